"""Counters over time: interval sums, and deltas of cumulative counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import CacheConfig
from ..functions.scalars import fmt_mem


def interval_counts(decisions: DataFrame, interval_us: int) -> DataFrame:
    """(interval, hits, misses, bytes_loaded) per tumbling interval of ``decisions`` (ts_us, outcome, weight)."""
    return decisions.groupBy(F.floor(F.col("ts_us") / interval_us).alias("interval")).agg(
        F.count_if(F.col("outcome") != "miss").alias("hits"), F.count_if(F.col("outcome") == "miss").alias("misses"), F.sum(F.when(F.col("outcome") == "miss", F.col("weight")).otherwise(0)).alias("bytes_loaded")
    )


def counter_deltas(snapshots: DataFrame, order: str, names: list[str], by: list[str] | None = None) -> DataFrame:
    """``snapshots`` with each cumulative counter's change since the one before, per ``by``.

    Negative counters count as 0; a counter that fell was reset, and its whole value is the change.
    """
    window = Window.partitionBy(*(by or [])).orderBy(order)
    for name in names:
        now = F.greatest(F.col(name), F.lit(0))
        before = F.greatest(F.lag(name).over(window), F.lit(0))
        snapshots = snapshots.withColumn(f"{name}_delta", F.when(before.isNull() | (now < before), now).otherwise(now - before))
    return snapshots


#: Counters of each record of the log; the last two of each evictor's are what it freed.
RECORDS = {
    "lifetime_manager": ("affected", "errors", "scans", "hits", "misses"),
    "admission_controller": ("allowed", "not_allowed"),
    "soft_evictor": ("scans", "hits", "freed_items", "freed_bytes"),
    "hard_evictor": ("freed_items", "freed_bytes"),
}


def log_records(snapshots: DataFrame, cfg: CacheConfig) -> DataFrame:
    """(interval, record, fields): what an interval's log says, from ``snapshots`` of cumulative counters.

    ``snapshots`` (interval, mem, entries, and each counter as record_counter, as in soft_evictor_hits). A record is
    written if its part is enabled, the hard evictor's only if it freed something, and the storage's always. fields:
    "name=value" with changes since the snapshot before; byte sizes in units.
    """
    names = [f"{record}_{c}" for record, counters in RECORDS.items() for c in counters]
    deltas = counter_deltas(snapshots, "interval", names)
    enabled = {"lifetime_manager": cfg.lifetime, "admission_controller": cfg.admission, "soft_evictor": cfg.eviction, "hard_evictor": cfg}

    def told(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}="), fmt_mem(value) if name.endswith("bytes") else value.cast("string"))

    made = []
    for record, counters in RECORDS.items():
        if enabled[record] is not None:
            fields = F.concat_ws(" ", *[told(c, F.col(f"{record}_{c}_delta")) for c in counters])
            useful = (F.col("hard_evictor_freed_items_delta") > 0) | (F.col("hard_evictor_freed_bytes_delta") > 0) if record == "hard_evictor" else F.lit(True)
            made.append(F.when(useful, F.struct(F.lit(record).alias("record"), fields.alias("fields"))))
    soft = fmt_mem(F.lit(cfg.eviction.soft_limit_bytes)) if cfg.eviction is not None else F.lit("INF")
    storage = F.concat(F.lit("size="), fmt_mem(F.col("mem")), F.lit(" entries="), F.col("entries").cast("string"), F.lit(" soft_limit="), soft, F.lit(" hard_limit="), fmt_mem(F.lit(cfg.db.size_bytes)))
    made.append(F.struct(F.lit("storage").alias("record"), storage.alias("fields")))
    return deltas.select("interval", F.explode(F.filter(F.array(*made), lambda r: r.isNotNull())).alias("r")).select("interval", "r.record", "r.fields")
