"""Ranks and running sums over a whole order without a task that holds all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running(df: DataFrame, by: list[str], bucket: Column, order: list, values: dict[str, Column]) -> DataFrame:
    """``df`` with the sum of each of ``values`` over the rows before, per ``by`` and in ``order``.

    ``bucket`` never falls along the order. Sums of whole buckets are added up first, one row a bucket, and only rows of
    one bucket are sorted together; finer buckets make smaller tasks.
    """
    keyed = df.withColumn("in_bucket", bucket)
    names = [*by, "in_bucket"]
    sums = keyed.groupBy(*[F.col(n).alias(f"of_{n}") for n in names]).agg(*[F.sum(v).alias(f"held_{n}") for n, v in values.items()])
    before = Window.partitionBy(*[f"of_{n}" for n in by]).orderBy("of_in_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[f"of_{n}" for n in names], *[F.coalesce(F.sum(f"held_{n}").over(before), F.lit(0)).alias(f"before_{n}") for n in values])
    within = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"of_{n}"))
    out = keyed.withColumns({f"within_{n}": F.coalesce(F.sum(v).over(within), F.lit(0)) for n, v in values.items()}).join(sums, same)
    return out.select(*df.columns, *[(F.col(f"before_{n}") + F.col(f"within_{n}")).alias(n) for n in values])


def running_max(df: DataFrame, by: list[str], bucket: Column, order: list, name: str, value: Column) -> DataFrame:
    """``df`` with the largest ``value`` of the rows up to each, per ``by`` and in ``order``, as ``name``; see running."""
    keyed = df.withColumn("in_bucket", bucket)
    names = [*by, "in_bucket"]
    tops = keyed.groupBy(*[F.col(n).alias(f"of_{n}") for n in names]).agg(F.max(value).alias("top"))
    before = Window.partitionBy(*[f"of_{n}" for n in by]).orderBy("of_in_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*[f"of_{n}" for n in names], F.max("top").over(before).alias("top_before"))
    within = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"of_{n}"))
    return keyed.withColumn("top_within", F.max(value).over(within)).join(tops, same).select(*df.columns, F.greatest("top_within", "top_before").alias(name))
