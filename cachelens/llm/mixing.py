"""Mixing of sources to target weights by Poisson replication, in DataFrame functions only.

A source's mean repetition is its target share of the output over its share of the input. Each document draws
its number of copies by inverting the Poisson distribution at uniforms hashed from (seed, doc_id); documents
are exploded by that number and dealt out in hashed order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import stored, unused

#: A draw with a larger mean is a sum of draws with means up to this one.
PIECE_MEAN = 4.0
#: Terms of the distribution: at PIECE_MEAN the rest is below 2**-60, finer than the uniforms.
TERMS = 40


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, hashed from the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def target_means(documents: DataFrame, targets: DataFrame | None, temperature: float, total: float | None) -> DataFrame:
    """(source, pieces, cdf): how many draws a document takes and their distribution function."""
    counts = documents.groupBy("source").agg(F.count("*").alias("rows"))
    if targets is None:
        weighted = counts.withColumn("weight", F.pow(F.col("rows").cast("double"), F.lit(temperature)))
    else:
        named = targets.select(F.col("source").alias("named"), F.col("weight").cast("double"))
        weighted = counts.join(named, F.col("source").eqNullSafe(F.col("named")), "left").select("source", "rows", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    all_rows, all_weight = weighted.agg(F.sum("rows"), F.sum("weight")).first()
    mean = F.col("weight") / F.lit(all_weight or 1.0) * F.lit(float(total if total is not None else all_rows or 0)) / F.col("rows")
    means = weighted.select("source", mean.alias("mean"))
    pieces = F.ceil(F.col("mean") / PIECE_MEAN).cast("int")
    means = means.select("source", pieces.alias("pieces"), (F.col("mean") / F.greatest(pieces, F.lit(1))).alias("piece_mean"))
    steps = F.sequence(F.lit(1), F.lit(TERMS))
    start = F.struct(F.exp(-F.col("piece_mean")).alias("p"), F.array(F.exp(-F.col("piece_mean"))).alias("cdf"))

    def add(state: Column, k: Column) -> Column:
        p = state["p"] * F.col("piece_mean") / k
        return F.struct(p.alias("p"), F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + p)).alias("cdf"))

    return means.select("source", "pieces", F.aggregate(steps, start, add)["cdf"].alias("cdf"))


def mix_sources(documents: DataFrame, targets: DataFrame | None = None, temperature: float = 0.5, total: float | None = None, seed: str = "mix-1") -> DataFrame:
    """All columns of ``documents`` plus copy (0, 1, ...) and position (a hashed key), in shuffled order.

    ``targets`` (source, weight) gives each source's share; a source that it doesn't name goes. Without it a
    source weighs its row count to the power ``temperature``. ``total`` is the expected number of output
    rows, by default the number of input rows. A null source is a source of its own. Rows with the same
    doc_id draw alike; a null doc_id draws as the text "null". An empty table gives an empty result. Rows are
    dealt to partitions by the hashed key and sorted by it, which orders them at random over the whole
    output; a source of any size spreads evenly. Columns named copy or position are replaced, all others stay.
    """
    documents = documents.drop("copy", "position")
    of_source, pieces, cdf, copies = unused(documents, "mean_source", "pieces", "cdf", "copies")
    # A written table has a known size, by which the planner broadcasts it or not.
    means = stored(target_means(documents, targets, temperature, total), "means").toDF(of_source, pieces, cdf)
    joined = documents.join(means, F.col("source").eqNullSafe(F.col(of_source)))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    drawn = F.transform(F.sequence(F.lit(1), F.col(pieces)), lambda k: uniform(F.lit(seed), name, k.cast("string")))
    drawn = F.transform(drawn, lambda u: F.size(F.filter(F.col(cdf), lambda c: u >= c)))
    number = F.when(F.col(pieces) > 0, F.aggregate(drawn, F.lit(0), lambda a, b: a + b)).otherwise(F.lit(0))
    out = joined.withColumn(copies, number).drop(of_source, pieces, cdf).filter(F.col(copies) > 0)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(copies) - 1))).drop(copies)
    out = out.withColumn("position", F.md5(F.concat_ws("|", F.lit(seed), name, F.col("copy").cast("string"))))
    return out.repartition("position").sortWithinPartitions("position")


def mix_sql(table: str = "documents", temperature: float = 0.5, seed: str = "mix-1", columns: str = "doc_id, text, lang, source, n_chars") -> str:
    """The same rows in DuckDB SQL."""
    return f"""
    WITH RECURSIVE counts AS (SELECT source, count(*) AS n_rows FROM {table} GROUP BY source),
    weighted AS (SELECT source, n_rows, pow(n_rows::DOUBLE, {temperature}) AS weight FROM counts),
    sums AS (SELECT sum(n_rows)::DOUBLE AS all_rows, sum(weight) AS all_weight FROM weighted),
    means AS (SELECT source, weight / all_weight * all_rows / n_rows AS mean FROM weighted, sums),
    split AS (SELECT source, ceil(mean / {PIECE_MEAN})::INT AS pieces, mean / greatest(ceil(mean / {PIECE_MEAN}), 1) AS piece_mean FROM means),
    terms AS (
        SELECT source, 0 AS k, exp(-piece_mean) AS p, exp(-piece_mean) AS cdf, piece_mean FROM split
        UNION ALL
        SELECT source, k + 1, p * piece_mean / (k + 1), cdf + p * piece_mean / (k + 1), piece_mean FROM terms WHERE k < {TERMS}),
    draws AS (
        SELECT d.*, s.pieces, coalesce(doc_id::VARCHAR, 'null') AS draw_name, row_number() OVER () AS row_id
        FROM {table} d JOIN split s ON d.source IS NOT DISTINCT FROM s.source),
    uniforms AS (
        SELECT row_id, source, ('0x' || substr(md5('{seed}|' || draw_name || '|' || piece), 1, 13))::BIGINT / {float(1 << 52)} AS u
        FROM (SELECT row_id, source, draw_name, unnest(range(1, pieces + 1)) AS piece FROM draws)),
    counted AS (
        SELECT row_id, count(*) AS copies FROM uniforms w JOIN terms t ON t.source IS NOT DISTINCT FROM w.source AND w.u >= t.cdf GROUP BY row_id),
    copied AS (SELECT d.*, unnest(range(0, copies)) AS copy FROM draws d JOIN counted USING (row_id))
    SELECT {columns}, copy::INT AS copy, md5('{seed}|' || draw_name || '|' || copy) AS position FROM copied"""
