"""The bounded samples of labelled rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import text_key, text_or_empty

#: A classifier is fitted on at most so many bytes of text of either label, and on no text over ROW_BYTES (bounded sample).
SAMPLE_BYTES, ROW_BYTES = 64 << 20, 1 << 20

def labelled_sample(labels: DataFrame, label: str, rows_per_class: int, held_out_fold: bool) -> DataFrame:
    """(doc_id, label, held_out) of at most ``rows_per_class`` rows of either label, by hashed order.

    With ``held_out_fold`` only rows whose crc32(doc_id as text) mod 5 isn't 0 are taken. A doc_id that has
    both labels, a null id and labels other than 0 and 1 are left out.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    if held_out_fold:
        rows = rows.filter(~held_out())
    order = F.xxhash64("doc_id", F.lit("sample"))
    parts = [rows.filter(F.col("label") == k).orderBy(order, "doc_id").limit(rows_per_class) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def sampled_texts(documents: DataFrame, sample: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, label, place, columns) of a sample (doc_id, label) of few rows, in the hashed order ``place``.

    Of several texts with one doc_id the one with the smallest hash is taken, so a repeated task takes the same.
    Texts over ROW_BYTES are left out, and so are those that would bring a label to more than SAMPLE_BYTES.
    """
    rows = documents.withColumn("text_key", text_key()).filter(F.octet_length(text_or_empty()) <= ROW_BYTES)
    rows = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("text_key", *columns)).alias("row"))
    rows = rows.select("doc_id", "label", F.xxhash64("doc_id", F.lit("order")).alias("place"), *[F.col(f"row.{c}").alias(c) for c in columns])
    upto = F.sum(F.octet_length(text_or_empty())).over(Window.partitionBy("label").orderBy("place", "doc_id"))  # the rows of a sample only
    return rows.withColumn("upto", upto).filter(F.col("upto") <= SAMPLE_BYTES).drop("upto")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
