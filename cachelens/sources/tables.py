"""Access logs and entries made of the parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import key_hash
from ..functions.scalars import weight


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses (key, seq, ts_us, weight, op): users are keys, (ts, event_id) is the total order, seq its id."""
    events = table(spark, sf_dir, "events")
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(F.col("user_id").alias("key"), F.struct(ts.alias("ts_us"), F.col("event_id").alias("id")).alias("seq"), ts.alias("ts_us"), weight(F.col("props")).alias("weight"), F.col("event_type").alias("op"), F.col("event_id"))


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries (key, key_hash, shard, weight, touched): documents are payloads, doc_id is the recency."""
    docs = table(spark, sf_dir, "documents")
    h = key_hash(F.col("doc_id").cast("string"))
    return docs.select(F.col("doc_id").alias("key"), h.alias("key_hash"), h.bitwiseAND(1023).cast("int").alias("shard"), weight(F.col("text")).alias("weight"), F.col("doc_id").alias("touched"))


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the one that the cluster shares; only a local master has one of its own. It isn't deleted."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return f"{(root or '/tmp/checkpoints').rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a table in the folder that the cluster shares and read again, which cuts its lineage."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
