"""Helpers that the training-data operators share: tables, work folders and column checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on a local master where the session names no shared folder, as in tests.
LOCAL_WORK_DIR = "/tmp/checkpoints"

#: Word pattern of all operators here: runs of anything but ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder name below the checkpoint folder that the whole cluster shares. What is written there isn't deleted."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    root = root or LOCAL_WORK_DIR
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again, which cuts its lineage."""
    path = work_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(col: str = "text") -> Column:
    """The column as a string, an empty one for null."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_key(col: str = "text") -> Column:
    """A 64-bit hash that tells the texts of rows with one id apart; a null counts as empty."""
    return F.xxhash64(text_or_empty(col))


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Lower-cased words of a text, an empty array for none."""
    return F.filter(F.split(ascii_lower(text), SPACE_CLASS), lambda w: w != "")


def documents_only(df: DataFrame) -> DataFrame:
    """The columns of ``documents`` that are there, in their order."""
    return df.select(*[c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in df.columns])
