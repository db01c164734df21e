"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask keeps three words of a short window. The hashes of all masked windows of the benchmark are joined with
those of the documents; a hit only makes a candidate. Around each hit the document's and the item's words on
its diagonal (document position minus item position) are then compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SPACE, SPACE_CLASS, stored, text_key, text_or_empty, unused
from .licenses import computed

#: Any ENOUGH of REACH positions, or MOST of a shorter item's, hold all positions of one of these somewhere.
SEEDS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: A shorter item has to agree as a whole.
SPAN = 8
#: Words that have to agree, or MOST of a shorter item's.
ENOUGH, MOST = 13, 0.8
#: Words that agree have to lie within so many positions of the item.
REACH = 24
#: Benchmark seeds up to this many are sent to all executors (some 40 bytes each); more are joined by a shuffle.
BROADCAST_SEEDS = 1_000_000
#: A document's candidates are compared in groups of so many diagonals.
DIAGONALS = 4096


def with_words(df: DataFrame, *keep: str) -> DataFrame:
    """(keep, words): the lower-cased words of ``text``."""
    trimmed = F.btrim(F.lower(text_or_empty()), F.lit(SPACE))
    return computed(df, list(keep), "words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS)), F.lit(True))


def seed_rows(df: DataFrame, name: str, key: str, at: str, words: str) -> DataFrame:
    """(name, key, words, at, seed) of all masks, ``key`` being the text's and ``words`` how many it has.

    A text of one or two words has one seed, the whole of it, which no longer text has.
    """
    rows = with_words(df.select(F.col(name).cast("long").alias(name), text_key().alias(key), "text"), name, key)
    shifted = F.arrays_zip(*[F.slice("words", k + 1, F.size("words")).alias(f"w{k}") for k in range(4)])
    rows = rows.select(name, key, F.size("words").alias(words), F.posexplode(shifted).alias(at, "w"))
    seeds = [F.when(F.col(f"w.w{mask[-1]}").isNotNull(), F.xxhash64(*[F.col(f"w.w{k}") for k in mask], F.lit(m))) for m, mask in enumerate(SEEDS)]
    seeds.append(F.when((F.col(words) < 3) & (F.col(at) == 0), F.xxhash64("w.w0", "w.w1", F.lit(len(SEEDS)))))
    return rows.select(name, key, words, at, F.explode(F.array(*seeds)).alias("seed")).filter("seed IS NOT NULL")


def candidates(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(hit_id, hit_key, hits): a row for a text's hits on up to DIAGONALS diagonals; near is the part of the item."""
    items = stored(seed_rows(benchmark, "item_id", "item_key", "j", "item_words"), "seeds")
    if items.count() <= BROADCAST_SEEDS:
        items = F.broadcast(items)
    rows = seed_rows(documents, "doc_id", "doc_key", "i", "words").drop("words")
    near, diagonal = F.floor(F.col("j") / REACH).cast("int").alias("near"), (F.col("i") - F.col("j")).alias("diagonal")
    hits = rows.join(items, "seed").select("doc_id", "doc_key", "item_id", "item_key", "item_words", diagonal, near).distinct()
    found = F.collect_list(F.struct("item_id", "item_key", "item_words", "diagonal", "near")).alias("hits")
    grouped = hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("doc_key").alias("hit_key"), F.floor(F.col("diagonal") / DIAGONALS).alias("group"))
    return stored(grouped.agg(found).drop("group"), "hits")


def needed(words: Column, enough: int) -> Column:
    return F.when(words < SPAN, words).otherwise(F.least(F.lit(enough), F.ceil(words * MOST)))


def passages(documents: DataFrame, benchmark: DataFrame, enough: int) -> DataFrame:
    """(doc_id, text_key, item_id, matched) for every diagonal on which a text holds an item's passage."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", text_key())
    held = texts.join(candidates(documents, benchmark), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")))
    held = with_words(held, "doc_id", "text_key", "hits")

    def words_at(h: Column) -> Column:
        begin = F.greatest(F.lit(0), (h["near"] - 1) * REACH + 1, -h["diagonal"])
        end = F.least(h["item_words"], (h["near"] + 2) * REACH)
        ours = F.slice("words", begin + h["diagonal"] + 1, F.greatest(F.lit(0), end - begin))
        return F.struct(h["item_id"].alias("found_id"), h["item_key"].alias("found_key"), h["item_words"].alias("item_words"), begin.alias("begin"), ours.alias("ours"))

    pairs = held.select("doc_id", "text_key", F.explode(F.transform("hits", words_at)).alias("h")).select("doc_id", "text_key", "h.*")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_key().alias("item_key"), "text").dropDuplicates(["item_id", "item_key"])
    items = stored(with_words(items, "item_id", "item_key"), "items").withColumnRenamed("words", "theirs")
    pairs = pairs.join(items, F.col("item_id").eqNullSafe(F.col("found_id")) & (F.col("item_key") == F.col("found_key")))
    agree = F.zip_with("ours", F.slice("theirs", F.col("begin") + 1, F.size("ours")), lambda a, b: F.coalesce(a == b, F.lit(False)))
    names = ["doc_id", "text_key", "item_id", "item_words"]
    pairs = computed(pairs, names, "agree", agree, F.lit(True))
    pairs = pairs.filter(F.size(F.filter("agree", lambda x: x)) >= needed(F.col("item_words"), enough))  # few are left
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("agree") - (REACH - 1)))
    most = F.array_max(F.transform(starts, lambda a: F.size(F.filter(F.slice("agree", a, REACH), lambda x: x))))
    pairs = computed(pairs, names, "matched", most, F.lit(True))
    return pairs.filter(F.col("matched") >= needed(F.col("item_words"), enough)).drop("item_words")


def contaminated(documents: DataFrame, benchmark: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """(doc_id, item_id, matched) for every document that holds a benchmark item's passage.

    Reported are pairs where, on one diagonal and within REACH positions of the item, at least
    min(enough, ceil(0.8 * item words)) words agree; matched is the largest such number. With ``enough`` from
    ENOUGH on no such pair is missed. An item of fewer than SPAN words has to be there as a whole, one of one or
    two words as the whole text. Words are separated by ASCII white space and lower-cased. A null or empty item
    or text is never reported. Rows with the same doc_id or item_id give one row with the largest figure. A text
    of any length is compared around its hits only. Other columns are ignored. Empty tables give an empty result.
    """
    return passages(documents, benchmark, enough).groupBy("doc_id", "item_id").agg(F.max("matched").cast("int").alias("matched"))


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents``, with all their columns, that hold no passage of ``benchmark``.

    Rows go by doc_id and text, so clean rows stay that share the doc_id, or its lack, of a contaminated one.
    """
    of_id, of_key = unused(documents, "of_id", "of_key")
    found = stored(passages(documents, benchmark, ENOUGH).select(F.col("doc_id").alias(of_id), F.col("text_key").alias(of_key)).distinct(), "contaminated")
    return documents.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(of_id)) & (text_key() == F.col(of_key)), "left_anti").select(documents.columns)


def contaminated_sql(documents: str = "documents", benchmark: str = "benchmark", enough: int = ENOUGH) -> str:
    """The same in DuckDB SQL, from all words that agree."""

    def side(table: str, key: str, row: str, size: str, at: str) -> str:
        return f"""
        {key}_words AS (SELECT {key}, row_number() OVER () AS {row}, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table}),
        {key}_at AS (SELECT {key}, {row}, len(w) AS {size}, unnest(w) AS word, unnest(range(0, len(w))) AS {at} FROM {key}_words)"""

    return f"""
    WITH {side(documents, "doc_id", "doc_row", "words", "i")}, {side(benchmark, "item_id", "item_row", "item_words", "j")},
    agreeing AS (SELECT doc_id, doc_row, words, item_id, item_row, item_words, i - j AS diagonal, j FROM doc_id_at JOIN item_id_at USING (word)),
    counted AS (SELECT doc_id, words, item_id, item_words, count(*) OVER (PARTITION BY doc_row, item_row, diagonal ORDER BY j RANGE BETWEEN CURRENT ROW AND {REACH - 1} FOLLOWING) AS matched FROM agreeing)
    SELECT doc_id, item_id, max(matched)::INT AS matched FROM counted
    WHERE matched >= CASE WHEN item_words < {SPAN} THEN item_words ELSE least({enough}, ceil(item_words * {MOST})) END AND (item_words > 2 OR words = item_words)
    GROUP BY doc_id, item_id"""
