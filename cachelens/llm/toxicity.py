"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its words, word pairs, and pairs with one word between.
Per-coordinate learning rates and L1 leave few weights, which are sent to all tasks with the scoring function.
Words are runs of letters and digits (any non-ASCII byte counts as a letter), A-Z lower-cased.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import held_out, labelled_sample, sampled_texts
from .textops import U64, distinct_sets, mix64, slices, strings, sums, word_hashes

SLICE_BYTES = 2 << 20
#: Features are hashed to so many bits; the weights of them can't be more.
HASH_BITS = 20
#: The classifier is fitted on at most so many labelled rows of either class (bounded sample), and on no more bytes than sampling.SAMPLE_BYTES.
ROWS_PER_CLASS = 4096
#: Chosen on an inner fold of the rows that are learnt from.
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 5.0, 0.1, 6
#: What an example of either class weighs.
CLEAN_WEIGHT, TOXIC_WEIGHT = 0.5, 1.0


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct feature numbers of each text, and where each text's begin."""
    raw, offsets = strings(column)
    words, at = word_hashes(raw, offsets, plain=True)
    size = np.diff(at)
    owner = np.repeat(np.arange(len(size)), size)
    own, whose = [words], [owner]
    for gap, salt in ((1, 0x2545F491), (2, 0x9E6C63D0)):
        if len(words) > gap:
            inside = owner[gap:] == owner[:-gap]
            own.append(mix64(words[:-gap] * U64(3) + words[gap:] + U64(salt))[inside])
            whose.append(owner[gap:][inside])
    found, whose = np.concatenate(own) & U64((1 << HASH_BITS) - 1), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    counts = np.bincount(whose, minlength=len(size))
    return distinct_sets(found[order], np.concatenate([[0], np.cumsum(counts)]))


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature numbers, their weights, bias) of FTRL-proximal logistic regression; examples go in the given order."""
    z, n = np.zeros(1 << HASH_BITS), np.zeros(1 << HASH_BITS)
    bias, bias_n = 0.0, 0.0

    def current(at: np.ndarray) -> np.ndarray:
        own = z[at]
        shrunk = np.sign(own) * np.maximum(np.abs(own) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for at, y, importance in zip(rows, labels.tolist(), weights.tolist()):
            w = current(at)
            p = 1 / (1 + math.exp(-max(min(bias + float(w.sum()), 35), -35)))
            g = (p - y) * importance
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
            bias_n += g * g
            bias -= 0.1 * g / math.sqrt(1 + bias_n)
    at = np.flatnonzero(np.abs(z) > L1)
    return at, current(at), bias


def fit_task(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One row with the model; examples go in hashed order of their ids."""
    rows = rows.sort_values(["place", "doc_id"], kind="stable")
    labels = rows["label"].to_numpy().astype(float)
    if len(np.unique(labels)) < 2:
        return pd.DataFrame({"at": [], "weights": [], "bias": []}, dtype=object)
    found = [np.frombuffer(x, np.uint32) for x in rows["found"]]
    at, w, bias = fit_ftrl(found, labels, np.where(labels > 0, TOXIC_WEIGHT, CLEAN_WEIGHT))
    return pd.DataFrame({"at": [at.astype(np.uint32).tobytes()], "weights": [w.astype(np.float32).tobytes()], "bias": [bias]})


def fit_toxicity(documents: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> tuple[np.ndarray, np.ndarray, float]:
    """The model (feature numbers, weights, bias), learnt from ``labels`` (doc_id, toxic) outside the held-out fold.

    Without any labelled row, or with one label only, the model has no weights.
    """
    sample = labelled_sample(labels, "toxic", rows_per_class, held_out_fold=True)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, SLICE_BYTES):
            found, at = features(piece["text"])
            blobs = [found[a:z].astype(np.uint32).tobytes() for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_pydict({"doc_id": piece["doc_id"].combine_chunks(), "label": piece["label"].combine_chunks(), "place": piece["place"].combine_chunks(), "found": pa.array(blobs, pa.binary())})

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = sampled_texts(texts, sample, "text").select("doc_id", "label", "place", "text").mapInArrow(task, "doc_id long, label int, place long, found binary")
    got = rows.groupBy(F.lit(0).alias("all")).applyInPandas(fit_task, "at binary, weights binary, bias double").collect()
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0
    return np.frombuffer(got[0]["at"], np.uint32).astype(np.int64), np.frombuffer(got[0]["weights"], np.float32), float(got[0]["bias"])


def scorer(model: tuple[np.ndarray, np.ndarray, float]):
    """A function from a text column to scores."""
    at, weights, bias = model

    def score(column) -> np.ndarray:
        dense = np.zeros(1 << HASH_BITS, np.float32)
        dense[at] = weights
        found, ends = features(column)
        return 1 / (1 + np.exp(-np.clip(bias + sums(dense[found.astype(np.int64)].astype(np.float64), ends), -35, 35)))

    return score


def score_toxicity(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, score) for every row; a null or empty text gets the score of no features."""
    score = scorer(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, SLICE_BYTES):
            yield pa.RecordBatch.from_pydict({"doc_id": piece["doc_id"].combine_chunks(), "score": pa.array(score(piece["text"]))})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, "doc_id long, score double")


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents``, with all their columns, that score below ``threshold``; all of them if nothing could be learnt."""
    model = fit_toxicity(documents, labels)
    if not len(model[0]) and not model[2]:
        return documents
    score = scorer(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, SLICE_BYTES):
            yield from piece.filter(pa.array(score(piece["text"]) < threshold)).to_batches()

    return documents.mapInArrow(task, documents.schema)


def toxicity(documents: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``documents``.

    Only texts are inputs of a score; equal texts have equal scores. held_out: crc32(doc_id as text) mod 5 is
    0 (false for a null id); such rows are never learnt from. Null and empty texts are scored as having no
    words. Rows with the same doc_id each give a row, and one of them is learnt from, the same in every run.
    A text of any length is scored as a whole by one task. Without rows of both labels every score is 0.5. Other
    columns are ignored; an empty table gives an empty result.
    """
    scored = score_toxicity(documents, fit_toxicity(documents, labels, rows_per_class))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
