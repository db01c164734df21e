"""Quality scores by co-training of two views of a document.

The content view sees what the text is made of: hashed byte trigrams. The metadata view sees only the row's
metadata and layout: language, source, length, lines, and shares of symbols, capitals and repeats. Each view
has a logistic regression. In each round, each classifier scores all rows of the corpus but those that are learnt
from, and gives the ones it is surest of, labelled by itself, to the other one. Both are then calibrated on labelled rows
that they haven't learnt from, and the score is the mean of their calibrated log odds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stored, text_key
from .sampling import labelled_sample, sampled_texts
from .textops import distinct_sets, ngram_hashes, slices, strings, word_hashes

SLICE_BYTES = 2 << 20
CONTENT, SOURCES = 2048, 64
#: The classifiers are fitted on at most so many labelled rows of either class (bounded sample), and on no more bytes than sampling.SAMPLE_BYTES.
ROWS_PER_CLASS = 2048
#: Rounds of exchange, and how many rows a view gives away in each: the surest of the whole corpus.
ROUNDS, GIVEN = 3, 256
#: Log odds from which a view is sure.
SURE = 2.0
#: A document is kept from this score on: below it, it is at least twice as likely to be bad.
LEAST_SCORE = 1 / 3


def content_view(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text, ln(1 + 1000 * share) of its byte trigrams, hashed."""
    out = np.zeros((len(offsets) - 1, CONTENT), np.float32)
    for i, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if z - a >= 3:
            b = raw[a:z].astype(np.uint32)
            grams = ((b[:-2] * 0x1F35 + b[1:-1] * 0x2E9B5 + b[2:] * 0x3C6EF35) * np.uint32(0x9E3779B1)) >> np.uint32(21)
            out[i] = np.log1p(np.bincount(grams, minlength=CONTENT) * (1000 / (z - a)))
    return out


def layout(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: ln of its bytes and words, words a line, word length, shares of capitals, symbols, digits, distinct words and word pairs."""
    out = np.zeros((len(offsets) - 1, 9), np.float32)
    words, at = word_hashes(raw, offsets)
    n = np.diff(at)
    single = np.diff(distinct_sets(words, at)[1])
    pairs = np.diff(distinct_sets(*ngram_hashes(words, at, 2, short=True))[1])
    kinds = np.zeros(256, np.uint8)
    kinds[10], kinds[65:91], kinds[48:58] = 1, 2, 3
    for c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
        kinds[c] = 4
    for i, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if z > a:
            seen = np.bincount(kinds[raw[a:z]], minlength=5)
            out[i] = (np.log1p(z - a), np.log1p(n[i]), np.log1p(n[i] / (1 + seen[1])), np.log1p((z - a) / max(n[i], 1)), seen[2] / (z - a), seen[4] / (z - a), seen[3] / (z - a), single[i] / max(n[i], 1), pairs[i] / max(n[i] - 1, 1))
    return out


def views(piece: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(content, metadata) matrices of a table (text, lang, source)."""
    raw, offsets = strings(piece["text"])
    meta = np.zeros((len(offsets) - 1, 9 + SOURCES), np.float32)
    meta[:, :9] = layout(raw, offsets)
    for name in ("lang", "source"):
        for i, value in enumerate(piece[name].to_pylist()):
            meta[i, 9 + zlib.crc32(f"{name}={value}".encode()) % SOURCES] = 1
    return content_view(raw, offsets), meta


class Logistic:
    """Logistic regression with L2 on standardised columns, by gradient steps with momentum."""

    def __init__(self, x: np.ndarray, y: np.ndarray, l2: float, steps: int = 200):
        self.mean, self.scale = x.mean(0), x.std(0) + 0.05
        x = (x - self.mean) / self.scale
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        w, b = np.zeros(x.shape[1], np.float32), 0.0
        speed, speed_b = np.zeros_like(w), 0.0
        rate = 4.0 / (1 + np.square(x).sum(1).mean() * 0.25)
        for _ in range(steps):
            g = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * weight / len(y)
            speed = 0.9 * speed - rate * (x.T @ g + l2 * w)
            speed_b = 0.9 * speed_b - rate * g.sum()
            w, b = w + speed, b + speed_b
        self.w, self.b = w / self.scale, float(b - (self.mean / self.scale) @ w)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b


def calibration(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's (slope, offset), by Newton steps with his smoothed targets."""
    good, bad = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * odds + b, -30, 30)))
        r, s = p - t, p * (1 - p) + 1e-6
        h = np.array([[(s * odds * odds).sum() + 1e-3, (s * odds).sum()], [(s * odds).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(h, [(r * odds).sum(), r.sum()])
        a, b = a - step[0], b - step[1]
        a, b = float(np.clip(a, 0.01, 20)), float(np.clip(b, -20, 20))
    return a, b


def fit_views(content: np.ndarray, meta: np.ndarray, label: np.ndarray, view: np.ndarray, mark: np.ndarray) -> dict | None:
    """The calibrated model of labelled rows (``view`` -1) and of rows given to a view with a ``mark``; None unless both labels are there."""
    known = np.flatnonzero(view < 0)
    if len(known) < 8 or len(np.unique(label[known])) < 2:
        return None
    held, learn = known[::4], np.setdiff1d(known, known[::4])
    if len(np.unique(label[learn])) < 2 or len(np.unique(label[held])) < 2:
        held = learn = known
    models = []
    for v, x, l2 in ((0, content, 3e-3), (1, meta, 1e-3)):
        given = np.flatnonzero(view == v)
        models.append(Logistic(x[np.concatenate([learn, given])], np.concatenate([label[learn], mark[given]]).astype(np.float32), l2))
    scales = [calibration(m.odds(x[held]), label[held]) for m, x in zip(models, (content, meta))]
    return {"w0": models[0].w, "w1": models[1].w, "rest": np.array([models[0].b, models[1].b, *scales[0], *scales[1], label[learn].mean()])}


MODEL_FIELDS = "w0 binary, w1 binary, rest binary"
ROW_FIELDS = "doc_id long, label int, place long, view int, mark int, content binary, meta binary"


def fit_task(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["view", "place", "doc_id"], kind="stable")
    content = np.stack([np.frombuffer(x, np.float16) for x in rows["content"]]).astype(np.float32)
    meta = np.stack([np.frombuffer(x, np.float32) for x in rows["meta"]])
    model = fit_views(content, meta, rows["label"].to_numpy(), rows["view"].to_numpy(), rows["mark"].to_numpy())
    if model is None:
        return pd.DataFrame({"w0": [], "w1": [], "rest": []}, dtype=object)
    return pd.DataFrame({"w0": [model["w0"].astype(np.float32).tobytes()], "w1": [model["w1"].astype(np.float32).tobytes()], "rest": [model["rest"].astype(np.float64).tobytes()]})


def fitted(rows: DataFrame) -> dict | None:
    """The model of featured rows (ROW_FIELDS), which one task holds: the labelled sample and 2 * ROUNDS * GIVEN rows."""
    got = rows.groupBy(F.lit(0).alias("all")).applyInPandas(fit_task, MODEL_FIELDS).collect()
    if not got:
        return None
    return {"w0": np.frombuffer(got[0]["w0"], np.float32), "w1": np.frombuffer(got[0]["w1"], np.float32), "rest": np.frombuffer(got[0]["rest"], np.float64)}


def raw_odds(piece: pa.Table, model: dict) -> tuple[np.ndarray, np.ndarray]:
    content, meta = views(piece)
    return content @ model["w0"] + model["rest"][0], meta @ model["w1"] + model["rest"][1]


def surest_task(model: dict, learnt: np.ndarray, given: int):
    """Of a partition's rows that aren't learnt from, the ``given`` surest of either sign for each view, a text once."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("by", pa.int32()), ("odds", pa.float64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {}
        for piece in slices(batches, SLICE_BYTES):
            ids, keys = (piece[c].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key"))
            free = ~np.isin(keys, learnt) & np.asarray(piece["doc_id"].combine_chunks().is_valid())
            for v, odds in enumerate(raw_odds(piece, model)):
                for sign in (1, -1):
                    at = np.flatnonzero(free & (sign * odds > SURE))
                    rows = np.rec.fromarrays([-sign * odds[at].astype(np.float64), keys[at], ids[at]], names="far,key,id")
                    rows = np.concatenate([best.get((v, sign), rows[:0]), rows])
                    best[v, sign] = first_of_each(rows)[:given]
        for (v, sign), rows in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(rows["id"]), pa.array(rows["key"]), pa.array(np.full(len(rows), v, np.int32)), pa.array(-sign * rows["far"])], schema=schema)

    return task


def first_of_each(rows: np.ndarray) -> np.ndarray:
    """Sorted rows (far, key, id), the first of each key."""
    rows = np.sort(rows, order=["far", "key", "id"])
    return rows[np.sort(np.unique(rows["key"], return_index=True)[1])]


def view_columns(documents: DataFrame) -> DataFrame:
    def text(name: str):
        return F.col(name).cast("string").alias(name) if name in documents.columns else F.lit(None).cast("string").alias(name)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text("text"), text("lang"), text("source"))


def featured(rows: DataFrame) -> DataFrame:
    """ROW_FIELDS of rows (doc_id, label, place, view, mark, text, lang, source)."""
    names = ("doc_id", "label", "place", "view", "mark")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, SLICE_BYTES):
            content, meta = views(piece)
            columns = {c: piece[c].combine_chunks() for c in names}
            yield pa.RecordBatch.from_pydict(columns | {"content": pa.array([x.astype(np.float16).tobytes() for x in content], pa.binary()), "meta": pa.array([x.tobytes() for x in meta], pa.binary())})

    return rows.select(*names, "text", "lang", "source").mapInArrow(task, ROW_FIELDS)


def surest(keyed: DataFrame, model: dict, learnt: list[int], given: int) -> list[tuple]:
    """(doc_id, text_key, view, mark) of the rows that each view gives to the other one, in the labels' shares."""
    found = keyed.mapInArrow(surest_task(model, np.array(learnt, np.int64), given), "doc_id long, text_key long, by int, odds double")
    found = stored(found.groupBy("text_key", "by").agg(F.min("doc_id").alias("doc_id"), F.min("odds").alias("odds")), "surest")
    good = max(1, int(given * model["rest"][6]))
    out = []
    for by in (0, 1):
        for mark, most, order in ((1, good, F.desc("odds")), (0, given - good, F.asc("odds"))):
            side = found.filter((F.col("by") == by) & ((F.col("odds") > 0) == (mark == 1)))
            out += [(r.doc_id, r.text_key, 1 - by, mark) for r in side.orderBy(order, "doc_id", "text_key").limit(most).collect()]
    return out


def fit_quality(documents: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, rounds: int = ROUNDS, given: int = GIVEN) -> dict | None:
    """The model of a bounded sample of ``labels`` (doc_id, quality), by hashed id, and of all ``documents``.

    Each round reads the corpus twice: to score every row that isn't in the sample nor given yet, and to fetch the few
    rows that are given. A text that occurs often is given once.
    """
    keyed = view_columns(documents).withColumn("text_key", text_key())
    sample = labelled_sample(labels, "quality", rows_per_class, held_out_fold=False)
    known = sampled_texts(keyed, sample, "text", "lang", "source").withColumn("view", F.lit(-1)).withColumn("mark", F.lit(-1))
    rows = stored(featured(known).join(known.select("doc_id", text_key().alias("text_key")), "doc_id"), "labelled")
    learnt = [r[0] for r in rows.select("text_key").collect()]
    rows = rows.drop("text_key")
    spark = documents.sparkSession
    for _ in range(rounds):
        model = fitted(rows)
        chosen = surest(keyed, model, learnt, given) if model is not None else []
        if not chosen:
            return model
        learnt += [r[1] for r in chosen]
        few = F.broadcast(spark.createDataFrame(chosen, "of_id long, of_key long, view int, mark int"))  # at most 2 * given rows
        same = (F.col("doc_id") == F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
        texts = keyed.join(few, same).groupBy("doc_id", "text_key", "view", "mark").agg(F.min(F.struct("text", "lang", "source")).alias("row"))
        texts = texts.select("doc_id", F.lit(-1).alias("label"), F.xxhash64("doc_id", F.lit("order")).alias("place"), "view", "mark", "row.*")
        rows = stored(rows.unionByName(featured(texts)), "given")
    return fitted(rows)


def scorer(model: dict | None):
    """A function from a table (text, lang, source) to (content, metadata, combined) scores."""

    def score(piece: pa.Table) -> np.ndarray:
        odds = np.zeros((3, piece.num_rows))
        if model is not None:
            content, meta = raw_odds(piece, model)
            s0, o0, s1, o1 = model["rest"][2:6]
            odds[0] = np.clip(s0 * content + o0, -12, 12)
            odds[1] = np.clip(s1 * meta + o1, -12, 12)
            odds[2] = (odds[0] + odds[1]) / 2
        return 1 / (1 + np.exp(-odds))

    return score


def score_quality(documents: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, content_score, metadata_score, score) for every row; all 0.5 without a model."""
    score = scorer(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, SLICE_BYTES):
            scores = score(piece)
            yield pa.RecordBatch.from_pydict({"doc_id": piece["doc_id"].combine_chunks(), "content_score": pa.array(scores[0]), "metadata_score": pa.array(scores[1]), "score": pa.array(scores[2])})

    return view_columns(documents).mapInArrow(task, "doc_id long, content_score double, metadata_score double, score double")


def drop_low_quality(documents: DataFrame, labels: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``documents``, with all their columns, that score ``least`` or more."""
    score = scorer(fit_quality(documents, labels))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, SLICE_BYTES):
            view = pa.table({n: piece[n].cast(pa.string()) if n in piece.column_names else pa.nulls(piece.num_rows, pa.string()) for n in ("text", "lang", "source")})
            yield from piece.filter(pa.array(score(view)[2] >= least)).to_batches()

    return documents.mapInArrow(task, documents.schema)


def quality(documents: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, rounds: int = ROUNDS, given: int = GIVEN) -> DataFrame:
    """(doc_id, content_score, metadata_score, score, keep) for every row of ``documents`` (doc_id, text, lang, source).

    The scores are probabilities that the quality label is 1; keep: score >= LEAST_SCORE. Without rows of both
    labels every score is 0.5 and everything is kept. A null text counts as empty; null or missing lang and
    source are values of their own. Rows with the same doc_id each give a row, and one of them is learnt from,
    the same in every run; rows without an id aren't learnt from. A text of any length is scored as a whole by one
    task. Other columns are ignored; an empty table gives an empty result.
    """
    scored = score_quality(documents, fit_quality(documents, labels, rows_per_class, rounds, given))
    return scored.withColumn("keep", F.col("score") >= LEAST_SCORE)
