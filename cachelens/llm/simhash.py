"""SimHash fingerprints of documents and the search for near ones.

Weighted term hashes vote on 128 signed bits. Terms are runs of three words (a shorter text's whole
sequence) with weight 1 + ln(count), in whole 256ths, so that equal texts have equal votes on any machine. Permuted block
tables then find every pair of fingerprints within a Hamming radius: with radius r the bits are cut into r + 1 blocks,
and two fingerprints that differ in at most r bits agree on at least one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stored
from .components import components
from .textops import U64, mix64, ngram_hashes, slices, strings, word_hashes

BITS = 128
TERM_WORDS = 3
SLICE_BYTES = 4 << 20


def fingerprints(column) -> np.ndarray:
    """A row of 16 bytes for each text; all 0 for a text without words."""
    raw, offsets = strings(column)
    terms, at = ngram_hashes(*word_hashes(raw, offsets), TERM_WORDS, short=True)
    out = np.zeros((len(at) - 1, BITS // 8), np.uint8)
    for i in np.flatnonzero(np.diff(at)).tolist():
        names, count = np.unique(terms[at[i] : at[i + 1]], return_counts=True)
        # Sums of 4096 weights of at most 2**12 are exact in this type.
        weight = np.rint(256 * (1 + np.log(np.minimum(count, 1 << 20)))).astype(np.float32)
        votes, total = np.zeros(BITS, np.float64), float(weight.sum(dtype=np.float64))
        for a in range(0, len(names), 4096):
            part = names[a : a + 4096]
            words = np.stack([mix64(part ^ U64(0x1234567)), mix64(part ^ U64(0x89ABCDEF))], 1)
            bits = np.unpackbits(words.view(np.uint8).reshape(len(part), BITS // 8), axis=1)
            votes += weight[a : a + 4096] @ bits
        out[i] = np.packbits(2 * votes > total)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.unpackbits(a ^ b, axis=1).sum(1) / BITS


def hexed(prints: np.ndarray) -> list[str]:
    return [p.tobytes().hex() for p in prints]


EDIT_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_rows(ids: list, texts: list[str], following: list[str]) -> dict[str, list]:
    """What edit_likeness returns, for texts with the text that follows each."""
    import hashlib

    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following)]
    kind = pa.large_string()
    own, other, after = (fingerprints(pa.array(x, kind)) for x in (texts, edited, following))
    return {
        "doc_id": ids,
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": hexed(own),
        "edited_fingerprint": hexed(other),
        "near_edited": likeness(own, other).tolist(),
        "near_next": likeness(own, after).tolist(),
    }


def edit_task():
    """Rows of a sorted partition; its last row comes without figures, and its first one again as head."""
    numbers = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("kind", pa.string()), ("text", pa.string())])

    def edge(kind: str, doc_id, text: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"doc_id": doc_id, "kind": kind, "text": text}], schema=numbers)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, which waits for its next one
        for piece in slices(batches, SLICE_BYTES):
            ids, texts = piece["doc_id"].to_pylist(), piece["text"].to_pylist()
            if held is None:
                yield edge("head", ids[0], texts[0])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = ids[-1], texts[-1]
            if len(ids) > 1:
                rows = edit_rows(ids[:-1], texts[:-1], texts[1:])
                yield pa.RecordBatch.from_pydict(rows | {"kind": ["row"] * (len(ids) - 1), "text": [None] * (len(ids) - 1)}, schema=numbers)
        if held is not None:
            yield edge("tail", *held)

    return task


def edit_likeness(documents: DataFrame) -> DataFrame:
    """Fingerprint of every document and of its edited text (see EDIT_FIELDS).

    The edited text has the last floor(n / 2) of the document's n code points replaced by the first as many
    of the next document, all if that has fewer, by ascending doc_id and then text; the last document is
    followed by the first. A null text counts as empty. A null doc_id comes first. Rows with the same doc_id
    follow each other by text. Other columns are ignored; an empty table gives an empty result.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    done = stored(dealt.mapInArrow(edit_task(), f"{EDIT_FIELDS}, kind string, text string"), "edits")
    # Two edges per partition: each tail is followed by the head of the next partition that has rows.
    edges = done.filter("kind <> 'row'").select("doc_id", "kind", "text")
    ranked = [r for r in edges.select("doc_id", "kind").toLocalIterator()]  # two per partition, without texts
    order = sorted((r[0] for r in ranked if r[1] == "head"), key=lambda x: (x is not None, x or 0))
    tails = sorted((r[0] for r in ranked if r[1] == "tail"), key=lambda x: (x is not None, x or 0))
    spark = documents.sparkSession
    pairs = spark.createDataFrame(list(zip(tails, order[1:] + order[:1])), "tail long, head long")
    own = edges.filter("kind = 'tail'").select(F.col("doc_id").alias("tail"), "text")
    heads = edges.filter("kind = 'head'").select(F.col("doc_id").alias("head"), F.col("text").alias("following"))
    met = pairs.join(own, pairs["tail"].eqNullSafe(own["tail"])).drop(own["tail"]).join(heads, pairs["head"].eqNullSafe(heads["head"])).select(F.col("tail").alias("doc_id"), "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1).to_pydict()
                rows = edit_rows(one["doc_id"], one["text"], one["following"])
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(k, pa.int64() if k in ("doc_id", "n_chars") else pa.float64() if k.startswith("near") else pa.string()) for k in rows]))

    names = [x.split()[0] for x in EDIT_FIELDS.split(", ")]
    return done.filter("kind = 'row'").select(names).unionByName(met.mapInArrow(finish, EDIT_FIELDS))


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): 32 hex digits for every row; a null or empty text has all zeros."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, SLICE_BYTES):
            yield pa.RecordBatch.from_pydict({"doc_id": piece["doc_id"].combine_chunks(), "fingerprint": hexed(fingerprints(piece["text"]))})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, "doc_id long, fingerprint string")


#: Fingerprints of a cell; a bucket of more is dealt to chunks, and each pair of chunks is a cell.
CELL = 4096


def blocks_of(radius: int) -> list[tuple[int, int]]:
    """The first bit and the one behind the last of each of radius + 1 blocks, as even as can be."""
    if not 1 <= radius < BITS:
        raise ValueError(f"the radius has to be from 1 to {BITS - 1}")
    return [(BITS * k // (radius + 1), BITS * (k + 1) // (radius + 1)) for k in range(radius + 1)]


def block_keys(prints: np.ndarray, radius: int) -> np.ndarray:
    """A 64-bit key per fingerprint (rows of 16 bytes) and block: its bits."""
    bits = np.unpackbits(prints, axis=1)
    keys = np.zeros((len(prints), radius + 1), U64)
    for k, (a, z) in enumerate(blocks_of(radius)):
        for b in range(a, z):
            keys[:, k] = (keys[:, k] << U64(1)) | bits[:, b].astype(U64)
    return keys


def near_in(left: np.ndarray, right: np.ndarray, block: int, radius: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs within ``radius`` that agree on ``block`` and no earlier one; with ``own``, left before right."""
    keys = block_keys(left, radius), block_keys(right, radius)
    words = left.view(U64), right.view(U64)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(0, len(left), 256):
        far = sum(np.bitwise_count(words[0][k : k + 256, None, w] ^ words[1][None, :, w]).astype(np.int16) for w in (0, 1))
        x, y = np.nonzero(far <= radius)
        x = x + k
        first = (keys[0][x, block] == keys[1][y, block]) & ~(keys[0][x, :block] == keys[1][y, :block]).any(1)
        if own:
            first &= x < y
        a.append(x[first])
        b.append(y[first])
    return np.concatenate(a), np.concatenate(b)


def cell_task(radius: int):
    """Per fingerprint of a cell how many it has near, and links (a, b) that connect those that are near."""

    def task(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("fingerprint", kind="stable")
        prints = np.frombuffer(b"".join(map(bytes.fromhex, rows["fingerprint"])), np.uint8).reshape(-1, BITS // 8)
        block, one, other = int(key[0]), int(key[2]), int(key[3])
        chunk = rows["chunk"].to_numpy()
        left, right = np.flatnonzero(chunk == one), np.flatnonzero(chunk == other)
        x, y = near_in(prints[left], prints[right], block, radius, one == other)
        x, y = left[x], right[y]
        root, links = np.arange(len(rows)), []
        for i, j in zip(x.tolist(), y.tolist()):
            if root[i] != root[j]:
                links.append((i, j))
                root[root == root[j]] = root[i]
        near = np.bincount(np.concatenate([x, y]), minlength=len(rows))
        some, names = np.flatnonzero(near), rows["fingerprint"].to_numpy()
        a, b = (names[[pair[k] for pair in links]] for k in (0, 1)) if links else (names[:0], names[:0])
        return pd.DataFrame({"a": np.concatenate([names[some], a]), "b": np.concatenate([np.full(len(some), None, object), b]), "near": np.concatenate([near[some], np.zeros(len(a), np.int64)])})

    return task


def near_fingerprints(prints: DataFrame, radius: int = 3, cell: int = CELL) -> DataFrame:
    """(fingerprint, n_near, group) for each distinct fingerprint of ``prints`` (fingerprint, ...).

    n_near is the exact number of other fingerprints within ``radius`` bits, group the same for all that are connected by
    such steps (a 64-bit hash of one of them). One table per block holds the fingerprints keyed by that block; a pair
    that agrees on several blocks counts in the first. A bucket of any size is dealt to chunks of some ``cell``
    fingerprints and each pair of chunks is a task's; it puts out counts and at most a link per fingerprint, never all pairs.
    Null fingerprints are left out. An empty table gives an empty result.
    """
    blocks_of(radius)  # checks it
    distinct = stored(prints.filter("fingerprint IS NOT NULL").select("fingerprint").distinct(), "prints")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch["fingerprint"].to_pylist()
            keys = block_keys(np.frombuffer(b"".join(map(bytes.fromhex, names)), np.uint8).reshape(-1, BITS // 8), radius)
            for k in range(radius + 1):
                yield pa.RecordBatch.from_arrays([batch["fingerprint"], pa.array(np.full(len(names), k, np.int32)), pa.array(keys[:, k].view(np.int64))], names=["fingerprint", "block", "key"])

    tables = stored(distinct.mapInArrow(keyed, "fingerprint string, block int, key long"), "tables")
    sizes = tables.groupBy("block", "key").agg(F.ceil(F.count("*") / cell).cast("int").alias("chunks"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    large = stored(sizes.filter("chunks > 1"), "large")  # few: a chunk has some ``cell`` rows
    shared = tables.join(sizes.select("block", "key"), ["block", "key"], "left_semi").join(large, ["block", "key"], "left")
    shared = shared.withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int"))
    cells = shared.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.select("block", "key", F.least("chunk", "with").alias("one"), F.greatest("chunk", "with").alias("other"), "chunk", "fingerprint")
    found = stored(cells.groupBy("block", "key", "one", "other").applyInPandas(cell_task(radius), "a string, b string, near long"), "near")
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("fingerprint")).agg(F.sum("near").alias("n_near"))
    groups = components(found.filter("b IS NOT NULL").select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    out = distinct.join(counts, "fingerprint", "left").withColumn("node", F.xxhash64("fingerprint")).join(groups, "node", "left")
    return out.select("fingerprint", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce("component", "node").alias("group"))


def near_documents(documents: DataFrame, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, n_near, class_id) for every row of ``documents``.

    n_near is the number of other distinct fingerprints within ``radius`` bits, class_id the smallest doc_id that is
    reached by such steps; rows with equal fingerprints are members of one class. A null or empty text has the fingerprint
    of no words. Rows with the same doc_id each give a row; a null doc_id stands for a class only if it has no other.
    """
    rows = stored(fingerprint_documents(documents), "fingerprints")
    near = stored(near_fingerprints(rows, radius), "classes")
    own = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    lows = stored(near.join(own, "fingerprint").groupBy("group").agg(F.min("first").alias("class_id"), F.count("*").alias("prints")).filter("prints > 1").drop("prints"), "lows")
    classes = near.join(own, "fingerprint").join(lows, "group", "left").select("fingerprint", "n_near", F.coalesce("class_id", "first").alias("class_id"))
    return rows.join(classes, "fingerprint").select("doc_id", "fingerprint", "n_near", "class_id")
