"""N-gram Jaccard join of documents by prefix trees.

1. Equal n-gram sets are found by a 128-bit digest; from here on a set counts once.
2. Every n-gram is counted over all sets, in blocks of packed tokens dealt out by hash. n-grams in more
   than about one of HEAVY_SHARE sets are found first, per slice of the input, and kept out of the blocks.
3. In the global order (count, hash) a set of n n-grams can only link with one that shares one of its first
   n - ceil(0.8 n) + 1. Those that no other set has need no partner, so most sets end here.
4. Each of these n-grams has a leader, the set with the fewest n-grams of its own among those that share it; a
   frequent one is dealt to buckets for that. A leader and all that share an n-gram it leads are a star. A star's
   sets go to one task, or to blocks of bounded size, where a trie over them is searched with remaining-length bounds.
5. The links found, a star per group, are joined to components.

Sets are told apart by 128 bits, n-grams by 64 bits while a task hashes texts and by their block's number and 48 bits
from there on; likeness is exact up to collisions of those within a pair. A text that is copied into several slices
is packed in each of them: picking one would shuffle all texts, which costs more than it spares unless over half are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stored, text_key, unused
from .components import components
from .textops import U64, distinct_sets, mix64, ngram_hashes, slices, strings, sums, word_hashes
from .trie import linked_groups

#: Text that is hashed together by a task.
SLICE_BYTES = 8 << 20
#: n-grams in at least one of so many sets are known to all tasks: at most HEAVY_SHARE times the mean set size of them.
HEAVY_SHARE = 512
#: Partitions that blocks are dealt to grow with the blocks up to this many; from there on a task has several.
MOST_PARTITIONS = 20_000
#: Tokens of a block, of a family's block in the join, and sets of the latter.
BLOCK_TOKENS, JOIN_TOKENS, JOIN_SETS = 2_000_000, 1_000_000, 1024
#: Sets of a frequent n-gram's bucket.
BUCKET_SETS = 1024


def gram_sets(column, words: int) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = strings(column)
    hashes, begin = word_hashes(raw, offsets)
    return distinct_sets(*ngram_hashes(hashes, begin, words, short=True))


def digests(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return sums(mix64(tokens), at), sums(mix64(tokens ^ U64(0xA5A5A5A55A5A5A5A)), at, np.bitwise_xor)


def firsts(n: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """Positions of the first of each group of equal non-empty sets."""
    rows = np.flatnonzero(n > 0)
    _, at = np.unique(np.stack([d1[rows], d2[rows]], 1), axis=0, return_index=True) if len(rows) else (0, rows)
    return np.sort(rows[at])


def pick(tokens: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of some texts."""
    sizes = np.diff(at)
    chosen = np.zeros(len(sizes), bool)
    chosen[rows] = True
    return tokens[np.repeat(chosen, sizes)], np.concatenate([[0], np.cumsum(sizes[rows])])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def within(tokens: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(tokens), bool)
    return known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens


def set_names(d1: np.ndarray, d2: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """A set's name: one half of its digest, or both as one where other sets have that half too."""
    return np.where(within(d1, shared), d1 ^ d2, d1)


def digest_task(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("token", pa.int64()), ("sets", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, SLICE_BYTES):
            tokens, at = gram_sets(piece["text"], words)
            n = np.diff(at)
            d1, d2 = digests(tokens, at)
            yield pa.RecordBatch.from_arrays(
                [piece["doc_id"].combine_chunks(), piece["text_key"].combine_chunks(), pa.array(n), signed(d1), signed(d2), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())], schema=schema
            )
            rows = firsts(n, d1, d2)
            found, count = np.unique(pick(tokens, at, rows)[0], return_counts=True)
            often = count >= max(8, len(rows) / HEAVY_SHARE)
            none = pa.nulls(int(often.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, none, signed(found[often]), pa.array(count[often])], schema=schema)

    return task


def packed(*columns: np.ndarray) -> bytes:
    return np.array([c.nbytes for c in columns], np.int64).tobytes() + b"".join(c.tobytes() for c in columns)


def unpacked(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(blob, np.int64, len(kinds)), 8 * len(kinds), []
    for kind, size in zip(kinds, sizes.tolist()):
        out.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


#: Of a block: name, set size and number of tokens of each set; the tokens' lower 32 and next 16 bits.
BLOCK = (np.uint64, np.uint32, np.uint32, np.uint32, np.uint16)
#: Of a set's repeated tokens: name, set size and number of tokens of each set; the tokens and in how many sets they are.
REPEATED = (np.uint64, np.uint32, np.uint32, np.uint64, np.uint32)


def by_key(key: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per key: its positions, the owners among them and how many positions each has. Owners ascend per key."""
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else []
    for a, z in zip(cuts[:-1], cuts[1:]):
        own = owner[a:z]
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        yield int(key[a]), order[a:z], own[heads], np.diff(np.concatenate([heads, [z - a]])).astype(np.uint32)


def pack_task(words: int, heavy: np.ndarray, heavy_counts: np.ndarray, shared: np.ndarray, blocks: int):
    """Rows (block, data): below ``blocks`` the tokens of a hash range, from there on the heavy tokens of sets."""
    schema = pa.schema([("block", pa.int64()), ("data", pa.large_binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, SLICE_BYTES):
            tokens, at = gram_sets(piece["text"], words)
            n = np.diff(at)
            d1, d2 = digests(tokens, at)
            rows = firsts(n, d1, d2)
            tokens, at = pick(tokens, at, rows)
            d1, n = set_names(d1[rows], d2[rows], shared), n[rows].astype(np.uint32)
            owner = np.repeat(np.arange(len(rows)), n)
            often = within(tokens, heavy)
            light, its = tokens[~often], owner[~often]
            low, next16 = light.astype(np.uint32), (light >> U64(32)).astype(np.uint16)
            out = []
            for block, at, own, count in by_key(((light >> U64(32)) * U64(blocks)) >> U64(32), its):
                out.append((block, packed(d1[own], n[own], count, low[at], next16[at])))
            known, its = tokens[often], owner[often]
            for block, at, own, count in by_key(d1[its] % U64(blocks), its):
                out.append((blocks + block, packed(d1[own], n[own], count, known[at], heavy_counts[np.searchsorted(heavy, known[at])])))
            for a in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out[a : a + 64]], pa.int64()), pa.array([x[1] for x in out[a : a + 64]], pa.large_binary())], schema=schema)

    return task


def joined(blobs: list[bytes], kinds: tuple) -> list[np.ndarray]:
    columns = [unpacked(b, kinds) for b in blobs]
    return [np.concatenate([c[k] for c in columns]) for k in range(len(kinds))]


def count_block(blocks: int):
    """Of one block, the tokens of two sets or more, again in packed form and dealt by set."""

    def task(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block = int(key[0])
        if block >= blocks:
            return pd.DataFrame({"part": [block - blocks] * len(rows), "data": rows["data"]})
        d1, n, count, low, next16 = joined(list(rows["data"]), BLOCK)
        tokens = low.astype(U64) | (next16.astype(U64) << U64(32)) | U64((block & 0xFFFF) << 48)
        owner = np.repeat(np.arange(len(d1)), count)
        order = np.lexsort((d1[owner], tokens))
        tokens, owner = tokens[order], owner[order]
        keep = np.ones(len(tokens), bool)  # a set may come from several slices
        keep[1:] = (tokens[1:] != tokens[:-1]) | (d1[owner[1:]] != d1[owner[:-1]])
        tokens, owner = tokens[keep], owner[keep]
        heads = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        df = np.repeat(np.diff(np.concatenate([heads, [len(tokens)]])), np.diff(np.concatenate([heads, [len(tokens)]])))
        tokens, owner, df = tokens[df > 1], owner[df > 1], df[df > 1].astype(np.uint32)
        order = np.argsort(owner, kind="stable")
        tokens, owner, df = tokens[order], owner[order], df[order]
        out = [(part, packed(d1[own], n[own], c, tokens[at], df[at])) for part, at, own, c in by_key(d1[owner] % U64(blocks), owner)]
        return pd.DataFrame({"part": pd.Series([x[0] for x in out], dtype="int64"), "data": pd.Series([x[1] for x in out], dtype=object)})

    return task


def prefix_block(percent: int):
    """The sets of one part that may have partners, with their repeated tokens in the global order."""

    def task(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        d1, n, count, tokens, df = joined(list(rows["data"]), REPEATED)
        names, size = np.unique(d1), np.zeros(0, np.int64)
        size = np.zeros(len(names), np.int64)
        size[np.searchsorted(names, d1)] = n
        owner = np.searchsorted(names, np.repeat(d1, count))
        order = np.lexsort((tokens, df, owner))
        tokens, owner, df = tokens[order], owner[order], df[order]
        keep = np.ones(len(tokens), bool)
        keep[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        tokens, owner, df = tokens[keep], owner[keep], df[keep]
        repeated = np.bincount(owner, minlength=len(names))
        prefix = size - (percent * size + 99) // 100 + 1 - (size - repeated)
        ends = np.cumsum(repeated)
        rows = np.flatnonzero(prefix > 0).tolist()
        return pd.DataFrame(
            {
                "name": pd.Series(names[rows].view(np.int64), dtype="int64"),
                "n": pd.Series(size[rows], dtype="int64"),
                "alone": pd.Series((size - repeated)[rows], dtype="int64"),
                "tokens": pd.Series([tokens[ends[i] - repeated[i] : ends[i]].view(np.int64) for i in rows], dtype=object),
                "counts": pd.Series([df[ends[i] - repeated[i] : ends[i] - repeated[i] + prefix[i]].astype(np.int32) for i in rows], dtype=object),
            }
        )

    return task


def join_block(percent: int):
    """Links (star, a, b, open) within the stars of one group, b being a and open true for a set that its block's leader doesn't reach."""

    def task(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for star, members in rows.groupby("star", sort=True):
            members = members.sort_values(["leads", "alone", "name"], ascending=[False, True, True], kind="stable")
            names, asks = members["name"].to_numpy(), members["asks"].to_numpy()
            root = linked_groups([np.asarray(t).view(U64) for t in members["tokens"]], members["n"].to_numpy(), 0, percent, asks if asks.any() else None)
            at = np.arange(len(root))
            far = np.flatnonzero((root != root[0]) & (members["blocks"].to_numpy() > 1) & ~asks.any())
            linked = np.flatnonzero(root != at)
            out.append((np.full(len(linked), star), names[linked], names[root[linked]], np.zeros(len(linked), bool)))
            out.append((np.full(len(far), star), names[far], names[far], np.ones(len(far), bool)))
        return pd.DataFrame({k: np.concatenate([x[i] for x in out]) for i, k in enumerate(("star", "a", "b", "open"))})

    return task


def stars_of(candidates: DataFrame, bucket_sets: int) -> DataFrame:
    """(star, name, held): each set under the leader of each of its first n-grams; held: its number of tokens."""
    zipped = F.arrays_zip(F.slice("tokens", F.lit(1), F.size("counts")).alias("token"), F.col("counts").alias("count"))
    routed = candidates.select("name", "alone", F.size("tokens").alias("held"), F.explode(zipped).alias("first")).select("name", "alone", "held", "first.token", F.ceil(F.col("first.count") / bucket_sets).alias("buckets"))
    leaders = routed.groupBy("token").agg(F.min(F.struct("alone", "name"))["name"].alias("star"), F.max("buckets").alias("buckets"), F.count("*").alias("sets")).filter("sets > 1")
    leaders = leaders.select("token", "star", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    routed = routed.withColumn("bucket", F.pmod(F.xxhash64("name"), F.col("buckets")))
    return stored(routed.join(leaders, ["token", "bucket"]).select("star", "name", "held").distinct(), "stars")


def links(candidates: DataFrame, percent: int, join_tokens: int, join_sets: int, bucket_sets: int) -> DataFrame:
    """Links (a, b) that connect exactly the sets of each component, from (name, n, alone, tokens, counts).

    Two sets that link share one of their first n-grams, so both are in the star of its leader. A star of several
    blocks is searched in two steps: each block with the leader, then the sets that the leader doesn't reach, in
    groups of ``join_sets``, against the other blocks. No task holds more than two blocks and the leader; only
    sets that aren't like their leader are compared with all the star.
    """
    stars = stars_of(candidates, bucket_sets)
    sized = stars.groupBy("star").agg(F.count("*").alias("sets"), F.sum("held").alias("held"))
    sized = stored(sized.withColumn("blocks", F.greatest(F.ceil(F.col("held") / join_tokens), F.ceil(F.col("sets") / join_sets)).cast("int")), "sizes")
    groups = sized.filter("blocks = 1").agg(F.ceil(F.sum("held") / join_tokens)).first()[0] or 1
    large = sized.filter("blocks > 1").select("star", "blocks")  # few: a block has some ``join_sets`` sets
    dealt = stars.select("star", "name").join(large, "star", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own, leads = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"), F.col("star") == F.col("name")
    dealt = dealt.withColumn("leads", leads).withColumn("block", F.explode(F.when(leads, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))))
    dealt = dealt.withColumn("ask_group", F.lit(-1)).withColumn("asks", F.lit(False))
    sets = candidates.select("name", "n", "alone", "tokens")

    def run(df: DataFrame) -> DataFrame:
        whole = F.col("blocks") == 1  # such stars share a group
        df = df.withColumn("part", F.when(whole, F.pmod(F.xxhash64("star"), F.lit(8 * groups))).otherwise(F.col("star"))).withColumn("block", F.when(whole, F.lit(-1)).otherwise(F.col("block")))
        rows = df.join(sets, "name").select("part", "block", "ask_group", "star", "blocks", "leads", "asks", "alone", "name", "n", "tokens")
        return rows.groupBy("part", "block", "ask_group").applyInPandas(join_block(percent), "star long, a long, b long, open boolean")

    found = stored(run(dealt), "links")
    left = found.filter("open").select("star", F.col("a").alias("name")).distinct()
    if left.isEmpty():
        return found.select("a", "b")
    counted = left.groupBy("star").agg(F.ceil(F.count("*") / join_sets).cast("int").alias("ask_groups")).join(large, "star")
    asking = left.join(counted, "star").withColumn("ask_group", F.pmod(F.xxhash64("name", F.lit(1)), F.col("ask_groups")).cast("int")).withColumn("own", own)
    asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("block <> own").withColumn("asks", F.lit(True)).withColumn("leads", F.lit(False))
    asked = dealt.filter("blocks > 1 AND NOT leads").drop("blocks", "ask_group").join(counted, "star").withColumn("ask_group", F.explode(F.sequence(F.lit(0), F.col("ask_groups") - 1)))
    names = ["star", "name", "blocks", "block", "ask_group", "leads", "asks"]
    further = run(asked.select(names).unionByName(asking.select(names)))
    return found.select("a", "b").unionByName(further.select("a", "b"))


def grouped(documents: DataFrame, words: int, percent: int, block_tokens: int, join_tokens: int, join_sets: int, bucket_sets: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): (doc_id, text_key, n, d1, d2) for every row, and (d1, d2, group, first) for every distinct non-empty set.

    group is the same for the sets of a component; first is (no_id, doc_id, text_key) of the class's first row.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = stored(texts.withColumn("text_key", text_key()).mapInArrow(digest_task(words), "doc_id long, text_key long, n long, d1 long, d2 long, token long, sets long"), "digests")
    own = seen.filter("token IS NULL").select("doc_id", "text_key", "n", "d1", "d2")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    classes = stored(own.filter("n > 0").groupBy("d1", "d2").agg(first, F.first("n").alias("n")), "classes")
    sets, tokens = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # Half digests of several sets: by chance sets * sets / 2**65 of them, a handful in billions of sets.
    shared = [r[0] for r in classes.groupBy("d1").count().filter("count > 1").select("d1").toLocalIterator()]
    name = F.when(F.col("d1").isin(shared), F.col("d1").bitwiseXOR(F.col("d2"))).otherwise(F.col("d1")) if shared else F.col("d1")
    shared = np.sort(np.array(shared, np.int64).view(U64))
    least = max(32, sets / HEAVY_SHARE)
    heavy = seen.filter("token IS NOT NULL").groupBy("token").agg(F.sum("sets").alias("sets")).filter(F.col("sets") >= least)
    heavy = [tuple(r) for r in heavy.toLocalIterator()]  # at most HEAVY_SHARE * tokens / sets
    # Their counts, a little less than the true ones, place them in the global order.
    often = np.array([r[1] for r in heavy], np.int64)
    heavy = np.array([r[0] for r in heavy], np.int64).view(U64)
    often, heavy = np.minimum(often, (1 << 31) - 1).astype(np.uint32)[np.argsort(heavy)], np.sort(heavy)
    blocks = max(1, -(-int(tokens) // block_tokens))
    tasks = min(max(8, 2 * blocks), MOST_PARTITIONS)
    parts = texts.mapInArrow(pack_task(words, heavy, often, shared, blocks), "block long, data binary").repartition(tasks, "block")
    counted = parts.groupBy("block").applyInPandas(count_block(blocks), "part long, data binary")
    able = counted.repartition(tasks, "part").groupBy("part").applyInPandas(prefix_block(percent), "name long, n long, alone long, tokens array<long>, counts array<int>")
    labels = components(links(stored(able, "candidates"), percent, join_tokens, join_sets, bucket_sets))
    named = classes.withColumn("name", name).join(labels.select(F.col("node").alias("name"), F.col("component").alias("label")), "name", "left")
    return own, named.select("d1", "d2", F.coalesce("label", "name").alias("group"), F.col("label").isNotNull().alias("linked"), "first")


def with_head(classes: DataFrame) -> DataFrame:
    """(d1, d2, group, head): head is the first row of the whole group."""
    # Only groups of several classes have to be looked up; written, so that the planner knows their size.
    heads = stored(classes.filter("linked").groupBy("group").agg(F.min("first").alias("of_group")), "heads")
    return classes.join(heads, "group", "left").select("d1", "d2", "group", F.coalesce("of_group", "first").alias("head"))


def ngram_jaccard_join(documents: DataFrame, words: int = 5, percent: int = 80, block_tokens: int = BLOCK_TOKENS, join_tokens: int = JOIN_TOKENS, join_sets: int = JOIN_SETS, bucket_sets: int = BUCKET_SETS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``documents`` (doc_id, text, ...).

    Two documents link when 100 * common >= percent * union of their sets of ``words``-word n-grams (a
    shorter text's whole sequence). component_id is the smallest doc_id reachable by links. A null or empty
    text, or one without words, has an empty set and links with nothing. Rows with the same doc_id each
    give a row, with the group of their own text. A null doc_id is kept and never stands for a group that has
    another. A text of any length is hashed in pieces, but its set is held by one task. Other columns are
    ignored. An empty table gives an empty result.
    """
    own, classes = grouped(documents, words, percent, block_tokens, join_tokens, join_sets, bucket_sets)
    heads = with_head(classes).select("d1", "d2", F.col("head.doc_id").alias("component_id"))
    joined = own.join(heads, ["d1", "d2"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_groups(documents: DataFrame, words: int = 5, percent: int = 80, **sizes: int) -> DataFrame:
    """The rows of ``documents``, with all their columns, without those that are like an earlier one.

    Of each group of linked texts (see ngram_jaccard_join) the row with the smallest doc_id stays, null ids last,
    then the one with the smallest hash of its text; of equal rows (doc_id and text) one. Rows go by doc_id and
    text, so a doc_id that several texts share loses only those texts that are repeats. Texts without words stay,
    all of them. An empty table gives an empty result.
    """
    limits = {"block_tokens": BLOCK_TOKENS, "join_tokens": JOIN_TOKENS, "join_sets": JOIN_SETS, "bucket_sets": BUCKET_SETS} | sizes
    own, classes = grouped(documents, words, percent, **limits)
    kept = own.filter("n > 0").join(with_head(classes).select("d1", "d2", "head"), ["d1", "d2"])
    heads = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key"))
    of_id, of_key = unused(documents, "of_id", "of_key")
    counted = kept.withColumn("stays", heads).groupBy(F.col("doc_id").alias(of_id), F.col("text_key").alias(of_key), "stays").count()
    counted = stored(counted.filter("NOT stays OR count > 1"), "repeats")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(of_id)) & (text_key() == F.col(of_key))
    ids = counted.select(of_id, of_key)
    left = documents.join(ids, same, "left_anti").select(documents.columns)
    equal = stored(counted.filter("stays").select(of_id, of_key), "equal")
    if equal.isEmpty():
        return left
    # Rows with a twin of the same id and text: one of each.
    return left.unionByName(documents.join(equal, same).dropDuplicates([of_id, of_key]).select(documents.columns))


def join_sql(documents: str = "documents", words: int = 5, percent: int = 80) -> str:
    """The same in DuckDB SQL: all pairs of distinct sets that share an n-gram, and what reaches what by links."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH RECURSIVE worded AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {documents}),
    shingled AS (
        SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' ')) END)) AS s FROM worded),
    named AS (SELECT doc_id, s, len(s) AS n, dense_rank() OVER (ORDER BY s) AS name FROM shingled),
    classes AS (SELECT name, min(doc_id) AS low, any_value(s) AS s, any_value(n) AS n FROM named WHERE n > 0 GROUP BY name),
    grams AS (SELECT name, n, unnest(s) AS gram FROM classes),
    pairs AS (SELECT a.name AS a, b.name AS b, a.n + b.n AS both_n, count(*) AS common FROM grams a JOIN grams b ON a.gram = b.gram AND a.name <> b.name GROUP BY a.name, b.name, a.n + b.n),
    linked AS (SELECT a, b FROM pairs WHERE 100 * common >= {percent} * (both_n - common)),
    reach AS (SELECT name AS a, name AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
    lows AS (SELECT r.a AS name, min(c.low) AS low FROM reach r JOIN classes c ON c.name = r.b GROUP BY r.a)
    SELECT doc_id, n::BIGINT AS n_shingles, CASE WHEN n > 0 THEN low ELSE doc_id END AS component_id FROM named LEFT JOIN lows USING (name)"""
