"""Words and shingles of Arrow string columns as 64-bit hashes, without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that are hashed at once; temporary arrays are about 30 times as large.
WINDOW_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser, a bijection on 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_values(plain: bool = False) -> np.ndarray:
    """A pseudo-random word for each byte; A-Z as a-z, ASCII white space as 0.

    With ``plain``, every ASCII character but letters and digits is 0, so that words have no punctuation.
    """
    folded = np.arange(256, dtype=U64)
    folded[65:91] += U64(32)
    values = mix64((folded + U64(1)) * U64(0x9E3779B97F4A7C15))
    values[[9, 10, 11, 12, 13, 32]] = 0
    if plain:
        values[[x for x in range(128) if not chr(x).isalnum()]] = 0
    return values


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def windows(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of about WINDOW_BYTES that end behind white space or at the end of a text."""
    a = 0
    while a < len(raw):
        z = min(a + WINDOW_BYTES, len(raw))
        while z < len(raw):
            k = np.searchsorted(offsets, z, "right") - 1
            if offsets[k] == z:
                break
            low = max(a, offsets[k])
            back = np.flatnonzero(np.isin(raw[low:z], (9, 10, 11, 12, 13, 32)))
            if len(back):
                z = low + int(back[-1]) + 1
                break
            if offsets[k] > a:
                z = int(offsets[k])
                break
            z = min(z + WINDOW_BYTES, len(raw))
        yield a, z
        a = z


def word_hashes(raw: np.ndarray, offsets: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and where each text's words begin (one more entry at the end)."""
    values = byte_values(plain)
    heads, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for a, z in windows(raw, offsets):
        b = raw[a:z]
        inside = values[b] != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, z)] - a
        first[cut] = inside[cut]
        s = np.flatnonzero(first)
        if not len(s):
            continue
        at = np.arange(z - a)
        begin = np.zeros(z - a, np.int64)
        begin[s] = s
        at -= np.maximum.accumulate(begin)
        at[: s[0]] = 0
        at[~inside] = 0
        powers = np.full(int(at.max()) + 1, U64(0x9E3779B97F4A7C55))
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        hashes.append(mix64(np.add.reduceat(values[b] * powers[at], s)))
        heads.append(s + a)
    head = np.concatenate(heads)
    return np.concatenate(hashes), np.searchsorted(head, offsets)


def ngram_hashes(words: np.ndarray, begin: np.ndarray, n: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of each text and where each text's n-grams begin.

    With ``short``, a text of 1 to n-1 words has its whole sequence as its only n-gram.
    """
    count = np.diff(begin)
    if len(words) >= n:
        grams = np.zeros(len(words) - n + 1, U64)
        for k in range(n):
            grams = grams * U64(0x9E3779B97F4A7C15) + mix64(words[k : len(words) - n + 1 + k] + U64(k))
        grams = mix64(grams)
    else:
        grams = np.zeros(0, U64)
    own = np.maximum(count - n + 1, 0)
    few = (count > 0) & (count < n) if short else np.zeros(len(count), bool)
    sizes = own + few
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(at[-1]), U64)
    if len(grams):
        last = np.zeros(len(words), bool)  # positions whose n-gram would leave the text
        for k in range(1, n):
            gone = begin[1:] - k
            last[gone[(count >= k)]] = True
        keep = ~last[: len(grams)]
        out[np.repeat(~few, sizes)] = grams[keep]
    for k in np.flatnonzero(few):
        x = np.full(1, 0x51ED270B, U64)
        for i in range(begin[k], begin[k + 1]):
            x = mix64(x * U64(3) + words[i : i + 1] + U64(count[k]))
        out[at[k]] = x[0]
    return out, at


def distinct_sets(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's tokens sorted and without repeats."""
    tokens = tokens.copy()
    for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
        if z - a > 1:
            tokens[a:z].sort()
    keep = np.ones(len(tokens), bool)
    if len(tokens):
        keep[1:] = tokens[1:] != tokens[:-1]
        keep[at[:-1][np.diff(at) > 0]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return tokens[keep], total[at]


def sums(values: np.ndarray, at: np.ndarray, op=np.add) -> np.ndarray:
    """``op`` over each text's values, 0 for none."""
    out = np.zeros(len(at) - 1, values.dtype)
    has = np.diff(at) > 0
    if has.any():
        out[has] = op.reduceat(values, at[:-1][has])
    return out


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.Table]:
    """The rows of a partition in tables of about ``most_bytes``, or of one longer text."""
    held, size = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            step = max(1, min(batch.num_rows - at, int(batch.num_rows * most_bytes / max(batch.nbytes, 1))))
            piece = batch.slice(at, step)
            held.append(piece)
            size += piece.nbytes
            at += step
            if size >= most_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
