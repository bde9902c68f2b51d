"""Words of texts as sets of hashes, by array arithmetic over the bytes of many texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from memlake.functions.text import STOP_WORDS
from memlake.operators.sweep import mixed
from memlake.shared import arrow_rows, stash

#: Bytes of texts taken at once, and of a word up to which it is hashed as a polynomial.
BYTES, SHORT = 1 << 20, 64
_CODE = np.zeros(256, np.uint8)  # 0 for what separates words, else the letter or digit, lower-cased
for _k, _c in enumerate(b"abcdefghijklmnopqrstuvwxyz0123456789"):
    _CODE[_c] = _k + 1
    _CODE[bytes([_c]).upper()[0]] = _k + 1
_VALUE = np.r_[np.uint64(0), mixed(np.arange(1, 37))]
_STEP = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """At least n powers of an odd number modulo 2^64 and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)], dtype=np.uint64)
    return _powers


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word of two letters or digits or more in the texts `data` (bytes), which end at `ends`."""
    code = _CODE[data]
    word = np.r_[False, code > 0, False]
    cut = np.zeros(len(data) + 1, bool)  # between two texts
    cut[ends] = True
    start = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
    stop = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1
    n = stop - start
    start, stop, n = start[n > 1], stop[n > 1], n[n > 1]
    up, down = _power(len(data) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(_VALUE[code] * up[: len(data)], dtype=np.uint64)]
    h = mixed((sums[stop] - sums[start]) * down[start], n)
    for k in np.flatnonzero(n > SHORT):
        h[k] = int.from_bytes(hashlib.blake2b(data[start[k] : stop[k]].tobytes().lower(), digest_size=8).digest(), "big")
    return h, np.searchsorted(ends, start, side="right")


def _stops() -> np.ndarray:
    flat = np.frombuffer("".join(STOP_WORDS).encode(), np.uint8)
    return words(flat, np.cumsum([len(w) for w in STOP_WORDS]))[0]


def _sets(texts: pa.Array, stops: np.ndarray) -> pa.Array:
    """The sorted distinct hashes of each text."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[ends[0] : ends[-1]] if body is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    h, of = words(data, ends[1:] - ends[0])
    good = ~np.isin(h, stops)
    h, of = h[good].view(np.int64), of[good]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])][: len(h)]
    counts = np.bincount(of[new], minlength=len(texts))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(h[new]))


def word_sets(rows: DataFrame, texts: tuple[str, ...], tag: str) -> DataFrame:
    """`rows`, stored, with each column of `texts` as the sorted distinct hashes of the words that text.similarity_tokens() gives (null: none)."""
    kept = [c for c in rows.columns if c not in texts]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stops = _stops()
        for b in batches:
            columns = [pc.fill_null(b.column(len(kept) + k).cast(pa.string()), "") for k in range(len(texts))]
            size = np.sum([pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], axis=0)
            block = (np.cumsum(size) - size) // BYTES
            for at, to in zip(f := np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), np.r_[f[1:], len(b)], strict=True):
                own = b.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*own.columns[: len(kept)], *(_sets(c.slice(at, to - at), stops) for c in columns)], names=[*kept, *texts])

    with arrow_rows(rows.sparkSession, 1000):
        return stash(rows.select(*kept, *texts).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"`{c}` array<long>" for c in texts)])), tag)
