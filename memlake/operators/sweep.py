"""Pairs of sets that can overlap enough, found inside tasks: rows that share a key meet in memory, and only pairs that pass leave a task.

A row is a set under one of its keys: its size, its place in the key's order, and a sketch, the parities of the set's hashes over some
bits. Two sketches differ in no more bits than the sets in members, so a pair whose sketches differ in more than the overlap allows is dropped
where it meets. Nothing is written for it, so what is shuffled grows with the rows, not with the pairs that share a key.

The sets of a frequent key are dealt into blocks of about BLOCK rows, and every pair of blocks is a key of its own, so a task holds a few blocks
at most. No pair is lost by this, and each meets under its key once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.operators.components import components
from memlake.shared import sized_stash, small, stash

#: Rows of a block, whole sets of a block, pairs looked at in one go, and counters of the order of tokens.
BLOCK, GROUP, AT_ONCE, BUCKETS = 16384, 512, 1 << 19, 1 << 22
#: Rows of a key from which on it is compared by tiles, and the sides of a tile.
LONG, TILE, WIDE = 48, 64, 1024
#: 64-bit words of a large set's finer sketch, at most.
FINE = 64
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(*parts: np.ndarray) -> np.ndarray:
    """A 64-bit key of several; callers check what a chance meeting of two keys could bring."""
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * _ODD[0]
        h = (h ^ (h >> np.uint64(30))) * _ODD[1]
        h ^= h >> np.uint64(27)
    return h


def sketch(hashes: np.ndarray, of: np.ndarray, n: int, words: int) -> np.ndarray:
    """For each of n sets the parities of its hashes over 64 * words bits, from all hashes and the set that each belongs to."""
    bits = np.uint64(64 * words)
    out = np.zeros((n, 64 * words), np.uint8)
    for at in range(0, n, 4096):  # a byte a bit, for some sets at once
        own = (of >= at) & (of < at + 4096) if n > 4096 else slice(None)
        m = min(4096, n - at)
        place = (of[own] - at) * (64 * words) + ((hashes[own] >> np.uint64(32)) % bits).astype(np.int64)
        out[at : at + m] = (np.bincount(place, minlength=m * 64 * words) & 1).astype(np.uint8).reshape(m, -1)
    return np.packbits(out, axis=1).view(np.uint64)


def allowed(total: np.ndarray, threshold: float) -> np.ndarray:
    """In how many members two sets of `total` members together may differ at an overlap of `threshold`."""
    return total * ((1 - threshold) / (1 + threshold)) + 1e-6


def differ(s: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which rows i and j of sketches `s` differ."""
    bits = np.bitwise_count(s[i] ^ s[j])
    if s.shape[1] % 8:
        return bits.sum(axis=1, dtype=np.int64)
    eight, low = bits.view(np.uint64), np.uint64(0x00FF00FF00FF00FF)  # a byte a word of the sketch, added up side by side
    sums = ((eight & low) + ((eight >> np.uint64(8)) & low)) * np.uint64(0x0001000100010001) >> np.uint64(48)
    return sums.astype(np.int64).sum(axis=1)


def _fine(hashes: np.ndarray, of: np.ndarray, n: np.ndarray, words: int) -> pa.Array:
    """Finer sketches, a bit a member up to FINE words, of the sets whose size n is over the bits of `words`; empty for others."""
    width = np.where(n > 64 * words, np.minimum(words << np.ceil(np.log2(np.maximum(n / (64 * words), 1))).astype(np.int64), FINE), 0)
    out = np.full(len(n), b"", object)
    for w in np.unique(width[width > words]):
        sets = np.flatnonzero(width == w)
        place = np.full(len(n), -1)
        place[sets] = np.arange(len(sets))
        own = place[of] >= 0
        marks = sketch(hashes[own], place[of[own]], len(sets), int(w))
        out[sets] = [m.tobytes() for m in marks]
    return pa.array(out, pa.binary())


def _finer(marks: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Which pairs differ in no more than `limit` bits of their finer sketches, where both have one; a longer one is folded to the shorter."""
    flat, ends = marks
    width, good = np.diff(ends), np.ones(len(i), bool)
    for x, y in {(int(x), int(y)) for x, y in zip(*np.unique(np.stack([width[i], width[j]]), axis=1), strict=True)} if len(i) else ():
        if not min(x, y):
            continue
        all_ = np.flatnonzero((width[i] == x) & (width[j] == y))
        for at in range(0, len(all_), 8192):
            own = all_[at : at + 8192]
            one, two = (np.bitwise_xor.reduce(flat[ends[r[own]][:, None] + np.arange(w)].reshape(len(own), -1, min(x, y)), axis=1) for r, w in ((i, x), (j, y)))
            good[own] = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64) <= limit[own]
    return good


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of an array of lists, and the row of each."""
    return lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def _counted(sets: DataFrame, keys: Callable[[np.ndarray, pa.Array], np.ndarray]) -> np.ndarray:
    """By bucket, at least the number of times that `keys` gives a key for `sets` (part, hashes): BUCKETS numbers, however many keys there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for at in range(0, len(b), 2000):
                own = b.slice(at, 2000)
                np.add.at(c, keys(own.column(0).to_numpy().view(np.uint64), own.column(1)) % np.uint64(BUCKETS), 1)
        k = np.flatnonzero(c)
        for at in range(0, len(k), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(k[at : at + 10_000]), pa.array(c[k[at : at + 10_000]])], names=["k", "c"])

    got = sets.mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(BUCKETS, np.int32)
    out[got.column(0).to_numpy()] = np.minimum(got.column(1).to_numpy(), np.iinfo(np.int32).max)
    return out


def _keys(part: np.ndarray, lists: pa.Array) -> np.ndarray:
    w, of = _flat(lists)
    return mixed(part[of], w)


def _prefix(part: np.ndarray, lists: pa.Array, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, place) of the tokens of each set's prefix, and the sizes of all; a token that no other set of the part has is left out."""
    w, of = _flat(lists)
    key = mixed(part[of], w)
    n = np.bincount(of, minlength=len(lists))
    held = counts[(key % np.uint64(BUCKETS)).astype(np.int64)]
    order = np.lexsort((key, held, of))
    key, of, held = key[order], of[order], held[order]
    at = np.arange(len(key)) - (np.cumsum(n) - n)[of]
    first = (at < n[of] - np.ceil(n[of] * threshold - 1e-9).astype(np.int64) + 1) & (held > 1)
    return key[first], of[first], at[first], n


def _dealt(key: np.ndarray, ids: np.ndarray, count: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, side): rows under the keys of their pairs of blocks. A side of -1 meets all of its key, others only other sides."""
    blocks = -(-count // block)
    row = np.repeat(np.arange(len(key)), blocks)
    across = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own = (ids % np.maximum(blocks, 1).astype(np.uint64)).astype(np.int64)[row]
    side = np.where(across == own, -1, own)
    return row, mixed(key[row], np.minimum(own, across), np.maximum(own, across)), side


def prefix_rows(sets: DataFrame, column: str, threshold: float, words: int, extra: tuple[str, ...] = (), block: int = BLOCK, fine: bool = False) -> DataFrame:
    """(key, id, n, at, side, sketch, *extra, with `fine` also fine) of `sets` (id, part, `column` distinct hashes, *extra): a row for each token under which the set can meet
    others of its part that overlap by the threshold.

    Two such sets share one of each one's first n - ceil(threshold n) + 1 tokens, in any order that holds for all of the part. Here it is that of
    the counts of buckets, so no table of tokens is made or joined. A second count, of prefixes only, says in how many blocks the sets of a token
    are dealt; tokens whose bucket has no other meet no one and are left out. A sketch of fewer bits than a set has members tells little, so
    with `fine` large sets bring a longer one too (`words` must be a power of two then).
    """
    kinds, context = dict(sets.dtypes), sets.sparkSession.sparkContext
    rows = sets.where(F.col("part").isNotNull()).select("id", F.xxhash64("part").alias("part"), column, F.xxhash64("id").alias("_h"), *extra)
    counts = context.broadcast(_counted(rows.select("part", column), _keys))
    firsts = context.broadcast(_counted(rows.select("part", column), lambda part, lists: _prefix(part, lists, counts.value, threshold)[0]))

    names = ["key", "id", "n", "at", "side", "sketch", *extra, *(["fine"] if fine else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, len(whole), 2000):
                b = whole.slice(begin, 2000)
                part = b.column(1).to_numpy().view(np.uint64)
                hashes, own = _flat(b.column(2))
                marks = sketch(hashes, own, len(b), words)
                key, of, at, n = _prefix(part, b.column(2), counts.value, threshold)
                more = [_fine(hashes, own, n, words)] if fine else []
                held = firsts.value[(key % np.uint64(BUCKETS)).astype(np.int64)].astype(np.int64)
                key, of, at, held = (x[held > 1] for x in (key, of, at, held))
                hashed = b.column(3).to_numpy().view(np.uint64)
                row, key, side = _dealt(key, hashed[of], held, block)
                of, at = of[row], at[row]
                t = pa.array(of)
                bits = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * words), len(b), [None, pa.py_buffer(marks.tobytes())]).cast(pa.binary())
                cols = [pa.array(key.view(np.int64)), b.column(0).take(t), pa.array(n[of].astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(side.astype(np.int32)), bits.take(t), *(b.column(4 + k).take(t) for k in range(len(extra))), *(x.take(t) for x in more)]
                out = pa.RecordBatch.from_arrays(cols, names=names)
                for k in range(0, len(out), 10_000):
                    yield out.slice(k, 10_000)

    return rows.mapInArrow(run, ", ".join(["key long", f"id {kinds['id']}", "n int, at int, side int, sketch binary", *(f"{x} {kinds[x]}" for x in extra), *(["fine binary"] if fine else [])]))


def _uneven(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Binary values of different lengths: all their 64-bit words, and where each value's begin, with the end of the last."""
    size = pc.binary_length(column).to_numpy().astype(np.int64) // 8
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64), np.r_[0, np.cumsum(size)]


def _columns(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """Numbers as they are; binary ones and lists of numbers, all of one length, as rows of 64-bit words."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(rows, -1)
    if pa.types.is_list(column.type):
        return column.combine_chunks().flatten().to_numpy().view(np.uint64).reshape(rows, -1)
    return column.to_numpy()


def _by_tiles(s: np.ndarray, n: np.ndarray, stop: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs in a run of rows by size, j from i + 1 to before stop[i], but for most whose sketches `s` differ in more than is allowed.

    Row by row the sketches are compared a word at a time, a tile of rows against a stretch of others, so nothing is gathered.
    """
    marks = np.ascontiguousarray(s.T)
    limit = (allowed(n, threshold) * 1.0001 + 0.01).astype(np.float32)  # wide enough for its rounding
    half = (len(marks) + 1) // 2
    for at in range(0, len(n), TILE):
        to = min(at + TILE, len(n))
        for left in range(at + 1, int(stop[to - 1]), WIDE):
            right = min(left + WIDE, int(stop[to - 1]))
            bound = limit[at:to, None] + limit[None, left:right]
            apart = np.zeros(bound.shape, np.uint16)
            for k in range(half):
                apart += np.bitwise_count(marks[k, at:to, None] ^ marks[k, None, left:right])
            near = apart <= bound
            if np.count_nonzero(near) * 32 > near.size:
                for k in range(half, len(marks)):
                    apart += np.bitwise_count(marks[k, at:to, None] ^ marks[k, None, left:right])
                near = apart <= bound
            i, j = np.nonzero(near)
            i, j = i + at, j + left
            good = (j > i) & (j < stop[i])
            yield i[good], j[good]


def met_pairs(rows: DataFrame, threshold: float, fits: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray], sketched: bool = False) -> DataFrame:
    """(a, b), a < b, each once: rows (key, id, n, side, ...) of one key whose sizes allow an overlap of `threshold` and that `fits` keeps.

    `fits` takes the columns by name, binary ones and lists as rows of 64-bit words, and the places i and j of pairs, n of i at most n of j.
    If it keeps only pairs whose `sketch` differ in no more than allowed(), say so by `sketched`: long runs are then compared by tiles.
    """
    names, kind = rows.columns, dict(rows.dtypes)["id"]
    if "side" not in names or "n" not in names:
        raise ValueError("rows need key, id, n and side")

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        ids = t.column("id").combine_chunks()
        cols = {x: _uneven(t.column(x)) if x == "fine" else _columns(t.column(x), len(t)) for x in names if x != "id"}
        key, n, side = cols["key"], cols["n"], cols["side"]
        new = np.r_[True, key[1:] != key[:-1]]
        run = np.cumsum(new) - 1
        span = int(n.max()) + 2
        reach = np.minimum(np.floor(n / threshold + 1e-6), span - 1).astype(np.int64)
        stop = np.searchsorted(run * span + n, run * span + reach, side="right")
        count = stop - np.arange(len(n)) - 1

        def kept(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            good = (side[i] < 0) | (side[i] != side[j])
            i, j = i[good], j[good]
            good = fits(cols, i, j)
            i, j = i[good], j[good]
            if len(i):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j))], names=["a", "b"])

        if sketched:
            first = np.r_[np.flatnonzero(new), len(n)]
            near, held = [], 0  # pairs of short stretches are checked together
            for k in np.flatnonzero(np.diff(first) >= LONG):
                own = slice(first[k], first[k + 1])
                count[own] = 0
                for i, j in _by_tiles(cols["sketch"][own], n[own], stop[own] - first[k], threshold):
                    near.append((i + first[k], j + first[k]))
                    held += len(i)
                    if held > AT_ONCE:
                        yield from kept(*map(np.concatenate, zip(*near, strict=True)))
                        near, held = [], 0
            if near:
                yield from kept(*map(np.concatenate, zip(*near, strict=True)))
        done, at = np.cumsum(count), 0
        while at < len(n):
            before = done[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(done, before + AT_ONCE, side="right")))
            own = count[at:to]
            i = np.repeat(np.arange(at, to), own)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
            yield from kept(i, j)
            at = to

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # the last run so far
        for b in batches:
            if not len(b):
                continue
            key = b.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last or rest and rest[-1].column(0)[-1].as_py() != int(key[0]):
                yield from found(pa.Table.from_batches([*rest, b.slice(0, last)]))
                rest = []
            rest.append(b.slice(last))
        if rest:
            yield from found(pa.Table.from_batches(rest))

    sorted_ = rows.select("key", *(x for x in names if x != "key")).repartition("key").sortWithinPartitions("key", "n")
    pairs = sorted_.mapInArrow(sweep, f"a {kind}, b {kind}").where("a <> b")
    return stash(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "met")


def overlap_fits(threshold: float) -> Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], np.ndarray]:
    """For prefix_rows(): pairs that can overlap by the threshold, by sizes, places and sketches."""

    def fits(cols: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n, at, s = cols["n"], cols["at"], cols["sketch"]
        total = n[i].astype(np.int64) + n[j]
        # At its first common token a pair has at most as many more as either set has left.
        good = np.minimum(n[i] - at[i], n[j] - at[j]) >= total * (threshold / (1 + threshold)) - 1e-9
        place = np.flatnonzero(good)
        near = differ(s, i[place], j[place]) <= allowed(total[place], threshold)
        good[place[~near]] = False
        if "fine" in cols:
            place = place[near]
            good[place[~_finer(cols["fine"], i[place], j[place], allowed(total[place], threshold))]] = False
        return good

    return fits


def with_sketch(sets: DataFrame, column: str, name: str, words: int) -> DataFrame:
    """`sets` with the sketch of the hashes in `column` (the last one), which it replaces, as binary column `name`."""
    kept = [x for x in sets.columns if x != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, of = _flat(b.column(len(kept)))
            bits = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * words), len(b), [None, pa.py_buffer(sketch(w, of, len(b), words).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], bits], names=[*kept, name])

    return sets.select(*kept, column).mapInArrow(run, ", ".join([*(f"{x} {t}" for x, t in sets.dtypes if x != column), f"{name} binary"]))


def overlaps(met: DataFrame, sets: DataFrame, columns: tuple[str, ...], union: str | None = None, block: int = GROUP) -> DataFrame:
    """(a, b, <column> struct of shared, left, right) of the pairs `met` (a, b) of one part: the exact sizes of what their sets share and have.

    `sets` (id, part, *columns sorted distinct hashes) come once for each group that they are needed in, not once for each pair: a component of pairs
    is dealt into blocks of at most about `block` sets, and a group is a pair of blocks. With `union` the sets of all columns together are one more.
    """
    met = stash(met, "met")
    roots = stash(components(met).select(F.col("node").alias("id"), "root"), "roots")
    sizes, size = sized_stash(roots.groupBy("root").agg(F.ceil(F.count("*") / block).alias("blocks")).where("blocks > 1"), "blocks")
    of = roots.join(small(sizes, size), "root", "left").select("id", "root", F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")), F.lit(0)).alias("block"))
    keyed = met.join(of.withColumnsRenamed({"id": "a", "block": "x"}), "a").join(of.select(F.col("id").alias("b"), F.col("block").alias("y")), "b")
    keyed = stash(keyed.select(F.xxhash64("root", F.least("x", "y"), F.greatest("x", "y")).alias("key"), "a", "b"), "keyed")
    used = keyed.select(F.col("key").alias("g"), F.explode(F.array("a", "b")).alias("id")).distinct()
    whole = used.join(sets.select("id", F.xxhash64("part").alias("p"), *columns), "id").select("g", "id", "p", *columns)
    kind, named = dict(met.dtypes)["a"], [*columns, *([union] if union else [])]

    def judge(pairs: pa.Table, members: pa.Table) -> pa.Table:
        at: dict = {}
        for k, i in enumerate(members.column("id").to_pylist()):
            at.setdefault(i, []).append(k)
        part = members.column("p").to_numpy()
        own = []
        for c in columns:
            lists = members.column(c).combine_chunks()
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = lists.flatten().to_numpy()
            own.append([flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)])
        if union:
            own.append([np.unique(np.concatenate(x)) for x in zip(*own, strict=True)])
        rows = [(a, b, i, j) for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True) for i in at.get(a, ()) for j in at.get(b, ()) if part[i] == part[j]]
        out = {"a": pa.array([x[0] for x in rows], members.schema.field("id").type), "b": pa.array([x[1] for x in rows], members.schema.field("id").type)}
        for c, s in zip(named, own, strict=True):
            counts = [[len(np.intersect1d(s[i], s[j], assume_unique=True)) for *_, i, j in rows], [len(s[i]) for _, _, i, _ in rows], [len(s[j]) for *_, j in rows]]
            out |= {f"{c}_{x}": pa.array(v, pa.int64()) for x, v in zip(("shared", "left", "right"), counts, strict=True)}
        return pa.table(out)

    schema = ", ".join([f"a {kind}, b {kind}", *(f"{c}_{x} long" for c in named for x in ("shared", "left", "right"))])
    got = keyed.groupBy("key").cogroup(whole.groupBy("g")).applyInArrow(judge, schema)
    return got.select("a", "b", *(F.struct(*(F.col(f"{c}_{x}").alias(x) for x in ("shared", "left", "right"))).alias(c) for c in named))


def overlap(c: str) -> Column:
    """The overlap of a column of overlaps(); 0 if a set is empty."""
    shared, left, right = (F.col(f"{c}.{x}") for x in ("shared", "left", "right"))
    return F.when((left == 0) | (right == 0), F.lit(0.0)).otherwise(shared / (left + right - shared))
