"""Near-copies by the Jaccard similarity of their 5-word shingles, each link checked exactly.

Rows with equal shingle sets form a class. Candidates come in two ways:

1. SimHash fingerprints of the classes' shingles go through the Gray-order index, which gives a spanning forest of the links at 3
   bits or fewer. Most near-copies meet here, and a group of thousands costs rows, not pairs.
2. A fingerprint of 64 bits can't hold all pairs at 0.8 (they differ in some 10 bits, as many unlike texts do at this
   number of rows), so a join finds the rest. Two sets alike in 0.8 or more share a shingle among each one's first
   n - ceil(0.8 n) + 1 in any order that holds for all rows. A slice of all shingles is counted over all classes: a class with
   enough shingles there that no other has meets no one and is done. The others are joined in the order of the number of them that
   have a shingle; shingles that are frequent in a sample aren't counted and come last. Slice and sample bear on the time only.
   Pairs that are one component already are left out, as a link there changes nothing.

A candidate is dropped if the sizes, the places of a shingle in common, or a bitmap of parities (whose differing bits
are never more than the differing shingles) show that it can't reach 0.8; what is left is compared as whole sets.
Classes with the same first of all shingles are compared with one of them first, a row a class, as most near-copies meet there; then the first
shingles become rows. Where very many classes share one, they are compared with one of them, the hub, as long as that helps, and each round
goes on with the rows that the last one left; then pairs of different components are left, which meet inside tasks by pairs of bounded blocks, so a frequent shingle is dealt to many
tasks and only pairs that pass become rows. So no pair is lost. Shingles outside the hot ones are in no more classes than all rows of shingles by HOT_MOST, about, so
the steps that need all classes of such a shingle in one task hold few rows.

Edge cases: texts under 5 words are one shingle; null or empty texts have none and form a class. Very long texts are worked on
in one task, in memory of some times their size. Case is ignored. Shingles and classes are known by 64-bit hashes. Rows are told
apart by doc_id and text, so a null or repeated doc_id does no harm; of rows equal in both one stays. Ties: of a group the row of
the smallest doc_id stays, null ids last, and of those the one with the smallest hash of its text. Empty tables give an empty
result. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.words import coded_words, freeing, text_groups
from memlake.operators.components import components
from memlake.operators.sweep import differ, met_pairs
from memlake.shared import scratch, sized_stash, small, stash

SEED = 42
SHINGLE = 5
#: Similarity of near-copies, in hundredths.
ALIKE = 80
#: One row in so many is sampled for the order of shingles; those in HOT rows of the sample or more come last, HOT_MOST shingles at most.
SAMPLE, HOT, HOT_MOST = 10, 3, 200_000
#: Hubs are used while the pairs left are more than this many for each row of first shingles, and while they take away a share of GAIN.
PAIRS, HUB_ROUNDS, GAIN = 4, 8, 0.2
#: Rows of a shingle are compared in blocks of about so many, by bands of sizes this far apart (over 100 / ALIKE, so two bands hold any pair).
BLOCK, BAND = 4096, 1.3
#: 64-bit words of a class's bitmap of parities.
BITMAP = 8
#: Shingles below this, three of ten, are counted over all classes first; the others only for the classes that those leave open.
SLICE = np.uint64(3 * (1 << 64) // 10)
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(SHINGLE)], dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    for group in text_groups(texts):
        codes, words, ends = coded_words(pc.ascii_lower(group))
        known = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in words.to_pylist()), np.uint64, len(words))
        h = np.concatenate([known[codes], np.zeros(SHINGLE, np.uint64)])
        n = len(codes)
        s = sum(h[i : i + n] * _FACTORS[i] for i in range(SHINGLE))
        for begin, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if end - begin >= SHINGLE:
                own = s[begin : end - SHINGLE + 1]
            else:
                own = np.sum(h[begin:end] * _FACTORS[: end - begin], dtype=np.uint64, keepdims=True)[: end - begin]
            own = (own ^ (own >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            yield np.unique(own ^ (own >> np.uint64(29)))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return next(shingle_sets(pa.array([text], pa.string())))


def fingerprint(s: np.ndarray) -> int:
    """The majority bits of a set's hashes."""
    counts, octets = np.zeros(64, np.int64), s.view(np.uint8).reshape(-1, 8)
    for i in range(0, len(s), 1 << 15):
        counts += np.unpackbits(octets[i : i + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(s)).tobytes(), "big")


def bitmap(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's hashes fall on each bit. Two bitmaps differ in no more bits than the sets in members."""
    odd = np.bincount((s >> np.uint64(32)).astype(np.int64) % (64 * BITMAP), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def prefix_size(n: int) -> int:
    """So many shingles of a set of n hold one of each set alike to it."""
    return n - -(-ALIKE * n // 100) + 1 if n else 0


def _prefix(n: Column) -> Column:
    """The same of a column of sizes over 0."""
    return n - F.floor((ALIKE * n + 99) / 100) + 1


def _hot(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample of `texts` (k, text), sorted, and in how many rows they are: HOT_MOST at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*shingle_sets(b.column(0)), np.zeros(0, np.uint64)]).view(np.int64))], names=["sh"])

    part = texts.where(F.pmod(F.xxhash64("k"), F.lit(SAMPLE)) == 0).select("text")
    found = stash(part.mapInArrow(freeing(run), "sh long").groupBy("sh").count().where(F.col("count") >= HOT), "hot")
    step = F.floor(F.log2(F.col("count").cast("double")) * 16).cast("int")
    least, room = 1 << 30, HOT_MOST
    for k, n in sorted(found.groupBy(step.alias("k")).agg(F.count("*")).collect(), reverse=True):  # some hundred steps at most
        if n > room:
            break
        least, room = k, room - n
    got = found.where(step >= least).toArrow()
    sh, n = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy()
    at = np.argsort(sh)
    return sh[at], n[at]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def _split(s: np.ndarray, hot: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a set: its shingles that aren't hot, sorted, and its hot ones in order."""
    if not len(hot):
        return s, s[:0]
    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    is_hot = hot[at] == s
    often = s[is_hot]
    return s[~is_hot], often[np.lexsort((often, freq[at[is_hot]]))]


def _sets(texts: DataFrame, hot: Broadcast) -> DataFrame:
    """(doc_id, k, cid, n, fp, bits, some) for every row of `texts` (doc_id, k, text): class, size, fingerprint, and once in each
    task the class's bitmap and those of its shingles that are in the slice and aren't hot."""
    kind = dict(texts.dtypes)["doc_id"]
    names = ["doc_id", "k", "cid", "n", "fp", "bits", "some"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, none = {}, np.zeros(0, np.uint64)
        for b in batches:
            cids, sizes, fps, bits, some = [], [], [], [], []
            for s in shingle_sets(b.column(2)):
                cid = xxhash.xxh3_64_intdigest(s.tobytes(), SEED)
                new = cid not in seen
                if new:
                    seen[cid] = fingerprint(s)
                cids.append(cid)
                sizes.append(len(s))
                fps.append(seen[cid])
                bits.append(bitmap(s) if new else none)
                some.append(_split(s[: np.searchsorted(s, SLICE)], *hot.value)[0] if new else none)
            ints = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            cols = [b.column(0), b.column(1), ints(cids), pa.array(sizes, pa.int64()), ints(fps), _lists(bits), _lists(some)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return texts.select("doc_id", "k", "text").mapInArrow(freeing(run), f"doc_id {kind}, k long, cid long, n long, fp long, bits array<long>, some array<long>")


def _of_classes(rows: DataFrame, texts: DataFrame, used: DataFrame, lists: Callable[[np.ndarray], tuple], names: list[str]) -> DataFrame:
    """(cid, *names) of the classes in `used` (cid): `lists` of their sets, from a text of each; repeated texts repeat them."""
    one, size = sized_stash(rows.join(used, "cid", "left_semi").groupBy("cid").agg(F.min("k").alias("k")), "texts_of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            at = [i for i, c in enumerate(b.column(0).to_pylist()) if not (c in seen or seen.add(c))]
            part = b.take(pa.array(at, pa.int64()))
            if at:
                columns = zip(*map(lists, shingle_sets(part.column(1))), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(_lists(list(x)) for x in columns)], names=["cid", *names])

    found = texts.select("k", "text").join(small(one, size), "k").select("cid", "text")
    return found.mapInArrow(freeing(run), ", ".join(["cid long", *(f"{x} array<long>" for x in names)]))


def _runs(found: Callable[..., pa.RecordBatch], columns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows sorted by their first column: `found` of the columns, rows with equal first values always in one call."""

    def joined(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        return found(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [[np.zeros(0, np.int64)] * columns]  # the last run so far, in parts that are joined once
        for b in batches:
            now = [x.to_numpy() for x in b.columns]
            if not len(now[0]):
                continue
            last = np.searchsorted(now[0], now[0][-1])
            if last or len(rest[-1][0]) and rest[-1][0][0] != now[0][0]:
                yield joined([*rest, [x[:last] for x in now]])
                rest = []
            rest.append([x[last:] for x in now])
        yield joined(rest)

    return run


def _of_many(w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted rows (shingle, class): those whose shingle has several classes, each once, and how many classes."""
    new = np.r_[True, (w[1:] != w[:-1]) | (c[1:] != c[:-1])][: len(w)]
    w, c = w[new], c[new]
    size = np.diff(np.r_[np.flatnonzero(np.r_[True, w[1:] != w[:-1]][: len(w)]), len(w)])
    f = np.repeat(size, size)
    return w[f > 1], c[f > 1], f[f > 1]


def _open_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, n) of the classes that may have a near-copy.

    In the order with the slice first, and there shingles of one class only, a class with so many of these has no others among
    its first shingles, so it meets no one.
    """

    def shared(w: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        cid, count = np.unique(_of_many(w, c)[1], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(cid), pa.array(count)], names=["cid", "count"])

    flat = rows.select(F.explode("some").alias("w"), "cid").repartition("w").sortWithinPartitions("w", "cid")
    met = flat.mapInArrow(freeing(_runs(shared, 2)), "cid long, count long").groupBy("cid").agg(F.sum("count").alias("met"))
    own = classes.where("n > 0").join(met, "cid", "left")
    return stash(own.where(F.col("some") - F.coalesce("met", F.lit(0)) < _prefix(F.col("n"))).select("cid", "n"), "open")


def _first_shingles(rows: DataFrame, texts: DataFrame, opened: DataFrame, hot: Broadcast) -> DataFrame:
    """(cid, n, alone, first): for each class in `opened` (cid, n) the number of its shingles that no other of them has, and in order those of
    its first shingles that others have too, as (i, w) with their places.

    The order is: shingles of one of the classes, then by the number of classes, then hot ones by their rows in the sample.
    """

    def lists(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rare, often = _split(s, *hot.value)
        return rare, often[: max(0, prefix_size(len(s)) - len(rare))]

    def shared(w: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _of_many(w, c)], names=["w", "cid", "f"])

    sets = stash(_of_classes(rows, texts, opened, lists, ["rare", "hot"]), "rare")
    flat = sets.select(F.explode("rare").alias("w"), "cid").repartition("w").sortWithinPartitions("w", "cid")
    met = flat.mapInArrow(freeing(_runs(shared, 2)), "w long, cid long, f long").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("f", "w"))).alias("met"))
    one = sets.groupBy("cid").agg(F.first(F.size("rare")).alias("rares"), F.first("hot").alias("hot"))
    both = opened.join(one, "cid").join(met, "cid", "left").withColumn("met", F.coalesce(F.col("met.w"), F.array().cast("array<long>")))
    alone = F.col("rares") - F.size("met")
    first = F.concat(F.slice("met", F.lit(1), F.greatest(_prefix(F.col("n")) - alone, F.lit(0)).cast("int")), "hot")
    placed = F.transform(first, lambda w, i: F.struct(i.cast("long").alias("i"), w.alias("w")))
    return stash(both.select("cid", "n", alone.alias("alone"), placed.alias("first")).where(F.size("first") > 0), "prefixes")


def _rooted(first: DataFrame, named: DataFrame, named_bytes: int) -> DataFrame:
    """(w, cid, n, i, rest, root): a row for each of the `first` shingles (i, w) of a class, where i is how many such came before it, and rest how many
    shingles of the class come after it. A class gets its component before its shingles become rows."""
    own = first.join(small(named, named_bytes), "cid", "left").select("cid", "n", "alone", F.coalesce("root", "cid").alias("root"), F.inline("first"))
    return own.select("w", "cid", "n", "i", (F.col("n") - F.col("alone") - F.col("i") - 1).alias("rest"), "root")


def _still_open(left: DataFrame) -> DataFrame:
    """The rows of _parted() as classes (cid, n, alone, first) for _rooted(). Components only merge, so no other shingle of theirs can part any later."""
    alone = F.col("n") - F.col("i") - F.col("rest") - 1
    return stash(left.groupBy("cid").agg(F.first("n").alias("n"), F.first(alone).alias("alone"), F.collect_list(F.struct("i", "w")).alias("first")), "open_prefixes")


def _leading(first: DataFrame, named: DataFrame, named_bytes: int) -> DataFrame:
    """(w, cid, n, i, rest, root) of each class's first shingle alone, a row a class."""
    own = first.join(small(named, named_bytes), "cid", "left").select("cid", "n", "alone", F.coalesce("root", "cid").alias("root"), F.col("first")[0].alias("x"))
    return own.select("x.w", "cid", "n", "x.i", (F.col("n") - F.col("alone") - 1).alias("rest"), "root")


def _apart(first: DataFrame, named: DataFrame, named_bytes: int) -> tuple[DataFrame, int, int]:
    """_parted() of rows (w, cid, n, i, rest) whose components are in `named`."""
    return _parted(first.join(small(named, named_bytes), "cid", "left").select("w", "cid", "n", "i", "rest", F.coalesce("root", "cid").alias("root")))


def _parted(own: DataFrame) -> tuple[DataFrame, int, int]:
    """(w, cid, n, i, rest, root, size): rows of `own` whose shingle is shared by classes of different components, and by how many
    classes; then the number of these rows, and of pairs of different components by shingle.

    Rows are counted by shingle and component first, so no task sees all rows of a shingle.
    """
    parts = own.groupBy("w", "root").agg(F.count("*").alias("c"))
    by_w = parts.groupBy("w").agg(F.count("*").alias("roots"), F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("within"))
    met, met_bytes = sized_stash(by_w.where("roots > 1").select("w", "size", F.expr("(size * size - within) div 2").alias("pairs")), "shared")
    total, pairs = met.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first()
    return stash(own.join(small(met.select("w", "size"), met_bytes), "w"), "apart"), total, pairs


def _fits(cols: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of different components can be alike, by sizes, places and bitmaps, where this is the first shingle that they share.

    Alike pairs pass at the first, as all their rows are compared, so most rows of a pair that meets in many shingles are not made.
    """
    n, total = cols["n"], cols["n"][i] + cols["n"][j]
    shared = 1 + np.minimum(cols["rest"][i], cols["rest"][j])
    good = (cols["root"][i] != cols["root"][j]) & (n[i] * 100 >= n[j] * ALIKE) & (shared * (100 + ALIKE) >= total * ALIKE)
    place = np.flatnonzero(good)
    good[place[differ(cols["bits"], i[place], j[place]) * (100 + ALIKE) > total[place] * (100 - ALIKE)]] = False
    return good


def _side(rows: DataFrame, bands: int, suffix: str) -> DataFrame:
    """`rows` with the keys under which they meet others: shingle, band of sizes and a pair of blocks.

    The rows of a shingle are dealt into blocks of about BLOCK, and every pair of blocks is a key, so a frequent shingle is many tasks.
    A set goes to its own band, and to the `bands` - 1 below it.
    """
    blocks = F.ceil(F.col("size") / BLOCK)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("cid"), blocks)).withColumn("across", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(BAND))
    dealt = dealt.withColumn("band", F.explode(F.array(*(band - i for i in range(bands)))))
    keys = [F.col("w"), F.col("band"), F.least("block", "across").alias("low"), F.greatest("block", "across").alias("high")]
    return dealt.select(*keys, *(F.col(x).alias(x + suffix) for x in ("cid", "n", "i", "rest", "root", "block")))


def _met(rows: DataFrame) -> DataFrame:
    """Pairs of `rows` of one shingle whose sizes may fit, the smaller set first, each once: columns of both, the second's with 2.

    A plain join, which makes a row of each pair; tests hold _compared() to it.
    """
    both = _side(rows, 1, "").join(_side(rows, 2, "2"), ["w", "band", "low", "high"])
    ordered = (F.col("n") < F.col("n2")) | (F.col("n") == F.col("n2")) & (F.col("cid") < F.col("cid2"))
    return both.where(ordered & ((F.col("low") == F.col("high")) | (F.col("block") != F.col("block2"))))


def _compared(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) of _met() that can be alike, from `classes` (cid, bits). They are compared inside tasks, so a pair that can't be is never a row."""
    dealt = _side(rows, 1, "").join(classes.select("cid", "bits"), "cid")
    side = F.when(F.col("low") == F.col("high"), F.lit(-1).cast("long")).otherwise(F.col("block")).alias("side")
    return met_pairs(dealt.select(F.xxhash64("w", "low", "high").alias("key"), F.col("cid").alias("id"), "n", side, "i", "rest", "root", "bits"), ALIKE / 100, _fits)


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * ALIKE


def _places_fit(n: Column, i: Column, rest: Column, m: Column, j: Column, after: Column) -> Column:
    """Sets of n and m that meet in a shingle share at most that, those that come before it in both and those after it in both."""
    return (F.least(i, j) + 1 + F.least(rest, after)) * (100 + ALIKE) >= (n + m) * ALIKE


def _linked(pairs: DataFrame, classes: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are alike: by sizes and bitmaps first, then by their whole sets."""
    left = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    differ = sum(F.bit_count(F.get("ba", F.lit(i)).bitwiseXOR(F.get("bb", F.lit(i)))) for i in range(BITMAP))
    near = differ * (100 + ALIKE) <= (F.col("na") + F.col("nb")) * (100 - ALIKE)
    pairs = pairs.distinct().join(left, "a").join(right, "b").where(_sizes_fit(F.col("na"), F.col("nb")) & near).select("a", "b")
    pairs, _ = sized_stash(pairs, "pairs")
    used, used_size = sized_stash(pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct(), "used")
    whole = _of_classes(rows, texts, small(used, used_size), lambda s: (s,), ["sh"])
    sets, sets_size = sized_stash(whole.groupBy("cid").agg(F.first("sh").alias("sh")), "whole_sets")
    a, b = sets.select(F.col("cid").alias("a"), F.col("sh").alias("sa")), sets.select(F.col("cid").alias("b"), F.col("sh").alias("sb"))
    both = pairs.join(small(a, sets_size), "a").join(small(b, sets_size), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    met = both.select("a", "b", shared.alias("m"), (F.size("sa") + F.size("sb")).alias("s"))
    return met.where(F.col("m") * 100 >= (F.col("s") - F.col("m")) * ALIKE).select("a", "b")


def linked_classes(rows: DataFrame, texts: DataFrame, hot: Broadcast, fingerprint_links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(cid, root): the component of every class that has a near-copy."""
    spark = rows.sparkSession

    def verified(pairs: DataFrame) -> DataFrame:
        with scratch(spark, "links"):
            return stash(_linked(pairs, classes, rows, texts), "links")

    def rooted(links: DataFrame) -> tuple[DataFrame, int]:
        with scratch(spark, "named"):
            return sized_stash(components(links).select(F.col("node").alias("cid"), "root"), "named")

    classes = stash(rows.where(F.size("bits") > 0).groupBy("cid").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bits").alias("bits"), F.first(F.size("some")).alias("some")), "classes")
    first = stash(classes.where("n > 0").groupBy("fp").agg(F.min("cid").alias("rep")), "first")
    near = fingerprint_links(first.select("fp"))
    ends = [first.select(F.col("fp").alias(x), F.col("rep").alias(f"rep_{x}")) for x in ("a", "b")]
    across = near.join(ends[0], "a").join(ends[1], "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    same = classes.where("n > 0").join(first, "fp").where("cid <> rep").select(F.col("cid").alias("a"), F.col("rep").alias("b"))
    links = verified(across.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    named, size = rooted(links)
    with scratch(spark, "prefixes"):
        leading = _first_shingles(rows, texts, _open_classes(rows, classes), hot)
    other = [F.col(x).alias(x + "2") for x in ("cid", "n", "i", "rest", "root")]

    def met_hubs(left: DataFrame, turn: int) -> DataFrame:
        hubs = left.groupBy("w").agg(F.min(F.struct(F.xxhash64("cid", F.lit(turn)).alias("h"), *other)).alias("hub"))
        hubs, size = sized_stash(hubs.select("w", "hub.*").drop("h"), "hubs")
        found = left.join(small(hubs, size), "w")
        found = found.where((F.col("root") != F.col("root2")) & _sizes_fit(F.col("n"), F.col("n2")) & _places_fit(*map(F.col, ("n", "i", "rest", "n2", "i2", "rest2"))))
        return found.select(F.least("cid", "cid2").alias("a"), F.greatest("cid", "cid2").alias("b"))

    links = links.unionByName(verified(met_hubs(_leading(leading, named, size), -1)))
    named, size = rooted(links)
    opening = leading.agg(F.coalesce(F.sum(F.size("first")), F.lit(0))).first()[0]
    (left, total, pairs), last = _parted(_rooted(leading, named, size)), None
    for turn in range(HUB_ROUNDS + 1):
        if not total:
            break
        direct = pairs <= PAIRS * opening or turn == HUB_ROUNDS or last is not None and pairs > (1 - GAIN) * last
        links = links.unionByName(verified(_compared(left, classes) if direct else met_hubs(left, turn)))
        named, size = rooted(links)
        if direct:
            break
        last = pairs
        left, total, pairs = _parted(_rooted(_still_open(left), named, size))
    return named


def keep_one(docs: DataFrame, fingerprint_links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of `docs` but for near-copies: of each component of linked rows the one of the smallest doc_id stays.

    `fingerprint_links` gives links (a, b) that span the components of fingerprints (fp) near each other.
    """
    with scratch(docs.sparkSession, "gone", "again"):
        return _keep_one(docs, fingerprint_links)


def _keep_one(docs: DataFrame, fingerprint_links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    k = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    texts = docs.select("doc_id", k.alias("k"), "text")
    hot = docs.sparkSession.sparkContext.broadcast(_hot(texts))
    rows = stash(_sets(texts, hot), "sets")
    named, size = sized_stash(linked_classes(rows, texts, hot, fingerprint_links), "components")
    rows = stash(rows.select("doc_id", "k", "cid").join(small(named, size), "cid", "left").select("doc_id", "k", F.coalesce("root", "cid").alias("root")), "rooted")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("d"), F.col("k").alias("k")))
    best, size = sized_stash(rows.groupBy("root").agg(first.alias("best"), F.count("*").alias("c")).where("c > 1").select("root", "best.d", F.col("best.k").alias("best_k")), "best")
    met = stash(rows.join(small(best, size), "root").select("doc_id", "k", (F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k") == F.col("best_k"))).alias("stays")), "met")
    gone, size = sized_stash(met.where("NOT stays").select(F.col("doc_id").alias("_d"), F.col("k").alias("_k")).distinct(), "gone")
    again, again_size = sized_stash(met.where("stays").groupBy(F.col("doc_id").alias("_d"), F.col("k").alias("_k")).count().where("count > 1").select("_d", "_k"), "again")
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    same = lambda t: docs["doc_id"].eqNullSafe(t["_d"]) & (key == t["_k"])
    kept = docs.join(small(gone, size), same(gone), "left_anti")
    if again.isEmpty():
        return kept
    once = kept.join(small(again, again_size), same(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(small(again, again_size), same(again), "left_anti").unionByName(once)
