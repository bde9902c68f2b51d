"""Removal of long repeated passages by difference-cover anchors.

A word goes if it lies in a window of WINDOW words whose sequence also starts in a document with a smaller doc_id. COVER is a
difference cover modulo PERIOD: for any two places there is a shift under PERIOD that takes both to cover positions. So two
equal windows share an aligned anchor: a run of WINDOW - PERIOD + 1 words at a cover position. Only anchors are hashed and
compared at first; those that occur in one document alone are dropped.

Extension: the context of an anchor is all the words that windows over it can reach. Anchors with equal contexts form
a class. In a class, all windows of members but of the smallest doc_id are repeats at once. What is left are the smallest
members of classes whose anchor has several classes: only their windows over the anchor are hashed (128 bits) and compared
one by one. So the copies of a passage, however many, cost one row each, and nothing grows with pairs.

Edge cases: null or empty text has no words. Rows with a null doc_id lose nothing and are no source. Repeated rows are
judged alike and lose nothing to each other, as neither id is smaller; rows that share a doc_id with different
texts are judged each by its own text. An empty table gives an empty result. Extra columns are ignored. Very long texts are taken
whole, their windows in one task. Ties of ids are repeated rows, as above; of several earlier documents any one is reason enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.shared import sized_stash, small, stash, table

WINDOW = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
CACHE_WORDS = 400_000

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_U = np.uint64


class _WordHashes(dict):
    """64-bit hashes of words; forgets all when too many."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 0)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), _U, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Rolling:
    """Hashes of any ranges of a word sequence, from prefix sums of a polynomial modulo 2**64."""

    _powers: dict = {}

    def __init__(self, hashes: np.ndarray, which: int):
        n = len(hashes)
        have = Rolling._powers.get(which)
        if have is None or len(have[0]) <= n:
            size, base = max(4096, 2 * n), _BASES[which]
            up, down = np.full(size, base, _U), np.full(size, pow(base, -1, 1 << 64), _U)
            up[0] = down[0] = 1
            have = Rolling._powers[which] = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
        self.down = have[1]
        words = _mix(hashes + _U(which)) if which else hashes
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(words * have[0][:n], dtype=_U)])

    def ranges(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(_U))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def cover_places(n: int) -> np.ndarray:
    """Places of anchors in a text of n words; none if no window fits."""
    if n < WINDOW:
        return np.zeros(0, np.int64)
    at = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
    return at[at + ANCHOR <= n]


def _anchors(docs: DataFrame, context: bool) -> DataFrame:
    """h, doc for each distinct anchor of a row; with context also t (hash of the text), pos and c (hash of the context)."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"h long, doc {kind}" + (", t long, pos int, c long" if context else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for b in batches:
            rows, hs, ps, cs = [], [], [], []
            for i, text in enumerate(b.column(2)):
                w = known.of(_words(text.as_py()))
                at = cover_places(len(w))
                if not len(at):
                    continue
                h = Rolling(w, 0).ranges(at, at + ANCHOR)
                if context:
                    begin, end = np.maximum(at - PERIOD + 1, 0), np.minimum(at + WINDOW, len(w))
                    cs.append(Rolling(w, 1).ranges(begin, end) ^ (at - begin).astype(_U))
                    ps.append(at)
                else:
                    h = np.unique(h)
                hs.append(h)
                rows.append(np.full(len(h), i))
            if not hs:
                continue
            take = pa.array(np.concatenate(rows))
            cols = [pa.array(np.concatenate(hs).view(np.int64)), b.column(0).take(take)]
            names = ["h", "doc"]
            if context:
                cols += [b.column(1).take(take), pa.array(np.concatenate(ps).astype(np.int32)), pa.array(np.concatenate(cs).view(np.int64))]
                names += ["t", "pos", "c"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(run, schema)


def _windows(rows: DataFrame) -> DataFrame:
    """doc, t, i, h1, h2 for each window over the places of rows (doc_id, t, text, places)."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for b in batches:
            take, at, h1, h2 = [], [], [], []
            for i, (text, places) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                w = known.of(_words(text.as_py()))
                mark = np.zeros(len(w) + 1, np.int32)
                p = places.values.to_numpy()
                np.add.at(mark, np.maximum(p - PERIOD + 1, 0), 1)
                np.add.at(mark, np.minimum(p + 1, len(w)), -1)
                starts = np.flatnonzero(np.cumsum(mark)[: max(0, len(w) - WINDOW + 1)] > 0)
                take.append(np.full(len(starts), i))
                at.append(starts.astype(np.int32))
                h1.append(Rolling(w, 0).ranges(starts, starts + WINDOW))
                h2.append(Rolling(w, 1).ranges(starts, starts + WINDOW))
            if take:
                idx = pa.array(np.concatenate(take))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(idx), b.column(1).take(idx), pa.array(np.concatenate(at)), *[pa.array(np.concatenate(x).view(np.int64)) for x in (h1, h2)]],
                    names=["doc", "t", "i", "h1", "h2"],
                )

    return rows.select("doc_id", "t", "text", "places").mapInArrow(run, f"doc {kind}, t long, i int, h1 long, h2 long")


def _by_text(docs: DataFrame, found: DataFrame, found_bytes: int, how: str) -> DataFrame:
    """Joins rows (doc, t, ...) to their texts, by broadcast if their stored size allows."""
    left = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    right = small(found.withColumnRenamed("t", "_t"), found_bytes, 8 << 20)
    return left.join(right, (left["doc_id"] == right["doc"]) & (left["t"] == right["_t"]), how).drop("doc", "_t")


def repeats(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc, t, spans array of (begin, end)): the words that go, and the bytes stored."""
    shared = _anchors(docs, False).groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("h")
    shared, size = sized_stash(shared, "shared")
    anchors = stash(_anchors(docs, True).join(small(shared, size), "h"), "anchors")
    classes = stash(anchors.groupBy("h", "c").agg(F.min("doc").alias("low"), F.max("doc").alias("high")), "classes")
    several = classes.groupBy("h").agg(F.count("*").alias("n"), F.min("low").alias("a"), F.max("high").alias("b")).where("n > 1 AND a < b").select("h")
    several, size = sized_stash(several, "several")
    rich = classes.join(small(several.withColumn("more", F.lit(True)), size), "h", "left").where("low < high OR more").select("h", "c", "low", F.coalesce("more", F.lit(False)).alias("more"))
    judged = stash(anchors.join(rich, ["h", "c"]).where("doc > low OR more").select("doc", "t", "pos", (F.col("doc") > F.col("low")).alias("gone")), "judged")
    places, size = sized_stash(judged.where("NOT gone").groupBy("doc", "t").agg(F.collect_set("pos").alias("places")), "places")
    windows = stash(_windows(_by_text(docs, places, size, "inner")), "windows")
    twice = windows.groupBy("h1", "h2").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("h1", "h2", "low")
    again = windows.join(twice, ["h1", "h2"]).where("doc > low").select("doc", "t", F.col("i").alias("begin"), (F.col("i") + WINDOW).alias("end"))
    direct = judged.where("gone").select("doc", "t", F.greatest(F.col("pos") - PERIOD + 1, F.lit(0)).alias("begin"), (F.col("pos") + WINDOW).alias("end"))
    spans = direct.unionByName(again).groupBy("doc", "t").agg(_islands(F.array_sort(F.collect_set(F.struct("begin", "end")))).alias("spans"))
    return sized_stash(spans, "spans")


def _islands(spans: Column) -> Column:
    """Sorted spans (begin, end), those that touch made one."""

    def step(a: Column, x: Column) -> Column:
        joins = x["begin"] <= a["end"]
        done = F.when(joins | (a["end"] < 0), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(a["begin"].alias("begin"), a["end"].alias("end")))))
        return F.struct(done.alias("out"), F.when(joins, a["begin"]).otherwise(x["begin"]).alias("begin"), F.when(joins, F.greatest(a["end"], x["end"])).otherwise(x["end"]).alias("end"))

    none = F.array().cast("array<struct<begin:int,end:int>>")
    start = F.struct(none.alias("out"), F.lit(0).alias("begin"), F.lit(-1).alias("end"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.array(F.struct(a["begin"].alias("begin"), a["end"].alias("end")))))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for every row."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = _by_text(docs, *repeats(docs), "left").select("doc_id", "text", "spans")
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha, kept = [], [], [], []
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                w = _words(text.as_py())
                n.append(len(w))
                removed = 0
                if spans.is_valid:
                    mark = np.zeros(len(w) + 1, np.int32)
                    np.add.at(mark, spans.values.field("begin").to_numpy(), 1)
                    np.add.at(mark, np.minimum(spans.values.field("end").to_numpy(), len(w)), -1)
                    stay = np.flatnonzero(np.cumsum(mark[:-1]) == 0)
                    removed = len(w) - len(stay)
                    w = [w[i] for i in stay]
                out = b" ".join(w)
                gone.append(removed)
                sha.append(hashlib.sha256(out).hexdigest())
                if with_text:
                    kept.append(out.decode())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array(kept, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: Every window compared as text: for small tables.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT uid, doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM d WHERE len(w) >= {WINDOW}),
h AS (SELECT uid, doc_id, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS k FROM s),
m AS (SELECT k, min(doc_id) AS low FROM h GROUP BY k HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT uid, i + j AS p FROM (SELECT uid, i FROM h JOIN m ON m.k = h.k WHERE doc_id > low) x, range({WINDOW}) AS o(j)),
r AS (SELECT uid, list(p) AS ps, count(*) AS n FROM g GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p)), lambda p: w[p]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r ON r.uid = d.uid
"""
