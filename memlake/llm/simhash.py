"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint holds the majority bits of the XXH64 hashes of a text's 3-word shingles. Distinct fingerprints are dealt into
groups: two that differ in at most 3 of 64 bits agree on one of four blocks of bits, so each fingerprint goes to four
groups; a group over GROUP rows is dealt on by four blocks of its remaining bits, as often as it takes, so no group grows with
the data and no link is lost. Within a group the fingerprints are sorted by Gray rank, and neighbours in that order form
nodes, nodes form upper nodes. A node keeps the bits all its members share, less those its parent keeps already. A search
goes down from the top, adds up the differences on the kept bits, and leaves a whole node out once the sum is over 3.

Edge cases: null or empty text has the fingerprint zero. Ties are broken by bit counts of over half, as stated. Repeated
rows share a fingerprint. A null doc_id never names a component unless all its ids are null. An empty table gives an
empty result. Extra columns are ignored. The pipeline's `keep_one` has settings of its own
(`nearcopies`). A very long text is worked on in one task, its bits counted block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import nearcopies
from memlake.llm.words import freeing
from memlake.operators.components import components
from memlake.shared import sized_stash, small, stash, table

SEED = 42
SHINGLE = 3
MAX_BITS = 3
GROUP = 4096
FAN = 8
_ALL = (1 << 64) - 1


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a whole text."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else [b" ".join(w)]
    raw = b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles])
    n, counts = len(raw) // 8, np.zeros(64, dtype=np.int64)
    octets = np.frombuffer(raw, dtype=np.uint8).reshape(n, 8)
    for i in range(0, n, 1 << 15):
        counts += np.unpackbits(octets[i : i + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(freeing(run), f"doc_id {kind}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Fingerprints in Gray order under nodes that keep shared bits."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        ones, zeros = self.codes, ~self.codes  # bits that all members have set, or have clear
        levels = []
        while True:
            levels.append((ones, ones | zeros))  # (pattern, kept bits)
            if len(ones) <= FAN:
                break
            at = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
        self.levels = []
        for i, (pattern, kept) in enumerate(levels):
            above = np.repeat(levels[i + 1][1], FAN)[: len(kept)] if i + 1 < len(levels) else np.uint64(0)
            self.levels.append((pattern, kept & ~above))

    def near(self, queries: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, member number in Gray order) at most `limit` bits apart."""
        pattern, kept = self.levels[-1]
        q = np.repeat(np.arange(len(queries)), len(pattern))
        node = np.tile(np.arange(len(pattern)), len(queries))
        total = np.zeros(len(q), dtype=np.uint8)
        for level in range(len(self.levels) - 1, -1, -1):
            pattern, kept = self.levels[level]
            if level < len(self.levels) - 1:
                q, total = np.repeat(q, FAN), np.repeat(total, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                inside = node < len(pattern)
                q, total, node = q[inside], total[inside], node[inside]
            total = total + np.bitwise_count((queries[q] ^ pattern[node]) & kept[node])
            near = total <= limit
            q, node, total = q[near], node[near], total[near]
        return q, node


def forest(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct codes: pairs of codes."""
    if len(codes) == 2:
        return (codes[:1], codes[1:]) if int(np.bitwise_count(codes[0] ^ codes[1])) <= MAX_BITS else (codes[:0], codes[:0])
    index = GrayIndex(codes)
    label = np.arange(len(codes))
    for i in range(0, len(codes), 256):
        q, m = index.near(index.codes[i : i + 256])
        u, v = label[q + i], label[m]
        u, v = u[u != v], v[u != v]
        while len(u):
            low = np.minimum(u, v)
            jump = np.arange(len(codes))
            np.minimum.at(jump, u, low)
            np.minimum.at(jump, v, low)
            while not np.array_equal(jump, jump[jump]):
                jump = jump[jump]
            label = jump[label]
            u, v = jump[u], jump[v]
            u, v = u[u != v], v[u != v]
    moved = label != np.arange(len(codes))
    return index.codes[moved], index.codes[label[moved]]


def _deal(rows: DataFrame) -> DataFrame:
    """Each row (fp, key, done) four times: the bits not in `done` are cut into four blocks, one of which joins the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, key, done = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in range(3))
            out: list[list[np.ndarray]] = [[], [], []]
            for mask in np.unique(done):
                at = done == mask
                free = [i for i in range(64) if not int(mask) >> i & 1]
                for j in range(4):
                    block = np.uint64(sum(1 << i for i in free[j::4])) if mask else np.uint64(sum(1 << i for i in free[16 * j : 16 * j + 16]))
                    mixed = (key[at] + np.uint64(j + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ (fp[at] & block)
                    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                    out[0].append(fp[at])
                    out[1].append(mixed ^ (mixed >> np.uint64(29)))
                    out[2].append(np.full(int(at.sum()), mask | block, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)) for x in out], names=["fp", "key", "done"])

    return rows.mapInArrow(freeing(run), "fp long, key long, done long")


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints of `distinct` (fp) that span every component of the links."""
    zero = F.lit(0).cast("long")
    rows, parts = stash(_deal(distinct.select("fp", zero.alias("key"), zero.alias("done"))), "groups"), []
    for _ in range(8):  # 64 bits are used up before that
        hot, size = sized_stash(rows.groupBy("key", "done").count().where(F.col("count") > GROUP).select("key", "done"), "hot")
        if hot.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(small(hot, size), ["key", "done"], "left_anti"))
        rows = stash(_deal(rows.join(small(hot, size), ["key", "done"], "left_semi").select("fp", "key", "done")), "groups")
    else:
        parts.append(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key = rest_fp = np.zeros(0, dtype=np.int64)

        def found(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
            pairs = [forest(np.unique(fp[s:e].view(np.uint64))) for s, e in zip(starts, ends, strict=True) if e - s > 1]
            a, b = ([np.concatenate(x).view(np.int64) for x in zip(*pairs, strict=True)]) if pairs else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            key = np.concatenate([rest_key, batch.column(0).to_numpy()])
            fp = np.concatenate([rest_fp, batch.column(1).to_numpy()])
            last = np.searchsorted(key, key[-1]) if len(key) else 0
            if last:
                yield found(key[:last], fp[:last])
            rest_key, rest_fp = key[last:], fp[last:]
        if len(rest_key):
            yield found(rest_key, rest_fp)

    whole = parts[0].select("key", "fp")
    for p in parts[1:]:
        whole = whole.unionByName(p.select("key", "fp"))
    dealt = whole.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(freeing(run), "a long, b long").distinct()


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row."""
    rows = stash(fingerprints(docs), "fps")
    distinct = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    nodes = components(links(distinct)).withColumnRenamed("node", "fp")
    rooted = stash(nodes.join(distinct, "fp"), "rooted")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named, size = sized_stash(rooted.join(lows, "root").select("fp", "component_id"), "named")
    own = distinct.join(small(named, size), "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    own, size = sized_stash(own, "components")
    return rows.join(small(own, size), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of `docs` but for near-copies: of each group of linked rows one stays (see `nearcopies`)."""
    return nearcopies.keep_one(docs, links)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
