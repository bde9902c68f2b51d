"""Exact neighbours of vectors: a tree of cells by pivots, pairs of cells pruned by the angle, one matrix product a pair of blocks.

The angle between vectors is a metric. Each cell of over BLOCK rows is split by up to FAN pivots of its own, each row going to
the nearest, until cells are blocks of bounded size; a cell is a pivot and the largest angle of its rows to it. Two cells can hold
near rows only if their pivots' angle is at most the limit and both radii, so pairs of cells go down the tree from each part with
itself, and those too far apart are dropped. What is left are pairs of blocks; the rows of a pair meet in one bounded group, as one
matrix product. A cell that no longer splits (its rows are hardly apart) is cut into blocks by hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.shared import sized_stash, small, stash

#: Rows of a block, pivots of a cell, rows of a task that looks for pivots, and levels of the tree, at most.
BLOCK, FAN, CHUNK, LEVELS = 1024, 32, 8192, 12
#: Blocks of a side of a task of near_links(), and numbers of its vectors, at most.
SIDE, NUMBERS = 16, 1 << 21
#: Slack of angles in radians, over what rounding can do.
SLACK = 1e-6


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Unit rows of equally long vectors."""
    flat = np.asarray(vectors.combine_chunks().flatten(), np.float64)
    m = flat.reshape(len(vectors), -1)
    return m / np.linalg.norm(m, axis=1)[:, None]


def sound(vectors: DataFrame, key: str, part: str, vector: str) -> DataFrame:
    """(id, part, v, node): rows with a key and a direction; vectors of one part and one length share a root node."""
    v = F.col(vector).cast("array<double>")
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    rows = vectors.select(F.col(key).alias("id"), F.col(part).alias("part"), v.alias("v"), norm.alias("_n"))
    return rows.where("id IS NOT NULL AND size(v) > 0 AND _n > 0 AND _n < double('Infinity')").select("id", "part", "v", F.xxhash64("part", F.size("v")).alias("node"))


def _split(open_: DataFrame, level: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """The rows (id, part, v, node) of cells (node, n) one level down, and the new cells (node, parent, pivot, radius)."""
    chunk = F.pmod(F.xxhash64("id", F.lit(-1)), F.ceil(F.col("n") / CHUNK))
    step = F.greatest(F.floor(F.col("n") / (4 * fan)), F.lit(1))
    drawn = open_.where(F.pmod(F.xxhash64("id", F.lit(level)), step) == 0).select("node", "n", "v", F.xxhash64("id", F.lit(level), F.lit(0)).alias("r"))
    first = drawn.groupBy("node").agg(F.first("n").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct("r", "v"))), 1, fan).alias("p"))  # some 4 fan rows a cell
    pivots = stash(first.select("node", "n", F.transform("p", lambda x: x["v"]).alias("pivots")), "pivots")
    spread = pivots.select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / CHUNK) - 1)).alias("chunk"), "pivots")
    kinds = dict(open_.dtypes)

    def assign(rows: pa.Table, of: pa.Table) -> pa.Table:
        if not rows.num_rows or not of.num_rows:
            return pa.table({"id": rows.column("id")[:0], "part": rows.column("part")[:0], "v": rows.column("v")[:0], "node": rows.column("node")[:0], "place": pa.array([], pa.int32()), "angle": pa.array([], pa.float64())})
        p = _matrix(pa.chunked_array([of.column("pivots").combine_chunks().flatten()]))
        cos = _matrix(rows.column("v")) @ p.T
        place = cos.argmax(axis=1)
        angle = np.arccos(np.clip(cos[np.arange(len(place)), place], -1, 1))
        return pa.table({"id": rows.column("id"), "part": rows.column("part"), "v": rows.column("v"), "node": rows.column("node"), "place": pa.array(place.astype(np.int32)), "angle": pa.array(angle)})

    grouped = open_.select("id", "part", "v", "node", chunk.alias("chunk")).groupBy("node", "chunk").cogroup(spread.groupBy("node", "chunk"))
    dealt = stash(grouped.applyInArrow(assign, f"id {kinds['id']}, part {kinds['part']}, v array<double>, node long, place int, angle double"), "dealt")
    child = F.xxhash64("node", F.col("place") + 1)
    cells = dealt.groupBy("node", "place").agg(F.max("angle").alias("radius")).join(pivots, "node")
    cells = cells.select(child.alias("node"), F.col("node").alias("parent"), F.get("pivots", F.col("place")).alias("pivot"), "radius")
    return dealt.select("id", "part", "v", child.alias("node")), cells


def blocks(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, list[DataFrame]]:
    """sound() rows with `node` their block, and the cells of each level, the topmost first; a cell that isn't split has a copy of itself below."""
    rows = stash(rows, "vectors")
    levels = [stash(rows.select("node").distinct().select("node", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("array<double>").alias("pivot"), F.lit(None).cast("double").alias("radius")), "cells")]
    done, before = [], None
    for level in range(LEVELS):
        sizes, size = sized_stash(rows.groupBy("node").agg(F.count("*").alias("n")), "sizes")
        done.append(rows.join(small(sizes.where(F.col("n") <= block).select("node"), size), "node", "left_semi"))
        big = sizes.where(F.col("n") > block)
        left = big.agg(F.sum("n")).first()[0] or 0
        if not left:
            break
        open_ = rows.join(small(big, size), "node")
        if level == LEVELS - 1 or left == before:  # no cell got smaller
            cut = F.xxhash64("node", F.lit(0), F.pmod(F.xxhash64("id", F.lit(-2)), F.ceil(F.col("n") * 2 / block)))
            rows = stash(open_.withColumn("_child", cut).select("id", "part", "v", "node", "_child"), "cut")
            cells = rows.select(F.col("node").alias("parent"), F.col("_child").alias("node")).distinct().join(levels[-1].select(F.col("node").alias("parent"), "pivot", "radius"), "parent").select("node", "parent", "pivot", "radius")
            done.append(rows.select("id", "part", "v", F.col("_child").alias("node")))
            rows = None
        else:
            rows, cells = _split(open_, level, fan)
        stay = levels[-1].join(small(big.select("node"), size), "node", "left_anti").select("node", F.col("node").alias("parent"), "pivot", "radius")
        levels.append(stash(cells.unionByName(stay), "cells"))
        before = left
        if rows is None:
            break
    out = done[0]
    for d in done[1:]:
        out = out.select("id", "part", "v", "node").unionByName(d.select("id", "part", "v", "node"))
    return out.select("id", "part", "v", "node"), levels


def block_pairs(levels: list[DataFrame], angle: float) -> DataFrame:
    """(a, b): pairs of blocks, a <= b, that can hold rows at most `angle` apart."""
    pairs = levels[0].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for cells in levels[1:]:
        one = cells.select(F.col("parent").alias("a"), F.col("node").alias("x"), F.col("pivot").alias("px"), F.col("radius").alias("rx"))
        two = cells.select(F.col("parent").alias("b"), F.col("node").alias("y"), F.col("pivot").alias("py"), F.col("radius").alias("ry"))
        dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        cos = dot(F.col("px"), F.col("py")) / F.sqrt(dot(F.col("px"), F.col("px")) * dot(F.col("py"), F.col("py")))
        apart = F.acos(F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0)))
        near = (F.col("x") == F.col("y")) | F.coalesce(apart <= F.col("rx") + F.col("ry") + angle + SLACK, F.lit(True))
        met = pairs.join(one, "a").join(two, "b").where(near & ((F.col("a") != F.col("b")) | (F.col("x") <= F.col("y"))))
        pairs = stash(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "block-pairs")
    return pairs


def near_pairs(vectors: DataFrame, key: str, part: str, vector: str, epsilon: float, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(part, a, b, distance), a < b: pairs of one part (null is one too) at most `epsilon` apart by 1 - cosine.

    Rows without a key or a direction (null, empty or zero vector) and vectors of different lengths are near nothing. Repeated keys make
    no pair with themselves. An empty table gives no rows; other columns are ignored.
    """
    rows, levels = blocks(sound(vectors, key, part, vector), block, fan)
    angle = float(np.arccos(np.clip(1 - epsilon, -1, 1)))
    pairs = block_pairs(levels, angle)
    kinds = dict(rows.dtypes)

    def product(t: pa.Table) -> pa.Table:
        side, v = t.column("side").to_numpy(), t.column("v")
        m = _matrix(v)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = not len(right)
        found: tuple[list, list, list] = ([], [], [])
        for at in range(0, len(left), 512):
            rows_ = left[at : at + 512]
            d = 1 - m[rows_] @ m[left if alone else right].T
            i, j = np.nonzero(d <= epsilon)
            if alone:
                i, j = i[i + at < j], j[i + at < j]
            for out, x in zip(found, (rows_[i], (left if alone else right)[j], d[i, j]), strict=True):
                out.append(x)
        i, j, d = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        ids = t.column("id").combine_chunks()
        a, b = ids.take(pa.array(i, pa.int64())), ids.take(pa.array(j, pa.int64()))
        apart, first = pc.not_equal(a, b), pc.less(a, b)
        out = pa.table({"part": t.column("part").combine_chunks().take(pa.array(i, pa.int64())), "a": pc.if_else(first, a, b), "b": pc.if_else(first, b, a), "distance": pa.array(d, pa.float64())})
        return out.filter(apart)

    sides = pairs.select("a", "b", F.col("a").alias("node"), F.lit(0).alias("side")).unionByName(pairs.where("a <> b").select("a", "b", F.col("b").alias("node"), F.lit(1).alias("side")))
    return sides.join(rows, "node").select("a", "b", "side", "id", "part", "v").groupBy("a", "b").applyInArrow(product, f"part {kinds['part']}, a {kinds['id']}, b {kinds['id']}, distance double")


def _sparse(m: np.ndarray, at: dict[int, np.ndarray], pairs: list[tuple[int, int]], epsilon: float, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) of unit rows `m` that stand for all pairs at most epsilon apart of the pairs of blocks `pairs`, whose rows are in `at`.

    A row with `enough` links here keeps the first of them, and all such rows that are linked a spanning forest; other rows keep all their links.
    """

    def near() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for a, b in pairs:
            for begin in range(0, len(at[a]), 256):
                left, right = at[a][begin : begin + 256], at[b]
                hit = 1 - m[left] @ m[right].T <= epsilon
                if a == b:
                    hit &= left[:, None] < right[None, :]
                yield left, right, hit

    degree = np.zeros(len(m), np.int64)
    i_, j_ = [], []
    for left, right, hit in near():
        # Rows that haven't enough so far keep what they get here, up to that.
        for rows, others, h, place in ((left, right, hit, degree[left]), (right, left, hit.T, degree[right])):
            open_ = np.flatnonzero((place < enough) & h.any(axis=1))
            x, y = np.nonzero(h[open_])
            nth = np.arange(len(x)) - np.searchsorted(x, x)
            kept = place[open_][x] + nth < enough
            i_.append(rows[open_[x[kept]]])
            j_.append(others[y[kept]])
        degree[left] += hit.sum(axis=1)
        degree[right] += hit.sum(axis=0)
    core = degree >= enough
    label, parent = np.arange(len(m)), list(range(len(m)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for left, right, hit in near():
        x, y = np.nonzero(hit & core[left][:, None] & core[right][None, :] & (label[left][:, None] != label[right][None, :]))
        if not len(x):
            continue
        _, first = np.unique(label[left[x]] * len(m) + label[right[y]], return_index=True)
        for k in first.tolist():
            u, v = int(left[x[k]]), int(right[y[k]])
            ru, rv = root(u), root(v)
            if ru != rv:
                parent[max(ru, rv)] = min(ru, rv)
                i_.append(np.array([u]))
                j_.append(np.array([v]))
        while True:  # all labels are roots again
            up = np.asarray(parent)[label]
            if (up == label).all():
                break
            label = up
    return np.concatenate([np.zeros(0, np.int64), *i_]), np.concatenate([np.zeros(0, np.int64), *j_])


def near_links(vectors: DataFrame, key: str, part: str, vector: str, epsilon: float, min_size: int, block: int = BLOCK, fan: int = FAN, side: int = SIDE) -> DataFrame:
    """(a, b), a < b: those of near_pairs() from which density clusters of `min_size` follow: no more than some min_size a row of each task.

    A row with min_size - 1 links in a task is a core, so a few of its links show that, and linked cores of a task need a spanning forest only. A row that
    isn't a core has too few links in every task and keeps them all. Blocks meet by groups of up to `side`, each sent once a task.
    """
    rows, levels = blocks(sound(vectors, key, part, vector), block, fan)
    rows = stash(rows, "leaves")
    pairs = block_pairs(levels, float(np.arccos(np.clip(1 - epsilon, -1, 1))))
    leaves = rows.groupBy("node").agg(F.first(F.xxhash64("part", F.size("v"))).alias("top"), F.first(F.size("v")).alias("dim"))
    leaves = stash(leaves, "leaf-nodes")
    some = F.greatest(F.lit(1), F.least(F.lit(side), F.floor(F.lit(NUMBERS) / (block * F.col("dim")))))
    tops = leaves.groupBy("top").agg(F.ceil(F.count("*") / F.max(some)).alias("groups"))
    of = leaves.join(tops, "top").select("node", F.xxhash64("top", F.pmod(F.xxhash64("node"), F.col("groups"))).alias("g"))
    keyed = pairs.join(of.select(F.col("node").alias("a"), F.col("g").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("g").alias("y")), "b")
    keyed = stash(keyed.select(F.xxhash64(F.least("x", "y"), F.greatest("x", "y")).alias("key"), "a", "b"), "block-keys")
    sent = keyed.select(F.col("key").alias("to"), F.explode(F.array("a", "b")).alias("node")).distinct().join(rows, "node").select("to", "node", "id", "v")
    kind = dict(rows.dtypes)["id"]

    def links(pairs: pa.Table, members: pa.Table) -> pa.Table:
        ids = members.column("id").combine_chunks()
        i = j = np.zeros(0, np.int64)
        if pairs.num_rows and members.num_rows:
            node, size = members.column("node").to_numpy(), pc.list_value_length(members.column("v")).to_numpy()
            at = {int(x): np.flatnonzero(node == x) for x in np.unique(node)}
            met = [(a, b) for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True) if a in at and b in at]
            # Rows of one number would count as several neighbours: where a task holds some, all pairs are kept.
            enough = max(min_size - 1, 1) if pc.count_distinct(ids).as_py() == len(ids) else len(ids)
            for n in np.unique(size):  # vectors of a key are of one length, but for a chance meeting of keys
                own = np.flatnonzero(size == n)
                place = np.full(len(ids), -1)
                place[own] = np.arange(len(own))
                here = {x: place[r] for x, r in at.items() if (place[r] >= 0).all()}
                u, v = _sparse(_matrix(members.column("v").take(pa.array(own))), here, [p for p in met if p[0] in here and p[1] in here], epsilon, enough)
                i, j = np.concatenate([i, own[u]]), np.concatenate([j, own[v]])
        a, b = ids.take(pa.array(i, pa.int64())), ids.take(pa.array(j, pa.int64()))
        first = pc.less(a, b)
        return pa.table({"a": pc.if_else(first, a, b), "b": pc.if_else(first, b, a)}).filter(pc.not_equal(a, b))

    return keyed.groupBy("key").cogroup(sent.groupBy("to")).applyInArrow(links, f"a {kind}, b {kind}").distinct()
