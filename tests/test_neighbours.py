"""Neighbours of vectors, links of clusters and the greedy dedupe: against all pairs and the sequential scans."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.operators import cluster, neighbours


def _cos(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb) if len(a) == len(b) and na and nb else None


def _vectors(seed, n):
    """Rows about a few directions, some far off, copies, and rows that are near nothing."""
    rng = random.Random(seed)
    heads = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), [x + rng.gauss(0, rng.choice([0.1, 0.4, 2])) for x in rng.choice(heads)]) for i in range(n)]
    rows += [(n + i, "a", [1.0, 0.0, 0.0, 0.0, 0.0, 1.0]) for i in range(60)]
    return rows + [(n + 60, "a", [0.0] * 6), (n + 61, "a", []), (n + 62, "a", None), (None, "a", [1.0] * 6), (n + 63, "a", [1.0, 2.0]), (n + 64, "a", [2.0, 4.0])]


@pytest.mark.parametrize(("block", "fan", "epsilon"), [(1024, 32, 0.2), (16, 4, 0.05), (16, 3, 0.6)])
def test_near_pairs_are_all_pairs(spark, block, fan, epsilon):
    rows = _vectors(block + fan, 300)
    df = spark.createDataFrame(rows, "id long, part string, v array<double>").withColumn("distance", F.lit("clash")).repartition(5)
    got = {(r["a"], r["b"]): r["distance"] for r in neighbours.near_pairs(df, "id", "part", "v", epsilon, block, fan).collect()}
    want = {}
    for (i, p, u), (j, q, v) in combinations([r for r in rows if r[0] is not None and r[2]], 2):
        c = _cos(u, v)
        if p == q and c is not None and 1 - c <= epsilon:
            want[min(i, j), max(i, j)] = 1 - c
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_far_cells_never_meet(spark):
    """Tight bunches in many directions: only few pairs of blocks are left."""
    rng = random.Random(5)
    heads = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(24)]
    rows = [(i, "p", [x + rng.gauss(0, 0.02) for x in heads[i % 24]]) for i in range(1200)]
    v, levels = neighbours.blocks(neighbours.sound(spark.createDataFrame(rows, "id long, part string, v array<double>"), "id", "part", "v"), 64, 32)
    n = v.select("node").distinct().count()
    assert v.count() == 1200 and v.groupBy("node").count().agg(F.max("count")).first()[0] <= 64
    assert neighbours.block_pairs(levels, 0.2).count() < n * (n + 1) / 8
    assert neighbours.near_pairs(spark.createDataFrame([], "id long, part string, v array<double>"), "id", "part", "v", 0.2).count() == 0


@pytest.mark.parametrize(("block", "side", "epsilon", "min_size"), [(16, 4, 0.05, 3), (16, 2, 0.6, 5), (1024, 16, 0.2, 2)])
def test_near_links_give_the_clusters_of_near_pairs(spark, block, side, epsilon, min_size):
    rows = [r for r in _vectors(block + side, 300) if r[0] is not None]
    df = spark.createDataFrame(rows, "id long, part string, v array<double>").repartition(5)
    pairs = neighbours.near_pairs(df, "id", "part", "v", epsilon, block, 4).select("a", "b")
    links = neighbours.near_links(df, "id", "part", "v", epsilon, min_size, block, 4, side)
    got, want = ({(r["id"], r["cluster"], r["is_core"]) for r in cluster.dbscan(df, x, min_size).collect()} for x in (links, pairs))
    assert got == want and len({c for _, c, _ in want}) > 1
    assert links.join(pairs, ["a", "b"], "left_anti").count() == 0


def test_links_of_a_bunch_grow_with_its_rows(spark):
    """All pairs of a bunch are near: 44,850 pairs, but a few links a row show its cores and their component."""
    rng = random.Random(8)
    df = spark.createDataFrame([(i, "p", [1 + rng.random() / 9, rng.random() / 9, rng.random() / 9]) for i in range(300)], "id long, part string, vector array<double>")
    links = cluster.cluster_links(df, 0.2, 3)
    assert links.count() <= 300 * 8
    found = cluster.dbscan(df, links, 3).collect()
    assert len(found) == 300 and all(r["cluster"] == 0 and r["is_core"] for r in found)


def _texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(18)]
    return [(i, " ".join(rng.sample(words, 4)), " ".join(rng.sample(words, rng.choice([3, 6, 9])))) for i in range(n)]


def _sets(title, body):
    split = lambda t: {x for x in t.lower().replace("\n", " ").split() if len(x) > 1}
    return split(title), split(body), split(title) | split(body)


def _alike(x, y, limits):
    t, b, w = (len(a & c) / len(a | c) if a and c else 0 for a, c in zip(x, y, strict=True))
    return t >= limits["title"] and (b >= limits["body"] or w >= limits["text_with_title"]) or w >= limits["text"]


def test_links_give_the_clusters_of_all_pairs(spark):
    """Distance, words and lineage together; copies and hot lineage numbers among them."""
    rng = random.Random(6)
    texts, rows = _texts(6, 90), []
    for i, title, body in texts:
        rows.append((i, rng.choice("ab"), [rng.gauss(0, 1) for _ in range(3)], title, body, rng.sample(range(300), 1) + ([7] if i % 9 == 0 else [])))
    rows += [(100 + i, *rows[3][1:]) for i in range(12)] + [(200, "a", [0.0] * 3, *rows[4][3:])]
    df = spark.createDataFrame(rows, "id long, part string, vector array<double>, title string, body string, lin array<long>")
    df = df.select("id", "part", "vector", *[tx.similarity_tokens(x).alias(a) for x, a in ((F.col("title"), "tt"), (F.col("body"), "tb"), (F.concat_ws("\n", "title", "body"), "tx"))], "lin")
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in cluster.dbscan(df, cluster.cluster_links(df, 0.02, 3, cluster.ALIKE), 3).collect()}
    pairs = []
    for x, y in combinations(rows, 2):
        c = _cos(x[2], y[2])
        if x[1] == y[1] and c is not None and (1 - c <= 0.02 or set(x[5]) & set(y[5]) or _alike(_sets(*x[3:5]), _sets(*y[3:5]), cluster.ALIKE)):
            pairs.append((x[0], y[0]))
    want = {r["id"]: (r["cluster"], r["is_core"]) for r in cluster.dbscan(df, spark.createDataFrame(pairs, "a long, b long"), 3).collect()}
    assert got == want and len(set(want.values())) > 2


def _scan(rows, limits):
    """The sequential scan over all pairs of each group."""
    info = {i: 8 * len(_sets(t, b)[2]) + len(b) for i, _, _, t, b in rows}
    gone, out = set(), []
    for i, s, p, t, b in sorted(rows):
        if i in gone:
            continue
        for j, s2, p2, t2, b2 in sorted(rows):
            if j <= i or (s, p) != (s2, p2) or j in gone or not _alike(_sets(t, b), _sets(t2, b2), limits):
                continue
            loser, winner = (j, i) if info[j] <= info[i] else (i, j)
            gone.add(loser)
            out.append((loser, winner))
            if loser == i:
                break
    return sorted(out)


def test_greedy_rounds_are_the_scan(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["global", "project"]), rng.choice(["p", None]), t, b) for i, t, b in _texts(2, 160)]
    rows += [(1000 + i, "project", "copies", "one title here", "all the same body text") for i in range(80)]
    rows += [(2000 + i, "project", "chain", " ".join(f"c{k}" for k in range(i, i + 12)), "") for i in range(14)]  # each like the next ones only
    df = spark.createDataFrame(rows, "id long, scope string, project_id string, title string, body string").repartition(4)
    limits = {"title": 0.5, "body": 0.3, "text_with_title": 0.4, "text": 0.72}
    got = sorted((r["id"], r["kept_id"]) for r in cluster.greedy_losers(df, limits).collect())
    want = _scan(rows, limits)
    assert got == want and len(want) > 100
    assert cluster.greedy_losers(df.where("id < 0"), limits).count() == 0
