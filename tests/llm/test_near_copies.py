"""Near-copies of the pipeline against brute force over 5-word shingles."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from conftest import DOCS, prose

from memlake.llm import nearcopies, simhash


def brute_kept(rows):
    """Numbers of the rows (doc_id, text) that stay."""
    words = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    best = {}
    for i, (d, _) in enumerate(rows):
        c = find(i)
        best[c] = min(best.get(c, (True, 0, 0)), (d is None, d or 0, i)) if c in best else (d is None, d or 0, i)
    return {i for *_, i in best.values()}


def _mosaic(seed, n):
    rng, rows = random.Random(seed), []
    passage = prose(40, 77, 5000)
    for i in range(n):
        w = prose(rng.choice([3, 30, 60, 120, 300]), 1000 * seed + i, 5000).split()
        rows.append(" ".join(w) if i % 5 else f"{passage} {' '.join(w[:12])}")
        for _ in range(rng.randrange(0, 5)):
            v = list(w)
            for _ in range(rng.randrange(0, 2 + len(w) // 25)):
                v[rng.randrange(len(v))] = f"new{rng.randrange(10**6)}"
            rows.append(" ".join(v))
    rng.shuffle(rows)
    return [*rows, "", None, "  "]


@pytest.mark.parametrize(("pairs", "block"), [(4, 4096), (0, 4096), (4, 3)])
def test_is_brute_force(spark, monkeypatch, pairs, block):
    monkeypatch.setattr(nearcopies, "PAIRS", pairs)  # 0: hubs come first
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    rows = list(enumerate(_mosaic(3, 60)))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(4)
    want = brute_kept(rows)
    assert {r["doc_id"] for r in simhash.keep_one(df).collect()} == want and len(want) < len(rows) - 40


def test_pairs_of_a_frequent_shingle_meet_once_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", 16)
    rng = random.Random(5)
    rows = [(w, 1000 * w + i, rng.choice([5, 8, 10, 99, 100, 124, 125, 1000]), 0, 9, i) for w, size in ((1, 200), (2, 17), (3, 2)) for i in range(size)]
    first = spark.createDataFrame(rows, "w long, cid long, n long, i long, rest long, root long")
    named = spark.createDataFrame([(1000 + i, 1000) for i in range(50)], "cid long, root long")
    left, total, pairs = nearcopies._apart(first.drop("root"), named, 1)
    assert total == len(rows) and pairs == 200 * 199 // 2 - 50 * 49 // 2 + 17 * 16 // 2 + 1 and left.count() == total
    side = nearcopies._side(left, 1, "")
    assert max(r["count"] for r in side.groupBy("w", "band", "low", "high").count().collect()) <= 4 * 16
    met = nearcopies._met(left).where(nearcopies._sizes_fit(nearcopies.F.col("n"), nearcopies.F.col("n2"))).select("cid", "cid2").collect()
    want = {frozenset((a[1], b[1])) for a, b in combinations(rows, 2) if a[0] == b[0] and 100 * min(a[2], b[2]) >= 80 * max(a[2], b[2])}
    assert len(met) == len(want) and {frozenset(r) for r in met} == want


def test_later_rounds_go_on_with_the_rows_left(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "PAIRS", 0)
    rooted, parted, made, left = nearcopies._rooted, nearcopies._parted, [], []

    def counted(first, *named):
        made.append(sum(len(r["first"]) for r in first.select("first").collect()))
        return rooted(first, *named)

    def told(own):
        left.append(parted(own)[1])
        return parted(own)

    monkeypatch.setattr(nearcopies, "_rooted", counted)
    monkeypatch.setattr(nearcopies, "_parted", told)
    rows = list(enumerate(_mosaic(3, 60)))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(4)
    assert {r["doc_id"] for r in simhash.keep_one(df).collect()} == brute_kept(rows)
    assert len(made) > 1 and made[1:] == left[:-1] and made[1] < made[0]


@pytest.mark.parametrize("step", [1, 2, 3, 7, 100])
def test_runs_are_whole_whatever_the_batches(step):
    w = np.array([1, 1, 1, 1, 2, 3, 3, 3, 3, 3, 4, 9, 9], np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(w[i : i + step]), pa.array(np.arange(len(w))[i : i + step])], names=["w", "c"]) for i in range(0, len(w), step)]
    calls = []
    list(nearcopies._runs(lambda w, c: calls.append((w.tolist(), c.tolist())), 2)(iter([batches[0].slice(0, 0), *batches])))
    assert sum((x for x, _ in calls), []) == w.tolist() and sum((y for _, y in calls), []) == list(range(len(w)))
    seen = [set(x) for x, _ in calls]
    assert all(not a & b for a, b in combinations(seen, 2))


def test_prefix_is_wide_enough():
    for n in range(1, 300):
        least = -(-8 * n // 10)
        assert nearcopies.prefix_size(n) > n - least
