"""Pairs of memories alike in words, exact copies among them, against brute force."""

import random
from itertools import combinations

from memlake.operators import cluster


def test_copies_are_members(spark):
    rng, rows = random.Random(4), []
    for i in range(12):
        base = [f"w{rng.randrange(200)}" for _ in range(12)]
        for k in range(4):
            rows.append((10 * i + k, "en" if i % 3 else "de", sorted(set(base[: 12 - k // 2]))))
    rows += [(500, "en", rows[5][2]), (501, "de", []), (502, "de", [])]
    df = spark.createDataFrame(rows, "id long, lang string, t array<string>").repartition(3)
    got = {(r["a"], r["b"]): r["jaccard"] for r in cluster.jaccard_pairs(df, "id", "lang", "t", 0.72).collect()}
    rep = {}
    for i, lang, t in sorted(rows):
        if t:
            rep.setdefault((lang, tuple(t)), i)
    want = {(rep[lang, tuple(t)], i): 1.0 for i, lang, t in rows if t and rep[lang, tuple(t)] != i}
    assert len(want) > 20
    for ((la, ta), a), ((lb, tb), b) in combinations(rep.items(), 2):
        j = len(set(ta) & set(tb)) / len(set(ta) | set(tb))
        if la == lb and j >= 0.72:
            want[min(a, b), max(a, b)] = j
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
