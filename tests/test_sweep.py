"""Pairs of sets that meet inside tasks: none that overlaps enough is lost in any dealing of blocks, and few others are written."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.operators import cluster, sweep, wordsets


def _rows(n):
    rng, rows = random.Random(7), []
    for i in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([20, 60]))] + ["everywhere", f"half{i % 2}"]
        rows.append((3 * i, "en" if i % 4 else "de", base))
        if i % 5 == 0:
            rows.append((3 * i + 1, "en", [*base[4:], "other"]))
    return [*rows, (9000, None, rows[0][2]), (9001, "en", ["everywhere"]), (9002, "en", ["everywhere", "alone"])]


def test_candidates_are_few_and_whole(spark):
    rows = _rows(150)
    df = spark.createDataFrame(rows, "id long, part string, t array<string>").select("id", "part", cluster._hashed(F.col("t")).alias("t"))
    sets = {i: (p, set(t)) for i, p, t in rows}
    share = lambda a, b: len(a & b) / len(a | b)
    want = {}
    for a, b in combinations(sorted(sets), 2):
        if sets[a][0] == sets[b][0] and sets[a][0] is not None and share(sets[a][1], sets[b][1]) >= 0.5:
            want[a, b] = share(sets[a][1], sets[b][1])
    assert len(want) > 15
    for block in (4, 4096):
        met = sweep.met_pairs(sweep.prefix_rows(df, "t", 0.5, 8, block=block), 0.5, sweep.overlap_fits(0.5))
        got = {tuple(r) for r in met.collect()}
        assert want.keys() <= got and len(got) <= 2 * len(want)  # hundreds of sets share a first token
        found = sweep.overlaps(met, df, ("t",), block=block).select("a", "b", sweep.overlap("t").alias("j")).where("j >= 0.5").collect()
        assert {(r["a"], r["b"]): r["j"] for r in found} == want


def test_common_titles_write_no_pairs(spark, monkeypatch):
    rng, rows = random.Random(3), []
    for i in range(200):
        body = [f"b{rng.randrange(9000)}" for _ in range(60)]
        rows.append((2 * i, "p", ["weekly", "status", "report"], body))
        if i < 10:
            rows.append((2 * i + 1, "p", ["weekly", "status", "report"], [*body[:50], *(f"c{k}" for k in range(5))]))
    sets = cluster._word_sets(spark.createDataFrame(rows, "id long, part string, tt array<string>, tb array<string>"))
    seen, whole = [], cluster.overlaps
    monkeypatch.setattr(cluster, "overlaps", lambda met, *rest: seen.append(met.count()) or whole(met, *rest))
    got = {tuple(r) for r in cluster.alike_pairs(sets, cluster.ALIKE).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(10)} and seen[0] <= 40


def test_a_common_word_in_few_prefixes_is_dealt_by_these(spark):
    rows = [(i, "p", ["everywhere", *(f"w{i}-{k}" for k in range(9))]) for i in range(300)] + [(900, "p", ["everywhere"]), (901, "p", ["everywhere"])]
    df = spark.createDataFrame(rows, "id long, part string, t array<string>").select("id", "part", cluster._hashed(F.col("t")).alias("t"))
    keyed = sweep.prefix_rows(df, "t", 0.9, 8, block=4)
    assert keyed.where("id >= 900").count() == 2  # 302 sets hold the word, in 76 blocks of 4
    assert [tuple(r) for r in sweep.met_pairs(keyed, 0.9, sweep.overlap_fits(0.9), sketched=True).collect()] == [(900, 901)]


def test_tiles_keep_all_that_may_overlap():
    rng = np.random.default_rng(5)
    n = np.sort(rng.integers(1, 90, 300)).astype(np.int32)
    of, pool = np.repeat(np.arange(300), n), rng.integers(0, 1 << 63, 400).astype(np.uint64)
    for words in (1, 2, 8, 16):
        s = sweep.sketch(rng.choice(pool, len(of)), of, 300, words)
        s[100:200] = s[rng.integers(100, 300, 100)]
        s[100:200, 0] ^= rng.integers(0, 4, 100).astype(np.uint64)
        stop = np.searchsorted(n, np.floor(n / 0.72 + 1e-6), side="right")
        got = [p for i, j in sweep._by_tiles(s, n, stop, 0.72) for p in zip(i.tolist(), j.tolist(), strict=True)]
        want = {(i, j) for i in range(300) for j in range(i + 1, stop[i]) if np.bitwise_count(s[i] ^ s[j]).sum() <= sweep.allowed(n[i] + n[j], 0.72)}
        assert len(got) == len(set(got)) and want <= set(got) and len(want) > 20
        i, j = np.array(got).T
        assert (sweep.differ(s, i, j) == np.bitwise_count(s[i] ^ s[j]).sum(axis=1)).all()


def test_long_runs_give_all_pairs(spark):
    """Hundreds of sets under one rare word, most of them unlike."""
    rng, rows = random.Random(9), []
    for i in range(240):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 30]))] if i % 6 else rows[-1][2][2:] if rows else ["x", "y", "z"]
        rows.append((i, "p", ["shared", *base]))
    df = spark.createDataFrame(rows, "id long, part string, t array<string>").select("id", "part", cluster._hashed(F.col("t")).alias("t"))
    want = {(a, b) for (a, _, s), (b, _, t) in combinations(rows, 2) if len(set(s) & set(t)) >= 0.5 * len(set(s) | set(t))}
    for block in (64, 4096):
        met = sweep.met_pairs(sweep.prefix_rows(df, "t", 0.5, 8, block=block), 0.5, sweep.overlap_fits(0.5), sketched=True)
        got = {tuple(r) for r in met.collect()}
        assert want <= got and 20 < len(want) and len(got) <= 2 * len(want) + 20


def test_word_sets_are_those_of_similarity_tokens(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB09 é_\n-z") for _ in range(rng.choice([1, 2, 5, 40, 300]))) for _ in range(400)]
    texts += [None, "", "the", "The AND x", "a" * 70 + " " + "A" * 70 + " " + "a" * 71, "KK ab", "ab", "AB"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3).withColumn("w", tx.similarity_tokens(F.col("t")))
    got = wordsets.word_sets(df, ("t",), "test").collect()
    name = {w: None for r in got for w in r["w"]}
    for r in got:  # each word has one hash everywhere, and no two share one
        assert len(r["t"]) == len(set(r["t"])) == len(r["w"]) and r["t"] == sorted(r["t"])
    one = wordsets.word_sets(spark.createDataFrame([(w, w) for w in name], "w string, t string"), ("t",), "test").collect()
    name = {r["w"]: r["t"][0] for r in one}
    assert len(set(name.values())) == len(name) > 500 and all({name[w] for w in r["w"]} == set(r["t"]) for r in got)


def test_large_sets_bring_finer_sketches(spark):
    """Sets of far more members than a sketch has bits: unlike ones aren't written, none that overlaps enough is lost."""
    rng, rows = np.random.default_rng(2), []
    for i in range(40):
        n = int(rng.integers(600, 2500))
        rows.append((2 * i, "p", np.r_[-1, rng.choice(30_000, n, replace=False)].tolist()))
        if i % 8 == 0:
            rows.append((2 * i + 1, "p", rows[-1][2][: int(n * 0.9)] + list(range(40_000, 40_000 + n // 20))))
    df = spark.createDataFrame(rows, "id long, part string, t array<long>").select("id", "part", cluster._hashed(F.col("t")).alias("t"))
    want = {(a, b) for (a, _, s), (b, _, t) in combinations(rows, 2) if len(set(s) & set(t)) >= 0.72 * len(set(s) | set(t))}
    met = sweep.met_pairs(sweep.prefix_rows(df, "t", 0.72, 8, fine=True), 0.72, sweep.overlap_fits(0.72), sketched=True)
    assert {tuple(r) for r in met.collect()} == want and len(want) == 5
    assert {(r["a"], r["b"]) for r in cluster.jaccard_pairs(df, "id", "part", "t", 0.72).collect()} == want
