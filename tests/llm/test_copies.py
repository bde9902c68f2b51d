"""Substring and near-duplicate removal against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from conftest import DOCS, HARD, docs, prose

from memlake.llm import simhash, substrings


def brute_removed(rows, window):
    """doc_id to the kept words, for rows of distinct ids."""
    words = {i: (t or "").encode().split() for i, t in rows}
    starts = {}
    for i, w in words.items():
        for p in range(len(w) - window + 1):
            starts.setdefault(tuple(w[p : p + window]), []).append(i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if min(starts[tuple(w[p : p + window])]) < i:
                gone |= set(range(p, p + window))
        out[i] = [x for p, x in enumerate(w) if p not in gone]
    return out


def test_cover():
    n, c = substrings.PERIOD, substrings.COVER
    assert all(any((i + s) % n in c and (j + s) % n in c for s in range(n)) for i in range(n) for j in range(n))


def _mosaic(seed, n_docs=40):
    rng = random.Random(seed)
    blocks = [prose(rng.choice([20, 49, 50, 51, 70, 120]), 100 + i, 5000) for i in range(8)]
    rows = []
    for i in range(n_docs):
        parts = [rng.choice(blocks) if rng.random() < 0.6 else prose(rng.randrange(1, 60), 1000 * seed + 7 * i + k, 5000) for k in range(rng.randrange(0, 5))]
        rows.append((i * 3, " ".join(parts)))
    rows += [(500, "z " * 200), (501, "z " * 120), (502, rows[5][1]), (503, rows[5][1]), (504, None), (505, "")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_is_brute_force(spark, seed):
    rows = _mosaic(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_removed(rows, substrings.WINDOW)
    got = {r["doc_id"]: r for r in substrings.remove_repeats(df, with_text=True).collect()}
    for i, kept in want.items():
        assert got[i]["kept_text"].encode().split() == kept, i
        assert got[i]["n_removed"] == got[i]["n_words"] - len(kept)
    assert sum(r["n_removed"] for r in got.values()) > 100


def plain_fingerprint(text):
    w = [x for x in (text or "").encode().lower().split()]
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints(spark):
    for t in (None, "", "a", "a b", "A b C d", prose(300, 4), "ä ß 日本 😀"):
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    s = "One two three"
    assert simhash.fingerprint(s) == spark.sql("SELECT xxhash64('one two three')").first()[0] % (1 << 64)


def _codes(seed, n=400):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 8)]
    out = set(base)
    for b in base:
        for _ in range(7):
            out.add(b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 6))))
    return np.array(sorted(x % (1 << 64) for x in out), dtype=np.uint64)


def test_index_is_brute_force():
    codes = _codes(3)
    index = simhash.GrayIndex(codes)
    q, m = index.near(codes)
    got = {(int(codes[a]), int(index.codes[b])) for a, b in zip(q, m, strict=True)}
    want = {(int(a), int(b)) for a in codes for b in codes if int(np.bitwise_count(a ^ b)) <= 3}
    assert got == want and all(len(simhash.GrayIndex(codes[:k]).near(codes[:k])[0]) >= k for k in (1, 2, 8, 9, 65))
    ranks = simhash.gray_rank(np.arange(1 << 10, dtype=np.uint64) ^ (np.arange(1 << 10, dtype=np.uint64) >> np.uint64(1)))
    assert ranks.tolist() == list(range(1 << 10))


def brute_components(fps):
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if bin(a ^ b).count("1") <= 3:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {x: find(x) for x in fps}


@pytest.mark.parametrize("group", [4096, 4])
def test_links_lose_nothing(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)  # 4: nearly every group is dealt on
    codes = _codes(9, 160)
    df = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")
    edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(df).collect()]
    want = brute_components({int(x) for x in codes})
    root = {x: x for x in want}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        assert bin(a ^ b).count("1") <= 3 or want[a] == want[b]
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    assert {x: find(x) for x in want} == want


def test_hard_rows_and_components(spark, make):
    d = make(documents=HARD, extra=True)
    got = simhash.query(spark, d).collect()
    assert len(got) == len(HARD)
    text = {i: t for i, t, *_ in HARD}
    comp = brute_components({plain_fingerprint(t) for _, t, *_ in HARD})
    low = {}
    for i, t, *_ in HARD:
        if i is not None:
            c = comp[plain_fingerprint(t)]
            low[c] = min(low.get(c, i), i)
    for r in got:
        t = text[r["doc_id"]]
        assert r["fingerprint"] == f"{plain_fingerprint(t):016x}" and r["component_id"] == low.get(comp[plain_fingerprint(t)])
    df = spark.read.parquet(f"{d}/documents.parquet")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    want = sorted([(False, i) for i in set(low.values())] + ([(True, 0)] if comp[plain_fingerprint(text[None])] not in low else []))
    assert ids == want


def test_near_copies_join(spark):
    a = prose(400, 8, 3000).split()
    b = list(a)
    b[200] = "other"
    df = spark.createDataFrame(docs(" ".join(a), " ".join(a), " ".join(b), prose(400, 9, 3000)), DOCS)
    assert [r["component_id"] for r in simhash.cluster(df).orderBy("doc_id").collect()] == [0, 0, 0, 3]
