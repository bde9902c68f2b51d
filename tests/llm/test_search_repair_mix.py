"""Lexical search, conversation repair and source mixing: against SQL, plain loops and every possible edit."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from compare import rows, same
from conftest import HARD, prose
from pyspark.sql import functions as F

from memlake.llm import catalog, mixing, ranking, repair

ITEMS = [(1, "w1 w2 W3 w3-w9 x"), (1, "w1 w2 W3 w3-w9 x"), (2, None), (3, ""), (4, "nowhere-found"), (5, "ä ß 日本 a b"), (None, prose(300, 9)), (6, "same"), (6, "LINE line")]
TURNS = [
    (1, 0, "user", "Hi there."), (1, 1, "assistant", "Hello."), (1, 1, "assistant", "Hello."), (1, 2, "user", "cut off"), (1, 3, "assistant", "Done!"), (2, None, None, None), (2, None, "user", "a b?"), (2, 5, "", "."),
    (2, 5, "user", ""), (None, 1, "system", "s."), (None, 2, "system", "t."), (None, None, "user", "u."), (3, 0, "assistant", prose(20000, 4) + "."), (3, 1, "Über", "ü."), (4, -7, "unknown", "x! \t"), (4, 9, "user", " \x0b"), (5, 0, "system", "only."),
]


def plain_search(docs, items, k=20):
    term = re.compile(ranking.TERM)
    terms_of = lambda t: term.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    kept = [(d, Counter(t), len(t)) for d, t in ((d, terms_of(x)) for d, x in docs) if t]
    n_docs, total = len(kept), sum(n for *_, n in kept)
    df = Counter(w for _, c, _ in kept for w in c)
    wanted: dict = {}
    for i, t in sorted(set(items), key=repr):
        wanted.setdefault(i, Counter()).update(terms_of(t))
    out = []
    for i, c in wanted.items():
        scores = []
        for d, have, n in kept:
            m = 75 + 25 * n * n_docs // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * have[w] // (1000 * have[w] + 12 * m)) for w, q in c.items() if w in have)
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        out += [(i, r + 1, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def test_search_hard_rows(spark, make):
    d = make(documents=HARD, benchmark=ITEMS, extra=True)
    got = ranking.query(spark, d)
    same(got, d, ranking.SQL)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search([x[:2] for x in HARD], ITEMS)


def test_search_in_blocks(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(f"t{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.randrange(40)))) for i in range(400)] + [(i, "t1 t2 t3") for i in range(400, 700)]
    items = [(i, " ".join(f"T{rng.randrange(80)}" for _ in range(12))) for i in range(30)]
    dd, ii = spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string")
    want = plain_search(docs, items, 5)
    for size in (ranking.ITEM_BYTES, 700):  # one block of items, and several
        assert sorted((tuple(r) for r in ranking.search(dd, ii, 5, size).collect()), key=repr) == want


def test_small_blocks_and_wide_numbers(monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_COUNTS", 3)
    lists = pa.array([[1, 2], [], [3], [1, 2, 3, 4, 5], [1]], pa.list_(pa.int32()))
    b = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(range(5)), lists], names=["doc", "n", "at"])
    parts = list(ranking._blocks(b))
    assert len(parts) > 2 and pa.Table.from_batches(parts).column("doc").to_pylist() == [0, 1, 2, 3, 4]
    n, w, tf = np.array([10**9, 3]), np.array([5, 7]), np.array([2, 1])
    got = ranking.impacts(w, tf, n, 10**9, 10**12)
    assert got.tolist() == [int(a) * (10**9 * int(t) // (1000 * int(t) + 12 * (75 + 25 * int(x) * 10**9 // 10**12))) for a, t, x in zip(w, tf, n, strict=True)]


def test_fold_is_the_pattern():
    text = "".join(map(chr, range(300))) + "日本 A😀b"
    want = re.findall(ranking.TERM, text.translate({c: c + 32 for c in range(65, 91)}))
    codes, words, ends = ranking.coded_words(ranking.folded(pa.array([None, text, "", text[::-1]]).slice(1, 2)))
    assert [words[int(c)].as_py() for c in codes] == want and ends.tolist() == [0, len(want), len(want)]


def plain_damage(turns):
    out: dict = {}
    for c, t, role, text in turns:
        conv = out.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        conv += [] if kind == 0 else [row, row] if kind == 3 else [row]
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def every_edit(turns):
    """(cost, audit, turns) of the cheapest ASCII-least way, by trying all with up to two inserts in a place."""
    seen, faults = set(), []
    for _, role, text in turns:
        end = text.rstrip(" \t\n\v\f\r")[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    best = (2 * len(turns), "D" * len(turns), [])  # all deleted: nothing dearer need be tried

    def fits(roles):
        return re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r in roles)) is not None

    def go(i, cost, audit, kept, inserts):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(turns) and fits([r for r, _ in kept]):
            best = min(best, (cost, audit, kept))
        if inserts < 2:
            for role in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*kept, (role, "")], inserts + 1)
        if i < len(turns):
            _, role, text = turns[i]
            go(i + 1, cost + 2, audit + "D", kept, 0)
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                go(i + 1, cost + more, audit + "K", [*kept, (role, text)], 0)
                for to in ("user", "assistant"):
                    go(i + 1, cost + 1 + more, audit + "R", [*kept, (to, text)], 0)

    go(0, 0, "", [], 0)
    count = Counter(faults)
    initials = [r[:1] for _, r, _ in turns]
    known = [t for t, *_ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest()
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, best[0], best[1], sha


def _tuples(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


def test_repair_hard_rows(spark, make):
    d = make(conversations=TURNS, extra=True)
    got = repair.query(spark, d)
    same(got, d, repair.SQL)
    assert _tuples(got) == {c: every_edit(v) for c, v in plain_damage(TURNS).items()}


def _random_turns(seed, conversations=60):
    rng, out = random.Random(seed), []
    for c in range(conversations):
        for t in range(rng.randrange(1, 7)):
            out.append((c, rng.choice([t, t, t + 1, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool"]), rng.choice(["a.", "b!", "c", "d?", "", "e. ", "long text."])))
    return out


@pytest.mark.parametrize("most", [2, 10_000])
def test_repair_is_the_best_of_all(spark, most):
    """Chunks of two turns and whole conversations give what trying all edits gives."""
    turns = _random_turns(most)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    assert _tuples(repair.repair(repair.damaged(df), most_turns=most)) == {c: every_edit(v) for c, v in plain_damage(turns).items()}


def test_long_conversation_in_chunks(spark):
    """One conversation over many chunks, with runs of equal rows, is what it is in one chunk."""
    rng = random.Random(8)
    turns = [(7, t // 3, rng.choice(["user", "assistant", "system"]), rng.choice(["x.", "y!", "z", "", f"n{rng.randrange(200)}.", f"m{rng.randrange(99)}?"])) for t in range(3000)] + [(8, 1, "user", "same.")] * 500
    df = repair.damaged(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    whole = repair.repair(df)
    assert rows(repair.repair(df, most_turns=50)) == rows(repair.repair(df, most_chars=40)) == rows(whole)
    got = _tuples(whole)[7]
    back = [(r["role"], r["text"]) for r in repair.rebuilt(df).where("conv_id = 7").orderBy("chunk", "place").collect()]
    assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in back).encode()).hexdigest() == got[7]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in back)) and sum({"K": 0, "R": 1, "D": 2, "I": 5}[x] for x in got[6]) <= got[5]


def test_mix_hard_rows(spark, make):
    d = make(documents=HARD, extra=True)
    got = mixing.query(spark, d)
    assert got.count() == len(HARD)
    same(got, d, mixing.SQL)


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - cap * sum(sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: Fraction(rest * w[s], sum(w[x] for x in open_)) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else share[s] for s in names}
        full |= over


def _mixed(seed, n=3000):
    rng = random.Random(seed)
    sources = ["z", "a", None, "B", "é", "small", "empty"]
    out = []
    for i in range(n):
        s = rng.choices(sources, [30, 8, 3, 6, 4, 1, 1])[0]
        size = 0 if s == "empty" else 40 if s == "z" and rng.random() < 0.5 else min(int(8 * rng.paretovariate(0.9)), 3000)
        out.append((i, " ".join(["w"] * size), s))
    return out + [(n, "copy of one row", "a")] * 400


def test_mix_meets_targets(spark):
    docs = _mixed(3)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(df, cell=50, cells=64).select("doc_id", F.col("source_size"), "size", "target", "taken", "copies").collect()
    assert len(got) == len(docs) and all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in got)
    sizes: dict = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = plain_targets(sizes)
    of = {i: s for i, _, s in docs}
    taken = Counter()
    for r in got:
        s = of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - float(want[s])) < 1e-6
        taken[s] += r["taken"]
    assert all(abs(taken[s] - float(t)) <= 0.02 * float(t) + 8 for s, t in want.items())
    again = mixing.mix(df.repartition(9)).select("doc_id", "size", "source_size", "target", "taken", "copies")
    assert rows(spark.createDataFrame(got)) == rows(again)  # other partitions, other histograms: the same rows


@pytest.mark.parametrize("cell, cells", [(4, 256), (50, 8192), (10_000, 8192)])
def test_first_ranked(spark, cell, cells):
    rng = random.Random(cell)
    ranked = [(i, i % 3, rng.choice([5, 5, 1 << 51, rng.randrange(1 << 52)]), rng.randrange(1 << 52)) for i in range(900)]
    need = [(0, 300, 120), (1, 300, 299), (2, 300, 1)]
    got = mixing.first_ranked(spark.createDataFrame(ranked, "uid long, stratum long, k1 long, k2 long"), spark.createDataFrame(need, "stratum long, n long, take long"), cell, cells)
    want = {u for s, _, k in need for *_, u in sorted((a, b, u) for u, x, a, b in ranked if x == s)[:k]}
    found = [r["uid"] for r in got.collect()]
    assert set(found) == want and len(found) == len(want)


def test_unequal_odds_are_kept(spark):
    """Over many draws documents of a class come as often as their tilted probability says."""
    docs = [(i, " ".join(["w"] * (100 + i % 6)), "b" if i % 4 else "a") for i in range(400)]
    tries, hits, words = 4, 0, 0
    for t in range(tries):
        got = mixing.mix(spark.createDataFrame([(i + 1000 * t, x, s) for i, x, s in docs], "doc_id long, text string, source string")).where("source_size > 20000")
        row = got.agg(F.sum((F.col("copies") > 0).cast("int")), F.sum("taken"), F.first("target")).first()
        hits, words = hits + row[0], words + row[1]
        assert abs(row[1] - row[2]) < 0.01 * row[2]
    share = row[2] / got.select("source_size").first()[0]
    assert abs(hits / tries / 300 - share) < 0.03


def test_new_queries_on_empty_tables(spark, make):
    d = make()
    for name in ("op11_lexical_search", "op12_conversation_repair", "op13_source_mixing"):
        assert catalog.queries()[name](spark, d).count() == 0
