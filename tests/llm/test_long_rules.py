"""Mined URL rules of any length; the limits of hosts."""

import math
import random
import time
from itertools import combinations, product

import pytest
from compare import same
from conftest import prose

from memlake.llm import quality, urls


def _three_tokens():
    """Only the three tokens together are bad: each pair is bad in half of its pages."""
    rows = []
    for i in range(400):
        a, b, c = (i >> s & 1 for s in range(3))
        rows.append((i, f"http://{'sub' if a else 'www'}.{'host' if b else 'other'}.org/{'xx' if c else 'en'}/{i}", int(a and b and c)))
    return rows


def test_rule_of_three_tokens(spark, make):
    rows = _three_tokens()
    d = make(pages=[(i, u, "") for i, u, _ in rows], labels=[(i, 1, bad) for i, _, bad in rows])
    got = {r["page_id"]: r["verdict"] for r in urls.query(spark, d).collect()}
    assert {i for i, v in got.items() if v == "block"} == {i for i, _, bad in rows if bad}


def test_no_rule_holds_another(spark):
    rows = [([f"h={x}" for x in "abcde"[:n]] + [f"p={m}"], m == "bad") for n, m in product(range(1, 6), ("bad", "good")) for _ in range(20)]
    rows += [(["h=q", "h=r", "h=s"], True)] * 20 + [(["h=q", "h=r"], False)] * 20 + [(["h=q", "h=s"], False)] * 20 + [(["h=r", "h=s"], False)] * 20
    got = [frozenset(r["need"]) for r in urls.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()]
    assert set(got) == {frozenset({"p=bad"}), frozenset({"h=q", "h=r", "h=s"})} and len(got) == 2


def _hosts(spark, make, share):
    """20 hosts of 40 documents, of which one in 20 is too short; at the first host, `share` of 20 are."""
    rows = []
    for h in range(20):
        for i in range(40):
            short = i % 20 < (share if h == 0 else 1)
            rows.append((len(rows), "too short" if short else prose(60, 41 * h + i, 3000), "en", f"host{h}", 1))
    return make(documents=rows)


@pytest.mark.parametrize(("share", "falls"), [(1, False), (3, False), (10, True), (20, True)])
def test_host_limit_follows_the_hosts(spark, make, share, falls):
    d = _hosts(spark, make, share)
    df = spark.read.parquet(f"{d}/documents.parquet")
    got = {r["source"]: r["host_rejected"] for r in quality.host_verdicts(quality.features(df)).collect()}
    assert got == {f"host{h}": falls and h == 0 for h in range(20)}
    kept = {r["doc_id"] for r in quality.keep(df).collect()}
    assert kept == {r["doc_id"] for r in quality.query(spark, d).where("kept").collect()} and len(kept) == (19 * 38 if falls else 19 * 38 + 40 - 2 * share)
    same(quality.query(spark, d), d, quality.SQL)


def _brute_rules(rows, support, confidence):
    """Smallest token sets by support and confidence, all sets counted."""
    n, found = len(rows), {}
    tokens = sorted({t for ts, _ in rows for t in ts})
    for size in range(1, len(tokens) + 1):
        for need in map(frozenset, combinations(tokens, size)):
            if any(f < need for f in found):
                continue
            has = [bad for ts, bad in rows if need <= set(ts)]
            if has and sum(has) >= math.ceil(support * n) and sum(has) and sum(has) / len(has) >= confidence:
                found[need] = round(sum(has) / len(has), 9)
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("open_tokens", [14, 3])
def test_mining_is_brute_force(spark, monkeypatch, seed, open_tokens):
    rng = random.Random(seed)
    rows = []
    for _ in range(240):
        ts = [f"h={x}" for x in "abcdef" if rng.random() < 0.5]
        ts += [f"{t}2" for t in ts if t in ("h=a", "h=b")]  # always together
        bad = {"h=a", "h=c"} <= set(ts) or {"h=b", "h=d", "h=e"} <= set(ts) or rng.random() < 0.1
        rows.append((ts, bad))
    rows += [([], True), ([], False)]
    monkeypatch.setattr(urls, "OPEN_TOKENS", open_tokens)  # 3: combinations grow token by token
    got = {frozenset(r["need"]): round(r["confidence"], 9) for r in urls.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.02, 0.8, 1).collect()}
    want = _brute_rules(rows, 0.02, 0.8)
    assert got == want and any(len(k) == 3 for k in got)


def test_long_templates_end(spark):
    """URLs of one template with 40 parts, whole, and with parts missing here and there."""
    rng = random.Random(9)
    for share in (1.0, 0.97):
        rows = [([f"p=t{k}" for k in range(40) if rng.random() < share] + ([f"p=x{i % 2}"] if i % 3 else []), i % 2 == 0 and i % 3 > 0) for i in range(300)]
        began = time.time()
        got = [frozenset(r["need"]) for r in urls.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()]
        assert frozenset({"p=x0"}) in got and time.time() - began < 60


def _four_tokens(wide):
    """Only four tokens together are bad; `wide` more URLs have 16 open tokens."""
    rows = []
    for i in range(960):
        a, b, c, e = (i >> s & 1 for s in range(4))
        rows.append((i, f"http://{'sub' if a else 'www'}.{'host' if b else 'other'}.org/{'xx' if c else 'en'}/{'yy' if e else 'de'}/{i}", int(a and b and c and e)))
    parts = [f"q{k}" for k in range(16)]
    for j in range(wide):
        rows.append((1000 + j, "http://wide.org/" + "/".join(p for k, p in enumerate(parts) if (k + j) % (wide + 2))[:400], j % 2))
    return rows


def test_wide_urls_cap_no_rule(spark, make):
    """The rule of four tokens stands, whatever wide URLs are there; all verdicts are the SQL's, which tries all combinations."""
    for wide in (3, 40):
        rows = _four_tokens(wide)
        d = make(pages=[(i, u, "") for i, u, _ in rows], labels=[(i, 1, bad) for i, _, bad in rows])
        got = {r["page_id"]: r["verdict"] for r in urls.query(spark, d).collect()}
        assert {i for i, v in got.items() if v == "block" and i < 1000} == {i for i, _, bad in rows if bad and i < 1000}
        if wide == 3:
            same(urls.query(spark, d), d, urls.SQL)


def test_very_wide_urls_end(spark, make):
    """URLs of 2,000 parts, alike and in many mixes."""
    rng = random.Random(2)
    rows = [(i, "http://h.org/" + "/".join(f"p{k}" for k in range(2000) if i % 2 or rng.random() < 0.9), i % 2) for i in range(24)]
    d = make(pages=[(i, u, "") for i, u, _ in rows], labels=[(i, 1, bad) for i, _, bad in rows])
    assert {r["page_id"] for r in urls.query(spark, d).where("verdict = 'block'").collect()} >= set()


def test_few_hits_are_no_rule(spark, make):
    """Four bad pages are too few for a rule, five are enough."""
    for n in (4, 5):
        rows = [(i, f"http://x.org/{'odd' if i < n else 'en'}/{i}", int(i < n)) for i in range(200)]
        d = make(pages=[(i, u, "") for i, u, _ in rows], labels=[(i, 1, bad) for i, _, bad in rows])
        assert urls.query(spark, d).where("verdict = 'block'").count() == (n if n == 5 else 0)
        same(urls.query(spark, d), d, urls.SQL)
