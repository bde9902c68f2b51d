"""Mined URL rules where combinations are too many to list: no rule is lost, whatever its length."""

import math
import random
from itertools import combinations

import pytest

from memlake.llm import rulesearch, urls


def _template(seed, few, many, n):
    """Only all `few` tokens together are bad, each on half of the rows; `many` more are on nine rows of ten."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = [f"a{k}" for k in range(few) if rng.random() < 0.5]
        rows.append((i, a + [f"b{k}" for k in range(many) if rng.random() < 0.9], len(a) == few))
    return rows


def _holds_rule(rows, least, confidence):
    """Whether each row holds a rule: the widest set on given bad rows is what they share, so all groups of bad rows are gone through."""
    names = {t: k for k, t in enumerate(sorted({t for _, ts, _ in rows for t in ts}))}
    masks = [sum(1 << names[t] for t in ts) for _, ts, _ in rows]
    bad = [m for m, (_, _, b) in zip(masks, rows) if b]
    good = [m for m, (_, _, b) in zip(masks, rows) if not b]
    shared = set()
    for size in range(least, len(bad) + 1):
        for some in combinations(bad, size):
            s = some[0]
            for m in some:
                s &= m
            shared.add(s)
    out, known = [], {}
    for m in masks:
        found = False
        for s in {s & m for s in shared} - {0}:
            if s not in known:
                h, g = sum(x & s == s for x in bad), sum(x & s == s for x in good)
                known[s] = h >= least and h / (h + g) >= confidence
            found = found or known[s]
        out.append(found)
    return out


def _pages(rows):
    return [(i, "http://h.org/" + "/".join(ts), "") for i, ts, _ in rows], [(i, 1, int(bad)) for i, _, bad in rows]


def test_long_rule_in_a_template(spark, make):
    rows = _template(4, 6, 24, 640)
    pages, labels = _pages(rows)
    got = {r["page_id"]: r["verdict"] == "block" for r in urls.query(spark, make(pages=pages, labels=labels)).collect()}
    want = _holds_rule(rows, max(math.ceil(0.005 * len(rows)), 5), 0.8)
    assert [got[i] for i, _, _ in rows] == want and sum(want) >= sum(bad for _, _, bad in rows) >= 5


@pytest.mark.parametrize("cells", [1, 300])
def test_parts_give_the_same_verdicts(spark, make, monkeypatch, cells):
    """Split by many first tokens and by few; URLs without a label are judged too."""
    monkeypatch.setattr(urls, "OPEN_TOKENS", 3)
    monkeypatch.setattr(urls, "LISTED", 0)
    monkeypatch.setattr(rulesearch, "CELLS", cells)
    monkeypatch.setattr(rulesearch, "PIECE", 40)
    rows = _template(5, 3, 4, 90)
    pages, labels = _pages(rows)
    got = {r["page_id"]: r["verdict"] == "block" for r in urls.query(spark, make(pages=pages + [(1000 + i, u + "?x", h) for i, u, h in pages], labels=labels)).collect()}
    want = _holds_rule(rows, 5, 0.8)
    assert [got[i] for i, _, _ in rows] == want and [got[1000 + i] for i, _, _ in rows] == want and True in want and False in want


@pytest.mark.parametrize("cells", [1, 1 << 23])
def test_parts_give_the_same_rules(spark, monkeypatch, cells):
    rows = [(ts, bad or i % 9 == 0) for i, ts, bad in _template(7, 3, 5, 120)]
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    want = {(frozenset(r["need"]), r["hits"], r["freq"]) for r in urls.mine(df, 0.03, 0.5).collect()}
    monkeypatch.setattr(urls, "OPEN_TOKENS", 3)
    monkeypatch.setattr(urls, "LISTED", 0)
    monkeypatch.setattr(rulesearch, "CELLS", cells)
    got = [(frozenset(r["need"]), r["hits"], r["freq"]) for r in urls.mine(df, 0.03, 0.5).collect()]
    assert set(got) == want and len(got) == len(want) > 1
