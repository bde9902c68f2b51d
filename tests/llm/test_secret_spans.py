"""Spans and redaction against plain loops, and their time."""

import random
import re
import time

import pytest
from conftest import DOCS, prose

from memlake.llm import secrets


def plain_spans(text):
    kinds = [(k, re.finditer(p, text)) for k, p in ((0, secrets.ASSIGN), (1, secrets.ACCESS), (2, secrets.HEX), (3, secrets.MIXED))]
    base, more = [], []
    for k, found in kinds:
        for m in found:
            v = m[2] if k == 0 else m[0]
            if k == 0 and len(v) < 6:
                continue
            if k == 3 and not all(re.search(c, v) for c in ("[0-9]", "[a-z]", "[A-Z]")):
                continue
            (more if k == 3 else base).append((m.start(), k, m.end(), v))
    return sorted(base), [c for c in more if not any(b[0] < c[2] and c[0] < b[2] for b in base)]


def _text(rng, n):
    bits = ["password=hunter22x", "deadbeef" * 4, "AKIA" + "Q7" * 9, "Zk3Qp9xLm2Vt7Rb4Wd8Yc1Nf6", "token: " + "ab12" * 7, "api_key='Xy9" + "z" * 25 + "'", "plain", "ñ日本😀", "secret=short", "x" * 30, "Ab1" * 12 + "deadbeef" * 3]
    return "".join(rng.choice(bits) + rng.choice([" ", "", "\n", ", "]) for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_are_a_plain_loops(spark, seed):
    rng = random.Random(seed)
    texts = [_text(rng, n) for n in (0, 1, 2, 5, 30, 63, 64, 65, 300, 900)]
    df = spark.createDataFrame([(i, t, "en", f"s{i}", 1) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: ([tuple(x) for x in r["_b"]], [tuple(x) for x in r["_c"]]) for r in secrets.with_spans(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_spans(t), i
    owner = {}
    for i, t in enumerate(texts):
        for x in sum(plain_spans(t), []):
            owner.setdefault(x[3], set()).add(i)
    out = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    for i, t in enumerate(texts):
        at, want = 0, ""
        for s, _, e, v in sorted(sum(plain_spans(t), [])):
            if owner[v] == {i}:
                want += t[at:s] + secrets.MARK if s >= at else ""
                at = max(at, e)
        assert out[i] == want + t[at:], i


def test_many_matches(spark):
    """Four times the matches take about four times as long, not sixteen."""
    rng = random.Random(7)
    long = [" ".join(f"{rng.getrandbits(128):032x}" for _ in range(n)) for n in (500, 8000, 32000)]
    took = []
    for t in long:
        df = spark.createDataFrame([(1, f"{prose(5)} {t}", "en", "a", 1), (2, "Zk3Qp9xLm2Vt7Rb4Wd8Yc1Nf6 " * 3, "en", "b", 1)], DOCS).coalesce(1)
        began = time.time()
        got = {r["doc_id"]: r for r in secrets.scan(df).collect()}
        took.append(time.time() - began)
        assert got[1]["n_hex"] == got[1]["n_live"] == t.count(" ") + 1
    began = time.time()
    assert next(r["text"] for r in secrets.redact(df).collect() if r["doc_id"] == 1) == " ".join([*prose(5).split(), *[secrets.MARK] * 32000])
    assert took[2] < 8 * took[1] + 5 and took[2] < 30 and time.time() - began < 60, took
    print("seconds", took, time.time() - began)
