"""Language models, language identification, archives and packing: brute force, round trips, accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import HARD, docs, prose

from memlake.llm import langid, lm, packing, warc

SF = "/root/testdata/sf0.01"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def plain_base(rows):
    train = Counter()
    for i, t in rows:
        if i is not None and fold(i, 7) != 2:
            train.update(lm.tokens(t))
    n, v = sum(train.values()), len(train)
    out = []
    for i, t in rows:
        ws = lm.tokens(t)
        out.append((i, i is not None and fold(i, 7) == 2, len(ws), sum(w in train for w in ws), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws)))
    return out


@pytest.mark.parametrize("head", [lm.HEAD, 7])
def test_base_scores(spark, make, head):
    d = make(documents=HARD, extra=True)
    got = lm.score(spark.read.parquet(f"{d}/documents.parquet"), head).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    have = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    for a, b in zip(have, sorted(plain_base([(i, t) for i, t, *_ in HARD]), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
    assert all(r["score"] < 0 for r in got)


def test_model_is_normalised():
    rng = np.random.default_rng(0)
    v = lm.Vocabulary([b"a", b"b", lm.END], [5, 3, 2], 10, 3, {})
    m = lm.LogBilinear(noise=v.noise)
    ctx = rng.integers(0, lm._C, (5, lm.ORDER))
    total = sum(np.exp(m.log_probabilities(ctx, np.full(5, u))) for u in range(lm._K))
    assert np.allclose(total, 1, atol=1e-4)


def test_contexts():
    c = lm.contexts_of(np.array([1, 2, 3, 4, 5]), np.array([0, 3]))
    assert c.tolist() == [[lm.BEGIN] * 2, [1, lm.BEGIN], [2, 1], [lm.BEGIN] * 2, [4, lm.BEGIN]]


def test_model_beats_counts_on_held_out(spark):
    r = lm.score(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").selectExpr("sum(score) / sum(n_tokens) s", "sum(base_score) / sum(n_tokens) b").first()
    assert r["s"] > r["b"]


def test_language_accuracy(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    got = langid.identify(d, langid.fit(d)).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = [r["lang_pred"] == r["lang"] for r in got]
    assert len(right) > 150 and sum(right) / len(right) > 0.95
    sure = [r for r in got if not r["rejected"]]
    assert sum(r["lang_pred"] == r["lang"] for r in sure) / len(sure) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_hard_rows(spark, make):
    d = make(documents=HARD, extra=True)
    got = langid.query(spark, d).collect()
    assert len(got) == len(HARD)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3)) and by[4]["lang_pred"] in ("en", "de", "fr")
    none = langid.identify(spark.read.parquet(f"{d}/documents.parquet"), langid.train([]))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def test_archive_round_trip(spark, make):
    pages = [(3, "http://a", "x"), (1, "http://b\r\nWARC/1.1", "x"), (2, None, "y\r\n\r\nWARC/1.1\r\n"), (4, "u", None), (5, "u", ""), (6, "u", "ä" * 200000), (7, "u", "x"), (None, "u", "x")]
    d = make(pages=pages, extra=True)
    got = {r["page_id"]: r for r in warc.query(spark, d).collect()}
    assert len(got) == len(pages)
    for i, _, h in pages:
        p = (h or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(p), warc.digest(p))
    assert {i: got[i]["refers_to"] for i in got} == {1: None, 2: None, 3: 1, 4: None, 5: 4, 6: None, 7: 1, None: None}
    assert {got[i]["record_type"] for i in (3, 5, 7)} == {"revisit"}


def _archive(n=6, gz=False):
    recs = [warc.record(i, f"u{i}", f"payload {i} ".encode() * 9, None) + warc.END for i in range(n)]
    if gz:
        import gzip

        recs = [gzip.compress(r) for r in recs]
    return recs


@pytest.mark.parametrize("gz", [False, True])
def test_salvage(gz):
    recs = _archive(gz=gz)
    assert [len(x) for x in warc.salvage(b"".join(recs))] == [6, 0] and warc.salvage(b"") == ([], [])
    bad = bytearray(recs[2])
    bad[len(bad) // 2] ^= 0xFF
    data = b"junk" + recs[0] + recs[1] + bytes(bad) + recs[3] + b"more junk WARC/1.1 not" + recs[4] + recs[5][:-5]
    found, gaps = warc.salvage(data)
    assert [h["warc-record-id"] for h, _, _ in found] == [f"<urn:page:{i}>" for i in (0, 1, 3, 4)]
    assert gaps[0] == (0, 4) and len(gaps) == 4 and gaps[-1][1] == len(data)
    covered = sum(e - b for b, e in gaps) + sum(len(recs[i]) for i in (0, 1, 3, 4))
    assert covered == len(data)


def test_salvage_of_noise():
    rng = random.Random(1)
    for _ in range(30):
        data = bytearray(b"".join(_archive(4)))
        for _ in range(3):
            data[rng.randrange(len(data))] = rng.randrange(256)
        found, gaps = warc.salvage(bytes(data))
        told = [(h.get("warc-payload-digest", ""), b) for h, b, _ in found]
        assert all(d[5:] == warc.digest(b) for d, b in told if d.startswith("sha1:")) and found
        assert all(0 <= b < e <= len(data) for b, e in gaps)


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY)), packing.WordTokenizer(public_tokenizers.path(packing.VOCABULARY))


def test_ids_are_the_tokenizers(spark, monkeypatch):
    whole, words = tokenizer()
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()]
    texts += ["", None, "It's DON'T we'll", "ÉÀß ñandú Ünïcode", "é ́x", "日本 😀  x y", "ΣΑΣ İ", "a1b2 3.14, (x)!", "#|*$ <>", "x" * 5000, "\x0bq\x0c", "<|endoftext|> x<|startoftext|>y <b>bold</b> (a) don't 's it's, ''quoted'' *** stars### a'b' ([{word}])|"]
    for t in texts:
        assert words.ids(t).tolist() == whole.encode(t or "", add_special_tokens=False).ids + [0]
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    for t in ["some fresh words here", *texts[:40], *texts[-11:], *texts[:40]]:  # the cache forgets again and again
        assert words.ids(t).tolist() == whole.encode(t or "", add_special_tokens=False).ids + [0]


def test_packing(spark, make):
    d = make(documents=HARD, extra=True)
    whole, _ = tokenizer()
    got = packing.query(spark, d).collect()
    want = Counter()
    for i, t, *_ in HARD:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for p in range(0, len(ids), 2048):
            x = ids[p : p + 2048]
            want[(i, p // 2048, p, len(x), zlib.crc32(x.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    check_sequences(got)


def check_sequences(got, most=1.02):
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = 0
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
        total += at
    assert len(seqs) <= max(most * total / 2048 + 1, 1)


@pytest.mark.parametrize("per_task", [50_000, 40])
def test_packing_through_rounds(spark, monkeypatch, per_task):
    monkeypatch.setattr(packing, "PIECES_PER_TASK", per_task)
    rng = random.Random(4)
    rows = [(i, 0, 0, min(2048, int(rng.lognormvariate(5.5, 1.1)) + 1), i) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(df).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(600))
    check_sequences(got, 1.03)


def test_best_fit():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randrange(1, 40) for _ in range(rng.randrange(0, 30))]
        bins = packing.best_fit(sizes, 50)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 50 for b in bins)
        free = [50] * len(sizes)
        used = 0
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [k for k in range(used) if free[k] >= sizes[i]]
            k = min(fits, key=lambda k: free[k]) if fits else used
            used = max(used, k + 1)
            free[k] -= sizes[i]
        assert len(bins) == used


def test_prose_is_whole():
    assert len(docs(prose(5))) == 1


def test_words_are_normalised():
    """Over all words of the vocabulary and what its tail classes leave for unknown ones, probabilities add up to one."""
    rng = np.random.default_rng(1)
    words = [f"w{i}".encode() for i in range(700)] + [lm.END]
    c = sorted((int(x) for x in rng.zipf(1.4, 701) % 5000 + 1), reverse=True)
    n = lm.model_words(np.array(c))
    tails = Counter()
    for w, x in zip(words[n:], c[n:], strict=True):
        tails[lm.tail_of(w)] += x + 1
    v = lm.Vocabulary(words, c, sum(c), len(c), tails)
    assert 0 < n < len(words) and (np.diff(v.first) >= 0).all() and v.first[-1] == n
    t = lm.Trainer(v, 3)
    at, unit, context = v.ids([words[i] for i in rng.integers(0, len(words), 20_000)])
    t.learn(lm.contexts_of(context, np.arange(0, 20_000, 50)), unit, at)
    m, (every, units, _) = t.model, v.ids(words)
    for ctx in rng.integers(0, lm._C, (4, lm.ORDER)):
        ctxs = np.tile(ctx, (len(words), 1))
        logs = m.log_probabilities(ctxs, units) + m.word_log_probabilities(ctxs, units, every)
        known = (np.exp(logs.astype(float)) * 10 ** v.share).sum()
        unknown = sum(math.exp(m.log_probabilities(ctx[None], np.array([lm.CLASSES + k]))[0]) / (v.tail_sums[k] + 1) for k in range(lm.TAIL))
        assert known + unknown == pytest.approx(1, abs=1e-3)


def test_equal_counts_fill_the_head(spark):
    df = spark.createDataFrame([(f"w{i}".encode(), 3) for i in range(4000)], "word binary, c long")
    assert 1500 < len(lm.vocabulary(df, 2000).rank) <= 2000
