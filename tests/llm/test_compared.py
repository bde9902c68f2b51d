"""Sets that share a frequent shingle: compared inside tasks, only those that can be alike become rows."""

import numpy as np

from memlake.llm import nearcopies


def test_only_pairs_that_can_be_alike_become_rows(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", 16)
    rng, rows, sets = np.random.default_rng(5), [], {}
    for cid in range(120):
        s = rng.integers(0, 1 << 63, 50).astype(np.uint64)
        if cid % 10 == 9:  # nearly the one before
            s = np.r_[sets[cid - 1][:47], s[:4]]
        sets[cid] = np.unique(s)
        bits = nearcopies.bitmap(sets[cid]).view(np.int64).tolist()
        rows += [(w, cid, len(sets[cid]), i, len(sets[cid]) - i - 1, cid, 120, bits) for i, w in enumerate((7, 8))]
    df = spark.createDataFrame(rows, "w long, cid long, n long, i long, rest long, root long, size long, bits array<long>")
    classes = df.select("cid", "bits").distinct()
    got = sorted(tuple(r) for r in nearcopies._compared(df.drop("bits"), classes).collect())
    assert got == [(c - 1, c) for c in range(9, 120, 10)]  # each once, of over 7,000 pairs a shingle
    plain = {tuple(sorted((r["cid"], r["cid2"]))) for r in nearcopies._met(df.drop("bits")).select("cid", "cid2").collect()}
    assert set(got) <= plain and len(plain) > 5000
