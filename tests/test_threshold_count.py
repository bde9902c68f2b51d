"""Threshold counts without a bound."""

import numpy as np

from memlake.functions import vectors as vx


def test_count_has_no_k(spark, monkeypatch):
    """Counts come from sums: nothing ranks or keeps rows, so no number of hits is a bound."""
    rows = [(i, [1.0, 0.01 * i]) for i in range(300)] + [(None, [1.0, 0.0]), (500, [0.0, 0.0]), (501, None), (502, [-1.0, 0.0]), (7, [1.0, 0.2])]
    vectors = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    ask = spark.createDataFrame([(7, [1.0, 0.0]), (502, [-1.0, 0.0]), (900, [1.0, 0.0]), (901, None)], "query_id long, v array<float>")
    unit = lambda v: np.float32(v).astype(float) / np.linalg.norm(np.float32(v))
    near = lambda i, q: sum(1 for k, v in rows if k not in (None, i) and v and any(v) and unit(v) @ unit(q) >= 0.3)
    want = {i: near(i, q) for i, q in ((7, [1.0, 0.0]), (900, [1.0, 0.0]))}
    monkeypatch.setattr(vx, "search", None)
    assert {r["query_id"]: r["n"] for r in vx.count_over(vectors, ask, "id", "v", 0.3).collect()} == want
    assert want[900] == 301 and want[7] == 299


def test_count_query_does_not_rank(spark, monkeypatch):
    from memlake.plans import catalog

    monkeypatch.setattr(vx, "search", None)
    got = catalog.QUERIES["vector_threshold_count"](spark, "/root/testdata/sf0.001")
    assert got.count() > 0
