"""Task keys as columns against the plain function; as-of choices and counts against all pairs."""

import random

from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.operators import evals

PIECES = [
    "PR", "pr", "pull", "#12", "12a", "pull/7", "x/pull/9/files", "https://h.org/t/pull/3", "http://a.b/c", "pr#44!", "PR#", "ABC-12", "(ABC-12),", "A-1", "9Z-", "-ABC-1-", "src/Main.java", "./a/b", ".././x", "~/n", "/abs/p/",
    "docs/x", "a/b", "a/b.c", "a:b/cd", "tests/", "branch", "branch:", "Branch", "fix-1", "-x", "ü/ö/ä", "ñ", "just", "`cargo`", "gh;", "bin/bazel", "{GT}", " ", " ", "\x1f", "\n", "\"q\"", "", "''", "pull-request", "5",
]


def test_task_keys_as_columns(spark):
    rng = random.Random(7)
    texts = [rng.choice([" ", "  ", "\t"]).join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(400)]
    texts += [None, "", " ", " ".join(f"T{i}X-{i}" for i in range(70)), " ".join(f"pr {i} src/f{i}.py" for i in range(60)), "word " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", tx.task_keys_of(F.col("t")).alias("keys")).collect()
    for r in rows:
        assert list(r["keys"]) == tx.task_keys(texts[r["i"]]), repr(texts[r["i"]])
    assert "Python" not in spark.createDataFrame([("x",)], "t string").select(tx.task_keys_of(F.col("t")))._jdf.queryExecution().executedPlan().toString()


def _events(n):
    rng = random.Random(4)
    return [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(40)]), rng.random() < 0.4) for i in range(n)]


def test_asof_is_all_pairs(spark):
    rows = _events(300)
    df = spark.createDataFrame(rows, "id long, k string, t long, m boolean").repartition(5)
    got = {r["id"]: r["eligible"] for r in evals.eligible_before(df, "k", "t", F.col("m"), 8).collect()}
    assert got == {i: sum(m and k == k2 and t2 is not None and t is not None and t2 < t for _, k2, t2, m in rows) for i, k, t, _ in rows}
    q = df.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("t").alias("qt"))
    m = df.select("id", "t", F.col("m").alias("is_active"))
    found = evals.best_before(q, m, "qt", "t", F.col("id") % 7, F.col("t"), 3)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    want = []
    for i, _, t, _ in rows:
        if i % 10 == 0 and t is not None:
            near = sorted(((-(j % 7), -t2, -j) for j, _, t2, a in rows if a and t2 is not None and t2 < t))[:3]
            want += [(i, -j, r + 1) for r, (*_, j) in enumerate(near)]
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in found.collect()) == sorted(want)
    empty = evals.best_before(q.where("query_id < 0"), m, "qt", "t", F.lit(1), F.col("t"))
    assert empty.count() == 0 and evals.candidates_before(q, m.where("id < 0"), "qt", "t").count() == 0


def test_keyed_asof_is_all_pairs(spark, monkeypatch):
    """Groups over many tasks, equal times, nulls, ties and repeated rows, against the SQL's pairs; rows swept grow with rows, not with pairs."""
    rng = random.Random(5)
    rows = [(i // 2 if i < 40 else i, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, *range(30)]), rng.random() < 0.6, rng.choice([None, 0.0, 0.5, 1.0, 1.5, float("nan"), *map(float, range(9))])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, t long, m boolean, v double").repartition(5)
    q = df.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("t").alias("qt"), F.col("k").alias("qk"))
    m = df.select("id", "k", "t", "v", F.col("m").alias("is_active"))
    made = []
    monkeypatch.setattr(evals, "_swept", lambda rows, tasks, limit, f=evals._swept: made.append(tasks) or f(rows, tasks, limit))
    score = F.when(F.col("k") == F.col("qk"), 1).otherwise(0) + F.col("v")
    want = sorted((r["query_id"], r["rank"], r["id"], str(r["score"])) for r in evals.best_before(q, m, "qt", "t", score, F.col("t")).collect())
    for swept in (100_000, 25):
        monkeypatch.setattr(evals, "SWEPT", swept)
        got = evals.best_before_keyed(q, m, "qt", "t", "qk", "k", 0 + F.col("v"), 1 + F.col("v"), F.col("t")).collect()
        assert sorted((r["query_id"], r["rank"], r["id"], str(r["score"])) for r in got) == want
    assert made[0] == 1 and made[1] > 20 and len(want) > 300
    assert evals.best_before_keyed(q, m.where("id < 0"), "qt", "t", "qk", "k", F.lit(0), F.lit(1), F.col("t")).count() == 0
