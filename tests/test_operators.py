import random

import pytest
from pyspark.sql import functions as F

from memlake.operators import cluster, evals, recall, state, tasks, turns
from memlake.operators.components import components


def test_components(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(1, 1), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_dbscan_is_the_sequential_scan(spark):
    for seed in range(3):
        rng = random.Random(seed)
        n = 30
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.07]
        near = [{i} | {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(n)]
        df = cluster.dbscan(spark.range(n), spark.createDataFrame(pairs, "a long, b long"), 3)
        got = {r["id"]: r["cluster"] for r in df.collect()}
        assert set(got) == set(cluster.sequential_dbscan(n, near, 3))


def test_densest_drops_the_far_one(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.01]), (3, [0.98, 0.02]), (4, [0.8, 0.2])], "id long, vector array<double>")
    m = v.select(F.lit(1).alias("cluster"), "id")
    assert {r["id"] for r in cluster.densest(m, v, 3).collect()} == {1, 2, 3}


def test_greedy_losers(spark):
    rows = [(1, "project", "p", "Use just for builds", "Run just test before a commit"), (2, "project", "p", "Use just for builds", "Run just test before a commit always please"), (3, "project", "p", "Other matter", "Nothing alike here"), (4, "project", None, "Use just for builds", "Run just test before a commit")]
    got = cluster.greedy_losers(spark.createDataFrame(rows, "id long, scope string, project_id string, title string, body string")).collect()
    assert [(r["id"], r["kept_id"]) for r in got] == [(1, 2)]


def _candidate(**kw):
    base = {"query_id": 1, "memory_id": 1, "similarity": 0.5, "context_points": 0, "same_project": False, "same_repo": False, "same_area": False, "scope": "project", "kind": "workflow", "has_query_keys": False, "n_strong": 0, "n_weak": 0}
    return base | kw


SCHEMA = "query_id long, memory_id long, similarity double, context_points int, same_project boolean, same_repo boolean, same_area boolean, scope string, kind string, has_query_keys boolean, n_strong int, n_weak int"


def _frame(spark, rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def test_key_beats_project(spark):
    rows = [_candidate(memory_id=1, similarity=0.9, same_project=True, has_query_keys=True), _candidate(memory_id=2, similarity=0.7, n_strong=1, has_query_keys=True)]
    got = {r["memory_id"]: (r["rank"], round(r["score"], 6)) for r in recall.rank(_frame(spark, rows)).collect()}
    assert got == {2: (1, 0.98), 1: (2, 0.71)}


def test_rules_and_greedy_choice(spark):
    rows = [
        _candidate(memory_id=1, similarity=0.9, kind="task_state", has_query_keys=True), _candidate(memory_id=2, similarity=0.8, kind="task_state", has_query_keys=True, n_strong=1),
        _candidate(memory_id=3, similarity=0.7, has_query_keys=True), _candidate(memory_id=4, similarity=0.6, has_query_keys=True, kind="project_fact"), _candidate(memory_id=5, similarity=0.1),
    ]
    got = recall.select(recall.rank(_frame(spark, rows)), 2)
    assert sorted(r["memory_id"] for r in got.where("selected").collect()) == [2, 3]
    why = {r["memory_id"]: r["reason"] for r in got.collect()}
    assert why[1].startswith("drop:task_state_without") and why[4] == "drop:project_fact_wrong_context"


def test_judge(spark):
    sel = recall.select(recall.rank(_frame(spark, [_candidate(memory_id=i, similarity=1 - i / 10) for i in range(1, 5)])), 12)
    ids = lambda v: [r["memory_id"] for r in recall.judged(sel, v).orderBy("place").collect()]
    v = lambda x: spark.createDataFrame([(1, x)], "query_id long, ids array<long>")
    assert ids(None) == [1, 2, 3, 4] and ids(v([3, 99, 2])) == [2, 3] and ids(v([])) == [1] and ids(v(None)) == [1, 2, 3, 4]


def test_write_action_and_validity(spark):
    r = spark.createDataFrame([(1, [1, 2]), (2, [3]), (3, [])], "query_id long, memory_ids array<long>")
    old = spark.createDataFrame([(1, [1, 2]), (2, [4])], "query_id long, memory_ids array<long>")
    assert {x["query_id"]: x["action"] for x in recall.write_action(r, old).collect()} == {1: "unchanged", 2: "written", 3: "noop"}
    files = spark.createDataFrame([("a", [1, 2]), ("b", [1, 9]), ("c", [])], "path string, memory_ids array<long>")
    mem = spark.createDataFrame([(1, True), (2, True), (9, False)], "id long, is_active boolean")
    assert {x["path"]: x["valid"] for x in recall.valid_files(files, mem).collect()} == {"a": True, "b": False, "c": False}


def test_batches_of_25(spark):
    t = spark.range(25).select(F.lit("s").alias("session_id"), F.col("id").alias("ordinal"), F.lit("completed").alias("status"))
    lots = turns.batches(t, 10)
    assert sorted(r["n"] for r in lots.collect()) == [5, 10, 10]
    assert turns.uncovered(lots, t.where("ordinal < 20")).count() == 1 and turns.uncovered(lots, t).count() == 0


TASK = "id long, kind string, status string, priority long, payload_json string, attempts long, max_attempts long, next_run_at string, last_error string, created_at string, updated_at string"


def _task(i, priority=0, status="queued", at=None, kind="recall", payload="{}"):
    return (i, kind, status, priority, payload, 1, 5, at, None, "a", "a")


def test_queue(spark):
    q = spark.createDataFrame([_task(1), _task(2, 10), _task(3), _task(4, 99, at="unix:200"), _task(5, 5, at="unix:99"), _task(6, 7, "running")], TASK)
    assert [r["id"] for r in tasks.next_due(q, 100, 9).collect()] == [2, 5, 1, 3]
    assert [r["id"] for r in tasks.by_display_status(q, 100, "scheduled", 9).collect()] == [4]
    t = tasks.transition(q, F.col("id") == 6, "retried", "now").where("id = 6").first()
    assert (t["status"], t["attempts"], t["updated_at"]) == ("queued", 0, "now")
    assert tasks.transition(q, F.lit(True), "requeued", "now").where("status = 'queued'").count() == 6
    assert tasks.clear(q, 100, "scheduled").count() == 5 and tasks.clear(q, 100, "nonsense").count() == 6
    new = spark.createDataFrame([_task(0, payload="{}"), _task(0, payload="x"), _task(0, payload="x")], TASK)
    assert tasks.enqueue(q, new).count() == 1


def test_eval_states(spark):
    ev = spark.createDataFrame([(1, "s", 0, 1, 5, "unix:90"), (2, "s", 5, 1, 5, "unix:90"), (3, "s", 9, 1, 5, None), (4, "s", 5, 5, 5, "unix:90")], "id long, session_id string, turn_ordinal long, attempts long, max_attempts long, last_seen_at string")
    t = spark.createDataFrame([("s", 0, "completed"), ("s", 5, "completed")], "session_id string, ordinal long, status string")
    got = {r["id"]: r["state"] for r in tasks.eval_state(ev, t, 600, 100).collect()}
    assert got == {1: "score", 2: "defer_turns", 3: "defer_anchor", 4: "insufficient_context"}


def test_state_rules(spark):
    s = "id string, agent_type string, project_id string, transcript_file_path string, started_at string, last_seen_at string"
    old = spark.createDataFrame([("a", "codex", "p", "f", "1", "2")], s)
    new = spark.createDataFrame([("a", "codex", "q", "f", "9", "3"), ("b", "codex", "q", "g", "9", None)], s)
    got = {r["id"]: (r["project_id"], r["started_at"], r["last_seen_at"]) for r in state.upsert_sessions(old, new).collect()}
    assert got == {"a": ("q", "1", "3"), "b": ("q", "9", None)}
    c = "file_path string, last_byte_offset long, last_processed_at string"
    lw = state.last_wins(spark.createDataFrame([("f", 9, "a")], c), spark.createDataFrame([("f", 4, "b")], c), ["file_path"], "last_byte_offset").first()
    assert lw["last_byte_offset"] == 4


def test_store(spark, tmp_path):
    st = state.Store(spark, f"file://{tmp_path}")
    assert st.read("file_cursors").count() == 0 and st.tables() == []
    row = spark.createDataFrame([("f", 1, "x")], state.SCHEMAS["file_cursors"])
    st.write("file_cursors", row)
    st.write("file_cursors", st.read("file_cursors").unionByName(row))
    assert st.read("file_cursors").count() == 2 and st.tables() == ["file_cursors"]


def test_rollups(spark):
    res = spark.createDataFrame([(1, 1, "5"), (2, 1, "2"), (3, 2, "insufficient_context")], "id long, eval_run_id long, judge_score string")
    runs = spark.createDataFrame([(1, "s", 0), (2, "s", 3), (3, "t", 1)], "id long, session_id string, turn_ordinal long")
    assert {r["id"]: (r["n_results"], r["score"]) for r in evals.run_rollup(runs, res).collect()} == {1: (2, "2,5"), 2: (1, "insufficient_context"), 3: (0, None)}
    assert {r["score"]: r["n"] for r in evals.score_histogram(res).collect()} == {"5": 1, "2": 1, "n/a": 1}
    u = evals.usefulness(res).first()
    assert list(u) == [2, 1, 1, 1, 1]
    s = {r["session_id"]: r for r in evals.session_summary(runs, res).collect()}
    assert s["s"]["average"] == pytest.approx(3.5) and s["s"]["latest_run"] == 2 and s["t"]["average"] == 0
    v = evals.volumes(spark.createDataFrame([], "n long")).first()
    assert (v["avg_n"], v["p50"], v["b_0"]) == (0.0, 0, 0)


def test_by_ids(spark):
    m = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    ids = spark.createDataFrame([(0, 2), (1, 9), (2, 1)], "pos int, id long")
    assert [r["t"] for r in state.by_ids(m, ids).collect()] == ["b", "a"]
    assert [r["t"] for r in state.by_ids(m, ids, keep_missing=True).collect()] == ["b", None, "a"]


def test_retry_class(spark):
    got = spark.createDataFrame([(s,) for s in (429, 500, 404, 408)], "s int").select(tasks.retry_class(F.col("s")).alias("c")).collect()
    assert [r["c"] for r in got] == ["retryable", "retryable", "permanent", "retryable"]


def test_config(tmp_path):
    from memlake import config

    (tmp_path / "a.toml").write_text("recall_result_limit = 7\nother = 1\n[memory]\nmemory_cluster_min_size = 4\n")
    (tmp_path / "b.toml").write_text("recall_result_limit = 9\n")
    c = config.load(tmp_path / "a.toml", tmp_path / "b.toml", tmp_path / "none.toml")
    assert (c.recall_result_limit, c.memory_cluster_min_size, c.recall_candidate_pool) == (9, 4, 20)


def test_stale_evals(spark):
    cfg = lambda o, rerun=None: '{"session_id": "s", "turn_ordinal": %d%s}' % (o, "" if rerun is None else f', "rerun_for_eval_run_id": {rerun}')
    runs = spark.createDataFrame([(1, cfg(0)), (2, cfg(1)), (3, cfg(0, 1)), (4, cfg(9)), (5, cfg(2))], "id long, config_json string")
    res = spark.createDataFrame([(i, "insufficient_context") for i in (1, 2, 3, 4)] + [(5, "3")], "eval_run_id long, judge_score string")
    t = spark.createDataFrame([("s", 5, "completed")], "session_id string, ordinal long, status string")
    assert [r["id"] for r in tasks.stale_evals(runs, res, t).collect()] == [2]


def test_telemetry_and_deferral(spark):
    sel = recall.select(recall.rank(_frame(spark, [_candidate(memory_id=i, similarity=1 - i / 10) for i in range(1, 8)])), 12)
    v = spark.createDataFrame([(1, [2], None)], "query_id long, ids array<long>, error string")
    t = recall.telemetry(sel, recall.judged(sel, v.drop("error")), v).first()
    assert list(t) == [1, 7, 5, 1, True, True, False, None]
    assert recall.telemetry(sel, recall.judged(sel, None), None).first()["llm_attempted"] is False
    q = spark.createDataFrame([_task(1)], TASK)
    rest, copies = tasks.deferred(q, F.col("id") == 1, 60, 100)
    assert rest.first()["status"] == "completed" and (copies.first()["attempts"], copies.first()["next_run_at"]) == (2, "unix:160")
    none = spark.createDataFrame([], "config_json string")
    r = spark.createDataFrame([("s", 1, "x"), ("s", 2, "y")], "session_id string, turn_ordinal long, recall_text string")
    e = tasks.eval_tasks(spark.createDataFrame([_task(1, kind="recall_eval", payload='{"session_id": "s", "turn_ordinal": 1}')], TASK), none, r, 100).collect()
    assert len(e) == 1 and e[0]["next_run_at"] == "unix:700" and '"turn_ordinal":2' in e[0]["payload_json"]


def test_due_windows(spark):
    t = spark.createDataFrame([("a", i, "completed") for i in range(4)] + [("b", 0, "completed")], "session_id string, ordinal long, status string")
    assert sorted(r["ordinal"] for r in turns.due_windows(t, 3).collect()) == [1, 2, 3]


def test_blocks_of_queries(spark, monkeypatch):
    """Queries sent to all tasks, and blocks of queries and vectors: the same rows."""
    import random

    from memlake.functions import vectors as vx

    monkeypatch.setattr(vx, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vx, "VECTOR_BLOCK", 20)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3 + i % 2)]) for i in range(120)] + [(200, None), (201, []), (202, [0.0] * 3), (203, [1.0, 0.0, 0.0]), (203, [1.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    q = v.where("id % 10 = 0 OR id > 199").select(F.col("id").alias("query_id"), "v")
    for f in (lambda limit: vx.search(v, q, "id", "v", 4, 0.2, limit=limit), lambda limit: vx.count_over(v, q, "id", "v", 0.2, limit=limit)):
        one, many = (sorted(map(tuple, f(limit).collect())) for limit in (1 << 30, -1))
        assert len(one) == len(many) > 5 and all(a[:2] == b[:2] and abs(a[-1] - b[-1]) < 1e-12 for a, b in zip(one, many, strict=True))
    assert vx.search(v, q.where("query_id < 0"), "id", "v", 4, 0.2, limit=-1).count() == 0
