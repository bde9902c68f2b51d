"""What summaries show: examples, runs to look at again, queued evaluations; the judge of recalls and what is stored of it; sessions and keys as read."""

import json

import pytest

from memlake.config import Config, load
from memlake.engine import Engine
from memlake.operators import evals, pipelines, recall, state
from memlake.providers import CannedCompleter


def test_examples_and_stale_runs(spark):
    runs = spark.createDataFrame([(i, f"s{i % 2}", i % 3) for i in range(1, 9)] + [(9, None, None)], "id long, session_id string, turn_ordinal long")
    scores = ["1", "5", "insufficient_context", "3", None, "2", "4", "insufficient_context"]
    res = spark.createDataFrame([(j, i, j, scores[(i + j) % 8], "why") for i in range(1, 10) for j in range(3 * i, 3 * i + 3)], "id long, eval_run_id long, memory_id long, judge_score string, rationale string")
    rows = sorted(((r["eval_run_id"], r["id"], r["judge_score"]) for r in res.collect()), key=lambda x: (-x[0], x[1]))
    got = evals.score_examples(runs, res).collect()
    for kind, own in (("low", ("1", "2")), ("high", ("4", "5"))):
        assert [(r["run_id"], r["memory_id"]) for r in got if r["kind"] == kind] == [(a, b) for a, b, s in rows if s in own][:5]
    turns = spark.createDataFrame([(f"s{i % 2}", i // 2, "completed" if i % 5 else "aborted") for i in range(9)], "session_id string, ordinal long, status string")
    done = [(r["session_id"], r["ordinal"]) for r in turns.where("status = 'completed'").collect()]
    at = {r["id"]: (r["session_id"], r["turn_ordinal"]) for r in runs.where("session_id IS NOT NULL").collect()}
    later = {i: sum(x == s and o > n for x, o in done) for i, (s, n) in at.items()}
    anchors = runs.withColumnRenamed("id", "run_id")
    assert {r["run_id"]: r["later_completed_turns"] for r in evals.later_counts(anchors, turns).collect()} == later
    assert {r["later_completed_turns"] for r in evals.later_counts(anchors, turns, 2).collect()} <= {0, 1, 2}
    short = {a for a, _, s in rows if s == "insufficient_context"}
    want = sorted((i for i in short & set(later) if later[i]), reverse=True)
    assert want and [r["run_id"] for r in evals.stale_insufficient(runs, res, turns).collect()] == want
    assert evals.stale_insufficient(runs.limit(0), res.limit(0), turns.limit(0)).isEmpty() and evals.score_examples(runs.limit(0), res).isEmpty()


def test_verdicts(spark):
    said = ['{"selected_memory_ids": [2, "3", 2, "x", null]}', 'so: {"selected_memory_ids": []} ok', "{}", "no", None]
    got = {r["query_id"]: (r["ids"], r["error"]) for r in pipelines.filter_verdicts(spark.createDataFrame(list(enumerate(said)), "query_id long, reply string")).collect()}
    assert got == {0: ([2, 3], None), 1: ([], None), 2: ([], None), 3: (None, "the reply holds no JSON"), 4: (None, "the call failed")}


def _engine(spark, path, judge, **settings):
    e = Engine(spark, f"file://{path}/store", judge=judge, config=Config(**settings), evaluate=True)
    for place in ("kelp bay", "kelp bay north", "kelp bay south"):
        e.remember(f"Tides in {place}", f"how tides in {place} move", "project", "/work/kelp")
    return e


def test_judge_filters_and_is_told(spark, tmp_path):
    e = _engine(spark, tmp_path, CannedCompleter({"selected_memory_ids": [2, 99]}))
    final, told = e.recall_run("how tides in kelp bay move", "/work/kelp")
    assert [(r["memory_id"], r["judge_reason"], r["place"]) for r in final.collect()] == [(2, "keep:llm_semantic_filter", 1)]
    t = told.first()
    assert (t["candidate_count"], t["final_selected_count"], t["llm_attempted"], t["llm_applied"], t["llm_error"]) == (3, 1, True, True, None)
    e.judge = CannedCompleter("nothing to read")
    final, told = e.recall_run("how tides in kelp bay move", "/work/kelp")
    assert final.count() == 3 and told.first()["llm_error"] == "the reply holds no JSON"
    e.judge = None
    assert e.recall_run("how tides in kelp bay move", "/work/kelp")[1].first()["llm_attempted"] is False
    one = e.store.read("memories").where("id = 2").first()
    assert one["project_descriptor"] == "kelp"


def test_telemetry_is_stored(spark, tmp_path):
    e = _engine(spark, tmp_path, CannedCompleter({"selected_memory_ids": [1]}))
    t = spark.createDataFrame([(1, "s", "t0", 0, 0, 9, "unix:1", "completed", "how tides in kelp bay move", "/work/kelp")], e.store.read("turns").schema)
    e.store.write("turns", t)
    e.store.write("sessions", spark.createDataFrame([("s", "roles", "/work/kelp", "gone", None, "unix:1"), ("r", "roles", "/work/kelp", "gone", "unix:9", None)], e.store.read("sessions").schema))
    assert e.session("/work/kelp").first()["id"] == "r" and e.session("/work/kelp", "s").first()["id"] == "s" and e.session("/x").isEmpty()
    e.queue_recalls(spark.createDataFrame([("s", 0)], "session_id string, turn_ordinal long"))
    assert e.run_tasks(1) == 1
    told = json.loads(e.store.read("tasks").where("kind = 'recall_eval'").first()["payload_json"])["filter_telemetry"]
    assert (told["candidate_count"], told["final_selected_count"], told["llm_applied"], told["llm_empty_fallback"]) == (3, 1, True, False)
    assert e.eval_queued().first()["turn_ordinal"] == 0
    assert e.run_tasks(1, now=4_000_000_000) == 1  # no later turn, and the session counts as idle by then
    s = e.stats().first()
    assert (s["attempted"], s["applied"], s["fallback"], s["errors"], s["avg_candidates"], s["avg_dropped"]) == (1, 1, 0, 0, 3.0, 2.0)
    assert e.eval_stale().isEmpty()
    e.store.write("turns", t.unionByName(t.selectExpr(*[{"id": "2L AS id", "ordinal": "1L AS ordinal"}.get(c, c) for c in t.columns])))
    assert [(r["run_id"], r["later_completed_turns"]) for r in e.eval_stale().collect()] == [(1, 1)]


def test_read_rules(spark, tmp_path):
    m = spark.createDataFrame([("Fix ABC-12", "now", None), ("Fix ABC-12", "now", []), ("Fix ABC-12", "now", ["own"])], "title string, body string, task_keys array<string>")
    got = [r["task_keys"] for r in state.with_task_keys(m).collect()]
    assert got[0] == got[1] and got[0] and got[2] == ["own"]
    e = Engine(spark, f"file://{tmp_path}/store")
    assert e.ingest(f"file://{tmp_path}/none").first()["files"] == 0
    with pytest.raises(FileNotFoundError):
        e.ingest(f"file://{tmp_path}/none", "roles")
    line = lambda role: json.dumps({"role": role, "content": "x", "cwd": "/w", "timestamp": "2024-01-01T00:00:00Z"})
    for part in ("in", "in/subagents"):
        (tmp_path / part).mkdir()
        (tmp_path / part / "a.jsonl").write_text(line("user") + "\n" + line("assistant") + "\n")
    assert e.ingest(f"file://{tmp_path}/in", "roles").first()["files"] == 1
    assert recall.Options().limit == load("~/no/such/file").recall_result_limit
