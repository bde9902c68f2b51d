"""The chain from recall to file, delayed evaluation and statistics; both dialects; batches."""

import json

from memlake.config import expand_home
from memlake.engine import Engine
from memlake.providers import CannedCompleter


def _say(role, text, **more):
    return json.dumps({"role": role, "content": text, "cwd": "/work/kelp", "timestamp": "2024-01-01T00:00:00Z", **more})


def _write(path, *lines):
    path.write_text("\n".join(lines) + "\n")


def test_chain(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    talk = [x for i in range(3) for x in (_say("user", f"how do tides in kelp bay {i} move"), _say("assistant", f"slowly, case {i}"))]
    _write(src / "sea.jsonl", *talk[:4], talk[4])
    e = Engine(spark, f"file://{tmp_path}/store", completer=CannedCompleter({"score": 5, "rationale": "it helped"}), evaluate=True)
    assert e.ingest(f"file://{src}", "roles").first()["new_turns"] == 2  # the third is still open
    s = e.store.read("sessions").first()
    assert (s["id"], s["agent_type"], s["project_id"]) == ("sea", "claude-code", "/work/kelp")
    i = e.remember("Tides in kelp bay", "how tides in kelp bay move slowly", "project", "/work/kelp")
    anchor = spark.createDataFrame([("sea", 1)], "session_id string, turn_ordinal long")
    e.queue_recalls(anchor)
    assert e.run_tasks(1) == 1
    text = e.store.get_text(e.recall_name("sea"))
    assert f"memory_ids: {i}" in text and e.write_recall("sea", 1) == ("unchanged", [i]) and e.read_recall("sea") == text
    queued = e.store.read("tasks").where("kind = 'recall_eval'").collect()
    assert len(queued) == 1 and queued[0]["status"] == "queued" and json.loads(queued[0]["payload_json"])["memory_ids"] == [i]
    soon = 4_000_000_000  # the session counts as idle by then
    _write(src / "sea.jsonl", *talk)
    assert e.ingest(f"file://{src}", "roles").first()["new_turns"] == 1
    assert sorted(t["ordinal"] for t in e.store.read("turns").collect()) == [0, 1, 2]
    assert e.run_tasks(1, now=soon) == 1
    run = e.store.read("eval_runs").first()
    got = e.eval_show(run["id"]).collect()
    assert run["completed_at"] and run["strategy"] == "delayed" and [(r["memory_id"], r["judge_score"], r["title"]) for r in got] == [(i, "5", "Tides in kelp bay")]
    r = e.stats().first()
    assert (r["eligible_turns"], r["recall_runs"], r["nonempty_runs"], r["good_results"], r["useful_runs"], r["p50"]) == (3, 1, 1, 1, 1, 1)
    e.store.write("memories", e.store.read("memories").selectExpr(*[c if c != "is_active" else "false AS is_active" for c in e.store.read("memories").columns]))
    assert e.read_recall("sea") is None  # its memory is inactive, and nothing else is found
    assert e.config_effective().where("name = 'recall_result_limit'").first()["value"] == "5" and e.path().endswith("/store")


def test_evaluation_waits(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    payload = json.dumps({"session_id": "none", "turn_ordinal": 0, "recall_text": "text", "memory_ids": []})
    from memlake.operators import tasks

    e._queue(tasks.new_tasks(spark.createDataFrame([(payload,)], "payload_json string"), "recall_eval", 0, "unix:1"))
    assert e.run_tasks(1, now=1000) == 1
    t = sorted(e.store.read("tasks").collect(), key=lambda r: r["id"])
    assert [(r["status"], r["next_run_at"]) for r in t] == [("completed", None), ("queued", "unix:1060")] and t[1]["attempts"] == 1
    assert e.eval_targets(json.loads(payload)).collect()[0]["text"] == "text" and e.store.read("eval_runs").isEmpty()


def test_batches_are_formulated_apart(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    _write(src / "a.jsonl", *[x for i in range(4) for x in (_say("user", f"question {i}"), _say("assistant", f"answer {i}"))])
    e = Engine(spark, f"file://{tmp_path}/store", completer=CannedCompleter({"memories": [{"title": "One", "body": "A fact"}]}))
    e.ingest(f"file://{src}", "roles")
    assert e.formulate(["a"], 1, 3) == 1
    refs = e.store.read("memories").first()["source_turn_refs"]
    assert [r["ordinal"] for r in refs] == [1, 2]


def test_home():
    assert [expand_home(p, "/h") for p in ("~", "~/a/b", "~x/a", "/~", "a")] == ["/h", "/h/a/b", "~x/a", "/~", "a"]
