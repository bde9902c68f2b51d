import json

from pyspark.sql import functions as F

from memlake.engine import Engine
from memlake.providers import CannedCompleter
from memlake.sources import transcripts as tr


def ev(kind, at="2024-01-01T00:00:00Z", **payload):
    return json.dumps({"timestamp": at, "type": kind, "payload": payload})


def turn(i, end="task_complete"):
    return [ev("event_msg", type="task_started", turn_id=f"t{i}"), ev("event_msg", type="user_message", message=f"ask {i} about QX-{i}"), ev("event_msg", type=end)]


META = ev("session_meta", id="s1", cwd="/work/proj")


def put(path, lines, partial=""):
    path.write_text("".join(x + "\n" for x in lines) + partial)


def parse(spark, root):
    lines, bad = tr.sound_files(tr.read_lines(spark, f"file://{root}"))
    return tr.marker_events(lines), lines, bad


def test_segments_and_offsets(spark, tmp_path):
    body = [META, *turn(0), *turn(1, "task_aborted"), ev("other", type="x"), ev("event_msg", type="task_started"), *turn(2)]
    put(tmp_path / "a.jsonl", body, '{"cut')
    e, lines, bad = parse(spark, tmp_path)
    got = tr.marker_turns(e).orderBy("ordinal").collect()
    assert [(t["ordinal"], t["turn_id"], t["status"]) for t in got] == [(0, "t0", "completed"), (1, "t1", "aborted"), (2, "t2", "completed")]
    raw = (tmp_path / "a.jsonl").read_bytes()
    assert raw[got[0]["byte_start"] : got[0]["byte_end"]].decode().splitlines() == body[1:4]
    assert got[0]["display_text"] == "ask 0 about QX-0" and bad.count() == 0
    s = tr.marker_sessions(e).first()
    assert (s["session_id"], s["project_id"]) == ("s1", "/work/proj")


def test_bad_line_stops_its_file_only(spark, tmp_path):
    put(tmp_path / "a.jsonl", [META, "{nope", *turn(0)])
    put(tmp_path / "b.jsonl", [META, *turn(0)])
    e, _, bad = parse(spark, tmp_path)
    assert tr.marker_turns(e).count() == 1 and bad.first()["offset"] == len(META) + 1


def test_roles_dialect(spark, tmp_path):
    m = lambda role, content: json.dumps({"timestamp": "2024-01-01T00:00:00Z", "message": {"role": role, "content": content}})
    put(tmp_path / "a.jsonl", [m("user", "hi"), m("assistant", [{"type": "tool_use", "name": "ls"}]), m("user", [{"type": "tool_result", "content": "out"}]), m("assistant", [{"type": "text", "text": "done"}]), m("user", "open")])
    lines = tr.read_lines(spark, f"file://{tmp_path}")
    got = tr.role_turns(tr.role_events(lines)).collect()
    assert len(got) == 1 and got[0]["display_text"] == "hi\ntool: ls\ntool output: out\ndone"


def test_engine(spark, tmp_path):
    src, root = tmp_path / "in", tmp_path / "store"
    src.mkdir()
    put(src / "a.jsonl", [META, *turn(0), ev("event_msg", type="task_started", turn_id="t1")])
    reply = {"memories": [{"title": "Build rule", "body": "Always run the build for QX-7 first"}, {"title": "Other", "body": "A quite different matter"}]}
    e = Engine(spark, f"file://{root}", completer=CannedCompleter(reply))
    r = e.ingest(f"file://{src}").first()
    assert (r["files"], r["failures"], r["new_turns"]) == (1, 0, 1)
    put(src / "a.jsonl", [META, *turn(0), *turn(1)])
    assert e.ingest(f"file://{src}").first()["new_turns"] == 1  # the open turn was held back
    assert e.ingest(f"file://{src}").first()["new_turns"] == 0
    assert [t["ordinal"] for t in e.store.read("turns").orderBy("ordinal").collect()] == [0, 1]
    assert e.queue_formulation() == 1 and e.queue_formulation() == 0
    assert e.formulate(["s1"]) == 2
    assert e.queue_formulation() == 0
    i = e.remember("Build rule", "Always run the build for QX-7 first")
    assert i == 3 and e.dedupe() in (0, 1)
    got = e.recall("the build for QX-7", "/work/proj").collect()
    assert got and got[0]["title"] == "Build rule" and got[0]["reason"].startswith("keep")
    s = e.status().first()
    assert (s["memories"], s["turns"], s["sessions"]) == (3, 2, 1)
    assert e.eval_recall().count() >= 2
    assert e.recall_for_turn("s1", 1).count() >= 0
    anchor = spark.createDataFrame([("s1", 1)], "session_id string, turn_ordinal long")
    e.queue_recalls(anchor)
    e.queue_recalls(anchor)
    assert e.store.read("tasks").where("kind = 'recall'").count() == 1
    e.store.write("tasks", e.store.read("tasks").withColumn("payload_json", F.when(F.col("kind") == "memory_formulation", "{").otherwise(F.col("payload_json"))))
    assert e.run_tasks(5) == 2  # the recall, and the task whose payload is broken
    assert sorted(r["status"] for r in e.store.read("tasks").collect()) == ["completed", "parked"]
    assert e.schedule_consolidation() and not e.schedule_consolidation() and e.queue_stale_evals() == 0
    assert e.memories_rebuild(yes=True) >= 1


def test_hydration(spark, tmp_path):
    body = [META, *turn(0)]
    put(tmp_path / "a.jsonl", body)
    lines, _ = tr.sound_files(tr.read_lines(spark, f"file://{tmp_path}"))
    t = tr.marker_turns(tr.marker_events(lines)).first()
    path = f"file:{tmp_path}/a.jsonl"
    turns_ = spark.createDataFrame([("s1", 0, t["byte_start"], t["byte_end"], None, None), ("s1", 1, 0, 0, "kept", "/x"), ("s2", 0, 0, 9, None, None)], "session_id string, ordinal long, byte_start long, byte_end long, display_text string, cwd string")
    sessions = spark.createDataFrame([("s1", path), ("s2", "gone")], "id string, transcript_file_path string")
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}").select("path", "content")
    got = {(r["session_id"], r["ordinal"]): r["display_text"] for r in tr.hydrate(turns_, sessions, files).collect()}
    assert got == {("s1", 0): "ask 0 about QX-0", ("s1", 1): "kept", ("s2", 0): None}


def test_consolidate(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}", completer=CannedCompleter('Merged: {"title": "One build rule", "body": "Run the build first"}'))
    for x in ("alpha", "beta", "gamma"):
        e.remember("Build rule for all", f"Always run the whole build before a commit {x}", "global")
    e.remember("Far away", "Nothing to do with it at all", "global")
    i = e.consolidate()
    m = {r["id"]: r for r in e.store.read("memories").collect()}
    assert i == 5 and sorted(m[5]["lineage_refs"]) == [1, 2, 3] and m[5]["project_id"] is None
    assert [m[k]["is_active"] for k in (1, 2, 3, 4, 5)] == [False, False, False, True, True]
