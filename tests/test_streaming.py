import json
import random
import time

import pytest
from test_transcripts import META, ev, put, turn

from memlake.operators.state import Store
from memlake.sources import transcripts as tr
from memlake.sources.ranges import complete_end, lines_in, listing
from memlake.streaming.turns import RoleAssembly, store_turns, stream_lines, turn_stream


def test_partial_line_waits(tmp_path):
    p = tmp_path / "x"
    p.write_bytes(b"ab\ncd\nef")
    assert complete_end(str(p), 0) == 6 and complete_end(str(p), 6) == 6 and complete_end(str(p), 0, 1) == 6


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    first = [META, *turn(0), ev("event_msg", type="task_started", turn_id="t1")]
    put(src / "a.jsonl", first, turn(1)[1][:10])
    store = Store(spark, f"file://{tmp_path}/store")

    def drain():
        q = turn_stream(stream_lines(spark, str(src))).writeStream.option("checkpointLocation", f"file://{tmp_path}/cp").foreachBatch(store_turns(store)).outputMode("append").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    drain()
    assert store.read("turns").count() == 1
    put(src / "a.jsonl", [META, *turn(0), *turn(1), *turn(2)])
    drain()
    lines, _ = tr.sound_files(tr.read_lines(spark, f"file://{src}"))
    batch = tr.marker_turns(tr.marker_events(lines))
    cols = ["ordinal", "turn_id", "status", "byte_start", "byte_end", "display_text"]
    assert sorted(map(tuple, store.read("turns").select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))


def test_ranges_own_the_lines_that_begin_in_them(tmp_path):
    rng = random.Random(1)
    data = b"".join(bytes(rng.choice(b"ab\r") for _ in range(rng.choice([0, 1, 5, 60]))) + b"\n" for _ in range(80)) + b"rest"
    (tmp_path / "f.jsonl").write_bytes(data)
    path = str(tmp_path / "f.jsonl")
    whole = list(lines_in(path, 0, len(data)))
    assert b"".join(x + b"\n" for *_, x in whole) + b"rest" == data and [e - b - 1 for b, e, _ in whole] == [len(x) for *_, x in whole]
    for size in (1, 3, 17, 1000):
        assert [x for at in range(0, len(data), size) for x in lines_in(path, at, min(at + size, len(data)), block=7)] == whole
    base = whole[30][0]
    assert [x for at in range(base, len(data), 11) for x in lines_in(path, at, at + 11, base)] == whole[30:]
    assert list(listing(f"file://{tmp_path}")) == [(f"file://{tmp_path}/f.jsonl", len(data))]
    with pytest.raises(FileNotFoundError):
        list(listing(str(tmp_path / "none")))


def test_only_new_bytes_are_read(spark, tmp_path):
    """A file without new bytes has no range; a long one has many, and its lines are those of one range."""
    put(tmp_path / "old.jsonl", [META, *turn(0)])
    put(tmp_path / "new.jsonl", [META, *turn(0), *turn(1), *turn(2)])
    old, new = (f"file:{tmp_path}/{x}.jsonl" for x in ("old", "new"))
    first = tr.read_lines(spark, f"file://{tmp_path}").where(f"path = '{new}'").orderBy("line_start").collect()
    cursors = spark.createDataFrame([(old, (tmp_path / "old.jsonl").stat().st_size), (new, first[1]["line_start"])], "file_path string, last_byte_offset long")
    cut = tr.new_ranges(spark, f"file://{tmp_path}", cursors, 40).collect()
    assert {r["path"] for r in cut} == {new} and len(cut) > 5
    got = tr.read_lines(spark, f"file://{tmp_path}", cursors, 40)
    assert [tuple(r) for r in got.orderBy("line_start").collect()] == [tuple(r) for r in first[1:]] and got.rdd.getNumPartitions() == len(cut)


def _role_lines(n):
    out = []
    for i in range(n):
        out += [{"role": "user", "content": f"ask {i}", "timestamp": f"t{i}", "cwd": "/w"}, {"message": {"role": "assistant", "content": [{"type": "tool_use", "name": "run"}, {"type": "text", "text": "try"}]}}]
        out += [{"role": "user", "content": [{"type": "tool_result", "content": "out"}]}, {"role": "system", "content": "x"}, {"role": "assistant", "content": [{"type": "text", "text": f"done {i}"}]}]
    return [json.dumps(x) for x in out]


def test_roles_stream_in_pieces(spark, tmp_path):
    """Lines come in pieces, across restarts; turns are the batch's. Ranges of 50 bytes deal one file to many tasks."""
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    src.mkdir()
    text = "\n".join(_role_lines(4)) + "\n"
    for cut in (30, 333, 700, len(text)):
        (src / "s.jsonl").write_text(text[:cut])
        q = turn_stream(stream_lines(spark, str(src), rangeBytes="50"), "roles").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/cp").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    batch = tr.role_turns(tr.role_events(tr.read_lines(spark, f"file://{src}")))
    cols = ["ordinal", "status", "byte_start", "byte_end", "observed_at", "cwd", "display_text"]
    got = spark.read.parquet(out)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect())) and got.count() == 4 and got.first()["session_id"] == "s"


def test_role_assembly_keeps_what_it_knows():
    """State through JSON after each line gives what one run gives."""
    lines, state, got = _role_lines(3), None, []
    whole = RoleAssembly()
    for i, line in enumerate(lines):
        a = RoleAssembly(json.loads(state) if state else None)
        got.append((a.feed("p/x.jsonl", i, i + 1, line), whole.feed("p/x.jsonl", i, i + 1, line)))
        state = json.dumps(a.state)
    assert all(a == b for a, b in got) and sum(a is not None for a, _ in got) == 3


def test_idle_files_are_flushed(spark, tmp_path):
    """A full window is announced at once, a rest when the file has been idle."""
    src = tmp_path / "in"
    src.mkdir()
    put(src / "a.jsonl", [META, *turn(0), *turn(1), *turn(2)])
    rows = []
    q = turn_stream(stream_lines(spark, str(src)), idle_seconds=1, window=2).writeStream.foreachBatch(lambda b, _: rows.extend(b.collect())).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while time.time() < until and sum(r["status"] == "flush" for r in rows) < 2:
            time.sleep(0.5)
    finally:
        q.stop()
    assert sorted((r["ordinal"], r["pending"]) for r in rows if r["status"] == "flush") == [(0, 2), (2, 1)]
    assert sorted(r["ordinal"] for r in rows if r["status"] != "flush") == [0, 1, 2]


def test_small_files_share_tasks(tmp_path):
    """Many small files are few tasks, all ranges are there once, and a long file is still cut."""
    from memlake.streaming import source

    for i in range(300):
        (tmp_path / f"s{i}.jsonl").write_text(f'{{"i": {i}}}\n' * 2 + "rest")
    (tmp_path / "long.jsonl").write_text("x" * 99 + "\n" + '{"k": 1}\n' * 300_000)
    reader = source._Reader(str(tmp_path), ".jsonl", 1 << 20)
    start, end = reader.initialOffset(), reader.latestOffset()
    parts = reader.partitions(start, end)
    dealt = [r for p in parts for r in p.ranges]
    assert len(parts) < 100 and len(dealt) == len(set(dealt)) == 300 + 3
    lines = [x for p in parts for x in reader.read(p)]
    assert len(lines) == 300 * 2 + 300_001 and len({x[:2] for x in lines}) == len(lines)
    assert reader.partitions(end, reader.latestOffset())[0].ranges == []
