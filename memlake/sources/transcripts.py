"""Transcripts of agent sessions: JSONL files with byte cursors, their lines, and events.

Two dialects: `markers` (explicit start, complete and abort events) and `roles` (user and assistant messages).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.sources import ranges

#: Tasks of one reading at most; beyond, a task takes several ranges.
MOST_TASKS = 20_000


def discover(spark: SparkSession, root: str, cursors: DataFrame | None = None, skip_part: str | None = None) -> DataFrame:
    """(path, modificationTime, length) of the JSONL files under `root` that have no cursor, newest first."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(root).select("path", "modificationTime", "length")
    if skip_part:
        found = found.where(~F.array_contains(F.split("path", "/"), skip_part))
    if cursors is not None:
        found = found.join(cursors.select(F.col("file_path").alias("path")), "path", "left_anti")
    return found.orderBy(F.desc("modificationTime"), F.desc("path"))


def new_ranges(spark: SparkSession, root: str, cursors: DataFrame | None = None, range_bytes: int = ranges.RANGE_BYTES, skip_part: str | None = None) -> DataFrame:
    """(path, base, begin, end): what each file grew by after its cursor, cut into ranges; a cursor past the end is clamped.

    Lengths come from the listing of files, so a file without new bytes is never opened. Files below a folder named `skip_part` are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(root).select("path", "length")
    if skip_part:
        files = files.where(~F.array_contains(F.split("path", "/"), skip_part))
    base = F.lit(0).cast("long")
    if cursors is not None:
        files = files.join(cursors.select(F.col("file_path").alias("path"), F.col("last_byte_offset").alias("_at")), "path", "left")
        base = F.least(F.coalesce("_at", F.lit(0).cast("long")), F.col("length"))
    grown = files.select("path", "length", base.alias("base")).where("length > base")
    cut = grown.select("path", "base", "length", F.explode(F.sequence(F.col("base"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("begin"))
    return cut.select("path", "base", "begin", F.least(F.col("begin") + range_bytes, "length").alias("end"))


def read_lines(spark: SparkSession, root: str, cursors: DataFrame | None = None, range_bytes: int = ranges.RANGE_BYTES, skip_part: str | None = None) -> DataFrame:
    """(path, line_no, line_start, line_end, line) of the complete lines after each file's cursor; line_no is the place of the first byte.

    Each range is a task's work, long files are the work of many; a worker holds a block and a line at a time.
    """
    todo = new_ranges(spark, root, cursors, range_bytes, skip_part)
    n = todo.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base, begin, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = ranges.lines_in(path, begin, end, base)
                while rows := list(islice(found, 2000)):
                    first, last, raw = zip(*rows, strict=True)
                    text = [x.rstrip(b"\r").decode("utf-8", "replace") for x in raw]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(first, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(text)], names=["path", "line_no", "line_start", "line_end", "line"])

    return todo.repartition(max(1, min(n, MOST_TASKS))).mapInArrow(run, "path string, line_no long, line_start long, line_end long, line string")


def with_offsets(files: DataFrame) -> DataFrame:
    """Lines with byte places from rows (path, base, text); what follows the last newline is no line yet."""
    lines = files.select("path", "base", F.posexplode(F.expr("slice(split(text, '\n'), 1, size(split(text, '\n')) - 1)")).alias("line_no", "raw"))
    w = Window.partitionBy("path").orderBy("line_no")
    end = F.col("base") + F.sum(F.octet_length("raw") + 1).over(w)
    return lines.withColumn("line_end", end).select("path", "line_no", (F.col("line_end") - F.octet_length("raw") - 1).alias("line_start"), "line_end", F.regexp_replace("raw", "\r$", "").alias("line"))


def sound_files(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of the files whose complete lines are all JSON, and (path, offset) of the first bad line of each other file."""
    full = lines.where(F.trim("line") != "").withColumn("_bad", F.try_parse_json("line").isNull())
    bad = full.where("_bad").groupBy("path").agg(F.min("line_start").alias("offset"))
    return full.join(bad, "path", "left_anti").drop("_bad"), bad


def _at(path: str) -> Column:
    return F.get_json_object("line", path)


#: Event types that open and close a turn.
STARTS, COMPLETES, ABORTS = ("task_started", "turn_started"), ("task_complete", "turn_complete"), ("task_aborted", "turn_aborted")


def marker_events(lines: DataFrame) -> DataFrame:
    """Columns that segmentation and display need, of the markers dialect."""
    kind = _at("$.payload.type")
    event = _at("$.type") == "event_msg"
    items = F.from_json(_at("$.payload.content"), "array<struct<type:string,text:string,message:string>>")
    message = F.array_join(F.filter(F.transform(items, lambda x: F.trim(F.coalesce(x["text"], x["message"]))), lambda x: x.isNotNull() & (x != "")), "\n")
    said = F.when(event & kind.isin("user_message", "agent_message"), F.trim(_at("$.payload.message")))
    said = said.when((_at("$.type") == "response_item") & (kind == "message"), message)
    said = said.when(kind == "function_call", F.concat(F.lit("tool call: "), _at("$.payload.name")))
    said = said.when(kind == "function_call_output", F.concat(F.lit("tool output: "), F.substring(_at("$.payload.output"), 1, 500)))
    mark = F.when(event & kind.isin(*STARTS), "start").when(event & kind.isin(*COMPLETES), "complete").when(event & kind.isin(*ABORTS), "abort")
    mark = mark.when(_at("$.type") == "session_meta", "meta").when(_at("$.type") == "turn_context", "context").otherwise("other")
    return lines.select(
        "path", "line_no", "line_start", "line_end", mark.alias("mark"), _at("$.payload.turn_id").alias("turn_id"), F.coalesce(_at("$.timestamp"), _at("$.created_at")).alias("observed_at"),
        _at("$.payload.id").alias("meta_id"), _at("$.payload.cwd").alias("cwd"), _at("$.payload.timestamp").alias("meta_at"), F.nullif(said, F.lit("")).alias("said"),
    )


def marker_sessions(events: DataFrame) -> DataFrame:
    """(path, session_id, project_id, started_at): the first session_meta of a file counts; the latest turn_context renames the project."""
    meta = F.col("mark") == "meta"
    first = lambda c: F.min_by(F.when(meta, c), F.when(meta, F.col("line_no")))
    moved = F.max_by(F.col("cwd"), F.when((F.col("mark") == "context") & F.col("cwd").isNotNull(), F.col("line_no")))
    return events.groupBy("path").agg(
        F.coalesce(first(F.col("meta_id")), F.lit("unknown-codex-session")).alias("session_id"),
        F.coalesce(moved, first(F.col("cwd"))).alias("project_id"),
        first(F.coalesce("meta_at", "observed_at")).alias("started_at"),
    )


def marker_turns(events: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Closed turns (path, ordinal, turn_id, status, byte_start, byte_end, observed_at, cwd, display_text) of the markers dialect.

    Each start opens a group and drops an open one; a context opens one if none is open. Lines after the end belong to no
    turn. Ordinals follow the place in the file, from the given base (path, next_ordinal).
    """
    w = Window.partitionBy("path").orderBy("line_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("mark").isin("start", "complete", "abort"), F.struct("line_no", "mark"))
    last = F.last(step, ignorenulls=True).over(before)
    closed = last.isNull() | last["mark"].isin("complete", "abort")
    opens = (F.col("mark") == "start") | ((F.col("mark") == "context") & closed)
    # Of several contexts before an end only the first opens.
    e = events.where(F.col("mark") != "meta").withColumn("_o", opens).withColumn("_era", F.sum(F.col("mark").isin("start", "complete", "abort").cast("int")).over(before))
    first = F.row_number().over(Window.partitionBy("path", "_era", "_o").orderBy("line_no")) == 1
    e = e.withColumn("_g", F.sum((F.col("_o") & ((F.col("mark") == "start") | first)).cast("int")).over(w)).where("_g > 0")
    end = F.min(F.when(F.col("mark").isin("complete", "abort"), F.col("line_no"))).over(Window.partitionBy("path", "_g"))
    e = e.withColumn("_end", end).where(F.col("line_no") <= F.col("_end"))
    parts = F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("line_no", "said"))))
    turns = e.groupBy("path", "_g").agg(
        F.min("line_start").alias("byte_start"), F.max("line_end").alias("byte_end"), F.first_value("turn_id", True).alias("turn_id"),
        F.max_by("mark", "line_no").alias("m"), F.max_by("observed_at", F.when(F.col("observed_at").isNotNull(), F.col("line_no"))).alias("observed_at"),
        F.max_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line_no"))).alias("cwd"), F.array_join(F.transform(parts, lambda p: p["said"]), "\n").alias("t"),
    )
    if base is not None:
        turns = turns.join(base, "path", "left")
    start = F.coalesce("next_ordinal", F.lit(0)) if base is not None else F.lit(0)
    ordinal = F.row_number().over(Window.partitionBy("path").orderBy("byte_start")) - 1 + start
    status = F.when(F.col("m") == "abort", "aborted").otherwise("completed")
    return turns.select("path", ordinal.cast("long").alias("ordinal"), "turn_id", status.alias("status"), "byte_start", "byte_end", "observed_at", "cwd", F.nullif("t", F.lit("")).alias("display_text"))


def next_cursors(lines: DataFrame, events: DataFrame, turns: DataFrame) -> DataFrame:
    """(file_path, last_byte_offset): the end of the last complete line, or the start of a turn still open."""
    ends = lines.groupBy("path").agg(F.max("line_end").alias("done"))
    closed = turns.groupBy("path").agg(F.max("byte_end").alias("closed"))
    opening = events.where(F.col("mark").isin("start", "context")).join(closed, "path", "left").where(F.coalesce(F.col("line_start") >= F.col("closed"), F.lit(True))).groupBy("path").agg(F.max(F.when(F.col("mark") == "start", F.col("line_start"))).alias("s"), F.min("line_start").alias("c"))
    return ends.join(opening, "path", "left").select(F.col("path").alias("file_path"), F.coalesce("s", "c", "done").alias("last_byte_offset"))


def role_events(lines: DataFrame) -> DataFrame:
    """Role, texts and tool marks of the roles dialect, where content is a string or a list."""
    content = F.coalesce(_at("$.content"), _at("$.message.content"))
    items = F.from_json(content, "array<struct<type:string,text:string,name:string,content:string>>")
    listed = content.startswith("[")
    one = lambda x: F.coalesce(x["text"], F.when(x["name"].isNotNull(), F.concat(F.lit("tool: "), x["name"])), F.when(x["content"].isNotNull(), F.concat(F.lit("tool output: "), x["content"])))
    texts = F.when(listed, F.array_compact(F.transform(items, one))).otherwise(F.array_compact(F.array(content)))
    has = lambda kind: F.coalesce(F.exists(items, lambda x: x["type"] == kind), F.lit(False)) & F.coalesce(listed, F.lit(False))
    has_text = F.when(listed, F.exists(items, lambda x: x["text"].isNotNull())).otherwise(content.isNotNull())
    return lines.select(
        "path", "line_no", "line_start", "line_end", F.coalesce(_at("$.role"), _at("$.message.role")).alias("role"), F.coalesce(_at("$.timestamp"), _at("$.created_at")).alias("observed_at"), _at("$.cwd").alias("cwd"),
        texts.alias("texts"), has("tool_result").alias("is_result"), has("tool_use").alias("is_use"), F.coalesce(has_text, F.lit(False)).alias("has_text"),
    )


def role_sessions(events: DataFrame) -> DataFrame:
    """(path, session_id, project_id, started_at): a file's name without its ending is its session; the latest cwd names the project."""
    moved = F.max_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line_no")))
    first = F.min_by("observed_at", F.when(F.col("observed_at").isNotNull(), F.col("line_no")))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^/.]*)?$", 1)
    return events.groupBy("path").agg(moved.alias("project_id"), first.alias("started_at")).withColumn("session_id", stem)


def role_cursors(lines: DataFrame, events: DataFrame, turns: DataFrame) -> DataFrame:
    """(file_path, last_byte_offset) of the roles dialect: the end of the last complete line, or where a turn still open begins."""
    ends = lines.groupBy("path").agg(F.max("line_end").alias("done"))
    closed = turns.groupBy("path").agg(F.max("byte_end").alias("closed"))
    left = events.where(F.col("role").isin("user", "assistant")).join(closed, "path", "left").where(F.coalesce(F.col("line_start") >= F.col("closed"), F.lit(True)))
    opened = left.groupBy("path").agg(F.min("line_start").alias("open"))
    return ends.join(opened, "path", "left").select(F.col("path").alias("file_path"), F.coalesce("open", "done").alias("last_byte_offset"))


def role_turns(events: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Closed turns of the roles dialect: a user message that is no tool result opens one; an answer with text and no tool use closes it.

    Ordinals follow the place in the file, from the given base (path, next_ordinal).
    """
    w = Window.partitionBy("path").orderBy("line_no")
    talk = events.where(F.col("role").isin("user", "assistant"))
    closes = (F.col("role") == "assistant") & F.col("has_text") & ~F.col("is_use")
    after_close = F.coalesce(F.lag(closes).over(w), F.lit(True))
    opens = ((F.col("role") == "user") & ~F.col("is_result")) | after_close
    e = talk.withColumn("_c", closes).withColumn("_g", F.sum(opens.cast("int")).over(w))
    parts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "texts"))), lambda x: x["texts"]))
    turns = e.groupBy("path", "_g").agg(
        F.min("line_start").alias("byte_start"), F.max("line_end").alias("byte_end"), F.bool_or("_c").alias("done"), F.max_by("observed_at", F.when(F.col("observed_at").isNotNull(), F.col("line_no"))).alias("observed_at"),
        F.max_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line_no"))).alias("cwd"), parts.alias("parts"),
    ).where("done")
    if base is not None:
        turns = turns.join(base, "path", "left")
    start = F.coalesce("next_ordinal", F.lit(0)) if base is not None else F.lit(0)
    ordinal = (F.row_number().over(Window.partitionBy("path").orderBy("byte_start")) - 1 + start).cast("long")
    return turns.select("path", ordinal.alias("ordinal"), F.lit(None).cast("string").alias("turn_id"), F.lit("completed").alias("status"), "byte_start", "byte_end", "observed_at", "cwd", F.when(F.size("parts") > 0, F.array_join("parts", "\n")).alias("display_text"))


def hydrate(turns: DataFrame, sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Fills missing display_text and cwd of turns from the bytes they name; what is there stays.

    files: (path, content). A missing file leaves a turn as it is.
    """
    need = turns.join(sessions.select(F.col("id").alias("session_id"), F.col("transcript_file_path").alias("path")), "session_id", "left")
    cut = need.join(files, "path", "left").withColumn("text", F.expr("cast(substring(content, int(byte_start) + 1, int(byte_end - byte_start)) as string)"))
    lines = cut.where("text IS NOT NULL AND (display_text IS NULL OR cwd IS NULL)").select(F.concat_ws("\u0001", "session_id", F.col("ordinal").cast("string")).alias("path"), F.lit(0).cast("long").alias("base"), "text")
    e = marker_events(with_offsets(lines))
    parts = F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("line_no", "said"))))
    found = e.groupBy(F.col("path").alias("_k")).agg(F.nullif(F.array_join(F.transform(parts, lambda p: p["said"]), "\n"), F.lit("")).alias("_t"), F.max_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line_no"))).alias("_c"))
    key = F.concat_ws("\u0001", "session_id", F.col("ordinal").cast("string"))
    return turns.join(found, key == F.col("_k"), "left").withColumn("display_text", F.coalesce("display_text", "_t")).withColumn("cwd", F.coalesce("cwd", "_c")).drop("_k", "_t", "_c")
