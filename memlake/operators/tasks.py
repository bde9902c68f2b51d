"""The task queue: due selection, transitions, and the rules that queue work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import display_status, epoch_seconds
from memlake.providers import RETRY_STATUSES

#: Priorities and attempts by kind of work.
PRIORITY = {"live_formulation": 10, "recall": 20, "backlog": 0, "consolidation": -10}
MAX_ATTEMPTS, MAX_CONSOLIDATION_ATTEMPTS = 5, 20
EVAL_DELAY, DEFER_ANCHOR, DEFER_TURNS = 600, 60, 600


def due(now: int) -> Column:
    """Queued, and without a run time, or with one that is no `unix:` time, or with one that has come."""
    at = F.col("next_run_at")
    seconds = F.coalesce(F.regexp_extract(F.substring(at, 6, 40), r"^[+-]?\d+", 0).try_cast("long"), F.lit(0))
    return (F.col("status") == "queued") & (at.isNull() | ~F.ilike(at, F.lit("unix:%")) | (seconds <= now))


def next_due(tasks: DataFrame, now: int, n: int = 1) -> DataFrame:
    return tasks.where(due(now)).orderBy(F.desc("priority"), "id").limit(n)


def by_display_status(tasks: DataFrame, now: int, status: str | None, n: int) -> DataFrame:
    shown = tasks.withColumn("display_status", display_status(F.col("status"), F.col("next_run_at"), now))
    return (shown if status is None else shown.where(F.col("display_status") == status)).orderBy(F.desc("id")).limit(n)


def enqueue(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """New tasks whose (kind, payload) no task has yet."""
    return new.dropDuplicates(["kind", "payload_json"]).join(tasks.select("kind", "payload_json").distinct(), ["kind", "payload_json"], "left_anti")


def transition(tasks: DataFrame, which: Column, change: str, now: str, error: str | None = None) -> DataFrame:
    """running, completed, parked, retried or requeued rows where `which` holds and the change is allowed."""
    ok = {"retried": F.col("status").isin("queued", "running", "parked"), "requeued": F.col("status") == "running"}.get(change, F.lit(True))
    hit = which & ok
    put = lambda c, v: F.when(hit, v).otherwise(F.col(c))
    status = {"retried": "queued", "requeued": "queued"}.get(change, change)
    out = {"status": put("status", F.lit(status)), "updated_at": put("updated_at", F.lit(now))}
    none = F.lit(None).cast("string")
    if change == "retried":
        out |= {"attempts": put("attempts", F.lit(0).cast("long")), "next_run_at": put("next_run_at", none), "last_error": put("last_error", none)}
    if change == "running":
        out |= {"attempts": put("attempts", F.col("attempts") + 1)}
    if change == "parked":
        out |= {"last_error": put("last_error", F.lit(error))}
    return tasks.withColumns(out)


def clear(tasks: DataFrame, now: int, status: str, kind: str | None = None) -> DataFrame:
    """Tasks without those of a display status (and kind); an unknown status clears none."""
    gone = display_status(F.col("status"), F.col("next_run_at"), now) == status
    return tasks.where(~(gone & (F.col("kind") == kind) if kind else gone))


def recent_failures(tasks: DataFrame, n: int = 5) -> DataFrame:
    return tasks.where("last_error IS NOT NULL").orderBy(F.desc("updated_at"), F.desc("id")).limit(n)


def anchors(tasks: DataFrame) -> DataFrame:
    """(id, kind, status, session_id, turn_ordinal) of tasks whose payload names an anchor."""
    p = F.col("payload_json")
    return tasks.select("id", "kind", "status", F.get_json_object(p, "$.session_id").alias("session_id"), F.get_json_object(p, "$.turn_ordinal").try_cast("long").alias("turn_ordinal")).where("session_id IS NOT NULL AND turn_ordinal IS NOT NULL")


def formulation_tasks(lots: DataFrame, priority: int, now: str) -> DataFrame:
    """Tasks for batches (session_id, first, last, refs of structs)."""
    payload = F.to_json(F.struct("session_id", F.col("first").alias("start_ordinal"), (F.col("last") + 1).alias("end_ordinal"), F.col("refs").alias("source_turn_refs")))
    none = F.lit(None).cast("string")
    return lots.select(F.lit("memory_formulation").alias("kind"), F.lit("queued").alias("status"), F.lit(priority).cast("long").alias("priority"), payload.alias("payload_json"), F.lit(0).cast("long").alias("attempts"), F.lit(MAX_ATTEMPTS).cast("long").alias("max_attempts"), none.alias("next_run_at"), none.alias("last_error"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))


def consolidation_due(memories: DataFrame, tasks: DataFrame, dark_seconds: int) -> DataFrame:
    """(due_at): when consolidation may run; no row if one is under way, or the last one saw the latest memory."""
    last = memories.where("is_active").agg(F.max_by("created_at", "id").alias("latest"))
    own = tasks.where("kind = 'memory_consolidation'")
    seen = own.agg(F.count_if(F.col("status").isin("queued", "running", "parked")).alias("open"), F.max_by("updated_at", F.when(F.col("status") == "completed", F.col("id"))).alias("done"))
    row = last.join(F.broadcast(seen))
    at = epoch_seconds(F.col("latest"))
    fresh = F.col("done").isNull() | (epoch_seconds(F.col("done")) < at)
    return row.where((F.col("open") == 0) & F.col("latest").isNotNull() & F.coalesce(fresh, F.lit(True))).select((at + dark_seconds).alias("due_at"))


def eval_state(evals: DataFrame, turns: DataFrame, idle_after: int, now: int) -> DataFrame:
    """What becomes of each recall_eval task (session_id, turn_ordinal, attempts, max_attempts, last_seen_at).

    defer_anchor: its turn isn't there yet. defer_turns: no later turn, the session still active, attempts left. score: later
    turns are there. insufficient_context: neither.
    """
    t = turns.where("status = 'completed'").select(F.col("session_id").alias("s"), "ordinal")
    met = evals.join(t, F.col("session_id") == F.col("s"), "left").groupBy(*evals.columns).agg(F.coalesce(F.bool_or(F.col("ordinal") == F.col("turn_ordinal")), F.lit(False)).alias("has_anchor"), F.count_if(F.col("ordinal") > F.col("turn_ordinal")).alias("later"))
    seen = epoch_seconds(F.col("last_seen_at"))
    idle = F.col("last_seen_at").isNull() | F.coalesce(F.lit(now) - seen >= idle_after, F.lit(False))
    left = F.col("attempts") < F.col("max_attempts")
    return met.withColumn("state", F.when(~F.col("has_anchor"), "defer_anchor").when(F.col("later") > 0, "score").when(~idle & left, "defer_turns").otherwise("insufficient_context"))


def stale_evals(runs: DataFrame, results: DataFrame, turns: DataFrame, last: int = 200, limit: int = 10) -> DataFrame:
    """Runs to be evaluated again: of the last ones, those scored insufficient_context alone, not reruns nor rerun yet, with a later turn now."""
    recent = runs.orderBy(F.desc("id")).limit(last)
    c = F.col("config_json")
    recent = recent.select("id", F.get_json_object(c, "$.session_id").alias("session_id"), F.get_json_object(c, "$.turn_ordinal").try_cast("long").alias("turn_ordinal"), F.get_json_object(c, "$.rerun_for_eval_run_id").try_cast("long").alias("rerun_for"))
    scores = results.groupBy(F.col("eval_run_id").alias("id")).agg(F.collect_set("judge_score").alias("s")).where(F.col("s") == F.array(F.lit("insufficient_context")))
    rerun = recent.where("rerun_for IS NOT NULL").select(F.col("rerun_for").alias("id"))
    later = turns.where("status = 'completed'").groupBy("session_id").agg(F.max("ordinal").alias("top"))
    return recent.where("rerun_for IS NULL").join(scores.select("id"), "id", "left_semi").join(rerun, "id", "left_anti").join(later, "session_id").where("top > turn_ordinal").orderBy(F.desc("id")).limit(limit)


def first_per_anchor(rows: DataFrame) -> DataFrame:
    """Of each anchor the row with the largest id."""
    r = F.row_number().over(Window.partitionBy("session_id", "turn_ordinal").orderBy(F.desc("id")))
    return rows.withColumn("_r", r).where("_r = 1").drop("_r")


def retry_class(status: Column) -> Column:
    """Whether an HTTP status is worth another try."""
    return F.when(status.isin(*RETRY_STATUSES) | status.between(500, 599), F.lit("retryable")).otherwise(F.lit("permanent"))


def new_tasks(payloads: DataFrame, kind: str, priority: int, now: str, run_at: str | None = None, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Queued tasks of one kind from rows (payload_json)."""
    none = F.lit(None).cast("string")
    return payloads.select(F.lit(kind).alias("kind"), F.lit("queued").alias("status"), F.lit(priority).cast("long").alias("priority"), "payload_json", F.lit(0).cast("long").alias("attempts"), F.lit(max_attempts).cast("long").alias("max_attempts"), F.lit(run_at).cast("string").alias("next_run_at"), none.alias("last_error"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))


def recall_tasks(anchors_: DataFrame, now: str, priority: int = PRIORITY["recall"]) -> DataFrame:
    """A recall for each anchor (session_id, turn_ordinal); queue them with enqueue(), which skips those there already."""
    return new_tasks(anchors_.select(F.to_json(F.struct("session_id", "turn_ordinal")).alias("payload_json")), "recall", priority, now)


def eval_tasks(tasks: DataFrame, runs: DataFrame, recalls: DataFrame, now_seconds: int) -> DataFrame:
    """Delayed evaluations of recalls (session_id, turn_ordinal, recall_text, memory_ids, filter_telemetry), for anchors that have neither a task nor a run."""
    key = ["session_id", "turn_ordinal"]
    c = F.col("config_json")
    ran = runs.select(F.get_json_object(c, "$.session_id").alias("session_id"), F.get_json_object(c, "$.turn_ordinal").try_cast("long").alias("turn_ordinal"))
    have = anchors(tasks.where("kind = 'recall_eval'")).select(key).unionByName(ran)
    fresh = recalls.join(have.distinct(), key, "left_anti").select(F.to_json(F.struct(*recalls.columns)).alias("payload_json"))
    return new_tasks(fresh, "recall_eval", PRIORITY["backlog"], f"unix:{now_seconds}", f"unix:{now_seconds + EVAL_DELAY}")


def deferred(tasks: DataFrame, which: Column, delay: int, now_seconds: int) -> tuple[DataFrame, DataFrame]:
    """The table with the tasks completed, and their copies, one attempt older, that are due after the delay."""
    now = f"unix:{now_seconds}"
    copies = tasks.where(which).drop("id").withColumns({"status": F.lit("queued"), "attempts": F.col("attempts") + 1, "next_run_at": F.lit(f"unix:{now_seconds + delay}"), "last_error": F.lit(None).cast("string"), "created_at": F.lit(now), "updated_at": F.lit(now)})
    return transition(tasks, which, "completed", now), copies
