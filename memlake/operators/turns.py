"""Windows over turns: last ones, live and replay contexts, batches, coverage and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = ("session_id", "ordinal")


def from_messages(messages: DataFrame) -> DataFrame:
    """(session_id, ordinal, status, texts): a user message opens a turn; it is completed if an assistant answers.

    Rows before the first user message belong to no turn. messages: (conv_id, turn, role, text).
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    g = messages.withColumn("g", F.sum((F.col("role") == "user").cast("long")).over(w)).where("g > 0")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    answered = F.bool_or(F.col("role") == "assistant")
    turns = g.groupBy(F.col("conv_id").alias("session_id"), (F.col("g") - 1).alias("ordinal")).agg(texts.alias("texts"), answered.alias("ok"))
    return turns.select("session_id", "ordinal", F.when(F.col("ok"), "completed").otherwise("aborted").alias("status"), "texts")


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each session, whatever their status."""
    r = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ordinal")))
    return turns.withColumn("_r", r).where(F.col("_r") <= n).drop("_r")


def live_windows(turns: DataFrame, width: int, value: Column) -> DataFrame:
    """For each completed turn the values of completed turns at ordinals (o - width, o], in order: a range, so gaps shrink it."""
    w = Window.partitionBy("session_id").orderBy("ordinal").rangeBetween(-(max(width, 1) - 1), 0)
    return turns.where(F.col("status") == "completed").withColumn("window", F.collect_list(value).over(w))


def replay_windows(turns: DataFrame, width: int, value: Column) -> DataFrame:
    """For each turn the values of the `width` rows before it."""
    w = Window.partitionBy("session_id").orderBy("ordinal").rowsBetween(-width, -1)
    return turns.withColumn("window", F.collect_list(value).over(w))


def batches(turns: DataFrame, size: int, partial: Column | None = None) -> DataFrame:
    """(session_id, batch, first, last, n, refs): completed turns cut in lots of `size`; a rest only where `partial` holds."""
    w = Window.partitionBy("session_id").orderBy("ordinal")
    lot = F.floor((F.row_number().over(w) - 1) / size).cast("long")
    done = turns.where(F.col("status") == "completed").withColumn("batch", lot)
    out = done.groupBy("session_id", "batch").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count("*").alias("n"), F.array_sort(F.collect_list("ordinal")).alias("refs"))
    return out.where((F.col("n") == size) | partial) if partial is not None else out


def uncovered(lots: DataFrame, covered: DataFrame) -> DataFrame:
    """Batches of which some turn is in no active memory's sources. covered: (session_id, ordinal)."""
    c = covered.select("session_id", "ordinal").distinct().withColumn("_c", F.lit(True))
    each = lots.select("session_id", "batch", F.explode("refs").alias("ordinal")).join(c, ["session_id", "ordinal"], "left")
    full = each.groupBy("session_id", "batch").agg(F.bool_and(F.coalesce("_c", F.lit(False))).alias("full")).where("full")
    return lots.join(full, ["session_id", "batch"], "left_anti")


def covered_turns(memories: DataFrame) -> DataFrame:
    """Distinct source turns of active memories."""
    return memories.where("is_active").select(F.explode("source_turn_refs").alias("r")).select("r.session_id", "r.ordinal").distinct()


def later_turns(anchors: DataFrame, turns: DataFrame, n: int = 20) -> DataFrame:
    """For each anchor (session_id, anchor) its next n completed turns, with their place."""
    done = turns.where(F.col("status") == "completed")
    later = anchors.join(done, "session_id").where(F.col("ordinal") > F.col("anchor"))
    place = F.row_number().over(Window.partitionBy("session_id", "anchor").orderBy("ordinal"))
    return later.withColumn("place", place).where(F.col("place") <= n)


def next_ordinals(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    top = turns.groupBy("session_id").agg(F.max("ordinal").alias("m"))
    return sessions.select("session_id").join(top, "session_id", "left").select("session_id", F.coalesce(F.col("m") + 1, F.lit(0)).alias("next_ordinal"))


def distinct_refs(rows: DataFrame, key: str, refs: str) -> DataFrame:
    """For each key its source turns, each once, in the order of first mention. refs: array of struct(session_id, ordinal)."""
    e = rows.select(key, F.posexplode(refs).alias("pos", "r")).select(key, "pos", "r.session_id", "r.ordinal")
    return e.groupBy(key, "session_id", "ordinal").agg(F.min("pos").alias("pos"))


def budgeted(turns: DataFrame, max_chars: int, text: str = "display_text") -> DataFrame:
    """Turn texts up to a budget of characters in order; the one that crosses it is cut."""
    before = Window.partitionBy("session_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0))
    return turns.withColumn("_u", used).where(F.col("_u") < max_chars).withColumn(text, F.expr(f"substring({text}, 1, int({max_chars} - _u))")).drop("_u")


def sessions_by_gap(events: DataFrame, key: str, seconds: Column, gap: int) -> DataFrame:
    """Adds idle_session: a number that goes up after each pause over `gap` seconds."""
    w = Window.partitionBy(key).orderBy(seconds, "event_id")
    paused = (seconds - F.lag(seconds).over(w) > gap).cast("long")
    return events.withColumn("_p", F.coalesce(paused, F.lit(0))).withColumn("idle_session", F.sum("_p").over(w)).drop("_p")


def due_windows(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of the sessions that have at least n completed ones."""
    done = turns.where(F.col("status") == "completed").groupBy("session_id").count().where(F.col("count") >= n)
    return last_turns(turns.join(done, "session_id", "left_semi"), n)
