"""Recall statistics and evaluation summaries."""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import numeric_score
from memlake.shared import sized_stash, small

#: Times that edges of blocks are taken from, at most.
SAMPLE = 2048
#: Rows of a sweep's task, about.
SWEPT = 100_000


def rate(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d)


def run_rollup(runs: DataFrame, results: DataFrame) -> DataFrame:
    """(id, n_results, score): the one score of a run, or its distinct scores joined in order; null without results."""
    g = results.groupBy(F.col("eval_run_id").alias("id")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("judge_score")), ",").alias("score"))
    return runs.select("id").join(g, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_results"), F.nullif("score", F.lit("")).alias("score"))


def score_histogram(results: DataFrame) -> DataFrame:
    shown = F.when(F.col("judge_score") == "insufficient_context", "n/a").otherwise(F.col("judge_score"))
    return results.groupBy(shown.alias("score")).agg(F.count("*").alias("n"))


def volumes(runs: DataFrame, value: str = "n") -> DataFrame:
    """Average, median, 90th percentile by nearest rank, and buckets of memory counts over non-empty runs."""
    v = F.col(value)
    disc = lambda p: F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").cast("long"), F.lit(0))
    return runs.agg(
        F.coalesce(F.avg(v), F.lit(0.0)).alias("avg_n"), disc(0.5).alias("p50"), disc(0.9).alias("p90"),
        F.count_if(v == 0).alias("b_0"), F.count_if(v.between(1, 2)).alias("b_1_2"), F.count_if(v.between(3, 5)).alias("b_3_5"), F.count_if(v > 5).alias("b_over_5"),
    )


def usefulness(results: DataFrame) -> DataFrame:
    """Results of 4 and over are good, of 2 and under low; a run is evaluated with any number, useful with any good one."""
    n = numeric_score(F.col("judge_score"))
    runs = results.groupBy("eval_run_id").agg(F.count(n).alias("judged"), F.count_if(n >= 4).alias("good"), F.count_if(n <= 2).alias("low"))
    return runs.agg(
        F.coalesce(F.sum("judged"), F.lit(0)).alias("numeric_results"), F.coalesce(F.sum("good"), F.lit(0)).alias("good_results"), F.coalesce(F.sum("low"), F.lit(0)).alias("low_results"),
        F.count_if(F.col("judged") > 0).alias("evaluated_runs"), F.count_if(F.col("good") > 0).alias("useful_runs"),
    )


def recall_rates(eligible: DataFrame, recalls: DataFrame, evals: DataFrame) -> DataFrame:
    """Rates over eligible turns: with a recall (a task, or a non-empty evaluation), and with memories. All are anchors (session_id, turn_ordinal); evals has n."""
    key = ["session_id", "turn_ordinal"]
    all_ = eligible.select(key).distinct()
    nonempty = evals.where("n > 0").select(key).distinct()
    ran = recalls.select(key).unionByName(nonempty).distinct()
    marked = all_.join(ran.withColumn("r", F.lit(1)), key, "left").join(nonempty.withColumn("e", F.lit(1)), key, "left")
    a = marked.agg(F.count("*").alias("eligible_turns"), F.count("r").alias("recall_runs"), F.count("e").alias("nonempty_runs"))
    return a.select("*", rate(F.col("recall_runs"), F.col("eligible_turns")).alias("recall_rate"), rate(F.col("nonempty_runs"), F.col("recall_runs")).alias("nonempty_rate"))


def filter_telemetry(rows: DataFrame) -> DataFrame:
    """Judge filter telemetry: counts of tries, uses, fallbacks and errors; average pool, and average drop where used."""
    drop = F.greatest(F.col("deterministic_selected_count") - F.col("final_selected_count"), F.lit(0))
    return rows.agg(
        F.count_if("llm_attempted").alias("attempted"), F.count_if("llm_applied").alias("applied"), F.count_if("llm_empty_fallback").alias("fallback"), F.count_if(F.col("llm_error").isNotNull()).alias("errors"),
        F.coalesce(F.avg("candidate_count"), F.lit(0.0)).alias("avg_candidates"), F.coalesce(F.avg(F.when(F.col("llm_applied"), drop)), F.lit(0.0)).alias("avg_dropped"),
    )


def session_summary(runs: DataFrame, results: DataFrame) -> DataFrame:
    """By session: runs, results, judged results, average score, latest run and its turn; latest run first."""
    n = numeric_score(F.col("judge_score"))
    per = results.groupBy(F.col("eval_run_id").alias("id")).agg(F.count("*").alias("c"), F.count(n).alias("j"), F.sum(n).alias("s"))
    j = runs.join(per, "id", "left")
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return j.groupBy("session_id").agg(F.count("*").alias("runs"), zero("c").alias("results"), zero("j").alias("judged"), rate(zero("s"), zero("j")).alias("average"), F.max("id").alias("latest_run"), F.max_by("turn_ordinal", "id").alias("latest_turn"))


def score_examples(runs: DataFrame, results: DataFrame, n: int = 5) -> DataFrame:
    """(kind, run_id, session_id, turn_ordinal, memory_id, judge_score, rationale): the first low and high results, those of the latest runs first."""
    r = runs.select(F.col("id").alias("run_id"), "session_id", "turn_ordinal")
    s = numeric_score(F.col("judge_score"))
    known = results.join(r, F.col("eval_run_id") == F.col("run_id"))
    first = lambda kind, some: known.where(some).orderBy(F.desc("run_id"), "id").limit(n).withColumn("kind", F.lit(kind))
    return first("low", s <= 2).unionByName(first("high", s >= 4)).select("kind", "run_id", "session_id", "turn_ordinal", "memory_id", "judge_score", "rationale")


def later_counts(anchors: DataFrame, turns: DataFrame, most: int = 10_000) -> DataFrame:
    """Anchors (run_id, session_id, turn_ordinal) with later_completed_turns, at most `most`: completed turns of the session after each.

    Anchors and turns are counted together by blocks of ordinals, so a session of very many turns is many tasks' work.
    """
    key = "session_id"
    t = turns.where("status = 'completed'").select(F.lit(None).cast("long").alias("run_id"), key, F.col("ordinal").cast("long").alias("turn_ordinal"), F.lit(True).alias("_turn"))
    a = anchors.where("session_id IS NOT NULL AND turn_ordinal IS NOT NULL").select(F.col("run_id").cast("long").alias("run_id"), key, F.col("turn_ordinal").cast("long").alias("turn_ordinal"), F.lit(False).alias("_turn"))
    counted = eligible_before(t.unionByName(a).withColumn("_at", -F.col("turn_ordinal")), key, "_at", F.col("_turn"))
    return counted.where("NOT _turn").select("run_id", key, "turn_ordinal", F.least("eligible", F.lit(most)).cast("long").alias("later_completed_turns"))


def stale_insufficient(runs: DataFrame, results: DataFrame, turns: DataFrame, n: int = 10) -> DataFrame:
    """The latest runs with a result of insufficient context whose session went on since: (run_id, session_id, turn_ordinal, score, later_completed_turns)."""
    short = results.where("judge_score = 'insufficient_context'").select(F.col("eval_run_id").alias("run_id"))
    anchors = runs.select(F.col("id").alias("run_id"), "session_id", "turn_ordinal").join(short, "run_id", "left_semi")
    later = later_counts(anchors, turns).where("later_completed_turns > 0").withColumn("score", F.lit("n/a"))
    return later.orderBy(F.desc("run_id")).limit(n)


def memory_stats(memories: DataFrame) -> DataFrame:
    return memories.groupBy("scope", "memory_kind", "is_active").agg(F.count("*").alias("n"))


def top_projects(memories: DataFrame, n: int = 20) -> DataFrame:
    return memories.where("is_active AND project_id IS NOT NULL").groupBy("project_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project_id").limit(n)


def time_blocks(rows: DataFrame, at: str, blocks: int = 64) -> Callable[[Column], Column]:
    """The number of a time's block as a function of the time, from 0; edges come from SAMPLE times, those with the least hashes, so blocks are about even.

    Times may be of any type that has an order. Only the evenness of blocks depends on the sample.
    """
    drawn = rows.where(F.col(at).isNotNull()).select(F.col(at).alias("t"), F.xxhash64(*rows.columns).alias("h")).orderBy("h", "t").limit(SAMPLE).select("t")
    times = sorted(r["t"] for r in drawn.collect())  # SAMPLE at most
    edges = sorted({times[len(times) * i // blocks] for i in range(1, blocks)}) if times else []
    return lambda t: sum((F.coalesce(t >= F.lit(e), F.lit(False)).cast("int") for e in edges), F.lit(0))


def candidates_before(turns: DataFrame, memories: DataFrame, turn_time: str, memory_time: str, blocks: int = 64) -> DataFrame:
    """As-of pairs with `block`: active memories created before a turn was seen; a null time gives none.

    Memories lie in blocks of time; a turn meets each block up to its own by an equi-join on the block, and times are compared in
    the turn's own block only to effect. The result has a row for each pair; keep the best of each turn and block (best_before()).
    """
    of = time_blocks(memories, memory_time, blocks)
    m = memories.where("is_active").where(F.col(memory_time).isNotNull()).withColumn("block", of(F.col(memory_time)))
    t = turns.where(F.col(turn_time).isNotNull()).withColumn("block", F.explode(F.sequence(F.lit(0), of(F.col(turn_time)))))
    return t.join(m, "block").where(F.col(memory_time) < F.col(turn_time))


def best_before(turns: DataFrame, memories: DataFrame, turn_time: str, memory_time: str, score: Column, newest: Column, limit: int = 5) -> DataFrame:
    """Ranked as-of candidates of turns (query_id, ...) among memories (id, is_active, ...): the best of each block first, then of all blocks."""
    scored = candidates_before(turns, memories, turn_time, memory_time).withColumns({"score": score, "_new": newest})
    order = (F.desc("score"), F.desc("_new"), F.desc("id"))
    near = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "block").orderBy(*order))).where(F.col("rank") <= limit)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= limit).drop("block", "_new")


def _swept(rows: DataFrame, tasks: int, limit: int) -> DataFrame:
    """Rows (own, k, t, is_memory, uid, query_id, id, score, new) in the order of own, k, t and is_memory: what each turn has met in its task, and what goes on.

    Gives (part, own, k, is_memory, first, uid, query_id, found): for a turn the best memories before it of its group (own, k) within its task, and
    whether the group may have begun in an earlier one; for a task's last group, with is_memory, its best memories.
    """
    kinds = dict(rows.dtypes)
    order = ["own", "k", "t", "is_memory", "uid"]
    hit = f"uid long, id {kinds['id']}, score double, new {kinds['new']}"
    schema = f"part int, own boolean, k string, is_memory boolean, first boolean, uid long, query_id {kinds['query_id']}, found array<struct<{', '.join(x.replace(' ', ':', 1) for x in hit.split(', '))}>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, group, first, best = TaskContext.get().partitionId(), None, True, []  # best: the least first, nulls below all
        kind = None

        def told(out: list[tuple]) -> pa.RecordBatch:
            hits = [[dict(zip(("uid", "id", "score", "new"), b[1], strict=True)) for b in x[-1]] for x in out]
            columns = [list(c) for c in zip(*out, strict=True)][:-1]
            types = [pa.int32(), pa.bool_(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), kind.field("query_id").type]
            struct = pa.struct([("uid", pa.int64()), ("id", kind.field("id").type), ("score", pa.float64()), ("new", kind.field("new").type)])
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array(hits, pa.list_(struct))], names=["part", "own", "k", "is_memory", "first", "uid", "query_id", "found"])

        for b in batches:
            kind, out = b.schema, []
            for own, k, is_memory, uid, query_id, id_, score, new in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("own", "k", "is_memory", "uid", "query_id", "id", "score", "new")), strict=True):
                if (own, k) != group:
                    first, group, best = group is None, (own, k), []
                if not is_memory:
                    out.append((part, own, k, False, first, uid, query_id, list(best)))
                    continue
                nan = score is not None and score != score
                place = (score is not None, nan, 0.0 if nan or score is None else score, *(y for x in (new, id_) for y in ((x is not None, x) if x is not None else (False,))))
                if len(best) < limit or place > best[0][0]:
                    insort(best, (place, (uid, id_, score, new)), key=lambda x: x[0])
                    del best[:-limit]
            if out:
                yield told(out)
        if group is not None:
            yield told([(part, *group, True, first, None, None, best)])

    sorted_ = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return sorted_.select("own", "k", "is_memory", "uid", "query_id", "id", "score", "new").mapInArrow(run, schema)


def best_before_keyed(turns: DataFrame, memories: DataFrame, turn_time: str, memory_time: str, turn_key: str, memory_key: str, score: Column, same: Column, newest: Column, limit: int = 5) -> DataFrame:
    """(query_id, id, rank, score): best_before() where only an equal key changes a score, which is `same` then, never less than `score`; no pairs are made.

    The best of all earlier memories by `score` and the best of those of the turn's key by `same` hold the best of all. Turns and memories are
    sorted by group (all, or a key) and time, dealt out by ranges, and swept; a group that goes on in later tasks hands on its best. Keys are
    compared as text and null equals none; times are of one type, and a null time gives no pair. Repeated rows each count.
    """
    m = memories.where("is_active").select(F.col(memory_time).alias("t"), F.col(memory_key).cast("string").alias("key"), "id", score.cast("double").alias("s"), same.cast("double").alias("o"), newest.alias("new"))
    q = turns.select(F.col(turn_time).alias("t"), F.col(turn_key).cast("string").alias("key"), "query_id")
    kinds = dict(m.dtypes) | dict(q.select("query_id").dtypes)
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)

    def both(rows: DataFrame, rest: list, other: Column, own: Column) -> DataFrame:
        known = rows.where("t IS NOT NULL").withColumn("uid", F.monotonically_increasing_id())
        each = F.array(F.struct(F.lit(False).alias("own"), F.lit(None).cast("string").alias("k"), other.alias("score")), F.struct(F.lit(True).alias("own"), F.col("key").alias("k"), own.alias("score")))
        return known.withColumn("g", F.explode(each)).where("NOT g.own OR g.k IS NOT NULL").select("g.own", "g.k", "t", "uid", *rest, "g.score")

    nil = F.lit(None).cast("double")
    as_turns = both(q, ["query_id", none("id"), none("new"), F.lit(False).alias("is_memory")], nil, nil)
    as_memories = both(m, [none("query_id"), "id", "new", F.lit(True).alias("is_memory")], F.col("s"), F.col("o"))
    tasks = max(1, -(-2 * (q.count() + m.count()) // SWEPT))
    swept, size = sized_stash(_swept(as_turns.unionByName(as_memories), tasks, limit), "swept")
    ends = swept.where("is_memory").select("part", "own", "k", "found")  # one a task
    met = swept.where("NOT is_memory")
    begun = met.where("first").select(F.col("part").alias("at"), "own", "k").distinct()
    before = begun.alias("b").join(F.broadcast(ends).alias("e"), F.expr("b.own = e.own AND b.k <=> e.k AND e.part < b.at")).select("at", "b.own", F.explode("found").alias("f"))
    order = (F.desc("f.score"), F.desc("f.new"), F.desc("f.id"))
    before = before.withColumn("r", F.row_number().over(Window.partitionBy("at", "own").orderBy(*order))).where(F.col("r") <= limit).groupBy("at", "own").agg(F.collect_list("f").alias("earlier"))
    handed = met.where("first").join(small(before.withColumnRenamed("own", "_own"), size), (F.col("part") == F.col("at")) & (F.col("own") == F.col("_own"))).select("query_id", F.col("uid").alias("turn"), F.explode("earlier").alias("f"))
    found = met.select("query_id", F.col("uid").alias("turn"), F.explode("found").alias("f")).unionByName(handed)
    once = found.withColumn("n", F.row_number().over(Window.partitionBy("turn", "f.uid").orderBy(F.desc("f.score")))).where("n = 1")  # met in both groups
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return once.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "f.id", "rank", "f.score")


def eligible_before(rows: DataFrame, key: str, at: str, marked: Column, blocks: int = 64) -> DataFrame:
    """`rows` with `eligible`: how many marked rows of the same key are earlier than each; 0 where the time is null, which marks nothing either.

    A key's rows lie in blocks of time: whole earlier blocks count by running sums, the own block by a window, so a hot key is many tasks' work.
    """
    of = time_blocks(rows.select(key, at), at, blocks)
    mark = F.when(F.col(at).isNotNull(), marked.cast("long")).otherwise(0)
    cut = rows.withColumn("_b", of(F.col(at))).withColumn("_m", mark)
    sums = cut.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_block")).agg(F.sum("_m").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most `blocks` rows a key
    joined = cut.join(sums.withColumn("_before", before).drop("_n"), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_block")))
    w = Window.partitionBy(key, "_b").orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.sum("_m").over(w) - F.sum("_m").over(Window.partitionBy(key, "_b", at))
    return joined.withColumn("eligible", F.when(F.col(at).isNotNull(), F.col("_before") + own).otherwise(0)).drop("_b", "_m", "_k", "_block", "_before")


def replay_candidates(scored: DataFrame, limit: int = 5) -> DataFrame:
    """Ranked candidates of a replay: score, then newest, then largest id."""
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("created_at"), F.desc("id")))
    return scored.withColumn("rank", r).where(F.col("rank") <= limit)
