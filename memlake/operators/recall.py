"""Recall: hybrid ranking of vector hits, rule filter, greedy selection, and rendering.

Frames of candidates have the columns query_id, memory_id, similarity, context_points (hundredths), same_project,
same_repo, same_area, scope, kind, has_query_keys, and counts of matched strong and weak keys (n_strong, n_weak).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.functions.context import context_points

#: The weights of the rank, in hundredths.
STRONG_KEY, WEAK_KEY, MOST_KEYS, DURABLE = 28, 6, 70, 8
SAME_PROJECT_NO_KEY, TASK_STATE_NO_KEY, GLOBAL_TASK_STATE = 24, 35, 35
STRONG_REPO, STRONG_CONTEXT = 36, 42
DURABLE_KINDS = ("preference", "lesson", "workflow")


@dataclass(frozen=True)
class Options:
    """What changes results of a recall."""

    pool: int = 20
    limit: int = 5
    threshold: float = 0.3
    tiebreaker: bool = True
    project_bonus: float = 0.05
    judge_pool: int = 12


def features(pairs: DataFrame, exclusions=()) -> DataFrame:
    """Candidate columns from pairs of a query (q_project, q_context, q_keys) and a memory (project_id, context, task_keys)."""
    matched = tx.matched_keys(F.col("q_keys"), F.col("task_keys"))
    both = lambda f: F.coalesce(F.col("q_context")[f] == F.col("context")[f], F.lit(False))
    out = pairs.withColumn("matched", matched)
    return out.withColumns(
        {
            "context_points": context_points(F.col("q_context"), F.col("context"), exclusions),
            "same_project": F.coalesce(F.col("q_project") == F.col("project_id"), F.lit(False)),
            "same_repo": both("repo_id"),
            "same_area": both("work_area"),
            "has_query_keys": F.size("q_keys") > 0,
            "n_strong": F.size(F.filter("matched", tx.is_strong_key)),
            "n_weak": F.size(F.filter("matched", lambda k: ~tx.is_strong_key(k))),
        }
    )


def project_bonus(candidates: DataFrame, bonus: float = 0.05) -> DataFrame:
    """similarity plus a bonus for the query's own project."""
    return candidates.withColumn("score", F.col("similarity") + F.when(F.col("same_project"), F.lit(bonus)).otherwise(F.lit(0.0)))


def score(options: Options = Options()) -> Column:
    c = F.col
    no_match = (c("n_strong") + c("n_weak")) == 0
    points = c("context_points") + F.least(c("n_strong") * STRONG_KEY + c("n_weak") * WEAK_KEY, F.lit(MOST_KEYS))
    points += F.when((c("scope") == "global") & c("kind").isin(*DURABLE_KINDS), DURABLE).otherwise(0)
    missed = c("has_query_keys") & no_match
    points -= F.when(missed & c("same_project"), SAME_PROJECT_NO_KEY).otherwise(0)
    points -= F.when(missed & (c("kind") == "task_state"), TASK_STATE_NO_KEY).otherwise(0)
    points -= F.when((c("scope") == "global") & (c("kind") == "task_state") & no_match, GLOBAL_TASK_STATE).otherwise(0)
    bonus = F.when(c("same_project") & F.lit(options.tiebreaker), F.lit(options.project_bonus)).otherwise(F.lit(0.0))
    return c("similarity") + points / 100 + bonus


def rank(candidates: DataFrame, options: Options = Options()) -> DataFrame:
    """Adds score, and rank within the query: score descending, then memory_id."""
    out = candidates.withColumn("score", score(options))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")))


def reason() -> Column:
    """Why the rules keep or drop a candidate; the first that fits."""
    c = F.col
    strong = c("same_area") | (c("same_repo") & (c("context_points") >= STRONG_REPO)) | (c("context_points") >= STRONG_CONTEXT)
    state = c("kind") == "task_state"
    fact = c("kind") == "project_fact"
    return (
        F.when(c("n_strong") > 0, "keep:strong_task_key_match")
        .when(state & c("has_query_keys"), "drop:task_state_without_task_key_match")
        .when(state & c("same_project") & strong, "keep:task_state_strong_context")
        .when(state, "drop:task_state_weak_context")
        .when(fact & (c("same_project") | strong), "keep:project_fact_context")
        .when(fact, "drop:project_fact_wrong_context")
        .when(c("scope") == "global", "keep:global_durable")
        .when(c("same_project"), "keep:same_project_durable")
        .when(strong, "keep:cross_project_strong_context")
        .when(c("n_weak") > 0, "keep:weak_task_key_semantic_durable")
        .otherwise("keep:semantic_durable")
    )


def select(ranked: DataFrame, limit: int = 5) -> DataFrame:
    """Adds reason and selected: the first `limit` kept ones of each query in rank order. Missing memories are dropped."""
    why = F.when(F.col("kind").isNull(), F.lit("drop:memory_not_loaded")).otherwise(reason())
    out = ranked.withColumn("reason", why).withColumn("_keep", F.col("reason").startswith("keep").cast("int"))
    so_far = F.sum("_keep").over(Window.partitionBy("query_id").orderBy("rank"))
    return out.withColumn("selected", (F.col("_keep") == 1) & (so_far <= limit)).drop("_keep")


def judged(selected: DataFrame, verdicts: DataFrame | None, options: Options = Options()) -> DataFrame:
    """The judge's choice within the pool of selected candidates: verdicts (query_id, ids array or null for an error).

    Without a verdict the rules' order stands; an empty choice falls back on the first candidate; ids outside the pool don't count.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    pool = selected.where("selected").withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(options.judge_pool, options.limit))
    if verdicts is None:
        return pool.where(F.col("place") <= options.limit).withColumn("judge_reason", F.lit(None).cast("string"))
    said = pool.join(verdicts.withColumnRenamed("ids", "_ids"), "query_id", "left")
    hit = F.coalesce(F.array_contains("_ids", F.col("memory_id")), F.lit(False))
    any_hit = F.max(hit).over(Window.partitionBy("query_id"))
    keep = F.when(F.col("_ids").isNull(), F.lit(True)).when(~any_hit, F.col("place") == 1).otherwise(hit)
    why = F.when(F.col("_ids").isNull(), F.lit(None).cast("string")).when(~any_hit, F.lit("keep:llm_empty_fallback")).otherwise(F.lit("keep:llm_semantic_filter"))
    out = said.withColumn("_k", keep).withColumn("judge_reason", why).where("_k")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= options.limit).drop("_ids", "_k")


def render(results: DataFrame, stamp: str, source: str) -> DataFrame:
    """(query_id, memory_ids, markdown) from rows query_id, q_project, rank, memory_id, title, body, created_at, project_id, project_descriptor."""
    foreign = ~F.col("project_id").eqNullSafe(F.col("q_project")) & F.col("project_descriptor").isNotNull()
    section = F.concat(
        F.lit("## "), "title", F.lit("\n\n"), "body", F.lit("\n\ncreated_at: "), "created_at", F.lit("\n"),
        F.when(foreign, F.concat(F.lit("originating_project: "), "project_descriptor", F.lit("\n"))).otherwise(""), F.lit("\n"),
    )
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col("memory_id").alias("id"), section.alias("s"))))
    g = results.groupBy("query_id").agg(rows.alias("r"))
    ids = F.transform("r", lambda x: x["id"])
    head = F.concat(F.lit(f"# Recall\n\nquery_timestamp: {stamp}\nquery_source: {source}\nmemory_count: "), F.size("r").cast("string"), F.lit("\nmemory_ids: "), F.array_join(F.transform(ids, lambda i: i.cast("string")), ","), F.lit("\n\n"))
    return g.select("query_id", ids.alias("memory_ids"), F.concat(head, F.array_join(F.transform("r", lambda x: x["s"]), "")).alias("markdown"))


def write_action(rendered: DataFrame, previous: DataFrame) -> DataFrame:
    """Adds action: noop without ids, unchanged if the previous file has the same ids in order, else written."""
    old = previous.select("query_id", F.col("memory_ids").alias("_old"))
    same = F.col("memory_ids") == F.col("_old")
    action = F.when(F.size("memory_ids") == 0, "noop").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("written")
    return rendered.join(old, "query_id", "left").withColumn("action", action).drop("_old")


def valid_files(files: DataFrame, memories: DataFrame) -> DataFrame:
    """(path, valid): a recall file holds if it names ids and all of them are still active."""
    ids = files.select("path", F.explode_outer("memory_ids").alias("id"))
    active = memories.where("is_active").select(F.col("id").alias("_id")).distinct()
    return ids.join(active, F.col("id") == F.col("_id"), "left").groupBy("path").agg(F.bool_and(F.col("_id").isNotNull()).alias("valid"))


def telemetry(selected: DataFrame, final: DataFrame, verdicts: DataFrame | None, options: Options = Options()) -> DataFrame:
    """For each query what the judge did: counts of candidates, of the rules' choice and of the final one, and whether it was asked, used, empty or failed.

    verdicts: (query_id, ids array or null, error string); none without a judge.
    """
    pool = max(options.judge_pool, options.limit)
    n = selected.groupBy("query_id").agg(F.least(F.count_if("selected"), F.lit(pool)).alias("candidate_count"), F.least(F.count_if("selected"), F.lit(options.limit)).alias("deterministic_selected_count"))
    done = final.groupBy("query_id").agg(F.count("*").alias("f"), F.bool_or(F.coalesce(F.col("judge_reason") == "keep:llm_empty_fallback", F.lit(False))).alias("e"))
    out = n.join(done, "query_id", "left")
    if verdicts is None:
        out = out.withColumns({"_v": F.lit(False), "_ids": F.lit(None).cast("array<long>"), "llm_error": F.lit(None).cast("string")})
    else:
        out = out.join(verdicts.select("query_id", F.lit(True).alias("_v"), F.col("ids").alias("_ids"), F.col("error").alias("llm_error")), "query_id", "left")
    asked = F.coalesce("_v", F.lit(False))
    return out.select(
        "query_id", "candidate_count", "deterministic_selected_count", F.coalesce("f", F.lit(0)).alias("final_selected_count"),
        asked.alias("llm_attempted"), (asked & F.col("_ids").isNotNull()).alias("llm_applied"), F.coalesce("e", F.lit(False)).alias("llm_empty_fallback"), "llm_error",
    )
