"""Work that calls providers: formulation, consolidation, replay evaluation, remembering, rebuilding."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.functions import text as tx
from memlake.functions.context import context_score
from memlake.functions.vectors import cosine
from memlake.operators import evals
from memlake.operators.turns import budgeted
from memlake.providers import Completer, Embedder, completed, embedded

FORMULATION = "Distil durable memories from these turns. Reply with JSON: {\"memories\": [{title, body, scope, kind, task_keys}]}."
CONSOLIDATION = "Merge these related memories into one. Reply with JSON in the same form."
JUDGE = "Score how useful the recalled memory was, 1 to 5. Reply with JSON: {score, rationale}."
DRAFT = T.ArrayType(T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if n == "task_keys" else T.StringType()) for n in ("title", "body", "scope", "kind", "task_keys", "project_descriptor")]))
NO_CANDIDATES = "no eligible recalled memories"
FILTER = "Choose the memories that help with the current turn; leave out those that are unrelated, stale or too general. An empty choice means that all are wrong. Name no id that isn't listed. Reply with JSON: {selected_memory_ids}."
#: Characters of a memory's body and of the turn's text that the filter sees.
FILTER_BODY, FILTER_TURN = 1200, 6000


def prompts(turns: DataFrame, config) -> DataFrame:
    """(session_id, prompt): turn texts in order within a budget of three characters a token."""
    budget = min(config.max_formulation_tokens * 3, 80_000)
    rows = budgeted(turns.where("display_text IS NOT NULL"), budget)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "display_text"))), lambda x: x["display_text"])
    return rows.groupBy("session_id").agg(tx.recall_query_text(lines, budget, config.tool_call_truncation_chars).alias("prompt"))


def drafts(replies: DataFrame, reply: str, project: str, max_body: int) -> DataFrame:
    """Memory drafts from replies (prose around JSON is fine); a reply that can't be read gives none."""

    def parse(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for replies_, projects in parts:
            out = []
            for r, p in zip(replies_, projects, strict=True):
                try:
                    out.append(tx.parse_formulation(r, p or "unknown", max_body) if r else [])
                except (ValueError, AttributeError, TypeError):
                    out.append([])
            yield pd.Series(out)

    parsed = F.pandas_udf(parse, DRAFT)(tx.json_from_prose(F.col(reply)), F.col(project))
    d = replies.withColumn("draft", F.explode(parsed)).drop(reply)
    kind = tx.normalize_kind(F.col("draft.kind"), F.col("draft.title"), F.col("draft.body"), F.col("draft.scope"))
    return d.select("*", "draft.title", "draft.body", "draft.scope", F.coalesce(kind, tx.infer_kind(F.col("draft.title"), F.col("draft.body"), F.col("draft.scope"))).alias("memory_kind"), "draft.task_keys", "draft.project_descriptor").drop("draft")


def formulate(turns: DataFrame, sessions: DataFrame, config, completer: Completer) -> DataFrame:
    """Drafts of each session's turns, with the session's project."""
    p = prompts(turns, config).join(sessions.select(F.col("id").alias("session_id"), "project_id"), "session_id", "left")
    return drafts(completed(p, FORMULATION, "prompt", "reply", completer).drop("prompt"), "reply", "project_id", config.max_memory_length)


def embed_memories(memories: DataFrame, embedder: Embedder, now: str) -> DataFrame:
    """Embedding rows of memories (id, title, body, scope, memory_kind, project_descriptor, task_keys)."""
    none = F.lit(None).cast("string")
    text = tx.embedding_text(F.col("title"), F.col("scope"), F.col("memory_kind"), F.col("project_descriptor"), none, none, none, F.array().cast("array<string>"), F.col("task_keys"), F.col("body"))
    e = memories.withColumn("_t", text).withColumn("embedding", embedded(F.col("_t"), embedder))
    return e.select(F.col("id").alias("memory_id"), F.lit(embedder.model).alias("embedding_model"), F.size("embedding").cast("long").alias("dimensions"), "embedding", tx.fnv1a(F.col("_t")).alias("embedded_text_hash"), F.lit(now).alias("updated_at"))


def merge_cluster(members: DataFrame, config, completer: Completer) -> DataFrame:
    """The merged memory of each cluster (cluster, id, title, body, scope, project_id): the last draft; its lineage is the members."""
    ordered = F.array_sort(F.collect_list(F.struct("id", F.concat_ws("\n", F.concat(F.lit("title: "), F.substring("title", 1, 300)), F.substring("body", 1, 3000)).alias("t"), "scope", "project_id")))
    g = members.groupBy("cluster").agg(ordered.alias("m"))
    p = g.select("cluster", F.array_join(F.transform("m", lambda x: x["t"]), "\n\n").alias("prompt"), F.transform("m", lambda x: x["id"]).alias("lineage_refs"), F.col("m")[0]["scope"].alias("s"), F.col("m")[0]["project_id"].alias("project_id"))
    d = drafts(completed(p, CONSOLIDATION, "prompt", "reply", completer).drop("prompt"), "reply", "project_id", config.max_memory_length)
    last = d.groupBy("cluster").agg(F.last(F.struct("title", "body", "memory_kind", "task_keys", "lineage_refs", "s", "project_id", "project_descriptor")).alias("d"))
    return last.select("cluster", "d.title", "d.body", F.col("d.s").alias("scope"), "d.memory_kind", "d.task_keys", "d.lineage_refs", F.when(F.col("d.s") == "global", None).otherwise(F.col("d.project_id")).alias("project_id"), "d.project_descriptor")


def replay(queries: DataFrame, memories: DataFrame, text_compare: bool = False, limit: int = 5) -> DataFrame:
    """Candidates of replayed turns (query_id, q_text, q_vector, q_context, observed_at) among earlier active memories.

    Score: cosine plus context where both vectors are there, else shared terms plus context. Times are compared as epoch seconds;
    as text with text_compare.
    """
    when = lambda c: F.col(c) if text_compare else tx.epoch_seconds(F.col(c))
    near = F.coalesce(cosine(F.col("q_vector"), F.col("vector")), tx.lexical_score(tx.terms(F.col("q_text")), tx.terms(F.concat_ws("\n", "title", "body"))))
    score = near + context_score(F.col("q_context"), F.col("context"))
    return evals.best_before(queries.withColumn("_q", when("observed_at")), memories.withColumn("_m", when("created_at")), "_q", "_m", score, F.col("created_at"), limit).drop("_q", "_m")


def judge(candidates: DataFrame, prompt: str, completer: Completer | None) -> DataFrame:
    """Adds judge_score and rationale; `unjudged` without a judge or when it fails."""
    if completer is None:
        return candidates.withColumn("judge_score", F.lit("unjudged")).withColumn("rationale", F.lit("no judge"))
    said = completed(candidates, JUDGE, prompt, "_r", completer)
    j = tx.json_from_prose(F.col("_r"))
    ok = j.isNotNull()
    why = F.coalesce(F.nullif(F.trim(F.get_json_object(j, "$.rationale")), F.lit("")), F.lit("judge returned no rationale"))
    score: Column = F.when(ok, tx.normalize_score(F.get_json_object(j, "$.score"))).otherwise("unjudged")
    return said.withColumn("judge_score", score).withColumn("rationale", F.when(ok, why).otherwise("judge failed")).drop("_r")


def filter_prompts(pool: DataFrame, config) -> DataFrame:
    """(query_id, prompt) of pools of candidates (query_id, q_text, q_project, place, memory_id, title, body, kind, scope, project_id,
    project_descriptor, task_keys, score, reason); a pool is bounded by the options of the recall."""
    shown = F.struct("place", "memory_id", "title", tx.truncated(F.col("body"), FILTER_BODY).alias("body"), "kind", "scope", "project_id", "project_descriptor", "task_keys", "score", "reason")
    g = pool.groupBy("query_id").agg(F.first("q_text").alias("t"), F.first("q_project").alias("p"), F.array_sort(F.collect_list(shown)).alias("c"))
    asked = F.struct(F.col("p").alias("current_project_id"), tx.truncated(F.col("t"), FILTER_TURN).alias("current_turn_text"), F.lit(config.recall_result_limit).alias("max_selected_memories"), F.col("c").alias("candidate_memories"))
    return g.select("query_id", tx.truncated(F.to_json(asked), config.recall_llm_filter_prompt_max_chars).alias("prompt"))


def filter_verdicts(replies: DataFrame) -> DataFrame:
    """(query_id, ids, error) from replies (query_id, reply): each id once, numbers or digits; no ids and an error where nothing can be read."""
    j = tx.json_from_prose(F.col("reply"))
    named = F.from_json(F.get_json_object(j, "$.selected_memory_ids"), "array<string>")
    ids = F.array_distinct(F.array_compact(F.transform(F.coalesce(named, F.array().cast("array<string>")), lambda x: x.try_cast("long"))))
    error = F.when(F.col("reply").isNull(), F.lit("the call failed")).when(j.isNull(), F.lit("the reply holds no JSON"))
    return replies.select("query_id", F.when(error.isNull(), ids).alias("ids"), error.alias("error"))


def filtered(pool: DataFrame, config, completer: Completer) -> DataFrame:
    """Verdicts of a completer on pools of candidates, a call a query."""
    return filter_verdicts(completed(filter_prompts(pool, config), FILTER, "prompt", "reply", completer))


def payload(**fields) -> str:
    return json.dumps(fields, sort_keys=True)
