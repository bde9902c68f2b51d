"""Every relational operator of the engine, bound to the given tables, with its SQL for DuckDB.

Bindings: turns come from `conversations`; memories with vectors from `embeddings`; memory texts from `documents`; tasks and
evaluation results from `events`. Each query reads its whole tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.functions import vectors as vx
from memlake.operators import cluster, evals, projects, recall, state, tasks, turns
from memlake.operators.wordsets import word_sets
from memlake.shared import fresh_path, sized_stash, small, stash, table
from memlake.sources import transcripts
from memlake.streaming import turns as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = 1_704_500_000


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _r6(c: Column | str) -> Column:
    return F.round(c, 6)


# Memories with vectors.

_M_SQL = """m AS (SELECT vec_id AS memory_id, embedding, label AS project_id, CASE WHEN label = 0 THEN 'global' ELSE 'project' END AS scope,
  ['preference', 'lesson', 'workflow', 'project_fact', 'task_state'][CAST(vec_id % 5 + 1 AS BIGINT)] AS kind, vec_id % 11 <> 0 AS is_active FROM embeddings)"""


def _memories(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        v.alias("memory_id"), "embedding", F.col("label").alias("project_id"), F.when(F.col("label") == 0, "global").otherwise("project").alias("scope"),
        F.get(F.array(*[F.lit(k) for k in tx.KINDS]), (v % 5).cast("int")).alias("kind"), (v % 11 != 0).alias("is_active"),
    )


def _ask(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _hits(spark: SparkSession, sf: str, k: int, threshold: float = 0.3) -> DataFrame:
    return vx.search(_memories(spark, sf).where("is_active"), _ask(spark, sf), "memory_id", "embedding", k, threshold)


def _hits_sql(k: int, threshold: float = 0.3) -> str:
    return f"""{_M_SQL},
s AS (SELECT q.vec_id AS query_id, m.memory_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])) AS similarity
      FROM embeddings q JOIN m ON q.vec_id <> m.memory_id WHERE q.vec_id % 100 = 0 AND m.is_active),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, memory_id) AS rank FROM s WHERE similarity >= {threshold}) WHERE rank <= {k})"""


@_query(f"WITH {_hits_sql(5)} SELECT query_id, memory_id, rank, round(similarity, 6) AS similarity FROM h")
def vector_recall_topk(spark, sf):
    return _hits(spark, sf, 5).select("query_id", "memory_id", F.col("rank").cast("long").alias("rank"), _r6("similarity").alias("similarity"))


@_query(f"WITH {_hits_sql(1)} SELECT query_id, count(*) AS n FROM s WHERE similarity >= 0.3 GROUP BY query_id")
def vector_threshold_count(spark, sf):
    return vx.count_over(_memories(spark, sf).where("is_active"), _ask(spark, sf), "memory_id", "embedding", 0.3)


_CTX = """{{'repo_id': CASE WHEN {v} % 6 = 0 THEN NULL ELSE 'r' || ({v} % 4) END, 'work_area': CASE WHEN {v} % 3 = 0 THEN NULL ELSE 'w' || ({v} % 2) END,
 'activity_domain': CASE WHEN {v} % 3 = 0 THEN 'code' WHEN {v} % 3 = 1 THEN 'planning' END, 'subject_tags': list_distinct(['t' || ({v} % 3), 'u' || ({v} % 5), CASE WHEN {v} % 4 = 0 THEN 'github' ELSE 'ci' END])}}"""
_KEYS = "list_concat(CASE WHEN {v} % 4 = 0 THEN ['pr:' || ({v} % 3)] ELSE [] END, CASE WHEN {v} % 5 = 0 THEN ['tool:just'] ELSE [] END)"


def _ctx(v: Column) -> Column:
    s = lambda n: (v % n).cast("string")
    return F.struct(
        F.when(v % 6 == 0, None).otherwise(F.concat(F.lit("r"), s(4))).alias("repo_id"), F.when(v % 3 == 0, None).otherwise(F.concat(F.lit("w"), s(2))).alias("work_area"),
        F.when(v % 3 == 0, "code").when(v % 3 == 1, "planning").alias("activity_domain"),
        F.array(F.concat(F.lit("t"), s(3)), F.concat(F.lit("u"), s(5)), F.when(v % 4 == 0, "github").otherwise("ci")).alias("subject_tags"),
    )


def _keys(v: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.when(v % 4 == 0, F.array(F.concat(F.lit("pr:"), (v % 3).cast("string")))).otherwise(none), F.when(v % 5 == 0, F.array(F.lit("tool:just"))).otherwise(none))


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    found = _hits(spark, sf, 20)
    m = _memories(spark, sf).drop("embedding")
    q, v = F.col("query_id"), F.col("memory_id")
    pairs = found.drop("rank").join(m, "memory_id").withColumns({"q_project": (q % 10).cast("int"), "q_context": _ctx(q), "q_keys": _keys(q), "context": _ctx(v), "task_keys": _keys(v)})
    return recall.rank(recall.features(pairs))


_COMMON = "['linear', 'work-tracking', 'github', 'pr', 'ci', 'docs', 'slack', 'java', 'codex', 'claude-code']"
_HIGH = f"list_filter({{0}}, lambda x: NOT list_contains({_COMMON}, x))"
_RANK_SQL = f"""{_hits_sql(20)},
p AS (SELECT h.query_id, h.memory_id, h.similarity, m.scope, m.kind, m.project_id = h.query_id % 10 AS same_project, {_CTX.format(v="h.query_id")} AS q, {_CTX.format(v="m.memory_id")} AS c,
  {_KEYS.format(v="h.query_id")} AS qk, {_KEYS.format(v="m.memory_id")} AS mk FROM h JOIN m ON m.memory_id = h.memory_id),
f AS (SELECT *, len(list_intersect(q.subject_tags, c.subject_tags)) AS o, len(list_intersect({_HIGH.format("q.subject_tags")}, c.subject_tags)) > 0 AS strong_tag,
  len({_HIGH.format("q.subject_tags")}) AS high, coalesce(q.repo_id = c.repo_id, false) AS same_repo, coalesce(q.work_area = c.work_area, false) AS same_area, list_intersect(qk, mk) AS mt, len(qk) > 0 AS has_query_keys FROM p),
x AS (SELECT *, least(9 * o, 36)
  + CASE WHEN q.repo_id IS NULL OR c.repo_id IS NULL THEN 0 WHEN same_repo THEN 30 WHEN strong_tag THEN -8 ELSE -25 END
  + CASE WHEN q.work_area IS NULL OR c.work_area IS NULL THEN 0 WHEN same_area THEN 18 WHEN o = 0 THEN -8 ELSE 0 END
  + CASE WHEN q.activity_domain = c.activity_domain AND q.activity_domain <> 'code' THEN 6 ELSE 0 END
  + CASE WHEN high > 0 AND NOT strong_tag THEN -18 ELSE 0 END AS context_points,
  len(list_filter(mt, lambda k: starts_with(k, 'pr:'))) AS n_strong, len(list_filter(mt, lambda k: starts_with(k, 'tool:'))) AS n_weak FROM f),
y AS (SELECT *, similarity + (context_points + least(28 * n_strong + 6 * n_weak, 70) + CASE WHEN scope = 'global' AND kind IN ('preference', 'lesson', 'workflow') THEN 8 ELSE 0 END
  - CASE WHEN has_query_keys AND n_strong + n_weak = 0 AND same_project THEN 24 ELSE 0 END - CASE WHEN has_query_keys AND n_strong + n_weak = 0 AND kind = 'task_state' THEN 35 ELSE 0 END
  - CASE WHEN scope = 'global' AND kind = 'task_state' AND n_strong + n_weak = 0 THEN 35 ELSE 0 END) / 100.0 + CASE WHEN same_project THEN 0.05 ELSE 0 END AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank,
  same_area OR (same_repo AND context_points >= 36) OR context_points >= 42 AS strong FROM y),
w AS (SELECT *, CASE WHEN n_strong > 0 THEN 'keep:strong_task_key_match' WHEN kind = 'task_state' AND has_query_keys THEN 'drop:task_state_without_task_key_match'
  WHEN kind = 'task_state' AND same_project AND strong THEN 'keep:task_state_strong_context' WHEN kind = 'task_state' THEN 'drop:task_state_weak_context'
  WHEN kind = 'project_fact' AND (same_project OR strong) THEN 'keep:project_fact_context' WHEN kind = 'project_fact' THEN 'drop:project_fact_wrong_context'
  WHEN scope = 'global' THEN 'keep:global_durable' WHEN same_project THEN 'keep:same_project_durable' WHEN strong THEN 'keep:cross_project_strong_context'
  WHEN n_weak > 0 THEN 'keep:weak_task_key_semantic_durable' ELSE 'keep:semantic_durable' END AS reason FROM z),
k AS (SELECT *, starts_with(reason, 'keep') AND sum(CASE WHEN starts_with(reason, 'keep') THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) <= {{limit}} AS selected FROM w)"""


@_query(f"WITH {_RANK_SQL.replace("{limit}", "5")} SELECT query_id, memory_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM z")
def hybrid_rank(spark, sf):
    return _ranked(spark, sf).select("query_id", "memory_id", F.col("rank").cast("long").alias("rank"), _r6("score").alias("score"))


@_query(f"WITH {_RANK_SQL.replace("{limit}", "5")} SELECT query_id, memory_id, reason FROM w")
def rule_filter_reasons(spark, sf):
    return recall.select(_ranked(spark, sf)).select("query_id", "memory_id", "reason")


@_query(f"WITH {_RANK_SQL.replace("{limit}", "5")} SELECT query_id, memory_id, selected FROM k")
def greedy_keep_first_k(spark, sf):
    return recall.select(_ranked(spark, sf), 5).select("query_id", "memory_id", "selected")


@_query(f"WITH {_RANK_SQL.replace("{limit}", "12")} SELECT query_id, memory_id, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM k WHERE selected) WHERE place <= 5")
def two_stage_limit(spark, sf):
    return recall.judged(recall.select(_ranked(spark, sf), 12), None).select("query_id", "memory_id", F.col("place").cast("long").alias("place"))


@_query(f"""WITH {_hits_sql(20)} SELECT query_id, memory_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS BIGINT) AS rank
FROM (SELECT h.query_id, h.memory_id, similarity + CASE WHEN project_id = query_id % 10 THEN 0.05 ELSE 0 END AS score FROM h JOIN m ON m.memory_id = h.memory_id)""")
def project_bonus_rerank(spark, sf):
    c = _hits(spark, sf, 20).drop("rank").join(_memories(spark, sf).select("memory_id", "project_id"), "memory_id").withColumn("same_project", F.col("project_id") == F.col("query_id") % 10)
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id"))
    return recall.project_bonus(c).select("query_id", "memory_id", _r6("score").alias("score"), r.cast("long").alias("rank"))


@_query(f"WITH {_RANK_SQL.replace("{limit}", "5")} SELECT query_id, string_agg(CAST(memory_id AS VARCHAR), ',' ORDER BY rank) AS memory_ids, '# Recall' || chr(10) || chr(10) || 'query_timestamp: t' || chr(10) || 'query_source: s' || chr(10) || 'memory_count: ' || count(*) || chr(10) || 'memory_ids: ' || string_agg(CAST(memory_id AS VARCHAR), ',' ORDER BY rank) || chr(10) || chr(10) || string_agg('## m' || memory_id || chr(10) || chr(10) || kind || chr(10) || chr(10) || 'created_at: unix:' || memory_id || chr(10) || CASE WHEN same_project THEN '' ELSE 'originating_project: p' || (SELECT project_id FROM m WHERE m.memory_id = k.memory_id) || chr(10) END || chr(10), '' ORDER BY rank) AS markdown FROM k WHERE selected GROUP BY query_id")
def render_recall_markdown(spark, sf):
    s = lambda c: F.col(c).cast("string")
    rows = recall.select(_ranked(spark, sf), 5).where("selected").withColumns({"title": F.concat(F.lit("m"), s("memory_id")), "body": F.col("kind"), "created_at": F.concat(F.lit("unix:"), s("memory_id")), "project_descriptor": F.concat(F.lit("p"), s("project_id"))})
    return recall.render(rows, "t", "s").select("query_id", F.array_join(F.transform("memory_ids", lambda i: i.cast("string")), ",").alias("memory_ids"), "markdown")


@_query(f"WITH {_M_SQL} SELECT memory_id, CAST(len(embedding) AS BIGINT) AS dimensions, kind FROM m WHERE is_active")
def embedding_join_active(spark, sf):
    m = _memories(spark, sf)
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("memory_id"), F.size("embedding").cast("long").alias("dimensions"))
    return e.join(m.where("is_active").select("memory_id", "kind"), "memory_id").select("memory_id", "dimensions", "kind")


_NEAR = "n AS (SELECT a.label AS part, a.vec_id AS a, b.vec_id AS b, 1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)"


@_query(f"WITH {_NEAR} SELECT part, a, b, round(d, 6) AS distance FROM n WHERE d <= 0.7")
def cluster_neighbours(spark, sf):
    return cluster.near_pairs(table(spark, sf, "embeddings"), "vec_id", "label", "embedding", 0.7).select("part", "a", "b", _r6("distance").alias("distance"))


_DB = f"""{_NEAR}, l AS (SELECT a, b FROM n WHERE d <= 0.7 UNION SELECT b, a FROM n WHERE d <= 0.7),
c AS (SELECT a AS id FROM l GROUP BY a HAVING count(*) + 1 >= 3),
cl AS (SELECT l.a, l.b FROM l WHERE l.a IN (FROM c) AND l.b IN (FROM c)),
r AS (SELECT id, id AS root FROM c UNION SELECT cl.b, r.root FROM r JOIN cl ON cl.a = r.id),
core AS (SELECT id, min(root) AS cluster, true AS is_core FROM r GROUP BY id),
bord AS (SELECT l.a AS id, min(core.cluster) AS cluster, false AS is_core FROM l JOIN core ON core.id = l.b WHERE l.a NOT IN (FROM c) GROUP BY l.a),
mem AS (FROM core UNION ALL FROM bord)"""


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("part"), F.col("embedding").alias("vector"))
    return cluster.dbscan(v, cluster.cluster_links(v, 0.7, 3), 3)


@_query(f"WITH RECURSIVE {_DB} SELECT id, cluster, is_core FROM mem")
def dbscan_clusters(spark, sf):
    return _clusters(spark, sf)


@_query(f"""WITH RECURSIVE {_DB}, pr AS (SELECT x.cluster, x.id, 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])) AS d FROM mem x JOIN mem y ON x.cluster = y.cluster AND x.id <> y.id JOIN embeddings e ON e.vec_id = x.id JOIN embeddings f ON f.vec_id = y.id),
mn AS (SELECT cluster, id, avg(d) AS md FROM pr GROUP BY ALL)
SELECT cluster, id, round(md, 6) AS mean_distance, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md, id) AS place FROM mn) WHERE place <= 5""")
def cluster_rank_densest(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return cluster.densest(_clusters(spark, sf), v).select("cluster", "id", _r6("mean_distance").alias("mean_distance"), F.col("place").cast("long").alias("place"))


# Texts of memories.

_STOPS = "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"
_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOK = "list_filter(list_distinct(regexp_split_to_array(" + _LOW + ", '[^a-z0-9]+')), lambda t: length(t) > 1 AND NOT list_contains(" + _STOPS + ", t))"
_JAC = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0 ELSE len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END"
_TITLE = "substr(string_split(coalesce(text, ''), chr(10))[1], 1, 80)"


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.substring(F.get(F.split(text, "\n"), F.lit(0)), 1, 80).alias("title"), text.alias("body"), F.lit("project").alias("scope"), F.col("source").alias("project_id"), "lang")


@_query(f"""WITH r AS (SELECT doc_id, lang, t FROM (SELECT doc_id, lang, list_sort({_TOK.format("text")}) AS t FROM documents) WHERE len(t) > 0), c AS (SELECT lang, t, min(doc_id) AS rep FROM r GROUP BY ALL)
SELECT a, b, round(j, 6) AS jaccard FROM (SELECT x.rep AS a, y.rep AS b, {_JAC.format("x.t", "y.t")} AS j FROM c x JOIN c y ON x.lang = y.lang AND x.rep < y.rep AND len(x.t) >= 0.72 * len(y.t) AND len(y.t) >= 0.72 * len(x.t)) WHERE j >= 0.72
UNION ALL SELECT c.rep, r.doc_id, 1.0 FROM r JOIN c ON r.lang IS NOT DISTINCT FROM c.lang AND r.t = c.t WHERE r.doc_id <> c.rep""")
def jaccard_duplicates(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return cluster.jaccard_pairs(rows, "doc_id", "lang", "text", 0.72).select("a", "b", _r6("jaccard").alias("jaccard"))


_ALIKE = "(tj >= {title} AND (bj >= {body} OR xj >= {text_with_title}) OR xj >= {text})"
_SETS = f"SELECT doc_id AS id, source AS part, {_TOK.format(_TITLE)} AS tt, {_TOK.format('text')} AS tb, {_TOK.format(_TITLE + ' || chr(10) || coalesce(text, chr(32))')} AS tx"
_SHARES = ", ".join(f"{_JAC.format(f'x.{c}', f'y.{c}')} AS {n}" for c, n in (("tt", "tj"), ("tb", "bj"), ("tx", "xj")))


@_query(f"""WITH RECURSIVE m AS ({_SETS}, 8 * len(tx) + length(coalesce(text, '')) AS info FROM documents),
p AS (SELECT part, a, b, beats FROM (SELECT x.part, x.id AS a, y.id AS b, y.info > x.info AS beats, {_SHARES} FROM m x JOIN m y ON x.part = y.part AND x.id < y.id) WHERE {_ALIKE.format(**cluster.DUPLICATE)}),
s AS (SELECT part, a, list({{'b': b, 'beats': beats}} ORDER BY b) AS rivals, row_number() OVER (PARTITION BY part ORDER BY a) AS i FROM p GROUP BY part, a),
r AS (SELECT DISTINCT part, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS gone FROM s
      UNION ALL SELECT part, i, CASE WHEN list_contains(gone, a) THEN gone ELSE list_concat(gone, list_transform(list_filter(left_, lambda q: stop IS NULL OR q.b < stop), lambda q: q.b), CASE WHEN stop IS NULL THEN [] ELSE [a] END) END
      FROM (SELECT *, list_min(list_transform(list_filter(left_, lambda q: q.beats), lambda q: q.b)) AS stop FROM (
        SELECT s.part, s.i, s.a, gone, list_filter(rivals, lambda q: NOT list_contains(gone, q.b)) AS left_ FROM r JOIN s ON s.part = r.part AND s.i = r.i + 1))),
g AS (SELECT unnest(gone) AS id FROM (SELECT part, max_by(gone, i) AS gone FROM r GROUP BY part))
SELECT doc_id AS id, source AS project_id FROM documents WHERE doc_id NOT IN (SELECT id FROM g)""")
def dedupe_survivors(spark, sf):
    m = _texts(spark, sf)
    return m.join(cluster.greedy_losers(m), "id", "left_anti").select("id", "project_id")


@_query(f"SELECT doc_id AS id, CAST(8 * len({_TOK.format(_TITLE + ' || chr(10) || coalesce(text, chr(32))')}) + length(coalesce(text, '')) AS BIGINT) AS score FROM documents")
def information_score(spark, sf):
    return _texts(spark, sf).select("id", tx.information_score(F.col("title"), F.col("body")).alias("score"))


@_query(f"""WITH RECURSIVE m AS (SELECT q.*, CAST(e.embedding AS DOUBLE[]) AS v, [CAST(vec_id // 3 AS BIGINT)] AS lin FROM ({_SETS} FROM documents) q JOIN embeddings e ON e.vec_id = q.id),
l0 AS (SELECT a, b FROM (SELECT x.id AS a, y.id AS b, 1 - list_cosine_similarity(x.v, y.v) AS d, x.lin = y.lin AS line, {_SHARES} FROM m x JOIN m y ON x.part = y.part AND x.id < y.id) WHERE d <= 0.7 OR line OR {_ALIKE.format(**cluster.ALIKE)}),
l AS (SELECT a, b FROM l0 UNION SELECT b, a FROM l0), c AS (SELECT a AS id FROM l GROUP BY a HAVING count(*) + 1 >= 3), cl AS (SELECT l.a, l.b FROM l WHERE l.a IN (FROM c) AND l.b IN (FROM c)),
r AS (SELECT id, id AS root FROM c UNION SELECT cl.b, r.root FROM r JOIN cl ON cl.a = r.id), core AS (SELECT id, min(root) AS cluster, true AS is_core FROM r GROUP BY id),
bord AS (SELECT l.a AS id, min(core.cluster) AS cluster, false AS is_core FROM l JOIN core ON core.id = l.b WHERE l.a NOT IN (FROM c) GROUP BY l.a)
SELECT id, cluster, is_core FROM core UNION ALL SELECT id, cluster, is_core FROM bord""")
def memory_clusters(spark, sf):
    t = _texts(spark, sf)
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.array(F.floor(F.col("vec_id") / 3)).alias("lin"))
    ids = small(*sized_stash(e.select("id"), "ids"))
    texts = t.select("id", F.col("project_id").alias("part"), F.col("title").alias("tt"), F.col("body").alias("tb")).join(ids, "id", "left_semi")
    m = word_sets(texts, ("tt", "tb"), "words").join(e, "id")
    return cluster.dbscan(m, cluster.cluster_links(m, 0.7, 3, cluster.ALIKE), 3)


_TERMS = "list_filter(list_distinct(regexp_split_to_array(" + _LOW + ", '[^a-z0-9]+')), lambda t: length(t) >= 3)"


@_query(f"""WITH q AS (SELECT item_id AS query_id, {_TERMS.format("text")} AS qt FROM benchmark WHERE item_id % 100 = 0), d AS (SELECT doc_id, {_TERMS.format("text")} AS dt FROM documents),
s AS (SELECT query_id, doc_id, CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, dt)) / len(qt) END AS score FROM q, d)
SELECT query_id, id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM (SELECT query_id, doc_id AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM s WHERE score > 0) WHERE rank <= 5""")
def lexical_score_topk(spark, sf):
    q = table(spark, sf, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), tx.terms(F.col("text")).alias("qt"))
    hits = q.select("query_id", F.size("qt").alias("nq"), F.explode("qt").alias("w"))
    words = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(tx.terms(F.col("text"))).alias("w"))
    scored = words.join(small(*sized_stash(hits, "hits")), "w").groupBy("query_id", "id", "nq").agg(F.count("*").alias("c")).select("query_id", "id", (F.col("c") / F.col("nq")).alias("score"), F.lit(0).alias("created_at"))
    return evals.replay_candidates(scored).select("query_id", "id", F.col("rank").cast("long").alias("rank"), _r6("score").alias("score"))


@_query("""WITH t AS (SELECT o_orderkey, 'Merged PR ' || o_orderkey || ', see ABC-' || o_custkey || ' and src/x/' || o_orderkey || '/Main.java; on branch fix-' || o_custkey || ' run just test' AS text FROM orders)
SELECT o_orderkey, 'pr:' || o_orderkey || ',' || 'ticket:ABC-' || regexp_extract(text, 'ABC-([0-9]+)', 1) || ',path:src/x/' || o_orderkey || '/main.java,branch:' || regexp_extract(text, 'branch (fix-[0-9]+)', 1) || ',tool:just' AS keys FROM t""")
def task_key_extract(spark, sf):
    s = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit("Merged PR "), s("o_orderkey"), F.lit(", see ABC-"), s("o_custkey"), F.lit(" and src/x/"), s("o_orderkey"), F.lit("/Main.java; on branch fix-"), s("o_custkey"), F.lit(" run just test"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(tx.task_keys_of(text), ",").alias("keys"))


def _kind_sql() -> str:
    low = _LOW.format(_TITLE + " || ' ' || coalesce(text, '')")
    cases = " ".join(f"WHEN {' OR '.join(f'contains(low, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{k}'" for k, ws in tx.KIND_WORDS)
    return f"SELECT doc_id AS id, CASE {cases} ELSE 'project_fact' END AS kind FROM (SELECT doc_id, {low} AS low FROM documents)"


@_query(_kind_sql())
def memory_kind_infer(spark, sf):
    return _texts(spark, sf).select("id", tx.infer_kind(F.col("title"), F.col("body"), F.col("scope")).alias("kind"))


@_query("""SELECT source, lower(lpad(hex(CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), list_transform(regexp_extract_all(hex(encode(coalesce(source, ''))), '..'), lambda x: CAST(CAST('0x' || x AS INTEGER) AS UHUGEINT))),
  lambda h, b: (xor(h, b) * CAST(1099511628211 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT)) AS UBIGINT)), 16, '0')) AS hash FROM (SELECT DISTINCT source FROM documents)""")
def project_hash_fnv(spark, sf):
    return table(spark, sf, "documents").select("source").distinct().select("source", tx.fnv1a(F.coalesce("source", F.lit(""))).alias("hash"))


@_query("SELECT page_id, 'session-' || CASE WHEN s = '' THEN 'unknown' ELSE s END || '.md' AS file FROM (SELECT page_id, regexp_replace(coalesce(url, ''), '[^A-Za-z0-9_-]', '_', 'g') AS s FROM pages)")
def safe_session_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.recall_file(F.coalesce("url", F.lit(""))).alias("file"))


@_query("SELECT doc_id, left(text, 120) AS plain, CASE WHEN length(text) > 120 THEN left(text, 105) || '[truncated]' ELSE text END AS marked, CASE WHEN length(text) > 120 THEN left(text, 120) || '...' ELSE text END AS dots FROM documents")
def truncate_variants(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", *[tx.truncated(t, 120, h).alias(h) for h in ("plain", "marked", "dots")])


# Turns.

_T_SQL = """g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations),
t AS (SELECT conv_id AS session_id, CAST(g - 1 AS BIGINT) AS ordinal, CASE WHEN bool_or(role = 'assistant') THEN 'completed' ELSE 'aborted' END AS status, list(text ORDER BY turn) AS texts FROM g WHERE g > 0 GROUP BY conv_id, g)"""


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return turns.from_messages(table(spark, sf, "conversations"))


@_query(f"WITH {_T_SQL} SELECT session_id, ordinal, status, CAST(len(texts) AS BIGINT) AS n FROM t")
def turn_segmentation(spark, sf):
    return _turns(spark, sf).select("session_id", "ordinal", "status", F.size("texts").cast("long").alias("n"))


@_query(f"WITH {_T_SQL} SELECT session_id, ordinal, array_to_string(texts, chr(10)) AS display_text FROM t")
def turn_display_text(spark, sf):
    return _turns(spark, sf).select("session_id", "ordinal", F.array_join("texts", "\n").alias("display_text"))


@_query("SELECT conv_id, turn, CAST(e - strlen(text) - 1 AS BIGINT) AS line_start, CAST(e AS BIGINT) AS line_end FROM (SELECT *, sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations)")
def turn_byte_offsets(spark, sf):
    end = F.sum(F.octet_length("text") + 1).over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").withColumn("line_end", end).select("conv_id", "turn", (F.col("line_end") - F.octet_length("text") - 1).alias("line_start"), "line_end")


@_query(f"WITH {_T_SQL} SELECT session_id, ordinal, status FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ordinal DESC) AS r FROM t) WHERE r <= 3")
def last_n_turns(spark, sf):
    return turns.last_turns(_turns(spark, sf), 3).select("session_id", "ordinal", "status")


@_query(f"WITH {_T_SQL}, c AS (SELECT *, list(array_to_string(texts, chr(10))) OVER (PARTITION BY session_id ORDER BY ordinal RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS w FROM t WHERE status = 'completed') SELECT session_id, ordinal, left(array_to_string(w, chr(10)), 12000) AS query_text FROM c")
def live_window_query(spark, sf):
    w = turns.live_windows(_turns(spark, sf), 3, F.array_join("texts", "\n"))
    return w.select("session_id", "ordinal", tx.recall_query_text(F.col("window")).alias("query_text"))


@_query(f"WITH {_T_SQL}, c AS (SELECT *, list(CAST(ordinal AS VARCHAR)) OVER (PARTITION BY session_id ORDER BY ordinal ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS w FROM t) SELECT session_id, ordinal, coalesce(array_to_string(w, ','), '') AS before FROM c")
def replay_context(spark, sf):
    return turns.replay_windows(_turns(spark, sf), 3, F.col("ordinal").cast("string")).select("session_id", "ordinal", F.array_join("window", ",").alias("before"))


_LOTS = f"{_T_SQL}, lt AS (SELECT session_id, CAST((rn - 1) // 2 AS BIGINT) AS batch, min(ordinal) AS first, max(ordinal) AS last, count(*) AS n, list(ordinal) AS refs FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) AS rn FROM t WHERE status = 'completed') GROUP BY ALL)"


@_query(f"WITH {_LOTS} SELECT session_id, batch, first, last, n FROM lt WHERE n = 2 OR session_id % 2 = 0")
def formulation_batches(spark, sf):
    return turns.batches(_turns(spark, sf), 2, F.col("session_id") % 2 == 0).select("session_id", "batch", "first", "last", "n")


@_query(f"WITH {_LOTS}, cv AS (SELECT session_id, ordinal FROM t WHERE (session_id + ordinal) % 3 <> 0), u AS (SELECT session_id, batch, unnest(refs) AS ordinal FROM lt) SELECT DISTINCT u.session_id, u.batch FROM u LEFT JOIN cv ON cv.session_id = u.session_id AND cv.ordinal = u.ordinal WHERE cv.ordinal IS NULL")
def uncovered_batches(spark, sf):
    t = _turns(spark, sf)
    sources = t.where("(session_id + ordinal) % 3 <> 0").groupBy((F.col("session_id") % 50).alias("id")).agg(F.collect_list(F.struct("session_id", "ordinal")).alias("source_turn_refs"))
    return turns.uncovered(turns.batches(t, 2), turns.covered_turns(sources.withColumn("is_active", F.lit(True)))).select("session_id", "batch")


@_query("WITH s AS (SELECT conv_id AS session_id, conv_id % 7 AS project_id, max(turn) AS last_seen FROM conversations GROUP BY conv_id) SELECT project_id, session_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY last_seen DESC, session_id DESC) AS r FROM s) WHERE r = 1")
def latest_session_per_project(spark, sf):
    s = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.max("turn").alias("last_seen")).withColumn("project_id", F.col("session_id") % 7)
    return state.latest_per(s, "project_id", F.desc("last_seen"), F.desc("session_id")).select("project_id", "session_id")


@_query(f"WITH {_T_SQL}, s AS (SELECT DISTINCT conv_id AS session_id FROM conversations) SELECT s.session_id, count(t.ordinal) AS n FROM s LEFT JOIN t ON t.session_id = s.session_id AND t.status = 'completed' GROUP BY ALL")
def completed_turns_per_session(spark, sf):
    s = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    n = _turns(spark, sf).where("status = 'completed'").groupBy("session_id").agg(F.count("*").alias("n"))
    return s.join(n, "session_id", "left").select("session_id", F.coalesce("n", F.lit(0)).alias("n"))


#: Sentence shapes: text and its keys, with {k} the order's and {c} the customer's key.
_SHAPES = (
    ("Merged PR #{k}, see ABC-{c}; ABC-{c} again.", "pr:{k},ticket:ABC-{c}"),
    ("fixes https://host.org/Team/pull/{k}/files and (pull/{c}) or pr#{c}!", "pr:{k},pr:{c}"),
    ("on Branch: Fix-{c} edit ./src/Mod{k}/Main.PY: then `cargo`, {{gh}}", "branch:fix-{c},path:src/mod{k}/main.py,tool:cargo,tool:gh"),
    ("see http://no.path/{k} but tests/{k} and ~/notes/{c}/ or a/b", "path:tests/{k},path:~/notes/{c}"),
    ("pull request none, branch -x, x-{c} X1-{c} pr\u00a0{k}", "ticket:X1-{c},pr:{k}"),
)


def _shape_sql(text: str) -> str:
    return "'" + text.replace("{{", "{").replace("}}", "}").replace("{k}", "' || o_orderkey || '").replace("{c}", "' || o_custkey || '") + "'"


@_query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 AND o_orderkey = o_custkey THEN 'pr:' || o_orderkey ELSE CASE o_orderkey % 5 {' '.join(f'WHEN {i} THEN {_shape_sql(keys)}' for i, (_, keys) in enumerate(_SHAPES))} END END AS keys FROM orders")
def task_key_shapes(spark, sf):
    plain = lambda t: F.concat(*[F.col({"k": "o_orderkey", "c": "o_custkey"}[x]).cast("string") if n % 2 else F.lit(x) for n, x in enumerate(re.split(r"\{([kc])\}", t.replace("{{", "{").replace("}}", "}")))])
    text = F.lit(None).cast("string")
    for i, (shape, _) in enumerate(_SHAPES):
        text = F.when(F.col("o_orderkey") % 5 == i, plain(shape)).otherwise(text)
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(tx.task_keys_of(text), ",").alias("keys"))


@_query(f"WITH {_T_SQL}, s AS (SELECT DISTINCT conv_id AS session_id FROM conversations) SELECT s.session_id, coalesce(max(ordinal) + 1, 0) AS next_ordinal FROM s LEFT JOIN t ON t.session_id = s.session_id GROUP BY ALL")
def next_ordinal(spark, sf):
    return turns.next_ordinals(table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id")).distinct(), _turns(spark, sf))


@_query(f"WITH {_T_SQL}, a AS (SELECT session_id, min(ordinal) AS anchor FROM t GROUP BY session_id) SELECT session_id, anchor, ordinal, CAST(place AS BIGINT) AS place FROM (SELECT a.session_id, anchor, t.ordinal, row_number() OVER (PARTITION BY a.session_id ORDER BY t.ordinal) AS place FROM a JOIN t ON t.session_id = a.session_id AND t.ordinal > a.anchor AND t.status = 'completed') WHERE place <= 20")
def late_evidence(spark, sf):
    t = _turns(spark, sf)
    anchors = t.groupBy("session_id").agg(F.min("ordinal").alias("anchor"))
    return turns.later_turns(anchors, t).select("session_id", "anchor", "ordinal", F.col("place").cast("long").alias("place"))


@_query("WITH m AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'), e AS (SELECT user_id, event_id, ts FROM events) SELECT e.event_id, count(m.ts) AS eligible FROM e LEFT JOIN m ON m.user_id = e.user_id AND m.ts < e.ts GROUP BY e.event_id")
def asof_memories(spark, sf):
    e = table(spark, sf, "events")
    return evals.eligible_before(e, "user_id", "ts", F.col("event_type") == "purchase").select("event_id", "eligible")


@_query(f"""WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 100 = 0), m AS (SELECT event_id AS id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
p AS (SELECT q.event_id AS query_id, id, CASE WHEN m.user_id = q.user_id THEN 1 ELSE 0 END + value / 1000 AS score, epoch_us(m.ts) AS created_at FROM q JOIN m ON m.ts < q.ts)
SELECT query_id, id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC, id DESC) AS rank FROM p) WHERE rank <= 5""")
def asof_topk(spark, sf):
    e = table(spark, sf, "events")
    q = e.where("event_id % 100 = 0").select(F.col("event_id").alias("query_id"), F.col("user_id").alias("q_user"), F.col("ts").alias("seen_at"))
    m = e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("made_at"), "value", F.lit(True).alias("is_active"))
    base = F.col("value") / 1000
    found = evals.best_before_keyed(q, m, "seen_at", "made_at", "q_user", "user_id", 0 + base, 1 + base, F.unix_micros(F.col("made_at").cast("timestamp")))
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"), _r6("score").alias("score"))


# Transcripts: conversations written as JSONL, one file each, and read by the parsers.


def _transcripts(spark: SparkSession, sf: str, line: Column) -> DataFrame:
    """Lines with byte places of a file for each conversation, whose line for a message is `line`."""
    rows = table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("r"))
    text = F.concat(F.array_join(F.transform("r", lambda x: x["line"]), "\n"), F.lit("\n"))
    return transcripts.with_offsets(rows.select("path", F.lit(0).cast("long").alias("base"), text.alias("text")))


@_query("SELECT conv_id, CAST(row_number() OVER w - 1 AS BIGINT) AS line_no, CAST(sum(n + 1) OVER w - n - 1 AS BIGINT) AS line_start, CAST(sum(n + 1) OVER w AS BIGINT) AS line_end FROM (SELECT conv_id, turn, strlen(regexp_replace(text, '[\r\n]', ' ', 'g')) AS n FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def transcript_line_offsets(spark, sf):
    lines = _transcripts(spark, sf, F.regexp_replace("text", "[\r\n]", " "))
    return lines.select(F.col("path").cast("long").alias("conv_id"), F.col("line_no").cast("long").alias("line_no"), "line_start", "line_end")


@_query("""WITH k AS (SELECT *, role = 'assistant' AS c FROM conversations WHERE role IN ('user', 'assistant')),
o AS (SELECT *, role = 'user' OR coalesce(lag(c) OVER (PARTITION BY conv_id ORDER BY turn), true) AS opens FROM k),
g AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM o)
SELECT conv_id AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) - 1 AS BIGINT) AS ordinal, array_to_string(list(text ORDER BY turn), chr(10)) AS display_text FROM g GROUP BY conv_id, g HAVING bool_or(c)""")
def role_dialect_turns(spark, sf):
    lines, _ = transcripts.sound_files(_transcripts(spark, sf, F.to_json(F.struct("role", F.col("text").alias("content")))))
    return transcripts.role_turns(transcripts.role_events(lines)).select(F.col("path").cast("long").alias("session_id"), "ordinal", "display_text")


@_query("""WITH g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations),
e AS (SELECT *, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id, g) AS ending FROM g WHERE g > 0)
SELECT conv_id AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) - 1 AS BIGINT) AS ordinal, CAST(min(turn) AS VARCHAR) AS turn_id, 'completed' AS status,
  array_to_string(list(text ORDER BY turn) FILTER (WHERE role = 'system'), chr(10)) AS display_text FROM e WHERE turn <= ending GROUP BY conv_id, g""")
def marker_dialect_turns(spark, sf):
    role, none = F.col("role"), F.lit(None).cast("string")
    kind = F.when(role == "user", "task_started").when(role == "assistant", "task_complete").otherwise("agent_message")
    body = F.struct(kind.alias("type"), F.when(role == "user", F.col("turn").cast("string")).alias("turn_id"), F.when(role == "system", F.col("text")).otherwise(none).alias("message"))
    lines, _ = transcripts.sound_files(_transcripts(spark, sf, F.to_json(F.struct(F.lit("event_msg").alias("type"), body.alias("payload")))))
    return transcripts.marker_turns(transcripts.marker_events(lines)).select(F.col("path").cast("long").alias("session_id"), "ordinal", "turn_id", "status", "display_text")


@_query("""WITH g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations),
e AS (SELECT *, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id, g) AS ending FROM g WHERE g > 0)
SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) - 1 AS BIGINT) AS ordinal, CAST(min(turn) AS VARCHAR) AS turn_id, CASE WHEN max(ending) % 4 = 3 THEN 'aborted' ELSE 'completed' END AS status,
  nullif(array_to_string(list(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ORDER BY turn) FILTER (WHERE role = 'system'), chr(10)), '') AS display_text FROM e WHERE turn <= ending GROUP BY conv_id, g""")
def stream_turns(spark, sf):
    role, none = F.col("role"), F.lit(None).cast("string")
    ends = F.when(F.col("turn") % 4 == 3, "task_aborted").otherwise("task_complete")
    kind = F.when(role == "user", "task_started").when(role == "assistant", ends).otherwise("agent_message")
    body = F.struct(kind.alias("type"), F.when(role == "user", F.col("turn").cast("string")).alias("turn_id"), F.when(role == "system", F.col("text")).otherwise(none).alias("message"))
    meta = F.struct(F.lit("session_meta").alias("type"), F.struct(F.col("path").alias("id")).alias("payload"))
    rows = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("path"), "turn", F.to_json(F.struct(F.lit("event_msg").alias("type"), body.alias("payload"))).alias("value"))
    heads = rows.select("path").distinct().select("path", F.lit(None).cast("long").alias("turn"), F.to_json(meta).alias("value"))
    root, out, state_path = (fresh_path(spark, f"stream-{x}") for x in ("in", "out", "state"))
    lines = heads.unionByName(rows).repartition("path").sortWithinPartitions("path", F.asc_nulls_first("turn"))
    lines.select("path", "value").write.partitionBy("path").text(root)  # a file for each conversation
    run = streaming.turn_stream(streaming.stream_lines(spark, root, suffix=".txt")).writeStream.format("parquet").option("path", out).option("checkpointLocation", state_path).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out).select("session_id", "ordinal", "turn_id", "status", "display_text")


# Tasks.

_TASK_SQL = f"""k AS (SELECT event_id AS id, event_type AS kind, CASE event_type WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'parked' ELSE 'queued' END AS status,
  coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) % 5 AS priority, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'unix:' || CAST(floor(epoch(ts)) AS BIGINT) END AS next_run_at, CASE WHEN event_id % 10 = 0 THEN 'error ' || event_id END AS last_error, CAST(floor(epoch(ts)) AS BIGINT) AS updated, user_id, props FROM events),
x AS (SELECT *, CASE WHEN status = 'queued' AND next_run_at IS NOT NULL AND CAST(substr(next_run_at, 6) AS BIGINT) > {NOW} THEN 'scheduled' ELSE status END AS display_status FROM k)"""


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    kind, s = F.col("event_type"), F.unix_seconds(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), kind.alias("kind"), F.when(kind == "click", "running").when(kind == "purchase", "completed").when(kind == "error", "parked").otherwise("queued").alias("status"),
        (F.coalesce(k, F.lit(0)) % 5).alias("priority"), F.when(F.col("event_id") % 3 == 0, None).otherwise(F.concat(F.lit("unix:"), s.cast("string"))).alias("next_run_at"),
        F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("error "), F.col("event_id").cast("string"))).alias("last_error"), s.alias("updated_at"), "user_id", "props",
    )


@_query(f"WITH {_TASK_SQL} SELECT id, display_status FROM x")
def task_display_status(spark, sf):
    return _tasks(spark, sf).select("id", tx.display_status(F.col("status"), F.col("next_run_at"), NOW).alias("display_status"))


@_query(f"WITH {_TASK_SQL} SELECT id, priority FROM k WHERE status = 'queued' AND (next_run_at IS NULL OR CAST(substr(next_run_at, 6) AS BIGINT) <= {NOW}) ORDER BY priority DESC, id LIMIT 20")
def next_due_tasks(spark, sf):
    return tasks.next_due(_tasks(spark, sf), NOW, 20).select("id", "priority")


@_query(f"WITH {_TASK_SQL} SELECT id, last_error FROM k WHERE last_error IS NOT NULL ORDER BY updated DESC, id DESC LIMIT 5")
def recent_failures(spark, sf):
    return tasks.recent_failures(_tasks(spark, sf)).select("id", "last_error")


@_query(f"WITH {_TASK_SQL} SELECT kind, display_status, count(*) AS n FROM x GROUP BY ALL")
def task_status_counts(spark, sf):
    return _tasks(spark, sf).groupBy("kind", tx.display_status(F.col("status"), F.col("next_run_at"), NOW).alias("display_status")).agg(F.count("*").alias("n"))


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_payload_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@_query("SELECT conv_id, turn FROM conversations c WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.conv_id AND e.event_type = 'purchase')")
def anchor_exists_semi(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("conv_id"))
    return table(spark, sf, "conversations").select("conv_id", "turn").join(e, "conv_id", "left_semi")


@_query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unseen_anti(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@_query("""WITH o AS (SELECT c_custkey AS id, 'codex' AS agent_type, c_nationkey AS project_id, CASE WHEN c_custkey % 2 = 0 THEN 'a' END AS started_at, 'x' AS last_seen_at FROM customer WHERE c_custkey % 3 <> 0),
n AS (SELECT c_custkey AS id, 'claude-code' AS agent_type, c_nationkey + 1 AS project_id, 'b' AS started_at, 'y' AS last_seen_at FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 = 0)
SELECT coalesce(o.id, n.id) AS id, coalesce(n.agent_type, o.agent_type) AS agent_type, coalesce(n.project_id, o.project_id) AS project_id, coalesce(o.started_at, n.started_at) AS started_at, coalesce(n.last_seen_at, o.last_seen_at) AS last_seen_at FROM o FULL JOIN n ON n.id = o.id""")
def upsert_sessions(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    old = c.where(k % 3 != 0).select(k.alias("id"), F.lit("codex").alias("agent_type"), F.col("c_nationkey").alias("project_id"), F.when(k % 2 == 0, "a").alias("started_at"), F.lit("x").alias("last_seen_at"))
    new = c.where((k % 2 == 0) | (k % 5 == 0)).select(k.alias("id"), F.lit("claude-code").alias("agent_type"), (F.col("c_nationkey") + 1).alias("project_id"), F.lit("b").alias("started_at"), F.lit("y").alias("last_seen_at"))
    return state.upsert_sessions(old, new)


@_query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id % 7 = 0 AND o.event_id % 2 = 1 AND o.user_id = events.user_id AND o.event_type = events.event_type)) WHERE r = 1")
def insert_or_ignore_turns(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return state.insert_or_ignore(e.where("event_id % 7 = 0 AND event_id % 2 = 1"), e.where("event_id % 2 = 0"), ["user_id", "event_type"], ["event_id"])


@_query(f"WITH {_M_SQL} SELECT memory_id AS id, is_active AND NOT kind = 'task_state' AS is_active, CASE WHEN is_active AND kind = 'task_state' THEN 'now' ELSE 'old' END AS updated_at FROM m")
def soft_delete(spark, sf):
    m = _memories(spark, sf).select(F.col("memory_id").alias("id"), "kind", "is_active", F.lit("old").alias("updated_at"))
    return state.deactivate(m, F.col("kind") == "task_state", "now").select("id", "is_active", "updated_at")


@_query("SELECT count(*) AS files, CAST(coalesce(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)), 0) AS BIGINT) AS turns, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'view') AS last_activity_at FROM events")
def counter_accumulate(spark, sf):
    d = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.lit(1).alias("files"), F.get_json_object("props", "$.k").try_cast("long").alias("turns"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("last_activity_at"))
    return state.counters(d, ["files", "turns"], "last_activity_at")


# Evaluations.

_E_SQL = """er AS (SELECT event_id AS id, user_id AS eval_run_id, CASE WHEN k BETWEEN 1 AND 5 THEN CAST(k AS VARCHAR) WHEN k = 6 THEN 'insufficient_context' END AS judge_score FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS k FROM events)),
ru AS (SELECT c_custkey AS id, c_custkey % 13 AS session_id, c_custkey % 10 AS turn_ordinal FROM customer)"""


def _results(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long") % 7
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("eval_run_id"), F.when(k.between(1, 5), k.cast("string")).when(k == 6, "insufficient_context").alias("judge_score"))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), (k % 13).alias("session_id"), (k % 10).alias("turn_ordinal"))


@_query(f"WITH {_E_SQL} SELECT ru.id, count(er.id) AS n_results, string_agg(DISTINCT judge_score, ',' ORDER BY judge_score) AS score FROM ru LEFT JOIN er ON er.eval_run_id = ru.id GROUP BY ru.id")
def eval_run_rollup(spark, sf):
    return evals.run_rollup(_runs(spark, sf), _results(spark, sf))


@_query(f"WITH {_E_SQL} SELECT CASE WHEN judge_score = 'insufficient_context' THEN 'n/a' ELSE judge_score END AS score, count(*) AS n FROM er GROUP BY ALL")
def eval_score_histogram(spark, sf):
    return evals.score_histogram(_results(spark, sf))


@_query(f"""WITH {_E_SQL}, p AS (SELECT eval_run_id AS id, count(*) AS c, count(TRY_CAST(judge_score AS BIGINT)) AS j, sum(TRY_CAST(judge_score AS BIGINT)) AS s FROM er GROUP BY ALL)
SELECT session_id, count(*) AS runs, CAST(coalesce(sum(c), 0) AS BIGINT) AS results, CAST(coalesce(sum(j), 0) AS BIGINT) AS judged, round(CASE WHEN coalesce(sum(j), 0) = 0 THEN 0 ELSE sum(s) / sum(j) END, 6) AS average, max(ru.id) AS latest_run, arg_max(turn_ordinal, ru.id) AS latest_turn FROM ru LEFT JOIN p ON p.id = ru.id GROUP BY session_id""")
def eval_session_summary(spark, sf):
    return evals.session_summary(_runs(spark, sf), _results(spark, sf)).withColumn("average", _r6("average"))


@_query(f"""WITH {_E_SQL}, r AS (SELECT eval_run_id, count(n) AS j, count(*) FILTER (WHERE n >= 4) AS g, count(*) FILTER (WHERE n <= 2) AS l FROM (SELECT *, TRY_CAST(judge_score AS BIGINT) AS n FROM er) GROUP BY ALL)
SELECT CAST(sum(j) AS BIGINT) AS numeric_results, CAST(sum(g) AS BIGINT) AS good_results, CAST(sum(l) AS BIGINT) AS low_results, count(*) FILTER (WHERE j > 0) AS evaluated_runs, count(*) FILTER (WHERE g > 0) AS useful_runs FROM r""")
def usefulness_rollup(spark, sf):
    return evals.usefulness(_results(spark, sf))


@_query(f"""WITH {_T_SQL}, el AS (SELECT DISTINCT session_id, ordinal AS turn_ordinal FROM t WHERE status = 'completed'), re AS (SELECT DISTINCT user_id AS session_id, CAST(event_id % 3 AS BIGINT) AS turn_ordinal FROM events WHERE event_type = 'click'),
ev AS (SELECT DISTINCT user_id AS session_id, CAST(event_id % 3 AS BIGINT) AS turn_ordinal FROM events WHERE event_type = 'purchase'), ran AS (FROM re UNION FROM ev),
a AS (SELECT count(*) AS e, count(ran.session_id) AS r, count(ev.session_id) AS v FROM el LEFT JOIN ran USING (session_id, turn_ordinal) LEFT JOIN ev USING (session_id, turn_ordinal))
SELECT e AS eligible_turns, r AS recall_runs, v AS nonempty_runs, CASE WHEN e = 0 THEN 0 ELSE r / e END AS recall_rate, CASE WHEN r = 0 THEN 0 ELSE v / r END AS nonempty_rate FROM a""")
def recall_rates(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 3).alias("turn_ordinal"), "event_type", F.lit(1).alias("n"))
    ok = _turns(spark, sf).where("status = 'completed'").select("session_id", F.col("ordinal").alias("turn_ordinal"))
    return evals.recall_rates(ok, e.where("event_type = 'click'"), e.where("event_type = 'purchase'"))


@_query("WITH v AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n FROM events GROUP BY user_id) SELECT round(avg(n), 6) AS avg_n, CAST(quantile_disc(n, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(n, 0.9) AS BIGINT) AS p90, count(*) FILTER (WHERE n = 0) AS b_0, count(*) FILTER (WHERE n BETWEEN 1 AND 2) AS b_1_2, count(*) FILTER (WHERE n BETWEEN 3 AND 5) AS b_3_5, count(*) FILTER (WHERE n > 5) AS b_over_5 FROM v")
def volume_percentiles(spark, sf):
    v = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n"))
    return evals.volumes(v).withColumn("avg_n", _r6("avg_n"))


@_query("SELECT count_if(CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0) AS attempted, count_if(CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 = 0) AS applied, count_if(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 = 0) AS fallback, count_if(event_type = 'error') AS errors, round(avg(CAST(json_extract_string(props, '$.k') AS BIGINT)), 6) AS avg_candidates, round(coalesce(avg(greatest(event_id % 5 - event_id % 3, 0)) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 = 0), 0), 6) AS avg_dropped FROM events")
def filter_telemetry(spark, sf):
    k, e = F.get_json_object("props", "$.k").try_cast("long"), F.col("event_id")
    rows = table(spark, sf, "events").select(k.alias("candidate_count"), (e % 5).alias("deterministic_selected_count"), (e % 3).alias("final_selected_count"), (k % 2 == 0).alias("llm_attempted"), (k % 3 == 0).alias("llm_applied"), (k % 5 == 0).alias("llm_empty_fallback"), F.when(F.col("event_type") == "error", "e").alias("llm_error"))
    return evals.filter_telemetry(rows).withColumns({c: _r6(c) for c in ("avg_candidates", "avg_dropped")})


@_query(f"WITH {_M_SQL} SELECT scope, kind AS memory_kind, is_active, count(*) AS n FROM m GROUP BY ALL")
def memory_stats_scope_kind(spark, sf):
    return evals.memory_stats(_memories(spark, sf).withColumnRenamed("kind", "memory_kind"))


@_query(f"WITH {_M_SQL} SELECT project_id, count(*) AS n FROM m WHERE is_active GROUP BY project_id ORDER BY n DESC, project_id LIMIT 20")
def top_projects(spark, sf):
    return evals.top_projects(_memories(spark, sf))


@_query("SELECT user_id AS session_id, turn_ordinal, id FROM (SELECT user_id, event_id AS id, event_id % 3 AS turn_ordinal, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def first_per_anchor(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 3).alias("turn_ordinal"), F.col("event_id").alias("id"))
    return tasks.first_per_anchor(rows).select("session_id", "turn_ordinal", "id")


@_query("""WITH m AS (SELECT vec_id, unnest([{'p': 0, 's': vec_id % 50, 'o': vec_id % 3}, {'p': 1, 's': vec_id % 40, 'o': vec_id % 2}, {'p': 2, 's': vec_id % 50, 'o': vec_id % 3}]) AS r FROM embeddings)
SELECT vec_id, r.s AS session_id, r.o AS ordinal, CAST(min(r.p) AS INT) AS pos FROM m GROUP BY ALL""")
def lineage_expand(spark, sf):
    v = F.col("vec_id")
    ref = lambda s, o: F.struct((v % s).alias("session_id"), (v % o).alias("ordinal"))
    rows = table(spark, sf, "embeddings").select("vec_id", F.array(ref(50, 3), ref(40, 2), ref(50, 3)).alias("refs"))
    return turns.distinct_refs(rows, "vec_id", "refs").select("vec_id", "session_id", "ordinal", "pos")


@_query(f"WITH {_T_SQL}, m AS (SELECT vec_id, vec_id % 50 AS s, vec_id % 3 AS o FROM embeddings) SELECT vec_id, session_id, ordinal, CASE WHEN vec_id % 4 = 0 THEN 'none' WHEN s = session_id AND o < ordinal THEN 'same_session_prior' ELSE 'different_context' END AS citation FROM m JOIN t ON t.session_id = m.s")
def citation_score(spark, sf):
    v = F.col("vec_id")
    refs = F.when(v % 4 == 0, F.array().cast("array<struct<session_id:bigint,ordinal:bigint>>")).otherwise(F.array(F.struct((v % 50).alias("session_id"), (v % 3).alias("ordinal"))))
    m = table(spark, sf, "embeddings").select("vec_id", refs.alias("refs"), (v % 50).alias("session_id"))
    return m.join(_turns(spark, sf), "session_id").select("vec_id", "session_id", "ordinal", tx.citation(F.col("refs"), F.col("session_id"), F.col("ordinal")).alias("citation"))


@_query("SELECT user_id, event_id, CAST(sum(p) OVER (PARTITION BY user_id ORDER BY s, event_id) AS BIGINT) AS idle_session FROM (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) > 21600 THEN 1 ELSE 0 END AS p FROM (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events))")
def idle_sessions(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return turns.sessions_by_gap(e, "user_id", F.col("s"), 21600).select("user_id", "event_id", "idle_session")


@_query("SELECT CAST(floor(epoch(arg_max(ts, event_id))) AS BIGINT) + 300 AS due_at FROM events")
def dark_period_due(spark, sf):
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    m = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("unix:"), s.cast("string")).alias("created_at"), F.lit(True).alias("is_active"))
    none = spark.createDataFrame([], "id long, kind string, status string, updated_at string")
    return tasks.consolidation_due(m, none, 300)


@_query("WITH m AS (SELECT CAST(floor(epoch(arg_max(ts, event_id))) AS BIGINT) AS seen FROM events WHERE event_type = 'click'), k AS (SELECT CAST(floor(epoch(arg_max(ts, event_id))) AS BIGINT) AS done FROM events WHERE event_type = 'purchase' AND event_id % 2 = 0) SELECT seen + 300 AS due_at FROM m, k WHERE done IS NULL OR done < seen")
def dark_period_after_work(spark, sf):
    """Memories are clicks; completed consolidations are every other purchase, other work the rest."""
    s = F.concat(F.lit("unix:"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"))
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), s.alias("at"), "event_type")
    m = e.where("event_type = 'click'").select("id", F.col("at").alias("created_at"), F.lit(True).alias("is_active"))
    kind = F.when(F.col("id") % 2 == 0, "memory_consolidation").otherwise("recall")
    k = e.where("event_type = 'purchase'").select("id", kind.alias("kind"), F.when(F.col("id") % 2 == 0, "completed").otherwise("queued").alias("status"), F.col("at").alias("updated_at"))
    return tasks.consolidation_due(m, k, 300)


# The judge: of the queries by turns, one call fails, one names nothing, one names every third memory and one isn't made.
_JUDGE_SQL = f"""{_RANK_SQL.replace("{limit}", "12")}, pool AS (SELECT query_id, memory_id, rank, query_id // 100 % 4 AS way, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM k WHERE selected),
hit AS (SELECT *, way = 2 AND memory_id % 3 = 0 AS hit, bool_or(way = 2 AND memory_id % 3 = 0) OVER (PARTITION BY query_id) AS named FROM pool),
kept AS (SELECT query_id, memory_id, way, named, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM hit WHERE CASE WHEN way IN (0, 3) THEN true WHEN NOT named THEN place = 1 ELSE hit END)"""


def _judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    chosen = stash(recall.select(_ranked(spark, sf), 12), "chosen")
    way = F.floor(F.col("query_id") / 100) % 4
    listed = F.concat(F.collect_list(F.when(F.col("selected") & (F.col("memory_id") % 3 == 0), F.col("memory_id"))), F.array(F.lit(-5).cast("long")))
    v = chosen.groupBy("query_id").agg(listed.alias("n")).where(way != 3)
    return chosen, v.select("query_id", F.when(way == 1, F.array().cast("array<long>")).when(way == 2, F.col("n")).alias("ids"), F.when(way == 0, "failed").alias("error"))


@_query(f"WITH {_JUDGE_SQL} SELECT query_id, memory_id, CAST(place AS BIGINT) AS place, CASE WHEN way IN (0, 3) THEN NULL WHEN named THEN 'keep:llm_semantic_filter' ELSE 'keep:llm_empty_fallback' END AS judge_reason FROM kept WHERE place <= 5")
def judged_choice(spark, sf):
    chosen, verdicts = _judged(spark, sf)
    return recall.judged(chosen, verdicts.drop("error")).select("query_id", "memory_id", F.col("place").cast("long").alias("place"), "judge_reason")


@_query(f"""WITH {_JUDGE_SQL}, n AS (SELECT query_id, query_id // 100 % 4 AS way, count(*) FILTER (WHERE selected) AS c FROM k GROUP BY query_id), fin AS (SELECT query_id, count(*) AS final_n, bool_or(way IN (1, 2) AND NOT named) AS e FROM kept WHERE place <= 5 GROUP BY query_id)
SELECT query_id, least(c, 12) AS candidate_count, least(c, 5) AS deterministic_selected_count, coalesce(final_n, 0) AS final_selected_count, way <> 3 AS llm_attempted, way IN (1, 2) AS llm_applied, coalesce(e, false) AS llm_empty_fallback, CASE WHEN way = 0 THEN 'failed' END AS llm_error FROM n LEFT JOIN fin USING (query_id)""")
def judge_telemetry(spark, sf):
    chosen, verdicts = _judged(spark, sf)
    out = recall.telemetry(chosen, recall.judged(chosen, verdicts.drop("error")), verdicts)
    return out.withColumns({c: F.col(c).cast("long") for c in ("candidate_count", "deterministic_selected_count", "final_selected_count")})


# Projects: hosts are project folders, pages are folders in them; of every seventh page the folder is a worktree beside the project's.
_FOLDER_SQL = r"""u AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS rest FROM pages WHERE url IS NOT NULL),
fo AS (SELECT DISTINCT CASE WHEN page_id % 7 = 0 THEN '/w/.' || host || '-codex-worktrees/' || host || '-' || page_id || '/en' ELSE '/w/' || rest END AS path FROM u),
pr0 AS (SELECT '/w/' || host || CASE WHEN page_id % 5 = 0 THEN '/en' ELSE '' END AS root, 'git@github.com:Org' || page_id % 5 || '/' || host || '.git' AS remote, CASE WHEN page_id % 2 = 0 THEN host || '-pkg' END AS package, CASE page_id % 4 WHEN 0 THEN 'Rust' WHEN 1 THEN 'Node' WHEN 2 THEN 'Python' END AS ecosystem FROM u WHERE page_id % 3 = 0 OR page_id % 5 = 0),
pr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY remote DESC NULLS LAST, package DESC NULLS LAST, ecosystem DESC NULLS LAST) AS r FROM pr0) WHERE r = 1),
lo AS (SELECT * FROM (SELECT fo.path, pr.root, pr.remote, row_number() OVER (PARTITION BY fo.path ORDER BY length(pr.root) DESC NULLS LAST) AS n FROM fo LEFT JOIN pr ON fo.path = pr.root OR starts_with(fo.path, pr.root || '/')) WHERE n = 1)"""
_TAG = "replace(lower(regexp_replace(trim({0}), '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')), '_', '-')"


def _folders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    u, i = table(spark, sf, "pages").where("url IS NOT NULL"), F.col("page_id")
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    rest = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    path = F.when(i % 7 == 0, F.concat(F.lit("/w/."), host, F.lit("-codex-worktrees/"), host, F.lit("-"), i.cast("string"), F.lit("/en"))).otherwise(F.concat(F.lit("/w/"), rest))
    kind = F.when(i % 4 == 0, "Rust").when(i % 4 == 1, "Node").when(i % 4 == 2, "Python")
    known = u.where((i % 3 == 0) | (i % 5 == 0)).select(
        F.concat(F.lit("/w/"), host, F.when(i % 5 == 0, "/en").otherwise("")).alias("root"), F.concat(F.lit("git@github.com:Org"), (i % 5).cast("string"), F.lit("/"), host, F.lit(".git")).alias("remote"),
        F.when(i % 2 == 0, F.concat(host, F.lit("-pkg"))).alias("package"), kind.alias("ecosystem"),
    )
    return u.select(path.alias("path")).distinct(), known


@_query(rf"""WITH {_FOLDER_SQL}, a AS (SELECT path, rtrim(path, '/') AS bare, coalesce(root, rtrim(path, '/')) AS root, lower(regexp_extract(remote, '^git@github\.com:(.*)\.git$', 1)) AS slug FROM lo),
b AS (SELECT *, regexp_extract(root, '([^/]*)$', 1) AS name, list_filter(string_split(substr(bare, length(root) + 1), '/'), lambda x: x NOT IN ('', '.', 'src', 'lib', 'crates'))[1] AS part FROM a),
c AS (SELECT *, {_TAG.format('name')} AS nt, {_TAG.format('part')} AS pt FROM b)
SELECT path, coalesce(slug, name) AS repo_id, root AS repo_root, nullif(pt, '') AS work_area, 'code' AS activity_domain, array_to_string(CASE WHEN nt = '' THEN list_filter([pt], lambda x: x <> '') WHEN coalesce(pt, '') IN ('', nt) THEN [nt] ELSE [nt, pt] END, ',') AS tags FROM c""")
def path_contexts(spark, sf):
    folders, known = _folders(spark, sf)
    return projects.path_contexts(folders, known).select("path", "context.repo_id", "context.repo_root", "context.work_area", "context.activity_domain", F.array_join("context.subject_tags", ",").alias("tags"))


@_query(rf"WITH {_FOLDER_SQL}, w AS (SELECT *, '/w/' || regexp_extract(path, '^/w/\.(.*)-codex-worktrees/', 1) AS copied FROM lo) SELECT path, CASE WHEN copied IN (SELECT root FROM pr) THEN copied ELSE coalesce(root, rtrim(path, '/')) END AS project_id FROM w")
def project_ids(spark, sf):
    return projects.project_ids(*_folders(spark, sf))


@_query(rf"""WITH {_FOLDER_SQL}, a AS (SELECT DISTINCT root AS path, 'phrase ' || length(root) % 3 AS phrase FROM pr UNION SELECT path, 'phrase ' || length(path) % 3 FROM fo)
SELECT path, concat_ws(', ', pr.package, regexp_extract(rtrim(path, '/'), '([^/]+)$', 1), pr.ecosystem, phrase) AS project_descriptor FROM a LEFT JOIN pr ON pr.root = rtrim(a.path, '/')""")
def project_descriptors(spark, sf):
    folders, known = _folders(spark, sf)
    every = folders.unionByName(known.select(F.col("root").alias("path")))
    return projects.descriptors(every.withColumn("phrase", F.concat(F.lit("phrase "), (F.length("path") % 3).cast("string"))), known)


_LATER_SQL = f"{_T_SQL}, {_E_SQL}, la AS (SELECT ru.id AS run_id, ru.session_id, ru.turn_ordinal, least(count(t.ordinal), 10000) AS later_completed_turns FROM ru LEFT JOIN t ON t.session_id = ru.session_id AND t.status = 'completed' AND t.ordinal > ru.turn_ordinal GROUP BY ALL)"


@_query(f"WITH {_LATER_SQL} SELECT run_id, session_id, turn_ordinal, later_completed_turns FROM la")
def eval_later_turns(spark, sf):
    return evals.later_counts(_runs(spark, sf).withColumnRenamed("id", "run_id"), _turns(spark, sf))


@_query(f"WITH {_LATER_SQL} SELECT run_id, session_id, turn_ordinal, 'n/a' AS score, later_completed_turns FROM la WHERE later_completed_turns > 0 AND run_id IN (SELECT eval_run_id FROM er WHERE judge_score = 'insufficient_context') ORDER BY run_id DESC LIMIT 10")
def eval_stale_runs(spark, sf):
    return evals.stale_insufficient(_runs(spark, sf), _results(spark, sf), _turns(spark, sf))


@_query(f"""WITH {_E_SQL}, x AS (SELECT ru.id AS run_id, session_id, turn_ordinal, er.id AS rid, er.id % 97 AS memory_id, judge_score, 'why ' || er.id AS rationale, TRY_CAST(judge_score AS BIGINT) AS n FROM er JOIN ru ON ru.id = er.eval_run_id),
e AS ((SELECT 'low' AS kind, * FROM x WHERE n <= 2 ORDER BY run_id DESC, rid LIMIT 5) UNION ALL (SELECT 'high' AS kind, * FROM x WHERE n >= 4 ORDER BY run_id DESC, rid LIMIT 5))
SELECT kind, run_id, session_id, turn_ordinal, memory_id, judge_score, rationale FROM e""")
def eval_score_examples(spark, sf):
    i = F.col("id")
    return evals.score_examples(_runs(spark, sf), _results(spark, sf).withColumns({"memory_id": i % 97, "rationale": F.concat(F.lit("why "), i.cast("string"))}))
