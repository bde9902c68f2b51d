"""The engine's verbs over a store: each gives a DataFrame."""

from __future__ import annotations

import json
import time
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.config import Config
from memlake.functions import context as cx
from memlake.functions import text as tx
from memlake.functions import vectors as vx
from memlake.operators import cluster, evals, pipelines, recall, state, tasks, turns
from memlake.operators import projects as pj
from memlake.providers import Completer, Embedder, HashEmbedder
from memlake.shared import stash
from memlake.sources import transcripts as tr


TELEMETRY = "candidate_count long, deterministic_selected_count long, final_selected_count long, llm_attempted boolean, llm_applied boolean, llm_empty_fallback boolean, llm_error string"


#: Files of the roles dialect below such a folder are parts of other sessions.
SUBAGENTS = "subagents"


class Deferred(Exception):
    """A task that is to be tried again after some seconds."""

    def __init__(self, seconds: int):
        super().__init__(f"deferred by {seconds} s")
        self.seconds = seconds


class Engine:
    """ingest, status, stats, tasks, memories, recall, remember and eval over one store."""

    def __init__(self, spark: SparkSession, root: str, config: Config = Config(), embedder: Embedder | None = None, completer: Completer | None = None, evaluate: bool = False, judge: Completer | None = None, projects: DataFrame | None = None, broad: tuple[str, ...] = ()):
        """`evaluate`: a recall task queues a delayed evaluation of what it gave. `judge` filters recalls, if the settings allow it.

        `projects` (root, remote, package, ecosystem) are the known project folders; `broad` folders hold many and tell nothing.
        """
        self.spark, self.config, self.store, self.evaluate = spark, config, state.Store(spark, root), evaluate
        self.embedder, self.completer, self.judge = embedder or HashEmbedder(), completer, judge
        self.projects, self.broad = projects if projects is not None else spark.createDataFrame([], pj.SCHEMA), broad

    def now(self) -> str:
        return f"unix:{int(time.time())}"

    # Ingest.

    def ingest(self, root: str, dialect: str = "markers") -> DataFrame:
        """Reads what is new under `root`, in the `markers` or `roles` dialect: sessions, turns and cursors. Gives a row of counts; bad files change nothing.

        A missing root is an error in the roles dialect, and holds no files in the other one.
        """
        agent = {"markers": "codex", "roles": "claude-code"}[dialect]
        s, now = self.store, self.now()
        if not s.exists(root):
            if dialect == "roles":
                raise FileNotFoundError(root)
            return self.spark.createDataFrame([(0, 0, 0)], "files long, failures long, new_turns long")
        cursors, old_turns, old_sessions = s.read("file_cursors"), s.read("turns"), s.read("sessions")
        known = old_sessions.select(F.col("transcript_file_path").alias("path"), F.col("id").alias("known_id"))
        usable = cursors.join(known, F.col("file_path") == F.col("path"), "left_semi")  # without its session a file starts anew
        lines, bad = tr.sound_files(tr.read_lines(self.spark, root, usable, skip_part=SUBAGENTS if dialect == "roles" else None))
        lines = lines.cache()
        events = tr.marker_events(lines) if agent == "codex" else tr.role_events(lines)
        fresh = (tr.marker_sessions if agent == "codex" else tr.role_sessions)(events).join(known, "path", "left").withColumn("session_id", F.coalesce("known_id", "session_id"))
        base = fresh.join(turns.next_ordinals(fresh.select("session_id").distinct(), old_turns), "session_id").select("path", "next_ordinal")
        found = (tr.marker_turns if agent == "codex" else tr.role_turns)(events, base).join(fresh.select("path", "session_id"), "path")
        seen = found.groupBy("session_id").agg(F.max("observed_at").alias("last_seen_at"))
        new_sessions = fresh.join(seen, "session_id", "left").select(F.col("session_id").alias("id"), F.lit(agent).alias("agent_type"), "project_id", F.col("path").alias("transcript_file_path"), "started_at", "last_seen_at")
        ids = pj.project_ids(new_sessions.select(F.col("project_id").alias("path")), self.projects).withColumnRenamed("project_id", "_project")
        new_sessions = new_sessions.join(ids, F.col("project_id") == F.col("path"), "left").withColumn("project_id", F.col("_project")).drop("path", "_project")
        inserted = state.insert_or_ignore(old_turns, found.drop("path"), ["session_id", "ordinal"], ["byte_start"])
        all_turns = old_turns.unionByName(state.with_ids(inserted, old_turns, ["session_id", "ordinal"]), allowMissingColumns=True)
        before = old_turns.count()
        new_cursors = (tr.next_cursors if agent == "codex" else tr.role_cursors)(lines, events, found).withColumn("last_processed_at", F.lit(now))
        counts = (fresh.count(), bad.count())
        s.write("turns", all_turns)
        s.write("sessions", state.upsert_sessions(old_sessions, new_sessions.dropDuplicates(["id"])))
        s.write("file_cursors", state.last_wins(cursors, new_cursors, ["file_path"], "last_byte_offset"))
        lines.unpersist()
        return self.spark.createDataFrame([(counts[0], counts[1], s.read("turns").count() - before)], "files long, failures long, new_turns long")

    def queue_formulation(self) -> int:
        """Queues tasks for turns no active memory covers: full batches, and rests of idle sessions."""
        s, c = self.store, self.config
        t = s.read("turns").join(s.read("sessions").select(F.col("id").alias("session_id"), "last_seen_at"), "session_id", "left")
        idle = F.col("last_seen_at").isNull() | F.coalesce(F.lit(int(time.time())) - tx.epoch_seconds(F.col("last_seen_at")) >= c.session_idle_memory_seconds, F.lit(False))
        idle_ids = t.where(idle).select("session_id").distinct().withColumn("idle", F.lit(True))
        lots = turns.uncovered(turns.batches(t, c.backlog_formulation_turn_window), turns.covered_turns(s.read("memories")))
        lots = lots.join(idle_ids, "session_id", "left").where((F.col("n") == c.backlog_formulation_turn_window) | F.coalesce("idle", F.lit(False)))
        spots = t.select("session_id", "ordinal", "byte_start", "byte_end")
        refs = lots.select("session_id", "batch", "first", "last", F.explode("refs").alias("ordinal")).join(spots, ["session_id", "ordinal"])
        refs = refs.groupBy("session_id", "batch", "first", "last").agg(F.array_sort(F.collect_list(F.struct("session_id", "ordinal", "byte_start", "byte_end"))).alias("refs"))
        old = s.read("tasks")
        new = tasks.enqueue(old, tasks.formulation_tasks(refs, tasks.PRIORITY["backlog"], self.now()))
        before = old.count()
        s.write("tasks", old.unionByName(state.with_ids(new, old, ["payload_json"])))
        return s.read("tasks").count() - before

    # Memories.

    def remember(self, title: str, body: str, scope: str = "project", project: str | None = None) -> int:
        """Appends one memory with its embedding; gives its id."""
        if not title.strip() or not body.strip():
            raise ValueError("title and body are needed")
        now = self.now()
        row = self.spark.createDataFrame([(title.strip()[:200], body.strip()[: self.config.max_memory_length], "global" if scope == "global" else "project", project)], "title string, body string, scope string, project_id string")
        row = row.select("*", tx.infer_kind(F.col("title"), F.col("body"), F.col("scope")).alias("memory_kind"), tx.task_keys_of(F.concat_ws("\n", "title", "body")).alias("task_keys"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), F.lit(True).alias("is_active"), F.col("project_id").alias("path"), F.lit(None).cast("string").alias("phrase"))
        row = row.join(pj.descriptors(row.select("path", "phrase"), self.projects), "path", "left").withColumn("project_descriptor", F.coalesce("project_descriptor", F.lit("unknown"))).drop("path", "phrase")
        return self._append_memories(row)

    def _append_memories(self, rows: DataFrame) -> int:
        s, old = self.store, self.store.read("memories")
        new = state.with_ids(rows, old, ["title", "body"]).cache()
        top = new.agg(F.max("id")).first()[0]
        s.write("embeddings", state.last_wins(s.read("embeddings"), pipelines.embed_memories(new, self.embedder, self.now()), ["memory_id"], "updated_at"))
        s.write("memories", old.unionByName(new, allowMissingColumns=True))
        new.unpersist()
        return top

    def formulate(self, session_ids: list[str], first: int | None = None, end: int | None = None) -> int:
        """Distils memories from completed turns of sessions by the completer: of a batch, those at ordinals from `first` to before `end`.

        Turns without text are filled from their transcripts first. Every draft refers to all turns that it was made of.
        """
        s, now = self.store, self.now()
        t = s.read("turns").where(F.col("session_id").isin(session_ids) & (F.col("status") == "completed"))
        if first is not None:
            t = t.where(F.col("ordinal") >= first)
        if end is not None:
            t = t.where(F.col("ordinal") < end)
        t = self._hydrated(t)
        refs = t.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("session_id", "ordinal", "byte_start", "byte_end"))).alias("source_turn_refs"))
        d = pipelines.formulate(t, s.read("sessions"), self.config, self.completer).join(refs, "session_id")
        d = d.withColumns({"created_at": F.lit(now), "updated_at": F.lit(now), "is_active": F.lit(True)}).cache()
        n = d.count()
        if n:
            self._append_memories(d)
            self.dedupe()
        d.unpersist()
        return n

    def _hydrated(self, t: DataFrame) -> DataFrame:
        """Turns with the texts that their transcripts still have, where the table has none."""
        if t.where("display_text IS NULL").isEmpty():
            return t
        sessions = self.store.read("sessions")
        need = t.where("display_text IS NULL").join(sessions, t["session_id"] == sessions["id"], "left_semi").select("session_id").distinct()
        paths = [r[0] for r in sessions.join(need, F.col("id") == F.col("session_id"), "left_semi").select("transcript_file_path").distinct().collect()]  # a path a session of the batch
        files = [p for p in paths if p and self.store.exists(p)]
        if not files:
            return t
        return tr.hydrate(t, sessions, self.spark.read.format("binaryFile").load(files).select("path", "content"))

    def dedupe(self) -> int:
        """Deactivates duplicates among active memories."""
        m, s = self.store.read("memories"), self.store
        gone = cluster.greedy_losers(m.where("is_active")).select("id").cache()
        n = gone.count()
        if n:
            hit = m.join(gone.withColumn("_g", F.lit(True)), "id", "left")
            s.write("memories", state.deactivate(hit, F.col("_g"), self.now()).drop("_g"))
        gone.unpersist()
        return n

    def clusters(self) -> DataFrame:
        """(cluster, id, place): consolidation clusters of active memories embedded by the configured model."""
        c, m = self.config, self.store.read("memories").where("is_active")
        e = self.store.read("embeddings").where(F.col("embedding_model") == self.embedder.model)
        v = m.join(e, m["id"] == e["memory_id"]).select(m["id"], F.when(F.col("scope") == "global", "global").otherwise(F.concat(F.lit("project:"), F.coalesce("project_id", F.lit("")))).alias("part"), F.col("embedding").alias("vector"), *[tx.similarity_tokens(x).alias(a) for x, a in ((F.col("title"), "tt"), (F.col("body"), "tb"), (F.concat_ws("\n", "title", "body"), "tx"))], F.coalesce("lineage_refs", F.array().cast("array<long>")).alias("lin"))
        links = cluster.cluster_links(v, c.memory_cluster_distance_threshold, c.memory_cluster_min_size, cluster.ALIKE)
        found = cluster.dbscan(v.select("id"), links, c.memory_cluster_min_size)
        return cluster.densest(found, v.select("id", "vector"), c.memory_cluster_max_size)

    def consolidate(self) -> int | None:
        """Merges the top cluster by the completer; gives the new memory's id."""
        s, now = self.store, self.now()
        chosen = self.clusters().cache()
        v = s.read("embeddings").select(F.col("memory_id").alias("id"), F.col("embedding").alias("vector"))
        top = cluster.cluster_order(chosen, v).where(F.col("size") >= self.config.memory_cluster_min_size).orderBy(F.desc("size"), "mean_distance", "cluster").first()
        if top is None:
            return None
        ids = [r[0] for r in chosen.where(F.col("cluster") == top["cluster"]).select("id").collect()]  # max_size at most
        m = s.read("memories")
        members = m.where(F.col("id").isin(ids)).withColumn("cluster", F.lit(top["cluster"]))
        merged = pipelines.merge_cluster(members, self.config, self.completer)
        refs = turns.distinct_refs(members, "cluster", "source_turn_refs").groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "session_id", "ordinal"))), lambda r: F.struct(r["session_id"].alias("session_id"), r["ordinal"].alias("ordinal"), F.lit(None).cast("long").alias("byte_start"), F.lit(None).cast("long").alias("byte_end"))).alias("source_turn_refs"))
        row = merged.join(refs, "cluster", "left").withColumns({"created_at": F.lit(now), "updated_at": F.lit(now), "is_active": F.lit(True)}).cache()
        if row.isEmpty():
            return None
        s.write("memories", state.deactivate(m, F.col("id").isin(ids), now))
        return self._append_memories(row.drop("cluster"))

    def memories_stats(self) -> DataFrame:
        return evals.memory_stats(self.store.read("memories"))

    def memories_rebuild(self, yes: bool = False, keep_active: bool = False) -> int:
        """Deactivates all memories, clears build tasks and queues them anew."""
        if not yes:
            raise ValueError("rebuild needs yes=True")
        s = self.store
        if not keep_active:
            s.write("memories", state.deactivate(s.read("memories"), F.lit(True), self.now()))
        s.write("tasks", s.read("tasks").where(~F.col("kind").isin("memory_formulation", "memory_consolidation")))
        return self.queue_formulation()

    # Recall.

    def memories(self) -> DataFrame:
        """The memories as they are read, with their task keys."""
        return state.with_task_keys(self.store.read("memories"))

    def session(self, project: str | None, session_id: str | None = None) -> DataFrame:
        """The session meant: the named one if it is known, else the latest of the project."""
        return state.session_of(self.store.read("sessions"), project, session_id)

    def recall(self, query: str, project: str | None = None, judge=None) -> DataFrame:
        """The memories for a text: vector search, hybrid rank, rules, and an optional judge (query_id, ids)."""
        return self.recall_run(query, project, judge)[0]

    def recall_run(self, query: str, project: str | None = None, judge=None) -> tuple[DataFrame, DataFrame]:
        """recall(), and a row of what the judge did: given verdicts (query_id, ids, error), or the engine's own judge."""
        c, s = self.config, self.store
        opts = recall.Options(c.recall_candidate_pool, c.recall_result_limit, c.recall_similarity_threshold, c.recall_project_tiebreaker, c.recall_project_score_bonus, c.recall_llm_filter_candidate_limit)
        m = self.memories().where("is_active")
        vec = s.read("embeddings").join(m.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").select("memory_id", "embedding")
        q = self.spark.createDataFrame([(-1, self.embedder.embed([query])[0], query, project)], "query_id long, embedding array<float>, q_text string, q_project string")
        hits = vx.search(vec, q.select("query_id", "embedding"), "memory_id", "embedding", opts.pool, opts.threshold, exclude_self=False)
        places = pj.path_contexts(q.select(F.col("q_project").alias("path")), self.projects, self.broad)
        asked = q.join(places, F.col("q_project") == F.col("path"), "left").withColumn("_text", cx.from_text(F.col("q_text"))).withColumn("_all", cx.merged(F.col("context"), F.col("_text")))
        asked = asked.select("query_id", "q_project", "q_text", cx.normalized(F.col("_all")).alias("q_context"), tx.task_keys_of(F.col("q_text")).alias("q_keys"))
        m = m.join(F.broadcast(hits.select(F.col("memory_id").alias("id")).distinct()), "id", "left_semi")  # a pool at most
        known = pj.memory_contexts(m, self.projects, self.broad).select(F.col("id").alias("memory_id"), "title", "body", "scope", F.col("memory_kind").alias("kind"), "project_id", "project_descriptor", "created_at", "task_keys", "context")
        pairs = hits.drop("rank").join(known, "memory_id").join(F.broadcast(asked), "query_id")
        ranked = recall.rank(recall.features(pairs), opts)
        selected = recall.select(ranked, max(opts.judge_pool, opts.limit))
        if judge is None and self.judge is not None and c.recall_llm_filter_enabled:
            selected = stash(selected, "selected")
            judge = stash(pipelines.filtered(recall.judged(selected, None, recall.Options(limit=opts.judge_pool, judge_pool=opts.judge_pool)), c, self.judge), "verdicts")
        if judge is not None and "error" not in judge.columns:
            judge = judge.withColumn("error", F.lit(None).cast("string"))
        final = recall.judged(selected, None if judge is None else judge.drop("error"), opts)
        return final, recall.telemetry(selected, final, judge, opts)

    def recall_for_turn(self, session_id: str, ordinal: int, judge=None) -> DataFrame:
        """Recall as of a past turn: the live window of completed turns is the query."""
        return self.recall_run_for_turn(session_id, ordinal, judge)[0]

    def recall_run_for_turn(self, session_id: str, ordinal: int, judge=None) -> tuple[DataFrame, DataFrame]:
        c = self.config
        w = turns.live_windows(self.store.read("turns").where(F.col("session_id") == session_id), c.recall_live_turn_window, F.coalesce("display_text", F.lit("")))
        row = w.where(F.col("ordinal") == ordinal).select(tx.recall_query_text(F.col("window"), c.recall_query_max_chars, c.tool_call_truncation_chars)).first()
        project = self.store.read("sessions").where(F.col("id") == session_id).select("project_id").first()
        return self.recall_run(row[0] if row else "", project[0] if project else None, judge)

    def write_recall(self, session_id: str, ordinal: int, judge=None) -> tuple[str, list[int]]:
        """Writes the recall file of a session as of a turn: noop, unchanged or written, and the ids it names."""
        return self._write_recall(session_id, ordinal, judge)[:2]

    def _write_recall(self, session_id: str, ordinal: int, judge=None) -> tuple[str, list[int], dict | None]:
        """write_recall(), and the telemetry of its judge."""
        final, said = self.recall_run_for_turn(session_id, ordinal, judge)
        final = final.cache()
        told = said.drop("query_id").first()
        told = told.asDict() if told else None
        rendered = self.recall_file(final, "turn").cache()
        name = self.recall_name(session_id)
        old = self.spark.createDataFrame([(-1, self.store.get_text(name) or "")], "query_id long, text string").select("query_id", tx.memory_ids_of(F.col("text")).alias("memory_ids"))
        row = recall.write_action(rendered, old).first()
        rendered.unpersist()
        final.unpersist()
        if row is None:
            return "noop", [], told
        if row["action"] == "written":
            self.store.put_text(name, row["markdown"])
        return row["action"], list(row["memory_ids"]), told

    def read_recall(self, session_id: str, refresh: bool = True) -> str | None:
        """The recall file of a session. One that names an inactive memory is removed; a missing one is made from the latest completed turn."""
        name = self.recall_name(session_id)
        text = self.store.get_text(name)
        if text is not None:
            files = self.spark.createDataFrame([(name, text)], "path string, text string").select("path", tx.memory_ids_of(F.col("text")).alias("memory_ids"))
            if recall.valid_files(files, self.store.read("memories")).first()["valid"]:
                return text
            self.store.remove(name)
        last = self.store.read("turns").where((F.col("session_id") == session_id) & (F.col("status") == "completed")).agg(F.max("ordinal")).first()[0]
        if not refresh or last is None:
            return None
        self.write_recall(session_id, last)
        return self.store.get_text(name)

    def recall_name(self, session_id: str) -> str:
        return "recall/" + self.spark.range(1).select(tx.recall_file(F.lit(session_id))).first()[0]

    def recall_file(self, results: DataFrame, source: str) -> DataFrame:
        return recall.render(results.withColumn("rank", F.col("place")), self.now(), source)

    # Reports.

    def status(self) -> DataFrame:
        """One row of counts."""
        s = self.store
        m = s.read("memories").agg(F.count("*").alias("memories"), F.count_if("is_active").alias("active_memories"), F.max("created_at").alias("last_memory_at"))
        n = lambda name: s.read(name).agg(F.count("*").alias(name))
        t = s.read("tasks").agg(*[F.count_if(F.col("status") == x).alias(f"tasks_{x}") for x in ("queued", "running", "parked", "completed")])
        out = m
        for part in (n("sessions"), n("turns"), n("file_cursors"), t):
            out = out.join(F.broadcast(part))  # one row each
        return out

    def tasks_list(self, status: str | None = None, limit: int = 50) -> DataFrame:
        return tasks.by_display_status(self.store.read("tasks"), int(time.time()), status, limit)

    def tasks_retry(self, task_id: int) -> None:
        self.store.write("tasks", tasks.transition(self.store.read("tasks"), F.col("id") == task_id, "retried", self.now()))

    def tasks_clear(self, task_id: int | None = None, status: str | None = None, kind: str | None = None, yes: bool = False) -> None:
        t = self.store.read("tasks")
        if task_id is not None:
            self.store.write("tasks", t.where(F.col("id") != task_id))
        elif not yes or status is None:
            raise ValueError("clearing many needs a status and yes=True")
        else:
            self.store.write("tasks", tasks.clear(t, int(time.time()), status, kind))

    def recover(self) -> None:
        """After a crash: running tasks are queued again."""
        self.store.write("tasks", tasks.transition(self.store.read("tasks"), F.lit(True), "requeued", self.now()))

    def queue_recalls(self, anchors: DataFrame) -> None:
        """Queues a recall for each anchor (session_id, turn_ordinal) that has none."""
        self._queue(tasks.recall_tasks(anchors, self.now()))

    def schedule_consolidation(self) -> bool:
        """Queues a consolidation after the quiet period, unless one is under way or nothing new came."""
        t = self.store.read("tasks")
        due = tasks.consolidation_due(self.store.read("memories"), t, self.config.consolidation_dark_period_seconds).first()
        if due is None:
            return False
        payload = self.spark.createDataFrame([('{"reason": "quiet period"}',)], "payload_json string")
        new = tasks.new_tasks(payload, "memory_consolidation", tasks.PRIORITY["consolidation"], self.now(), f"unix:{due[0]}", tasks.MAX_CONSOLIDATION_ATTEMPTS)
        self.store.write("tasks", t.unionByName(state.with_ids(new, t, ["payload_json"])))
        return True

    def queue_stale_evals(self, limit: int = 10) -> int:
        """Queues evaluations anew that lacked later turns and have them now."""
        stale = tasks.stale_evals(self.store.read("eval_runs"), self.store.read("eval_results"), self.store.read("turns"), limit=limit)
        payload = stale.select(F.to_json(F.struct("session_id", "turn_ordinal", F.col("id").alias("rerun_for_eval_run_id"))).alias("payload_json"))
        return self._queue(tasks.new_tasks(payload, "recall_eval", tasks.PRIORITY["backlog"], self.now()))

    def _queue(self, new: DataFrame) -> int:
        old = self.store.read("tasks")
        fresh = state.with_ids(tasks.enqueue(old, new), old, ["kind", "payload_json"]).cache()
        n = fresh.count()
        if n:
            self.store.write("tasks", old.unionByName(fresh))
        fresh.unpersist()
        return n

    def run_tasks(self, limit: int = 1, now: int | None = None) -> int:
        """Runs due tasks, the most urgent first: each is completed, or parked with its error. Unknown kinds complete."""
        done = 0
        for _ in range(limit):
            row = tasks.next_due(self.store.read("tasks"), now or int(time.time())).first()
            if row is None:
                break
            own = F.col("id") == row["id"]
            self.store.write("tasks", tasks.transition(self.store.read("tasks"), own, "running", self.now()))
            try:
                self._run(row["kind"], json.loads(row["payload_json"]), row, now or int(time.time()))
                change, error = "completed", None
                if row["kind"] == "memory_formulation":
                    self.schedule_consolidation()
            except Deferred as e:
                before = self.store.read("tasks").withColumn("attempts", F.when(own, F.col("attempts") - 1).otherwise(F.col("attempts")))
                kept, copies = tasks.deferred(before, own, e.seconds, now or int(time.time()))
                self.store.write("tasks", kept.unionByName(state.with_ids(copies, kept, ["payload_json"])))
                done += 1
                continue
            except Exception as e:  # the task keeps the error; the loop goes on
                change, error = "parked", " <- ".join(str(x) for x in (e, e.__cause__) if x is not None)
            self.store.write("tasks", tasks.transition(self.store.read("tasks"), own, change, self.now(), error))
            done += 1
        return done

    def _run(self, kind: str, payload: dict, task, now: int) -> None:
        if kind == "memory_formulation":
            self.formulate([payload["session_id"]], payload.get("start_ordinal"), payload.get("end_ordinal"))
        elif kind == "memory_consolidation":
            self.consolidate()
        elif kind == "recall":
            _, ids, told = self._write_recall(payload["session_id"], payload["turn_ordinal"])
            if self.evaluate and ids:
                text = self.store.get_text(self.recall_name(payload["session_id"])) or ""
                given = self.spark.createDataFrame([(payload["session_id"], payload["turn_ordinal"], text, ids, told)], f"session_id string, turn_ordinal long, recall_text string, memory_ids array<long>, filter_telemetry struct<{TELEMETRY}>")
                self._queue(tasks.eval_tasks(self.store.read("tasks"), self.store.read("eval_runs"), given, now))
        elif kind == "recall_eval":
            self._evaluate(payload, task, now)

    # Evaluation.

    def _evaluate(self, payload: dict, task, now: int) -> None:
        """Scores a recall by the turns that came after it; waits for its turn and for later ones, as long as attempts last."""
        s, at = self.store, payload["turn_ordinal"]
        seen = s.read("sessions").where(F.col("id") == payload["session_id"]).select("last_seen_at").first()
        anchor = [(payload["session_id"], at, task["attempts"], task["max_attempts"], seen[0] if seen else None)]
        own = self.spark.createDataFrame(anchor, "session_id string, turn_ordinal long, attempts long, max_attempts long, last_seen_at string")
        t = s.read("turns")
        verdict = tasks.eval_state(own, t, self.config.session_idle_memory_seconds, now).first()["state"]
        if verdict.startswith("defer"):
            raise Deferred(tasks.DEFER_ANCHOR if verdict == "defer_anchor" else tasks.DEFER_TURNS)
        later = turns.budgeted(turns.later_turns(own.select("session_id", F.col("turn_ordinal").alias("anchor")), self._hydrated(t)), self.config.recall_query_max_chars)
        evidence = "\n".join(r[0] or "" for r in later.orderBy("place").select("display_text").collect())  # 20 turns at most, within a budget
        turn = t.where((F.col("session_id") == payload["session_id"]) & (F.col("ordinal") == at)).select("id").first()
        prompt = F.concat(F.lit("later turns:\n" + evidence + "\n\nrecalled:\n"), F.col("text"))
        targets = self.eval_targets(payload).withColumn("turn_id", F.lit(turn[0]).cast("long"))
        if verdict == "score":
            judged = pipelines.judge(targets.withColumn("prompt", prompt), "prompt", self.completer)
        else:
            judged = targets.withColumns({"judge_score": F.lit("insufficient_context"), "rationale": F.lit("no later turns")})
        kept = ("session_id", "turn_ordinal", "memory_ids", "rerun_for_eval_run_id", "filter_telemetry")
        self.record_eval("delayed", {k: payload[k] for k in kept if k in payload}, judged)

    def eval_targets(self, payload: dict) -> DataFrame:
        """(memory_id, text) of the memories that a recall gave, in the order of their ids; without any, its text alone under no id."""
        ids = sorted(set(payload.get("memory_ids") or []))
        order = self.spark.createDataFrame(list(enumerate(ids)), "pos long, id long")
        found = state.by_ids(self.store.read("memories"), order).select(F.col("id").alias("memory_id"), F.concat_ws("\n", "title", "body").alias("text"))
        if ids and not found.isEmpty():
            return found
        return self.spark.createDataFrame([(None, payload.get("recall_text") or "")], "memory_id long, text string")

    def record_eval(self, strategy: str, config: dict, results: DataFrame) -> int:
        """Appends a run and its results (turn_id, memory_id, judge_score, rationale), then marks the run as complete; gives its id."""
        s, now = self.store, self.now()
        runs, old = s.read("eval_runs"), s.read("eval_results")
        row = self.spark.createDataFrame([(strategy, now, None, json.dumps(config, sort_keys=True))], "strategy string, started_at string, completed_at string, config_json string")
        new = state.with_ids(row, runs, ["started_at"])
        run = new.first()["id"]
        s.write("eval_runs", runs.unionByName(new))
        rows = results.select("turn_id", "memory_id", "judge_score", "rationale").withColumns({"eval_run_id": F.lit(run).cast("long"), "created_at": F.lit(now)})
        s.write("eval_results", old.unionByName(state.with_ids(rows, old, ["turn_id", "memory_id"])))
        ended = F.when(F.col("id") == run, F.lit(self.now())).otherwise(F.col("completed_at"))
        s.write("eval_runs", s.read("eval_runs").withColumn("completed_at", ended))
        return run

    def eval_recall(self, limit: int = 100) -> DataFrame:
        """Replays turns against the memories that were there before them, and judges the candidates."""
        t = self.store.read("turns").where("display_text IS NOT NULL AND observed_at IS NOT NULL").orderBy(F.col("observed_at").asc_nulls_first(), "id").limit(limit)
        from memlake.providers import embedded

        q = t.select(F.col("id").alias("query_id"), F.col("display_text").alias("q_text"), "observed_at", F.col("session_id").alias("q_session"), F.col("ordinal").alias("q_ordinal")).withColumn("q_vector", embedded(F.col("q_text"), self.embedder)).withColumn("q_context", cx.from_text(F.col("q_text")))
        m, e = self.store.read("memories"), self.store.read("embeddings")
        known = m.join(e.select(F.col("memory_id").alias("id"), F.col("embedding").alias("vector")), "id", "left").withColumn("context", cx.from_text(F.concat_ws("\n", "title", "body")))
        c = pipelines.replay(q, known).withColumn("citation", tx.citation(F.coalesce("source_turn_refs", F.array().cast(f"array<{state.REF}>")), F.col("q_session"), F.col("q_ordinal")))
        prompt = F.concat_ws("\n\n", F.concat(F.lit("turn:\n"), F.substring("q_text", 1, 8000)), F.concat(F.lit("memory:\n"), "title", F.lit("\n"), F.substring("body", 1, 8000)), F.concat(F.lit("citation: "), "citation"))
        done = pipelines.judge(c.withColumn("prompt", prompt), "prompt", self.completer).select("query_id", F.col("id").alias("memory_id"), "rank", "score", "citation", "judge_score", "rationale")
        none = q.select("query_id").join(done.select("query_id"), "query_id", "left_anti").select("query_id", *[F.lit(None).cast(k).alias(n) for n, k in (("memory_id", "long"), ("rank", "int"), ("score", "double"), ("citation", "string"))], F.lit("neutral").alias("judge_score"), F.lit(pipelines.NO_CANDIDATES).alias("rationale"))
        return done.unionByName(none)

    def eval_replay(self, limit: int = 100) -> int:
        """eval_recall(), stored as a run; gives its id."""
        return self.record_eval("replay", {"limit": limit}, self.eval_recall(limit).withColumnRenamed("query_id", "turn_id"))

    def eval_show(self, run: int) -> DataFrame:
        """The results of a run with the titles of their memories, in order."""
        m = self.store.read("memories").select(F.col("id").alias("memory_id"), "title")
        return self.store.read("eval_results").where(F.col("eval_run_id") == run).join(m, "memory_id", "left").orderBy("id")

    def stats(self) -> DataFrame:
        """One row: recall rates over completed turns, volumes of recalls, usefulness of results, and the judge filter's telemetry."""
        s, c = self.store, F.col("config_json")
        runs = s.read("eval_runs").select(
            "id", F.get_json_object(c, "$.session_id").alias("session_id"), F.get_json_object(c, "$.turn_ordinal").try_cast("long").alias("turn_ordinal"),
            F.coalesce(F.json_array_length(F.get_json_object(c, "$.memory_ids")), F.lit(0)).alias("n"), F.from_json(F.get_json_object(c, "$.filter_telemetry"), TELEMETRY).alias("t"),
        ).where("session_id IS NOT NULL")
        last = tasks.first_per_anchor(runs)
        eligible = s.read("turns").where("status = 'completed'").select("session_id", F.col("ordinal").alias("turn_ordinal"))
        out = evals.recall_rates(eligible, tasks.anchors(s.read("tasks").where("kind = 'recall'")), last)
        results = s.read("eval_results").join(last.select(F.col("id").alias("eval_run_id")), "eval_run_id", "left_semi")
        for part in (evals.volumes(last.where("n > 0")), evals.usefulness(results), evals.filter_telemetry(last.where("t IS NOT NULL").select("t.*"))):
            out = out.join(F.broadcast(part))  # one row each
        return out

    def config_effective(self) -> DataFrame:
        """(name, value) of the settings in force."""
        return self.spark.createDataFrame([(f.name, str(getattr(self.config, f.name))) for f in fields(self.config)], "name string, value string")

    def path(self) -> str:
        return self.store.root

    def _eval_runs(self) -> DataFrame:
        """(id, session_id, turn_ordinal) of the runs, as their settings tell."""
        c = F.col("config_json")
        return self.store.read("eval_runs").select("id", F.get_json_object(c, "$.session_id").alias("session_id"), F.get_json_object(c, "$.turn_ordinal").try_cast("long").alias("turn_ordinal"))

    def eval_examples(self, n: int = 5) -> DataFrame:
        """The first results of low and of high scores."""
        return evals.score_examples(self._eval_runs(), self.store.read("eval_results"), n)

    def eval_stale(self, n: int = 10) -> DataFrame:
        """Runs without enough context whose sessions went on since."""
        return evals.stale_insufficient(self._eval_runs(), self.store.read("eval_results"), self.store.read("turns"), n)

    def eval_queued(self, n: int = 20) -> DataFrame:
        """Evaluations that are queued or running, with the time of the next try."""
        t = self.store.read("tasks").where("kind = 'recall_eval' AND status IN ('queued', 'running')")
        at = tasks.anchors(t).select("id", "session_id", "turn_ordinal")
        return t.join(at, "id", "left").select("id", "status", "attempts", "max_attempts", "session_id", "turn_ordinal", "next_run_at", tx.human_time(F.col("next_run_at")).alias("next_run"), "last_error").orderBy("id").limit(n)

    def eval_list(self, limit: int = 200) -> DataFrame:
        return evals.run_rollup(self.store.read("eval_runs"), self.store.read("eval_results")).orderBy(F.desc("id")).limit(limit)

    def eval_summary(self) -> DataFrame:
        return evals.session_summary(self._eval_runs(), self.store.read("eval_results")).orderBy(F.desc("latest_run"))
