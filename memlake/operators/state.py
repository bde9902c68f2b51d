"""Tables of the memory store as Parquet snapshots, and the rules by which rows change.

A table is a folder of versions; the current one is named by a pointer file that is replaced in one rename, so readers never see
half a table. Changes are plans over the old snapshot; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions.text import task_keys_of
from memlake.shared import stash

REF = "struct<session_id:string,ordinal:bigint,byte_start:bigint,byte_end:bigint>"
#: Table name to columns; the key comes first.
SCHEMAS = {
    "file_cursors": "file_path string, last_byte_offset long, last_processed_at string",
    "sessions": "id string, agent_type string, project_id string, transcript_file_path string, started_at string, last_seen_at string",
    "turns": "id long, session_id string, turn_id string, ordinal long, byte_start long, byte_end long, observed_at string, status string, display_text string, cwd string",
    "memories": f"id long, title string, body string, scope string, memory_kind string, task_keys array<string>, source_turn_refs array<{REF}>, created_at string, updated_at string, is_active boolean, session_id string, project_id string, project_descriptor string, lineage_refs array<bigint>",
    "context_metadata": "entity_type string, entity_key string, context_json string, updated_at string",
    "embeddings": "memory_id long, embedding_model string, dimensions long, embedding array<float>, embedded_text_hash string, updated_at string",
    "tasks": "id long, kind string, status string, priority long, payload_json string, attempts long, max_attempts long, next_run_at string, last_error string, created_at string, updated_at string",
    "backlog_progress": "discovered_files long, processed_files long, processed_turns long, queued_memory_jobs long, failures long, last_activity_at string",
    "eval_runs": "id long, strategy string, started_at string, completed_at string, config_json string",
    "eval_results": "id long, eval_run_id long, turn_id long, memory_id long, judge_score string, rationale string, created_at string",
}
SCHEMA_VERSION = 1


class Store:
    """Snapshot tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path("x").getFileSystem(self._conf)

    def _version(self, name: str) -> int:
        p = self._path(name, "_current")
        if not self._fs().exists(p):
            return 0
        with_ = self._fs().open(p)
        try:
            return int(self._jvm.org.apache.commons.io.IOUtils.toString(with_, "UTF-8"))
        finally:
            with_.close()

    def read(self, name: str) -> DataFrame:
        """The current snapshot; columns it lacks are null, so schemas can grow."""
        v = self._version(name)
        schema = SCHEMAS[name]
        if not v:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v{v}")

    def write(self, name: str, df: DataFrame) -> None:
        v = self._version(name) + 1
        cols = [c.strip().split(" ")[0] for c in self.spark.createDataFrame([], SCHEMAS[name]).columns]
        df.select(cols).write.mode("overwrite").parquet(f"{self.root}/{name}/v{v}")
        self._place(self._path(name, f"_next{v}"), self._path(name, "_current"), str(v))

    def _place(self, tmp, final, text: str) -> None:
        """Writes a small file beside its place and moves it there, over what is there, in one rename."""
        out = self._fs().create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        opts = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        opts[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(tmp, final, opts)

    def put_text(self, name: str, text: str) -> None:
        """Writes a small text file under the root, in one rename."""
        self._place(self._path(f"{name}.next"), self._path(name), text)

    def exists(self, path: str) -> bool:
        """Whether a file of any file system is there."""
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf).exists(p)

    def get_text(self, name: str) -> str | None:
        p = self._path(name)
        if not self._fs().exists(p):
            return None
        file = self._fs().open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        finally:
            file.close()

    def remove(self, name: str) -> None:
        self._fs().delete(self._path(name), True)

    def tables(self) -> list[str]:
        return sorted(n for n in SCHEMAS if self._version(n))


def with_ids(new: DataFrame, old: DataFrame, order: list) -> DataFrame:
    """Gives new rows the ids after the largest old one, in a stated total order.

    Rows are sorted by ranges; each range numbers its own rows, and starts after the rows of the ranges before it, so no task sees
    all rows. One count a range reaches the driver.
    """
    top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    ranged = stash(new.orderBy(*order).withColumn("_p", F.spark_partition_id()), "ids")
    starts, at = [], top
    for r in sorted(ranged.groupBy("_p").count().collect()):
        starts.append((r["_p"], at))
        at += r["count"]
    base = new.sparkSession.createDataFrame(starts, "_p int, _at long")
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn("_r", rank).join(F.broadcast(base), "_p").withColumn("id", (F.col("_r") + F.col("_at")).cast("long")).drop("_r", "_at", "_p")


def upsert_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same id, but started_at stays once known."""
    n = new.select([F.col(c).alias(f"n_{c}") for c in new.columns])
    both = old.join(n, F.col("id") == F.col("n_id"), "full")
    cols = [F.coalesce("id", "n_id").alias("id")]
    for c in old.columns[1:]:
        fresh = F.when(F.col("n_id").isNotNull(), F.col(f"n_{c}")).otherwise(F.col(c))
        cols.append((F.coalesce(c, f"n_{c}") if c == "started_at" else fresh).alias(c))
    return both.select(cols)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str], order: list) -> DataFrame:
    """Rows of `new` whose key is neither in `old` nor earlier in `new`."""
    fresh = new.join(old.select(key).distinct(), key, "left_anti")
    return fresh.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def last_wins(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Upsert: of each key the row with the largest `order`; new rows beat old ones."""
    rest = [c for c in old.columns if c not in key]
    every = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    best = every.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_n", F.col(order))).alias("b"))
    return best.select(*key, "b.*").select(old.columns)


def deactivate(memories: DataFrame, which: Column, now: str) -> DataFrame:
    """Soft delete of the active rows where `which` holds."""
    hit = F.col("is_active") & F.coalesce(which, F.lit(False))
    return memories.withColumn("updated_at", F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))).withColumn("is_active", F.col("is_active") & ~hit)


def consolidate(memories: DataFrame, source_ids: list[int], merged: DataFrame, now: str) -> DataFrame:
    """One plan: the sources go inactive and the merged memory is appended with the next id."""
    rest = deactivate(memories, F.col("id").isin(source_ids), now)
    return rest.unionByName(with_ids(merged.drop("id"), memories, ["title"]).select(memories.columns))


def delete_rows(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_anti")


def counters(deltas: DataFrame, names: list[str], at: str) -> DataFrame:
    """Sums of counter deltas and the latest known time of activity."""
    latest = F.max_by(at, F.when(F.col(at).isNotNull(), F.col("seq")))
    return deltas.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names], latest.alias(at))


def known_or(col: str, values: tuple, default: str) -> Column:
    """A known word as it is, any other as the default."""
    return F.when(F.col(col).isin(*values), F.col(col)).otherwise(F.lit(default))


def with_task_keys(memories: DataFrame) -> DataFrame:
    """Memories as they are read: one stored without task keys gets those of its title and body."""
    k = F.col("task_keys")
    return memories.withColumn("task_keys", F.when(k.isNull() | (F.size(k) == 0), task_keys_of(F.concat_ws("\n", "title", "body"))).otherwise(k))


def session_of(sessions: DataFrame, project: str | None, session_id: str | None = None) -> DataFrame:
    """At most one session: the named one if it is there, else the project's latest."""
    named = F.col("id").eqNullSafe(F.lit(session_id))
    own = sessions.where(named | (F.col("project_id") == project)).withColumn("_named", named)
    return own.orderBy(F.desc("_named"), F.desc(F.coalesce("last_seen_at", "started_at")), F.desc("id")).limit(1).drop("_named")


def latest_per(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id", keep_missing: bool = False) -> DataFrame:
    """Rows for an ordered list of ids (pos, id), in its order; missing ones dropped or kept as nulls."""
    return ids.withColumnRenamed("id", "_id").join(df, F.col("_id") == F.col(key), "left" if keep_missing else "inner").orderBy("pos")
