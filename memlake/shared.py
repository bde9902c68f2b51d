"""Session helpers shared by all operators: tables, shared folder, lineage cuts, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its stored Parquet files are at most this large.
BROADCAST_BYTES = 24 << 20

_own_dir: str | None = None
_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table `name` under `sf_dir`, by Spark's reader, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where unset on a local master."""
    global _own_dir
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="memlake-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no one else uses."""
    path = f"{shared_dir(spark)}/memlake-{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clean(spark: SparkSession) -> None:
    """Removes the intermediate tables of this process; call it once its results are written."""
    while _made:
        remove_path(spark, _made.pop())


@contextmanager
def scratch(spark: SparkSession, *keep: str) -> Iterator[None]:
    """On leaving, removes the intermediate tables made inside, but for those with a tag in `keep`."""
    first = len(_made)
    yield
    made, _made[first:] = _made[first:], []
    for path in made:
        if any(f"/memlake-{tag}-" in path for tag in keep):
            _made.append(path)
        else:
            remove_path(spark, path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python tasks that run inside are sent at most so many rows at once, so that a batch of long texts stays small on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes stored under `path`, asked of its file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def make_path(spark: SparkSession, path: str) -> None:
    """Makes the folder `path` unless it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: cuts lineage, outlives executors."""
    return sized_stash(df, tag)[0]


def sized_stash(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """Like stash(), and the bytes stored."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path_bytes(spark, path)


def small(df: DataFrame, stored_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if its stored size is within `limit`; else as it is, for a shuffle join."""
    return F.broadcast(df) if stored_bytes <= limit else df


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once, also when it is used inside lambdas."""
    return F.transform(F.array(value), body)[0]


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)
