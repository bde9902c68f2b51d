"""HTTP providers: embeddings and completions asked by partitions, with retries, bounded concurrency and rate, and a stored table of replies.

Prompts that are equal are asked once. Replies and final failures are appended to the table slice by slice, so a run that ends early is
taken up where it stopped; what failed for the moment only (time-outs, 408, 409, 425, 429, 5xx) isn't stored and is asked again.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.providers import ProviderError, retryable_status
from memlake.shared import stash

TIMEOUT = 60
REPLIES = "k string, reply string, error string, attempts int"
#: Prompts asked between two appends to the table of replies.
SLICE = 10_000


def post(url: str, body: dict, headers: dict[str, str], timeout: float = TIMEOUT) -> dict:
    """The JSON that a POST gives; a ProviderError says whether another try is worth while."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            text = r.read()
    except urllib.error.HTTPError as e:
        raise ProviderError(f"status {e.code}", retryable_status(e.code)) from e
    except OSError as e:  # no connection, or none in time
        raise ProviderError(f"transport: {e}", True) from e
    try:
        return json.loads(text)
    except ValueError as e:
        raise ProviderError("reply is no JSON", False) from e


class HttpEmbedder:
    """Vectors by POST to /v1/embeddings: a batch of texts a call."""

    def __init__(self, base: str, model: str, headers: dict[str, str] | None = None, timeout: float = TIMEOUT):
        self.base, self.model, self.headers, self.timeout = base.rstrip("/"), model, headers or {}, timeout

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        data = post(f"{self.base}/v1/embeddings", {"model": self.model, "input": texts}, self.headers, self.timeout).get("data")
        try:
            out = [[float(x) for x in d["embedding"]] for d in sorted(data, key=lambda d: d.get("index", 0))]
        except (KeyError, TypeError, ValueError) as e:
            raise ProviderError("no embeddings in the reply", False) from e
        if len(out) != len(texts) or not all(out):
            raise ProviderError("embeddings are missing in the reply", False)
        return out


class HttpCompleter:
    """Text by POST to /v1/messages: the text blocks of the reply, joined."""

    def __init__(self, base: str, model: str, headers: dict[str, str] | None = None, max_tokens: int = 4096, timeout: float = TIMEOUT):
        self.base, self.model, self.headers, self.max_tokens, self.timeout = base.rstrip("/"), model, headers or {}, max_tokens, timeout

    def complete(self, system: str, prompt: str) -> str:
        body = {"model": self.model, "max_tokens": self.max_tokens, "system": system, "messages": [{"role": "user", "content": prompt}]}
        blocks = post(f"{self.base}/v1/messages", body, self.headers, self.timeout).get("content")
        if not isinstance(blocks, list):
            raise ProviderError("no content in the reply", False)
        text = "".join(b.get("text") or "" for b in blocks if isinstance(b, dict) and b.get("type", "text") == "text")
        if not text:
            raise ProviderError("no text in the reply", False)
        return text


def asked(call: Callable[[str], str], prompt: str, tries: int, wait: float) -> tuple[str | None, str | None, int, bool]:
    """Reply, error, attempts, and whether this is final, of a call tried again while that is worth while."""
    for n in range(1, tries + 1):
        try:
            return call(prompt), None, n, True
        except ProviderError as e:
            if not e.retryable or n == tries:
                return None, str(e), n, not e.retryable
            time.sleep(wait * 2 ** (n - 1))
    raise AssertionError("tries is at least 1")


def _replies(prompts: DataFrame, call: Callable[[str], str], tasks: int, concurrency: int, per_second: float | None, tries: int, wait: float) -> DataFrame:
    """(k, reply, error, attempts, final) of prompts (k, prompt): `tasks` at once at most, in each `concurrency` calls, begun `per_second` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(concurrency) as pool:
            rows = ((k, p) for b in batches for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            while some := list(islice(rows, 4 * concurrency)):
                waiting = []
                for _, p in some:
                    waiting.append(pool.submit(asked, call, p, tries, wait))
                    if per_second:
                        time.sleep(1 / per_second)
                out = [(k, *w.result()) for (k, _), w in zip(some, waiting, strict=True)]
                types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["k", "reply", "error", "attempts", "final"])

    return prompts.select("k", "prompt").repartition(tasks).mapInArrow(run, f"{REPLIES}, final boolean")


def answered(df: DataFrame, prompt: str, call: Callable[[str], str], path: str, tasks: int = 8, concurrency: int = 4, per_second: float | None = None, tries: int = 4, wait: float = 1.0, slice_rows: int = SLICE) -> DataFrame:
    """`df` with `reply` and `error` of each prompt; null prompts have neither. `path` is the table of replies, of one provider and model.

    Prompts that the table has, with a reply or a final error, aren't asked; another run asks the others again.
    """
    spark = df.sparkSession
    key = F.sha2(F.col(prompt), 256)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)
    known = spark.read.schema(REPLIES).parquet(path) if there else spark.createDataFrame([], REPLIES)
    todo = df.where(F.col(prompt).isNotNull()).select(key.alias("k"), F.col(prompt).alias("prompt")).dropDuplicates(["k"]).join(known.select("k"), "k", "left_anti")
    slices = max(1, -(-todo.count() // slice_rows))
    late = spark.createDataFrame([], REPLIES)
    for i in range(slices):
        part = todo.where(F.pmod(F.xxhash64("k"), F.lit(slices)) == i)
        found = stash(_replies(part, call, tasks, concurrency, per_second, tries, wait), "replies")
        found.where("final").drop("final").write.mode("append").parquet(path)
        late = late.unionByName(found.where("NOT final").drop("final"))
    out = spark.read.schema(REPLIES).parquet(path).unionByName(late)
    return df.withColumn("_k", key).join(out.withColumnRenamed("k", "_k").dropDuplicates(["_k"]).drop("attempts"), "_k", "left").drop("_k")
