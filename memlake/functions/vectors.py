"""Vectors: cosine similarity on the JVM, exact search by Arrow batches of matrix products, and the blob codec."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.shared import sized_stash


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if lengths differ, a vector is empty, or a norm is zero."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), _dot(a, b) / norm)


def distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def _decode(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in blobs:
        yield s.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))


def _encode(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in vectors:
        yield s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def decode_f32(blob: Column) -> Column:
    """Little-endian 32-bit floats of a blob; null if its length isn't a multiple of four."""
    return F.pandas_udf(_decode, T.ArrayType(T.FloatType()))(blob)


def encode_f32(vector: Column) -> Column:
    return F.pandas_udf(_encode, T.BinaryType())(vector)


#: Stored bytes of queries that are sent to all tasks at most; beyond, queries and vectors meet in blocks of so many rows.
QUERY_BYTES, QUERY_BLOCK, VECTOR_BLOCK = 8 << 20, 1024, 16_384


def _query_block(got: pa.Table) -> dict[int, tuple[list, np.ndarray]]:
    """Ids and unit vectors of queries (query_id, vector) by vector size."""
    ids = got.column(0).to_pylist()
    rows = [np.asarray(v, np.float64) if v is not None else np.zeros(0) for v in got.column(1).to_pylist()]
    by_size: dict[int, tuple[list, np.ndarray]] = {}
    for size in {len(r) for r in rows if len(r)}:
        own = [(i, r / n) for i, r in zip(ids, rows, strict=True) if len(r) == size and (n := np.linalg.norm(r)) > 0]
        if own:
            by_size[size] = [i for i, _ in own], np.stack([r for _, r in own])
    return by_size


def _met(vectors: DataFrame, queries: DataFrame, key: str, vector: str, work: Callable, names: list[str], kinds: list[str], limit: int) -> DataFrame:
    """Rows that work(queries by size, ids' type, batch of vectors) gives, whether few queries go to all vectors or blocks of both meet."""
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    asked, size = sized_stash(queries.select("query_id", F.col(vector).alias("v")), "queries")
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v"))

    def batch(cols: list, types: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    if size <= limit:
        got = asked.toArrow()
        shared = vectors.sparkSession.sparkContext.broadcast((_query_block(got), got.schema.field(0).type))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for cols, types in work(*shared.value, b):
                    yield batch(cols, types)

        return rows.mapInArrow(run, schema)
    n_queries, n_rows = asked.count(), rows.count()
    q, p = -(-n_queries // QUERY_BLOCK), max(1, -(-n_rows // VECTOR_BLOCK))
    spread = rows.select("key", "v", F.pmod(F.xxhash64("key", "v"), F.lit(p)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(q - 1))).alias("block"))
    blocks = asked.select("query_id", "v", F.pmod(F.xxhash64("query_id", "v"), F.lit(q)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p - 1).cast("long"))).alias("part"))
    empty = vectors.sparkSession.createDataFrame([], schema).toArrow().schema

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            by_size = _query_block(right.select(["query_id", "v"]))
            for b in left.select(["key", "v"]).combine_chunks().to_batches():
                found += [batch(cols, types) for cols, types in work(by_size, right.schema.field("query_id").type, b)]
        return pa.Table.from_batches(found) if found else empty.empty_table()

    return spread.groupBy("part", "block").cogroup(blocks.groupBy("part", "block")).applyInArrow(meet, schema)


def _unit_rows(b: pa.RecordBatch, size: int) -> tuple[list, np.ndarray]:
    """Keys and unit vectors of a batch (key, vector) whose vectors have `size` numbers and a norm over zero."""
    keys, lists = b.column(0), b.column(1)
    sizes = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()])
    at = np.flatnonzero(sizes == size)
    if not len(at):
        return [], np.zeros((0, size))
    m = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
    norm = np.linalg.norm(m, axis=1)
    good = norm > 0
    return keys.take(pa.array(at[good])).to_pylist(), m[good] / norm[good, None]


def search(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, threshold: float, exclude_self: bool = True, limit: int = QUERY_BYTES) -> DataFrame:
    """(query_id, key, similarity): for each query the k most similar rows at or over the threshold; ties by key.

    `queries` (query_id, vector) whose stored size is within `limit` go to all tasks and `vectors` stay where they are; more meet them
    block by block. Either way a pair of blocks is one matrix product and keeps its k best for each query, and only these are shuffled on.
    """

    def work(by_size: dict, id_type: pa.DataType, b: pa.RecordBatch) -> Iterator[tuple]:
        for size, (q_ids, q) in by_size.items():
            own, m = _unit_rows(b, size)
            if not own:
                continue
            out: tuple[list, list, list] = ([], [], [])
            for i in range(0, len(q_ids), 256):
                sim = q[i : i + 256] @ m.T
                for j, row in enumerate(sim):
                    near = np.flatnonzero(row >= threshold)
                    best = sorted(near.tolist(), key=lambda x, r=row: (-r[x], own[x]))[: k + 1]
                    out[0].extend([q_ids[i + j]] * len(best))
                    out[1].extend(own[x] for x in best)
                    out[2].extend(row[best].tolist())
            yield out, [id_type, b.column(0).type, pa.float64()]

    found = _met(vectors, queries, key, vector, work, ["query_id", key, "similarity"], [dict(queries.dtypes)["query_id"], dict(vectors.dtypes)[key], "double"], limit)
    if exclude_self:
        found = found.where(F.col("query_id") != F.col(key))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def count_over(vectors: DataFrame, queries: DataFrame, key: str, vector: str, threshold: float, limit: int = QUERY_BYTES) -> DataFrame:
    """(query_id, n): for each query with any the number of rows at or over the threshold, but for rows of the query's own key or of none.

    Workers count hits by query and batch; only these sums are shuffled, so no number of hits is a bound.
    """

    def work(by_size: dict, id_type: pa.DataType, b: pa.RecordBatch) -> Iterator[tuple]:
        for size, (q_ids, q) in by_size.items():
            own, m = _unit_rows(b.filter(b.column(0).is_valid()), size)
            if not own:
                continue
            places: dict = {}
            for x, k in enumerate(own):
                places.setdefault(k, []).append(x)
            ids, sums = [], []
            for i in range(0, len(q_ids), 256):
                near = q[i : i + 256] @ m.T >= threshold
                for j, n in enumerate(near.sum(axis=1).tolist()):
                    n -= sum(int(near[j, x]) for x in places.get(q_ids[i + j], ()))
                    if n and q_ids[i + j] is not None:
                        ids.append(q_ids[i + j])
                        sums.append(n)
            yield (ids, sums), [id_type, pa.int64()]

    return _met(vectors, queries, key, vector, work, ["query_id", "n"], [dict(queries.dtypes)["query_id"], "long"], limit).groupBy("query_id").agg(F.sum("n").alias("n"))
