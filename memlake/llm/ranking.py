"""Ranked lexical search: a blocked sparse matrix product with integer impacts.

Two sparse matrices are multiplied: items by terms (how often an item has a term) and terms by documents (an int64 impact).
Documents are read once: each becomes its number of terms and the counts of those of its terms that some item has, stored
as sparse rows. The terms' frequencies are summed from these rows, and then each block of rows is turned into postings by
term. A row of the product is the merge of the postings of the item's terms (Gustavson), added up in a dense row of
int64 over the block's documents; a task keeps the k best documents of each item over its blocks, and only these are shuffled:
first within groups of GROUP_TASKS tasks, then by item.

Items are taken in blocks of ITEM_BYTES of stored terms, so what is sent to all tasks is bounded however many items there are.

Edge cases: null and empty texts have no terms; such documents aren't counted and never found. An item without a known term
has no rows. Very long texts are one row of counts, no longer than the items' distinct terms. Ties go to the smaller doc_id,
null first. Repeated document rows are documents of their own. Rows of one item_id (null is one too) are one item with the
terms of all its distinct texts. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.llm.words import coded_words, freeing, text_groups
from memlake.shared import LOWER, UPPER, ascii_lower, sized_stash, stash, table

#: Maximal matches of this are terms, A-Z lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 20
#: Fixed values of the score.
SCALE, TF_SCALE, LENGTH_SHARE, BASE, DAMP = 1_000_000_000, 1000, 25, 100, 12
#: Stored bytes of item terms in one block of items, and counts in one block of documents, about.
ITEM_BYTES, BLOCK_COUNTS = 4 << 20, 1 << 20
#: Tasks whose best documents meet in a first step.
GROUP_TASKS = 256

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
for _c in range(0x30, 0x3A):
    _FOLD[_c] = _c
for _c in range(0x61, 0x7B):
    _FOLD[_c] = _FOLD[_c - 0x20] = _c


def folded(texts: pa.Array) -> pa.Array:
    """`texts` with A-Z lower-cased and a space for each byte that is in no term; bytes over 0x7F are always in one."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or at[0] == at[-1]:
        return texts
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(_FOLD[np.frombuffer(data, np.uint8)[at[0] : at[-1]]]))


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term, times) of every item."""
    found = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TERM), F.lit(0))
    return items.select(F.col(key).alias("item"), text).distinct().select("item", F.explode(found).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))


def counted(docs: DataFrame, terms: pa.Array, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n, at, tf) of every document with a term: its terms in all, places in `terms` of those it has, and how often."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            row = 0
            for texts in text_groups(b.column(1)):
                codes, words, ends = coded_words(folded(texts))
                place = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int64)[codes]
                n = np.diff(ends)
                doc = np.repeat(np.arange(len(texts)), n)
                pairs, tf = np.unique((doc * len(known) + place)[place >= 0], return_counts=True)
                full = np.flatnonzero(n)
                lists = np.searchsorted(pairs // max(len(known), 1), np.append(full, len(texts))).astype(np.int32)
                at, counts = (pa.ListArray.from_arrays(pa.array(lists), pa.array(x.astype(np.int32))) for x in (pairs % max(len(known), 1), tf))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(full + row)), pa.array(n[full]), at, counts], names=["doc", "n", "at", "tf"])
                row += len(texts)

    return docs.select(F.col(key).cast("long").alias("doc"), text).mapInArrow(freeing(run), "doc long, n long, at array<int>, tf array<int>")


def frequencies(rows: DataFrame, n_terms: int) -> tuple[np.ndarray, int, int]:
    """Documents by term, documents with a term, and terms of all documents, of counted() rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(n_terms, np.int64), 0, 0
        for b in batches:
            df += np.bincount(b.column(1).flatten().to_numpy(), minlength=n_terms)
            docs += b.num_rows
            total += pc.sum(b.column(0)).as_py() or 0
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-1, -2]).astype(np.int32)), pa.array(np.append(df[seen], [docs, total]))], names=["term", "c"])

    sums = rows.select("n", "at").mapInArrow(run, "term int, c long").groupBy("term").agg(F.sum("c").alias("c")).toArrow()  # as many rows as terms of a block of items
    by = dict(zip(sums.column(0).to_pylist(), sums.column(1).to_pylist(), strict=True))
    return np.array([by.get(i, 0) for i in range(n_terms)], np.int64), by.get(-1, 0), by.get(-2, 0)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """Int64 impacts of counts `tf` of terms with `weight` in documents of `n` terms."""
    wide = len(n) and int(n.max()) * LENGTH_SHARE * n_docs >= 1 << 63
    length = (LENGTH_SHARE * (n.astype(object) if wide else n) * n_docs // total).astype(np.int64)
    return weight * (SCALE * tf // (TF_SCALE * tf + DAMP * (BASE - LENGTH_SHARE + length)))


class _Best:
    """The k best documents of each item so far: scores, keys, and whether a key isn't null."""

    def __init__(self, items: int, k: int):
        self.k, self.rows = k, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * items
        self.least = np.ones(items, np.int64)

    def add(self, item: int, scores: np.ndarray, keys: np.ndarray, known: np.ndarray) -> None:
        near = np.flatnonzero(scores >= self.least[item])
        if not len(near):
            return
        all_of = [np.concatenate(x) for x in zip(self.rows[item], (scores[near], keys[near], known[near]), strict=True)]
        order = np.lexsort((all_of[1], all_of[2], -all_of[0]))[: self.k]
        self.rows[item] = tuple(x[order] for x in all_of)
        if len(order) == self.k:
            self.least[item] = self.rows[item][0][-1]


def _blocks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in a row with about BLOCK_COUNTS counts, or one row."""
    cut = np.cumsum(b.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) // BLOCK_COUNTS
    cuts = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), b.num_rows]
    return (b.slice(i, j - i) for i, j in zip(cuts, cuts[1:], strict=False) if j > i)


def product(rows: DataFrame, n_items: int, matrix: tuple[np.ndarray, np.ndarray, np.ndarray], weight: np.ndarray, n_docs: int, total: int, k: int = TOP) -> DataFrame:
    """(item number, doc, score, task): the k best documents of each item in each task, of counted() rows.

    `matrix` holds the items' rows: where each begins in the lists of term places and of times, sorted by item.
    """
    shared = rows.sparkSession.sparkContext.broadcast((matrix, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (begins, places, times), w = shared.value
        begins, places, times, best = begins.tolist(), places.tolist(), times.tolist(), _Best(n_items, k)
        for batch in batches:
            for b in _blocks(batch):
                n, term, tf = b.column(1).to_numpy(), b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(len(n)), b.column(2).value_lengths().to_numpy())
                order = np.argsort(term, kind="stable")
                doc, value = doc[order], impacts(w[term], tf, n[doc], n_docs, total)[order]
                starts = np.searchsorted(term[order], np.arange(len(w) + 1)).tolist()
                keys, known = pc.fill_null(b.column(0), 0).to_numpy(), pc.is_valid(b.column(0)).to_numpy(zero_copy_only=False)
                for i in range(n_items):
                    sums = np.zeros(len(n), np.int64)
                    for x in range(begins[i], begins[i + 1]):
                        at = slice(starts[places[x]], starts[places[x] + 1])
                        sums[doc[at]] += times[x] * value[at]
                    best.add(i, sums, keys, known)
        sizes = [len(r[0]) for r in best.rows]
        item = np.repeat(np.arange(n_items, dtype=np.int32), sizes)
        score, key, known = (np.concatenate([r[j] for r in best.rows]) for j in range(3))
        task = np.full(len(item), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(key, mask=~known), pa.array(score), pa.array(task)], names=["item", "doc", "score", "task"])

    return rows.mapInArrow(freeing(run), "item int, doc long, score long, task int")


def best_of(found: DataFrame, k: int = TOP) -> DataFrame:
    """(item, doc, score, rank): the k best rows of each item, met first within groups of tasks."""
    order = (F.desc("score"), F.asc_nulls_first("doc"))
    some = F.row_number().over(Window.partitionBy("item", F.floor(F.col("task") / GROUP_TASKS)).orderBy(*order))
    near = found.withColumn("rank", some).where(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("item", "doc", "score", "rank")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of `docs` (doc_id, text) for each of `items` (item_id, text)."""
    spark = docs.sparkSession
    kind = dict(items.dtypes)["item_id"]
    wanted, size = sized_stash(item_terms(items), "item-terms")
    blocks = max(1, -(-size // item_bytes))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow()  # bounded by item_bytes
        if not part.num_rows:
            continue
        ids, terms = (pc.unique(part.column(c).combine_chunks()) for c in ("item", "term"))
        item, term = (np.asarray(pc.index_in(part.column(c).combine_chunks(), value_set=v), np.int64) for c, v in (("item", ids), ("term", terms)))
        order = np.lexsort((term, item))
        matrix = np.searchsorted(item[order], np.arange(len(ids) + 1)), term[order], part.column("times").to_numpy()[order]
        rows = stash(counted(docs, terms), "counts")
        df, n_docs, total = frequencies(rows, len(terms))
        if not total:
            continue
        best = best_of(product(rows, len(ids), matrix, weights(df, n_docs), n_docs, total, k), k)
        names = spark.createDataFrame(list(enumerate(ids.to_pylist())), f"item int, item_id {kind}")
        out = out.unionByName(stash(best.join(F.broadcast(names), "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score"), "ranked"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _terms_sql(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{TERM}')"


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_terms_sql("text")} AS terms FROM documents),
e AS (SELECT row, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM e),
p AS (SELECT row, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, unnest(terms) AS term FROM e) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
m AS (SELECT row, doc_id, {BASE - LENGTH_SHARE} + ({LENGTH_SHARE} * n * docs) // total AS m FROM e, s),
q AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT item_id, unnest({_terms_sql("text")}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
r AS (SELECT item_id, p.row, any_value(doc_id) AS doc_id, CAST(sum(times * w * (({SCALE} * tf) // ({TF_SCALE} * tf + {DAMP} * m))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN f USING (term) JOIN m ON m.row = p.row GROUP BY item_id, p.row),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {TOP}
"""
