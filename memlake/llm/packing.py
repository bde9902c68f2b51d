"""Best-fit packing of tokenised documents into sequences of bounded length.

A document is its token ids and one end id; only documents longer than a sequence are cut. Hierarchical residual packing:
pieces are dealt into partitions of bounded size and packed there by best fit decreasing; bins that are nearly full are
final; the others become items of a next round in fewer partitions, up the tree, until one partition is left or a round no
longer helps. Only a bin's number and fill go up, so rows stay small whatever a bin holds. Pieces are dealt by a stored row
number, so no task gets many more than PIECES_PER_TASK items, however doc_ids repeat.

Edge cases: null or empty text is the end id alone. A very long text is tokenised in one task and cut into pieces. Rows with
a null doc_id are packed like others, and repeated rows each for itself. Items of one size are taken in the order of a hash
of their row numbers. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.words import coded_words, freeing, text_groups
from memlake.shared import arrow_rows, sized_stash, small, table

MAX_TOKENS = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Items packed in one task at most, about.
PIECES_PER_TASK = 50_000
#: A bin with at most this many free tokens is nearly full.
FREE_AT_MOST = 8
FAN_IN = 8
MIN_GAIN = 0.002
#: Words that a task remembers at most, about; bytes of text it works on at once, and rows it is sent at once: two such tasks share a machine's memory with the JVM.
CACHE_WORDS, GROUP, ROWS = 200_000, 1 << 20, 1000

#: ASCII marks, Latin letters, ASCII marks. Before letters no "'", which can begin a part of its own there, and no "<", which can begin a special token.
_FAST = re.compile(r"([!-&(-/:;=-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> list[str]:
    """The printable letter that byte-level BPE uses for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=2)
def tokenizer_of(path: str):
    """The whole tokenizer, loaded once in a worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """`x`, or a longer copy, with room for `n` values."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


class WordTokenizer:
    """Token ids of texts, word by word, with a bounded cache.

    White space parts words and is dropped by this vocabulary, so a text's ids are its words' ids in a row. Words of
    Latin letters between ASCII marks go straight to the model, part by part; all others go through the whole tokenizer.
    Once the cache is full, the half of its words that were met least is forgotten.
    """

    def __init__(self, path: str):
        self.whole = tokenizer_of(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.heads: dict[str, bytes] = {}
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0
        self.starts, self.sizes, self.met = (np.zeros(1 << 16, np.int64) for _ in range(3))

    def _head(self, word: str) -> bytes:
        got = self.heads.get(word)
        if got is None:
            text = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
            got = self.heads[word] = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        return got

    def _marks(self, marks: str) -> bytes:
        got = self.heads.get(marks)
        if got is None:
            got = self.heads[marks] = array("I", self.whole.encode(marks, add_special_tokens=False).ids).tobytes()
        return got

    def _word(self, word: str) -> bytes:
        if m := _FAST.fullmatch(word):
            before, letters, after = m.groups()
            ids = self._head(letters.lower())
            if after:
                ids += self._marks(after)
            return self._marks(before) + ids if before else ids
        return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()

    def _learn(self, fresh: list[str]) -> None:
        if len(self.heads) > CACHE_WORDS // 2:
            self.heads.clear()
        ids = list(map(self._word, fresh))
        data, first = np.frombuffer(b"".join(ids), "<u4"), len(self.index)
        last = first + len(ids)
        self.flat = _room(self.flat, self.used + len(data))
        self.starts, self.sizes, self.met = (_room(x, last) for x in (self.starts, self.sizes, self.met))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.index.update(zip(fresh, range(first, last), strict=True))
        self.flat[self.used : self.used + len(data)] = data
        self.starts[first:last], self.sizes[first:last], self.met[first:last] = self.used + np.cumsum(sizes) - sizes, sizes, 0
        self.used += len(data)

    def _forget(self) -> None:
        n, words = len(self.index), list(self.index)
        keep = np.sort(np.argsort(-self.met[:n], kind="stable")[: CACHE_WORDS // 2])
        self.index = {words[i]: k for k, i in enumerate(keep.tolist())}
        starts, sizes, k = self.starts[keep], self.sizes[keep], len(keep)
        ends = np.cumsum(sizes)
        self.used = int(ends[-1]) if k else 0
        self.flat[: self.used] = self.flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(self.used)]
        self.starts[:k], self.sizes[:k], self.met[:k] = ends - sizes, sizes, self.met[keep] // 2

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of `texts`, each followed by the end id, as unsigned 32-bit in a row; and where each text's ids end."""
        if len(self.index) > CACHE_WORDS:
            self._forget()
        codes, words, ends = coded_words(texts)
        words = words.to_pylist()
        found = list(map(self.index.get, words))
        if None in found:
            self._learn(list(compress(words, map(is_, found, repeat(None)))))
            found = map(self.index.__getitem__, words)
        at = np.fromiter(found, np.int64, len(words))
        self.met[at] += np.bincount(codes, minlength=len(at))
        first, count = self.starts[at], self.sizes[at]
        sizes = count[codes]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        ends = stops[ends]
        places = np.arange(stops[-1])
        ids = self.flat[np.repeat(first[codes] - stops[:-1], sizes) + places]
        out = np.full(len(ids) + len(texts), END_ID, "<u4")
        out[places + np.repeat(np.arange(len(texts)), np.diff(ends))] = ids
        return out, ends[1:] + np.arange(1, len(texts) + 1)

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of one text and the end id."""
        return self.ids_of(pa.array([text], pa.string()))[0]


def pieces(docs: DataFrame, vocabulary: str | None = None, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        tokens = WordTokenizer(path)  # its words are forgotten with the task, as a worker lives on through other stages
        for b in batches:
            row = 0
            for texts in text_groups(b.column(1), GROUP):
                ids, ends = tokens.ids_of(texts)
                begins = np.concatenate([[0], ends[:-1]])
                counts = -(-(ends - begins) // max_tokens)
                text = np.repeat(np.arange(len(texts)), counts)
                piece = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * max_tokens
                length = np.minimum(ends[text] - begins[text] - start, max_tokens)
                data, at = memoryview(ids).cast("B"), 4 * (begins[text] + start)
                crc = np.fromiter((zlib.crc32(data[i:j]) for i, j in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)), np.int64, len(at))
                keys = b.column(0).take(pa.array(text + row))
                row += len(texts)
                yield pa.RecordBatch.from_arrays([keys, pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        del tokens
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(freeing(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers by best fit decreasing: each item goes to the fullest bin that still takes it."""
    bins: list[list[int]] = []
    free_sizes: list[int] = []  # sorted sizes of free room that some bin has
    by_free: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = bisect_left(free_sizes, sizes[i])
        if k < len(free_sizes):
            free = free_sizes[k]
            spot = by_free[free].pop()
            if not by_free[free]:
                del by_free[free]
                free_sizes.pop(k)
            bins[spot].append(i)
        else:
            spot, free = len(bins), capacity
            bins.append([i])
        left = free - sizes[i]
        if left:
            if left not in by_free:
                by_free[left] = []
                insort(free_sizes, left)
            by_free[left].append(spot)
    return bins


_FIELDS = ("doc_id", "piece", "start", "length", "ids_crc32")


def _pack_round(items: DataFrame, tasks: int, level: int, max_tokens: int) -> DataFrame:
    """Packs items (uid, fill, ...) within each of `tasks` partitions: adds bin, at (place in it) and bin_fill to each row."""
    mix = F.xxhash64("uid", F.lit(level)).alias("mix")
    schema = ", ".join(f"{n} {t}" for n, t in items.dtypes)
    names = [*items.columns, "bin", "at", "bin_fill"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("mix", "ascending"), ("uid", "ascending")]).drop_columns(["mix"]).combine_chunks()
        fills = t.column("fill").to_numpy()
        bins = best_fit(fills.tolist(), max_tokens)
        order = np.array([i for members in bins for i in members], np.int64)
        counts = np.fromiter(map(len, bins), np.int64, len(bins))
        firsts = np.cumsum(counts) - counts
        stops = np.cumsum(fills[order])
        before = np.repeat((stops - fills[order])[firsts], counts)
        base = (level << 56) + (TaskContext.get().partitionId() << 28)
        added = (np.repeat(np.arange(len(bins)) + base, counts), stops - fills[order] - before, np.repeat(np.add.reduceat(fills[order], firsts), counts))
        out = pa.Table.from_arrays([*t.take(pa.array(order)).combine_chunks().columns, *map(pa.array, added)], names=names)
        yield from out.to_batches(max_chunksize=10_000)

    return items.select("*", mix).repartition(tasks, "mix").mapInArrow(freeing(run), f"{schema}, bin long, at long, bin_fill long")


def _lifted(rows: DataFrame, above: tuple[DataFrame, int] | None) -> DataFrame:
    """`rows` (..., bin, at) with bin and at of the bin of the rounds above that their own bin went into, if it went."""
    if above is None:
        return rows
    named = small(above[0].select(F.col("uid").alias("_bin"), F.col("bin").alias("_to"), F.col("at").alias("_by")), above[1])
    joined = rows.join(named, rows["bin"] == named["_bin"], "left")
    return joined.withColumns({"bin": F.coalesce("_to", "bin"), "at": F.col("at") + F.coalesce("_by", F.lit(0))}).drop("_bin", "_to", "_by")


def pack(found: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to pieces().

    Pieces take part in the first round only. Up the tree go the numbers and fills of underfull bins; at the end these
    rounds' rows, a small part of all, name the sequence and the place of each bin of the round below, down to the pieces.
    """
    with arrow_rows(found.sparkSession, ROWS):
        found, _ = sized_stash(found.select(*_FIELDS).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    whole = F.col("length") == max_tokens
    alone = found.where(whole).select(*_FIELDS, F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = found.where(~whole).withColumn("fill", F.col("length"))
    n, level, last, rounds = found.where(~whole).count(), 1, None, []
    tasks = -(-n // PIECES_PER_TASK)
    while tasks:
        rows, size = sized_stash(_pack_round(items, tasks, level, max_tokens), "bins")
        rounds.append((rows, size))
        loose = rows.where((F.col("at") == 0) & (F.col("bin_fill") < max_tokens - FREE_AT_MOST)).select(F.col("bin").alias("uid"), F.col("bin_fill").alias("fill"))
        left = loose.count()
        gained = last is None or last - left > MIN_GAIN * last
        if tasks == 1 or left <= 1 or not gained and left > PIECES_PER_TASK:
            break
        items, last, level = loose, left, level + 1
        tasks = max(-(-left // PIECES_PER_TASK), -(-tasks // FAN_IN)) if left > PIECES_PER_TASK else 1
    if not rounds:
        return alone
    above = None
    for rows, _ in reversed(rounds[1:]):
        above = sized_stash(_lifted(rows.select("uid", "bin", "at"), above), "placed")
    placed = _lifted(rounds[0][0].select(*_FIELDS, "bin", "at"), above)
    return alone.unionByName(placed.select(*_FIELDS, F.col("bin").alias("sequence_id"), F.col("at").alias("offset")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
