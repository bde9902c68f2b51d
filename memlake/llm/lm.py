"""LM scoring: a log-bilinear neural model, trained in numpy by noise-contrastive estimation.

Counts of all training tokens come first. The model predicts a token in two steps: its class, then the token within it. The
most frequent words (up to MODEL_WORDS, those seen MIN_COUNT times or more) have vectors of their own and form classes of
about equal frequency; all others share TAIL classes by a hash of their last two bytes, and within such a class words have
their add-one share of its training tokens. Both steps are normalised, so the probabilities of all tokens add up to one. Each
step is a sum of the two previous tokens' vectors, scaled by that step's position weights, times the output's vector, plus
its bias.

Training reads every training document: each partition runs one pass of stochastic gradient descent from the same start with
noise-contrastive estimation at both steps, noise drawn from the classes' frequencies and, within the token's class, evenly
from its words, which are about equally frequent. Rows of parameters are then averaged, weighted by the tokens that a partition has seen of them. So scores depend, a
little, on how rows are dealt to partitions. Scoring needs no noise: batched matrix products give the log-probabilities over all
classes, and over all words of a class.

Counts of the HEAD most frequent words travel to the workers (a bounded broadcast); rarer words of each document are
joined with the whole table of counts by shuffle, so no word is left out.

Edge cases: null or empty text is the end token alone. A very long text is scored whole, in one task. Rows with a null doc_id
are scored but not learned from. Repeated rows count and come back each for itself. Ties: words of equal counts are ranked by
their bytes, and where the head ends among equally frequent words a hash chooses. Without training rows all counts are zero. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.words import coded_words, text_groups
from memlake.shared import sized_stash, stash, table

FOLDS, HELD_OUT = 7, 2
#: Classes of words with vectors of their own, classes of all other words, and how many words have vectors at most.
CLASSES, TAIL = 128, 64
MODEL_WORDS, MIN_COUNT = 32_768, 4
CONTEXT_WORDS = 8192
HEAD = 200_000
DIM, ORDER = 16, 2
#: Noise of a batch for the classes, of a token for the words; tokens in a batch; rates of the two steps.
NOISE, WORD_NOISE, BATCH, RATE, WORD_RATE = 32, 1, 4096, 0.15, 0.1
#: Tokens scored at once, and logits of them at once, few enough for the processor's cache.
CHUNK, CACHE_FLOATS = 1 << 16, 1 << 18
#: The end token; no word holds a space.
END = b" "
_K, _C = CLASSES + TAIL, CONTEXT_WORDS + TAIL + 1
BEGIN = _C - 1
#: Places of a model's rows: contexts, position weights of both steps, classes, words.
_W, _Q = _C, _C + 2 * ORDER
_V = _Q + _K
_ROWS_PER_BLOCK = 1024


def tokens(text: str | None) -> list[bytes]:
    """Words of the whole text, A-Z lower-cased, and the end token."""
    words = (text or "").encode().lower().split()
    words.append(END)
    return words


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL


def coded_tokens(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Tokens of `texts` in a row as places in a list of distinct tokens, that list, and the place of each text's first token."""
    codes, words, ends = coded_words(pc.ascii_lower(texts))
    out = np.full(len(codes) + len(texts), len(words), np.int64)
    out[np.arange(len(codes)) + np.repeat(np.arange(len(texts)), np.diff(ends))] = codes
    return out, [*words.cast(pa.binary()).to_pylist(), END], ends[:-1] + np.arange(len(texts))


def counts(training: DataFrame) -> DataFrame:
    """(word binary, c long): counts of all training tokens, pre-aggregated where the texts stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group in text_groups(b.column(0), 64 << 20):
                codes, words, _ = coded_tokens(group)
                c = np.bincount(codes, minlength=len(words))
                seen = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).take(pa.array(seen)), pa.array(c[seen].astype(np.int64))], names=["word", "c"])

    return training.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Ranks and counts of the head words, their classes, and the training tokens of each tail class."""

    def __init__(self, words: list[bytes], c: list[int], total: int, distinct: int, tail_sums: dict[int, int]):
        self.rank = {w: i for i, w in enumerate(words)}
        self.total, self.distinct = total, distinct
        self.c = np.array(c, np.int64)
        self.n_model = model_words(self.c)
        tails = np.array([tail_of(w) for w in words], np.int64) if words else np.zeros(0, np.int64)
        places = np.arange(len(words))
        own = (self.c[: self.n_model] + 1).astype(np.float64)
        before = np.cumsum(own) - own
        made = np.unique((before / max(own.sum(), 1) * CLASSES).astype(np.int64), return_inverse=True)[1]
        #: Of each class, its first word and the one after its last.
        self.first = np.searchsorted(made, np.arange(CLASSES + 1))
        self.unit = np.concatenate([made, CLASSES + tails[self.n_model :]])
        self.context = np.where(places < CONTEXT_WORDS, places, CONTEXT_WORDS + tails)
        mass = np.zeros(_K)
        np.add.at(mass, made, own)
        self.tail_sums = np.array([tail_sums.get(i, 0) for i in range(TAIL)], np.float64)
        mass[CLASSES:] = self.tail_sums + 1
        self.noise = np.maximum(mass / mass.sum(), 1e-26)  # a class without words has next to nothing, and a finite logarithm
        self.word_share = own / mass[made]  # of a word within its class
        share = np.log10(self.c + 1.0) - np.log10(self.tail_sums[tails] + 1.0) if words else np.zeros(0)
        self.share = np.where(places < self.n_model, 0.0, share)  # of a word within its tail class
        self.log_c = np.log10(self.c + 1.0)

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Head rank (or -1), class and context number of each token."""
        get = self.rank.get
        at = np.array([get(w, -1) for w in words], np.int64)
        if len(self.c):
            unit, context = self.unit[at], self.context[at]
        else:
            unit, context = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        rare = np.flatnonzero(at < 0)
        tails = np.array([tail_of(words[i]) for i in rare], np.int64)
        unit[rare], context[rare] = CLASSES + tails, CONTEXT_WORDS + tails
        return at, unit, context


def model_words(c: np.ndarray) -> int:
    """How many of the head's words, in order of falling counts, have vectors of their own."""
    return int(min((c >= MIN_COUNT).sum(), MODEL_WORDS))


def vocabulary(counted: DataFrame, head: int = HEAD) -> Vocabulary:
    """Gathers the bounded head of the counts, the totals, and a sum for each tail class."""
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The head is all words over a count, found from a histogram of at most a few thousand steps: no task sorts all words.
    step = F.floor(F.log2(F.col("c").cast("double")) * 32).cast("int")
    least, room, last = None, head, None
    for k, n in sorted(counted.groupBy(step.alias("k")).agg(F.count("*")).collect(), reverse=True):
        if n > room:
            last = (k, 0.95 * room / n)
            break
        least, room = k, room - n
    inside = step >= (1 << 30 if least is None else least)
    if last is not None and room > 20:
        inside = inside | ((step == last[0]) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(last[1] * (1 << 20))))
    top = counted.where(inside).toArrow()
    words, c = top.column("word").to_pylist(), top.column("c").to_pylist()
    order = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))
    words, c = [words[i] for i in order], [c[i] for i in order]
    tail = F.crc32(F.expr("substring(word, greatest(octet_length(word) - 1, 1), 2)")) % TAIL
    sums = {r[0]: r[1] for r in counted.groupBy(tail.alias("b")).agg(F.sum(F.col("c") + 1)).collect()}
    n = model_words(np.array(c, np.int64))
    for w, x in zip(words[:n], c[:n], strict=True):
        sums[tail_of(w)] -= x + 1
    return Vocabulary(words, c, int(total), int(distinct), sums)


class LogBilinear:
    """Parameters in rows of a vector and a bias: contexts, position weights of both steps, classes, words."""

    def __init__(self, rows: np.ndarray | None = None, noise: np.ndarray | None = None, vocab: Vocabulary | None = None):
        n = vocab.n_model if vocab is not None else 0
        if rows is None:
            rng = np.random.default_rng(11)
            rows = np.zeros((_V + n, DIM + 1))
            rows[:, :DIM] = rng.normal(0, 0.1, (len(rows), DIM))
            rows[_W:_Q, :DIM] = 1.0
            rows[_Q:_V, DIM] = np.log(noise)
            if n:
                rows[_V:, :DIM] *= 0.1
                rows[_V:, DIM] = np.log(vocab.word_share)
        self.rows = np.ascontiguousarray(rows, np.float32)
        self.first = vocab.first if vocab is not None else None
        self.r, self.w = self.rows[:_W, :DIM], self.rows[_W:_Q, :DIM].reshape(2, ORDER, DIM)
        self.q, self.b = self.rows[_Q:_V, :DIM], self.rows[_Q:_V, DIM]
        self.v, self.a = self.rows[_V:, :DIM], self.rows[_V:, DIM]

    def hidden(self, contexts: np.ndarray, step: int = 0) -> np.ndarray:
        return sum(self.r[contexts[:, j]] * self.w[step, j] for j in range(ORDER))

    def log_probabilities(self, contexts: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities of the classes after their contexts."""
        return _log_softmax(self.hidden(contexts), self.rows[_Q:_V], units)

    def word_log_probabilities(self, contexts: np.ndarray, units: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities of words within their classes; 0 for tokens of tail classes."""
        out = np.zeros(len(units), np.float32)
        order = np.argsort(units.astype(np.uint16), kind="stable")
        sorted_units = units[order]
        order = order[: np.searchsorted(sorted_units, CLASSES)]
        h = self.hidden(contexts[order], 1)
        cuts = np.searchsorted(sorted_units, np.arange(CLASSES + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            i, j, first, last = cuts[k], cuts[k + 1], self.first[k], self.first[k + 1]
            if last - first > 1:
                own = order[i:j]
                out[own] = _log_softmax(h[i:j], self.rows[_V + first : _V + last], words[own] - first)
        return out


def _log_softmax(h: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each vector of `h` the logarithm of the share of the output `at` among all outputs `rows` (vectors and biases)."""
    out, weights = np.empty(len(at), np.float32), np.ascontiguousarray(rows.T)
    with_one = np.hstack([h, np.ones((len(h), 1), np.float32)])
    reach, top = np.sqrt((h * h).sum(1).max(initial=0)) * np.sqrt((rows[:, :DIM] ** 2).sum(1).max()), rows[:, DIM].max()
    calm = reach + abs(top) < 60  # then no exponential can overflow, nor all of a row vanish
    size = max(1, CACHE_FLOATS // len(rows))
    for i in range(0, len(at), size):
        z = with_one[i : i + size] @ weights
        if not calm:
            z -= z.max(axis=1, keepdims=True)
        own = z[np.arange(len(z)), at[i : i + size]]
        out[i : i + size] = own - np.log(np.einsum("ij->i", np.exp(z, out=z)))
    return out


def contexts_of(context: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The ORDER tokens before each token; BEGIN before a document's first."""
    out = np.full((len(context), ORDER), BEGIN, np.int64)
    start = np.zeros(len(context), np.int64)
    start[firsts] = firsts
    age = np.arange(len(context)) - np.maximum.accumulate(start)
    for j in range(ORDER):
        ok = age > j
        out[ok, j] = context[np.flatnonzero(ok) - j - 1]
    return out


def _summed(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, all under 2**16, and the sums of their rows of `x`."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")  # a radix sort
    ids = ids[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]][: len(ids)])
    return ids[first], np.add.reduceat(x[order], first, axis=0) if len(ids) else x


class Trainer:
    """Noise-contrastive estimation at both steps with AdaGrad updates of the rows met."""

    def __init__(self, vocab: Vocabulary, seed: int):
        self.v, self.model = vocab, LogBilinear(noise=vocab.noise, vocab=vocab)
        self.log_kn = np.log(NOISE * vocab.noise).astype(np.float32)
        self.sizes = np.diff(vocab.first)
        self.log_kw = np.log(WORD_NOISE / np.maximum(self.sizes, 1)).astype(np.float32)  # words of a class are about equally frequent
        self.cum, self.rng, self.seen = np.cumsum(vocab.noise), np.random.default_rng(seed), 0
        self.past, self.word_past = np.full((_V, DIM + 1), 1e-2, np.float32), np.ones(vocab.n_model, np.float32)
        #: How many tokens each row has learned from as what it stands for; noise alone doesn't count.
        self.met = np.zeros(len(self.model.rows), np.int64)

    def _step(self, ids: np.ndarray, grad: np.ndarray) -> None:
        past = self.past[ids] + grad * grad
        self.past[ids] = past
        self.model.rows[ids] += RATE * grad / np.sqrt(past)

    def _word_step(self, ids: np.ndarray, grad: np.ndarray) -> None:
        """One rate a word, not one a number."""
        past = self.word_past[ids] + np.einsum("nd,nd->n", grad, grad) / (DIM + 1)
        self.word_past[ids] = past
        self.model.rows[_V + ids] += (WORD_RATE / np.sqrt(past))[:, None] * grad

    def learn(self, contexts: np.ndarray, units: np.ndarray, words: np.ndarray) -> None:
        for i in range(0, len(units), BATCH):
            self._batch(contexts[i : i + BATCH], units[i : i + BATCH], words[i : i + BATCH])

    def _batch(self, ctx: np.ndarray, t: np.ndarray, word: np.ndarray) -> None:
        m, n = self.model, np.float32(len(t))
        z = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), _K - 1)
        rows = [m.r[ctx[:, j]] for j in range(ORDER)]
        h = sum(x * m.w[0, j] for j, x in enumerate(rows))
        qt, qz = m.q[t], m.q[z]
        good = 1 / (1 + np.exp((qt * h).sum(1) + m.b[t] - self.log_kn[t]))  # 1 - sigmoid
        bad = -1 / (1 + np.exp(-(h @ qz.T + m.b[z] - self.log_kn[z])))
        dh = (good[:, None] * qt + bad @ qz) / n
        one = np.ones((len(t), 1), np.float32)
        ids, grad = _summed(np.concatenate([t, z]), np.concatenate([good[:, None] * np.hstack([h, one]), np.hstack([bad.T @ h, bad.sum(0)[:, None]])]) / n)
        dr = [dh * m.w[0, j] for j in range(ORDER)]
        dw = np.zeros((2, ORDER, DIM + 1), np.float32)
        for j in range(ORDER):
            dw[0, j, :DIM] = (dh * rows[j]).sum(0)
        has = np.flatnonzero(t < CLASSES)
        if len(has):
            w, k = word[has], t[has]
            noise = (self.rng.random((len(w), WORD_NOISE), np.float32) * self.sizes[k][:, None]).astype(np.int64)
            both = np.concatenate([w[:, None], self.v.first[k][:, None] + np.minimum(noise, self.sizes[k][:, None] - 1)], axis=1)
            own = [x[has] for x in rows]
            h2 = np.hstack([sum(x * m.w[1, j] for j, x in enumerate(own)), one[has]])
            vecs = m.rows[_V + both]
            err = -1 / (1 + np.exp(self.log_kw[k][:, None] - np.einsum("nkd,nd->nk", vecs, h2)))
            err[:, 0] += 1
            word_ids, word_grad = _summed(both.ravel(), (err[:, :, None] * h2[:, None, :]).reshape(-1, DIM + 1))
            dh2 = np.einsum("nk,nkd->nd", err, vecs[:, :, :DIM]) / n
            for j in range(ORDER):
                dr[j][has] += dh2 * m.w[1, j]
                dw[1, j, :DIM] = (dh2 * own[j]).sum(0)
            self._word_step(word_ids, word_grad)
            self.met[_V:] += np.bincount(w, minlength=self.v.n_model)
        ctx_ids, ctx_grad = _summed(ctx.T.ravel(), np.concatenate(dr))
        self._step(_Q + ids, grad)
        self._step(ctx_ids, np.hstack([ctx_grad, np.zeros((len(ctx_ids), 1), np.float32)]))
        self._step(np.arange(_W, _Q), dw.reshape(2 * ORDER, DIM + 1))
        self.met[:_W] += np.bincount(ctx.ravel(), minlength=_W)
        self.met[_W:_V] += len(t)
        self.seen += len(t)


def train(training: DataFrame, vocab: Vocabulary) -> LogBilinear:
    """One pass over all training rows; as many numbers as parameters reach the driver."""
    shared = training.sparkSession.sparkContext.broadcast(vocab)
    schema = "block int, ids binary, met binary, x binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = shared.value
        t = Trainer(v, TaskContext.get().partitionId())
        for b in batches:
            for group in text_groups(b.column(0)):
                codes, words, firsts = coded_tokens(group)
                at, unit, context = v.ids(words)
                t.learn(contexts_of(context[codes], firsts), unit[codes], at[codes])
        ids = np.flatnonzero(t.met).astype(np.int32)
        cuts = np.searchsorted(ids, np.arange(0, len(t.met) + _ROWS_PER_BLOCK, _ROWS_PER_BLOCK))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            own = ids[cuts[k] : cuts[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (own, t.met[own], t.model.rows[own]))], names=names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total, sums = None, None, None

        def done() -> pa.RecordBatch:
            own = np.flatnonzero(total)
            mean = (sums[own] / total[own, None]).astype(np.float32)
            ids = (own + block * _ROWS_PER_BLOCK).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, total[own], mean))], names=names)

        for b in batches:
            for k, ids, met, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != block:
                    if block is not None:
                        yield done()
                    block, total, sums = k, np.zeros(_ROWS_PER_BLOCK, np.int64), np.zeros((_ROWS_PER_BLOCK, DIM + 1))
                at, weight = np.frombuffer(ids, np.int32) - block * _ROWS_PER_BLOCK, np.frombuffer(met, np.int64)
                total[at] += weight
                sums[at] += weight[:, None] * np.frombuffer(x, np.float32).reshape(-1, DIM + 1)
        if block is not None:
            yield done()

    parts = training.select("text").mapInArrow(run, schema).repartition("block").sortWithinPartitions("block")
    merged = parts.mapInArrow(merge, schema).toArrow()
    shared.unpersist()
    rows = LogBilinear(noise=vocab.noise, vocab=vocab).rows
    for ids, x in zip(merged.column("ids").to_pylist(), merged.column("x").to_pylist(), strict=True):
        rows[np.frombuffer(ids, np.int32)] = np.frombuffer(x, np.float32).reshape(-1, DIM + 1)
    return LogBilinear(rows, vocab=vocab)


def score(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    training = docs.where(F.coalesce(fold != HELD_OUT, F.lit(False)))
    counted = stash(counts(training), "counts")
    vocab = vocabulary(counted, head)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, train(training, vocab)))
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "rare", "times"]
    schema = f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, model double, rare array<binary>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = shared.value
        log10 = 1 / np.log(10)
        for b in batches:
            row = 0
            for group in text_groups(b.column(3)):
                codes, words, firsts = coded_tokens(group)
                known, unit, context = v.ids(words)
                at, units, ctx = known[codes], unit[codes], contexts_of(context[codes], firsts)
                p = np.empty(len(at))
                for i in range(0, len(at), CHUNK):
                    part = slice(i, i + CHUNK)
                    p[part] = m.log_probabilities(ctx[part], units[part])
                    p[part] += m.word_log_probabilities(ctx[part], units[part], at[part])
                p *= log10
                head_ = at >= 0
                if len(v.c):
                    p += np.where(head_, v.share[at], 0.0)
                    logs = np.where(head_, v.log_c[at], 0.0)
                else:
                    logs = np.zeros(len(at))
                text = np.repeat(np.arange(len(group)), np.diff([*firsts, len(at)]))
                rare, times = np.unique((text[~head_] << 32) + codes[~head_], return_counts=True)
                ends = pa.array(np.searchsorted(rare >> 32, np.arange(len(group) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(words, pa.binary()).take(pa.array(rare & 0xFFFFFFFF)), pa.array(times.astype(np.int32)))]
                sums = (np.diff([*firsts, len(at)]).astype(np.int64), np.add.reduceat(head_.astype(np.int64), firsts), np.add.reduceat(logs, firsts), np.add.reduceat(p, firsts))
                own = b.slice(row, len(group))
                row += len(group)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), *map(pa.array, sums), *lists], names=names)

    found, _ = sized_stash(rows.mapInArrow(run, schema), "scored")
    tail = F.crc32(F.expr("substring(word, greatest(octet_length(word) - 1, 1), 2)")) % TAIL
    sums = F.array(*[F.lit(float(x)) for x in vocab.tail_sums])
    one = found.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("z")).select("uid", F.col("z.rare").alias("word"), F.col("z.times").alias("t"))
    c = F.coalesce("c", F.lit(0))
    joined = one.join(counted, "word", "left").select(
        "uid",
        F.when(c > 0, F.col("t")).otherwise(0).alias("k"),
        (F.col("t") * F.log10(c + 1)).alias("base"),
        (F.col("t") * (F.log10(c + 1) - F.log10(F.get(sums, tail.cast("int")) + 1))).alias("model"),
    )
    added = joined.groupBy("uid").agg(F.sum("k").alias("k"), F.sum("base").alias("rb"), F.sum("model").alias("rm"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    spread = float(np.log10(vocab.total + vocab.distinct + 1))
    return found.drop("rare", "times").join(added, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("k")).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rb") - F.col("n_tokens") * F.lit(spread)).alias("base_score"),
        (F.col("model") + zero("rm")).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
