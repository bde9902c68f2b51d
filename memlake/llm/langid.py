"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the byte 2-, 3- and 4-grams of the lower-cased text, hashed into a fixed table of embeddings. A text is the
mean of its subwords' embeddings; a linear softmax gives the languages. Embeddings and weights are trained together by
stochastic gradient descent in numpy. A part of the sample is kept from training to fit a temperature, so that scores are
calibrated, and the least score at which predictions are reliable; below it a row is `rejected`.

The classifier is fitted on a bounded sample: SAMPLE_ROWS rows, spread evenly over the languages (the SAMPLE_ROWS most
frequent, should there be more), in the order of a hash of doc_id. Prediction reads every whole text.

Edge cases: null text, empty text and text without a letter give `und` and score 0. Rows with null lang, text or doc_id are
not learned from; a null doc_id is not held out. Repeated rows each come back. Without any labelled row every
prediction is `und`. Equal scores go to the smaller language name. Extra columns are ignored. Very long texts are embedded whole, in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.shared import table

BUCKETS = 1 << 16
DIM = 16
EPOCHS = 8
RATE = 4.0
SAMPLE_ROWS = 1600
#: Short pieces taken from each sampled text as further examples, so that short texts are known too: count and bytes.
PIECES, PIECE_BYTES = 2, (20, 160)
#: Of those at or over the rejection score, this share must be right in the calibration part.
PRECISION = 0.99
FOLDS, HELD_OUT = 4, 2


def buckets(data: bytes) -> np.ndarray:
    """The table rows of a text's subwords."""
    a = np.frombuffer(b" " + data + b" ", dtype=np.uint8).astype(np.uint32)
    out, h = [], a
    for n in range(1, 4):
        if len(a) <= n:
            break
        h = h[:-1] * np.uint32(16777619) ^ (a[n:] + np.uint32(n << 8))
        out.append((h * np.uint32(2654435761)) >> np.uint32(16))
    return np.concatenate(out)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Model:
    """Trained languages, the table of each bucket's part in the logits, temperature and least reliable score."""

    def __init__(self, langs: list[str], parts: np.ndarray, bias: np.ndarray, temperature: float, least: float):
        self.langs, self.parts, self.bias, self.temperature, self.least = langs, parts, bias, temperature, least

    def logits(self, data: bytes) -> np.ndarray:
        b = buckets(data)
        total = np.zeros(len(self.langs), dtype=np.float64)
        for i in range(0, len(b), 1 << 18):  # bounded memory for very long texts
            total += self.parts[b[i : i + (1 << 18)]].sum(axis=0, dtype=np.float64)
        return total / len(b) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not has_letter(text):
            return "und", 0.0
        p = softmax(self.logits(text.lower().encode()) / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(min(max(p[best], 0.0), 1.0))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray, bool]], seed: int = 7) -> Model:
    """Fits rows (language, bucket ids, their shares, is in the calibration part)."""
    langs = sorted({r[0] for r in rows})
    n = len(langs)
    if not n:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    table_ = rng.normal(0, 0.1, (BUCKETS, DIM))
    weights, bias = rng.normal(0, 0.1, (DIM, n)), np.zeros(n)
    number = {x: i for i, x in enumerate(langs)}
    fit = [r for r in rows if not r[3]] or rows
    steps, total = 0, EPOCHS * len(fit)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(fit)):
            lang, ids, share, _ = fit[k]
            rate = RATE * (1 - steps / total)
            steps += 1
            rows_ = table_[ids]
            x = share @ rows_
            err = softmax(x @ weights + bias)
            err[number[lang]] -= 1
            back = weights @ err
            weights -= 0.1 * rate * np.outer(x, err)
            bias -= 0.01 * rate * err
            table_[ids] = rows_ - rate * np.outer(share, back)
    parts = (table_ @ weights).astype(np.float32)
    judged = [r for r in rows if r[3]] or fit
    z = np.array([share @ parts[ids] for _, ids, share, _ in judged]) + bias
    y = np.array([number[r[0]] for r in judged])
    heats = np.geomspace(0.05, 20, 60)
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in heats]
    heat = float(heats[int(np.argmin(loss))])
    p = softmax(z / heat)
    score, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-score)
    share_right = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(share_right >= PRECISION)
    least = float(score[order][good[-1]]) if len(good) else 1.0
    return Model(langs, parts, bias, heat, least)


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, ids, shares, calibrates) of the sampled texts and of pieces of them."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold != HELD_OUT))
    per_lang = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()  # a row a language
    want = max(1, rows // max(len(per_lang), 1))
    spark = docs.sparkSession
    # Hashes under a language's share give a little more than is wanted; the driver sees those ids alone and keeps the first.
    shares = spark.createDataFrame([(r["lang"], min(1.0, (1.3 * want + 20) / r["count"])) for r in per_lang], "lang string, share double")
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 33) / float(1 << 31)
    near = usable.select("lang", "doc_id", place.alias("place")).join(F.broadcast(shares), "lang").where(F.col("place") < F.col("share")).select("lang", "doc_id", "place").distinct()
    taken: dict = {}
    for r in sorted(near.collect(), key=lambda r: (r["lang"], r["place"], r["doc_id"])):
        taken.setdefault(r["lang"], []).append(r["doc_id"])
    ids = spark.createDataFrame([(i,) for own in taken.values() for i in own[:want]], f"doc_id {dict(docs.dtypes)['doc_id']}").distinct()
    texts = usable.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, lang, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if not has_letter(text):
                    continue
                rng = np.random.default_rng(zlib.crc32(str(key).encode()))
                data = text.lower().encode()
                parts = [data]
                for _ in range(PIECES):
                    size = int(rng.integers(*PIECE_BYTES))
                    at = int(rng.integers(0, max(1, len(data) - size)))
                    parts.append(data[at : at + size])
                held = bool(rng.random() < 0.2)
                for part in parts:
                    found, n = np.unique(buckets(part), return_counts=True)
                    out.append((lang, found.astype(np.int32), (n / n.sum()).astype(np.float32), held))
            cols = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.bool_()), strict=True)], names=["lang", "ids", "shares", "held"])

    return texts.mapInArrow(pieces, "lang string, ids array<int>, shares array<float>, held boolean")


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from the bounded sample."""
    got = sample(docs, rows).toArrow().sort_by([("lang", "ascending")])
    cols = [got.column(i) for i in range(4)]
    data = [(lang.as_py(), i.values.to_numpy(), s.values.to_numpy().astype(np.float64), h.as_py()) for lang, i, s, h in zip(*cols, strict=True)]
    data.sort(key=lambda r: (r[0], r[1].tobytes()))
    return train(data)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    rows = docs.select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            said = [m.predict(x.as_py()) for x in b.column(2)]
            score = pa.array([s for _, s in said], pa.float64())
            low = pa.array([s < m.least or x == "und" for x, s in said], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in said], pa.string()), score, low], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, fit(docs))
