"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

A text is cut into words and runs of punctuation.  Its features are hashed words,
word pairs, and triples of token shapes (case, digits, kind of punctuation,
repetition of the last token), each weighted by the root of its share.  The
follow-the-regularised-leader-proximal updates run over shards of the labelled
rows, and the shards' weights are averaged.  A score is the sparse dot product of
a text's features with the weights.

Training takes at most ``TRAIN_ROWS`` labelled rows, those with the smallest
hashes of their ids; weights are a table of fixed size.  Scoring is one pass over
the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrate_spark.llm import common, tokens

BITS = 18
TRAIN_ROWS = 16_000
SHARDS = 4
EPOCHS = 3
ALPHA, BETA, L1, L2 = 16.0, 1.0, 1e-6, 1e-5
CUT = 0.3
FOLDS = 5

_KIND = np.where(common.SPACES, 0, np.where(common.NOT_ALNUM, 2, 1)).astype(np.uint8)
_CHAR = np.arange(256)
_IS_UPPER = (_CHAR >= 65) & (_CHAR <= 90)
_IS_LOWER = (_CHAR >= 97) & (_CHAR <= 122)
_IS_DIGIT = (_CHAR >= 48) & (_CHAR <= 57)
_SALTS = common.mix(np.arange(900, 903, dtype=np.uint64))

SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _grams(codes: np.ndarray, size: int, salt: np.uint64) -> np.ndarray:
    n = max(0, len(codes) - size + 1)
    out = np.full(n, salt, np.uint64)
    for i in range(size):
        out = common.mix(out * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n])
    return out


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text and their values; a text without tokens has none."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends = common.runs(_KIND[data])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    with np.errstate(over="ignore"):
        count = lambda is_: np.diff(np.cumsum(is_[data])[np.stack((starts, ends - 1))], axis=0)[0] + is_[data[starts]]
        lower = np.where(_IS_UPPER[data], data + 32, data).astype(np.uint8)
        hashes = common.hash_runs(lower, starts, ends)
        first, size = data[starts], ends - starts
        upper, small, digits = count(_IS_UPPER), count(_IS_LOWER), count(_IS_DIGIT)
        shape = np.where(digits > 0, 3, np.where((upper > 1) & (small == 0), 2, np.where(_IS_UPPER[first], 1, 0)))
        punct = _KIND[first] == 2
        shape = np.where(punct, 16 + 4 * first.astype(np.int64) + np.minimum(size, 4) - 1, shape).astype(np.uint64)
        again = np.zeros(len(hashes), np.uint64)
        again[1:] = hashes[1:] == hashes[:-1]
        shape = shape * np.uint64(2) + again
        hashed = np.concatenate((_grams(hashes, 1, _SALTS[0]), _grams(hashes, 2, _SALTS[1]), _grams(shape, 3, _SALTS[2])))
    index, tf = np.unique((hashed >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    return index, np.sqrt(tf / tf.sum()).astype(np.float32)


class Ftrl:
    """Follow-the-regularised-leader-proximal logistic regression over hashed features."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        index, value = np.append(index, 1 << BITS), np.append(value, 1.0)  # the last weight is the constant
        w = self.weights(index)
        g = (sigmoid(float(w @ value)) - label) * value
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[index] = n + g * g


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept for testing; also without id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learned from at most ``rows`` labels whose documents are not held out.

    Null ids and labels are left out, a repeated label counts once; of different
    labels of one document both count.  Without labels all weights are 0.
    """
    wanted = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .distinct()
        .withColumn("order", F.xxhash64("doc_id"))
        .orderBy("order", "doc_id", "quality")
        .limit(rows)
    )

    def fit(seen: list) -> pa.RecordBatch:
        model = Ftrl()
        for _ in range(EPOCHS):
            for index, value, label in seen:
                model.update(index, value, label)
        weights = model.weights().astype("<f4").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([weights]), pa.array([len(seen)], pa.int64())], ["weights", "rows"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        shard, seen = None, []
        for b in batches:
            for own, text, label in zip(*(b.column(c).to_pylist() for c in ("shard", "text", "quality")), strict=True):
                if seen and own != shard:
                    yield fit(seen)
                    seen = []
                shard = own
                seen.append((*features(text), label))
        if seen:
            yield fit(seen)

    # the sample is bounded, so it may be sent to all tasks; documents stay where they are
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), "doc_id")
    # shards are made by key, so their number does not follow that of the partitions
    shards = (
        sample.withColumn("shard", F.pmod(F.hash("doc_id"), F.lit(SHARDS)))
        .repartition(4 * SHARDS, "shard")
        .sortWithinPartitions("shard", "order", "quality", "text")
        .select("shard", "text", "quality")
        .mapInArrow(learn, "weights binary, rows bigint")
        .collect()  # one table of weights a shard
    )
    total = np.zeros((1 << BITS) + 1)
    for shard in sorted(shards, key=lambda r: bytes(r["weights"])):
        total += np.frombuffer(shard["weights"], "<f4").astype(float) * shard["rows"]
    return (total / max(1, sum(s["rows"] for s in shards))).astype(np.float32)


def _scores(weights: np.ndarray, texts: list[str | None]) -> list[float]:
    out = []
    for text in texts:
        index, value = features(text)
        out.append(sigmoid(float(weights[index] @ value) + float(weights[-1])))
    return out


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score (0 to 1) of each row of ``docs``; an empty or null text scores as the constant says."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for b in batches:
            scores = _scores(sent.value, b.column("text").to_pylist())
            yield common.batch({"doc_id": b.column("doc_id"), "score": scores}, SCORED)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id bigint, score double")


def keep_good(docs: DataFrame, weights: np.ndarray, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``cut``."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for b in batches:
            keep = [s >= cut for s in _scores(sent.value, b.column("text").to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(good, docs.schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
