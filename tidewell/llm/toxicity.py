"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words, their stems (the first bytes of a word, STEMS long), word pairs, and pairs with one or two
words between, hashed to SLOTS places. The model is fitted in one sequence of examples, on a bounded sample of the
labelled rows: TRAIN_ROWS of them, those of the least hashes of doc_id and label, so that copies of a text are drawn
one by one. Each coordinate has its own learning rate, and L1 keeps most weights at zero. The non-zero weights,
SLOTS at most, are broadcast. An example of label 1 counts UP-fold at most, as it is the rarer one.

Defined results: a null text is empty; an empty text has the score of the bias alone; labels that are null or
of no document, and documents without doc_id, are no examples; of several labels of one document each is an
example, as is each of several texts of one doc_id; without labels of both classes every score is the share of the
label 1 there is (0 if none). Repeated rows score alike. Columns other than doc_id, text and toxic are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import chunks, documents, flat, mix, released, span_hashes, stored

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
#: The most labelled rows that the model is fitted on.
TRAIN_ROWS = 24_000
STEMS = (3, 4, 5, 6)
EPOCHS, ALPHA, BETA, L1, L2, UP = 2, 0.2, 1.0, 4.0, 1.0, 3.0
THRESHOLD = 0.7

_WORD = np.zeros(256, bool)
_WORD[[39, *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of each text, with offsets."""
    data, offsets = flat(column)
    n = len(offsets) - 1
    inner = np.concatenate([[False], _WORD[data], [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inner[1:-1] & (~inner[:-2] | edge[:-1]))
    ends = np.flatnonzero(inner[1:-1] & (~inner[2:] | edge[1:])) + 1
    values = _FOLD[data]
    h = span_hashes(values, starts, ends)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    parts, owners = [h], [doc]
    for size in STEMS:
        long = ends - starts > size
        parts.append(mix(span_hashes(values, starts[long], starts[long] + size) + np.uint64(99)))
        owners.append(doc[long])
    for skip in (1, 2, 3):
        same = doc[skip:] == doc[:-skip]
        parts.append(mix(h[:-skip] * np.uint64(0xD6E8FEB86659FD93) + h[skip:] + np.uint64(skip))[same])
        owners.append(doc[skip:][same])
    slot = (np.concatenate(parts) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    key = np.sort(np.concatenate(owners) << SLOT_BITS | slot)
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key & (SLOTS - 1), np.concatenate([[0], np.cumsum(np.bincount(key >> SLOT_BITS, minlength=n))])


class Ftrl:
    """Per-coordinate state z and n; a weight is zero while |z| stays within L1."""

    def __init__(self) -> None:
        self.z, self.n, self.bias = np.zeros(SLOTS), np.zeros(SLOTS), [0.0, 0.0]

    def weights(self, i) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def offset(self) -> float:
        z, n = self.bias
        return -z / ((BETA + n**0.5) / ALPHA)

    def learn(self, i: np.ndarray, y: int, weight: float) -> None:
        w, b = self.weights(i), self.offset()
        p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30)))
        g = (p - y) * weight
        old = self.n[i]
        self.n[i] = old + g * g
        self.z[i] += g - (np.sqrt(self.n[i]) - np.sqrt(old)) / ALPHA * w
        z, n = self.bias
        self.bias = [z + g - ((n + g * g) ** 0.5 - n**0.5) / ALPHA * b, n + g * g]


def drawn(labels: DataFrame, rows: int, key: list[str]) -> DataFrame:
    """At most `rows` rows, those of the least hashes of key; labels is small, as texts aren't in it."""
    hashed = labels.withColumn("_h", F.xxhash64(*key))
    total = hashed.count()
    if total > rows:  # a cut that leaves more than enough, so that little is sorted
        share = min(1.0, (rows + 8 * rows**0.5 + 16) / total)
        cut = hashed.where(F.col("_h") <= min(2**63 - 1, int(-(2**63) + share * 2**64)))
        hashed = cut if cut.count() >= rows else hashed  # fewer only if many rows are equal
    return hashed.orderBy("_h", *key).limit(rows).drop("_h")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots and weights other than zero, and the bias; docs: doc_id, text; labels: doc_id, toxic.

    The sample is drawn from the labels of documents that exist, before any text is read, and broadcast: its size
    is bounded by `rows`. The fitting task reads it once for each epoch, in the order of a hash, as a stream.
    """
    docs = docs.select("doc_id", "text")
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sample = stored(drawn(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), rows, ["doc_id", "toxic"]), "sample")
    ones, total = (int(x or 0) for x in sample.agg(F.sum("toxic"), F.count("*")).first())
    if not 0 < ones < total:
        return np.zeros(0, np.int64), np.zeros(0), 30.0 if ones else -30.0
    up = min(UP, (total - ones) / ones)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            slots, offsets = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("toxic"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(slots.astype(np.int32)))], ["h", "toxic", "slots"])

    # A doc_id that stands in several rows has several texts; of each label so many are examples as the bound allows.
    found = docs.join(F.broadcast(sample), "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), "toxic", F.coalesce("text", F.lit("")).alias("text"))
    examples = stored(found.mapInArrow(released(run), "h long, toxic int, slots array<int>"), "examples")
    if examples.count() > rows:
        examples = examples.orderBy("h", "toxic").limit(rows)
    turns = examples.select(F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))).alias("epoch"), "*")
    turns = turns.withColumn("place", F.xxhash64("epoch", "h")).repartition(1).sortWithinPartitions("epoch", "place", "toxic")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl()
        for b in batches:
            for y, i in zip(b.column("toxic").to_pylist(), b.column("slots"), strict=True):
                model.learn(np.asarray(i.values), y, up if y else 1.0)
        w = model.weights(slice(None))
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(w[used], model.offset()))], ["slot", "weight"])

    got = turns.select("toxic", "slots").mapInArrow(released(learn), "slot long, weight double").toArrow()
    slot, weight = got["slot"].to_numpy(), got["weight"].to_numpy()
    real = slot >= 0
    order = np.argsort(slot[real])
    return slot[real][order], weight[real][order], float(weight[~real][0])


def scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, weights, bias = held.value
        dense = np.zeros(SLOTS)
        dense[slots] = weights
        for b in chunks(batches, "text"):
            own, offsets = features(b.column("text"))
            total = np.concatenate([[0.0], np.cumsum(dense[own])])
            p = 1 / (1 + np.exp(-np.clip(total[offsets[1:]] - total[offsets[:-1]] + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, score double, predicted int")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out())
    model = fit(docs, labels)
    return scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
