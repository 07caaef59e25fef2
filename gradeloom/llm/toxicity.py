"""Toxicity: logistic regression by FTRL-proximal over hashed words, neighbouring words and words one apart.

Rates per coordinate let rare words learn fast, and the L1 term keeps most weights at exactly zero, so a model is a short
list of buckets and weights. Words also count by their first letters, so that inflected forms share what is learned.
Several tasks learn from a bounded sample, each in an order of its own, and their weights are averaged.
"""

import struct
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.common import WordCache, mixed, once, per_text, slices, stored, texts
from gradeloom.llm.licenses import words_of

BITS = 20
BUCKETS = 1 << BITS
#: Most labelled rows that a fit uses, picked by a hash of their ids; weights settle long before this many.
SAMPLE_ROWS = 12_000
ORDERS = 3
STEMS = (4, 6)
EPOCHS = 3
THRESHOLD = 0.3
_U = np.uint64


class Settings(NamedTuple):
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 1.0


class Model(NamedTuple):
    """Sorted buckets with their weights, at most ``BUCKETS``, and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float


def _word(word: bytes) -> bytes:
    """Hashes of a word and of its stems; a word no longer than a stem stands for it."""
    letters = word.decode("utf-8", "replace")
    stems = [f"{n}{letters[:n]}".encode() if len(letters) > n else word for n in STEMS]
    return struct.pack("<3Q", *map(xxhash.xxh3_64_intdigest, (word, *stems)))


def features(text: bytes) -> np.ndarray:
    """Distinct buckets of a text's words, their stems, pairs of neighbours and pairs one word apart."""
    cache = once("toxicity", "word and stems", lambda: WordCache(_word))
    found = np.frombuffer(b"".join(map(cache.__getitem__, words_of(text))), _U).reshape(-1, 1 + len(STEMS))
    h = found[:, 0]
    pairs = mixed(h[:-1] * _U(3) + mixed(h[1:]) + _U(1)) if len(h) > 1 else h[:0]
    skips = mixed(h[:-2] * _U(5) + mixed(h[2:]) + _U(2)) if len(h) > 2 else h[:0]
    return np.unique((np.concatenate([found.ravel(), pairs, skips]) >> _U(64 - BITS)).astype(np.int32))


def logistic(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(max(x, -35.0), 35.0)))


def fit(rows: list[tuple[np.ndarray, int]], settings: Settings = Settings(), epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over rows of buckets and labels, in the order given, ``epochs`` times."""
    alpha, beta, l1, l2 = settings
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    share = (sum(y for _, y in rows) + 0.5) / (len(rows) + 1.0)
    intercept, seen = float(np.log(share / (1 - share))), 1.0
    for _ in range(epochs):
        for buckets, label in rows:
            zs, ns = z[buckets], n[buckets]
            root = np.sqrt(ns)
            w = np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + root) / alpha + l2))
            error = logistic(intercept + w.sum()) - label
            step = error * error
            n[buckets] = ns + step
            z[buckets] = zs + error - (np.sqrt(ns + step) - root) / alpha * w
            seen += step
            intercept -= 0.1 * error / np.sqrt(seen)
    kept = np.flatnonzero(np.abs(z) > l1)
    zs, root = z[kept], np.sqrt(n[kept])
    return Model(kept, -(zs - np.sign(zs) * l1) / ((beta + root) / alpha + l2), intercept)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no fit sees: a quarter, by checksum of the id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, text, label)`` of labelled rows that are not held out, at most about ``most``.

    A document with several labels counts as toxic if one says so; null labels say nothing. All rows are used while there
    are no more than ``most``; beyond that, the share that ``most`` is of them, by a hash of the id.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = stored(known.groupBy("doc_id").agg(F.max("toxic").alias("label")), "labels")
    rate = min(1.0, most / max(1, known.count()))
    spread = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 20))
    chosen = known.where(spread < int(rate * (1 << 20)))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, int]]:
    """Part, buckets and label of each row. Texts go as soon as their buckets are known."""
    for batch in batches:
        for some in slices(batch):
            yield from zip(some["part"].to_pylist(), map(features, texts(some)), some["label"].to_pylist())


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), orders: int = ORDERS) -> Model:
    """Fit on a bounded sample, once for each of ``orders`` orders of it, and average the weights by bucket.

    The ids sent to all tasks are those of the sample, and what comes back is at most ``BUCKETS`` weights. Orders are
    those of hashes, so reruns agree. Without a labelled row, no text is toxic.
    """
    rows = sample(docs, labels).select("doc_id", "text", "label", F.explode(F.sequence(F.lit(1), F.lit(orders))).alias("part"))
    rows = rows.select("part", F.xxhash64("part", "doc_id", "text").alias("order"), "text", F.col("label").cast("int").alias("label"))
    rows = rows.repartition("part").sortWithinPartitions("part", "order")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in groupby(_labelled(batches), itemgetter(0)):
            model = fit([row[1:] for row in part], settings)
            columns = np.append(model.buckets, -1), np.append(model.weights, model.intercept)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1])], ["bucket", "weight"])

    found = rows.mapInArrow(one, "bucket long, weight double")
    found = found.groupBy("bucket").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).toPandas()
    ends = found[found["bucket"] == -1]
    if ends.empty:
        return Model(np.zeros(0, np.int64), np.zeros(0), -35.0)
    total = float(ends["n"].iloc[0])
    found = found[found["bucket"] >= 0].sort_values("bucket")
    weights = found["weight"].to_numpy() / total
    return Model(found["bucket"].to_numpy(), weights, float(ends["weight"].iloc[0]) / total)


def scorer(docs: DataFrame, model: Model):
    """A function from texts to scores, with the model sent once to each executor."""
    table = np.zeros(BUCKETS, np.float32)
    table[model.buckets] = model.weights
    sent = docs.sparkSession.sparkContext.broadcast(table)
    intercept = model.intercept

    def scores(found: list[bytes]) -> list[float]:
        weights = sent.value
        return [float(logistic(intercept + float(weights[features(t)].sum(dtype=np.float64)))) for t in found]

    return scores


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``score`` (0 to 1) and ``predicted`` (1 from 0.3) of every whole text, beside the ``keep`` columns.

    Only the text counts. A null or empty text gets the intercept's score. Nothing is shuffled.
    """
    scores = scorer(docs, model)

    def measure(found: list[bytes]):
        values = scores(found)
        return values, [int(v >= THRESHOLD) for v in values]

    return per_text(docs, measure, "score double, predicted int", list(keep))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below 0.3, with all their columns."""
    scores = scorer(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                yield some.filter(pa.array([v < THRESHOLD for v in scores(texts(some))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
