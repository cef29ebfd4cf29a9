"""Toxicity scores by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic texts are the positives; texts drawn without regard to labels are unlabelled.  A
linear model over the presence of hashed words and word beginnings minimises the class-prior-
corrected risk  pi R_p(+) + max(0, R_u(-) - pi R_p(-))  in numpy.  The fitting sample is bounded
(`POSITIVES`, `UNLABELLED` rows, the first by a hash of their ids); scoring covers whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.language import held_out_is
from tidemark.llm.shared import bounded_batches, cut, spare_name
from tidemark.llm.text import ALNUM_WORDS, Words, as_bytes, chunks

#: Rows of the bounded fitting sample.
POSITIVES, UNLABELLED = 6000, 12000
#: Features that the model keeps of the 2**20 hashed ones: at least `LIFT` times as frequent among positives
#: as among unlabelled texts, and by `SIGMAS` standard deviations more frequent than chance allows.
FEATURES, LIFT, SIGMAS = 2000, 3.0, 4.0
#: A text is called toxic from this score on.
CUT = 0.3
_BITS = 20
#: Word beginnings of so many bytes are features beside whole words.
_BEGINNINGS = (4, 5, 6)
_SALTS = np.array([0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1], dtype=np.uint64)


def present(column: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks (low, high, row, feature) of the distinct hashed features of each row, rows counted from low.
    `wanted` (2**20 booleans) keeps only some features."""
    data, offsets = as_bytes(column)
    for low, high in chunks(offsets):
        words = Words(data, offsets, low, high, ALNUM_WORDS)
        row = np.repeat(np.arange(high - low, dtype=np.int64), np.diff(words.first))
        length = words.end - words.begin
        keys = []
        for k, salt in zip((None, *_BEGINNINGS), _SALTS, strict=True):
            longer = slice(None) if k is None else length > k
            feature = ((words.hashes(k)[longer] ^ salt) >> np.uint64(64 - _BITS)).astype(np.int64)
            of = row[longer]
            if wanted is not None:
                chosen = wanted[feature]
                feature, of = feature[chosen], of[chosen]
            keys.append((of << _BITS) | feature)
        unique = np.unique(np.concatenate(keys))
        yield low, high, unique >> _BITS, unique & ((1 << _BITS) - 1)


def _count(rows: DataFrame) -> DataFrame:
    """(feature, positives, unlabelled) that have the feature, of rows (positive, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << _BITS), np.int64)
        for batch in batches:
            kind = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            for low, _, row, feature in present(batch.column(1)):
                for k in (0, 1):
                    total[k] += np.bincount(feature[kind[low + row] == k], minlength=1 << _BITS)
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[1][some]), pa.array(total[0][some])], ["feature", "positives", "unlabelled"])

    return rows.mapInArrow(run, "feature long, positives long, unlabelled long").groupBy("feature").agg(F.sum("positives").alias("positives"), F.sum("unlabelled").alias("unlabelled"))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, sparsity: float = 1e-3, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias of the smallest non-negative PU risk with the logistic loss and an L1 penalty.
    The last column of both matrices is 1 and gets the bias.

    Accelerated proximal gradient descent with restarts.  Where the corrected risk of the negatives
    falls below zero, the step goes up that term alone, as the non-negative estimator asks.
    """
    p, u = positive, unlabelled
    loss = lambda z: np.logaddexp(0, -z)
    slope = lambda z: -1 / (1 + np.exp(np.clip(z, -60, 60)))
    direction, top = np.ones(p.shape[1], np.float32), 1.0
    for _ in range(15):  # the largest curvature
        direction = prior * (p.T @ (p @ direction)) / len(p) + (u.T @ (u @ direction)) / len(u)
        top = float(np.linalg.norm(direction))
        direction /= top
    rate, momentum = 4 / top, 1.0
    weights = np.zeros(p.shape[1])
    weights[-1] = np.log(prior / (1 - prior))
    ahead = weights.copy()
    for _ in range(steps):
        zp, zu = p @ ahead.astype(np.float32), u @ ahead.astype(np.float32)
        rest = loss(-zu).mean() - prior * loss(-zp).mean()
        negatives = (-slope(-zu) / len(u)) @ u - prior * ((-slope(-zp) / len(p)) @ p)
        gradient = prior * ((slope(zp) / len(p)) @ p) + (negatives if rest >= 0 else -negatives)
        after = ahead - rate * gradient
        after[:-1] = np.sign(after[:-1]) * np.maximum(np.abs(after[:-1]) - rate * sparsity, 0)
        if (ahead - after) @ (after - weights) > 0:
            momentum = 1.0
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = after + (momentum - 1) / following * (after - weights)
        weights, momentum = after, following
    return weights[:-1], float(weights[-1])


class Model:
    """A weight for each kept feature and a bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.table = np.zeros(1 << _BITS, np.float64)
        self.table[features] = weights
        self.wanted = self.table != 0
        self.bias = bias

    def scores(self, column: pa.Array) -> np.ndarray:
        """Between 0 and 1 for each row; a null or empty text gets the bias alone."""
        z = np.full(len(column), self.bias)
        for low, high, row, feature in present(column, self.wanted):
            z[low:high] += np.bincount(row, self.table[feature], minlength=high - low)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def learn(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Model:
    """A model from the rows whose crc32(doc_id) mod 4 isn't 2.

    `labels` (doc_id, toxic) mark the positives; a document is positive if any of its labels is 1.
    The prior is the share of 1 among the labelled rows unless given.  Without any positive every text scores 0.
    """
    bounded_batches(docs.sparkSession)
    learning = ~held_out_is(F.col("doc_id"), 4, 2)
    marked = labels.where(learning & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = marked.agg(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0))).first()[0]
    prior = min(0.5, max(1e-4, known or 0.0)) if prior is None else prior
    draw = F.xxhash64("doc_id")
    chosen = marked.where("toxic = 1").orderBy(draw, "doc_id").limit(POSITIVES).select("doc_id", F.lit(1).alias("positive"))
    others = docs.where(learning & F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(UNLABELLED).select("doc_id", F.lit(0).alias("positive"))
    # At most POSITIVES + UNLABELLED ids, so they may be broadcast.
    # Equal texts count once: copies would make chance words look telling.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.unionByName(others)), "doc_id").select("positive", "text").dropDuplicates()
    rows = cut(rows, "toxicity-sample")
    n = {r[0]: r[1] for r in rows.groupBy("positive").count().collect()}
    if not n.get(1) or not n.get(0):
        return Model(np.zeros(0, np.int64), np.zeros(0), -50.0)
    share, usual = (F.col("positives") + 0.5) / (n[1] + 1), (F.col("unlabelled") + 0.5) / (n[0] + 1)
    chance = usual * n[1]
    ranked = _count(rows).where((F.col("positives") >= 3) & (share > LIFT * usual) & (F.col("positives") - chance > SIGMAS * F.sqrt(chance))).orderBy(F.desc(share * F.log(share / usual)), "feature").limit(FEATURES)
    features = np.array(sorted(r[0] for r in ranked.select("feature").collect()), dtype=np.int64)
    if not len(features):
        return Model(features, np.zeros(0), -50.0)
    wanted = np.zeros(1 << _BITS, bool)
    wanted[features] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.zeros(0, np.int64)] * batch.num_rows
            for low, high, row, feature in present(batch.column(1), wanted):
                for i, own in enumerate(np.split(feature, np.searchsorted(row, np.arange(1, high - low)))):
                    lists[low + i] = own
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], ["positive", "features"])

    # The bounded sample, as lists of kept features.
    sample = sorted((r[0], r[1]) for r in rows.mapInArrow(run, "positive int, features array<long>").collect())
    sides = []
    for kind in (1, 0):
        rows = [own for positive, own in sample if positive == kind]
        side = np.zeros((len(rows), len(features) + 1), np.float32)
        side[:, -1] = 1
        for i, own in enumerate(rows):
            side[i, np.searchsorted(features, own)] = 1
        sides.append(side)
    return Model(features, *fit_nnpu(*sides, prior))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and the score of every row; rows may repeat, null and empty texts get the score of no feature.  An empty
    table gives an empty result."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(shared.value.scores(batch.column(len(keep))))], [*keep, "score"])

    return docs.select(*keep, F.col("text").cast("string").alias(spare_name(docs, "whole_text"))).mapInArrow(run, ", ".join([*kinds, "score double"]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.withColumn("held_out", held_out_is(F.col("doc_id"), 4, 2)), model, ("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored toxic go; all columns of the others stay."""
    model = learn(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(at)) < CUT))

    return docs.mapInArrow(run, docs.schema)
