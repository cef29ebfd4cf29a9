"""Mixing documents to target domain weights by soft membership.

A classifier fitted on a labelled table gives every document a probability for each domain (a
language and quality class).  Nonnegative rates per document (expected copies) are fitted so that the
expected tokens of each domain meet the targets: least squares over the domains, solved by projected
gradient steps.  A step needs only one vector with an entry per domain, so each is one distributed
sum; a document's rate follows from its probabilities and the vectors of all steps so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches, cut, spare_name
from tidemark.llm.text import LOWER, SPACE_WORDS, Words, as_bytes, chunks, mix

#: Rows of the bounded labelled sample that the classifier is fitted on, and its hashed features.
LABELLED, FEATURES = 8000, 1024
#: Rows whose features are held at a time, and bytes of text in an output batch, at most about.
ROWS, BATCH_BYTES = 512, 8 << 20
#: Target weights are the domains' own shares to this power: under 1, rare domains are raised.
SMOOTHING = 0.7
#: Steps at most, and the largest relative distance from a target at which they end.
STEPS, NEAR = 60, 1e-6


def features_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks (low, high, x, tokens) of rows: unit vectors of log counts of hashed word beginnings and endings, and numbers of
    words.  A chunk has at most `ROWS` rows, so that features never exist for a whole batch."""
    data, offsets = as_bytes(column)
    for first, last in chunks(offsets):
        for low in range(first, last, ROWS):
            high = min(last, low + ROWS)
            words = Words(data, offsets, low, high, SPACE_WORDS)
            counts = np.diff(words.first)
            raw = data[words.base : int(offsets[high])]
            start, end = words.begin, words.end - 1
            at = lambda i: LOWER[raw[i]].astype(np.uint64)  # noqa: B023, E731
            head = (at(start) << np.uint64(16)) | (at(np.minimum(start + 1, end)) << np.uint64(8)) | at(np.minimum(start + 2, end))
            tail = (at(np.maximum(end - 2, start)) << np.uint64(16)) | (at(np.maximum(end - 1, start)) << np.uint64(8)) | at(end) | np.uint64(1 << 24)
            row = np.repeat(np.arange(high - low), counts)
            x = np.zeros((high - low) * FEATURES, np.float32)
            for key in (head, tail):
                x += np.bincount(row * FEATURES + (mix(key) >> np.uint64(54)).astype(np.int64) % FEATURES, minlength=len(x))
            x = np.log1p(x, out=x).reshape(-1, FEATURES)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            yield low, high, x, counts


class Classifier:
    """Softmax regression over the hashed features."""

    def __init__(self, domains: list[str], weights: np.ndarray):
        self.domains, self.weights = domains, weights

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str], steps: int = 300, rate: float = 4.0, decay: float = 1e-5) -> Classifier:
        domains = sorted(set(labels))
        y = np.zeros((len(labels), len(domains)), np.float32)
        y[np.arange(len(labels)), [domains.index(v) for v in labels]] = 1
        weights = np.zeros((x.shape[1] + 1, len(domains)), np.float32)
        speed = np.zeros_like(weights)
        for _ in range(steps):
            wrong = (_softmax(x @ weights[:-1] + weights[-1]) - y) / len(x)
            gradient = np.vstack([x.T @ wrong, wrong.sum(axis=0)]) + decay * weights
            speed = 0.9 * speed - rate * 0.1 * gradient
            weights += speed
        return cls(domains, weights)

    def posteriors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each domain, number of words) of each row."""
        p, tokens = np.zeros((len(column), len(self.domains))), np.zeros(len(column), np.int64)
        for low, high, x, counts in features_of(column):
            p[low:high] = _softmax(x @ self.weights[:-1] + self.weights[-1])
            tokens[low:high] = counts
        return p, tokens


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True)) if z.shape[1] else z
    return e / e.sum(axis=1, keepdims=True) if z.shape[1] else e


def fit_classifier(docs: DataFrame, labels: DataFrame) -> Classifier:
    """From documents (doc_id, text, lang) with a label (doc_id, quality): the domain is `lang:q<quality>`; null parts are
    `und` and `q0`.  One domain, `all`, if there is no labelled row."""
    bounded_batches(docs.sparkSession)
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # At most LABELLED ids.
    chosen = docs.select("doc_id").join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED).distinct()
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")
    domain = F.concat(F.coalesce("lang", F.lit("und")), F.lit(":q"), F.coalesce(F.col("quality").cast("string"), F.lit("0")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, x, _ in features_of(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())], ["domain", "x"])

    sample = rows.select(domain.alias("domain"), "text").mapInArrow(run, "domain string, x binary").toPandas()
    if not len(sample):
        return Classifier(["all"], np.zeros((FEATURES + 1, 1), np.float32))
    x = np.frombuffer(b"".join(sample["x"]), np.float16).reshape(-1, FEATURES).astype(np.float32)
    return Classifier.fit(x, sample["domain"].tolist())


def membership(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, n_tokens, posterior array) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, tokens = shared.value.posteriors(batch.column(1))
            edges = np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens), pa.ListArray.from_arrays(pa.array(edges), pa.array(p.ravel()))], ["doc_id", "n_tokens", "posterior"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, posterior array<double>")


def rates_of(posterior: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the given steps, from 1; never below 0."""
    rate = np.ones(len(posterior))
    for step in steps:
        rate = np.maximum(0.0, rate - posterior @ step)
    return rate


def _sums(members: DataFrame, steps: list[np.ndarray], d: int, squares: bool) -> np.ndarray:
    """Expected tokens of each domain under the rates; with `squares`, also sum of tokens * p p^T."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + d * d * squares)
        for batch in batches:
            p = batch.column(1).flatten().to_numpy().reshape(-1, d)
            weighted = p * batch.column(0).to_numpy()[:, None]
            total[:d] += rates_of(p, steps) @ weighted
            if squares:
                total[d:] += (weighted.T @ p).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "x"])

    rows = members.select("n_tokens", "posterior").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(d + d * d * squares)
    out[rows["i"].to_numpy(np.int64)] = rows["x"].to_numpy(np.float64)
    return out


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float] | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(steps, target tokens, expected tokens).

    `targets` are weights by domain (missing ones 0) of the total tokens; by default the domains' own shares to the power
    `SMOOTHING`.  A weight of an unknown domain, a negative one and weights that sum to 0 are errors.  Least squares in the
    metric of the inverse token matrix, in which a step of length one is safe.
    """
    if targets is not None and (set(targets) - set(domains) or min(targets.values(), default=0) < 0 or sum(targets.values()) <= 0):
        raise ValueError(f"targets must be weights of {domains}, none negative and not all 0")
    d = len(domains)
    sums = _sums(members, [], d, True)
    expected, matrix = sums[:d], sums[d:].reshape(d, d)
    total = expected.sum()
    if total <= 0:
        return [], expected, expected
    weights = np.array([targets.get(x, 0.0) for x in domains]) if targets is not None else (expected / total) ** SMOOTHING
    goal = total * weights / weights.sum()
    inverse = np.linalg.pinv(matrix + 1e-9 * np.trace(matrix) / d * np.eye(d))
    steps: list[np.ndarray] = []
    for _ in range(STEPS):
        if np.abs(expected - goal).max() <= NEAR * total:
            break
        steps.append(inverse @ (expected - goal))
        before, expected = expected, _sums(members, steps, d, False)
        if np.abs(expected - before).max() <= 1e-3 * NEAR * total:
            break
    return steps, goal, expected


def copies_of(rate: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Whole copies with the rate as mean: the floor of rate plus a draw from [0, 1) that depends on the id only."""
    return np.floor(rate + (mix(draw.astype(np.int64).view(np.uint64)) >> np.uint64(11)).astype(np.float64) / (1 << 53)).astype(np.int64)


def rated(members: DataFrame, domains: list[str], steps: list[np.ndarray], goal: np.ndarray, expected: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, the likeliest domain and its posterior, rate and copies of every row, with the tokens that the
    domain should have and is expected to have over all rows."""
    d, names = len(domains), np.array(domains, dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = np.stack(batch["posterior"].to_numpy()).reshape(-1, d) if len(batch) else np.zeros((0, d))
            rate, best = rates_of(p, steps), p.argmax(axis=1)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "n_tokens": batch["n_tokens"], "domain": names[best], "posterior": p.max(axis=1, initial=0), "rate": rate,
                "copies": copies_of(rate, batch["draw"].to_numpy()), "target_tokens": goal[best], "expected_tokens": expected[best],
            })

    kind = members.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, n_tokens long, domain string, posterior double, rate double, copies long, target_tokens double, expected_tokens double"
    return members.withColumn("draw", F.xxhash64("doc_id")).mapInPandas(run, columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's likeliest domain, rate and copies, with the target and the expected tokens of that domain.

    A null or empty text has no tokens and the classifier's prior; rows may repeat; an empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    classifier = fit_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    members = cut(membership(docs, classifier), "membership")
    return rated(members, classifier.domains, *fit_rates(members, classifier.domains))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each row as many times as its rate says; the part of a rate beyond whole copies is a draw by id.
    A text without words, which changes no total, is kept once.  All columns stay as they are."""
    classifier = fit_classifier(docs.select("doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    members = cut(membership(docs, classifier), "membership")
    steps, _, _ = fit_rates(members, classifier.domains)
    shared = spark.sparkContext.broadcast((classifier, steps))
    columns, at = list(range(len(docs.columns))), docs.columns.index("text")

    # Posteriors are computed again: ids may be null or repeated, and a join would shuffle all texts.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, taken = shared.value
        for batch in batches:
            p, tokens = model.posteriors(batch.column(at))
            copies = np.where(tokens > 0, copies_of(rates_of(p, taken), batch.column(len(columns)).to_numpy()), 1)
            repeated = np.repeat(np.arange(batch.num_rows), copies)
            size = np.cumsum(np.diff(as_bytes(batch.column(at))[1])[repeated] + 1)
            edges = np.searchsorted(size, np.arange(1, int(size[-1] if len(size) else 0) // BATCH_BYTES + 1) * BATCH_BYTES)
            rows = batch.select(columns)
            for part in np.split(repeated, np.unique(edges)):
                yield rows.take(pa.array(part))

    return docs.withColumn(spare_name(docs, "draw"), F.xxhash64("doc_id")).mapInArrow(run, docs.schema)
