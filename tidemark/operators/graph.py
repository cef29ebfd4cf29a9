"""Sparse graphs as edge tables: build, controls, propagation and readouts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.windows import global_row_number
from tidemark.sources.shared import cut, small_or_shuffled


def scan_edges(edges: DataFrame, low: int | None = None, high: int | None = None, allowed: DataFrame | None = None, order: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(ordinal, src, dst, weight, scaled) with positive weights and scaled = log1p(w) / log1p(10000).

    `low` and `high` bound the ordinal, `allowed` (id) the nodes at both ends, `most` the number of edges in `order`.
    """
    out = edges.where(F.col("weight") > 0)
    if low is not None:
        out = out.where(F.col("ordinal").between(low, high))
    if allowed is not None:
        ids = allowed.select("id").distinct()
        out = out.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")
    if most is not None:
        out = out.orderBy(*order).limit(most)
    return out.withColumn("scaled", F.log1p("weight") / F.log1p(F.lit(10000.0)))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def statistics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, positive and negative edges, mean weight."""
    n = nodes(edges).agg(F.count("*").alias("nodes"))
    e = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("sign") > 0).alias("positive"), F.count_if(F.col("sign") < 0).alias("negative"), F.avg("weight").alias("mean_weight"))
    return n.crossJoin(F.broadcast(e))


def shuffled_targets(edges: DataFrame, seed: int, sources: DataFrame | None = None) -> DataFrame:
    """Edges with their targets dealt anew: every source keeps its out-degree, every target its in-degree.

    Two seeded orders of the edges are ranked and the targets of one joined to the other by rank.  All are dealt; with
    `sources` (node) only the edges of these are given.
    """
    keyed = edges.withColumn("__a", F.xxhash64(F.lit(seed), "ordinal")).withColumn("__b", F.xxhash64(F.lit(seed + 1), "ordinal"))
    left = global_row_number(keyed.select("ordinal", "src", "weight", "sign", "__a"), ["__a", "ordinal"], "__r").drop("__a")
    if sources is not None:
        left = left.join(small_or_shuffled(sources), F.col("src") == F.col("node"), "left_semi")
    right = global_row_number(keyed.select(F.col("ordinal").alias("__o"), "dst", "__b"), ["__b", "__o"], "__r").select("__r", "dst")
    return left.join(right, "__r").select("ordinal", "src", "dst", "weight", "sign")


def random_weights(edges: DataFrame, seed: int) -> DataFrame:
    """Edges with seeded uniform weights scaled to the same mean."""
    drawn = edges.withColumn("__u", (F.pmod(F.xxhash64(F.lit(seed), "ordinal"), F.lit(1 << 30)) + 1) / float(1 << 30))
    means = drawn.agg(F.avg("weight").alias("__w"), F.avg("__u").alias("__m"))
    return drawn.crossJoin(F.broadcast(means)).withColumn("weight", F.col("__u") * F.col("__w") / F.col("__m")).drop("__u", "__w", "__m")


def propagate(edges: DataFrame, state: DataFrame, steps: int, decay: float, by: list[str] | None = None, drive: DataFrame | None = None) -> DataFrame:
    """`state` (by, node, value) after so many steps of next = decay * old + (1 - decay) * tanh(sum of state * weight * sign + drive).

    All episodes (`by`) advance together: one join and one aggregation a step.  `drive` (by, node, input) is added in every step.
    """
    by = by or []
    for _ in range(steps):
        incoming = edges.join(state, F.col("src") == F.col("node")).groupBy(*by, F.col("dst").alias("node")).agg(F.sum(F.col("value") * F.col("weight") * F.col("sign")).alias("__in"))
        joined = state.join(incoming, [*by, "node"], "left")
        total = F.coalesce("__in", F.lit(0.0))
        if drive is not None:
            joined = joined.join(drive, [*by, "node"], "left")
            total = total + F.coalesce("input", F.lit(0.0))
        state = cut(joined.select(*by, "node", (decay * F.col("value") + (1 - decay) * F.tanh(total)).alias("value")), "propagate")
    return state


def propagate_sparse(edges: DataFrame, steps: int, decay: float, by: list[str], drive: DataFrame) -> DataFrame:
    """What `propagate` gives from states of 0 at all nodes, without the nodes that nothing has reached: these stay at 0."""
    drive = drive.join(nodes(edges), "node", "left_semi")
    given = drive.select(*by, "node", F.lit(0.0).alias("value"), F.coalesce("input", F.lit(0.0)).alias("__in"))
    state = None
    for _ in range(steps):
        parts = given
        if state is not None:
            incoming = edges.join(state, F.col("src") == F.col("node")).select(*by, F.col("dst").alias("node"), F.lit(0.0).alias("value"), (F.col("value") * F.col("weight") * F.col("sign")).alias("__in"))
            parts = parts.unionByName(state.withColumn("__in", F.lit(0.0))).unionByName(incoming)
        summed = parts.groupBy(*by, "node").agg(F.sum("value").alias("value"), F.sum("__in").alias("__in"))
        state = cut(summed.select(*by, "node", (decay * F.col("value") + (1 - decay) * F.tanh("__in")).alias("value")), "propagate")
    return state


def ridge_fit(rows: DataFrame, features: Column, target: str, l2: float, d: int) -> tuple[np.ndarray, float]:
    """(weights, intercept) of centred ridge regression with a free intercept on an array column of d features.

    Each task adds up its part of the Gram matrix, so (d + 2)**2 sums a task are shuffled and one matrix reaches the driver.
    Rows with a null feature array or target are left out.
    """
    x = F.transform(features, lambda v: v.cast("double"))
    n = d + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            if batch.num_rows:
                y = batch.column(1).to_numpy(zero_copy_only=False)
                z = np.column_stack([np.ones(len(y)), batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d), y])
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * n)), pa.array(total.ravel())], ["i", "x"])

    given = rows.select(x.alias("x"), F.col(target).cast("double").alias("y")).where("x is not null and y is not null")
    got = given.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    sums = np.zeros(n * n)
    sums[got["i"].to_numpy(np.int64)] = got["x"].to_numpy(np.float64)
    sums = sums.reshape(n, n)
    count, means = sums[0, 0], sums[0, 1:] / max(sums[0, 0], 1.0)
    if not count:
        return np.zeros(d), 0.0
    centred = sums[1:, 1:] - count * np.outer(means, means)
    weights = np.linalg.solve(centred[:d, :d] + l2 * np.eye(d), centred[:d, d])
    return weights, float(means[d] - means[:d] @ weights)


def linear_score(rows: DataFrame, features: Column, weights: list[float], intercept: float, name: str = "score") -> DataFrame:
    """`rows` with the weighted sum of an array column of features; null where the array is null or has another length."""
    products = F.zip_with(features, F.array(*[F.lit(float(w)) for w in weights]), lambda v, w: v.cast("double") * w)
    return rows.withColumn(name, F.aggregate(products, F.lit(float(intercept)), lambda acc, v: acc + v))


def recurrent_state(rows: DataFrame, episode: str, order: str, value: str, decay: float) -> DataFrame:
    """(episode, steps, state): s <- decay * s + x in order, from 0 in each episode."""
    steps = rows.groupBy(episode).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).cast("double").alias("__x")))).alias("s"))
    return steps.select(episode, F.size("s").cast("long").alias("steps"), F.aggregate("s", F.lit(0.0), lambda acc, x: acc * decay + x["__x"]).alias("state"))
