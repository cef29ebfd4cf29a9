"""Metrics, bootstrap, scores, reviews and gates over evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.integers import floor_div


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """The names of the rules that hold, in order, joined by commas; empty if none does."""
    return F.concat_ws(",", *[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules])


def episode_metrics(episodes: DataFrame, by: list[str], min_blocks: int = 4) -> DataFrame:
    """Counts, blocks, floored means, failure rate, exposure, the worst and the inference state of (block_id, net_bps,
    benchmark_bps, failed, turnover_bps, exposure_bps)."""
    n = F.count("*")
    mean = lambda c: floor_div(F.sum(c), n)
    out = episodes.groupBy(*by).agg(
        n.alias("episodes"), F.count_distinct("block_id").alias("blocks"), mean(F.col("net_bps")).alias("mean_net_bps"), mean(F.col("net_bps") - F.col("benchmark_bps")).alias("mean_excess_bps"),
        floor_div(F.count_if("failed") * 10_000, n).alias("failure_bps"), mean(F.col("turnover_bps")).alias("turnover_bps"), mean(F.col("exposure_bps")).alias("exposure_bps"), F.min("net_bps").alias("worst_bps"),
    )
    return out.withColumn("inference", F.when(F.col("blocks") < min_blocks, "insufficient_blocks").otherwise("missing_equity_curve"))


def block_bootstrap(episodes: DataFrame, by: list[str], replicates: int = 200, seed: int = 0) -> DataFrame:
    """(by, blocks, low_bps, high_bps): 2.5 and 97.5 % order statistics of the mean excess over resampled blocks.

    Blocks are first reduced to (sum, count); a replicate draws as many blocks as there are, each by a
    hash of (seed, replicate, draw), so the work is replicates times blocks and repeats exactly.
    """
    own = Window.partitionBy(*by)
    blocks = episodes.groupBy(*by, "block_id").agg(F.sum(F.col("net_bps") - F.col("benchmark_bps")).alias("s"), F.count("*").alias("c"))
    blocks = blocks.withColumn("place", F.row_number().over(own.orderBy("block_id")) - 1).withColumn("n", F.count("*").over(own))
    draws = blocks.select(*by, "n", F.col("place").alias("draw")).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draws = draws.withColumn("place", F.pmod(F.xxhash64(F.lit(seed), "replicate", "draw"), F.col("n")).cast("int"))
    means = draws.join(blocks.select(*by, "place", "s", "c"), [*by, "place"]).groupBy(*by, "replicate").agg(floor_div(F.sum("s"), F.sum("c")).alias("m"), F.max("n").alias("n"))
    ranked = means.withColumn("r", F.row_number().over(own.orderBy("m", "replicate")) - 1)
    low, high = max(0, int(replicates * 0.025) - 1), min(replicates - 1, int(replicates * 0.975))
    return ranked.groupBy(*by).agg(F.max("n").alias("blocks"), F.max(F.when(F.col("r") == low, F.col("m"))).alias("low_bps"), F.max(F.when(F.col("r") == high, F.col("m"))).alias("high_bps"))


def window_scores(points: DataFrame) -> DataFrame:
    """Mean absolute error and count per (model, market, window, split)."""
    return points.groupBy("model", "market", "window", "split").agg(F.avg(F.abs(F.col("predicted") - F.col("target"))).alias("mae"), F.count("*").alias("points"))


def paired_windows(scores: DataFrame, candidate: object, active: object) -> DataFrame:
    """Full outer pairs of the two models' scores on (market, window), and whether the candidate is strictly better."""
    side = lambda m, p: scores.where(F.col("model") == F.lit(m)).select("market", "window", F.col("mae").alias(f"mae_{p}"), F.col("points").alias(f"points_{p}"))
    joined = side(candidate, "candidate").join(side(active, "active"), ["market", "window"], "full")
    return joined.withColumn("better", F.coalesce(F.col("mae_candidate") < F.col("mae_active"), F.lit(False)))


def candidate_evaluation(pairs: DataFrame, min_windows: int, min_points: int) -> DataFrame:
    """One row: windows, better windows, points, reasons and qualified or inconclusive."""
    out = pairs.agg(
        F.count("*").alias("windows"), F.count_if("better").alias("better_windows"), F.coalesce(F.sum("points_candidate"), F.lit(0)).alias("points"),
        F.count_if(F.col("mae_candidate").isNull() | F.col("mae_active").isNull()).alias("unpaired"), F.coalesce(F.min("points_candidate"), F.lit(0)).alias("fewest"),
    )
    why = reasons([("no_evidence", F.col("windows") == 0), ("missing_side", F.col("unpaired") > 0), ("too_few_windows", F.col("windows") < min_windows), ("too_few_points", F.col("fewest") < min_points), ("not_better_everywhere", F.col("better_windows") < F.col("windows"))])
    return out.select("windows", "better_windows", "points", "unpaired", why.alias("reasons"), F.when(F.length(why) == 0, "qualified").otherwise("inconclusive").alias("state"))


def grid_equal(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, only_a, only_b, equal): whether both sides hold the same multiset of rows in each group."""
    columns = a.columns
    counted = a.withColumn("__d", F.lit(1)).unionByName(b.select(*columns).withColumn("__d", F.lit(-1))).groupBy(*columns).agg(F.sum("__d").alias("__d"))
    out = counted.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("__d") > 0, F.col("__d"))), F.lit(0)).alias("only_a"), F.coalesce(F.sum(F.when(F.col("__d") < 0, -F.col("__d"))), F.lit(0)).alias("only_b"))
    return out.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def grid_complete(cells: DataFrame, axes: list[str], by: list[str], per_group: int) -> DataFrame:
    """(by, cells, repeated, complete) of a factorial grid: every combination of the axes exactly once per group."""
    counted = cells.groupBy(*by, *axes).count()
    out = counted.groupBy(*by).agg(F.count("*").alias("cells"), F.count_if(F.col("count") > 1).alias("repeated"))
    return out.withColumn("complete", (F.col("cells") == per_group) & (F.col("repeated") == 0))
