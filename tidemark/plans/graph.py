"""Queries of graphs, propagation and small models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.canon import table_hash
from tidemark.operators import experiment, graph
from tidemark.plans.bindings import query, table
from tidemark.sources.shared import cut

_ED = "ed AS (SELECT l_orderkey * 8 + l_linenumber AS ordinal, l_suppkey AS src, l_partkey % 100 AS dst, l_quantity AS weight, CASE WHEN (l_suppkey + l_partkey) % 2 = 0 THEN 1 ELSE -1 END AS sign, l_partkey AS part, l_shipdate AS at FROM lineitem)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordinal"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst"), F.col("l_quantity").alias("weight"), F.when((F.col("l_suppkey") + F.col("l_partkey")) % 2 == 0, 1).otherwise(-1).alias("sign"), F.col("l_partkey").alias("part"))


@query("scan_edges", f"{_ED} SELECT ordinal, src, dst, round(ln(1 + weight) / ln(10001), 6) AS scaled, sign FROM ed WHERE weight > 0 AND src IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND dst IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def scan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    return graph.scan_edges(edges(spark, sf_dir), allowed=allowed).select("ordinal", "src", "dst", F.round("scaled", 6).alias("scaled"), "sign")


@query("bounded_scan", f"{_ED} SELECT ordinal, src, dst, part FROM ed ORDER BY ordinal, src, dst, part LIMIT 5000")
def bounded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.scan_edges(edges(spark, sf_dir), order=["ordinal", "src", "dst", "part"], most=5000).select("ordinal", "src", "dst", "part")


@query("graph_build", f"{_ED} SELECT (SELECT count(*) FROM (SELECT src FROM ed UNION SELECT dst FROM ed)) AS nodes, count(*) AS edges, count(*) FILTER (sign > 0) AS positive, count(*) FILTER (sign < 0) AS negative, round(avg(weight), 6) AS mean_weight FROM ed")
def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.statistics(edges(spark, sf_dir)).withColumn("mean_weight", F.round("mean_weight", 6))


@query("graph_hash", f"{_ED}, h AS (SELECT src, sha256(concat_ws('|', CAST(src AS VARCHAR), CAST(dst AS VARCHAR), CAST(CAST(weight AS BIGINT) AS VARCHAR), CAST(sign AS VARCHAR))) AS x FROM ed), b AS (SELECT src, x[1:2] AS b, count(*) AS n, sha256(string_agg(x, ',' ORDER BY x)) AS p FROM h GROUP BY 1, 2) SELECT src, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(p, ',' ORDER BY b)) AS content_hash FROM b GROUP BY 1")
def graph_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_hash(edges(spark, sf_dir).withColumn("weight", F.col("weight").cast("long")), ["src", "dst", "weight", "sign"], ["src"])


def _unique_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel edges as one, with an ordinal from both ends."""
    e = edges(spark, sf_dir).groupBy("src", "dst").agg((F.sum("weight") / 5000).alias("weight"), F.when(F.sum("sign") >= 0, 1).otherwise(-1).alias("sign"))
    return e.withColumn("ordinal", F.col("src") * 1_000_000 + F.col("dst"))


@query("graph_controls")
def graph_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _unique_edges(spark, sf_dir)
    shuffled = graph.shuffled_targets(e, 11).select(F.lit("shuffled").alias("control"), "ordinal", "src", "dst", F.round("weight", 6).alias("weight"), "sign")
    weighted = graph.random_weights(e, 12).select(F.lit("random_weights").alias("control"), "ordinal", "src", "dst", F.round("weight", 6).alias("weight"), "sign")
    return shuffled.unionByName(weighted)


_UE = f"{_ED}, ue AS (SELECT src, dst, sum(weight) / 5000 AS weight, CASE WHEN sum(sign) >= 0 THEN 1 ELSE -1 END AS sign FROM ed GROUP BY 1, 2), n0 AS (SELECT node, 1.0 / (node + 2) AS value FROM (SELECT src AS node FROM ue UNION SELECT dst FROM ue))"


def _step(old: str, new: str, by: str = "") -> str:
    on = "AND i.ep = o.ep" if by else ""
    return f"{new} AS (SELECT {by}o.node, 0.3 * o.value + 0.7 * tanh(coalesce(x, 0)) AS value FROM {old} o LEFT JOIN (SELECT {by.replace('o.', 's.')}dst, sum(value * weight * sign) AS x FROM ue JOIN {old} s ON src = node GROUP BY ALL) i ON i.dst = o.node {on})"


@query("graph_propagate", f"{_UE}, {_step('n0', 'n1')}, {_step('n1', 'n2')}, {_step('n2', 'n3')} SELECT node, round(value, 6) AS value FROM n3")
def graph_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _unique_edges(spark, sf_dir)
    start = graph.nodes(e).select("node", (1.0 / (F.col("node") + 2)).alias("value"))
    return graph.propagate(e, start, 3, 0.3).select("node", F.round("value", 6).alias("value"))


@query("episode_states", f"{_UE}, e0 AS (SELECT ep, node, value * (ep + 1) AS value FROM n0, (VALUES (0), (1), (2)) t(ep)), {_step('e0', 'e1', 'o.ep, ')}, {_step('e1', 'e2', 'o.ep, ')} SELECT ep AS episode, node, round(value, 6) AS value FROM e2")
def episode_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _unique_edges(spark, sf_dir)
    start = graph.nodes(e).select(F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("episode"), "node").withColumn("value", (F.col("episode") + 1) / (F.col("node") + 2))
    return graph.propagate(e, start, 2, 0.3, ["episode"]).select("episode", "node", F.round("value", 6).alias("value"))


#: Dimensions of the supplied embeddings.
DIMS = 64


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").cast("double").alias("y"))


@query("ridge_fit")
def ridge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a ridge fit over all dimensions on the rows whose id isn't divisible by 5."""
    s = samples(spark, sf_dir)
    weights, intercept = graph.ridge_fit(s.where("vec_id % 5 <> 0"), F.col("x"), "y", 1.0, DIMS)
    return graph.linear_score(s, F.col("x"), list(weights), intercept).select("vec_id", F.round("score", 6).alias("score"))


@query("linear_score", f"SELECT vec_id, round(0.5 + list_sum(list_transform(range(1, {DIMS} + 1), lambda i: CAST(embedding[i] AS DOUBLE) * ((i * 37 % 11 - 5) / 8.0))), 6) AS score FROM embeddings")
def linear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = [((i + 1) * 37 % 11 - 5) / 8 for i in range(DIMS)]
    return graph.linear_score(samples(spark, sf_dir), F.col("x"), weights, 0.5).select("vec_id", F.round("score", 6).alias("score"))


@query("recurrent_readout", "RECURSIVE cn AS (SELECT conv_id, length(text) / 100 AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), fo(conv_id, i, s) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM cn UNION ALL SELECT cn.conv_id, cn.i, s * 0.8 + x FROM fo JOIN cn ON cn.conv_id = fo.conv_id AND cn.i = fo.i + 1), st AS (SELECT conv_id, max(i) AS steps, arg_max(s, i) AS state FROM fo GROUP BY 1), k AS (SELECT sum(state * steps) / sum(state * state) AS slope FROM st) SELECT conv_id, steps, round(state, 6) AS state, round(state * slope, 6) AS readout FROM st, k")
def recurrent_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") / 100).alias("x"))
    st = graph.recurrent_state(c, "conv_id", "turn", "x", 0.8)
    slope = st.agg((F.sum(F.col("state") * F.col("steps")) / F.sum(F.col("state") * F.col("state"))).alias("slope"))
    return st.crossJoin(F.broadcast(slope)).select("conv_id", "steps", F.round("state", 6).alias("state"), F.round(F.col("state") * F.col("slope"), 6).alias("readout"))


@query("matched_experiment")
def matched_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out error of five models: dimension i of a vector drives node i, and four vectors in a row are an episode."""
    s = samples(spark, sf_dir)
    e = cut(_unique_edges(spark, sf_dir), "edges")
    i = F.col("vec_id")
    rows = s.select(i.alias("sample_id"), F.expr("vec_id div 4").alias("episode_id"), i.alias("observed_us"), F.col("y").alias("target"), F.when(i % 5 == 0, "test").otherwise("train").alias("partition"))
    inputs = s.select(i.alias("sample_id"), F.posexplode("x").alias("node", "input")).withColumn("node", F.col("node").cast("long"))
    metrics, _ = experiment.run_experiment(e, rows, inputs)
    return metrics.select("model", "status", "train_count", "heldout_count", F.round("mae", 6).alias("mae"))
