"""Queries of the feedback loop: predictions, outcomes, proposals, actions, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluation, feedback, market, policies
from tidemark.plans.bindings import DAY, MINUTE, query, raw_events, table, trades
from tidemark.plans.market import _LABELS, _SPLIT, AS_OF, labels, points

CUTOFF = AS_OF - 3 * DAY
_OUT = """oc AS (SELECT point_id * 10 + horizon // 86400000000 AS outcome_id, point_id AS prediction_id, CASE WHEN point_id % 17 = 0 THEN 'other' ELSE 'net' END AS target_id, status, observed_us, available_us, net_return_bps, CASE WHEN point_id % 19 = 0 THEN [-1, point_id] ELSE [-1] END AS source_refs, pool, horizon FROM lab WHERE horizon <> 259200000000)"""
_PRE = "pr AS (SELECT event_id AS prediction_id, 'net' AS target_id, arrival_us AS created_us, arrival_us + 172800000000 AS expires_us, CASE WHEN event_id % 23 = 0 THEN 'expired' ELSE 'active' END AS state, pool, event_id % 2 AS model FROM ev WHERE event_id % 29 <> 3)"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab, i = labels(spark, sf_dir).where("horizon <> 259200000000"), F.col("point_id")
    return lab.select((i * 10 + F.expr("horizon div 86400000000")).alias("outcome_id"), i.alias("prediction_id"), F.when(i % 17 == 0, "other").otherwise("net").alias("target_id"), "status", "observed_us", "available_us", "net_return_bps", F.when(i % 19 == 0, F.array(F.lit(-1).cast("long"), i)).otherwise(F.array(F.lit(-1).cast("long"))).alias("source_refs"), "pool", "horizon")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return raw_events(spark, sf_dir).where("event_id % 29 <> 3").select(i.alias("prediction_id"), F.lit("net").alias("target_id"), F.col("arrival_us").alias("created_us"), (F.col("arrival_us") + 2 * DAY).alias("expires_us"), F.when(i % 23 == 0, "expired").otherwise("active").alias("state"), "pool", (i % 2).alias("model"))


_FB = f"""{_LABELS}, {_OUT}, {_PRE}, fb AS (SELECT oc.*, pr.prediction_id IS NULL OR available_us IS NULL OR available_us > {CUTOFF} AS excluded,
 concat_ws(',', CASE WHEN observed_us < created_us OR available_us < created_us THEN 'outcome_before_prediction' END, CASE WHEN oc.target_id IS DISTINCT FROM pr.target_id THEN 'target_identity_mismatch' END,
  CASE WHEN list_contains(source_refs, oc.prediction_id) THEN 'prediction_self_label_reference' END, CASE WHEN state IN ('invalidated', 'expired') THEN 'prediction_not_active_at_creation' END) AS violations,
 concat_ws(',', CASE WHEN status IN ('unresolved', 'invalidated') THEN 'outcome_unresolved_or_invalidated' END, CASE WHEN net_return_bps IS NULL THEN 'numeric_target_unavailable' END) AS unusable,
 pr.prediction_id IS NULL AS absent FROM oc LEFT JOIN pr ON oc.prediction_id = pr.prediction_id),
fe AS (SELECT *, CASE WHEN absent THEN 'prediction_not_found' WHEN excluded THEN 'label_after_cutoff_or_missing' WHEN violations = '' OR unusable = '' THEN violations || unusable ELSE violations || ',' || unusable END AS reasons,
 NOT excluded AND violations = '' AND status IN ('observed', 'censored') AND net_return_bps IS NOT NULL AS eligible FROM fb)"""


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.feedback_join(outcomes(spark, sf_dir), predictions(spark, sf_dir), CUTOFF)


@query("feedback_join", f"{_FB} SELECT outcome_id, prediction_id, status, excluded, reasons, eligible FROM fe")
def feedback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark, sf_dir).select("outcome_id", "prediction_id", "status", "excluded", "reasons", "eligible")


@query("maturation_queue", f"""{_LABELS}, {_OUT}, {_PRE}, kn AS (SELECT prediction_id, count(*) FILTER (status IN ('observed', 'censored')) AS usable FROM oc WHERE available_us <= {CUTOFF} GROUP BY 1)
SELECT pr.prediction_id, CASE WHEN usable > 0 THEN 'ready' WHEN usable = 0 THEN 'unresolved' WHEN expires_us <= {CUTOFF} THEN 'missing' ELSE 'waiting' END AS state,
 CASE WHEN usable > 0 THEN NULL WHEN usable = 0 THEN 'outcome_unresolved_or_invalidated' WHEN expires_us <= {CUTOFF} THEN 'label_due_without_available_outcome' END AS reason
FROM pr LEFT JOIN kn ON pr.prediction_id = kn.prediction_id""")
def maturation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = predictions(spark, sf_dir).withColumnRenamed("expires_us", "due_us")
    return feedback.maturation_queue(due, outcomes(spark, sf_dir), CUTOFF)


@query("training_join", f"{_FB}, {_SPLIT}, ft AS (SELECT event_id AS prediction_id, price FROM ev WHERE event_id % 31 <> 4), nn AS (SELECT *, count(outcome_id) OVER (PARTITION BY prediction_id) AS n FROM fe WHERE prediction_id % 3 = 0 OR horizon = 86400000000) SELECT nn.outcome_id, nn.prediction_id, price, partition, CASE WHEN NOT eligible THEN 'not_eligible' WHEN n > 1 THEN 'several_outcomes' WHEN ft.prediction_id IS NULL THEN 'features_missing' WHEN partition IS NULL THEN 'partition_missing' END AS reason FROM nn LEFT JOIN ft ON nn.prediction_id = ft.prediction_id LEFT JOIN (SELECT * FROM split WHERE pool % 37 <> 5) sp ON nn.pool = sp.pool")
def training_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = raw_events(spark, sf_dir).where("event_id % 31 <> 4").select(F.col("event_id").alias("prediction_id"), "price")
    split = market.group_chrono_split(points(spark, sf_dir), "pool", ["arrival_us", "event_id"]).where("pool % 37 <> 5").select("pool", "partition")
    examples = joined(spark, sf_dir).where((F.col("prediction_id") % 3 == 0) | (F.col("horizon") == DAY))
    return feedback.training_join(examples, features, split, "pool").select("outcome_id", "prediction_id", "price", "partition", "reason")


_PROP = "ps AS (SELECT event_id AS proposal_id, event_id + 1 AS prediction_id, arrival_us + 86400000000 AS expires_us, CASE WHEN price % 2 = 0 THEN 'enter' ELSE 'exit' END AS action, CASE WHEN event_id % 4 = 0 THEN 'acted' ELSE 'open' END AS proposal_state FROM ev WHERE event_id % 3 = 1)"


@query("inbox_join", f"{_PRE}, {_PROP}, jn AS (SELECT ps.*, CASE WHEN state IS NULL THEN 'unknown_prediction' WHEN state <> 'active' THEN 'withdrawn' WHEN ps.expires_us <= {CUTOFF} THEN 'expired' ELSE proposal_state END AS shown_state FROM ps LEFT JOIN pr ON ps.prediction_id = pr.prediction_id) SELECT proposal_id, shown_state, CASE WHEN shown_state = 'open' THEN action ELSE 'none' END AS shown_action, expires_us FROM jn")
def inbox_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = raw_events(spark, sf_dir).where("event_id % 3 = 1"), F.col("event_id")
    proposals = e.select(i.alias("proposal_id"), (i + 1).alias("prediction_id"), (F.col("arrival_us") + DAY).alias("expires_us"), F.when(F.col("price") % 2 == 0, "enter").otherwise("exit").alias("action"), F.when(i % 4 == 0, "acted").otherwise("open").alias("proposal_state"))
    return feedback.inbox(proposals, predictions(spark, sf_dir), CUTOFF).select("proposal_id", "shown_state", "shown_action", "expires_us").sort(F.desc("expires_us"), "proposal_id")


_ACT = """ac AS (SELECT tx * 10 + line AS action_id, CASE WHEN line <> 3 THEN tx + line // 5 END AS tx, CASE WHEN line % 2 = 0 THEN wallet END AS wallet, CASE WHEN line = 4 THEN 'lp' ELSE 'spot' END AS market,
 token AS instrument, CASE WHEN line = 4 THEN 'hold' WHEN direction = 'buy' THEN 'enter' ELSE 'exit' END AS action, event_us AS at_us FROM tr WHERE line <= 5),
av AS (SELECT tx * 10 + line AS activity_id, CASE WHEN line <> 6 THEN tx END AS tx, CASE WHEN quantity % 9 = 0 THEN wallet + 1 ELSE wallet END AS wallet, CASE WHEN line % 4 = 0 THEN 'lp' ELSE 'swap' END AS kind,
 token AS instrument, CASE WHEN direction = 'buy' THEN quantity ELSE -quantity END AS delta, event_us + quantity * 3600000000 AS at_us FROM tr)"""


@query("action_link_join", f"""{_ACT}, fit AS (SELECT DISTINCT action_id, activity_id FROM ac JOIN av ON ac.instrument = av.instrument AND (ac.wallet IS NULL OR ac.wallet = av.wallet)
 AND CASE WHEN ac.market = 'spot' THEN av.kind = 'swap' AND CASE ac.action WHEN 'enter' THEN delta > 0 WHEN 'exit' THEN delta < 0 ELSE false END ELSE av.kind = 'lp' END
 AND CASE WHEN ac.tx IS NOT NULL THEN coalesce(ac.tx = av.tx, false) ELSE abs(ac.at_us - av.at_us) <= {DAY} END),
n AS (SELECT action_id, count(*) AS n, min(activity_id) AS one FROM fit GROUP BY 1)
SELECT ac.action_id, CASE WHEN n = 1 THEN one END AS activity_id, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'pending' END AS status,
 CASE WHEN tx IS NOT NULL THEN CASE WHEN n = 1 THEN 'exact_transaction_match' WHEN n > 1 THEN 'multiple_exact_transaction_candidates' ELSE 'transaction_identity_not_observed' END
  ELSE CASE WHEN n = 1 THEN 'single_compatible_time_window_match' WHEN n > 1 THEN 'multiple_compatible_time_window_candidates' ELSE 'manual_evidence_pending' END END AS reason FROM ac LEFT JOIN n ON ac.action_id = n.action_id""")
def action_link_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.link_actions(*_actions(spark, sf_dir), DAY)


def _actions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines as actions, some without a hash or a wallet and some of another transaction, and as activities of other wallets or kinds."""
    t, line, buys = trades(spark, sf_dir), F.col("line"), F.col("direction") == "buy"
    ident, market = F.col("tx") * 10 + line, F.when(line == 4, "lp").otherwise("spot")
    action = F.when(line == 4, "hold").when(buys, "enter").otherwise("exit")
    actions = t.where("line <= 5").select(
        ident.alias("action_id"), F.when(line != 3, F.expr("tx + line div 5")).alias("tx"), F.when(line % 2 == 0, F.col("wallet")).alias("wallet"), market.alias("market"), F.col("token").alias("instrument"), action.alias("action"), F.col("event_us").alias("at_us"),
    )
    activities = t.select(
        ident.alias("activity_id"), F.when(line != 6, F.col("tx")).alias("tx"), F.when(F.col("quantity") % 9 == 0, F.col("wallet") + 1).otherwise(F.col("wallet")).alias("wallet"), F.when(line % 4 == 0, "lp").otherwise("swap").alias("kind"),
        F.col("token").alias("instrument"), F.when(buys, F.col("quantity")).otherwise(-F.col("quantity")).alias("delta"), (F.col("event_us") + F.col("quantity") * 60 * MINUTE).alias("at_us"),
    )
    return actions, activities


@query("action_status_join", "lk AS (SELECT tx * 10 + line AS action_id, class FROM tr WHERE line = 2), un AS (SELECT action_id, max(class) AS class FROM lk GROUP BY 1) SELECT l_orderkey * 10 + l_linenumber AS action_id, coalesce(un.class, 'pending') AS status FROM lineitem LEFT JOIN un ON l_orderkey * 10 + l_linenumber = action_id")
def action_status_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = trades(spark, sf_dir).where("line = 2").groupBy((F.col("tx") * 10 + F.col("line")).alias("action_id")).agg(F.max("class").alias("class"))
    actions = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("action_id"))
    return actions.join(links, "action_id", "left").select("action_id", F.coalesce("class", F.lit("pending")).alias("status"))


_PTS = f"pt AS (SELECT event_id % 2 AS model, pool % 5 AS market, event_us // {7 * DAY} AS \"window\", CASE WHEN event_id % 3 = 0 THEN 'validation' ELSE 'train' END AS split, price % 500 AS predicted, price % 700 AS target FROM ev)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, p = raw_events(spark, sf_dir), F.col("price")
    return e.select((F.col("event_id") % 2).alias("model"), (F.col("pool") % 5).alias("market"), F.call_function("div", F.col("event_us"), F.lit(7 * DAY)).alias("window"), F.when(F.col("event_id") % 3 == 0, "validation").otherwise("train").alias("split"), (p % 500).alias("predicted"), (p % 700).alias("target"))


@query("window_scores", f'{_PTS} SELECT model, market, "window", split, round(avg(abs(predicted - target)), 6) AS mae, count(*) AS points FROM pt GROUP BY 1, 2, 3, 4')
def window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.window_scores(scored(spark, sf_dir)).withColumn("mae", F.round("mae", 6))


@query("model_metrics", f"{_PTS} SELECT model, round(avg(abs(predicted - target)), 6) AS mae, count(*) AS points FROM pt WHERE split = 'validation' GROUP BY 1")
def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).where("split = 'validation'").groupBy("model").agg(F.round(F.avg(F.abs(F.col("predicted") - F.col("target"))), 6).alias("mae"), F.count("*").alias("points"))


_PAIR = f'{_PTS}, ws AS (SELECT model, market, "window", avg(abs(predicted - target)) AS mae, count(*) AS points FROM pt WHERE split = \'validation\' AND NOT (model = 0 AND market = 3 AND "window" % 3 = 0) GROUP BY 1, 2, 3), pw AS (SELECT coalesce(a.market, b.market) AS market, coalesce(a."window", b."window") AS "window", a.mae AS ma, b.mae AS mb, a.points AS pa, b.points AS pb, coalesce(a.mae < b.mae, false) AS better FROM (SELECT * FROM ws WHERE model = 1) a FULL JOIN (SELECT * FROM ws WHERE model = 0) b ON a.market = b.market AND a."window" = b."window")'


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scored(spark, sf_dir).where("split = 'validation'").where(~((F.col("model") == 0) & (F.col("market") == 3) & (F.col("window") % 3 == 0)))
    return evaluation.paired_windows(evaluation.window_scores(p), 1, 0)


@query("paired_window_join", f'{_PAIR} SELECT market, "window", round(ma, 6) AS mae_candidate, round(mb, 6) AS mae_active, pa AS points_candidate, pb AS points_active, better FROM pw')
def paired_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("market", "window", F.round("mae_candidate", 6).alias("mae_candidate"), F.round("mae_active", 6).alias("mae_active"), "points_candidate", "points_active", "better")


@query("candidate_evaluation", f"{_PAIR}, ag AS (SELECT count(*) AS windows, count(*) FILTER (better) AS better_windows, CAST(coalesce(sum(pa), 0) AS BIGINT) AS points, count(*) FILTER (ma IS NULL OR mb IS NULL) AS unpaired, coalesce(min(pa), 0) AS fewest FROM pw) SELECT windows, better_windows, points, unpaired, concat_ws(',', CASE WHEN windows = 0 THEN 'no_evidence' END, CASE WHEN unpaired > 0 THEN 'missing_side' END, CASE WHEN windows < 8 THEN 'too_few_windows' END, CASE WHEN fewest < 20 THEN 'too_few_points' END, CASE WHEN better_windows < windows THEN 'not_better_everywhere' END) AS reasons, CASE WHEN windows >= 8 AND unpaired = 0 AND fewest >= 20 AND better_windows = windows THEN 'qualified' ELSE 'inconclusive' END AS state FROM ag")
def candidate_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.candidate_evaluation(_pairs(spark, sf_dir), 8, 20)


@query("matched_comparison_review", f"{_PTS}, sd AS (SELECT market, count(DISTINCT predicted % 7) AS seeds, count(DISTINCT \"window\") AS windows, count(*) FILTER (model = 1) AS c, count(*) FILTER (model = 0) AS a FROM pt GROUP BY 1) SELECT market, seeds, windows, CASE WHEN seeds < 5 THEN 'inconclusive_seeds' WHEN windows < 4 THEN 'inconclusive_windows' WHEN c > a THEN 'retain' ELSE 'reject' END AS decision FROM sd")
def matched_comparison_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).groupBy("market").agg(F.count_distinct(F.col("predicted") % 7).alias("seeds"), F.count_distinct("window").alias("windows"), F.count_if(F.col("model") == 1).alias("c"), F.count_if(F.col("model") == 0).alias("a"))
    return s.select("market", "seeds", "windows", F.when(F.col("seeds") < 5, "inconclusive_seeds").when(F.col("windows") < 4, "inconclusive_windows").when(F.col("c") > F.col("a"), "retain").otherwise("reject").alias("decision"))


@query("evidence_grid_equal", f"{_PTS}, sa AS (SELECT market, \"window\", target % 11 AS ref, count(*) AS n FROM pt WHERE model = 1 GROUP BY 1, 2, 3), sb AS (SELECT market, \"window\", target % 11 AS ref, count(*) AS n FROM pt WHERE model = 0 GROUP BY 1, 2, 3), d AS (SELECT coalesce(sa.market, sb.market) AS market, coalesce(sa.\"window\", sb.\"window\") AS \"window\", coalesce(sa.n, 0) - coalesce(sb.n, 0) AS df FROM sa FULL JOIN sb ON sa.market = sb.market AND sa.\"window\" = sb.\"window\" AND sa.ref = sb.ref) SELECT market, \"window\", CAST(sum(greatest(df, 0)) AS BIGINT) AS only_a, CAST(sum(greatest(-df, 0)) AS BIGINT) AS only_b, sum(abs(df)) = 0 AS equal FROM d GROUP BY 1, 2")
def evidence_grid_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).select("model", "market", "window", (F.col("target") % 11).alias("ref"))
    return evaluation.grid_equal(s.where("model = 1").drop("model"), s.where("model = 0").drop("model"), ["market", "window"])


@query("identity_map_equal", "a AS (SELECT event_id AS k FROM ev WHERE event_id % 31 <> 4), b AS (SELECT event_id AS k FROM ev WHERE event_id % 29 <> 3) SELECT (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_features, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_predictions, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) + (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) = 0 AS equal")
def identity_map_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_events(spark, sf_dir).select(F.col("event_id").alias("k"))
    sides = e.where("k % 31 <> 4").withColumn("f", F.lit(1)).join(e.where("k % 29 <> 3").withColumn("p", F.lit(1)), "k", "full")
    counts = sides.agg(F.count_if(F.col("p").isNull()).alias("only_features"), F.count_if(F.col("f").isNull()).alias("only_predictions"))
    return counts.withColumn("equal", (F.col("only_features") + F.col("only_predictions")) == 0)


_CUR = "cu AS (SELECT p_partkey, p_brand, p_size, CAST(p_partkey % 3 + 1 AS INTEGER) AS revision FROM part WHERE p_partkey % 5 <> 0), inc AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 4 <> 0)"
_UP = f"{_CUR}, jo AS (SELECT coalesce(cu.p_partkey, inc.p_partkey) AS p_partkey, CASE WHEN cu.p_partkey IS NULL THEN 'inserted' WHEN inc.p_partkey IS NULL THEN 'kept' WHEN cu.p_brand = inc.p_brand AND cu.p_size = inc.p_size THEN 'duplicate' ELSE 'revised' END AS change, coalesce(inc.p_brand, cu.p_brand) AS p_brand, coalesce(inc.p_size, cu.p_size) AS p_size, cu.p_brand AS ob, cu.p_size AS os, revision FROM cu FULL JOIN inc ON cu.p_partkey = inc.p_partkey)"


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    current = p.where("p_partkey % 5 <> 0").withColumn("revision", (F.col("p_partkey") % 3 + 1).cast("int"))
    incoming = p.where("p_partkey % 4 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return feedback.versioned_upsert(current, incoming, "p_partkey", ["p_brand", "p_size"])


@query("sink_versioned_upsert", f"""{_UP} SELECT p_partkey, change, p_brand, p_size, CASE WHEN change = 'revised' THEN '{{"p_brand":"' || ob || '","p_size":' || os || '}}' END AS replaced, CASE change WHEN 'inserted' THEN 1 WHEN 'revised' THEN revision + 1 ELSE revision END AS revision FROM jo""")
def sink_versioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir)


@query("revision_history", f"""{_UP}, hi AS (SELECT p_partkey, revision, p_size, 'current' AS kind FROM (SELECT p_partkey, p_size, CASE change WHEN 'inserted' THEN 1 WHEN 'revised' THEN revision + 1 ELSE revision END AS revision FROM jo) UNION ALL SELECT p_partkey, revision, os, 'replaced' FROM jo WHERE change = 'revised') SELECT p_partkey, revision, p_size, kind FROM hi""")
def revision_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = _upserted(spark, sf_dir)
    now = up.select("p_partkey", "revision", "p_size", F.lit("current").alias("kind"))
    old = up.where("change = 'revised'").select("p_partkey", (F.col("revision") - 1).alias("revision"), F.get_json_object("replaced", "$.p_size").cast("int").alias("p_size"), F.lit("replaced").alias("kind"))
    return now.unionByName(old)


_MO = "mo AS (SELECT event_id // 2 * 2 AS output_id, CASE pool % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'slow' WHEN 2 THEN 'day' ELSE 'none' END AS target_id, arrival_us AS created_us, price / 8 AS value, CASE WHEN event_id % 5 = 0 THEN 'final_test' ELSE 'validation' END AS partition, event_id FROM ev), te(target_id, horizon_us, prefix) AS (VALUES ('fast', 60000000, 'f'), ('slow', 900000000, 's'), ('day', 86400000000, 'd'))"


def _outputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = raw_events(spark, sf_dir)
    target = F.when(F.col("pool") % 4 == 0, "fast").when(F.col("pool") % 4 == 1, "slow").when(F.col("pool") % 4 == 2, "day").otherwise("none")
    outputs = e.select((F.expr("event_id div 2") * 2).alias("output_id"), target.alias("target_id"), F.col("arrival_us").alias("created_us"), (F.col("price") / 8).alias("value"), F.when(F.col("event_id") % 5 == 0, "final_test").otherwise("validation").alias("partition"), "event_id")
    return outputs, spark.createDataFrame([("fast", 60_000_000, "f"), ("slow", 900_000_000, "s"), ("day", DAY, "d")], "target_id string, horizon_us long, prefix string")


@query("signal_records", f"{_MO}, nu AS (SELECT *, row_number() OVER (PARTITION BY output_id ORDER BY created_us) AS n FROM mo) SELECT output_id, concat_ws(':', prefix, CAST(output_id AS VARCHAR)) AS prediction_id, CAST(round_even(value, 0) AS BIGINT) AS expected_bps, created_us + horizon_us AS expires_us, least(created_us + horizon_us, created_us + 15000000) AS proposal_expires_us, CASE WHEN n > 1 THEN 'repeated_output' WHEN prefix IS NULL THEN 'unknown_target' WHEN partition = 'final_test' THEN 'final_test' END AS excluded FROM nu LEFT JOIN te ON nu.target_id = te.target_id")
def signal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.signal_rows(*_outputs(spark, sf_dir), 15_000_000)


@query("model_output_rows", f"{_MO} SELECT event_id, output_id, round(value, 6) AS value, partition, count(*) OVER (PARTITION BY output_id) > 1 AS repeated FROM mo WHERE target_id = 'fast' AND partition IN ('validation', 'test')")
def model_output_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs, _ = _outputs(spark, sf_dir)
    one = outputs.where((F.col("target_id") == "fast") & F.col("partition").isin("validation", "test"))
    counts = one.groupBy("output_id").agg((F.count("*") > 1).alias("repeated"))
    return one.join(counts, "output_id").select("event_id", "output_id", F.round("value", 6).alias("value"), "partition", "repeated")


@query("final_test_exclusion", f"{_MO} SELECT target_id, count(*) FILTER (partition <> 'final_test') AS kept, count(*) FILTER (partition = 'final_test') AS excluded FROM mo GROUP BY 1")
def final_test_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outputs(spark, sf_dir)[0].groupBy("target_id").agg(F.count_if(F.col("partition") != "final_test").alias("kept"), F.count_if(F.col("partition") == "final_test").alias("excluded"))


@query("validate_against_targets", f"{_MO} SELECT event_id, concat_ws(',', CASE WHEN prefix IS NULL THEN 'target_unknown' END, CASE WHEN horizon_us < 300000000 AND value > 900 THEN 'value_out_of_range' END, CASE WHEN horizon_us > 3600000000 AND event_id % 3 = 0 THEN 'ttl_exceeded' END) AS reasons FROM mo LEFT JOIN te ON mo.target_id = te.target_id")
def validate_against_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs, template = _outputs(spark, sf_dir)
    joined_ = outputs.join(F.broadcast(template), "target_id", "left")
    why = evaluation.reasons([("target_unknown", F.col("prefix").isNull()), ("value_out_of_range", (F.col("horizon_us") < 300_000_000) & (F.col("value") > 900)), ("ttl_exceeded", (F.col("horizon_us") > 60 * MINUTE) & (F.col("event_id") % 3 == 0))])
    return joined_.select("event_id", why.alias("reasons"))


@query("cash_ledger", "cl AS (SELECT pool, arrival_us, event_id, CASE WHEN event_type = 'signup' THEN price ELSE -(price % 3000) END AS amount FROM ev), ru AS (SELECT *, sum(amount) OVER w AS s FROM cl WINDOW w AS (PARTITION BY pool ORDER BY arrival_us, event_id)) SELECT pool, CAST(sum(amount) AS BIGINT) AS requested, count(*) AS entries FROM ru GROUP BY pool")
def cash_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.ledger import requested

    return requested(_cash(spark, sf_dir), "pool", "amount")


def _cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).select("pool", "arrival_us", "event_id", F.when(F.col("event_type") == "signup", F.col("price")).otherwise(-(F.col("price") % 3000)).alias("amount"))


_LEDGER = """RECURSIVE cl AS (SELECT pool, CASE WHEN event_type = 'signup' THEN price ELSE -(price % 3000) END AS amount, row_number() OVER (PARTITION BY pool ORDER BY arrival_us, event_id) AS i FROM ev),
fo(pool, i, cash, failed) AS (SELECT DISTINCT pool, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM cl UNION ALL SELECT cl.pool, cl.i, CASE WHEN cash + amount < 0 THEN cash ELSE cash + amount END, failed + CASE WHEN cash + amount < 0 THEN 1 ELSE 0 END FROM fo JOIN cl ON cl.pool = fo.pool AND cl.i = fo.i + 1)"""


@query("cash_ledger_failures", f"{_LEDGER} SELECT pool, max(i) AS entries, arg_max(cash, i) AS balance, max(failed) AS failed FROM fo GROUP BY pool")
def cash_ledger_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.ledger import cash_fold

    return cash_fold(_cash(spark, sf_dir), "pool", ["arrival_us", "event_id"], "amount")


@query("decision_ledger", "dl AS (SELECT source AS portfolio, pool AS asset, event_type, price, arrival_us, event_id FROM ev), la AS (SELECT portfolio, asset, arg_max(event_type, {a: arrival_us, e: event_id}) AS state, arg_max(price, {a: arrival_us, e: event_id}) AS amount FROM dl GROUP BY 1, 2), ca AS (SELECT portfolio, CAST(sum(CASE event_type WHEN 'purchase' THEN -price WHEN 'error' THEN price ELSE 0 END) AS BIGINT) AS cash_change, count(*) FILTER (event_type = 'purchase') AS entries, count(*) FILTER (event_type = 'error') AS exits FROM dl GROUP BY 1) SELECT ca.portfolio, cash_change, entries, exits, count(*) FILTER (state = 'purchase') AS open_assets, CAST(coalesce(sum(amount) FILTER (state = 'purchase'), 0) AS BIGINT) AS open_amount FROM ca JOIN la ON ca.portfolio = la.portfolio GROUP BY 1, 2, 3, 4")
def decision_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.ledger import decisions

    e = raw_events(spark, sf_dir).select(F.col("source").alias("portfolio"), F.col("pool").alias("asset"), "event_type", "price", "arrival_us", "event_id")
    return decisions(e, "purchase", "error")
