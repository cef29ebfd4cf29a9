"""Queries of policies, quotes, metrics and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.integers import floor_div, round_to_spacing
from tidemark.operators import evaluation, policies, windows
from tidemark.plans.bindings import DAY, MINUTE, floored, query, raw_events
from tidemark.plans.market import AS_OF, START, returns

_EPI = f"epi AS (SELECT event_id, pool, event_type, CAST(event_us // {DAY} AS BIGINT) AS block_id, price % 400 - 180 AS net_bps, price % 90 - 30 AS benchmark_bps, event_type = 'error' AS failed, price % 50 AS turnover_bps, price % 70 AS exposure_bps, event_us FROM ev)"


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("price")
    return raw_events(spark, sf_dir).select(
        "event_id", "pool", "event_type", F.call_function("div", F.col("event_us"), F.lit(DAY)).alias("block_id"), (p % 400 - 180).alias("net_bps"), (p % 90 - 30).alias("benchmark_bps"),
        (F.col("event_type") == "error").alias("failed"), (p % 50).alias("turnover_bps"), (p % 70).alias("exposure_bps"), "event_us",
    )


def _metrics(by: str, source: str = "epi") -> str:
    mean = lambda c: floored(f"CAST(sum({c}) AS BIGINT)", "count(*)")
    return f"""SELECT {by}, count(*) AS episodes, count(DISTINCT block_id) AS blocks, {mean("net_bps")} AS mean_net_bps, {mean("net_bps - benchmark_bps")} AS mean_excess_bps,
 count(*) FILTER (failed) * 10000 // count(*) AS failure_bps, {mean("turnover_bps")} AS turnover_bps, {mean("exposure_bps")} AS exposure_bps, min(net_bps) AS worst_bps,
 CASE WHEN count(DISTINCT block_id) < 4 THEN 'insufficient_blocks' ELSE 'missing_equity_curve' END AS inference FROM {source} GROUP BY {by}"""


@query("episode_metrics", f"{_EPI} {_metrics('pool')}")
def episode_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.episode_metrics(episodes(spark, sf_dir), ["pool"])


_WF = [(f"w{i}", START + i * 7 * DAY, START + (i * 7 + 14) * DAY) for i in range(3)]


@query("walk_forward", f"{_EPI}, wf(name, lo, hi) AS (VALUES {', '.join(str(w) for w in _WF)}), we AS (SELECT epi.*, name FROM epi JOIN wf ON event_us >= lo AND event_us < hi) {_metrics('name, event_type', 'we')}")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.array_compact(F.array(*[F.when((F.col("event_us") >= lo) & (F.col("event_us") < hi), name) for name, lo, hi in _WF]))
    return evaluation.episode_metrics(episodes(spark, sf_dir).withColumn("name", F.explode(inside)), ["name", "event_type"])


@query("mode_comparison", f"{_EPI}, md AS (SELECT epi.*, mode FROM epi, (VALUES ('spot'), ('idle'), ('lp')) m(mode)), adj AS (SELECT * REPLACE (CASE mode WHEN 'idle' THEN 0 WHEN 'lp' THEN net_bps // 2 ELSE net_bps END AS net_bps) FROM md WHERE mode <> 'lp' OR pool % 3 = 0) {_metrics('mode', 'adj')}")
def mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = episodes(spark, sf_dir)
    modes = F.array(F.struct(F.lit("spot").alias("mode"), F.col("net_bps").alias("m")), F.struct(F.lit("idle").alias("mode"), F.lit(0).cast("long").alias("m")), F.struct(F.lit("lp").alias("mode"), F.expr("net_bps div 2").alias("m")))
    stacked = e.select("*", F.inline(modes)).where((F.col("mode") != "lp") | (F.col("pool") % 3 == 0)).withColumn("net_bps", F.col("m"))
    return evaluation.episode_metrics(stacked, ["mode"])


@query("block_bootstrap")
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.block_bootstrap(episodes(spark, sf_dir), ["event_type"])


_CURVE = f"{_EPI}, oe AS (SELECT pool, event_us, event_id, sum(net_bps) OVER (PARTITION BY pool ORDER BY event_us, event_id) + 100000 AS equity FROM epi)"


@query("max_drawdown_bps", f"{_CURVE}, pk AS (SELECT pool, CAST(equity AS BIGINT) AS equity, CAST(max(equity) OVER (PARTITION BY pool ORDER BY event_us, event_id) AS BIGINT) AS peak FROM oe) SELECT pool, max(CASE WHEN peak > 0 THEN (peak - equity) * 10000 // peak ELSE 0 END) AS drawdown_bps FROM pk GROUP BY pool")
def max_drawdown_bps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = episodes(spark, sf_dir)
    curve = e.withColumn("equity", F.sum("net_bps").over(Window.partitionBy("pool").orderBy("event_us", "event_id")) + 100_000)
    return windows.max_drawdown_bps(curve, ["pool"], ["event_us", "event_id"], "equity")


_FOLD = f"""RECURSIVE {_EPI}, nu AS (SELECT pool, net_bps, row_number() OVER (PARTITION BY pool ORDER BY event_us, event_id) AS i FROM epi),
fo(pool, i, e) AS (SELECT DISTINCT pool, CAST(0 AS BIGINT), CAST(100000 AS BIGINT) FROM nu UNION ALL SELECT nu.pool, nu.i, greatest(0, e + {floored("e * net_bps", "10000")}) FROM fo JOIN nu ON nu.pool = fo.pool AND nu.i = fo.i + 1)"""


@query("equity_curve", f"{_FOLD} SELECT pool, i AS step, e AS equity FROM fo WHERE i > 0")
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.equity_curve(episodes(spark, sf_dir), ["pool"], ["event_us", "event_id"], "net_bps", 100_000)


@query("map_prediction_action", """pq AS (SELECT event_id, price % 401 - 200 AS expected, price % 613 AS uncertainty, event_id % 3 = 0 AS is_open FROM ev)
SELECT event_id, CASE WHEN uncertainty > 500 THEN 'watch' WHEN is_open AND expected <= -100 THEN 'exit' WHEN NOT is_open AND expected >= 100 THEN 'enter' WHEN is_open THEN 'hold' ELSE 'watch' END AS action,
 CASE WHEN uncertainty > 500 THEN 'uncertainty_above_threshold' WHEN is_open AND expected <= -100 THEN 'expected_return_below_exit_threshold' WHEN NOT is_open AND expected >= 100 THEN 'expected_return_above_entry_threshold' ELSE 'threshold_not_met' END AS reason FROM pq""")
def map_prediction_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("price")
    decided = policies.prediction_action(p % 401 - 200, p % 613, F.col("event_id") % 3 == 0)
    return raw_events(spark, sf_dir).select("event_id", decided.alias("d")).select("event_id", "d.action", "d.reason")


#: Observations of the pools: the price change and the run of rises from arrivals, the rest from the event.
_OBS = f"""l1 AS (SELECT *, lag(price) OVER (PARTITION BY pool ORDER BY arrival_us, event_id) AS before FROM ev),
l2 AS (SELECT *, coalesce({returns("before", "price")}, 0) AS change FROM l1),
l3 AS (SELECT *, sum(CASE WHEN change <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY pool ORDER BY arrival_us, event_id) AS run FROM l2),
ob AS (SELECT event_id, pool, event_us, price % 300 - 140 AS expected, price % 40 - 5 AS flow, price % 7 AS liquidity, change, event_type <> 'error' AS candidate, CASE pool % 4 WHEN 0 THEN 'member' WHEN 1 THEN 'outside' ELSE NULL END AS cohort,
 sum(CASE WHEN change > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY pool, run ORDER BY arrival_us, event_id) AS rises, event_id % 3 = 0 AS is_open, event_id % 11 * 50 AS age FROM l3)"""
_BASE = """CASE policy
 WHEN 'idle_cash' THEN 'watch'
 WHEN 'fixed_horizon_hold' THEN CASE WHEN is_open AND age >= 300 THEN 'exit' WHEN NOT is_open AND candidate THEN 'enter' WHEN is_open THEN 'hold' ELSE 'watch' END
 WHEN 'confirmation_momentum' THEN CASE WHEN is_open AND change < 0 THEN 'exit' WHEN NOT is_open AND change > 0 AND rises >= 2 THEN 'enter' WHEN is_open THEN 'hold' ELSE 'watch' END
 WHEN 'verified_flow_filter' THEN CASE WHEN is_open AND NOT (flow >= 1 AND liquidity >= 1) THEN 'exit' WHEN NOT is_open AND flow >= 1 AND liquidity >= 1 AND candidate THEN 'enter' WHEN is_open THEN 'hold' ELSE 'watch' END
 ELSE CASE WHEN cohort IS DISTINCT FROM 'member' THEN 'watch' WHEN NOT is_open AND candidate THEN 'enter' WHEN is_open THEN 'hold' ELSE 'watch' END END"""
_WHY = """CASE policy
 WHEN 'idle_cash' THEN 'no_entry_by_definition'
 WHEN 'fixed_horizon_hold' THEN CASE action WHEN 'exit' THEN 'fixed_horizon_reached' WHEN 'enter' THEN 'candidate_available' ELSE 'waiting_for_candidate' END
 WHEN 'confirmation_momentum' THEN CASE action WHEN 'exit' THEN 'negative_momentum' WHEN 'enter' THEN 'confirmed_positive_momentum' ELSE 'confirmation_not_met' END
 WHEN 'verified_flow_filter' THEN CASE action WHEN 'exit' THEN 'flow_or_liquidity_below_threshold' WHEN 'enter' THEN 'verified_flow_and_liquidity_confirmed' ELSE 'verified_flow_filter_not_met' END
 ELSE CASE WHEN cohort IS DISTINCT FROM 'member' THEN 'cohort_unavailable_or_uncertain' WHEN action = 'enter' THEN 'observed_prior_cohort_signal' ELSE 'no_new_cohort_signal' END END"""
_POLICIES = "po(policy) AS (VALUES ('idle_cash'), ('fixed_horizon_hold'), ('confirmation_momentum'), ('verified_flow_filter'), ('tracked_wallet_follow'))"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, p = policies.market_observations(raw_events(spark, sf_dir), "pool", ["arrival_us", "event_id"], "price"), F.col("price")
    cohort = F.when(F.col("pool") % 4 == 0, "member").when(F.col("pool") % 4 == 1, "outside")
    return e.select(
        "event_id", "pool", "event_us", (p % 300 - 140).alias("expected"), (p % 40 - 5).alias("verified_flow"), (p % 7).alias("liquidity"), "price_change_bps", (F.col("event_type") != "error").alias("candidate_available"), cohort.alias("cohort_state"),
        "positive_intervals", (F.col("event_id") % 3 == 0).alias("position_open"), (F.col("event_id") % 11 * 50).alias("position_age_seconds"),
    )


@query("baseline_policies", f"{_OBS}, {_POLICIES}, ac AS (SELECT *, {_BASE} AS action FROM ob, po) SELECT event_id, policy, action, CASE WHEN action = 'enter' THEN 500 ELSE 0 END AS allocation_bps, {_WHY} AS reason FROM ac")
def baseline_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.baseline_decisions(observations(spark, sf_dir), ["event_id"])


@query("range_policies", """rp AS (SELECT event_id, price - 5000 AS tick, price % 137 AS volatility, CASE event_id % 4 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS verified FROM ev),
hw AS (SELECT *, CASE policy WHEN 'fixed_wide_range' THEN 600 WHEN 'volatility_range' THEN greatest(120, volatility * 2) END AS half FROM rp, (VALUES ('fixed_wide_range'), ('volatility_range'), ('idle')) v(policy))
SELECT event_id, policy, CASE WHEN policy <> 'idle' AND verified THEN 'open' ELSE 'watch' END AS action, tick - half AS tick_lower, tick + half AS tick_upper,
 CASE WHEN policy = 'idle' THEN 'no_lp_position' WHEN verified IS NOT TRUE THEN 'lp_disabled_until_verified_live_evidence' WHEN policy = 'fixed_wide_range' THEN 'fixed_discrete_range' ELSE 'observed_volatility_range' END AS reason FROM hw""")
def range_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    verified = F.when(i % 4 == 0, False).when(i % 4 != 1, True)
    rows = raw_events(spark, sf_dir).select("event_id", (F.col("price") - 5000).alias("tick"), (F.col("price") % 137).alias("volatility"), verified.alias("verified"))
    return policies.range_decisions(rows, ["event_id"], "tick", "volatility", "verified")


@query("tick_rounding", "tk AS (SELECT event_id, price - 4000 AS tick, 10 + event_id % 3 * 50 AS spacing FROM ev), fl AS (SELECT *, tick - ((tick % spacing) + spacing) % spacing AS down FROM tk) SELECT event_id, down, CASE WHEN down <> tick THEN down + spacing ELSE down END AS up FROM fl")
def tick_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = raw_events(spark, sf_dir).select("event_id", (F.col("price") - 4000).alias("tick"), (10 + F.col("event_id") % 3 * 50).alias("spacing"))
    return t.select("event_id", round_to_spacing(F.col("tick"), F.col("spacing")).alias("down"), round_to_spacing(F.col("tick"), F.col("spacing"), up=True).alias("up"))


@query("health_state", f"""pl AS (SELECT DISTINCT pool FROM ev),
la AS (SELECT pool, arg_max({{t: event_type, p: price}}, {{a: arrival_us, i: event_id}}) AS l, max(arrival_us) AS latest FROM ev WHERE arrival_us <= {AS_OF} AND pool % 10 <> 7 GROUP BY pool),
q AS (SELECT pl.pool, CASE l.t WHEN 'error' THEN 'degraded' WHEN 'view' THEN 'unknown' ELSE 'healthy' END AS quality, l.p % 6 = 0 AS contradictory, latest, pl.pool % 2 = 0 AS position FROM pl LEFT JOIN la ON pl.pool = la.pool),
st AS (SELECT *, CASE WHEN latest IS NULL THEN 'unknown' WHEN contradictory THEN 'degraded' WHEN quality <> 'healthy' THEN quality WHEN {AS_OF} - latest > 21600000000 THEN 'stale' ELSE 'healthy' END AS state FROM q)
SELECT pool, state, state = 'healthy' AS can_enter, CASE WHEN NOT position THEN 'pause_new_entries' WHEN state = 'healthy' THEN 'hold_existing_position' ELSE 'hold_and_reconcile_existing_position' END AS management_action,
 latest IS NULL OR {AS_OF} - latest > 21600000000 AS missed_deadline,
 CASE WHEN latest IS NULL THEN 'no_received_observation' WHEN contradictory THEN 'contradictory_observation' WHEN quality <> 'healthy' THEN 'quality_' || quality WHEN {AS_OF} - latest > 21600000000 THEN 'decision_deadline_missed' ELSE 'within_deadline' END AS reason FROM st""")
def health_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pool at an instant, from the last event that had arrived; some pools are never observed."""
    e = raw_events(spark, sf_dir)
    latest = e.where((F.col("arrival_us") <= AS_OF) & (F.col("pool") % 10 != 7)).groupBy("pool").agg(F.max_by(F.struct("event_type", "price"), F.struct("arrival_us", "event_id")).alias("l"), F.max("arrival_us").alias("latest"))
    q = e.select("pool").distinct().join(latest, "pool", "left")
    quality = F.when(F.col("l.event_type") == "error", "degraded").when(F.col("l.event_type") == "view", "unknown").otherwise("healthy")
    h = policies.health(quality, F.col("l.price") % 6 == 0, F.lit(AS_OF), F.col("latest"), F.col("pool") % 2 == 0, deadline_seconds=21_600)
    return q.select("pool", h.alias("h")).select("pool", "h.*")


_SC = [("calm", 0, 10, 0), ("fees", 30, 60, 5), ("crash", 2500, 120, 40)]
_SCV = f"sc(scenario, move, fee, gas) AS (VALUES {', '.join(str(x) for x in _SC)})"


@query("stress_linear", f"""{_SCV}, lp AS (SELECT event_id, price % 500 AS base_fee, price * 3 AS size, CASE WHEN event_id % 4 = 0 THEN price * 2 WHEN event_id % 4 = 1 THEN price * 5 END AS depth, status <> 'quarantined' AND event_id % 23 <> 0 AS supported FROM ev),
ex AS (SELECT *, CASE WHEN NOT supported THEN 'unsupported_hook_or_token' WHEN depth < size THEN 'insufficient_exit_depth' ELSE 'linearized_counterfactual' END AS reason FROM lp, sc)
SELECT event_id, scenario, CASE WHEN reason = 'linearized_counterfactual' THEN base_fee - size * move // 10000 - size * fee // 10000 - gas END AS modelled_net, CASE WHEN reason = 'linearized_counterfactual' THEN 'modeled' ELSE 'excluded' END AS state, reason FROM ex""")
def stress_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, p = F.col("event_id"), F.col("price")
    scenarios = F.inline(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(m).alias("move"), F.lit(f).alias("fee"), F.lit(g).alias("gas")) for n, m, f, g in _SC]))
    depth = F.when(i % 4 == 0, p * 2).when(i % 4 == 1, p * 5)
    e = raw_events(spark, sf_dir).select("event_id", (p % 500).alias("base"), (p * 3).alias("size"), depth.alias("depth"), ((F.col("status") != "quarantined") & (i % 23 != 0)).alias("supported"), scenarios)
    r = policies.linear_stress(F.col("base"), F.col("size"), F.col("move"), F.col("fee"), F.col("gas"), F.col("depth"), F.col("supported"))
    return e.select("event_id", "scenario", r.alias("r")).select("event_id", "scenario", "r.*")


_QUOTE = "qt AS (SELECT pool, event_us AS quoted_us, event_id AS quote_id, 1000000 + price * 10 AS reserve_in, 2000000 + price * 7 AS reserve_out, 30 + event_id % 3 * 5 AS fee_bps FROM ev WHERE event_id % 2 = 0), od AS (SELECT event_id AS order_id, pool, event_us + 1800000000 AS at_us, 10000 + price AS amount FROM ev WHERE event_id % 3 = 0)"


def _asof(orders: str, at: str) -> str:
    return f"SELECT o.*, q.quote_id, q.reserve_in, q.reserve_out, q.fee_bps FROM {orders} o ASOF LEFT JOIN qt q ON o.pool = q.pool AND o.{at} >= q.quoted_us"


def _fill(prefix: str, source: str, amount: str) -> str:
    return f"""{prefix}f AS (SELECT *, {amount} * fee_bps // 10000 AS fee FROM ({source})),
{prefix} AS (SELECT *, CAST(({amount} - fee)::HUGEINT * reserve_out // (reserve_in + {amount} - fee) AS BIGINT) AS output, CAST(({amount} - fee)::HUGEINT * reserve_out // reserve_in AS BIGINT) AS spot FROM {prefix}f)"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).where("event_id % 2 = 0").select("pool", F.col("event_us").alias("quoted_us"), F.col("event_id").alias("quote_id"), (1_000_000 + F.col("price") * 10).alias("reserve_in"), (2_000_000 + F.col("price") * 7).alias("reserve_out"), (30 + F.col("event_id") % 3 * 5).alias("fee_bps"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).where("event_id % 3 = 0").select(F.col("event_id").alias("order_id"), "pool", (F.col("event_us") + 30 * MINUTE).alias("at_us"), (10_000 + F.col("price")).alias("amount"))


def _filled(orders: DataFrame, q: DataFrame, at: str, amount: str) -> DataFrame:
    with_quote = policies.quote_as_of(orders, q, "pool", at, "quoted_us", DAY)
    fee, output, impact = policies.fill(F.col(amount), F.col("quote.reserve_in"), F.col("quote.reserve_out"), F.col("quote.fee_bps"))
    return with_quote.select(*orders.columns, F.col("quote.quote_id").alias("quote_id"), fee.alias("fee"), output.alias("output"), impact.alias("impact_bps"))


@query("quote_as_of_fill", f"{_QUOTE}, {_fill('fl', _asof('od', 'at_us'), 'amount')} SELECT order_id, quote_id, fee, output, CASE WHEN spot > 0 THEN {floored('(spot - output) * 10000', 'spot')} ELSE 0 END AS impact_bps, CASE WHEN quote_id IS NULL THEN 'no_quote' WHEN (spot - output) * 10000 // spot > 120 THEN 'impact_limit' ELSE 'filled' END AS status FROM fl")
def quote_as_of_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _filled(_orders(spark, sf_dir), quotes(spark, sf_dir), "at_us", "amount")
    status = F.when(F.col("quote_id").isNull(), "no_quote").when(F.col("impact_bps") > 120, "impact_limit").otherwise("filled")
    return f.select("order_id", "quote_id", "fee", "output", F.when(F.col("quote_id").isNull(), F.lit(0)).otherwise(F.col("impact_bps")).cast("long").alias("impact_bps"), status.alias("status"))


_TRIP = f"""{_QUOTE}, {_fill("en", _asof("od", "at_us"), "amount")}, ex0 AS (SELECT order_id, pool, at_us + 7200000000 AS exit_us, amount, output AS held FROM en WHERE quote_id IS NOT NULL),
exq AS (SELECT o.*, q.quote_id, q.reserve_out AS reserve_in, q.reserve_in AS reserve_out, q.fee_bps FROM ex0 o ASOF LEFT JOIN qt q ON o.pool = q.pool AND o.exit_us >= q.quoted_us), {_fill("ex", "SELECT * FROM exq", "held")}"""


def trips(spark: SparkSession, sf_dir: str, delay: int = 120 * MINUTE) -> DataFrame:
    q = quotes(spark, sf_dir)
    entry = _filled(_orders(spark, sf_dir), q, "at_us", "amount").where("quote_id is not null").select("order_id", "pool", (F.col("at_us") + delay).alias("exit_us"), "amount", F.col("output").alias("held"))
    turned = q.select("pool", "quoted_us", "quote_id", F.col("reserve_out").alias("reserve_in"), F.col("reserve_in").alias("reserve_out"), "fee_bps")
    return _filled(entry, turned, "exit_us", "held")


@query("round_trip", f"{_TRIP} SELECT order_id, held, output AS returned, {floored('(output - amount) * 10000', 'amount')} AS net_bps FROM ex")
def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips(spark, sf_dir).select("order_id", "held", F.col("output").alias("returned"), floor_div((F.col("output") - F.col("amount")) * 10_000, F.col("amount")).alias("net_bps"))


#: Of a scenario: slippage and extra fee of each fill in basis points, and the delay of each fill.
_STRESS = [("calm", 0, 0, 0), ("fees", 30, 60, 5 * MINUTE), ("crash", 250, 120, 90 * MINUTE)]
_HOLDING = 120 * MINUTE


def _stress_fill(name: str, source: str, at: str, amount: str, out: str) -> str:
    return f"""{name}f AS (SELECT *, {amount} * (fee_bps + fee) // 10000 AS taken FROM (SELECT o.*, q.reserve_in, q.reserve_out, q.fee_bps FROM {source} o ASOF LEFT JOIN qt q ON o.pool = q.pool AND o.{at} >= q.quoted_us)),
{name} AS (SELECT * EXCLUDE (reserve_in, reserve_out, fee_bps, taken), CAST(({amount} - taken)::HUGEINT * {"reserve_out // (reserve_in" if name == "en" else "reserve_in // (reserve_out"} + {amount} - taken) * (10000 - slip) // 10000 AS BIGINT) AS {out} FROM {name}f)"""


_STRESS_SQL = f"""{_QUOTE}, sc(scenario, slip, fee, delay_us) AS (VALUES {", ".join(str(x) for x in _STRESS)}), oi AS (SELECT od.*, sc.*, at_us + delay_us AS in_us FROM od, sc),
{_stress_fill("en", "oi", "in_us", "amount", "held")}, eo AS (SELECT *, in_us + {_HOLDING} + delay_us AS out_us FROM en), {_stress_fill("ex", "eo", "out_us", "held", "returned")}
SELECT order_id, scenario, CASE WHEN coalesce(held, 0) <= 0 THEN 'entry_failed' WHEN coalesce(returned, 0) <= 0 THEN 'exit_failed' ELSE 'completed' END AS status, CASE WHEN held > 0 AND returned > 0 THEN returned - amount END AS net FROM ex"""


def _stressed(orders: DataFrame, q: DataFrame, at: str, amount: str, out: str) -> DataFrame:
    """`orders` with what a fill leaves under their own extra fee and slippage; null without a quote."""
    _, output, _ = policies.fill(F.col(amount), F.col("quote.reserve_in"), F.col("quote.reserve_out"), F.col("quote.fee_bps") + F.col("fee"))
    return policies.quote_as_of(orders, q, "pool", at, "quoted_us", DAY).select(*orders.columns, floor_div(output * (10_000 - F.col("slip")), 10_000).alias(out))


@query("stress_round_trip", _STRESS_SQL)
def stress_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's trip under each scenario: the entry is delayed, the exit follows the delayed entry and is delayed again, and
    each fill takes the quote known at its own time."""
    q = quotes(spark, sf_dir)
    turned = q.select("pool", "quoted_us", "quote_id", F.col("reserve_out").alias("reserve_in"), F.col("reserve_in").alias("reserve_out"), "fee_bps")
    scenarios = F.inline(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(s).alias("slip"), F.lit(f).alias("fee"), F.lit(d).cast("long").alias("delay_us")) for n, s, f, d in _STRESS]))
    orders = _orders(spark, sf_dir).select("*", scenarios).withColumn("in_us", F.col("at_us") + F.col("delay_us"))
    entry = _stressed(orders, q, "in_us", "amount", "held").withColumn("out_us", F.col("in_us") + _HOLDING + F.col("delay_us"))
    out = _stressed(entry, turned, "out_us", "held", "returned")
    status = F.when(F.coalesce("held", F.lit(0)) <= 0, "entry_failed").when(F.coalesce("returned", F.lit(0)) <= 0, "exit_failed").otherwise("completed")
    return out.select("order_id", "scenario", status.alias("status"), F.when(status == "completed", F.col("returned") - F.col("amount")).alias("net"))


@query("quote_cross_policies", f"{_OBS}, {_POLICIES}, q0 AS (SELECT pool AS qp, count(*) AS quotes FROM ev WHERE event_id % 2 = 0 GROUP BY pool) SELECT policy, pool, count(*) FILTER ({_BASE} = 'enter') AS entries, any_value(quotes) AS quotes FROM ob, po, q0 WHERE pool = qp GROUP BY policy, pool")
def quote_cross_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quotes(spark, sf_dir).groupBy("pool").agg(F.count("*").alias("quotes"))
    acted = policies.baseline_decisions(observations(spark, sf_dir), ["pool"])
    return acted.groupBy("policy", "pool").agg(F.count_if(F.col("action") == "enter").alias("entries")).join(q, "pool")


@query("baseline_laboratory", f"""RECURSIVE {_OBS}, {_POLICIES}, ac AS (SELECT policy, pool, event_id, event_us, CASE WHEN {_BASE} = 'enter' THEN expected ELSE 0 END AS bps FROM ob, po),
nu AS (SELECT policy, pool, bps, row_number() OVER (PARTITION BY policy, pool ORDER BY event_us, event_id) AS i FROM ac),
fo(policy, pool, i, e) AS (SELECT DISTINCT policy, pool, CAST(0 AS BIGINT), CAST(1000000 AS BIGINT) FROM nu UNION ALL SELECT nu.policy, nu.pool, nu.i, greatest(0, e + {floored('e * bps', '10000')}) FROM fo JOIN nu ON nu.policy = fo.policy AND nu.pool = fo.pool AND nu.i = fo.i + 1),
eq AS (SELECT policy, pool, max(i) AS steps, arg_max(e, i) AS equity FROM fo GROUP BY policy, pool), me AS (SELECT policy, pool, {floored('CAST(sum(bps) AS BIGINT)', 'count(*)')} AS mean_bps, min(bps) AS worst_bps FROM ac GROUP BY policy, pool)
SELECT eq.policy, eq.pool, steps, equity, mean_bps, worst_bps FROM eq JOIN me ON eq.policy = me.policy AND eq.pool = me.pool""")
def baseline_laboratory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each baseline policy's account in each pool over all cases: steps, final equity, mean and worst return."""
    acted = policies.baseline_decisions(observations(spark, sf_dir), ["pool", "event_id", "event_us", "expected"]).withColumn("bps", F.when(F.col("action") == "enter", F.col("expected")).otherwise(0))
    curve = windows.equity_curve(acted, ["policy", "pool"], ["event_us", "event_id"], "bps", 1_000_000)
    last = curve.groupBy("policy", "pool").agg(F.max("step").alias("steps"), F.max_by("equity", "step").alias("equity"))
    return last.join(acted.groupBy("policy", "pool").agg(floor_div(F.sum("bps"), F.count("*")).alias("mean_bps"), F.min("bps").alias("worst_bps")), ["policy", "pool"])


@query("allocate_candidates", f"""ca AS (SELECT event_us // {DAY} AS portfolio, pool AS asset, price AS score, arrival_us AS at_us, event_id, 2000 + (event_us // {DAY}) % 5 * 700 AS cash, 12 + (event_us // {DAY}) % 4 AS slots FROM ev),
ex AS (SELECT DISTINCT event_us // {DAY} + 1 AS portfolio, pool AS asset FROM ev WHERE event_type = 'signup' AND price % 10 = 0), ec AS (SELECT portfolio, count(*) AS n FROM ex GROUP BY 1),
r1 AS (SELECT ca.*, coalesce(ec.n, 0) AS held, ex.asset IS NOT NULL AS own, row_number() OVER (PARTITION BY ca.portfolio, ca.asset ORDER BY score DESC, at_us, event_id) AS a FROM ca LEFT JOIN ec ON ec.portfolio = ca.portfolio LEFT JOIN ex ON ex.portfolio = ca.portfolio AND ex.asset = ca.asset),
r2 AS (SELECT *, sum(CASE WHEN a = 1 AND NOT own THEN 1 ELSE 0 END) OVER (PARTITION BY portfolio ORDER BY score DESC, at_us, event_id) AS p, greatest(0, slots - held) AS free, cash // 200 AS paid FROM r1),
r3 AS (SELECT *, max(CASE WHEN a = 1 AND NOT own AND p <= least(free, paid) THEN 1 ELSE 0 END) OVER (PARTITION BY portfolio, asset) = 1 AS taken FROM r2)
SELECT event_id, CASE WHEN own OR (a > 1 AND taken) THEN 'position_already_open_no_adding' WHEN taken THEN 'accepted' WHEN free <= paid THEN 'max_concurrent_positions' ELSE 'insufficient_simulation_cash' END AS reason FROM r3""")
def allocate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a day compete for its slots and cash, beside the positions that signups of the day before left open."""
    day = F.call_function("div", F.col("event_us"), F.lit(DAY))
    e = raw_events(spark, sf_dir)
    c = e.select(day.alias("portfolio"), F.col("pool").alias("asset"), F.col("price").alias("score"), F.col("arrival_us").alias("at"), "event_id", (2000 + day % 5 * 700).alias("cash"), (12 + day % 4).alias("slots"))
    existing = e.where("event_type = 'signup' and price % 10 = 0").select((day + 1).alias("portfolio"), F.col("pool").alias("asset"))
    return policies.allocate(c, "portfolio", "asset", "score", "at", "event_id", 200, "cash", "slots", existing).select("event_id", "reason")


@query("select_mode", """mo AS (SELECT event_id, m.mode, price * k % 997 AS score, event_id % k <> 0 AS supported, price * k AS cash, m.mode <> 'lp' OR event_id % 5 < 2 AS verified, event_id % 13 = 0 AS allocated FROM ev, (VALUES ('lp', 7), ('spot', 5), ('idle_reserve', 3)) m(mode, k)),
el AS (SELECT *, supported AND cash >= 9000 AS affordable FROM mo),
bm AS (SELECT event_id, min({s: -score, m: mode}) FILTER (affordable AND verified) AS b, bool_or(affordable AND NOT verified) AS blocked, bool_or(allocated) AS allocated FROM el GROUP BY event_id)
SELECT event_id, CASE WHEN allocated OR b IS NULL THEN 'idle' ELSE b.m END AS mode, NOT allocated AS accepted,
 CASE WHEN allocated THEN 'shared_portfolio_already_allocated' WHEN b IS NOT NULL THEN 'highest_registered_score' WHEN blocked THEN 'lp_disabled_until_verified_live_evidence' ELSE 'no_supported_affordable_mode' END AS reason FROM bm""")
def select_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, p = F.col("event_id"), F.col("price")
    modes = F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(k).alias("k")) for m, k in (("lp", 7), ("spot", 5), ("idle_reserve", 3))]))
    rows = raw_events(spark, sf_dir).select("event_id", "price", modes)
    rows = rows.select("event_id", "mode", (p * F.col("k") % 997).alias("score_bps"), (i % F.col("k") != 0).alias("supported"), (p * F.col("k")).alias("available_cash"), (i % 5 < 2).alias("verified"), (i % 13 == 0).alias("allocated"))
    return policies.best_mode(rows, "event_id", F.lit(9000), F.col("allocated"))


@query("shadow_reconcile", f"""dr AS (SELECT pool, CASE WHEN event_id % 4 <> 0 THEN price % 41 - 20 END AS drift, event_type = 'error' AS missed, status = 'quarantined' AND pool % 3 = 0 AS revised, CASE WHEN event_id % 50 = 7 THEN price % 100 - 60 END AS stress FROM ev),
su AS (SELECT pool, count(drift) AS compared, CAST(sum(drift) AS BIGINT) AS total, count(*) FILTER (missed) AS missed, count(*) FILTER (revised) AS revisions, count(stress) AS stresses FROM dr GROUP BY pool)
SELECT pool, compared, CASE WHEN compared > 0 THEN {floored('total', 'compared')} END AS mean_drift_bps, missed, revisions, stresses, CASE WHEN revisions > 0 OR stresses = 0 THEN 'inconclusive' ELSE 'reviewed' END AS state FROM su""")
def shadow_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, p = F.col("event_id"), F.col("price")
    d = raw_events(spark, sf_dir).select(
        "pool", F.when(i % 4 != 0, p % 41 - 20).alias("drift_bps"), (F.col("event_type") == "error").alias("missed"), ((F.col("status") == "quarantined") & (F.col("pool") % 3 == 0)).alias("revised"), F.when(i % 50 == 7, p % 100 - 60).alias("stress_bps"),
    )
    return policies.reconcile_shadow(d, ["pool"])


@query("replay_audit", f"{_QUOTE}, {_fill('fl', _asof('od', 'at_us'), 'amount')}, st AS (SELECT order_id, pool, CASE WHEN quote_id IS NULL THEN 'no_quote' WHEN (spot - output) * 10000 // spot > 120 THEN 'impact_limit' ELSE 'filled' END AS status FROM fl) SELECT pool, count(*) AS orders, count(*) FILTER (status = 'filled') AS filled, string_agg(DISTINCT CASE WHEN status <> 'filled' THEN status END, ',' ORDER BY CASE WHEN status <> 'filled' THEN status END) AS failures, sha256(string_agg(CAST(order_id AS VARCHAR), ',' ORDER BY order_id)) AS order_hash FROM st GROUP BY pool")
def replay_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = quote_as_of_fill(spark, sf_dir).join(_orders(spark, sf_dir).select("order_id", "pool"), "order_id")
    failures = F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("status") != "filled", F.col("status")))))
    hashed = F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("order_id")), lambda x: x.cast("string"))).cast("binary"), 256)
    return f.groupBy("pool").agg(F.count("*").alias("orders"), F.count_if(F.col("status") == "filled").alias("filled"), F.when(failures != "", failures).alias("failures"), hashed.alias("order_hash"))


_FACT = "fc AS (SELECT pool AS study, event_id % 3 AS arch, (event_id // 3) % 2 AS a, (event_id // 6) % 2 AS b FROM ev WHERE event_id % 5 <> 0)"


@query("factorial_review", f"{_FACT}, ce AS (SELECT study, arch, a, b, count(*) AS n FROM fc GROUP BY 1, 2, 3, 4) SELECT study, count(*) AS cells, count(*) FILTER (n > 1) AS repeated, count(*) = 12 AND count(*) FILTER (n > 1) = 0 AS complete FROM ce GROUP BY study")
def factorial_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = raw_events(spark, sf_dir).where("event_id % 5 <> 0").select(F.col("pool").alias("study"), (F.col("event_id") % 3).alias("arch"), F.expr("(event_id div 3) % 2").alias("a"), F.expr("(event_id div 6) % 2").alias("b"))
    return evaluation.grid_complete(cells, ["arch", "a", "b"], ["study"], 12)


#: A flag is verified unless the last event of the pool denies it: its price modulo a small number of the flag's own is 0.
_FLAG = [5, 7, 11, 13, 17, 19, 23, 29, 31]


@query("evidence_gate", f"""la AS (SELECT pool, arg_max(price, {{a: arrival_us, i: event_id}}) AS p, count(*) FILTER (event_type = 'purchase') AS checkpoints, arg_max(event_type, {{a: arrival_us, i: event_id}}) AS kind FROM ev GROUP BY pool),
mi AS (SELECT pool, kind, list_filter([{", ".join(f"CASE WHEN p % {k} = 0 THEN 'missing_{n}_verified' END" for n, k in zip(policies.VERIFIED, _FLAG, strict=True))},
 CASE WHEN p % 9 = 0 THEN 'missing_deployment_evidence' END, CASE WHEN p % 8 = 0 THEN 'unsupported_or_unverified_chain' END, CASE WHEN p % 10 = 0 THEN 'missing_bytecode_evidence' END,
 CASE WHEN pool % 6 = 0 THEN 'missing_live_source_refs' END, CASE WHEN checkpoints = 0 THEN 'missing_observed_position_checkpoint' END], lambda x: x IS NOT NULL) AS missing FROM la)
SELECT pool, array_to_string(missing, ',') AS missing, kind <> 'error' AND len(missing) = 0 AS qualifies, CASE WHEN kind = 'error' THEN 'unavailable' WHEN len(missing) = 0 THEN 'verified' ELSE 'inconclusive' END AS evidence_status FROM mi""")
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = lambda c: F.max_by(c, F.struct("arrival_us", "event_id"))
    g = raw_events(spark, sf_dir).groupBy("pool").agg(last("price").alias("p"), F.count_if(F.col("event_type") == "purchase").alias("checkpoints"), last("event_type").alias("kind"))
    p, pool = F.col("p"), F.col("pool")
    rows = g.select(
        "pool", "checkpoints", *[(p % k != 0).alias(f"{n}_verified") for n, k in zip(policies.VERIFIED, _FLAG, strict=True)], F.when(p % 9 != 0, "deployed").alias("deployment_ref"), F.when(p % 8 == 0, 1).otherwise(7).alias("chain_id"),
        F.when(p % 10 == 0, "").otherwise("code").alias("bytecode_ref"), F.when(pool % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("ref"))).alias("source_refs"), F.when(F.col("kind") != "error", pool).alias("evidence_id"),
    )
    return policies.evidence_gate(rows, chain_id=7).select("pool", F.array_join("missing", ",").alias("missing"), "qualifies", "evidence_status")


@query("tick_availability", f"tk AS (SELECT {START} + i * 21600000000 AS tick_us FROM range(0, 130) t(i)), ne AS (SELECT tick_us, (SELECT count(*) FROM ev WHERE arrival_us <= tick_us) AS cumulative FROM tk) SELECT tick_us, cumulative, cumulative - coalesce(lag(cumulative) OVER (ORDER BY tick_us), 0) AS newly FROM ne")
def tick_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are counted per tick interval first; the running sum then covers ticks only."""
    step = 360 * MINUTE
    tick = -floor_div(-(F.col("arrival_us") - START), step)
    counted = raw_events(spark, sf_dir).groupBy(F.greatest(tick, F.lit(0)).alias("i")).agg(F.count("*").alias("n"))
    ticks = spark.range(0, 130).select(F.col("id").alias("i"))
    order = Window.orderBy("i")
    out = ticks.join(counted, "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("newly"))
    return out.select((START + F.col("i") * step).alias("tick_us"), F.sum("newly").over(order).alias("cumulative"), "newly")
