"""Queries over trades, wallets and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import maps, words
from tidemark.operators import facts, market, windows
from tidemark.plans.bindings import query, raw_events, table, trades

#: 1998-01-01 00:00:00 UTC, 2000-01-01 00:00:00 UTC.
EVENTS_BY, ARRIVED_BY = 883_612_800_000_000, 946_684_800_000_000

#: Lines as trades with maps of amounts in units of 2**64; some come again a day later.
_EVIDENCE = """ln AS (SELECT *, CASE WHEN class = 'genuine' THEN 'genuine_swap' WHEN class = 'transfer' AND quantity % 10 = 0 THEN 'gift_or_airdrop' ELSE class END AS classification,
 cents % 11 <> 0 AND cents % 13 <> 0 AS sound, cents::HUGEINT * 18446744073709551616 AS pay, quantity::HUGEINT * 18446744073709551616 AS qty, CASE WHEN line % 3 = 0 THEN CASE WHEN line = 3 THEN cents ELSE cents // 50 END::HUGEINT * 18446744073709551616 END AS back
 FROM tr QUALIFY row_number() OVER (PARTITION BY tx, line ORDER BY token, wallet, direction, cents, quantity, asset, class, arrival_us, event_us) = 1),
tw AS (SELECT *, 0 AS again FROM ln UNION ALL SELECT * REPLACE (arrival_us + 86400000000 AS arrival_us), 1 FROM ln WHERE line % 4 = 0)"""
_TIMELINE = f"""{_EVIDENCE}, se AS (SELECT * FROM tw WHERE event_us <= {EVENTS_BY} AND arrival_us <= {ARRIVED_BY}),
su AS (SELECT * FROM se WHERE classification = 'genuine_swap' AND sound QUALIFY row_number() OVER (PARTITION BY tx, line ORDER BY arrival_us) = 1),
fl AS (SELECT token, 'token_in' AS flow, '' AS asset, qty AS amount FROM su WHERE direction = 'buy' UNION ALL SELECT token, 'token_out', '', qty FROM su WHERE direction = 'sell'
 UNION ALL SELECT token, 'payment_out', 'q' || asset % 7, pay FROM su WHERE direction = 'buy' UNION ALL SELECT token, 'payment_out', 'q' || asset % 7, -back FROM su WHERE direction = 'buy' AND back IS NOT NULL
 UNION ALL SELECT token, 'quote_in', 'q' || asset % 7, pay FROM su WHERE direction = 'sell'),
fs AS (SELECT token, flow, asset, sum(amount) AS amount FROM fl GROUP BY ALL),
fm AS (SELECT token, max(amount) FILTER (flow = 'token_in') AS token_in, max(amount) FILTER (flow = 'token_out') AS token_out, string_agg(asset || ':' || amount, ',' ORDER BY asset) FILTER (flow = 'payment_out') AS payment_out, string_agg(asset || ':' || amount, ',' ORDER BY asset) FILTER (flow = 'quote_in') AS quote_in FROM fs GROUP BY token),
sd AS (SELECT token, count(*) FILTER (direction = 'buy') AS verified_buys, count(*) FILTER (direction = 'sell') AS verified_sells FROM su GROUP BY token),
ct AS (SELECT token, count(*) AS trade_count, count(*) FILTER (classification = 'ambiguous') AS ambiguous, count(*) FILTER (classification = 'transfer') AS transfers, count(*) FILTER (classification = 'gift_or_airdrop') AS gifts,
 count(*) FILTER (classification = 'genuine_swap' AND NOT sound) AS unverified, max(event_us) AS latest_event, max(arrival_us) AS latest_arrival FROM se GROUP BY token),
tq AS (SELECT ct.token, trade_count, coalesce(verified_buys, 0) AS verified_buys, coalesce(verified_sells, 0) AS verified_sells, CAST(coalesce(token_in, 0) AS VARCHAR) AS token_in, CAST(coalesce(token_out, 0) AS VARCHAR) AS token_out, coalesce(payment_out, '') AS payment_out, coalesce(quote_in, '') AS quote_in,
 ambiguous, transfers, gifts, latest_event, latest_arrival, concat_ws(',', CASE WHEN ambiguous > 0 THEN 'ambiguous_activity_excluded_from_verified_flow' END, CASE WHEN transfers + gifts > 0 THEN 'non_swap_activity_excluded_from_verified_flow' END, CASE WHEN unverified > 0 THEN 'unverified_trade_evidence_excluded_from_verified_flow' END) AS missingness,
 CASE WHEN ambiguous + transfers + gifts + unverified > 0 THEN 'degraded' ELSE 'healthy' END AS quality FROM ct LEFT JOIN fm ON ct.token = fm.token LEFT JOIN sd ON ct.token = sd.token)"""
_METHOD = "evidence-2"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    one = F.row_number().over(Window.partitionBy("tx", "line").orderBy("token", "wallet", "direction", "cents", "quantity", "asset", "class", "arrival_us", "event_us"))
    t = t.withColumn("nth", one).where("nth = 1").drop("nth")
    amount = lambda c: F.concat(F.substring(words.word_from_long(c), 17, 48), F.lit("0" * 16))
    token, quote, buys = F.col("token").cast("string"), F.concat(F.lit("q"), (F.col("asset") % 7).cast("string")), F.col("direction") == "buy"
    paid, got = F.create_map(quote, amount(F.col("cents"))), F.create_map(token, amount(F.col("quantity")))
    back = F.when(F.col("line") == 3, F.col("cents")).otherwise(F.expr("cents div 50"))
    kind = F.when(F.col("class") == "genuine", "genuine_swap").when((F.col("class") == "transfer") & (F.col("quantity") % 10 == 0), "gift_or_airdrop").otherwise(F.col("class"))
    t = t.select(
        (F.col("tx") * 10 + F.col("line")).alias("tx"), "line", F.col("wallet").cast("string").alias("wallet"), token.alias("token"), kind.alias("classification"), F.when(F.col("cents") % 11 == 0, "uncertain").otherwise("verified").alias("route_status"), "direction",
        F.when(F.col("cents") % 13 == 0, "evidence-1").otherwise(_METHOD).alias("method"), "event_us", "arrival_us", F.when(buys, paid).otherwise(got).alias("payments"), F.when(buys, got).otherwise(paid).alias("receipts"),
        F.when(F.col("line") % 3 == 0, F.create_map(quote, amount(back))).alias("refunds"),
    )
    return t.unionByName(t.where("line % 4 = 0").withColumn("arrival_us", F.col("arrival_us") + 86_400_000_000))


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = facts.token_timeline(evidence(spark, sf_dir), EVENTS_BY, ARRIVED_BY, _METHOD)
    return out.withColumn("token", F.col("token").cast("long"))


@query("token_timeline", f"{_TIMELINE} SELECT * FROM tq")
def token_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = {c: words.decimal_text(F.col(c)) for c in ("token_in", "token_out")} | {c: maps.text(F.col(c)) for c in ("payment_out", "quote_in")}
    return _timeline(spark, sf_dir).withColumns(shown | {"missingness": F.array_join("missingness", ",")})


@query("observatory_projection", f"{_TIMELINE}, ex AS (SELECT token, count(*) AS excluded FROM tr WHERE event_us > arrival_us GROUP BY token), u AS (SELECT p_partkey AS token FROM part UNION SELECT token FROM tr) SELECT u.token, coalesce(trade_count, 0) AS trade_count, coalesce(verified_buys, 0) AS verified_buys, coalesce(quality, 'unknown') AS quality, coalesce(excluded, 0) AS excluded FROM u LEFT JOIN tq ON u.token = tq.token LEFT JOIN ex ON u.token = ex.token")
def observatory_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    tokens = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("token")).union(t.select("token")).distinct()
    line = _timeline(spark, sf_dir).select("token", "trade_count", "verified_buys", "quality")
    excluded = market.exclusion_split(t, [("event_after_arrival", F.col("event_us") > F.col("arrival_us"))]).where("reason is not null").groupBy("token").agg(F.count("*").alias("excluded"))
    out = tokens.join(line, "token", "left").join(excluded, "token", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("token", zero("trade_count"), zero("verified_buys"), F.coalesce("quality", F.lit("unknown")).alias("quality"), zero("excluded"))


@query("token_universe", "SELECT p_partkey AS token FROM part UNION SELECT token FROM tr")
def token_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("token")).union(table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_partkey")).distinct()


@query("activity_from_trade", """legs AS (SELECT tx * 10 + line AS tx, 'payment' AS kind, asset, cents AS amount FROM tr UNION ALL SELECT tx * 10 + line, 'receipt', token, quantity * 100 FROM tr UNION ALL SELECT tx * 10 + line, 'refund', asset, CASE WHEN line = 3 THEN cents ELSE cents // 50 END FROM tr)
SELECT tx, asset, CAST(sum(CASE WHEN kind = 'payment' THEN -amount ELSE amount END) AS BIGINT) AS delta FROM legs GROUP BY tx, asset HAVING sum(CASE WHEN kind = 'payment' THEN -amount ELSE amount END) <> 0""")
def activity_from_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    leg = lambda kind, asset, amount: F.struct(F.lit(kind).alias("kind"), F.col(asset).alias("asset"), amount.alias("amount"))
    t = trades(spark, sf_dir).select((F.col("tx") * 10 + F.col("line")).alias("tx"), "line", "asset", "token", "cents", "quantity")
    refund = F.when(F.col("line") == 3, F.col("cents")).otherwise(F.expr("cents div 50"))
    return facts.activity_deltas(t.select("tx", F.array(leg("payment", "asset", F.col("cents")), leg("receipt", "token", F.col("quantity") * 100), leg("refund", "asset", refund)).alias("legs")))


@query("activity_from_lp", "SELECT event_id AS activity_id, pool AS position_id, CASE event_type WHEN 'purchase' THEN 'open' WHEN 'error' THEN 'remove' ELSE 'observe' END AS action, CASE event_type WHEN 'purchase' THEN price WHEN 'error' THEN -price ELSE 0 END AS liquidity_delta, arrival_us FROM ev WHERE status = 'canonical'")
def activity_from_lp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_events(spark, sf_dir).where("status = 'canonical'")
    kind = F.col("event_type")
    return e.select(F.col("event_id").alias("activity_id"), F.col("pool").alias("position_id"), F.when(kind == "purchase", "open").when(kind == "error", "remove").otherwise("observe").alias("action"), F.when(kind == "purchase", F.col("price")).when(kind == "error", -F.col("price")).otherwise(F.lit(0).cast("long")).alias("liquidity_delta"), "arrival_us")


@query("cash_flow_class", "f AS (SELECT tx, line, class <> 'transfer' AS s, cents % 7 <> 0 AS p, quantity % 5 <> 0 AS r, class = 'genuine' AS v, cents - 100000 AS net FROM tr) SELECT tx, line, concat_ws(',', CASE WHEN NOT s THEN 'no_swap' END, CASE WHEN NOT p THEN 'no_payment' END, CASE WHEN NOT r THEN 'no_receipt' END, CASE WHEN NOT v THEN 'route_unverified' END, CASE WHEN net <= 0 THEN 'no_net_outflow' END) AS flags, CASE WHEN s AND p AND r AND v AND net > 0 THEN 'genuine_swap' WHEN r AND NOT p AND NOT s THEN 'gift_or_airdrop' WHEN NOT s AND NOT p THEN 'transfer' ELSE 'ambiguous' END AS cash_class FROM f")
def cash_flow_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = facts.cash_flow_class(trades(spark, sf_dir), F.col("class") != "transfer", F.col("cents") % 7 != 0, F.col("quantity") % 5 != 0, F.col("class") == "genuine", F.col("cents") - 100_000)
    return out.select("tx", "line", F.concat_ws(",", "flags").alias("flags"), "cash_class")


@query("flow_by_asset", "SELECT asset, CAST(sum(CASE WHEN direction = 'sell' THEN cents ELSE 0 END) AS BIGINT) AS net_in, CAST(sum(CASE WHEN direction = 'buy' THEN cents - cents // 20 ELSE 0 END) AS BIGINT) AS net_out FROM tr GROUP BY asset")
def flow_by_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir).withColumn("way", F.when(F.col("direction") == "buy", "out").otherwise("in")).withColumn("refund", F.expr("cents div 20"))
    return facts.flow_by_asset(t, "asset", "way", "cents", "refund")


@query("accounting", "SELECT wallet, asset, CAST(coalesce(sum(d) FILTER (st = 'ok' AND rec), 0) AS BIGINT) AS balance, CAST(coalesce(sum(d) FILTER (st = 'ok' AND NOT rec), 0) AS BIGINT) AS residual, count(*) FILTER (st = 'ok' AND rec) AS lines, count(*) FILTER (st = 'failed') AS failed, count(*) FILTER (st = 'unresolved') AS unresolved FROM (SELECT wallet, asset, CASE WHEN direction = 'buy' THEN -cents ELSE cents END AS d, CASE class WHEN 'genuine' THEN 'ok' WHEN 'ambiguous' THEN 'unresolved' ELSE 'failed' END AS st, quantity % 3 <> 0 AS rec FROM tr) GROUP BY 1, 2")
def accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("class") == "genuine", "ok").when(F.col("class") == "ambiguous", "unresolved").otherwise("failed")
    return facts.accounting(trades(spark, sf_dir), "wallet", "asset", F.when(F.col("direction") == "buy", -F.col("cents")).otherwise(F.col("cents")), status, F.col("quantity") % 3 != 0)


_STEPS = "st AS (SELECT pool, event_id, arrival_us, CASE WHEN event_type IN ('error', 'click') THEN -price * 3 ELSE price END AS d FROM ev WHERE status = 'canonical')"


def position_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_events(spark, sf_dir).where("status = 'canonical'")
    return e.select("pool", "event_id", "arrival_us", F.when(F.col("event_type").isin("error", "click"), -F.col("price") * 3).otherwise(F.col("price")).alias("d"))


#: A sum that is reset at 0 is the running sum less its running minimum, if that is below 0.
_CLAMPED = f"{_STEPS}, ru AS (SELECT pool, d, sum(d) OVER (PARTITION BY pool ORDER BY arrival_us, event_id) AS s, arrival_us, event_id FROM st), cl AS (SELECT pool, CAST(arg_max(s, {{a: arrival_us, e: event_id}}) - least(0, min(s)) AS BIGINT) AS liquidity, min(s) < 0 AS uncertain, count(*) AS steps FROM ru GROUP BY pool)"


@query("wallet_positions", f"{_CLAMPED} SELECT pool, liquidity, uncertain, steps FROM cl")
def wallet_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.clamped_position(position_steps(spark, sf_dir), ["pool"], ["arrival_us", "event_id"], "d")


@query("wallet_observation", f"{_CLAMPED} SELECT count(*) AS positions, CAST(sum(liquidity) AS BIGINT) AS liquidity, count(*) FILTER (uncertain) AS uncertain, CAST(sum(steps) AS BIGINT) AS activities, CASE WHEN count(*) FILTER (uncertain) > 0 THEN 'degraded' ELSE 'healthy' END AS quality, pool % 10 AS wallet FROM cl GROUP BY pool % 10")
def wallet_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = windows.clamped_position(position_steps(spark, sf_dir), ["pool"], ["arrival_us", "event_id"], "d")
    return p.groupBy((F.col("pool") % 10).alias("wallet")).agg(F.count("*").alias("positions"), F.sum("liquidity").alias("liquidity"), F.count_if("uncertain").alias("uncertain"), F.sum("steps").alias("activities"), F.when(F.count_if("uncertain") > 0, "degraded").otherwise("healthy").alias("quality"))
