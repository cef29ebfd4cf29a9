"""Queries of log decoding and wide integers, over logs that Spark encodes from the event and order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import maps, words
from tidemark.operators import decode
from tidemark.operators import receipts as receipts_
from tidemark.plans.bindings import query, raw_events, table, trades

_INIT, _SWAP, _MODIFY = list(decode.POOL_TOPICS)


def _hex(*parts: Column) -> Column:
    return F.concat(F.lit("0x"), *parts)


def _address_word(x: Column) -> Column:
    return words.word_from_long(x)


def pool_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event i as a log: Initialize, Swap, ModifyLiquidity by i modulo 4, else an unknown topic; some malformed."""
    e, i, p = raw_events(spark, sf_dir), F.col("event_id"), F.col("price")
    w = words.word_from_long
    topic = F.when(i % 4 == 0, _INIT).when(i % 4 == 1, _SWAP).when(i % 4 == 2, _MODIFY).otherwise("0x" + "ab" * 32)
    base = [topic, _hex(w(F.col("pool"))), _hex(_address_word(i))]
    topics = F.when(i % 4 == 0, F.array(*base, _hex(_address_word(p)))).otherwise(F.array(*base))
    data = (
        F.when(i % 4 == 0, F.concat(w(p % 3000), w(10 + p % 50), w(F.lit(0)), w(p * 1000), w(p - 4000)))
        .when(i % 4 == 1, F.concat(w(-p), w(p * 2), w(F.when(i % 60 == 1, -p).otherwise(p * 1000)), w(p * 77), w(p - 4000), w(p % 3000)))
        .otherwise(F.concat(w(p - 5000), w(p + 5000), w(F.when(i % 8 == 2, -p).otherwise(p)), w(i)))
    )
    return e.select("event_id", F.lit("0xPool").alias("address"), topics.alias("topics"), _hex(F.when(i % 36 == 4, F.concat(data, F.lit("0"))).otherwise(data)).alias("data"))


@query("decode_pool_logs", """dk AS (SELECT event_id, price, pool, CASE event_id % 4 WHEN 0 THEN 'Initialize' WHEN 1 THEN 'Swap' WHEN 2 THEN 'ModifyLiquidity' END AS event_type,
CASE WHEN event_id % 4 = 3 THEN 'unsupported_topic' WHEN event_id % 36 = 4 THEN 'malformed_log' WHEN event_id % 60 = 1 AND price > 0 THEN 'value_out_of_range' END AS error FROM ev)
SELECT event_id, event_type, error, CASE WHEN error IS NULL THEN '0x' || lpad(printf('%x', pool), 64, '0') END AS pool_id,
CASE WHEN error IS NULL AND event_type <> 'ModifyLiquidity' THEN price % 3000 END AS fee, CASE WHEN error IS NULL AND event_type = 'Initialize' THEN 10 + price % 50 END AS tick_spacing,
CASE WHEN error IS NULL AND event_type <> 'ModifyLiquidity' THEN price - 4000 END AS tick, CASE WHEN error IS NULL AND event_type = 'Swap' THEN -price END AS amount0, CASE WHEN error IS NULL AND event_type = 'Swap' THEN price * 2 END AS amount1,
CASE WHEN error IS NULL AND event_type = 'Swap' THEN price * 77 END AS liquidity, CASE WHEN error IS NULL AND event_type = 'ModifyLiquidity' THEN price - 5000 END AS tick_lower, CASE WHEN error IS NULL AND event_type = 'ModifyLiquidity' THEN price + 5000 END AS tick_upper,
CASE WHEN error IS NULL AND event_type = 'ModifyLiquidity' THEN CASE WHEN event_id % 8 = 2 THEN -price ELSE price END END AS liquidity_delta FROM dk""")
def decode_pool_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decode.decode_pool_logs(pool_logs(spark, sf_dir))
    n = lambda c: words.to_long(F.col(c)).alias(c)
    return d.select("event_id", "event_type", "error", "pool_id", "fee", "tick_spacing", "tick", n("amount0"), n("amount1"), n("liquidity"), "tick_lower", "tick_upper", n("liquidity_delta"))


@query("decode_launch_logs", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'TokenLaunched' WHEN 1 THEN 'LaunchSwept' WHEN 2 THEN 'TokensLocked' WHEN 3 THEN 'PoolGraduated' END AS event_type, CASE WHEN event_id % 5 = 4 THEN 'unsupported_topic' WHEN event_id % 35 = 6 THEN 'malformed_log' END AS error,
CASE WHEN event_id % 5 <> 4 AND event_id % 35 <> 6 THEN '0x' || lpad(printf('%x', pool), 40, '0') END AS token, CASE WHEN event_id % 5 <> 4 AND event_id % 35 <> 6 THEN CASE event_id % 5 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 3 END END AS n_amounts,
CASE WHEN event_id % 5 <> 4 AND event_id % 35 <> 6 THEN price END AS last_amount FROM ev""")
def decode_launch_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i, w = raw_events(spark, sf_dir), F.col("event_id"), words.word_from_long
    names = list(decode.LAUNCH_TOPICS)
    topic = F.when(i % 5 == 0, names[0]).when(i % 5 == 1, names[1]).when(i % 5 == 2, names[2]).when(i % 5 == 3, names[3]).otherwise("0x" + "cd" * 32)
    base = [topic, _hex(w(F.col("pool")))]
    topics = F.when(i % 5 == 0, F.array(*base, _hex(w(i)), _hex(w(i + 1)))).otherwise(F.array(*base))
    p = w(F.col("price"))
    data = F.when(i % 5 == 1, F.concat(w(i), p)).when(i % 5 == 2, p).otherwise(F.concat(w(i), w(i + 1), p))
    logs = e.select("event_id", F.lit("0xFactory").alias("address"), topics.alias("topics"), _hex(F.when(i % 35 == 6, F.concat(data, data)).otherwise(data)).alias("data"))
    d = decode.decode_launch_logs(logs)
    return d.select("event_id", "event_type", "error", "token", F.when(F.col("error").isNull(), F.size("amounts")).alias("n_amounts"), words.to_long(F.element_at("amounts", -1)).alias("last_amount"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt an order: each line moves its part to or from the customer against its price in the supplier's asset."""
    t, w = trades(spark, sf_dir), words.word_from_long
    # Lines travel as numbers; their logs are written once they are together.
    lines = t.groupBy("tx", "wallet").agg(F.collect_list(F.struct("line", "token", "asset", "direction", "quantity", "cents")).alias("lines"), F.min("token").alias("token"))
    wallet = _hex(w(F.col("wallet")))
    log = lambda asset, sender, to, amount: F.struct(asset.alias("address"), F.array(F.lit(decode.TRANSFER_TOPIC), sender, to).alias("topics"), _hex(w(amount)).alias("data"))

    def logs(x: Column) -> Column:
        market, buy = _hex(w(x["asset"] + 1_000_000)), x["direction"] == "buy"
        payer, payee = F.when(buy, wallet).otherwise(market), F.when(buy, market).otherwise(wallet)
        one = F.array(log(F.concat(F.lit("0xT"), x["token"].cast("string")), payee, payer, x["quantity"]), log(F.lit("0xQ"), payer, payee, x["cents"]))
        return F.struct(x["line"].alias("line"), x["token"].alias("token"), one.alias("one"))

    return lines.select("tx", "wallet", F.flatten(F.transform(F.array_sort(F.transform("lines", logs)), lambda x: x["one"])).alias("logs"), "token")


def _transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.decode_transfers(receipts(spark, sf_dir)).withColumn("amount", words.to_long(F.col("amount")))


_TF = "tf AS (SELECT tx, '0xt' || token AS asset, CASE WHEN direction = 'buy' THEN asset + 1000000 ELSE wallet END AS sender, CASE WHEN direction = 'buy' THEN wallet ELSE asset + 1000000 END AS recipient, quantity AS amount FROM tr UNION ALL SELECT tx, '0xq', CASE WHEN direction = 'buy' THEN wallet ELSE asset + 1000000 END, CASE WHEN direction = 'buy' THEN asset + 1000000 ELSE wallet END, cents FROM tr)"


@query("decode_transfers", f"{_TF} SELECT tx, asset, '0x' || lpad(printf('%x', sender), 40, '0') AS sender, '0x' || lpad(printf('%x', recipient), 40, '0') AS recipient, amount FROM tf")
def decode_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transfers(spark, sf_dir).select("tx", "asset", "sender", "recipient", "amount")


#: Receipts by line: a wallet trades a part against the quote of its pool; amounts are multiples of 2**64.
_QUOTES = ["0xq1", "0xq2", "0xq3", receipts_.NATIVE]
_RX = """tx AS (SELECT tx * 10 + line AS tx, line, token, '0x' || lpad(printf('%x', wallet), 40, '0') AS wallet, '0x' || lpad(printf('%x', 1000000 + token % 50), 40, '0') AS manager, '0xt' || token AS part,
 CASE WHEN token % 5 = 0 THEN 'native:eth' ELSE '0xq' || token % 5 END AS quote, direction = 'buy' AS buys, cents, cents::HUGEINT * 18446744073709551616 AS pay, quantity::HUGEINT * 18446744073709551616 AS qty, quantity, cents % 53 = 0 AS failed FROM tr QUALIFY row_number() OVER (PARTITION BY tx, line ORDER BY token, wallet, direction, cents, quantity) = 1),
sw AS (SELECT tx.*, CASE WHEN token % 41 = 0 THEN 'pool_identity_unavailable' WHEN token % 31 = 0 THEN 'unsupported_pool_protocol' WHEN cents % 19 = 0 THEN 'swap_issuer_or_event_mismatch' WHEN token % 23 = 0 THEN 'unsupported_hook_route'
  WHEN cents % 29 = 0 THEN 'swap_log_not_linked_to_receipt' WHEN token % 37 = 0 THEN 'token_not_in_verified_pool_currency' WHEN token % 5 = 4 THEN 'quote_asset_not_in_verified_pool_currency' END AS broken FROM tx),
rt AS (SELECT *, cents % 17 <> 0 AS swapped, CASE WHEN cents % 17 = 0 THEN 'no_supported_swap_route' ELSE broken END AS route_flag,
 CASE WHEN cents % 17 = 0 THEN 'uncertain' WHEN broken IS NULL THEN 'verified' WHEN broken IN ('unsupported_pool_protocol', 'swap_issuer_or_event_mismatch', 'unsupported_hook_route', 'token_not_in_verified_pool_currency') THEN 'unsupported' ELSE 'uncertain' END AS route_status,
 cents % 17 <> 0 AND token % 41 <> 0 AS actor, cents % 17 <> 0 AND token % 41 <> 0 AND token % 5 <> 4 AS quoted FROM sw)"""


def _address(x: Column) -> Column:
    return F.concat(F.lit("0x"), F.substring(words.word_from_long(x), 25, 40))


def _tokens(x: Column) -> Column:
    """The word of a bigint times 2**64."""
    return F.concat(F.substring(words.word_from_long(x), 17, 48), F.lit("0" * 16))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, token = trades(spark, sf_dir), F.col("token")
    # Lines can share order and number; one of them is the transaction.
    one = F.row_number().over(Window.partitionBy("tx", "line").orderBy("token", "wallet", "direction", "cents", "quantity"))
    t = t.withColumn("nth", one).where("nth = 1")
    quote = F.when(token % 5 == 0, receipts_.NATIVE).otherwise(F.concat(F.lit("0xq"), (token % 5).cast("string")))
    return t.select(
        (F.col("tx") * 10 + F.col("line")).alias("tx"), "line", token.alias("part"), _address(F.col("wallet")).alias("wallet"), _address(1_000_000 + token % 50).alias("manager"), F.concat(F.lit("0xt"), token.cast("string")).alias("token"),
        quote.alias("quote"), (F.col("direction") == "buy").alias("buys"), "cents", "quantity", (F.col("cents") % 53 == 0).alias("failed"),
    )


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines' transactions with their routes: pools, swaps and receipts with faults of every kind."""
    x = _lines(spark, sf_dir)
    native = (F.col("quote") == receipts_.NATIVE) & F.col("buys")
    tx = x.select("tx", "line", "wallet", "token", "failed", F.col("wallet").alias("tx_from"), F.col("manager").alias("tx_to"), F.when(native, _tokens(F.col("cents"))).otherwise("0" * 64).alias("value"), (F.col("line") % 2 == 0).alias("refunds_accounted"))
    swaps = x.where("cents % 17 <> 0").select("tx", F.lit(2).alias("log_index"), F.concat(F.lit("p"), F.col("part").cast("string")).alias("pool_id"), F.when(F.col("cents") % 19 == 0, "0xother").otherwise(F.col("manager")).alias("emitter"), F.lit("Swap").alias("event_type"), (F.col("part") % 23 == 0).alias("hooked"), "cents")
    logs = swaps.where("cents % 29 <> 0").select("tx", "log_index")
    part = F.col("p_partkey")
    other = F.when(part % 5 == 0, receipts_.NO_ADDRESS).otherwise(F.concat(F.lit("0xQ"), (part % 5).cast("string")))
    pools = table(spark, sf_dir, "part").where("p_partkey % 41 <> 0").select(
        F.concat(F.lit("p"), part.cast("string")).alias("pool_id"), F.when(part % 31 == 0, "v3").otherwise("v4").alias("protocol"), _address(1_000_000 + part % 50).alias("manager"), F.when(part % 37 == 0, "0xnone").otherwise(F.concat(F.lit("0xT"), part.cast("string"))).alias("currency0"), other.alias("currency1"),
    )
    return receipts_.verify_routes(tx, swaps.drop("cents"), logs, pools, _QUOTES, "v4")


@query("route_verify_join", f"{_RX} SELECT tx, route_status, route_flag, swapped::BIGINT AS swaps FROM rt")
def route_verify_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routes(spark, sf_dir).select("tx", "route_status", "route_flag", "swaps")


def _receipt_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _lines(spark, sf_dir)
    wallet, manager, buys, other = F.col("wallet"), F.col("manager"), F.col("buys"), F.lit("0x" + "9" * 40)
    payer, payee = F.when(buys, wallet).otherwise(manager), F.when(buys, manager).otherwise(wallet)
    coin = F.col("quote") != receipts_.NATIVE
    back = F.when(F.col("line") == 3, F.col("cents")).otherwise(F.expr("cents div 50"))
    # The logs of a line, one a row: what it costs, what it moves, what comes back, a gift.
    there = F.array(F.when(coin, F.lit(0)), F.lit(1), F.when(coin & buys & (F.col("line") % 3 == 0), F.lit(2)), F.when(F.col("quantity") % 7 == 0, F.lit(3)))
    one, nth = x.select("*", F.explode_outer(there).alias("log")).where("log is not null"), F.col("log")
    word_address = lambda c: F.concat(F.lit("0x" + "0" * 24), F.substring(c, 3, 40))
    asset = F.when(nth % 2 == 0, F.upper(F.substring("quote", 3, 9))).otherwise(F.col("token"))
    sender = F.when(nth == 0, payer).when(nth == 1, payee).when(nth == 2, manager).otherwise(other)
    recipient = F.when(nth == 0, payee).when(nth == 1, payer).otherwise(wallet)
    amount = F.when(nth == 0, F.col("cents")).when(nth == 1, F.col("quantity")).when(nth == 2, back).otherwise(F.lit(5).cast("long"))
    log = F.struct(asset.alias("address"), F.array(F.lit(decode.TRANSFER_TOPIC), word_address(sender), word_address(recipient)).alias("topics"), F.concat(F.lit("0x"), _tokens(amount)).alias("data"))
    found = decode.decode_transfers(one.select("tx", F.array(log).alias("logs"))).withColumn("asset", F.when(F.startswith("asset", F.lit("q")), F.concat(F.lit("0x"), F.col("asset"))).otherwise(F.col("asset")))
    refunds = x.where(~coin & buys & (F.col("line") % 4 == 0)).select("tx", F.when(F.col("cents") % 13 == 0, other).otherwise(manager).alias("sender"), F.col("wallet").alias("recipient"), _tokens(F.expr("cents div 50")).alias("amount"))
    return receipts_.trades_from_receipts(_routes(spark, sf_dir), found, refunds, [])


@query("trade_from_receipt", f"""{_RX}, lg AS (SELECT *, buys AND quote = 'native:eth' AND actor AS sends_native, CASE WHEN line = 3 THEN cents ELSE cents // 50 END::HUGEINT * 18446744073709551616 AS coin_back, (cents // 50)::HUGEINT * 18446744073709551616 AS native_back,
  quote <> 'native:eth' AND quoted AS coin, actor AND quote <> 'native:eth' AND quoted AND buys AND line % 3 = 0 AS coin_refund, quote = 'native:eth' AND buys AND line % 4 = 0 AS native_refund FROM rt WHERE NOT failed),
fl AS (SELECT *, native_refund AND (NOT actor OR cents % 13 = 0) AS unlinked, actor AND buys AS token_in, actor AND NOT buys AS token_out, CASE WHEN buys THEN coin OR sends_native AND quoted ELSE false END AS quote_out, (NOT buys AND coin) OR coin_refund AS quote_in FROM lg),
di AS (SELECT *, native_refund AND NOT unlinked AS refunded, CASE WHEN token_in AND quote_out THEN 'buy' WHEN token_out AND quote_in THEN 'sell' ELSE 'unknown' END AS direction,
  buys AND sends_native AND quoted AND line % 2 <> 0 AS uncovered FROM fl),
am AS (SELECT *, CASE WHEN uncovered THEN 'uncertain' ELSE route_status END AS status,
  CASE direction WHEN 'buy' THEN quote || ':' || pay WHEN 'sell' THEN part || ':' || qty ELSE concat_ws(',', CASE WHEN quote_out THEN quote || ':' || pay END, CASE WHEN token_out THEN part || ':' || qty END) END AS payments,
  CASE direction WHEN 'buy' THEN part || ':' || qty WHEN 'sell' THEN quote || ':' || pay ELSE concat_ws(',', CASE WHEN quote_in THEN quote || ':' || CASE WHEN buys THEN coin_back ELSE pay END END, CASE WHEN token_in THEN part || ':' || qty END) END AS receipts,
  concat_ws(',', CASE WHEN direction = 'buy' AND coin_refund THEN quote || ':' || coin_back END, CASE WHEN refunded THEN 'native:eth:' || native_back END) AS refunds,
  CASE direction WHEN 'sell' THEN true WHEN 'buy' THEN pay > CASE WHEN coin_refund THEN coin_back WHEN refunded THEN native_back ELSE 0 END ELSE quote_out AND pay > CASE WHEN refunded THEN native_back ELSE 0 END OR token_out END AS net FROM di),
cl AS (SELECT *, payments <> '' AS paid, receipts <> '' AS got, swapped AND payments <> '' AND receipts <> '' AND status = 'verified' AND direction <> 'unknown' AND net AS genuine FROM am)
SELECT tx, direction, status AS route_status, payments, receipts, refunds, CASE WHEN unlinked THEN 'native refund is not linked to the verified route' END AS error,
 CASE WHEN unlinked THEN NULL WHEN genuine THEN 'genuine_swap' WHEN NOT swapped AND got AND NOT paid THEN 'transfer' ELSE 'ambiguous' END AS classification,
 concat_ws(',', route_flag, CASE WHEN uncovered THEN 'native_refund_coverage_unavailable' END, CASE WHEN quantity % 7 = 0 OR NOT actor THEN 'unrelated_token_transfer_excluded' END, CASE WHEN sends_native AND NOT quoted THEN 'native_input_outside_verified_pool_currency' END,
  CASE WHEN unlinked THEN 'native_refund_not_linked' END, CASE WHEN swapped AND paid AND got AND NOT genuine AND status <> 'verified' THEN 'route_evidence_unverified' END, CASE WHEN swapped AND paid AND got AND NOT genuine AND direction = 'unknown' THEN 'wallet_direction_unresolved' END,
  CASE WHEN swapped AND paid AND got AND NOT genuine AND NOT net THEN 'fully_refunded_or_zero_net_input' END, CASE WHEN swapped AND NOT paid THEN 'no_readable_cash_leg,vendor_or_swap_label_is_not_spend' END, CASE WHEN NOT swapped AND got AND NOT paid THEN 'no_swap_payment_evidence' END,
  CASE WHEN (NOT swapped AND (paid OR NOT got)) OR (swapped AND paid AND NOT got) THEN 'unsupported_or_unresolved_cash_flow' END, CASE WHEN refunds <> '' THEN 'refund_observed' END) AS flags FROM cl""")
def trade_from_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _receipt_trades(spark, sf_dir)
    return t.select("tx", "direction", "route_status", *[maps.text(F.col(c)).alias(c) for c in ("payments", "receipts", "refunds")], "error", "classification", F.array_join("flags", ",").alias("flags"))


@query("wide_sums", "SELECT pool, lower(lpad(printf('%x', CAST(sum(price * 1000000) AS BIGINT)), 64, '0')) AS total, count(*) AS n, max(CASE WHEN price = 0 THEN 0 ELSE CAST(floor(log2(price)) AS INTEGER) + 1 END) AS bits FROM ev GROUP BY pool")
def wide_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_events(spark, sf_dir).select("pool", words.word_from_long(F.col("price") * 1_000_000).alias("w"), words.bit_length(words.word_from_long(F.col("price"))).alias("b"))
    parts = e.groupBy("pool").agg(*words.limb_sums(F.col("w")), F.count("*").alias("n"), F.max("b").alias("bits"))
    return parts.select("pool", words.carry(F.array(*[F.col(f"limb{i}") for i in range(words.LIMBS)])).alias("total"), "n", "bits")


@query("price_return_bps", "lg AS (SELECT event_id, price + 1000 AS s1, lag(price + 1000) OVER (PARTITION BY pool ORDER BY event_us) AS s0 FROM ev) SELECT event_id, CAST(((s0 * s0 - s1 * s1) * 10000 - ((((s0 * s0 - s1 * s1) * 10000) % (s1 * s1)) + s1 * s1) % (s1 * s1)) // (s1 * s1) AS BIGINT) AS return_bps FROM lg WHERE s0 IS NOT NULL")
def price_return_bps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_events(spark, sf_dir).withColumn("s1", words.word_from_long(F.col("price") + 1000))
    e = e.withColumn("s0", F.lag("s1").over(Window.partitionBy("pool").orderBy("event_us"))).where("s0 is not null")
    return e.select("event_id", words.price_return_bps("s0", "s1").alias("return_bps"))


@query("tick_price_dim")
def tick_price_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of every tick there is, with the number of events at it."""
    seen = raw_events(spark, sf_dir).groupBy((F.col("price") - 4000).cast("long").alias("tick")).agg(F.count("*").alias("events"))
    ticks = spark.range(words.MIN_TICK, words.MAX_TICK + 1).select(F.col("id").alias("tick"))
    priced = ticks.select(F.col("tick").cast("int").alias("tick"), words.sqrt_price_of_tick("tick").alias("sqrt_price_x96"))
    return priced.join(seen, "tick", "left").select(F.col("tick").cast("int").alias("tick"), "sqrt_price_x96", F.coalesce("events", F.lit(0)).alias("events"))


@query("liquidity_amounts")
def liquidity_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of a position at the exact prices, and by the linear model of ticks as counterfactual."""
    tick = (F.col("price") - 4000).cast("int")
    e = raw_events(spark, sf_dir).select("event_id", (F.col("price") * 1_000_000).alias("l"), tick.alias("tick"), (tick / 2 - 600).cast("int").alias("low"), (tick / 2 + 600).cast("int").alias("high"))
    at = F.least(F.greatest("tick", "low"), F.col("high"))
    rows = e.select("event_id", words.word_from_long(F.col("l")).alias("liquidity"), *[words.sqrt_price_of_tick(c).alias(n) for c, n in (("tick", "p"), ("low", "a"), ("high", "b"))], (F.col("l") * (F.col("high") - at)).alias("linear0"), (F.col("l") * (at - F.col("low"))).alias("linear1"))
    return rows.select("event_id", words.liquidity_amounts("liquidity", "p", "a", "b").alias("x"), "linear0", "linear1").select("event_id", "x.*", "linear0", "linear1")


@query("fee_growth_inside", """fg AS (SELECT event_id, event_id % 40 - 20 AS tick, price * 7 AS everywhere, price AS below, price * 2 AS above FROM ev),
gr AS (SELECT event_id, tick, CASE WHEN tick < -10 THEN below - above WHEN tick < 10 THEN everywhere - below - above ELSE above - below END AS g FROM fg)
SELECT event_id, tick, CASE WHEN g >= 0 THEN lpad(printf('%x', g), 64, '0') ELSE repeat('f', 48) || printf('%x', CAST(g AS BIGINT)) END AS growth FROM gr""")
def fee_growth_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth inside the range from tick -10 to 10, for prices below, inside and above it, modulo 2**256."""
    w, p = words.word_from_long, F.col("price")
    e = raw_events(spark, sf_dir).withColumn("tick", F.col("event_id") % 40 - 20)
    return e.select("event_id", "tick", words.growth_inside(F.col("tick"), F.lit(-10), F.lit(10), w(p * 7), w(p), w(p * 2)).alias("growth"))


@query("fee_accrual", "SELECT event_id, CAST(price * 11 AS VARCHAR) AS owed0, CAST((price * 3 + 7) * 11 AS VARCHAR) AS owed1 FROM ev")
def fee_accrual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fees owed on both sides by a liquidity of 11 since the last checkpoint; the growth of the second side has wrapped."""
    w, p = words.word_from_long, F.col("price")
    shifted = lambda x: F.concat(F.substring(w(x), 33, 32), F.lit("0" * 32))
    since = lambda now, last: words.modular_difference(shifted(now), shifted(last))
    owed = lambda growth: words.fees_owed(growth, w(F.lit(11)))
    return raw_events(spark, sf_dir).select("event_id", owed(since(p * 5, p * 4)).alias("owed0"), owed(since(p, -2 * p - 7)).alias("owed1"))
