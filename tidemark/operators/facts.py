"""Trades, cash flows, token timelines and accounting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import maps, words


def activity_deltas(trades: DataFrame, legs: str = "legs") -> DataFrame:
    """(tx, asset, delta): signed asset changes of each trade, zero ones dropped.

    legs is an array of structs (kind, asset, amount): payments count negative, receipts and refunds positive.
    """
    leg = trades.select("tx", F.inline(legs))
    signed = F.when(F.col("kind") == "payment", -F.col("amount")).otherwise(F.col("amount"))
    return leg.groupBy("tx", "asset").agg(F.sum(signed).alias("delta")).where("delta != 0")


def cash_flow_class(trades: DataFrame, has_swap: Column, paid: Column, received: Column, routed: Column, net_out: Column) -> DataFrame:
    """`trades` with cash_class and flags: a genuine swap has a routed swap, payment, receipt and a net outflow; a receipt
    without payment is a gift; neither swap nor payment is a transfer; anything else is ambiguous."""
    flags = F.array_compact(F.array(F.when(~has_swap, "no_swap"), F.when(~paid, "no_payment"), F.when(~received, "no_receipt"), F.when(~routed, "route_unverified"), F.when(net_out <= 0, "no_net_outflow")))
    kind = F.when(F.size(flags) == 0, "genuine_swap").when(received & ~paid & ~has_swap, "gift_or_airdrop").when(~has_swap & ~paid, "transfer").otherwise("ambiguous")
    return trades.withColumn("flags", flags).withColumn("cash_class", kind)


def verified_once(trades: DataFrame, method: str, name: str) -> DataFrame:
    """`trades` with a boolean: a genuine swap with a verified route, a direction and the current method, and of those of its
    (tx, wallet, token) the first to arrive."""
    sure = (F.col("classification") == "genuine_swap") & (F.col("route_status") == "verified") & F.col("direction").isin("buy", "sell") & (F.col("method") == method)
    marked = trades.withColumn("__sure", F.coalesce(sure, F.lit(False)))
    first = Window.partitionBy("tx", "wallet", "token", "__sure").orderBy("arrival_us", "event_us")
    return marked.withColumn(name, F.col("__sure") & (F.row_number().over(first) == 1)).drop("__sure")


def token_timeline(trades: DataFrame, event_cutoff: int, arrival_cutoff: int, method: str, unknown: tuple[str, ...] = ()) -> DataFrame:
    """One row a token at two cutoffs: counts by class, verified amounts of the token, what buyers paid and sellers got by asset,
    latest times, missingness and quality.

    trades(tx, wallet, token, classification, route_status, direction, method, event_us, arrival_us, payments, receipts,
    refunds), the last three maps from assets to words.  token_in and token_out are words, payment_out (refunds taken off)
    and quote_in maps of words, exact at any size.  Only `verified_once` trades count in them; other activity is counted and named
    in `missingness` (array), to which `unknown` adds what the caller doesn't know.
    """
    seen = verified_once(trades.where((F.col("event_us") <= event_cutoff) & (F.col("arrival_us") <= arrival_cutoff)), method, "__verified")
    sure = seen.where("__verified")
    kind = lambda *names: F.count_if(F.col("classification").isin(*names))
    genuine = F.col("classification") == "genuine_swap"
    unsure = genuine & ~((F.col("route_status") == "verified") & F.col("direction").isin("buy", "sell") & (F.col("method") == method))
    counts = seen.groupBy("token").agg(
        F.count("*").alias("trade_count"), kind("ambiguous").alias("ambiguous"), kind("transfer").alias("transfers"), kind("gift_or_airdrop").alias("gifts"), F.count_if(F.coalesce(unsure, genuine)).alias("unverified"),
        F.count_if(F.col("__verified") & (F.col("direction") == "buy")).alias("verified_buys"), F.count_if(F.col("__verified") & (F.col("direction") == "sell")).alias("verified_sells"),
        F.max("event_us").alias("latest_event"), F.max("arrival_us").alias("latest_arrival"),
    )

    def entries(side: str, name: str, sign: Callable[[Column], Column] = lambda word: word) -> Column:
        given = F.map_entries(F.coalesce(side, F.create_map().cast("map<string,string>")))
        return F.transform(given, lambda e: F.struct(F.lit(name).alias("flow"), e["key"].alias("asset"), sign(e["value"]).alias("word")))

    of_token = lambda legs: F.filter(legs, lambda leg: leg["asset"] == F.col("token"))
    bought = F.concat(of_token(entries("receipts", "token_in")), entries("payments", "payment_out"), entries("refunds", "payment_out", words.negated))
    sold = F.concat(of_token(entries("payments", "token_out")), entries("receipts", "quote_in"))
    # One pass over the trades: a row of a leg each.
    legs = sure.select("token", F.inline(F.when(F.col("direction") == "buy", bought).otherwise(sold)))
    totals = maps.asset_sums(legs, ["token", "flow"], "asset", "word")
    whole = lambda name: F.max(F.when(F.col("flow") == name, F.col("total"))).alias(name)
    by_asset = lambda name: maps.to_map("asset", "total", F.col("flow") == name, drop_zero=False).alias(name)
    flows = totals.groupBy("token").agg(whole("token_in"), whole("token_out"), by_asset("payment_out"), by_asset("quote_in"))

    out = counts.join(flows, "token", "left")
    nothing = F.create_map().cast("map<string,string>")
    out = out.withColumns({c: F.coalesce(c, F.lit(maps.ZERO)) for c in ("token_in", "token_out")} | {c: F.coalesce(c, nothing) for c in ("payment_out", "quote_in")})
    missing = F.array_compact(F.array(
        *[F.lit(u) for u in unknown], F.when(F.col("ambiguous") > 0, "ambiguous_activity_excluded_from_verified_flow"), F.when(F.col("transfers") + F.col("gifts") > 0, "non_swap_activity_excluded_from_verified_flow"),
        F.when(F.col("unverified") > 0, "unverified_trade_evidence_excluded_from_verified_flow"),
    ))
    return out.withColumn("missingness", missing).withColumn("quality", F.when(F.size("missingness") > 0, "degraded").otherwise("healthy")).drop("unverified")


def flow_by_asset(legs: DataFrame, asset: str, direction: str, amount: str, refund: str) -> DataFrame:
    """(asset, net_in, net_out): amounts in and out per asset, refunds taken off the outflow."""
    outgoing = F.sum(F.when(F.col(direction) == "out", F.col(amount) - F.col(refund)).otherwise(0))
    return legs.groupBy(asset).agg(F.sum(F.when(F.col(direction) == "in", F.col(amount)).otherwise(0)).alias("net_in"), outgoing.alias("net_out"))


def accounting(rows: DataFrame, wallet: str, asset: str, delta: Column, status: Column, reconciled: Column) -> DataFrame:
    """Per wallet and asset: the balance of reconciled rows, the residual of the others, counts of failed and unresolved rows."""
    good = (status == "ok") & reconciled
    return rows.groupBy(wallet, asset).agg(
        F.coalesce(F.sum(F.when(good, delta)), F.lit(0)).cast("long").alias("balance"), F.coalesce(F.sum(F.when((status == "ok") & ~reconciled, delta)), F.lit(0)).cast("long").alias("residual"),
        F.count_if(good).alias("lines"), F.count_if(status == "failed").alias("failed"), F.count_if(status == "unresolved").alias("unresolved"),
    )
