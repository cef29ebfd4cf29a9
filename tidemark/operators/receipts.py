"""Trades from receipts: routes verified against pools, wallet legs as wide integers, refunds and native value.

All legs are words; sums are exact at any size.  A transaction's pools, transfers and swaps are few, so its arrays are
small; transactions meet their pools and receipts by joins on the transaction and the pool.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import maps, words

#: The name of the native asset and the currency that stands for it in pools.
NATIVE, NO_ADDRESS = "native:eth", "0x" + "0" * 40
#: Flags of routes that can't be supported; with any other flag a route is uncertain.
UNSUPPORTED = ["unsupported_pool_protocol", "swap_issuer_or_event_mismatch", "unsupported_hook_route", "token_not_in_verified_pool_currency"]


def currency(address: Column) -> Column:
    return F.when(F.lower(address) == NO_ADDRESS, NATIVE).otherwise(F.lower(address))


def _listed(values: list[str]) -> Column:
    return F.array(*[F.lit(v.lower()) for v in values]).cast("array<string>")


def verify_routes(receipts: DataFrame, swaps: DataFrame, receipt_logs: DataFrame, pools: DataFrame, quotes: list[str], protocol: str) -> DataFrame:
    """`receipts` (tx, token, ...) with route_status, route_flag, swaps, managers and route_quotes.

    swaps(tx, log_index, pool_id, emitter, event_type, hooked); receipt_logs(tx, log_index) are the swap logs that the receipt
    holds; pools(pool_id, protocol, manager, currency0, currency1).  A pool of another protocol makes the route
    unsupported; else the first swap by log index that fails decides: its pool is unknown (uncertain), its emitter isn't the
    pool's manager or it is no Swap (unsupported), its hook isn't supported (unsupported), its log isn't in the receipt
    (uncertain), the token isn't in the pool (unsupported), the other currency isn't a quote asset (uncertain).
    """
    p = pools.select(F.lower("pool_id").alias("pool_id"), "protocol", F.lower("manager").alias("manager"), currency(F.col("currency0")).alias("c0"), currency(F.col("currency1")).alias("c1"))
    s = swaps.select("tx", "log_index", F.lower("pool_id").alias("pool_id"), F.lower("emitter").alias("emitter"), "event_type", "hooked").join(p, "pool_id", "left")
    failing = lambda *rules: F.coalesce(*[F.when(F.coalesce(rule, F.lit(True)), flag) for rule, flag in rules])
    early = failing(
        (F.col("manager").isNull(), "swap_pool_identity_unavailable"), ((F.col("event_type") != "Swap") | (F.col("emitter") != F.col("manager")), "swap_issuer_or_event_mismatch"),
        (F.coalesce(F.col("hooked"), F.lit(False)), "unsupported_hook_route"),
    )
    foreign = F.coalesce(F.col("protocol") != protocol, F.lit(False))
    swap = F.struct("log_index", "pool_id", early.alias("early"), "manager", "c0", "c1", foreign.alias("foreign"))
    # One row a transaction before the receipts come in, so each input is read and shuffled by transaction once.
    held = receipt_logs.select("tx", F.lit(None).alias("swap"), F.col("log_index").alias("held"))
    rolled = s.select("tx", swap.alias("swap")).unionByName(held, allowMissingColumns=True).groupBy("tx").agg(F.collect_list("swap").alias("__swaps"), F.collect_set("held").alias("__held"))
    out = receipts.join(rolled, "tx", "left")

    token, known = F.lower("token"), _listed(quotes)

    def failure(x: Column) -> Column:
        late = failing(
            (~F.array_contains("__held", x["log_index"]), "swap_log_not_linked_to_receipt"), ((x["c0"] != token) & (x["c1"] != token), "token_not_in_verified_pool_currency"),
            (~F.array_contains(known, F.when(x["c0"] == token, x["c1"]).otherwise(x["c0"])), "quote_asset_not_in_verified_pool_currency"),
        )
        flag = F.coalesce(x["early"], late)
        return F.when(flag.isNotNull(), F.struct(x["log_index"].alias("log_index"), x["pool_id"].alias("pool_id"), flag.alias("flag")))

    sides = F.array_intersect(F.concat("__swaps.c0", "__swaps.c1"), known)
    out = out.withColumns({
        "swaps": F.coalesce(F.size("__swaps"), F.lit(0)).cast("long"), "__first": F.array_min(maps.each(F.col("__swaps"), failure, 1))["flag"], "__foreign": F.array_contains("__swaps.foreign", F.lit(True)),
        "managers": F.array_except("__swaps.manager", F.array(F.lit(None).cast("string"))), "route_quotes": F.when(token.isNotNull(), F.array_except(sides, F.array(token))),
    })
    flag = (
        F.when(F.col("swaps") <= 0, "no_supported_swap_route").when(F.size("managers") == 0, "pool_identity_unavailable")
        .when(F.col("__foreign"), "unsupported_pool_protocol").otherwise(F.col("__first"))
    )
    out = out.withColumn("route_flag", flag)
    status = F.when(F.col("route_flag").isNull(), "verified").when(F.col("route_flag").isin(*UNSUPPORTED), "unsupported").otherwise("uncertain")
    none = F.array().cast("array<string>")
    return out.withColumns({"route_status": status, "swaps": F.greatest("swaps", F.lit(0).cast("long")), "managers": F.coalesce("managers", none), "route_quotes": F.coalesce("route_quotes", none)}).drop("__foreign", "__first", "__swaps", "__held")


#: Kinds of legs as bits; a native payment, which needs refund coverage, has its own.
_KINDS = [
    "token_in", "token_out", "quote_in", "quote_out", "native_out", "native_refund", "unrelated_token_transfer_excluded", "unrelated_quote_transfer_excluded",
    "token_fee_or_route_split_observed", "native_input_outside_verified_pool_currency", "native_refund_not_linked",
]


def _bits(*kinds: str) -> Column:
    return F.lit(sum(1 << _KINDS.index(k) for k in kinds))


def _as_map(legs: str) -> Column:
    """Sorted legs as a map from assets to the sums of their words, in the order of assets."""
    assets = F.array_distinct(f"{legs}.asset")
    total = lambda asset: words.word_sum(F.transform(F.filter(legs, lambda leg: leg["asset"] == asset), lambda leg: leg["amount"]))
    # Mostly an asset has one leg, whose word is the sum.
    return F.when(F.size(assets) == F.size(legs), F.map_from_arrays(f"{legs}.asset", f"{legs}.amount")).otherwise(F.map_from_arrays(assets, F.transform(assets, total)))


def trades_from_receipts(routes: DataFrame, transfers: DataFrame, refunds: DataFrame, actors: list[str]) -> DataFrame:
    """One row a transaction that didn't fail: payments, receipts and refunds as maps of words, direction, class and flags.

    routes: as from `verify_routes`, with wallet, failed, tx_from, tx_to, value (word or null) and refunds_accounted;
    transfers(tx, asset, sender, recipient, amount word) of the receipts' logs; refunds(tx, sender, recipient, amount word) of
    native value.  Legs count between the wallet and route actors (`actors` and the pools' managers) only.  A native payment
    without known refund coverage makes the route uncertain; a refund that isn't from an actor to the wallet is an error.
    A buy gets the token and pays quotes, a sell the other way; what comes back of the paid asset is a refund.
    """
    given = _listed(actors)
    tx = routes.where("not coalesce(failed, false)").withColumns({"wallet": F.lower("wallet"), "token": F.lower("token"), "__actors": F.array_union("managers", given)})
    # The legs of a transaction come together before its route, which is therefore worked out once.
    moved = transfers.select("tx", F.struct(F.lower("asset").alias("asset"), F.lower("sender").alias("sender"), F.lower("recipient").alias("recipient"), "amount", F.lit(False).alias("refund")).alias("leg"))
    back = refunds.select("tx", F.struct(F.lit(NATIVE).alias("asset"), F.lower("sender").alias("sender"), F.lower("recipient").alias("recipient"), "amount", F.lit(True).alias("refund")).alias("leg"))
    out = tx.join(moved.unionByName(back).groupBy("tx").agg(F.collect_list("leg").alias("__moved")), "tx", "left")

    def kind(x: Column) -> Column:
        is_token, is_quote = x["asset"] == F.col("token"), F.array_contains("route_quotes", x["asset"])
        comes, goes = x["recipient"] == F.col("wallet"), x["sender"] == F.col("wallet")
        from_actor, to_actor = F.array_contains("__actors", x["sender"]), F.array_contains("__actors", x["recipient"])
        return (
            F.when(x["refund"], F.when(comes & from_actor, _bits("native_refund")).otherwise(_bits("native_refund_not_linked")))
            .when(comes & is_token, F.when(from_actor, _bits("token_in")).otherwise(_bits("unrelated_token_transfer_excluded")))
            .when(goes & is_token, F.when(to_actor, _bits("token_out")).otherwise(_bits("unrelated_token_transfer_excluded")))
            .when(comes & is_quote, F.when(from_actor, _bits("quote_in")).otherwise(_bits("unrelated_quote_transfer_excluded")))
            .when(goes & is_quote, F.when(to_actor, F.when(x["asset"] == NATIVE, _bits("native_out")).otherwise(_bits("quote_out"))).otherwise(_bits("unrelated_quote_transfer_excluded")))
            .when(is_token & from_actor, _bits("token_fee_or_route_split_observed")).otherwise(F.lit(0))
        )

    native_in = (F.lower("tx_from") == F.col("wallet")) & F.array_contains("__actors", F.lower("tx_to")) & ~words.is_negative(F.col("value")) & (F.col("value") != maps.ZERO)
    native_kind = F.when(F.array_contains("route_quotes", F.lit(NATIVE)), _bits("native_out")).otherwise(_bits("native_input_outside_verified_pool_currency"))
    none = F.array().cast("array<struct<asset:string,amount:string,kind:int>>")
    legs = F.coalesce(maps.each(F.col("__moved"), lambda x: F.struct(x["asset"].alias("asset"), x["amount"].alias("amount"), kind(x).alias("kind")), 3), none)
    value = F.when(native_in, F.array(F.struct(F.lit(NATIVE).alias("asset"), F.col("value").alias("amount"), native_kind.alias("kind")))).otherwise(none)
    out = out.withColumn("legs", F.concat(legs, value)).drop("__moved")

    has = lambda *kinds: reduce(Column.__or__, [F.array_contains("legs.kind", _bits(k)) for k in kinds])
    paid_quote = ("quote_out", "native_out")
    buy = has("token_in") & has(*paid_quote) & ~has("token_out")
    sell = has("token_out") & has("quote_in") & ~has("token_in")
    out = out.withColumn("direction", F.when(buy, "buy").when(sell, "sell").otherwise("unknown"))

    def by(b: tuple[str, ...], s: tuple[str, ...], u: tuple[str, ...]) -> Column:
        return F.when(F.col("direction") == "buy", _bits(*b)).when(F.col("direction") == "sell", _bits(*s)).otherwise(_bits(*u))

    wanted = {
        "payments": by(paid_quote, ("token_out",), (*paid_quote, "token_out")), "receipts": by(("token_in",), ("quote_in",), ("token_in", "quote_in")),
        "refunds": by(("quote_in", "native_refund"), ("token_in", "native_refund"), ("native_refund",)),
    }
    picked = lambda name: F.sort_array(F.filter("legs", lambda x: x["kind"].bitwiseAND(F.col(name)) != 0))
    out = out.withColumns(wanted).withColumns({c: picked(c) for c in wanted}).withColumns({c: _as_map(c) for c in wanted})
    net = F.array_contains(maps.each(F.map_entries("payments"), lambda e: words.is_greater(e["value"], F.coalesce(F.try_element_at("refunds", e["key"]), F.lit(maps.ZERO))), 1), F.lit(True))
    uncovered = has("native_out") & ~F.coalesce("refunds_accounted", F.lit(False))
    out = out.withColumns({"route_status": F.when(uncovered, "uncertain").otherwise(F.col("route_status")), "__net": net})

    swapped, paid, got = F.col("swaps") > 0, F.size("payments") > 0, F.size("receipts") > 0
    genuine = swapped & paid & got & (F.col("route_status") == "verified") & (F.col("direction") != "unknown") & F.col("__net")
    kind = F.when(genuine, "genuine_swap").when(~swapped & got & ~paid, "transfer").otherwise("ambiguous")
    cash = ~genuine & swapped & paid & got
    rules = [
        (F.col("route_flag").isNotNull(), F.col("route_flag")), (uncovered, "native_refund_coverage_unavailable"),
        *[(has(f), f) for f in ("unrelated_token_transfer_excluded", "unrelated_quote_transfer_excluded", "token_fee_or_route_split_observed", "native_input_outside_verified_pool_currency", "native_refund_not_linked")],
        (has("token_in") & has("token_out"), "mixed_wallet_token_direction"), (F.col("swaps") > 1, "multi_hop_route_collapsed_to_one_wallet_purchase"),
        (cash & (F.col("route_status") != "verified"), "route_evidence_unverified"), (cash & (F.col("direction") == "unknown"), "wallet_direction_unresolved"), (cash & ~F.col("__net"), "fully_refunded_or_zero_net_input"),
        (swapped & ~paid, "no_readable_cash_leg"), (swapped & ~paid, "vendor_or_swap_label_is_not_spend"), (~swapped & got & ~paid, "no_swap_payment_evidence"), (~swapped & (paid | ~got), "unsupported_or_unresolved_cash_flow"),
        (swapped & paid & ~got, "unsupported_or_unresolved_cash_flow"), (F.size("refunds") > 0, "refund_observed"),
    ]
    flags = F.array_distinct(F.array_remove(F.array(*[F.coalesce(F.when(rule, name), F.lit("")) for rule, name in rules]), ""))
    quoted = F.map_keys(F.when(F.col("direction") == "sell", F.col("receipts")).otherwise(F.col("payments")))
    wrong = has("native_refund_not_linked")
    return out.select(
        *[c for c in routes.columns if c not in ("route_status", "managers", "route_quotes", "wallet", "token")], "wallet", "token", "route_status", "direction", "payments", "receipts", "refunds", F.when(wrong, "native refund is not linked to the verified route").alias("error"),
        F.when(~wrong, kind).alias("classification"), F.when(F.size(quoted) == 1, F.get(quoted, F.lit(0))).alias("quote_asset"), flags.alias("flags"),
    )
