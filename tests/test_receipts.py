"""Wide integers as text, maps of assets, routes, receipt trades and token timelines on rows written by hand."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.functions import maps, words
from tidemark.operators import decode, facts
from tidemark.operators import receipts as r

WALLET, MANAGER, TOKEN, QUOTE, OTHER = "0xW", "0xM", "0xT", "0xQ", "0xO"
E18 = 10**18


def word(value: int) -> str:
    return f"{value % (1 << 256):064x}"


def test_text_and_words(spark):
    rng = random.Random(1)
    values = [0, 1, -1, 2**63, -(2**63), 10**38 - 1, -(10**38) + 1, 2**255 - 1, -(2**255), *[rng.randrange(-(2**255), 2**255) >> rng.randrange(250) for _ in range(60)]]
    df = spark.createDataFrame([(str(v), word(v)) for v in values], "t string, w string")
    for row in df.select("t", "w", words.word_from_text(F.col("t")).alias("w2"), words.decimal_text(F.col("w")).alias("t2"), words.decimal_text(words.negated(F.col("w"))).alias("n")).collect():
        assert (row.w2, row.t2) == (row.w, row.t)
        assert row.n == str(-int(row.t)) or int(row.t) == -(2**255)
    bad = spark.createDataFrame([("",), ("+1",), ("01",), ("1.0",), (None,), ("-0",)], "t string").select(words.word_from_text(F.col("t")).alias("w")).collect()
    assert [b.w for b in bad] == [None] * 6


def test_merged_maps(spark):
    rows = [("a", {"x": word(2**200), "y": word(5)}), ("a", {"x": word(-(2**200) + 7), "y": word(-5)}), ("a", None), ("b", {}), ("c", {"z": word(-3)})]
    df = spark.createDataFrame(rows, "k string, m map<string,string>")
    out = {x.k: x.m for x in maps.merged(df, ["k"], "m").select("k", maps.decimals(F.col("m")).alias("m")).collect()}
    assert out == {"a": {"x": "7"}, "b": {}, "c": {"z": "-3"}}
    assert maps.merged(df, ["k"], "m", drop_zero=False).where("k = 'a'").select(maps.text(F.col("m")).alias("t")).first().t == "x:7,y:0"


POOL = ("P", "v4", MANAGER, TOKEN, QUOTE)
NATIVE_POOL = ("P", "v4", MANAGER, r.NO_ADDRESS, TOKEN)
SWAP = (1, 3, "p", "0xm", "Swap", False)


def routed(spark, pools=(POOL,), swaps=(SWAP,), logs=((1, 3),), quotes=(QUOTE, "native:ETH"), **tx):
    own = {"failed": False, "tx_from": WALLET, "tx_to": OTHER, "value": word(0), "refunds_accounted": False} | tx
    receipts = spark.createDataFrame([(1, WALLET, TOKEN, *own.values())], "tx int, wallet string, token string, failed boolean, tx_from string, tx_to string, value string, refunds_accounted boolean")
    return r.verify_routes(
        receipts, spark.createDataFrame(list(swaps), "tx int, log_index int, pool_id string, emitter string, event_type string, hooked boolean"), spark.createDataFrame(list(logs), "tx int, log_index int"),
        spark.createDataFrame(list(pools), "pool_id string, protocol string, manager string, currency0 string, currency1 string"), list(quotes), "v4",
    )


def traded(spark, transfers, refunds=(), **how):
    t = spark.createDataFrame([(1, a, s, d, word(n)) for a, s, d, n in transfers], "tx int, asset string, sender string, recipient string, amount string")
    back = spark.createDataFrame([(1, s, d, word(n)) for s, d, n in refunds], "tx int, sender string, recipient string, amount string")
    out = r.trades_from_receipts(routed(spark, **how), t, back, [])
    return out.withColumns({c: maps.decimals(F.col(c)) for c in ("payments", "receipts", "refunds")}).collect()


#: Pools, swaps (log index, pool, emitter, kind, hook) and swap logs of a receipt each, and its route.
ROUTES = [
    ([POOL], [SWAP], [3], ("verified", None)),
    ([POOL], [], [3], ("uncertain", "no_supported_swap_route")),
    ([], [SWAP], [3], ("uncertain", "pool_identity_unavailable")),
    ([("P", "v3", MANAGER, TOKEN, QUOTE)], [SWAP], [3], ("unsupported", "unsupported_pool_protocol")),
    ([POOL], [SWAP, (1, 2, "other", "0xm", "Swap", False)], [2, 3], ("uncertain", "swap_pool_identity_unavailable")),
    ([POOL], [(1, 3, "p", "0xforged", "Swap", False)], [3], ("unsupported", "swap_issuer_or_event_mismatch")),
    ([POOL], [(1, 3, "p", "0xm", "Initialize", False)], [3], ("unsupported", "swap_issuer_or_event_mismatch")),
    ([POOL], [(1, 3, "p", "0xm", "Swap", True)], [3], ("unsupported", "unsupported_hook_route")),
    ([POOL], [SWAP], [4], ("uncertain", "swap_log_not_linked_to_receipt")),
    ([("P", "v4", MANAGER, OTHER, QUOTE)], [SWAP], [3], ("unsupported", "token_not_in_verified_pool_currency")),
    ([("P", "v4", MANAGER, TOKEN, OTHER)], [SWAP], [3], ("uncertain", "quote_asset_not_in_verified_pool_currency")),
    # The first failing swap by log index decides.
    ([POOL], [(1, 5, "p", "0xforged", "Swap", False), (1, 3, "p", "0xm", "Swap", True)], [3, 5], ("unsupported", "unsupported_hook_route")),
]


def test_routes(spark):
    number = range(len(ROUTES))
    receipts = spark.createDataFrame([(i, WALLET, TOKEN) for i in number], "tx int, wallet string, token string")
    swaps = [(i, s[1], f"{s[2]}{i}", *s[3:]) for i in number for s in ROUTES[i][1]]
    pools = [(f"{p[0]}{i}", *p[1:]) for i in number for p in ROUTES[i][0]]
    out = r.verify_routes(
        receipts, spark.createDataFrame(swaps, "tx int, log_index int, pool_id string, emitter string, event_type string, hooked boolean"), spark.createDataFrame([(i, k) for i in number for k in ROUTES[i][2]], "tx int, log_index int"),
        spark.createDataFrame(pools, "pool_id string, protocol string, manager string, currency0 string, currency1 string"), [QUOTE], "v4",
    ).collect()
    assert {x.tx: (x.route_status, x.route_flag) for x in out} == {i: ROUTES[i][3] for i in number}


def test_buy_with_amounts_beyond_64_bits(spark):
    (row,) = traded(spark, [(QUOTE, WALLET, MANAGER, 50 * E18), (TOKEN, MANAGER, WALLET, 10**30), (QUOTE, MANAGER, WALLET, 2 * E18)])
    assert row.direction == "buy" and row.classification == "genuine_swap" and row.quote_asset == "0xq"
    assert (row.payments, row.receipts, row.refunds) == ({"0xq": str(50 * E18)}, {"0xt": str(10**30)}, {"0xq": str(2 * E18)}) and row.flags == ["refund_observed"]


def test_sell(spark):
    (row,) = traded(spark, [(TOKEN, WALLET, MANAGER, 7), (QUOTE, MANAGER, WALLET, 3)])
    assert (row.direction, row.classification, row.payments, row.receipts, row.quote_asset, row.flags) == ("sell", "genuine_swap", {"0xt": "7"}, {"0xq": "3"}, "0xq", [])


def test_native_buy_needs_refund_coverage(spark):
    native = {"pools": (NATIVE_POOL,), "tx_to": MANAGER, "value": word(5 * E18)}
    got = [(TOKEN, MANAGER, WALLET, 100)]
    (row,) = traded(spark, got, **native)
    assert (row.route_status, row.direction, row.classification) == ("uncertain", "buy", "ambiguous") and row.flags == ["native_refund_coverage_unavailable", "route_evidence_unverified"]
    (row,) = traded(spark, got, refunds=[(MANAGER, WALLET, E18)], refunds_accounted=True, **native)
    assert (row.route_status, row.classification, row.payments, row.refunds) == ("verified", "genuine_swap", {r.NATIVE: str(5 * E18)}, {r.NATIVE: str(E18)})
    (row,) = traded(spark, got, refunds=[(MANAGER, WALLET, 5 * E18)], refunds_accounted=True, **native)
    assert row.classification == "ambiguous" and "fully_refunded_or_zero_net_input" in row.flags
    (row,) = traded(spark, got, refunds=[(OTHER, WALLET, E18)], refunds_accounted=True, **native)
    assert row.error and row.classification is None
    # A pool without the native currency doesn't make the value a payment.
    (row,) = traded(spark, got, tx_to=MANAGER, value=word(5))
    assert row.payments == {} and "native_input_outside_verified_pool_currency" in row.flags and "no_readable_cash_leg" in row.flags


def test_airdrop_missing_cash_and_failure(spark):
    (row,) = traded(spark, [(TOKEN, OTHER, WALLET, 100)])
    assert row.direction == "unknown" and row.receipts == {} and row.flags[0] == "unrelated_token_transfer_excluded"
    (row,) = traded(spark, [(TOKEN, MANAGER, WALLET, 100)])
    assert row.classification == "ambiguous" and row.flags == ["no_readable_cash_leg", "vendor_or_swap_label_is_not_spend"]
    (row,) = traded(spark, [(TOKEN, MANAGER, WALLET, 100), (QUOTE, WALLET, MANAGER, 5)], swaps=((1, 3, "p", "0xforged", "Swap", False),))
    assert (row.route_status, row.direction, row.classification) == ("unsupported", "buy", "ambiguous")
    assert traded(spark, [(TOKEN, MANAGER, WALLET, 100)], failed=True) == []
    (row,) = traded(spark, [])
    assert (row.payments, row.receipts, row.refunds) == ({}, {}, {})


TRADE = "tx int, wallet string, token string, classification string, route_status string, direction string, method string, event_us long, arrival_us long, payments map<string,string>, receipts map<string,string>, refunds map<string,string>"


def timeline(spark, rows, cutoff=20):
    out = facts.token_timeline(spark.createDataFrame(rows, TRADE), cutoff, cutoff, "m2")
    shown = {c: words.decimal_text(F.col(c)) for c in ("token_in", "token_out")} | {c: maps.decimals(F.col(c)) for c in ("payment_out", "quote_in")}
    return {x.token: x for x in out.withColumns(shown).collect()}


def test_timeline(spark):
    buy = (1, "w", "T", "genuine_swap", "verified", "buy", "m2", 1, 2, {"Q": word(2**100), "R": word(4)}, {"T": word(100)}, {"Q": word(2**100 - 9)})
    sell = (2, "w", "T", "genuine_swap", "verified", "sell", "m2", 3, 4, {"T": word(40)}, {"Q": word(7)}, None)
    old = (3, "w", "T", "genuine_swap", "verified", "buy", "m1", 3, 4, {"Q": word(1)}, {"T": word(1)}, None)
    again = (*buy[:8], 5, *buy[9:])
    late = (4, "w", "T", "genuine_swap", "verified", "buy", "m2", 3, 21, {"Q": word(1)}, {"T": word(1)}, None)
    x = timeline(spark, [buy, sell, old, again, late])["T"]
    assert (x.trade_count, x.verified_buys, x.verified_sells, x.token_in, x.token_out) == (4, 1, 1, "100", "40")
    assert x.payment_out == {"Q": "9", "R": "4"} and x.quote_in == {"Q": "7"} and x.latest_arrival == 5
    assert x.missingness == ["unverified_trade_evidence_excluded_from_verified_flow"] and x.quality == "degraded"
    x = timeline(spark, [(1, "w", "U", "ambiguous", "uncertain", "unknown", "m2", 1, 1, None, None, None), (2, "w", "U", "gift_or_airdrop", "uncertain", "unknown", "m2", 1, 1, None, None, None)])["U"]
    assert (x.token_in, x.payment_out, x.ambiguous, x.gifts) == ("0", {}, 1, 1)
    assert x.missingness == ["ambiguous_activity_excluded_from_verified_flow", "non_swap_activity_excluded_from_verified_flow"]
    x = timeline(spark, [buy])["T"]
    assert x.quality == "healthy" and x.missingness == []
    # A full refund keeps its asset at zero.
    assert timeline(spark, [(*buy[:11], {"Q": word(2**100)})])["T"].payment_out == {"Q": "0", "R": "4"}


def test_receipts_are_put_together_as_numbers(spark, sf):
    """No log is written before the lines of a receipt meet, so none is shuffled."""
    from tidemark.plans.decode import receipts

    lines = receipts(spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert lines[0].startswith("Aggregate") and [decode.TRANSFER_TOPIC in line for line in lines] == [True] + [False] * (len(lines) - 1)


def test_each_input_of_a_trade_is_read_once(spark, sf):
    """Receipts, swaps, swap logs, transfers and refunds come from the lines; the route isn't worked out again for each kind of leg."""
    from tidemark.plans.decode import trade_from_receipt

    plan = trade_from_receipt(spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert sum("Relation [l_orderkey#" in line for line in plan) == 5 and not any("Filter" in line and decode.TRANSFER_TOPIC in line and "array(" in line for line in plan)


def test_legs_of_one_asset_are_added(spark):
    """More legs than are named one by one, several of an asset, modulo 2**256; a native transfer adds to the native value."""
    paid, got = [(QUOTE, WALLET, MANAGER, n) for n in (2**200, 3, 4)], [(TOKEN, MANAGER, WALLET, n) for n in (2**64, 2**64 + 5)]
    (row,) = traded(spark, [*paid, *got, (QUOTE, MANAGER, WALLET, 1), (QUOTE, MANAGER, WALLET, 6), (TOKEN, OTHER, WALLET, 9)])
    assert (row.direction, row.classification, row.payments, row.receipts, row.refunds) == ("buy", "genuine_swap", {"0xq": str(2**200 + 7)}, {"0xt": str(2**65 + 5)}, {"0xq": "7"})
    assert row.flags == ["unrelated_token_transfer_excluded", "refund_observed"]
    native = {"pools": (NATIVE_POOL,), "tx_to": MANAGER, "value": word(5), "refunds_accounted": True}
    (row,) = traded(spark, [(TOKEN, MANAGER, WALLET, 1), (r.NATIVE, WALLET, MANAGER, 2)], refunds=[(MANAGER, WALLET, 3), (MANAGER, WALLET, 4)], **native)
    assert (row.payments, row.refunds, row.classification, row.flags) == ({r.NATIVE: "7"}, {r.NATIVE: "7"}, "ambiguous", ["fully_refunded_or_zero_net_input", "refund_observed"])


def test_swaps_of_a_route(spark):
    """Managers and quotes of all swaps, each once; a swap whose log is missing decides only if no earlier one fails."""
    pools = [("P", "v4", MANAGER, TOKEN, QUOTE), ("R", "v4", "0xN", "0xR", TOKEN), ("S", "v4", MANAGER, QUOTE, TOKEN)]
    swaps = [(1, 3, "p", "0xm", "Swap", False), (1, 4, "r", "0xn", "Swap", False), (1, 5, "s", "0xm", "Swap", False)]
    row = routed(spark, pools, swaps, [(1, 3), (1, 4), (1, 5)], (QUOTE, "0xR")).first()
    assert (row.swaps, row.route_status, row.route_flag, sorted(row.managers), sorted(row.route_quotes)) == (3, "verified", None, ["0xm", "0xn"], ["0xq", "0xr"])
    row = routed(spark, pools, swaps, [(1, 4)], (QUOTE,)).first()
    assert (row.route_status, row.route_flag) == ("uncertain", "swap_log_not_linked_to_receipt")
    row = routed(spark, pools, swaps, [(1, 3), (1, 4)], (QUOTE,)).first()
    assert (row.route_status, row.route_flag, row.route_quotes) == ("uncertain", "quote_asset_not_in_verified_pool_currency", ["0xq"])
