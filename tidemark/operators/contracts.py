"""Row contracts: named rules as columns; a row is good if it breaks none.

The rules are plain columns, so a contract is one projection and any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[Callable[[str], Column]], Column]

ADDRESS, WORD32, UNSIGNED, SIGNED = r"^0x[0-9a-fA-F]{40}$", r"^0x[0-9a-fA-F]{64}$", r"^(0|[1-9][0-9]*)$", r"^-?(0|[1-9][0-9]*)$"
#: RFC-3339 text with its mandatory zone.
INSTANT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"


EXIT_KINDS = ("collect_fees", "convert_residual", "remove_liquidity", "sell_token")


def matches(column: str, pattern: str, nullable: bool = False) -> Rule:
    return lambda c: (c(column).isNull() & F.lit(nullable)) | F.coalesce(c(column).cast("string").rlike(pattern), F.lit(False))


def present(column: str) -> Rule:
    return lambda c: F.coalesce(F.trim(c(column).cast("string")) != "", F.lit(False))


def one_of(column: str, *values: str) -> Rule:
    return lambda c: F.coalesce(c(column).isin(*values), F.lit(False))


def between(column: str, low: float, high: float) -> Rule:
    return lambda c: F.coalesce(c(column).between(low, high), F.lit(False))


def at_least(column: str, low: int, nullable: bool = False) -> Rule:
    return lambda c: (c(column).isNull() & F.lit(nullable)) | F.coalesce(c(column) >= low, F.lit(False))


def micros_of(text: Column) -> Column:
    """RFC-3339 text with a zone as microseconds since 1970; null for anything else, times that don't exist included."""
    return F.when(text.rlike(INSTANT), F.unix_micros(F.try_to_timestamp(F.upper(text))))


def instant(column: str, nullable: bool = False) -> Rule:
    """A timestamp, microseconds, or RFC-3339 text with a zone."""

    def rule(c: Callable[[str], Column]) -> Column:
        x = c(column)
        text = F.typeof(x) == "string"
        return (x.isNull() & F.lit(nullable)) | (x.isNotNull() & (~text | F.coalesce(micros_of(x.cast("string")).isNotNull(), F.lit(False))))

    return rule


def ordered(early: str, late: str, strictly: bool = False) -> Rule:
    """Early is at or before late (before it, `strictly`), as instants; a null on either side is no breach."""

    def rule(c: Callable[[str], Column]) -> Column:
        a, b = c(early), c(late)
        by_text = F.when(F.typeof(a) == "string", micros_of(a.cast("string")) < micros_of(b.cast("string")) if strictly else micros_of(a.cast("string")) <= micros_of(b.cast("string")))
        return a.isNull() | b.isNull() | F.coalesce(by_text, a < b if strictly else a <= b)

    return rule


def filled(column: str) -> Rule:
    return lambda c: F.coalesce(F.size(c(column)) > 0, F.lit(False))


def texts(column: str, pattern: str = r"\S", filled: bool = False) -> Rule:
    """A list whose items all match; `filled` asks for at least one."""
    return lambda c: F.coalesce(F.forall(c(column), lambda x: F.coalesce(x.rlike(pattern), F.lit(False))) & (F.size(c(column)) > 0 if filled else F.lit(True)), F.lit(False))


def only_if(condition: Callable[[Callable[[str], Column]], Column], rule: Rule) -> Rule:
    """The rule where the condition holds."""
    return lambda c: ~F.coalesce(condition(c), F.lit(False)) | rule(c)


def absent(column: str) -> Rule:
    return lambda c: c(column).isNull()


def _is(column: str, *values: str) -> Rule:
    return lambda c: c(column).isin(*values)


def _exits(c: Callable[[str], Column]) -> Column:
    """Only exits name a kind, of those that their market has."""
    kinds = F.when(c("market") == "spot", c("exit_kind").isin("sell_token", "convert_residual")).otherwise(c("exit_kind").isin(*[k for k in EXIT_KINDS if k != "sell_token"]))
    return F.when(c("action") == "exit", F.coalesce(kinds, F.lit(False))).otherwise(c("exit_kind").isNull())


def _kind_of_market(c: Callable[[str], Column]) -> Column:
    return F.coalesce(c("instrument.kind") == F.when(c("market") == "spot", "token").otherwise("pool"), F.lit(False))


def _horizons(c: Callable[[str], Column]) -> Column:
    x = c("horizons_seconds")
    return F.coalesce((F.size(x) > 0) & F.forall(x, lambda h: h > 0) & (F.array_sort(F.array_distinct(x)) == x), F.lit(False))


_NATIVE = r"^(?i:native:eth)$|" + ADDRESS
_V4 = _is("protocol", "uniswap_v4")
_V3 = _is("protocol", "uniswap_v3")
_SWAP = _is("classification", "genuine_swap")

#: Contract by record kind: the reason that a broken rule gives, and the rule.
CONTRACTS: dict[str, list[tuple[str, Rule]]] = {
    "raw_event": [
        ("chain_id", at_least("chain_id", 1)), ("source", present("source")), ("schema_version", present("source_schema_version")), ("block_number", at_least("block_number", 0, True)),
        ("block_hash", matches("block_hash", WORD32, True)), ("parent_hash", matches("parent_hash", WORD32, True)), ("transaction_hash", matches("transaction_hash", WORD32, True)), ("log_index", at_least("log_index", 0, True)),
        ("event_time", instant("event_time")), ("received_time", instant("received_time")), ("payload", lambda c: c("payload").isNotNull()), ("ingestion_run", present("ingestion_run")),
        ("status", one_of("canonical_status", "provisional", "canonical", "orphaned", "unresolved", "quarantined")), ("orphan_hash", only_if(_is("canonical_status", "orphaned"), lambda c: c("block_hash").isNotNull())),
    ],
    "pool_identity": [
        ("chain_id", at_least("chain_id", 0)), ("protocol", one_of("protocol", "uniswap_v3", "uniswap_v4")), ("manager", matches("manager_or_factory", ADDRESS)), ("currency0", matches("currency0", ADDRESS)), ("currency1", matches("currency1", ADDRESS)),
        ("currencies_differ", lambda c: F.lower(c("currency0")) != F.lower(c("currency1"))), ("fee", at_least("fee", 0)), ("tick_spacing", lambda c: c("tick_spacing").isNotNull()),
        ("v4_address", only_if(_V4, absent("pool_address"))), ("v4_pool_id", only_if(_V4, matches("pool_id", WORD32))), ("v4_hook", only_if(_V4, matches("hook", ADDRESS))),
        ("v3_pool_id", only_if(_V3, absent("pool_id"))), ("v3_address", only_if(_V3, matches("pool_address", ADDRESS))), ("v3_hook", only_if(_V3, absent("hook"))),
    ],
    "launch": [
        ("chain_id", at_least("chain_id", 0)), ("token", matches("token", ADDRESS)), ("contract", matches("launch_contract", ADDRESS, True)), ("evidence", texts("creation_evidence")), ("creator", matches("creator", ADDRESS, True)),
        ("created_at", instant("created_at", True)), ("first_seen_at", instant("first_seen_at")), ("origin", one_of("origin_confidence", "verified", "observed", "unverified", "unknown")),
        ("linked_pools", texts("linked_pool_ids", WORD32)), ("lifecycle", one_of("lifecycle_state", "active", "graduated", "non_graduate", "unknown")),
    ],
    "payment_leg": [
        ("asset", matches("asset", _NATIVE)), ("amount", matches("amount_atomic", UNSIGNED)), ("positive", lambda c: c("amount_atomic") != "0"), ("direction", one_of("direction", "in", "out")),
        ("from", matches("from_address", ADDRESS)), ("to", matches("to_address", ADDRESS)), ("evidence", present("evidence_ref")),
    ],
    "trade": [
        ("transaction", matches("transaction_hash", WORD32)), ("wallet", matches("wallet", ADDRESS)), ("token", matches("token", ADDRESS)), ("class", one_of("classification", "genuine_swap", "transfer", "gift_or_airdrop", "ambiguous")),
        ("route", one_of("route_status", "verified", "uncertain", "unsupported")), ("direction", one_of("trade_direction", "buy", "sell", "unknown")), ("swap_payment", only_if(_SWAP, filled("payment_legs"))), ("swap_receipt", only_if(_SWAP, filled("receipt_legs"))),
        ("swap_route", only_if(_SWAP, one_of("route_status", "verified"))), ("swap_direction", only_if(_SWAP, one_of("trade_direction", "buy", "sell"))), ("refund_direction", lambda c: F.coalesce(F.forall(c("refund_legs"), lambda x: x["direction"] == "in"), F.lit(True))),
        ("quote_asset", matches("quote_asset", _NATIVE, True)), ("usd", lambda c: F.when(c("estimated_usd"), F.coalesce(c("estimated_usd_value").rlike(UNSIGNED), F.lit(False)) & c("valuation_method").isNotNull()).otherwise(c("estimated_usd_value").isNull())),
        ("method_version", present("method_version")), ("as_of_time", instant("as_of_time")), ("retrieved_time", instant("retrieved_time")), ("refs", filled("raw_event_refs")),
    ],
    "vendor_claim": [
        ("vendor", present("vendor")), ("subject_type", one_of("subject_type", "token", "pool", "wallet")), ("subject", present("subject_id")), ("source_time", instant("source_as_of_time", True)), ("retrieved_time", instant("retrieved_time")),
        ("freshness", one_of("freshness", "fresh", "stale", "unknown")), ("unavailable", only_if(lambda c: c("unavailable"), one_of("freshness", "unknown"))),
    ],
    "wallet_cohort": [
        ("cohort", present("cohort_id")), ("wallet", matches("wallet", ADDRESS)), ("state", one_of("membership_state", "member", "not_member", "unknown")), ("source", present("source")), ("observed", instant("observed_at")),
        ("evidence", texts("relationship_evidence")), ("uncertainty", one_of("relationship_uncertainty", "low", "medium", "high", "unknown")), ("refs", filled("raw_references")),
    ],
    "observation": [
        ("subject_type", one_of("subject_type", "token", "pool", "launch")), ("subject", present("subject_id")), ("as_of_time", instant("as_of_time")), ("latest_event", instant("latest_included_event_time", True)), ("latest_arrival", instant("latest_included_arrival_time", True)),
        ("feature_version", present("feature_version")), ("quality", one_of("quality_state", "healthy", "stale", "degraded", "unknown")), ("lineage", filled("lineage")),
    ],
    "instrument": [("chain_id", at_least("chain_id", 1)), ("kind", one_of("kind", "token", "pool")), ("identifier", present("identifier")), ("protocol", lambda c: F.when(c("kind") == "pool", F.coalesce(F.trim(c("protocol")) != "", F.lit(False))).otherwise(c("protocol").isNull()))],
    "portfolio_context": [
        ("as_of_time", instant("as_of_time")), ("position", one_of("position_state", "flat", "spot_open", "lp_open", "mixed", "unknown")), ("scope", one_of("wallet_scope", "none", "public_only", "unknown")), ("quality", one_of("quality_state", "healthy", "stale", "degraded", "unknown")),
        ("capital", matches("available_capital_atomic", UNSIGNED, True)), ("open_refs", texts("open_position_refs")), ("refs", texts("source_refs")),
    ],
    "prediction_target": [
        ("target", present("target_id")), ("market", one_of("market", "spot", "lp")), ("action", one_of("action", "entry", "hold", "exit")), ("metric", one_of("metric", "net_return_bps", "adverse_excursion_bps", "exit_failure_risk", "liquidity_deterioration_bps")),
        ("horizons", _horizons), ("gate", present("qualification_gate")),
    ],
    "confidence": [
        ("kind", one_of("kind", "unavailable", "uncalibrated_score", "calibrated_probability")), ("unavailable", only_if(_is("kind", "unavailable"), lambda c: F.coalesce(c("score"), c("probability_bps")).isNull() & c("calibration_ref").isNull())),
        ("score", only_if(_is("kind", "uncalibrated_score"), lambda c: c("score").isNotNull() & c("probability_bps").isNull() & c("calibration_ref").isNull())),
        ("probability", only_if(_is("kind", "calibrated_probability"), lambda c: between("probability_bps", 0, 10_000)(c) & c("score").isNull() & present("calibration_ref")(c))),
    ],
    "prediction": [
        ("id", present("prediction_id")), ("target", present("target_id")), ("horizon", at_least("horizon_seconds", 1)), ("created_at", instant("created_at")), ("evidence_cutoff", instant("evidence_cutoff")), ("expires_at", instant("expires_at")),
        ("cutoff", ordered("evidence_cutoff", "created_at")), ("expiry", ordered("created_at", "expires_at", True)), ("model", present("model_id")), ("model_version", present("model_version")), ("uncertainty", at_least("uncertainty_bps", 0, True)),
        ("refs", texts("source_refs", filled=True)), ("state", one_of("state", "research_prediction", "invalidated", "expired")),
    ],
    "proposal": [
        ("id", present("proposal_id")), ("prediction", present("prediction_id")), ("target", present("target_id")), ("horizon", at_least("horizon_seconds", 1)), ("market", one_of("market", "spot", "lp")), ("action", one_of("action", "enter", "hold", "exit", "abstain")),
        ("exit_kind", _exits), ("instrument", _kind_of_market), ("created_at", instant("created_at")), ("expires_at", instant("expires_at")), ("expiry", ordered("created_at", "expires_at", True)), ("model_version", present("model_version")),
        ("refs", texts("evidence_refs", filled=True)), ("state", one_of("proposal_state", "research_only", "qualified_manual_proposal", "expired", "invalidated")),
    ],
    "manual_action": [
        ("id", present("action_id")), ("market", one_of("market", "spot", "lp")), ("action", one_of("action", "enter", "hold", "exit", "abstain")), ("exit_kind", lambda c: F.when(c("action") == "exit", F.coalesce(c("exit_kind").isin(*EXIT_KINDS), F.lit(False))).otherwise(c("exit_kind").isNull())),
        ("instrument", _kind_of_market), ("action_time", instant("action_time")), ("recorded_at", instant("recorded_at")), ("status", one_of("execution_status", "reported", "matched", "ambiguous", "failed", "partial", "not_executed")),
        ("override", lambda c: c("user_override").isNotNull()), ("refs", texts("source_refs", filled=True)),
    ],
    "outcome": [
        ("id", present("outcome_id")), ("prediction", present("prediction_id")), ("target", present("target_id")), ("kind", one_of("outcome_kind", "actual_manual", "simulated_counterfactual", "observed_market")),
        ("action", lambda c: F.when(c("outcome_kind") == "actual_manual", c("action_id").isNotNull()).otherwise(c("action_id").isNull())), ("status", one_of("status", "observed", "censored", "unresolved", "invalidated")), ("observed_at", instant("observed_at")),
        ("available_at", instant("label_available_at", True)), ("available", ordered("observed_at", "label_available_at")), ("refs", texts("source_refs", filled=True)),
    ],
    "wallet_activity": [
        ("wallet", matches("wallet", ADDRESS)), ("type", one_of("activity_type", "swap", "lp")), ("action", one_of("action", "swap", "open", "resize", "collect", "remove", "unknown")), ("status", one_of("status", "confirmed", "failed", "pending", "unknown")),
        ("canonical_status", one_of("canonical_status", "canonical", "provisional", "orphaned", "unresolved")), ("clock", ordered("event_time", "received_time")), ("swap_action", only_if(_is("activity_type", "swap"), one_of("action", "swap"))),
        ("lp_position", only_if(_is("activity_type", "lp"), lambda c: present("pool_id")(c) & present("position_id")(c))), ("lp_action", only_if(_is("activity_type", "lp"), lambda c: c("action") != "swap")), ("delta", matches("liquidity_delta", SIGNED, True)), ("refs", filled("source_refs")),
    ],
}


def validate(rows: DataFrame, contract: str | list[tuple[str, Rule]], names: dict[str, str] | None = None) -> DataFrame:
    """`rows` with reasons (comma-joined names of the broken rules in order) and valid.  `names` maps the contract's columns
    to those of `rows`; a rule over a missing value is broken unless it says otherwise."""
    rules = CONTRACTS[contract] if isinstance(contract, str) else contract
    column = lambda name: F.col((names or {}).get(name, name))
    why = F.concat_ws(",", *[F.when(~F.coalesce(rule(column), F.lit(False)), reason) for reason, rule in rules])
    return rows.withColumn("reasons", why).withColumn("valid", F.col("reasons") == "")
