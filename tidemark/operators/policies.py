"""Policies, gates, quotes and allocation as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.integers import floor_div, return_bps


def _decided(policy: str, *cases: tuple[Column | None, str | Column, str | Column]) -> Column:
    """Struct (policy, action, reason) of the first case (condition, action, reason) that holds; the last one has none."""
    pair = lambda action, reason: F.struct(F.lit(policy).alias("policy"), (action if isinstance(action, Column) else F.lit(action)).alias("action"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    *tests, (_, action, reason) = cases
    out = pair(action, reason)
    for condition, action, reason in reversed(tests):
        out = F.when(F.coalesce(condition, F.lit(False)), pair(action, reason)).otherwise(out)
    return out


def prediction_action(expected: Column, uncertainty: Column, open_position: Column, enter: int = 100, leave: int = -100, most_uncertain: int = 500) -> Column:
    """Struct (policy, action, reason) of a prediction in basis points: watch above the largest uncertainty, exit an open position
    at `leave` or less, enter at `enter` or more, else hold or watch."""
    return _decided(
        "prediction",
        (uncertainty > most_uncertain, "watch", "uncertainty_above_threshold"),
        (open_position & (expected <= leave), "exit", "expected_return_below_exit_threshold"),
        (~open_position & (expected >= enter), "enter", "expected_return_above_entry_threshold"),
        (None, F.when(open_position, "hold").otherwise("watch"), "threshold_not_met"),
    )


def market_observations(points: DataFrame, key: str, order: list[str], price: str) -> DataFrame:
    """`points` with price_change_bps from the point before and positive_intervals, how many rises in a row end here."""
    ordered = Window.partitionBy(key).orderBy(*order)
    changed = points.withColumn("price_change_bps", F.coalesce(return_bps(F.lag(price).over(ordered), F.col(price)), F.lit(0)))
    # A run of rises begins after each point that isn't one.
    run = changed.withColumn("__run", F.sum((F.col("price_change_bps") <= 0).cast("int")).over(ordered))
    inside = Window.partitionBy(key, "__run").orderBy(*order)
    return run.withColumn("positive_intervals", F.sum((F.col("price_change_bps") > 0).cast("long")).over(inside)).drop("__run")


def baseline_decisions(rows: DataFrame, keep: list[str], entry_bps: int = 500, confirmations: int = 2, least_flow: int = 1, least_liquidity: int = 1, hold_seconds: int = 300) -> DataFrame:
    """(keep, policy, action, allocation_bps, reason): what five simple policies do at each market observation.

    rows(verified_flow, liquidity, price_change_bps, candidate_available, cohort_state, positive_intervals, position_open,
    position_age_seconds).  An entry allocates `entry_bps`, everything else nothing.
    """
    c = F.col
    held, free = c("position_open"), ~c("position_open")
    waiting = F.when(held, "hold").otherwise("watch")
    qualifies = (c("verified_flow") >= least_flow) & (c("liquidity") >= least_liquidity)
    decisions = [
        _decided("idle_cash", (None, "watch", "no_entry_by_definition")),
        _decided(
            "fixed_horizon_hold",
            (held & (c("position_age_seconds") >= hold_seconds), "exit", "fixed_horizon_reached"),
            (free & c("candidate_available"), "enter", "candidate_available"),
            (None, waiting, "waiting_for_candidate"),
        ),
        _decided(
            "confirmation_momentum",
            (held & (c("price_change_bps") < 0), "exit", "negative_momentum"),
            (free & (c("price_change_bps") > 0) & (c("positive_intervals") >= confirmations), "enter", "confirmed_positive_momentum"),
            (None, waiting, "confirmation_not_met"),
        ),
        _decided(
            "verified_flow_filter",
            (held & ~qualifies, "exit", "flow_or_liquidity_below_threshold"),
            (free & qualifies & c("candidate_available"), "enter", "verified_flow_and_liquidity_confirmed"),
            (None, waiting, "verified_flow_filter_not_met"),
        ),
        _decided(
            "tracked_wallet_follow",
            (F.coalesce(c("cohort_state"), F.lit("unknown")) != "member", "watch", "cohort_unavailable_or_uncertain"),
            (free & c("candidate_available"), "enter", "observed_prior_cohort_signal"),
            (None, waiting, "no_new_cohort_signal"),
        ),
    ]
    stacked = rows.select(*keep, F.inline(F.array(*decisions)))
    return stacked.select(*keep, "policy", "action", F.when(F.col("action") == "enter", entry_bps).otherwise(0).alias("allocation_bps"), "reason")


def range_decisions(rows: DataFrame, keep: list[str], tick: str, volatility_bps: str, verified: str, width: int = 600, least_width: int = 120, multiplier: int = 2) -> DataFrame:
    """(keep, policy, action, tick_lower, tick_upper, reason) of three range policies.  Ticks are kept without verified evidence,
    which turns opening into watching; the idle policy has no range."""
    sure = F.coalesce(F.col(verified), F.lit(False))
    half = {"fixed_wide_range": (F.lit(width), "fixed_discrete_range"), "volatility_range": (F.greatest(F.lit(least_width), F.col(volatility_bps) * multiplier), "observed_volatility_range")}
    ranges = [
        F.struct(F.lit(name).alias("policy"), F.when(sure, "open").otherwise("watch").alias("action"), (F.col(tick) - w).cast("long").alias("tick_lower"), (F.col(tick) + w).cast("long").alias("tick_upper"), F.when(sure, why).otherwise("lp_disabled_until_verified_live_evidence").alias("reason"))
        for name, (w, why) in half.items()
    ]
    nothing = F.lit(None).cast("long")
    idle = F.struct(F.lit("idle").alias("policy"), F.lit("watch").alias("action"), nothing.alias("tick_lower"), nothing.alias("tick_upper"), F.lit("no_lp_position").alias("reason"))
    return rows.select(*keep, F.inline(F.array(*ranges, idle)))


#: What has to be verified before ranges are opened, in the order in which missing ones are named.
VERIFIED = ["live_protocol", "token_order", "tick_math", "hook_behavior", "supported_tokens", "position_state", "receipt_accounting", "gas_denomination", "complete_receipts"]


def evidence_gate(rows: DataFrame, chain_id: int) -> DataFrame:
    """`rows` with `missing` (array), `qualifies` and `evidence_status` (unavailable for a row without any evidence id).

    rows have <name>_verified for each of `VERIFIED`, chain_id, deployment_ref, bytecode_ref, source_refs (array),
    checkpoints and evidence_id.  Null counts as not verified.
    """
    given = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    rules = [(f"missing_{n}_verified", F.coalesce(F.col(f"{n}_verified"), F.lit(False))) for n in VERIFIED] + [
        ("missing_deployment_evidence", given("deployment_ref")),
        ("unsupported_or_unverified_chain", F.coalesce(F.col("chain_id") == chain_id, F.lit(False))),
        ("missing_bytecode_evidence", given("bytecode_ref")),
        ("missing_live_source_refs", F.coalesce(F.size("source_refs") > 0, F.lit(False))),
        ("missing_observed_position_checkpoint", F.coalesce(F.col("checkpoints") > 0, F.lit(False))),
    ]
    missing = F.array_compact(F.array(*[F.when(~holds, name) for name, holds in rules]))
    out = rows.withColumn("missing", missing).withColumn("qualifies", (F.size("missing") == 0) & F.col("evidence_id").isNotNull())
    return out.withColumn("evidence_status", F.when(F.col("evidence_id").isNull(), "unavailable").when(F.col("qualifies"), "verified").otherwise("inconclusive"))


def health(quality: Column, contradictory: Column, now_us: Column, latest_us: Column, position: Column, deadline_seconds: int = 15) -> Column:
    """Struct (state, can_enter, management_action, missed_deadline, reason) of an observed source at an instant.

    Without an arrival the state is unknown.  A contradiction comes before the reported quality, and that before a
    missed deadline.  An arrival after `now_us` is an error.
    """
    late = F.coalesce(now_us - latest_us > deadline_seconds * 1_000_000, F.lit(True))
    contradicted = F.coalesce(contradictory, F.lit(False))
    state = F.when(latest_us.isNull(), "unknown").when(latest_us > now_us, F.raise_error(F.lit("observation arrival cannot be in the future"))).when(contradicted, "degraded").when(quality != "healthy", quality).when(late, "stale").otherwise("healthy")
    reason = F.when(latest_us.isNull(), "no_received_observation").when(contradicted, "contradictory_observation").when(quality != "healthy", F.concat(F.lit("quality_"), quality)).when(late, "decision_deadline_missed").otherwise("within_deadline")
    fine = state == "healthy"
    managed = F.when(~F.coalesce(position, F.lit(False)), "pause_new_entries").when(fine, "hold_existing_position").otherwise("hold_and_reconcile_existing_position")
    return F.struct(state.alias("state"), fine.alias("can_enter"), managed.alias("management_action"), late.alias("missed_deadline"), reason.alias("reason"))


def linear_stress(base_fee: Column, size: Column, move_bps: Column, fee_bps: Column, gas: Column, exit_depth: Column, supported: Column) -> Column:
    """Struct (modelled_net, state, reason) of a linear stress of a position: fees earned less the price move and the fee on its
    size, each floored, less gas.  Unsupported hooks or tokens and an exit depth below the size are excluded."""
    net = base_fee - floor_div(size * move_bps, 10_000) - floor_div(size * fee_bps, 10_000) - gas
    shallow = F.coalesce(exit_depth < size, F.lit(False))
    reason = F.when(~F.coalesce(supported, F.lit(False)), "unsupported_hook_or_token").when(shallow, "insufficient_exit_depth").otherwise("linearized_counterfactual")
    modelled = reason == "linearized_counterfactual"
    return F.struct(F.when(modelled, net).alias("modelled_net"), F.when(modelled, "modeled").otherwise("excluded").alias("state"), reason.alias("reason"))


def reconcile_shadow(decisions: DataFrame, by: list[str]) -> DataFrame:
    """(by, compared, mean_drift_bps, missed, revisions, stresses, state) of decisions(drift_bps, missed, revised, stress_bps), where
    null drifts and stresses weren't compared or stressed: reviewed only without revisions and with a stress."""
    out = decisions.groupBy(*by).agg(
        F.count("drift_bps").alias("compared"), F.sum("drift_bps").alias("__sum"), F.count_if("missed").alias("missed"), F.count_if("revised").alias("revisions"), F.count("stress_bps").alias("stresses"),
    )
    state = F.when((F.col("revisions") > 0) | (F.col("stresses") == 0), "inconclusive").otherwise("reviewed")
    return out.select(*by, "compared", F.when(F.col("compared") > 0, floor_div(F.col("__sum"), F.col("compared"))).alias("mean_drift_bps"), "missed", "revisions", "stresses", state.alias("state"))


def audit_window(windows: DataFrame, least_days: int, least_launches: int, least_availability_bps: int) -> DataFrame:
    """`windows` with duration_us, availability_bps, state and reasons (array).

    windows(start_us, end_us, launches, scheduled, missed, gaps), where end_us is null while a window is open and gaps
    counts those that aren't resolved.  Availability is the share of scheduled decisions that weren't missed, floored.
    """
    duration = F.coalesce(F.col("end_us") - F.col("start_us"), F.lit(0))
    out = windows.withColumn("duration_us", duration).withColumn("availability_bps", F.when(F.col("scheduled") > 0, floor_div((F.col("scheduled") - F.col("missed")) * 10_000, F.col("scheduled"))))
    rules = [
        ("insufficient_duration", F.col("duration_us") < least_days * 86_400_000_000), ("insufficient_eligible_launches", F.col("launches") < least_launches),
        ("healthy_interval_availability_below_gate", F.coalesce(F.col("availability_bps") < least_availability_bps, F.lit(True))), ("unresolved_source_gaps", F.col("gaps") > 0),
    ]
    out = out.withColumn("reasons", F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules])))
    return out.withColumn("state", F.when(F.size("reasons") == 0, "pass").otherwise("inconclusive"))


def quote_as_of(orders: DataFrame, quotes: DataFrame, key: str, at: str, quoted: str, bucket: int) -> DataFrame:
    """`orders` with the latest quote of their key not later than them, as struct `quote` (null without one).

    An as-of join by one union and one window per (key): quotes carry themselves forward.  Time buckets
    of a key are first closed by their last quote, so that a busy key's rows are spread over tasks.
    """
    q = quotes.select(F.col(key), F.col(quoted).alias("__t"), F.struct(*quotes.columns).alias("quote"))
    q = q.withColumn("__b", floor_div(F.col("__t"), bucket))
    last = q.groupBy(key, "__b").agg(F.max_by("quote", "__t").alias("__carry"))
    before = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    o = orders.select(F.col(key), F.col(at).alias("__t"), F.struct(*orders.columns).alias("__o")).withColumn("__b", floor_div(F.col("__t"), bucket))
    spine = o.select(key, "__b").union(last.select(key, "__b")).distinct().join(last, [key, "__b"], "left")
    carried = spine.select(key, "__b", F.last("__carry", ignorenulls=True).over(before).alias("__carry"))
    mixed = q.select(key, "__b", "__t", F.lit(0).alias("__k"), "quote", F.lit(None).cast(o.schema["__o"].dataType).alias("__o")).unionByName(o.select(key, "__b", "__t", F.lit(1).alias("__k"), F.lit(None).cast(q.schema["quote"].dataType).alias("quote"), "__o"))
    inside = Window.partitionBy(key, "__b").orderBy("__t", "__k").rowsBetween(Window.unboundedPreceding, 0)
    seen = mixed.withColumn("__q", F.last("quote", ignorenulls=True).over(inside)).where("__k = 1").join(carried, [key, "__b"], "left")
    return seen.select("__o.*", F.coalesce("__q", "__carry").alias("quote"))


def fill(amount: Column, reserve_in: Column, reserve_out: Column, fee_bps: Column) -> tuple[Column, Column, Column]:
    """(fee, output, impact in basis points) of a constant-product swap in integers; amounts fit decimal(38,0)."""
    big = lambda c: c.cast("decimal(19,0)")
    fee = floor_div(amount * fee_bps, 10_000)
    net = amount - fee
    output = F.floor(F.call_function("div", big(net) * big(reserve_out), big(reserve_in + net))).cast("long")
    spot = F.floor(F.call_function("div", big(net) * big(reserve_out), big(reserve_in))).cast("long")
    return fee, output, F.when(spot > 0, floor_div((spot - output) * 10_000, spot)).otherwise(F.lit(0).cast("long"))


def allocate(candidates: DataFrame, portfolio: str, asset: str, score: str, at: str, ident: str, ticket: int, cash: str, slots: str, existing: DataFrame | None = None) -> DataFrame:
    """`candidates` with reason: greedily by falling score, time and id, a ticket each while slots and cash last, no second
    position in an asset.  `existing` (portfolio, asset) are positions that are open already and take slots.

    Once a limit is reached nothing is accepted any more, so the accepted are a rank among the first candidates of each
    asset that isn't open, and the limit that was reached first is the reason of all others.
    """
    kept = candidates.columns
    rows = candidates.select(F.struct(*kept).alias("c"), F.col(portfolio).alias("p"), F.col(asset).alias("a"), F.col(slots).alias("slots"), F.col(cash).alias("cash"), *[F.struct(F.col(score).alias("s"), F.col(at).alias("t"), F.col(ident).alias("i")).alias("k")])
    if existing is None:
        rows = rows.withColumn("own", F.lit(False)).withColumn("held", F.lit(0))
    else:
        open_ = existing.select(F.col(portfolio).alias("p"), F.col(asset).alias("a")).distinct()
        rows = rows.join(open_.withColumn("own", F.lit(True)), ["p", "a"], "left").join(open_.groupBy("p").agg(F.count("*").alias("held")), "p", "left").fillna({"own": False, "held": 0})
    order = [F.col("k.s").desc(), F.col("k.t").asc(), F.col("k.i").asc()]
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("p", "a").orderBy(*order)))
    opening = (F.col("nth") == 1) & ~F.col("own")
    place = F.sum(opening.cast("int")).over(Window.partitionBy("p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranked.withColumn("place", place).withColumn("free", F.greatest(F.lit(0), F.col("slots") - F.col("held"))).withColumn("paid", floor_div(F.col("cash"), ticket))
    taken = F.max((opening & (F.col("place") <= F.least("free", "paid"))).cast("int")).over(Window.partitionBy("p", "a")) == 1
    ranked = ranked.withColumn("taken", taken)
    why = F.when(F.col("own") | (F.col("taken") & (F.col("nth") > 1)), "position_already_open_no_adding").when(F.col("taken"), "accepted").when(F.col("free") <= F.col("paid"), "max_concurrent_positions").otherwise("insufficient_simulation_cash")
    return ranked.select("c.*", why.alias("reason"))


def best_mode(candidates: DataFrame, decision: str, required_cash: Column, allocated: Column) -> DataFrame:
    """(decision, mode, accepted, reason) of candidates(mode, score_bps, supported, available_cash, verified): the best affordable
    one by falling score, then name; range modes (`lp`) need verified evidence.  Nothing is selected where the portfolio is
    already allocated, and idle is where no candidate is left."""
    affordable = F.coalesce(F.col("supported"), F.lit(False)) & (F.col("available_cash") >= required_cash)
    blocked = (F.col("mode") == "lp") & ~F.coalesce(F.col("verified"), F.lit(False))
    best = candidates.groupBy(decision).agg(
        F.min(F.when(affordable & ~blocked, F.struct((-F.col("score_bps")).alias("s"), F.col("mode").alias("m")))).alias("b"), F.bool_or(affordable & blocked).alias("blocked"), F.bool_or(allocated).alias("allocated"),
    )
    reason = F.when(F.col("allocated"), "shared_portfolio_already_allocated").when(F.col("b").isNotNull(), "highest_registered_score").when(F.col("blocked"), "lp_disabled_until_verified_live_evidence").otherwise("no_supported_affordable_mode")
    return best.select(decision, F.when(F.col("allocated"), "idle").otherwise(F.coalesce("b.m", F.lit("idle"))).alias("mode"), (~F.col("allocated")).alias("accepted"), reason.alias("reason"))
