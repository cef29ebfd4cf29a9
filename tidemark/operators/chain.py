"""Block ancestry, canonical projection, coverage and quality of an event log."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.integers import floor_div
from tidemark.sources.shared import cut, small_or_shuffled


#: Heights of a range of blocks that a task walks at once.
RANGE = 16_384


def _parents(table: pa.Table) -> np.ndarray:
    """The row of each header's parent among the rows, -1 for none."""
    at = pc.index_in(table.column("up").combine_chunks(), value_set=table.column("node").combine_chunks(), skip_nulls=True)
    return pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _contracted(table: pa.Table) -> pa.Table:
    """Headers of a range with their problem, the furthest ancestor inside the range (root), and whether the parent is elsewhere."""
    at, own = _parents(table), np.arange(table.num_rows)
    h = table.column("h").combine_chunks()
    uneven = pc.fill_null(pc.not_equal(pc.take(h, pa.array(np.where(at >= 0, at, own))), pc.subtract(h, pa.scalar(1, h.type))), False).to_numpy(zero_copy_only=False) & (at >= 0)
    goes = (at >= 0) & ~uneven
    root = np.where(goes, at, own)
    for _ in range(table.num_rows.bit_length()):
        root = root[root]
    loose = pc.is_valid(table.column("up")).to_numpy() & (at < 0)
    problem = pa.array(np.where(uneven, "nonconsecutive_height", ""), pa.string())
    problem = pc.if_else(pa.array(uneven), problem, pa.scalar(None, pa.string()))
    return table.select(["node", "h", "up"]).append_column("problem", problem).append_column("root", table.column("node").take(pa.array(root))).append_column("loose", pa.array(loose)).append_column("cyclic", pa.array(goes[root]))


def _walked(table: pa.Table) -> pa.Table:
    """The headers of a range between its entries and their roots."""
    at, keep = _parents(table), np.zeros(table.num_rows, bool)
    up = np.where(pc.is_null(table.column("problem")).to_numpy(), at, -1).tolist()
    for row in np.flatnonzero(table.column("entry").to_numpy()).tolist():
        while row >= 0 and not keep[row]:
            keep[row] = True
            row = up[row]
    return table.filter(pa.array(keep)).select(["node", "h", "up", "problem"])


def ancestry_walk(headers: DataFrame, tip: object, ident: str = "hash", parent: str = "parent", height: str = "height") -> DataFrame:
    """(hash, height, parent, problem): the chain from the tip upwards until a root, a gap or a break; one row a hash is given.

    The headers are shuffled twice by ranges of `RANGE` heights.  First each range is contracted: every header gets its
    furthest ancestor inside the range.  What leaves a range are links between such roots, one a branch and range, which
    pointer doubling follows from the tip in log2(ranges) rounds of equi-joins: before round r the roots up to 2**r - 1
    links away are found and every root knows the one 2**r links away.  Then each range is walked once from where the chain
    enters it.  `problem` is missing_parent, nonconsecutive_height or null.  A cycle among the headers raises an error.
    """
    kind, high = headers.schema[ident].dataType, headers.schema[height].dataType
    # Headers without height are dealt by their hash; any ranges give the same chain.
    ranged = F.coalesce(floor_div(F.col("h"), RANGE), -1 - F.pmod(F.xxhash64("node"), F.lit(1024)))
    rows = headers.select(F.col(ident).alias("node"), F.col(height).alias("h"), F.col(parent).cast(kind).alias("up"))
    names, a, b = "node {0}, h {1}, up {0}, problem string", kind.simpleString(), high.simpleString()
    step = cut(rows.groupBy(ranged).applyInArrow(_contracted, f"{names}, root {{0}}, loose boolean, cyclic boolean".format(a, b)), "ancestry")
    if not step.where("cyclic").isEmpty():
        raise ValueError("block parent cycle detected")
    loose = step.where("loose").select("node", "h", "up")
    parents = step.select(F.col("node").alias("up"), F.col("h").alias("__ph"), F.col("root").alias("next"))
    met = cut(parents.join(small_or_shuffled(loose.select("node", "up")), "up").select("node", "__ph", "next"), "ancestry")
    problem = F.when(F.col("next").isNull(), "missing_parent").when(F.col("__ph") != F.col("h") - 1, "nonconsecutive_height")
    links = loose.join(small_or_shuffled(met), "node", "left").select("node", "up", problem.alias("problem"), F.when(problem.isNull(), F.col("next")).alias("jump"))
    links = cut(links, "ancestry")
    total = links.count()
    start = step.where(F.col("node") == F.lit(tip)).select(F.col("node").alias("entry"), F.col("root").alias("node"))
    found = start.select("node")
    jumps, rounds = links.select("node", "jump").where("jump is not null"), 0
    extend = lambda known, far: known.unionByName(known.join(far, "node").select(F.col("jump").alias("node")))
    twice = lambda far: far.join(far.select(F.col("node").alias("jump"), F.col("jump").alias("next")), "jump").select("node", F.col("next").alias("jump"))
    while not jumps.isEmpty():
        if (1 << rounds) > total:
            raise ValueError("block parent cycle detected")
        doubled = twice(jumps)  # two rounds for each table written
        found = cut(extend(extend(found, jumps), doubled), "ancestry")
        rounds += 2
        jumps = cut(twice(doubled), "ancestry")
    ways = links.where("jump is not null").join(small_or_shuffled(found), "node", "left_semi").select(F.col("up").alias("node"))
    entries = cut(ways.unionByName(start.select(F.col("entry").alias("node"))).distinct(), "ancestry").withColumn("entry", F.lit(True))
    marked = step.drop("root", "loose", "cyclic").join(small_or_shuffled(entries), "node", "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    walked = marked.groupBy(ranged).applyInArrow(_walked, names.format(a, b))
    ends = small_or_shuffled(links.where("problem is not null").select("node", F.col("problem").alias("__end")))
    return walked.join(ends, "node", "left").select(F.col("node").alias(ident), F.col("h").alias(height), F.col("up").cast(headers.schema[parent].dataType).alias(parent), F.coalesce("problem", "__end").alias("problem"))


def canonical_projection(events: DataFrame, chain: DataFrame, anchor_height: int, tip_height: int, resolved: Column, confirmations: int = 0, block_hash: str = "block_hash", block: str = "block", status: str = "status") -> DataFrame:
    """`events` with projected and confirmed.

    Quarantined events stay so.  Without a resolved chain everything else is unresolved; with one, an
    event of a chain block is canonical, one outside the proven heights unresolved, any other orphaned.
    """
    own = chain.select(F.col("hash").alias("__h"), F.col("height").alias("__n"))
    joined = events.join(own, (F.col(block_hash) == F.col("__h")) & (F.col(block) == F.col("__n")), "left")
    outside = (F.col(block) < anchor_height) | (F.col(block) > tip_height)
    projected = F.when(F.col(status) == "quarantined", "quarantined").when(~resolved, "unresolved").when(F.col("__h").isNotNull(), "canonical").when(outside, "unresolved").otherwise("orphaned")
    out = joined.withColumn("projected", projected).drop("__h", "__n")
    return out.withColumn("confirmed", (F.col("projected") == "canonical") & (F.col(block) <= tip_height - confirmations))


def header_merge(observed: DataFrame, ident: str = "hash", facts: tuple[str, ...] = ("height", "parent")) -> DataFrame:
    """One row a header: each fact is the one known value, with conflict where observations disagree."""
    known = [F.max(c).alias(c) for c in facts]
    conflict = F.lit(False)
    for c in facts:
        conflict = conflict | (F.min(c) != F.max(c))
    return observed.groupBy(ident).agg(*known, F.coalesce(conflict, F.lit(False)).alias("conflict"), F.count("*").alias("observations"))


def anchor_state(anchor: DataFrame, headers: DataFrame, chain_id: int, config: str) -> DataFrame:
    """State of each anchor row (source, chain_id, height, block_hash, qualification, config_identity) against the headers."""
    seen = headers.select(F.col("hash").alias("__h"), F.col("height").alias("__n"))
    by_hash = anchor.join(seen, F.col("block_hash") == F.col("__h"), "left")
    state = (
        F.when(F.col("block_hash").isNull(), "unavailable")
        .when(F.col("chain_id") != chain_id, "unsupported")
        .when(F.col("config_identity") != config, "config_mismatch")
        .when(F.col("__h").isNull(), "unverified")
        .when(F.col("__n") != F.col("height"), "mismatch")
        .when(F.col("qualification") != "qualified", "unqualified")
        .otherwise("qualified")
    )
    return by_hash.select(*anchor.columns, state.alias("state"))


def header_cross_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per height that both have: whether hash and parent agree, nulls equal."""
    other = b.select("height", F.col("hash").alias("hash_b"), F.col("parent").alias("parent_b"))
    agree = F.col("hash").eqNullSafe(F.col("hash_b")) & F.col("parent").eqNullSafe(F.col("parent_b"))
    return a.join(other, "height").select("height", "hash", "hash_b", F.when(agree, "accepted").otherwise("rejected").alias("verdict"))


def quality_report(events: DataFrame, by: list[str], key: list[str], block: str, event: str, arrival: str, status: str, head: int | None = None, source_state: str = "healthy") -> DataFrame:
    """Counts, duplicates, mean and exact p95 arrival delay in seconds (the ceil(0.95 n)-th), block lag and state per group.

    The p95 is the smallest delay whose cumulative count reaches the rank, from counts per distinct delay."""
    delay = F.greatest(F.lit(0), F.col(arrival) - F.col(event))
    base = events.withColumn("__delay", delay)
    counts = base.groupBy(*by).agg(
        F.count("*").alias("events"), F.count_distinct(F.struct(*key)).alias("unique_events"), F.count_if(F.col(status) == "quarantined").alias("quarantined"),
        (F.sum("__delay") / F.count("*") / 1_000_000).alias("mean_delay"), F.max(block).alias("latest_block"),
    )
    per = base.groupBy(*by, "__delay").agg(F.count("*").alias("__c"))
    own = Window.partitionBy(*by)
    ranked = per.withColumn("__cum", F.sum("__c").over(own.orderBy("__delay"))).withColumn("__n", F.sum("__c").over(own))
    p95 = ranked.where(F.col("__cum") >= F.ceil(F.col("__n") * 0.95)).groupBy(*by).agg((F.min("__delay") / 1_000_000).alias("p95_delay"))
    out = counts.join(p95, by)
    lag = F.greatest(F.lit(0), F.lit(head) - F.col("latest_block")) if head is not None else F.lit(None).cast("long")
    return out.withColumn("duplicates", F.col("events") - F.col("unique_events")).withColumn("block_lag", lag.cast("long")).withColumn("state", F.when(F.col("quarantined") > 0, "degraded").otherwise(source_state))


def coverage_audit(expected: DataFrame, observed: DataFrame, key: list[str], independent: bool = True) -> DataFrame:
    """One row: counts, matched distinct keys, recall over all expected rows, missing, repeated keys, notes and state."""
    e = expected.groupBy(*[F.col(k).alias(f"e_{k}") for k in key]).agg(F.count("*").alias("n_e"))
    o = observed.groupBy(*[F.col(k).alias(f"o_{k}") for k in key]).agg(F.count("*").alias("n_o"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"e_{k}").eqNullSafe(F.col(f"o_{k}"))
    both = e.join(o, same, "full")
    total = both.agg(
        F.coalesce(F.sum("n_e"), F.lit(0)).alias("expected"), F.coalesce(F.sum("n_o"), F.lit(0)).alias("observed"), F.count_if(F.col("n_e").isNotNull() & F.col("n_o").isNotNull()).alias("matched"),
        F.coalesce(F.sum(F.when(F.col("n_o").isNull(), F.col("n_e"))), F.lit(0)).alias("missing"), F.count_if(F.col("n_o") > 1).alias("repeated_keys"),
    )
    notes = F.array_compact(F.array(
        F.when(F.col("expected") == 0, "empty_reference_cannot_establish_coverage"), F.when(F.lit(not independent), "provider_independence_unverified"),
        F.when(F.col("missing") > 0, "expected_records_missing"), F.when(F.col("repeated_keys") > 0, "duplicate_delivery_detected"),
    ))
    return total.select("*", F.when(F.col("expected") > 0, F.col("matched") / F.col("expected")).alias("recall"), notes.alias("notes"), F.when(F.size(notes) == 0, "pass").otherwise("degraded").alias("state"))


def provider_compare(a: DataFrame, b: DataFrame, key: str, chunk: int) -> DataFrame:
    """(chunk, expected, matched, complete): coverage of provider b per chunk of keys of provider a."""
    part = a.select(floor_div(F.col(key), chunk).alias("chunk"), F.col(key).alias("__k"))
    seen = b.select(F.col(key).alias("__k")).distinct().withColumn("__seen", F.lit(1))
    return part.join(seen, "__k", "left").groupBy("chunk").agg(F.count("*").alias("expected"), F.count("__seen").alias("matched")).withColumn("complete", F.col("expected") == F.col("matched"))


def dedup_merge(rows: DataFrame, key: list[str], content: list[str], lineage: str) -> DataFrame:
    """One row a key: its smallest content, the sorted distinct union of lineage, and whether deliveries disagree."""
    body = F.struct(*content)
    merged = rows.groupBy(*key).agg(F.min(body).alias("__c"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.col(lineage))))).alias("lineage"), (F.min(body) != F.max(body)).alias("conflict"), F.count("*").alias("deliveries"))
    return merged.select(*key, *[F.col(f"__c.{c}").alias(c) for c in content], "lineage", "conflict", "deliveries")


def fold_lifecycle(events: DataFrame, token: str, kind: str, arrival: str, created: str, pooled: str, swept: str) -> DataFrame:
    """(token, state, first_seen, creations, valid): graduated with a pool event, unknown if swept without one, else active;
    valid with exactly one creation."""
    out = events.groupBy(token).agg(F.count_if(F.col(kind) == created).alias("creations"), F.count_if(F.col(kind) == pooled).alias("__p"), F.count_if(F.col(kind) == swept).alias("__s"), F.min(arrival).alias("first_seen"))
    return out.select(token, F.when(F.col("__p") > 0, "graduated").when(F.col("__s") > 0, "unknown").otherwise("active").alias("state"), "first_seen", "creations", (F.col("creations") == 1).alias("valid"))
