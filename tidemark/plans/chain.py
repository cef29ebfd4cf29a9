"""Queries of ancestry, canonical projection, quality, coverage and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.canon import row_hash, table_hash
from tidemark.operators import chain, policies, windows
from tidemark.plans.bindings import DAY, headers, query, raw_events, table
from tidemark.plans.market import AS_OF

_TIP = "tip AS (SELECT hash, height FROM hd WHERE hash % 10 <> 9 ORDER BY hash DESC LIMIT 1)"
_WALK = f"RECURSIVE {_TIP}, wk(hash, height, parent) AS (SELECT hd.hash, hd.height, hd.parent FROM hd JOIN tip ON hd.hash = tip.hash UNION ALL SELECT hd.hash, hd.height, hd.parent FROM wk JOIN hd ON hd.hash = wk.parent)"


def tip_of(tree: DataFrame) -> tuple[int, int]:
    return tuple(tree.where("hash % 10 <> 9").agg(F.max(F.struct("hash", "height")).alias("t")).select("t.*").first())


@query("ancestry_walk", f"{_WALK} SELECT hash, height, parent, CAST(NULL AS VARCHAR) AS problem FROM wk")
def ancestry_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = headers(spark, sf_dir)
    return chain.ancestry_walk(tree, tip_of(tree)[0])


def _chain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderkey") % 25 == 3, "quarantined").otherwise("provisional").alias("status"))
    return o.join(headers(spark, sf_dir).select(F.col("hash").alias("event_id"), F.col("height").alias("block")), "event_id").withColumn("block_hash", F.col("event_id"))


@query("canonical_projection", f"""{_WALK}, ce AS (SELECT hash AS event_id, height AS block, CASE WHEN hash % 25 = 3 THEN 'quarantined' ELSE 'provisional' END AS status FROM hd),
pr AS (SELECT event_id, CASE WHEN status = 'quarantined' THEN status WHEN wk.hash IS NOT NULL THEN 'canonical' WHEN block < 100 OR block > (SELECT height FROM tip) THEN 'unresolved' ELSE 'orphaned' END AS projected, block FROM ce LEFT JOIN (SELECT * FROM wk WHERE height >= 100) wk ON ce.event_id = wk.hash)
SELECT event_id, projected, projected = 'canonical' AND block <= (SELECT height FROM tip) - 12 AS confirmed FROM pr""")
def canonical_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = headers(spark, sf_dir)
    tip, height = tip_of(tree)
    proven = chain.ancestry_walk(tree, tip).where("height >= 100")
    return chain.canonical_projection(_chain_events(spark, sf_dir), proven, 100, height, F.lit(True), 12).select("event_id", "projected", "confirmed")


@query("header_merge", "ob AS (SELECT hash, height, parent FROM hd UNION ALL SELECT hash, CASE WHEN hash % 97 = 5 THEN height + 1 ELSE height END, CASE WHEN hash % 3 = 0 THEN NULL ELSE parent END FROM hd) SELECT hash, max(height) AS height, max(parent) AS parent, coalesce(min(height) <> max(height) OR min(parent) <> max(parent), false) AS conflict, count(*) AS observations FROM ob GROUP BY hash")
def header_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = headers(spark, sf_dir)
    second = h.select("hash", F.when(F.col("hash") % 97 == 5, F.col("height") + 1).otherwise(F.col("height")).alias("height"), F.when(F.col("hash") % 3 != 0, F.col("parent")).alias("parent"))
    return chain.header_merge(h.unionByName(second))


@query("anchor_state", """an AS (SELECT hash AS source, CASE WHEN hash % 7 = 0 THEN 2 ELSE 1 END AS chain_id, CASE WHEN hash % 11 = 0 THEN height + 1 ELSE height END AS height, CASE WHEN hash % 13 = 0 THEN NULL WHEN hash % 5 = 0 THEN -hash ELSE hash END AS block_hash, CASE WHEN hash % 3 = 0 THEN 'pending' ELSE 'qualified' END AS qualification, CASE WHEN hash % 17 = 0 THEN 'old' ELSE 'cfg' END AS config_identity FROM hd WHERE hash % 10 = 1)
SELECT source, CASE WHEN block_hash IS NULL THEN 'unavailable' WHEN chain_id <> 1 THEN 'unsupported' WHEN config_identity <> 'cfg' THEN 'config_mismatch' WHEN hd.hash IS NULL THEN 'unverified' WHEN hd.height <> an.height THEN 'mismatch' WHEN qualification <> 'qualified' THEN 'unqualified' ELSE 'qualified' END AS state FROM an LEFT JOIN hd ON an.block_hash = hd.hash""")
def anchor_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, k = headers(spark, sf_dir), F.col("hash")
    anchors = h.where("hash % 10 = 1").select(
        k.alias("source"), F.when(k % 7 == 0, 2).otherwise(1).alias("chain_id"), F.when(k % 11 == 0, F.col("height") + 1).otherwise(F.col("height")).alias("height"),
        F.when(k % 13 == 0, None).when(k % 5 == 0, -k).otherwise(k).alias("block_hash"), F.when(k % 3 == 0, "pending").otherwise("qualified").alias("qualification"), F.when(k % 17 == 0, "old").otherwise("cfg").alias("config_identity"),
    )
    return chain.anchor_state(anchors, h, 1, "cfg").select("source", "state")


@query("header_cross_check", "b AS (SELECT height, hash, CASE WHEN hash % 19 = 2 THEN NULL ELSE parent END AS parent FROM hd WHERE hash % 10 <> 9) SELECT a.height, a.hash, b.hash AS hash_b, CASE WHEN a.hash IS NOT DISTINCT FROM b.hash AND a.parent IS NOT DISTINCT FROM b.parent THEN 'accepted' ELSE 'rejected' END AS verdict FROM hd a JOIN b ON a.height = b.height")
def header_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = headers(spark, sf_dir)
    b = h.where("hash % 10 <> 9").withColumn("parent", F.when(F.col("hash") % 19 != 2, F.col("parent")))
    return chain.header_cross_check(h, b)


@query("header_rebind", "SELECT event_id, block, hd.parent AS parent FROM ev LEFT JOIN hd ON ev.event_id = hd.hash")
def header_rebind(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = headers(spark, sf_dir).select(F.col("hash").alias("event_id"), "parent")
    return raw_events(spark, sf_dir).select("event_id", "block").join(h, "event_id", "left")


@query("scan_canonical", "ok AS (SELECT source, max(block) % 2 = max(block) % 2 AS fine FROM ev GROUP BY source) SELECT event_id, ev.source, block FROM ev JOIN ok ON ev.source = ok.source WHERE status = 'canonical' AND fine")
def scan_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.sources.log import scan_canonical as scan

    e = raw_events(spark, sf_dir)
    checkpoints = e.groupBy("source").agg(F.max("block").alias("tip")).select("source", F.lit("canonical").alias("state"))
    return scan(e.select("event_id", "source", "block"), e.select("event_id", "status"), checkpoints)


@query("arrival_filter", f"SELECT event_id, arrival_us FROM ev WHERE arrival_us <= {AS_OF}")
def arrival_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).where(F.col("arrival_us") <= AS_OF).select("event_id", "arrival_us").sort("arrival_us", "event_id")


@query("quality_report", """d AS (SELECT source, event_id, pool, block, status, greatest(0, arrival_us - event_us) AS dl FROM ev),
r AS (SELECT source, dl, row_number() OVER (PARTITION BY source ORDER BY dl) AS rn, count(*) OVER (PARTITION BY source) AS n FROM d)
SELECT d.source, count(*) AS events, count(DISTINCT (pool, block)) AS unique_events, count(*) - count(DISTINCT (pool, block)) AS duplicates, count(*) FILTER (status = 'quarantined') AS quarantined,
 round(avg(dl) / 1000000, 6) AS mean_delay, any_value(p) / 1000000 AS p95_delay, greatest(0, 1100 - max(block)) AS block_lag, CASE WHEN count(*) FILTER (status = 'quarantined') > 0 THEN 'degraded' ELSE 'healthy' END AS state
FROM d JOIN (SELECT source, min(dl) AS p FROM r WHERE rn >= ceil(n * 0.95) GROUP BY source) q ON d.source = q.source GROUP BY d.source""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chain.quality_report(raw_events(spark, sf_dir), ["source"], ["pool", "block"], "block", "event_us", "arrival_us", "status", head=1100)
    return out.select("source", "events", "unique_events", "duplicates", "quarantined", F.round("mean_delay", 6).alias("mean_delay"), "p95_delay", "block_lag", "state")


@query("coverage_audit", """e AS (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1), o AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
b AS (SELECT e.n AS ne, o.n AS no FROM e FULL JOIN o ON e.k = o.k), t AS (SELECT CAST(coalesce(sum(ne), 0) AS BIGINT) AS expected, CAST(coalesce(sum(no), 0) AS BIGINT) AS observed, count(*) FILTER (ne IS NOT NULL AND no IS NOT NULL) AS matched, CAST(coalesce(sum(ne) FILTER (no IS NULL), 0) AS BIGINT) AS missing, count(*) FILTER (no > 1) AS repeated_keys FROM b)
SELECT expected, observed, matched, missing, repeated_keys, round(matched / expected, 6) AS recall, concat_ws(',', CASE WHEN missing > 0 THEN 'expected_records_missing' END, CASE WHEN repeated_keys > 0 THEN 'duplicate_delivery_detected' END) AS notes, CASE WHEN missing = 0 AND repeated_keys = 0 THEN 'pass' ELSE 'degraded' END AS state FROM t""")
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chain.coverage_audit(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])
    return out.withColumn("recall", F.round("recall", 6)).withColumn("notes", F.concat_ws(",", "notes"))


@query("provider_compare", "SELECT o_orderkey // 1000 AS chunk, count(*) AS expected, count(l) AS matched, count(*) = count(l) AS complete FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS l FROM lineitem) ON o_orderkey = l GROUP BY 1")
def provider_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.provider_compare(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k", 1000)


@query("key_intersect", "SELECT o_orderkey AS k FROM orders INTERSECT SELECT l_orderkey FROM lineitem")
def key_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).intersect(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")))


@query("key_except", "SELECT o_orderkey AS k FROM orders EXCEPT ALL SELECT l_orderkey FROM lineitem")
def key_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).exceptAll(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")))


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("refs"))
    return one.unionByName(one)


_DELIVERED = "li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)"
_LINEAGE = "rf AS (SELECT l_orderkey, l_linenumber, string_agg(r, ',' ORDER BY r) AS lineage FROM (SELECT DISTINCT l_orderkey, l_linenumber, unnest(['p' || l_partkey, 's' || l_suppkey]) AS r FROM li) GROUP BY 1, 2)"


@query("dedup_merge", f"""{_DELIVERED}, {_LINEAGE}, g AS (SELECT l_orderkey, l_linenumber, min({{a: l_partkey, b: l_suppkey}}) AS c, max({{a: l_partkey, b: l_suppkey}}) AS x, count(*) AS deliveries FROM li GROUP BY 1, 2)
SELECT g.l_orderkey, g.l_linenumber, c.a AS l_partkey, c.b AS l_suppkey, lineage, c <> x AS conflict, deliveries FROM g JOIN rf ON g.l_orderkey = rf.l_orderkey AND g.l_linenumber = rf.l_linenumber""")
def dedup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.dedup_merge(_deliveries(spark, sf_dir), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"], "refs").withColumn("lineage", F.concat_ws(",", "lineage"))


@query("union_sources", f"{_DELIVERED}, k AS (SELECT l_orderkey, l_linenumber, count(DISTINCT (l_partkey, l_suppkey)) AS shapes, count(*) AS deliveries FROM li GROUP BY 1, 2) SELECT * FROM k WHERE shapes = 1")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = chain.dedup_merge(_deliveries(spark, sf_dir), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"], "refs")
    return merged.where("not conflict").select("l_orderkey", "l_linenumber", F.lit(1).cast("long").alias("shapes"), "deliveries")


@query("lineage_union", f"{_DELIVERED}, {_LINEAGE} SELECT l_orderkey, string_agg(r, ',' ORDER BY r) AS lineage FROM (SELECT DISTINCT l_orderkey, unnest(string_split(lineage, ',')) AS r FROM rf) GROUP BY 1")
def lineage_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deliveries(spark, sf_dir).select("l_orderkey", F.explode("refs").alias("r")).groupBy("l_orderkey").agg(F.concat_ws(",", F.array_sort(F.collect_set("r"))).alias("lineage"))


_PART_HASH = "sha256(concat_ws('|', CAST(p_partkey AS VARCHAR), p_name, p_brand, CAST(p_size AS VARCHAR)))"


@query("content_hashes", f"""h AS (SELECT p_brand, {_PART_HASH} AS x FROM part), b AS (SELECT p_brand, x[1:2] AS b, count(*) AS n, sha256(string_agg(x, ',' ORDER BY x)) AS p FROM h GROUP BY 1, 2)
SELECT p_brand, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(p, ',' ORDER BY b)) AS content_hash FROM b GROUP BY 1""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_hash(table(spark, sf_dir, "part"), ["p_partkey", "p_name", "p_brand", "p_size"], ["p_brand"])


@query("provenance_bind", f"SELECT p_partkey, {_PART_HASH} AS recorded, p_partkey % 40 <> 7 AS bound FROM part")
def provenance_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows against their recorded hashes, of which every fortieth is of a changed row."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    columns = ["p_partkey", "p_name", "p_brand", "p_size"]
    recorded = p.select("p_partkey", row_hash(columns).alias("recorded"))
    changed = p.withColumn("p_size", F.when(F.col("p_partkey") % 40 == 7, F.col("p_size") + 1).otherwise(F.col("p_size"))).select("p_partkey", row_hash(columns).alias("found"))
    return recorded.join(changed, "p_partkey").select("p_partkey", "recorded", (F.col("recorded") == F.col("found")).alias("bound"))


@query("launch_projection", "SELECT pool AS token, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'graduated' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'unknown' ELSE 'active' END AS state, min(arrival_us) AS first_seen, count(*) FILTER (event_type = 'signup') AS creations, count(*) FILTER (event_type = 'signup') = 1 AS valid FROM ev GROUP BY pool")
def launch_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_events(spark, sf_dir).withColumnRenamed("pool", "token")
    return chain.fold_lifecycle(e, "token", "event_type", "arrival_us", "signup", "purchase", "error")


@query("lifecycle_as_of", f"t AS (SELECT DISTINCT pool AS token FROM ev), l AS (SELECT pool, event_type FROM ev WHERE arrival_us <= {AS_OF - 20 * 86_400_000_000} AND event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY pool ORDER BY arrival_us DESC, event_id DESC) = 1) SELECT token, coalesce(event_type, 'unknown') AS state FROM t LEFT JOIN l ON token = pool")
def lifecycle_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_events(spark, sf_dir)
    revisions = e.where((F.col("arrival_us") <= AS_OF - 20 * 86_400_000_000) & (F.col("event_type") != "view")).select("pool", "event_type", "arrival_us", "event_id")
    latest = windows.latest_by_key(revisions, ["pool"], ["arrival_us", "event_id"]).select(F.col("pool").alias("token"), "event_type")
    return e.select(F.col("pool").alias("token")).distinct().join(latest, "token", "left").select("token", F.coalesce("event_type", F.lit("unknown")).alias("state"))


@query("cohort_as_of", f"l AS (SELECT source, pool, event_id % 4 <> 0 AS member FROM ev WHERE arrival_us <= {AS_OF} QUALIFY row_number() OVER (PARTITION BY source, pool ORDER BY arrival_us DESC, event_id DESC) = 1) SELECT source AS cohort, count(*) AS wallets, count(*) FILTER (member) AS members, bool_and(member) AS all_members FROM l GROUP BY 1")
def cohort_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_events(spark, sf_dir).where(F.col("arrival_us") <= AS_OF).select("source", "pool", "arrival_us", "event_id", (F.col("event_id") % 4 != 0).alias("member"))
    latest = windows.latest_by_key(e, ["source", "pool"], ["arrival_us", "event_id"])
    return latest.groupBy(F.col("source").alias("cohort")).agg(F.count("*").alias("wallets"), F.count_if("member").alias("members"), F.bool_and("member").alias("all_members"))


@query("discovery_snapshot", f"f AS (SELECT pool, min(arrival_us) AS first_seen, count(*) FILTER (status = 'canonical' AND arrival_us <= {AS_OF}) AS canonical, count(*) FILTER (event_type = 'purchase' AND arrival_us <= {AS_OF}) AS known FROM ev GROUP BY pool) SELECT count(*) FILTER (first_seen <= {AS_OF}) AS discovered, CAST(sum(canonical) AS BIGINT) AS canonical_events, count(*) FILTER (first_seen <= {AS_OF} AND known = 0) AS unknown_lifecycle, concat_ws(',', CASE WHEN count(*) FILTER (first_seen <= {AS_OF} AND known = 0) > 0 THEN 'lifecycle_unknown' END, CASE WHEN count(*) FILTER (first_seen > {AS_OF}) > 0 THEN 'later_discoveries_hidden' END) AS missingness FROM f")
def discovery_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.col("arrival_us") <= AS_OF
    per = raw_events(spark, sf_dir).groupBy("pool").agg(F.min("arrival_us").alias("first_seen"), F.count_if((F.col("status") == "canonical") & seen).alias("canonical"), F.count_if((F.col("event_type") == "purchase") & seen).alias("known"))
    unknown = F.count_if((F.col("first_seen") <= AS_OF) & (F.col("known") == 0))
    return per.agg(F.count_if(F.col("first_seen") <= AS_OF).alias("discovered"), F.sum("canonical").alias("canonical_events"), unknown.alias("unknown_lifecycle"), F.concat_ws(",", F.when(unknown > 0, "lifecycle_unknown"), F.when(F.count_if(F.col("first_seen") > AS_OF) > 0, "later_discoveries_hidden")).alias("missingness"))


@query("swap_identity_join", "id AS (SELECT pool, arg_min({e: event_us, a: arrival_us, i: event_id}, {e: event_us, a: arrival_us, i: event_id}) AS f, count(DISTINCT event_type) > 1 AS conflict FROM ev WHERE event_type IN ('signup', 'view') GROUP BY pool) SELECT event_id, f.i AS identity_id, CASE WHEN f IS NULL THEN 'identity_missing' WHEN f.e < event_us AND f.a < arrival_us THEN 'joined' ELSE 'before_initialisation' END AS state, conflict FROM ev LEFT JOIN id ON ev.pool = id.pool WHERE event_type NOT IN ('signup', 'view')")
def swap_identity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_events(spark, sf_dir)
    identity = e.where(F.col("event_type").isin("signup", "view")).groupBy("pool").agg(F.min(F.struct("event_us", "arrival_us", "event_id")).alias("f"), (F.count_distinct("event_type") > 1).alias("conflict"))
    state = F.when(F.col("f").isNull(), "identity_missing").when((F.col("f.event_us") < F.col("event_us")) & (F.col("f.arrival_us") < F.col("arrival_us")), "joined").otherwise("before_initialisation")
    return e.where(~F.col("event_type").isin("signup", "view")).join(identity, "pool", "left").select("event_id", F.col("f.event_id").alias("identity_id"), state.alias("state"), "conflict")


@query("pool_identity", "SELECT pool, min({e: event_us, a: arrival_us, i: event_id}).i AS identity_id, count(DISTINCT event_type) > 1 AS conflict FROM ev WHERE event_type IN ('signup', 'view') GROUP BY pool")
def pool_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_events(spark, sf_dir).where(F.col("event_type").isin("signup", "view"))
    return e.groupBy("pool").agg(F.min(F.struct("event_us", "arrival_us", "event_id")).alias("f"), (F.count_distinct("event_type") > 1).alias("conflict")).select("pool", F.col("f.event_id").alias("identity_id"), "conflict")


@query("shadow_window_audit", f"""w AS (SELECT pool, min(event_us) AS a, CASE WHEN pool % 9 <> 0 THEN max(event_us) END AS b, count(*) FILTER (event_type IN ('signup', 'purchase')) AS launches, count(*) FILTER (status = 'canonical') AS scheduled,
 count(*) FILTER (status = 'canonical' AND event_id % 61 = 0) AS missed, count(*) FILTER (status = 'quarantined' AND event_id % 3 = 0) AS gaps FROM ev GROUP BY 1),
x AS (SELECT *, coalesce(b - a, 0) AS duration_us, CASE WHEN scheduled > 0 THEN (scheduled - missed) * 10000 // scheduled END AS availability_bps FROM w),
y AS (SELECT pool, duration_us, availability_bps, concat_ws(',', CASE WHEN duration_us < {14 * DAY} THEN 'insufficient_duration' END, CASE WHEN launches < 20 THEN 'insufficient_eligible_launches' END,
 CASE WHEN availability_bps IS NULL OR availability_bps < 9800 THEN 'healthy_interval_availability_below_gate' END, CASE WHEN gaps > 0 THEN 'unresolved_source_gaps' END) AS reasons FROM x)
SELECT pool, duration_us, availability_bps, reasons, CASE WHEN reasons = '' THEN 'pass' ELSE 'inconclusive' END AS state FROM y""")
def shadow_window_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of each pool, some still open, with its launches, canonical decisions, missed ones and open gaps."""
    own, canonical = F.col("event_id"), F.col("status") == "canonical"
    w = raw_events(spark, sf_dir).groupBy("pool").agg(
        F.min("event_us").alias("start_us"), F.max("event_us").alias("last_us"), F.count_if(F.col("event_type").isin("signup", "purchase")).alias("launches"), F.count_if(canonical).alias("scheduled"),
        F.count_if(canonical & (own % 61 == 0)).alias("missed"), F.count_if((F.col("status") == "quarantined") & (own % 3 == 0)).alias("gaps"),
    )
    w = w.withColumn("end_us", F.when(F.col("pool") % 9 != 0, F.col("last_us")))
    return policies.audit_window(w, 14, 20, 9800).select("pool", "duration_us", "availability_bps", F.array_join("reasons", ",").alias("reasons"), "state")
