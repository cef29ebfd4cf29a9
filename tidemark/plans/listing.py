"""Queries of contracts, claims, listing, search and redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.redact import redact_text, url_origin
from tidemark.operators import claims, contracts, filters
from tidemark.plans.bindings import DAY, query, raw_events, table
from tidemark.plans.market import START

_RULES = [
    ("negative_balance", lambda c: c("c_acctbal") >= 0), ("name", contracts.matches("c_name", r"^Customer#[0-9]{9}$")), ("nation", contracts.between("c_nationkey", 0, 19)),
    ("segment", contracts.one_of("c_mktsegment", "BUILDING", "AUTOMOBILE", "HOUSEHOLD")),
]


@query("validate_contract", "vc AS (SELECT c_custkey, concat_ws(',', CASE WHEN NOT c_acctbal >= 0 THEN 'negative_balance' END, CASE WHEN NOT regexp_full_match(c_name, 'Customer#[0-9]{9}') THEN 'name' END, CASE WHEN NOT c_nationkey BETWEEN 0 AND 19 THEN 'nation' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'HOUSEHOLD') THEN 'segment' END) AS reasons FROM customer) SELECT c_custkey, reasons, reasons = '' AS valid FROM vc")
def validate_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.validate(table(spark, sf_dir, "customer"), _RULES).select("c_custkey", "reasons", "valid")


_EVENT = """SELECT event_id, concat_ws(',', CASE WHEN event_id % 43 = 0 THEN 'chain_id' END, CASE WHEN event_id % 41 = 0 THEN 'source' END, CASE WHEN event_id % 47 = 0 THEN 'block_hash' END, CASE WHEN event_id % 37 = 0 THEN 'log_index' END,
 CASE WHEN event_id % 59 = 0 THEN 'event_time' END, CASE WHEN event_id % 61 = 0 THEN 'ingestion_run' END, CASE WHEN event_id % 53 = 0 THEN 'status' END, CASE WHEN event_id % 53 <> 0 AND status = 'orphaned' AND event_id % 47 <> 0 AND event_id % 3 = 0 THEN 'orphan_hash' END) AS reasons FROM ev"""


@query("validate_raw_events", f"vr AS ({_EVENT}) SELECT event_id, reasons, reasons = '' AS valid FROM vr")
def validate_raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw-event contract over the event log with some fields broken by rule."""
    i = F.col("event_id")
    word = F.concat(F.lit("0x"), F.sha2(i.cast("string").cast("binary"), 256))
    text = F.date_format(F.timestamp_micros("event_us"), "yyyy-MM-dd'T'HH:mm:ss")
    rows = raw_events(spark, sf_dir).select(
        "event_id", F.when(i % 41 != 0, "feed").alias("source"), F.lit("v1").alias("source_schema_version"), F.when(i % 43 == 0, 0).otherwise(7).alias("chain_id"), F.when(i % 4 != 0, F.col("block")).alias("block_number"),
        F.when(i % 47 == 0, F.lit("0xbad")).when(i % 3 == 0, None).otherwise(word).alias("block_hash"), F.when(i % 5 != 0, word).alias("parent_hash"),
        word.alias("transaction_hash"), F.when(i % 37 == 0, -1).otherwise(i % 90).alias("log_index"), F.concat(text, F.when(i % 59 == 0, "").when(i % 2 == 0, "Z").otherwise("+02:00")).alias("event_time"), F.timestamp_micros("arrival_us").alias("received_time"),
        F.col("props").alias("payload"), F.when(i % 61 == 0, " ").otherwise("run").alias("ingestion_run"), F.when(i % 53 == 0, "lost").otherwise(F.col("status")).alias("canonical_status"),
    )
    return contracts.validate(rows, "raw_event").select("event_id", "reasons", "valid")


@query("faceted_list", "SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_brand = 'Brand#2' AND (contains(lower(p_name), 'red') OR contains(lower(p_type), 'red')) ")
def faceted_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.search(table(spark, sf_dir, "part"), {"p_brand": "Brand#2"}, "RED", ["p_name", "p_type"]).select("p_partkey", "p_name", "p_brand", "p_size").sort("p_partkey")


@query("point_lookup", "SELECT p_partkey, p_name, p_brand FROM part WHERE lower(p_name) = 'red widget'")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.lower("p_name") == "red widget").select("p_partkey", "p_name", "p_brand")


@query("stable_page", "SELECT c_custkey, c_acctbal, (SELECT count(*) FROM customer) AS total FROM customer WHERE c_acctbal < 5000.0 OR (c_acctbal = 5000.0 AND c_custkey > 0) ORDER BY c_acctbal DESC, c_custkey ASC LIMIT 100")
def stable_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    total = customers.agg(F.count("*").alias("total"))
    return filters.page(customers, "c_acctbal", "c_custkey", descending=True, after=(5000.0, 0)).crossJoin(F.broadcast(total))


@query("catalog_counts", "SELECT 'customer' AS entity, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS flagged FROM customer UNION ALL SELECT 'supplier', count(*), count(*) FILTER (s_acctbal < 0) FROM supplier UNION ALL SELECT 'part', count(*), count(*) FILTER (p_size > 40) FROM part UNION ALL SELECT 'event', count(*), count(*) FILTER (event_type = 'error') FROM events")
def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda name, rule: table(spark, sf_dir, name.rstrip("s") if name != "events" else name).agg(F.count("*").alias("n"), F.count_if(rule).alias("flagged")).select(F.lit(name.rstrip("s") if name == "events" else name).alias("entity"), "n", "flagged")
    return count("customer", F.col("c_acctbal") < 0).unionByName(count("supplier", F.col("s_acctbal") < 0)).unionByName(count("part", F.col("p_size") > 40)).unionByName(count("events", F.col("event_type") == "error"))


@query("redact_url", r"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+)', 1)) AS origin FROM pages")
def redact_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", url_origin(F.col("url")).alias("origin"))


@query("redact_text", r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z][A-Za-z0-9+.-]*://[^\s"''<>]+', '<url>', 'g'), '(?i)\bbearer\s+[^\s"'']+', '<token>', 'g'), '(?i)\b(api[_-]?key|token|secret|password)\b(\s*[=:]\s*)[^\s,;"'']+', '\1\2<redacted>', 'g'), '(?i)\b(0x)?[0-9a-f]{64}\b', '<hex>', 'g')) AS redacted_sha256 FROM documents""")
def redact_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(redact_text(F.col("text")).cast("binary"), 256).alias("redacted_sha256"))


@query("normalize_claim", """SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'unknown' END AS claim_status, CAST(json_extract_string(props, '$.k') AS BIGINT) AS claim_value FROM events""")
def normalize_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"status": "'), F.upper("event_type"), F.lit('", '), F.substring("props", 2, 1000)).alias("payload"))
    return claims.normalize_claim(raw, "payload", ["click", "view", "purchase"]).select("event_id", "claim_status", "claim_value")


@query("claim_time_audit", f"cl AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN {START} + doc_id * 3600000000 END AS published_us, {START} + doc_id * 3600000000 + (doc_id % 9 - 2) * 7200000000 AS retrieved_us FROM documents) SELECT doc_id, coalesce(coalesce(published_us, retrieved_us) <= {START + 20 * DAY} AND retrieved_us <= {START + 20 * DAY} AND retrieved_us >= coalesce(published_us, retrieved_us), false) AS usable FROM cl")
def claim_time_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit(START) + F.col("doc_id") * 3_600_000_000
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, at).alias("published_us"), (at + (F.col("doc_id") % 9 - 2) * 7_200_000_000).alias("retrieved_us"))
    return filters.claim_time_audit(rows, START + 20 * DAY).select("doc_id", "usable")


@query("permitted_text", "SELECT page_id, coalesce(page_id % 3 <> 0 AND url IS NOT NULL AND length(html) > 0, false) AS permitted FROM pages")
def permitted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.permitted_text(table(spark, sf_dir, "pages"), F.col("page_id") % 3 != 0, F.col("url"), F.col("html")).select("page_id", "permitted")


@query("validate_claims", """SELECT doc_id, claim_type, accepted, CASE WHEN claim_type NOT IN ('quality', 'topic') THEN 'unsupported_type' WHEN NOT spanned THEN 'no_evidence' WHEN NOT accepted THEN 'invented_span' END AS reason, cache_key FROM (
SELECT doc_id, claim_type, spanned, claim_type IN ('quality', 'topic') AND spanned AND contains(text, span) AS accepted, sha256(concat_ws('|', 'm1', 'p1', text)) AS cache_key FROM (
SELECT d.doc_id, d.text, CASE d.doc_id % 5 WHEN 0 THEN 'rumour' WHEN 1 THEN 'topic' ELSE 'quality' END AS claim_type, d.doc_id % 7 <> 0 AS spanned, CASE WHEN d.doc_id % 3 = 0 THEN b.text ELSE substr(d.text, 11, 30) END AS span FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id))""")
def validate_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quoted"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(b), i % 40 == F.col("item_id"))
    span = F.when(i % 3 == 0, F.col("quoted")).otherwise(F.substring("text", 11, 30))
    rows = rows.select("doc_id", F.when(i % 5 == 0, "rumour").when(i % 5 == 1, "topic").otherwise("quality").alias("claim_type"), F.col("text").alias("source_text"), F.when(i % 7 != 0, F.array(span)).otherwise(F.array().cast("array<string>")).alias("spans"), F.lit("m1").alias("model"), F.lit("p1").alias("prompt"))
    return claims.validate_claims(rows, ["quality", "topic"]).select("doc_id", "claim_type", "accepted", "reason", "cache_key")


@query("filter_identity", """SELECT n_regionkey, sha256('{"addresses":[' || string_agg('"' || lower(n_name) || '"', ',' ORDER BY lower(n_name)) || '],"chain_id":7}')[1:16] AS identity FROM nation GROUP BY 1""")
def filter_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.array_sort(F.collect_list(F.lower("n_name"))).alias("addresses"), F.lit(7).alias("chain_id")))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.substring(F.sha2(body.cast("binary"), 256), 1, 16).alias("identity"))
