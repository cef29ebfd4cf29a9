"""Text claims: only typed ones whose evidence is a literal span of their source are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate_claims(claims: DataFrame, kinds: list[str]) -> DataFrame:
    """`claims` (claim_type, source_text, spans array, model, prompt) with accepted, reason and cache_key.

    cache_key is the SHA-256 of model, prompt and text; a null span isn't evidence.
    """
    grounded = F.forall("spans", lambda s: F.coalesce(F.contains(F.col("source_text"), s), F.lit(False)))
    why = F.when(~F.coalesce(F.col("claim_type").isin(kinds), F.lit(False)), "unsupported_type").when(F.coalesce(F.size("spans"), F.lit(0)) < 1, "no_evidence").when(~grounded, "invented_span")
    key = F.sha2(F.concat_ws("|", F.col("model"), F.col("prompt"), F.col("source_text")).cast("binary"), 256)
    return claims.withColumn("reason", why).withColumn("accepted", F.col("reason").isNull()).withColumn("cache_key", key)


def permitted_text(records: DataFrame, permission: Column, url: Column, content: Column) -> DataFrame:
    """`records` with permitted: marked so, with an address and content."""
    return records.withColumn("permitted", F.coalesce(permission & url.isNotNull() & (F.length(content) > 0), F.lit(False)))


def normalize_claim(raw: DataFrame, json: str, known: list[str]) -> DataFrame:
    """`raw` with claim_status and claim_value of a vendor's JSON; an unknown status is `unknown`."""
    status = F.lower(F.get_json_object(json, "$.status"))
    return raw.withColumn("claim_status", F.when(status.isin(known), status).otherwise("unknown")).withColumn("claim_value", F.expr(f"try_cast(get_json_object(`{json}`, '$.k') AS bigint)"))
