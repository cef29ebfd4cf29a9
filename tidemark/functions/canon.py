"""Canonical JSON and content hashes of rows and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(columns: list[str]) -> Column:
    """One JSON object a row, keys in alphabetical order, nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def row_hash(columns: list[str], separator: str = "|") -> Column:
    """SHA-256 of the columns as text between separators, a null as the word null."""
    return F.sha2(F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]).cast("binary"), 256)


def table_hash(df: DataFrame, columns: list[str], by: list[str], buckets: int = 256) -> DataFrame:
    """(`by` columns, rows, content_hash): a hash of bucket hashes, each of the sorted row hashes whose first two digits
    are the bucket's.  No task gathers more than a bucket of one table."""
    hashed = df.select(*by, row_hash(columns).alias("h"))
    parts = hashed.groupBy(*by, F.substring("h", 1, 2).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("h"))).cast("binary"), 256).alias("p"))
    whole = F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("b", "p"))), lambda x: x["p"])).cast("binary"), 256)
    return parts.groupBy(*by).agg(F.sum("n").alias("rows"), whole.alias("content_hash"))
