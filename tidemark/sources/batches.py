"""Raw batches, exports, snapshots and bundles: written once with a manifest, verified when read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.canon import canonical_json, row_hash
from tidemark.sources.shared import shared_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def rows_hash(hashed: Column) -> Column:
    """An aggregate: a hash of all row hashes whatever their order, from sums of their parts, so no task gathers a group."""
    part = lambda i: F.coalesce(F.sum(F.conv(F.substring(hashed, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return F.sha2(F.concat_ws(",", *[part(i) for i in range(5)]).cast("binary"), 256)


def append_raw(events: DataFrame, path: str, columns: list[str], by: list[str]) -> DataFrame:
    """Append events as JSON lines (gzip) under source and date, unless the batch is there; returns the manifest rows added.

    A batch is the rows of one `by` group; its id is a hash of its row hashes.  The manifest
    (batch_id, rows, by columns) is a table beside the data, so appending again changes nothing.  A batch's folder is
    overwritten and its manifest row comes last: an append that was cut off is repeated as a whole.
    """
    spark = events.sparkSession
    hashed = events.withColumn("__h", row_hash(columns))
    batches = hashed.groupBy(*by).agg(rows_hash(F.col("__h")).alias("batch_id"), F.count("*").alias("rows"))
    try:
        known = spark.read.parquet(f"{path}/manifest").select("batch_id")
        batches = batches.join(known, "batch_id", "left_anti")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    new = events.join(batches.select(*by, "batch_id"), by)
    new.select("batch_id", *by, canonical_json(columns).alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", *by).option("compression", "gzip").text(f"{path}/data")
    batches.write.mode("append").parquet(f"{path}/manifest")
    return batches


def scan_raw(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows with batch_id, report of (batch_id, expected, found, corrupt, sound)) of what `append_raw` wrote.

    Rows that aren't JSON of the schema are counted as corrupt, not dropped silently; a batch whose
    count or hash differs from its manifest isn't sound.
    """
    names = [f.name for f in schema.fields]
    text = spark.read.option("basePath", f"{path}/data").text(f"{path}/data")
    parsed = text.withColumn("__r", F.from_json("value", T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())]), {"columnNameOfCorruptRecord": "_corrupt"}))
    rows = parsed.select("batch_id", "__r.*")
    hashed = rows.withColumn("__h", row_hash(names))
    found = hashed.groupBy("batch_id").agg(F.count_if(F.col("_corrupt").isNull()).alias("found"), F.count_if(F.col("_corrupt").isNotNull()).alias("corrupt"), rows_hash(F.when(F.col("_corrupt").isNull(), F.col("__h"))).alias("__id"))
    manifest = spark.read.parquet(f"{path}/manifest").select("batch_id", F.col("rows").alias("expected"))
    report = manifest.join(found, "batch_id", "left").select("batch_id", "expected", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("corrupt", F.lit(0)).alias("corrupt"), F.coalesce((F.col("expected") == F.col("found")) & (F.col("__id") == F.col("batch_id")), F.lit(False)).alias("sound"))
    return rows.where("_corrupt is null").drop("_corrupt"), report


def export(rows: DataFrame, path: str, key: str, columns: list[str]) -> None:
    """One record_json column (zstd) and a manifest of keys and record hashes."""
    record = canonical_json(columns)
    rows.select(record.alias("record_json")).write.option("compression", "zstd").parquet(f"{path}/records")
    rows.select(F.col(key).cast("string").alias("key"), F.sha2(record.cast("binary"), 256).alias("hash")).write.parquet(f"{path}/manifest")


def read_export(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, record_json, state): verified, or changed, unlisted or missing against the manifest."""
    records = spark.read.parquet(f"{path}/records")
    found = records.select(F.get_json_object("record_json", f"$.{key}").alias("key"), "record_json", F.sha2(F.col("record_json").cast("binary"), 256).alias("found"))
    manifest = spark.read.parquet(f"{path}/manifest")
    both = found.join(manifest, "key", "full")
    return both.select("key", "record_json", F.when(F.col("found").isNull(), "missing").when(F.col("hash").isNull(), "unlisted").when(F.col("found") != F.col("hash"), "changed").otherwise("verified").alias("state"))


def snapshots(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Snapshots to add: id from the content, duplicates left out, `valid` if what one replaces has its source and type.

    current and incoming have (source, kind, content, replaces); current also snapshot_id.
    """
    named = incoming.withColumn("snapshot_id", F.substring(F.sha2(F.concat_ws("|", "source", "kind", "content").cast("binary"), 256), 1, 24))
    new = named.join(current.select("snapshot_id"), "snapshot_id", "left_anti")
    old = current.select(F.col("snapshot_id").alias("replaces"), F.col("source").alias("__s"), F.col("kind").alias("__k"))
    joined = new.join(old, "replaces", "left")
    fits = F.col("replaces").isNull() | F.coalesce((F.col("source") == F.col("__s")) & (F.col("kind") == F.col("__k")), F.lit(False))
    return joined.select("snapshot_id", "source", "kind", "content", "replaces", fits.alias("valid"))


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """Several tables and a manifest with rows and an order-independent hash of each; the manifest is written last, so a
    bundle without one isn't complete."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    rows = None
    for name in tables:
        one = bundle_hash(spark.read.parquet(f"{path}/{name}"), name)
        rows = one if rows is None else rows.unionByName(one)
    rows.write.parquet(f"{path}/manifest")


def bundle_hash(df: DataFrame, name: str) -> DataFrame:
    """(name, rows, content_hash): a sum of 64-bit halves of the row hashes, so no row order and no single task is needed."""
    h = df.select(row_hash(sorted(df.columns)).alias("h"))
    return h.agg(F.count("*").alias("rows"), rows_hash(F.col("h")).alias("content_hash")).select(F.lit(name).alias("name"), "rows", "content_hash")


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a bundle; an error if one doesn't match the manifest."""
    out = {}
    for row in spark.read.parquet(f"{path}/manifest").collect():
        df = spark.read.parquet(f"{path}/{row['name']}")
        if bundle_hash(df, row["name"]).first()["content_hash"] != row["content_hash"]:
            raise ValueError(f"table {row['name']} doesn't match the bundle's manifest")
        out[row["name"]] = df
    return out
