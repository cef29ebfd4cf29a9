"""What the operators need from the session: the shared folder, checkpoints and checked broadcasts."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.shared import cut, shared_dir, small_or_shuffled

__all__ = ["ARROW_BYTES", "bounded_batches", "cut", "fresh_path", "partitions", "shared_dir", "small_or_shuffled", "spare_name"]


#: Bytes of an Arrow batch that goes to a Python task, at most about.
ARROW_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit of Arrow batches to `ARROW_BYTES`, so that what a Python task and its JVM buffers hold depends on
    bytes and not on rows.  A lower limit stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", str(spark.conf.get(key)).lower()).groups()
    now = int(number) << 10 * " kmgtp".index(unit or " ")
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(key, ARROW_BYTES)


def spare_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
