"""Reading the event log: canonical scans, verified batches and exports, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan_canonical(events: DataFrame, projection: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Events whose projected status is canonical, of sources whose checkpoint is canonical; none of the others."""
    sound = checkpoints.where("state = 'canonical'").select("source")
    return events.join(projection.where(F.col("status") == "canonical").select("event_id"), "event_id", "left_semi").join(F.broadcast(sound), "source", "left_semi").select(*events.columns)
