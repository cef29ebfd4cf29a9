"""Point-in-time filters, splits, listing and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_of(rows: DataFrame, event_cutoff: int, arrival_cutoff: int, event: str = "event_us", arrival: str = "arrival_us") -> DataFrame:
    """Rows that had happened and were known by the cutoffs; plain comparisons, so they reach the scan."""
    return rows.where((F.col(event) <= event_cutoff) & (F.col(arrival) <= arrival_cutoff))


def window_split(rows: DataFrame, windows: list[tuple[str, int, int]], group: str, at: str, end: str, ident: str) -> DataFrame:
    """`rows` with partition and reason: outside all windows, label past the window's end, or a group that an earlier row
    put into another window.  Windows are a list of literals, not a join."""
    name, stop = F.lit(None).cast("string"), F.lit(None).cast("long")
    for label, low, high in windows:
        inside = (F.col(at) >= low) & (F.col(at) < high)
        name, stop = F.when(inside, label).otherwise(name), F.when(inside, F.lit(high)).otherwise(stop)
    placed = rows.withColumn("__w", name).withColumn("__r", F.when(F.col("__w").isNull(), "outside_windows").when(F.col(end) > stop, "label_exceeds_partition_end"))
    own = placed.where("__r is null").groupBy(group).agg(F.min_by("__w", F.struct(at, ident)).alias("__own"))
    out = placed.join(own, group, "left")
    kept = F.col("__r").isNull() & (F.col("__w") == F.col("__own"))
    return out.withColumn("partition", F.when(kept, F.col("__w"))).withColumn("reason", F.when(F.col("__r").isNotNull(), F.col("__r")).when(~kept, "group_reused_across_partitions")).drop("__w", "__r", "__own")


def page(rows: DataFrame, order: str, ident: str, descending: bool = False, limit: int = 100, after: tuple | None = None) -> DataFrame:
    """One page in a stable order (key, then id ascending), by the last key and id of the page before instead of an offset.
    At most 100 rows: a limit is the feature."""
    if after is not None:
        beyond = F.col(order) < F.lit(after[0]) if descending else F.col(order) > F.lit(after[0])
        rows = rows.where(beyond | ((F.col(order) == F.lit(after[0])) & (F.col(ident) > F.lit(after[1]))))
    return rows.orderBy(F.col(order).desc() if descending else F.col(order).asc(), F.col(ident).asc()).limit(min(limit, 100))


def search(rows: DataFrame, facets: dict[str, object], text: str | None, columns: list[str]) -> DataFrame:
    """Rows equal to every facet with the text, in any case, inside any of the columns."""
    for name, value in facets.items():
        rows = rows.where(F.col(name) == F.lit(value))
    if text:
        found = F.lit(False)
        for c in columns:
            found = found | F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower()))
        rows = rows.where(found)
    return rows


def claim_time_audit(claims: DataFrame, cutoff: int, published: str = "published_us", retrieved: str = "retrieved_us") -> DataFrame:
    """`claims` with usable: published (or else retrieved) and retrieved by the cutoff, and not retrieved before published."""
    p = F.coalesce(F.col(published), F.col(retrieved))
    return claims.withColumn("usable", F.coalesce((p <= cutoff) & (F.col(retrieved) <= cutoff) & (F.col(retrieved) >= p), F.lit(False)))
