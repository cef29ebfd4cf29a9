"""Maps from assets to wide integers, kept as words: added up in one aggregation, shown as decimal strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import words

ZERO = "0" * 64


def each(items: Column, body: Callable[[Column], Column], upto: int) -> Column:
    """`transform` that names up to so many elements one by one, as Spark compiles these and only interprets a lambda."""
    at = [body(F.get(items, F.lit(i))) for i in range(upto)]
    out = F.when(F.size(items) == 1, F.array(at[0]))
    for n in range(2, upto + 1):
        out = out.when(F.size(items) == n, F.array(*at[:n]))
    return out.otherwise(F.transform(items, body))


def asset_sums(rows: DataFrame, by: list[str], asset: str, word: str) -> DataFrame:
    """(by, asset, total): exact sums of words, however many rows a group has; partial sums are made before the shuffle."""
    summed = rows.groupBy(*by, asset).agg(*words.limb_sums(F.col(word)))
    return summed.select(*by, asset, words.carry(F.array(*[F.col(f"limb{i}") for i in range(words.LIMBS)])).alias("total"))


def to_map(asset: str, total: str, when: Column | None = None, drop_zero: bool = True) -> Column:
    """An aggregate: the map of a group's assets to their totals, in the order of assets; empty without any."""
    keep = (F.col(total) != ZERO) if drop_zero else F.lit(True)
    if when is not None:
        keep = keep & when
    return F.map_from_entries(F.array_sort(F.collect_list(F.when(keep, F.struct(F.col(asset).alias("key"), F.col(total).alias("value"))))))


def merged(df: DataFrame, by: list[str], column: str, drop_zero: bool = True) -> DataFrame:
    """(by, column): the maps of a group added up asset by asset.  A group whose maps are null or empty has an empty map."""
    entries = df.select(*by, F.explode_outer(column).alias("__asset", "__word"))
    totals = asset_sums(entries, by, "__asset", "__word")
    return totals.groupBy(*by).agg(to_map("__asset", "total", F.col("__asset").isNotNull(), drop_zero).alias(column))


def decimals(column: Column) -> Column:
    """A map of words as a map of decimal strings."""
    return F.transform_values(column, lambda _, word: words.decimal_text(word))


def text(column: Column) -> Column:
    """asset:amount of each entry of a map of words, joined by commas in the order of assets."""
    entries = F.sort_array(F.map_entries(column))
    return F.array_join(each(entries, lambda e: F.concat(e["key"], F.lit(":"), words.given_text(e["value"])), 1), ",")
