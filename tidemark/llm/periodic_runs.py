"""Periodic runs of words by descending-LCP Kruskal.

The suffixes of a text's words are sorted, and suffix classes are united in the order of falling
longest common prefix (LCP), as Kruskal's algorithm unites trees.  A class keeps its positions in
order.  When two classes are united at LCP `l`, two positions that become neighbours at distance
d <= l begin a repetition of period d that lasts l + d words.  The first words of a run and of its
second period are such neighbours, with d the smallest period: a position between them would give
a smaller period.  A seed whose preceding words differ is therefore exactly one run.

Work is O(n log n) for n words: the smaller class always joins the larger one.  A text is one row
of one task; nothing is shuffled.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches
from tidemark.llm.text import RUN_BYTES, as_bytes, chunks

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_SPACE = re.compile(rb"[ \t-\r]")
#: Positions in one list of a class.
_LIST = 512


def spaced_parts(raw: bytes, size: int | None = None) -> Iterator[bytes]:
    """A text in parts of about `size` (`RUN_BYTES`) bytes that end between words [^\\x20\\x09-\\x0D]+."""
    low, size = 0, size or RUN_BYTES
    while low < len(raw):
        space = _SPACE.search(raw, low + size) if len(raw) - low > size else None
        high = space.start() if space else len(raw)
        yield raw[low:high]
        low = high


def word_lists(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of about `RUN_BYTES`."""
    return (part.split() for part in spaced_parts(raw))


class Positions:
    """Ascending positions of one suffix class, in lists of bounded length."""

    __slots__ = ("heads", "lists", "size")

    def __init__(self, at: int):
        self.heads, self.lists, self.size = [at], [[at]], 1

    def __iter__(self) -> Iterator[int]:
        return itertools.chain.from_iterable(self.lists)

    def insert(self, at: int) -> tuple[int, int]:
        """Add a position; its neighbours before and after, -1 for none."""
        heads, lists = self.heads, self.lists
        k = max(bisect_left(heads, at) - 1, 0)
        here = lists[k]
        i = bisect_left(here, at)
        before = here[i - 1] if i else -1
        after = here[i] if i < len(here) else lists[k + 1][0] if k + 1 < len(lists) else -1
        here.insert(i, at)
        heads[k] = here[0]
        self.size += 1
        if len(here) > _LIST:
            upper = here[_LIST // 2 :]
            del here[_LIST // 2 :]
            lists.insert(k + 1, upper)
            heads.insert(k + 1, upper[0])
        return before, after


def suffix_order(ids: np.ndarray) -> np.ndarray:
    """The positions in the order of their suffixes, by prefix doubling over the positions that still tie.
    The last id occurs nowhere else."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    place = np.arange(n)
    first = np.maximum.accumulate(np.where(np.diff(ids[order], prepend=-1) != 0, place, 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    tied = np.bincount(first, minlength=n)[first] > 1
    active, step = order[tied], 1
    while len(active):
        # A tied suffix shares `step` words with another one, so the text goes on behind them.
        group = rank[active]
        key = group * n + rank[active + step]
        by = np.argsort(key)
        active, key, group = active[by], key[by], group[by]
        place = np.arange(len(active))
        begins = np.maximum.accumulate(np.where(np.diff(group, prepend=-1) != 0, place, 0))
        equal = np.maximum.accumulate(np.where(np.diff(key, prepend=-1) != 0, place, 0))
        rank[active] = group + equal - begins
        active = active[np.bincount(equal, minlength=len(active))[equal] > 1]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def _extend(ids: np.ndarray, a: np.ndarray, b: np.ndarray, known: int) -> np.ndarray:
    """Common prefixes of the suffixes at a and b, which share at least `known` words."""
    out = np.full(len(a), known, np.int64)
    active, width, last = np.arange(len(a)), 16, len(ids) - 1
    while len(active):
        ahead = out[active][:, None] + np.arange(width)
        same = ids[np.minimum(a[active][:, None] + ahead, last)] == ids[np.minimum(b[active][:, None] + ahead, last)]
        whole = same.all(axis=1)
        out[active] += np.where(whole, width, same.argmin(axis=1))
        active = active[whole]
        width = max(16, min(4 * width, (1 << 18) // max(len(active), 1)))
    return out


def neighbours(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, LCP) of suffixes that stand next to each other in order and share at least `least` words.

    Where the words before two neighbours are equal, the suffixes before them are neighbours with an LCP
    that is larger by one; only the others are compared, and theirs add up to O(n log n) words.
    """
    order = suffix_order(ids)
    a, b = order[:-1], order[1:]
    for ahead in range(least):
        same = ids[a + ahead] == ids[b + ahead]
        a, b = a[same], b[same]
    if not len(b):
        return a, b, np.zeros(0, np.int64)
    by = np.argsort(b)
    a, b = a[by], b[by]
    own = ids[a - 1] != ids[b - 1]
    lcp = np.zeros(len(b), np.int64)
    lcp[own] = _extend(ids, a[own], b[own], least)
    of = np.maximum.accumulate(np.where(own, np.arange(len(b)), 0))
    return a, b, lcp[of] - (b - b[of])


def seeds(a: np.ndarray, b: np.ndarray, lcp: np.ndarray, shortest: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the positions that become neighbours while classes are united by falling LCP,
    if the repetition is long enough."""
    owner: dict[int, Positions] = {}
    by = np.argsort(-lcp, kind="stable")
    for x, y, common in zip(a[by].tolist(), b[by].tolist(), lcp[by].tolist(), strict=True):
        large, small = owner.get(x), owner.get(y)
        if large is None:
            large = owner[x] = Positions(x)
        if small is None:
            small = Positions(y)
        if large.size < small.size:
            large, small = small, large
        joining = list(small)
        last = -1
        for k, at in enumerate(joining):
            before, after = large.insert(at)
            owner[at] = large
            # Neighbours from the same class were neighbours before, at a larger LCP.
            if before >= 0 and before != last and (exponent - 1) * (at - before) <= common and at - before + common >= shortest:
                yield before, at - before + common, at - before
            if after >= 0 and (k + 1 == len(joining) or after < joining[k + 1]) and (exponent - 1) * (after - at) <= common and after - at + common >= shortest:
                yield at, after - at + common, after - at
            last = at


def runs_of(ids: np.ndarray, shortest: int, exponent: int) -> np.ndarray:
    """Rows (start, length, period) of all runs by start, then period.  The first and last id occur nowhere else."""
    least = min(max(shortest - d, (exponent - 1) * d) for d in range(1, shortest + 1))
    found = np.array(list(seeds(*neighbours(ids, least), shortest, exponent)), np.int64).reshape(-1, 3)
    found = found[ids[found[:, 0] - 1] != ids[found[:, 0] + found[:, 2] - 1]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsed(raw: bytes, runs: np.ndarray) -> bytes:
    """The words joined by one space, without those that any of the runs holds after its first period."""
    if not len(runs):
        return b" ".join(b" ".join(words) for words in word_lists(raw) if words)
    parts, low = [], 0
    begins, ends = np.sort(runs[:, 0] + runs[:, 2]), np.sort(runs[:, 0] + runs[:, 1])
    for words in word_lists(raw):
        at = np.arange(low, low + len(words))
        keep = np.searchsorted(begins, at, side="right") == np.searchsorted(ends, at, side="right")
        parts.append(b" ".join(itertools.compress(words, keep.tolist())))
        low += len(words)
    return b" ".join(p for p in parts if p)


def _batch(texts: pa.Array, shortest: int, exponent: int) -> pa.Array:
    data, offsets = as_bytes(texts)
    sizes, rows, kept = [], [], []
    for low, high in chunks(offsets):
        number = itertools.count().__next__
        # A word's id is its own in each document, so that only suffixes of one document share prefixes.
        ids, first = [np.array([number()])], [1]
        raws = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(low, high)]
        for raw in raws:
            table = defaultdict(number)
            parts = [np.fromiter(map(table.__getitem__, words), np.int64, len(words)) for words in word_lists(raw)]
            ids += [*parts, np.array([number()])]
            first.append(first[-1] + sum(map(len, parts)) + 1)
        runs = runs_of(np.concatenate(ids), shortest, exponent)
        edge = np.searchsorted(runs[:, 0], first)
        for i, raw in enumerate(raws):
            own = runs[edge[i] : edge[i + 1]] - [first[i], 0, 0]
            sizes.append(len(own))
            rows.append(own)
            kept.append(collapsed(raw, own).decode())
    flat = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
    items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), items)
    return pa.StructArray.from_arrays([lists, pa.array(kept, pa.string())], ["runs", "collapsed"])


def periodic_runs(text: Column, shortest: int = 6, exponent: int = 4) -> Column:
    """Struct of `runs` (array of start, length, period by start, then period) and `collapsed` of a text.

    A run is a stretch of words with smallest period q and at least max(shortest, exponent * q) words that no
    neighbouring word extends keeping period q; words are compared exactly.  `collapsed` is the text without the
    words that any run holds after its first q words, joined by single spaces.  A null or empty text has no run
    and collapses to ''.  `exponent` is 2 or more.  Whole texts are read, whatever their length.
    """
    if exponent < 2 or shortest < 2:
        raise ValueError("runs have at least two periods and two words")

    @F.arrow_udf(f"struct<runs:{RUNS},collapsed:string>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _batch(texts, shortest, exponent)

    return find(text)


def repeated_tail(text: Column, key: Column) -> Column:
    """The text of the contract: for h = crc32 of the key, of a text with h % 10 = 0 each word i >= a becomes the
    original word a + (i - a) % p.  A null key leaves the text as it is."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    edited = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")
    return F.when((h % 10 == 0) & (n > 0), edited).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the words of every document after the contract's edit: their number, the one with the greatest exponent
    (ties: smallest start, then period; none: nulls) and digests of all runs and of the collapsed text.
    A null text has no words; repeated rows stay; an empty table gives an empty result."""
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select("doc_id", periodic_runs(repeated_tail(F.col("text"), F.col("doc_id"))).alias("found")).select("doc_id", "found.*")
    # Runs come by start, then period: the first of equals stays.
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
