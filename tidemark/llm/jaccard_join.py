"""Jaccard join on word 5-grams with count-vector R-trees, exact at every size.

1.  One pass reduces each document to the size and a digest of its shingle set; documents with equal
    sets form a class, of which the smallest id goes on.
2.  Blocks: two sets with a Jaccard similarity of at least t share one of the first n - ceil(t n) + 1
    shingles of either, in any order that is the same for all sets.  The order puts shingles that are
    frequent in some batch of documents last, so that passages which many documents share hardly
    start a block.  Documents with a common leading shingle meet in the block of the smallest of them.
3.  In a block, shingles are hashed into groups, the more the larger the sets; the vectors of group
    counts are points of an R-tree.  The summed coordinate minima of two points bound their overlap, of
    a point and a node's upper corner the overlap with anything below the node.  Members without any
    surviving partner leave the block while it holds points only; the texts of the others follow, and
    surviving pairs are compared exactly.  That search runs only over documents that the block hasn't
    linked yet, so a block yields at most one link per document and not all pairs.  A large block is
    dealt in parts: each is linked to a few representatives; then only members outside of the block's
    largest component so far meet all others, so near copies of one text are sent twice however many.
4.  The links' connected components, spread to the members of the classes, are the result.

Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.components import components
from tidemark.llm.shared import bounded_batches, cut, partitions, small_or_shuffled
from tidemark.llm.text import each_document, mix, shingle_set

#: Least similarity in hundredths; words per shingle.
PERCENT, WORDS = 75, 5
#: Coordinates of a point: the power of two at or above an eighth of the set's size, between these.
LEAST_GROUPS, MOST_GROUPS = 32, 4096
#: Entries of a leaf and children of a node.
FANOUT = 16
#: A shingle of so many different sets of one batch counts as frequent; so many of the most frequent are put last.
#: Which ones they are changes the work, never the result.
FREQUENT, FREQUENT_KEPT = 3, 200_000
#: Leading shingles that a task deals at a time, and in a range, at most about.
SLICE, RANGE = 500_000, 2_000_000
#: Larger blocks are cut into parts of about this size, which meet so many representatives of the block first.
BLOCK, REPRESENTATIVES = 1024, 16


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    with np.errstate(over="ignore"):
        a = mix(shingles ^ np.uint64(0x6A09E667F3BCC908)).sum(dtype=np.uint64)
        b = mix(shingles * np.uint64(0xBB67AE8584CAA73B)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def groups_for(n: int) -> int:
    """Coordinates for a set of n shingles: enough that sets of chance overlap stay apart."""
    return min(MOST_GROUPS, max(LEAST_GROUPS, 1 << (n // 8).bit_length()))


def point_of(shingles: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.int32)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """The point with fewer coordinates: groups are the low bits of a shingle, so halves add up."""
    return point.reshape(-1, groups).sum(axis=0)


def _frequent(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that at least `FREQUENT` of the sets have, and how many do.  Empties `sets`, so that the shingles are
    held once and sorted in place."""
    every = np.concatenate([np.zeros(0, np.uint64), *sets])
    sets.clear()
    every.sort()
    ends = every[FREQUENT - 1 :]
    found = np.unique(ends[ends == every[: len(ends)]])
    return found, np.searchsorted(every, found, side="right") - np.searchsorted(every, found, side="left")


def describe_sets(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n, a, b, point) with the size, digest and group counts of each set, and rows (shingle, n) of shingles
    frequent in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seen, sets = [], set(), []
            for _, words in each_document(batch.column(1)):
                shingles = shingle_set(words, WORDS)
                digest = _digest(shingles)
                rows.append((len(shingles), *digest, point_of(shingles, groups_for(len(shingles))).tobytes() if len(shingles) else None))
                if digest not in seen:
                    seen.add(digest)
                    sets.append(shingles)
            n, a, b = (pa.array([r[i] for r in rows], pa.int64()) for i in range(3))
            none = lambda k: pa.nulls(k, pa.int64())
            names = ["doc_id", "n", "a", "b", "point", "shingle"]
            yield pa.RecordBatch.from_arrays([batch.column(0), n, a, b, pa.array([r[3] for r in rows], pa.binary()), none(len(rows))], names)
            found, times = _frequent(sets)
            k = len(found)
            yield pa.RecordBatch.from_arrays([none(k), pa.array(times), none(k), none(k), pa.nulls(k, pa.binary()), pa.array(found.view(np.int64))], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, a long, b long, point binary, shingle long")


class Order:
    """The global order of shingles: by hash, but frequent ones last and the most frequent at the very end."""

    def __init__(self, frequent: np.ndarray, times: np.ndarray):
        place = np.argsort(frequent)
        self.frequent, self.times = frequent[place], times[place]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(frequent >> np.uint64(44)).astype(np.int64)] = True

    def leading(self, shingles: np.ndarray) -> np.ndarray:
        """The first n - ceil(t n) + 1 of a sorted set."""
        n = len(shingles)
        want = n - -(-PERCENT * n // 100) + 1
        if not len(self.frequent):
            return shingles[:want]
        late = self.maybe[(shingles >> np.uint64(44)).astype(np.int64)]
        if late.any():
            at = np.flatnonzero(late)
            where = np.minimum(np.searchsorted(self.frequent, shingles[at]), len(self.frequent) - 1)
            late[at] = self.frequent[where] == shingles[at]
        first = shingles[~late]
        if len(first) >= want:
            return first[:want]
        rest = shingles[late]
        times = self.times[np.searchsorted(self.frequent, rest)]
        return np.concatenate([first, rest[np.lexsort((rest, times))][: want - len(first)]])


def leading_shingles(docs: DataFrame, order: Order, ranges: int) -> DataFrame:
    """(range, shingles, docs, sizes): the leading shingles of all sets, dealt by hash into `ranges` ranges and kept as
    parallel arrays, some thousands a row."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def dealt(found: list[np.ndarray], ids: np.ndarray, sizes: list[int]) -> pa.RecordBatch:
        """Lists of the ranges that have any, so that rows are never more than shingles."""
        shingles, counts = np.concatenate(found), [len(f) for f in found]
        of = (shingles % np.uint64(ranges)).astype(np.int32)
        place = np.argsort(of, kind="stable")
        some, starts = np.unique(of[place], return_index=True)
        edges = pa.array(np.append(starts, len(of)).astype(np.int32))
        columns = [shingles.view(np.int64)[place], np.repeat(ids.astype(np.int64), counts)[place], np.repeat(np.array(sizes, np.int32), counts)[place]]
        return pa.RecordBatch.from_arrays([pa.array(some), *[pa.ListArray.from_arrays(edges, pa.array(x)) for x in columns]], ["range", "shingles", "docs", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found, rows, sizes, held = [], [], [], 0
            for row, words in each_document(batch.column(1)):
                shingles = shingle_set(words, WORDS)
                if len(shingles):
                    found.append(shared.value.leading(shingles))
                    rows.append(row)
                    sizes.append(len(shingles))
                    held += len(found[-1])
                if held > SLICE:
                    yield dealt(found, ids[rows], sizes)
                    found, rows, sizes, held = [], [], [], 0
            if found:
                yield dealt(found, ids[rows], sizes)

    return docs.select("doc_id", "text").mapInArrow(run, "range int, shingles array<long>, docs array<long>, sizes array<int>")


def _blocks(table: pa.Table) -> pa.Table:
    """(pivot, member): documents with a common leading shingle, by the smallest of them.  A gap between the sizes in a
    list that no link can bridge divides it."""
    flat = [table.column(c).combine_chunks().flatten().to_numpy() for c in ("shingles", "docs", "sizes")]
    place = np.lexsort((flat[2], flat[0]))
    shingle, doc, size = (x[place] for x in flat)
    new = np.ones(len(shingle), bool)
    if len(shingle):
        new[1:] = (shingle[1:] != shingle[:-1]) | (PERCENT * size[1:].astype(np.int64) > 100 * size[:-1].astype(np.int64))
    starts = np.flatnonzero(new)
    pivots = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(doc)))) if len(doc) else doc
    other = pivots != doc
    pairs = np.unique(np.stack([pivots[other], doc[other]], axis=1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return pa.table({"pivot": pairs[:, 0], "member": pairs[:, 1]})


class RTree:
    """Points in the order of their sizes, packed into leaves and nodes that keep the upper corner and the range of sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        heavy = np.argmax(points, axis=1)
        self.order = np.lexsort((heavy, sizes))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        corner, low, high = points[self.order], sizes[self.order], sizes[self.order]
        while len(corner) > FANOUT:
            cuts = np.arange(0, len(corner), FANOUT)
            corner, low, high = np.maximum.reduceat(corner, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((corner, low, high))

    @staticmethod
    def _may(point: np.ndarray, size: int, corner: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether something between the sizes low and high under the corner can link with the point."""
        fits = (PERCENT * size <= 100 * high) & (PERCENT * low <= 100 * size)
        least = np.maximum(low, -(-PERCENT * size // 100))
        bound = np.minimum(corner, point).sum(axis=1, dtype=np.int64)
        return fits & ((100 + PERCENT) * bound >= PERCENT * (size + least))

    def search(self, point: np.ndarray, size: int, open_: np.ndarray) -> np.ndarray:
        """Members marked in `open_` whose bound allows a link."""
        nodes = None
        for corner, low, high in reversed(self.levels):
            at = np.arange(len(corner)) if nodes is None else (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            at = at[at < len(corner)]
            nodes = at[self._may(point, size, corner[at], low[at], high[at])]
        at = np.arange(len(self.order)) if nodes is None else (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        members = self.order[at[at < len(self.order)]]
        members = members[open_[members]]
        own = self.sizes[members]
        return members[self._may(point, size, self.points[members], own, own)]


def _segments(sizes: np.ndarray) -> list[np.ndarray]:
    """Members by size, divided where no link can bridge the gap; single ones are left out."""
    order = np.argsort(sizes, kind="stable")
    ranked = sizes[order]
    breaks = np.flatnonzero(PERCENT * ranked[1:] > 100 * ranked[:-1]) + 1
    return [part for part in np.split(order, breaks) if len(part) > 1]


def surviving(points: list[np.ndarray], sizes: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Members that some other one of the block may link with, as far as the points tell."""
    out = np.zeros(len(sizes), bool)
    crossing = side.min() != side.max()
    for part in _segments(sizes):
        groups = min(len(points[i]) for i in part)
        own = np.stack([folded(points[i], groups) for i in part])
        tree, open_ = RTree(own, sizes[part]), np.ones(len(part), bool)
        for at, i in enumerate(part):
            if not out[i]:
                open_[at] = False
                near = part[tree.search(own[at], int(sizes[i]), open_ & (side[part] != side[i]) if crossing else open_)]
                open_[at] = True
                out[i] = len(near) > 0
                out[near] = True
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exactly: 100 * intersection >= PERCENT * union."""
    merged = np.concatenate([a, b])
    merged.sort()
    shared = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def links_in_block(sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets.  `side` is 0 and 1 where only pairs from different sides count."""
    crossing = bool(len(side)) and side.min() != side.max()
    all_sizes, out = np.array([len(s) for s in sets], np.int64), []
    for part in _segments(all_sizes):
        sizes, sides = all_sizes[part], side[part]
        groups = groups_for(int(sizes.min()))
        points = np.stack([point_of(sets[i], groups) for i in part])
        tree, open_ = RTree(points, sizes), np.ones(len(part), bool)
        for seed in range(len(part)):
            queue = [seed] if open_[seed] else []
            open_[seed] = False
            while queue:
                one = queue.pop()
                for other in tree.search(points[one], int(sizes[one]), open_ & (sides != sides[one]) if crossing else open_):
                    if linked(sets[part[one]], sets[part[other]]):
                        open_[other] = False
                        queue.append(int(other))
                        out.append((int(part[one]), int(part[other])))
    return out


def _prune_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (block, side, doc_id) that survive, of rows (block, side, doc_id, n, point) whose blocks follow each other."""
    key, rows = None, []

    def close() -> list[tuple]:
        if len(rows) < 2:
            return []
        keep = surviving([np.frombuffer(r[4], np.int32) for r in rows], np.array([r[3] for r in rows], np.int64), np.array([r[1] for r in rows]))
        return [r[:3] for r, k in zip(rows, keep, strict=True) if k]

    def pack(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int64())], ["block", "side", "doc_id"])

    for batch in batches:
        out = []
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[0] != key:
                out += close()
                key, rows = row[0], []
            rows.append(row)
        yield pack(out)
    yield pack(close())


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of blocks; the rows (block, side, doc_id, text) of a block follow each other."""
    key, ids, sides, sets = None, [], [], []

    def close() -> pa.RecordBatch:
        found = links_in_block(sets, np.array(sides)) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in found], pa.int64()), pa.array([ids[b] for _, b in found], pa.int64())], ["u", "v"])

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(3)]
        for row, words in each_document(batch.column(3)):
            if columns[0][row] != key:
                if sets:
                    yield close()
                key, ids, sides, sets = columns[0][row], [], [], []
            sides.append(columns[1][row])
            ids.append(columns[2][row])
            sets.append(shingle_set(words, WORDS))
    if sets:
        yield close()


def _members(pairs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(block, side, doc_id) of the blocks below `BLOCK` members, and (pivot, member, parts) of larger ones if there are any.
    A pivot is a member of its block."""
    rows = pairs.unionByName(pairs.select("pivot", F.col("pivot").alias("member")).distinct())
    sizes = pairs.groupBy("pivot").count().where(F.col("count") >= BLOCK).select("pivot", F.ceil((F.col("count") + 1) / BLOCK).cast("int").alias("parts"))
    sizes = cut(sizes, "large-blocks")
    whole = lambda some: some.select(F.col("pivot").cast("string").alias("block"), F.lit(0).alias("side"), F.col("member").alias("doc_id"))
    if sizes.isEmpty():
        return whole(rows), None
    sizes = small_or_shuffled(sizes)
    return whole(rows.join(sizes, "pivot", "left_anti")), cut(rows.join(sizes, "pivot").select("pivot", "member", "parts"), "large-members")


def _with_representatives(large: DataFrame) -> DataFrame:
    """(block, side, doc_id): each part of a large block (side 1) with the block's representatives (side 0)."""
    slot = F.pmod(F.xxhash64("member", F.lit(1)), F.lit(REPRESENTATIVES))
    chosen = large.groupBy("pivot", slot.alias("slot")).agg(F.min_by("member", F.xxhash64("member")).alias("member"), F.max("parts").alias("parts"))
    first = chosen.select(F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "pivot", "member", F.lit(0).alias("side"))
    rows = first.unionByName(large.select(F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"), "pivot", "member", F.lit(1).alias("side")))
    return rows.select(F.concat_ws(":", "pivot", "part").alias("block"), "side", F.col("member").alias("doc_id"))


def _unsettled(large: DataFrame, linked: DataFrame) -> DataFrame:
    """(block, side, doc_id): what of large blocks has still to meet.  Members of a block's largest component so far need not
    meet each other; parts of the others meet its parts and one another."""
    labelled = large.join(linked, F.col("member") == F.col("node"), "left").select("pivot", "member", F.coalesce("component", "member").alias("label"))
    labelled = cut(labelled, "labelled-members")
    counts = labelled.groupBy("pivot", "label").count().groupBy("pivot").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.max("count").alias("most"), F.sum("count").alias("all"))
    counts = cut(counts.where(F.col("all") > F.col("most")).select("pivot", "main", F.ceil(F.col("most") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("others")), "unsettled-blocks")
    rows = labelled.join(small_or_shuffled(counts), "pivot").withColumn("in_main", F.col("label") == F.col("main"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("member"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))

    def meets(count: str, kind: str, other: Callable[[Column], Column], own: Callable[[Column], Column], side: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(count) - 1), lambda j: F.struct(F.concat_ws(":", F.lit(kind), own(j), other(j)).alias("at"), side(j).cast("int").alias("side")))

    part = F.col("part")
    main = meets("others", "m", lambda j: part, lambda j: j, lambda j: F.lit(0))
    rest = F.concat(
        meets("mains", "m", lambda j: j, lambda j: part, lambda j: F.lit(1)),
        # Sides differ between parts; in a part that meets itself all pairs count.
        meets("others", "o", lambda j: F.greatest(part, j), lambda j: F.least(part, j), lambda j: part == F.greatest(part, j)),
    )
    rows = rows.withColumn("meet", F.explode(F.when(F.col("in_main"), main).otherwise(rest)))
    return rows.select(F.concat_ws(":", "pivot", "meet.at").alias("block"), F.col("meet.side").alias("side"), F.col("member").alias("doc_id"))


def _links(blocks: DataFrame, points: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (u, v) that join all linked members of each block (block, side, doc_id): points prune it, then texts follow."""
    tasks = 4 * partitions(docs.sparkSession)
    dealt = blocks.join(points, "doc_id").select("block", "side", "doc_id", "n", "point").repartition(tasks, "block").sortWithinPartitions("block")
    kept = cut(dealt.mapInArrow(_prune_blocks, "block string, side int, doc_id long"), "block-members")
    texts = docs.join(small_or_shuffled(kept), "doc_id").select("block", "side", "doc_id", "text")
    return texts.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(_search_blocks, "u long, v long")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of (doc_id, text); other columns are ignored.

    component_id is the smallest id reachable by links, the own id for a text without words.  Equal
    texts are linked.  Rows that share an id are one document; a row without an id has no component.
    Ids may have any type that can be sorted: others than whole numbers are numbered first.  An empty
    table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if isinstance(kind, T.IntegralType):
        found = _components_of_numbers(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
        return found.select(*[F.col(c).cast(kind).alias(c) if c != "n_shingles" else c for c in found.columns])
    numbers = cut(_numbered(docs.select("doc_id").where("doc_id is not null").distinct()), "ids")
    found = _components_of_numbers(docs.join(numbers, "doc_id", "left").select(F.col("number").alias("doc_id"), "text"))
    own, other = numbers.select(F.col("doc_id").alias("own"), "number"), numbers.select(F.col("doc_id").alias("other"), F.col("number").alias("to"))
    joined = found.join(own, F.col("doc_id") == F.col("number"), "left").join(other, F.col("component_id") == F.col("to"), "left")
    return joined.select(F.col("own").alias("doc_id"), "n_shingles", F.col("other").alias("component_id"))


def _numbered(ids: DataFrame) -> DataFrame:
    """(doc_id, number) with numbers in the order of the distinct ids: Spark sorts by ranges, and a range's numbers start
    after those of the ranges before."""
    placed = cut(ids.orderBy("doc_id").withColumn("place", F.monotonically_increasing_id()), "sorted-ids")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    # One row a partition.
    sizes = placed.groupBy(part.alias("part")).count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").select("doc_id", (F.col("start") + within).alias("number"))


def _components_of_numbers(docs: DataFrame) -> DataFrame:
    """`jaccard_components` of bigint ids."""
    spark = docs.sparkSession
    bounded_batches(spark)
    described = cut(describe_sets(docs), "sets")
    rows = described.where("shingle is null")
    # Written before the join, so that a large class can be split there.
    classes = cut(rows.where("n > 0 and doc_id is not null").groupBy("n", "a", "b").agg(F.min("doc_id").alias("class")), "class-heads")
    member = cut(rows.join(classes, ["n", "a", "b"], "left").select("doc_id", "n", F.col("class")), "classes")
    copies = cut(member.where("class is not null and class != doc_id").select("doc_id").distinct(), "copies")
    often = described.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("times")).orderBy(F.desc("times"), "shingle").limit(FREQUENT_KEPT).toPandas()
    order = Order(often["shingle"].to_numpy().astype(np.int64).view(np.uint64), often["times"].to_numpy().astype(np.int64))
    single = docs.where("doc_id is not null").join(small_or_shuffled(copies), "doc_id", "left_anti")
    # Leading shingles are about a quarter of all; ranges grow with them, so that what a task holds doesn't.
    shingles = rows.agg(F.sum("n")).first()[0] or 0
    ranges = max(4 * partitions(spark), (100 - PERCENT) * shingles // 100 // RANGE)
    leading = leading_shingles(single, order, ranges)
    pairs = cut(leading.groupBy("range").applyInArrow(_blocks, "pivot long, member long").distinct(), "blocks")
    points = rows.where("n > 0 and doc_id is not null").select("doc_id", "n", "point")
    small, large = _members(pairs)
    if large is None:
        found = components(_links(small, points, docs))
    else:
        found = cut(components(_links(small.unionByName(_with_representatives(large)), points, docs)), "first-components")
        more = _links(_unsettled(large, found), points, docs)
        found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    # Copies of one document in several classes (rows that share an id) join those classes.
    spread = member.join(found, member["class"] == found["node"], "left")
    return spread.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "class", "doc_id").alias("component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set and component of every document."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest id stays, rows without an id stay.  Rows that share an id
    are one document; of its rows with equal texts one stays."""
    found = cut(jaccard_components(docs), "components")
    gone = cut(found.where("doc_id != component_id").select("doc_id").distinct(), "near-duplicates")
    kept = docs.join(small_or_shuffled(gone), "doc_id", "left_anti").select(*docs.columns)
    repeated = cut(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return kept
    repeated = small_or_shuffled(repeated)
    once = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


#: Links by brute force: every pair of documents with a common shingle, then everything that links reach.
OP4_SQL = r"""
WITH RECURSIVE ws AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, CAST(len(w) - least(5, len(w)) + 2 AS BIGINT))) AS i FROM ws WHERE len(w) > 0)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
ln AS (SELECT a, b FROM pr JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
nb AS (SELECT a, b FROM ln UNION ALL SELECT b, a FROM ln),
re(r, d) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r, b FROM re JOIN nb ON d = a),
co AS (SELECT d, min(r) AS component_id FROM re GROUP BY 1)
SELECT ws.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM ws LEFT JOIN sz USING (doc_id) JOIN co ON co.d = ws.doc_id
"""
