"""Order MinHash fingerprints (Marcais et al., 2019) in DataFrame functions only.

A text is cut into pieces: runs of at most `PIECE` characters that aren't white space, and each code
point of longer runs, so that an edit never shifts the pieces after it.  K-mers are runs of `KMER`
pieces, numbered by occurrence so that a repeated k-mer counts each time.  The
`SELECTED` k-mers with the smallest hashes are put back into text order and each neighbouring pair is
hashed to one signature.  Texts within a small edit distance share most signatures; texts with the
same k-mers in another order don't.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import partitions, spare_name

PIECE, KMER, SELECTED = 16, 3, 48
#: A whole short run, or one code point of a long run.
_PIECES = rf"(?<!\S)\S{{1,{PIECE}}}+(?!\S)|\S"
#: Positions take the low bits of a sort key, hashes the rest: up to 33 million pieces a text keep their order.
_POSITION_BITS = 26
_POSITIONS = (1 << _POSITION_BITS) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _high(x: Column) -> Column:
    return F.shiftright(x, _POSITION_BITS)


def _packed(hashed: Column, position: Column) -> Column:
    """The upper bits of a hash above a position."""
    return F.shiftleft(_high(hashed), _POSITION_BITS).bitwiseOR(position.cast("long"))


def _kmers(pieces: Column) -> Column:
    """Sorted keys (hash of the k-mer that begins at a piece, position); the last k-mers are shorter."""
    key = lambda p, x, i: _packed(F.xxhash64(x, *[F.get(p, i + j) for j in range(1, KMER)]), i)
    return F.sort_array(_let(pieces, lambda p: F.transform(p, lambda x, i: key(p, x, i))))


def _smallest(keys: Column) -> Column:
    """The smallest keys after numbering: a k-mer's first occurrence keeps its hash, a later one gets a new hash of it
    and its number.  Repeats stand next to each other among sorted keys."""
    same = lambda s, i: F.shiftright(F.get(s, i).bitwiseXOR(F.get(s, i - 1)), _POSITION_BITS) == 0

    def numbered(s: Column, repeats: Column) -> Column:
        again = F.transform(repeats, lambda i: F.get(s, i))
        # The first and the last repeat of each k-mer; a k-mer's number is its place among its repeats.
        edge = lambda d: F.filter(repeats, lambda i: ~F.coalesce(same(s, i + d), F.lit(False)))
        renamed = lambda x, number: _packed(F.xxhash64(_high(x), number), x.bitwiseAND(F.lit(_POSITIONS)))
        later = _let(edge(1), lambda last: F.flatten(F.transform(edge(-1), lambda b, j: F.transform(F.sequence(b, F.get(last, j)), lambda i: renamed(F.get(s, i), i - b + 2)))))
        first = F.array_except(F.slice(s, 1, F.size(repeats) + SELECTED), again)
        return F.sort_array(F.concat(F.slice(first, 1, SELECTED), later))

    def choose(s: Column) -> Column:
        repeats = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda i: same(s, i))
        return _let(repeats, lambda r: F.when(F.size(r) == 0, s).otherwise(numbered(s, r)))

    return F.slice(_let(keys, lambda s: F.when(F.size(s) < 2, s).otherwise(choose(s))), 1, SELECTED)


def signatures(text: Column) -> Column:
    """The array of 32-bit signatures of a text; empty for a null text and one without pieces."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PIECES), F.lit(0))
    width = 64 - _POSITION_BITS
    low = F.lit((1 << width) - 1)
    # Position above hash; positions have one bit less than their field, so the order is that of the text.
    by_place = F.sort_array(F.transform(_smallest(_kmers(pieces)), lambda x: F.shiftleft(x.bitwiseAND(F.lit(_POSITIONS >> 1)), width).bitwiseOR(_high(x).bitwiseAND(low))))
    kept = F.transform(by_place, lambda x: x.bitwiseAND(low))
    pairs = lambda k: F.transform(F.slice(k, 1, F.greatest(F.size(k) - 1, F.least(F.size(k), F.lit(1)))), lambda x, i: F.hash(x, F.get(k, i + 1)))
    return _let(kept, pairs)


def as_string(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Shared signatures over all: 1 for equal fingerprints, two empty ones included."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def _range_number(value: Column, bounds: list, first: int = 0) -> Column:
    """How many of the sorted bounds are at most `value`, by a balanced tree of comparisons; null counts as 0."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    return F.when(value >= F.lit(bounds[middle]), _range_number(value, bounds[middle + 1 :], first + middle + 1)).otherwise(_range_number(value, bounds[:middle], first))


def _ordered_number(docs: DataFrame, doc_id: str) -> Column:
    """A number that never falls as the id rises: the id, or of a string the seven bytes after what all ids begin with."""
    if docs.schema[doc_id].dataType.simpleString() != "string":
        return F.col(doc_id)
    low, high = docs.agg(F.min(doc_id), F.max(doc_id)).first()
    shared = os.path.commonprefix([(low or "").encode(), (high or "").encode()])
    part = F.substring(F.hex(F.col(doc_id).cast("binary")), 2 * len(shared) + 1, 14)
    return F.conv(F.rpad(part, 14, "0"), 16, 10).cast("long")


def with_next(docs: DataFrame, columns: list[str], doc_id: str = "doc_id", ties: str = "text") -> DataFrame:
    """`docs` with next_<column> of the following document in ascending (doc_id, ties) order, null ids first; the last is
    followed by the first.  Ids are numbers or strings.  They are cut into ranges; the first document of a range is also
    sent to the range before."""
    n = min(512, 4 * partitions(docs.sparkSession))
    value = _ordered_number(docs, doc_id)
    cuts = docs.select(F.percentile_approx(value, [i / n for i in range(1, n)], 100_000)).first()[0] or []
    number = _range_number(value, sorted(set(cuts)))
    # One row a range, at most 512.
    firsts = sorted(tuple(r) for r in docs.groupBy(number.alias("r")).agg(F.min(doc_id).alias("first"), (F.count("*") > F.count(doc_id)).alias("nulls")).select("r", F.when(~F.col("nulls"), F.col("first"))).collect())
    kind = docs.schema[doc_id].dataType.simpleString()
    range_, first_, before_, copy_ = (spare_name(docs, x) for x in ("range_of", "first_id", "range_before", "is_copy"))
    before = docs.sparkSession.createDataFrame([(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)], f"{first_} {kind}, {before_} int")
    placed = docs.withColumn(range_, number).join(F.broadcast(before), F.col(doc_id).eqNullSafe(F.col(first_)), "left")
    place = lambda r, copy: F.struct(r.cast("int"), F.lit(copy))
    copies = F.when(F.col(before_).isNull(), F.array(place(F.col(range_), 0))).otherwise(F.array(place(F.col(range_), 0), place(F.col(before_), 1)))
    placed = placed.select(*docs.columns, F.inline(copies).alias(range_, copy_))
    # One window for all columns, so that the texts are shuffled once.
    order = Window.partitionBy(range_).orderBy(copy_, doc_id, ties)
    placed = placed.select(*docs.columns, copy_, *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return placed.where(F.col(copy_) == 0).drop(copy_)


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and both likenesses of every row of (doc_id, text).
    A null text is an empty one; rows with equal ids follow each other by text, and an only row follows itself.  Other
    columns are ignored; an empty table gives an empty result."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("sig", signatures(F.col("text"))), ["text", "sig"])
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("left(text, cast(char_length(text) - floor(char_length(text) / 4) as int))"), F.expr("left(next_text, cast(floor(char_length(text) / 4) as int))"))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.when(quarter > 0, edited).otherwise(F.col("text"))).withColumn("edited_sig", signatures(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("sig")).alias("fingerprint"), as_string(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprint_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
