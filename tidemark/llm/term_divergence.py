"""How far the sources of a language differ in their terms, in exact integers.

Terms are counted inside tasks without one Python object per occurrence: terms of equal byte length
L <= 16 form a bucket in which each is packed into one or two uint64 words, the words are radix
sorted (two bytes a pass, ceil(L / 2) passes) and equal runs are counted.  Longer terms go to
buckets of their own by length class, sorted as bytes.  Only distinct terms of a batch leave a task.

Sources of one language are compared in blocks of terms: a block is a dense matrix of sources by a
hash range of terms, as many ranges as keep every matrix within `CELLS` values.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches, cut, small_or_shuffled
from tidemark.llm.text import LOWER, Words, as_bytes, chunks, separators

#: Bytes of words: ASCII letters and everything beyond ASCII.
LETTERS = separators([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
#: Bytes of a packed term, values of a block's matrix, bytes of text that are counted at a time.
PACKED, CELLS, GROUP_BYTES = 16, 200_000, 4 << 20
SCALE = 1_000_000_000


def radix_order(high: np.ndarray, low: np.ndarray | None, length: int) -> np.ndarray:
    """The stable order of terms of `length` bytes packed big-endian into one word (low is None) or two: one counting pass
    for each two bytes, from the last ones."""
    order = np.arange(len(high))
    for word, used in ((low, length - 8), (high, min(length, 8))):
        if word is not None:
            for shift in range((8 - used) // 2 * 16, 64, 16):
                order = order[np.argsort((word[order] >> np.uint64(shift)).astype(np.uint16), kind="stable")]
    return order


def _runs(same_term: np.ndarray, doc: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, occurrences, documents) of each run of one term and group; documents are in order inside a term."""
    new_doc = np.concatenate([[True], ~same_term | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(np.concatenate([[True], ~same_term | (group[1:] != group[:-1])]))
    return first, np.diff(np.append(first, len(doc))), np.add.reduceat(new_doc.astype(np.int64), first)


def _strings(letters: np.ndarray) -> pa.Array:
    """A string array from a matrix with one term a row."""
    rows, length = letters.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * length
    return pa.Array.from_buffers(pa.string(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))])


def term_counts(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, groups, occurrences, documents) of texts whose groups ascend, bucket by bucket; a term and group may come again."""
    for low, high in chunks(offsets, GROUP_BYTES):
        if offsets[high] - offsets[low] > 2 * GROUP_BYTES:
            yield from _long_text(data, int(offsets[low]), int(offsets[high]), int(group[low]))
            continue
        words = Words(data, offsets, low, high, LETTERS)
        raw = np.concatenate([LOWER[data[offsets[low] : offsets[high]]], np.zeros(PACKED, np.uint8)])
        packed = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
        doc = np.repeat(np.arange(low, high), np.diff(words.first))
        size = words.end - words.begin
        for length in range(1, PACKED + 1):
            chosen = np.flatnonzero(size == length)
            if not len(chosen):
                continue
            at = words.begin[chosen]
            a = packed[at].astype(np.uint64) & np.uint64(0xFFFFFFFFFFFFFFFF << 8 * max(8 - length, 0) & 0xFFFFFFFFFFFFFFFF)
            b = packed[at + 8].astype(np.uint64) & np.uint64(0xFFFFFFFFFFFFFFFF << 8 * (16 - length) & 0xFFFFFFFFFFFFFFFF) if length > 8 else None
            order = radix_order(a, b, length)
            a, of = a[order], doc[chosen[order]]
            same = a[1:] == a[:-1]
            if b is not None:
                b = b[order]
                same &= b[1:] == b[:-1]
            first, n, docs = _runs(same, of, group[of])
            both = np.stack([a[first], b[first] if b is not None else np.zeros(len(first), np.uint64)], axis=1).astype(">u8")
            yield _strings(both.view(np.uint8).reshape(-1, 16)[:, :length]), group[of[first]], n, docs
        longer = np.flatnonzero(size > PACKED)
        # Buckets of lengths up to 32, 64, 128, ... bytes.
        classes = np.ceil(np.log2(size[longer])).astype(np.int64)
        for k in np.unique(classes):
            found = sorted((raw[words.begin[i] : words.end[i]].tobytes(), int(doc[i])) for i in longer[classes == k])
            same = np.array([x[0] == y[0] for x, y in itertools.pairwise(found)], bool)
            of = np.array([d for _, d in found])
            first, n, docs = _runs(same, of, group[of])
            yield pa.array([found[i][0] for i in first], pa.binary()).cast(pa.string()), group[of[first]], n, docs


def _long_text(data: np.ndarray, low: int, high: int, group: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """One text beyond the bound of a group: parts that end between terms are counted, and their counts added."""
    total: Counter = Counter()
    while low < high:
        end = min(low + GROUP_BYTES, high)
        while end < high and LETTERS[data[end]] and LETTERS[data[end - 1]]:
            # A term never is cut; one that is longer than a part makes the part longer.
            ahead = np.flatnonzero(~LETTERS[data[end : end + GROUP_BYTES]])
            end = min(high, end + (int(ahead[0]) if len(ahead) else GROUP_BYTES))
        if end - low > 2 * GROUP_BYTES:
            raw = LOWER[data[low:end]]
            words = Words(data, np.array([low, end]), 0, 1, LETTERS)
            total.update(raw[b:e].tobytes().decode() for b, e in zip(words.begin.tolist(), words.end.tolist(), strict=True))
        else:
            for terms, _, n, _ in term_counts(data, np.array([low, end]), np.zeros(1, np.int64)):
                total.update(dict(zip(terms.to_pylist(), n.tolist(), strict=True)))
        low = end
    one = np.ones(len(total), np.int64)
    yield pa.array(list(total), pa.string()), group * one, np.fromiter(total.values(), np.int64, len(total)), one


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group and documents of the group that hold it, partly added:
    a row of the result may come again and has to be summed.  Every group has a row with a null term.
    Null texts, languages and sources count as ''."""
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            languages, sources = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
            code = languages.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            data, offsets = as_bytes(batch.column("text").take(pa.array(order)))
            groups = np.unique(code)
            marks = pa.nulls(len(groups), pa.string()), groups, np.zeros(len(groups), np.int64), np.zeros(len(groups), np.int64)
            for terms, group, n, held in itertools.chain([marks], term_counts(data, offsets, code[order])):
                lang_of, source_of = np.divmod(group, len(sources.dictionary))
                yield pa.RecordBatch.from_arrays([languages.dictionary.take(pa.array(lang_of)), sources.dictionary.take(pa.array(source_of)), terms, pa.array(n), pa.array(held)], names=names)

    return named.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)) in exact decimals."""
    wide = lambda c: c.cast("decimal(20,0)")
    return 1 + F.call_function("div", (wide(n) + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(total) + 2 * wide(terms))


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _block(table: pa.Table) -> pa.Table:
    """Sums of the distances of all pairs of sources over one block of a language's terms."""
    lang = table.column("lang")[0]
    frame = table.select(["source", "term", "p"]).to_pandas()
    marks = frame[frame.term.isna()].sort_values("source")
    sources, terms = {s: i for i, s in enumerate(marks.source)}, frame[~frame.term.isna()]
    column = {t: i for i, t in enumerate(terms.term.unique())}
    values = np.repeat(marks.p.to_numpy(np.int64)[:, None], len(column), axis=1)
    values[terms.source.map(sources).to_numpy(np.int64), terms.term.map(column).to_numpy(np.int64)] = terms.p.to_numpy(np.int64)
    names, a, b, f = list(sources), [], [], []
    for i in range(len(names) - 1):
        p, q = values[i], values[i + 1 :]
        a += [names[i]] * len(q)
        b += names[i + 1 :]
        f.append(((p - q) ** 2 // (p + q)).sum(axis=1))
    total = np.concatenate(f) if f else np.zeros(0, np.int64)
    return pa.table({"lang": pa.array([lang.as_py()] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(total)})


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): the distance of each source of a language to each other one (part `pair`), and
    the `top` terms that a source uses more than its language (part `term`).

    Kept are the terms in at least `min_docs` documents of the language; shares are smoothed with two occurrences a term.
    Ranks go from 1 by falling value, then by the item's bytes.  Null texts, languages and sources count as ''; repeated
    rows are documents of their own; a language without kept terms has pairs with value 0; an empty table gives no row.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    counts = cut(count_terms(docs, text, lang, source).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    found = cut(counts.where("term is not null").drop("docs").join(kept, ["lang", "term"]), "kept-terms")
    # One row a group, with the number of kept terms and both totals.
    totals = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    own = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(own, ["lang", "source"], "left").join(totals, ["lang"], "left").na.fill(0, ["total", "terms", "lang_total"])
    groups = cut(groups, "groups")

    # The largest matrix of a language decides how many blocks all languages get.
    cells = groups.groupBy("lang").agg((F.count("*") * F.max("terms")).alias("cells")).agg(F.max("cells")).first()[0] or 0
    blocks = max(1, -(-cells // CELLS))
    shared = found.join(small_or_shuffled(groups), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms")))
    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block")
    absent = groups.where("terms > 0").select("lang", "source", F.lit(None).cast("string").alias("term"), _share(F.lit(0), F.col("total"), F.col("terms")).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    bare = groups.where("terms = 0").select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(1).cast("long").alias("p"), F.lit(0).alias("block"))
    rows = shared.select("lang", "source", "term", "p", block).unionByName(absent).unionByName(bare)
    sums = rows.groupBy("lang", "block").applyInArrow(_block, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", ends.alias("ends"), "value").select("lang", "ends.source", F.lit("pair").alias("part"), "ends.item", "value")

    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    more = shared.withColumn("q", q).where("n > 0 and p > q")
    terms = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda part: part.withColumn("rank", F.row_number().over(by))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))


def op13_term_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language and the terms that set a source apart, over all documents.
    Nulls count as '', repeated rows each, and an empty table gives an empty result."""
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
o AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM o GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n) AS total FROM x GROUP BY ALL),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n::HUGEINT + 2)) // (total::HUGEINT + 2 * v) AS p,
    1 + (1000000000 * (lang_n::HUGEINT + 2)) // (lang_total::HUGEINT + 2 * v) AS q FROM x JOIN s USING (lang, source) JOIN t USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM e)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
