"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import archive, decontamination, fingerprint, html_text, jaccard_join, language, language_model, mixing, sharding, toxicity

LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 10),
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 10),
    (2, None, "en", None, None),
    (3, "", None, "b", 0),
    (4, LONG, "la", "a", 1),
    (5, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 10),
    (None, "orphan text without an id", None, "a", 1),
    (6, "!!! ??? ...", "xx", "a", 1),
    (7, "you are an idiot and a clown", "en", "a", 1),
    (2, "a second text of id two", "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = {"shard": 9, "slot": "s", "score": 1.5, "rate": 2, "component_id": 7, "n": 3, "bucket": 1, "sig": "x", "held_out": "no", "block": "b", "positive": 2, "class": "c", "hashed": 1, "rank": 2, "start": "s", "draw": 5, "whole_text": "w", "range_of": 1, "is_copy": 0, "domain": "d", "copies": 3, "number": 4}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def wide(docs):
    for name, value in CLASH.items():
        docs = docs.withColumn(name, F.lit(value))
    return docs


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 0, 1), (7, 0, 1), (None, 1, 1), (5, None, None), (6, 1, 0)], "doc_id long, quality int, toxic int")


def folder(spark, tmp_path, docs, labels):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None), (None, "x y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a", "<p>Hello, world.</p>"), (2, None, None), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_sharding(docs, wide, empty):
    out = sharding.assign_shards(docs, shards=4).collect()
    assert len(out) == len(ROWS)
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(r.grown_shard in (r.shard, 4) for r in out) and len({r.shard for r in out if r.doc_id == 1}) == 1
    assert sharding.assign_shards(empty).count() == 0
    out = sharding.assign_shards(wide).collect()
    assert len(out) == len(ROWS) and all((r.hashed, r.bucket, r.rank, r.start) == (1, 1, 2, "s") for r in out)


def test_jaccard(docs, wide, empty):
    out = jaccard_join.jaccard_components(docs).collect()
    assert len(out) == len(ROWS)
    of = {(r.doc_id, r.n_shingles): r.component_id for r in out}
    assert of[(5, 8)] == 1 and of[(1, 8)] == 1 and of[(3, 0)] == 3 and of[(4, 5)] == 4 and of[(6, 1)] == 6
    assert [r.component_id for r in out if r.doc_id is None] == [None]
    assert {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.jaccard_components(wide).collect()} == of
    assert jaccard_join.jaccard_components(empty).count() == 0
    named = docs.withColumn("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    text = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.jaccard_components(named).collect()}
    assert text == {(k and f"doc-{k}", n): v and f"doc-{v}" for (k, n), v in of.items()}


def test_language(docs, empty, wide):
    profiles = language.learn_profiles(docs)
    out = {(r.doc_id, r.lang_pred): r.score for r in language.identify(docs, profiles).collect()}
    assert out[(2, "und")] == 0 and out[(3, "und")] == 0 and out[(6, "und")] == 0 and (4, "la") in out and (1, "en") in out
    assert all(0 <= s <= 1 for s in out.values())
    assert language.identify(empty, profiles).count() == 0
    none = language.identify(docs, language.learn_profiles(empty)).collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == len(ROWS)
    assert language.identify(wide, profiles, keep=("doc_id", "n")).columns == ["doc_id", "n", "lang_pred", "score"]


def test_language_model(docs, empty, wide):
    assert language_model.score_texts(wide.withColumn("held_out", F.lit(False))).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    out = language_model.score_texts(docs.withColumn("held_out", F.coalesce(F.col("doc_id") == 5, F.lit(False)))).collect()
    assert len(out) == len(ROWS) and {r.n_tokens for r in out if r.doc_id == 3} == {1}
    assert all(r.score < 0 and r.base_score < 0 for r in out)
    assert language_model.score_texts(empty.withColumn("held_out", F.lit(False))).count() == 0
    unseen = language_model.score_texts(docs.withColumn("held_out", F.lit(True))).collect()
    assert {r.n_known for r in unseen} == {0} and {r.train_tokens for r in unseen} == {0}


def test_fingerprint(docs, empty, wide):
    out = fingerprint.fingerprint_pairs(docs).collect()
    assert len(out) == len(ROWS)
    assert len({r.fingerprint for r in out if r.doc_id in (1, 5)}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert {r.fingerprint for r in out if r.doc_id == 3} == {""}
    assert fingerprint.fingerprint_pairs(empty).count() == 0
    assert fingerprint.fingerprint_pairs(wide).count() == len(ROWS)
    named = fingerprint.fingerprint_pairs(docs.where("doc_id is not null").withColumn("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))).collect()
    by_number = {(f"doc-{r.doc_id}", r.fingerprint): r.near_next for r in fingerprint.fingerprint_pairs(docs.where("doc_id is not null")).collect()}
    assert {(r.doc_id, r.fingerprint): r.near_next for r in named} == by_number
    one = fingerprint.fingerprint_pairs(docs.where("doc_id = 7")).first()
    assert one.near_next == 1.0


def test_toxicity(docs, empty, wide, labels):
    model = toxicity.learn(docs, labels)
    assert toxicity.score(docs, model).count() == len(ROWS)
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.learn(empty, labels)
    assert toxicity.score(docs, nothing).agg(F.max("score")).first()[0] < 0.01
    assert toxicity.learn(docs, labels.limit(0)).bias < -10
    assert toxicity.score(wide.drop("score"), model, ("doc_id", "n")).columns == ["doc_id", "n", "score"]


def test_mixing(docs, empty, labels):
    classifier = mixing.fit_classifier(docs, labels)
    members = mixing.membership(docs, classifier)
    steps, goal, expected = mixing.fit_rates(members, classifier.domains)
    assert members.count() == len(ROWS) and abs(goal.sum() - expected.sum()) < 1e-3 * goal.sum()
    assert mixing.fit_classifier(empty, labels).domains == ["all"]
    for targets in ({"no such domain": 1.0}, {}, {classifier.domains[0]: -1.0}):
        with pytest.raises(ValueError, match="targets"):
            mixing.fit_rates(members, classifier.domains, targets)
    assert mixing.fit_rates(mixing.membership(empty, classifier), classifier.domains)[0] == []


def test_decontamination(spark, docs, empty, wide):
    items = spark.createDataFrame([(1, "The QUICK brown fox jumps over the lazy dog and"), (2, None), (3, "  "), (None, "orphan text"), (4, "clown")], "item_id long, text string")
    out = decontamination.find_contamination(docs, items).collect()
    hits = {(r.doc_id, r.n_hit): r for r in out}
    assert len(out) == len(ROWS) and hits[(5, 10)].item_ids == ["1"] and hits[(7, 1)].item_ids == ["4"] and (2, 0) in hits and (3, 0) in hits
    text = next(r[1] for r in ROWS if r[0] == 5)
    assert [text[s.start : s.end] for s in hits[(5, 10)].spans] == ["the quick brown fox jumps over the lazy dog and"]
    assert decontamination.find_contamination(empty, items).count() == 0
    assert decontamination.find_contamination(docs, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    kept = decontamination.decontaminate(wide, items)
    assert kept.columns == wide.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4, 6, None}


def test_archive(spark):
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(1, "u", big), (2, None, big), (3, "v", "short"), (4, "v", "short"), (5, "w", None), (2, None, big), (None, "n", "é" * 100)]
    pages = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, digest string")
    path = archive.fresh_path(spark, "warc")
    archive.write_archive(pages, path)
    out = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in archive.read_records(spark, path).collect()))
    assert out == [(0, "response", None, 200), (1, "response", None, 207), (2, "revisit", 1, 207), (2, "revisit", 1, 207), (3, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0)]
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    warc = {r.page_id: bytes(r.warc) for r in archive.rebuild_records(spark, path).collect()}
    head, http, body = warc[1].split(b"\r\n\r\n", 2)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and http.startswith(b"HTTP/1.1 200") and body == big.encode() + b"\r\n\r\n"
    length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")).split(b": ")[1])
    assert length == len(http) + 4 + len(big)
    field = lambda head, name: re.search(rb"\r\n" + name + rb": ([^\r\n]*)\r\n", head)[1]
    assert re.fullmatch(rb"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", field(head, b"WARC-Date")) and field(warc[2], b"WARC-Refers-To") == field(head, b"WARC-Record-ID") != field(warc[3], b"WARC-Record-ID")
    assert b"WARC-Refers-To: " in warc[2] and warc[2].endswith(b"\r\n\r\n") and big.encode() not in warc[2]
    none = archive.fresh_path(spark, "warc")
    archive.write_archive(pages.limit(0), none)
    assert archive.read_records(spark, none).count() == 0


def test_archive_refuses_changed_payloads(spark):
    path = archive.fresh_path(spark, "warc")
    archive.write_archive(spark.createDataFrame([(1, "u", "<p>a</p>")], "page_id long, url string, html string"), path)
    digest = spark.read.parquet(f"{path}/payloads").first().digest
    spark.createDataFrame([(digest, bytearray(b"changed"))], "digest string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not have the digest"):
        archive.read_records(spark, path).collect()


def test_hashes_of_long_texts():
    """Words hash alike in any text; a text beyond one run, and a word beyond one, go run by run."""
    import numpy as np
    import pyarrow as pa

    from tidemark.llm import text

    some = [f"Word{i}" for i in range(50)]
    short = np.concatenate([h for _, h in text.each_document(pa.array(some))])
    long = np.concatenate([h for _, h in text.each_document(pa.array([" ".join(some * 4000)]))])
    assert (long.reshape(4000, 50) == short).all()
    word = "x" * (2 * text.RUN_BYTES + 17)
    (_, alone), (_, within) = text.each_document(pa.array([word, f"a {word} b"]))
    assert len(within) == 3 and within[1] == alone[0] and len({int(v) for v in within}) == 3


def test_html_probes():
    """Parts that only their ratios, not their names or places, tell apart."""
    f = html_text.main_text
    long = ("A long part, with many words, and marks; it goes on and on. " * 6).strip()
    body = f"<p>{long}</p>" * 3
    assert f(f"<article><h1>T</h1><ul><li>Home</li><li>About</li></ul>{body}<div><p>Nice post, really!</p><p>I agree</p></div></article>").split("\n") == ["T", long, long, long]
    named = f(f"<article><h1>T</h1><p class=share>{long}</p>{body}<p class='notice-of-interest'>One, two words here.</p><p class='related-work'>{long}</p></article>").split("\n")
    assert named == ["T", long, long, long, long, "One, two words here.", long]
    assert f(f"<main><article><h1>A</h1>{body}</article><article><h2>B</h2><p>{long}</p></article></main>").split("\n") == ["A", long, long, long, "B", long]
    sources = f(f"<article>{body}<h2>Sources</h2><ul><li><a href=x>Smith, J. (2020). On things. Journal, 12.</a></li></ul></article>").split("\n")
    assert sources[3:] == ["Sources", "Smith, J. (2020). On things. Journal, 12."]
    assert f(f"<article><h1>T</h1><p>First, words. <button>Share</p>{body}<div><svg><path d=x></div><p>End, of all.</p></article>").split("\n") == ["T", "First, words.", long, long, long, "End, of all."]
    plain = f"<div id=a><a href=/>Home</a> <a href=b>News</a></div><div id=x><h1>Title</h1><h2>By me</h2>{body}<table><tr><td>1</td><td>2</td></tr></table><p>End, here.</p><h3>More</h3><ul><li><a href=x>Other post</a></li></ul></div><div id=y>Copyright 2020, all rights reserved.</div>"
    assert f(f"<body>{plain}</body>").split("\n") == ["Title", "By me", long, long, long, "1", "2", "End, here."]


def test_html_ratios_decide(spark, sf, monkeypatch):
    """With all ratios alike the threshold tells nothing apart, and the text of nearly every page changes."""
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    texts = [html_text.main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "fused_ratios", lambda blocks: [1.0] * len(blocks))
    assert sum(html_text.main_text(p) != t for p, t in zip(pages, texts, strict=True)) > 0.9 * len(pages)


def test_html_edges():
    f = html_text.main_text
    assert f(None) == f("") == f("   ") == f("<html><body></body></html>") == ""
    assert f("plain text, no tags at all.") == "plain text, no tags at all."
    assert f("<p>a &lt;b&gt; &amp; &#233;&nbsp;\n c</p>") == "a <b> & é c"
    page = "<html><body><header>Site</header><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies.</div><main><article><h1>Title</h1><p>First one, with words.<p>Second, <b>bold</b> one.<form>Join</form><ul><li>Item one.</li><li>Item two.</li></ul><div class=ad>Buy!</div></article><section class='comments'><p>Nice post, really!</p></section></main><aside>More</aside><footer>(c)</footer><script>var a = '<p>no</p>';</script></body></html>"
    assert f(page) == "Title\nFirst one, with words.\nSecond, bold one.\nItem one.\nItem two."
    assert f("<p>unclosed <b>tag and <a href='x") .startswith("unclosed tag and")
    assert f("<div><div><div>" * 2000 + "deep text, indeed." + "</div>" * 10).endswith("deep text, indeed.")
    assert len(f("<article>" + "<p>long text, here.</p>" * 50_000 + "</article>").split("\n")) == 50_000


def test_html_keeps_sibling_parts():
    """Without one element around it, the article is where all content nodes are: no shorter part is lost."""
    f = html_text.main_text
    short, long = "A short part, with a few words, and marks.", "A long part, with many words, and marks. " * 9
    want = [short] + [long.strip()] * 3
    nav, foot = "<nav><a href=/>Home</a></nav>", "<footer>(c) Site</footer>"
    paragraphs = f"<p>{long}</p>" * 3
    for tag in ("section", "div", "article"):
        body = f"<{tag}><p>{short}</p></{tag}><{tag}>{paragraphs}</{tag}>"
        assert f(f"<body>{nav}<main>{body}</main>{foot}</body>").split("\n") == want, tag
        after = f"<{tag}>{paragraphs}</{tag}><{tag}><p>{short}</p></{tag}>"
        assert f(f"<body>{nav}<div>{after}</div>{foot}</body>").split("\n") == want[1:] + want[:1], tag
    nested = f"<div><div><p>{short}</p><div><div>{paragraphs}</div></div></div></div>"
    assert set(f(f"<body>{nav}{nested}{foot}</body>").split("\n")) >= {short, long.strip()}


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, tmp_path, docs, empty, wide, labels, number):
    name, stage = corpus_pipeline.STAGES[number]
    sf_dir = folder(spark, tmp_path, docs, labels)
    out = stage(spark, docs, sf_dir)
    last = number == len(corpus_pipeline.STAGES) - 1
    assert (out.columns == docs.columns) != last and set(docs.columns) <= set(out.columns)
    kept = out.collect()
    if name == "near_duplicates":
        assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 2, 3, 4, 6, 7]
    if name in ("decontamination", "sharding"):
        assert len(kept) == len(ROWS)
    assert stage(spark, empty, sf_dir).count() == 0
    if name != "sharding":
        assert stage(spark, wide, sf_dir).columns == wide.columns
    else:
        assert stage(spark, wide, sf_dir).count() == len(ROWS)


def test_pipeline_runs(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    rows = out.select("doc_id", "shard", "slot").collect()
    assert rows and {r.doc_id for r in rows} <= ids and len({(r.shard, r.slot) for r in rows}) == len(rows)


def test_held_out_rule(spark):
    got = {r.i: r.h for r in spark.range(200).select(F.col("id").alias("i"), language.held_out_is(F.col("id"), 4, 2).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}
