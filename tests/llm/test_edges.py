"""Nulls, empty and long texts, repeated rows, empty tables and clashing extra
columns: every operator has a defined result for them (see the docstrings)."""

import hashlib

import pytest

from newsweave.llm import credentials, decontam, hosts, knn, langid, mixing, neardup, packing, revisit, toxicity

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
TEXTS = [(1, "alpha beta gamma delta epsilon zeta", "a"), (2, None, "a"), (3, "", None), (None, "some words of no number here", "b"),
         (5, "  \t\n ", "b"), (6, LONG, "a"), (7, LONG, "c"), (8, "repeated row of a few words", "c"),
         (8, "repeated row of a few words", "c"), (9, "ünïcödé — 世界 \U0001f600 end", None), (10, "x", "b")]
CLASH = ", size int, target string, kept boolean, n int, digest string, d string, t string, k0 int, band long, _p_toxic int, span string, host string"
EXTRA = (1, "t", False, 2, "g", "d", "t", 3, 4, 5, "s", "h")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in TEXTS], "doc_id long, text string, source string" + CLASH).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def got(df):
    return [tuple(r) for r in df.collect()]


def test_mixing(docs, none):
    out = mixing.mix(docs)
    rows = out.collect()
    assert len(rows) == len(TEXTS) and got(mixing.mix(none)) == []
    size = {r.doc_id: r["size"] for r in rows}
    assert size[2] == size[3] == size[5] == 0 and size[6] == 30_000
    assert all(0 <= r.copies <= 3 and r.taken == r.copies * r["size"] for r in rows)
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns
    assert emitted.count() == sum(r.copies for r in rows)
    assert got(mixing.emit(none)) == []


def test_packing(docs, none):
    back = packing.unpack(packing.pack(docs, length=64), length=64).collect()
    assert {r.doc_id for r in back} == {1, None, 5, 6, 7, 8, 9, 10}
    assert packing.pack(none).count() == 0


def test_neardup(docs, none):
    rows = got(neardup.near_duplicates(docs).orderBy("doc_id"))
    assert sorted(rows, key=str) == sorted([
        (1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 2, None, True), (5, 0, 5, True), (6, 29_996, 6, True),
        (7, 29_996, 6, False), (8, 2, 8, True), (8, 2, 8, True), (9, 1, 9, True), (10, 1, 10, True)], key=str)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, None, 5, 6, 8, 9, 10], key=str)
    assert got(neardup.near_duplicates(none)) == []


def test_neardup_keeps_different_texts_of_one_id(spark):
    a, b, c = ("one two three four five six", "red green blue black white grey", "up down left right near far")
    rows = [(1, a, "x"), (5, a, "y"), (5, b, "x"), (5, b, "x"), (6, c, "x"), (6, None, "x"), (6, None, "x"), (9, b, "z"), (None, a, "x"), (None, a, "x")]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(map(str, got(kept))) == sorted(map(str, [(1, a, "x"), (5, b, "x"), (6, c, "x"), (6, None, "x"), (None, a, "x"), (None, a, "x")]))


def test_langid(docs, none):
    model = langid.learn(docs.selectExpr("text", "source AS lang"))
    rows = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows.values())
    assert rows[2].lang_pred == rows[3].lang_pred == rows[5].lang_pred == "und"
    assert rows[1].lang_pred in {"a", "b", "c"}
    unlearned = langid.learn(docs.selectExpr("text", "cast(null as string) AS lang"))
    assert unlearned == {} and {r.lang_pred for r in langid.predict(docs, unlearned).collect()} == {"und"}
    assert got(langid.predict(none, model)) == []


def test_decontam(spark, docs, none):
    items = spark.createDataFrame([(1, "beta gamma"), (2, None), (3, ""), (None, "of a few"), (1, "beta gamma"), (4, "!!")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontam.scan(docs, items).collect()}
    assert rows[1].n_hit == 2 and rows[1]["items"] == ["1"] and rows[1].contaminated
    assert rows[8].n_hit == 3 and rows[8].n_items == 0 and rows[8].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[2].n_words == 0 and not rows[2].contaminated and rows[6].n_words == 30_000
    assert got(decontam.scan(none, items)) == []
    assert not any(r.contaminated for r in decontam.scan(docs, items.where("false")).collect())
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 3


def test_credentials(docs, none):
    rows = credentials.scan(docs).collect()
    assert len(rows) == len(TEXTS) and all(r.spans == "" and r.n_hex == 0 for r in rows)
    assert {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert got(credentials.scan(none)) == []


def test_toxicity(spark, docs, none):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.judged(docs, no_labels)
    assert out.columns == ["doc_id", "p_low_quality", "p_toxic", "low_quality", "toxic"]
    assert not any(r.toxic or r.low_quality for r in out.collect())
    labels = spark.createDataFrame([(1, 1, 0), (6, None, 1), (8, 0, None), (None, 1, 1), (99, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.judged(docs, labels).count() == len(TEXTS)
    kept = toxicity.clean(docs, no_labels)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)
    assert toxicity.clean(none, labels).count() == 0


def test_hosts(spark):
    pages = spark.createDataFrame([(1, None, 0), (2, "no scheme", 0), (3, "http://A.example.NET/en/x?q#f", 0), (None, "http://b.org", 0),
                                   (3, "http://A.example.NET/en/x?q#f", 0), (4, "", 0), (5, "http://", 0)], "page_id long, url string, bound int")
    outcomes = spark.createDataFrame([("b.org", 1), ("b.org", None), ("", 1), (None, 0)], "host string, bad int")
    rows = hosts.judge(pages, outcomes).collect()
    assert len(rows) == 7
    by = {r.page_id: r for r in rows}
    assert (by[3].host, by[3].path, by[3].rule, by[3].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert all((by[k].host, by[k].path, by[k].rule, by[k].verdict) == ("", "", None, "allow") for k in (1, 2, 4, 5))
    assert hosts.judge(pages.where("false"), outcomes).count() == 0
    assert {r.verdict for r in hosts.judge(pages, outcomes.where("false")).collect()} == {"allow"}


def test_knn(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
                               (6, [float("inf"), 0.0]), (None, [1.0, 1.0]), (7, [0.5, 0.5, 0.5]), (8, []), (9, [-1.0, 0.25])],
                              "vec_id long, embedding array<float>")
    rows = got(knn.top_k(v, v).orderBy("query_id", "rank"))
    assert rows == [(1, 1, 2, 65536), (1, 2, 9, -65536), (2, 1, 1, 65536), (2, 2, 9, -65536), (9, 1, 1, -65536), (9, 2, 2, -65536)]
    assert got(knn.top_k(v.where("false"), v)) == [] and got(knn.top_k(v, v.where("false"))) == []


def test_revisit(spark):
    records = spark.createDataFrame([("a", None, 1, "response", None), ("b", "no scheme", 2, "revisit", None), (None, "http://x/", 3, "revisit", {}),
                                     ("c", "http://x", None, "revisit", {"etag": "1"}), ("d", "http://x/", 1, "other", {})],
                                    "record_id string, url string, at long, kind string, headers map<string,string>")
    rows = revisit.resolve(records).collect()
    assert sorted((str(r.record_id), r.status) for r in rows) == [("None", "no_response"), ("b", "no_response"), ("c", "no_response")]
    assert revisit.resolve(records.where("false")).count() == 0
