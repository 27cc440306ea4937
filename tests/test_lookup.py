"""Token lookup in tables of any size (J2, J6, S6): every way gives the same."""

import random

import pytest
from pyspark.sql import functions as F

from newsweave.operators import lookup, text

SCHEMA = "row_id long, other string, tokens array<string>"
ROWS = [(1, "a", ["movies", "the", "movies", "x"]), (2, "b", []), (3, None, None), (4, "d", ["the", None, "", "the"]), (5, "e", ["cats"] * 40)]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    more = [(100 + i, "r", ["hot"] * r.randint(0, 30) + r.choices([f"w{k}" for k in range(300)], k=r.randint(0, 20))) for i in range(200)]
    return spark.createDataFrame(ROWS + more, SCHEMA).repartition(5)


def collected(df):
    assert sorted(df.columns) == ["other", "row_id", "tokens"]
    return {r.row_id: (r.other, r.tokens) for r in df.collect()}


@pytest.mark.parametrize("max_words, max_bytes", [(10 ** 6, 10 ** 9), (150, 10 ** 9), (10 ** 6, 900), (0, 0)])
def test_replace_tokens(spark, rows, max_words, max_bytes):
    """The whole table, its words that occur, or a join: same tokens."""
    table = {"movies": "movie", "hot": "warm", "": "empty", "absent": "gone", **{f"w{k}": f"v{k}" for k in range(0, 100)}, **{f"no{k}": "n" for k in range(100)}}
    df = spark.createDataFrame(list(table.items()), "form string, lemma string").repartition(3)
    got = collected(lookup.replace_tokens(rows, "tokens", df, max_words=max_words, max_bytes=max_bytes))
    want = {r.row_id: (r.other, r.tokens and [table.get(t, t) for t in r.tokens]) for r in rows.collect()}
    assert got == want


@pytest.mark.parametrize("max_words", [10 ** 6, 120, 0])
def test_drop_tokens(spark, rows, max_words):
    words = ["the", "hot", "", "absent"] + [f"w{k}" for k in range(100)] + [f"no{k}" for k in range(100)]
    df = spark.createDataFrame([(w,) for w in words + words + [None]], "word string").withColumn("tokens", F.lit("clash"))
    got = collected(lookup.drop_tokens(rows, "tokens", df, max_words=max_words))
    assert got == {r.row_id: (r.other, r.tokens and [t for t in r.tokens if t not in words]) for r in rows.collect()}
    out = lookup.drop_tokens(rows, "tokens", df, out="kept", max_words=max_words)
    assert sorted(out.columns) == ["kept", "other", "row_id", "tokens"]
    assert {r.row_id: r.kept for r in out.collect()} == {k: v[1] for k, v in got.items()}


def test_table_equals_literal_list(spark, rows):
    words = ["the", "w1", "w2", "hot"]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    whole = rows.where("row_id <> 4")  # a tokeniser gives no null token
    assert collected(text.remove_stopwords(whole, "tokens", table)) == collected(text.remove_stopwords(whole, "tokens", words))
    arts = spark.createDataFrame([(1, "a", "The cats and the movies"), (2, "b", ""), (3, "a", "the the")], "row_id long, category string, combined_text string")
    low = arts.withColumn("combined_text", F.lower("combined_text"))
    stop = spark.createDataFrame([("the",), ("and",)], "word string")
    assert sorted(text.normalize_text(low, stopwords=stop).collect()) == sorted(text.normalize_text(low, stopwords=["the", "and"]).collect())
    assert sorted(text.word_frequencies(low, stopwords=stop).collect()) == sorted(text.word_frequencies(low, stopwords=["the", "and"]).collect())


def test_empty_tables(spark, rows):
    none = spark.createDataFrame([], "form string, lemma string")
    assert collected(lookup.replace_tokens(rows, "tokens", none)) == collected(rows)
    table = spark.createDataFrame([("hot", "warm")], "form string, lemma string")
    for bound in (10, 0):
        assert lookup.replace_tokens(rows.where("false"), "tokens", table, max_words=bound).collect() == []


def test_no_token_row_is_exchanged(spark, rows):
    """The main plan is one projection over the rows; the subquery stays out of them."""
    table = spark.createDataFrame([("hot", "warm")], "form string, lemma string")
    made = rows.select("row_id", "other", F.array_union("tokens", F.array(F.upper("other"))).alias("tokens"))
    for out in ("tokens", "new"):
        plan = lookup.replace_tokens(made, "tokens", table, out=out)._jdf.queryExecution().optimizedPlan().toString()
        main = "\n".join(x for x in plan.split("\n") if not x.lstrip("+- ").startswith(":"))  # without the subquery's plan
        assert "Generate" not in main and "Aggregate" not in main and "collect_list" not in main
        assert "AS __value" not in main and "scalar-subquery" in main


def test_bloom_filter_lets_its_words_through(spark):
    words = spark.range(3000).select(F.concat(F.lit("w"), "id").alias("word"))
    others = spark.range(3000).select(F.concat(F.lit("x"), "id").alias("word"))
    bits = 1 << 16
    both = words.unionByName(others).withColumn("f", lookup.bloom(words, "word", bits=bits))
    got = both.select("word", lookup.may_contain(F.col("f"), F.col("word"), bits=bits).alias("passes")).collect()
    assert all(r.passes for r in got if r.word.startswith("w"))
    assert sum(r.passes for r in got if r.word.startswith("x")) < 60


def test_rules_of_the_tokeniser_are_planned_once(spark):
    """Exploding tokens does not make Spark evaluate the rules a second time."""
    df = spark.createDataFrame([(1, "a b")], "row_id long, combined_text string")
    tokens = df.select(text.cleaned_tokens(F.col("combined_text")).alias("t"))
    rules = lambda x: x._jdf.queryExecution().executedPlan().toString().count("regexp_replace(")
    spark.conf.set("spark.sql.maxPlanStringLength", 10 ** 8)
    try:
        once = rules(tokens)
        assert once > 20 and rules(text.vocabulary(tokens, "t")) == once
    finally:
        spark.conf.unset("spark.sql.maxPlanStringLength")
