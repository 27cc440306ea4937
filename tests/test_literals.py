
import datetime
import glob
import io
import math
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from newsweave.functions import tokenize as tk
from newsweave.functions import vectors as V
from newsweave.operators import evaluate, ingest, model, profile, split, text
from newsweave.sources.news import NEWS_SCHEMA, load_table, news_from_documents, numbered, read_news


BYLINES = [
    ("a, b and c", ["a", "b", "c"]),
    ("a, and b", ["a", "and b"]),
    ("lee moran, ap", ["lee moran"]),
    ("a and b, ap", ["a", "b"]),
    ("a, ap, ap", ["a", "ap"]),
    ("", []),
    (" and x", ["x"]),
    ("a,b", ["a,b"]),
    ("ap", ["ap"]),
]


def test_byline_cases(spark):
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(BYLINES)], "row_id long, authors string")
    got = {r.row_id: r.authors for r in profile.parse_byline(df).collect()}
    for i, (b, want) in enumerate(BYLINES):
        assert got[i] == want, b


def test_median_and_quartiles(spark):
    df = spark.createDataFrame([("k", "x" * n, "y") for n in (1, 2, 3, 10)],
                               "category string, headline string, short_description string")
    p = profile.category_profile(df).collect()[0]
    assert p.median_headline_len == 2.5
    s = profile.length_summary(df).collect()[0]
    assert (s.q1, s.median, s.q3) == (1.75, 2.5, 4.75)


def test_argmax_tie_is_first(spark):
    r = spark.range(1).select(V.argmax(F.array(F.lit(0.5), F.lit(0.5))).alias("a")).collect()[0]
    assert r.a == 0


def test_author_category_compat(spark):
    df = spark.createDataFrame([(1, "u", "k1"), (2, "u", "k1"), (3, "u", "k2"), (4, "v", "k1")],
                               "row_id long, authors string, category string")
    got = {(r.author, r.category): r.n for r in profile.author_category_counts(df, True).collect()}
    assert got == {("u", "k1"): 1, ("u", "k2"): 1}
    full = {(r.author, r.category): r.n for r in profile.author_category_counts(df).collect()}
    assert full == {("u", "k1"): 2, ("u", "k2"): 1, ("v", "k1"): 1}


def test_tokenize_literal(spark):
    s = "don't stop the u.s. well-known 1,000 movies, they're \"great\": it's 10:30 (really)!"
    want = "do n't stop the u.s. well-known 1,000 movies , they 're great : it 's 10:30 ( really ) !"
    df = spark.createDataFrame([(s,)], "t string")
    got = df.select(tk.tokenize(F.col("t")).alias("x")).collect()[0].x
    assert " ".join(got) == want


def test_tokenize_contracted_words(spark):
    df = spark.createDataFrame([("i cannot, gonna gotta gimme lemme wanna d'ye more'n: 'tis and 'twas. cannot cannot canny",)], "t string")
    got = " ".join(df.select(tk.tokenize(F.col("t")).alias("x")).first().x)
    assert got == "i can not , gon na got ta gim me lem me wan na d 'ye more 'n : 't is and 't was . can not can not canny"


def test_lemma_rules_and_exceptions(spark):
    vocab = spark.createDataFrame([(w,) for w in "men man movies movie geese mice boxes box ties wolves".split()], "word string")
    got = {r.form: r.lemma for r in text.lemma_table(vocab).collect()}
    assert got == {"movies": "movie", "boxes": "box"}  # men is a word as short as man
    words = spark.createDataFrame([(w,) for w in "man movie box tie wolf".split()], "word string")
    listed = spark.createDataFrame([("geese", "goose"), ("men", "men"), ("unused", "x")], "form string, lemma string")
    got = {r.form: r.lemma for r in text.lemma_table(vocab, words, listed).collect()}
    assert got == {"movies": "movie", "boxes": "box", "ties": "tie", "wolves": "wolf", "geese": "goose"}
    assert {r.form: r.lemma for r in text.lemma_table(vocab, words).collect()}["men"] == "man"


def test_tokenize_sentences_and_blanks(spark):
    df = spark.createDataFrame([("hello world. bye now! ok\n\tthen...", ), ("",)], "t string")
    got = [r.x for r in df.select(tk.tokenize(F.col("t")).alias("x")).collect()]
    assert got[0] == ["hello", "world", ".", "bye", "now", "!", "ok", "then", "..."]
    assert got[1] == []


def test_normalise_digits_leave_double_blank(spark):
    df = spark.createDataFrame([(1, "top 10 movies")], "row_id long, combined_text string")
    lex = spark.createDataFrame([("movie",), ("top",)], "word string")
    got = text.normalize_text(df, dictionary=lex).collect()[0].combined_text
    assert got == "top  movie"
    sq = text.normalize_text(df, dictionary=lex, squeeze=True).collect()[0].combined_text
    assert sq == "top movie"


def test_normalise_keeps_empty_rows(spark):
    df = spark.createDataFrame([(1, "the and of"), (2, "!!")], "row_id long, combined_text string")
    got = {r.row_id: r.combined_text for r in text.normalize_text(df).collect()}
    assert got == {1: "", 2: ""}


def test_null_rule_and_empty_description(spark):
    rows = [(1, None, "h", "c", "d", "a", None), (2, "l", "h", "c", "", "a", None)]
    df = spark.createDataFrame(rows, "row_id long, link string, headline string, category string, "
                                     "short_description string, authors string, date date")
    df = df.withColumn("date", F.lit("2020-01-01").cast("date"))
    c = ingest.combine_text(ingest.clean_news(df)).collect()
    assert [r.row_id for r in c] == [2]
    assert c[0].combined_text == "h "


def test_null_filter_is_pushed_to_scan(spark, tmp_out):
    p = tmp_out + "/news.json"
    spark.createDataFrame([("l", "H", "C", "d", "a", datetime.date(2020, 1, 2))], NEWS_SCHEMA).write.json(p)
    plan = ingest.drop_incomplete(spark.read.schema(NEWS_SCHEMA).json(p))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(link), IsNotNull(headline)" in plan


def test_json_of_six_columns_keeps_every_line(spark, tmp_out):
    p = tmp_out + "/news.json"
    line = '{"category": "C", "headline": "H", "authors": "", "link": "l", "short_description": "d", "date": "2018-05-26"}\n'
    with open(p, "w") as f:
        f.write(line * 2 + line.replace("H", "G"))
    rows = ingest.clean_news(read_news(spark, p)).collect()
    assert sorted(r.headline for r in rows) == ["g", "h", "h"]
    assert len({r.row_id for r in rows}) == 3 and str(rows[0].date) == "2018-05-26"
    assert sorted(r.row_id for r in rows) == sorted(r.row_id for r in ingest.clean_news(read_news(spark, p)).collect())


def test_json_without_a_declared_column_raises(spark, tmp_out):
    p = tmp_out + "/short.json"
    with open(p, "w") as f:
        f.write('{"category": "C", "headline": "H", "link": "l", "short_description": "d", "date": "2018-05-26"}\n')
    with pytest.raises(ValueError, match="authors"):
        read_news(spark, p, require_all=True)
    assert read_news(spark, p).collect()[0].authors is None


def test_keys_are_unique_and_do_not_depend_on_the_files(spark, tmp_out):
    """A third of all lines are one line: no key twice, the same keys anyhow."""
    line = '{{"category": "c", "headline": "h{}", "authors": "", "link": "l", "short_description": "d", "date": "2018-05-26"}}\n'
    lines = [line.format(i) for i in range(600)] + [line.format("hot")] * 300
    got = []
    for files, order in ((1, 1), (9, -1)):
        folder = f"{tmp_out}/{files}"
        os.makedirs(folder)
        for k in range(files):
            with open(f"{folder}/{k}.json", "w") as f:
                f.writelines(lines[::order][k::files])
        rows = read_news(spark, folder).collect()
        assert sorted(r.row_id for r in rows) == list(range(900))
        got.append(sorted((r.row_id, r.headline) for r in rows))
    assert got[0] == got[1]
    hot = [i for i, h in got[0] if h == "hhot"]
    assert hot == list(range(hot[0], hot[0] + 300))


def test_a_repeated_line_is_spread_over_the_ranges(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("headline")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    try:
        parts = numbered(rows).where("headline = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(r["count"] for r in parts) < 5000


def test_split_weights_and_small_classes(spark):
    rows = spark.createDataFrame([(i, "a" if i < 60 else "b") for i in range(100)] + [(100, "one")], "row_id long, category string")
    for weights, totals in (((14, 3, 3), (70, 15, 16)), ((1, 0, 0), (101, 0, 0)), ((0, 1, 1), (0, 50, 51)), ((8, 1, 1), (80, 10, 11)), ((2, 1, 0), (67, 34, 0))):
        got = split.stratified_split(rows, weights=weights).groupBy("split").count().collect()
        assert {r["split"]: r["count"] for r in got} == {k: n for k, n in zip(split.SPLITS, totals) if n}, weights
    for bad in ((0, 0, 0), (1, -1, 1), (0.7, 0.2, 0.1)):
        with pytest.raises(ValueError, match="weights"):
            split.split_quotas(rows, weights=bad)
    assert split.stratified_split(rows, on_small_class="quota").count() == 101
    with pytest.raises(ValueError, match="one row cannot be stratified: one"):
        split.stratified_split(rows, on_small_class="error")
    assert split.stratified_split(rows.where("category <> 'one'"), on_small_class="error").count() == 100
    with pytest.raises(ValueError, match="on_small_class"):
        split.stratified_split(rows, on_small_class="drop")


def test_metrics_as_text(spark):
    conf = spark.createDataFrame([("a", "a", 2), ("a", "b", 1), ("c", "a", 1)], "actual string, predicted string, n long")
    r = evaluate.evaluation_metrics(conf).collect()[0]
    assert (r.accuracy_text, r.weighted_recall_text) == ("0.50000", "0.50000")
    assert (r.weighted_precision_text, r.weighted_f1_text) == ("0.50000", "0.50000")


def test_stand_in_holds_every_character(spark):
    docs = load_table(spark, SF01, "documents")
    whole = news_from_documents(docs).join(docs.withColumnRenamed("doc_id", "row_id"), "row_id").where("short_description IS NOT NULL")
    assert whole.where("concat(headline, short_description) <> text").count() == 0
    sums = whole.agg(F.sum(F.length("headline") + F.length("short_description")), F.sum(F.length("text"))).first()
    assert sums[0] == sums[1]


def test_malformed_json_fails_fast(spark, tmp_out):
    p = tmp_out + "/bad.json"
    with open(p, "w") as f:
        f.write('{"link": "x"}\n{bad\n')
    with pytest.raises(Exception):
        read_news(spark, p).collect()


def test_loss_of_a_label_without_a_class(spark):
    df = spark.createDataFrame([([0.25, 0.75], 1), ([0.25, 0.75], -1), ([0.25, 0.75], 2)], "probs array<double>, label int")
    got = [r[0] for r in df.select(V.clipped_log_loss(F.col("probs"), F.col("label"))).collect()]
    assert got[0] == pytest.approx(-math.log(0.75)) and got[1] == got[2] == pytest.approx(-math.log(1e-7))


def test_dense_takes_the_callers_weights(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    got = df.select(V.dense(F.col("v"), [[1.0, 1.0], [0.5, -1.0], [0.0, 0.0]], [0.0, 0.25, 7.0]).alias("y")).first().y
    assert got == [3.0, -1.25, 7.0]


def test_long_text_ngrams_are_linear(spark):
    import time
    took = []
    for n in (30_000, 120_000):
        df = spark.createDataFrame([("k", " ".join(f"w{i % 5000}" for i in range(n)))], "category string, combined_text string")
        text.ngram_counts(df, 2).count()
        t = time.perf_counter()
        text.ngram_counts(df, 2).count()
        took.append(time.perf_counter() - t)
    assert took[1] < 10 and took[1] < 12 * max(took[0], 0.3)


def test_csv_equals_pandas(spark, tmp_out):
    rows = [('he said "x", y\nz', "e"), ("plain", "b")]
    df = spark.createDataFrame(rows, "combined_text string, category string")
    model.write_csv(df.coalesce(1), tmp_out + "/csv")
    part = glob.glob(tmp_out + "/csv/part-*.csv")[0]
    got = open(part, encoding="utf-8").read()
    buf = io.StringIO()
    pd.DataFrame(rows, columns=["combined_text", "category"]).to_csv(buf, index=False)
    assert got == buf.getvalue()


def test_csv_keeps_empty_texts_and_blanks(spark, tmp_out):
    rows = [(1, "", "a"), (2, " x ", None), (3, 'q"\n', "")]
    model.write_csv(spark.createDataFrame(rows, "row_id long, combined_text string, category string"), tmp_out + "/csv2")
    got = sorted(tuple(r) for r in model.read_csv(spark, tmp_out + "/csv2", "row_id long, combined_text string, category string").collect())
    assert got == rows


def test_dense_confusion_keeps_zero_rows_and_columns(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "actual string, predicted string")
    conf = evaluate.confusion_matrix(df)
    dense = {(r.actual, r.predicted): r.n for r in evaluate.confusion_dense(conf).collect()}
    assert len(dense) == 9
    assert all(dense[("b", p)] == 0 for p in "abc")
    assert all(dense[(a, "c")] == 0 for a in "abc")
    wide = {r.actual: r.counts for r in evaluate.confusion_wide(conf).collect()}
    assert wide == {"a": [1, 1, 0], "b": [0, 0, 0], "c": [1, 0, 0]}


@pytest.mark.parametrize("n", [0, 1, 1499, 1500, 1501])
def test_batch_sizes(spark, n):
    import numpy as np
    rows = [(i, [float((i * 7 + j) % 5) for j in range(V.DENSE_DIM)]) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    out = model.score_batches(df, model.dense_softmax_model(), "embedding", V.DENSE_DIM).collect()
    assert len(out) == n
    for r in out[:5]:
        assert abs(sum(r.probs) - 1) < 1e-9
    assert all(np.isfinite(r.probs).all() for r in out)


def test_profile_first_seen_ties_and_approx(spark):
    rows = [(1, "b", "xx", "y"), (2, "a", "x", "y"), (3, "b", "xxxx", "y"), (4, "a", "xxx", "y"), (5, "c", "x", "y")]
    df = spark.createDataFrame(rows, "row_id long, category string, headline string, short_description string")
    got = [r.category for r in profile.category_profile(df, tie_break="first_seen").collect()]
    assert got == ["b", "a", "c"]
    assert [r.category for r in profile.category_profile(df).collect()] == ["a", "b", "c"]
    approx = {r.category: r.median_headline_len for r in profile.category_profile(df, approx=True).collect()}
    assert approx["c"] == 1.0 and approx["a"] in (1.0, 3.0)
