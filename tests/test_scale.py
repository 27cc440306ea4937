"""Work that must not grow faster than the input: passes, distinct rows, shards, checkpoints."""

import re

from pyspark.sql import functions as F

from conftest import SF001
from newsweave.functions import tokenize as tk
from newsweave.operators import minibatch, model, sentences, text
from newsweave.plans.catalog import QUERIES


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plain_texts_skip_the_passes_for_rare_strings():
    always = [p for p in tk.TOKEN_PASSES if p[2] is None]
    assert len(always) <= 4
    for pattern, _, needed in tk.TOKEN_PASSES:
        assert needed is None or all(re.search(r"['\w\"“”]", n) for n in needed), pattern


def test_sentence_words_are_bared_on_distinct_rows(spark):
    rows = [(1, "dr. x went. it came! we saw"), (2, "it went. we saw dr. x"), (3, None), (4, ""), (5, " it. ")]
    df = spark.createDataFrame(rows, "row_id long, combined_text string")
    counted = sentences.counted_words(df, "combined_text")
    once = sorted(map(str, counted.collect()))
    again = sentences.counted_words(df.crossJoin(spark.range(20)), "combined_text").withColumn("n", F.col("n") / 20)
    assert again.count() == len(once)
    got = {(r.lead, r.form, r.dot): r.n for r in counted.collect()}
    assert got[("dr.", "x", False)] == 2 and got[("!", "we", False)] == 1 and got[("went.", "it", False)] == 1
    assert got[(None, "it", False)] == 1 and got[(None, "it", True)] == 1 and got[("", "saw", False)] == 2


def test_both_sentence_operators_read_one_mark(spark):
    df = spark.createDataFrame([(1, "dr. x went. it came"), (2, None)], "row_id long, combined_text string")
    learned = spark.createDataFrame([("dr", 1), ("it", 2)], "form string, kind int")
    marked = sentences.mark(df, learned)
    out = sentences.split_sentences(sentences.tokenize(marked, learned, marked="marked"), learned, marked="marked")
    assert out.columns == ["row_id", "combined_text", "marked", "tokens", "sentences"]
    apart = sentences.split_sentences(sentences.tokenize(df, learned), learned)
    assert sorted(out.drop("marked").collect()) == sorted(apart.collect())
    assert _optimized(out).count("zip_with") == 1


def test_ngrams_are_joined_without_lambdas(spark):
    assert "zip_with" not in _optimized(QUERIES["top_trigrams"](spark, SF001))


def test_straddling_ngrams_are_aggregated_once(spark):
    plan = _optimized(QUERIES["trigrams_straddling"](spark, SF001))
    assert len([x for x in plan.split("\n") if "Aggregate [" in x and "gram#" in x]) == 1


def test_a_task_reads_one_shard(spark):
    rows = spark.createDataFrame([(i, [f"w{i % 5}"] * 3, i % 2) for i in range(96)], "row_id long, tokens array<string>, label int")
    a = minibatch.arranged(rows, "tokens", "label", "row_id", 2, "shuffle:42", 64, 4, 12)
    assert dict(a.dtypes)["x"] == "array<smallint>"
    parts = a.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("shard").alias("k")).collect()
    assert len(parts) == 12 and {r.k for r in parts} == {1}


def test_tokens_are_checkpointed_as_text(spark, monkeypatch):
    rows = [(1, ["a", "", "b"]), (2, []), (3, None), (4, [""]), (5, ["x"]), (6, ["", ""])]
    df = spark.createDataFrame(rows, "row_id long, t array<string>")
    kinds, real = [], text.materialize
    monkeypatch.setattr(text, "materialize", lambda d: kinds.append(dict(d.dtypes)["t"]) or real(d))
    assert sorted(map(tuple, text.materialize_tokens(df, "t").collect())) == rows and kinds == ["string"]


def test_training_checkpoints_frequencies_not_tokens(spark, monkeypatch):
    df = spark.createDataFrame([("a", "one two"), ("b", "three four"), ("a", "one one")], "category string, combined_text string")
    columns, real = [], model.materialize
    monkeypatch.setattr(model, "materialize", lambda d: columns.extend(d.columns) or real(d))
    fitted = model.train_text_classifier(df, num_features=32)
    assert columns == ["category", "tf"]
    assert [r.prediction for r in model.predict_labels(fitted, df).select("prediction").collect()] == ["a", "b", "a"]
