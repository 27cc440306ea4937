"""Model persistence, single-example scoring, split persistence and pooling."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from newsweave.functions import vectors as V
from newsweave.operators import ingest, model, split
from newsweave.plans import catalog


def test_save_load_round_trip(spark, tmp_out):
    s = split.stratified_split(ingest.select_features(catalog.merged(spark, SF001)))
    m = model.train_text_classifier(s.where(F.col("split") == "train"), max_iter=5)
    test = s.where(F.col("split") == "test")
    before = {r.row_id: r.prediction for r in model.predict_labels(m, test).collect()}
    model.save_model(m, tmp_out + "/model")
    again = model.load_model(tmp_out + "/model")
    after = {r.row_id: r.prediction for r in model.predict_labels(again, test).collect()}
    assert before == after and len(after) == 30
    one = model.score_one(spark, again, "a headline about movies").collect()
    assert len(one) == 1 and one[0].prediction in model.model_classes(again)
    rep = model.validation_report(again, s.where(F.col("split") == "validation")).collect()[0]
    assert rep.rows == 29 and 0 <= rep.val_accuracy <= 1 and rep.val_loss > 0


def test_persisted_splits_prune_partitions(spark, tmp_out):
    s = split.stratified_split(ingest.select_features(catalog.merged(spark, SF001)))
    split.persist_splits(s, tmp_out + "/splits")
    t = split.read_split(spark, tmp_out + "/splits", "test")
    assert t.count() == 30
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "(split#" in plan


def test_pool_sequence(spark):
    df = spark.createDataFrame([([[1.0, 5.0], [3.0, 2.0], [0.0, 9.0]],), ([[4.0, 4.0]],)],
                               "v array<array<double>>")
    got = [r.p for r in df.select(V.pool_sequence(F.col("v")).alias("p")).collect()]
    assert got == [[3.0, 9.0], [4.0, 4.0]]


def test_load_lexicon(spark, tmp_out):
    from newsweave.operators import text
    assert text.load_lexicon(spark).count() == 179
    p = tmp_out + "/dict.csv"
    with open(p, "w") as f:
        f.write("word\nmovie\ntop\n")
    d = text.load_lexicon(spark, p, kind="dictionary")
    assert sorted(r.word for r in d.collect()) == ["movie", "top"]
    df = spark.createDataFrame([(1, "top movies")], "row_id long, combined_text string")
    assert text.normalize_text(df, dictionary=d).collect()[0].combined_text == "top movie"


def test_encode_type_ids_option(spark):
    from newsweave.operators import encode
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, [])], "row_id long, tokens array<string>")
    vocab = encode.build_vocab(df)
    rows = {r.row_id: r for r in encode.encode_sequences(df, vocab, max_len=8, type_ids=True).collect()}
    assert rows[1].input_word_ids == [0, 4, 5, 4, 2, 1, 1, 1]
    assert rows[1].input_mask == [1, 1, 1, 1, 1, 0, 0, 0]
    assert rows[2].input_word_ids == [0, 2, 1, 1, 1, 1, 1, 1]
    assert rows[2].input_type_ids == [0] * 8


def test_bayes_beats_the_majority_and_handles_empty_texts(spark):
    from newsweave.operators import bayes
    rows = [(1, "the cat the dog", "en"), (2, "the end", "en"), (3, "le chat le chien", "fr"), (4, "", "fr")]
    df = spark.createDataFrame(rows, "row_id long, combined_text string, category string")
    words, classes = bayes.train(df)
    new = spark.createDataFrame([(10, "the unseen"), (11, "le"), (12, ""), (13, "nothing known")], "row_id long, combined_text string")
    got = {r.row_id: r.prediction for r in bayes.predict(new, words, classes).collect()}
    assert got == {10: "en", 11: "fr", 12: "en", 13: "fr"}


def test_language_models_beat_the_majority(spark):
    for name in ("bayes_evaluation", "model_evaluation"):
        m = catalog.QUERIES[name](spark, SF001).first()
        assert m.accuracy > 0.75, name


# --- written batches (M4, J5) and stored models (M7) ---------------------------

def test_written_batches_are_read_by_block(spark, tmp_out):
    rows = spark.range(1003).select(F.col("id").alias("row_id"), F.concat(F.lit("t"), "id").alias("text"))
    split.write_batches(rows.repartition(5), tmp_out, batch_size=10, block_batches=7)
    want = {r.row_id: (r.position, r.batch) for r in split.assign_batches(rows, 10).collect()}
    manifest = split.read_manifest(spark, tmp_out).orderBy("block").collect()
    assert [(m.block, m.first_batch, m.last_batch, m.first_position, m.rows) for m in manifest] == [
        (k, 7 * k, min(7 * k + 6, 100), 70 * k, min(70, 1003 - 70 * k)) for k in range(15)]
    for first, last in ((0, 0), (33, 33), (100, 100), (12, 15), (95, None), (0, None), (101, None), (50, 40)):
        df = split.read_batches(spark, tmp_out, first, last)
        got = {r.row_id: (r.position, r.batch) for r in df.collect()}
        assert got == {k: v for k, v in want.items() if first <= v[1] <= (100 if last is None else last)}
    one = split.read_batches(spark, tmp_out, 33, 33)
    assert len(one.select(F.input_file_name()).distinct().collect()) == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in plan and "GreaterThanOrEqual(batch,33)" in plan


def test_written_batches_of_nothing(spark, tmp_out):
    split.write_batches(spark.range(0).select(F.col("id").alias("row_id")), tmp_out)
    assert split.read_manifest(spark, tmp_out).count() == 0


def _counting(folder):
    """Scores that note which worker process loaded a model object."""
    def predict(arrays, x):
        import os
        with open(f"{folder}/{os.getpid()}-{id(arrays)}-{len(x)}", "a"):
            pass
        return x @ arrays["w"]
    return predict


@pytest.mark.parametrize("n", [0, 1, 1499, 1500, 1501])
def test_stored_model_scores_any_number_of_rows(spark, tmp_out, n):
    w = np.arange(6.0).reshape(3, 2)
    model.save_arrays(spark, f"{tmp_out}/m", 1, w=w)
    df = spark.range(n).coalesce(1).select("id", F.array(*[(F.col("id") + k).cast("double") for k in range(3)]).alias("x"))
    os.makedirs(f"{tmp_out}/seen")
    out = model.score_batches(df, model.stored_model(spark, f"{tmp_out}/m", _counting(f"{tmp_out}/seen"), 1), "x", 3).collect()
    assert len(out) == n
    for r in out:
        assert np.allclose(r.probs, np.array(r.x) @ w)
    seen = [x.split("-") for x in os.listdir(f"{tmp_out}/seen")]
    assert len({(pid, obj) for pid, obj, _ in seen}) == (n > 0)          # loaded once by its worker
    assert sorted({int(size) for *_, size in seen}) == sorted({min(n, 1500), n - 1500 if n > 1500 else n} - {0}) or n == 1500


def test_stored_versions_stand_beside_each_other(spark, tmp_out, monkeypatch):
    for v in (1, 2):
        model.save_arrays(spark, tmp_out, v, w=np.full((2, 1), float(v)))
    with pytest.raises(Exception, match="exists"):
        model.save_arrays(spark, tmp_out, 2, w=np.zeros(1))
    df = spark.createDataFrame([([1.0, 1.0],)], "x array<double>")
    predict = lambda arrays, x: x @ arrays["w"]
    for v in (1, 2):
        assert model.score_batches(df, model.stored_model(spark, tmp_out, predict, v), "x", 2).first().probs == [2.0 * v]
    monkeypatch.setattr(model, "MAX_MODEL_BYTES", 10)
    with pytest.raises(ValueError, match="more than 10"):
        model.stored_model(spark, tmp_out, predict, 1)
    with pytest.raises(ValueError, match="more than 10"):
        model.save_arrays(spark, tmp_out, 3, w=np.zeros(100))


def test_one_example_goes_through_the_model_and_the_sigmoid(spark, tmp_out):
    model.save_arrays(spark, tmp_out, 1, w=np.array([[1.0, -2.0], [0.0, 800.0]]), b=np.array([0.5, 0.0]))
    rows = spark.createDataFrame([(7, [9.0, 9.0]), (2, [1.0, 1.0]), (5, [0.0, 0.0])], "row_id int, x array<double>")
    predict = model.stored_model(spark, tmp_out, model.scores_of_dense, 1)
    got = model.score_example(rows, predict, "x", 2).collect()
    assert [r.row_id for r in got] == [2] and got[0].sigmoid[1] == 1.0
    assert abs(got[0].sigmoid[0] - 1 / (1 + np.exp(0.5))) < 1e-12
    assert model.score_example(rows.where("row_id > 9"), predict, "x", 2).count() == 0
