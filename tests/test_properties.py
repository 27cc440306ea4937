
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from newsweave.functions import tokenize as tk
from newsweave.functions import vectors as V
from newsweave.operators import evaluate, ingest, labels, profile, split, text
from newsweave.plans import catalog
from newsweave.sources.news import load_news


@pytest.fixture(scope="module")
def merged(spark):
    return catalog.merged(spark, SF01).cache()


@pytest.fixture(scope="module")
def splits(merged):
    return split.stratified_split(merged).cache()


def test_fixture_counts(spark, merged):
    assert load_news(spark, SF01).count() == 1000
    assert merged.count() == 979
    assert merged.select("raw_category").distinct().count() == 32
    assert merged.select("category").distinct().count() == 12


def test_split_disjoint_complete_exact(splits, merged):
    counts = dict(splits.groupBy("split").count().collect())
    assert counts == {"train": 685, "validation": 147, "test": 147}
    assert splits.select("row_id").distinct().count() == merged.count()
    assert splits.select("row_id").exceptAll(merged.select("row_id")).count() == 0


def test_split_quotas_close_to_shares(splits):
    rows = splits.groupBy("category").pivot("split", list(split.SPLITS)).count().collect()
    for r in rows:
        n = r.train + r.validation + r.test
        assert abs(r.train - n * 685 / 979) < 1
        assert abs(r.validation - (n - r.train) * 147 / 294) < 1


def test_split_independent_of_partitioning(merged, splits):
    base = {r.row_id: r.split for r in splits.select("row_id", "split").collect()}
    for k in (1, 17):
        again = split.stratified_split(merged.repartition(k))
        assert {r.row_id: r.split for r in again.select("row_id", "split").collect()} == base


def test_split_same_after_normalisation(merged, splits):
    norm = text.normalize_text(ingest.select_features(merged))
    again = split.stratified_split(norm)
    base = {r.row_id: r.split for r in splits.select("row_id", "split").collect()}
    assert {r.row_id: r.split for r in again.select("row_id", "split").collect()} == base


def test_split_cut_path_matches_window(spark, merged, monkeypatch):
    """With one bucket per class every row goes through the ranked path."""
    base = {r.row_id: r.split for r in split.stratified_split(merged).collect()}
    monkeypatch.setattr(split, "SPLIT_BUCKET_HEX", 0)
    again = {r.row_id: r.split for r in split.stratified_split(merged).collect()}
    assert again == base


def test_global_rank_equals_sort(spark, splits):
    import hashlib
    train = splits.where(F.col("split") == "train").select("row_id")
    got = {r.row_id: r.position for r in split.global_rank(train, seed="shuffle:42").collect()}
    ids = sorted(got, key=lambda i: (hashlib.md5(f"shuffle:42:{i}".encode()).hexdigest(), i))
    assert [got[i] for i in ids] == list(range(len(ids)))
    b = split.assign_batches(train).groupBy("batch").count().orderBy("batch").collect()
    assert all(r["count"] == 8 for r in b[:-1]) and 1 <= b[-1]["count"] <= 8


def test_merge_idempotent(merged):
    once = labels.merge_categories(merged.select("row_id", "category"), keep_raw=None)
    twice = labels.merge_categories(once, keep_raw=None)
    assert once.exceptAll(twice).count() == 0


def test_merge_table_join_equals_literal(spark, merged):
    from newsweave.functions.fixed import CATEGORY_MERGE
    base = merged.select("row_id", F.col("raw_category").alias("category"))
    tbl = spark.createDataFrame(list(CATEGORY_MERGE.items()), "raw string, merged string")
    a = labels.merge_categories(base, keep_raw=None)
    b = labels.merge_categories(base, tbl, keep_raw=None)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_author_counts_equal_sorted_rows(spark):
    """All (author, place, category) rows, sorted; an author's first row does
    not count in the compatible table."""
    df = ingest.clean_news(load_news(spark, SF01))
    names = lambda line: filter(None, re.split(", | and ", re.sub(", ap$", "", line)))
    rows = sorted((name, r.row_id, place, r.category) for r in df.collect() for place, name in enumerate(names(r.authors)))
    assert {r.author: r.articles for r in profile.author_counts(df).collect()} == dict(Counter(r[0] for r in rows))
    later = [r for before, r in zip([(None,)] + rows, rows) if before[0] == r[0]]
    got = {(r.author, r.category): r.n for r in profile.author_category_counts(df, True).collect()}
    assert got == dict(Counter((r[0], r[3]) for r in later))


def _loop_straddle(rows, n):
    by = defaultdict(list)
    for cat, rid, h in sorted(rows, key=lambda r: r[1]):
        by[cat].append(h)
    out = Counter()
    for cat, hs in by.items():
        words = re.findall(r"\w+", " ".join(hs))
        for i in range(len(words) - n + 1):
            out[(cat, " ".join(words[i:i + n]))] += 1
    return out


@pytest.mark.parametrize("n,parts", [(2, "1"), (2, "40"), (3, "40"), (3, "400")])
def test_straddling_ngrams_equal_loop(spark, n, parts):
    """Headlines cut to a few words, so that a gram may span several articles."""
    df = ingest.clean_news(load_news(spark, SF01)).withColumn("few", F.substring_index("headline", " ", 2))
    df = df.withColumn("few", F.when(F.col("row_id") % 3 == 0, "").when(F.col("row_id") % 3 == 1, F.substring_index("few", " ", 1)).otherwise(F.col("few")))
    want = _loop_straddle([(r.category, r.row_id, r.few) for r in df.collect()], n)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.category, r.gram): r.n for r in text.ngram_counts_straddling(df, n, "few").collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == dict(want)


def test_confusion_sums_and_recall_equals_accuracy(spark):
    p = catalog.predictions(spark, SF01)
    conf = evaluate.confusion_matrix(p)
    assert conf.agg(F.sum("n")).collect()[0][0] == 1000
    m = evaluate.evaluation_metrics(conf).collect()[0]
    assert m.weighted_recall == m.accuracy


def test_metrics_equal_builtin_evaluator(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    p = catalog.predictions(spark, SF01)
    m = evaluate.evaluation_metrics(evaluate.confusion_matrix(p)).collect()[0]
    codes = {c: float(i) for i, c in enumerate(["de", "en", "es", "fr"])}
    idx = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))])
    d = p.select(idx[F.col("actual")].alias("label"), idx[F.col("predicted")].alias("prediction"))
    for name, ours in [("accuracy", m.accuracy), ("weightedPrecision", m.weighted_precision),
                       ("weightedRecall", m.weighted_recall), ("f1", m.weighted_f1)]:
        ev = MulticlassClassificationEvaluator(metricName=name).evaluate(d)
        assert abs(ev - ours) < 1e-9, name


def test_probabilities_sum_to_one(spark):
    s = catalog.scored(spark, SF01).select(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert all(abs(r.s - 1) < 1e-9 for r in s.collect())


def test_encoded_lengths_and_masks(spark):
    e = catalog.QUERIES["encode_sequences"](spark, SF01)
    rows = e.collect()
    assert len(rows) == 979
    for r in rows:
        assert len(r.input_word_ids) == 256 and len(r.input_mask) == 256
        k = sum(r.input_mask)
        assert 2 <= k <= 256
        assert r.input_word_ids[0] == 0 and r.input_word_ids[k - 1] == 2
        assert all(x == 1 for x in r.input_word_ids[k:])


def test_max_pool_equals_numpy(spark):
    import numpy as np
    e = spark.read.parquet(SF01 + "/embeddings.parquet")
    got = {r.label: r.pooled for r in V.max_pool(e, "label", "embedding").collect()}
    pdf = e.toPandas()
    for lab, g in pdf.groupby("label"):
        want = np.max(np.stack(g.embedding.values), axis=0)
        assert np.allclose(got[lab], want)


def test_ngrams_short_inputs(spark):
    df = spark.createDataFrame([(["a"],), ([],), (["a", "b", "c"],)], "w array<string>")
    got = [r.g for r in df.select(tk.ngrams(F.col("w"), 2).alias("g")).collect()]
    assert got == [[], [], ["a b", "b c"]]


def test_token_passes_equal_the_rules_one_by_one(spark):
    """The shared passes give the tokens of the rule table, applied in its order."""
    import random
    from functools import reduce
    from unittest import mock

    from newsweave.functions.fixed import TOKEN_RULES
    rnd = random.Random(5)
    pieces = list(" \n'.,:;!?-\"()[]<>$&a1") + ["...", "--", "'s ", "'ll ", "n't ", "'d", " 'tis", " 'twas", "cannot", "can", "not", "d'ye",
                                                   "gimme", "gonna", "gotta", "lemme", "more'n", "wanna", "u.s.", "é", "\u201c", "\u00a0", "x", "' "]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 30))) for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string").repartition(4)
    got = df.select("id", tk.tokenize(F.col("s")).alias("a"))
    with mock.patch.object(tk, "TOKEN_PASSES", TOKEN_RULES):
        want = df.select("id", tk.tokenize(F.col("s")).alias("b"))
    bad = [(texts[r.id], r.a, r.b) for r in got.join(want, "id").where("a <> b").limit(5).collect()]
    assert not bad, bad
