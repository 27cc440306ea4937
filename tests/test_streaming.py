"""The stateless stages give the same rows under readStream as in batch."""

from pyspark.sql import functions as F

from conftest import SF001
from newsweave.operators import ingest, labels, text
from newsweave.sources.news import KEYED_NEWS_SCHEMA, load_news
from newsweave.streaming import articles


def _write_json(spark, tmp_out):
    news = load_news(spark, SF001)
    src = tmp_out + "/in"
    news.select([f.name for f in KEYED_NEWS_SCHEMA]).repartition(3).write.json(src)
    return news, src


def test_features_stream_equals_batch(spark, tmp_out):
    news, src = _write_json(spark, tmp_out)
    s = articles.features_stream(articles.read_news_stream(spark, src, max_files_per_trigger=1))
    q = articles.start_parquet_sink(s, tmp_out + "/out", tmp_out + "/ckpt")
    q.awaitTermination(300)
    got = spark.read.parquet(tmp_out + "/out")
    want = ingest.select_features(ingest.combine_text(labels.merge_categories(ingest.clean_news(news))))
    assert got.count() == 195
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_normalize_stream_equals_batch(spark, tmp_out):
    news, src = _write_json(spark, tmp_out)
    feats = ingest.select_features(ingest.combine_text(labels.merge_categories(ingest.clean_news(news))))
    toks = feats.select(text.cleaned_tokens(F.col("combined_text")).alias("t"))
    lemmas = text.lemma_table(text.vocabulary(toks, "t")).cache()
    s = articles.features_stream(articles.read_news_stream(spark, src, max_files_per_trigger=1))
    q = articles.start_normalize(s, lemmas, tmp_out + "/norm", tmp_out + "/ckpt2")
    q.awaitTermination(300)
    got = spark.read.parquet(tmp_out + "/norm").drop("batch")
    want = text.normalize_text(feats)
    assert got.count() == 195
    cols = ["row_id", "combined_text", "category"]
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
