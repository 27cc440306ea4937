"""Registered queries: name -> f(spark, sf_dir) -> DataFrame.

Each query reads the scale-factor tables and composes operators; none
collects rows.  The matching DuckDB statements live in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokenize as tk
from ..functions import vectors as V
from ..functions.fixed import VOCABULARY_FILE
from ..operators import bayes, encode, evaluate, ingest, labels, lengths, minibatch, model, profile, sentences, split, subword, text
from ..session import materialize, scratch_path
from ..sources.news import load_documents, load_news, load_table, read_news

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.clean_news(load_news(spark, sf_dir))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned articles with merged labels and the model input text."""
    return ingest.combine_text(labels.merge_categories(clean(spark, sf_dir)))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned articles under their raw labels with the whole text."""
    return ingest.combine_text(clean(spark, sf_dir))


# --- stage 1-2: ingest and profile -------------------------------------------

@register("clean_news")
def q_clean_news(spark, sf_dir):
    df = ingest.drop_columns(clean(spark, sf_dir), "link", "date")
    return df.select("row_id", "headline", "category", "short_description", "authors")


@register("category_profile")
def q_category_profile(spark, sf_dir):
    return profile.category_profile(clean(spark, sf_dir))


@register("top_categories")
def q_top_categories(spark, sf_dir):
    return profile.top_categories(clean(spark, sf_dir), 3)


@register("category_percent")
def q_category_percent(spark, sf_dir):
    return profile.category_percent(clean(spark, sf_dir))


@register("distinct_categories_first_seen")
def q_distinct_first_seen(spark, sf_dir):
    return profile.distinct_categories_first_seen(clean(spark, sf_dir))


@register("length_summary")
def q_length_summary(spark, sf_dir):
    return profile.length_summary(clean(spark, sf_dir), "headline")


@register("description_length_summary")
def q_description_length_summary(spark, sf_dir):
    return profile.length_summary(clean(spark, sf_dir), "short_description")


def length_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length state of the articles, one part per year, merged when read."""
    path = scratch_path(spark, "lengths")
    c = clean(spark, sf_dir)
    new_year = F.lit("2021-01-01").cast("date")
    for part, rows in (("until-2020", c.where(F.col("date") < new_year)), ("from-2021", c.where(F.col("date") >= new_year))):
        lengths.add_part(rows, path, part, ["headline", "short_description"])
    return lengths.read_state(spark, path)


@register("profile_from_parts")
def q_profile_from_parts(spark, sf_dir):
    """A1-A5 over parts that are each read once, medians between two bounds."""
    return lengths.length_profile(length_parts(spark, sf_dir))


@register("box_numbers_from_parts")
def q_box_numbers_from_parts(spark, sf_dir):
    """A22 over parts, every number between two bounds."""
    return lengths.box_numbers(length_parts(spark, sf_dir))


@register("category_orders")
def q_category_orders(spark, sf_dir):
    return profile.category_orders(clean(spark, sf_dir))


@register("read_news_json")
def q_read_news_json(spark, sf_dir):
    """The stand-in as JSON lines of the six article columns, read back."""
    path = scratch_path(spark, "news-json")
    load_news(spark, sf_dir).drop("row_id").write.json(path)
    return ingest.clean_news(read_news(spark, path))


@register("byline_authors")
def q_byline_authors(spark, sf_dir):
    return profile.parse_byline(clean(spark, sf_dir)).select("row_id", "authors")


@register("author_counts")
def q_author_counts(spark, sf_dir):
    return profile.author_counts(clean(spark, sf_dir))


@register("author_category_counts")
def q_author_category_counts(spark, sf_dir):
    return profile.author_category_counts(clean(spark, sf_dir))


@register("author_category_counts_compat")
def q_author_category_counts_compat(spark, sf_dir):
    return profile.author_category_counts(clean(spark, sf_dir), drop_first_seen=True)


@register("author_lookup")
def q_author_lookup(spark, sf_dir):
    return profile.author_lookup(clean(spark, sf_dir), "writer 5", drop_first_seen=True)


# --- stage 3: labels and features --------------------------------------------

@register("merged_categories")
def q_merged_categories(spark, sf_dir):
    return (merged(spark, sf_dir).groupBy("raw_category", "category")
            .agg(F.count(F.lit(1)).alias("articles")))


@register("combined_text")
def q_combined_text(spark, sf_dir):
    return ingest.select_features(merged(spark, sf_dir))


# --- stage 5: split, batches, label encodings ---------------------------------

def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_split(merged(spark, sf_dir))


@register("split_quotas")
def q_split_quotas(spark, sf_dir):
    return split.split_quotas(merged(spark, sf_dir))


@register("stratified_split")
def q_stratified_split(spark, sf_dir):
    return splits(spark, sf_dir).select("row_id", "category", "split")


@register("split_check")
def q_split_check(spark, sf_dir):
    """U4: rows in several splits, rows in none, rows in all (0, 0, n)."""
    s = splits(spark, sf_dir).select("row_id", F.lit(1).alias("given"))
    rows = merged(spark, sf_dir).select("row_id", F.lit(0).alias("given"))
    each = rows.union(s).groupBy("row_id").agg(F.sum("given").alias("times"))
    return each.agg(F.count(F.when(F.col("times") > 1, 1)).alias("in_several"), F.count(F.when(F.col("times") == 0, 1)).alias("in_none"),
                    F.count(F.lit(1)).alias("rows"))


@register("persisted_split")
def q_persisted_split(spark, sf_dir):
    """The split written by part, the test part read back alone."""
    path = scratch_path(spark, "splits")
    split.persist_splits(splits(spark, sf_dir), path)
    return split.read_split(spark, path, "test").select("row_id", "category", "combined_text")


@register("training_frame")
def q_training_frame(spark, sf_dir):
    """Ids, mask and one-hot label of the train rows in one row each."""
    t = split_tokens(spark, sf_dir)
    train = t.where(F.col("split") == "train")
    ids = encode.encode_sequences(train, encode.build_vocab(train))
    classes = split.split_quotas(merged(spark, sf_dir)).where("train > 0")
    hot = labels.one_hot(train.select("row_id", "category"), classes).select("row_id", "one_hot")
    return ids.join(hot, "row_id")


@register("class_distribution")
def q_class_distribution(spark, sf_dir):
    return split.class_distribution(splits(spark, sf_dir))


@register("shuffled_batches")
def q_shuffled_batches(spark, sf_dir):
    train = splits(spark, sf_dir).where(F.col("split") == "train").select("row_id")
    return split.assign_batches(train).select("row_id", "position", "batch")


@register("written_batches")
def q_written_batches(spark, sf_dir):
    """The train batches written in blocks; all from the second half on read again."""
    path = scratch_path(spark, "batches")
    train = splits(spark, sf_dir).where(F.col("split") == "train").select("row_id", "category")
    split.write_batches(train, path, block_batches=16)
    half = split.read_manifest(spark, path).agg(F.max("last_batch")).first()[0]
    return split.read_batches(spark, path, (half or 0) // 2).select("row_id", "category", "position", "batch", F.col("block").cast("long").alias("block"))


@register("batch_plan")
def q_batch_plan(spark, sf_dir):
    return split.batch_plan(splits(spark, sf_dir).where(F.col("split") == "train"))


@register("label_index")
def q_label_index(spark, sf_dir):
    return labels.class_table(split.split_quotas(merged(spark, sf_dir)).where("train > 0"))


@register("one_hot")
def q_one_hot(spark, sf_dir):
    s = splits(spark, sf_dir)
    # a class is in train if its quota there is not 0
    classes = split.split_quotas(merged(spark, sf_dir)).where("train > 0")
    return labels.one_hot(s, classes).select("row_id", "split", "one_hot")


# --- stage 6: evaluation -------------------------------------------------------

def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.language_predictions(load_documents(spark, sf_dir))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion_matrix(predictions(spark, sf_dir))


@register("rule_predictions")
def q_rule_predictions(spark, sf_dir):
    return predictions(spark, sf_dir)


@register("confusion_matrix")
def q_confusion_matrix(spark, sf_dir):
    return confusion(spark, sf_dir)


@register("confusion_dense")
def q_confusion_dense(spark, sf_dir):
    return evaluate.confusion_dense(confusion(spark, sf_dir))


@register("confusion_wide")
def q_confusion_wide(spark, sf_dir):
    return evaluate.confusion_wide(confusion(spark, sf_dir))


@register("class_report")
def q_class_report(spark, sf_dir):
    return evaluate.round_report(evaluate.class_report(confusion(spark, sf_dir)))


@register("evaluation_metrics")
def q_evaluation_metrics(spark, sf_dir):
    return evaluate.evaluation_metrics(confusion(spark, sf_dir))


# --- vectors over `embeddings` ---------------------------------------------------

def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load_table(spark, sf_dir, "embeddings")
    s = e.withColumn("scores", V.dense(F.col("embedding")))
    return s.withColumn("probs", V.softmax(F.col("scores")))


@register("dense_scores")
def q_dense_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("vec_id", V.round_all(F.col("scores")).alias("scores"))


@register("softmax_scores")
def q_softmax_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("vec_id", V.round_all(F.col("probs")).alias("probs"))


@register("sigmoid_scores")
def q_sigmoid_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("vec_id", V.round_all(V.sigmoid(F.col("scores"))).alias("sigmoid"))


@register("argmax_label")
def q_argmax_label(spark, sf_dir):
    return scored(spark, sf_dir).select("vec_id", "label", V.argmax(F.col("scores")).alias("predicted"))


@register("cross_entropy")
def q_cross_entropy(spark, sf_dir):
    return evaluate.cross_entropy(scored(spark, sf_dir))


@register("categorical_accuracy")
def q_categorical_accuracy(spark, sf_dir):
    return evaluate.categorical_accuracy(scored(spark, sf_dir))


@register("max_pool")
def q_max_pool(spark, sf_dir):
    return V.max_pool(load_table(spark, sf_dir, "embeddings"), "label", "embedding")


@register("pooled_features")
def q_pooled_features(spark, sf_dir):
    """An embedding as a sequence of four vectors, pooled to one."""
    e = load_table(spark, sf_dir, "embeddings")
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16)))
    return e.select("vec_id", V.pool_sequence(parts).alias("pooled"))


# --- stage 4: text -------------------------------------------------------------------

@register("tokenize")
def q_tokenize(spark, sf_dir):
    return merged(spark, sf_dir).select("row_id", tk.tokenize(F.col("combined_text")).alias("tokens"))


@register("sentence_words")
def q_sentence_words(spark, sf_dir):
    """Abbreviations and sentence starters learned from all articles."""
    return sentences.learn(merged(spark, sf_dir))


@register("tokenize_sentences")
def q_tokenize_sentences(spark, sf_dir):
    """T1 with the sentence ends that the learned words decide."""
    m = merged(spark, sf_dir).select("row_id", "combined_text")
    learned = sentences.learn(m)
    marked = sentences.mark(m, learned)  # both operators read the marks: they are made once
    out = sentences.split_sentences(sentences.tokenize(marked, learned, marked="marked"), learned, marked="marked")
    return out.select("row_id", F.size("sentences").cast("long").alias("n_sentences"), "tokens")


@register("lemmatize")
def q_lemmatize(spark, sf_dir):
    toks = merged(spark, sf_dir).select(text.cleaned_tokens(F.col("combined_text")).alias("t"))
    # the table reads the words twice: the texts are tokenised once
    return text.lemma_table(materialize(text.vocabulary(toks, "t")))


@register("normalize_text")
def q_normalize_text(spark, sf_dir):
    m = ingest.select_features(merged(spark, sf_dir))
    return text.normalize_text(m).select("row_id", "combined_text", "category")


def listed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stopword table of the user's own: every word of the `benchmark` texts."""
    b = load_table(spark, sf_dir, "benchmark")
    return b.select(F.explode_outer(tk.word_tokens(F.lower(F.col("text")))).alias("word")).where(F.col("word").isNotNull()).distinct()


@register("remove_stopwords_table")
def q_remove_stopwords_table(spark, sf_dir):
    """Tokens that a table lists are taken out, the rest stays in order."""
    toks = materialize(merged(spark, sf_dir).select("row_id", tk.tokenize(F.col("combined_text")).alias("tokens")))
    return text.remove_stopwords(toks, "tokens", listed_words(spark, sf_dir))


@register("word_frequencies_table")
def q_word_frequencies_table(spark, sf_dir):
    """A20 minus a table of stopwords."""
    return text.word_frequencies(texts(spark, sf_dir), stopwords=listed_words(spark, sf_dir))


@register("word_frequencies")
def q_word_frequencies(spark, sf_dir):
    return text.word_frequencies(texts(spark, sf_dir))


@register("word_weights")
def q_word_weights(spark, sf_dir):
    return text.word_weights(texts(spark, sf_dir), 200).withColumnRenamed("rank", "rank_in_class")


@register("top_bigrams")
def q_top_bigrams(spark, sf_dir):
    return text.top_ngrams(texts(spark, sf_dir), 2, 10).withColumnRenamed("rank", "rank_in_class")


@register("top_trigrams")
def q_top_trigrams(spark, sf_dir):
    return text.top_ngrams(texts(spark, sf_dir), 3, 10).withColumnRenamed("rank", "rank_in_class")


@register("bigrams_straddling")
def q_bigrams_straddling(spark, sf_dir):
    return text.ngram_counts_straddling(texts(spark, sf_dir), 2)


@register("trigrams_straddling")
def q_trigrams_straddling(spark, sf_dir):
    return text.ngram_counts_straddling(texts(spark, sf_dir), 3)


# --- stage 5b: vocabulary and encoding ----------------------------------------------

def split_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenised split rows, checkpointed: the vocabulary's count histogram,
    its top-k and the encoding all read them."""
    s = splits(spark, sf_dir).select("row_id", "split", "category", tk.tokenize(F.col("combined_text")).alias("tokens"))
    return text.materialize_tokens(s, "tokens")


@register("build_vocab")
def q_build_vocab(spark, sf_dir):
    t = split_tokens(spark, sf_dir)
    return encode.build_vocab(t.where(F.col("split") == "train"))


@register("encode_sequences")
def q_encode_sequences(spark, sf_dir):
    t = split_tokens(spark, sf_dir)
    vocab = encode.build_vocab(t.where(F.col("split") == "train"))
    return encode.encode_sequences(t, vocab)


@register("encode_subwords")
def q_encode_subwords(spark, sf_dir):
    """M5, sub-word form: 256 ids and mask by a public byte-level vocabulary."""
    return subword.encode_subwords(merged(spark, sf_dir), subword.read_vocabulary(spark, VOCABULARY_FILE))


# --- stage 6b: model, batched scoring, sinks -------------------------------------------

@register("batched_inference")
def q_batched_inference(spark, sf_dir):
    e = load_table(spark, sf_dir, "embeddings")
    s = model.score_batches(e, model.dense_softmax_model(), "embedding", V.DENSE_DIM)
    return s.select("vec_id", "label", V.argmax(F.col("probs")).alias("predicted"),
                    F.round(F.array_max("probs"), 6).alias("p_max"))


@register("stored_inference")
def q_stored_inference(spark, sf_dir):
    """M7 from shared storage: the dense model saved as a version, loaded by
    the workers, over all embeddings."""
    w, b = V.dense_weights_numpy()
    path = scratch_path(spark, "arrays")
    model.save_arrays(spark, path, 1, w=w, b=b)
    e = load_table(spark, sf_dir, "embeddings")
    s = model.score_batches(e, model.stored_model(spark, path, model.softmax_of_dense, 1), "embedding", V.DENSE_DIM)
    return s.select("vec_id", "label", V.argmax(F.col("probs")).alias("predicted"), F.round(F.array_max("probs"), 6).alias("p_max"))


@register("score_example")
def q_score_example(spark, sf_dir):
    """The first embedding through a stored model, then the sigmoid."""
    w, b = V.dense_weights_numpy()
    path = scratch_path(spark, "arrays")
    model.save_arrays(spark, path, 1, w=w, b=b)
    e = load_table(spark, sf_dir, "embeddings")
    s = model.score_example(e, model.stored_model(spark, path, model.scores_of_dense, 1), "embedding", V.DENSE_DIM, "vec_id")
    return s.select("vec_id", V.round_all(F.col("sigmoid")).alias("sigmoid"))


def test_with_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows with the stand-in predictor's output attached by key.

    """
    test = splits(spark, sf_dir).where(F.col("split") == "test").select("row_id", "combined_text", "category")
    preds = predictions(spark, sf_dir).select(F.col("doc_id").alias("row_id"), F.col("predicted").alias("prediction"))
    return model.attach_predictions(test, preds)


@register("attach_predictions")
def q_attach_predictions(spark, sf_dir):
    return test_with_predictions(spark, sf_dir)


@register("csv_round_trip")
def q_csv_round_trip(spark, sf_dir):
    path = scratch_path(spark, "predictions-csv")
    model.write_csv(test_with_predictions(spark, sf_dir), path)
    return model.read_csv(spark, path, "row_id bigint, combined_text string, category string, prediction string")


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target that the text carries: each document's language."""
    return load_documents(spark, sf_dir).select(F.col("doc_id").alias("row_id"), F.col("lang").alias("category"), F.col("text").alias("combined_text"))


def language_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_split(languages(spark, sf_dir).where("category IS NOT NULL AND combined_text IS NOT NULL"))


def bayes_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = language_splits(spark, sf_dir)
    words, classes = bayes.train(s.where(F.col("split") == "train"))
    test = s.where(F.col("split") == "test")
    return test.select("row_id", "category").join(bayes.predict(test, words, classes), "row_id")


@register("bayes_words")
def q_bayes_words(spark, sf_dir):
    s = language_splits(spark, sf_dir)
    return bayes.train(s.where(F.col("split") == "train"))[0]


@register("bayes_predictions")
def q_bayes_predictions(spark, sf_dir):
    return bayes_predictions(spark, sf_dir)


@register("bayes_evaluation")
def q_bayes_evaluation(spark, sf_dir):
    p = bayes_predictions(spark, sf_dir)
    return evaluate.evaluation_metrics(evaluate.confusion_matrix(p, "category", "prediction"), "category", "prediction")


_trained: dict[tuple[str, str], tuple[str, str]] = {}


def trained(spark: SparkSession, sf_dir: str):
    """(path of the written split, fitted model), trained once per session.

    The split depends on key and label only, so rows are split first and
    normalised once, on the way into the write (S7); training and scoring read
    their part with partition pruning.  The model is saved (S4) and later
    queries load it (S5).
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _trained:
        path, saved = scratch_path(spark, "splits"), scratch_path(spark, "model")
        rows = language_splits(spark, sf_dir)
        split.persist_splits(text.normalize_text(rows), path)
        model.save_model(model.train_text_classifier(split.read_split(spark, path, "train")), saved)
        _trained[key] = path, saved
    path, saved = _trained[key]
    return path, model.load_model(saved)


@register("train_and_score")
def q_train_and_score(spark, sf_dir):
    path, m = trained(spark, sf_dir)
    test = split.read_split(spark, path, "test")
    return model.predict_labels(m, test).select("row_id", "category", "prediction")


@register("validation_report")
def q_validation_report(spark, sf_dir):
    path, m = trained(spark, sf_dir)
    return model.validation_report(m, split.read_split(spark, path, "validation"))


@register("model_evaluation")
def q_model_evaluation(spark, sf_dir):
    path, m = trained(spark, sf_dir)
    p = model.predict_labels(m, split.read_split(spark, path, "test"))
    return evaluate.evaluation_metrics(evaluate.confusion_matrix(p, "category", "prediction"),
                                       "category", "prediction")


@register("minibatch_training")
def q_minibatch_training(spark, sf_dir):
    """M6 over M4's batches: four epochs with warm-up, validated after each."""
    s = language_splits(spark, sf_dir)
    classes = labels.class_table(split.split_quotas(languages(spark, sf_dir).where("category IS NOT NULL AND combined_text IS NOT NULL")).where("train > 0"))
    words = s.select("row_id", "split", "category", tk.word_tokens(F.lower(F.col("combined_text"))).alias("tokens"))
    rows = materialize(labels.index_labels(words, classes).where("label IS NOT NULL").select("row_id", "split", "tokens", "label"))
    out = minibatch.train(rows.where("split = 'train'"), rows.where("split = 'validation'"), classes.count(), scratch_path(spark, "epochs"))
    return out.select("epoch", "steps", *[F.round(c, 9).alias(c) for c in ("last_rate", "train_loss", "val_loss", "val_accuracy")], "rows")


@register("decode_class")
def q_decode_class(spark, sf_dir):
    s = splits(spark, sf_dir)
    classes = labels.class_table(split.split_quotas(merged(spark, sf_dir)).where("train > 0"))
    test = labels.index_labels(s.where(F.col("split") == "test"), classes)
    return labels.decode_class(test, classes, idx_col="label", out="decoded").select("row_id", "label", "decoded")


@register("preview_normalized")
def q_preview_normalized(spark, sf_dir):
    m = ingest.select_features(merged(spark, sf_dir))
    return ingest.preview(text.normalize_text(m, first=5).select("row_id", "combined_text", "category"), 5)
