"""The stateless stages on a stream of JSON-lines article files.

The reference reads one file whole; nothing in it is stateful.  Stages 1, 3
and scoring are row-local, so the same operator functions run unchanged on
``readStream``.  Normalisation needs the lemma join and a regroup per row,
which is done per micro-batch in ``foreachBatch`` against a lemma table fixed
before the stream starts (a stream-static lookup, no streaming state).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, labels, model, text
from ..sources.news import KEYED_NEWS_SCHEMA


def read_news_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(KEYED_NEWS_SCHEMA).option("mode", "FAILFAST")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


def features_stream(stream: DataFrame) -> DataFrame:
    """S1 -> P1/F1 -> J1 -> P4/P5 on a streaming DataFrame."""
    return ingest.select_features(ingest.combine_text(labels.merge_categories(ingest.clean_news(stream))))


def score_stream(stream: DataFrame, fitted: PipelineModel) -> DataFrame:
    """Predictions for each arriving article (row-local transformers only)."""
    return model.predict_labels(fitted, stream).drop("probs")


def normalize_batch(lemmas: DataFrame, out_path: str):
    """foreachBatch body: T1-T7 with a fixed lemma table, appended as parquet.

    Idempotent per batch id: each micro-batch writes its own folder, so a
    batch replayed after a failure overwrites its own output only.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        toks = batch.withColumn("__tok", text.cleaned_tokens(F.col("combined_text"))).drop("combined_text")
        withl = text.apply_lemmas(toks, "__tok", lemmas, "row_id")
        from ..functions import tokenize as tk
        res = withl.withColumn("combined_text", tk.strip_digits_joined(tk.drop_empty(F.col("__tok")))) \
                   .drop("__tok")
        res.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
    return run


def start_normalize(stream: DataFrame, lemmas: DataFrame, out_path: str, checkpoint: str,
                    available_now: bool = True):
    """Start the normalisation stream; ``checkpoint`` must be on shared storage."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(normalize_batch(lemmas, out_path))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def start_parquet_sink(df: DataFrame, out_path: str, checkpoint: str, available_now: bool = True):
    """Append a stateless stream to parquet (exactly-once via the checkpoint)."""
    w = df.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.outputMode("append").start()
