"""Train, persist, batch-score and decode.

The reference fine-tunes a pretrained encoder on one GPU; here the classifier
is a Spark ML pipeline (hashed term frequencies, IDF, multinomial logistic
regression) trained on the executors.  Python models are scored with
``predict_batch_udf``: Arrow batches of ``batch_size`` rows per call.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, StringIndexer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tokenize as tk
from ..functions.fixed import SCORE_BATCH
from ..functions.vectors import argmax, clipped_log_loss, sigmoid
from ..session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

# 2^16 hashed terms x k classes keeps the dense gradient small enough to be
# aggregated in a tree across many executors.
NUM_FEATURES = 1 << 16
MAX_MODEL_BYTES = 1 << 30  # a stored NumPy model beyond this is refused, not broadcast
CSV_ROWS = 20_000  # rows of one CSV file
CSV_NULL = "\\N"    # so that an empty text stays one


def featurize(df: DataFrame, col: str = "combined_text") -> DataFrame:
    """Model input: word tokens of the text (the same tokeniser as T1)."""
    return df.withColumn("tokens", tk.tokenize(F.col(col)))


def train_text_classifier(train: DataFrame, label: str = "category", max_iter: int = 30,
                          reg: float = 1e-3, num_features: int = NUM_FEATURES) -> PipelineModel:
    """M6: fit tokens -> TF -> IDF -> softmax regression; labels indexed alphabetically.

    The hashed term frequencies of the training set are checkpointed once in
    the shared folder: the label index, IDF and every optimiser pass then read
    these few numbers a row instead of its tokens (and neither they nor a lost
    executor run the upstream plan again).
    """
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features)
    rows = materialize(tf.transform(featurize(train).select(label, "tokens")).select(label, "tf"))
    index = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="error").fit(rows)
    idf = IDF(inputCol="tf", outputCol="features").fit(rows)
    lr = LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg, tol=1e-4,
                            featuresCol="features", labelCol="label", aggregationDepth=3)
    return PipelineModel([index, tf, idf, lr.fit(idf.transform(index.transform(rows)))])


def model_classes(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def _decode_array(model: PipelineModel):
    return F.array(*[F.lit(c) for c in model_classes(model)])


def predict_labels(model: PipelineModel, df: DataFrame, out: str = "prediction") -> DataFrame:
    """M8: arg-max class index -> class name (J3 through the fitted label list)."""
    # the label index is for training only: rows may have labels it never saw
    scored = PipelineModel(model.stages[1:]).transform(featurize(df))
    classes = _decode_array(model)
    probs = vector_to_array("probability")
    return (scored.withColumn("probs", probs)
            .withColumn(out, F.element_at(classes, argmax(F.col("probs")) + 1))
            .drop("tokens", "tf", "features", "rawPrediction", "probability"))


def validation_report(model: PipelineModel, df: DataFrame, label: str = "category") -> DataFrame:
    """Validation loss and accuracy after training (A16 + A17 in one aggregate)."""
    classes = F.array(*[F.lit(c) for c in model_classes(model)])
    p = predict_labels(model, df).withColumn(
        "label_idx", (F.array_position(classes, F.col(label)) - 1).cast("int"))
    return p.agg(F.round(F.avg(clipped_log_loss(F.col("probs"), F.col("label_idx"))), 9).alias("val_loss"),
                 F.round(F.avg((argmax(F.col("probs")) == F.col("label_idx")).cast("int")), 9).alias("val_accuracy"),
                 F.count(F.lit(1)).alias("rows"))


def save_model(model: PipelineModel, path: str) -> None:
    """S4."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """S5."""
    return PipelineModel.load(path)


def score_batches(df: DataFrame, make_predict_fn, input_col: str, width: int, out: str = "probs",
                  batch_size: int = SCORE_BATCH) -> DataFrame:
    """M7: batched inference of a Python model over Arrow batches.

    ``make_predict_fn()`` is called once per Python worker and returns
    ``predict(x: ndarray[batch, width]) -> ndarray[batch, k]``.  Any row count
    works (0, 1, batch_size - 1, batch_size, batch_size + 1, ...).
    """
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()),
                            batch_size=batch_size, input_tensor_shapes=[[width]])
    return df.withColumn(out, udf(F.col(input_col)))


def save_arrays(spark, path: str, version: int, **arrays) -> None:
    """A NumPy model as one version in shared storage (S4 for Python models);
    versions stand beside each other and are never changed."""
    import io

    import numpy as np
    held = io.BytesIO()
    np.savez(held, **arrays)
    if (size := held.tell()) > MAX_MODEL_BYTES:
        raise ValueError(f"the model has {size} bytes, more than {MAX_MODEL_BYTES}")
    row = spark.createDataFrame([(version, size, held.getvalue())], "version int, size long, content binary")
    row.coalesce(1).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version-{version}")


def stored_model(spark, path: str, predict, version: int):
    """``make_predict_fn`` for ``score_batches`` from a stored version.

    The size is checked before the content is read; the content travels to
    each executor once, and each Python worker loads it once, when its first
    batch comes.  ``predict(arrays, x)`` gives the batch's scores.
    """
    stored = spark.read.parquet(f"{path.rstrip('/')}/version-{version}")
    if (size := stored.select("size").first()["size"]) > MAX_MODEL_BYTES:
        raise ValueError(f"version {version} has {size} bytes, more than {MAX_MODEL_BYTES}")
    content = spark.sparkContext.broadcast(bytes(stored.select("content").first()["content"]))

    def make_predict_fn():
        import io

        import numpy as np
        with np.load(io.BytesIO(content.value)) as held:
            arrays = {k: held[k] for k in held.files}
        return lambda x: predict(arrays, x)
    return make_predict_fn


def softmax_of_dense(arrays, x):
    """Scores of one dense layer (arrays w and b), as the stored query uses it."""
    import numpy as np
    z = x.astype(np.float64) @ arrays["w"].T + arrays["b"]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def scores_of_dense(arrays, x):
    """Raw scores of one dense layer (arrays w and b)."""
    import numpy as np
    return x.astype(np.float64) @ arrays["w"].T + arrays["b"]


def dense_softmax_model():
    """``make_predict_fn`` for the stand-in dense layer (NumPy, per batch).

    The weights are built here, on the driver, and travel inside the
    closure; the Python workers need only NumPy, not this package.
    """
    from ..functions.vectors import dense_weights_numpy
    w, b = dense_weights_numpy()

    def make_predict_fn():
        import numpy as np

        def predict(x):
            z = x.astype(np.float64) @ w.T + b
            z = z - z.max(axis=1, keepdims=True)
            e = np.exp(z)
            return e / e.sum(axis=1, keepdims=True)
        return predict
    return make_predict_fn


def attach_predictions(rows: DataFrame, preds: DataFrame, key: str = "row_id") -> DataFrame:
    """Predictions joined to their rows by key (never by position); a row
    without one keeps a null."""
    return rows.join(preds, key, "left")


def write_csv(df: DataFrame, path: str) -> None:
    """Header, quotes doubled, empty strings quoted, nulls marked; files
    of bounded size, since a file with line breaks is read by one task."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("nullValue", CSV_NULL)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("maxRecordsPerFile", CSV_ROWS).csv(path))


def read_csv(spark, path: str, schema: str) -> DataFrame:
    return (spark.read.option("header", True).option("escape", '"').option("multiLine", True)
            .option("nullValue", CSV_NULL)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .schema(schema).csv(path))


def score_one(spark, fitted: PipelineModel, text: str) -> DataFrame:
    """Smoke prediction for one text (a one-row DataFrame through the model)."""
    one = spark.createDataFrame([(text,)], "combined_text string")
    return predict_labels(fitted, one)


def score_example(df: DataFrame, make_predict_fn, input_col: str, width: int, key: str = "row_id",
                  out: str = "sigmoid") -> DataFrame:
    """M11 for a Python model: the row of the smallest key through M7, its raw
    scores squashed one by one (C14).  No rows give none."""
    one = df.orderBy(key).limit(1)  # a top-1: one row per task leaves the scan
    return score_batches(one, make_predict_fn, input_col, width, "__scores").withColumn(out, sigmoid(F.col("__scores"))).drop("__scores")
