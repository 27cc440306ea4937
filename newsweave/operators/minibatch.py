"""Mini-batch training over epochs with warm-up and decay (M6 with M4 and A18).

A softmax classifier over hashed words takes the batches of M4's seeded order:
every epoch goes through all of them, the learning rate rises over the warm-up
steps of ``batch_plan`` and then falls to zero, and the validation rows are
scored after each epoch, as the reference's training does.

Consecutive batches are a shard.  Every epoch each shard starts from the same
weights, takes its own batches in order, and gives back what it changed; the
changes are averaged by rows.  With one shard this is the plain sequential
loop.  Shards are streamed, so a task holds one batch and the weights; no task
waits for another, so a lost executor repeats only its shards.  Changes are
added as whole numbers of 2^-44, so the order of tasks does not show in the
result.  Each epoch's weights and report are files in the given shared folder;
training that is started again goes on after the last complete epoch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import EPOCHS, PROB_CLIP, TRAIN_BATCH, WARMUP_FRACTION_PERCENT
from ..session import materialize
from . import split

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package

WIDTH = 1 << 14             # hashed words
RATE = 0.5                  # highest learning rate
SHARD_BATCHES = 8192        # batches that one task takes in order
MAX_WEIGHTS = 1 << 24       # width x classes: what reaches the driver and every task
UNIT = 2.0 ** 44            # changes are summed in whole numbers of its inverse
BIAS, LOSS = -1, -2         # rows of the changes that are no word's
REPORT = "epoch int, steps long, last_rate double, train_loss double, val_loss double, val_accuracy double, rows long"


@dataclass(frozen=True)
class Plan:
    """What an epoch needs to know."""
    epochs: int
    batches: int
    rows: int
    warmup: int
    rate: float

    def rate_at(self, step: int) -> float:
        """Up to ``rate`` over the warm-up steps, then down to 0 at the end."""
        total = self.epochs * self.batches
        if step < self.warmup:
            return self.rate * (step + 1) / self.warmup
        return self.rate * (total - step) / max(1, total - self.warmup)


def hashed_words(tokens: Column, width: int = WIDTH) -> Column:
    """The words' numbers below ``width``, two bytes each where they fit."""
    kind = "smallint" if width <= 1 << 15 else "int"
    return F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(width)).cast(kind))


def arranged(df: DataFrame, tokens: str, label: str, key: str, batch_size: int, seed: int | str, width: int,
             shard_batches: int, shards: int) -> DataFrame:
    """Rows (key, tokens, label index) in M4's order, a shard's together and
    each shard in a partition of its own: a task reads one, however many there are."""
    rows = split.assign_batches(df.select(key, F.col(label).cast("int").alias("y"), hashed_words(F.col(tokens), width).alias("x")),
                                batch_size, key, seed)
    return materialize(rows.select(F.floor(F.col("batch") / shard_batches).alias("shard"), "batch", "position", "y", "x")
                       .repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "position"))


def _matrix(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word lists -> (row, word, value): counts, each row of length one."""
    lists = [np.unique(np.asarray(r.values, dtype=np.int64) if r.values is not None else np.zeros(0, np.int64), return_counts=True) for r in rows]
    row = np.repeat(np.arange(len(lists)), [len(w) for w, _ in lists])
    word = np.concatenate([w for w, _ in lists]) if lists else np.zeros(0, np.int64)
    value = np.concatenate([n / np.sqrt((n * n).sum()) if len(n) else n.astype(float) for _, n in lists]) if lists else np.zeros(0)
    return row, word, value


def probabilities(x: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    row, word, value = x
    z = np.tile(bias, (n, 1))
    np.add.at(z, row, value[:, None] * weights[word])
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def step(x: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, weights: np.ndarray, bias: np.ndarray, rate: float) -> float:
    """One gradient step in place; the summed loss before it."""
    row, word, value = x
    p = probabilities(x, len(y), weights, bias)
    loss = -np.log(np.clip(p[np.arange(len(y)), y], PROB_CLIP, 1 - PROB_CLIP)).sum()
    p[np.arange(len(y)), y] -= 1
    np.add.at(weights, word, -rate / len(y) * value[:, None] * p[row])
    bias -= rate * p.mean(axis=0)
    return float(loss)


def _epoch(model: Broadcast, plan: Plan, epoch: int):
    """Rows in order -> (word, change): what each shard changed, weighted by
    its share of the rows, in whole numbers of 1 / UNIT."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_w, first_b = model.value
        shard, weights, bias, loss, rows, touched = None, None, None, 0.0, 0, set()
        held: list[pa.RecordBatch] = []

        def take() -> None:
            nonlocal loss, rows
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            x = _matrix(t.column("x").combine_chunks())
            number = plan.batches * epoch + t.column("batch")[0].as_py()
            loss += step(x, t.column("y").to_numpy().astype(np.int64), weights, bias, plan.rate_at(number))
            rows += t.num_rows
            touched.update(np.unique(x[1]).tolist())

        def changes() -> pa.RecordBatch:
            words = np.array(sorted(touched), np.int64)
            delta = np.concatenate([weights[words] - first_w[words], [bias - first_b]]) * (rows / plan.rows)
            least = np.zeros((1, delta.shape[1]))
            least[0, 0] = loss / plan.rows
            whole = np.rint(np.concatenate([delta, least]) * UNIT).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([words, [BIAS, LOSS]]), pa.int64()), pa.array(list(whole), pa.list_(pa.int64()))],
                                              names=["word", "change"])

        for b in batches:
            shards, numbers = b.column("shard").to_numpy(), b.column("batch").to_numpy()
            edges = np.flatnonzero(np.diff(numbers)) + 1
            for lo, hi in zip(np.concatenate(([0], edges)), np.concatenate((edges, [len(numbers)]))):
                if hi == lo:
                    continue
                if held and held[0].column("batch")[0].as_py() != numbers[lo]:
                    take()
                if shards[lo] != shard:
                    if shard is not None:
                        yield changes()
                    shard, weights, bias, loss, rows = shards[lo], first_w.copy(), first_b.copy(), 0.0, 0
                    touched.clear()
                held.append(b.slice(lo, hi - lo))
        if held:
            take()
        if shard is not None:
            yield changes()
    return run


def _scores(model: Broadcast, columns: list[str], tokens: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = probabilities(_matrix(b.column(tokens)), b.num_rows, *model.value)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(list(p), pa.list_(pa.float64()))], names=[*columns, "probs"])
    return run


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray], tokens: str = "tokens") -> DataFrame:
    """The rows with ``probs``, the class probabilities; the tokens are dropped.
    A row without tokens gets what the bias says."""
    columns = [c for c in df.columns if c not in (tokens, "probs")]
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)
    narrow = df.select(*[F.col(f"`{c}`") for c in columns], hashed_words(F.coalesce(F.col(tokens), F.array().cast("array<string>")), len(model[0])).alias(tokens))
    return narrow.mapInArrow(_scores(shared, columns, tokens), schema + "probs array<double>")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _epoch_dir(folder: str, epoch: int) -> str:
    return f"{folder.rstrip('/')}/epoch-{epoch}"


def load(spark: SparkSession, folder: str, epoch: int, width: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) after an epoch; before the first all are zero."""
    weights, bias = np.zeros((width, classes)), np.zeros(classes)
    if epoch:
        t = spark.read.parquet(_epoch_dir(folder, epoch) + "/weights").toArrow().combine_chunks()
        words, values = t.column("word").to_numpy(), np.array(t.column("weights").to_pylist(), float).reshape(-1, classes)
        weights[words[words >= 0]] = values[words >= 0]
        bias[:] = values[words == BIAS].sum(axis=0)
    return weights, bias


def _average(spark: SparkSession, rows: DataFrame, model, plan: Plan, epoch: int, classes: int):
    """The model after one more epoch, and the loss on the way."""
    changed = rows.mapInArrow(_epoch(spark.sparkContext.broadcast(model), plan, epoch), "word long, change array<long>")
    sums = changed.groupBy("word").agg(*[F.sum(F.col("change")[c]).alias(f"c{c}") for c in range(classes)]).toArrow().combine_chunks()
    words = sums.column("word").to_numpy()
    delta = np.stack([sums.column(f"c{c}").to_numpy().astype(float) for c in range(classes)], axis=1) / UNIT
    weights, bias = model[0].copy(), model[1].copy()
    weights[words[words >= 0]] += delta[words >= 0]
    bias += delta[words == BIAS].sum(axis=0)
    return (weights, bias), float(delta[words == LOSS, 0].sum())


def _validation(df: DataFrame, model, tokens: str, label: str) -> tuple[float | None, float | None]:
    """Mean clipped loss and accuracy over the rows (A16, A17); none without rows."""
    from ..functions.vectors import argmax, clipped_log_loss
    s = score(df.select(tokens, F.col(label).cast("int").alias("y")), model, tokens)
    r = s.agg(F.avg(clipped_log_loss(F.col("probs"), F.col("y"))).alias("l"), F.avg((argmax(F.col("probs")) == F.col("y")).cast("int")).alias("a")).first()
    return r["l"], r["a"]


def train(df: DataFrame, validation: DataFrame, classes: int, folder: str, tokens: str = "tokens", label: str = "label",
          key: str = "row_id", epochs: int = EPOCHS, batch_size: int = TRAIN_BATCH, rate: float = RATE,
          warmup_percent: int = WARMUP_FRACTION_PERCENT, seed: int | str = "shuffle:42", width: int = WIDTH,
          shard_batches: int = SHARD_BATCHES) -> DataFrame:
    """Train on (key, tokens, label index) -> one row per epoch: epoch, steps,
    last_rate, train_loss (mean before each step), val_loss, val_accuracy, rows.

    ``load`` reads the weights of any epoch from ``folder``, which must be
    shared and used with one set of options.  Labels are 0 to ``classes`` - 1
    and not null; a row without tokens moves the bias only; without rows the
    weights stay zero.
    """
    if width * classes > MAX_WEIGHTS:
        raise ValueError(f"{width} x {classes} weights are more than {MAX_WEIGHTS}")
    spark = df.sparkSession
    plan_row = split.batch_plan(df, batch_size, epochs, warmup_percent).first()
    plan = Plan(epochs, plan_row["batches_per_epoch"], plan_row["rows"], plan_row["warmup_steps"], rate)
    done = max([e for e in range(1, epochs + 1) if _exists(spark, _epoch_dir(folder, e) + "/report/_SUCCESS")], default=0)
    model = load(spark, folder, done, width, classes)
    shards = -(-plan.batches // shard_batches)
    rows = arranged(df, tokens, label, key, batch_size, seed, width, shard_batches, shards) if plan.rows and done < epochs else None
    for epoch in range(done, epochs):
        loss = None
        if rows is not None:
            model, loss = _average(spark, rows, model, plan, epoch, classes)
        val_loss, val_accuracy = _validation(validation, model, tokens, label)
        used = np.flatnonzero(np.abs(model[0]).sum(axis=1))
        table = pa.table({"word": np.concatenate([used, [BIAS]]), "weights": pa.array(list(np.concatenate([model[0][used], [model[1]]])), pa.list_(pa.float64()))})
        out = _epoch_dir(folder, epoch + 1)
        spark.createDataFrame(table).write.mode("overwrite").parquet(out + "/weights")
        steps = plan.batches * (epoch + 1)
        report = (epoch + 1, steps, float(plan.rate_at(steps - 1)) if steps else None, loss, val_loss, val_accuracy, plan.rows)
        # the report comes last: with it the epoch is complete
        spark.createDataFrame([report], REPORT).coalesce(1).write.mode("overwrite").parquet(out + "/report")
    return spark.read.schema(REPORT).parquet(*[_epoch_dir(folder, e) + "/report" for e in range(1, epochs + 1)])
