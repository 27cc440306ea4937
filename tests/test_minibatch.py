"""Mini-batch training against a plain NumPy loop."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweave.operators import minibatch, split

WIDTH, CLASSES = 64, 3


def made(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        y = r.choice([0, 1, 1, 2])
        rows.append((i * 7 + 1, r.choices([f"w{y}{k}" for k in range(6)] + [f"c{k}" for k in range(6)], k=r.randint(0, 9)), y))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_id long, tokens array<string>, label int")


def word_numbers(spark, rows):
    words = spark.createDataFrame([(w,) for w in {t for _, ts, _ in rows for t in ts} | {"-"}], "w string")
    return {r.w: r.h for r in words.select("w", F.pmod(F.xxhash64("w"), F.lit(WIDTH)).cast("int").alias("h")).collect()}


def dense(rows, number):
    x = np.zeros((len(rows), WIDTH))
    for i, (_, ts, _) in enumerate(rows):
        for t in ts:
            x[i, number[t]] += 1
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300), np.array([y for *_, y in rows])


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def plain(rows, val, number, epochs, size, rate, shard_batches):
    """The loop as stated, shard by shard, with dense arrays."""
    order = sorted(rows, key=lambda r: (hashlib.md5(f"shuffle:42:{r[0]}".encode()).hexdigest(), r[0]))
    x, y = dense(order, number)
    vx, vy = dense(val, number)
    batches = math.ceil(len(rows) / size)
    total = batches * epochs
    warm = total * 10 // 100
    w, b, out = np.zeros((WIDTH, CLASSES)), np.zeros(CLASSES), []
    for e in range(epochs):
        change_w, change_b, loss = np.zeros_like(w), np.zeros_like(b), 0.0
        for first in range(0, batches, shard_batches):
            sw, sb, seen = w.copy(), b.copy(), 0
            for k in range(first, min(first + shard_batches, batches)):
                bx, by = x[k * size:(k + 1) * size], y[k * size:(k + 1) * size]
                step = e * batches + k
                lr = rate * (step + 1) / warm if step < warm else rate * (total - step) / (total - warm)
                p = softmax(bx @ sw + sb)
                loss -= np.log(p[np.arange(len(by)), by]).sum()
                g = p - np.eye(CLASSES)[by]
                sw -= lr * bx.T @ g / len(by)
                sb -= lr * g.mean(axis=0)
                seen += len(by)
            change_w += (sw - w) * seen / len(rows)
            change_b += (sb - b) * seen / len(rows)
        w, b = w + change_w, b + change_b
        p = softmax(vx @ w + b)
        out.append((e + 1, loss / len(rows), -np.log(p[np.arange(len(vy)), vy]).mean(), (p.argmax(axis=1) == vy).mean()))
    return w, b, out


@pytest.mark.parametrize("shard_batches, parts", [(10 ** 6, 1), (4, 5), (1, 3)])
def test_equals_a_plain_loop(spark, tmp_out, shard_batches, parts):
    rows, val = made(90), made(40, 2)
    number = word_numbers(spark, rows + val)
    report = minibatch.train(frame(spark, rows).repartition(parts), frame(spark, val), CLASSES, tmp_out, epochs=3, batch_size=7, width=WIDTH,
                             shard_batches=shard_batches)
    got = sorted((r.epoch, r.train_loss, r.val_loss, r.val_accuracy) for r in report.collect())
    w, b, want = plain(rows, val, number, 3, 7, minibatch.RATE, shard_batches)
    assert np.allclose(np.array(got), np.array(want), atol=1e-9)
    gw, gb = minibatch.load(spark, tmp_out, 3, WIDTH, CLASSES)
    assert np.allclose(gw, w, atol=1e-9) and np.allclose(gb, b, atol=1e-9)
    assert got[2][1] < got[0][1]  # it learns


def test_same_under_any_partitioning(spark, tmp_out):
    rows, val = made(120), made(20, 2)
    out = [minibatch.train(frame(spark, rows).repartition(p), frame(spark, val), CLASSES, f"{tmp_out}/{p}", epochs=2, width=WIDTH, shard_batches=3).orderBy("epoch").collect()
           for p in (1, 6)]
    assert out[0] == out[1]  # to the last bit


def test_goes_on_after_the_last_complete_epoch(spark, tmp_out, monkeypatch):
    rows, val = frame(spark, made(60)), frame(spark, made(20, 2))
    options = dict(epochs=3, width=WIDTH, shard_batches=4)
    want = minibatch.train(rows, val, CLASSES, f"{tmp_out}/whole", **options).orderBy("epoch").collect()
    real, calls = minibatch._average, []

    def failing(spark_, rows_, model, plan, epoch, classes):
        calls.append(epoch)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(spark_, rows_, model, plan, epoch, classes)

    monkeypatch.setattr(minibatch, "_average", failing)
    with pytest.raises(RuntimeError, match="lost"):
        minibatch.train(rows, val, CLASSES, f"{tmp_out}/broken", **options)
    got = minibatch.train(rows, val, CLASSES, f"{tmp_out}/broken", **options).orderBy("epoch").collect()
    assert got == want and calls == [0, 1, 1, 2]  # the first epoch is not repeated
    minibatch.train(rows, val, CLASSES, f"{tmp_out}/broken", **options)
    assert len(calls) == 4


def test_learning_rate_follows_the_batch_plan(spark):
    plan = split.batch_plan(frame(spark, made(100)), 8, 4).first()
    p = minibatch.Plan(4, plan.batches_per_epoch, plan.rows, plan.warmup_steps, 1.0)
    rates = [p.rate_at(i) for i in range(plan.total_steps)]
    assert plan.warmup_steps == 5 and rates[:5] == [0.2, 0.4, 0.6, 0.8, 1.0]
    assert rates[5] == 1.0 and all(a > b for a, b in zip(rates[5:], rates[6:])) and 0 < rates[-1] < 0.03


def test_edges(spark, tmp_out):
    none, one = frame(spark, []), frame(spark, [(1, [], 2)])
    (r,) = minibatch.train(none, one, CLASSES, f"{tmp_out}/a", epochs=1, width=WIDTH).collect()
    assert (r.rows, r.train_loss, r.val_accuracy) == (0, None, 0.0) and abs(r.val_loss - math.log(3)) < 1e-12
    (r,) = minibatch.train(one, none, CLASSES, f"{tmp_out}/b", epochs=1, width=WIDTH).collect()
    assert (r.rows, r.val_loss) == (1, None) and abs(r.train_loss - math.log(3)) < 1e-12
    with pytest.raises(ValueError):
        minibatch.train(one, one, 1 << 20, f"{tmp_out}/c")
    scored = minibatch.score(spark.createDataFrame([(1, None, "x")], "row_id long, tokens array<string>, probs string"), (np.zeros((8, 2)), np.zeros(2)))
    assert [tuple(r) for r in scored.collect()] == [(1, [0.5, 0.5])]
