"""Text head by epochs: a step equals plain numpy, losses fall, the best epoch is kept, hard rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tabtext.operators import epochs as EP
from tabtext.plans import fixtures as X
from tabtext.plans import jobs as J

SMALL = EP.Training(epochs=3, batches=3, buckets=64, dim=4)


def plain_gradients(head, docs, ys, classes):
    """Row by row and id by id."""
    ge, gw, gb, loss = np.zeros_like(head.embed), np.zeros_like(head.weight), np.zeros_like(head.bias), 0.0
    for ids, y in zip(docs, ys):
        mean = sum((head.embed[i] for i in ids), np.zeros(head.embed.shape[1])) / max(1, len(ids))
        s = head.weight @ mean + head.bias
        if classes:
            p = np.exp(s) / np.exp(s).sum()
            loss -= np.log(p[int(y)])
            d = p - (np.arange(len(p)) == y)
        else:
            loss += (s[0] - y) ** 2
            d = 2 * (s - y)
        gw += np.outer(d, mean)
        gb += d
        for i in ids:
            ge[i] += head.weight.T @ d / len(ids)
    return [ge, gw, gb], loss


@pytest.mark.parametrize("classes", [True, False])
@pytest.mark.parametrize("chunk", [1, 50, 1 << 17])
def test_step_equals_plain_numpy(spark, monkeypatch, classes, chunk):
    monkeypatch.setattr(EP, "CHUNK_IDS", chunk)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 64, rng.integers(0, 30)).tolist() for _ in range(40)]
    ys = rng.integers(0, 3, 40).astype(float).tolist() if classes else rng.normal(size=40).tolist()
    head = EP.Head(rng.normal(size=(64, 4)), rng.normal(size=(3 if classes else 1, 4)), rng.normal(size=3 if classes else 1))
    rows = spark.createDataFrame(list(zip(docs, ys)), "ids array<int>, y double").repartition(5)
    grads, loss, n = EP.gradient_pass(rows, head, classes)
    want, want_loss = plain_gradients(head, docs, ys, classes)
    assert n == 40 and loss == pytest.approx(want_loss, abs=1e-7)
    for g, w in zip(grads, want):
        assert np.abs(g - w).max() < 1e-7
    # the first step of Adam moves every parameter with a gradient by the rate
    moved = EP.Adam(SMALL).apply(head, grads, 0.25)
    for a, b, w in zip(moved.parts(), head.parts(), want):
        assert np.allclose((b - a)[np.abs(w) > 1e-3], 0.25 * np.sign(w[np.abs(w) > 1e-3]), atol=1e-5)


def test_rate_rises_and_falls():
    t = EP.Training(rate=1.0, warmup=0.1)
    r = [EP.rate(s, 40, t) for s in range(40)]
    assert r[:4] == [0.25, 0.5, 0.75, 1.0] and r[4] == 1.0 and r[-1] == pytest.approx(1 / 36) and r[4:] == sorted(r[4:], reverse=True)


def test_gram_ids(spark):
    df = spark.createDataFrame([("one two one two",), ("solo",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(EP.gram_ids(F.col("t"), 1 << 20)).collect()]
    assert [len(g) for g in got] == [7, 1, 0, 0]
    assert got[0][0] == got[0][2] and got[0][4] == got[0][6] != got[0][5]


def test_hard_rows_repeat_exactly(spark):
    data = [(i, "train" if i % 4 else "valid", "ab"[i % 2], ("good fine " if i % 2 else "bad poor ") * (1 + i % 3)) for i in range(60)]
    data += [(100, "train", "a", None), (101, "train", "b", ""), (102, "valid", "a", None), (103, "train", None, "word"),
             (None, "train", "a", "bad bad"), (104, "valid", None, "good fine"), (105, "valid", "unseen", "good"), (7, "train", "b", "good fine ")]
    df = spark.createDataFrame(data, "key long, split string, label string, sentence string")
    runs = [J.train_text_head(df, training=SMALL) for _ in range(2)]
    out = [sorted(map(tuple, o.collect()), key=str) for o, _ in runs]
    assert out[0] == out[1] and [e.collect() for _, e in runs][0] == runs[1][1].collect()
    by = {r[0]: r for r in out[0]}
    assert len(out[0]) == 15 + 3 and by[104][2] == "b" and by[105][1] == "unseen" and all(r[2] in ("a", "b") for r in out[0])
    assert all(r[1] == r[2] for r in out[0] if r[0] < 100)
    with pytest.raises(ValueError):
        J.train_text_head(df.filter("split = 'valid'"), training=SMALL)


@pytest.mark.parametrize("classifier", [True, False])
def test_losses_fall_and_the_best_epoch_stays(spark, classifier):
    df = X.fx_text_class(spark, SF001).drop("n_chars") if classifier else X.fx_text_reg(spark, SF001).drop("lang")
    pred, epochs = J.train_text_head(df, classifier)
    log = epochs.orderBy("epoch").collect()
    assert [r["epoch"] for r in log] == [1, 2, 3, 4, 5]
    loss = [r["loss"] for r in log]
    assert loss == sorted(loss, reverse=True) and loss[-1] < 0.9 * loss[0], loss
    best = [r for r in log if r["best"]]
    assert len(best) == 1 and best[0]["metric"] == max(r["metric"] for r in log)
    assert pred.count() == df.filter("split = 'valid'").count()
    from tabtext.operators import evaluate as E
    if classifier:
        assert E.summary(pred).first()["macro_f1"] == pytest.approx(best[0]["metric"])


def test_broadcast_needs_no_copy_of_the_package():
    import pickle
    assert b"tabtext" not in pickle.dumps(EP.new_head(2, SMALL).parts())


def test_a_row_sums_one_number_per_output(spark):
    """With fewer outputs than dimensions a task sums and hands over scores, not embeddings; a row's score is its own, bit by bit."""
    rng = np.random.default_rng(2)
    head = EP.Head(rng.normal(size=(64, 4)), rng.normal(size=(1, 4)), rng.normal(size=1))
    by = EP.factor(head)
    assert by.shape == (64, 1)
    ids, offs = rng.integers(0, 64, 50), np.array([0, 20, 20, 50])
    every = EP.forward(head, by, ids, offs)[1]
    assert every[2] == EP.forward(head, by, ids[20:], offs[2:] - 20)[1][0] and every[1] == head.bias


def test_more_outputs_than_dimensions(spark):
    rng = np.random.default_rng(3)
    docs, ys = [rng.integers(0, 64, rng.integers(0, 30)).tolist() for _ in range(40)], rng.integers(0, 6, 40).astype(float).tolist()
    head = EP.Head(rng.normal(size=(64, 4)), rng.normal(size=(6, 4)), rng.normal(size=6))
    grads, loss, n = EP.gradient_pass(spark.createDataFrame(list(zip(docs, ys)), "ids array<int>, y double").repartition(3), head, True)
    want, want_loss = plain_gradients(head, docs, ys, True)
    assert n == 40 and loss == pytest.approx(want_loss, abs=1e-7) and all(np.abs(g - w).max() < 1e-7 for g, w in zip(grads, want))


def test_texts_of_one_partition_are_dealt(spark):
    df = spark.createDataFrame([(i if i % 3 else None, f"word number {i} of some") for i in range(400)] + [(1, None), (1, "")], "key long, t string").coalesce(1)
    got = EP.with_gram_ids(df, "t", 64, ["key"])
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    sizes = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(sizes) < 150  # null keys, too
    assert got.filter(~F.col("ids").eqNullSafe(EP.gram_ids(F.col("t"), 64))).count() == 0 and got.count() == 402
