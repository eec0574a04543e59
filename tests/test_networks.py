"""The network's forward pass against loops, its peaks against rows of pixels, and training epochs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetmill.operators import epochs as E
from sheetmill.operators import layout as Y
from sheetmill.operators import models as H
from sheetmill.operators import networks as N

RNG = np.random.default_rng(11)


def loop_convolved(x, w):
    c, h, wd = x.shape
    out = np.zeros((len(w), h, wd))
    for o in range(len(w)):
        for y in range(h):
            for k in range(wd):
                for dy in range(3):
                    for dx in range(3):
                        if 0 <= y + dy - 1 < h and 0 <= k + dx - 1 < wd:
                            out[o, y, k] += sum(w[o, i, dy, dx] * x[i, y + dy - 1, k + dx - 1] for i in range(c))
    return out


def loop_block(x, w, name):
    for place in (0, 3):
        x = loop_convolved(x, w[f"{name}.layers.{place}.weight"])
        each = len(x) // next(g for g in (8, 4, 2, 1) if len(x) % g == 0)
        for a in range(0, len(x), each):
            values = [*x[a : a + each].ravel()]
            mean = sum(values) / len(values)
            var = sum((v - mean) ** 2 for v in values) / len(values)
            x[a : a + each] = (x[a : a + each] - mean) / math.sqrt(var + 1e-5)
        x = x * w[f"{name}.layers.{place + 1}.weight"][:, None, None] + w[f"{name}.layers.{place + 1}.bias"][:, None, None]
        x = x / (1 + np.exp(-x))
    return x


def loop_halved(x):
    return np.array([[[max(p[2 * y, 2 * k], p[2 * y, 2 * k + 1], p[2 * y + 1, 2 * k], p[2 * y + 1, 2 * k + 1]) for k in range(p.shape[1] // 2)] for y in range(p.shape[0] // 2)] for p in x])


def loop_grown(x, height, width):
    out = np.zeros((len(x), height, width))
    for y in range(height):
        for k in range(width):
            sy, sx = (max(0.0, (n + 0.5) * old / new - 0.5) for n, old, new in ((y, x.shape[1], height), (k, x.shape[2], width)))
            a, b = int(sy), int(sx)
            c, d = min(a + 1, x.shape[1] - 1), min(b + 1, x.shape[2] - 1)
            top = x[:, a, b] * (1 - sx + b) + x[:, a, d] * (sx - b)
            out[:, y, k] = top * (1 - sy + a) + (x[:, c, b] * (1 - sx + b) + x[:, c, d] * (sx - b)) * (sy - a)
    return out


def loop_forward(x, w):
    one = loop_block(x, w, "enc1")
    two = loop_block(loop_halved(one), w, "enc2")
    three = loop_block(loop_halved(two), w, "enc3")
    up = loop_block(loop_halved(three), w, "bottleneck")
    for name, beside in (("up3", three), ("up2", two), ("up1", one)):
        up = loop_block(np.concatenate([loop_grown(up, *beside.shape[1:]), beside]), w, f"{name}.conv")
    return np.einsum("oc,chw->ohw", w["out.weight"][:, :, 0, 0], up) + w["out.bias"][:, None, None]


def network(base, seed):
    """Seeded, its scales and shifts moved off 1 and 0."""
    rng = np.random.default_rng(seed)
    return {k: v + (0.2 * rng.standard_normal(v.shape)).astype(np.float32) * (v.ndim == 1) for k, v in N.seeded_weights(base, 4, seed).items()}


@pytest.mark.parametrize(("base", "height", "width"), [(2, 8, 8), (1, 13, 11), (3, 9, 16)])
def test_forward_against_loops(monkeypatch, base, height, width):
    x, w = RNG.standard_normal((3, height, width)), {k: v.astype(float) for k, v in network(base, base).items()}
    want = loop_forward(x, w)
    assert np.allclose(N.forward(x, w), want, atol=1e-9)
    monkeypatch.setattr(N, "STRIP", 3)
    assert np.allclose(N.forward(x, w), want, atol=1e-9)


def test_peaks_equal_those_of_pixel_rows(spark):
    pictures = [(k, 31, 23, RNG.integers(0, 256, (23, 31)).astype(np.uint8).tobytes()) for k in range(4)]
    df = spark.createDataFrame([*pictures, (4, 31, 23, None), (5, 3, 3, b"ab")], "image_id long, width int, height int, gray binary")
    w = network(2, 5)
    limits = {"page": 0.55, "marker": 0.5, "bubble": 0.45, "radius": 2, "most": 5}
    got = {r.image_id: r for r in N.predict_layout(df.repartition(3), w, 16, 12, **limits).collect()}
    assert len(got) == 6 and all(got[k].n_markers == 0 and got[k].bubbles == [] and got[k].page is None for k in (4, 5))
    heat = []
    for k, width, height, gray in pictures:
        maps = N.probabilities(np.frombuffer(gray, np.uint8).reshape(height, width), w, 16, 12)
        heat += [(k, c, y, x, float(m[y, x])) for c, m in zip(N.CHANNELS, maps, strict=True) for y in range(12) for x in range(16)]
    rows = spark.createDataFrame(heat, "image_id long, channel string, y int, x int, p double")
    want = Y.layout_predictions(rows, 31 / 16, 23 / 12, **limits).collect()
    assert len(want) == 4 and sum(r.n_markers + r.n_bubbles for r in want) > 8
    for r in want:
        own = got[r.image_id]
        assert (own.n_markers, own.n_bubbles) == (r.n_markers, r.n_bubbles)
        for a, b in zip([*own.markers, *own.bubbles], [*r.markers, *r.bubbles], strict=True):
            assert (a["rank"], a.model_x, a.model_y) == (b["rank"], b.model_x, b.model_y)
            assert (a.x, a.y) == (b.x, b.y) and abs(a.score - b.score) < 2e-6
        assert own.page == r.page


def test_weights_come_from_a_file(spark, tmp_path):
    w = network(2, 8)
    np.savez(tmp_path / "w.npz", **w)
    read = N.read_weights(spark, str(tmp_path / "w.npz"))
    assert all(np.array_equal(read[k], v) for k, v in w.items()) and len(read) == len(w)
    with pytest.raises(ValueError, match="one network"):
        N.checked({**w, "enc2.layers.0.weight": np.zeros((1, 1, 3, 3))})
    with pytest.raises(ValueError, match="one network"):
        N.checked({k: v for k, v in w.items() if k != "up1.conv.layers.4.bias"})
    with pytest.raises(ValueError, match="out.weight"):
        N.checked({})


# -- epochs -----------------------------------------------------------------------------------

CLASSES = ["a", "b", "c"]


def labelled(n=300):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(n):
        c = int(rng.integers(3))
        x = rng.normal(size=2) + np.array([[0, 0], [3, 0], [0, 3]])[c]
        rows.append((k, CLASSES[c], 1.0 / (c + 1), "val" if k % 5 == 0 else "train", float(x[0]), float(x[1])))
    return rows


SCHEMA = "image_id long, gt_label string, weight double, split string, u double, v double"


def loop_train(rows, epochs, rate, least, decay):
    x, m, s, out = np.zeros((3, 3)), np.zeros((3, 3)), np.zeros((3, 3)), []

    def sums(split):
        slope, loss, weight, right, n = np.zeros((3, 3)), 0.0, 0.0, 0, 0
        for _, c, w, own, u, v in rows:
            if own == split:
                e = np.exp(x @ [u, v, 1.0])
                p, k = e / e.sum(), CLASSES.index(c)
                slope += w * np.outer(p - np.eye(3)[k], [u, v, 1.0])
                loss, weight, right, n = loss - w * math.log(p[k]), weight + w, right + (int(p.argmax()) == k), n + 1
        return slope / weight, loss / weight, right / n

    for t in range(1, epochs + 1):
        now = least + (rate - least) * (1 + math.cos(math.pi * (t - 1) / epochs)) / 2
        slope, loss, right = sums("train")
        m, s = 0.9 * m + 0.1 * slope, 0.999 * s + 0.001 * slope**2
        x = x * (1 - now * decay) - now * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        out.append((now, loss, right, *sums("val")[1:]))
    return out


def test_epochs_against_a_loop_whatever_the_partitions(spark):
    rows = labelled()
    nothing = [(900, "d", 1.0, "train", 0.0, 0.0), (901, "a", None, "train", 0.0, 0.0), (902, "a", -1.0, "val", 0.0, 0.0), (903, None, 1.0, "train", 0.0, 0.0),
               (904, "b", 1.0, "train", None, 0.0), (905, "b", 1.0, "train", math.nan, 0.0), (906, "b", 1.0, "val", math.inf, 0.0), (907, "c", 1.0, "test", 0.0, 0.0)]
    df = spark.createDataFrame(rows + nothing, SCHEMA)
    options = {"epochs": 4, "rate": 0.2, "least_rate": 0.01, "decay": 0.02}
    found = E.train(df.repartition(8), ["u", "v"], CLASSES, **options)
    want = loop_train(rows, 4, 0.2, 0.01, 0.02)
    assert np.allclose([[*h.values()][1:] for h in found.history], want, atol=1e-8)
    best = max(range(4), key=lambda k: (want[k][4], -k)) + 1
    assert found.epoch == best and want[best - 1][4] > 0.8
    again = E.train(df.coalesce(1), ["u", "v"], CLASSES, **options)
    assert again.epoch == found.epoch and np.allclose(again.weights, found.weights, atol=1e-10)
    few = [E.train(df.repartition(p), ["u", "v"], CLASSES, epochs=2, steps=3, rate=0.2) for p in (1, 5)]
    assert np.allclose(few[0].weights, few[1].weights, atol=1e-10) and few[0].history[1]["train_loss"] < few[0].history[0]["train_loss"]
    scored = df.where("image_id < 300").withColumn("s", H.score_batches(["u", "v"], found.scorer)).withColumns(H.prediction(F.col("s"), CLASSES))
    right = scored.where("split = 'val' and pred_label = gt_label").count() / scored.where("split = 'val'").count()
    assert abs(right - want[best - 1][4]) < 1e-9


def test_epochs_without_rows(spark):
    df = spark.createDataFrame(labelled(40), SCHEMA)
    with pytest.raises(ValueError, match="no rows"):
        E.train(df.where("split = 'val'"), ["u", "v"], CLASSES, epochs=1)
    alone = E.train(df.where("split = 'train'"), ["u", "v"], CLASSES, epochs=2)
    assert alone.history[0]["val_loss"] is None and alone.epoch in (1, 2)
