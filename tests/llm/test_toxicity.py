"""Toxicity: features and gradients against plain loops, and held-out accuracy."""

import os
import random
import zlib

import numpy as np
import pytest

from sheetmill.llm import toxicity as T

DOCS, LABELS = "doc_id long, text string, lang string, label int, score string", "doc_id long, quality int, toxic int, text string"


def plain_features(text):
    points = [ord(c) for c in " " + "".join(" " if c.isspace() else c for c in (text or "").lower()) + " "]
    out = set()
    for n in T.ORDERS:
        for a in range(len(points) - n + 1):
            state = 0
            for p in points[a : a + n]:
                state = (state + p + 1) * int(T._MULTIPLY) % (1 << 64)
            out.add(state >> 46)
    return sorted(out)


def test_features_whatever_stands_beside_them(monkeypatch):
    texts = ["", None, "a", "Ab\tcd é", "x" * 50, "word " * 30, "\U0001f600 ok", "last one"]
    want = [plain_features(t) for t in texts]
    assert [x.tolist() for x in T.features(texts)] == want
    for chunk in (1, 3, 7, 64):
        monkeypatch.setattr(T, "_CHUNK", chunk)
        assert [x.tolist() for x in T.features(texts)] == want
    assert [*T.features([])] == []


def table(n=240):
    rng = random.Random(3)
    docs = []
    for i in range(n):
        words = ["".join(rng.choice(["ba", "lo", "mi", "tu"]) for _ in range(3)) for _ in range(25)]
        if i % 4 == 0:
            words[rng.randrange(25)] = rng.choice(["Nitwit", "dunce"])
        docs.append((i, " ".join(words), int(i % 4 == 0)))
    return docs


def test_held_out_and_edges(spark):
    rows = table()
    docs = spark.createDataFrame([(i, t, "x", 9, "s") for i, t, _ in rows] + [(900, None, None, 0, ""), (901, "", "", 0, ""), (None, "a dunce", "", 0, ""), (902, "balo dunce " * 50_000, "", 0, ""), (0, rows[0][1], "", 0, "")], DOCS)
    marks = [(i, 1, y, "t") for i, _, y in rows] + [(5, 1, None, ""), (6, 0, 7, ""), (9999, 1, 1, ""), (None, 1, 1, ""), (0, 1, 0, "")]
    got = T.score_toxicity(docs, spark.createDataFrame(marks, LABELS)).collect()
    assert len(got) == docs.count() and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert all(by[i].predicted == y for i, _, y in rows)
    assert by[900].score == by[901].score < 0.5 and by[None].predicted == 1 and by[902].predicted == 1
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    # Labels of held-out documents teach nothing, and a bounded sample does as well.
    other = [(i, q, 1 - y if by[i].held_out else y, t) for i, q, y, t in marks[: len(rows)]]
    again = {r.doc_id: r.score for r in T.score_toxicity(docs, spark.createDataFrame(other + marks[len(rows) :], LABELS)).collect()}
    assert again == {i: r.score for i, r in by.items()}
    few = T.score_toxicity(docs, spark.createDataFrame(marks, LABELS), train_docs=40).collect()
    assert np.mean([r.predicted == rows[r.doc_id][2] for r in few if r.doc_id is not None and r.doc_id < len(rows)]) > 0.9


def test_descent_reaches_the_minimum():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(80, 5)), rng.integers(0, 2, 80)

    def loss(w):
        z = x @ w
        return float(np.logaddexp(0, np.where(y == 1, -z, z)).sum() + w @ w / 2), x.T @ (1 / (1 + np.exp(-z)) - y) + w

    w = T._descend(np.zeros(5), loss, 60)
    assert np.abs(loss(w)[1]).max() < 0.05


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "", 0, ""), (2, None, "", 0, "")], DOCS)
    assert [r.score for r in T.score_toxicity(docs, spark.createDataFrame([], LABELS)).collect()] == [0.5, 0.5]
    assert T.score_toxicity(docs.limit(0), spark.createDataFrame([(1, 1, 1, "")], LABELS)).collect() == []
    taught = next(i for i in range(1, 9) if zlib.crc32(str(i).encode()) % 5)
    one = T.score_toxicity(spark.createDataFrame([(taught, "a", "", 0, "")], DOCS), spark.createDataFrame([(taught, 1, 1, "")], LABELS)).collect()
    assert one[0].score > 0.5


def test_held_out_accuracy_on_the_test_tables(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.exists(f"{folder}/labels.parquet"):
        pytest.skip("no test tables")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = T.score_toxicity(spark.read.parquet(f"{folder}/documents.parquet"), labels).where("held_out")
    rows = scored.join(labels.select("doc_id", "toxic"), "doc_id").collect()
    y, p, s = (np.array([r[c] for r in rows]) for c in ("toxic", "predicted", "score"))
    order = np.argsort(np.argsort(s))
    area = (order[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    print("area", area, "caught", p[y == 1].mean(), "left alone", 1 - p[y == 0].mean(), len(y))
    assert area > 0.8 and p[y == 0].mean() < 0.1


def test_packed_features_come_back():
    rng = np.random.default_rng(5)
    wide = T._WIDEST
    for found in ([], [0], [wide - 1], [wide], [wide + 1], [0, 3 * wide], [2 * wide, 4 * wide - 1, T.FEATURES - 1], np.sort(rng.choice(T.FEATURES, 5000, replace=False))):
        found = np.array(found, np.int32)
        assert T.unpacked(T.packed(found)).tolist() == found.tolist()
    assert len(T.packed(np.arange(1000, dtype=np.int32))) == 2000
