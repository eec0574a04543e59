"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams of three to five code points that it holds, once each.  From
labelled texts come each feature's log-count ratio (how much more of the toxic texts' features it is than
of the others') and, with features scaled by it, the weights of a logistic regression.  Both are fitted by
sums over a stored table of features: each round of the descent broadcasts the weights and adds up one
gradient a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, scratch_dir, slices, small_batches

FEATURES = 1 << 18
ORDERS = (3, 4, 5)
#: Labelled documents of each label that the model is fitted on, about: those of lowest hash.
TRAIN_DOCS = 10_000
#: Tasks that add up gradients at most, however many files the table has, and so gradients that come to the
#: driver in a round.
TASKS = 6
ROUNDS = 30
RIDGE = 1.0
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 18


def features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The features of each text, ascending: those of its n-grams, lower-cased, white space as spaces."""
    lower = [" " + (t or "").lower().translate(_SPACES) + " " for t in texts]
    edges = np.cumsum([0, *map(len, lower)])
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4")
    seen = np.zeros(FEATURES + 1, bool)  # the last one is for n-grams that would leave their text
    text, total = 0, len(points)
    for a in range(0, total, _CHUNK):
        b = min(total, a + _CHUNK)
        wide = points[a : min(total, b + ORDERS[-1])].astype(np.uint64) + np.uint64(1)
        wide = np.concatenate([wide, np.zeros(b - a + ORDERS[-1] - len(wide), np.uint64)])
        left = np.repeat(edges[1:], np.diff(edges))[a:b] - np.arange(a, b)
        state, found = np.zeros(b - a, np.uint64), np.empty((len(ORDERS), b - a), np.int32)
        for order in range(1, ORDERS[-1] + 1):
            state = (state + wide[order - 1 : order - 1 + b - a]) * _MULTIPLY
            if order in ORDERS:
                found[ORDERS.index(order)] = np.where(left >= order, (state >> np.uint64(46)).astype(np.int32), FEATURES)
        while text < len(lower) and edges[text] < b:
            seen[found[:, max(0, edges[text] - a) : edges[text + 1] - a]] = True
            if edges[text + 1] > b:
                break
            here = np.flatnonzero(seen[:-1]).astype(np.int32)
            seen[:] = False
            text += 1
            yield here


_SPACES = {i: " " for i in (*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}


_WIDEST = 0xFFFF


def packed(found: np.ndarray) -> bytes:
    """Ascending features as gaps of 16 bits; the widest gap stands for a step without a feature."""
    gaps = np.diff(found, prepend=0)
    steps = gaps // _WIDEST
    out = np.full(len(gaps) + int(steps.sum()), _WIDEST, np.uint16)
    out[np.arange(len(gaps)) + np.cumsum(steps)] = gaps % _WIDEST
    return out.tobytes()


def unpacked(stored: bytes) -> np.ndarray:
    gaps = np.frombuffer(stored, np.uint16)
    return np.cumsum(gaps, dtype=np.int32)[gaps != _WIDEST]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        found = [packed(x) for x in features(batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.binary())], names=["label", "features"])


def _share(n: int, most: int) -> float:
    return min(1.0, most / n) if n else 1.0


def sample(docs: DataFrame, labels: DataFrame, train_docs: int) -> tuple[DataFrame, dict[int, float]]:
    """``label, doc_id, text`` of about ``train_docs`` documents a label, and the weight of one of each.  An id labelled
    twice counts as toxic if one of its rows does; a document that repeats with its text counts once."""
    place = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 20)) / F.lit(float(1 << 20))
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("label"))
    n = dict(marks.groupBy("label").count().collect())
    marks = cut(marks.where(place(F.col("label_id").cast("string")) < F.when(F.col("label") == 1, _share(n.get(1, 0), train_docs)).otherwise(_share(n.get(0, 0), train_docs))))
    # About 2 * train_docs ids at most, whatever the input.
    few = marks.count() <= 4 * train_docs
    marked = docs.join(F.broadcast(marks) if few else marks, F.col("doc_id") == F.col("label_id"))
    rows = dict(marked.groupBy("label").count().collect())
    share = {k: _share(rows.get(k, 0), 2 * train_docs) for k in (0, 1)}  # below 1 only where ids repeat
    chosen = marked.where(place(F.col("doc_id").cast("string"), "text") < F.when(F.col("label") == 1, share[1]).otherwise(share[0]))
    chosen = chosen.dropDuplicates(["doc_id", "text"]).select("label", "doc_id", "text")
    return chosen, {k: 1 / _share(n.get(k, 0), train_docs) / share[k] for k in (0, 1)}


def _descend(start: np.ndarray, loss: Callable[[np.ndarray], tuple[float, np.ndarray]], rounds: int, memory: int = 5) -> np.ndarray:
    """Limited-memory quasi-Newton descent; ``loss`` gives value and gradient, and is called ``rounds`` times at most."""
    x, (value, slope) = start, loss(start)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    step = 1.0 / max(1.0, float(np.linalg.norm(slope)))
    for _ in range(rounds - 1):
        way, used = slope.copy(), []
        for s, y, rho in reversed(moves):
            used.append(rho * float(s @ way))
            way -= used[-1] * y
        if moves:
            s, y, rho = moves[-1]
            way /= rho * float(y @ y)
        for (s, y, rho), a in zip(moves, reversed(used), strict=True):
            way += (a - rho * float(y @ way)) * s
        there = x - step * way
        value_there, slope_there = loss(there)
        if not value_there <= value - 1e-4 * step * float(way @ slope):
            step /= 4
            if step < 1e-6:
                break
            continue
        move, turn = there - x, slope_there - slope
        if float(move @ turn) > 1e-12:
            moves = [*moves[1 - memory :], (move, turn, 1 / float(move @ turn))]
        done = value - value_there < 1e-6 * abs(value)
        x, value, slope, step = there, value_there, slope_there, 1.0
        if done:
            break
    return x


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, float]:
    """The weight of each feature and the intercept.  Without labels of both kinds: all zero, but for the intercept."""
    spark = docs.sparkSession
    chosen, weight = sample(docs, labels, train_docs)
    folder = scratch_dir(spark, "toxicity")
    # Texts are dealt, not their features, which are several times as large; by their ids too, so that copies part.
    dealt = small_batches(chosen).repartition(TASKS, F.xxhash64("doc_id", "text")).sortWithinPartitions("label", F.xxhash64("doc_id", "text"))
    dealt.mapInArrow(_featured, "label int, features binary").write.parquet(f"{folder}/features")
    table = spark.read.schema("label int, features binary").parquet(f"{folder}/features")

    def sums(weights: np.ndarray | None, intercept: float = 0.0) -> np.ndarray:
        """Without weights: the documents of each label that hold a feature, and all.  With them: the gradient
        of the loss by feature, by the intercept, and the loss."""
        shared = spark.sparkContext.broadcast(weights)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = shared.value
            total = np.zeros((2, FEATURES + 2))
            for batch in batches:
                for part in slices([batch], "features", 4 << 20):
                    label = part.column("label").to_numpy()
                    each = [unpacked(x) for x in part.column("features").to_pylist()]
                    held, sizes = np.concatenate(each), np.array([len(x) for x in each])
                    one = np.where(label == 1, weight[1], weight[0])
                    if w is None:
                        for k in (0, 1):
                            total[k, :FEATURES] += np.bincount(held[np.repeat(label == k, sizes)], minlength=FEATURES)
                            total[k, FEATURES] += (label == k).sum()
                        continue
                    z = np.bincount(np.repeat(np.arange(len(each)), sizes), w[held], len(each)) + intercept
                    off = one * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label)
                    total[0, :FEATURES] += np.bincount(held, np.repeat(off, sizes), FEATURES)
                    total[0, FEATURES] += off.sum()
                    total[0, FEATURES + 1] += (one * np.logaddexp(0, np.where(label == 1, -z, z))).sum()
            if total.any():  # summed in double, sent in single precision, the loss apart
                kept = (total if w is None else total[:1]).astype(np.float32)
                yield pa.RecordBatch.from_pydict({"part": [kept.tobytes()], "loss": [float(total[0, FEATURES + 1])]}, pa.schema([("part", pa.binary()), ("loss", pa.float64())]))

        whole = np.zeros((2 if weights is None else 1, FEATURES + 2))
        losses = 0.0
        for r in table.coalesce(TASKS).mapInArrow(add, "part binary, loss double").collect():
            whole += np.frombuffer(r["part"], np.float32).reshape(whole.shape)
            losses += r["loss"]
        whole[0, FEATURES + 1] = losses
        shared.destroy()
        return whole

    counts = sums(None)
    n = [counts[k, FEATURES] * weight[k] for k in (0, 1)]
    if not n[0] or not n[1]:
        forget(spark, folder)
        return np.zeros(FEATURES), float(np.log((n[1] + 1) / (n[0] + 1)))
    q, p = counts[:, :FEATURES] + 1.0
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[(counts[:, :FEATURES].sum(axis=0)) == 0] = 0.0

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        got = sums(ratio * x[:-1], float(x[-1]))[0]
        return got[-1] + RIDGE / 2 * float(x[:-1] @ x[:-1]), np.append(ratio * got[:FEATURES] + RIDGE * x[:-1], got[FEATURES])

    x = _descend(np.append(np.zeros(FEATURES), np.log(n[1] / n[0])), loss, ROUNDS)
    forget(spark, folder)
    return ratio * x[:-1], float(x[-1])


def predict(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` (which has a column ``text``) with ``score``, the model's probability of label 1, instead of its text."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    kept = [f for f in docs.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = shared.value
        for batch in slices(batches, "text", 1 << 20):
            z = np.array([weights[x].sum(dtype=np.float64) for x in features(batch.column("text").to_pylist())]) + intercept
            score = np.round(1 / (1 + np.exp(-np.clip(z, -500, 500))), 6)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(score)], names=[*(f.name for f in kept), "score"])

    return small_batches(docs).mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double"]))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score_toxicity(docs: DataFrame, labels: DataFrame, *, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each document, learned from the labels of ids not held out.

    Null and empty texts have no n-gram but the intercept's score; rows that repeat are scored alike; labels
    other than 0 and 1 teach nothing, nor do labels of ids without a document; without labels of both kinds
    the score is that of the kind there is, 0.5 without any; an empty table gives an empty result; other
    columns are ignored.
    """
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    taught = labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    scored = predict(rows, fit(rows.select("doc_id", "text"), taught, train_docs))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
