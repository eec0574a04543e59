"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and everything but letters becomes a space.  The n-grams of one to three
code points are hashed into 2 ** 15 features.  Feature counts by language are summed in Spark and
the log-probability matrix (languages x 2 ** 15 floats at most, whatever the number of documents) is broadcast; a batch of
documents is scored by gathering the matrix's columns at the batch's features and summing them by
document.  The matrix goes out in blocks of languages, sparse where a block has seen few features, so that
thousands of labels with little text take little room.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

FEATURES = 1 << 15
ORDERS = 3
UNKNOWN = "und"
#: Labelled documents of each language that the model is fitted on, about: those of lowest hash.
TRAIN_DOCS = 5_000
#: Languages that are scored together.
BLOCK = 64
#: Up to so many labels, their counts (a name and a number each) are broadcast; beyond it Spark chooses the join.
BROADCAST_LANGS = 50_000
#: Counts that a task holds before it merges them, and hands them on where most are different.
HELD = 1 << 21
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 19


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points with all but letters as spaces and a space around each text; the texts' edges;
    whether a text has a letter."""
    lower = [f" {(t or '').lower()} " for t in texts]
    edges = np.concatenate(([0], np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)))))
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    some = np.add.reduceat(letter, edges[:-1], dtype=np.int64) > 0 if len(texts) else np.zeros(0, bool)
    return np.where(letter, points, np.uint32(32)), edges, some


def _features(points: np.ndarray, edges: np.ndarray, begin: int = 0, end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of the texts from ``begin`` to ``end``: where a piece begins, and for each order the features
    of each position; an n-gram that would leave its text gets the feature FEATURES."""
    total = int(edges[-1])
    end_of = np.repeat(edges[1:], np.diff(edges))
    stop = total if end is None else min(total, end)
    for a in range(begin, stop, _CHUNK):
        b = min(stop, a + _CHUNK)
        at = np.arange(a, b)
        state = np.zeros(b - a, np.uint64)
        for order in range(ORDERS):
            inside = at + order < end_of[a:b]
            nxt = points[np.minimum(at + order, total - 1)].astype(np.uint64)
            state = (state + nxt + np.uint64(1)) * _MULTIPLY
            yield a, np.where(inside, (state >> np.uint64(49)).astype(np.int64), FEATURES)


class Model(NamedTuple):
    """Languages by name, their log-priors, each one's log-probability of an unseen feature, and what seen
    features add to it: for each block of ``BLOCK`` languages places (language in the block x (FEATURES + 1)
    + feature) and values, or the whole block where most places are taken."""

    langs: list[str]
    prior: np.ndarray
    unseen: np.ndarray
    blocks: list[tuple[np.ndarray | None, np.ndarray]]

    def block(self, k: int) -> np.ndarray:
        """Log-probabilities of the block's languages (rows) by feature; the last column is zero."""
        places, values = self.blocks[k]
        if places is None:
            return values
        unseen = self.unseen[k * BLOCK : (k + 1) * BLOCK]
        full = np.repeat(unseen.astype(np.float32), FEATURES + 1).reshape(len(unseen), -1)
        full.ravel()[places] += values
        full[:, FEATURES] = 0
        return full


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[str, int] = {}
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in kept])).astype(np.int64)

    def rows() -> pa.RecordBatch:
        keys, counts = merged()
        lang = pa.array(list(names), pa.string()).take(pa.array(keys // (FEATURES + 1)))
        return pa.RecordBatch.from_arrays([lang, pa.array((keys % (FEATURES + 1)).astype(np.int32)), pa.array(counts)], names=["lang", "feature", "n"])

    held = 0
    for batch in slices(batches, "text", 1 << 20):
        points, edges, _ = _code_points(batch.column("text").to_pylist())
        number = np.repeat(np.array([names.setdefault(x, len(names)) for x in batch.column("lang").to_pylist()]), np.diff(edges))
        for a, f in _features(points, edges):
            inside = f < FEATURES
            kept.append(np.unique(number[a : a + len(f)][inside] * (FEATURES + 1) + f[inside], return_counts=True))
            held += len(kept[-1][0])
            if held > HELD:
                kept[:] = [merged()]
                held = len(kept[0][0])
                if held > HELD // 2:
                    yield rows()
                    kept, held = [], 0
    if kept:
        yield rows()


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, most_langs: int | None = None) -> Model:
    """A model of labelled ``doc_id, text, lang`` rows.  Every label is learned, or, given ``most_langs``,
    those with most rows.  Only the model comes to the driver: 8 bytes for each feature that a language
    has shown, at most 256 KB a language; where most are shown, 128 KB stay."""
    labelled = small_batches(docs).where(F.col("lang").isNotNull())
    counted = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    if most_langs is not None:
        counted = counted.orderBy(F.desc("rows"), "lang").limit(most_langs)
    found = counted.toArrow().sort_by("lang")
    langs, sizes = found.column("lang").to_pylist(), found.column("rows").to_numpy()
    if not langs:
        return Model([], np.zeros(0), np.zeros(0), [])
    few = F.broadcast if len(langs) <= BROADCAST_LANGS else (lambda df: df)
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = labelled.where(F.col("text").isNotNull()).join(few(counted), "lang").where(place < F.lit(train_docs) / F.col("rows"))
    counts = (
        chosen.select("text", "lang")
        .mapInArrow(_count, "lang string, feature int, n long")
        .groupBy("lang", "feature")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang")
        .agg(F.sum("n").alias("total"), F.collect_list("feature").alias("features"), F.collect_list(F.ln(F.col("n") / 0.5 + 1).cast("float")).alias("adds"))
    )
    total = np.zeros(len(langs))
    parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(0, len(langs), BLOCK)]
    for row in _arrow_rows(counts.sort("lang")):
        k = bisect_left(langs, row[0])
        total[k] = row[1]
        parts[k // BLOCK].append((row[2].astype(np.int32) + (k % BLOCK) * (FEATURES + 1), row[3]))
    unseen = np.log(0.5) - np.log(total + 0.5 * FEATURES)
    model = Model(langs, np.log(sizes / sizes.sum()), unseen, [])
    for k, part in enumerate(parts):
        places = np.concatenate([p for p, _ in part] or [np.zeros(0, np.int32)])
        model.blocks.append((places, np.concatenate([v for _, v in part] or [np.zeros(0, np.float32)])))
        part.clear()
        if len(places) > FEATURES * len(unseen[k * BLOCK : (k + 1) * BLOCK]) // 2:
            model.blocks[k] = (None, model.block(k))
    return model


def _arrow_rows(counts: DataFrame) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    found = counts.toArrow()
    for batch in found.to_batches():
        for k, (lang, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            yield lang, n, batch.column(2)[k].values.to_numpy(), batch.column(3)[k].values.to_numpy()


def _score(shared: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: Model = shared.value
    langs = known.langs
    only = known.block(0) if len(known.blocks) == 1 else None
    at_once = max(1, (1 << 21) // max(1, len(langs)))
    for whole in slices(batches, "text", 1 << 20):
        for begin in range(0, whole.num_rows, at_once):
            batch = whole.slice(begin, at_once)
            points, edges, some = _code_points(batch.column("text").to_pylist())
            n = batch.num_rows
            total = np.tile(known.prior, (n, 1))
            for a in range(0, int(edges[-1]), _CHUNK):
                pieces = [f for _, f in _features(points, edges, a, a + _CHUNK)]
                first = int(np.searchsorted(edges, a, "right")) - 1
                last = int(np.searchsorted(edges, a + len(pieces[0]), "left"))
                starts = np.maximum(edges[first:last] - a, 0)
                for k in range(len(known.blocks)):
                    log_p = known.block(k) if only is None else only
                    for j, row in enumerate(log_p, k * BLOCK):
                        for f in pieces:
                            total[first:last, j] += np.add.reduceat(row[f], starts, dtype=np.float64)
            if langs:
                best = total.argmax(axis=1)
                total -= total.max(axis=1, keepdims=True)
                sure = 1 / np.exp(total, out=total).sum(axis=1)
                names = np.array(langs, object)[best]
            else:
                sure, names, some = np.zeros(n), np.full(n, UNKNOWN, object), np.zeros(n, bool)
            names[~some] = UNKNOWN
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names.tolist(), pa.string()), pa.array(np.where(some, sure, 0.0))],
                names=[*batch.schema.names, "lang_pred", "score"],
            )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (which has a column ``text``) with ``lang_pred`` and ``score``, the posterior
    probability.  Null texts and texts without a letter: ``und`` with score 0.

    Languages are scored a block at a time, documents so many at a time that their sums stay in 16 MB."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return small_batches(docs).mapInArrow(partial(_score, shared), f"{fields}, lang_pred string, score double")


def held_out(doc_id: F.Column) -> F.Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame, *, train_docs: int = TRAIN_DOCS, most_langs: int | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each document, learned from those not held out.

    Languages are all that labelled rows name (the ``most_langs`` commonest if given); ties go to the first by name; rows that
    repeat are predicted alike; an empty table gives an empty result, and a table without any
    label gives ``und`` throughout; other columns are ignored.
    """
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")).select("doc_id", "text", "lang"), train_docs, most_langs)
    return predict(rows.select("doc_id", "held_out", "text"), model).drop("text")
