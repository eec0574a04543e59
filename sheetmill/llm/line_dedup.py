"""Line deduplication by a deletion-neighbourhood join.

Two lines count as the same when their trimmed texts are equal or, from ``MIN_CHARS`` code points
on, one edit apart; of such lines the earliest by (doc_id, line number) stays.  Each distinct line
would emit itself and all its single deletions as hashed keys.  Lines one edit apart also agree on
one half (before or behind the edit), so only lines whose half, taken with the length, occurs in
another distinct line go on to emit their neighbourhood; that filter loses no pair.  Keys carry the
length and the deleted position, so that the earliest line of a key is the one partner to
verify, and groups are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, small_batches

MIN_CHARS = 12
#: Wanted lines (id and line number: about 16 bytes each) up to which they are broadcast to the
#: texts; beyond it texts and lines are shuffled by document.
BROADCAST_LINES = 1 << 20
_ROW = "__row"
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))


def within_one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def _halves(line: str, n: int) -> tuple[int, int]:
    """Keys of the first and last part as in a line of n code points and one of as many or one more."""
    h = n // 2
    return xxhash.xxh3_64_intdigest(line[:h].encode(), 2 * n), xxhash.xxh3_64_intdigest(line[len(line) - (n - h) :].encode(), 2 * n + 1)


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, number, high, low, keys = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for j, line in enumerate((text or "").split("\n")):
                    line = line.strip()
                    if not line:
                        continue
                    row.append(i)
                    number.append(j)
                    digest = xxhash.xxh3_128_intdigest(line.encode())
                    high.append(digest >> 64)
                    low.append(digest & 0xFFFFFFFFFFFFFFFF)
                    n = len(line)
                    keys += (*_halves(line, n), *_halves(line, n - 1)) if n >= min_chars else (0, 0, 0, 0)
            if not row:
                continue
            four = np.array(keys, np.uint64).view(np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    pa.array(number, pa.int32()),
                    pa.array(np.array(high, np.uint64).view(np.int64)),
                    pa.array(np.array(low, np.uint64).view(np.int64)),
                    *[pa.array(np.ascontiguousarray(four[:, k])) for k in range(4)],
                ],
                names=["doc_id", "line", "high", "low", "k0", "k1", "k2", "k3"],
            )

    return run


#: What a line emits: deletions from its second half, from its first half, itself, and deletions
#: that a shorter line may equal.
SECOND, FIRST, WHOLE, SHORTER = 1, 2, 4, 8


def neighbourhood(line: str, emit: int = SECOND | FIRST | WHOLE | SHORTER) -> tuple[np.ndarray, np.ndarray]:
    """Hashed keys of a line and its single deletions, and their kinds: 0 a deletion with its
    position (lines of equal length that differ there share it), 1 a deletion as a shorter line,
    2 the line itself (which 1 of a longer line meets)."""
    points = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64)
    n = len(points)
    mixed = (points + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE, np.uint64))), dtype=np.uint64)
    before = np.concatenate(([np.uint64(0)], np.cumsum(mixed * powers[:-1], dtype=np.uint64)))
    less = before[:-1] + (before[-1] - before[1:]) * _BACK

    def keyed(value: np.ndarray, length: int, position: np.ndarray | int) -> np.ndarray:
        x = value ^ (np.asarray(position + 2).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)) ^ np.uint64(length * 0x9FB21C651E98DF25 % (1 << 64))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    at = np.arange(n if emit & SECOND else n // 2)[0 if emit & FIRST else n // 2 :]
    equal = keyed(less[at], n, at) if emit & (SECOND | FIRST) else at[:0].astype(np.uint64)
    shorter = np.unique(keyed(less, n - 1, -1)) if emit & SHORTER else equal[:0]
    whole = keyed(before[-1:], n, -1) if emit & WHOLE else equal[:0]
    kinds = np.repeat(np.array([0, 1, 2], np.int8), [len(equal), len(shorter), len(whole)])
    return np.concatenate((equal, shorter, whole)).view(np.int64), kinds


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        keys, kinds, row, number = [], [], [], []
        for i, (text, wanted) in enumerate(zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True)):
            lines = (text or "").split("\n")
            for j, emit in sorted({(w["line"], w["emit"]) for w in wanted}):
                if j < len(lines):
                    found = neighbourhood(lines[j].strip(), emit)
                    keys.append(found[0])
                    kinds.append(found[1])
                    row.append(np.full(len(found[0]), i))
                    number.append(np.full(len(found[0]), j, np.int32))
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.concatenate(kinds)), batch.column("doc_id").take(pa.array(np.concatenate(row))), pa.array(np.concatenate(number))],
                names=["key", "kind", "doc_id", "line"],
            )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = [
            (i, j, lines[j].strip())
            for i, (text, numbers) in enumerate(zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True))
            for lines in [(text or "").split("\n")]
            for j in numbers
            if j < len(lines)
        ]
        if rows:
            at, number, found = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(number, pa.int32()), pa.array(found)], names=["doc_id", "line", "found"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = [within_one_edit(a, b) for a, b in zip(batch.column("left").to_pylist(), batch.column("found").to_pylist(), strict=True)]
        yield batch.select(["doc_id", "line"]).filter(pa.array(near, pa.bool_()))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts, counts, gone = [], [], []
        for text, kept in zip(batch.column("text").to_pylist(), batch.column("kept").to_pylist(), strict=True):
            if text is None:
                texts.append(None)
                counts.append(0)
                gone.append(0)
                continue
            lines, kept = text.split("\n"), set(kept or ())
            stay = [x for j, x in enumerate(lines) if j in kept or not x.strip()]
            texts.append("\n".join(stay))
            counts.append(len(lines))
            gone.append(len(lines) - len(stay))
        columns = [pa.array(texts, pa.string()) if name == "text" else c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "kept"]
        names = [name for name in batch.schema.names if name != "kept"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "n_lines", "n_removed"])


def near_partners(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """``doc_id, line`` of the distinct lines that have an earlier line one edit away.

    ``firsts``: ``doc_id, line, low, k0..k3`` of each distinct line's first occurrence."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    halves = firsts.where("k0 != 0").select("doc_id", "line", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("side", "half"))
    # Cut before it is joined back, so that a frequent half is split over tasks.
    shared = cut(
        halves.groupBy("half")
        .agg(F.count(F.when(F.col("side") < 2, 1)).alias("own"), F.count(F.when(F.col("side") > 1, 1)).alias("longer"))
        .where("own > 1 or (own = 1 and longer > 0)")
    )
    part = F.when(F.col("side") > 1, F.lit(SHORTER)).otherwise(
        F.when(F.col("own") > 1, F.when(F.col("side") == 0, F.lit(SECOND)).otherwise(F.lit(FIRST))).otherwise(F.lit(0))
        .bitwiseOR(F.when(F.col("longer") > 0, F.lit(WHOLE)).otherwise(F.lit(0)))
    )
    wanted = cut(
        halves.join(shared, "half")
        .groupBy("doc_id", "line")
        .agg(F.bit_or(part).alias("emit"))
        .groupBy(F.col("doc_id").alias("w_id"))
        .agg(F.collect_list(F.struct("line", "emit")).alias("wanted"))
    )
    texts = docs.select("doc_id", "text")

    def pick(wanted: DataFrame, make, schema: str) -> DataFrame:
        """What ``make`` finds in the wanted lines of the texts; few lines go to the texts, not
        the texts to the lines."""
        few = (wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= BROADCAST_LINES
        wanted = F.broadcast(wanted) if few else wanted
        return texts.join(wanted, F.col("doc_id") == F.col("w_id")).select("doc_id", "text", "wanted").mapInArrow(make, schema)

    variants = pick(wanted, _variants, f"key long, kind byte, doc_id {kind}, line int").withColumn("at", F.struct("doc_id", "line"))
    groups = (
        variants.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(F.col("kind") == 0, F.col("at"))).alias("equal"),
            F.min(F.when(F.col("kind") == 1, F.col("at"))).alias("longer"),
            F.min(F.when(F.col("kind") == 2, F.col("at"))).alias("whole"),
        )
        .where("n > 1")
        .drop("n")
    )
    other = F.when(F.col("kind") == 0, F.col("equal")).when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("longer"))
    pairs = cut(
        variants.join(groups, "key")
        .withColumn("other", other)
        .where(F.col("other") < F.col("at"))
        .groupBy("doc_id", "line")
        .agg(F.collect_set("other").alias("others"))
        .select("doc_id", "line", F.explode("others").alias("other"))
        .select("doc_id", "line", F.col("other.doc_id").alias("o_id"), F.col("other.line").alias("o_line"))
    )
    named = pairs.select("doc_id", "line").union(pairs.select("o_id", "o_line")).distinct()
    named = cut(named.groupBy(F.col("doc_id").alias("w_id")).agg(F.collect_list("line").alias("wanted")))
    found = pick(named, _texts, f"doc_id {kind}, line int, found string").distinct()
    found = cut(found.select(F.col("doc_id").alias("f_id"), F.col("line").alias("f_line"), "found"))
    both = (
        pairs.join(found, (F.col("doc_id") == F.col("f_id")) & (F.col("line") == F.col("f_line")))
        .select("doc_id", "line", "o_id", "o_line", F.col("found").alias("left"))
        .join(found, (F.col("o_id") == F.col("f_id")) & (F.col("o_line") == F.col("f_line")))
    )
    return both.select("doc_id", "line", "left", "found").mapInArrow(_verify, f"doc_id {kind}, line int").distinct()


def dedup_lines(docs: DataFrame, *, max_edits: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, and ``n_lines``, ``n_removed``.

    A line is removed if an earlier one, by (doc_id, line number), is equal or (``max_edits`` 1,
    at least ``min_chars`` code points) one edit away, whether or not that one stays itself.  Lines
    are compared without surrounding white space; blank lines always stay and match nothing.  A
    null text stays null with no lines; rows that share a doc_id but not the text follow each other by
    the text's hash, and exact repeats of a row count as one document and keep the same lines; a null id
    is earlier than any other; an empty table gives an empty result; columns named ``n_lines`` or
    ``n_removed`` are replaced.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    docs = small_batches(docs).drop("n_lines", "n_removed")
    # A row's name inside: its id, then its text's hash, in that order.
    named = docs.withColumn(_ROW, F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")))
    rows = named.select(F.col(_ROW).alias("doc_id"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    lines = rows.mapInArrow(
        _lines(min_chars), f"doc_id {kind}, line int, high long, low long, k0 long, k1 long, k2 long, k3 long"
    )
    firsts = cut(
        lines.groupBy("high", "low")
        .agg(F.min(F.struct("doc_id", "line")).alias("at"), *[F.max(f"k{k}").alias(f"k{k}") for k in range(4)])
        .select("at.doc_id", "at.line", "low", "k0", "k1", "k2", "k3")
    )
    kept = firsts.select("doc_id", "line")
    if max_edits:
        gone = near_partners(rows, firsts).select(F.col("doc_id").alias("g_id"), F.col("line").alias("g_line"))
        kept = kept.join(gone, (F.col("doc_id") == F.col("g_id")) & (F.col("line") == F.col("g_line")), "left_anti")
    lists = kept.groupBy(F.col("doc_id").alias("k_id")).agg(F.collect_list("line").alias("kept"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return (
        named.join(lists, F.col(_ROW) == F.col("k_id"), "left")
        .drop("k_id", _ROW)
        .mapInArrow(_apply, f"{fields}, n_lines long, n_removed long")
    )
