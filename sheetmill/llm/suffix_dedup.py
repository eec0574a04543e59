"""Removal of long repeated substrings by suffix arrays built in two stages.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else, too.  Where such
a string repeats, so does an anchor inside it: of each window of substring hashes the smallest
(the last of equals), which depends on the window's bytes alone.  So a start belongs to the anchor of its
own first window, and equal strings belong to equal anchors at equal distances.

1. Each anchor has a stretch: the text that its starts cover.  One pass emits the stretches' digests;
   anchors are counted, and starts whose anchor occurs once are done: nothing equals them.
2. Stretches of one digest are copies, however many: two of them stand for all.  Neighbouring ones with the
   same two places join to runs, and both places' bytes go to one suffix array.
3. Where an anchor has different stretches, one of each goes, with its bytes, to the array of that
   anchor.  Where an anchor has very many different stretches, they are first
   split by their starts' distance to it and by the bytes that all starts of such a part cover, which equal
   strings share, so that what they share collapses again.  Where too many different parts still agree
   in those, they are split into narrower ones, down to single starts, whose parts are all equal.
4. Suffix arrays are built in two stages: suffixes smaller than their successors are sorted directly, the
   others are induced by scanning the buckets; adjacent common prefixes of ``length`` mark repeats.
5. The marked starts go back to their documents, whose bytes are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forget, scratch_dir, slices, small_batches, utf8_buffer

LENGTH = 400
#: Bytes of a hashed substring; a window holds LENGTH - GRAM + 1 of them.
GRAM = 160
#: Different stretches of an anchor from which they are split by distance, and different parts of a key from
#: which those are split further; starts of a part, and by what the next narrower ones are smaller.
HOT, PART, NARROWER = 2_000, 64, 4
#: Text of a suffix array that one call builds, about, and starts whose anchors are found at once.
ARRAY_BYTES, CHUNK = 1 << 18, 1 << 18
#: Starts of a run of copies at most, about, and bytes of parts that one task compares, about.
RUN, TASK_BYTES = 1 << 16, 16 << 20
_BASE = 0x9E3779B97F4A7C15
_NONE = ~np.uint64(0)


# -- suffix array -----------------------------------------------------------------------------


def direct_sort(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions ordered by their suffixes' first ``depth`` symbols.

    Sixteen symbols sort as two numbers.  Those that agree so far and have the same hash of ``depth``
    symbols are left in any order; other groups are sorted by their bytes."""
    n = len(text)
    if not len(at):
        return at
    padded = np.concatenate((text, np.zeros(16, np.uint8)))
    words = np.ndarray((n + 9,), ">u8", padded.tobytes(), strides=(1,))
    first, second = words[at].astype(np.uint64), words[np.minimum(at + 8, n + 8)].astype(np.uint64)
    order = np.lexsort((second, first))
    at, first, second = at[order], first[order], second[order]
    new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
    begin = np.flatnonzero(new)
    size = np.diff(np.concatenate((begin, [len(at)])))
    deep = np.zeros(n, np.uint64)
    hashes = _gram_hashes(text, depth)
    deep[: len(hashes)] = hashes
    deep = deep[at]
    same = (np.minimum.reduceat(deep, begin) == np.maximum.reduceat(deep, begin)) & (deep[begin] != 0)
    raw = text.tobytes()
    for k in np.flatnonzero((size > 1) & ~same).tolist():
        a, b = begin[k], begin[k] + size[k]
        at[a:b] = sorted(at[a:b].tolist(), key=lambda i: raw[i : i + depth])
    return at


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All positions of ``text`` (uint8), ordered by at least ``depth`` symbols of their suffixes.

    Stage one sorts the suffixes smaller than their successors.  Stage two scans the buckets of first
    symbols upwards: each placed suffix places its predecessor, if that one is larger than its
    successor, next in the bucket of its own first symbol.  Within a bucket those come before the
    directly sorted ones, so a bucket is scanned in two steps and whole arrays at a time.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # smaller[i]: suffix i is smaller than suffix i + 1; the empty suffix is smallest.
    differs = np.flatnonzero(text[1:] != text[:-1])
    sign = text[differs] < text[differs + 1]
    smaller = np.zeros(n, bool)
    if len(differs):
        smaller[: differs[-1] + 1] = np.repeat(sign, np.diff(np.concatenate(([-1], differs))))
    placed = direct_sort(text, np.flatnonzero(smaller), depth)
    count = np.bincount(text, minlength=256)
    direct = np.bincount(text[placed], minlength=256)
    order = np.full(n, -1, np.int64)
    begin = np.concatenate(([0], np.cumsum(count)[:-1]))
    for c in np.flatnonzero(direct):
        end = begin[c] + count[c]
        order[end - direct[c] : end] = placed[np.searchsorted(text[placed], c, "left") : np.searchsorted(text[placed], c, "right")]
    free = begin.copy()

    def induce(sources: np.ndarray) -> None:
        before = sources[sources > 0] - 1
        before = before[~smaller[before]]
        if not len(before):
            return
        symbol = text[before]
        by = np.argsort(symbol, kind="stable")
        before, symbol = before[by], symbol[by]
        sizes = np.bincount(symbol, minlength=256)
        used = np.flatnonzero(sizes)
        within = np.arange(len(before)) - np.repeat((np.cumsum(sizes) - sizes)[used], sizes[used])
        order[free[symbol] + within] = before
        free[used] += sizes[used]

    induce(np.array([n]))  # the empty suffix comes first
    for c in np.flatnonzero(count):
        done = begin[c]
        while done < free[c]:  # inside the bucket a suffix may place its own predecessor
            step = order[done : free[c]].copy()
            done = free[c]
            induce(step)
        if direct[c]:
            induce(order[begin[c] + count[c] - direct[c] : begin[c] + count[c]])
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """How many symbols each suffix of ``order`` shares with the next one, ``most`` at most; all have as many.

    Eight symbols are compared as one number, for those pairs alone that agree so far."""
    lengths = np.full(max(0, len(order) - 1), most)
    words = np.ndarray((len(text) + 1,), ">u8", np.concatenate((text, np.zeros(8, np.uint8))).tobytes(), strides=(1,))
    pairs = np.arange(len(lengths))
    for depth in range(0, most, 8):
        differs = words[order[pairs] + depth].astype(">u8") ^ words[order[pairs + 1] + depth]
        apart = differs != 0
        if apart.any():
            first = (differs[apart].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
            lengths[pairs[apart]] = np.minimum(depth + first, most)
            pairs = pairs[~apart]
        if not len(pairs):
            break
    return lengths


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part, which of its starts have ``length`` bytes that also start elsewhere."""
    sizes = np.array([len(p) for p in parts])
    edge = np.concatenate(([0], np.cumsum(sizes)))
    text = np.frombuffer(b"".join(parts), np.uint8)
    order = suffix_array(text, length)
    room = np.repeat(edge[1:], sizes) - np.arange(len(text))
    order = order[room[order] >= length]  # a string lies inside its part
    found = np.zeros(len(text), bool)
    near = common_prefixes(text, order, length) >= length
    found[order[:-1][near]] = found[order[1:][near]] = True
    return [found[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


# -- anchors ----------------------------------------------------------------------------------


_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each position, the same for equal bytes anywhere."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    room = 1 << n.bit_length()
    up, down = _powers(_BASE, room), _powers(_INVERSE, room)
    before = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)))
    x = (before[size:] - before[:-size]) * down[: n - size + 1]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The place of the smallest of each w values in a row, the last of equals."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, _NONE, np.uint64)
    padded[:n] = x
    rows = padded.reshape(blocks, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    least = np.minimum(right[:m], left[w - 1 : w - 1 + m])
    # The place: the last position up to i + w - 1 whose value is the window's minimum.  A new minimum
    # of a window is either its last element or stays where it was.
    is_last = x[w - 1 : w - 1 + m] == least
    place = np.where(is_last, np.arange(w - 1, w - 1 + m), -1)
    changed = np.concatenate(([True], least[1:] != least[:-1]))
    unsure = np.flatnonzero(changed & ~is_last)
    for i in unsure.tolist():
        place[i] = i + w - 1 - int(np.argmin(x[i : i + w][::-1]))
    # An equal minimum that has left the window is replaced by the next equal one, which is_last saw;
    # places never go back.
    return np.maximum.accumulate(place)


def anchors(data: np.ndarray, edges: np.ndarray, length: int, gram: int, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, ...]]:
    """Of texts in one array: numbers of the texts, the anchors' hashes and places, and the first
    and the end of the starts of each, counted from the text's begin.  Starts of one anchor that lie in
    two chunks come as two."""
    total = int(edges[-1])
    for a in range(0, total - length + 1, chunk):
        part = data[a : a + chunk + length - 1]
        hashes = _gram_hashes(part, gram)
        place = _sliding_least(hashes, length - gram + 1)
        m = len(place)
        # The last starts of a text would run over its end.
        low, high = np.searchsorted(edges, [a, a + m + length], "right")
        ends = edges[low : min(high + 1, len(edges))]
        begins = np.maximum(edges[low - 1 : low - 1 + len(ends)], ends - length + 1)
        change = np.zeros(m + 1, np.int32)
        np.add.at(change, np.clip(begins - a, 0, m), 1)
        np.add.at(change, np.clip(ends - a, 0, m), -1)
        valid = np.cumsum(change[:-1]) == 0
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            continue
        stop = np.flatnonzero(np.concatenate((valid[:-1] & ~valid[1:], valid[-1:]))) + 1
        end = np.minimum(np.concatenate((first[1:], [m])), stop[np.searchsorted(stop, first, "right")])
        text = np.searchsorted(edges, first + a, "right") - 1
        base = a - edges[text]
        yield text, hashes[place[first]].view(np.int64), place[first] + base, first + base, end + base


def _find_anchors(length: int, gram: int):
    """Anchor, its stretch's digest, the row's name, and packed in ``at``: the first start, its distance
    to the anchor and the number of starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK):
            data, edges = utf8_buffer(batch.column("text"))
            whole = data.tobytes()
            for text, hashes, place, first, end in anchors(data, edges, length, gram):
                low, far, starts = edges[text] + first, place - first, end - first
                spans = zip(low.tolist(), (low + starts + length - 1).tolist(), far.tolist(), strict=True)
                digests = np.fromiter((xxhash.xxh3_64_intdigest(whole[a:b], f) for a, b, f in spans), np.uint64, len(low))
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes), pa.array(digests.view(np.int64)), batch.column("r1").take(rows), batch.column("r2").take(rows), pa.array(first << 24 | far << 12 | starts)],
                    names=["anchor", "d", "r1", "r2", "at"],
                )

    return run


def _lists(batch: pa.RecordBatch, name: str) -> tuple[list[int], dict[str, list]]:
    """A column of lists of structs: the lists' edges, and each field of all their elements."""
    lists = batch.column(name)
    edges = lists.offsets.to_numpy()
    flat = lists.flatten()
    return (edges - edges[0]).tolist(), {f.name: flat.field(k).to_pylist() for k, f in enumerate(flat.type)}


PARTS = "run boolean, key long, p long, part binary"
SPLIT = "key long, p long, anchor long, d long, at long, shift int, r1 long, r2 long"


def _take_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted parts, each ``size`` long from ``first``."""
    for batch in slices(batches, "text", CHUNK):
        data, text_edges = utf8_buffer(batch.column("text"))
        whole = data.tobytes()
        edges, fields = _lists(batch, "wanted")
        base = np.repeat(text_edges[:-1], np.diff(edges))
        first = (base + np.array(fields["first"], np.int64)).tolist()
        parts = [whole[a : a + n] for a, n in zip(first, fields["size"], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(fields["run"], pa.bool_()), pa.array(fields["key"], pa.int64()), pa.array(fields["p"], pa.int64()), pa.array(parts, pa.binary())],
            names=["run", "key", "p", "part"],
        )


def _split_parts(length: int, width: int):
    """Wanted stretches split at distances from the anchor that are multiples of ``width``; ``shift``
    counts from the begin of the stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK):
            data, text_edges = utf8_buffer(batch.column("text"))
            whole = data.tobytes()
            edges, fields = _lists(batch, "wanted")
            text = np.repeat(np.arange(batch.num_rows), np.diff(edges)).tolist()
            rows: list[tuple] = []
            for t, anchor, d, at, shift in zip(text, fields["anchor"], fields["d"], fields["at"], fields["shift"], strict=True):
                b = int(text_edges[t])
                start = first = at >> 24
                place, end = start + (at >> 12 & 4095), start + (at & 4095)
                while first < end:
                    far = (place - first) // width
                    last = place - far * width
                    stop = min(end, last + 1)
                    # What all starts at these distances cover, whichever of them this stretch has.
                    shared = whole[b + last : b + max(last, last + 1 - width + length)]
                    key = xxhash.xxh3_64_intdigest(b"%d %d %d " % (anchor, width, far) + shared) - (1 << 63)
                    p = xxhash.xxh3_64_intdigest(whole[b + first : b + stop + length - 1], place - first) - (1 << 63)
                    rows.append((key, p, anchor, d, first << 24 | place - first << 12 | stop - first, shift + first - start, t))
                    first = stop
            if rows:
                *numbers, shift, row = zip(*rows, strict=True)
                named = [batch.column(c).take(pa.array(row)) for c in ("r1", "r2")]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x, pa.int64()) for x in numbers), pa.array(shift, pa.int32()), *named],
                    names=["key", "p", "anchor", "d", "at", "shift", "r1", "r2"],
                )

    return run


def _compare(length: int):
    """Parts ``run, key, p, part`` sorted by run and key: their starts ``low <= start < high`` that repeat."""

    def of(held: list[tuple[bool, int, int, bytes]]) -> pa.RecordBatch:
        rows = []
        for (run, key, p, _), marks in zip(held, repeated_starts([h[3] for h in held], length), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))).tolist()
            rows += [(run, key, p, low, high) for low, high in zip(edge[::2], edge[1::2], strict=True)]
        columns = zip(*rows, strict=True) if rows else ((),) * 5
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["run", "key", "p", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bool, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("run", "key", "p", "part")), strict=True):
                if size >= ARRAY_BYTES and row[:2] != held[-1][:2]:
                    yield of(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield of(held)

    return run


def _remove(with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, edges = utf8_buffer(batch.column("text"))
            marks = batch.column("marks").to_pylist()
            size, removed, spans, sums, kept = [], [], [], [], []
            for raw, mark in zip(np.split(data, edges[1:-1]), marks, strict=True):
                size.append(len(raw))
                left, gone, runs = raw, 0, 0
                if mark:
                    change = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(change, [m["a"] for m in mark], 1)
                    np.add.at(change, [m["b"] for m in mark], -1)
                    covered = np.cumsum(change[:-1]) > 0
                    left, gone = raw[~covered], int(covered.sum())
                    runs = int((np.diff(np.concatenate(([0], covered.astype(np.int8)))) == 1).sum())
                removed.append(gone)
                spans.append(runs)
                left = left.tobytes()
                sums.append(hashlib.sha256(left).hexdigest())
                kept.append(left if with_kept else None)
            columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(sums)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_kept:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, with_kept: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``: each document's bytes less all
    that a repeated string of ``length`` bytes covers; ``kept`` holds what is left.

    Repeats are judged on the input, whole corpus and same document alike, overlaps included; rows that
    repeat are documents of their own, so both lose what they share; a null text is empty; an
    empty table gives an empty result; other columns are ignored.
    """
    if not gram <= length < 4096:
        raise ValueError("length lies between gram and 4095")
    kind = docs.schema["doc_id"].dataType.simpleString()
    # A row's name: 128 bits that equal rows alone share.
    names = {"r1": F.xxhash64(F.col("doc_id").cast("string"), "text"), "r2": F.xxhash64("text", F.lit("|"), F.col("doc_id").cast("string"))}
    texts = small_batches(docs).select("doc_id", "text").withColumns(names)
    name = ["r1", "r2"]
    spark, stretch = docs.sparkSession, ["anchor", "d"]
    # Anchors are found once and kept as a table until the repeated ones are known.
    folder = scratch_dir(spark, "anchors")
    texts.select(*name, "text").mapInArrow(_find_anchors(length, gram), "anchor long, d long, r1 long, r2 long, at long").write.mode("overwrite").parquet(folder)
    found = spark.read.parquet(folder)
    # Cut, so that a very frequent anchor is split over tasks by the join below.
    repeated = cut(
        found.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("least"), F.max("d").alias("most"))
        .where("n > 1")
        .select("anchor", (F.col("least") != F.col("most")).alias("differ"))
    )
    placed = cut(found.join(repeated, "anchor"))
    forget(spark, folder)
    occurrence = F.struct(*name, "at")
    kinds = cut(
        placed.groupBy(*stretch).agg(
            F.count(F.lit(1)).alias("n"), F.max("differ").alias("differ"), F.min(occurrence).alias("one"), F.max(occurrence).alias("two")
        )
    )
    starts = F.col("one.at").bitwiseAND(F.lit(4095).cast("long")).cast("int")
    first = lambda side: F.shiftright(F.col(side)["at"], 24).cast("int")

    # Copies: neighbouring stretches at the same two places are a run.
    places = [F.col(f"{side}.{r}").alias(f"{side}_{r}") for side in ("one", "two") for r in name]
    both = [f"{side}_{r}" for side in ("one", "two") for r in name] + ["lag"]
    order = Window.partitionBy(*both).orderBy("first", "starts")
    copies = kinds.where("n > 1").select(*stretch, *places, (first("two") - first("one")).alias("lag"), first("one").alias("first"), starts.alias("starts"))
    before = F.lag(F.col("first") + F.col("starts")).over(order)
    joins = (F.col("first") <= before) & (F.floor(F.col("first") / RUN) == F.floor(F.lag("first").over(order) / RUN))
    members = (
        copies.withColumn("fresh", F.when(joins, None).otherwise(F.col("first")))
        .withColumn("begin", F.max("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .select(*stretch, *both, "begin", (F.col("first") - F.col("begin")).alias("shift"), "starts")
        .withColumn("key", F.xxhash64(*both, "begin"))
    )
    members = cut(members)
    runs = members.groupBy("key", *both, "begin").agg((F.max(F.col("shift") + F.col("starts")) + length - 1).alias("size"))
    sides = F.array(
        F.struct(F.col("one_r1").alias("w1"), F.col("one_r2").alias("w2"), F.lit(0).cast("long").alias("p"), F.col("begin").alias("first")),
        F.struct(F.col("two_r1").alias("w1"), F.col("two_r2").alias("w2"), F.lit(1).cast("long").alias("p"), (F.col("begin") + F.col("lag")).alias("first")),
    )
    runs = runs.select("key", "size", F.explode(sides).alias("side")).select("side.w1", "side.w2", F.lit(True).alias("run"), "key", "side.p", "side.first", "size")

    different = kinds.where("differ").select(*stretch, "one", F.lit(0).alias("shift"))
    hot = cut(different.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > HOT).select("anchor"))
    any_hot = hot.limit(1).count() > 0
    cool = different.join(hot, "anchor", "left_anti") if any_hot else different

    def single(some: DataFrame, key: str, p: str, side: str = "one") -> DataFrame:
        size = F.col(f"{side}.at").bitwiseAND(F.lit(4095).cast("long")).cast("int") + length - 1
        return some.select(F.col(f"{side}.r1").alias("w1"), F.col(f"{side}.r2").alias("w2"), F.lit(False).alias("run"), F.col(key).alias("key"), F.col(p).alias("p"), first(side).alias("first"), size.alias("size"))

    # All joins with the texts take the same columns, so that one query shuffles the texts once.
    def with_texts(some: DataFrame, *fields: str) -> DataFrame:
        wanted = some.groupBy("w1", "w2").agg(F.collect_list(F.struct(*fields)).alias("wanted"))
        return texts.join(wanted, (F.col("r1") == F.col("w1")) & (F.col("r2") == F.col("w2"))).select("doc_id", *name, "text", "wanted")

    def compared(some: DataFrame) -> DataFrame:
        tasks = (some.agg(F.sum("size")).first()[0] or 0) // TASK_BYTES
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(tasks, 100_000))
        rows = with_texts(some, "run", "key", "p", "first", "size").mapInArrow(_take_parts, PARTS)
        return rows.repartition(tasks, "run", "key").sortWithinPartitions("run", "key", "p").mapInArrow(_compare(length), "run boolean, key long, p long, low int, high int")

    marks = cut(compared(runs.union(single(cool, "anchor", "d"))))
    of_runs = members.select(*stretch, "key", "shift", "starts").join(marks.where("run and p = 0").select("key", "low", "high"), "key")
    of_runs = of_runs.select(*stretch, F.greatest(F.col("low") - F.col("shift"), F.lit(0)).alias("low"), F.least(F.col("high") - F.col("shift"), "starts").alias("high")).where("low < high")
    marked = of_runs.union(marks.where("not run").select(F.col("key").alias("anchor"), F.col("p").alias("d"), "low", "high"))
    some, width = different.join(hot, "anchor", "left_semi"), PART
    while any_hot:
        asked = some.select(F.col("one.r1").alias("w1"), F.col("one.r2").alias("w2"), *stretch, "one.at", "shift")
        split = cut(with_texts(asked, *stretch, "at", "shift").mapInArrow(_split_parts(length, width), SPLIT))
        each = cut(split.groupBy("key", "p").agg(F.count(F.lit(1)).alias("n"), F.min(occurrence).alias("one"), F.max(occurrence).alias("two")))
        groups = cut(each.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")).where("n > 1"))
        crowded = groups.where(F.col("kinds") > HOT).select("key")
        # Parts of one start each that share a key are equal.
        any_hot = width > 1 and crowded.limit(1).count() > 0
        few = groups.where(F.col("kinds") <= HOT) if any_hot else groups
        taken = each.join(few.select("key"), "key", "left_semi")
        repeats = cut(compared(single(taken, "key", "p").union(single(taken.where("n > 1"), "key", "p", "two"))).select("key", "p", "low", "high").distinct())
        marked = marked.union(
            split.join(repeats, ["key", "p"]).select(*stretch, (F.col("low") + F.col("shift")).alias("low"), (F.col("high") + F.col("shift")).alias("high"))
        )
        some = split.join(crowded, "key", "left_semi").select(*stretch, "shift", F.struct(*name, "at").alias("one"))
        width = max(1, width // NARROWER)
    start = F.shiftright("at", 24)
    spans = (
        placed.select(*stretch, *name, "at")
        .join(marked, stretch)
        .select(F.col("r1").alias("m1"), F.col("r2").alias("m2"), F.struct((start + F.col("low")).cast("int").alias("a"), (start + F.col("high") + length - 1).cast("int").alias("b")).alias("m"))
        .groupBy("m1", "m2")
        .agg(F.collect_set("m").alias("marks"))
    )
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_kept else "")
    joined = texts.join(spans, (F.col("r1") == F.col("m1")) & (F.col("r2") == F.col("m2")), "left")
    return joined.select("doc_id", *name, "text", "marks").mapInArrow(_remove(with_kept), schema)
