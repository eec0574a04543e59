"""SimHash near-duplicates: 64-bit fingerprints compared as vertical bit planes.

Fingerprints within the radius agree on at least two of radius + 2 bit blocks, so each distinct
fingerprint is dealt out once for each pair of blocks.  Where a key holds more fingerprints than
one cell should, it is split into chunks and each pair of chunks is a cell of its own.  Inside a
cell, bit planes are stored vertically, carry-save counters add up the differing bits of many
fingerprints at once, and a block of 256 lanes is abandoned when all its counters have overflowed;
lanes that nobody asks for (padding, and fingerprints that already have a group) count as overflowed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, small_batches
from .components import components, local_roots

SEED = 42
BITS = 64
#: Fingerprints of one key that are compared in one cell.
CELL = 2048
#: 64-bit words of a block of lanes, and planes between two looks at whether to abandon it.
WORDS, LOOK = 4, 4
_SPREAD = np.uint64(0x0101010101010101)


def shingle_hashes(raw: bytes, width: int = 3) -> list[int]:
    """XXH64 of each run of ``width`` words, repeats included; of all words where they are fewer."""
    words = raw.lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = map(slice, starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    return list(map(xxhash.xxh64_intdigest, map(text.__getitem__, spans), repeat(SEED)))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of ``counts`` hashes: bits that are set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    # Byte lanes hold up to 255, so runs are added up in pieces of 255 and then widened.
    sizes = counts[full]
    pieces = (sizes + 254) // 255
    owner = np.repeat(np.arange(len(full)), pieces)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = first[owner] + 255 * nth
    edge = np.cumsum(pieces) - pieces
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _SPREAD, at)
        for j in range(8):
            ones = np.add.reduceat(((lanes >> np.uint64(8 * j)) & np.uint64(255)).astype(np.int64), edge)
            out[full] |= (2 * ones > sizes).astype(np.uint64) << np.uint64(8 * j + k)
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long.  A null or wordless text has zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [shingle_hashes((t or "").encode(), width) for t in batch.column("text").to_pylist()]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((h for row in found for h in row), np.uint64, int(counts.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(majority(flat, counts).view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _pack(bits: np.ndarray) -> np.ndarray:
    """The last axis as blocks of 64-bit words, the rest of the last block zero."""
    n, lanes = bits.shape[-1], 64 * WORDS
    padded = np.zeros((*bits.shape[:-1], max(1, -(-n // lanes)) * lanes), np.uint8)
    padded[..., :n] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64).reshape(*bits.shape[:-1], -1, WORDS)


def _unpack(blocks: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(blocks).view(np.uint8).ravel(), bitorder="little")[:n]


def _planes(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T


def far_lanes(over: np.ndarray, planes: int, differs: Callable[[int, np.ndarray], np.ndarray], radius: int) -> np.ndarray:
    """Adds to ``over``, blocks of lanes, those that differ in more than ``radius`` of the planes.

    ``differs(plane, blocks)`` gives the differing lanes of some of the blocks, by number.  The
    counters start so that radius + 1 differences carry out of their highest bit.  A block whose
    lanes are all over is abandoned: no later plane is read for it.
    """
    bits = max(1, radius.bit_length())
    start = (1 << bits) - 1 - radius
    ones = ~np.uint64(0)
    alive = np.flatnonzero((over != ones).any(axis=1))
    now = over[alive]
    counter = [np.full(now.shape, ones if start >> k & 1 else np.uint64(0)) for k in range(bits)]
    for plane in range(planes):
        if not len(alive):
            break
        carry = differs(plane, alive)
        for k in range(bits):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        now |= carry
        if plane % LOOK == LOOK - 1:
            live = (now != ones).any(axis=1)
            if not live.all():
                over[alive] = now
                alive, now, counter = alive[live], now[live], [c[live] for c in counter]
    over[alive] = now
    return over


def cell_roots(fps: np.ndarray, radius: int, block: int = 256) -> np.ndarray:
    """For each of the distinct fingerprints of a cell, the index of the first that it reaches."""
    n = len(fps)
    planes = _planes(fps)
    planes = planes[(planes.min(axis=1) != planes.max(axis=1))]
    words = _pack(planes)
    masks = -planes.astype(np.int64).view(np.uint64) if len(planes) else planes
    root, left = np.full(n, -1), _pack(np.ones(n, np.uint8))
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed] = seed
        left.reshape(-1)[seed // 64] &= ~(np.uint64(1) << np.uint64(seed % 64))
        queue = [seed]
        while queue:
            ask, queue = np.array(queue[:block]), queue[block:]
            # The blocks of all asking rows, one row's after the other's.
            over = np.tile(~left, (len(ask), 1))
            far_lanes(over, len(planes), lambda b, at: words[b, at % len(left)] ^ masks[b, ask[at // len(left)]][:, None], radius)
            near = np.bitwise_or.reduce(~over.reshape(len(ask), *left.shape), axis=0)
            if near.any():
                left &= ~near
                new = np.flatnonzero(_unpack(near, n))
                root[new] = seed
                queue += new.tolist()
    return root


def small_roots(fps: np.ndarray, cell: np.ndarray, radius: int) -> np.ndarray:
    """As ``cell_roots`` for many small cells at once; items of one cell stand together."""
    n, planes = len(fps), _planes(fps)
    left, right, shift = [], [], 1
    while shift < n:
        at = np.flatnonzero(cell[:-shift] == cell[shift:])
        if not len(at):
            break
        differs = _pack(planes[:, at] ^ planes[:, at + shift])
        over = far_lanes(~_pack(np.ones(len(at), np.uint8)), BITS, lambda b, some: differs[b, some], radius)
        near = at[_unpack(over, len(at)) == 0]
        left.append(near)
        right.append(near + shift)
        shift += 1
    return local_roots(n, np.concatenate(left), np.concatenate(right)) if left else np.arange(n)


def _links(radius: int, small: int = 12, gather: int = 1 << 16):
    def of(cells: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1], [True])))
        size = np.diff(edge)
        root = np.arange(len(fps))
        few = np.repeat(size <= small, size)
        at = np.flatnonzero(few)
        if len(at):
            root[at] = at[small_roots(fps[at], cells[at], radius)]
        for a, k in zip(edge[:-1][size > small].tolist(), size[size > small].tolist(), strict=True):
            root[a : a + k] = a + cell_roots(fps[a : a + k], radius)
        moved = np.flatnonzero(root != np.arange(len(fps)))
        pairs = np.unique(np.stack([fps[moved], fps[root[moved]]], axis=1), axis=0).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append((batch.column("cell").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)))
            rows += batch.num_rows
            if rows >= gather:
                cells, fps = (np.concatenate(x) for x in zip(*held, strict=True))
                end = int(np.flatnonzero(cells != cells[-1])[-1]) + 1 if (cells != cells[-1]).any() else 0
                if end:
                    yield of(cells[:end], fps[:end])
                held, rows = [(cells[end:], fps[end:])], len(cells) - end
        if rows:
            yield of(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def fingerprint_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """``a, b``: links between distinct fingerprints of the column ``fp`` that join all which
    chains of at most ``radius`` differing bits join.  No link is longer than such a chain."""
    blocks = radius + 2
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]

    def mask(i: int) -> int:
        return ((1 << (edges[i + 1] - edges[i])) - 1) << edges[i]

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    keys: list[Column] = [
        F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(mask(i) | mask(j))).cast("long")))
        for k, (i, j) in enumerate(combinations(range(blocks), 2))
    ]
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    # Cut before it is joined back, here and below: then a hot key can be split over tasks.
    shared = cut(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    chunks = F.ceil(F.col("n") / F.lit(CELL)).cast("long")
    chunk = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks"))
    cells = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1),
        lambda j: F.xxhash64(F.col("key"), F.least(F.col("chunk"), j), F.greatest(F.col("chunk"), j)),
    )
    spread = (
        dealt.join(shared, "key")
        .withColumn("chunks", chunks)
        .withColumn("chunk", chunk)
        .select("fp", F.explode(cells).alias("cell"))
    )
    return spread.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, *, radius: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row a document.

    Null and empty texts have fingerprint zero and link like any other; rows that repeat stay as
    often as they occur; a null id never becomes a component's id unless no other is there; an
    empty table gives an empty result; columns that are not named are ignored.
    """
    fps = cut(fingerprints(docs, id_col=id_col, text_col=text_col, width=width))
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(fingerprint_links(fps.select("fp").distinct(), radius))
    rooted = cut(
        firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    )
    least = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
