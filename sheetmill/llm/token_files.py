"""Token-id files of directly addressable codes.

An id is split into 8-bit chunks.  Level 0 holds the lowest chunk of every id and a bitmap that
says whether a higher chunk follows; level 1 holds the next chunk of those, and so on.  A rank
directory (the ones before every 512th bit) leads from an id on one level to its place on the next,
so that any single id is read from a few bytes, and a document from its own stretch of each level.

File, all little-endian:

====================  =======================================================================
8 bytes               ``SMDACv1\\n``
u64 x 3               documents, tokens, levels
levels x u64          chunks on each level
documents x i64       document ids (a null id as 0), then documents x u8: whether it is null
(documents + 1) x u64 tokens before each document
each level            chunks (u8), padded to 8; bitmap (u64 words); rank directory (u64)
====================  =======================================================================
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, small_batches
from .tokens import byte_encoder

MAGIC = b"SMDACv1\n"
END_ID = 2
#: Tokens of a file, about: it ends with the document that reaches them.
FILE_TOKENS = 4_000_000
#: Partitions of the list of files, which is short: a row a file.
LIST_PARTS = 8
_EVERY = 512


def _words(n: int) -> int:
    return -(-n // 64)


def write_file(ids: np.ndarray, counts: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray) -> bytes:
    """The file of documents with ``counts`` tokens each, ``ids`` in a row."""
    levels, left = [], ids.astype(np.uint32)
    while True:
        more = left > 255
        bits = np.zeros(_words(len(left)) * 64, np.uint8)
        bits[: len(left)] = more
        packed = np.packbits(bits, bitorder="little").view("<u8")
        directory = np.concatenate(([0], np.cumsum(bits.reshape(-1, 64).sum(axis=1, dtype=np.int64))))[:: _EVERY // 64]
        chunks = np.zeros(-(-len(left) // 8) * 8, np.uint8)
        chunks[: len(left)] = left & 255
        levels.append((len(left), chunks, packed, directory.astype("<u8")))
        if not more.any():
            break
        left = left[more] >> 8
    starts = np.concatenate(([0], np.cumsum(counts)))
    head = np.array([len(counts), len(ids), len(levels), *[n for n, *_ in levels]], "<u8")
    parts = [MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), starts.astype("<u8").tobytes()]
    for _, *arrays in levels:
        parts += [a.tobytes() for a in arrays]
    return b"".join(parts)


class TokenFile:
    """Random access to a file; ``read(offset, n)`` returns its bytes there."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        if read(0, 8) != MAGIC:
            raise ValueError("not a token file")
        self.docs, self.tokens, count = (int(x) for x in np.frombuffer(read(8, 24), "<u8"))
        self.lengths = [int(x) for x in np.frombuffer(read(32, 8 * count), "<u8")]
        self.ids_at = 32 + 8 * count
        self.starts_at = self.ids_at + 9 * self.docs
        at, self.levels = self.starts_at + 8 * (self.docs + 1), []
        for n in self.lengths:
            bits = at + -(-n // 8) * 8
            directory = bits + 8 * _words(n)
            self.levels.append((at, bits, directory))
            at = directory + 8 * (_words(n) // (_EVERY // 64) + 1)
        self.size = at

    def doc_ids(self) -> tuple[np.ndarray, np.ndarray]:
        raw = self.read(self.ids_at, 9 * self.docs)
        return np.frombuffer(raw, "<i8", self.docs), np.frombuffer(raw, np.uint8, self.docs, 8 * self.docs).astype(bool)

    def starts(self) -> np.ndarray:
        return np.frombuffer(self.read(self.starts_at, 8 * (self.docs + 1)), "<u8").astype(np.int64)

    def _bits(self, level: int, a: int, b: int) -> np.ndarray:
        first = a // 8
        raw = np.frombuffer(self.read(self.levels[level][1] + first, -(-b // 8) - first), np.uint8)
        return np.unpackbits(raw, bitorder="little")[a - 8 * first : b - 8 * first]

    def _rank(self, level: int, i: int) -> int:
        block = i // _EVERY
        before = int.from_bytes(self.read(self.levels[level][2] + 8 * block, 8), "little")
        return before + int(self._bits(level, block * _EVERY, i).sum())

    def span(self, a: int, b: int, level: int = 0) -> np.ndarray:
        """The ids at a <= place < b."""
        out = np.frombuffer(self.read(self.levels[level][0] + a, b - a), np.uint8).astype(np.uint32)
        more = self._bits(level, a, b).view(bool)
        n = int(more.sum())
        if n:
            first = self._rank(level, a)
            out[more] |= self.span(first, first + n, level + 1) << np.uint32(8)
        return out

    def token(self, i: int) -> int:
        return int(self.span(i, i + 1)[0])

    def document(self, k: int) -> np.ndarray:
        a, b = np.frombuffer(self.read(self.starts_at + 8 * k, 16), "<u8")
        return self.span(int(a), int(b))


def open_file(uri: str) -> TokenFile:
    store, path = pafs.FileSystem.from_uri(uri)
    handle = store.open_input_file(path)

    def read(offset: int, n: int) -> bytes:
        return handle.read_at(n, offset)

    return TokenFile(read)


def _put(uri: str, content: bytes) -> None:
    """Whole or not at all, and the same again if a task is tried again."""
    store, path = pafs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(content)
    store.move(draft, path)


def write_tokens(docs: DataFrame, folder: str, *, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the token files of ``docs`` (``doc_id`` a whole number, ``text``) into the folder, a
    URI that all executors reach, and returns their list: ``part, file, uri, docs, tokens, start``.

    Files follow each other by (part, file) and hold the documents in ascending id, null first;
    rows that share an id follow each other by their text's hash.  A null or empty text is
    ``end_id`` alone; an empty table writes no file; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = byte_encoder(), np.array([end_id], np.uint16)
        part, number = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        counts: list[int] = []
        names: list[int | None] = []
        total = 0

        def finish() -> pa.RecordBatch:
            uri = f"{folder}/part-{part:06d}-{number:05d}.dac"
            known = np.array([x or 0 for x in names], np.int64)
            _put(uri, write_file(np.concatenate(ids), np.array(counts), known, np.array([x is None for x in names])))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([number], pa.int32()), "uri": [uri], "docs": [len(names)], "tokens": [total]})

        for batch in slices(batches, "text", 1 << 20):
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encoder.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                ids += [found, tail]
                counts.append(len(found) + 1)
                names.append(doc_id)
                total += len(found) + 1
                if total >= file_tokens:
                    yield finish()
                    ids, counts, names, total, number = [], [], [], 0, number + 1
        if names:
            yield finish()

    listed = cut(
        small_batches(docs)
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(run, "part int, file int, uri string, docs long, tokens long")
        .repartition(LIST_PARTS)
    )
    running = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = listed.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    parts = parts.select("part", running(Window.orderBy("part")).alias("before"))  # a row a partition
    return listed.join(parts, "part").withColumn("start", F.col("before") + running(Window.partitionBy("part").orderBy("file"))).drop("before")


def read_tokens(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document in the files that ``files`` lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
                file = open_file(uri)
                edges, (ids, nulls) = file.starts(), file.doc_ids()
                raw = file.span(0, file.tokens).astype("<u4")
                sums = [zlib.crc32(raw[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=nulls), pa.array(edges[:-1] + start), pa.array(np.diff(edges)), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = max(1, min(files.count(), 100_000))  # a task for each file, as far as tasks go
    return files.select("uri", "start").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
