"""Order-preserving packing of documents into sequences by dynamic programming.

Documents are range-partitioned by id, and a partition's token stream is cut into windows of at
most ``size`` tokens.  Cuts lie at document ends (free), sentence ends (a small penalty) or, where
neither comes for long, inside a sentence (a large one).  With g(j) the cost up to cut j plus its
position, the least cost over all earlier cuts within ``size`` is a sliding-window minimum of g,
kept in a monotone queue: g(j) = min g(i) + size + penalty(j).
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches
from .tokens import word_encoder

SIZE, END_ID = 2048, 1
SENTENCE_PENALTY, INNER_PENALTY = 2, 16
#: Longest stretch without a cut, and tokens that are planned together.
STRETCH, BLOCK = 16, 1 << 20


def sentence_ends(encoder) -> np.ndarray:
    """Whether each token id ends a sentence."""
    vocabulary = encoder.tokenizer.get_vocab()
    ends = regex.compile(r"[^\p{L}\p{N}]*[.!?][^\p{L}\p{N}]*</w>").fullmatch
    table = np.zeros(1 << 16, bool)
    table[[i for token, i in vocabulary.items() if ends(token)]] = True
    return table


def candidate_cuts(total: int, sentences: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions where a window may end, and their penalties; both arrays hold ends in (0, total]."""
    natural = np.union1d(sentences, documents)
    before = np.concatenate(([0], natural[:-1])) if len(natural) else natural
    long = np.flatnonzero(natural - before > STRETCH)
    inner = [np.arange(before[k] + STRETCH, natural[k], STRETCH) for k in long]
    cuts = np.union1d(natural, np.concatenate(inner)) if inner else natural
    penalty = np.full(len(cuts), INNER_PENALTY)
    penalty[np.searchsorted(cuts, sentences)] = SENTENCE_PENALTY
    penalty[np.searchsorted(cuts, documents)] = 0
    return cuts, penalty


def best_windows(cuts: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """The ends of the windows of least padding plus penalties, the last candidate among them."""
    at, cost = [0, *cuts.tolist()], [0, *penalty.tolist()]
    g, parent = [0] * len(at), [0] * len(at)
    queue = deque([0])
    for j in range(1, len(at)):
        oldest = at[j] - size
        while at[queue[0]] < oldest:
            queue.popleft()
        i = queue[0]
        parent[j] = i
        g[j] = v = g[i] + size + cost[j]
        while queue and g[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    ends, j = [], len(at) - 1
    while j:
        ends.append(at[j])
        j = parent[j]
    return ends[::-1]


def last_windows(length: int, size: int) -> list[int]:
    """How the last window of a stream is split: into powers of two, which need no padding, where
    the cuts cost less than the padding."""
    parts = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    return parts if (len(parts) - 1) * INNER_PENALTY < size - length and len(parts) > 1 else [length]


class _Stream:
    """The documents of one partition, packed as they come."""

    def __init__(self, size: int, ends: np.ndarray, first_sequence: int, kind: pa.DataType, with_ids: bool):
        self.size, self.sentence, self.sequence, self.kind, self.with_ids = size, ends, first_sequence, kind, with_ids
        self.held: list[tuple[object, int, np.ndarray, int]] = []  # id, tokens before, tokens, all its tokens
        self.total = 0

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        self.held.append((doc_id, 0, ids, len(ids)))
        self.total += len(ids)

    def pack(self, last: bool) -> pa.RecordBatch | None:
        if not self.total:
            return None
        stream = np.concatenate([x[2] for x in self.held])
        doc_end = np.cumsum([len(x[2]) for x in self.held])
        sentences = np.flatnonzero(self.sentence[stream]) + 1
        ends = best_windows(*candidate_cuts(self.total, sentences, doc_end), self.size)
        if last:
            begin = ends[-2] if len(ends) > 1 else 0
            ends = [*ends[:-1], *(begin + np.cumsum(last_windows(ends[-1] - begin, self.size))).tolist()]
        else:
            ends = ends[:-1]
        if not ends:
            return None
        ends = np.array(ends)
        edge = np.union1d(ends, doc_end[doc_end < ends[-1]])
        start = np.concatenate(([0], edge[:-1]))
        doc = np.searchsorted(doc_end, start, "right")
        window = np.searchsorted(ends, start, "right")
        doc_start = doc_end - [len(x[2]) for x in self.held]
        base = np.array([x[1] for x in self.held])
        pieces = [stream[a:b] for a, b in zip(start.tolist(), edge.tolist(), strict=True)]
        columns = [
            pa.array([self.held[k][0] for k in doc], self.kind),
            pa.array(start - doc_start[doc] + base[doc]),
            pa.array(edge - start),
            pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in pieces], pa.int64()),
            pa.array([self.held[k][3] for k in doc], pa.int64()),
            pa.array(self.sequence + window),
            pa.array(start - np.concatenate(([0], ends))[window]),
        ]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if self.with_ids:
            columns.append(pa.array([p.astype(np.int32) for p in pieces], pa.list_(pa.int32())))
            names.append("ids")
        self.sequence += len(ends)
        rest = []
        for k in range(int(np.searchsorted(doc_end, ends[-1], "right")), len(self.held)):
            doc_id, before, ids, whole = self.held[k]
            skip = max(0, int(ends[-1] - doc_start[k]))
            rest.append((doc_id, before + skip, ids[skip:], whole))
        self.held, self.total = rest, int(self.total - ends[-1])
        return pa.RecordBatch.from_arrays(columns, names=names)


def pack_documents(docs: DataFrame, *, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and,
    ``with_ids``, the tokens themselves as ``ids``.

    Each document's tokens end with ``end_id``; a null or empty text is that token alone.  Documents
    follow each other by id, null first; rows that share an id follow each other by their text's
    hash, each packed as a document of its own; an empty table gives an empty result; other
    columns are ignored.  Sequence ids hold the partition's number above the sequence's own.
    """
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stream = word_encoder(), None
        tail = np.array([end_id], np.uint16)
        for batch in slices(batches, "text", 1 << 20):
            if stream is None:
                first = TaskContext.get().partitionId() << 40
                stream = _Stream(size, sentence_ends(encoder), first, batch.column("doc_id").type, with_ids)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                stream.add(doc_id, np.concatenate((ids, tail)))
            if stream.total >= BLOCK and (done := stream.pack(False)):
                yield done
        if stream and (done := stream.pack(True)):
            yield done

    schema = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return (
        small_batches(docs)
        .select("doc_id", "text")
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
    )
