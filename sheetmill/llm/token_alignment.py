"""Alignment of two tokenizers' tokens, as a relational plan over distinct words.

Both tokenizers begin anew at a space behind anything that is no white space, so a text is cut there into
words, and each distinct word of the corpus is tokenized and aligned once: its tokens are exploded with
their positions, windows over their lengths give the bytes at which they end, an equi-join of both sides'
ends on word and end finds the cuts, a running count numbers the groups between cuts, and a join back to
the word's tokens takes each group's range of them.

Documents are sequences of words.  They are dealt into blocks of a bounded size; a block's words meet
their groups by a join, and what documents hold is summed within the block.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import forget, scratch_dir, slices, small_batches, utf8_buffer
from .tokens import _byte_characters

#: Bytes of text in a block of documents, about; a longer text is a block of its own.
BLOCK = 16 << 20
_CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
_ODD = re.compile(r"\s ").search
_SPLIT = re.compile(r"(?<=\S)(?= .)", re.S).split


@contextmanager
def _by_word(spark: SparkSession) -> Iterator[None]:
    """What is dealt by word counts as dealt for joins on word and more, while a table is written."""
    before = spark.conf.get(_CO_PARTITION)
    spark.conf.set(_CO_PARTITION, "false")
    try:
        yield
    finally:
        spark.conf.set(_CO_PARTITION, before)


def words_of(text: str) -> list[str]:
    """The words of a text behind a space: each without the space that it begins with.  A last space alone
    stays with the word before it: of nothing, one of the tokenizers makes no space."""
    if text.endswith(" ") or _ODD(f" {text}"):
        return [w[1:] for w in _SPLIT(f" {text}")]
    return text.split(" ")


def _release(spark: SparkSession) -> None:
    """Shuffle files that nothing refers to any longer go now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype(np.int32).tobytes())


def _unpacked(held: bytes | None) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(held) if held else b"", np.int32)


def _block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (part 0), ``words`` holding their words' numbers in the block, and a row for each of its
    words (part 1)."""
    numbers: defaultdict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    block, size = TaskContext.get().partitionId() << 32, 0
    kind = None

    def dictionary() -> pa.RecordBatch:
        n = len(numbers)
        return pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), pa.array([block] * n, pa.int64()), pa.nulls(n, kind), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(list(numbers), pa.string())], names=names)

    names = ["part", "block", "doc_id", "words", "number", "word"]
    for batch in slices(batches, "text", 1 << 20):
        kind = batch.column("doc_id").type
        texts = batch.column("text").to_pylist()
        held = [_packed(np.fromiter(map(numbers.__getitem__, words_of(t)), np.int32)) if t else None for t in texts]
        n = len(texts)
        yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([block] * n, pa.int64()), batch.column("doc_id"), pa.array(held, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=names)
        size += sum(map(len, filter(None, texts)))
        if size >= BLOCK:
            yield dictionary()
            numbers.clear()
            block, size = block + 1, 0
    if numbers:
        yield dictionary()


@cache
def _tokenizers() -> tuple[Tokenizer, sentencepiece.SentencePieceProcessor, list[bytes], list[bytes]]:
    """Both tokenizers, and the bytes of each of their tokens."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = {c: i for i, c in enumerate(_byte_characters())}
    a_bytes = [b""] * a.get_vocab_size()
    for piece, i in a.get_vocab().items():
        a_bytes[i] = bytes(shown.get(c, 0) for c in piece)
    b_bytes = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(b.id_to_piece, range(b.get_piece_size())))]
    return a, b, a_bytes, b_bytes


def _lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The values between each two edges, as bytes."""
    offsets = (edges * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted words: which number each has in which blocks (part 0, ``blocks`` and ``numbers`` being lists as
    bytes, one row a word and batch), and, once, its tokens' ids and lengths (part 1) if both tokenizers keep
    its bytes."""
    a, b, a_bytes, b_bytes = _tokenizers()
    kind = pa.list_(pa.int32())
    schema = pa.schema([("part", pa.int32()), ("w", pa.int64()), ("blocks", pa.binary()), ("numbers", pa.binary()), ("a", kind), ("a_len", kind), ("b", kind), ("b_len", kind)])
    w, last = (TaskContext.get().partitionId() << 32) - 1, None
    for whole in batches:
        for batch in slices([whole], "word", 1 << 20):
            words, new, which = batch.column("word").to_pylist(), [], []
            for word in words:
                if word != last:
                    w, last = w + 1, word
                    new.append(word)
                which.append(w)
            runs = np.array(which, np.int64)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(runs)) + 1, [len(words)]])
            n = len(edges) - 1
            lists = [_lists(batch.column(c).to_numpy(), edges) for c in ("block", "number")]
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array(runs[edges[:-1]]), *lists, *(pa.nulls(n, kind) for _ in range(4))], schema=schema)
            found: dict[str, list] = {name: [] for name in ("w", "a", "a_len", "b", "b_len")}
            left = [e.ids for e in a.encode_batch([f" {x}" for x in new], add_special_tokens=False)]
            for k, (word, x, y) in enumerate(zip(new, left, b.encode(new, num_threads=1) if new else [], strict=True)):
                text, p, q = f" {word}".encode(), [a_bytes[i] for i in x], [b_bytes[i] for i in y]
                if b"".join(p) == text == b"".join(q):
                    for name, value in zip(found, (w - len(new) + 1 + k, x, [*map(len, p)], y, [*map(len, q)]), strict=True):
                        found[name].append(value)
            n = len(found["w"])
            yield pa.RecordBatch.from_pydict({"part": [1] * n, "blocks": [None] * n, "numbers": [None] * n, **found}, schema)


def aligned_groups(tokens: DataFrame) -> DataFrame:
    """``w, groups`` of ``w, a, a_len, b, b_len``: the groups as ``a1,a2|b1;a3|b2,b3``."""
    dealt = tokens.repartition("w")

    def ends(side: str) -> DataFrame:
        rows = dealt.select("w", F.posexplode(f"{side}_len").alias(f"{side}_at", "size"))
        so_far = Window.partitionBy("w").orderBy(f"{side}_at").rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("w", f"{side}_at", F.sum("size").over(so_far).alias("end"))

    cuts = ends("a").join(ends("b"), ["w", "end"])
    by_end = Window.partitionBy("w").orderBy("end")
    groups = cuts.select(
        "w", F.row_number().over(by_end).alias("g"), "a_at", "b_at",
        F.lag("a_at", 1, -1).over(by_end).alias("a_from"), F.lag("b_at", 1, -1).over(by_end).alias("b_from"),
    )
    ids = lambda side: F.array_join(F.slice(side, F.col(f"{side}_from") + 2, F.col(f"{side}_at") - F.col(f"{side}_from")), ",")
    ranges = groups.join(dealt.select("w", "a", "b"), "w").select("w", F.struct("g", F.concat(ids("a"), F.lit("|"), ids("b")).alias("ids")).alias("group"))
    return ranges.groupBy("w").agg(F.array_join(F.transform(F.array_sort(F.collect_list("group")), lambda x: x["ids"]), ";").alias("groups"))


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``blocks, numbers, groups`` as one compressed piece of ``number, groups`` a block and some hundred
    thousand rows."""
    held: list[pa.RecordBatch] = []

    def pieces() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).sort_by("block").combine_chunks()
        block = table.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        out = []
        for x, y in zip(edges, edges[1:], strict=False):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([table.schema.field("number"), table.schema.field("groups")]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(table.select(["number", "groups"]).slice(x, y - x))
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(block[edges[:-1]]), pa.array(out, pa.binary())], names=["block", "piece"])

    for batch in batches:
        if batch.num_rows:
            blocks = np.frombuffer(b"".join(batch.column("blocks").to_pylist()), np.int64)
            numbers = np.frombuffer(b"".join(batch.column("numbers").to_pylist()), np.int32)
            times = np.diff(utf8_buffer(batch.column("blocks"))[1]) // 8
            groups = batch.column("groups").take(pa.array(np.repeat(np.arange(batch.num_rows), times)))
            held.append(pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(numbers), groups], names=["block", "number", "groups"]))
        if sum(b.num_rows for b in held) >= 200_000:
            yield pieces()
            held.clear()
    if held:
        yield pieces()


class _Groups(dict):
    """Numbers of group strings, and what each group holds."""

    def __init__(self) -> None:
        self.sizes: list[tuple[int, int]] = []
        self.pairs: list[np.ndarray] = []

    def __missing__(self, group: str) -> int:
        a, b = (np.array(side.split(","), np.int64) for side in group.split("|"))
        self.sizes.append((len(a), len(b)))
        self.pairs.append((a[:, None] << 32 | b).ravel())
        self[group] = len(self)
        return self[group]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _hold(kind: pa.DataType):
    """What the documents of one block hold, and how many of them hold each pair."""
    schema = pa.schema([("block", pa.int64()), ("doc_id", kind), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("links", pa.binary()), ("number", pa.int32()), ("pair", pa.int64()), ("n_docs", pa.int64())])

    def run(words: pa.Table, docs: pa.Table) -> pa.Table:
        block = (words if words.num_rows else docs).column("block")[0].as_py()
        pieces = [pa.ipc.open_stream(x).read_all() for x in words.column("piece").to_pylist()]
        n = sum(x.num_rows for x in pieces)
        strings = np.full(n, None, object)
        for x in pieces:
            strings[x.column("number").to_numpy()] = x.column("groups").to_pylist()
        known, numbers = _Groups(), []
        sizes = np.zeros(n, np.int64)
        for k, s in enumerate(strings):
            if s is not None:
                found = list(map(known.__getitem__, s.split(";")))
                numbers.append(found)
                sizes[k] = len(found)
        of_word = np.fromiter((x for found in numbers for x in found), np.int64, int(sizes.sum()))
        word_starts = np.cumsum(sizes) - sizes
        n_a, n_b = np.array(known.sizes, np.int64).reshape(-1, 2).T
        pair_sizes = n_a * n_b
        pair_starts = np.cumsum(pair_sizes) - pair_sizes
        pairs, pair_of = np.unique(np.concatenate(known.pairs or [np.zeros(0, np.int64)]), return_inverse=True)
        n_docs = np.zeros(len(pairs), np.int64)
        out: dict[str, list] = {name: [] for name in schema.names[:8]}
        for doc_id, held in zip(docs.column("doc_id").to_pylist(), docs.column("words").to_pylist(), strict=True):
            row: tuple = (0, 0, 0, 0, "", None)
            if held is not None:
                at = _unpacked(held)
                texts = strings[at].tolist()
                if None not in texts:
                    groups = np.bincount(of_word[_spread(word_starts[at], sizes[at])], minlength=len(known))
                    some = np.flatnonzero(groups)
                    times = groups[some]
                    each = np.repeat(times, pair_sizes[some])
                    mine, where = np.unique(pair_of[_spread(pair_starts[some], pair_sizes[some])], return_inverse=True)
                    n_docs[mine] += 1
                    sha = hashlib.sha256(";".join(texts).encode()).hexdigest()
                    row = (int(times @ n_a[some]), int(times @ n_b[some]), int(times.sum()), int(each.sum()), sha, _packed(np.concatenate([np.diff(mine, prepend=0), np.bincount(where, each, len(mine))])))
            for name, value in zip(schema.names[:8], (block, doc_id, *row), strict=True):
                out[name].append(value)
        rows = pa.Table.from_pydict(out | {"number": [None] * docs.num_rows, "pair": [None] * docs.num_rows, "n_docs": [None] * docs.num_rows}, schema)
        p = len(pairs)
        counts = pa.Table.from_arrays([pa.array([block] * p, pa.int64()), *(pa.nulls(p, f.type) for f in [*schema][1:8]), pa.array(range(p), pa.int32()), pa.array(pairs), pa.array(n_docs)], schema=schema)
        return pa.concat_tables([rows, counts])

    return run


def _judge(pairs: pa.Table, docs: pa.Table) -> pa.Table:
    """The documents of one block with sums over their links: best links, and counts."""
    n = pairs.num_rows
    count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    number = pairs.column("number").to_numpy()
    count[number], best[number] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy()
    sums: dict[str, list[int]] = {"n_best": [], "count_sum": []}
    for held in docs.column("links").to_pylist():
        steps, times = _unpacked(held).astype(np.int64).reshape(2, -1)
        at = np.cumsum(steps)
        sums["n_best"].append(int(times @ best[at]))
        sums["count_sum"].append(int(times @ count[at]))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = {**{c: docs.column(c) for c in names if c not in sums}, **{k: pa.array(v, pa.int64()) for k, v in sums.items()}}
    return pa.table({c: found[c] for c in names})


def align_tokens(docs: DataFrame) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each document.

    Null and empty texts, and texts whose bytes a tokenizer changes, have no tokens: zeros and an empty
    string.  Rows that repeat, or share an id, are documents of their own; a pair's count is the number of
    such rows; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = scratch_dir(spark, "token-alignment")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = small_batches(docs).select("doc_id", "text").mapInArrow(_block_words, f"part int, block long, doc_id {kind}, words binary, number int, word string")
    rows.write.partitionBy("part").parquet(f"{folder}/blocks")
    read = lambda name, part, columns: spark.read.schema(f"{columns}, part int").parquet(f"{folder}/{name}").where(F.col("part") == part).drop("part")
    dictionary = read("blocks", 1, "block long, number int, word string")
    tokens = dictionary.repartition("word").sortWithinPartitions("word").mapInArrow(_tokenize, "part int, w long, blocks binary, numbers binary, a array<int>, a_len array<int>, b array<int>, b_len array<int>")
    tokens.write.partitionBy("part").parquet(f"{folder}/tokens")
    forget(spark, f"{folder}/blocks/part=1")
    _release(spark)
    with _by_word(spark):
        aligned_groups(read("tokens", 1, "w long, a array<int>, a_len array<int>, b array<int>, b_len array<int>")).write.parquet(f"{folder}/words")
    forget(spark, f"{folder}/tokens/part=1")
    _release(spark)
    words = spark.read.parquet(f"{folder}/words").withColumnRenamed("w", "known")
    places = read("tokens", 0, "w long, blocks binary, numbers binary")
    known = places.join(words, F.col("w") == F.col("known"), "left").select("blocks", "numbers", "groups").mapInArrow(_bundle, "block long, piece binary")
    known.write.parquet(f"{folder}/pieces")
    for done in ("tokens", "words"):
        forget(spark, f"{folder}/{done}")
    _release(spark)
    texts = read("blocks", 0, f"block long, doc_id {kind}, words binary")
    held = f"block long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, number int, pair long, n_docs long"
    pieces = spark.read.parquet(f"{folder}/pieces").groupBy("block")
    pieces.cogroup(texts.groupBy("block")).applyInArrow(_hold(_arrow_type(docs)), held).write.parquet(f"{folder}/held")
    for done in ("blocks", "pieces"):
        forget(spark, f"{folder}/{done}")
    _release(spark)
    found = spark.read.parquet(f"{folder}/held")
    pairs = found.where("number is not null").select("block", "number", "pair", "n_docs")
    counts = pairs.groupBy(F.col("pair").alias("counted")).agg(F.sum("n_docs").alias("count"))
    most = counts.groupBy(F.shiftright("counted", 32).alias("id")).agg(F.max("count").alias("most"))
    counts = counts.join(most, F.shiftright("counted", 32) == F.col("id")).select("counted", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    judged = pairs.join(counts, F.col("pair") == F.col("counted")).select("block", "number", "count", "best")
    whole = spark.read.parquet(f"{folder}/held").where("number is null").drop("number", "pair", "n_docs")
    result = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return judged.groupBy("block").cogroup(whole.groupBy("block")).applyInArrow(_judge, result)


def _arrow_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)
