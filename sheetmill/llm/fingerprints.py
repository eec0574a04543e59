"""Document fingerprints as invertible Bloom lookup tables of paragraph digests.

A text is cut into paragraphs at line ends, and long paragraphs further behind words that their own
bytes choose, so that an edit changes only the pieces it touches.  The set of the pieces' 64-bit
digests goes into a table: each digest into one cell of each of three subtables, cells holding
a count, the sum of digests and the sum of their check values.  Tables of two versions subtract cell
by cell; what only one version holds is left, and is peeled off cells that hold a single digest.
Where peeling gets stuck, larger tables are tried.  The fingerprint that is written out is the
smallest table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Cells of a subtable of the smallest table, and the factor of the next larger one.
CELLS, LARGER = 4, 4
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
_CELL = np.dtype([("count", "<i4"), ("digest", "<u8"), ("check", "<u8")])


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        out = np.full(1 << n.bit_length(), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[base]


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9FB21C651E98DF25 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def piece_digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct digests of the texts' pieces in a row, and where each text's begin (n + 1 edges)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    # A piece ends with a line end, or with a space behind a word whose last four bytes choose it;
    # the four lie in the space's own text, so that equal texts are cut alike behind any other.
    space = np.flatnonzero(data == 32)
    space = space[space - edges[np.searchsorted(edges, space, "right") - 1] >= 4]
    word = sum(data[space - k].astype(np.uint64) << np.uint64(8 * k - 8) for k in (1, 2, 3, 4))
    chosen = space[_mix(word, 1) >> np.uint64(61) == 0]
    ends = np.union1d(np.concatenate((np.flatnonzero(data == 10), chosen)) + 1, edges[1:][sizes > 0])
    starts = np.concatenate(([0], ends[:-1]))
    before = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[:n], dtype=np.uint64)))
    digest = _mix((before[ends] - before[starts]) * _powers(_INVERSE, n)[starts], 2)
    text = np.searchsorted(edges, starts, "right") - 1
    order = np.lexsort((digest, text))
    digest, text = digest[order], text[order]
    first = np.concatenate(([True], (digest[1:] != digest[:-1]) | (text[1:] != text[:-1])))
    return digest[first], np.concatenate(([0], np.cumsum(np.bincount(text[first], minlength=len(texts)))))


def _place(digest: np.ndarray, table: np.ndarray, cells: int, j: int) -> np.ndarray:
    x = _mix(digest, 16 * cells + j + 3) >> np.uint64(32)
    return (table * 3 + j) * cells + (x * np.uint64(cells) >> np.uint64(32)).astype(np.int64)


def tables(digest: np.ndarray, table: np.ndarray, sign: np.ndarray, count: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``count`` tables: the counts, digest sums and check sums of their cells, each digest added
    (sign 1) to or taken (-1) from its table."""
    counts, sums, checks = (np.zeros(count * 3 * cells, t) for t in (np.int64, np.uint64, np.uint64))
    _add(counts, sums, checks, digest, table, sign, cells)
    return counts, sums, checks


def _add(counts, sums, checks, digest, table, sign, cells) -> None:
    times = sign.astype(np.uint64)  # minus one wraps round
    value, check = digest * times, _mix(digest, 99) * times
    for j in range(3):
        at = _place(digest, table, cells, j)
        np.add.at(counts, at, sign)
        np.add.at(sums, at, value)
        np.add.at(checks, at, check)


def peel(counts: np.ndarray, sums: np.ndarray, checks: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The digests in the tables, which are emptied, their tables and sides; none of those where peeling
    gets stuck, and which these are."""
    got = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    progress = True
    while progress:
        progress = False
        for j in range(3):
            single = np.flatnonzero(np.abs(counts.reshape(-1, 3, cells)[:, j, :].ravel()) == 1)
            at = (single // cells * 3 + j) * cells + single % cells
            side = counts[at]
            key = sums[at] * side.astype(np.uint64)
            pure = _mix(key, 99) * side.astype(np.uint64) == checks[at]
            if pure.any():
                progress = True
                key, side, table = key[pure], side[pure], single[pure] // cells
                _add(counts, sums, checks, key, table, -side, cells)
                got.append((key, table, side))
    stuck = (counts.reshape(-1, 3 * cells) != 0).any(axis=1) | (sums.reshape(-1, 3 * cells) != 0).any(axis=1)
    key, table, side = (np.concatenate(x) for x in zip(*got, strict=True))
    good = ~stuck[table]
    return key[good], table[good], side[good], stuck


def differences(a: np.ndarray, a_of: np.ndarray, b: np.ndarray, b_of: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of digest sets, ``a`` of pair ``a_of`` and ``b`` of ``b_of``: the digests that one
    side alone holds, their pairs, and 1 or -1 for the side."""
    digest, sign = np.concatenate((a, b)), np.repeat(np.array([1, -1]), [len(a), len(b)])
    pair = np.concatenate((a_of, b_of))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    open_, cells = np.arange(pairs), CELLS
    while len(open_):
        number = np.full(pairs, -1)
        number[open_] = np.arange(len(open_))
        in_open = number[pair] >= 0
        key, table, side, stuck = peel(*tables(digest[in_open], number[pair[in_open]], sign[in_open], len(open_), cells), cells)
        found.append((key, open_[table], side))
        open_, cells = open_[stuck], cells * LARGER
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def stored_differences(a: str, b: str) -> tuple[list[int], list[int]] | None:
    """The digests that only the first and only the second of two fingerprints with equally large tables
    hold; none where they differ in too many to tell, and strings of tables ``LARGER`` times as large are
    to be asked for."""
    x, y = (np.frombuffer(bytes.fromhex(s.partition(":")[2]), _CELL) for s in (a, b))
    if len(x) != len(y):
        raise ValueError("fingerprints have tables of one size")
    counts = x["count"].astype(np.int64) - y["count"]
    key, _, side, stuck = peel(counts, x["digest"] - y["digest"], x["check"] - y["check"], len(x) // 3)
    return None if stuck[0] else (sorted(key[side == 1].tolist()), sorted(key[side == -1].tolist()))


def fingerprint_strings(digest: np.ndarray, edges: np.ndarray, subtable: int = CELLS) -> list[str]:
    """A table of each set, the smallest unless told otherwise: the set's size, then its cells, in hex."""
    n = len(edges) - 1
    of = np.repeat(np.arange(n), np.diff(edges))
    cells = np.zeros((n, 3 * subtable), _CELL)
    counts, sums, checks = tables(digest, of, np.ones(len(digest), np.int64), n, subtable)
    for name, value in (("count", counts), ("digest", sums), ("check", checks)):
        cells[name] = value.reshape(n, -1)
    return [f"{k:x}:{row.tobytes().hex()}" for k, row in zip(np.diff(edges).tolist(), cells, strict=True)]


def likeness(digest: np.ndarray, edges: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of the sets ``left[i]`` and ``right[i]``: shared digests over all, from their tables' difference."""
    sizes = np.diff(edges)

    def of(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = sizes[side]
        within = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        return digest[np.repeat(edges[side], k) + within], np.repeat(np.arange(len(side)), k)

    _, pair, _ = differences(*of(left), *of(right), len(left))
    apart, total = np.bincount(pair, minlength=len(left)), sizes[left] + sizes[right]
    return np.where(total > 0, (total - apart) / np.maximum(1, total + apart), 1.0)


def edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _rows(held: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """``held``: id, text, next text."""
    n = len(held)
    changed = [edited(text, following).encode() for _, text, following in held]
    digest, edges = piece_digests([h[1].encode() for h in held] + changed + [h[2].encode() for h in held])
    strings = fingerprint_strings(digest[: edges[2 * n]], edges[: 2 * n + 1])
    at = np.arange(n)
    near = likeness(digest, edges, np.concatenate((at, at)), np.concatenate((at + n, at + 2 * n)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([h[0] for h in held], kind),
            pa.array([len(h[1]) for h in held], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
            pa.array(strings[:n]),
            pa.array(strings[n:]),
            pa.array(near[:n]),
            pa.array(near[n:]),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (part, tail, id): a part's documents, each met by its next, then the first of the
    next part, which only meets the last."""
    held: list[tuple] = []
    size, last, kind = 0, None, None
    for batch in batches:
        kind = batch.column("doc_id").type
        for part, tail, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "tail", "doc_id", "text")), strict=True):
            text = text or ""
            if last and last[0] == part:
                held.append((last[1], last[2], text))
                size += len(last[2]) + len(text)
                if size > 1 << 20:
                    yield _rows(held, kind)
                    held, size = [], 0
            # Behind a tail nothing is left to meet.
            last = None if tail else (part, doc_id, text)
    if held:
        yield _rows(held, kind)


def compare_versions(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    A document's edited text has its last quarter (floor of code points / 4) replaced by the first
    as many code points of the next document by id, and after the last comes the first.  A null text is
    empty; two texts without any piece are alike (1.0); rows that share an id follow each other by
    their text's hash; a null id comes first; an empty table gives an empty result; other columns
    are ignored.  ``doc_id`` is a whole number.
    """
    spark = docs.sparkSession
    rows = small_batches(docs).select("doc_id", "text")
    # Several parts a task, so that tasks come out even.
    parts = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / parts for i in range(1, parts)]
    ids = rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("at"))
    bounds = ids.agg(F.percentile_approx("at", shares, 20 * parts)).first()[0] if shares else None
    bounds = np.unique(np.array(bounds or [], np.int64))

    def part_of(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, at, "right")

    @F.pandas_udf("int")
    def part(at: pd.Series) -> pd.Series:
        return pd.Series(part_of(at.to_numpy()))

    # The first id of each part: as many as there are parts.
    firsts = sorted((r["part"], r["at"]) for r in ids.groupBy(part("at").alias("part")).agg(F.min("at").alias("at")).collect())
    before = {at: firsts[k - 1][0] for k, (_, at) in enumerate(firsts)}
    leads = np.array([at for _, at in firsts], np.int64)

    @F.pandas_udf("array<int>")
    def places(at: pd.Series) -> pd.Series:
        """The part of a row, and where it is the first of its part, the part before as well."""
        values = at.to_numpy()
        own = part_of(values)
        lead = np.isin(values, leads)
        return pd.Series([[p, before[a]] if f else [p] for p, a, f in zip(own.tolist(), values.tolist(), lead.tolist(), strict=True)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = (
        rows.withColumn("at", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
        .withColumn("places", places("at"))
        .select("doc_id", "text", "at", F.posexplode("places").alias("tail", "part"))
    )
    return (
        dealt.repartition("part")
        .sortWithinPartitions("part", "tail", "at", F.xxhash64("text"))
        .select("part", "tail", "doc_id", "text")
        .mapInArrow(
            _walk,
            f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
        )
    )
