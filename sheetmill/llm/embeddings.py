"""Near-duplicate vectors by product quantisation over inverted lists.

Equal vectors are one class from the start.  A coarse quantiser (k-means of a bounded sample)
gives every class its list; codes of eight subspaces approximate the residual to the list's centre.  A
class meets every list that may hold a link of it: the triangle inequality, with the distances that
the list's members have to its centre, and the plane between two centres leave out only lists that hold
none.  Lists lie on shelves of bounded size, a larger list on several; each pair of shelves is a block,
to which either side sends those of its classes that cannot leave the other out.  There, a table of a
class's products with every code gives the distance to each stored class by eight lookups.  That distance
is off by at most the stored code's own error, so the filter with this slack drops no link; what passes is
compared by exact cosine in double precision.  So no link is lost, whatever the vectors' density.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components, local_roots

LEAST_COSINE = 0.9
#: Vectors that the quantisers are fitted on at most; lists at most.
SAMPLE, MOST_LISTS = 1 << 15, 1 << 14
SUBSPACES, CODES = 8, 256
#: Vectors of a shelf at most, which one task holds at a time, and queries compared at once.
STORED, QUERIES = 4096, 256
#: Shelves, about, that fewer vectors are dealt to; the room left for rounding where lists are left out.
SHELVES, ROUNDING = 16, 1e-6


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Centres; deterministic.  An empty cluster moves to the point that is served worst."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near, far = nearest(x, centres, 1)
        near = near[:, 0]
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        size = np.bincount(near, minlength=k)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
        empty = np.flatnonzero(size == 0)
        if len(empty):
            centres[empty] = x[np.argsort(-far[:, 0], kind="stable")[: len(empty)]]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, k: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest centres of each row, nearest first, and their squared distances less |x|^2."""
    k = min(k, len(centres))
    square = (centres * centres).sum(axis=1)
    ids, far = np.empty((len(x), k), np.int64), np.empty((len(x), k))
    for a in range(0, len(x), block):
        d = square - 2 * (x[a : a + block] @ centres.T)
        some = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(centres) else np.tile(np.arange(k), (len(d), 1))
        value = np.take_along_axis(d, some, axis=1)
        order = np.lexsort((some, value), axis=1)
        ids[a : a + block] = np.take_along_axis(some, order, axis=1)
        far[a : a + block] = np.take_along_axis(value, order, axis=1)
    return ids, far


class Quantiser:
    """Coarse centres and the codes of residuals' subspaces, of unit vectors."""

    def __init__(self, sample: np.ndarray, total: int):
        lists = max(1, min(len(sample), MOST_LISTS, int(2 * np.sqrt(total))))
        self.centres = kmeans(sample, lists)
        dim = sample.shape[1]
        self.edges = np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int)
        residual = sample - self.centres[nearest(sample, self.centres, 1)[0][:, 0]]
        self.books = [kmeans(np.ascontiguousarray(residual[:, a:b]), min(CODES, len(sample)), 5) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the error of each row's approximation."""
        codes = np.empty((len(residual), len(self.books)), np.int64)
        error = np.zeros(len(residual))
        for m, (a, b) in enumerate(zip(self.edges[:-1], self.edges[1:], strict=True)):
            codes[:, m] = nearest(residual[:, a:b], self.books[m], 1)[0][:, 0]
            error += ((residual[:, a:b] - self.books[m][codes[:, m]]) ** 2).sum(axis=1)
        return codes, np.sqrt(error)

    def distances(self, residual: np.ndarray, codes: np.ndarray, lists: np.ndarray | None = None) -> np.ndarray:
        """Asymmetric: from each query's residual to each code row, by table lookup; with the code rows'
        ``lists``, from each query itself to each list's centre with the code added."""
        total = np.zeros((len(residual), len(codes)))
        for m, (a, b) in enumerate(zip(self.edges[:-1], self.edges[1:], strict=True)):
            part = residual[:, a:b]
            table = (part * part).sum(axis=1)[:, None] - 2 * part @ self.books[m].T + (self.books[m] ** 2).sum(axis=1)
            total += np.take(table, codes[:, m], axis=1)
        if lists is not None:
            # |x - c - q|^2 = |x - q|^2 - 2 x c + c (c + 2 q)
            some, at = np.unique(lists, return_inverse=True)
            own = np.zeros(len(codes))
            for m, (a, b) in enumerate(zip(self.edges[:-1], self.edges[1:], strict=True)):
                c = self.centres[lists, a:b]
                own += (c * (c + 2 * self.books[m][codes[:, m]])).sum(axis=1)
            total += own
            total -= np.take(2 * residual @ self.centres[some].T, at, axis=1)
        return np.sqrt(np.maximum(total, 0))


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Shelves:
    """Where the lists lie, and how far their members are from their centres."""

    def __init__(self, q: Quantiser, lists: np.ndarray, size: np.ndarray, least: np.ndarray, most: np.ndarray, room: int):
        shelves = -(-int(size.sum()) // room)
        # Near lists share a shelf.
        group = nearest(q.centres[lists], kmeans(q.centres[lists], min(len(lists), shelves)), 1)[0][:, 0]
        self.base, self.chunks = np.zeros(len(q.centres), np.int64), np.zeros(len(q.centres), np.int64)
        entries, shelf, used = [], -1, room
        for k in np.lexsort((lists, group)).tolist():
            n = -(-int(size[k]) // room)
            if n > 1 or used + size[k] > room:
                shelf, used = shelf + 1, 0
            self.base[lists[k]], self.chunks[lists[k]] = shelf, n
            entries += [lists[k]] * n
            used += size[k]
            if n > 1:
                shelf, used = shelf + n - 1, room
        self.entries = np.array(entries)
        first = np.concatenate(([True], self.entries[1:] != self.entries[:-1]))
        within = np.arange(len(entries)) - np.maximum.accumulate(np.where(first, np.arange(len(entries)), 0))
        self.begins = np.flatnonzero(np.diff(self.base[self.entries] + within, prepend=-1))
        self.least, self.most = np.full(len(q.centres), np.inf), np.full(len(q.centres), -np.inf)
        self.least[lists], self.most[lists] = least, most


def reachable(q: Quantiser, shelves: Shelves, x: np.ndarray, own: np.ndarray, lists: np.ndarray, reach: float) -> np.ndarray:
    """For each row of ``x``, of list ``own``, and each of ``lists``: whether the list may hold a
    vector within ``reach``."""
    c, home = q.centres[lists], q.centres[own]
    far = np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * x @ c.T, 0)
    apart = np.sqrt(np.maximum((home * home).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * home @ c.T, 0))
    # A list's members are nearer to its centre than to ours: they lie behind the plane between the two.
    plane = far - ((x - home) ** 2).sum(axis=1)[:, None] <= 2 * (apart + ROUNDING) * (reach + ROUNDING) + ROUNDING
    far = np.sqrt(far)
    return plane & (far <= shelves.most[lists] + reach + ROUNDING) & (far >= shelves.least[lists] - reach - ROUNDING)


def _compare(model, layout, reach: float, least: float):
    """Rows by (low, high, role): the classes of a block's lower shelf, then those of its higher; a shelf's
    block with itself has the first alone."""

    class Side:
        def __init__(self, q: Quantiser, batches: list[pa.RecordBatch]):
            self.x = np.concatenate([_unit(b.column("embedding")) for b in batches])
            self.node = [n for b in batches for n in b.column("node").to_pylist()]
            self.weight = np.concatenate([b.column("n").to_numpy() for b in batches])
            self.own = np.concatenate([b.column("own").to_numpy() for b in batches])
            self.lists, self.at = np.unique(self.own, return_inverse=True)
            self.codes, self.error = q.encode(self.x - q.centres[self.own])

    def links(y: Side, x: np.ndarray, names: list[bytes], weight: np.ndarray, own: np.ndarray, begin: int | None) -> Iterator[pa.RecordBatch]:
        """Of queries with ``y``; where they are its own rows from ``begin`` on, with those behind them."""
        q = model.value
        some = np.flatnonzero(reachable(q, layout.value, x, own, y.lists, reach).any(axis=0)[y.at])
        if begin is not None:
            some = np.union1d(some[some >= begin], np.arange(begin, begin + len(x)))
        if not len(some):
            return
        i, j = np.nonzero(q.distances(x, y.codes[some], y.own[some]) <= reach + y.error[some] + ROUNDING)
        j = some[j]
        if begin is not None:
            i, j = i[j > i + begin], j[j > i + begin]
        linked = np.concatenate([np.einsum("ij,ij->i", x[i[a : a + 65536]], y.x[j[a : a + 65536]]) >= least for a in range(0, len(i), 65536)] or [np.zeros(0, bool)])
        i, j = i[linked], j[linked]
        if not len(i):
            return
        here = np.bincount(i, y.weight[j], len(names)).astype(np.int64)
        back = np.bincount(j, weight[i], len(y.node)).astype(np.int64)
        all_ = names + y.node
        root = local_roots(len(all_), i, j + len(names))
        count = np.concatenate((here, back))
        at = np.flatnonzero((count > 0) | (root != np.arange(len(all_))))
        yield pa.RecordBatch.from_arrays(
            [pa.array([all_[k] for k in at.tolist()], pa.binary()), pa.array(count[at]), pa.array([all_[k] for k in root[at].tolist()], pa.binary())],
            names=["node", "links", "other"],
        )

    def inside(y: Side) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(y.x), QUERIES):
            b = a + QUERIES
            yield from links(y, y.x[a:b], y.node[a:b], y.weight[a:b], y.own[a:b], a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = model.value

        def pieces() -> Iterator[tuple[tuple[int, int, int], pa.RecordBatch]]:
            for batch in batches:
                keys = np.stack([batch.column(c).to_numpy() for c in ("low", "high", "role")], axis=1)
                edge = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True])))
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    if b > a:
                        yield tuple(keys[a].tolist()), batch.slice(a, b - a)

        stored: list[pa.RecordBatch] = []
        side, at = None, None
        for (low, high, role), piece in pieces():
            if (low, high) != at:
                if stored and at[0] == at[1]:
                    yield from inside(Side(q, stored))
                at, stored, side = (low, high), [], None
            if role == 0:
                stored.append(piece)
            elif stored:
                side = side or Side(q, stored)
                for a in range(0, piece.num_rows, QUERIES):
                    part = piece.slice(a, QUERIES)
                    yield from links(side, _unit(part.column("embedding")), part.column("node").to_pylist(), part.column("n").to_numpy(), part.column("own").to_numpy(), None)
        if stored and at[0] == at[1]:
            yield from inside(Side(q, stored))

    return run


def _assign(model):
    """Each class's list, and its distance to the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, centres = _unit(batch.column("embedding")), model.value.centres
                own = nearest(x, centres, 1)[0][:, 0]
                far = np.sqrt(((x - centres[own]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(far)], names=[*batch.schema.names, "own", "far"])

    return run


def _deal(model, layout, reach: float):
    """Each class once for every block that it may have a link in, its own shelf's with itself included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, shelves = model.value, layout.value
        rows = max(1, min((1 << 20) // len(shelves.entries), (1 << 15) // len(shelves.begins)))
        for whole in batches:
            for a in range(0, whole.num_rows, rows):
                batch = whole.slice(a, rows)
                own = batch.column("own").to_numpy()
                hit = reachable(q, shelves, _unit(batch.column("embedding")), own, shelves.entries, reach)
                hit = np.logical_or.reduceat(hit, shelves.begins, axis=1)
                digest = np.array([int.from_bytes(n[:7], "little") for n in batch.column("node").to_pylist()])
                home = shelves.base[own] + digest % shelves.chunks[own]
                hit[np.arange(len(home)), home] = True
                i, other = np.nonzero(hit)
                sent = batch.take(pa.array(i))
                keys = [np.minimum(home[i], other), np.maximum(home[i], other), home[i] > other]
                yield pa.RecordBatch.from_arrays([*(pa.array(k.astype(np.int32)) for k in keys), *sent.columns], names=["low", "high", "role", *sent.schema.names])

    return run


def class_links(classes: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``node, links, other``: how many vectors (copies counted by ``n``) of other classes link
    with a class, in parts to be summed, and edges that join what links join.

    ``classes``: ``node, embedding, n``, all of one dimension."""
    spark = classes.sparkSession
    total = classes.count()
    # A bounded sample, the same in each run: the lowest digests.
    sample = classes.orderBy("node").limit(SAMPLE).select("embedding").toArrow().column("embedding")
    quantiser = Quantiser(_unit(sample.combine_chunks()), total)
    model = spark.sparkContext.broadcast(quantiser)
    reach = float(np.sqrt(2 - 2 * least)) + 1e-9
    kind = classes.schema["embedding"].dataType.simpleString()
    row = f"node binary, embedding {kind}, n long, own int"
    assigned = cut(classes.select("node", "embedding", "n").mapInArrow(_assign(model), f"{row}, far double"))
    found = assigned.groupBy("own").agg(F.count(F.lit(1)).alias("size"), F.min("far"), F.max("far")).orderBy("own").collect()
    lists, size, nearest_, farthest = (np.array(c) for c in zip(*found, strict=True))
    layout = spark.sparkContext.broadcast(Shelves(quantiser, lists, size, nearest_, farthest, max(1, min(STORED, max(QUERIES, -(-total // SHELVES))))))
    return (
        assigned.select("node", "embedding", "n", "own")
        .mapInArrow(_deal(model, layout, reach), f"low int, high int, role int, {row}")
        .repartition("low", "high")
        .sortWithinPartitions("low", "high", "role", "own")
        .mapInArrow(_compare(model, layout, reach, least), "node binary, links long, other binary")
    )


def near_vectors(vectors: DataFrame, *, least: float = LEAST_COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row a vector.

    Vectors link when their cosine is at least ``least``; those that are null, zero or hold null
    or non-finite components link with nothing, and neither do vectors of different dimension.
    Rows that repeat are vectors of their own; an empty table gives an empty result; other columns
    are ignored.
    """
    rows = vectors.select("vec_id", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    node = F.unhex(F.md5(F.concat_ws(",", F.transform("embedding", lambda x: x.cast("string"))).cast("binary")))
    named = rows.withColumn("node", F.when(good, node))
    classes = cut(
        named.where("node is not null").groupBy("node").agg(F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))
    )
    dims = sorted(r[0] for r in classes.select(F.size("embedding")).distinct().collect())
    links = None
    for dim in dims:
        some = class_links(classes.where(F.size("embedding") == dim), least)
        links = some if links is None else links.union(some)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = cut(links)
    counts = links.groupBy(F.col("node").alias("l_node")).agg(F.sum("links").alias("links"))
    roots = components(links, "node", "other").select(F.col("node").alias("r_node"), "root")
    joined = cut(
        classes.drop("embedding")
        .join(counts, F.col("node") == F.col("l_node"), "left")
        .join(roots, F.col("node") == F.col("r_node"), "left")
        .select("node", "first_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    # Cut before it is joined back, so that a large component is split over tasks.
    least_id = cut(joined.groupBy("root").agg(F.min("first_id").alias("component_id")))
    found = joined.join(least_id, "root").select(F.col("node").alias("f_node"), "n_links", "component_id")
    component = F.when(F.col("f_node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return (
        named.drop("embedding")
        .join(found, F.col("node") == F.col("f_node"), "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
    )
