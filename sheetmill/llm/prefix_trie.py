"""Conversation prefix trie by prefix-doubling names.

Turns are named by their digests; then, in rounds, so are blocks of 2, 4, 8, ... turns that begin at multiples of
their length, each by the digest of its halves' names.  A prefix of d turns is made of the blocks of d's
binary decomposition, longest first.  A block of s turns that ends at e is the last of its length in the prefixes of
e to e + s - 1 turns, so each block goes out to these depths and meets the prefix's others there, in one
aggregate.  Nodes of the trie are groups of equal depth and prefix name.

Names need no table of their own and no join, so that a round is one aggregate; the driver's memory goes with the
number of plans.

Sums over a node's subtree need no walk: every node is charged to its smallest member, so a subtree's sum
is that of its members' own charges from the node's depth on, which is a suffix sum along each conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Every how many conversation ids one is the base of the following, and the most turns that are borrowed and one.
FAMILY = 5
BORROWED = 9
#: Depths of a conversation that one window or one list holds; sums are carried on between windows.
STRETCH = 4096
#: Ids that one row of a node's list of ends holds.
ENDS = 1 << 16


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` cut, with dense numbers from 0 on in the order of its partitions and of the rows in them."""
    rows = cut(df.withColumn("row_at", F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.shiftright("row_at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, total = [0] * (max((r["part"] for r in sizes), default=0) + 1), 0
    for r in sorted(sizes):
        offsets[r["part"]], total = total, total + r["n"]
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets]), (F.shiftright("row_at", 33) + 1).cast("int"))
    return rows.withColumn(name, start + F.col("row_at").bitwiseAND((1 << 33) - 1)).drop("row_at")


def borrowed_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from its base: crc32 of its id as text, modulo 9."""
    return F.crc32(conv_id.cast("string").cast("binary")) % BORROWED


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, i, turn_key, n_bytes``: the turns in order, from 0 on.  Null roles and texts are empty, a null
    turn comes first, and turns of the same number follow each other by role and text digest.

    The order is that of one range sort over all rows, so a conversation of any length is split."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", key.alias("turn_key"), F.octet_length(text).cast("long").alias("n_bytes"), role.alias("role"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "turn_key"]
    rows = _numbered(cut(turns).repartitionByRange(*order).sortWithinPartitions(*order).drop("turn", "role"), "at")
    first = rows.groupBy(F.col("conv_id").alias("c")).agg(F.min("at").alias("first"))
    return rows.join(first, F.col("conv_id") == F.col("c")).select("conv_id", (F.col("at") - F.col("first")).alias("i"), "turn_key", "n_bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``c, d, name, n_bytes, n``: the turns of the rebuilt conversations by depth from 1 on; and ``c, n``: the
    number of turns of each.  ``turns`` has ``conv_id, i, name, n_bytes``; ``c % 5`` is SQL's remainder."""
    own = turns.groupBy(F.col("conv_id").alias("c")).agg(F.count(F.lit(1)).alias("own"))
    base = own.select(F.col("c").alias("b"), F.col("own").alias("base"))
    sizes = own.join(base, F.col("c") - F.col("c") % FAMILY == F.col("b"), "left").withColumn("h", borrowed_turns(F.col("c")))
    sizes = cut(sizes.select("c", "h", F.least("h", F.coalesce("base", F.lit(0))).alias("m"), "own"))
    turns_of = F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    lent = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("i") < BORROWED - 1)).withColumn("x", F.explode(F.sequence(F.lit(1 - FAMILY), F.lit(FAMILY - 1))))
    lent = lent.withColumn("x", F.col("conv_id") + F.col("x")).where((F.col("x") - F.col("x") % FAMILY == F.col("conv_id")) & (F.col("i") < borrowed_turns(F.col("x"))))
    kept = turns.withColumn("x", F.col("conv_id")).where(F.col("i") >= borrowed_turns(F.col("conv_id")))
    rows = lent.withColumn("lent", F.lit(True)).unionByName(kept.withColumn("lent", F.lit(False)))
    depth = F.when(F.col("lent"), F.col("i") + 1).otherwise(F.col("i") - F.col("h") + F.col("m") + 1)
    placed = rows.join(sizes, F.col("x") == F.col("c")).select("c", depth.alias("d"), "name", "n_bytes", turns_of.alias("n"))
    return cut(placed), sizes.select("c", turns_of.alias("n"))


def _digested(names: Column) -> Column:
    return F.unhex(F.sha2(names, 256))


def prefix_names(turns: DataFrame) -> DataFrame:
    """``c, d, n, n_bytes, prefix``: equal for conversations whose first d turns have equal names, from
    ``c, d, name, n_bytes, n`` rows.

    ``tail`` is the name of the block that ends at ``e``, of the length of e's lowest set bit."""
    deepest = turns.agg(F.max("d")).first()[0] or 0
    blocks, tails = turns.select("c", (F.col("d") - 1).alias("j"), "name", "n_bytes", "n"), []
    for size in (1 << k for k in range(max(1, deepest.bit_length()))):
        tails.append(blocks.where("j % 2 = 0").select("c", ((F.col("j") + 1) * size).alias("e"), F.lit(size).cast("long").alias("size"), F.col("name").alias("tail"), "n_bytes", "n"))
        if 2 * size > deepest:
            break
        half = lambda k, c: F.max(F.when(F.col("j") % 2 == k, F.col(c)))
        pairs = blocks.groupBy("c", F.shiftright("j", 1).alias("k")).agg(half(0, "name").alias("left"), half(1, "name").alias("right"), half(1, "n_bytes").alias("n_bytes"), F.max("n").alias("n"))
        blocks = cut(pairs.where("right is not null").select("c", F.col("k").alias("j"), _digested(F.concat("left", "right")).alias("name"), "n_bytes", "n"))
    last = F.least(F.col("e") + F.col("size") - 1, F.col("n"))
    reached = reduce(DataFrame.unionByName, tails).withColumn("from", F.explode(F.sequence("e", last, F.lit(STRETCH).cast("long"))))
    reached = reached.withColumn("d", F.explode(F.sequence("from", F.least(F.col("from") + STRETCH - 1, last))))
    own = F.max(F.when(F.col("e") == F.col("d"), F.col("n_bytes")))
    found = reached.groupBy("c", "d").agg(F.max("n").alias("n"), own.alias("n_bytes"), F.array_sort(F.collect_list(F.struct("e", "tail"))).alias("blocks"))
    joined = F.aggregate("blocks", F.lit(b""), lambda names, block: F.concat(names, block.tail))
    return found.select("c", "d", "n", "n_bytes", _digested(joined).alias("prefix"))


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one node, sorted by id, as rows of at most ``ENDS`` ids joined by commas."""
    for batch in batches:
        node, ids = batch.column("node").to_pylist(), batch.column("c").to_pylist()
        starts = [k for k in range(len(ids)) if k == 0 or node[k] != node[k - 1] or k % ENDS == 0]
        ends = [*starts[1:], len(ids)]
        lists = [",".join(map(str, ids[a:b])) for a, b in zip(starts, ends, strict=True)]
        yield pa.RecordBatch.from_pydict({"node": [node[a] for a in starts], "first": [ids[a] for a in starts], "ids": lists}, pa.schema([("node", pa.string()), ("first", pa.int64()), ("ids", pa.string())]))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node of its rows' lists, one after another; only the digest's state is held."""
    node, state = None, None
    schema = pa.schema([("node", pa.string()), ("ends_sha256", pa.string())])
    for batch in batches:
        found: dict[str, list[str]] = {"node": [], "ends_sha256": []}
        for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if name != node:
                if state is not None:
                    found["node"].append(node)
                    found["ends_sha256"].append(state.hexdigest())
                node, state = name, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pydict(found, schema)
    if state is not None:
        yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [state.hexdigest()]}, schema)


def ends_digests(ends: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of rows ``node, c``.  Lists are joined where a range sort has put their ids, and what
    passes one task for a node with very many ends are a few long pieces, which are digested as they come."""
    pieces = ends.repartitionByRange("node", "c").sortWithinPartitions("node", "c").mapInArrow(_join_ids, "node string, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digest, "node string, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, one row a node: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Rows without a conversation id belong to no conversation and make no node; rows that repeat are turns of
    their own; an empty table gives an empty result (no root); other columns are ignored.
    """
    # SQL's numbering needs rows by (c, d); depth 0 is the root, of which every conversation is a member.
    turns, sizes = rebuilt(cut(ordered_turns(small_batches(conversations)).withColumnRenamed("turn_key", "name")))
    roots = sizes.select("c", F.lit(0).cast("long").alias("d"), "n", F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("prefix"))
    rows = cut(prefix_names(turns).unionByName(roots))

    nodes = rows.groupBy(F.col("d").alias("node_d"), F.col("prefix").alias("node_prefix")).agg(
        F.min("c").alias("first"), (F.max("n_bytes") * (F.count(F.lit(1)) - 1)).alias("saved"), (F.max("n") == F.col("d")).alias("leaf")
    )
    rows = cut(
        rows.join(cut(nodes), (F.col("d") == F.col("node_d")) & (F.col("prefix") == F.col("node_prefix")))
        .withColumn("own", F.col("c") == F.col("first"))
        .select("c", "d", "n", "first", "own", F.when(F.col("own"), F.col("saved")).otherwise(0).alias("saved"), (F.col("own") & F.col("leaf")).cast("long").alias("leaf"))
        .withColumn("stretch", F.floor(F.col("d") / STRETCH))
    )
    node = F.concat_ws(":", "conv_id", "depth")
    ends = ends_digests(rows.where("d = n").select(F.concat_ws(":", "first", "d").alias("node"), "c")).withColumnRenamed("node", "end_node")
    # The depth up to which the nodes are others', and the last of these others: the own nodes' parent.
    others = F.when(~F.col("own"), F.struct("d", "first"))
    parts = rows.groupBy("c", "stretch").agg(F.max(others).alias("hang"), F.sum("saved").alias("part"), F.sum("leaf").alias("leaves"))
    along = Window.partitionBy("c")
    later = along.orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(
        parts.select(
            F.col("c").alias("part_c"), F.col("stretch").alias("part_stretch"), F.max("hang").over(along).alias("hang"),
            F.sum("leaves").over(along).alias("leaves"), F.coalesce(F.sum("part").over(later), F.lit(0)).alias("later"),
        )
    )
    inside = Window.partitionBy("c", "stretch").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("saved").over(inside)).join(parts, (F.col("c") == F.col("part_c")) & (F.col("stretch") == F.col("part_stretch")))
    hang = F.coalesce(F.col("hang.d"), F.lit(-1))
    parent = F.when(F.col("d") > hang + 1, F.col("c")).otherwise(F.col("hang.first"))
    trie = rows.groupBy(F.col("first").alias("conv_id"), F.col("d").alias("depth")).agg(
        F.max(F.when(F.col("own") & (F.col("d") > 0), parent)).alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(((F.col("d") >= hang) & (F.col("d") < F.col("n"))).cast("long")).alias("n_children"),
        F.sum("leaves").alias("n_leaves"),
        F.sum(F.col("inside") + F.col("later")).alias("saved_tokens"),
    )
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return trie.join(ends, node == F.col("end_node"), "left").drop("end_node").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
