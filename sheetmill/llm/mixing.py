"""Mixing sources to target weights, in DataFrame functions alone.

Every document gets a hash-random key.  Within a source the keys are range-partitioned into
fixed buckets of key space, so that a source with a third of all rows still spreads over all
tasks; the bucket sums give each bucket the token count before it, a window inside a bucket
gives each document the count before it, and the source is cut at its budget.  A budget beyond
the source's size repeats whole epochs before the cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the key that name a bucket: 3 make 4,096 buckets a source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``source, source_size`` -> the same and ``target``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of all
    sizes; a target stops at ``cap`` times its source's size and the excess is shared again by
    weight.  The fixed point of that sharing is found in one pass: ordered by size over weight,
    the capped sources come first.  The rows here are one a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weigh = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")).cast("long")
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = (
        sizes.withColumn("w", weigh)
        .withColumn("left_size", F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
        .withColumn("left_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("rank", F.row_number().over(by_ratio))
        .withColumn("capped", F.col("source_size") * cap * F.col("left_w") < F.col("w") * F.col("left_size"))
    )
    first_free = F.min(F.when(~F.col("capped"), F.struct("rank", "left_size", "left_w"))).over(whole)
    share = F.col("w").cast("double") * F.col("free.left_size").cast("double") / F.col("free.left_w").cast("double")
    return ranked.withColumn("free", first_free).select(
        "source",
        "source_size",
        F.when(F.col("rank") < F.col("free.rank"), (F.col("source_size") * cap).cast("double")).otherwise(share).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[int] = (1, 2, 3),
    cap: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row a document: its id, ``size``, ``source``, ``source_size``, ``target``, ``epochs``,
    ``cut_words`` and ``taken`` = epochs * size + cut_words, with the columns of ``keep``.

    A null text has size 0 and takes nothing; a null source is a source of its own; rows that
    repeat count as often as they occur, and among equal keys the id decides; an empty table
    gives an empty result.  Columns of ``docs`` that are not named are dropped, so their names
    can't clash.  The key is md5 of the id and the text's md5, so reruns agree whatever the partitioning, and
    documents that share an id, or have none, still spread over the buckets.
    """
    text_of = lambda c: F.coalesce(c, F.lit(""))
    units = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat(text_of(F.col(id_col).cast("string")), F.lit(":"), F.md5(text_of(F.col(text_col)).cast("binary"))).cast("binary")).alias("mix_key"),
        *[F.col(c).alias(f"keep_{c}") for c in keep],
    ).withColumn("bucket", F.substring("mix_key", 1, BUCKET_DIGITS))
    if not keep:  # slim rows: words are counted once
        units = cut(units)
    sums = cut(units.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, cap)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        sums.withColumn("bucket_before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
        .alias("b")
        .join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .select(F.col("b.source").alias("p_source"), F.col("b.bucket").alias("p_bucket"), "bucket_before", "source_size", "target")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0).cast("long"))
    before = F.col("bucket_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return (
        units.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket")))
        .withColumn("before", before)
        .withColumn("epochs", whole)
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
        .withColumn("cut_words", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("before"))))
        .select(
            "doc_id",
            "size",
            "source",
            "source_size",
            "target",
            "epochs",
            "cut_words",
            (F.col("epochs") * F.col("size") + F.col("cut_words")).alias("taken"),
            *[F.col(f"keep_{c}").alias(c) for c in keep if c not in ("doc_id", "source")],
        )
    )


def mixed_documents(docs: DataFrame, *, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The mix itself, in the columns of ``docs``: one row for each epoch in which a document is
    taken whole, and one with its first words where the budget cuts it.  A document without a
    word adds nothing to a mix and has no row."""
    others = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    mixed = mix_sources(docs, weights=weights, cap=cap, keep=["text", *others]).where("size > 0")
    # A part ends where a word ends, so that the first k parts hold the first k words.
    parts = F.split(F.col("text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    first = F.array_join(F.slice(parts, F.lit(1), F.col("cut_words").cast("int")), "")
    whole = F.col("cut_words") >= F.col("size")
    copies = F.col("epochs") + F.when((F.col("cut_words") > 0) & whole, 1).otherwise(0)
    pieces = F.concat(
        F.array_repeat(F.lit(True), copies.cast("int")),
        F.when((F.col("cut_words") > 0) & ~whole, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")),
    )
    rows = mixed.withColumn("entire", F.explode(pieces)).withColumn("text", F.when(F.col("entire"), F.col("text")).otherwise(first))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("entire"), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
