"""Manifests, splits and metrics of training runs."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def manifest_stats(rows: DataFrame) -> DataFrame:
    """Row counts by label, split, section and split with label, and of distinct images in all."""
    return rows.sparkSession.sql(
        """
        SELECT CASE WHEN grouping(gt_label) = 0 AND grouping(split) = 0 THEN 'split:label'
                    WHEN grouping(gt_label) = 0 THEN 'label' WHEN grouping(split) = 0 THEN 'split'
                    WHEN grouping(section) = 0 THEN 'section' ELSE 'all' END AS kind,
               coalesce(concat_ws(':', split, gt_label, section), '') AS name, count(*) AS n, count(DISTINCT image_id) AS n_images
        FROM {rows} GROUP BY GROUPING SETS ((gt_label), (split), (section), (split, gt_label), ())
        """,
        rows=rows,
    )


def balanced_weights(rows: DataFrame, label: str = "gt_label") -> DataFrame:
    """Each row's sampling weight: one over the number of rows of its label.

    Labels are few and may be very uneven, so their counts are joined rather than windowed."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(counts, rows[label].eqNullSafe(counts[label])).drop(counts[label]).withColumn("weight", 1.0 / F.col("_n")).drop("_n")


def confusion(rows: DataFrame, names: Sequence[str], target: str = "target", predicted: str = "pred") -> DataFrame:
    """Counts of each target by prediction, and the recall of each target (null without support)."""
    table = rows.groupBy(target).agg(*[F.count(F.when(F.col(predicted) == n, 1)).alias(f"pred_{n}") for n in names])
    every = rows.sparkSession.createDataFrame([(n,) for n in names], f"{target} string")
    filled = every.join(table, target, "left").select(target, *[F.coalesce(f"pred_{n}", F.lit(0)).alias(f"pred_{n}") for n in names])
    support = sum((F.col(f"pred_{n}") for n in names[1:]), F.col(f"pred_{names[0]}"))
    right = F.coalesce(*[F.when(F.col(target) == n, F.col(f"pred_{n}")) for n in names])
    return filled.withColumn("recall", F.when(support > 0, F.round(right / support, 6)))


def pixel_metrics(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``batch_id, channel, dice, mse`` from ``logit`` and ``target``; dice is one of its batch."""
    prob = 1 / (1 + F.exp(-F.col("logit")))
    high, hit = (prob >= threshold).cast("double"), (F.col("target") >= threshold).cast("double")
    return rows.groupBy("batch_id", "channel").agg(
        F.round((2 * F.sum(high * hit) + 1) / (F.sum(high) + F.sum(hit) + 1), 6).alias("dice"),
        F.round(F.avg((prob - F.col("target")) * (prob - F.col("target"))), 6).alias("mse"),
    )


def layout_loss(rows: DataFrame, pos_weights: dict[str, float], dice_weight: float = 1.0, mse_weight: float = 0.25) -> DataFrame:
    """One loss a batch: weighted cross-entropy, soft dice and squared error of the probabilities."""
    x, t = F.col("logit"), F.col("target")
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in pos_weights.items() for v in kv]), F.col("channel")), F.lit(1.0))
    soft_plus = F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))
    bce = (1 - t) * x + (1 + (weight - 1) * t) * soft_plus
    prob = 1 / (1 + F.exp(-x))
    by_channel = rows.groupBy("batch_id", "channel").agg(
        F.sum(bce).alias("bce"), F.sum((prob - t) * (prob - t)).alias("se"), F.count(F.lit(1)).alias("n"), ((2 * F.sum(prob * t) + 1) / (F.sum(prob) + F.sum(t) + 1)).alias("dice")
    )
    return by_channel.groupBy("batch_id").agg(
        F.round(F.sum("bce") / F.sum("n") + dice_weight * (1 - F.avg("dice")) + mse_weight * F.sum("se") / F.sum("n"), 6).alias("loss")
    )


def merged_metric(rows: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Batch metrics weighted by batch size."""
    return rows.groupBy(*keys).agg(F.round(F.sum(F.col(value) * F.col(weight)) / F.sum(weight), 6).alias(value))


def best_epoch(history: DataFrame, score: str = "mean_dice") -> DataFrame:
    """The earliest epoch of the highest score: one aggregate, no sort."""
    best = F.min(F.struct((-F.col(score)).alias("minus"), "epoch")).alias("b")
    return history.agg(best).select(F.col("b.epoch").alias("epoch"), (-F.col("b.minus")).alias(score)).where("epoch IS NOT NULL")


def seeded_split(rows: DataFrame, counts: dict[str, int], seed: int = 20260619, key: str = "image_id", limit_base: int = 0) -> DataFrame:
    """Exactly so many images for each split, in the order of a seeded hash; the rest goes.

    The hash ranks the images the same way whatever their partitioning; only ids are ranked.  More images
    asked for than there are is an error.  ``limit_base``, if not 0, keeps so many, split by split."""
    wanted = sum(counts.values())
    digest = F.sha1(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    ids = rows.select(key).distinct().withColumn("_h", digest)
    chosen = ids.orderBy("_h", key).limit(wanted)  # top-k: no full sort
    if chosen.count() < wanted:
        raise ValueError(f"{wanted} images are asked for; there are fewer")
    ranked = chosen.withColumn("_r", F.row_number().over(Window.orderBy("_h", key)))
    split, at = F.lit(None).cast("string"), 0
    left = limit_base or wanted
    for name, n in counts.items():
        taken = min(n, left)
        split = F.when((F.col("_r") > at) & (F.col("_r") <= at + taken), name).otherwise(split)
        at, left = at + n, left - taken
    return rows.join(ranked.select(key, split.alias("split")).where("split is not null"), key)


def mean_channels(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The plain mean of a metric over channels."""
    return rows.groupBy(*keys).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias(value))


def mean_counts(found: DataFrame) -> DataFrame:
    """Mean numbers of ``markers`` and ``bubbles`` (arrays of peaks) an image; null without images."""
    return found.agg(F.round(F.avg(F.size("markers")), 6).alias("markers"), F.round(F.avg(F.size("bubbles")), 6).alias("bubbles"))


def error_stats(rows: DataFrame, keys: Sequence[str], error: str = "error") -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.round(F.sqrt(F.avg(F.col(error) * F.col(error))), 3).alias("rms"), F.round(F.max(error), 3).alias("largest")
    )


def epoch_draws(rows: DataFrame, n: int, seed: int, epoch: int, weight: str = "weight", key: str = "image_id", per_cell: int = 4_096) -> DataFrame:
    """``place`` (0 to n - 1, the order of the epoch) and the row drawn there: n draws with replacement, each row
    by its weight.  The key must be unique; null, negative and zero weights are never drawn.

    Rows lie one behind another along a line, in the order of their keys' hash, each as long as its weight in
    whole 1e-12s; draws are points on it.  Line and points are cut into cells, in which one sorted pass finds
    each point's row, so that neither a heavy row nor many light ones meet in one task; sums are whole numbers,
    so the draws don't depend on the partitions."""
    units = F.rint(F.col(weight) * 1e12).cast("decimal(38,0)")
    order = F.sha1(F.col(key).cast("string").cast("binary"))
    kept = rows.where(F.col(weight) > 0).select("*", units.alias("_units"), order.alias("_order")).withColumn("_bucket", F.substring("_order", 1, 3))
    sums = kept.groupBy("_bucket").agg(F.sum("_units").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    found = sums.orderBy("_bucket").collect()  # 4,096 at most
    whole, count = sum(int(r["_sum"]) for r in found), sum(r["_rows"] for r in found)
    cells = max(1, (n + count) // per_cell)
    size = -(-max(whole, 1) // cells)
    firsts, at = [], 0
    for r in found:
        firsts.append((r["_bucket"], Decimal(at)))
        at += int(r["_sum"])
    kept = kept.join(F.broadcast(rows.sparkSession.createDataFrame(firsts, "_bucket string, _first decimal(38,0)")), "_bucket")
    inside = Window.partitionBy("_bucket").orderBy("_order", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.lit(Decimal(size)).cast("decimal(38,0)")
    cell = lambda c: ((c - c % length) / length).cast("long")
    line = kept.withColumn("_end", (F.col("_first") + F.sum("_units").over(inside)).cast("decimal(38,0)")).withColumn("_start", (F.col("_end") - F.col("_units")).cast("decimal(38,0)"))
    line = line.where("_units > 0").select(F.explode(F.sequence(cell(F.col("_start")), cell(F.col("_end") - 1))).alias("_cell"), F.col("_start").alias("_at"), F.col(key).alias("_key"), F.lit(None).cast("long").alias("place"))
    share = F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}:{epoch}:"), F.col("id").cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    points = rows.sparkSession.range(n if whole else 0).select(F.least(F.rint(share * float(whole)).cast("decimal(38,0)"), F.lit(Decimal(max(whole - 1, 0))).cast("decimal(38,0)")).alias("_at"), F.col("id").alias("place"))
    points = points.select(cell(F.col("_at")).alias("_cell"), "_at", F.lit(None).cast(rows.schema[key].dataType).alias("_key"), "place")
    behind = Window.partitionBy("_cell").orderBy("_at", F.col("place").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = line.unionByName(points).withColumn("_key", F.last("_key", ignorenulls=True).over(behind))
    return met.where("place is not null").select("place", F.col("_key").alias(key))
