"""A layout model's outputs and training samples as relations.

Networks stay outside: their heat maps come as rows ``image_id, channel, y, x, p``, their training samples are
described here as rows of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import f_measure
from . import matching as M
from . import raster as R
from . import training as L
from .registration import held, projected, with_transform


def layout_predictions(heat: DataFrame, scale_x: float, scale_y: float, *, page: float, marker: float, bubble: float, radius: int, most: int) -> DataFrame:
    """``image_id, markers, bubbles, n_markers, n_bubbles, page``: an image's peaks in the source's pixels and the
    box of its page, null where no pixel reaches the threshold."""

    def peaks(channel: str, threshold: float) -> DataFrame:
        found = R.peaks(heat.where(F.col("channel") == channel), threshold, radius, most)
        found = M.scaled_peaks(found.select("image_id", "rank", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("p").alias("score")), F.lit(scale_x), F.lit(scale_y))
        entry = F.struct("rank", "x", "y", "model_x", "model_y", "score")
        return found.groupBy("image_id").agg(F.array_sort(F.collect_list(entry)).alias(f"{channel}s"))

    box = R.mask_box(heat.where("channel = 'page'"), page, scale_x, scale_y).select("image_id", F.array("x1", "y1", "x2", "y2").alias("page"))
    rows = heat.select("image_id").distinct().join(peaks("marker", marker), "image_id", "left").join(peaks("bubble", bubble), "image_id", "left").join(box, "image_id", "left")
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).alias(f"n_{c}")
    return rows.select("image_id", *[F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c) for c in ("markers", "bubbles")], "page").select("*", count("markers"), count("bubbles"))


def evaluate_layout(logits: DataFrame, sizes: DataFrame, peaks: DataFrame, labels: DataFrame, pos_weights: dict[str, float], reach: float) -> DataFrame:
    """One row about a split: loss and mean Dice weighted by batch size, and precision, recall and F1 of its peaks.

    ``sizes``: ``batch_id, size``; each input is an aggregate of its own, so the parts meet as single rows."""
    loss = L.layout_loss(logits, pos_weights).join(sizes, "batch_id").agg(F.round(F.sum(F.col("loss") * F.col("size")) / F.sum("size"), 4).alias("loss"))
    dice = L.mean_channels(L.pixel_metrics(logits), ["batch_id"], "dice").join(sizes, "batch_id").agg(F.round(F.sum(F.col("dice") * F.col("size")) / F.sum("size"), 4).alias("mean_dice"))
    total = M.peaks_to_labels(peaks, labels, reach).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "distance")])
    p, r, f1 = f_measure(F.col("tp"), F.col("fp"), F.col("fn"))
    total = total.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round(F.col("distance") / F.nullif("tp", F.lit(0)), 6).alias("mean_distance"))
    return loss.crossJoin(dice).crossJoin(total)  # three single rows


def _unit(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that a seed and the parts fix, whatever the partitioning."""
    digest = F.sha1(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def training_geometry(sheets: DataFrame, width: int, height: int, to_width: int, to_height: int, *, augmented: int, seed: int, shift: float, bend: float) -> DataFrame:
    """``sample_id, base_image_id, clean, sample, matrix``: for each sheet one clean sample, scaled only, and
    ``augmented`` ones whose corners are moved by up to ``shift`` together and up to ``bend`` each."""
    rows = sheets.select(F.col("image_id").alias("base_image_id"), F.explode(F.sequence(F.lit(0), F.lit(augmented))).alias("sample"))
    of = lambda *name: (_unit(seed, F.col("base_image_id"), F.col("sample"), *[F.lit(n) for n in name]) * 2 - 1) * F.when(F.col("sample") > 0, 1.0).otherwise(0.0)
    sx, sy = to_width / width, to_height / height

    def corner(k: int, x: float, y: float) -> Column:
        dx, dy = of("x") * shift + of("x", k) * bend, of("y") * shift + of("y", k) * bend
        return F.struct(F.lit(x).alias("sx"), F.lit(y).alias("sy"), (x * sx + dx).alias("dx"), (y * sy + dy).alias("dy"))

    points = F.array(*[corner(k, float(x), float(y)) for k, (x, y) in enumerate(((0, 0), (width, 0), (width, height), (0, height)))])
    name = F.concat(F.col("base_image_id").cast("string"), F.when(F.col("sample") == 0, F.lit("_clean")).otherwise(F.format_string("_aug%03d", "sample")))
    rows = rows.withColumns({"sample_id": held(name), "clean": F.col("sample") == 0})
    return with_transform(rows, "matrix", points)


def training_labels(geometry: DataFrame, points: DataFrame, to_width: int, to_height: int, *, occluded: float = 0.0, seed: int = 0) -> DataFrame:
    """``sample_id, kind, id, x, y, in_frame, occluded, visible``: a template's points in every sample; markers of
    augmented samples are covered with the probability ``occluded``.

    ``points``: ``kind, id, x, y``, bounded by the template."""
    rows = geometry.join(F.broadcast(points))
    x, y = projected(F.col("matrix"), F.col("x").cast("double"), F.col("y").cast("double"))
    covered = (F.col("kind") == "marker") & ~F.col("clean") & (_unit(seed, F.col("sample_id"), F.col("id")) < F.lit(float(occluded)))
    rows = rows.select("sample_id", "base_image_id", "clean", "kind", "id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), covered.alias("occluded"))
    inside = R.in_frame(F.col("x"), F.col("y"), to_width, to_height)
    return rows.withColumn("in_frame", inside).withColumn("visible", F.col("in_frame") & ~F.col("occluded"))


def training_manifest(labels: DataFrame, splits: DataFrame) -> DataFrame:
    """``sample_id, base_image_id, split, image_path, label_path, clean, visible_markers, visible_bubbles``."""
    seen = lambda kind: F.count(F.when((F.col("kind") == kind) & F.col("visible"), 1)).alias(f"visible_{kind}s")
    rows = labels.groupBy("sample_id", "base_image_id", "clean").agg(seen("marker"), seen("bubble"))
    path = lambda folder, suffix: F.concat(F.lit(folder + "/"), "split", F.lit("/"), "sample_id", F.lit(suffix))
    joined = rows.join(splits.select(F.col("image_id").alias("base_image_id"), "split"), "base_image_id")
    return joined.select("sample_id", "base_image_id", "split", path("images", ".jpg").alias("image_path"), path("labels", ".json").alias("label_path"), "clean", "visible_markers", "visible_bubbles")
