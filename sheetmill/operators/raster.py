"""Pixels as rows: ``image_id, y, x, gray`` or ``p``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DARK = 100


def darkness(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """Share of dark pixels."""
    return pixels.groupBy(key).agg(F.round(F.avg((F.col("gray") < DARK).cast("double")), 6).alias("darkness_score"))


def padded_crop(pixels: DataFrame, boxes: DataFrame, key: str = "image_id") -> DataFrame:
    """The pixels of each box ``x1, y1, x2, y2``; white where it leaves the image."""
    grid = boxes.select(
        key, "box_id", "x1", "y1", F.explode(F.sequence("y1", F.col("y2") - 1)).alias("y"), "x2"
    ).select(key, "box_id", "y", F.explode(F.sequence("x1", F.col("x2") - 1)).alias("x"), "x1", "y1")
    return grid.join(pixels.select(key, "y", "x", "gray"), [key, "y", "x"], "left").select(
        key, "box_id", (F.col("y") - F.col("y1")).alias("y"), (F.col("x") - F.col("x1")).alias("x"), F.coalesce("gray", F.lit(255)).alias("gray")
    )


def ring_of(width: int, height: int) -> F.Column:
    """Which part of a crop a pixel lies in: core, inner, gap or background."""
    far = F.sqrt(F.pow(F.col("x") - (width - 1) / 2, 2) + F.pow(F.col("y") - (height - 1) / 2, 2))
    r = min(width, height) / 2
    return F.when(far <= 0.58 * r, "core").when(far <= 0.72 * r, "inner").when(far >= 0.88 * r, "background").otherwise("gap")


def bubble_features(pixels: DataFrame, width: int, height: int, key: str = "image_id", with_component: bool = True) -> DataFrame:
    """``darkness_score, background_noise, darkness_contrast, ink_ratio_inside, component_score, fill_score``.

    Ink is what is darker than the background's 20th percentile allows; the largest component of
    connected ink in the core counts beside the amount of ink."""
    marked = pixels.withColumn("ring", ring_of(width, height))
    inner, ring = F.col("ring").isin("core", "inner"), F.col("ring")
    dark = (F.col("gray") < DARK).cast("double")
    first = marked.groupBy(key).agg(
        F.avg(dark).alias("darkness"),
        F.avg(F.when(inner, dark)).alias("inner"),
        F.avg(F.when(ring == "background", dark)).alias("noise"),
        F.round(F.percentile(F.when(ring == "background", F.col("gray")), 0.2), 9).alias("p20"),
        F.count(F.when(ring == "core", 1)).alias("core"),
    )
    first = first.withColumn("limit", F.greatest(F.lit(80.0), F.least(F.lit(190.0), F.col("p20") - 20)))
    core = marked.where("ring = 'core'").join(first.select(key, "limit"), key).withColumn("ink", (F.col("gray") < F.col("limit")).cast("double"))
    second = core.groupBy(key).agg(F.avg("ink").alias("ink"))
    out = first.join(second, key, "left")
    if with_component:
        largest = largest_component(core.where("ink = 1").select(key, "y", "x"), key)
        out = out.join(largest, key, "left").withColumn("component", F.coalesce(F.col("area") / F.col("core"), F.lit(0.0)))
    else:
        out = out.withColumn("component", F.lit(0.0))
    contrast = F.greatest(F.lit(0.0), F.col("inner") - F.col("noise"))
    fill = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * F.col("ink") + 0.35 * contrast + 0.2 * F.col("component") - 0.2 * F.col("noise")))
    whole = F.col("ink").isNotNull() & F.col("noise").isNotNull() & F.col("inner").isNotNull()
    six = lambda c, name: F.round(F.when(whole, c).otherwise(0.0), 6).alias(name)
    return out.select(
        key,
        F.round("darkness", 6).alias("darkness_score"),
        six(F.col("noise"), "background_noise"),
        six(contrast, "darkness_contrast"),
        F.round(F.when(whole, F.col("ink")).otherwise(F.col("darkness")), 6).alias("ink_ratio_inside"),
        six(F.col("component"), "component_score"),
        F.round(F.when(whole, fill).otherwise(F.col("darkness")), 6).alias("fill_score"),
    )


def component_labels(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each pixel a number of the 8-connected set that it belongs to; pixels of all images at once."""
    span = int(x.max()) + 3 if len(x) else 3
    rows = int(y.max()) + 3 if len(y) else 3
    at = (image.astype(np.int64) * rows + y + 1) * span + x + 1
    order = np.argsort(at)
    at = at[order]
    root = np.arange(len(at))
    left, right = [], []
    for step in (1, span - 1, span, span + 1):
        k = np.searchsorted(at, at + step)
        k[k == len(at)] = 0
        hit = at[k] == at + step
        left.append(np.flatnonzero(hit))
        right.append(k[hit])
    a, b = np.concatenate(left), np.concatenate(right)
    while True:  # the roots of neighbours join at the smaller one, roots point to roots
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    out = np.empty(len(at), np.int64)
    out[order] = root
    return out


def component_sizes(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each pixel the size of the set that it belongs to."""
    label = component_labels(image, y, x)
    return np.bincount(label)[label] if len(label) else label


def largest_component(ink: DataFrame, key: str = "image_id") -> DataFrame:
    """``area`` of the largest 8-connected set of ``y, x`` pixels of each image, which is small; the images of
    an Arrow batch are labelled together."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ink")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            image = np.repeat(np.arange(len(sizes)), sizes)
            found = component_sizes(image, flat.field("y").to_numpy(), flat.field("x").to_numpy())
            most = np.zeros(len(sizes), np.int64)
            np.maximum.at(most, image, found)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(most)], names=[key, "area"])

    kind = ink.schema[key].dataType.simpleString()
    gathered = ink.groupBy(key).agg(F.collect_list(F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))).alias("ink"))
    return gathered.select(key, "ink").mapInArrow(run, f"{key} {kind}, area long")


def peaks(heat: DataFrame, threshold: float, radius: int, most: int, key: str = "image_id") -> DataFrame:
    """Local maxima of ``p`` over a square of ``2 * radius + 1``, the ``most`` strongest by (p, y, x).

    The maximum is separable: along the rows first, then along the columns."""
    row = Window.partitionBy(key, "y").orderBy("x").rangeBetween(-radius, radius)
    column = Window.partitionBy(key, "x").orderBy("y").rangeBetween(-radius, radius)
    ranked = Window.partitionBy(key).orderBy(F.desc("p"), "y", "x")
    return (
        heat.withColumn("m", F.max("p").over(row))
        .withColumn("m", F.max("m").over(column))
        .where((F.col("p") >= threshold) & (F.col("p") >= F.col("m") - 1e-6))
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= most)
        .select(key, "y", "x", "p", "rank")
    )


def mask_box(heat: DataFrame, threshold: float, scale_x: float = 1.0, scale_y: float = 1.0, key: str = "image_id") -> DataFrame:
    """The box around all pixels at or above the threshold, its far ends exclusive."""
    high = heat.where(F.col("p") >= threshold)
    at = lambda c, s: F.round(c * F.lit(float(s)), 3)
    return high.groupBy(key).agg(
        at(F.min("x"), scale_x).alias("x1"), at(F.min("y"), scale_y).alias("y1"), at(F.max("x") + 1, scale_x).alias("x2"), at(F.max("y") + 1, scale_y).alias("y2")
    )


def gaussian_heat(points: DataFrame, width: int, height: int, sigma: float, key: str = "image_id") -> DataFrame:
    """``key, y, x, gray``: points drawn as Gaussian spots up to three sigma, the larger value wins."""
    reach = int(-(-3 * sigma // 1))
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    spread = points.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)).select(
        key, "x", "y", F.explode(F.transform(steps, lambda d: F.rint(F.col("x")).cast("int") + d)).alias("px")
    )
    spread = spread.select("*", F.explode(F.transform(steps, lambda d: F.rint(F.col("y")).cast("int") + d)).alias("py"))
    value = F.floor(255 * F.exp(-(F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2)) / (2 * sigma * sigma))).cast("int")
    inside = F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1)
    return spread.where(inside).groupBy(key, F.col("py").alias("y"), F.col("px").alias("x")).agg(F.max(value).alias("gray"))


def in_frame(x: Column, y: Column, width: float, height: float) -> Column:
    """Whether a point lies on the page: its far edges do not."""
    return (x >= 0) & (x < width) & (y >= 0) & (y < height)


def polygon_mask(polygons: DataFrame, width: int, height: int, key: str = "image_id") -> DataFrame:
    """``key, y, x`` of the pixels inside each closed polygon ``points`` (``x, y`` structs) or on its border.

    A pixel is inside if a ray to its right crosses an odd number of edges."""
    grid = polygons.select(key, "points", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    at = lambda i: F.element_at("points", (F.pmod(i, F.size("points")) + 1).cast("int"))
    sides = F.transform("points", lambda p, i: F.struct(p.x.alias("ax"), p.y.alias("ay"), at(i + 1).x.alias("bx"), at(i + 1).y.alias("by")))
    x, y = F.col("x"), F.col("y")
    crossed = F.size(F.filter(sides, lambda e: ((e.ay > y) != (e.by > y)) & (x < (e.bx - e.ax) * (y - e.ay) / (e.by - e.ay) + e.ax)))
    cross = lambda e: (e.bx - e.ax) * (y - e.ay) - (e.by - e.ay) * (x - e.ax)
    border = F.exists(sides, lambda e: (cross(e) == 0) & x.between(F.least(e.ax, e.bx), F.greatest(e.ax, e.bx)) & y.between(F.least(e.ay, e.by), F.greatest(e.ay, e.by)))
    return grid.where((F.pmod(crossed, F.lit(2)) == 1) | border).select(key, "y", "x")


def layout_masks(points: DataFrame, polygons: DataFrame, width: int, height: int, sigmas: dict[str, float], key: str = "image_id") -> DataFrame:
    """``key, mask, y, x, gray``: the page's polygon filled, and the visible points of each kind as spots.

    ``points``: ``key, kind, x, y, visible``."""
    rows = polygon_mask(polygons, width, height, key).select(key, F.lit("page").alias("mask"), "y", "x", F.lit(255).alias("gray"))
    for kind, sigma in sigmas.items():
        seen = points.where((F.col("kind") == kind) & F.col("visible"))
        rows = rows.union(gaussian_heat(seen, width, height, sigma, key).where("gray > 0").select(key, F.lit(kind), "y", "x", "gray"))
    return rows


def moved_points(points: DataFrame, maps: DataFrame, width: int, height: int, key: str = "image_id") -> DataFrame:
    """Points ``x, y`` moved by the displacement ``dx, dy`` of the pixel nearest to them."""
    near = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most - 1), F.rint(c).cast("int")))
    asked = points.withColumns({"_y": near(F.col("y"), height), "_x": near(F.col("x"), width)})
    found = maps.select(key, F.col("y").alias("_y"), F.col("x").alias("_x"), "dx", "dy")
    return asked.join(found, [key, "_y", "_x"]).withColumns({"x": F.col("x") + F.col("dx"), "y": F.col("y") + F.col("dy")}).drop("_y", "_x", "dx", "dy")


def area_resized(pixels: DataFrame, by: int, key: str = "image_id", value: str = "gray") -> DataFrame:
    """Pictures shrunk by a whole number: each pixel the mean of its square."""
    cell = lambda c: F.floor(F.col(c) / by).cast("int").alias(c)
    return pixels.groupBy(key, cell("y"), cell("x")).agg(F.avg(value).alias(value))


def normalised(gray: Column) -> Column:
    """0 to 255 as -1 to 1."""
    return (gray / 255.0 - 0.5) / 0.5


def denormalised(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), (value * 0.5 + 0.5) * 255.0))
