"""Matching of points: templates to candidates, peaks to labels, and neighbours to be dropped.

Points of one image are few (a template has ten marks, a sheet 602 bubbles), so what depends on
order is a fold over a sorted array inside a row.  Finding the pairs within reach is a join on grid
cells of the reach's size, not a comparison of all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reach_pairs(left: DataFrame, right: DataFrame, reach: float, key: str = "image_id") -> DataFrame:
    """``key, a, b, distance`` of points ``key, id, x, y`` at most ``reach`` apart (inclusive).

    Both sides are dealt and sorted: Spark takes exploded rows for as small as those they came from, and would
    send nine copies of every point to all tasks by way of the driver."""
    cell = lambda c: F.floor(F.col(c) / F.lit(float(reach))).cast("long")
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    a = left.select(key, F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(F.transform(around, lambda d: cell("x") + d)).alias("cx"), "y")
    a = a.select("*", F.explode(F.transform(around, lambda d: cell("y") + d)).alias("cy")).drop("y")
    b = right.select(key, F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("cx"), cell("y").alias("cy"))
    far = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
    return a.hint("merge").join(b, [key, "cx", "cy"]).withColumn("distance", far).where(F.col("distance") <= reach).select(key, "a", "b", "distance")


def greedy_fold(edges: Column) -> Column:
    """Of sorted ``(distance, .., a, b)`` structs those that take neither end a second time."""
    empty = F.filter(edges, lambda e: F.lit(False))
    return F.aggregate(
        edges,
        empty,
        lambda got, e: F.when(F.exists(got, lambda g: (g.a == e.a) | (g.b == e.b)), got).otherwise(F.concat(got, F.array(e))),
    )


def greedy_pairs(pairs: DataFrame, key: str = "image_id") -> DataFrame:
    """One-to-one pairs, the nearest first; ties by a, then b."""
    edges = F.array_sort(F.collect_list(F.struct("distance", "a", "b")))
    return pairs.groupBy(key).agg(edges.alias("edges")).select(key, F.explode(greedy_fold(F.col("edges"))).alias("e")).select(key, "e.a", "e.b", "e.distance")


def peaks_to_labels(peaks: DataFrame, labels: DataFrame, radius: float, key: str = "image_id") -> DataFrame:
    """``tp, fp, fn, distance`` by image: each peak, by score downwards, takes the nearest label that is
    left if that is within the radius.  Ties: peaks by id, labels by id."""
    p = peaks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id", "x", "y"))).alias("peaks"))
    g = labels.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", "x", "y"))).alias("labels"))
    both = p.join(g, key, "full_outer")
    none = F.array().cast("array<struct<minus:double,id:int,x:double,y:double>>")
    both = both.select(key, F.coalesce("peaks", none).alias("peaks"), F.coalesce("labels", F.array().cast("array<struct<id:int,x:double,y:double>>")).alias("labels"))

    def step(state: Column, peak: Column) -> Column:
        left = F.filter("labels", lambda q: ~F.array_contains(state.used, q.id))
        far = F.transform(left, lambda q: F.struct(F.sqrt((q.x - peak.x) * (q.x - peak.x) + (q.y - peak.y) * (q.y - peak.y)).alias("d"), q.id.alias("id")))
        best = F.array_min(far)
        hit = best.isNotNull() & (best.d <= radius)
        return F.struct(
            F.when(hit, F.concat(state.used, F.array(best.id))).otherwise(state.used).alias("used"),
            (state.tp + F.when(hit, 1).otherwise(0)).alias("tp"),
            (state.fp + F.when(hit, 0).otherwise(1)).alias("fp"),
            (state.distance + F.when(hit, best.d).otherwise(0.0)).alias("distance"),
        )

    start = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(0.0).alias("distance"))
    return both.withColumn("r", F.aggregate("peaks", start, step)).select(
        key, F.col("r.tp").alias("tp"), F.col("r.fp").alias("fp"), (F.size("labels") - F.col("r.tp")).alias("fn"), F.col("r.distance").alias("distance")
    )


def drop_near(circles: DataFrame, least: float = 8.0, key: str = "image_id") -> DataFrame:
    """Circles by radius downwards, less those strictly nearer than ``least`` to one that stays."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("radius")).alias("minus"), "id", "x", "y")))
    near = lambda p, q: F.sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) < least
    kept = F.aggregate(
        "all",
        F.filter("all", lambda c: F.lit(False)),
        lambda got, c: F.when(F.exists(got, lambda g: near(g, c)), got).otherwise(F.concat(got, F.array(c))),
    )
    return circles.groupBy(key).agg(ordered.alias("all")).select(key, F.explode(kept).alias("c")).select(key, "c.id", "c.x", "c.y", (-F.col("c.minus")).alias("radius"))


#: Whether a corner is on the right, and low.
CORNERS = {"top_left": (0, 0), "top_right": (1, 0), "bottom_right": (1, 1), "bottom_left": (0, 1)}


def corner_choices(candidates: DataFrame, width: float, height: float, key: str = "image_id") -> DataFrame:
    """For each corner the candidate in its part of the page that is nearest by |dx| + |dy|; ties by y, then x."""
    x, y = F.col("x"), F.col("y")
    rows = [
        F.when(
            ((x > 0.8 * width) if right else (x < 0.2 * width)) & ((y > 0.75 * height) if low else (y < 0.2 * height)),
            F.struct(F.lit(name).alias("corner"), (F.abs(x - right * width) + F.abs(y - low * height)).alias("cost")),
        )
        for name, (right, low) in CORNERS.items()
    ]
    return (
        candidates.select(key, "id", "x", "y", F.explode(F.array_compact(F.array(*rows))).alias("c"))
        .groupBy(key, F.col("c.corner").alias("corner"))
        .agg(F.min(F.struct("c.cost", "y", "x", "id")).alias("best"))
        .select(key, "corner", "best.id", "best.x", "best.y", "best.cost")
    )


def mark_like(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """Dark boxes ``x, y, w, h, area`` (x and y their upper left corner) that can be registration marks."""
    x, y, w, h = (F.col(c) for c in "xywh")
    edge = (x < 0.12 * width) | (x > 0.88 * width) | (y < 0.12 * height) | (y > 0.82 * height)
    return boxes.where(
        w.between(10, 54) & h.between(10, 54) & (w / h).between(0.55, 1.65) & (F.col("area") / (w * h) >= 0.45) & edge
    ).withColumns({"cx": x + w / 2, "cy": y + h / 2})


def visible_points(labels: DataFrame, kind: str, width: float, height: float, key: str = "image_id") -> DataFrame:
    """``key, place, x, y``: the visible points ``kind`` of a label record, scaled to another size."""
    seen = F.filter(kind, lambda p: F.coalesce(p.visible, F.lit(False)))
    rows = labels.select(key, "width", "height", F.posexplode(seen).alias("place", "p"))
    return rows.select(key, "place", (F.col("p.x") * width / F.col("width")).alias("x"), (F.col("p.y") * height / F.col("height")).alias("y"))


def scaled_peaks(peaks: DataFrame, scale_x: Column, scale_y: Column) -> DataFrame:
    """Peaks in the source's pixels beside the model's, rounded as they are reported."""
    return peaks.withColumns(
        {"model_x": F.round("x", 3), "model_y": F.round("y", 3), "x": F.round(F.col("x") * scale_x, 3), "y": F.round(F.col("y") * scale_y, 3), "score": F.round("score", 6)}
    )


def marker_payload(marks: DataFrame, key: str = "image_id") -> DataFrame:
    """``key, markers_found, markers``: names in order, and coordinates with two decimals."""
    entry = F.struct("name", F.array(F.round("x", 2), F.round("y", 2)).alias("at"))
    return marks.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("markers")).select(key, F.map_keys("markers").alias("markers_found"), "markers")
