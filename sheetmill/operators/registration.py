"""Registration marks of a page: from dark boxes or peaks to the template's marks and a transform.

Everything about a page's few marks happens inside its row, in arrays, so that a page's pixels are
never shuffled for it: corners are least elements, matching is a fold over sorted pairs, and only the
equations of a transform are solved in a batch of Arrow rows.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geometry import fit_affine, fit_homography
from .matching import CORNERS, greedy_fold

#: The marks around each block, and the regions that follow it.
BLOCKS = {
    "identity": (("sbd", "exam_code"), ("top_left", "top_right", "part1_left_top", "part1_right_top")),
    "part1": (("part1",), ("part1_left_top", "part1_right_top", "part1_left_bottom", "part1_right_bottom")),
    "part2": (("part2",), ("part1_left_bottom", "part1_right_bottom", "part2_left_bottom", "part2_right_bottom")),
    "part3": (("part3",), ("part2_left_bottom", "part2_right_bottom", "bottom_left", "bottom_right")),
}


def _distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def projected(matrix: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point under a 3 x 3 matrix given by rows."""
    m = lambda k: F.element_at(matrix, k)
    w = m(7) * x + m(8) * y + m(9)
    return (m(1) * x + m(2) * y + m(3)) / w, (m(4) * x + m(5) * y + m(6)) / w


def held(column: Column) -> Column:
    """The column, computed where it stands and not folded into what uses it: a Python function takes no
    nested array functions as its arguments, and array functions call no Python."""
    return F.when(F.spark_partition_id() >= 0, column)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def exact_transform(points: pd.Series) -> pd.Series:
    """Of ``sx, sy, dx, dy`` structs: an affine from three, a homography from four on, null from fewer or
    from points on a line."""

    def solved(rows) -> list[float] | None:
        if rows is None or len(rows) < 3:
            return None
        p = np.array([[r["sx"], r["sy"], r["dx"], r["dy"]] for r in rows], float)
        m = fit_affine(p[:, :2], p[:, 2:]) if len(p) == 3 else fit_homography(p[:, :2], p[:, 2:])
        return None if m is None else [float(v) for v in m.ravel()]

    return points.map(solved)


def corner_marks(boxes: Column, width: Column, height: Column) -> Column:
    """Of boxes ``x, y, w, h``: ``name, x, y`` of the centre of the one in each corner, where there is one."""

    def one(name: str) -> Column:
        right, low = CORNERS[name]
        there = F.filter(boxes, lambda b: ((b.x > width * 0.8) if right else (b.x < width * 0.2)) & ((b.y > height * 0.75) if low else (b.y < height * 0.2)))
        cost = lambda b: ((width - b.x) if right else b.x) + ((height - b.y) if low else b.y)
        best = F.array_min(F.transform(there, lambda b: F.struct(cost(b).alias("cost"), b.y.alias("y"), b.x.alias("x"), b.w.alias("w"), b.h.alias("h"))))
        return F.when(best.isNotNull(), F.struct(F.lit(name).alias("name"), (best.x + best.w / 2).alias("x"), (best.y + best.h / 2).alias("y")))

    return F.array_compact(F.array(*[one(name) for name in CORNERS]))


def with_corner_peaks(rows: DataFrame, name: str, peaks: Column, width: Column, height: Column) -> DataFrame:
    """Rows with the four corners in turn as ``name, at, x, y``: each the nearest of the peaks ``x, y, score`` of its
    part of the page that is left, or of all that are left where its part is empty."""
    numbered = F.transform(peaks, lambda p, i: F.struct(i.alias("at"), p.x.alias("x"), p.y.alias("y")))
    rows = rows.withColumn("_left", held(numbered)).withColumn(name, F.array().cast("array<struct<name:string,at:int,x:double,y:double>>"))

    def step(rows: DataFrame, corner: str) -> DataFrame:
        right, low = CORNERS[corner]
        mine = F.filter("_left", lambda p: ((p.x > width * 0.65) if right else (p.x < width * 0.35)) & ((p.y > height * 0.65) if low else (p.y < height * 0.35)))
        cost = lambda p: ((width - p.x) if right else p.x) + ((height - p.y) if low else p.y)
        best = lambda pool: F.array_min(F.transform(pool, lambda p: F.struct(cost(p).alias("cost"), p.at.alias("at"), p.x.alias("x"), p.y.alias("y"))))
        rows = rows.withColumn("_best", held(F.coalesce(best(mine), best(F.col("_left")))))
        found = F.struct(F.lit(corner).alias("name"), *[F.col(f"_best.{c}").alias(c) for c in ("at", "x", "y")])
        chosen = F.when(F.col("_best").isNotNull(), F.concat(name, F.array(found))).otherwise(F.col(name))
        return rows.withColumns({name: held(chosen), "_left": held(F.filter("_left", lambda p: ~p.at.eqNullSafe(F.col("_best.at"))))})

    for corner in CORNERS:
        rows = step(rows, corner)
    return rows.drop("_left", "_best")


def _onto(found: Column, targets: Column) -> Column:
    """``sx, sy, dx, dy`` of found marks ``name, x, y`` and the targets of the same name, in the targets' order."""
    pair = lambda t: F.element_at(F.filter(found, lambda f: f["name"] == t["name"]), 1)
    known = F.filter(targets, lambda t: F.exists(found, lambda f: f["name"] == t["name"]))
    return F.transform(known, lambda t: F.struct(pair(t).x.alias("sx"), pair(t).y.alias("sy"), t.x.cast("double").alias("dx"), t.y.cast("double").alias("dy")))


def _by_corner(corners: Column, targets: Column) -> Column:
    of = lambda c: F.element_at(F.filter(targets, lambda t: t["name"] == c["name"]), 1)
    return F.transform(corners, lambda c: F.struct(c.x.alias("sx"), c.y.alias("sy"), of(c).x.cast("double").alias("dx"), of(c).y.cast("double").alias("dy")))


def with_transform(rows: DataFrame, name: str, points: Column) -> DataFrame:
    """Rows with the transform of an array of points, 3 x 3 by rows."""
    return rows.withColumn("_points", held(points)).withColumn(name, held(exact_transform("_points"))).drop("_points")


def with_bootstrap(rows: DataFrame, corners: str, targets: Column, name: str = "start") -> DataFrame:
    """Rows with the transform that takes three or four corners to their targets; null with fewer."""
    held_ = rows.withColumn(corners, held(F.col(corners)))
    return with_transform(held_, name, _by_corner(F.col(corners), targets))


def _with_matches(rows: DataFrame, name: str, targets: Column, places: Column, reach: Column) -> DataFrame:
    """Rows with greedy pairs ``distance, minus, a, b`` of targets and places ``x, y, minus`` by distance, then ``minus``.

    Each step is held: an array function would compute its inner arrays again for each element."""
    near = lambda t, a: F.filter(
        F.transform("_places", lambda p, b: F.struct(_distance(p.x, p.y, t.x, t.y).alias("distance"), p.minus.alias("minus"), a.alias("a"), b.alias("b"))), lambda e: e.distance <= reach
    )
    rows = rows.withColumn("_places", held(places)).withColumn("_pairs", held(F.array_sort(F.flatten(F.transform(targets, near)))))
    return rows.withColumn(name, held(greedy_fold(F.col("_pairs")))).drop("_places", "_pairs")


def _filled(matched: Column, corners: Column) -> Column:
    """Matches, and the corners whose mark has none."""
    return F.concat(matched, F.filter(corners, lambda c: ~F.exists(matched, lambda m: m["name"] == c["name"])))


def _reach(corners: Column, tolerance: float) -> Column:
    return F.when(F.size(corners) >= 4, tolerance).when(F.size(corners) == 3, 3 * tolerance)


def with_registration_marks(rows: DataFrame, name: str, boxes: str, corners: str, matrix: str, targets: Column, tolerance: float = 35.0) -> DataFrame:
    """Rows with ``name, x, y`` of the marks that boxes match once the corners' transform has moved them; three
    corners allow three times the tolerance, fewer leave the corners alone."""
    place = lambda b: projected(F.col(matrix), b.x + b.w / 2, b.y + b.h / 2)
    places = F.transform(boxes, lambda b: F.struct(place(b)[0].alias("x"), place(b)[1].alias("y"), F.lit(0.0).alias("minus")))
    rows = _with_matches(rows, "_matched", targets, places, _reach(F.col(corners), tolerance))
    box = lambda e: F.get(F.col(boxes), e.b)
    found = F.transform("_matched", lambda e: F.struct(F.get(targets, e.a)["name"].alias("name"), (box(e).x + box(e).w / 2).alias("x"), (box(e).y + box(e).h / 2).alias("y")))
    rows = rows.withColumn("_found", held(found))
    marks = F.when(F.col(matrix).isNull(), F.col(corners)).otherwise(_filled(F.col("_found"), F.col(corners)))
    return rows.withColumn(name, held(marks)).drop("_matched", "_found")


def with_marks_by_position(rows: DataFrame, name: str, boxes: str, targets: Column, tolerance: float) -> DataFrame:
    """Rows with ``name, x, y`` of the marks of a page that already has its template's size."""
    places = F.transform(boxes, lambda b: F.struct((b.x + b.w / 2).alias("x"), (b.y + b.h / 2).alias("y"), F.lit(0.0).alias("minus")))
    rows = _with_matches(rows, "_matched", targets, places, F.lit(float(tolerance)))
    box = lambda e: F.get(F.col(boxes), e.b)
    found = F.transform("_matched", lambda e: F.struct(F.get(targets, e.a)["name"].alias("name"), (box(e).x + box(e).w / 2).alias("x"), (box(e).y + box(e).h / 2).alias("y")))
    return rows.withColumn(name, held(found)).drop("_matched")


def with_peak_marks(rows: DataFrame, name: str, peaks: str, corners: str, matrix: str, targets: Column, tolerance: float) -> DataFrame:
    """Rows with ``status, method, n_peaks, corners, reach, marks, mean_distance, max_distance`` of a detector's peaks:
    matched by distance, then by score downwards; a corner that only fills a gap counts as distance 0."""
    place = lambda p: projected(F.col(matrix), p.x, p.y)
    places = F.transform(peaks, lambda p: F.struct(place(p)[0].alias("x"), place(p)[1].alias("y"), (-p.score).alias("minus")))
    reach = _reach(F.col(corners), tolerance)
    rows = _with_matches(rows, "_matched", targets, places, reach)
    peak = lambda e: F.get(F.col(peaks), e.b)
    found = F.transform("_matched", lambda e: F.struct(F.get(targets, e.a)["name"].alias("name"), peak(e).x.alias("x"), peak(e).y.alias("y"), e.distance.alias("distance")))
    gaps = F.transform(corners, lambda c: F.struct(c["name"].alias("name"), c.x.alias("x"), c.y.alias("y"), F.lit(0.0).alias("distance")))
    rows = rows.withColumns({"_found": held(found), "_gaps": held(gaps)})
    marks = F.when(F.col(matrix).isNotNull(), _filled(F.col("_found"), F.col("_gaps"))).otherwise(F.slice("_gaps", 1, 0))
    rows = rows.withColumn("_marks", held(marks))
    far = F.transform("_marks", lambda m: m.distance)
    n, c, m = F.coalesce(F.size(peaks), F.lit(0)), F.size(corners), F.size("_marks")
    found = F.struct(
        F.when(n <= 0, "no_marker_peaks").when(c < 3, "insufficient_corners").when(m >= 4, "ok").otherwise("insufficient_markers").alias("status"),
        F.when(c >= 4, "homography").when(c == 3, "affine").when(n > 0, "insufficient_corners").otherwise("none").alias("method"),
        n.alias("n_peaks"),
        F.transform(corners, lambda c: c["name"]).alias("corners"),
        F.round(reach, 3).alias("reach"),
        F.col("_marks").alias("marks"),
        F.round(F.aggregate(far, F.lit(0.0), lambda a, d: a + d) / F.nullif(m, F.lit(0)), 3).alias("mean_distance"),
        F.round(F.array_max(far), 3).alias("max_distance"),
    )
    return rows.withColumn(name, found).drop("_matched", "_found", "_gaps", "_marks")


def better_marks(detected: Column, ruled: Column, targets: Column) -> tuple[Column, Column]:
    """A detector's marks unless it misses some and the rules find strictly more; and which they are."""
    falls = (F.size(detected) < F.size(targets)) & (F.size(ruled) > F.size(detected))
    source = F.when(detected.isNull(), "rule_based").when(falls, "rule_based_fallback_after_layout_v0").otherwise("layout_v0")
    return F.when(detected.isNull() | falls, ruled).otherwise(detected), source


def with_warp(rows: DataFrame, marks: str, targets: Column) -> DataFrame:
    """Rows with the page's ``matrix`` from its marks: a homography of four or more, else an affine of the first
    three in the template's order; and, with fewer, an ``error`` that names the missing corners."""
    found = F.col(marks)
    missing = F.filter(F.array(*[F.lit(c) for c in CORNERS]), lambda c: ~F.exists(found, lambda m: m["name"] == c))
    text = F.concat(F.lit("missing source markers: ["), F.array_join(F.transform(missing, lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", "), F.lit("]"))
    rows = rows.withColumn(marks, held(found)).withColumn("_onto", held(_onto(found, targets)))
    return rows.withColumns(
        {"matrix": held(F.coalesce(exact_transform("_onto"), exact_transform(F.slice("_onto", 1, 3)))), "error": F.when(F.size("_onto") < 3, text)}
    ).drop("_onto")


def block_points(marks: Column, targets: Column) -> Column:
    """``block, points`` for each block: its marks as found and as they should be."""
    of = lambda names: F.filter(targets, lambda t: t["name"].isin(*names))
    return F.array(*[F.struct(F.lit(block).alias("block"), _onto(marks, of(names)).alias("points")) for block, (_, names) in BLOCKS.items()])


_TEXT, _INT, _NUMBER = T.StringType(), T.IntegerType(), T.DoubleType()
LOCAL = T.ArrayType(
    T.StructType(
        [T.StructField(c, _TEXT) for c in ("block", "method", "status")] + [T.StructField("marker_count", _INT)]
        + [T.StructField(c, _NUMBER) for c in ("confidence", "pre_rms", "pre_max", "rms", "largest")] + [T.StructField("matrix", T.ArrayType(_NUMBER))]
    )
)


@F.pandas_udf(LOCAL)
def local_fits(blocks: pd.Series) -> pd.Series:
    """The transform of each block of ``block_points``, with its residuals before and after."""
    from .geometry import local_transform

    def fitted(rows) -> list[dict]:
        out = []
        for row in rows:
            p = np.array([[q["sx"], q["sy"], q["dx"], q["dy"]] for q in row["points"]], float).reshape(-1, 4)
            fit = local_transform(p[:, :2], p[:, 2:])
            before = np.linalg.norm(p[:, :2] - p[:, 2:], axis=1)
            three = lambda v: None if v is None else round(float(v), 3)
            out.append(
                {
                    "block": row["block"], "method": fit["method"], "status": fit["status"], "marker_count": len(p), "confidence": round(fit["confidence"], 3),
                    "pre_rms": three(np.sqrt((before**2).mean()) if len(p) else None), "pre_max": three(before.max() if len(p) else None),
                    "rms": three(fit["rms"]), "largest": three(fit["largest"]), "matrix": fit["matrix"],
                }
            )
        return out

    return blocks.map(fitted)
