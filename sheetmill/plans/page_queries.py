"""Queries from marks, transforms and pages to decoded sheets, each with its DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decode as D
from ..operators import extraction as E
from ..operators import geometry as G
from ..operators import layout as Y
from ..operators import models as A
from ..operators import ranking as R
from ..operators import registration as M
from ..operators import specs as T
from ..operators import training as L
from ..sources import readers as I
from ..sources import sinks as O
from ..sources.scratch import scratch
from . import bindings as B
from . import pages as P
from . import sheet_queries as Q
from . import vision_queries as V
from .detail_queries import ORACLES as DETAIL
from .file_queries import _pictures
from .template import DOCUMENT, template

TEMPLATE = json.loads(DOCUMENT)


def _targets():
    return F.array(*[F.struct(F.lit(m["name"]).alias("name"), F.lit(m["x"]).alias("x"), F.lit(m["y"]).alias("y")) for m in TEMPLATE["marks"]])


# -- whole pages ------------------------------------------------------------------------------


def _extraction(spark, sf) -> tuple[DataFrame, DataFrame]:
    specs = T.all_specs(template(spark))
    pages = P.drawn_pages(B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("image_id")), TEMPLATE, specs)
    return E.extract_sheets(pages, specs, TEMPLATE)


def extract_sheets(spark, sf):
    """Drawn pages to sheets: registered, warped, aligned by blocks, cropped, labelled, decoded."""
    sheets, _ = _extraction(spark, sf)
    return sheets.select("image_id", "status", "error", "marker_source", "sbd", "sbd_status", "exam_code", "exam_code_status", "alignment_status", "review_item_count", "auto_pass", "crop_count")


def extract_items(spark, sf):
    _, items = _extraction(spark, sf)
    return items.select("image_id", "section", "item_id", "value", "status", "need_review")


def _printed(spark, sf) -> tuple[DataFrame, DataFrame]:
    specs = T.all_specs(template(spark))
    return P.drawn_pages(B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("image_id")), TEMPLATE, specs, printed=True), specs


def refined_grids(spark, sf):
    """Grid blocks fitted to the circles printed on pages, one block lying beside its place or missing."""
    pages, specs = _printed(spark, sf)
    found = E.grid_blocks(E.page_bubbles(E.registered_pages(pages, TEMPLATE), specs, TEMPLATE, refine=True).where("spec_ord is not null"))
    there = F.col("status") == "ok"
    shift = lambda c: F.when(there, (4 * F.round(F.col(c) / 4)).cast("int")).alias(c)  # noqa: E731  blocks lie whole steps of 4 aside
    close = F.coalesce(F.col("grid_residual_px") <= 1.5, F.lit(False))
    return found.select("image_id", "grid_block", there.alias("fitted"), F.when(there, F.col("method")).alias("method"), (there & close).alias("close"), shift("shift_x"), shift("shift_y"))


def refined_sheets(spark, sf):
    """The same pages to sheets: what is read where the grid was moved, and the grid's say in the sheet's status."""
    pages, specs = _printed(spark, sf)
    sheets, items = E.extract_sheets(pages, specs, TEMPLATE, refine=True)
    moved = items.where("item_id = 'III_003'").select("image_id", F.col("value").alias("moved_value"))
    shown = sheets.select("image_id", "status", "error", "grid_status", "alignment_status", "sbd", "exam_code", "crop_count")
    return shown.join(moved, "image_id", "left")


def extract_pictures(spark, sf):
    """Small pictures as one question each: the crops of their quarters, labelled by rank and decoded."""
    pictures = _pictures(spark, sf, F.col("vec_id")).withColumnRenamed("name", "image_id")
    bubbles = E.picture_bubbles(pictures, [(0, 0, 4, 4), (4, 0, 8, 4), (0, 4, 4, 8), (4, 4, 8, 8)], "ABCD")
    ranked = R.relabel_by_rank(bubbles, score="fill_score", filled_threshold=0.08, margin_threshold=0.025)
    return Q._shown(D.decode_questions(ranked)).drop("item_id")


# -- marks ------------------------------------------------------------------------------------


def _scanned_marks(spark, sf) -> DataFrame:
    """Pages of suppliers: boxes of the template's marks under an affine, some missing, and a stray box."""
    k = F.col("image_id")
    mod = lambda n: F.pmod(k, F.lit(n))
    a, b, tx, ty = 1.0 + 0.002 * mod(5), 0.001 * mod(3), mod(9) - 4.0, mod(7) - 3.0
    gone = lambda t: ((mod(4) == 1) & (t["name"] == "bottom_right")) | ((mod(4) == 2) & t["name"].isin("bottom_right", "bottom_left")) | ((mod(4) == 3) & (t["name"] == "part1_left_top"))
    boxes = F.transform(
        F.filter(_targets(), lambda t: ~gone(t)), lambda t: F.struct((a * t.x + b * t.y + tx - 15).alias("x"), (a * t.y - b * t.x + ty - 15).alias("y"), F.lit(30.0).alias("w"), F.lit(30.0).alias("h"), F.lit(900.0).alias("area"))
    )
    stray = F.array(F.struct(F.lit(30.0).alias("x"), F.lit(1010.0).alias("y"), F.lit(20.0).alias("w"), F.lit(20.0).alias("h"), F.lit(350.0).alias("area")))
    rows = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("image_id"))
    return rows.withColumn("boxes", F.concat(stray, boxes)).withColumns({"width": F.lit(1650.0), "height": F.lit(2363.0)})


def _matched_marks(spark, sf) -> DataFrame:
    rows = _scanned_marks(spark, sf).withColumn("boxes", M.held(E.candidates(F.col("boxes"), F.col("width"), F.col("height"))))
    rows = rows.withColumn("corners", M.corner_marks(F.col("boxes"), F.col("width"), F.col("height")))
    rows = M.with_bootstrap(rows, "corners", _targets())
    return M.with_registration_marks(rows, "marks", "boxes", "corners", "start", _targets(), 36.0)


def registration_marks(spark, sf):
    """Marks found by the corners' bootstrap; with fewer than three corners those alone."""
    found = _matched_marks(spark, sf).select("image_id", F.explode("marks").alias("m"))
    return found.select("image_id", "m.name", F.round("m.x", 3).alias("x"), F.round("m.y", 3).alias("y"))


def _clean(c, n: int):
    """Rounded, without a negative zero."""
    return F.round(c, n) + 0.0


def warp_matrix(spark, sf):
    """A page's transform from its marks, or which corners it lacks."""
    rows = M.with_warp(_matched_marks(spark, sf), "marks", _targets()).withColumnRenamed("matrix", "m")
    names = ("m00", "m01", "m02", "m10", "m11", "m12")
    return rows.select("image_id", F.size("marks").alias("n"), "error", *[_clean(F.element_at("m", i + 1), 5 if i % 3 < 2 else 2).alias(n) for i, n in enumerate(names)])


def detector_marks(spark, sf):
    """A detector's peaks matched to the template, its corners taken in turn; and whether the rules do better."""
    rows = _matched_marks(spark, sf)
    k = F.col("image_id")
    mod = lambda n: F.pmod(k, F.lit(n))
    a, b, tx, ty = 1.0 + 0.002 * mod(5), 0.001 * mod(3), mod(9) - 4.0, mod(7) - 3.0
    seen = F.filter(_targets(), lambda t: ~((mod(4) == 3) & (t["name"] == "part1_left_top")))
    peaks = F.transform(seen, lambda t: F.struct((a * t.x + b * t.y + tx).alias("x"), (a * t.y - b * t.x + ty).alias("y"), F.lit(0.9).alias("score")))
    # A weaker peak close beside the first: the nearer one is matched.
    near = F.transform(F.slice(peaks, 1, 1), lambda p: F.struct((p.x + 6).alias("x"), (p.y + 6).alias("y"), F.lit(0.3).alias("score")))
    peaks = F.when(F.pmod("image_id", F.lit(10)) == 0, F.slice(peaks, 1, 0)).when(F.pmod("image_id", F.lit(10)) == 5, F.slice(peaks, 1, 2)).otherwise(F.concat(peaks, near))
    rows = M.with_corner_peaks(rows.withColumn("peaks", M.held(peaks)), "c", F.col("peaks"), F.col("width"), F.col("height"))
    rows = M.with_peak_marks(M.with_bootstrap(rows.drop("start"), "c", _targets()), "d", "peaks", "c", "start", _targets(), 36.0)
    chosen, source = M.better_marks(F.col("d.marks").cast("array<struct<name:string,x:double,y:double,distance:double>>"), F.transform("marks", lambda m: F.struct(m["name"].alias("name"), m.x.alias("x"), m.y.alias("y"), F.lit(0.0).alias("distance"))), _targets())
    return rows.select("image_id", "d.status", "d.method", "d.n_peaks", "d.reach", F.size("d.corners").alias("n_corners"), F.size("d.marks").alias("n_marks"), F.size(chosen).alias("n_chosen"), source.alias("marker_source"))


def block_alignment(spark, sf):
    """The four blocks of pages whose marks are all off by the same few pixels, some marks missing."""
    k = F.col("image_id")
    mod = lambda n: F.pmod(k, F.lit(n))
    gone = lambda t: (mod(4) == 1) & (t["name"] == "bottom_right") | (mod(4) == 2) & t["name"].isin("bottom_right", "bottom_left") | (mod(4) == 3) & t["name"].startswith("part")
    box = lambda t: F.struct((t.x + mod(5) - 17.0).alias("x"), (t.y + mod(3) - 16.0).alias("y"), F.lit(30.0).alias("w"), F.lit(30.0).alias("h"))
    rows = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("image_id"))
    rows = rows.withColumn("boxes", M.held(F.transform(F.filter(_targets(), lambda t: ~gone(t)), box)))
    rows = M.with_marks_by_position(rows, "marks", "boxes", _targets(), 36.0)
    rows = rows.withColumn("points", M.held(M.block_points(F.col("marks"), _targets()))).withColumn("fits", M.held(M.local_fits("points")))
    found = rows.select("image_id", F.explode("fits").alias("f"))
    return found.select(
        "image_id", "f.block", "f.method", "f.status", "f.marker_count", F.round("f.confidence", 2).alias("confidence"), "f.pre_rms", _clean(F.col("f.rms"), 2).alias("rms"), _clean(F.element_at("f.matrix", 3), 3).alias("shift_x"), _clean(F.element_at("f.matrix", 6), 3).alias("shift_y")
    )


# -- exact fits -------------------------------------------------------------------------------

_LATTICE = [(0, 0), (410, 0), (0, 430), (410, 430), (150, 200), (150, 0), (410, 200), (0, 200), (150, 430)]


def _fitted(spark, sf, outliers: bool) -> DataFrame:
    """Points under an affine of each part's own; with outliers, two of nine are far off."""
    k = F.col("p_partkey")
    mod = lambda n: F.pmod(k, F.lit(n))
    points = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(x)).alias("sx"), F.lit(float(y)).alias("sy")) for i, (x, y) in enumerate(_LATTICE)])
    p = B.table(spark, sf, "part").select("p_partkey", F.explode(points).alias("p")).select("p_partkey", "p.*")
    off = F.when(F.col("i").isin(2, 6), 60.0 + mod(9)).otherwise(0.0) if outliers else F.lit(0.0)
    dx = (1 + 0.01 * mod(5)) * F.col("sx") + 0.02 * mod(4) * F.col("sy") + mod(11) - 5
    dy = -0.01 * mod(3) * F.col("sx") + (1 - 0.02 * mod(6)) * F.col("sy") + mod(13) - 6
    rows = p.select(F.col("p_partkey").alias("image_id"), F.lit("grid").alias("block"), "i", "sx", "sy", (dx + off).alias("dx"), (dy - off).alias("dy"), F.lit(9).alias("expected"))
    return rows if outliers else rows.where(F.col("i") < 3 + F.pmod("image_id", F.lit(4)))


def _matrix(rows: DataFrame) -> list:
    return [_clean(F.element_at("matrix", i + 1), 5 if i % 3 < 2 else 2).alias(n) for i, n in enumerate(("m00", "m01", "m02", "m10", "m11", "m12"))]


def exact_block_fits(spark, sf):
    """Affines and homographies of points that fit exactly: the transform itself comes back."""
    found = G.fit_local(_fitted(spark, sf, False).drop("expected"))
    return found.select("image_id", "method", "status", "n", _clean(F.col("rms"), 3).alias("rms"), F.round("confidence", 4).alias("confidence"), *_matrix(found))


def exact_grid_fits(spark, sf):
    """Robust affines of nine points, two of them far off: the others' transform comes back."""
    found = G.fit_grid(_fitted(spark, sf, True))
    return found.select("image_id", "method", "status", "n", "n_inliers", _clean(F.col("rms"), 3).alias("rms"), F.round("confidence", 6).alias("confidence"), "decode_allowed", *_matrix(found))


def grid_report(spark, sf):
    """The robust fits as a run reports them, with the circles that were there."""
    rows = _fitted(spark, sf, True)
    circles = rows.groupBy("image_id", "block").agg((F.count(F.lit(1)) + F.pmod("image_id", F.lit(3))).alias("circle_count"))
    found = G.transform_info(G.fit_grid(rows), circles)
    return found.select("image_id", "block", "status", "method", "confidence", "decode_allowed", "circle_count", "matched_count", "inlier_count", _clean(F.col("grid_residual_px"), 2).alias("grid_residual_px"), _clean(F.col("rms_error_px"), 2).alias("rms_error_px"))


def predicted_crops(spark, sf):
    """Crops given as files: found, decoded, measured, and labelled by a model."""
    folder = scratch(spark, "crops")
    O.write_pictures(_pictures(spark, sf, F.concat(F.lit("crop_"), F.col("vec_id").cast("string"))), folder).write.format("noop").mode("overwrite").save()
    found = I.collect_images(spark, folder=folder)
    crops = I.gray_images(I.decode_images(spark, folder)).join(found.select("image_id"), "image_id", "left_semi")
    features = E.picture_bubbles(crops, [(0, 0, 8, 8)], ["A"]).select("image_id", "darkness_score", "ink_ratio_inside")
    rows = A.predict_rows(features, ["darkness_score", "ink_ratio_inside"], lambda: A.linear_scorer([6.0, 4.0], -3.0))
    return rows.select("image_id", "pred_label", "pred_confidence", "filled_probability", "blank_probability", "argmax_label", "argmax_confidence", "filled_threshold")


# -- layout models ----------------------------------------------------------------------------


def layout_predictions(spark, sf):
    """What a layout model's three heat maps say about each picture."""
    pixels = B.pixels(spark, sf)
    maps = (("page", F.col("p")), ("marker", F.col("p")), ("bubble", -F.col("p")))
    heat = pixels.select("image_id", "y", "x", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), v.alias("p")) for c, v in maps])).alias("m")).select("image_id", "m.channel", "y", "x", "m.p")
    found = Y.layout_predictions(heat, 2.5, 1.5, page=0.05, marker=0.1, bubble=0.12, radius=1, most=6)
    first = lambda c: F.get(c, 0)
    return found.select("image_id", "n_markers", "n_bubbles", *[F.get("page", i).alias(f"page_{i}") for i in range(4)], first("markers")["x"].alias("marker_x"), first("markers")["model_y"].alias("marker_y"), first("bubbles")["score"].alias("bubble_score"))


def evaluate_layout(spark, sf):
    """Loss, Dice and peaks of a layout model over the pictures."""
    pixels, logits = B.pixels(spark, sf), V._logits(spark, sf)
    peaks = V._peaks(spark, sf).withColumnRenamed("p", "score").withColumn("id", F.col("id").cast("int"))
    sizes = logits.select("batch_id").distinct().withColumn("size", F.col("batch_id") + 1)
    return Y.evaluate_layout(logits, sizes, peaks, B.lattice(pixels).where("id % 3 = 0"), {"page": 3.0, "marker": 50.0, "bubble": 10.0, "grid": 6.0}, 1.5)


def layout_dataset(spark, sf):
    """The manifest of a layout model's training samples: clean ones and two moved ones of each sheet of a split."""
    document = template(spark)
    splits = L.seeded_split(B.manifest(spark, sf), {"train": 20, "val": 6, "test": 4})
    marks = document.select(F.explode("marks").alias("m")).select(F.lit("marker").alias("kind"), F.col("m.name").alias("id"), F.col("m.x").cast("double").alias("x"), F.col("m.y").cast("double").alias("y"))
    points = marks.union(T.label_points(document).select(F.lit("bubble"), "id", "x", "y"))
    geometry = Y.training_geometry(splits, 1650, 2363, 832, 1192, augmented=2, seed=7, shift=90.0, bend=0.0)
    labels = Y.training_labels(geometry, points, 832, 1192, occluded=0.3, seed=11)
    return Y.training_manifest(labels, splits)


QUERIES = {
    f.__name__: f
    for f in (
        extract_sheets, extract_items, extract_pictures, refined_grids, refined_sheets, registration_marks, warp_matrix, detector_marks, block_alignment, exact_block_fits, exact_grid_fits, layout_predictions, evaluate_layout,
        layout_dataset, grid_report, predicted_crops,
    )
}

D_LABELS = DETAIL["label_points"]
_MARKS = " UNION ALL ".join(f"SELECT {i} AS i, '{m['name']}' AS name, {m['x']}.0::DOUBLE AS x, {m['y']}.0::DOUBLE AS y" for i, m in enumerate(TEMPLATE["marks"]))
_CORNER = "name IN ('top_left', 'top_right', 'bottom_right', 'bottom_left')"
SCANNED = f"""mk AS ({_MARKS}), pg AS (SELECT s_suppkey AS image_id, s_suppkey % 4 AS m4, 1.0::DOUBLE + 0.002::DOUBLE * (s_suppkey % 5) AS a, 0.001::DOUBLE * (s_suppkey % 3) AS b, s_suppkey % 9 - 4.0::DOUBLE AS tx, s_suppkey % 7 - 3.0::DOUBLE AS ty FROM supplier),
sc AS (SELECT pg.*, i, name, x AS dx, y AS dy, a * x + b * y + tx AS sx, a * y - b * x + ty AS sy FROM pg, mk
  WHERE NOT ((m4 = 1 AND name = 'bottom_right') OR (m4 = 2 AND name IN ('bottom_right', 'bottom_left')) OR (m4 = 3 AND name = 'part1_left_top')))"""
_FOUND = f"fo AS (SELECT * FROM sc WHERE m4 <> 2 OR {_CORNER})"
# Where the equations of an affine (a, b; -b, a) and shift are turned round.
_BACK = "a / (a * a + b * b) AS m00, -b / (a * a + b * b) AS m01, (-a * tx + b * ty) / (a * a + b * b) AS m02, b / (a * a + b * b) AS m10, a / (a * a + b * b) AS m11, (-b * tx - a * ty) / (a * a + b * b) AS m12"


def _shown_matrix(known: str) -> str:
    return ", ".join(f"CASE WHEN {known} THEN round(m{r}{c}, {2 if c == 2 else 5}) + 0.0::DOUBLE END AS m{r}{c}" for r in (0, 1) for c in (0, 1, 2))


_FIT = """pt AS (SELECT * FROM (VALUES {points}) v(i, sx, sy)),
fk AS (SELECT p_partkey AS k, 1 + 0.01::DOUBLE * (p_partkey % 5) AS m00, 0.02::DOUBLE * (p_partkey % 4) AS m01, p_partkey % 11 - 5.0::DOUBLE AS m02, -0.01::DOUBLE * (p_partkey % 3) AS m10, 1 - 0.02::DOUBLE * (p_partkey % 6) AS m11, p_partkey % 13 - 6.0::DOUBLE AS m12 FROM part)""".format(
    points=", ".join(f"({i}, {x}.0, {y}.0)" for i, (x, y) in enumerate(_LATTICE))
)
_TRUE = """nk AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey NOT IN (23, 24)),
it AS (
  SELECT k, 'identity' AS section, 'sbd' AS item_id, (SELECT string_agg(CAST((7 * k + 3 * s) % 10 AS VARCHAR), '' ORDER BY s) FROM range(1, 9) t(s)) AS value FROM nk
  UNION ALL SELECT k, 'identity', 'exam_code', (SELECT string_agg(CAST((k + s) % 10 AS VARCHAR), '' ORDER BY s) FROM range(1, 5) t(s)) FROM nk
  UNION ALL SELECT k, 'part1', format('I_{:03d}', q), CASE WHEN q % 11 <> 5 THEN ['A', 'B', 'C', 'D'][(k + q) % 4 + 1] END FROM nk, range(1, 41) t(q)
  UNION ALL SELECT k, 'part2', format('II_{:03d}_{}', q, chr(CAST(96 + s AS INTEGER))), ['T', 'F'][(k + q + s) % 2 + 1] FROM nk, range(1, 9) t(q), range(1, 5) u(s)
  UNION ALL SELECT k, 'part3', format('III_{:03d}', q), CASE WHEN (k + q) % 2 = 0 THEN '-' ELSE '' END || (SELECT string_agg(CAST((k + q + s) % 10 AS VARCHAR) || CASE WHEN s = (k + q) % 2 + 1 THEN ',' ELSE '' END, '' ORDER BY s) FROM range(1, 5) u(s)) FROM nk, range(1, 7) t(q))"""
_CROPS = """
qp AS (SELECT image_id, gray, (y // 4) * 2 + x // 4 + 1 AS spec_ord, sqrt((x % 4 - 1.5::DOUBLE) * (x % 4 - 1.5::DOUBLE) + (y % 4 - 1.5::DOUBLE) * (y % 4 - 1.5::DOUBLE)) AS d FROM px),
q1 AS (SELECT image_id, spec_ord, avg(CAST(gray < 100 AS DOUBLE)) AS dark, avg(CAST(gray < 100 AS DOUBLE)) FILTER (d <= 1.44::DOUBLE) AS inn, avg(CAST(gray < 100 AS DOUBLE)) FILTER (d >= 1.76::DOUBLE) AS noise,
  greatest(80.0::DOUBLE, least(190.0::DOUBLE, round(quantile_cont(gray, 0.2) FILTER (d >= 1.76::DOUBLE), 9) - 20)) AS lim FROM qp GROUP BY image_id, spec_ord),
q2 AS (SELECT image_id, spec_ord, avg(CAST(gray < lim AS DOUBLE)) AS ink FROM qp JOIN q1 USING (image_id, spec_ord) WHERE d <= 1.16::DOUBLE GROUP BY image_id, spec_ord),
b AS (SELECT image_id, 'I_001' AS item_id, 'part1' AS section, CAST(spec_ord AS INTEGER) AS spec_ord, chr(CAST(64 + spec_ord AS INTEGER)) AS choice, round(dark, 6) AS darkness_score,
  round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE * ink + 0.35::DOUBLE * greatest(0, inn - noise) + 0.2::DOUBLE * ink - 0.2::DOUBLE * noise)), 6) AS fill_score, 'none' AS prelabel,
  NULL::VARCHAR AS alignment_status, NULL::DOUBLE AS alignment_confidence, NULL::VARCHAR AS grid_status, NULL::BOOLEAN AS decode_allowed FROM q1 JOIN q2 USING (image_id, spec_ord))"""

ORACLES = {
    "extract_sheets": f"""WITH {_TRUE}, s AS (SELECT k, max(value) FILTER (item_id = 'sbd') AS sbd, max(value) FILTER (item_id = 'exam_code') AS exam_code FROM it GROUP BY k)
SELECT n_nationkey AS image_id, CASE WHEN sbd IS NULL THEN 'error' ELSE 'ok' END AS status, CASE n_nationkey WHEN 24 THEN 'image_read_failed' WHEN 23 THEN 'missing source markers: [''bottom_right'', ''bottom_left'']' END AS error,
  'rule_based' AS marker_source, sbd, CASE WHEN sbd IS NOT NULL THEN 'accepted' END AS sbd_status, exam_code, CASE WHEN sbd IS NOT NULL THEN 'accepted' END AS exam_code_status, CASE WHEN sbd IS NOT NULL THEN 'ok' END AS alignment_status,
  CASE WHEN sbd IS NOT NULL THEN 0 END AS review_item_count, CASE WHEN sbd IS NOT NULL THEN true WHEN true THEN false END AS auto_pass, CASE WHEN sbd IS NOT NULL THEN 602 END AS crop_count FROM nation LEFT JOIN s ON k = n_nationkey""",
    "extract_items": f"WITH {_TRUE} SELECT k AS image_id, section, item_id, value, CASE WHEN value IS NULL THEN 'blank' ELSE 'accepted' END AS status, false AS need_review FROM it",
    "refined_grids": f"""WITH {V.SPECS_SQL}, g AS (SELECT DISTINCT grid_block FROM al), p AS (
  SELECT n_nationkey AS image_id, grid_block, grid_block = '{P.MOVED}' AS moved, n_nationkey % {P.MISSING} <> 3 OR grid_block <> '{P.MOVED}' AS fitted
  FROM nation, g WHERE n_nationkey NOT IN (23, 24))
SELECT image_id, grid_block, fitted, CASE WHEN fitted THEN 'affine' END AS method, fitted AS close,
  CAST(CASE WHEN fitted THEN CASE WHEN moved THEN 4 * (image_id % 5) - 8 ELSE 0 END END AS INTEGER) AS shift_x,
  CAST(CASE WHEN fitted THEN CASE WHEN moved THEN 4 * (image_id % 4) - 4 ELSE 0 END END AS INTEGER) AS shift_y FROM p""",
    "refined_sheets": f"""WITH {_TRUE}, s AS (
  SELECT k, max(value) FILTER (item_id = 'sbd') AS sbd, max(value) FILTER (item_id = 'exam_code') AS exam_code, max(value) FILTER (item_id = 'III_003') AS third FROM it GROUP BY k)
SELECT n_nationkey AS image_id, CASE WHEN sbd IS NULL THEN 'error' WHEN n_nationkey % {P.MISSING} = 3 THEN 'need_review' ELSE 'ok' END AS status,
  CASE n_nationkey WHEN 24 THEN 'image_read_failed' WHEN 23 THEN 'missing source markers: [''bottom_right'', ''bottom_left'']' END AS error,
  CASE WHEN sbd IS NOT NULL THEN CASE WHEN n_nationkey % {P.MISSING} = 3 THEN 'need_review' ELSE 'ok' END END AS grid_status, CASE WHEN sbd IS NOT NULL THEN 'ok' END AS alignment_status,
  sbd, exam_code, CASE WHEN sbd IS NOT NULL THEN 602 END AS crop_count, CASE WHEN n_nationkey % {P.MISSING} <> 3 THEN third END AS moved_value
FROM nation LEFT JOIN s ON k = n_nationkey""",
    "extract_pictures": f"WITH {V.PIXELS_SQL},{_CROPS},{Q.relabel_sql('fill_score', 0.08, 0.025)},{Q.decode_sql(True, 0.08, 0.025)} SELECT {Q.ITEM_SQL.replace('item_id, ', '')} FROM f",
    "registration_marks": f"WITH {SCANNED}, {_FOUND} SELECT image_id, name, round(sx, 3) AS x, round(sy, 3) AS y FROM fo",
    "warp_matrix": f"""WITH {SCANNED}, {_FOUND}, n AS (SELECT image_id, m4, a, b, tx, ty, count(*) AS n FROM fo GROUP BY ALL), r AS (SELECT *, {_BACK} FROM n)
SELECT image_id, CAST(n AS INTEGER) AS n, CASE WHEN m4 = 2 THEN 'missing source markers: [''bottom_right'', ''bottom_left'']' END AS error, {_shown_matrix("m4 <> 2")} FROM r""",
    "detector_marks": f"""WITH {SCANNED}, {_FOUND}, ru AS (SELECT image_id, m4, count(*) AS ruled FROM fo GROUP BY image_id, m4),
q AS (SELECT *, CASE WHEN image_id % 10 = 0 THEN 0 WHEN image_id % 10 = 5 THEN 2 WHEN m4 = 3 THEN 10 ELSE 11 END AS np FROM ru),
d AS (SELECT *, CASE WHEN np > 2 THEN np - 1 ELSE 0 END AS nm FROM q)
SELECT image_id, CASE np WHEN 0 THEN 'no_marker_peaks' WHEN 2 THEN 'insufficient_corners' ELSE 'ok' END AS status, CASE np WHEN 0 THEN 'none' WHEN 2 THEN 'insufficient_corners' ELSE 'homography' END AS method,
  np AS n_peaks, CASE WHEN np > 2 THEN 36.0::DOUBLE END AS reach, least(np, 4) AS n_corners, nm AS n_marks, CASE WHEN nm < 10 AND ruled > nm THEN ruled ELSE nm END AS n_chosen,
  CASE WHEN nm < 10 AND ruled > nm THEN 'rule_based_fallback_after_layout_v0' ELSE 'layout_v0' END AS marker_source FROM d""",
    "block_alignment": f"""WITH mk AS ({_MARKS}), bl AS (SELECT * FROM (VALUES {", ".join(f"('{b}', '{n}')" for b, (_, names) in M.BLOCKS.items() for n in names)}) v(block, name)),
c AS (SELECT s_suppkey AS k, block, count(*) FILTER (NOT ((s_suppkey % 4 = 1 AND mk.name = 'bottom_right') OR (s_suppkey % 4 = 2 AND mk.name IN ('bottom_right', 'bottom_left')) OR (s_suppkey % 4 = 3 AND starts_with(mk.name, 'part')))) AS n
  FROM supplier, bl JOIN mk USING (name) GROUP BY 1, 2),
e AS (SELECT *, k % 5 - 2.0::DOUBLE AS ex, k % 3 - 1.0::DOUBLE AS ey FROM c)
SELECT k AS image_id, block, CASE WHEN n >= 4 THEN 'homography' WHEN n = 3 THEN 'affine' WHEN n > 0 THEN 'translation' ELSE 'identity' END AS method, CASE WHEN n >= 3 THEN 'ok' WHEN n > 0 THEN 'fallback_translation' ELSE 'fallback_global' END AS status,
  CAST(n AS INTEGER) AS marker_count, round(n / 4, 2) AS confidence, CASE WHEN n > 0 THEN round(sqrt(ex * ex + ey * ey), 3) END AS pre_rms, CASE WHEN n > 0 THEN 0.0::DOUBLE END AS rms,
  CASE WHEN n > 0 THEN -ex + 0.0::DOUBLE ELSE 0 END AS shift_x, CASE WHEN n > 0 THEN -ey + 0.0::DOUBLE ELSE 0 END AS shift_y FROM e""",
    "exact_block_fits": f"""WITH {_FIT}, n AS (SELECT *, CAST(3 + k % 4 AS INTEGER) AS n FROM fk)
SELECT k AS image_id, CASE WHEN n = 3 THEN 'affine' ELSE 'homography' END AS method, 'ok' AS status, n, 0.0::DOUBLE AS rms, CASE WHEN n = 3 THEN 0.75::DOUBLE ELSE 1 END AS confidence, {_shown_matrix("true")} FROM n""",
    "exact_grid_fits": f"WITH {_FIT} SELECT k AS image_id, 'affine' AS method, 'ok' AS status, 9 AS n, 7 AS n_inliers, 0.0::DOUBLE AS rms, round(7 / 9, 6) AS confidence, true AS decode_allowed, {_shown_matrix('true')} FROM fk",
    "layout_predictions": f"""WITH {V.PIXELS_SQL}, ht AS (SELECT image_id, 'marker' AS c, y, x, p, 0.1::DOUBLE AS t FROM px UNION ALL SELECT image_id, 'bubble', y, x, -p, 0.12::DOUBLE FROM px),
m1 AS (SELECT *, max(p) OVER (PARTITION BY image_id, c, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM ht),
m2 AS (SELECT *, max(m) OVER (PARTITION BY image_id, c, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mm FROM m1),
pk AS (SELECT image_id, c, y, x, p, row_number() OVER (PARTITION BY image_id, c ORDER BY p DESC, y, x) AS r FROM m2 WHERE p >= t AND p >= mm - 1e-6::DOUBLE QUALIFY r <= 6),
bx AS (SELECT image_id, round(min(x) * 2.5::DOUBLE, 3) AS page_0, round(min(y) * 1.5::DOUBLE, 3) AS page_1, round((max(x) + 1) * 2.5::DOUBLE, 3) AS page_2, round((max(y) + 1) * 1.5::DOUBLE, 3) AS page_3 FROM px WHERE p >= 0.05::DOUBLE GROUP BY image_id),
ag AS (SELECT image_id, CAST(count(*) FILTER (c = 'marker') AS INTEGER) AS n_markers, CAST(count(*) FILTER (c = 'bubble') AS INTEGER) AS n_bubbles, max(round(x * 2.5::DOUBLE, 3)) FILTER (c = 'marker' AND r = 1) AS marker_x,
  max(CAST(y AS DOUBLE)) FILTER (c = 'marker' AND r = 1) AS marker_y, max(round(p, 6)) FILTER (c = 'bubble' AND r = 1) AS bubble_score FROM pk GROUP BY image_id)
SELECT i.image_id, coalesce(n_markers, 0) AS n_markers, coalesce(n_bubbles, 0) AS n_bubbles, bx.* EXCLUDE (image_id), marker_x, marker_y, bubble_score
FROM (SELECT DISTINCT image_id FROM px) i LEFT JOIN ag ON ag.image_id = i.image_id LEFT JOIN bx ON bx.image_id = i.image_id""",
    "evaluate_layout": f"""SELECT l.loss, d.mean_dice, p.* FROM (SELECT round(sum(loss * (batch_id + 1)) / sum(batch_id + 1), 4) AS loss FROM ({V.ORACLES['layout_loss']})) l,
  (SELECT round(sum(dice * (batch_id + 1)) / sum(batch_id + 1), 4) AS mean_dice FROM (SELECT batch_id, avg(dice) AS dice FROM ({V.ORACLES['dice_mse']}) GROUP BY batch_id)) d, ({V.ORACLES['peak_prf']}) p""",
    "layout_dataset": f"""WITH {V.SPECS_SQL}, mk AS ({_MARKS}), pt AS (SELECT 'marker' AS kind, name AS id, x, y FROM mk UNION ALL SELECT 'bubble', id, x, y FROM ({D_LABELS})),
r AS (SELECT doc_id AS k, row_number() OVER (ORDER BY sha1('20260619:' || doc_id), doc_id) AS n FROM documents),
s AS (SELECT k, CASE WHEN n <= 20 THEN 'train' WHEN n <= 26 THEN 'val' ELSE 'test' END AS split FROM r WHERE n <= 30),
g AS (SELECT k, split, i, k || CASE i WHEN 0 THEN '_clean' ELSE format('_aug{{:03d}}', i) END AS sample_id,
  CASE WHEN i > 0 THEN 90.0::DOUBLE * (CAST(concat('0x', substr(sha1('7:' || k || ':' || i || ':x'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE * 2 - 1) ELSE 0 END AS dx,
  CASE WHEN i > 0 THEN 90.0::DOUBLE * (CAST(concat('0x', substr(sha1('7:' || k || ':' || i || ':y'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE * 2 - 1) ELSE 0 END AS dy FROM s, range(0, 3) a(i)),
l AS (SELECT sample_id, k, split, i, kind, round(x * (832 / 1650.0::DOUBLE) + dx, 3) AS x, round(y * (1192 / 2363.0::DOUBLE) + dy, 3) AS y,
  kind = 'marker' AND i > 0 AND CAST(concat('0x', substr(sha1('11:' || sample_id || ':' || id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < 0.3::DOUBLE AS covered FROM g, pt)
SELECT sample_id, k AS base_image_id, split, 'images/' || split || '/' || sample_id || '.jpg' AS image_path, 'labels/' || split || '/' || sample_id || '.json' AS label_path, i = 0 AS clean,
  count(*) FILTER (kind = 'marker' AND NOT covered AND x >= 0 AND x < 832 AND y >= 0 AND y < 1192) AS visible_markers, count(*) FILTER (kind = 'bubble' AND x >= 0 AND x < 832 AND y >= 0 AND y < 1192) AS visible_bubbles FROM l GROUP BY ALL""",
    "grid_report": f"WITH {_FIT} SELECT k AS image_id, 'grid' AS block, 'ok' AS status, 'affine' AS method, round(7 / 9, 3) AS confidence, true AS decode_allowed, 9 + k % 3 AS circle_count, 9 AS matched_count, 7 AS inlier_count, "
    "0.0::DOUBLE AS grid_residual_px, 0.0::DOUBLE AS rms_error_px FROM fk",
    "predicted_crops": f"""WITH {V.PIXELS_SQL},{V.FEATURES_SQL}, p AS (SELECT image_id, 1 / (1 + exp(-(6.0::DOUBLE * round(darkness, 6) + 4.0::DOUBLE * round(ink, 6) - 3.0::DOUBLE))) AS p FROM f1 JOIN f2 USING (image_id))
SELECT 'crop_' || image_id AS image_id, CASE WHEN p >= 0.5::DOUBLE THEN 'filled' ELSE 'blank' END AS pred_label, round(CASE WHEN p >= 0.5::DOUBLE THEN p ELSE 1 - p END, 6) AS pred_confidence, round(p, 6) AS filled_probability,
  round(1 - p, 6) AS blank_probability, CASE WHEN p > 1 - p THEN 'filled' ELSE 'blank' END AS argmax_label, round(greatest(p, 1 - p), 6) AS argmax_confidence, 0.5::DOUBLE AS filled_threshold FROM p""",
}
