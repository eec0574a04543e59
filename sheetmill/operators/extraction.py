"""Pages to decoded sheets.

A page's pixels stay in its row: they pass two kernels, one that brings the page to its template's size
and one that measures its bubbles, and are never shuffled.  What is shuffled, once and by page, are
the bubbles' few numbers; labels, items and sheets are plans over those.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..sources.scratch import computed_once
from . import decode as D
from . import ranking as R
from . import registration as G
from . import sheets as H
from .circles import grid_names, outlined, refined_grids
from .raster import component_sizes

BOX = "array<struct<x:double,y:double,w:double,h:double,area:double>>"
#: What is darker than this can be a mark.
MARK_LIMIT = 130
FEATURES = "darkness_score background_noise darkness_contrast ink_ratio_inside component_score fill_score".split()


# -- kernels: one page, or the bubbles of one page, as arrays ----------------------------------


def dark_boxes(gray: np.ndarray, limit: int = MARK_LIMIT, least: int = 10, most: int = 54) -> np.ndarray:
    """``x, y, w, h, area`` of connected dark areas of a mark's size, by y, then x.  The area is that within the
    outer outline, so that a ring or a hollow square counts as full."""
    boxes = np.array([f[:5] for f in outlined(gray <= limit, least, most)], float).reshape(-1, 5)
    return boxes[np.lexsort((boxes[:, 0], boxes[:, 1]))]


def warped(gray: np.ndarray, matrix: np.ndarray, box: Sequence[int], edge: bool = False) -> np.ndarray:
    """The part ``x1, y1, x2, y2`` of the page under a transform, between pixels in proportion; what lies outside
    the page is black, or with ``edge`` as its border."""
    back = np.linalg.inv(matrix)
    x1, y1, x2, y2 = box
    out = np.empty((y2 - y1, x2 - x1), np.uint8)
    xs = np.arange(x1, x2, dtype=np.float64)
    pad = np.pad(gray, 1, mode="edge" if edge else "constant").astype(np.float32)
    for top in range(y1, y2, 256):  # a strip at a time
        ys = np.arange(top, min(top + 256, y2), dtype=np.float64)[:, None]
        w = back[2, 0] * xs + back[2, 1] * ys + back[2, 2]
        x = np.clip((back[0, 0] * xs + back[0, 1] * ys + back[0, 2]) / w, -1, gray.shape[1])
        y = np.clip((back[1, 0] * xs + back[1, 1] * ys + back[1, 2]) / w, -1, gray.shape[0])
        x0, y0 = np.floor(x).astype(np.int32), np.floor(y).astype(np.int32)
        fx, fy = (x - x0).astype(np.float32), (y - y0).astype(np.float32)
        xr, yr = np.minimum(x0 + 1, gray.shape[1]), np.minimum(y0 + 1, gray.shape[0])
        upper = pad[y0 + 1, x0 + 1] * (1 - fx) + pad[y0 + 1, xr + 1] * fx
        lower = pad[yr + 1, x0 + 1] * (1 - fx) + pad[yr + 1, xr + 1] * fx
        out[top - y1 : top - y1 + len(ys)] = np.rint(upper * (1 - fy) + lower * fy)
    return out


def aligned(page: np.ndarray, fits: Sequence[dict], regions: dict[str, Sequence[int]], margin: int) -> np.ndarray:
    """A page whose blocks are each moved by their own transform; later blocks lie over earlier ones."""
    height, width = page.shape
    out = page.copy()
    for fit in fits:
        for name in G.BLOCKS[fit["block"]][0]:
            if name in regions:
                x1, y1, x2, y2 = regions[name]
                box = max(0, x1 - margin), max(0, y1 - margin), min(width, x2 + margin), min(height, y2 + margin)
                moved = page[box[1] : box[3], box[0] : box[2]] if fit["status"] == "fallback_global" else warped(page, np.array(fit["matrix"]).reshape(3, 3), box, edge=True)
                out[box[1] : box[3], box[0] : box[2]] = moved
    return out


def crop_features(page: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """The six features of each box ``x1, y1, x2, y2`` (all of one size), white where it leaves the page."""
    w, h = (boxes[0, 2:] - boxes[0, :2]).tolist()
    ys = boxes[:, 1, None, None] + np.arange(h)[None, :, None]
    xs = boxes[:, 0, None, None] + np.arange(w)[None, None, :]
    inside = (ys >= 0) & (ys < page.shape[0]) & (xs >= 0) & (xs < page.shape[1])
    crops = np.where(inside, page[np.clip(ys, 0, page.shape[0] - 1), np.clip(xs, 0, page.shape[1] - 1)], 255)
    gy, gx = np.mgrid[:h, :w]
    far, r = np.sqrt((gx - (w - 1) / 2) ** 2 + (gy - (h - 1) / 2) ** 2), min(w, h) / 2
    core, inner, ground = far <= 0.58 * r, far <= 0.72 * r, far >= 0.88 * r
    dark = crops < 100
    darkness = dark.mean(axis=(1, 2))
    if not (core.any() and inner.any() and ground.any()):
        return np.stack([darkness, 0 * darkness, 0 * darkness, darkness, 0 * darkness, darkness], axis=1)
    noise = dark[:, ground].mean(axis=1)
    contrast = np.maximum(0, dark[:, inner].mean(axis=1) - noise)
    limit = np.clip(np.round(np.percentile(crops[:, ground], 20, axis=1), 9) - 20, 80, 190)
    ink = core & (crops < limit[:, None, None])
    share = ink[:, core].mean(axis=1)
    k, y, x = np.nonzero(ink)
    largest = np.zeros(len(boxes), np.int64)
    if len(k):
        np.maximum.at(largest, k, component_sizes(k, y, x))
    component = largest / core.sum()
    fill = np.clip(0.5 * share + 0.35 * contrast + 0.2 * component - 0.2 * noise, 0, 1)
    return np.stack([darkness, noise, contrast, share, component, fill], axis=1)


# -- pages --------------------------------------------------------------------------------------


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "w", "h", "area")])))
def page_boxes(gray: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    names = ("x", "y", "w", "h", "area")
    return pd.Series([[dict(zip(names, b, strict=True)) for b in dark_boxes(np.frombuffer(g, np.uint8).reshape(h, w)).tolist()] if g is not None else [] for g, w, h in zip(gray, width, height, strict=True)])


def candidates(boxes: Column, width: Column, height: Column) -> Column:
    """The boxes that can be marks: about square, mostly filled, near an edge."""
    near = lambda b: (b.x < width * 0.12) | (b.x > width * 0.88) | (b.y < height * 0.12) | (b.y > height * 0.82)
    return F.filter(boxes, lambda b: b.w.between(10, 54) & b.h.between(10, 54) & (b.w / b.h).between(0.55, 1.65) & (b.area / (b.w * b.h) >= 0.45) & near(b))


KNOWN = ("image_id", "error", "marker_source")


def _warp_pages(width: int, height: int):
    """Pages in their template's size and their dark boxes; both null where there is no transform."""
    kind = pa.list_(pa.struct([(c, pa.float64()) for c in ("x", "y", "w", "h", "area")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                w, h, gray, matrix = (row.column(c)[0].as_py() for c in ("width", "height", "gray", "matrix"))
                page = boxes = None
                if gray is not None and matrix is not None:
                    page = warped(np.frombuffer(gray, np.uint8).reshape(h, w), np.array(matrix).reshape(3, 3), (0, 0, width, height))
                    boxes = [dict(zip(("x", "y", "w", "h", "area"), b, strict=True)) for b in dark_boxes(page).tolist()]
                    page = page.tobytes()
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in KNOWN), pa.array([page], pa.binary()), pa.array([boxes], kind)], names=[*KNOWN, "page", "boxes"])

    return run


GRID = "grid_refinement_status string, grid_refinement_confidence double, grid_refinement_decode_allowed boolean, grid_method string, grid_circles int, grid_inliers int, grid_residual_px double, grid_shift array<int>"


def _measure(width: int, height: int, regions: dict, margin: int, boxes: np.ndarray, grids: Sequence[str] | None = None):
    """A row a bubble with its features; a page without a transform has one row, of nulls.  With ``grids``, the names
    of the bubbles' grid blocks, these are first moved to the circles printed around them."""
    keep = (*KNOWN, "blocks")
    blocks = grid_names(grids or [])
    centres = boxes[:, :2] + (boxes[:, 2:] - boxes[:, :2]) // 2
    around = int((boxes[:, 2:] - boxes[:, :2]).max()) + margin - 8 if len(boxes) else 0
    kinds = [pa.string(), pa.float64(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int32())]
    names = [c.split()[0] for c in GRID.split(", ")]

    def refined(page: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        moved, fits = refined_grids(page, blocks, centres, boxes, around)
        rows = [(f["status"], f["confidence"], f["decode_allowed"], f["method"], f["circles"], f["n_inliers"], f["rms"]) for f in map(fits.__getitem__, grids)]
        shifts = (moved[:, :2] - boxes[:, :2]).tolist()
        return moved, [pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=False)] + [pa.array(shifts, kinds[-1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                raw = row.column("page")[0].as_py()
                n = 1 if raw is None else len(boxes)
                same = [row.column(c).take(pa.array(np.zeros(n, np.int64))) for c in keep]
                if raw is None:
                    found = [pa.nulls(1, pa.int32()), *(pa.nulls(1, pa.float64()) for _ in FEATURES), *(pa.nulls(1, kind) for kind in kinds if blocks)]
                else:
                    page = aligned(np.frombuffer(raw, np.uint8).reshape(height, width), row.column("fits")[0].as_py(), regions, margin)
                    moved, info = refined(page) if blocks else (boxes, [])
                    values = crop_features(page, moved)
                    found = [pa.array(np.arange(1, n + 1, dtype=np.int32)), *(pa.array(np.ascontiguousarray(values[:, j])) for j in range(len(FEATURES))), *info]
                yield pa.RecordBatch.from_arrays([*same, *found], names=[*keep, "spec_ord", *FEATURES, *(names if blocks else [])])

    return run


def registered_pages(pages: DataFrame, template: dict, detector: Column | None = None) -> DataFrame:
    """Pages with ``marks``, their ``marker_source``, ``matrix`` and ``error``.

    ``pages``: ``image_id, width, height, gray`` (bytes by rows; null for what could not be read).  A layout
    detector's marks, if its column of ``name, x, y`` structs is given, count unless the rules find more."""
    targets = F.array(*[F.struct(F.lit(m["name"]).alias("name"), F.lit(m["x"]).alias("x"), F.lit(m["y"]).alias("y")) for m in template["marks"]])
    width, height = F.col("width").cast("double"), F.col("height").cast("double")
    reach = max(35.0, 2.0 * template["tolerance"]) if detector is None else max(45.0, 2.5 * template["tolerance"])
    marks, source = G.better_marks(F.col("detected"), F.col("ruled"), targets)
    rows = pages.withColumn("boxes", G.held(page_boxes("gray", "width", "height"))).withColumn("boxes", candidates(F.col("boxes"), width, height))
    rows = rows.withColumn("boxes", G.held(F.col("boxes"))).withColumn("corners", G.corner_marks(F.col("boxes"), width, height))
    rows = G.with_bootstrap(rows, "corners", targets)
    rows = G.with_registration_marks(rows, "ruled", "boxes", "corners", "start", targets, reach)
    rows = rows.withColumn("detected", F.lit(None).cast("array<struct<name:string,x:double,y:double>>") if detector is None else detector)
    rows = G.with_warp(rows.withColumns({"marks": marks, "marker_source": source}), "marks", targets)
    return rows.withColumn("error", F.when(F.col("gray").isNull(), "image_read_failed").otherwise(F.col("error"))).drop("boxes", "corners", "start", "ruled", "detected")


def page_bubbles(pages: DataFrame, specs: DataFrame, template: dict, refine: bool = False) -> DataFrame:
    """Every bubble of the registered pages, with its features and its block's alignment, and a row with a null
    ``spec_ord`` for a page without a transform.  With ``refine``, grids follow the circles printed on the page.

    ``specs``: the template's; they go to the kernel as one small array."""
    width, height = template["canonical"]["width"], template["canonical"]["height"]
    targets = F.array(*[F.struct(F.lit(m["name"]).alias("name"), F.lit(m["x"]).alias("x"), F.lit(m["y"]).alias("y")) for m in template["marks"]])
    rows = specs.orderBy("spec_ord").select("bbox", "grid_block").collect()  # bounded by the template
    boxes, grids = np.array([r["bbox"] for r in rows]), [r["grid_block"] for r in rows] if refine else None
    known = f"image_id {pages.schema['image_id'].dataType.simpleString()}, error string, marker_source string"
    regions = {r["name"]: r["bbox"] for r in template["regions"]}
    straight = pages.select(*KNOWN, "width", "height", "gray", "matrix").mapInArrow(_warp_pages(width, height), f"{known}, page binary, boxes {BOX}")
    found = candidates(F.col("boxes"), F.lit(float(width)), F.lit(float(height)))
    placed = G.with_marks_by_position(straight.withColumn("boxes", G.held(F.coalesce(found, F.array().cast(BOX)))), "marks", "boxes", targets, max(24.0, 2.0 * template["tolerance"]))
    placed = placed.withColumn("points", G.held(G.block_points(F.col("marks"), targets))).withColumn("fits", G.held(G.local_fits("points")))
    fitted = placed.select(*KNOWN, "page", "fits", F.transform("fits", lambda f: F.struct(f.block, f.status, f.confidence, f.method, f.marker_count, f.rms)).alias("blocks"))
    features = ", ".join(f"{c} double" for c in FEATURES)
    measured = fitted.mapInArrow(
        _measure(width, height, regions, template["padding"] + 8, boxes, grids),
        f"{known}, blocks array<struct<block:string,status:string,confidence:double,method:string,marker_count:int,rms:double>>, spec_ord int, {features}" + (f", {GRID}" if refine else ""),
    )
    of_spec = specs.select("spec_ord", "spec_id", "section", "item_id", "choice", "label", "alignment_block", "grid_block")
    block = F.get(F.filter("blocks", lambda b: b.block == F.col("alignment_block")), 0)
    return (
        measured.join(F.broadcast(of_spec), "spec_ord", "left")  # one row a bubble of the template
        .withColumn("_block", block)
        .withColumns({"prelabel": S.prelabel(F.col("fill_score")), "prelabel_source": F.lit("adaptive_rule"), "alignment_status": F.col("_block.status"), "alignment_confidence": F.col("_block.confidence")})
        .withColumns({c: F.round(c, 6) for c in FEATURES})
        .drop("_block", "blocks")
    )


def decoded_pages(bubbles: DataFrame) -> DataFrame:
    """``image_id, section, item_id, value, status, confidence, need_review``: all items of the pages' bubbles.

    Bubbles are dealt by page once; labels and items of a page are found where it lies."""
    dealt = bubbles.repartition("image_id")
    answers = R.relabel_by_rank(dealt.where("section <> 'identity'"), score="fill_score", filled_threshold=S.FILLED_THRESHOLD, margin_threshold=S.MARGIN_THRESHOLD)
    identity = R.relabel_identity(dealt, score="fill_score")
    questions = D.decode_questions(answers.where("section = 'part1'"))
    groups = D.decode_groups(answers.where("section <> 'part1'").unionByName(identity))
    section = F.when(F.col("item_id").startswith("III_"), "part3").when(F.col("item_id").startswith("II_"), "part2").otherwise("identity")
    written = H.decode_sections(groups.withColumn("section", section), groups.select("image_id"))
    one = questions.select("image_id", F.lit("part1").alias("section"), "item_id", F.col("selected").alias("value"), "status", "confidence")
    return one.union(written).withColumn("need_review", F.when(F.col("section") == "identity", F.col("status") != "accepted").otherwise(F.col("status").isin(*H.REVIEW)))


def grid_blocks(bubbles: DataFrame) -> DataFrame:
    """``image_id, grid_block`` and how each grid was fitted, of refined bubbles."""
    return bubbles.groupBy("image_id", "grid_block").agg(
        F.first("grid_refinement_status").alias("status"), F.first("grid_method").alias("method"), F.round(F.first("grid_refinement_confidence"), 6).alias("confidence"), F.first("grid_refinement_decode_allowed").alias("decode_allowed"),
        F.first("grid_circles").alias("circle_count"), F.first("grid_inliers").alias("inlier_count"), F.round(F.first("grid_residual_px"), 3).alias("grid_residual_px"),
        F.round(F.avg(F.element_at("grid_shift", 1)), 3).alias("shift_x"), F.round(F.avg(F.element_at("grid_shift", 2)), 3).alias("shift_y"),
    )


def extract_sheets(pages: DataFrame, specs: DataFrame, template: dict, detector: Column | None = None, refine: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sheets and their items.  A sheet: ``image_id, status, error, marker_source, sbd, sbd_status, exam_code,
    exam_code_status, alignment_status, alignment_confidence, decoded_item_confidence, review_item_count,
    sheet_confidence, auto_pass, crop_count``; a page that can't be read or registered has status error and says why.

    With ``refine``, printed circles are searched for and each grid block is moved to them before its bubbles are
    cropped; sheets then have ``grid_status`` and ``grid_confidence``, and the grid decides on their status."""
    # Pages are read once: what comes of them is slim.
    rows = computed_once(page_bubbles(registered_pages(pages, template, detector), specs, template, refine))
    bubbles = rows.where("spec_ord is not null").drop("error")
    items = decoded_pages(bubbles.drop("marker_source"))
    field = lambda name, c: F.max(F.when(F.col("item_id") == name, F.col(c)))
    found = items.groupBy("image_id").agg(
        field("sbd", "value").alias("sbd"), field("sbd", "status").alias("sbd_status"), field("exam_code", "value").alias("exam_code"), field("exam_code", "status").alias("exam_code_status"),
        H.review_count(F.col("status"), F.col("section")).alias("review_item_count"),
        F.round(F.min(F.when((F.col("section") == "identity") | (F.col("status") != "blank"), F.col("confidence"))), 6).alias("decoded_item_confidence"),
    )
    blocks = bubbles.groupBy("image_id").agg(
        H.alignment_rollup(F.col("alignment_status")).alias("alignment_status"), F.round(F.min("alignment_confidence"), 6).alias("alignment_confidence"), F.count(F.lit(1)).alias("crop_count"),
        (H.grid_rollup(F.col("grid_refinement_status")) if refine else F.lit(None).cast("string")).alias("grid_status"), (F.round(F.min("grid_refinement_confidence"), 6) if refine else F.lit(None).cast("double")).alias("grid_confidence"),
        F.lit(None).cast("string").alias("error"), F.first("marker_source").alias("marker_source"),
    )
    failed = rows.where("spec_ord is null").select("image_id", "error", "marker_source")
    joined = found.join(blocks, "image_id").unionByName(failed, allowMissingColumns=True)
    none = F.lit(None).cast("string")
    joined = joined.withColumn("sheet_status", F.when(F.col("error").isNotNull(), "error").otherwise(H.sheet_status(F.col("grid_status"), none, F.col("alignment_status"))))
    sheets = H.confidence_summary(joined).withColumnRenamed("sheet_status", "status")
    return (sheets if refine else sheets.drop("grid_confidence", "grid_status")), items


def picture_bubbles(pictures: DataFrame, boxes: Sequence[Sequence[int]], choices: Sequence[str]) -> DataFrame:
    """The crops of small pictures ``image_id, width, height, gray`` at ``boxes``, as bubbles of one item each."""
    places = np.array(boxes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (w, h, gray) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("width", "height", "gray")), strict=True)):
                found = crop_features(np.frombuffer(gray, np.uint8).reshape(h, w), places)
                ids = batch.column("image_id").take(pa.array(np.full(len(places), k)))
                columns = [pa.array(np.ascontiguousarray(found[:, j])) for j in range(len(FEATURES))]
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(1, len(places) + 1, dtype=np.int32)), pa.array(list(choices)), *columns], names=["image_id", "spec_ord", "choice", *FEATURES])

    kind = pictures.schema["image_id"].dataType.simpleString()
    rows = pictures.select("image_id", "width", "height", "gray").mapInArrow(run, f"image_id {kind}, spec_ord int, choice string, " + ", ".join(f"{c} double" for c in FEATURES))
    labelled = rows.withColumns({"prelabel": S.prelabel(F.col("fill_score")), "prelabel_source": F.lit("adaptive_rule"), "item_id": F.lit("I_001")})
    return labelled.withColumns({c: F.round(c, 6) for c in FEATURES})
