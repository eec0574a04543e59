"""A layout model's training samples as files: pictures warped and partly covered, their masks and their labels.

Geometry and labels are those of ``layout``; here a sample's picture is painted from its sheet's in one numpy pass
over Arrow batches.  Whatever is drawn by chance comes from hashes of a seed and the sample's name, so a task that
runs again writes the same bytes below the same names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import write_files, write_pictures
from .pictures import _grays, _pictures, draw, painted_masks, sampled

#: Fixed values of the covers: share that hides a mark wholly, radii, greys, and of partial ones least half side and room.
FULL_SHARE, RADII, SHADES, LEAST_HALF, ROOM = 0.45, (14, 31), (190, 255), 6, 8
SIGMAS = {"marker": 4.0, "bubble": 2.6}
MASKS = ("page", *SIGMAS, "grid")


def with_covers(labels: DataFrame, seed: int, *, radii: tuple[int, int] = RADII, least_half: int = LEAST_HALF, room: int = ROOM) -> DataFrame:
    """``labels`` (of ``layout.training_labels``) with ``cover``, null but for marks that are occluded and in the frame:
    a grey box that hides the mark wholly, or one beside its middle that may hide a part.

    Marks wholly hidden are not visible; others that are in the frame are, partly hidden or not."""
    name = F.concat_ws(":", F.col("sample_id"), F.col("id").cast("string"))
    chance = lambda what: draw(F.lit(str(seed)), F.concat(name, F.lit(":" + what)))

    def whole(what: str, low: Column, high: Column) -> Column:
        return (F.floor(chance(what) * (high - low + 1)) + low).cast("int")

    covered, full = F.col("occluded") & F.col("in_frame"), chance("full") < FULL_SHARE
    r = F.col("_r")
    half = F.greatest(F.lit(least_half), F.floor(r / 2).cast("int"))
    middle = lambda axis: F.rint(axis).cast("int") + F.when(full, 0).otherwise(whole(f"at_{axis}", -r, r))
    reach = lambda axis: F.when(full, r).otherwise(whole(f"half_{axis}", half, r + room - 1))
    rows = labels.withColumn("_r", whole("radius", F.lit(radii[0]), F.lit(radii[1])))
    box = F.struct(
        (middle("x") - reach("x")).alias("x1"), (middle("y") - reach("y")).alias("y1"), (middle("x") + reach("x")).alias("x2"), (middle("y") + reach("y")).alias("y2"),
        whole("shade", F.lit(SHADES[0]), F.lit(SHADES[1])).alias("gray"),
    )
    return rows.withColumn("cover", F.when(covered, box)).withColumn("visible", F.col("in_frame") & ~(covered & full)).drop("_r")


def warped_samples(samples: DataFrame, to_width: int, to_height: int) -> DataFrame:
    """``sample_id, width, height, gray``: each sample's picture, its sheet's one (``width, height, gray``) moved by
    ``matrix`` (3 x 3 by rows, from the sheet to the sample; beyond the sheet white), with ``covers`` painted in their order.

    A null or broken picture or matrix gives null; null or no covers paint nothing."""

    def painted(picture: np.ndarray, matrix: list[float], covers: list[dict]) -> bytes:
        back = np.linalg.inv(np.array(matrix, float).reshape(3, 3))
        x, y = np.arange(to_width)[None, :], np.arange(to_height)[:, None]
        far = back[2, 0] * x + back[2, 1] * y + back[2, 2]
        moved = sampled(picture, *((back[k, 0] * x + back[k, 1] * y + back[k, 2]) / far for k in (0, 1)), 255)
        for c in covers or []:
            moved[max(0, c["y1"]) : max(0, c["y2"] + 1), max(0, c["x1"]) : max(0, c["x2"] + 1)] = c["gray"]
        return _grays(moved)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = zip(batch.column("matrix").to_pylist(), batch.column("covers").to_pylist(), strict=True)
            found = [None if p is None or m is None else painted(p, m, c) for p, (m, c) in zip(_pictures(batch), rest, strict=True)]
            size = [pa.array(np.full(batch.num_rows, n, np.int32)) for n in (to_width, to_height)]
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), *size, pa.array(found, pa.binary())], names=["sample_id", "width", "height", "gray"])

    return samples.select("sample_id", "width", "height", "gray", "matrix", "covers").mapInArrow(run, "sample_id string, width int, height int, gray binary")


def described(geometry: DataFrame, labels: DataFrame, splits: DataFrame) -> DataFrame:
    """``sample_id, base_image_id, split, clean, matrix, markers, bubbles, covers``: a row a sample, its labels as arrays
    in the order of their ids (a template bounds them)."""
    entry = F.struct("id", "x", "y", "in_frame", "occluded", "visible", "cover")
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, entry)))
    grouped = labels.groupBy("sample_id").agg(of("marker").alias("markers"), of("bubble").alias("bubbles"))
    covers = F.filter(F.transform("markers", lambda m: m["cover"]), lambda c: c.isNotNull())
    plain = lambda c: F.transform(c, lambda m: m.dropFields("cover")).alias(c)
    rows = geometry.select("sample_id", "base_image_id", "clean", "matrix").join(grouped, "sample_id").join(splits.select(F.col("image_id").alias("base_image_id"), "split"), "base_image_id")
    return rows.select("sample_id", "base_image_id", "split", "clean", "matrix", plain("markers"), plain("bubbles"), covers.alias("covers"))


def build_samples(samples: DataFrame, sheets: DataFrame, page: Column, grids: Column, to_width: int, to_height: int, folder: str) -> DataFrame:
    """Writes ``images/``, ``masks/<name>/`` and ``labels/`` below the folder, by split, and returns the manifest that
    tells their paths: ``sample_id, base_image_id, split, image_path, label_path, mask_paths, clean, visible_markers,
    visible_bubbles``.

    ``samples``: of ``described``.  ``sheets``: ``image_id, width, height, gray``, one row an image; a sample whose sheet is
    missing or broken has no row and no file.  ``page`` and ``grids``: polygons in the sample's pixels, as columns of ``samples``."""
    met = samples.join(sheets.select(F.col("image_id").alias("base_image_id"), "width", "height", "gray"), "base_image_id")
    met = met.where("width > 0 and height > 0 and length(gray) = width * height and matrix is not null")
    place = F.concat(F.lit("/"), "split", F.lit("/"), "sample_id")
    names = met.select("sample_id", place.alias("_place"))
    pictures = warped_samples(met, to_width, to_height).join(names, "sample_id").select(F.concat(F.lit("images"), "_place").alias("name"), "width", "height", "gray")
    spot = lambda kind: F.transform(f"{kind}s", lambda p: F.struct(F.lit(kind).alias("kind"), p["x"].alias("x"), p["y"].alias("y"), p["visible"].alias("visible")))
    marked = met.select("sample_id", page.alias("page"), F.concat(spot("marker"), spot("bubble")).alias("spots"), grids.alias("grids"))
    masks = painted_masks(marked, to_width, to_height, SIGMAS, "sample_id").join(names, "sample_id")
    masks = masks.select(F.concat(F.lit("masks/"), "mask", "_place").alias("name"), "width", "height", "gray")
    seen = lambda kind: F.size(F.filter(f"{kind}s", lambda p: p["visible"]))
    paths = F.struct(*[F.concat(F.lit(f"masks/{m}"), place, F.lit(".png")).alias(m) for m in MASKS])
    manifest = met.select(
        "sample_id", "base_image_id", "split", F.concat(F.lit("images"), place, F.lit(".png")).alias("image_path"), F.concat(F.lit("labels"), place, F.lit(".json")).alias("label_path"),
        paths.alias("mask_paths"), "clean", seen("marker").alias("visible_markers"), seen("bubble").alias("visible_bubbles"),
    )
    size = F.struct(F.concat(F.lit("images"), place, F.lit(".png")).alias("path"), F.lit(to_width).alias("width"), F.lit(to_height).alias("height"))
    counts = F.struct(F.size("markers").alias("markers"), seen("marker").alias("visible_markers"), F.size("bubbles").alias("bubbles"), seen("bubble").alias("visible_bubbles"))
    label = F.to_json(F.struct("sample_id", "base_image_id", "split", size.alias("image"), "clean", "matrix", "markers", "bubbles", paths.alias("masks"), counts.alias("counts")))
    labels = met.select(F.concat(F.lit("labels"), place, F.lit(".json")).alias("name"), F.encode(label, "UTF-8").alias("content"))
    for written in (write_pictures(pictures.union(masks), folder), write_files(labels, folder)):
        written.write.format("noop").mode("overwrite").save()
    return manifest
