"""Pictures as one row each, ``image_id, width, height, gray`` (bytes by rows): resizing, elastic
displacement and painted masks, in numpy over Arrow batches.  Pixels are never rows and are never shuffled.

A picture that is null, has no pixels, or whose bytes are not ``width * height`` gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD_COLUMNS, FIELD_ROWS = 6, 8
_TWO_PI = 2 * np.pi


# -- resampling -------------------------------------------------------------------------------


@cache
def taps(n_in: int, n_out: int, kernel: str) -> tuple[np.ndarray, np.ndarray]:
    """For each cell out, the cells in that it draws on and their weights, as two ``n_out x k`` tables.

    ``area``: the share of the cell out that each cell in covers.  ``lanczos``: windowed sinc of three lobes,
    as wide as the cells out when shrinking, edges renormalised.  ``cubic``: cubic convolution (-0.75), edges repeated."""
    scale = n_in / n_out
    out = np.arange(n_out)[:, None]
    if kernel == "area":
        at = np.floor(out * scale).astype(np.int64) + np.arange(int(np.ceil(scale)) + 1)
        weight = np.clip(np.minimum(at + 1, (out + 1) * scale) - np.maximum(at, out * scale), 0, None) / scale
    elif kernel == "lanczos":
        wide = max(scale, 1.0)
        middle = (out + 0.5) * scale
        at = np.floor(middle - 3 * wide).astype(np.int64) + np.arange(int(np.ceil(6 * wide)) + 2)
        far = (at + 0.5 - middle) / wide
        weight = np.where((np.abs(far) < 3) & (at >= 0) & (at < n_in), np.sinc(far) * np.sinc(far / 3), 0)
        weight = weight / weight.sum(axis=1, keepdims=True)
    elif kernel == "cubic":
        middle = (out + 0.5) * scale - 0.5
        at = np.floor(middle).astype(np.int64) + np.arange(-1, 3)
        d = np.abs(at - middle)
        weight = np.where(d <= 1, 1.25 * d**3 - 2.25 * d**2 + 1, -0.75 * d**3 + 3.75 * d**2 - 6 * d + 3)
    else:
        raise ValueError(f"no such kernel: {kernel}")
    return np.clip(at, 0, n_in - 1), weight


def resample(values: np.ndarray, height: int, width: int, kernel: str) -> np.ndarray:
    """Columns first, then rows, each cell out a weighted sum of few cells in."""
    at, weight = taps(values.shape[1], width, kernel)
    across = sum(values[:, at[:, k]] * weight[:, k] for k in range(at.shape[1]))
    at, weight = taps(values.shape[0], height, kernel)
    return sum(across[at[:, k]] * weight[:, k, None] for k in range(at.shape[1]))


def _grays(values: np.ndarray) -> bytes:
    return np.clip(np.rint(values), 0, 255).astype(np.uint8).tobytes()


def _pictures(batch: pa.RecordBatch) -> Iterator[np.ndarray | None]:
    for width, height, gray in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "gray")), strict=True):
        whole = gray is not None and width and height and len(gray) == width * height
        yield np.frombuffer(gray, np.uint8).reshape(height, width) if whole else None


def _kind(rows: DataFrame, name: str) -> str:
    return f"`{name}` {rows.schema[name].dataType.simpleString()}"


def resized(pictures: DataFrame, width: int, height: int, kernel: str = "area", key: str = "image_id") -> DataFrame:
    """Pictures of ``width x height`` by any ratio, grays rounded half to even."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if p is None else _grays(resample(p, height, width, kernel)) for p in _pictures(batch)]
            size = [pa.array(np.full(batch.num_rows, n, np.int32)) for n in (width, height)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *size, pa.array(found, pa.binary())], names=[key, "width", "height", "gray"])

    return pictures.select(key, "width", "height", "gray").mapInArrow(run, f"{_kind(pictures, key)}, width int, height int, gray binary")


def network_input(pictures: DataFrame, width: int, height: int, key: str = "image_id") -> DataFrame:
    """``key, values``: pictures shrunk by area, -1 to 1, as one array by rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if p is None else ((resample(p, height, width, "area") / 255 - 0.5) / 0.5).ravel() for p in _pictures(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.list_(pa.float64()))], names=[key, "values"])

    return pictures.select(key, "width", "height", "gray").mapInArrow(run, f"{_kind(pictures, key)}, values array<double>")


# -- elastic displacement ---------------------------------------------------------------------


def draw(seed: Column, name: Column) -> Column:
    """A number in (0, 1) that depends on the seed and a name alone."""
    digits = F.substring(F.sha1(F.concat(seed.cast("string"), F.lit(":"), name).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def elastic_field(seed: Column, strength: float) -> Column:
    """A coarse field of normal moves (``dx``, ``dy``: rows of 6 x 8) and the two phases of a bend, the same
    for a seed wherever and whenever it is drawn."""
    angle = lambda name: _TWO_PI * draw(seed, name)
    normal = lambda name: F.sqrt(-2 * F.log(draw(seed, F.concat(name, F.lit(":r"))))) * F.cos(angle(F.concat(name, F.lit(":a")))) * (strength / 2.5)
    cells = F.sequence(F.lit(0), F.lit(FIELD_ROWS * FIELD_COLUMNS - 1))
    field = lambda axis: F.transform(cells, lambda i: normal(F.concat(F.lit(axis), i.cast("string"))))
    bend = F.sin(angle(F.lit("bend_x"))), F.cos(angle(F.lit("bend_y")))
    return F.struct(field("x").alias("dx"), field("y").alias("dy"), bend[0].alias("bend_x"), bend[1].alias("bend_y"))


def displacement(field: dict, width: int, height: int, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """The moves of all pixels: the coarse field by cubic upsampling and a wave along the other axis, clipped."""
    coarse = [np.array(field[c], float).reshape(FIELD_ROWS, FIELD_COLUMNS) for c in ("dx", "dy")]
    dx, dy = (resample(c, height, width, "cubic") for c in coarse)
    dx = dx + strength * 0.35 * field["bend_x"] * np.sin(np.linspace(0, _TWO_PI, height))[:, None]
    dy = dy + strength * 0.35 * field["bend_y"] * np.sin(np.linspace(0, _TWO_PI, width))[None, :]
    return np.clip(dx, -strength, strength), np.clip(dy, -strength, strength)


def sampled(picture: np.ndarray, x: np.ndarray, y: np.ndarray, background: float) -> np.ndarray:
    """Bilinear samples at real places; what lies beyond the picture is background.  Fractions are those of the
    places themselves, as a shift by the frame would round them: moves of equal size often meet exact halves."""
    height, width = picture.shape
    framed = np.full((height + 2, width + 2), float(background))
    framed[1:-1, 1:-1] = picture
    x, y = np.clip(x, -1, width), np.clip(y, -1, height)
    left, top = np.minimum(np.floor(x), width - 1), np.minimum(np.floor(y), height - 1)
    fx, fy = x - left, y - top
    left, top = left.astype(np.int64) + 1, top.astype(np.int64) + 1
    upper = framed[top, left] * (1 - fx) + framed[top, left + 1] * fx
    lower = framed[top + 1, left] * (1 - fx) + framed[top + 1, left + 1] * fx
    return upper * (1 - fy) + lower * fy


def elastic(pictures: DataFrame, seed: Column, strength: float, background: int = 255, key: str = "image_id") -> DataFrame:
    """Pictures, and their ``points`` (``x, y`` structs), moved by each one's own elastic field; a pixel takes
    what lies where it came from, and a point moves as the pixel nearest to it, so both agree to the field's
    slope.  Strength 0 changes nothing."""
    if strength <= 0:
        return pictures.select(key, "width", "height", "gray", "points")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, moved = [], []
            for picture, field, points in zip(_pictures(batch), batch.column("_field").to_pylist(), batch.column("points").to_pylist(), strict=True):
                if picture is None:
                    found.append(None)
                    moved.append(points)
                    continue
                height, width = picture.shape
                dx, dy = displacement(field, width, height, strength)
                found.append(_grays(sampled(picture, np.arange(width) - dx, np.arange(height)[:, None] - dy, background)))
                near = lambda v, n: int(np.clip(np.rint(v), 0, n - 1))
                places = [(p["x"], p["y"], near(p["y"], height), near(p["x"], width)) for p in points or []]
                moved.append(None if points is None else [{"x": x + float(dx[r, c]), "y": y + float(dy[r, c])} for x, y, r, c in places])
            columns = [*(batch.column(c) for c in (key, "width", "height")), pa.array(found, pa.binary()), pa.array(moved, _POINTS)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "width", "height", "gray", "points"])

    rows = pictures.select(key, "width", "height", "gray", "points", elastic_field(seed, strength).alias("_field"))
    return rows.mapInArrow(run, f"{_kind(pictures, key)}, width int, height int, gray binary, points array<struct<x:double,y:double>>")


_POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


# -- masks ------------------------------------------------------------------------------------


def filled(points: np.ndarray, width: int, height: int) -> np.ndarray:
    """Whether each pixel lies inside the closed polygon or on its border: every edge toggles its rows' pixels
    left of it, once a row, and a running parity along the row fills the spans."""
    toggled = np.zeros((height, width + 1), np.int32)
    border = np.zeros((height, width), bool)
    for (ax, ay), (bx, by) in zip(points, np.roll(points, -1, axis=0), strict=True):
        y = np.arange(max(0, int(np.ceil(min(ay, by)))), min(height - 1, int(np.floor(max(ay, by)))) + 1)
        if ay == by:
            if len(y):
                border[y[0], max(0, int(np.ceil(min(ax, bx)))) : max(0, int(np.floor(max(ax, bx))) + 1)] = True
            continue
        x = (bx - ax) * (y - ay) / (by - ay) + ax
        half = (ay > y) != (by > y)
        np.add.at(toggled, (y[half], np.clip(np.ceil(x[half]), 0, width).astype(np.int64)), 1)
        on = np.rint(x).astype(np.int64)
        exact = ((bx - ax) * (y - ay) == (by - ay) * (on - ax)) & (on >= 0) & (on < width)
        border[y[exact], on[exact]] = True
    right_of = toggled[:, ::-1].cumsum(axis=1)[:, ::-1]  # crossings at or beyond a pixel, one on it left out
    return (right_of[:, 1:] % 2 == 1) | border


def spotted(mask: np.ndarray, x: float, y: float, sigma: float) -> None:
    """A Gaussian spot up to three sigma around the pixel nearest to a point inside, the larger value wins."""
    height, width = mask.shape
    if not (0 <= x < width and 0 <= y < height):
        return
    reach = int(np.ceil(3 * sigma))
    rows = np.arange(max(0, int(np.rint(y)) - reach), min(height, int(np.rint(y)) + reach + 1))
    columns = np.arange(max(0, int(np.rint(x)) - reach), min(width, int(np.rint(x)) + reach + 1))
    if len(rows) and len(columns):
        far = (columns[None, :] - x) ** 2 + (rows[:, None] - y) ** 2
        part = mask[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]
        np.maximum(part, np.floor(255 * np.exp(-far / (2 * sigma * sigma))).astype(np.uint8), out=part)


def lined(mask: np.ndarray, points: np.ndarray, thickness: float = 2.0) -> None:
    """The closed polygon's sides, their edges softened over one pixel: a pixel's value falls with its distance."""
    height, width = mask.shape
    reach = thickness / 2 + 0.5
    for (ax, ay), (bx, by) in zip(points, np.roll(points, -1, axis=0), strict=True):
        x = np.arange(max(0, int(np.ceil(min(ax, bx) - reach))), min(width - 1, int(np.floor(max(ax, bx) + reach))) + 1)
        y = np.arange(max(0, int(np.ceil(min(ay, by) - reach))), min(height - 1, int(np.floor(max(ay, by) + reach))) + 1)[:, None]
        if not len(x) or not len(y):
            continue
        length = (bx - ax) ** 2 + (by - ay) ** 2
        along = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length, 0, 1) if length else np.zeros((len(y), len(x)))
        far = np.sqrt((x - ax - along * (bx - ax)) ** 2 + (y - ay - along * (by - ay)) ** 2)
        part = mask[int(y[0, 0]) : int(y[-1, 0]) + 1, int(x[0]) : int(x[-1]) + 1]
        np.maximum(part, np.rint(255 * np.clip(reach - far, 0, 1)).astype(np.uint8), out=part)


def _corners(points: list[dict] | None) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points or []], float).reshape(-1, 2)


def painted_masks(samples: DataFrame, width: int, height: int, sigmas: dict[str, float], key: str = "image_id") -> DataFrame:
    """``key, mask, width, height, gray``: for each sample the page's polygon ``page`` filled, the visible
    ``spots`` (``kind, x, y, visible``) of each kind, and the polygons of ``grids`` as lines two pixels thick.
    Corners are rounded to pixels first.  A null or empty polygon or list paints nothing."""

    def masks(page: list, spots: list, grids: list) -> Iterator[tuple[str, np.ndarray]]:
        corners = np.rint(_corners(page))
        yield "page", np.where(filled(corners, width, height), 255, 0).astype(np.uint8)
        for kind, sigma in sigmas.items():
            mask = np.zeros((height, width), np.uint8)
            for s in spots or []:
                if s["kind"] == kind and s["visible"]:
                    spotted(mask, s["x"], s["y"], sigma)
            yield kind, mask
        mask = np.zeros((height, width), np.uint8)
        for grid in grids or []:
            lined(mask, np.rint(_corners(grid)))
        yield "grid", mask

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, sample in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page", "spots", "grids")), strict=True)):
                names, found = zip(*masks(*sample), strict=True)
                n = len(names)
                ids = batch.column(key).take(pa.array(np.full(n, k)))
                sizes = [pa.array(np.full(n, v, np.int32)) for v in (width, height)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(names), *sizes, pa.array([m.tobytes() for m in found], pa.binary())], names=[key, "mask", "width", "height", "gray"])

    return samples.select(key, "page", "spots", "grids").mapInArrow(run, f"{_kind(samples, key)}, mask string, width int, height int, gray binary")
