"""The layout network's forward pass, in numpy over Arrow batches, and its peaks, without rows of pixels.

Three levels down and up: blocks of two 3 x 3 convolutions, each normalised by groups of channels, halved by
the largest of four, grown again bilinearly beside the block of the same level.  Weights have a size fixed by
``base``, come from one file of named arrays and are broadcast.  Convolutions run by strips of rows, so a
picture of 832 x 1192 needs a few copies of its widest level and no more: some 750 MB with 24 channels there,
in each task.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .pictures import _kind, _pictures, resample

CHANNELS = ("page", "marker", "bubble", "grid")
STRIP = 64
#: Sides of which something is left after three halvings.
LEAST_SIDE = 8


def shapes(base: int, n_out: int, n_in: int = 3) -> dict[str, tuple[int, ...]]:
    """The named arrays of a network and their shapes."""
    found: dict[str, tuple[int, ...]] = {}

    def block(name: str, before: int, after: int) -> None:
        for place, wide in ((0, before), (3, after)):
            found[f"{name}.layers.{place}.weight"] = (after, wide, 3, 3)
            found[f"{name}.layers.{place + 1}.weight"] = found[f"{name}.layers.{place + 1}.bias"] = (after,)

    for name, before, after in (("enc1", n_in, 1), ("enc2", base, 2), ("enc3", 2 * base, 4), ("bottleneck", 4 * base, 8)):
        block(name, before, after * base)
    for level in (4, 2, 1):
        block(f"up{ {4: 3, 2: 2, 1: 1}[level] }.conv", 3 * level * base, level * base)
    found["out.weight"], found["out.bias"] = (n_out, base, 1, 1), (n_out,)
    return found


def seeded_weights(base: int, n_out: int, seed: int) -> dict[str, np.ndarray]:
    """An untrained network: convolutions normal by their fan-in, scales 1, shifts 0."""
    rng = np.random.default_rng(seed)
    start = lambda shape: rng.standard_normal(shape) * math.sqrt(2 / np.prod(shape[1:])) if len(shape) > 1 else None
    found = {}
    for name, shape in shapes(base, n_out).items():
        drawn = start(shape)
        found[name] = (drawn if drawn is not None else np.full(shape, float(name.endswith("weight")))).astype(np.float32)
    return found


def checked(weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Single precision arrays of a whole network; a missing, further or misshaped one is an error."""
    if "out.weight" not in weights or np.ndim(weights["out.weight"]) != 4:
        raise ValueError("there is no array out.weight of four axes")
    n_out, base = np.shape(weights["out.weight"])[:2]
    wanted = shapes(base, n_out, np.shape(weights.get("enc1.layers.0.weight", np.zeros((0, 3))))[1])
    odd = [n for n in {*wanted, *weights} if n not in weights or wanted.get(n) != np.shape(weights[n])]
    if odd:
        raise ValueError(f"arrays that don't belong to one network: {sorted(odd)}")
    return {name: np.ascontiguousarray(value, np.float32) for name, value in weights.items()}


def read_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """The arrays of one ``.npz`` file in any store that Spark reads; nothing pickled is loaded."""
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        raise ValueError(f"no weights at {path}")
    with np.load(io.BytesIO(bytes(row["content"])), allow_pickle=False) as stored:
        return checked({name: stored[name] for name in stored.files})


# -- layers, on channels x rows x columns -----------------------------------------------------


def convolved(parts: Sequence[np.ndarray], weight: np.ndarray) -> np.ndarray:
    """3 x 3 over zeros beyond the edge, of the parts' channels one behind another."""
    height, width = parts[0].shape[1:]
    out = np.zeros((len(weight), height, width), parts[0].dtype)
    first = 0
    for part in parts:
        own = weight[:, first : first + len(part)]
        first += len(part)
        for a in range(0, height, STRIP):
            b = min(height, a + STRIP)
            framed = np.zeros((len(part), b - a + 2, width + 2), part.dtype)
            above, below = max(0, a - 1), min(height, b + 1)
            framed[:, above - a + 1 : below - a + 1, 1:-1] = part[:, above:below]
            for dy in range(3):
                for dx in range(3):
                    seen = framed[:, dy : dy + b - a, dx : dx + width].reshape(len(part), -1)
                    out[:, a:b] += (own[:, :, dy, dx] @ seen).reshape(len(weight), b - a, width)
    return out


def activated(x: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Normalised by groups of channels (8 of them, or as many as divide both), scaled, and times its own sigmoid; in place."""
    for group in np.split(np.arange(len(x)), math.gcd(len(x), 8)):
        part = x[group[0] : group[-1] + 1]
        middle = np.mean([c.mean(dtype=np.float64) for c in part])
        spread = math.sqrt(np.mean([np.square(c - middle, dtype=np.float64).mean() for c in part]) + 1e-5)
        for k, c in zip(group, part, strict=True):
            c *= scale[k] / spread
            c += shift[k] - middle * scale[k] / spread
            c /= 1 + np.exp(-np.clip(c, -80, 80))
    return x


def halved(x: np.ndarray) -> np.ndarray:
    """The largest of each four; an odd last row or column goes."""
    height, width = x.shape[1] // 2, x.shape[2] // 2
    return x[:, : 2 * height, : 2 * width].reshape(len(x), height, 2, width, 2).max(axis=(2, 4))


def grown(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear between the middles of cells, edges repeated; a channel at a time."""
    places = []
    for before, after in zip(x.shape[1:], (height, width), strict=True):
        at = np.maximum((np.arange(after) + 0.5) * before / after - 0.5, 0)
        low = np.floor(at).astype(np.int64)
        places.append((low, np.minimum(low + 1, before - 1), (at - low).astype(x.dtype)))
    (top, bottom, down), (left, right, along) = places
    out = np.empty((len(x), height, width), x.dtype)
    for c, whole in zip(x, out, strict=True):
        rows = c[top] * (1 - down)[:, None] + c[bottom] * down[:, None]
        whole[:] = rows[:, left] * (1 - along) + rows[:, right] * along
    return out


def forward(x: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    """Logits (channels x rows x columns) of one picture's channels, whose sides are at least 8."""

    def block(name: str, *parts: np.ndarray) -> np.ndarray:
        w = lambda place, kind="weight": weights[f"{name}.layers.{place}.{kind}"]
        inner = activated(convolved(parts, w(0)), w(1), w(1, "bias"))
        return activated(convolved([inner], w(3)), w(4), w(4, "bias"))

    one = block("enc1", x)
    two = block("enc2", halved(one))
    three = block("enc3", halved(two))
    up = block("bottleneck", halved(three))
    for name, beside in (("up3", three), ("up2", two), ("up1", one)):
        up = block(f"{name}.conv", grown(up, *beside.shape[1:]), beside)
    return np.tensordot(weights["out.weight"][:, :, 0, 0], up, 1) + weights["out.bias"][:, None, None]


# -- pictures to peaks ------------------------------------------------------------------------


def probabilities(picture: np.ndarray, weights: dict[str, np.ndarray], width: int, height: int) -> np.ndarray:
    """A grey picture shrunk by area to the network's size, from -1 to 1 in each channel, to 0..1 maps."""
    gray = ((resample(picture, height, width, "area") / 255 - 0.5) / 0.5).astype(np.float32)
    n_in = weights["enc1.layers.0.weight"].shape[1]
    return 1 / (1 + np.exp(-np.clip(forward(np.broadcast_to(gray, (n_in, height, width)), weights).astype(np.float64), -500, 500)))


def highest(heat: np.ndarray, threshold: float, radius: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the pixels that reach the threshold and the largest value around them (to 1e-6), highest
    first, then by row and column; ``most`` at most."""
    largest = heat
    for axis in (0, 1):
        edge = [(radius, radius) if a == axis else (0, 0) for a in (0, 1)]
        framed = np.pad(largest, edge, constant_values=-np.inf)
        largest = np.lib.stride_tricks.sliding_window_view(framed, 2 * radius + 1, axis).max(axis=-1)
    y, x = np.nonzero((heat >= threshold) & (heat >= largest - 1e-6))
    order = np.lexsort((x, y, -heat[y, x]))[:most]
    return y[order], x[order]


def _shown(value: float, digits: int = 3) -> float:
    """Rounded half up, as Spark rounds; for values that aren't negative."""
    return math.floor(value * 10**digits + 0.5) / 10**digits


_PEAKS = "array<struct<rank:int,x:double,y:double,model_x:double,model_y:double,score:double>>"
_PEAKS_TYPE = pa.list_(pa.struct([("rank", pa.int32()), *((c, pa.float64()) for c in ("x", "y", "model_x", "model_y", "score"))]))


def predict_layout(
    pictures: DataFrame, weights: dict[str, np.ndarray], width: int, height: int, *, page: float, marker: float, bubble: float, radius: int, most: int, key: str = "image_id",
) -> DataFrame:
    """``key, markers, bubbles, page, n_markers, n_bubbles`` of each picture, in its own pixels, as
    ``layout.layout_predictions`` gives them from rows of pixels: peaks of the marker and bubble maps, and the box of the
    page's pixels (null where none reaches the threshold).

    The network sees pictures at ``width x height``.  A picture that is null or broken has no peaks and no page.  A network
    with other channels than page, marker, bubble and grid, in this order, or sides below 8, is an error."""
    weights = checked(weights)
    if len(weights["out.bias"]) != len(CHANNELS) or min(width, height) < LEAST_SIDE:
        raise ValueError(f"a network has the channels {CHANNELS} and sides of {LEAST_SIDE} at least")
    shared = pictures.sparkSession.sparkContext.broadcast(weights)
    limits = {"marker": marker, "bubble": bubble}

    def found(picture: np.ndarray) -> tuple[dict[str, list], list | None]:
        maps = dict(zip(CHANNELS, probabilities(picture, shared.value, width, height), strict=True))
        sx, sy = picture.shape[1] / width, picture.shape[0] / height
        peaks = {}
        for kind, limit in limits.items():
            places = zip(*highest(maps[kind], limit, radius, most), strict=True)
            peaks[kind] = [
                {"rank": n, "x": _shown(x * sx), "y": _shown(y * sy), "model_x": float(x), "model_y": float(y), "score": _shown(maps[kind][y, x], 6)}
                for n, (y, x) in enumerate(places, 1)
            ]
        y, x = np.nonzero(maps["page"] >= page)
        box = [x.min() * sx, y.min() * sy, (x.max() + 1) * sx, (y.max() + 1) * sy] if len(x) else None
        return peaks, box and [_shown(v) for v in box]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [({"marker": [], "bubble": []}, None) if p is None else found(p) for p in _pictures(batch)]
            peaks = [pa.array([r[0][kind] for r in rows], _PEAKS_TYPE) for kind in limits]
            counts = [pa.array([len(r[0][kind]) for r in rows], pa.int32()) for kind in limits]
            boxes = pa.array([r[1] for r in rows], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(key), *peaks, boxes, *counts], names=[key, "markers", "bubbles", "page", "n_markers", "n_bubbles"])

    return pictures.select(key, "width", "height", "gray").mapInArrow(run, f"{_kind(pictures, key)}, markers {_PEAKS}, bubbles {_PEAKS}, page array<double>, n_markers int, n_bubbles int")
