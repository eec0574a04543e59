"""Transforms fitted to matched points, one group of points at a time.

Groups are the blocks of a sheet (at most a few hundred points), many of which are fitted in one batch of
rows; the translation branch is a plain aggregate and needs no Python at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import residual_status

FIT = "method string, status string, n int, n_inliers int, rms double, largest double, confidence double, decode_allowed boolean, matrix array<double>"
REVIEW_PX, FAIL_PX = 6.0, 10.0


def apply_matrix(m: np.ndarray, points: np.ndarray) -> np.ndarray:
    moved = np.c_[points, np.ones(len(points))] @ m.T
    return moved[:, :2] / moved[:, 2:]


def fit_affine(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Least squares; None where the points lie on a line."""
    design = np.c_[src, np.ones(len(src))]
    if len(src) < 3 or np.linalg.matrix_rank(design - [*src.mean(axis=0), 0]) < 3:
        return None
    found, *_ = np.linalg.lstsq(design, dst, rcond=None)
    return np.vstack([found.T, [0, 0, 1]])


def fit_homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Direct linear transform of centred and scaled points."""

    def scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centre = p.mean(axis=0)
        spread = np.sqrt(((p - centre) ** 2).sum(axis=1)).mean()
        s = np.sqrt(2) / spread if spread > 0 else 1.0
        t = np.array([[s, 0, -s * centre[0]], [0, s, -s * centre[1]], [0, 0, 1]])
        return apply_matrix(t, p), t

    (a, ta), (b, tb) = scaled(src), scaled(dst)
    one, zero = np.ones((len(a), 1)), np.zeros((len(a), 3))
    rows = np.vstack([np.c_[a, one, zero, -a * b[:, :1], -b[:, :1]], np.c_[zero, a, one, -a * b[:, 1:], -b[:, 1:]]])
    _, size, v = np.linalg.svd(rows)
    if len(src) < 4 or (len(size) > 7 and size[7] < 1e-10):
        return None
    h = np.linalg.inv(tb) @ v[-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def translation(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    m = np.eye(3)
    m[:2, 2] = np.median(dst - src, axis=0)
    return m


def ransac_affine(src: np.ndarray, dst: np.ndarray, reach: float = 4.0, rounds: int = 500, seed: int = 0) -> tuple[np.ndarray, np.ndarray] | None:
    """The affine with most points within reach, refitted to them; all samples are scored at once."""
    n = len(src)
    rng = np.random.default_rng(seed)
    trio = np.argsort(rng.random((rounds, n)), axis=1)[:, :3]
    design = np.c_[src, np.ones(n)]
    sample = design[trio]
    fine = np.abs(np.linalg.det(sample)) > 1e-9
    if not fine.any():
        return None
    found = np.linalg.solve(sample[fine], dst[trio[fine]])
    near = np.linalg.norm(design @ found - dst, axis=2) <= reach
    best = near[near.sum(axis=1).argmax()]
    for _ in range(10):
        m = fit_affine(src[best], dst[best])
        if m is None:
            return None
        again = np.linalg.norm(apply_matrix(m, src) - dst, axis=1) <= reach
        if (again == best).all() or again.sum() < 3:
            break
        best = again
    return m, best


def _row(method: str, status: str, n: int, inliers: int, errors: np.ndarray, confidence: float, allowed: bool, matrix: np.ndarray) -> dict:
    rms = float(np.sqrt((errors**2).mean())) if len(errors) else None
    return {
        "method": method, "status": status, "n": n, "n_inliers": inliers, "rms": rms, "largest": float(errors.max()) if len(errors) else None,
        "confidence": float(confidence), "decode_allowed": allowed, "matrix": [float(x) for x in matrix.ravel()],
    }


def local_transform(src: np.ndarray, dst: np.ndarray, threshold: float = 8.0) -> dict:
    """From a block's marks: homography from four on, affine from three, else a shift; without marks the
    sheet's own transform stays."""
    n = len(src)
    if not n:
        return _row("identity", "fallback_global", 0, 0, np.zeros(0), 0.0, True, np.eye(3))
    method = "homography" if n >= 4 else "affine" if n == 3 else "translation"
    m = fit_homography(src, dst) if n >= 4 else fit_affine(src, dst) if n == 3 else translation(src, dst)
    if m is None:
        return _row(method, "alignment_failed", n, 0, np.zeros(0), 0.0, False, np.eye(3))
    errors = np.linalg.norm(apply_matrix(m, src) - dst, axis=1)
    rms = float(np.sqrt((errors**2).mean()))
    status = "fallback_translation" if method == "translation" else "ok" if rms <= threshold else "alignment_failed"
    return _row(method, status, n, n, errors, min(1.0, n / 4) * max(0.0, 1 - rms / max(1.0, threshold)), status != "alignment_failed", m)


def grid_transform(src: np.ndarray, dst: np.ndarray, expected: int, ratio: float = 0.35) -> dict:
    """From a block's bubbles: a robust affine if enough of them agree, else a shift."""
    n = len(src)
    if not n:
        return _row("identity", "skipped", 0, 0, np.zeros(0), 0.0, True, np.eye(3))

    def judged(rms: float) -> str:
        return "alignment_failed" if rms > FAIL_PX else "need_review" if rms > REVIEW_PX else "ok"

    found = ransac_affine(src, dst) if n >= 3 else None
    if found is not None and found[1].sum() >= max(3, round(expected * ratio)):
        m, inside = found
        errors = np.linalg.norm(apply_matrix(m, src) - dst, axis=1)[inside]
        rms = float(np.sqrt((errors**2).mean()))
        sure = min(1.0, inside.sum() / max(1, expected))
        status = judged(rms)
        return _row("affine", status, n, int(inside.sum()), errors, sure if status == "ok" else min(sure, 0.5), rms <= FAIL_PX, m)
    m = translation(src, dst)
    errors = np.linalg.norm(apply_matrix(m, src) - dst, axis=1)
    rms = float(np.sqrt((errors**2).mean()))
    status = judged(rms)
    if status == "ok":
        status = "fallback_translation" if n >= 4 else "skipped"
    return _row("translation", status, n, n, errors, min(0.65, n / max(1, expected)), rms <= FAIL_PX, m)


def fit_blocks(pairs: DataFrame, keys: Sequence[str], fit: Callable[[np.ndarray, np.ndarray, int], dict]) -> DataFrame:
    """``fit`` for each group of ``sx, sy, dx, dy`` rows and its ``expected`` number (0 without one).

    A block's few points are gathered as an array, and a batch of Arrow rows holds many blocks."""
    names = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    expected = F.max("expected").cast("int") if "expected" in pairs.columns else F.lit(0)
    gathered = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("sx", "sy", "dx", "dy")]))).alias("points"), expected.alias("expected"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for points, most in zip(batch["points"], batch["expected"], strict=True):
                p = np.array([[q[c] for c in ("sx", "sy", "dx", "dy")] for q in points]).reshape(-1, 4)
                rows.append(fit(p[:, :2], p[:, 2:], int(most)))
            if rows:
                yield pd.concat([batch[list(keys)].reset_index(drop=True), pd.DataFrame(rows)], axis=1)

    return gathered.mapInPandas(run, f"{names}, {FIT}")


def fit_local(pairs: DataFrame, keys: Sequence[str] = ("image_id", "block")) -> DataFrame:
    return fit_blocks(pairs, keys, lambda a, b, _: local_transform(a, b))


def fit_grid(pairs: DataFrame, keys: Sequence[str] = ("image_id", "block")) -> DataFrame:
    """Rows carry the number of bubbles that their block should have as ``expected``."""
    return fit_blocks(pairs, keys, lambda a, b, expected: grid_transform(a, b, expected))


def shift_blocks(pairs: DataFrame, keys: Sequence[str] = ("image_id", "block")) -> DataFrame:
    """The translation branch as aggregates: median shift, its residuals and what they allow."""
    shift = pairs.groupBy(*keys).agg(F.median(F.col("dx") - F.col("sx")).alias("shift_x"), F.median(F.col("dy") - F.col("sy")).alias("shift_y"))
    off = F.pow(F.col("sx") + F.col("shift_x") - F.col("dx"), 2) + F.pow(F.col("sy") + F.col("shift_y") - F.col("dy"), 2)
    found = pairs.join(shift, list(keys)).groupBy(*keys, "shift_x", "shift_y").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(off)), 3).alias("rms"), F.round(F.sqrt(F.max(off)), 3).alias("largest"), F.max("expected").alias("expected")
    )
    status = residual_status(F.col("rms"), REVIEW_PX, FAIL_PX)
    return found.select(
        *keys,
        F.round("shift_x", 3).alias("shift_x"),
        F.round("shift_y", 3).alias("shift_y"),
        "n",
        "rms",
        "largest",
        F.when(status != "ok", status).when(F.col("n") >= 4, "fallback_translation").otherwise("skipped").alias("status"),
        F.round(F.least(F.lit(0.65), F.col("n") / F.greatest(F.lit(1), F.col("expected"))), 6).alias("confidence"),
        (F.col("rms") <= FAIL_PX).alias("decode_allowed"),
    )


def moved_point(matrix: Column, x: Column, y: Column) -> Column:
    """A centre under a 3 x 3 matrix given by rows, halves to even."""
    m = lambda k: F.element_at(matrix, k)
    w = m(7) * x + m(8) * y + m(9)
    return F.array(F.rint((m(1) * x + m(2) * y + m(3)) / w).cast("int"), F.rint((m(4) * x + m(5) * y + m(6)) / w).cast("int"))


def refine_specs(specs: DataFrame, fits: DataFrame, keys: Sequence[str] = ("image_id", "grid_block")) -> DataFrame:
    """Specs moved by their block's transform where it may move them, with the transform's status."""
    few = fits.select(*keys, F.col("status").alias("grid_refinement_status"), F.col("confidence").alias("grid_refinement_confidence"), F.col("decode_allowed").alias("grid_refinement_decode_allowed"), "matrix")
    x, y = F.element_at("center", 1), F.element_at("center", 2)
    moves = F.col("grid_refinement_status").isin("ok", "need_review", "fallback_translation")
    new = F.when(moves, moved_point(F.col("matrix"), x, y)).otherwise(F.col("center"))
    dx, dy = F.element_at("new", 1) - x, F.element_at("new", 2) - y
    return (
        specs.join(few, list(keys), "left")
        .withColumn("new", new)
        .withColumns(
            {
                "template_center": F.col("center"),
                "template_bbox": F.col("bbox"),
                "bbox": F.array(F.element_at("bbox", 1) + dx, F.element_at("bbox", 2) + dy, F.element_at("bbox", 3) + dx, F.element_at("bbox", 4) + dy),
                "center": F.col("new"),
            }
        )
        .drop("new", "matrix")
    )


def transform_info(fits: DataFrame, circles: DataFrame, keys: Sequence[str] = ("image_id", "block")) -> DataFrame:
    """Fits as they are reported: rounded, residuals under both their names, the matrix's shift, and how many
    circles (``circle_count`` by the same keys) were there to match."""
    three = lambda c: F.round(c, 3)
    rows = fits.join(circles.select(*keys, "circle_count"), list(keys), "left")
    return rows.select(
        *keys, "status", "method", three(F.col("confidence")).alias("confidence"), "decode_allowed", F.coalesce("circle_count", F.lit(0)).alias("circle_count"), F.col("n").alias("matched_count"),
        F.col("n_inliers").alias("inlier_count"), three(F.col("rms")).alias("rms_error_px"), three(F.col("largest")).alias("max_error_px"), three(F.col("rms")).alias("grid_residual_px"), three(F.col("largest")).alias("max_residual_px"),
        F.transform("matrix", lambda v: F.round(v, 6)).alias("matrix"),
    )
