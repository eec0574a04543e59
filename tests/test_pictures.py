"""Picture kernels against direct summation, fields and masks, and draws of an epoch."""

import math

import numpy as np
from pyspark.sql import functions as F

from sheetmill.operators import pictures as P
from sheetmill.operators import training as L

RNG = np.random.default_rng(3)
SCHEMA = "image_id long, width int, height int, gray binary"


def test_area_of_any_ratio_keeps_the_sum():
    page = RNG.integers(0, 256, (2363, 1650)).astype(float)
    small = P.resample(page, 1192, 832, "area")
    assert small.shape == (1192, 832)
    assert math.isclose(small.sum() * (2363 * 1650) / (1192 * 832), page.sum(), rel_tol=1e-9)
    assert np.allclose(P.resample(page[:6, :8], 3, 4, "area"), page[:6, :8].reshape(3, 2, 4, 2).mean(axis=(1, 3)))


def test_lanczos_against_direct_summation():
    sinc = lambda t: 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)
    line = RNG.integers(0, 256, 23).astype(float)
    for n in (7, 23, 40):
        scale = 23 / n
        wide = max(1.0, scale)
        for j, got in enumerate(P.resample(line[None, :], 1, n, "lanczos")[0]):
            far = [(i + 0.5 - (j + 0.5) * scale) / wide for i in range(23)]
            weight = [sinc(t) * sinc(t / 3) if abs(t) < 3 else 0.0 for t in far]
            assert math.isclose(got, sum(w * v for w, v in zip(weight, line, strict=True)) / sum(weight), abs_tol=1e-9)
    assert np.allclose(P.resample(line[None, :], 1, 23, "lanczos")[0], line)


def test_elastic_moves_pixels_and_points_alike(spark):
    dots = np.full((120, 90), 255, np.uint8)
    places = [(20, 30), (60, 40), (45, 90)]
    for x, y in places:
        dots[y - 3 : y + 4, x - 3 : x + 4] = 0
    points = [{"x": float(x), "y": float(y)} for x, y in places]
    df = spark.createDataFrame([(1, 90, 120, dots.tobytes(), points), (2, 90, 120, None, None), (3, 5, 5, b"abc", [])], SCHEMA + ", points array<struct<x:double,y:double>>")
    rows = {r.image_id: r for r in P.elastic(df, F.col("image_id"), 3.0).collect()}
    again = {r.image_id: r for r in P.elastic(df.repartition(3), F.col("image_id"), 3.0).collect()}
    assert rows == again and rows[2].gray is None and rows[3].gray is None and rows[3].points == []
    ink = 255.0 - np.frombuffer(rows[1].gray, np.uint8).reshape(120, 90)
    moves = []
    for p, (x, y) in zip(rows[1].points, places, strict=True):
        around = ink[max(0, int(p.y) - 7) : int(p.y) + 8, max(0, int(p.x) - 7) : int(p.x) + 8]
        rr, cc = np.indices(around.shape)
        assert abs((cc * around).sum() / around.sum() + max(0, int(p.x) - 7) - p.x) < 1
        assert abs((rr * around).sum() / around.sum() + max(0, int(p.y) - 7) - p.y) < 1
        moves.append(abs(p.x - x) + abs(p.y - y))
    assert max(moves) > 0.5
    still = {r.image_id: r for r in P.elastic(df, F.col("image_id"), 0.0).collect()}
    assert still[1].gray == dots.tobytes() and [(p.x, p.y) for p in still[1].points] == places


def test_filled_against_ray_casting():
    for _ in range(40):
        points = RNG.integers(-4, 26, (RNG.integers(3, 8), 2)).astype(float)
        got = P.filled(points, 22, 17)
        ends = [*zip(points.tolist(), np.roll(points, -1, axis=0).tolist(), strict=True)]
        for y in range(17):
            for x in range(22):
                odd = sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in ends) % 2 == 1
                edge = any(
                    (b[0] - a[0]) * (y - a[1]) == (b[1] - a[1]) * (x - a[0]) and min(a[0], b[0]) <= x <= max(a[0], b[0]) and min(a[1], b[1]) <= y <= max(a[1], b[1])
                    for a, b in ends
                )
                assert got[y, x] == (odd or edge), (points, x, y)


def test_masks_of_a_whole_page_and_of_nothing(spark):
    corner = lambda x, y: {"x": float(x), "y": float(y)}
    page = [corner(10, 10), corner(820, 20), corner(810, 1180), corner(5, 1170)]
    spots = [{"kind": "marker", "x": 100.0, "y": 100.0, "visible": True}, {"kind": "marker", "x": 300.0, "y": 300.0, "visible": False}]
    kinds = "image_id string, page array<struct<x:double,y:double>>, spots array<struct<kind:string,x:double,y:double,visible:boolean>>, grids array<array<struct<x:double,y:double>>>"
    df = spark.createDataFrame([("a", page, spots, [page]), ("b", None, None, None), ("c", [], [], [[]])], kinds)
    rows = {(r.image_id, r["mask"]): np.frombuffer(r.gray, np.uint8).reshape(1192, 832) for r in P.painted_masks(df, 832, 1192, {"marker": 4.0, "bubble": 2.6}).collect()}
    assert len(rows) == 12 and not any(m.any() for (k, _), m in rows.items() if k != "a")
    assert rows["a", "page"][600, 400] == 255 and rows["a", "page"][2, 2] == 0
    assert rows["a", "marker"][100, 100] == 255 and not rows["a", "marker"][290:310, 290:310].any() and not rows["a", "bubble"].any()
    assert rows["a", "grid"][10, 10] == 255 and rows["a", "grid"][600, 400] == 0


def test_draws_follow_weights_and_not_partitions(spark):
    data = [(k, "rare" if k < 10 else "common", 5.0 if k == 0 else 0.05) for k in range(1000)] + [(2000, "x", None), (2001, "x", 0.0), (2002, "x", -1.0)]
    df = spark.createDataFrame(data, "image_id long, gt_label string, weight double")
    got = L.epoch_draws(df, 5000, 1, 0, per_cell=100).orderBy("place").collect()
    assert [r.place for r in got] == [*range(5000)]
    assert L.epoch_draws(df.repartition(7), 5000, 1, 0, per_cell=999).orderBy("place").collect() == got
    assert L.epoch_draws(df, 5000, 1, 1).orderBy("place").collect() != got
    heavy = sum(r.image_id == 0 for r in got) / 5000
    assert abs(heavy - 5.0 / (5.0 + 999 * 0.05)) < 0.02
    assert all(r.image_id < 2000 for r in got) and len({r.image_id for r in got}) > 900
    assert L.epoch_draws(df.where("false"), 10, 1, 0).collect() == []


def test_halves_round_by_the_places_own_fractions():
    grays = np.random.default_rng(1).integers(0, 256, (2000, 8, 8)).astype(np.uint8)
    x, y = np.arange(8) - 1.3, np.arange(8)[:, None] - 1.3
    fx, fy = x - np.floor(x), y - np.floor(y)
    for p in grays:
        f = np.full((10, 10), 255.0)  # two rows and columns of background above and left of the picture
        f[2:, 2:] = p
        l, t = np.floor(x).astype(int) + 2, np.floor(y).astype(int) + 2
        want = (f[t, l] * (1 - fx) + f[t, l + 1] * fx) * (1 - fy) + (f[t + 1, l] * (1 - fx) + f[t + 1, l + 1] * fx) * fy
        assert (np.rint(P.sampled(p, x, y, 255)) == np.rint(want)).all()
