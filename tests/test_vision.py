"""Templates, points, pixels and transforms."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sheetmill.operators import geometry as G
from sheetmill.operators import matching as M
from sheetmill.operators import models as P
from sheetmill.operators import raster as R
from sheetmill.operators import specs as T
from sheetmill.operators import training as L
from sheetmill.plans.template import template

MINI = '{"bubble": [12, 10], "part1": {"choices": ["A", "B"], "columns": [{"question_start": 1, "question_count": 2, "choice_x": [30, 50], "row_y_start": 20, "row_y_step": 10}]}}'


def test_all_specs(spark):
    rows = T.all_specs(template(spark)).collect()
    by = {}
    for r in rows:
        by[r.section] = by.get(r.section, 0) + 1
    assert by == {"part1": 160, "identity": 120, "part2": 64, "part3": 258} and [r.spec_ord for r in rows if r.spec_ord] and len({r.spec_id for r in rows}) == 602


def test_small_template(spark):
    rows = T.part1_specs(template(spark, MINI)).orderBy("order").collect()
    assert [r.spec_id for r in rows] == ["I_001_A", "I_001_B", "I_002_A", "I_002_B"]
    assert rows[0].bbox == [24, 15, 36, 25] and rows[0].grid_block == "part1:q001-002"
    with pytest.raises(PySparkException):
        T.part1_specs(template(spark, MINI.replace('"A", "B"', '"A"'))).collect()


def test_rounding_is_half_even(spark):
    r = spark.range(1).select(T.pixel(F.lit(2.5)).alias("a"), T.pixel(F.lit(3.5)).alias("b"), T.bubble_box(F.lit(30), F.lit(20), F.array(F.lit(13), F.lit(11))).alias("c")).first()
    assert (r.a, r.b, r.c) == (2, 4, [24, 15, 36, 25])


def test_polyline(spark):
    points = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4))])
    got = spark.range(1).select(T.polyline(points, 4).alias("p")).first().p
    assert len(got) == 12 and (got[1].x, got[1].y) == (1.0, 0.0) and (got[11].x, got[11].y) == (1.0, 1.0)


def bubble(filled):
    gray = np.full((36, 36), 255)
    y, x = np.mgrid[:36, :36]
    if filled:
        gray[(x - 18) ** 2 + (y - 18) ** 2 <= 64] = 0
    return gray


def test_bubble_features(spark):
    data = [(name, int(y), int(x), int(v)) for name, on in (("blank", False), ("filled", True)) for (y, x), v in np.ndenumerate(bubble(on))]
    got = {r.image_id: r for r in R.bubble_features(spark.createDataFrame(data, "image_id string, y int, x int, gray int"), 36, 36).collect()}
    assert got["blank"].fill_score < 0.01 and got["filled"].fill_score > got["blank"].fill_score + 0.1 and got["filled"].component_score > 0.1
    rings = spark.createDataFrame(data[:1296], "image_id string, y int, x int, gray int").groupBy(R.ring_of(36, 36).alias("r")).count().collect()
    n = {r.r: r["count"] for r in rings}
    assert (n["core"], n["core"] + n["inner"], n["background"]) == (332, 532, 508)


def test_padded_crop_is_white_outside(spark):
    pixels = spark.createDataFrame([("i", 0, 0, 7)], "image_id string, y int, x int, gray int")
    boxes = spark.createDataFrame([("i", 1, -1, -1, 1, 1)], "image_id string, box_id int, x1 int, y1 int, x2 int, y2 int")
    assert sorted((r.y, r.x, r.gray) for r in R.padded_crop(pixels, boxes).collect()) == [(0, 0, 255), (0, 1, 255), (1, 0, 255), (1, 1, 7)]


def test_greedy_matching_is_one_to_one(spark):
    rng = np.random.default_rng(1)
    a = [("i", k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 30, (40, 2)))]
    b = [("i", k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 30, (40, 2)))]
    schema = "image_id string, id int, x double, y double"
    reach = M.reach_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 4.0)
    want = sorted((np.sqrt((p[2] - q[2]) * (p[2] - q[2]) + (p[3] - q[3]) * (p[3] - q[3])), p[1], q[1]) for p in a for q in b if np.hypot(p[2] - q[2], p[3] - q[3]) <= 4)
    assert sorted((r.a, r.b) for r in reach.collect()) == sorted((p, q) for _, p, q in want)
    used_a, used_b, kept = set(), set(), set()
    for _, p, q in want:
        if p not in used_a and q not in used_b:
            used_a.add(p), used_b.add(q), kept.add((p, q))
    assert {(r.a, r.b) for r in M.greedy_pairs(reach).collect()} == kept


def test_peaks_to_labels_counts_misses(spark):
    peaks = spark.createDataFrame([("i", 1, 0.9, 0.0, 0.0), ("i", 2, 0.8, 0.5, 0.0), ("j", 1, 0.7, 0.0, 0.0)], "image_id string, id int, score double, x double, y double")
    labels = spark.createDataFrame([("i", 1, 0.1, 0.0), ("k", 1, 0.0, 0.0)], "image_id string, id int, x double, y double")
    got = {r.image_id: (r.tp, r.fp, r.fn) for r in M.peaks_to_labels(peaks, labels, 1.0).collect()}
    assert got == {"i": (1, 1, 0), "j": (0, 1, 0), "k": (0, 0, 1)}


def test_near_circles_go(spark):
    circles = spark.createDataFrame([("i", 1, 0.0, 0.0, 5.0), ("i", 2, 7.9, 0.0, 6.0), ("i", 3, 15.9, 0.0, 4.0)], "image_id string, id int, x double, y double, radius double")
    assert sorted(r.id for r in M.drop_near(circles).collect()) == [2, 3]


def test_local_transforms():
    t = G.local_transform(np.array([[8.0, 13], [28, 13]]), np.array([[10.0, 10], [30, 10]]))
    assert (t["method"], t["status"], t["matrix"][2], t["matrix"][5]) == ("translation", "fallback_translation", 2.0, -3.0)
    t = G.local_transform(np.zeros((0, 2)), np.zeros((0, 2)))
    assert (t["status"], t["confidence"]) == ("fallback_global", 0.0)
    src = np.array([[10.0, 10], [90, 10], [10, 90]])
    t = G.local_transform(src, src - 10)
    assert np.allclose(t["matrix"], [1, 0, -10, 0, 1, -10, 0, 0, 1]) and t["status"] == "ok"
    square = np.array([[0.0, 0], [10, 0], [10, 10], [0, 10]])
    moved = np.array([[1.0, 2], [12, 1], [13, 14], [-1, 11]])
    assert np.allclose(G.apply_matrix(G.fit_homography(square, moved), square), moved)


def test_grid_transforms(spark):
    pairs = np.array([[10, 10, 13, 8], [30, 10, 33, 8], [10, 30, 13, 28], [30, 30, 33, 28], [50, 30, 53, 28]], float)
    t = G.grid_transform(pairs[:, :2], pairs[:, 2:], 5)
    assert (t["status"], t["method"]) == ("ok", "affine") and np.isclose(t["matrix"][2], 3) and np.isclose(t["matrix"][5], -2)
    t = G.grid_transform(np.array([[0.0, 0], [10, 0]]), np.array([[0.0, 0], [50, 0]]), 10)
    assert t["status"] == "alignment_failed" and not t["decode_allowed"]
    rng = np.random.default_rng(2)
    src = rng.uniform(0, 500, (40, 2))
    dst = src @ np.array([[1.01, 0.02], [-0.01, 0.99]]) + [4, -3]
    dst[:10] += rng.uniform(50, 90, (10, 2))
    t = G.grid_transform(src, dst, 40)
    assert (t["method"], t["n_inliers"]) == ("affine", 30) and t["rms"] < 1e-6
    df = spark.createDataFrame([("i", "b", *map(float, p), 5) for p in pairs], "image_id string, block string, sx double, sy double, dx double, dy double, expected int")
    (r,) = G.fit_grid(df).collect()
    assert r.status == "ok" and r.n == 5
    (r,) = G.shift_blocks(df).collect()
    assert (r.shift_x, r.shift_y, r.status, r.decode_allowed) == (3.0, -2.0, "fallback_translation", True)


def test_refined_specs_move(spark):
    specs = T.part1_specs(template(spark, MINI)).withColumn("image_id", F.lit("i"))
    fits = spark.createDataFrame([("i", "part1:q001-002", "ok", 1.0, True, [1.0, 0.0, 3.0, 0.0, 1.0, -2.0, 0.0, 0.0, 1.0])], "image_id string, grid_block string, status string, confidence double, decode_allowed boolean, matrix array<double>")
    r = G.refine_specs(specs, fits).orderBy("order").first()
    assert (r.center, r.template_center, r.bbox) == ([33, 18], [30, 20], [27, 13, 39, 23])


def test_loss_and_weights(spark):
    rows = spark.createDataFrame([(1, c, 0.0, t) for c in ("a", "b") for t in (1.0, 0.0)], "batch_id int, channel string, logit double, target double")
    even, heavy = (L.layout_loss(rows, {"a": 1.0, "b": w}).first().loss for w in (1.0, 5.0))
    assert heavy > even
    data = spark.createDataFrame([("x", "l1"), ("y", "l1"), ("z", "l2"), ("n", None)], "image_id string, gt_label string")
    assert {r.image_id: r.weight for r in L.balanced_weights(data).collect()} == {"x": 0.5, "y": 0.5, "z": 1.0, "n": 1.0}
    assert L.best_epoch(spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7)], "epoch int, mean_dice double")).first().epoch == 2
    assert L.best_epoch(spark.createDataFrame([], "epoch int, mean_dice double")).count() == 0
    split = {r["split"]: r["n"] for r in L.seeded_split(spark.range(50).withColumnRenamed("id", "image_id"), {"train": 20, "val": 5}).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert split == {"train": 20, "val": 5}


def test_classifier(spark):
    df = spark.createDataFrame([("s", "q", 1, 0.9), ("s", "q", 2, 0.1)], "image_id string, item_id string, spec_ord int, f double")
    got = P.classify_bubbles(df, ["f"], lambda: P.linear_scorer([20.0], -10.0)).orderBy("spec_ord").collect()
    assert [r.prelabel for r in got] == ["filled", "blank"] and got[0].prelabel_source == "bubble_classifier_group"
    with pytest.raises(ValueError):
        P.prediction(F.lit(None), ["a"], 2.0)


def test_exploded_points_are_never_broadcast(spark):
    images = spark.range(3).select(F.col("id").alias("image_id"))
    points = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(float(k)).alias("x"), F.lit(0.0).alias("y")) for k in range(16)])
    lattice = images.distinct().select("image_id", F.explode(points).alias("p")).select("image_id", "p.id", "p.x", "p.y")
    pairs = M.reach_pairs(lattice, lattice, 2.0)
    assert len(pairs.collect()) == 3 * (16 + 2 * 15 + 2 * 14)
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", ["_shifted", "points_in_reach", "template_point_match"])  # _shifted: what grid_fit fits
def test_queries_on_points_broadcast_nothing(spark, query):
    from sheetmill.plans import vision_queries as V

    found = getattr(V, query)(spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
