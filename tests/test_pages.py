"""Registration, warping and extraction of pages."""

import json

import numpy as np
from pyspark.sql import functions as F

from sheetmill.operators import extraction as E
from sheetmill.operators import raster as R
from sheetmill.operators import registration as M
from sheetmill.operators import specs as T
from sheetmill.plans.template import DOCUMENT, template

TEMPLATE = json.loads(DOCUMENT)


def targets(marks=TEMPLATE["marks"]):
    return F.array(*[F.struct(F.lit(m["name"]).alias("name"), F.lit(m["x"]).alias("x"), F.lit(m["y"]).alias("y")) for m in marks])


def page_of(names, width=1650, height=2363):
    page = np.full((height, width), 255, np.uint8)
    for m in TEMPLATE["marks"]:
        if m["name"] in names:
            page[m["y"] - 15 : m["y"] + 16, m["x"] - 15 : m["x"] + 16] = 0
    return page


def pages(spark, *found):
    rows = [(i, p.shape[1], p.shape[0], bytearray(p.tobytes())) if p is not None else (i, 1, 1, None) for i, p in enumerate(found)]
    return spark.createDataFrame(rows, "image_id int, width int, height int, gray binary")


def test_marks_bootstrap_from_three_corners(spark):
    some = ["top_left", "top_right", "bottom_left", "part1_left_top", "part1_right_top"]
    got = E.registered_pages(pages(spark, page_of(some), page_of(["top_left", "top_right"]), None, np.full((40, 40), 255, np.uint8)), TEMPLATE).collect()
    assert sorted(m.name for m in got[0].marks) == sorted(some) and got[0].error is None
    by = {m.name: (m.x, m.y) for m in got[0].marks}
    assert all(abs(by[m["name"]][0] - m["x"]) <= 1 and abs(by[m["name"]][1] - m["y"]) <= 1 for m in TEMPLATE["marks"] if m["name"] in some)
    assert sorted(m.name for m in got[1].marks) == ["top_left", "top_right"] and got[1].error == "missing source markers: ['bottom_right', 'bottom_left']"
    assert got[2].error == "image_read_failed" and got[3].error.startswith("missing source markers: ['top_left'")


def test_warp_of_three_marks_is_an_affine(spark):
    marks = [{"name": n, "x": x, "y": y} for n, x, y in (("top_left", 10, 10), ("top_right", 50, 10), ("bottom_right", 50, 50), ("bottom_left", 10, 50))]
    found = F.array(*[F.struct(F.lit(m["name"]).alias("name"), F.lit(m["x"] + 10.0).alias("x"), F.lit(m["y"] + 10.0).alias("y")) for m in marks[:3]])
    (r,) = M.with_warp(spark.range(1).withColumn("marks", found), "marks", targets(marks)).collect()
    assert np.allclose(np.array(r.matrix).reshape(3, 3), [[1, 0, -10], [0, 1, -10], [0, 0, 1]]) and r.error is None
    page = np.random.default_rng(1).integers(0, 256, (80, 80)).astype(np.uint8)
    moved = E.warped(page, np.array(r.matrix).reshape(3, 3), (0, 0, 80, 80))
    assert np.array_equal(moved[:70, :70], page[10:, 10:]) and (moved[71:] == 0).all()
    assert np.array_equal(E.warped(page, np.eye(3), (3, 5, 20, 30)), page[5:30, 3:20])


def test_a_detector_is_used_unless_rules_find_more(spark):
    rows = pages(spark, page_of([m["name"] for m in TEMPLATE["marks"]]))
    some = F.array(*[F.struct(F.lit(m["name"]).alias("name"), F.lit(float(m["x"])).alias("x"), F.lit(float(m["y"])).alias("y")) for m in TEMPLATE["marks"][:4]])
    (r,) = E.registered_pages(rows, TEMPLATE, some).select("marker_source", F.size("marks").alias("n")).collect()
    assert (r.marker_source, r.n) == ("rule_based_fallback_after_layout_v0", 10)


def test_features_of_crops_agree_with_pixel_rows(spark):
    rng = np.random.default_rng(3)
    page = rng.integers(0, 256, (30, 40)).astype(np.uint8)
    boxes = np.array([[0, 0, 12, 12], [10, 5, 22, 17], [35, 25, 47, 37]])
    got = E.crop_features(page, boxes)
    rows = []
    for k, (x1, y1, x2, y2) in enumerate(boxes.tolist()):
        for y in range(y1, y2):
            for x in range(x1, x2):
                rows.append((k, y - y1, x - x1, int(page[y, x]) if y < 30 and x < 40 else 255))
    want = {r.image_id: r for r in R.bubble_features(spark.createDataFrame(rows, "image_id int, y int, x int, gray int"), 12, 12).collect()}
    for k in range(3):
        assert np.allclose(got[k], [want[k][c] for c in E.FEATURES], atol=1e-6)


def test_components_of_many_images_at_once():
    rng = np.random.default_rng(5)
    images = rng.random((6, 9, 11)) < 0.4
    k, y, x = np.nonzero(images)
    got = R.component_sizes(k, y, x)
    for i in range(6):
        left = set(zip(*np.nonzero(images[i])))
        while left:
            front = [left.pop()]
            whole = [front[0]]
            while front:
                a, b = front.pop()
                for q in [(a + p, b + r) for p in (-1, 0, 1) for r in (-1, 0, 1)]:
                    if q in left:
                        left.remove(q)
                        front.append(q)
                        whole.append(q)
            for a, b in whole:
                assert got[(k == i) & (y == a) & (x == b)] == len(whole)
    assert len(R.component_sizes(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))) == 0


def test_no_pages(spark):
    sheets, items = E.extract_sheets(pages(spark, None).limit(0), T.all_specs(template(spark)), TEMPLATE)
    assert sheets.collect() == [] and items.collect() == []
