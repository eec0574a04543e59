"""Training samples: covers, painted pictures against loops, and files read back."""

import glob
import json

import numpy as np
from pyspark.sql import functions as F

from sheetmill.operators import layout as Y
from sheetmill.operators import samples as X
from sheetmill.sources import readers

RNG = np.random.default_rng(4)


def sheets(spark, n=4):
    rows = [(k, 60, 80, RNG.integers(0, 200, (80, 60)).astype(np.uint8).tobytes()) for k in range(n)]
    return spark.createDataFrame([*rows, (90, 60, 80, None), (91, 2, 2, b"abc")], "image_id long, width int, height int, gray binary")


def labelled(spark, docs, **more):
    points = [("marker", f"m{k}", float(x), float(y)) for k, (x, y) in enumerate([(5, 5), (55, 5), (55, 75), (5, 75)])] + [("bubble", f"b{k}", 10.0 + 5 * k, 40.0) for k in range(8)]
    geometry = Y.training_geometry(docs, 60, 80, 90, 120, augmented=2, seed=1, shift=12.0, bend=4.0)
    labels = Y.training_labels(geometry, spark.createDataFrame(points, "kind string, id string, x double, y double"), 90, 120, occluded=0.7, seed=2)
    return geometry, X.with_covers(labels, 3, **more)


def test_covers_hide_wholly_or_in_part(spark):
    _, labels = labelled(spark, spark.range(200).select(F.col("id").alias("image_id")))
    rows = labels.collect()
    assert sorted(labels.repartition(7).collect()) == sorted(rows)
    covered = [r for r in rows if r.cover]
    assert len(covered) > 300 and all(r.occluded and r.in_frame and r.kind == "marker" for r in covered)
    assert all(r.cover is None and r.visible == r.in_frame for r in rows if not (r.occluded and r.in_frame))
    hidden = [r for r in covered if not r.visible]
    assert 0.35 < len(hidden) / len(covered) < 0.55
    for r in covered:
        c = r.cover
        assert 190 <= c.gray <= 255
        wide, high = c.x2 - c.x1, c.y2 - c.y1
        if not r.visible:
            assert wide == high and 28 <= wide <= 62 and (c.x1 + c.x2, c.y1 + c.y2) == (2 * round(r.x), 2 * round(r.y))
        else:
            assert 12 <= wide <= 2 * 38 and 12 <= high <= 2 * 38 and abs(c.x1 + c.x2 - 2 * round(r.x)) <= 62


def test_files_read_back_equal_the_rows(spark, tmp_path):
    folder = (tmp_path / "set").as_uri()
    pictures = sheets(spark)
    geometry, labels = labelled(spark, pictures)
    splits = pictures.select("image_id", F.when(F.col("image_id") % 2 == 0, "train").otherwise("val").alias("split"))
    samples = X.described(geometry, labels, splits)
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    page = F.array(corner(3.0, 3.0), corner(80.0, 3.0), corner(80.0, 110.0), corner(3.0, 110.0))
    manifest = X.build_samples(samples, pictures, page, F.array(page), 90, 120, folder).collect()
    assert len(manifest) == 12 and {r.split for r in manifest} == {"train", "val"}
    files = sorted(glob.glob(str(tmp_path / "set/**/*.*"), recursive=True))
    assert len(files) == 12 * 6 and all(f.endswith((".png", ".json")) for f in files)
    content = {f: open(f, "rb").read() for f in files}
    X.build_samples(samples.repartition(5), pictures, page, F.array(page), 90, 120, folder)
    assert sorted(glob.glob(str(tmp_path / "set/**/*.*"), recursive=True)) == files
    assert all(open(f, "rb").read() == content[f] for f in files)

    source = {r.image_id: np.frombuffer(r.gray, np.uint8).reshape(80, 60) for r in pictures.where("image_id < 90").collect()}
    rows = {r.sample_id: r for r in samples.collect()}
    decoded = readers.decode_images(spark, folder + "/images/*/*.png").collect()
    shown = {r.path.rpartition("/")[2].removesuffix(".png"): np.frombuffer(bytes(r["data"]), np.uint8).reshape(r.height, r.width, -1)[..., 0] for r in decoded}
    assert set(shown) == {r.sample_id for r in manifest}
    for r in manifest:
        label = json.loads(content[str(tmp_path / "set" / r.label_path)])
        own = rows[r.sample_id]
        assert (label["sample_id"], label["base_image_id"], label["split"], label["image"]["path"]) == (r.sample_id, r.base_image_id, r.split, r.image_path)
        assert label["counts"] == {"markers": 4, "visible_markers": r.visible_markers, "bubbles": 8, "visible_bubbles": r.visible_bubbles}
        assert [(m["id"], m["x"], m["visible"]) for m in label["markers"]] == [(m.id, m.x, m.visible) for m in own.markers]
        assert label["masks"] == r.mask_paths.asDict() and all(str(tmp_path / "set" / p) in content for p in r.mask_paths)
        want, back = np.zeros((120, 90)), np.linalg.inv(np.array(own.matrix).reshape(3, 3))
        at = lambda x, y, g: float(g[y, x]) if 0 <= x < 60 and 0 <= y < 80 else 255.0
        for y in range(120):
            for x in range(90):
                u, v, w = back @ [x, y, 1]
                u, v = min(max(u / w, -1), 60), min(max(v / w, -1), 80)
                a, b, g = int(np.floor(u)), int(np.floor(v)), source[r.base_image_id]
                top = at(a, b, g) * (1 - u + a) + at(a + 1, b, g) * (u - a)
                want[y, x] = top * (1 - v + b) + (at(a, b + 1, g) * (1 - u + a) + at(a + 1, b + 1, g) * (u - a)) * (v - b)
        for c in own.covers:
            for y in range(max(0, c.y1), min(119, c.y2) + 1):
                for x in range(max(0, c.x1), min(89, c.x2) + 1):
                    want[y, x] = c.gray
        assert np.abs(shown[r.sample_id] - want).max() <= 0.5 + 1e-6
