"""Printed circles, outlines, and grids refined by them."""

import numpy as np
import pytest

from sheetmill.operators import circles as C


def drawn(points, size=(300, 400), radius=12, ink=60, thick=2, noise=0, seed=0):
    y, x = np.mgrid[: size[0], : size[1]]
    page = np.full(size, 235, float)
    for px, py in points:
        far = np.hypot(x - px, y - py)
        page[np.abs(far - radius) <= thick / 2] = ink
    return np.clip(page + np.random.default_rng(seed).normal(0, noise, size), 0, 255).astype(np.uint8) if noise else page.astype(np.uint8)


def test_median_and_smoothing_against_loops():
    rng = np.random.default_rng(2)
    p = rng.integers(0, 256, (9, 13)).astype(np.uint8)
    pad = np.pad(p, 2, mode="edge")
    want = np.array([[np.median(pad[y : y + 5, x : x + 5]) for x in range(13)] for y in range(9)])
    assert np.array_equal(C.median_5x5(p), want)
    w = C.bell(5)
    want = np.array([[(pad[y : y + 5, x : x + 5] * np.outer(w, w)).sum() for x in range(13)] for y in range(9)])
    assert np.allclose(C.smoothed(p, w), want, atol=1e-3)
    assert abs(C.bell(31).sum() - 1) < 1e-12


@pytest.mark.parametrize("noise", [0, 6])
def test_circles_are_found_where_they_are(noise):
    points = [(40 + 45 * i, 50 + 50 * j) for i in range(8) for j in range(4)]
    assert len(C.voted_circles(drawn(points, noise=noise, thick=4))) >= 30  # thinner lines go with the median
    found = C.printed_circles(drawn(points, noise=noise))
    for p in points:
        far = np.hypot(found[:, 0] - p[0], found[:, 1] - p[1])
        assert far.min() <= 1.5 and abs(found[far.argmin(), 2] - 12) <= 2
    assert len(found) == len(points)
    apart = np.hypot(*(found[:, None, :2] - found[None, :, :2]).T)
    assert (apart[~np.eye(len(found), dtype=bool)] >= C.CIRCLES_APART).all()


def test_nothing_to_find():
    for page in (np.full((40, 60), 255, np.uint8), np.zeros((5, 5), np.uint8), np.zeros((1, 1), np.uint8)):
        assert C.printed_circles(page).shape == (0, 3)
    square = np.full((80, 80), 255, np.uint8)
    square[10:70, 39:41] = 0  # a line is no circle
    assert len(C.printed_circles(square)) == 0


def test_outlines_of_rings_squares_and_specks():
    mask = np.zeros((60, 90), bool)
    mask[5:25, 5:25] = True
    mask[8:22, 8:22] = False  # a hollow square counts as full
    mask[12:18, 12:18] = True  # and what is inside belongs to it
    mask[30:42, 40:52] = True
    mask[50, 80] = True
    mask[2:14, 60] = True  # a line has no area, and is passed on both sides
    got = {f[:2]: f[2:] for f in C.outlined(mask, 1, 40)}
    assert got[5, 5] == (20, 20, 19 * 19, 4 * 19) and (12, 12) not in got
    assert got[40, 30] == (12, 12, 121, 44) and got[80, 50] == (1, 1, 0, 0) and got[60, 2] == (1, 12, 0, 22)
    # The filled number of pixels follows from a simple outline's area and points (Pick).
    y, x = np.mgrid[:60, :60]
    disk = np.hypot(x - 30, y - 30) <= 13
    (f,) = C.outlined(disk, 5, 40)
    path = C.outline(np.pad(disk, 1), 18, 31)
    assert len(path) and f[4] + len(path) / 2 + 1 == disk.sum()
    assert 4 * np.pi * f[4] / f[5] ** 2 > 0.8


def test_pairs_are_one_to_one_and_nearest_first():
    a, b = np.array([[0, 0], [10, 0], [100, 0]]), np.array([[4.0, 0], [9, 0], [60, 0]])
    assert C.nearest_pairs(a, b).tolist() == [[1, 1], [0, 0]]
    assert C.nearest_pairs(a, np.zeros((0, 2))).shape == (0, 2)


def test_grids_follow_their_circles():
    centres = np.array([(40 + 45 * i, 50 + 50 * j) for i in range(8) for j in range(4)])
    boxes = np.c_[centres - 18, centres + 18]
    page = drawn(centres[:16] + [5, -3])
    page = np.minimum(page, drawn(centres[16:]))
    moved, fits = C.refined_grids(page, C.grid_names(["left"] * 16 + ["right"] * 16), centres, boxes, 10)
    assert fits["left"]["status"] == fits["right"]["status"] == "ok" and fits["left"]["method"] == "affine"
    assert np.abs(moved[:16] - boxes[:16] - [5, -3, 5, -3]).max() <= 1 and np.abs(moved[16:] - boxes[16:]).max() <= 1
    same, none = C.refined_grids(np.full((300, 400), 255, np.uint8), C.grid_names(["a"] * 32), centres, boxes, 10)
    assert none["a"]["status"] == "skipped" and none["a"]["circles"] == 0 and np.array_equal(same, boxes)
