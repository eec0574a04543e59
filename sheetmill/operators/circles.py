"""Printed circles of a page, and grids of bubbles refined by them.

Kernels over one page's grey pixels, for use inside Arrow batches: circle centres by votes along gradients,
outlines by border following, and the two together matched to a template's bubbles.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from . import geometry as G
from .raster import component_labels

# What counts as a printed bubble, in pixels of the template's size.
RADII = (8, 18)
STRONG, WEAK = 70, 35
LEAST_VOTES, CELL, CENTRES_APART, CIRCLES_APART = 24, 1.2, 18.0, 8.0
AREAS, SIDES, ASPECTS, ROUNDNESS = (35.0, 900.0), (8, 34), (0.65, 1.45), 0.35
WINDOW, DARKER = 31, 8
REACH = 32.0

#: The eight neighbours, clockwise from the right, rows growing downwards.
_AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def median_5x5(gray: np.ndarray) -> np.ndarray:
    """Each pixel's median over its square of 25, borders repeated: the extremes of a shrinking set are
    forgotten until one value is left, on whole pictures at a time."""
    h, w = gray.shape
    pad = np.pad(gray, 2, mode="edge")
    left = [pad[dy : dy + h, dx : dx + w] for dy in range(5) for dx in range(5)]
    held, left = left[:14], left[14:]
    while len(held) > 1:
        for first, pick, rest in ((0, np.minimum, np.maximum), (len(held) - 1, np.maximum, np.minimum)):
            for k in range(len(held)):
                if k != first and not (first and k == 0):
                    held[first], held[k] = pick(held[first], held[k]), rest(held[first], held[k])
        held = held[1:-1]
        if left:
            held.append(left.pop())
    return held[0]


def smoothed(picture: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The picture under a separable kernel, borders repeated."""
    r = len(weights) // 2
    for axis in (0, 1):
        pad = np.pad(picture, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge").astype(np.float32)
        n = picture.shape[axis]
        total = np.zeros(picture.shape, np.float32)
        for k, w in enumerate(weights):
            total += np.float32(w) * (pad[k : k + n] if axis == 0 else pad[:, k : k + n])
        picture = total
    return picture


def bell(size: int) -> np.ndarray:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return w / w.sum()


def edges(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``y, x`` of thin edges, and the gradient there: crests of the gradient that are strong, or hang together
    with a strong one."""
    p = np.pad(gray, 1, mode="edge").astype(np.int32)
    low, high = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:], p[:-2] + 2 * p[1:-1] + p[2:]
    gy, gx = low[2:] - low[:-2], high[:, 2:] - high[:, :-2]
    size = np.abs(gx) + np.abs(gy)
    wide = np.pad(size, 1)
    at = lambda dy, dx: wide[1 + dy : 1 + dy + size.shape[0], 1 + dx : 1 + dx + size.shape[1]]
    flat, steep = np.abs(gy) < 0.41421356 * np.abs(gx), np.abs(gy) > 2.41421356 * np.abs(gx)
    falling = (gx > 0) == (gy > 0)
    crest = np.where(
        flat, (size > at(0, -1)) & (size >= at(0, 1)),
        np.where(steep, (size > at(-1, 0)) & (size >= at(1, 0)), np.where(falling, (size > at(-1, -1)) & (size > at(1, 1)), (size > at(-1, 1)) & (size > at(1, -1)))),
    )
    y, x = np.nonzero(crest & (size > WEAK))
    if not len(y):
        return y, x, gy[y, x], gx[y, x]
    _, label = np.unique(component_labels(np.zeros(len(y), np.int64), y, x), return_inverse=True)
    held = np.zeros(label.max() + 1, bool)
    held[label[size[y, x] > STRONG]] = True
    keep = held[label]
    return y[keep], x[keep], gy[y[keep], x[keep]], gx[y[keep], x[keep]]


def voted_circles(gray: np.ndarray) -> list[tuple[float, float, float]]:
    """``x, y, radius`` of circles: every edge votes for the centres along its gradient on both sides; crests of the
    votes, the highest first and none near another, take the radius at which most edges lie for its length."""
    y, x, gy, gx = edges(median_5x5(gray))
    if not len(y):
        return []
    length = np.hypot(gx, gy)
    reach = np.arange(RADII[0], RADII[1] + 1)[:, None] * np.array([1, -1])[:, None, None]
    cx = np.floor((x + reach * gx / length) / CELL).astype(np.int64)
    cy = np.floor((y + reach * gy / length) / CELL).astype(np.int64)
    h, w = int(gray.shape[0] / CELL) + 1, int(gray.shape[1] / CELL) + 1
    inside = (cx >= 0) & (cx < w) & (cy >= 0) & (cy < h)
    votes = np.bincount(cy[inside] * w + cx[inside], minlength=h * w).reshape(h, w)
    wide = np.pad(votes, 1)
    top = (votes > LEAST_VOTES) & (votes > wide[1:-1, :-2]) & (votes >= wide[1:-1, 2:]) & (votes > wide[:-2, 1:-1]) & (votes >= wide[2:, 1:-1])
    ty, tx = np.nonzero(top)
    edge = np.zeros(gray.shape, bool)
    edge[y, x] = True
    found: list[tuple[float, float, float]] = []
    taken: dict[tuple[int, int], list[tuple[float, float]]] = {}
    for k in np.lexsort((tx, ty, -votes[ty, tx])).tolist():
        px, py = (tx[k] + 0.5) * CELL, (ty[k] + 0.5) * CELL
        cell = int(px // CENTRES_APART), int(py // CENTRES_APART)
        near = (q for dx in (-1, 0, 1) for dy in (-1, 0, 1) for q in taken.get((cell[0] + dx, cell[1] + dy), ()))
        if any((px - q[0]) ** 2 + (py - q[1]) ** 2 < CENTRES_APART**2 for q in near):
            continue
        y0, x0 = max(0, int(py) - RADII[1] - 1), max(0, int(px) - RADII[1] - 1)
        ey, ex = np.nonzero(edge[y0 : int(py) + RADII[1] + 3, x0 : int(px) + RADII[1] + 3])
        far = np.hypot(ex + x0 - px, ey + y0 - py)
        far = np.sort(far[(far >= RADII[0]) & (far <= RADII[1])])
        if not len(far):
            continue
        n = np.searchsorted(far, far + CELL, "right") - np.arange(len(far))
        best = int((n / far).argmax())
        if n[best] > LEAST_VOTES:
            found.append((float(px), float(py), float(far[best : best + n[best]].mean())))
            taken.setdefault(cell, []).append((px, py))
    return found


def outline(mask: np.ndarray, y: int, x: int) -> np.ndarray:
    """The outer border of the set of pixels whose first one, by rows, is at ``y, x``: its pixels ``x, y`` clockwise,
    each as often as the border passes it.  ``mask`` has an empty rim."""
    path, at, back = [(x, y)], (y, x), 4
    first = None
    while True:
        for turn in range(1, 9):
            side = (back + turn) % 8
            there = at[0] + _AROUND[side][0], at[1] + _AROUND[side][1]
            if mask[there]:
                break
        else:
            return np.array(path)
        if first is None:
            first = (at, side)
        elif (at, side) == first:
            return np.array(path[:-1])
        at, back = there, (side + 4) % 8
        path.append((there[1], there[0]))


def outline_sizes(path: np.ndarray) -> tuple[float, float]:
    """The area within a border and its length."""
    ahead = np.roll(path, -1, axis=0)
    area = abs(float((path[:, 0] * ahead[:, 1] - ahead[:, 0] * path[:, 1]).sum())) / 2
    return area, float(np.hypot(*(ahead - path).T).sum())


def outlined(mask: np.ndarray, least: int, most: int) -> list[tuple[int, int, int, int, float, float]]:
    """``x, y, w, h, area, length`` of the outer outlines of the mask's connected sets whose boxes' sides lie between
    ``least`` and ``most``, by y, then x.  What lies within another's outline is part of it."""
    y, x = np.nonzero(mask)
    if not len(y):
        return []
    _, start, label = np.unique(component_labels(np.zeros(len(y), np.int64), y, x), return_index=True, return_inverse=True)
    n = len(start)
    low, high = np.full((n, 2), 1 << 30), np.full((n, 2), -1)
    at = np.stack([x, y], axis=1)
    np.minimum.at(low, label, at)
    np.maximum.at(high, label, at)
    sides = high - low + 1
    first = np.full(n, len(y))
    np.minimum.at(first, label, np.arange(len(y)))
    rim = np.pad(mask, 1)
    owner = np.full(rim.shape, -1)
    owner[y + 1, x + 1] = label
    found = []
    for k in np.flatnonzero(((sides >= least) & (sides <= most)).all(axis=1)).tolist():
        y0, x0, y1, x1 = low[k, 1], low[k, 0], high[k, 1] + 3, high[k, 0] + 3
        path = outline(owner[y0:y1, x0:x1] == k, y[first[k]] + 1 - y0, x[first[k]] + 1 - x0)
        found.append((int(low[k, 0]), int(low[k, 1]), int(sides[k, 0]), int(sides[k, 1]), *outline_sizes(path), path + [x0 - 1, y0 - 1], k))
    inner = set()
    boxes = np.array([f[:4] for f in found]).reshape(-1, 4)
    for f in found:  # of the boxes strictly inside this one, those whose first pixel its outline goes round
        for j in np.flatnonzero((boxes[:, 0] > f[0]) & (boxes[:, 1] > f[1]) & (boxes[:, :2] + boxes[:, 2:] < [f[0] + f[2], f[1] + f[3]]).all(axis=1)).tolist():
            px, py = x[first[found[j][7]]], y[first[found[j][7]]]
            a, b = f[6], np.roll(f[6], -1, axis=0)
            crosses = ((a[:, 1] > py) != (b[:, 1] > py)) & (px < (b[:, 0] - a[:, 0]) * (py - a[:, 1]) / np.where(a[:, 1] == b[:, 1], 1, b[:, 1] - a[:, 1]) + a[:, 0])
            if crosses.sum() % 2:
                inner.add(j)
    return sorted(f[:6] for j, f in enumerate(found) if j not in inner)  # by x; callers order as they need


def outlined_circles(gray: np.ndarray) -> list[tuple[float, float, float]]:
    """``x, y, radius`` of round dark outlines against their surroundings."""
    fine = np.rint(smoothed(gray, np.array([0.25, 0.5, 0.25])))
    dark = fine <= np.rint(smoothed(fine, bell(WINDOW))) - DARKER
    for pick in (np.logical_and, np.logical_or):  # specks go: a cross must fit
        pad = np.pad(dark, 1, constant_values=pick is np.logical_and)
        dark = pick.reduce([pad[1:-1, 1:-1], pad[:-2, 1:-1], pad[2:, 1:-1], pad[1:-1, :-2], pad[1:-1, 2:]])
    found = []
    for x, y, w, h, area, length in outlined(dark, *SIDES):
        if AREAS[0] <= area <= AREAS[1] and ASPECTS[0] <= w / h <= ASPECTS[1] and length > 0 and 4 * np.pi * area / length**2 >= ROUNDNESS:
            found.append((x + w / 2, y + h / 2, (w + h) / 4))
    return found


def printed_circles(gray: np.ndarray) -> np.ndarray:
    """``x, y, radius`` of all circles, the largest first; none near a larger one."""
    every = sorted([*voted_circles(gray), *outlined_circles(gray)], key=lambda c: -c[2])
    kept: list[tuple[float, float, float]] = []
    cells: dict[tuple[int, int], list[tuple[float, float, float]]] = {}
    for c in every:
        cell = int(c[0] // CIRCLES_APART), int(c[1] // CIRCLES_APART)
        near = (q for dx in (-1, 0, 1) for dy in (-1, 0, 1) for q in cells.get((cell[0] + dx, cell[1] + dy), ()))
        if not any(np.hypot(c[0] - q[0], c[1] - q[1]) < CIRCLES_APART for q in near):
            kept.append(c)
            cells.setdefault(cell, []).append(c)
    return np.array(kept).reshape(-1, 3)


def nearest_pairs(expected: np.ndarray, found: np.ndarray, reach: float = REACH) -> np.ndarray:
    """One-to-one pairs of rows of both, the nearest first, ties by the first's row, then the second's."""
    far = np.hypot(expected[:, None, 0] - found[None, :, 0], expected[:, None, 1] - found[None, :, 1])
    a, b = np.nonzero(far <= reach)
    used_a, used_b, pairs = set(), set(), []
    for k in np.lexsort((b, a, far[a, b])).tolist():
        i, j = int(a[k]), int(b[k])
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            pairs.append((i, j))
    return np.array(pairs, np.int64).reshape(-1, 2)


def refined_grids(page: np.ndarray, blocks: dict[str, np.ndarray], centres: np.ndarray, boxes: np.ndarray, margin: int) -> tuple[np.ndarray, dict[str, dict]]:
    """The boxes of all bubbles, each block's moved by its own fit to the circles found around it; and the fits, with
    the number of circles.  ``blocks``: the rows of each block's bubbles."""
    height, width = page.shape
    moved, fits = boxes.copy(), {}
    for name, rows in blocks.items():
        low, high = np.maximum(0, boxes[rows, :2].min(axis=0) - margin), np.minimum((width, height), boxes[rows, 2:].max(axis=0) + margin)
        circles = printed_circles(page[low[1] : high[1], low[0] : high[0]])[:, :2] + low if (high > low).all() else np.zeros((0, 2))
        pairs = nearest_pairs(centres[rows], circles)
        fit = G.grid_transform(centres[rows][pairs[:, 0]].astype(float), circles[pairs[:, 1]], len(rows))
        fits[name] = fit | {"circles": len(circles)}
        if fit["status"] in ("ok", "need_review", "fallback_translation"):
            there = np.rint(G.apply_matrix(np.array(fit["matrix"]).reshape(3, 3), centres[rows])).astype(np.int64)
            moved[rows] += np.tile(there - centres[rows], 2)
    return moved, fits


def grid_names(names: Sequence[str]) -> dict[str, np.ndarray]:
    """The rows of each name, in order of its first row."""
    return {name: np.flatnonzero(np.array(names) == name) for name in dict.fromkeys(names)}
