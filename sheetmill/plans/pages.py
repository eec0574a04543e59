"""Drawn answer sheets, with answers that a formula knows: test pages for the extraction queries.

Page k of 25 holds the template's marks and filled bubbles under a small affine of its own.  On every fifth
page a mark is missing; page 23 has two marks and nothing else, and page 24 can't be read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT = 1700, 2440


def affine(k: int) -> np.ndarray:
    """From the template's pixels to the scan's."""
    a, b = 1 + 0.004 * (k % 5), 0.002 * (k % 3)
    return np.array([[a, b, 11 + 3 * (k % 7)], [-b, a, 14 + 4 * (k % 4)], [0, 0, 1]])


def is_marked(k: int, spec: dict) -> bool:
    """Whether a bubble is filled on page k."""
    number, slot, choice = spec["question_number"], spec["slot"] or 0, spec["choice"]
    if spec["section"] == "identity":
        return choice == str((7 * k + 3 * slot) % 10 if spec["field"] == "sbd" else (k + slot) % 10)
    if spec["section"] == "part1":
        return number % 11 != 5 and choice == "ABCD"[(k + number) % 4]
    if spec["section"] == "part2":
        return choice == "TF"[(k + number + slot) % 2]
    if spec["role"] == "sign":
        return (k + number) % 2 == 0
    if spec["role"] == "comma":
        return choice == f"after_{(k + number) % 2 + 1}"
    return choice == str((k + number + slot) % 10)


#: The grid block that printed pages move, and the pages on which it isn't printed at all.
MOVED, MISSING = "part3:q003", 7


def moved_by(k: int) -> tuple[int, int]:
    """How far page k's moved block lies beside its place."""
    return 4 * (k % 5) - 8, 4 * (k % 4) - 4


def draw(k: int, template: dict, specs: list[dict], printed: bool = False) -> np.ndarray:
    """Page k; with ``printed``, a ring stands around each bubble, and one block beside its place or not at all."""
    page, m = np.full((HEIGHT, WIDTH), 255, np.uint8), affine(k)
    marks = template["marks"][:2] if k == 23 else [t for t in template["marks"] if not (k % 5 == 4 and t["name"] == "part2_right_bottom")]
    for t in marks:
        x, y = (m @ [t["x"], t["y"], 1])[:2]
        page[round(y) - 15 : round(y) + 15, round(x) - 15 : round(x) + 15] = 10
    dy, dx = np.mgrid[-14:15, -14:15]
    far = np.hypot(dx, dy)
    for spec in specs:
        there = printed and spec["grid_block"] == MOVED
        if k == 23 or there and k % MISSING == 3:
            continue
        x, y = (m @ [*(np.array(spec["center"]) + (moved_by(k) if there else 0)), 1])[:2]
        spot = page[round(y) - 14 : round(y) + 15, round(x) - 14 : round(x) + 15]
        if printed:
            spot[np.abs(far - 13) <= 1] = 90
        if is_marked(k, spec):
            spot[far <= 11] = 20
    return page


def drawn_pages(keys: DataFrame, template: dict, specs: DataFrame, printed: bool = False) -> DataFrame:
    """``image_id, width, height, gray`` of the pages ``image_id`` (one row each)."""
    rows = [r.asDict() for r in specs.select("section", "field", "question_number", "slot", "choice", "role", "center", "grid_block").collect()]  # a template's bubbles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("image_id").to_pylist():
                gray = None if k == 24 else draw(k, template, rows, printed).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], batch.column("image_id").type), pa.array([WIDTH], pa.int32()), pa.array([HEIGHT], pa.int32()), pa.array([gray], pa.binary())], names=["image_id", "width", "height", "gray"]
                )

    kind = keys.schema["image_id"].dataType.simpleString()
    return keys.select("image_id").repartition(8, F.col("image_id")).mapInArrow(run, f"image_id {kind}, width int, height int, gray binary")
