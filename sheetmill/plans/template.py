"""The sheet template whose measures the queries use."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.specs import TEMPLATE

# The measures of the answer sheet, in pixels of its 1650 x 2363 canonical page.
DOCUMENT = (Path(__file__).parent / "template.json").read_text()


def template(spark: SparkSession, document: str = DOCUMENT) -> DataFrame:
    """One row of nested structs."""
    rows = spark.createDataFrame([(document,)], "document string")
    return rows.select(F.from_json("document", TEMPLATE, {"mode": "FAILFAST"}).alias("t")).select("t.*")
