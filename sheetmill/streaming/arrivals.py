"""Sheets as they arrive: the batch operators on a stream of extraction lines or image files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.decode import decode_groups
from ..operators.ranking import relabel_by_rank

BUBBLE = "image_id string, item_id string, section string, spec_ord int, choice string, prelabel string, prelabel_source string, fill_score double, darkness_score double, alignment_status string, alignment_confidence double, arrived timestamp"


def arriving_bubbles(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(BUBBLE).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def arriving_images(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def decode_arrivals(bubbles: DataFrame, folder: str, checkpoint: str, *, filled_threshold: float = 0.08, margin_threshold: float = 0.025) -> StreamingQuery:
    """Decodes the sheets of each trigger and appends their items.

    A sheet's bubbles come in one file, so a trigger holds whole sheets.  A batch's files are named by its
    number and replaced if it is run again, so a restart neither loses nor repeats a sheet."""

    def write(batch: DataFrame, number: int) -> None:
        ranked = relabel_by_rank(batch, score="fill_score", filled_threshold=filled_threshold, margin_threshold=margin_threshold)
        decode_groups(ranked).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return bubbles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals_by_hour(bubbles: DataFrame, late: str = "1 hour") -> DataFrame:
    """Bubbles an hour, late lines within the watermark counted."""
    return bubbles.withWatermark("arrived", late).groupBy(F.window("arrived", "1 hour").alias("hour")).agg(F.count(F.lit(1)).alias("bubbles"))
