"""Sources: JSON lines, documents, id lists, CSV manifests and images."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import base_id, crop_name, hash_split, image_id

IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark reads is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object a line; blank lines are skipped and a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_if_exists(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return read_jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_variant_lines(spark: SparkSession, path: str) -> DataFrame:
    """Objects without a fixed schema, as ``record`` of type variant."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("record"))


def read_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON file that is one document, such as a template."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_document_if_exists(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A run's summary or another single document; no row where there is no such file."""
    return read_document(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def first_that_exists(spark: SparkSession, path: str, *bases: str) -> str:
    """A path as it is if absolute; else below the first base that holds it, and below the last one if none does."""
    if path.startswith("/") or "://" in path:
        return path
    places = [f"{base.rstrip('/')}/{path}" for base in bases]
    return next((p for p in places if exists(spark, p)), places[-1])


def read_ids(spark: SparkSession, path: str) -> DataFrame | None:
    """The first tab-separated field of each line that is neither blank nor a comment; None, which
    means no filter, where the file is missing."""
    if not exists(spark, path):
        return None
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(F.split(line, "\t")[0].alias("image_id")).distinct()


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every column text."""
    return spark.read.option("header", True).csv(path)


def ok_sheets(sheets: DataFrame, ids: DataFrame | None = None, order: str = "relative_path") -> DataFrame:
    """Sheets that are ok and, given ids, among them; by the lower-cased order column, image_id where it lacks."""
    rows = sheets.where("status = 'ok'")
    if ids is not None:
        rows = rows.join(ids.select("image_id"), "image_id", "left_semi")
    key = F.coalesce(F.col(order).cast("string"), F.col("image_id").cast("string")) if order in sheets.columns else F.col("image_id").cast("string")
    return rows.orderBy(F.lower(key))


def read_images(spark: SparkSession, path: str, *, recursive: bool = False, suffixes: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    """``path, image_id, content`` of the image files in a folder, in no order (sorting would shuffle the files'
    bytes); other files are passed over."""
    glob = "*.{" + ",".join([*suffixes, *[s.upper() for s in suffixes]]) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)
    return files.select("path", base_id(F.col("path")).alias("image_id"), "content")


def decode_images(spark: SparkSession, path: str) -> DataFrame:
    """``image_id, width, height, n_channels, data`` in BGR rows; what can't be decoded has an error instead."""
    rows = spark.read.format("image").option("dropInvalid", False).load(path)
    bad = F.col("image.height") < 0
    return rows.select(
        F.col("image.origin").alias("path"),
        base_id(F.col("image.origin")).alias("image_id"),
        *[F.when(~bad, F.col(f"image.{c}")).alias(n) for c, n in (("width", "width"), ("height", "height"), ("nChannels", "n_channels"), ("data", "data"))],
        F.when(bad, F.lit("image_read_failed")).alias("error"),
    )


def gray_images(images: DataFrame) -> DataFrame:
    """``image_id, width, height, gray`` of decoded images: bytes by rows, by the usual weights of the three
    colours.  One kernel call an Arrow batch of images; what can't be decoded goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for width, height, channels, data in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "n_channels", "data")), strict=True):
                pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                gray = pixels[..., 0] if channels == 1 else np.rint(pixels[..., :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)
                found.append(gray.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("image_id", "width", "height")), pa.array(found, pa.binary())], names=["image_id", "width", "height", "gray"])

    kind = images.schema["image_id"].dataType.simpleString()
    return images.where("data is not null").select("image_id", "width", "height", "n_channels", "data").mapInArrow(run, f"image_id {kind}, width int, height int, gray binary")


def gray_pixels(images: DataFrame) -> DataFrame:
    """``image_id, y, x, gray`` of decoded images: for small pictures; pages are cropped as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (width, height, gray) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("width", "height", "gray")), strict=True)):
                y, x = np.divmod(np.arange(width * height, dtype=np.int32), np.int32(width))
                ids = batch.column("image_id").take(pa.array(np.full(len(y), k)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(y), pa.array(x), pa.array(np.frombuffer(gray, np.uint8).astype(np.int32))], names=["image_id", "y", "x", "gray"])

    kind = images.schema["image_id"].dataType.simpleString()
    return gray_images(images).mapInArrow(run, f"image_id {kind}, y int, x int, gray int")


def collect_images(spark: SparkSession, *, paths: Sequence[str] = (), folder: str = "", metadata: DataFrame | None = None, ids: DataFrame | None = None, limit: int = 0) -> DataFrame:
    """``image_id, path`` of a run's inputs: explicit paths before a folder's images before the sheets of the
    metadata that are ok and, given ids, among them; the first ``limit`` in that order if it is not 0."""
    if paths:
        rows = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "place long, path string")
        rows, order = rows.withColumn("image_id", base_id(F.col("path"))), "place"
    elif folder:
        rows, order = read_images(spark, folder, recursive=True).select("image_id", "path"), "path"
    else:
        rows, order = ok_sheets(metadata, ids).select(F.col("image_id").cast("string").alias("image_id"), F.col("relative_path").alias("path")), "path"
    rows = rows.orderBy(order, "image_id").select("image_id", "path")
    return rows.limit(limit) if limit else rows


def labelled_folder(spark: SparkSession, folder: str, labels: Sequence[str] = ("blank", "filled"), *, validation: float = 0.10, test: float = 0.10) -> DataFrame:
    """A manifest of crops whose label is their folder's name; a label without a folder fails."""
    rows = None
    for label in labels:
        if not exists(spark, f"{folder}/{label}"):
            raise FileNotFoundError(f"{folder}/{label}")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/{label}").select(F.regexp_replace("path", "^file:/+", "/").alias("crop_path"))
        root = f"{folder}/{label}".removeprefix("file://")
        part = files.select("crop_path", F.lit(label).alias("gt_label"), *[c.alias(n) for n, c in crop_name(F.col("crop_path"), root).items()])
        rows = part if rows is None else rows.union(part)
    return rows.withColumn("split", hash_split(F.col("image_id"), validation, test)).orderBy("split", "image_id", "gt_label", "crop_path")


def with_image_ids(rows: DataFrame, root: str, path: str = "path") -> DataFrame:
    return rows.withColumn("image_id", image_id(F.col(path), root))
