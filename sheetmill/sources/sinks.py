"""Sinks: JSON lines, single documents, reports and CSV with fixed columns."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIFFERENCE_COLUMNS = (
    "image_id file_name section item_id method_a_value method_a_status method_b_value method_b_status expected method_a_correct method_b_correct"
).split()
MANIFEST_COLUMNS = "crop_path gt_label prelabel darkness_score split image_id file_name section field group_id choice group_status".split()
ERROR_COLUMNS = "image_id file_name section item_id expected actual status need_review".split()


def json_lines(rows: DataFrame) -> DataFrame:
    """Rows as JSON text with sorted keys; nulls are written."""
    return rows.select(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    json_lines(rows).write.mode(mode).text(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    """A log that grows, such as one line an epoch."""
    write_jsonl(rows, path, "append")


def write_lines(lines: DataFrame, path: str, order: Sequence[str]) -> None:
    """A text report in order, as one part file (a report has few lines)."""
    lines.orderBy(*order).select("line").coalesce(1).write.mode("overwrite").text(path)


def csv_columns(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly these columns: others go, missing ones are empty."""
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns])


def write_csv(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    csv_columns(rows, columns).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def union_columns(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows with different columns under one header."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def write_splits(rows: DataFrame, path: str) -> None:
    """One folder of ids for each split."""
    rows.select("split", F.col("image_id").cast("string").alias("image_id")).write.mode("overwrite").partitionBy("split").text(path)


def guarded_mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def prepare_folder(spark: SparkSession, path: str, overwrite: bool) -> None:
    """An empty folder: a filled one is emptied if ``overwrite`` says so, else it is an error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(where):
        if overwrite:
            store.delete(where, True)
        elif len(store.listStatus(where)):
            raise FileExistsError(f"output directory is not empty: {path}")
    store.mkdirs(where)


def write_document(row: DataFrame, path: str, sort_keys: bool = False) -> None:
    """One row as a JSON document of its own, with indented lines and nulls (a summary or payload: small)."""
    columns = sorted(row.columns) if sort_keys else row.columns
    shown = F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "pretty": "true"}).alias("value")
    row.limit(1).select(shown).coalesce(1).write.mode("overwrite").text(path)


def png(gray: np.ndarray) -> bytes:
    """A grey picture (rows of uint8) as PNG."""
    height, width = gray.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = gray
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def write_pictures(pictures: DataFrame, folder: str) -> DataFrame:
    """``name, width, height, gray`` (bytes by rows) as PNG files below the folder, a URI that all executors
    reach; names may hold folders.  Returns ``name, uri``; each file is whole or not there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = base = None
        for batch in batches:
            names, uris = [], []
            for name, width, height, gray in zip(*(batch.column(c).to_pylist() for c in ("name", "width", "height", "gray")), strict=True):
                if store is None:
                    store, base = pafs.FileSystem.from_uri(folder)
                path = f"{base}/{name}.png"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                draft = f"{path}.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(png(np.frombuffer(gray, np.uint8).reshape(height, width)))
                store.move(draft, path)
                names.append(name)
                uris.append(f"{folder}/{name}.png")
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "uri": pa.array(uris, pa.string())})

    return pictures.select("name", "width", "height", "gray").mapInArrow(run, "name string, uri string")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """``name, content`` (bytes) as files below the folder, as ``write_pictures`` does.  Returns ``name, uri``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                path = f"{base}/{name}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                draft = f"{path}.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(content)
                store.move(draft, path)
            uris = pa.array([f"{folder}/{name}" for name in batch.column("name").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("name"), uris], names=["name", "uri"])

    return files.select("name", "content").mapInArrow(run, "name string, uri string")


def web_payload(sheets: DataFrame, metadata: DataFrame, summary: dict[str, str]) -> DataFrame:
    """Sheets that are ok with their metadata; entries of the run summary win over computed ones."""
    meta = metadata.select("image_id", *[F.col(c).alias(f"_m_{c}") for c in ("file_name", "split", "relative_path")])
    name = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")) if c in sheets.columns else F.lit(None).cast("string"), F.col(f"_m_{c}")).alias(c)
    rows = sheets.where("sheet_status = 'ok'").join(meta, "image_id", "left")
    others = [c for c in sheets.columns if c not in ("image_id", "file_name", "split", "relative_path")]
    shown = rows.select("image_id", name("file_name"), name("split"), name("relative_path"), *others)
    for key, value in summary.items():
        shown = shown.withColumn(key, F.lit(value))
    return shown
