"""Queries that write files and read them back, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import compare as C
from ..operators import training as L
from ..sources import readers as I
from ..sources import sinks as O
from ..sources.scratch import scratch
from . import bindings as B
from . import sheet_queries as Q
from .vision_queries import PIXELS_SQL, SPLIT_SQL


def jsonl_file(spark, sf):
    """Records as JSON lines and back; nulls and numbers keep."""
    rows = B.table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("value") > 50, F.col("value")).alias("value"))
    path = scratch(spark, "jsonl") + "/events"
    O.write_jsonl(rows, path)
    return I.read_jsonl(spark, path, rows.schema)


def jsonl_if_exists(spark, sf):
    """A file that is there and one that is not, under one schema."""
    folder = scratch(spark, "jsonl")
    rows = B.table(spark, sf, "customer").select("c_custkey", "c_name")
    O.write_jsonl(rows, f"{folder}/there")
    return I.read_jsonl_if_exists(spark, f"{folder}/there", rows.schema).union(I.read_jsonl_if_exists(spark, f"{folder}/missing", rows.schema))


def variant_lines_file(spark, sf):
    """Records without a common schema: events' own properties, read as variants."""
    path = scratch(spark, "variants") + "/props"
    B.table(spark, sf, "events").select("props").write.text(path)
    return I.read_variant_lines(spark, path).select(F.try_variant_get("record", "$.k", "long").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def layout_manifest_file(spark, sf):
    """A manifest of samples with nested paths, as JSON lines and back."""
    docs = B.table(spark, sf, "documents")
    name = F.concat(F.lit("sheet_"), F.col("doc_id").cast("string"), F.lit("_clean"))
    masks = F.create_map(*[x for c in ("page_mask", "red_grid_mask") for x in (F.lit(c), F.concat(F.lit(f"masks/{c}/"), name, F.lit(".png")))])
    rows = docs.select(name.alias("sample_id"), F.col("doc_id").alias("base_image_id"), S.hash_split(F.col("doc_id")).alias("split"), masks.alias("mask_paths"), (F.col("lang") == "en").alias("clean"))
    path = scratch(spark, "manifest") + "/rows"
    O.write_jsonl(rows, path)
    back = I.read_jsonl(spark, path, "sample_id string, base_image_id long, split string, mask_paths map<string,string>, clean boolean")
    return back.select("sample_id", "base_image_id", "split", F.col("mask_paths.page_mask").alias("page_mask"), "clean")


def json_document_file(spark, sf):
    """A run's summary as one document; a value that is not known is written, too."""
    orders = B.table(spark, sf, "orders")
    row = orders.agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("ok"), F.max("o_orderkey").alias("last_id"), F.lit(None).cast("string").alias("note")
    )
    path = scratch(spark, "document") + "/summary"
    O.write_document(row, path, sort_keys=True)
    return I.read_document(spark, path, row.schema)


def markdown_file(spark, sf):
    """A report's lines in order."""
    rows = B.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    lines = rows.select("o_orderpriority", F.format_string("- %s: %d", "o_orderpriority", "n").alias("line"))
    path = scratch(spark, "report") + "/lines"
    O.write_lines(lines, path, ["o_orderpriority"])
    return spark.read.text(path).select((F.monotonically_increasing_id() + 1).alias("place"), F.col("value").alias("line"))  # one file, one task


def id_list_file(spark, sf):
    """A list of chosen sheets with a comment, blank lines and further fields, and the sheets that it names."""
    folder = scratch(spark, "ids")
    chosen = B.table(spark, sf, "labels").where("quality = 1").select(F.explode(F.array(F.format_string("%d\tpath/%d.png\t10", "doc_id", "doc_id"), F.lit(""), F.lit("# image_id\tpath"))).alias("value"))
    chosen.write.text(f"{folder}/ids")
    docs = B.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("image_id"), F.when(F.col("lang") != "fr", "ok").otherwise("error").alias("status"), "source")
    missing = I.read_ids(spark, f"{folder}/none")
    return I.ok_sheets(docs, I.read_ids(spark, f"{folder}/ids"), order="source").select("image_id", "source", F.lit(missing is None).alias("no_list_no_filter"))


def _read_csv(spark, path: str, columns) -> DataFrame:
    return I.read_manifest(spark, path).select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def csv_differences_file(spark, sf):
    found = C.differences(Q._method_a(spark, sf), Q._method_b(spark, sf), Q._truth(spark, sf), tasks=Q._tasks(spark, sf))
    path = scratch(spark, "csv") + "/differences"
    O.write_csv(found, path, O.DIFFERENCE_COLUMNS)
    return _read_csv(spark, path, O.DIFFERENCE_COLUMNS)


def csv_errors_file(spark, sf):
    path = scratch(spark, "csv") + "/errors"
    O.write_csv(C.errors(Q._method_a(spark, sf), Q._truth(spark, sf)), path, O.ERROR_COLUMNS)
    return _read_csv(spark, path, O.ERROR_COLUMNS)


def csv_manifest_file(spark, sf):
    """A classifier's manifest: twelve columns, those not known empty."""
    path = scratch(spark, "csv") + "/manifest"
    rows = B.manifest(spark, sf).withColumn("split", S.hash_split(F.col("image_id"))).withColumnRenamed("pred", "prelabel")
    O.write_csv(rows, path, O.MANIFEST_COLUMNS)
    return _read_csv(spark, path, O.MANIFEST_COLUMNS)


def csv_union_file(spark, sf):
    """Rows of two kinds under the union of their columns."""
    nations = B.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    regions = B.table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key"))
    rows = O.union_columns([nations, regions])
    path = scratch(spark, "csv") + "/both"
    O.write_csv(rows, path, rows.columns)
    return _read_csv(spark, path, ["name", "region", "key"])


def metric_log(spark, sf):
    """A run's history, appended epoch by epoch in two goes; its best epoch read from the log."""
    rows = B.history(spark, sf).select("epoch", "mean_dice")
    path = scratch(spark, "log") + "/history"
    middle = rows.agg(F.avg("epoch")).first()[0]
    O.append_jsonl(rows.where(F.col("epoch") <= middle), path)
    O.append_jsonl(rows.where(F.col("epoch") > middle), path)
    back = I.read_jsonl(spark, path, "epoch int, mean_dice double")
    return back.crossJoin(F.broadcast(L.best_epoch(back).select(F.col("epoch").alias("best_epoch"))))  # one row


def split_files(spark, sf):
    """One folder of ids for each split."""
    path = scratch(spark, "splits") + "/ids"
    O.write_splits(B.manifest(spark, sf).withColumn("split", S.hash_split(F.col("image_id"))), path)
    return spark.read.text(path).select("split", F.col("value").cast("long").alias("image_id"))


def output_guard(spark, sf):
    """What the guard of an output folder does with a new, an empty and a filled one."""
    folder, rows = scratch(spark, "guard"), []

    def tried(case: str, overwrite: bool) -> None:
        try:
            O.prepare_folder(spark, f"{folder}/out", overwrite)
            rows.append((case, "ready"))
        except FileExistsError:
            rows.append((case, "exists"))

    tried("new", False)
    tried("empty", False)
    B.table(spark, sf, "region").write.parquet(f"{folder}/out/rows")
    tried("filled", False)
    tried("filled, overwrite", True)
    rows.append(("after", "exists" if I.exists(spark, f"{folder}/out/rows") else "gone"))
    return spark.createDataFrame(rows, "case string, outcome string")


def _pictures(spark, sf, name) -> DataFrame:
    """Pictures of 8 x 8 pixels as bytes by rows."""
    gray = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.lit(128.0) + 400.0 * v.cast("double") + 0.5).cast("int"))))
    bytes_ = F.unhex(F.array_join(F.transform(gray, lambda g: F.lpad(F.hex(g), 2, "0")), ""))
    return B.table(spark, sf, "embeddings").select(name.alias("name"), F.lit(8).alias("width"), F.lit(8).alias("height"), bytes_.alias("gray"))


def image_files(spark, sf):
    """Pictures written as image files, found, decoded and measured."""
    folder = scratch(spark, "images")
    O.write_pictures(_pictures(spark, sf, F.concat(F.lit("picture_"), F.col("vec_id").cast("string"))), folder).write.format("noop").mode("overwrite").save()
    pixels = I.gray_pixels(I.decode_images(spark, folder))
    found = pixels.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("gray") * (8 * F.col("y") + F.col("x") + 1)).alias("checksum"))
    listed = I.read_images(spark, folder).select("image_id", F.length("content").alias("size"))
    return found.join(listed.where("size > 60").select("image_id"), "image_id")


def labelled_folder_manifest(spark, sf):
    """Crops in folders named by their label, as a manifest."""
    folder = scratch(spark, "crops")
    name = F.concat(F.when(F.col("label") % 2 == 0, "filled").otherwise("blank"), F.lit("/"), F.when(F.col("label") % 3 == 0, "identity").otherwise("part1"), F.lit("/sheet"), F.pmod("vec_id", F.lit(40)).cast("string"), F.lit("__q_"), F.col("vec_id").cast("string"), F.lit("_A"))
    O.write_pictures(_pictures(spark, sf, name), folder).write.format("noop").mode("overwrite").save()
    return I.labelled_folder(spark, folder).select(F.regexp_extract("crop_path", "([^/]*)$", 1).alias("file"), "gt_label", "section", "image_id", "group_id", "choice", "field", "split")


def image_inputs(spark, sf):
    """A run's inputs by the three ways to name them, cut at their first ones."""
    folder = scratch(spark, "images")
    O.write_pictures(_pictures(spark, sf, F.concat(F.lit("in/p_"), F.lpad(F.col("vec_id").cast("string"), 9, "0"))), folder).write.format("noop").mode("overwrite").save()
    docs = B.table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), F.when(F.col("lang") != "fr", "ok").otherwise("error").alias("status"), F.format_string("scans/%09d.png", "doc_id").alias("relative_path"))
    ids = B.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("image_id"))
    ways = {
        "paths": I.collect_images(spark, paths=["b/two.png", "a/one.tif"], folder=folder, limit=5),
        "folder": I.collect_images(spark, folder=folder, metadata=docs, limit=9),
        "metadata": I.collect_images(spark, metadata=docs, ids=ids),
    }
    rows = None
    for way, found in ways.items():
        part = found.select(F.lit(way).alias("way"), "image_id", F.regexp_extract("path", "([^/]*)$", 1).alias("file"))
        rows = part if rows is None else rows.union(part)
    return rows


def web_payload(spark, sf):
    """Sheets of a run for the web: names by precedence of sheet, metadata and path; the run's own entries win."""
    docs = B.table(spark, sf, "documents")
    sheets = docs.select(
        F.col("doc_id").alias("image_id"), F.when(F.col("lang") != "es", "ok").otherwise("need_review").alias("sheet_status"), F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("own_"), "source")).otherwise("").alias("file_name"), F.lit("auto").alias("mode")
    )
    meta = docs.where("n_chars % 3 > 0").select(F.col("doc_id").alias("image_id"), F.concat("source", F.lit(".png")).alias("file_name"), F.col("lang").alias("split"), F.concat(F.lit("scans/"), "source").alias("relative_path"))
    return O.web_payload(sheets, meta, {"mode": "checked"})


QUERIES = {
    f.__name__: f
    for f in (
        jsonl_file, jsonl_if_exists, variant_lines_file, layout_manifest_file, json_document_file, markdown_file, id_list_file, csv_differences_file, csv_errors_file, csv_manifest_file,
        csv_union_file, metric_log, split_files, output_guard, image_files, labelled_folder_manifest, image_inputs, web_payload,
    )
}

_DIFF = f"WITH {Q.BOTH}{Q.PAIRS} {Q.DIFF_SELECT}"
ORACLES = {
    "jsonl_file": "SELECT event_id, event_type, CASE WHEN value > 50 THEN value END AS value FROM events",
    "jsonl_if_exists": "SELECT c_custkey, c_name FROM customer",
    "variant_lines_file": "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
    "layout_manifest_file": f"WITH {SPLIT_SQL} SELECT 'sheet_' || doc_id || '_clean' AS sample_id, doc_id AS base_image_id, split, 'masks/page_mask/sheet_' || doc_id || '_clean.png' AS page_mask, lang = 'en' AS clean FROM documents JOIN mf ON mf.image_id = doc_id",
    "json_document_file": "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS ok, max(o_orderkey) AS last_id, CAST(NULL AS VARCHAR) AS note FROM orders",
    "markdown_file": "SELECT row_number() OVER (ORDER BY o_orderpriority) AS place, format('- {}: {}', o_orderpriority, count(*)) AS line FROM orders GROUP BY o_orderpriority",
    "id_list_file": "SELECT CAST(doc_id AS VARCHAR) AS image_id, source, true AS no_list_no_filter FROM documents WHERE lang <> 'fr' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "csv_differences_file": f"SELECT CAST(image_id AS VARCHAR) AS image_id, '' AS file_name, section, item_id, method_a_value, coalesce(method_a_status, '') AS method_a_status, method_b_value, coalesce(method_b_status, '') AS method_b_status, "
    f"coalesce(expected, '') AS expected, method_a_correct, method_b_correct FROM ({_DIFF})",
    "csv_errors_file": f"""SELECT CAST(image_id AS VARCHAR) AS image_id, '' AS file_name, section, item_id, expected, actual, coalesce(status, '') AS status, CAST(need_review AS VARCHAR) AS need_review FROM (
  WITH {Q.BOTH} SELECT gt.image_id, {Q.SECTION_OF} AS section, split_part(key, ':', 2) AS item_id, expected, coalesce(ma.value, '') AS actual, ma.status, coalesce(ma.need_review, false) AS need_review
  FROM gt JOIN (SELECT DISTINCT image_id FROM ma) USING (image_id) LEFT JOIN ma USING (image_id, key) WHERE expected <> coalesce(ma.value, ''))""",
    "csv_manifest_file": f"WITH {SPLIT_SQL} SELECT '' AS crop_path, coalesce(gt_label, '') AS gt_label, coalesce(pred, '') AS prelabel, '' AS darkness_score, split, CAST(image_id AS VARCHAR) AS image_id, '' AS file_name, coalesce(section, '') AS section, "
    "'' AS field, '' AS group_id, '' AS choice, '' AS group_status FROM mf",
    "csv_union_file": "SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, '' AS key FROM nation UNION ALL SELECT r_name, '', CAST(r_regionkey AS VARCHAR) FROM region",
    "metric_log": "WITH h AS (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch, round(avg(value), 6) AS mean_dice FROM events GROUP BY 1) "
    "SELECT *, (SELECT epoch FROM h ORDER BY mean_dice DESC, epoch LIMIT 1) AS best_epoch FROM h",
    "split_files": f"WITH {SPLIT_SQL} SELECT split, image_id FROM mf",
    "output_guard": "SELECT * FROM (VALUES ('new', 'ready'), ('empty', 'ready'), ('filled', 'exists'), ('filled, overwrite', 'ready'), ('after', 'gone')) v(\"case\", outcome)",
    "image_files": f"WITH {PIXELS_SQL} SELECT 'picture_' || image_id AS image_id, count(*) AS n, CAST(sum(gray * (8 * y + x + 1)) AS BIGINT) AS checksum FROM px GROUP BY image_id",
    "labelled_folder_manifest": """WITH c AS (SELECT vec_id, 'sheet' || vec_id % 40 AS image_id, CASE WHEN label % 2 = 0 THEN 'filled' ELSE 'blank' END AS gt_label, CASE WHEN label % 3 = 0 THEN 'identity' ELSE 'part1' END AS section FROM embeddings),
s AS (SELECT *, CAST(concat('0x', substr(sha1(image_id), 1, 8)) AS BIGINT) / 4294967295.0::DOUBLE AS share FROM c)
SELECT image_id || '__q_' || vec_id || '_A.png' AS file, gt_label, section, image_id, 'q_' || vec_id AS group_id, 'A' AS choice, CASE section WHEN 'identity' THEN 'q' ELSE 'answer' END AS field,
  CASE WHEN share < 0.1::DOUBLE THEN 'test' WHEN share < 0.2::DOUBLE THEN 'val' ELSE 'train' END AS split FROM s""",
    "image_inputs": """SELECT * FROM (VALUES ('paths', 'two', 'two.png'), ('paths', 'one', 'one.tif')) v(way, image_id, file)
UNION ALL (SELECT 'folder', 'p_' || lpad(CAST(vec_id AS VARCHAR), 9, '0'), 'p_' || lpad(CAST(vec_id AS VARCHAR), 9, '0') || '.png' FROM embeddings ORDER BY vec_id LIMIT 9)
UNION ALL SELECT 'metadata', CAST(doc_id AS VARCHAR), lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.png' FROM documents WHERE lang <> 'fr' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "web_payload": """SELECT d.doc_id AS image_id, coalesce(CASE WHEN n_chars % 2 = 0 THEN 'own_' || source END, CASE WHEN n_chars % 3 > 0 THEN source || '.png' END) AS file_name, CASE WHEN n_chars % 3 > 0 THEN lang END AS split,
  CASE WHEN n_chars % 3 > 0 THEN 'scans/' || source END AS relative_path, 'ok' AS sheet_status, 'checked' AS mode FROM documents d WHERE lang <> 'es'""",
}
