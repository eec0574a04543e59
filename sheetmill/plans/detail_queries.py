"""Queries on templates' indexes, records' metadata, masks, samples and payloads, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import decode as D
from ..operators import geometry as G
from ..operators import matching as M
from ..operators import models as P
from ..operators import ranking as R
from ..operators import raster as X
from ..operators import sheets as H
from ..operators import specs as T
from ..operators import training as L
from . import bindings as B
from . import sheet_queries as Q
from . import vision_queries as V
from .template import template

# -- templates --------------------------------------------------------------------------------


def label_points(spark, sf):
    return T.label_points(template(spark))


def region_polygons(spark, sf):
    points = F.array_join(F.transform("points", lambda p: F.concat(p.x.cast("int").cast("string"), F.lit(","), p.y.cast("int").cast("string"))), " ")
    return T.region_polygons(template(spark)).select("name", points.alias("points"))


def grid_polylines(spark, sf):
    """The page's lines and their sampled points: of the border 96 an edge, of the others 32."""
    lines = T.grid_polylines(template(spark))
    sampled = F.when(F.col("place") == 0, T.polyline(F.col("points"), 96)).otherwise(T.polyline(F.col("points"), 32))
    points = lines.select("place", F.posexplode(sampled).alias("at", "p"))
    return points.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("p.x") * (F.col("at") + 1)), 3).alias("x"), F.round(F.sum(F.col("p.y") * (F.col("at") + 1)), 3).alias("y"))


def item_index(spark, sf):
    return T.item_index(T.all_specs(template(spark))).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("spec_ord").alias("first"), F.max("spec_ord").alias("last"))


def choice_index(spark, sf):
    return T.choice_index(T.all_specs(template(spark))).select("key", "spec_id", F.array_join(F.col("center").cast("array<string>"), ",").alias("center"))


def _values(spark, sf) -> DataFrame:
    """Values of all kinds at all keys of a sheet."""
    key = F.get(H.all_keys(), F.pmod("p_partkey", F.lit(80)))
    rows = B.table(spark, sf, "part").select("p_partkey", "p_size", key.alias("key")).withColumn("section", S.section_of(F.col("key")))
    number = F.concat(F.when(F.col("p_size") % 2 == 0, "-").otherwise(""), (F.col("p_size") % 10).cast("string"), F.when(F.col("p_size") % 3 == 0, ",").otherwise(""), (F.col("p_size") % 7).cast("string"))
    value = (
        F.when(F.col("section") == "part1", F.chr(65 + F.col("p_size") % 5)).when(F.col("section") == "part2", F.when(F.col("p_size") % 2 == 0, "T").otherwise("F")).when(F.col("section") == "part3", number).otherwise("12")
    )
    return rows.select("p_partkey", "section", S.item_of(F.col("key")).alias("item_id"), value.alias("value"))


def selected_specs(spark, sf):
    return T.selected_specs(_values(spark, sf), T.choice_index(T.all_specs(template(spark)))).select("p_partkey", "item_id", "value", "choice", "spec_id")


def field_regions(spark, sf):
    found = T.field_region(template(spark)).select("item_id", F.array_join(F.col("bbox").cast("array<string>"), ",").alias("bbox"))
    return _values(spark, sf).select("p_partkey", "item_id").join(F.broadcast(found), "item_id", "left")  # two rows


def refined_grid(spark, sf):
    """A template's bubbles on 25 pages, moved by their blocks' transforms."""
    specs = T.all_specs(template(spark)).select("spec_id", "grid_block", "center", "bbox")
    images = B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("image_id"))
    k, m = F.col("image_id"), F.pmod("image_id", F.lit(5))
    status = F.element_at(F.array(*[F.lit(s) for s in ("ok", "need_review", "fallback_translation", "skipped", "alignment_failed")]), (m + 1).cast("int"))
    matrix = F.array(F.lit(1.0), 0.01 * F.pmod(k, F.lit(3)), k - 12.0, -0.01 * F.pmod(k, F.lit(4)), F.lit(1.0), 0.5 * k, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    blocks = images.crossJoin(F.broadcast(specs.select("grid_block").distinct()))  # a template's blocks on each page
    fits = blocks.select("image_id", "grid_block", status.alias("status"), (k / 25.0).alias("confidence"), (m != 4).alias("decode_allowed"), matrix.alias("matrix"))
    found = G.refine_specs(images.crossJoin(F.broadcast(specs)), fits)  # a template's specs on each page
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.select("image_id", "spec_id", text("center"), text("bbox"), text("template_center"), "grid_refinement_status", F.round("grid_refinement_confidence", 6).alias("grid_refinement_confidence"), "grid_refinement_decode_allowed")


# -- records ----------------------------------------------------------------------------------


def block_metadata(spark, sf):
    """Bubbles with what is known of their alignment and grid blocks."""
    orders = B.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("image_id"))
    k = F.col("k")
    mod = lambda n: F.pmod(k, F.lit(n))
    last = lambda block: orders.groupBy("image_id", block.alias("block")).agg(F.max("o_orderkey").alias("k"))
    section = F.element_at(F.array(*[F.lit(s) for s in ("identity", "part1", "part2", "part3")]), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int"))
    status = F.when(mod(3) == 0, "ok").when(mod(3) == 1, "fallback_translation").otherwise("alignment_failed")
    method = F.when(mod(2) == 0, "affine").otherwise("homography")
    alignment = last(section).select("image_id", "block", status.alias("status"), (mod(1000) / 1000).alias("confidence"), method.alias("method"), mod(5).alias("marker_count"), (mod(100) / 10).alias("pre_rms"), (mod(70) / 10).alias("rms"), (mod(90) / 10).alias("largest"))
    grid = last(F.concat(F.lit("g"), F.pmod("o_orderkey", F.lit(6)).cast("string"))).select(
        "image_id", "block", status.alias("status"), (mod(100) / 100).alias("confidence"), method.alias("method"), mod(40).alias("n"), mod(30).alias("n_inliers"), (mod(70) / 10).alias("rms"), (mod(90) / 10).alias("largest"), (mod(3) != 2).alias("decode_allowed")
    )
    lines = B.table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    block = F.element_at(F.array(*[F.lit(s) for s in ("identity", "part1", "part2", "part3")]), (F.pmod("l_partkey", F.lit(4)) + 1).cast("int"))
    records = lines.select("image_id", "l_orderkey", "l_linenumber", block.alias("alignment_block"), F.concat(F.lit("g"), F.pmod("l_suppkey", F.lit(7)).cast("string")).alias("grid_block"))
    return D.with_block_metadata(records, alignment, grid)


def model_relabel(spark, sf):
    """Bubbles joined with a classifier's predictions, then ranked within their item."""
    bubbles = B.bubbles(spark, sf).withColumn("spec_id", F.concat_ws("_", F.col("item_id").cast("string"), F.col("spec_ord").cast("string")))
    p = 1 / (1 + F.exp(-(80.0 * F.col("fill_score") + 20.0 * F.col("darkness_score") - 5.0)))
    found = P.prediction(F.col("scores"), ["blank", "filled"], 0.9)
    predictions = bubbles.select("image_id", "spec_id", F.array(1 - p, p).alias("scores")).select("image_id", "spec_id", *[c.alias(n) for n, c in found.items()])
    labelled = D.with_predictions(bubbles.drop("prelabel"), predictions)
    ranked = R.relabel_by_rank(labelled, score="filled_probability", filled_threshold=0.9, margin_threshold=0.1)
    return ranked.select("image_id", "item_id", "spec_ord", "model_label", "filled_probability", "prelabel", "prelabel_source", "group_score_margin")


def predicted_manifest(spark, sf):
    """Rows of a manifest with predictions in place of the columns of the same name."""
    rows = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax", F.lit("old").alias("pred_label"))
    found = P.predict_rows(rows, ["l_discount", "l_tax"], lambda: P.linear_scorer([80.0, 20.0], -5.0))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "pred_label", "pred_confidence", "argmax_label", "argmax_confidence", "filled_probability", "blank_probability", "filled_threshold")


def item_states(spark, sf):
    states = D.item_states(B.bubbles(spark, sf))
    shown = F.array_join(F.transform(F.map_entries("states"), lambda e: F.concat(e.key, F.lit(":"), e.value.prelabel, F.lit(":"), F.rint(e.value.darkness_score * 100).cast("int").cast("string"))), ",")
    return states.select("image_id", "item_id", shown.alias("states"))


def compact_answers(spark, sf):
    named = lambda rows: rows.withColumn("item_id", F.concat(F.lit("I_"), F.col("item_id").cast("string")))
    bubbles = named(Q._relabelled(spark, sf))
    rows = D.compact_answers(D.decode_questions(bubbles), D.item_states(bubbles))
    return rows.select("image_id", "item_id", "question_number", "selected", "status", *[F.col(f"states.{x}.prelabel").alias(f"{x.lower()}_prelabel") for x in "ABCD"], *[F.col(f"states.{x}.darkness_score").alias(f"{x.lower()}_darkness") for x in "ABCD"])


def sectioned_decode(spark, sf):
    """Identity, true/false and short answers of all sheets, each section by its rules."""
    items = Q._slots(Q._items(spark, sf)).join(B.bubbles(spark, sf).select("image_id", "section").distinct(), "image_id")
    slot, part = F.col("slot"), F.pmod(F.col("slot") - 1, F.lit(6))
    field = F.when(slot <= 8, F.format_string("sbd_%02d", slot)).when(slot <= 12, F.format_string("exam_code_%02d", slot - 8))
    statement = F.format_string("II_%03d_%s", (F.floor((slot - 1) / 4) + 1).cast("int"), F.chr(F.lit(97) + F.pmod(slot - 1, F.lit(4))))
    suffix = F.when(part == 0, "sign").when(part == 1, "comma").otherwise(F.concat(F.lit("digit_"), (part - 1).cast("string")))
    short = F.concat(F.format_string("III_%03d_", (F.floor((slot - 1) / 6) + 1).cast("int")), suffix)
    place = F.ascii("selected") - 65
    mark = F.when(part == 0, "-").when(part == 1, F.concat(F.lit("after_"), (F.pmod(place, F.lit(5)) + 1).cast("string"))).otherwise(F.pmod(place, F.lit(10)).cast("string"))
    items = items.withColumn("item_id", F.when(F.col("section") == "identity", field).when(F.col("section") == "part2", statement).when(F.col("section") == "part3", short)).withColumn(
        "selected", F.when((F.col("section") == "part3") & F.col("selected").isNotNull(), mark).otherwise(F.col("selected"))
    )
    return H.decode_sections(items, Q._images(spark, sf))


def review_counts(spark, sf):
    """Items to be reviewed, strictly and as reports count them."""
    n = F.pmod("p_size", F.lit(5))
    status = F.when(n == 0, "accepted").when(n == 1, "need_review").when(n == 2, "multi_mark").when(n == 3, "blank")
    rows = B.table(spark, sf, "part").select("p_brand", status.alias("status"), F.when(F.col("p_partkey") % 2 == 0, "identity").otherwise("part2").alias("section"))
    glyph = S.mark_glyph(F.when(F.col("status") == "accepted", "True").when(F.col("status") == "blank", "False"))
    return rows.groupBy("p_brand").agg(
        H.review_count(F.col("status"), F.col("section")).alias("strict"), H.review_count(F.col("status"), F.col("section"), strict=False).alias("reported"), F.count(F.when(glyph == "✓", 1)).alias("right"), F.count(F.when(glyph == "✗", 1)).alias("wrong")
    )


def option_values(spark, sf):
    """Paths and numbers as options and CSV cells give them."""
    low, high = S.float_list("0.5, ,2,", 2)
    rows = B.table(spark, sf, "part").select("p_partkey", "p_size", F.concat(F.when(F.col("p_size") % 2 == 0, "/data\\").otherwise("scans\\"), "p_brand").alias("path"))
    number = F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_size") % 3 == 1, "n/a")
    shown = S.forward_slashes(F.col("path"))
    return rows.select("p_partkey", S.resolved_path(shown, "/project/").alias("path"), S.safe_double(number, low).alias("number"), (F.col("p_size") * high).alias("scaled"))


# -- pictures ---------------------------------------------------------------------------------


def layout_masks(spark, sf):
    """Images are dealt by what their masks take, 64 pixels each, and not by their ids' few bytes."""
    tasks = B.tasks(B.table(spark, sf, "embeddings"), 64)
    images = B.pixels(spark, sf).select("image_id", "label").distinct().repartition(tasks, "image_id")
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    label = F.col("label")
    quad = F.array(at(F.lit(0), F.lit(0)), at(7 - label % 3, F.lit(0)), at(F.lit(7), F.lit(7)), at(label % 2, F.lit(6)))
    polygons = images.select("image_id", quad.alias("points"))
    points = B.lattice(images).select("image_id", F.when(F.col("id") % 4 == 0, "marker").otherwise("bubble").alias("kind"), "x", "y", (F.col("id") % 3 > 0).alias("visible"))
    found = X.layout_masks(points, polygons, 8, 8, {"marker": 1.0, "bubble": 0.5})
    return found.groupBy("image_id", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("gray").alias("total"), F.sum(8 * F.col("y") + F.col("x")).alias("where"))


def displaced_points(spark, sf):
    maps = B.pixels(spark, sf).select("image_id", "y", "x", (F.col("p") * 10).alias("dx"), (F.col("p") * -5).alias("dy"))
    points = V._peaks(spark, sf).select("image_id", "id", (F.col("x") * 1.1 - 0.3).alias("x"), (F.col("y") + 0.25).alias("y"))
    moved = X.moved_points(points, maps, 8, 8)
    return moved.select("image_id", "id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), X.in_frame(F.col("x"), F.col("y"), 8, 8).alias("in_frame"))


def visible_points(spark, sf):
    point = lambda v, i: F.struct((i * 2.5).alias("x"), (i + 1.0).alias("y"), F.when(i != 3, v > 0).alias("visible"))
    labels = B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), (100 + F.pmod("vec_id", F.lit(50))).alias("width"), F.lit(80).alias("height"), F.transform(F.slice("embedding", 1, 8), point).alias("markers"))
    return M.visible_points(labels, "markers", 832.0, 1192.0).select("image_id", "place", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def scaled_peaks(spark, sf):
    peaks = V._peaks(spark, sf).withColumnRenamed("p", "score")
    return M.scaled_peaks(peaks, F.lit(1650 / 8), F.lit(2363 / 8)).select("image_id", "id", "x", "y", "model_x", "model_y", "score")


def mean_peak_counts(spark, sf):
    peaks = V._peaks(spark, sf)
    lists = peaks.groupBy("image_id").agg(F.collect_list(F.when(F.col("p") >= 0.2, F.col("id"))).alias("markers"), F.collect_list("id").alias("bubbles"))
    return L.mean_counts(lists)


def mean_channel_dice(spark, sf):
    return L.mean_channels(L.pixel_metrics(V._logits(spark, sf)), ["batch_id"], "dice").select("batch_id", F.round("dice", 4).alias("dice"))


def training_samples(spark, sf):
    """The first fifty pictures of a split, shrunk, as a network's input, with their mask and the way back."""
    chosen = B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id")).where(S.hash_split(F.col("image_id")) == "train").orderBy("image_id").limit(50)
    pixels = B.pixels(spark, sf).join(F.broadcast(chosen), "image_id")  # fifty rows
    image = X.area_resized(pixels, 2)
    mask = X.area_resized(pixels.withColumn("mask", F.when(F.col("p") > 0.1, 255).otherwise(0)), 2, value="mask")
    value = X.normalised(F.col("gray"))
    return image.join(mask, ["image_id", "y", "x"]).select("image_id", "y", "x", F.round(value, 6).alias("value"), F.round(F.col("mask") / 255, 6).alias("mask"), F.round(X.denormalised(value), 3).alias("gray"))


def marker_payload(spark, sf):
    marks = V._peaks(spark, sf).select("image_id", F.concat(F.lit("mark_"), F.col("id").cast("string")).alias("name"), (F.col("x") * 1.237).alias("x"), F.col("y"))
    shown = F.array_join(F.transform(F.map_entries("markers"), lambda e: F.concat(e.key, F.lit("="), F.rint(e.value[0] * 100).cast("int").cast("string"), F.lit("/"), F.rint(e.value[1] * 100).cast("int").cast("string"))), " ")
    return M.marker_payload(marks).select("image_id", F.array_join("markers_found", ",").alias("markers_found"), shown.alias("markers"))


QUERIES = {
    f.__name__: f
    for f in (
        label_points, region_polygons, grid_polylines, item_index, choice_index, selected_specs, field_regions, refined_grid, block_metadata, model_relabel, predicted_manifest, item_states, compact_answers,
        sectioned_decode, review_counts, option_values, layout_masks, displaced_points, visible_points, scaled_peaks, mean_peak_counts, mean_channel_dice, training_samples, marker_payload,
    )
}

_ORDER = "row_number() OVER (ORDER BY branch, o)"
_KEYED = """
ix AS (SELECT section || ':' || item_id AS key, * FROM ao UNION ALL SELECT section || ':' || question_id, * FROM ao WHERE section = 'part3'),
ch AS (SELECT section || ':' || item_id || ':' || choice AS key, * FROM ao UNION ALL SELECT section || ':' || question_id || ':' || choice, * FROM ao WHERE section = 'part3'),
ci AS (SELECT key, spec_id, cx, cy FROM ch QUALIFY row_number() OVER (PARTITION BY key ORDER BY spec_ord DESC) = 1)"""
# The other query's spec_id ends as the engine's does.
SPECS = V.SPECS_SQL + ", ao AS (SELECT *, CAST(row_number() OVER (ORDER BY branch, o) AS INTEGER) AS spec_ord FROM al)"
_BOX = "CAST(b->>0 AS DOUBLE) AS x1, CAST(b->>1 AS DOUBLE) AS y1, CAST(b->>2 AS DOUBLE) AS x2, CAST(b->>3 AS DOUBLE) AS y2"
LINES_SQL = f"""
bx AS (
  SELECT 0 AS g, CAST(i AS INTEGER) AS i, j->'regions'->CAST(i AS INTEGER)->'bbox' AS b FROM t, range(0, 6) a(i) UNION ALL
  SELECT 1, CAST(i AS INTEGER), j->'part1'->'columns'->CAST(i AS INTEGER)->'bbox' FROM t, range(0, 4) a(i) UNION ALL
  SELECT 2, 0, j->'sbd'->'bbox' FROM t UNION ALL SELECT 2, 1, j->'exam_code'->'bbox' FROM t UNION ALL
  SELECT 3, CAST(i AS INTEGER), j->'part2'->'questions'->CAST(i AS INTEGER)->'bbox' FROM t, range(0, 8) a(i) UNION ALL
  SELECT 4, CAST(i AS INTEGER), j->'part3'->'questions'->CAST(i AS INTEGER)->'bbox' FROM t, range(0, 6) a(i)),
li AS (SELECT 0 AS place, 96 AS per, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS y1, 1649.0::DOUBLE AS x2, 2362.0::DOUBLE AS y2
  UNION ALL SELECT CAST(row_number() OVER (ORDER BY g, i) AS INTEGER), 32, {_BOX} FROM bx)"""
_STATUS = "CASE WHEN k % 3 = 0 THEN 'ok' WHEN k % 3 = 1 THEN 'fallback_translation' ELSE 'alignment_failed' END"
_METHOD = "CASE WHEN k % 2 = 0 THEN 'affine' ELSE 'homography' END"
_SECTION4 = "['identity', 'part1', 'part2', 'part3'][{} % 4 + 1]"
_PROB = "round(1 / (1 + exp(-(80.0::DOUBLE * fill_score + 20.0::DOUBLE * darkness_score - 5.0::DOUBLE))), 6)"
_SHORT = Q.ORACLES["short_answer_compact"]


def _of(sql: str, section: str) -> str:
    return sql.replace("LEFT JOIN sl ON", f"LEFT JOIN (SELECT * FROM sl WHERE section = '{section}') sl ON")


ORACLES = {
    "label_points": f"""WITH {SPECS} SELECT CAST(row_number() OVER (ORDER BY CASE branch WHEN 0 THEN 2.5 ELSE branch END, o) AS INTEGER) AS place,
  CASE section WHEN 'part1' THEN format('part1_q{{:03d}}_{{}}', question_number, choice) WHEN 'identity' THEN format('{{}}_c{{:02d}}_d{{}}', field, slot, choice)
    WHEN 'part2' THEN format('part2_q{{:02d}}_{{}}_{{}}', question_number, statement, choice)
    ELSE format('part3_q{{:02d}}_', question_number) || CASE role WHEN 'sign' THEN 'minus' WHEN 'comma' THEN 'comma' || slot ELSE 's' || slot || '_d' || choice END END AS id,
  coalesce(field, section) AS "group", x, y FROM ao""",
    "region_polygons": f"""WITH {SPECS}, r AS (SELECT j->'regions'->CAST(i AS INTEGER)->>'name' AS name, j->'regions'->CAST(i AS INTEGER)->'bbox' AS b FROM t, range(0, 6) a(i)), q AS (SELECT name, {_BOX} FROM r)
SELECT name, format('{{}},{{}} {{}},{{}} {{}},{{}} {{}},{{}}', CAST(x1 AS INTEGER), CAST(y1 AS INTEGER), CAST(x2 AS INTEGER), CAST(y1 AS INTEGER), CAST(x2 AS INTEGER), CAST(y2 AS INTEGER), CAST(x1 AS INTEGER), CAST(y2 AS INTEGER)) AS points FROM q""",
    "grid_polylines": f"""WITH {SPECS}, {LINES_SQL}, ed AS (SELECT place, per, 0 AS e, x1 AS ax, y1 AS ay, x2 AS qx, y1 AS qy FROM li UNION ALL SELECT place, per, 1, x2, y1, x2, y2 FROM li
  UNION ALL SELECT place, per, 2, x2, y2, x1, y2 FROM li UNION ALL SELECT place, per, 3, x1, y2, x1, y1 FROM li),
pt AS (SELECT place, e * per + k + 1 AS n, ax + (qx - ax) * k / CAST(per AS DOUBLE) AS x, ay + (qy - ay) * k / CAST(per AS DOUBLE) AS y FROM ed, range(0, 96) a(k) WHERE k < per)
SELECT place, count(*) AS n, round(sum(x * n), 3) AS x, round(sum(y * n), 3) AS y FROM pt GROUP BY place""",
    "item_index": f"WITH {SPECS}, {_KEYED} SELECT key, count(*) AS n, min(spec_ord) AS first, max(spec_ord) AS last FROM ix GROUP BY key",
    "choice_index": f"WITH {SPECS}, {_KEYED} SELECT key, spec_id, cx || ',' || cy AS center FROM ci",
    "selected_specs": f"""WITH {SPECS}, {_KEYED}, {Q.KEYS_SQL}, v AS (SELECT p_partkey, split_part(k, ':', 1) AS section, split_part(k, ':', 2) AS item_id, p_size FROM part JOIN ks ON p_partkey % 80 = i),
w AS (SELECT *, CASE section WHEN 'part1' THEN chr(CAST(65 + p_size % 5 AS INTEGER)) WHEN 'part2' THEN CASE WHEN p_size % 2 = 0 THEN 'T' ELSE 'F' END
  WHEN 'part3' THEN CASE WHEN p_size % 2 = 0 THEN '-' ELSE '' END || p_size % 10 || CASE WHEN p_size % 3 = 0 THEN ',' ELSE '' END || p_size % 7 ELSE '12' END AS value FROM v),
c AS (SELECT p_partkey, section, item_id, value, unnest(CASE WHEN section IN ('part1', 'part2') THEN [value] WHEN section = 'part3'
  THEN list_transform(range(1, len(value) + 1), lambda n: CASE WHEN value[n] = ',' THEN 'after_' || greatest(1, n - 1) ELSE value[n] END) ELSE [] END) AS choice FROM w)
SELECT p_partkey, item_id, value, choice, ci.spec_id FROM c JOIN ci ON ci.key = section || ':' || item_id || ':' || choice""",
    "field_regions": f"""WITH {SPECS}, {Q.KEYS_SQL}, v AS (SELECT p_partkey, split_part(k, ':', 2) AS item_id FROM part JOIN ks ON p_partkey % 80 = i)
SELECT p_partkey, item_id, CASE WHEN item_id IN ('sbd', 'exam_code') THEN (SELECT format('{{}},{{}},{{}},{{}}', j->item_id->'bbox'->>0, j->item_id->'bbox'->>1, j->item_id->'bbox'->>2, j->item_id->'bbox'->>3) FROM t) END AS bbox FROM v""",
    "refined_grid": f"""WITH {SPECS}, p AS (SELECT n_nationkey AS k, spec_id, cx, cy, n_nationkey % 5 AS m FROM nation, ao),
q AS (SELECT *, ['ok', 'need_review', 'fallback_translation', 'skipped', 'alignment_failed'][m + 1] AS st, CAST(round_even(1.0::DOUBLE * cx + 0.01::DOUBLE * (k % 3) * cy + (k - 12.0::DOUBLE), 0) AS INTEGER) AS mx,
  CAST(round_even(-0.01::DOUBLE * (k % 4) * cx + 1.0::DOUBLE * cy + 0.5::DOUBLE * k, 0) AS INTEGER) AS my FROM p),
r AS (SELECT *, CASE WHEN m < 3 THEN mx ELSE cx END AS nx, CASE WHEN m < 3 THEN my ELSE cy END AS ny FROM q)
SELECT k AS image_id, spec_id, nx || ',' || ny AS center, (nx - 18) || ',' || (ny - 18) || ',' || (nx + 18) || ',' || (ny + 18) AS bbox, cx || ',' || cy AS template_center, st AS grid_refinement_status,
  round(k / 25.0::DOUBLE, 6) AS grid_refinement_confidence, m <> 4 AS grid_refinement_decode_allowed FROM r""",
    "block_metadata": f"""WITH a AS (SELECT o_custkey AS image_id, {_SECTION4.format("o_orderkey")} AS block, max(o_orderkey) AS k FROM orders GROUP BY 1, 2),
g AS (SELECT o_custkey AS image_id, 'g' || o_orderkey % 6 AS block, max(o_orderkey) AS k FROM orders GROUP BY 1, 2),
aa AS (SELECT image_id, block, {_STATUS} AS alignment_status, k % 1000 / 1000 AS alignment_confidence, {_METHOD} AS alignment_method, k % 5 AS alignment_marker_count, k % 100 / 10 AS marker_pre_residual_px, k % 70 / 10 AS marker_residual_px, k % 90 / 10 AS marker_max_residual_px FROM a),
gg AS (SELECT image_id, block, {_STATUS} AS grid_refinement_status, k % 100 / 100 AS grid_refinement_confidence, {_METHOD} AS grid_refinement_method, k % 40 AS grid_refinement_matched_count, k % 30 AS grid_refinement_inlier_count, k % 70 / 10 AS grid_residual_px, k % 90 / 10 AS grid_max_residual_px, k % 3 <> 2 AS grid_refinement_decode_allowed FROM g),
r AS (SELECT o_custkey AS image_id, l_orderkey, l_linenumber, {_SECTION4.format("l_partkey")} AS alignment_block, 'g' || l_suppkey % 7 AS grid_refinement_block FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT r.*, aa.* EXCLUDE (image_id, block), gg.* EXCLUDE (image_id, block) FROM r LEFT JOIN aa ON aa.image_id = r.image_id AND aa.block = alignment_block LEFT JOIN gg ON gg.image_id = r.image_id AND gg.block = grid_refinement_block""",
    "model_relabel": f"WITH {Q.BUBBLES}, fp AS (SELECT *, {_PROB} AS filled_probability FROM b), {Q.relabel_sql('filled_probability', 0.9, 0.1, src='fp')} SELECT image_id, item_id, spec_ord, "
    "CASE WHEN 1 / (1 + exp(-(80.0::DOUBLE * fill_score + 20.0::DOUBLE * darkness_score - 5.0::DOUBLE))) >= 0.9::DOUBLE THEN 'filled' ELSE 'blank' END AS model_label, filled_probability, prelabel, 'bubble_classifier_group' AS prelabel_source, round(gtop - gsecond, 6) AS group_score_margin FROM r",
    "predicted_manifest": """WITH p AS (SELECT *, 1 / (1 + exp(-(80.0::DOUBLE * l_discount + 20.0::DOUBLE * l_tax - 5))) AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN p >= 0.5::DOUBLE THEN 'filled' ELSE 'blank' END AS pred_label, round(CASE WHEN p >= 0.5::DOUBLE THEN p ELSE 1 - p END, 6) AS pred_confidence,
  CASE WHEN p > 1 - p THEN 'filled' ELSE 'blank' END AS argmax_label, round(greatest(p, 1 - p), 6) AS argmax_confidence, round(p, 6) AS filled_probability, round(1 - p, 6) AS blank_probability, 0.5::DOUBLE AS filled_threshold FROM p""",
    "item_states": f"WITH {Q.BUBBLES} SELECT image_id, item_id, string_agg(choice || ':' || prelabel || ':' || CAST(round_even(darkness_score * 100, 0) AS INTEGER), ',' ORDER BY choice) AS states FROM b GROUP BY image_id, item_id",
    "compact_answers": f"""WITH {Q.BUBBLES},{Q.relabel_sql('fill_score', 0.08, 0.025)},{Q.decode_sql(True, 0.08, 0.025)},
s AS (SELECT image_id, item_id, {", ".join(f"max(prelabel) FILTER (choice = '{x}') AS {x.lower()}_prelabel, max(darkness_score) FILTER (choice = '{x}') AS {x.lower()}_darkness" for x in "ABCD")} FROM r GROUP BY image_id, item_id)
SELECT image_id, 'I_' || item_id AS item_id, CAST(item_id AS INTEGER) AS question_number, selected, status, s.* EXCLUDE (image_id, item_id) FROM f JOIN s USING (image_id, item_id)""",
    "sectioned_decode": f"""SELECT image_id, 'identity' AS section, field AS item_id, value, status, confidence FROM ({_of(Q.ORACLES["identity_value_string"], "identity")})
UNION ALL SELECT image_id, 'identity', 'exam_code', value, status, confidence FROM ({_of(Q.ORACLES["identity_value_string"], "identity").replace("range(1, 9)", "range(1, 5)").replace("sl.slot = n", "sl.slot = n + 8")})
UNION ALL SELECT image_id, 'part2', item_id, selected, status, confidence FROM ({_of(Q.ORACLES["true_false_dense"], "part2")})
UNION ALL SELECT image_id, 'part3', question_id, value, status, confidence FROM ({_of(_SHORT, "part3")})""",
    "review_counts": """WITH r AS (SELECT p_brand, CASE p_size % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'need_review' WHEN 2 THEN 'multi_mark' WHEN 3 THEN 'blank' END AS status, p_partkey % 2 = 0 AS own FROM part)
SELECT p_brand, count(*) FILTER (CASE WHEN own THEN coalesce(status <> 'accepted', true) ELSE status IN ('need_review', 'multi_mark') END) AS strict,
  count(*) FILTER (CASE WHEN own THEN coalesce(status <> 'accepted', false) ELSE status IN ('need_review', 'multi_mark') END) AS reported, count(*) FILTER (status = 'accepted') AS "right", count(*) FILTER (status = 'blank') AS wrong FROM r GROUP BY p_brand""",
    "option_values": """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '/data/' ELSE '/project/scans/' END || p_brand AS path, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) ELSE 0.5::DOUBLE END AS number, p_size * 2.0::DOUBLE AS scaled FROM part""",
    "layout_masks": f"""WITH {V.PIXELS_SQL},{V.LATTICE_SQL}, lb AS (SELECT DISTINCT image_id, label FROM px),
pt AS (SELECT image_id, i, CASE i WHEN 0 THEN 0 WHEN 1 THEN 7 - label % 3 WHEN 2 THEN 7 ELSE label % 2 END AS x, CASE i WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 7 ELSE 6 END AS y FROM lb, range(0, 4) a(i)),
eg AS (SELECT p.image_id, CAST(p.x AS DOUBLE) AS ax, CAST(p.y AS DOUBLE) AS ay, CAST(q.x AS DOUBLE) AS qx, CAST(q.y AS DOUBLE) AS qy FROM pt p JOIN pt q ON q.image_id = p.image_id AND q.i = (p.i + 1) % 4),
gr AS (SELECT eg.image_id, y, x, count(*) FILTER ((ay > y) <> (qy > y) AND x < (qx - ax) * (y - ay) / (qy - ay) + ax) AS n,
  bool_or((qx - ax) * (y - ay) = (qy - ay) * (x - ax) AND x BETWEEN least(ax, qx) AND greatest(ax, qx) AND y BETWEEN least(ay, qy) AND greatest(ay, qy)) AS edge
  FROM eg, range(0, 8) a(y), range(0, 8) b(x) GROUP BY eg.image_id, y, x),
sp AS (SELECT image_id, CASE WHEN id % 4 = 0 THEN 'marker' ELSE 'bubble' END AS mask, x, y, CASE WHEN id % 4 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS s FROM lt WHERE id % 3 > 0),
ht AS (SELECT image_id, mask, CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x, max(CAST(floor(255 * exp(-(dx * dx + dy * dy) / (2 * s * s))) AS INTEGER)) AS gray FROM sp, range(-3, 4) a(dx), range(-3, 4) b(dy)
  WHERE abs(dx) <= ceil(3 * s) AND abs(dy) <= ceil(3 * s) AND x + dx BETWEEN 0 AND 7 AND y + dy BETWEEN 0 AND 7 GROUP BY ALL),
al AS (SELECT image_id, 'page' AS mask, y, x, 255 AS gray FROM gr WHERE n % 2 = 1 OR edge UNION ALL SELECT image_id, mask, y, x, gray FROM ht WHERE gray > 0)
SELECT image_id, mask, count(*) AS n, CAST(sum(gray) AS BIGINT) AS total, CAST(sum(8 * y + x) AS BIGINT) AS "where" FROM al GROUP BY image_id, mask""",
    "displaced_points": f"""WITH {V.PEAKS_SQL}, a AS (SELECT image_id, rank AS id, CAST(x AS DOUBLE) * 1.1::DOUBLE - 0.3::DOUBLE AS x, CAST(y AS DOUBLE) + 0.25::DOUBLE AS y FROM pk),
m AS (SELECT a.image_id, id, a.x + px.p * 10 AS x, a.y + px.p * -5 AS y FROM a JOIN px ON px.image_id = a.image_id AND px.y = greatest(0, least(7, round_even(a.y, 0))) AND px.x = greatest(0, least(7, round_even(a.x, 0))))
SELECT image_id, id, round(x, 6) AS x, round(y, 6) AS y, x >= 0 AND x < 8 AND y >= 0 AND y < 8 AS in_frame FROM m""",
    "visible_points": """WITH a AS (SELECT vec_id AS image_id, 100 + vec_id % 50 AS width, list_filter(list_transform(range(0, 8), lambda i: CASE WHEN i <> 3 AND embedding[i + 1] > 0 THEN i END), lambda i: i IS NOT NULL) AS seen FROM embeddings),
b AS (SELECT image_id, width, unnest(seen) AS i, generate_subscripts(seen, 1) - 1 AS place FROM a)
SELECT image_id, CAST(place AS INTEGER) AS place, round(i * 2.5::DOUBLE * 832.0::DOUBLE / width, 6) AS x, round((i + 1.0::DOUBLE) * 1192.0::DOUBLE / 80, 6) AS y FROM b""",
    "scaled_peaks": f"WITH {V.PEAKS_SQL} SELECT image_id, rank AS id, round(CAST(x AS DOUBLE) * {1650 / 8!r}::DOUBLE, 3) AS x, round(CAST(y AS DOUBLE) * {2363 / 8!r}::DOUBLE, 3) AS y, CAST(x AS DOUBLE) AS model_x, CAST(y AS DOUBLE) AS model_y, round(p, 6) AS score FROM pk",
    "mean_peak_counts": f"WITH {V.PEAKS_SQL}, c AS (SELECT image_id, count(*) FILTER (p >= 0.2::DOUBLE) AS m, count(*) AS b FROM pk GROUP BY image_id) SELECT round(avg(m), 6) AS markers, round(avg(b), 6) AS bubbles FROM c",
    "mean_channel_dice": f"SELECT batch_id, round(avg(dice), 4) AS dice FROM ({V.ORACLES['dice_mse']}) GROUP BY batch_id",
    "training_samples": f"""WITH {V.PIXELS_SQL}, s AS (SELECT vec_id AS image_id FROM embeddings WHERE CAST(concat('0x', substr(sha1(CAST(vec_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967295.0::DOUBLE >= 0.2::DOUBLE ORDER BY vec_id LIMIT 50),
g AS (SELECT image_id, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, avg(gray) AS gray, avg(CASE WHEN p > 0.1::DOUBLE THEN 255 ELSE 0 END) AS mask FROM px JOIN s USING (image_id) GROUP BY 1, 2, 3)
SELECT image_id, y, x, round((gray / 255.0::DOUBLE - 0.5::DOUBLE) / 0.5::DOUBLE, 6) AS value, round(mask / 255, 6) AS mask, round(gray, 3) AS gray FROM g""",
    "marker_payload": f"""WITH {V.PEAKS_SQL} SELECT image_id, string_agg('mark_' || rank, ',' ORDER BY rank) AS markers_found,
  string_agg('mark_' || rank || '=' || CAST(round_even(round(x * 1.237::DOUBLE, 2) * 100, 0) AS INTEGER) || '/' || y * 100, ' ' ORDER BY rank) AS markers FROM pk GROUP BY image_id""",
}
