"""Queries on templates, pixels, points, manifests and metrics, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import geometry as G
from ..operators import matching as M
from ..operators import models as P
from ..operators import raster as R
from ..operators import specs as T
from ..operators import training as L
from ..sources import sinks
from . import bindings as B
from .template import DOCUMENT, template

# -- templates --------------------------------------------------------------------------------


def _flat(specs: DataFrame) -> DataFrame:
    return specs.withColumns({"center": F.array_join(F.col("center").cast("array<string>"), ","), "bbox": F.array_join(F.col("bbox").cast("array<string>"), ",")})


def bubble_specs(spark, sf):
    return _flat(T.all_specs(template(spark)))


def web_spec_sort(spark, sf):
    rows = T.all_specs(template(spark))
    key = F.struct(S.section_rank(F.col("section")), F.coalesce("field", F.lit("")), F.coalesce("question_number", F.lit(0)), F.coalesce("slot", F.lit(0)), "choice", "spec_id")
    return rows.orderBy(key).select(S.section_rank(F.col("section")).alias("section_rank"), "spec_id", "choice", "label")


def block_bbox(spark, sf):
    return T.block_boxes(T.all_specs(template(spark)), 1650, 2363, 24)


_Q = DOCUMENT.replace("'", "''")


#: The same specs from the same document, unnested by DuckDB.
SPECS_SQL = f"""
t AS (SELECT CAST('{_Q}' AS JSON) AS j),
p1 AS (
  SELECT 0 AS branch, c * 10000 + i * 100 + k AS o, 'part1' AS section, NULL AS field, 'I' AS part, format('I_{{:03d}}', q0 + i) AS item_id, format('I_{{:03d}}', q0 + i) AS question_id,
         q0 + i AS question_number, NULL AS statement, j->'part1'->'choices'->>k AS choice, j->'part1'->'choices'->>k AS label, 'multiple_choice' AS role, NULL AS slot,
         'part1' AS alignment_block, format('part1:q{{:03d}}-{{:03d}}', q0, q0 + n - 1) AS grid_block, CAST(col->'choice_x'->>k AS DOUBLE) AS x,
         CAST(col->>'row_y_start' AS DOUBLE) + i * CAST(col->>'row_y_step' AS DOUBLE) AS y, '_' || (j->'part1'->'choices'->>k) AS suffix
  FROM (SELECT j, c, j->'part1'->'columns'->c AS col, CAST(j->'part1'->'columns'->c->>'question_start' AS INTEGER) AS q0, CAST(j->'part1'->'columns'->c->>'question_count' AS INTEGER) AS n
        FROM t, (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS c)) , (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS i), (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS k)),
idn AS (
  SELECT CASE f WHEN 'sbd' THEN 1 ELSE 2 END AS branch, c * 100 + d AS o, 'identity' AS section, f AS field, NULL AS part, format('{{}}_{{:02d}}', f, c + 1) AS item_id, format('{{}}_{{:02d}}', f, c + 1) AS question_id,
         c + 1 AS question_number, NULL AS statement, CAST(d AS VARCHAR) AS choice, CAST(d AS VARCHAR) AS label, 'digit' AS role, c + 1 AS slot, 'identity' AS alignment_block, f AS grid_block,
         CAST(j->f->'column_x'->>c AS DOUBLE) AS x, CAST(j->f->>'row_y_start' AS DOUBLE) + d * CAST(j->f->>'row_y_step' AS DOUBLE) AS y, '_' || d AS suffix
  FROM t, (SELECT unnest(['sbd', 'exam_code']) AS f), (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS c), (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS d) WHERE f = 'sbd' OR c < 4),
p2 AS (
  SELECT 3 AS branch, q * 100 + s * 10 + k AS o, 'part2' AS section, NULL AS field, NULL AS part, format('II_{{:03d}}_{{}}', q + 1, j->'part2'->'statements'->>s) AS item_id,
         format('II_{{:03d}}_{{}}', q + 1, j->'part2'->'statements'->>s) AS question_id, q + 1 AS question_number, j->'part2'->'statements'->>s AS statement, j->'part2'->'choices'->>k AS choice,
         j->'part2'->'choice_labels'->>(j->'part2'->'choices'->>k) AS label, 'true_false' AS role, s + 1 AS slot, 'part2' AS alignment_block, format('part2:q{{:03d}}', q + 1) AS grid_block,
         CAST(j->'part2'->'questions'->q->'choice_x'->>k AS DOUBLE) AS x, CAST(j->'part2'->>'row_y_start' AS DOUBLE) + s * CAST(j->'part2'->>'row_y_step' AS DOUBLE) AS y, '_' || (j->'part2'->'choices'->>k) AS suffix
  FROM t, (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS q), (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS s), (SELECT CAST(unnest(range(0, 2)) AS INTEGER) AS k)),
p3 AS (
  SELECT 4 AS branch, q * 100 + m AS o, 'part3' AS section, NULL AS field, NULL AS part, format('III_{{:03d}}_{{}}', q + 1, CASE WHEN m = 0 THEN 'sign' WHEN m < 3 THEN 'comma' ELSE 'digit_' || ((m - 3) // 10 + 1) END) AS item_id,
         format('III_{{:03d}}', q + 1) AS question_id, q + 1 AS question_number, NULL AS statement, CASE WHEN m = 0 THEN '-' WHEN m < 3 THEN 'after_' || m ELSE CAST((m - 3) % 10 AS VARCHAR) END AS choice,
         CASE WHEN m = 0 THEN '-' WHEN m < 3 THEN ',' ELSE CAST((m - 3) % 10 AS VARCHAR) END AS label, CASE WHEN m = 0 THEN 'sign' WHEN m < 3 THEN 'comma' ELSE 'digit' END AS role,
         CASE WHEN m < 3 THEN m ELSE (m - 3) // 10 + 1 END AS slot, 'part3' AS alignment_block, format('part3:q{{:03d}}', q + 1) AS grid_block,
         CAST(CASE WHEN m = 0 THEN qn->>'minus_x' WHEN m < 3 THEN qn->'comma_x'->>(m - 1) ELSE qn->'column_x'->>((m - 3) // 10) END AS DOUBLE) AS x,
         CASE WHEN m = 0 THEN CAST(j->'part3'->>'row_minus_y' AS DOUBLE) WHEN m < 3 THEN CAST(j->'part3'->>'row_comma_y' AS DOUBLE)
              ELSE CAST(j->'part3'->>'digit_row_y_start' AS DOUBLE) + ((m - 3) % 10) * CAST(j->'part3'->>'digit_row_y_step' AS DOUBLE) END AS y,
         CASE WHEN m = 0 THEN '_minus' WHEN m < 3 THEN '_' || m ELSE '_' || ((m - 3) % 10) END AS suffix
  FROM (SELECT j, q, j->'part3'->'questions'->q AS qn FROM t, (SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS q)), (SELECT CAST(unnest(range(0, 43)) AS INTEGER) AS m)),
al AS (SELECT *, item_id || suffix AS spec_id, CAST(round_even(x, 0) AS INTEGER) AS cx, CAST(round_even(y, 0) AS INTEGER) AS cy
       FROM (SELECT * FROM p1 UNION ALL SELECT * FROM idn UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3))"""

# -- pixels -----------------------------------------------------------------------------------

PIXELS_SQL = """
e0 AS (SELECT vec_id AS image_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
px AS (SELECT image_id, label, CAST(k // 8 AS INTEGER) AS y, CAST(k % 8 AS INTEGER) AS x, CAST(v AS DOUBLE) AS p,
       CAST(greatest(0, least(255, floor(128.0::DOUBLE + 400.0::DOUBLE * CAST(v AS DOUBLE) + 0.5::DOUBLE))) AS INTEGER) AS gray FROM e0)"""
PEAKS_SQL = (
    PIXELS_SQL
    + """,
m1 AS (SELECT *, max(p) OVER (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM px),
m2 AS (SELECT *, max(m) OVER (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS mm FROM m1),
pk AS (SELECT image_id, y, x, p, row_number() OVER (PARTITION BY image_id ORDER BY p DESC, y, x) AS rank FROM m2 WHERE p >= 0.1::DOUBLE AND p >= mm - 1e-6::DOUBLE QUALIFY rank <= 6)"""
)


def darkness_score(spark, sf):
    return R.darkness(B.pixels(spark, sf))


def bubble_features_no_component(spark, sf):
    return R.bubble_features(B.pixels(spark, sf), 8, 8, with_component=False).withColumn("fill_score", F.floor(F.col("fill_score") * 1000).cast("long"))


def bubble_features(spark, sf):
    return R.bubble_features(B.pixels(spark, sf), 8, 8).withColumn("fill_score", F.floor(F.col("fill_score") * 1000).cast("long"))


def connected_component_area(spark, sf):
    return R.largest_component(B.pixels(spark, sf).where("gray < 100").select("image_id", "y", "x"))


def padded_crop(spark, sf):
    pixels = B.pixels(spark, sf)
    boxes = pixels.select("image_id").distinct().select("image_id", F.lit(1).alias("box_id"), F.lit(-2).alias("x1"), F.lit(5).alias("y1"), F.lit(4).alias("x2"), F.lit(10).alias("y2"))
    return R.padded_crop(pixels, boxes).groupBy("image_id", "y").agg(F.sum("gray").alias("total"), F.count(F.when(F.col("gray") == 255, 1)).alias("white"))


def heatmap_peaks(spark, sf):
    return R.peaks(B.pixels(spark, sf), 0.1, 1, 6).withColumn("p", F.round("p", 6))


def mask_bbox(spark, sf):
    return R.mask_box(B.pixels(spark, sf), 0.05, 2.5, 1.5)


def gaussian_heatmap(spark, sf):
    points = R.peaks(B.pixels(spark, sf), 0.1, 1, 6).select("image_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return R.gaussian_heat(points, 8, 8, 1.0)


def _logits(spark, sf) -> DataFrame:
    channel = F.element_at(F.array(*[F.lit(c) for c in ("page", "marker", "bubble", "grid")]), (F.pmod("y", F.lit(4)) + 1).cast("int"))
    return B.pixels(spark, sf).select(
        F.pmod("image_id", F.lit(25)).alias("batch_id"), channel.alias("channel"), (F.col("p") * 10).alias("logit"), (F.pmod(F.col("x") + F.col("label"), F.lit(2))).cast("double").alias("target")
    )


LOGITS_SQL = (
    PIXELS_SQL
    + """,
lg AS (SELECT image_id % 25 AS batch_id, ['page', 'marker', 'bubble', 'grid'][y % 4 + 1] AS channel, p * 10 AS logit, CAST((x + label) % 2 AS DOUBLE) AS target,
       1 / (1 + exp(-(p * 10))) AS prob FROM px)"""
)


def dice_mse(spark, sf):
    return L.pixel_metrics(_logits(spark, sf))


def layout_loss(spark, sf):
    return L.layout_loss(_logits(spark, sf), {"page": 3.0, "marker": 50.0, "bubble": 10.0, "grid": 6.0})


def weighted_metric_merge(spark, sf):
    batches = L.pixel_metrics(_logits(spark, sf)).withColumn("size", F.col("batch_id") + 1)
    return L.merged_metric(batches, ["channel"], "dice", "size")


# -- points -----------------------------------------------------------------------------------


def _peaks(spark, sf) -> DataFrame:
    return R.peaks(B.pixels(spark, sf), 0.1, 1, 6).select("image_id", F.col("rank").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "p")


LATTICE_SQL = "lt AS (SELECT image_id, 4 * i + j AS id, CAST(2 * j AS DOUBLE) AS x, CAST(2 * i AS DOUBLE) AS y FROM (SELECT DISTINCT image_id FROM px), range(0, 4) a(i), range(0, 4) b(j))"
REACH_SQL = """
rp AS (SELECT lt.image_id, lt.id AS a, pk.rank AS b, sqrt((lt.x - pk.x) * (lt.x - pk.x) + (lt.y - pk.y) * (lt.y - pk.y)) AS distance
       FROM lt JOIN pk ON lt.image_id = pk.image_id AND sqrt((lt.x - pk.x) * (lt.x - pk.x) + (lt.y - pk.y) * (lt.y - pk.y)) <= 2)"""


def points_in_reach(spark, sf):
    pixels = B.pixels(spark, sf)
    return M.reach_pairs(B.lattice(pixels), _peaks(spark, sf), 2.0).withColumn("distance", F.round("distance", 6))


def template_point_match(spark, sf):
    pixels = B.pixels(spark, sf)
    return M.greedy_pairs(M.reach_pairs(B.lattice(pixels), _peaks(spark, sf), 2.0)).withColumn("distance", F.round("distance", 6))


def peak_prf(spark, sf):
    pixels = B.pixels(spark, sf)
    peaks = _peaks(spark, sf).withColumnRenamed("p", "score").withColumn("id", F.col("id").cast("int"))
    labels = B.lattice(pixels).where("id % 3 = 0")
    found = M.peaks_to_labels(peaks, labels, 1.5)
    total = found.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum("distance").alias("d"))
    p, r, f1 = S.f_measure(F.col("tp"), F.col("fp"), F.col("fn"))
    return total.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round(F.col("d") / F.col("tp"), 6).alias("mean_distance"))


def radius_nms(spark, sf):
    circles = _peaks(spark, sf).withColumn("radius", F.round(F.col("p") * 100, 0))
    return M.drop_near(circles, 3.0)


def corner_choice(spark, sf):
    return M.corner_choices(_peaks(spark, sf), 8.0, 8.0)


def mark_candidates(spark, sf):
    lines = B.table(spark, sf, "lineitem")
    boxes = lines.select(
        F.col("l_orderkey").alias("image_id"), F.pmod("l_partkey", F.lit(1650)).cast("double").alias("x"), F.pmod("l_suppkey", F.lit(2363)).cast("double").alias("y"),
        (F.col("l_quantity") + 5).alias("w"), (F.col("l_linenumber") * 8.0).alias("h"), F.col("l_quantity").alias("q"),
    ).withColumn("area", F.col("w") * F.col("h") * (F.lit(1.0) - F.col("q") / 80))
    return M.mark_like(boxes, 1650.0, 2363.0).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cx").alias("sum_cx"))


def _shifted(spark, sf) -> DataFrame:
    """Matched lattice points and where they were found, blocks by picture."""
    pixels = B.pixels(spark, sf)
    pairs = M.greedy_pairs(M.reach_pairs(B.lattice(pixels), _peaks(spark, sf), 2.0))
    lattice = B.lattice(pixels).select("image_id", F.col("id").alias("a"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    peaks = _peaks(spark, sf).select("image_id", F.col("id").alias("b"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    return pairs.join(lattice.hint("merge"), ["image_id", "a"]).join(peaks.hint("merge"), ["image_id", "b"]).select("image_id", F.lit("grid").alias("block"), "sx", "sy", "dx", "dy", F.lit(6).alias("expected"))


def translation_transform(spark, sf):
    return G.shift_blocks(_shifted(spark, sf))


def affine_homography_fit(spark, sf):
    found = G.fit_local(_shifted(spark, sf).drop("expected"))
    return found.select("image_id", "method", "status", "n", F.round("rms", 3).alias("rms"), F.round("confidence", 6).alias("confidence"))


def grid_fit(spark, sf):
    found = G.fit_grid(_shifted(spark, sf))
    return found.select("image_id", "method", "status", "n", "n_inliers", "decode_allowed")


def residual_status(spark, sf):
    rows = B.table(spark, sf, "part").select(F.col("p_partkey").alias("image_id"), (F.pmod(F.col("p_retailprice"), F.lit(15.0))).alias("rms"))
    return rows.groupBy(S.residual_status(F.col("rms")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def error_stats(spark, sf):
    rows = B.table(spark, sf, "part").select(F.col("p_brand").alias("block"), (F.col("p_size") * 0.37).alias("error"))
    return L.error_stats(rows, ["block"])


GREEDY_SQL = """
ed AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY distance, a, b) AS n FROM rp),
gr AS (
  SELECT image_id, 0 AS n, [] :: BIGINT[] AS ua, [] :: BIGINT[] AS ub, false AS ok, NULL :: BIGINT AS a, NULL :: BIGINT AS b, NULL :: DOUBLE AS distance FROM (SELECT DISTINCT image_id FROM ed)
  UNION ALL
  SELECT g.image_id, e.n, CASE WHEN list_contains(ua, e.a) OR list_contains(ub, e.b) THEN ua ELSE list_append(ua, e.a) END, CASE WHEN list_contains(ua, e.a) OR list_contains(ub, e.b) THEN ub ELSE list_append(ub, e.b) END,
         NOT (list_contains(ua, e.a) OR list_contains(ub, e.b)), e.a, e.b, e.distance
  FROM gr g JOIN ed e ON e.image_id = g.image_id AND e.n = g.n + 1),
gp AS (SELECT image_id, a, b, distance FROM gr WHERE ok)"""


# -- manifests and histories ------------------------------------------------------------------


def hash_split(spark, sf):
    return B.manifest(spark, sf).select("image_id", S.hash_split(F.col("image_id")).alias("split"), F.round(S.hash_share(F.col("image_id")), 9).alias("share"))


def manifest_stats(spark, sf):
    rows = B.manifest(spark, sf).where("gt_label is not null").withColumn("split", S.hash_split(F.col("image_id")))
    return L.manifest_stats(rows)


def balanced_weights(spark, sf):
    rows = L.balanced_weights(B.manifest(spark, sf).where("gt_label is not null"))
    return rows.select("image_id", "gt_label", F.round("weight", 9).alias("weight"))


def confusion_matrix(spark, sf):
    rows = B.manifest(spark, sf).where("gt_label is not null and pred is not null")
    return L.confusion(rows, ["blank", "filled"], "gt_label", "pred")


def best_epoch(spark, sf):
    return L.best_epoch(B.history(spark, sf).select("epoch", "mean_dice"))


def seeded_split(spark, sf):
    return L.seeded_split(B.manifest(spark, sf), {"train": 120, "val": 25, "test": 22}, limit_base=150).select("image_id", "split")


def json_round_trip(spark, sf):
    rows = B.table(spark, sf, "events").select("event_id", "event_type", "props")
    lines = sinks.json_lines(rows)
    back = lines.select(F.from_json("value", "event_id long, event_type string, props string", {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return back.select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


def image_id_normalise(spark, sf):
    pages = B.table(spark, sf, "pages").select("page_id", F.col("url"))
    return pages.select("page_id", S.image_id(F.col("url"), "https:").alias("image_id"), S.base_id(F.col("url")).alias("base"), S.safe_name(F.col("url")).alias("safe"))


def selected_ids_filter(spark, sf):
    docs = B.table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), F.when(F.col("lang") != "fr", "ok").otherwise("error").alias("status"), "source")
    ids = B.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("image_id"))
    from ..sources.readers import ok_sheets

    return ok_sheets(docs, ids, order="source").select("image_id", "source")


def crop_name_parse(spark, sf):
    docs = B.table(spark, sf, "documents")
    section = F.element_at(F.array(*[F.lit(x) for x in ("identity", "part1", "part3")]), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    path = F.concat(F.lit("/crops/filled/"), section, F.lit("/"), F.col("source"), F.lit("__"), F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"), F.lit("_digit_1.png"))
    rows = docs.select("doc_id", path.alias("path"))
    return rows.select("doc_id", *[c.alias(n) for n, c in S.crop_name(F.col("path"), "/crops/filled").items()])


def value_to_choices(spark, sf):
    rows = B.table(spark, sf, "part").select("p_partkey", F.concat(F.when(F.col("p_size") % 2 == 0, "-").otherwise(""), F.replace(F.col("p_retailprice").cast("decimal(12,1)").cast("string"), F.lit("."), F.lit(","))).alias("value"))
    return rows.select("p_partkey", F.array_join(S.value_choices(F.lit("part3"), F.col("value")), "|").alias("choices"))


def classifier_predictions(spark, sf):
    """A model of a fixed formula over two features, with the threshold rule for labels."""
    rows = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax")
    scored = rows.withColumn("scores", P.score_batches(["l_discount", "l_tax"], lambda: P.linear_scorer([80.0, 20.0], -5.0)))
    found = P.prediction(F.col("scores"), ["blank", "filled"], 0.5)
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", found["pred_label"].alias("pred_label"), found["filled_probability"].alias("filled_probability"))


QUERIES = {
    f.__name__: f
    for f in (
        bubble_specs, web_spec_sort, block_bbox, darkness_score, bubble_features_no_component, bubble_features, connected_component_area, padded_crop, heatmap_peaks, mask_bbox,
        gaussian_heatmap, dice_mse, layout_loss, weighted_metric_merge, points_in_reach, template_point_match, peak_prf, radius_nms, corner_choice, mark_candidates,
        translation_transform, affine_homography_fit, grid_fit, residual_status, error_stats, hash_split, manifest_stats, balanced_weights, confusion_matrix, best_epoch,
        seeded_split, json_round_trip, image_id_normalise, selected_ids_filter, crop_name_parse, value_to_choices, classifier_predictions,
    )
}

SPEC_RANK = "CASE section WHEN 'identity' THEN 0 WHEN 'part1' THEN 1 WHEN 'part2' THEN 2 WHEN 'part3' THEN 3 ELSE 99 END"
SPLIT_SQL = """sp AS (SELECT doc_id AS image_id, CASE quality WHEN 1 THEN 'filled' WHEN 0 THEN 'blank' END AS gt_label, lang AS section, CASE toxic WHEN 1 THEN 'filled' WHEN 0 THEN 'blank' END AS pred,
  CAST(concat('0x', substr(sha1(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967295.0::DOUBLE AS share FROM documents LEFT JOIN labels USING (doc_id)),
mf AS (SELECT *, CASE WHEN share < 0.1::DOUBLE THEN 'test' WHEN share < 0.2::DOUBLE THEN 'val' ELSE 'train' END AS split FROM sp)"""
FEATURES_SQL = """
rg AS (SELECT *, sqrt((x - 3.5::DOUBLE) * (x - 3.5::DOUBLE) + (y - 3.5::DOUBLE) * (y - 3.5::DOUBLE)) AS d FROM px),
f1 AS (SELECT image_id, avg(CAST(gray < 100 AS DOUBLE)) AS darkness, avg(CAST(gray < 100 AS DOUBLE)) FILTER (d <= 0.72::DOUBLE * 4) AS inn, avg(CAST(gray < 100 AS DOUBLE)) FILTER (d >= 0.88::DOUBLE * 4) AS noise,
  greatest(80.0::DOUBLE, least(190.0::DOUBLE, round(quantile_cont(gray, 0.2) FILTER (d >= 0.88::DOUBLE * 4), 9) - 20)) AS lim FROM rg GROUP BY image_id),
f2 AS (SELECT rg.image_id, avg(CAST(gray < lim AS DOUBLE)) AS ink FROM rg JOIN f1 USING (image_id) WHERE d <= 0.58::DOUBLE * 4 GROUP BY rg.image_id)"""
ORACLES = {
    "bubble_specs": f"""WITH {SPECS_SQL} SELECT CAST(row_number() OVER (ORDER BY branch, o) AS INTEGER) AS spec_ord, section, field, part, spec_id, item_id, question_id, question_number, statement, choice, label, role, slot,
  alignment_block, grid_block, cx || ',' || cy AS center, (cx - 18) || ',' || (cy - 18) || ',' || (cx + 18) || ',' || (cy + 18) AS bbox FROM al""",
    "web_spec_sort": f"WITH {SPECS_SQL} SELECT {SPEC_RANK} AS section_rank, spec_id, choice, label FROM al",
    "block_bbox": f"WITH {SPECS_SQL} SELECT grid_block, greatest(0, min(cx) - 42) AS x1, greatest(0, min(cy) - 42) AS y1, least(1650, max(cx) + 42) AS x2, least(2363, max(cy) + 42) AS y2 FROM al GROUP BY grid_block",
    "darkness_score": f"WITH {PIXELS_SQL} SELECT image_id, round(avg(CAST(gray < 100 AS DOUBLE)), 6) AS darkness_score FROM px GROUP BY image_id",
    "bubble_features_no_component": f"""WITH {PIXELS_SQL},{FEATURES_SQL} SELECT image_id, round(darkness, 6) AS darkness_score, round(noise, 6) AS background_noise, round(greatest(0, inn - noise), 6) AS darkness_contrast,
  round(ink, 6) AS ink_ratio_inside, 0.0::DOUBLE AS component_score, CAST(floor(round(greatest(0, least(1, 0.5::DOUBLE * ink + 0.35::DOUBLE * greatest(0, inn - noise) - 0.2::DOUBLE * noise)), 6) * 1000) AS BIGINT) AS fill_score FROM f1 JOIN f2 USING (image_id)""",
    "bubble_features": f"""WITH RECURSIVE {PIXELS_SQL},{FEATURES_SQL}, ik AS (SELECT rg.image_id, y, x, y * 8 + x AS id FROM rg JOIN f1 USING (image_id) WHERE d <= 0.58::DOUBLE * 4 AND gray < lim),
re AS (SELECT image_id, id AS seed, y, x FROM ik UNION SELECT r.image_id, r.seed, i.y, i.x FROM re r JOIN ik i ON i.image_id = r.image_id AND abs(i.y - r.y) <= 1 AND abs(i.x - r.x) <= 1),
ar AS (SELECT image_id, max(n) AS area FROM (SELECT image_id, seed, count(*) AS n FROM re GROUP BY image_id, seed) GROUP BY image_id),
co AS (SELECT image_id, count(*) FILTER (d <= 0.58::DOUBLE * 4) AS core FROM rg GROUP BY image_id),
fc AS (SELECT *, coalesce(area / core, 0.0::DOUBLE) AS comp FROM f1 JOIN f2 USING (image_id) JOIN co USING (image_id) LEFT JOIN ar USING (image_id))
SELECT image_id, round(darkness, 6) AS darkness_score, round(noise, 6) AS background_noise, round(greatest(0, inn - noise), 6) AS darkness_contrast, round(ink, 6) AS ink_ratio_inside, round(comp, 6) AS component_score,
  CAST(floor(round(greatest(0, least(1, 0.5::DOUBLE * ink + 0.35::DOUBLE * greatest(0, inn - noise) + 0.2::DOUBLE * comp - 0.2::DOUBLE * noise)), 6) * 1000) AS BIGINT) AS fill_score FROM fc""",
    "connected_component_area": f"""WITH RECURSIVE {PIXELS_SQL}, ik AS (SELECT image_id, y, x, y * 8 + x AS id FROM px WHERE gray < 100),
re AS (SELECT image_id, id AS seed, y, x FROM ik UNION SELECT r.image_id, r.seed, i.y, i.x FROM re r JOIN ik i ON i.image_id = r.image_id AND abs(i.y - r.y) <= 1 AND abs(i.x - r.x) <= 1)
SELECT image_id, max(n) AS area FROM (SELECT image_id, seed, count(*) AS n FROM re GROUP BY image_id, seed) GROUP BY image_id""",
    "padded_crop": f"""WITH {PIXELS_SQL}, gd AS (SELECT image_id, yy, xx FROM (SELECT DISTINCT image_id FROM px), range(5, 10) a(yy), range(-2, 4) b(xx))
SELECT gd.image_id, CAST(yy - 5 AS INTEGER) AS y, CAST(sum(coalesce(gray, 255)) AS BIGINT) AS total, count(*) FILTER (coalesce(gray, 255) = 255) AS white
FROM gd LEFT JOIN px ON px.image_id = gd.image_id AND px.y = yy AND px.x = xx GROUP BY gd.image_id, yy""",
    "heatmap_peaks": f"WITH {PEAKS_SQL} SELECT image_id, y, x, round(p, 6) AS p, rank FROM pk",
    "mask_bbox": f"WITH {PIXELS_SQL} SELECT image_id, round(min(x) * 2.5::DOUBLE, 3) AS x1, round(min(y) * 1.5::DOUBLE, 3) AS y1, round((max(x) + 1) * 2.5::DOUBLE, 3) AS x2, round((max(y) + 1) * 1.5::DOUBLE, 3) AS y2 FROM px WHERE p >= 0.05::DOUBLE GROUP BY image_id",
    "gaussian_heatmap": f"""WITH {PEAKS_SQL}, sd AS (SELECT image_id, x + i AS px_, y + k AS py_, CAST(floor(255 * exp(-(i * i + k * k) / 2.0::DOUBLE)) AS INTEGER) AS g FROM pk, range(-3, 4) a(i), range(-3, 4) b(k))
SELECT image_id, CAST(py_ AS INTEGER) AS y, CAST(px_ AS INTEGER) AS x, max(g) AS gray FROM sd WHERE px_ BETWEEN 0 AND 7 AND py_ BETWEEN 0 AND 7 GROUP BY ALL""",
    "dice_mse": f"""WITH {LOGITS_SQL} SELECT batch_id, channel, round((2 * sum(CAST(prob >= 0.5::DOUBLE AS DOUBLE) * CAST(target >= 0.5::DOUBLE AS DOUBLE)) + 1) / (sum(CAST(prob >= 0.5::DOUBLE AS DOUBLE)) + sum(CAST(target >= 0.5::DOUBLE AS DOUBLE)) + 1), 6) AS dice,
  round(avg((prob - target) * (prob - target)), 6) AS mse FROM lg GROUP BY ALL""",
    "layout_loss": f"""WITH {LOGITS_SQL}, wt AS (SELECT *, CASE channel WHEN 'page' THEN 3 WHEN 'marker' THEN 50 WHEN 'bubble' THEN 10 ELSE 6 END AS w FROM lg),
ch AS (SELECT batch_id, channel, sum((1 - target) * logit + (1 + (w - 1) * target) * (ln(1 + exp(-abs(logit))) + greatest(-logit, 0))) AS bce, sum((prob - target) * (prob - target)) AS se, count(*) AS n,
  (2 * sum(prob * target) + 1) / (sum(prob) + sum(target) + 1) AS dice FROM wt GROUP BY ALL)
SELECT batch_id, round(sum(bce) / sum(n) + (1 - avg(dice)) + 0.25::DOUBLE * sum(se) / sum(n), 6) AS loss FROM ch GROUP BY batch_id""",
    "weighted_metric_merge": f"""WITH {LOGITS_SQL}, dm AS (SELECT batch_id, channel, round((2 * sum(CAST(prob >= 0.5::DOUBLE AS DOUBLE) * target) + 1) / (sum(CAST(prob >= 0.5::DOUBLE AS DOUBLE)) + sum(target) + 1), 6) AS dice FROM lg GROUP BY ALL)
SELECT channel, round(sum(dice * (batch_id + 1)) / sum(batch_id + 1), 6) AS dice FROM dm GROUP BY channel""",
    "points_in_reach": f"WITH {PEAKS_SQL},{LATTICE_SQL},{REACH_SQL} SELECT image_id, a, b, round(distance, 6) AS distance FROM rp",
    "template_point_match": f"WITH RECURSIVE {PEAKS_SQL},{LATTICE_SQL},{REACH_SQL},{GREEDY_SQL} SELECT image_id, a, b, round(distance, 6) AS distance FROM gp",
    "peak_prf": f"""WITH RECURSIVE {PEAKS_SQL},{LATTICE_SQL}, lb AS (SELECT image_id, list({{'id': id, 'x': x, 'y': y}} ORDER BY id) AS ls FROM lt WHERE id % 3 = 0 GROUP BY image_id),
st AS (
  SELECT image_id, 0 AS n, ls AS rest, 0 AS tp, 0 AS fp, 0.0::DOUBLE AS d FROM lb
  UNION ALL
  SELECT image_id, n + 1, CASE WHEN hit THEN list_filter(rest, lambda q: q.id <> struct_extract(best, 'id')) ELSE rest END, tp + CAST(hit AS INTEGER), fp + CAST(NOT hit AS INTEGER), d + CASE WHEN hit THEN struct_extract(best, 'd') ELSE 0 END
  FROM (SELECT *, coalesce(struct_extract(best, 'd') <= 1.5::DOUBLE, false) AS hit FROM (
    SELECT s.*, list_sort(list_transform(rest, lambda q: {{'d': sqrt((q.x - pk.x) * (q.x - pk.x) + (q.y - pk.y) * (q.y - pk.y)), 'id': q.id}}))[1] AS best
    FROM st s JOIN pk ON pk.image_id = s.image_id AND pk.rank = s.n + 1))),
la AS (SELECT image_id, max(n) AS n FROM st GROUP BY image_id),
su AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(len(rest)) AS BIGINT) AS fn, sum(d) AS d FROM st JOIN la USING (image_id, n))
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1, round(d / tp, 6) AS mean_distance FROM su""",
    "radius_nms": f"""WITH RECURSIVE {PEAKS_SQL}, ci AS (SELECT image_id, rank AS id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, round(p * 100, 0) AS radius, row_number() OVER (PARTITION BY image_id ORDER BY round(p * 100, 0) DESC, rank) AS n FROM pk),
st AS (
  SELECT DISTINCT image_id, 0 AS n, [] :: STRUCT(id BIGINT, x DOUBLE, y DOUBLE, radius DOUBLE)[] AS kept FROM ci
  UNION ALL
  SELECT s.image_id, c.n, CASE WHEN len(list_filter(kept, lambda k: sqrt((k.x - c.x) * (k.x - c.x) + (k.y - c.y) * (k.y - c.y)) < 3)) > 0 THEN kept
                               ELSE list_append(kept, {{'id': c.id, 'x': c.x, 'y': c.y, 'radius': c.radius}}) END
  FROM st s JOIN ci c ON c.image_id = s.image_id AND c.n = s.n + 1),
la AS (SELECT image_id, max(n) AS n FROM st GROUP BY image_id)
SELECT image_id, k.id AS id, k.x AS x, k.y AS y, k.radius AS radius FROM (SELECT image_id, unnest(kept) AS k FROM st JOIN la USING (image_id, n))""",
    "corner_choice": f"""WITH {PEAKS_SQL}, co AS (SELECT * FROM (VALUES ('top_left', 0, 0), ('top_right', 1, 0), ('bottom_right', 1, 1), ('bottom_left', 0, 1)) v(corner, r, l)),
ca AS (SELECT image_id, corner, rank AS id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, abs(x - 8.0::DOUBLE * r) + abs(y - 8.0::DOUBLE * l) AS cost FROM pk, co
  WHERE CASE WHEN r = 1 THEN x > 6.4::DOUBLE ELSE x < 1.6::DOUBLE END AND CASE WHEN l = 1 THEN y > 6.0::DOUBLE ELSE y < 1.6::DOUBLE END)
SELECT image_id, corner, id, x, y, cost FROM ca QUALIFY row_number() OVER (PARTITION BY image_id, corner ORDER BY cost, y, x, id) = 1""",
    "mark_candidates": """WITH bx AS (SELECT l_orderkey AS image_id, CAST(l_partkey % 1650 AS DOUBLE) AS x, CAST(l_suppkey % 2363 AS DOUBLE) AS y, l_quantity + 5 AS w, l_linenumber * 8.0::DOUBLE AS h, l_quantity AS q FROM lineitem),
ba AS (SELECT *, w * h * (1.0::DOUBLE - q / 80) AS area, x + w / 2 AS cx, y + h / 2 AS cy FROM bx)
SELECT image_id, count(*) AS n, sum(cx) AS sum_cx FROM ba WHERE w BETWEEN 10 AND 54 AND h BETWEEN 10 AND 54 AND w / h BETWEEN 0.55::DOUBLE AND 1.65::DOUBLE AND area / (w * h) >= 0.45::DOUBLE
  AND (x < 0.12::DOUBLE * 1650 OR x > 0.88::DOUBLE * 1650 OR y < 0.12::DOUBLE * 2363 OR y > 0.82::DOUBLE * 2363) GROUP BY image_id""",
    "translation_transform": f"""WITH RECURSIVE {PEAKS_SQL},{LATTICE_SQL},{REACH_SQL},{GREEDY_SQL},
pr AS (SELECT gp.image_id, lt.x AS sx, lt.y AS sy, CAST(pk.x AS DOUBLE) AS dx, CAST(pk.y AS DOUBLE) AS dy FROM gp JOIN lt ON lt.image_id = gp.image_id AND lt.id = a JOIN pk ON pk.image_id = gp.image_id AND pk.rank = b),
sh AS (SELECT image_id, median(dx - sx) AS mx, median(dy - sy) AS my FROM pr GROUP BY image_id),
st AS (SELECT image_id, mx, my, count(*) AS n, round(sqrt(avg((sx + mx - dx) * (sx + mx - dx) + (sy + my - dy) * (sy + my - dy))), 3) AS rms, round(sqrt(max((sx + mx - dx) * (sx + mx - dx) + (sy + my - dy) * (sy + my - dy))), 3) AS largest
       FROM pr JOIN sh USING (image_id) GROUP BY image_id, mx, my)
SELECT image_id, 'grid' AS block, round(mx, 3) AS shift_x, round(my, 3) AS shift_y, n, rms, largest, CASE WHEN rms > 10 THEN 'alignment_failed' WHEN rms > 6 THEN 'need_review' WHEN n >= 4 THEN 'fallback_translation' ELSE 'skipped' END AS status,
  round(least(0.65::DOUBLE, n / 6), 6) AS confidence, rms <= 10 AS decode_allowed FROM st""",
    "residual_status": "SELECT CASE WHEN p_retailprice % 15.0::DOUBLE > 10 THEN 'alignment_failed' WHEN p_retailprice % 15.0::DOUBLE > 6 THEN 'need_review' ELSE 'ok' END AS status, count(*) AS n FROM part GROUP BY 1",
    "error_stats": "SELECT p_brand AS block, round(sqrt(avg((p_size * 0.37::DOUBLE) * (p_size * 0.37::DOUBLE))), 3) AS rms, round(max(p_size * 0.37::DOUBLE), 3) AS largest FROM part GROUP BY 1",
    "hash_split": f"WITH {SPLIT_SQL} SELECT image_id, split, round(share, 9) AS share FROM mf",
    "manifest_stats": f"""WITH {SPLIT_SQL} SELECT CASE WHEN grouping(gt_label) = 0 AND grouping(split) = 0 THEN 'split:label' WHEN grouping(gt_label) = 0 THEN 'label' WHEN grouping(split) = 0 THEN 'split'
  WHEN grouping(section) = 0 THEN 'section' ELSE 'all' END AS kind, coalesce(concat_ws(':', split, gt_label, section), '') AS name, count(*) AS n, count(DISTINCT image_id) AS n_images
FROM mf WHERE gt_label IS NOT NULL GROUP BY GROUPING SETS ((gt_label), (split), (section), (split, gt_label), ())""",
    "balanced_weights": f"WITH {SPLIT_SQL} SELECT image_id, gt_label, round(1.0::DOUBLE / count(*) OVER (PARTITION BY gt_label), 9) AS weight FROM mf WHERE gt_label IS NOT NULL",
    "confusion_matrix": f"""WITH {SPLIT_SQL}, cm AS (SELECT v.gt_label, count(*) FILTER (pred = 'blank') AS pred_blank, count(*) FILTER (pred = 'filled') AS pred_filled
  FROM (VALUES ('blank'), ('filled')) v(gt_label) LEFT JOIN mf ON mf.gt_label = v.gt_label GROUP BY v.gt_label)
SELECT *, CASE WHEN pred_blank + pred_filled > 0 THEN round(CASE gt_label WHEN 'blank' THEN pred_blank ELSE pred_filled END / (pred_blank + pred_filled), 6) END AS recall FROM cm""",
    "best_epoch": "WITH h AS (SELECT date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS epoch, round(avg(value), 6) AS mean_dice FROM events GROUP BY 1) SELECT CAST(epoch AS INTEGER) AS epoch, mean_dice FROM h ORDER BY mean_dice DESC, epoch LIMIT 1",
    "seeded_split": """WITH r AS (SELECT doc_id AS image_id, row_number() OVER (ORDER BY sha1('20260619:' || doc_id), doc_id) AS n FROM documents)
SELECT image_id, CASE WHEN n <= 120 THEN 'train' WHEN n <= 145 THEN 'val' ELSE 'test' END AS split FROM r WHERE n <= 150""",
    "json_round_trip": "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "image_id_normalise": r"""WITH s AS (SELECT page_id, url, CASE WHEN starts_with(url, 'https:/') THEN substr(url, 8) ELSE regexp_extract(url, '([^/]*)$', 1) END AS shown FROM pages),
b AS (SELECT *, regexp_replace(shown, '([^/])\.[^./]*$', '\1') AS bare FROM s)
SELECT page_id, coalesce(nullif(trim(regexp_replace(bare, '[^A-Za-z0-9]+', '_', 'g'), '_'), ''), 'sheet') AS image_id,
  regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS base, regexp_replace(url, '[^\p{L}\p{N}_-]', '_', 'g') AS safe FROM b""",
    "selected_ids_filter": "SELECT doc_id AS image_id, source FROM documents WHERE lang <> 'fr' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "crop_name_parse": """WITH d AS (SELECT doc_id, source, ['identity', 'part1', 'part3'][doc_id % 3 + 1] AS section, lang FROM documents)
SELECT doc_id, section, source AS image_id, lang || '_' || doc_id || '_digit' AS group_id, '1' AS choice, CASE section WHEN 'identity' THEN lang || '_' || doc_id WHEN 'part1' THEN 'answer' ELSE 'digit' END AS field FROM d""",
    "value_to_choices": """WITH v AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '-' ELSE '' END || replace(CAST(CAST(p_retailprice AS DECIMAL(12,1)) AS VARCHAR), '.', ',') AS value FROM part)
SELECT p_partkey, array_to_string(list_transform(range(1, len(value) + 1), lambda i: CASE WHEN value[i] = ',' THEN 'after_' || greatest(1, i - 1) ELSE value[i] END), '|') AS choices FROM v""",
    "classifier_predictions": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN 1 / (1 + exp(-(80.0::DOUBLE * l_discount + 20.0::DOUBLE * l_tax - 5))) >= 0.5::DOUBLE THEN 'filled' ELSE 'blank' END AS pred_label,
  round(1 / (1 + exp(-(80.0::DOUBLE * l_discount + 20.0::DOUBLE * l_tax - 5))), 6) AS filled_probability FROM lineitem""",
}
