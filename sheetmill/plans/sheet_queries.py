"""Queries from bubbles to sheets and comparisons, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import compare as C
from ..operators import decode as D
from ..operators import ranking as R
from ..operators import sheets as H
from . import bindings as B

BUBBLES = """
b0 AS (
  SELECT o_custkey AS image_id, l_orderkey AS item_id,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'identity' WHEN 'FURNITURE' THEN 'part2' WHEN 'MACHINERY' THEN 'part3' ELSE 'part1' END AS section,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS spec_ord,
         l_discount AS fill_score, l_tax AS darkness_score,
         CASE WHEN o_orderstatus <> 'P' OR o_orderkey % 3 = 0 THEN 'ok' WHEN o_orderkey % 3 = 1 THEN 'fallback_translation' ELSE 'alignment_failed' END AS alignment_status,
         least(1.0::DOUBLE, o_totalprice / 333333.0::DOUBLE) AS alignment_confidence,
         CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 1500 > 1000 THEN 'alignment_failed' WHEN o_orderkey % 1500 > 600 THEN 'need_review' ELSE 'ok' END END AS grid_status,
         CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 1500 <= 1000 END AS decode_allowed
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
b AS (
  SELECT *, chr(64 + spec_ord) AS choice,
         CASE WHEN fill_score <= 0.025::DOUBLE THEN 'blank' WHEN fill_score >= 0.08::DOUBLE THEN 'filled' ELSE 'ambiguous' END AS prelabel
  FROM b0)"""


def relabel_sql(score: str, filled: float, margin: float, lone: bool = True, src: str = "b", out: str = "r", where: str = "true") -> str:
    return f"""
{out}0 AS (
  SELECT *, coalesce({score}, 0) AS gs, row_number() OVER w AS rk, count(*) OVER (PARTITION BY image_id, item_id) AS gn,
         first_value(coalesce({score}, 0)) OVER w2 AS gtop, coalesce(nth_value({score}, 2) OVER w2, 0) AS gsecond
  FROM {src} WHERE {where}
  WINDOW w AS (PARTITION BY image_id, item_id ORDER BY coalesce({score}, 0) DESC, spec_ord),
         w2 AS (PARTITION BY image_id, item_id ORDER BY coalesce({score}, 0) DESC, spec_ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
{out} AS (
  SELECT * EXCLUDE (prelabel),
         CASE WHEN gtop < {filled}::DOUBLE THEN 'blank'
              WHEN {"gn > 1 AND " if lone else ""}gtop - gsecond < {margin}::DOUBLE THEN CASE WHEN gtop - gs <= {margin}::DOUBLE THEN 'ambiguous' ELSE 'blank' END
              WHEN rk = 1 THEN 'filled' ELSE 'blank' END AS prelabel
  FROM {out}0)"""


def decode_sql(question: bool, filled: float, margin: float, src: str = "r", out: str = "f") -> str:
    rank = "CASE WHEN choice IN ('A','B','C','D') THEN ascii(choice) - 65 ELSE 4 END" if question else "CASE choice WHEN 'T' THEN 0 WHEN 'F' THEN 1 ELSE 99 END"
    clamp = lambda x: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"
    ambiguous = "na > 0" if question else "na > 0 AND nf = 0"
    return f"""
{out}x AS (
  SELECT *, fill_score AS s, {rank} AS cr,
         CASE WHEN grid_status IS NOT NULL THEN grid_status <> 'ok' ELSE coalesce(alignment_status <> 'ok', false) END AS rv,
         CASE WHEN grid_status IS NOT NULL THEN grid_status = 'alignment_failed' OR coalesce(NOT decode_allowed, false)
              ELSE coalesce(alignment_status = 'alignment_failed', false) END AS hd
  FROM {src}),
{out}g AS (
  SELECT image_id, item_id, any_value(section) AS section, bool_or(rv) AS rv, bool_or(hd) AS hd, count(DISTINCT choice) AS nc, max(s) AS top,
         count(*) FILTER (prelabel = 'filled') AS nf, count(*) FILTER (prelabel = 'ambiguous') AS na
  FROM {out}x GROUP BY image_id, item_id),
{out}c AS (
  SELECT image_id, item_id, choice, s, darkness_score AS dk, {clamp("alignment_confidence")} AS sure,
         row_number() OVER (PARTITION BY image_id, item_id ORDER BY s DESC, cr, choice) AS n
  FROM {out}x WHERE prelabel = 'filled'),
{out}c1 AS (
  SELECT c.image_id, c.item_id, c.choice, c.s, c.dk, c.sure FROM {out}c c JOIN {out}g g USING (image_id, item_id)
  WHERE n = 1 AND NOT hd {"AND nf = 1" if question else ""}),
{out}o AS (
  SELECT x.image_id, x.item_id, max(x.s) FILTER (c.choice IS NULL OR x.choice <> c.choice) AS rival,
         max(x.darkness_score) FILTER (c.choice IS NULL OR x.choice <> c.choice) AS drival
  FROM {out}x x LEFT JOIN {out}c1 c USING (image_id, item_id) GROUP BY x.image_id, x.item_id),
{out}e AS (
  SELECT g.*, c.choice AS selected, c.s, c.dk, c.sure, o.drival, round(c.s - o.rival, 6) AS margin
  FROM {out}g g LEFT JOIN {out}c1 c USING (image_id, item_id) LEFT JOIN {out}o o USING (image_id, item_id)),
{out}k AS (
  SELECT *, CASE WHEN selected IS NOT NULL THEN round(least(CASE WHEN margin IS NOT NULL THEN {clamp(f"margin / greatest({margin}::DOUBLE * 2, 1e-6::DOUBLE)")}
                 ELSE {clamp(f"s / greatest({filled}::DOUBLE * 2, 1e-6::DOUBLE)")} END, sure), 6)
                 ELSE round({clamp(f"1 - top / {filled}::DOUBLE")}, 6) END AS confidence
  FROM {out}e),
{out}r AS (
  SELECT *, list_filter([{"CASE WHEN nc <> 4 THEN 'incomplete_choices' END," if question else ""} CASE WHEN {ambiguous} THEN 'ambiguous_bubble' END,
         CASE WHEN nf > 1 THEN 'multi_mark' END, CASE WHEN rv THEN 'alignment_failed' END,
         CASE WHEN selected IS NOT NULL AND confidence < 0.45::DOUBLE THEN 'low_confidence' END], lambda z: z IS NOT NULL) AS reasons
  FROM {out}k),
{out} AS (
  SELECT image_id, item_id, section, selected,
         CASE WHEN list_contains(reasons, 'multi_mark') THEN 'multi_mark' WHEN len(reasons) > 0 THEN 'need_review'
              WHEN selected IS NOT NULL THEN 'accepted' ELSE 'blank' END AS status,
         len(reasons) > 0 AS need_review, reasons, confidence, round(s, 6) AS score, margin AS score_margin,
         round(dk, 6) AS darkness_score, round(dk - drival, 6) AS darkness_margin
  FROM {out}r)"""


ITEM_SQL = "image_id, item_id, selected, status, need_review, array_to_string(reasons, '|') AS review_reasons, confidence, score, score_margin, darkness_score, darkness_margin"


def _relabelled(spark: SparkSession, sf: str, filled: float = 0.08, margin: float = 0.025) -> DataFrame:
    return R.relabel_by_rank(B.bubbles(spark, sf), score="fill_score", filled_threshold=filled, margin_threshold=margin)


def _items(spark: SparkSession, sf: str, filled: float = 0.08, margin: float = 0.025) -> DataFrame:
    return D.decode_groups(_relabelled(spark, sf, filled, margin))


def ranked_relabel(spark, sf):
    return _relabelled(spark, sf).select("image_id", "item_id", "spec_ord", "prelabel", "prelabel_source", "group_top_score", "group_second_score", "group_score_margin")


def identity_relabel(spark, sf):
    return R.relabel_identity(B.bubbles(spark, sf)).select("image_id", "item_id", "spec_ord", "prelabel", "group_score_margin", "group_relabel_source")


def prelabel_threshold(spark, sf):
    rows = B.bubbles(spark, sf).select("section", S.prelabel(F.col("darkness_score"), 0.02, 0.06).alias("label"))
    return rows.groupBy("section", "label").agg(F.count(F.lit(1)).alias("n"))


def record_score_coalesce(spark, sf):
    rows = B.bubbles(spark, sf).select(
        "image_id", "item_id", "spec_ord", F.when(F.col("spec_ord") == 1, "darkness_score").alias("group_score_key"),
        F.when(F.col("spec_ord") == 2, F.col("fill_score") + 0.5).alias("filled_probability"), F.when(F.col("spec_ord") < 5, F.col("fill_score")).alias("fill_score"), "darkness_score",
    )
    return rows.select("image_id", "item_id", "spec_ord", F.round(S.record_score(rows.columns), 6).alias("score"))


def _shown(items: DataFrame) -> DataFrame:
    return items.withColumn("review_reasons", F.array_join("review_reasons", "|"))


def decode_choice_question(spark, sf):
    return _shown(D.decode_questions(_relabelled(spark, sf)))


def decode_generic_group(spark, sf):
    return _shown(_items(spark, sf))


def decode_handmade_group(spark, sf):
    """Labels by threshold alone, so that items with several filled bubbles occur."""
    return _shown(D.decode_groups(B.bubbles(spark, sf)))


def alignment_gate_override(spark, sf):
    a, g, ok = F.col("alignment_status"), F.col("grid_refinement_status"), F.col("grid_refinement_decode_allowed")
    return B.bubbles(spark, sf).groupBy("image_id", "item_id").agg(F.bool_or(S.needs_review(a, g)).alias("needs_review"), F.bool_or(S.hard_failure(a, g, ok)).alias("hard_failure"))


def sheet_answer_rollup(spark, sf):
    rows = H.answer_sheets(D.decode_questions(_relabelled(spark, sf)))
    answers = F.array_join(F.transform(F.map_values("answers"), lambda a: F.concat(a.item_id.cast("string"), F.lit("="), F.coalesce(a.selected, F.lit("")))), ",")
    review = F.array_join(F.transform("review_items", lambda r: F.concat(r.item_id.cast("string"), F.lit(":"), F.array_join(r.review_reasons, "+"))), ",")
    return rows.select("image_id", answers.alias("answers"), review.alias("review_items"), "n_accepted", "n_blank", "n_multi_mark", "n_need_review", "n_review")


def item_status_histogram(spark, sf):
    sections = B.bubbles(spark, sf).select("image_id", "section").distinct()
    return _items(spark, sf).join(sections, "image_id").groupBy(F.concat_ws(":", "section", "status").alias("key")).agg(F.count(F.lit(1)).alias("n"))


# -- fixed slots ------------------------------------------------------------------------------


def _slots(items: DataFrame) -> DataFrame:
    return items.withColumn("slot", F.row_number().over(Window.partitionBy("image_id").orderBy("item_id")))


def _images(spark, sf):
    return B.table(spark, sf, "orders").select(F.col("o_custkey").alias("image_id"))


def identity_value_string(spark, sf):
    rows = _slots(_items(spark, sf)).withColumn("item_id", F.format_string("sbd_%02d", "slot"))
    return H.identity_values(rows, _images(spark, sf), "sbd", 8)


def true_false_dense(spark, sf):
    name = F.format_string("II_%03d_%s", (F.floor((F.col("slot") - 1) / 4) + 1).cast("int"), F.chr(F.lit(97) + F.pmod(F.col("slot") - 1, F.lit(4))))
    rows = _slots(_items(spark, sf)).withColumn("item_id", name)
    return H.true_false_answers(rows, _images(spark, sf))


def short_answer_compact(spark, sf):
    part = F.pmod(F.col("slot") - 1, F.lit(6))
    suffix = F.when(part == 0, "sign").when(part == 1, "comma").otherwise(F.concat(F.lit("digit_"), (part - 1).cast("string")))
    place = F.ascii("selected") - 65
    mark = F.when(part == 0, "-").when(part == 1, F.concat(F.lit("after_"), (F.pmod(place, F.lit(5)) + 1).cast("string"))).otherwise(F.pmod(place, F.lit(10)).cast("string"))
    rows = (
        _slots(_items(spark, sf))
        .withColumn("item_id", F.concat(F.format_string("III_%03d_", (F.floor((F.col("slot") - 1) / 6) + 1).cast("int")), suffix))
        .withColumn("selected", F.when(F.col("selected").isNotNull(), mark))
    )
    return H.short_answers(rows, _images(spark, sf))


SLOT_SQL = "sl AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY item_id) AS slot FROM f), im AS (SELECT DISTINCT o_custkey AS image_id FROM orders)"


# -- sheets -----------------------------------------------------------------------------------


def _sheets(spark, sf) -> DataFrame:
    lines = B.bubbles(spark, sf).select("image_id", "section", "item_id", "alignment_status", "alignment_confidence", "grid_refinement_status").distinct()
    blocks = lines.groupBy("image_id").agg(
        H.alignment_rollup(F.col("alignment_status")).alias("local_status"),
        H.grid_rollup(F.col("grid_refinement_status")).alias("grid_status"),
        F.round(F.min("alignment_confidence"), 6).alias("alignment_confidence"),
        F.round(F.min(F.when(F.col("grid_refinement_status").isNotNull(), F.col("alignment_confidence"))), 6).alias("grid_confidence"),
        F.first("section").alias("section"),
    )
    known = F.when(F.col("grid_status") != "skipped", F.col("grid_status"))
    items = _items(spark, sf).join(blocks.select("image_id", "section"), "image_id")
    found = items.groupBy("image_id").agg(
        F.round(F.min(F.when((F.col("section") == "identity") | (F.col("status") != "blank"), F.col("confidence"))), 6).alias("decoded_item_confidence"),
        H.review_count(F.col("status"), F.col("section")).alias("review_item_count"),
    )
    joined = blocks.join(found, "image_id").withColumn("sheet_status", H.sheet_status(known, F.lit(None).cast("string"), F.col("local_status")))
    return H.confidence_summary(joined)


def confidence_summary(spark, sf):
    return _sheets(spark, sf).select(
        "image_id", "local_status", "grid_status", "sheet_status", "alignment_confidence", "grid_confidence", "decoded_item_confidence", "review_item_count", "sheet_confidence", "auto_pass"
    )


def run_summary(spark, sf):
    return H.run_summary(_sheets(spark, sf))


SHEETS_SQL = """
bl AS (
  SELECT image_id, CASE WHEN bool_or(alignment_status = 'alignment_failed') THEN 'need_review' WHEN bool_or(alignment_status LIKE 'fallback%') THEN 'degraded' ELSE 'ok' END AS local_status,
         CASE WHEN count(grid_status) = 0 THEN 'skipped' WHEN bool_and(grid_status = 'ok') THEN 'ok' WHEN bool_and(grid_status = 'skipped') THEN 'skipped' ELSE 'need_review' END AS grid_status,
         round(min(alignment_confidence), 6) AS alignment_confidence, round(min(alignment_confidence) FILTER (grid_status IS NOT NULL), 6) AS grid_confidence
  FROM b GROUP BY image_id),
fi AS (
  SELECT image_id, round(min(confidence) FILTER (section = 'identity' OR status <> 'blank'), 6) AS decoded_item_confidence,
         count(*) FILTER (CASE WHEN section = 'identity' THEN status <> 'accepted' ELSE status IN ('need_review', 'multi_mark') END) AS review_item_count
  FROM f GROUP BY image_id),
sh AS (
  SELECT *, CASE WHEN grid_status <> 'skipped' THEN CASE WHEN grid_status = 'ok' THEN 'ok' ELSE 'need_review' END
                 WHEN local_status = 'ok' THEN 'ok' ELSE 'need_review' END AS sheet_status FROM bl JOIN fi USING (image_id)),
su AS (
  SELECT *, round(least(alignment_confidence, grid_confidence, decoded_item_confidence), 6) AS sheet_confidence,
         sheet_status = 'ok' AND review_item_count = 0 AS auto_pass FROM sh)"""


# -- comparison -------------------------------------------------------------------------------


#: Items that must be accepted for a sheet to count as extracted.
ENOUGH = 3


def _method(spark, sf, filled: float, margin: float) -> DataFrame:
    """An extraction in the form of 80 keys a sheet; sheets with too few accepted items failed."""
    items = _slots(_items(spark, sf, filled, margin))
    accepted = F.count(F.when(F.col("status") == "accepted", 1)).over(Window.partitionBy("image_id"))
    items = items.withColumn("accepted", accepted).where(F.col("accepted") >= ENOUGH)
    key = F.get(H.all_keys(), F.pmod((F.col("slot") - 1) * 7, F.lit(80)))
    keyed = items.withColumn("key", key).select("image_id", S.section_of(F.col("key")).alias("section"), S.item_of(F.col("key")).alias("item_id"), F.col("selected").alias("value"), "status", "need_review")
    return H.flat_items(keyed, H.all_keys())


def _tasks(spark, sf) -> int:
    return B.tasks(B.table(spark, sf, "lineitem"))


def _method_a(spark, sf):
    return _method(spark, sf, 0.05, 0.025)


def _method_b(spark, sf):
    return _method(spark, sf, 0.08, 0.03)


def _truth(spark, sf):
    best = F.min(F.struct((-F.col("darkness_score")).alias("m"), "spec_ord", "choice"))
    items = _slots(B.bubbles(spark, sf).groupBy("image_id", "item_id").agg(best.alias("b")))
    key = F.get(H.all_keys(), F.pmod((F.col("slot") - 1) * 7, F.lit(80)))
    return items.select("image_id", key.alias("key"), F.col("b.choice").alias("expected"))


KEYS_SQL = """
ks AS (
  SELECT k, row_number() OVER (ORDER BY o) - 1 AS i FROM (
    SELECT 0 AS o, 'identity:sbd' AS k UNION ALL SELECT 1, 'identity:exam_code'
    UNION ALL SELECT 10 + n, format('part1:I_{:03d}', n) FROM range(1, 41) t(n)
    UNION ALL SELECT 100 + 4 * (q - 1) + s, format('part2:II_{:03d}_{}', q, chr(CAST(97 + s AS INTEGER))) FROM range(1, 9) t(q), range(0, 4) u(s)
    UNION ALL SELECT 200 + q, format('part3:III_{:03d}', q) FROM range(1, 7) t(q)))"""


def method_sql(name: str, filled: float, margin: float) -> str:
    return (
        relabel_sql("fill_score", filled, margin, out=f"{name}r")
        + ","
        + decode_sql(False, filled, margin, src=f"{name}r", out=f"{name}f")
        + f""",
{name}s AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY item_id) AS slot FROM {name}f
  QUALIFY count(*) FILTER (status = 'accepted') OVER (PARTITION BY image_id) >= {ENOUGH}),
{name} AS (
  SELECT d.image_id, ks.k AS key, coalesce(s.selected, '') AS value, s.status, coalesce(s.need_review, false) AS need_review
  FROM (SELECT DISTINCT image_id FROM {name}s) d CROSS JOIN ks LEFT JOIN {name}s s ON s.image_id = d.image_id AND ((s.slot - 1) * 7) % 80 = ks.i)"""
    )


TRUTH_SQL = """
ti AS (SELECT image_id, item_id, arg_min(choice, (-darkness_score, spec_ord)) AS expected FROM b GROUP BY image_id, item_id),
ts AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY item_id) AS slot FROM ti),
gt AS (SELECT image_id, ks.k AS key, expected FROM ts JOIN ks ON ((slot - 1) * 7) % 80 = ks.i)"""
A_SQL, B_SQL = method_sql("ma", 0.05, 0.025), method_sql("mb", 0.08, 0.03)


def flatten_items(spark, sf):
    return _method_a(spark, sf)


def pairwise_agreement(spark, sf):
    return C.agreement(_method_a(spark, sf), _method_b(spark, sf), tasks=_tasks(spark, sf))


def _verdicts(found: DataFrame) -> DataFrame:
    """As in the CSV report: an unknown verdict is empty."""
    return found.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("method_a_correct", "method_b_correct")})


def difference_listing(spark, sf):
    return _verdicts(C.differences(_method_a(spark, sf), _method_b(spark, sf), _truth(spark, sf), tasks=_tasks(spark, sf)))


def sample_differences(spark, sf):
    return _verdicts(C.differences(_method_a(spark, sf), _method_b(spark, sf), _truth(spark, sf), most=200, tasks=_tasks(spark, sf)))


def only_in_a(spark, sf):
    return C.only_in(_method_a(spark, sf), _method_b(spark, sf))


def only_in_b(spark, sf):
    return C.only_in(_method_b(spark, sf), _method_a(spark, sf))


def accuracy_false_accept(spark, sf):
    return C.accuracy(_method_a(spark, sf), _truth(spark, sf))


def error_listing(spark, sf):
    return C.errors(_method_b(spark, sf), _truth(spark, sf))


def flat_status_histogram(spark, sf):
    return C.status_histogram(_method_a(spark, sf))


def sheets_by_differences(spark, sf):
    return C.sheets_with_most_differences(C.differences(_method_a(spark, sf), _method_b(spark, sf), tasks=_tasks(spark, sf)), 25)


def ground_truth_export(spark, sf):
    return C.truth_from_items(_method_a(spark, sf), _sheets(spark, sf)).where("expected <> ''")


def report_lines(spark, sf):
    a, b, truth, tasks = _method_a(spark, sf), _method_b(spark, sf), _truth(spark, sf), _tasks(spark, sf)
    accuracies = {"a": C.accuracy(a, truth), "b": C.accuracy(b, truth)}
    return C.report(C.agreement(a, b, tasks=tasks), accuracies, C.differences(a, b, truth, tasks=tasks), ("rule", "model"), 40)


def ground_truth_pivot(spark, sf):
    """Nested ground truth out of an extraction, its maps shown as text."""
    shown = lambda c: F.array_join(F.transform(F.filter(F.map_entries(c), lambda e: e.value.isNotNull()), lambda e: F.concat(e.key, F.lit("="), e.value)), ",").alias(c)
    n = sum((F.size(c) for c in C.SECTIONS[1:]), F.size(C.SECTIONS[0]))
    return C.truth_pivot(_method_a(spark, sf)).select("image_id", *[shown(c) for c in C.SECTIONS], n.alias("n_items"))


def ground_truth_unpivot(spark, sf):
    """There and back: the extraction's values as ground truth rows."""
    return C.truth_unpivot(C.truth_pivot(_method_b(spark, sf)), H.all_keys())


def last_row_wins(spark, sf):
    rows = B.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("image_id"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("line_no"), "l_quantity", "l_returnflag"
    )
    return C.last_wins(rows, "image_id", "line_no").select("image_id", "l_quantity", "l_returnflag")


ITEMS = BUBBLES + "," + relabel_sql("fill_score", 0.08, 0.025) + "," + decode_sql(False, 0.08, 0.025)
BOTH = BUBBLES + "," + KEYS_SQL + "," + A_SQL + "," + B_SQL + "," + TRUTH_SQL
SECTION_OF = "split_part(key, ':', 1)"
PAIRS = """, pr AS (SELECT ma.image_id, ma.key, ma.value AS va, mb.value AS vb, ma.status AS sa, mb.status AS sb FROM ma JOIN mb USING (image_id, key))"""
DIFF_SELECT = f"""SELECT image_id, {SECTION_OF} AS section, split_part(key, ':', 2) AS item_id, va AS method_a_value, sa AS method_a_status,
  vb AS method_b_value, sb AS method_b_status, expected, coalesce(CAST(va = expected AS VARCHAR), '') AS method_a_correct, coalesce(CAST(vb = expected AS VARCHAR), '') AS method_b_correct
FROM pr LEFT JOIN gt USING (image_id, key) WHERE va <> vb"""
SECTIONS_SQL = "(VALUES ('identity'), ('part1'), ('part2'), ('part3')) v(section)"


def _rolled(source: str, measures: str, finals: str) -> str:
    return f"""
, by_s AS (SELECT v.section, {measures} FROM {SECTIONS_SQL} LEFT JOIN ({source}) j ON j.section = v.section GROUP BY v.section
  UNION ALL SELECT 'overall', {measures} FROM ({source}) j)
SELECT section, {finals} FROM by_s"""


def _judged(m: str) -> str:
    return f"""SELECT {SECTION_OF} AS section, gt.image_id, gt.key, gt.expected, coalesce({m}.value, '') AS actual, coalesce({m}.need_review, false) AS need_review
  FROM gt JOIN (SELECT DISTINCT image_id FROM {m}) USING (image_id) LEFT JOIN {m} USING (image_id, key)"""


ACCURACY, ACCURACY_B = (_rolled(
    _judged(m),
    "count(j.key) AS total, count(*) FILTER (j.expected = j.actual) AS correct, count(*) FILTER (j.expected <> j.actual AND NOT j.need_review) AS false_accept",
    "total, correct, total - correct AS incorrect, CASE WHEN total > 0 THEN round(correct / total, 6) ELSE 0 END AS accuracy, false_accept, "
    "CASE WHEN total > 0 THEN round(false_accept / total, 6) ELSE 0 END AS false_accept_rate",
) for m in ("ma", "mb"))

def _rank_sql(line: str, block: int, source: str) -> str:
    return f"SELECT {block} AS block, CASE section WHEN 'overall' THEN 0 WHEN 'identity' THEN 1 WHEN 'part1' THEN 2 WHEN 'part2' THEN 3 ELSE 4 END AS place, {line} AS line FROM ({source})"


_NAME = "CASE section WHEN 'overall' THEN 'Overall' ELSE section END"
_METRIC = f"format('- {{}}: {{}}/{{}} ({{:.4f}}), false_accept {{}} ({{:.4f}})', {_NAME}, correct, total, CAST(accuracy AS DOUBLE), false_accept, CAST(false_accept_rate AS DOUBLE))"
AGREEMENT = _rolled(
    f"SELECT {SECTION_OF} AS section, * FROM pr",
    "count(j.key) AS total, count(*) FILTER (j.va = j.vb) AS same",
    "total, same, total - same AS different, CASE WHEN total > 0 THEN round(same / total, 6) ELSE 0 END AS same_rate",
)
_QUOTED = "chr(39) || {} || chr(39)"
REPORT = " UNION ALL ".join(
    [
        _rank_sql(f"format('- {{}}: same {{}}/{{}} ({{:.4f}}), different {{}}', {_NAME}, same, total, CAST(same_rate AS DOUBLE), different)", 1, f"WITH {BOTH}{PAIRS}{AGREEMENT}"),
        _rank_sql(_METRIC, 2, f"WITH {BOTH}{ACCURACY}"),
        _rank_sql(_METRIC, 3, f"WITH {BOTH}{ACCURACY_B}"),
        f"SELECT 4 AS block, row_number() OVER (ORDER BY image_id, section, item_id) AS place, '- `' || image_id || '` ' || section || ' ' || item_id || ': rule=' || {_QUOTED.format('method_a_value')} "
        f"|| ', model=' || {_QUOTED.format('method_b_value')} || coalesce(', gt=' || {_QUOTED.format('expected')}, '') AS line "
        f"FROM (SELECT * FROM (WITH {BOTH}{PAIRS} {DIFF_SELECT}) ORDER BY image_id, section, item_id LIMIT 40)",
    ]
)

QUERIES = {
    f.__name__: f
    for f in (
        ranked_relabel, identity_relabel, prelabel_threshold, record_score_coalesce, decode_choice_question, decode_generic_group, decode_handmade_group,
        alignment_gate_override, sheet_answer_rollup, item_status_histogram, identity_value_string, true_false_dense, short_answer_compact, confidence_summary,
        run_summary, flatten_items, pairwise_agreement, difference_listing, sample_differences, only_in_a, only_in_b, accuracy_false_accept, error_listing,
        flat_status_histogram, sheets_by_differences, ground_truth_export, ground_truth_pivot, ground_truth_unpivot, report_lines, last_row_wins,
    )
}

ORACLES = {
    "ranked_relabel": f"WITH {BUBBLES},{relabel_sql('fill_score', 0.08, 0.025)} SELECT image_id, item_id, spec_ord, prelabel, 'adaptive_rule_group' AS prelabel_source, "
    "round(gtop, 6) AS group_top_score, round(gsecond, 6) AS group_second_score, round(gtop - gsecond, 6) AS group_score_margin FROM r",
    "identity_relabel": "WITH " + BUBBLES + "," + relabel_sql("darkness_score", 0.07, 0.03, False, where="section = 'identity'")
    + " SELECT image_id, item_id, spec_ord, prelabel, round(gtop - gsecond, 6) AS group_score_margin, 'identity_ranked_score' AS group_relabel_source FROM r",
    "prelabel_threshold": f"WITH {BUBBLES} SELECT section, CASE WHEN darkness_score <= 0.02::DOUBLE THEN 'blank' WHEN darkness_score >= 0.06::DOUBLE THEN 'filled' ELSE 'ambiguous' END AS label, "
    "count(*) AS n FROM b GROUP BY ALL",
    "record_score_coalesce": f"WITH {BUBBLES} SELECT image_id, item_id, spec_ord, round(CASE WHEN spec_ord = 1 THEN darkness_score WHEN spec_ord = 2 THEN fill_score + 0.5::DOUBLE "
    "WHEN spec_ord < 5 THEN fill_score ELSE darkness_score END, 6) AS score FROM b",
    "decode_choice_question": f"WITH {BUBBLES},{relabel_sql('fill_score', 0.08, 0.025)},{decode_sql(True, 0.08, 0.025)} SELECT {ITEM_SQL} FROM f",
    "decode_generic_group": f"WITH {ITEMS} SELECT {ITEM_SQL} FROM f",
    "decode_handmade_group": f"WITH {BUBBLES},{decode_sql(False, 0.08, 0.025, src='b')} SELECT {ITEM_SQL} FROM f",
    "alignment_gate_override": f"WITH {ITEMS} SELECT image_id, item_id, rv AS needs_review, hd AS hard_failure FROM fg",
    "sheet_answer_rollup": f"""WITH {BUBBLES},{relabel_sql('fill_score', 0.08, 0.025)},{decode_sql(True, 0.08, 0.025)}
SELECT image_id, string_agg(item_id || '=' || coalesce(selected, ''), ',' ORDER BY item_id) AS answers,
  coalesce(string_agg(item_id || ':' || array_to_string(reasons, '+'), ',' ORDER BY item_id) FILTER (need_review), '') AS review_items,
  count(*) FILTER (status = 'accepted') AS n_accepted, count(*) FILTER (status = 'blank') AS n_blank, count(*) FILTER (status = 'multi_mark') AS n_multi_mark,
  count(*) FILTER (status = 'need_review') AS n_need_review, count(*) FILTER (need_review) AS n_review FROM f GROUP BY image_id""",
    "item_status_histogram": f"WITH {ITEMS} SELECT section || ':' || status AS key, count(*) AS n FROM f GROUP BY ALL",
    "identity_value_string": f"""WITH {ITEMS}, {SLOT_SQL}, d AS (SELECT im.image_id, n, selected, coalesce(status, 'blank') AS status, confidence
  FROM im CROSS JOIN range(1, 9) t(n) LEFT JOIN sl ON sl.image_id = im.image_id AND sl.slot = n)
SELECT image_id, 'sbd' AS field, string_agg(coalesce(selected, CASE WHEN status = 'blank' THEN '_' ELSE '?' END), '' ORDER BY n) AS value,
  CASE WHEN bool_and(status = 'accepted') THEN 'accepted' WHEN bool_or(status IN ('need_review', 'multi_mark')) THEN 'need_review' ELSE 'incomplete' END AS status,
  round(min(confidence), 6) AS confidence FROM d GROUP BY image_id""",
    "true_false_dense": f"""WITH {ITEMS}, {SLOT_SQL}
SELECT im.image_id, format('II_{{:03d}}_{{}}', q, chr(CAST(97 + s AS INTEGER))) AS item_id, selected, coalesce(status, 'blank') AS status, coalesce(need_review, false) AS need_review, confidence
FROM im CROSS JOIN range(1, 9) t(q) CROSS JOIN range(0, 4) u(s) LEFT JOIN sl ON sl.image_id = im.image_id AND sl.slot = 4 * (q - 1) + s + 1""",
    "short_answer_compact": f"""WITH {ITEMS}, {SLOT_SQL}, d AS (
  SELECT im.image_id, q, p, CASE WHEN status = 'accepted' THEN ascii(selected) - 65 END AS m, coalesce(status, 'blank') AS status, confidence
  FROM im CROSS JOIN range(1, 7) t(q) CROSS JOIN range(0, 6) u(p) LEFT JOIN sl ON sl.image_id = im.image_id AND sl.slot = 6 * (q - 1) + p + 1),
g AS (SELECT image_id, q, max(m) FILTER (p = 0) IS NOT NULL AS sign, max(m) FILTER (p = 1) % 5 + 1 AS comma,
  string_agg(coalesce(CAST(m % 10 AS VARCHAR), '_'), '' ORDER BY p) FILTER (p > 1) AS digits, bool_or(status IN ('need_review', 'multi_mark')) AS review,
  min(confidence) AS least, min(confidence) FILTER (status <> 'blank') AS marked FROM d GROUP BY image_id, q),
h AS (SELECT *, CASE WHEN sign THEN '-' ELSE '' END || CASE WHEN comma IS NULL THEN digits ELSE substr(digits, 1, least(4, comma)) || ',' || substr(digits, least(4, comma) + 1) END AS raw_value FROM g),
v AS (SELECT *, CASE WHEN replace(raw_value, '_', '') IN ('', '-', ',', '-,') THEN NULL ELSE replace(raw_value, '_', '') END AS value FROM h),
w AS (SELECT *, CASE WHEN review THEN 'need_review' WHEN value IS NULL THEN 'blank' ELSE 'accepted' END AS status FROM v)
SELECT image_id, format('III_{{:03d}}', q) AS question_id, value, raw_value, status, round(CASE WHEN status = 'blank' THEN least ELSE marked END, 6) AS confidence FROM w""",
    "confidence_summary": f"WITH {ITEMS},{SHEETS_SQL} SELECT image_id, local_status, grid_status, sheet_status, alignment_confidence, grid_confidence, decoded_item_confidence, "
    "review_item_count, sheet_confidence, auto_pass FROM su",
    "run_summary": f"""WITH {ITEMS},{SHEETS_SQL} SELECT count(*) AS total, count(*) FILTER (sheet_status = 'ok') AS ok, count(*) FILTER (sheet_status <> 'ok') AS error,
  count(*) FILTER (sheet_status = 'ok' AND auto_pass) AS auto_pass, CAST(coalesce(sum(review_item_count) FILTER (sheet_status = 'ok'), 0) AS BIGINT) AS review_item_count,
  round(min(sheet_confidence) FILTER (sheet_status = 'ok'), 6) AS min_sheet_confidence, round(avg(sheet_confidence) FILTER (sheet_status = 'ok'), 6) AS avg_sheet_confidence FROM su""",
    "flatten_items": f"WITH {BUBBLES},{KEYS_SQL},{A_SQL} SELECT image_id, key, value, status, need_review FROM ma",
    "pairwise_agreement": f"WITH {BOTH}{PAIRS}"
    + _rolled(
        f"SELECT {SECTION_OF} AS section, * FROM pr",
        "count(j.key) AS total, count(*) FILTER (j.va = j.vb) AS same",
        "total, same, total - same AS different, CASE WHEN total > 0 THEN round(same / total, 6) ELSE 0 END AS same_rate",
    ),
    "difference_listing": f"WITH {BOTH}{PAIRS} {DIFF_SELECT}",
    "sample_differences": f"WITH {BOTH}{PAIRS} {DIFF_SELECT} ORDER BY image_id, key LIMIT 200",
    "only_in_a": f"WITH {BOTH} SELECT DISTINCT image_id FROM ma WHERE image_id NOT IN (SELECT image_id FROM mb)",
    "only_in_b": f"WITH {BOTH} SELECT DISTINCT image_id FROM mb WHERE image_id NOT IN (SELECT image_id FROM ma)",
    "accuracy_false_accept": f"WITH {BOTH}{ACCURACY}",
    "error_listing": f"""WITH {BOTH} SELECT gt.image_id, {SECTION_OF} AS section, split_part(key, ':', 2) AS item_id, expected, coalesce(mb.value, '') AS actual, mb.status,
  coalesce(mb.need_review, false) AS need_review FROM gt JOIN (SELECT DISTINCT image_id FROM mb) USING (image_id) LEFT JOIN mb USING (image_id, key) WHERE expected <> coalesce(mb.value, '')""",
    "flat_status_histogram": f"WITH {BOTH} SELECT status, count(*) AS n FROM ma WHERE coalesce(status, '') <> '' GROUP BY status",
    "sheets_by_differences": f"WITH {BOTH}{PAIRS} SELECT image_id, count(*) AS n_differences FROM pr WHERE va <> vb GROUP BY image_id ORDER BY n_differences DESC, image_id LIMIT 25",
    "ground_truth_export": f"WITH {ITEMS},{SHEETS_SQL},{KEYS_SQL},{A_SQL} SELECT ma.image_id, key, value AS expected FROM ma JOIN su ON su.image_id = ma.image_id AND sheet_status = 'ok' WHERE value <> ''",
    "report_lines": REPORT,
    "ground_truth_pivot": f"""WITH {BUBBLES},{KEYS_SQL},{A_SQL}, kv AS (SELECT image_id, {SECTION_OF} AS section, split_part(key, ':', 2) AS item, nullif(value, '') AS value FROM ma)
SELECT image_id, {", ".join(f"coalesce(string_agg(item || '=' || value, ',' ORDER BY item) FILTER (section = '{s}' AND value IS NOT NULL), '') AS {s}" for s in C.SECTIONS)}, CAST(count(*) AS INTEGER) AS n_items FROM kv GROUP BY image_id""",
    "ground_truth_unpivot": f"WITH {BUBBLES},{KEYS_SQL},{B_SQL} SELECT image_id, key, value AS expected FROM mb",
    "last_row_wins": "SELECT l_partkey AS image_id, arg_max(l_quantity, (l_orderkey, l_linenumber, l_suppkey)) AS l_quantity, "
    "arg_max(l_returnflag, (l_orderkey, l_linenumber, l_suppkey)) AS l_returnflag FROM lineitem GROUP BY l_partkey",
}
