"""Facts of relabelling and decoding, on hand-made bubbles."""

import pytest
from pyspark.sql import functions as F

from sheetmill.functions import scalars as S
from sheetmill.operators import decode as D
from sheetmill.operators import ranking as R

SCHEMA = (
    "image_id string, item_id string, spec_ord int, choice string, prelabel string, darkness_score double, alignment_status string, "
    "grid_refinement_status string, grid_refinement_decode_allowed boolean, group_margin_threshold double"
)


def rows(spark, *bubbles, **more):
    data = []
    for k, (choice, label, score) in enumerate(bubbles):
        extra = more.get("per", {}).get(choice, {})
        get = lambda name: extra.get(name, more.get(name))
        data.append(("s", "I_001", k + 1, choice, label, score, get("alignment_status"), get("grid_refinement_status"), get("grid_refinement_decode_allowed"), get("group_margin_threshold")))
    return spark.createDataFrame(data, SCHEMA)


ACCEPT = [("A", "filled", 0.2), ("B", "blank", 0.01), ("C", "blank", 0.02), ("D", "blank", 0.03)]


def question(df):
    (r,) = D.decode_questions(df).collect()
    return r


def test_accepted(spark):
    r = question(rows(spark, *ACCEPT))
    assert (r.selected, r.status, r.score_margin, r.confidence, r.review_reasons) == ("A", "accepted", 0.17, 1.0, [])


def test_low_confidence(spark):
    r = question(rows(spark, ("A", "filled", 0.2), ("B", "blank", 0.19), ("C", "blank", 0.01), ("D", "blank", 0.01), group_margin_threshold=0.025))
    assert (r.selected, r.status, r.review_reasons) == ("A", "need_review", ["low_confidence"])


def test_multi_mark(spark):
    r = question(rows(spark, ("A", "filled", 0.2), ("B", "filled", 0.19), ("C", "blank", 0.02), ("D", "blank", 0.03)))
    assert (r.selected, r.status) == (None, "multi_mark")
    (g,) = D.decode_groups(rows(spark, ("A", "filled", 0.2), ("B", "filled", 0.19), ("C", "blank", 0.02))).collect()
    assert (g.selected, g.status) == ("A", "multi_mark")


def test_alignment_gates(spark):
    r = question(rows(spark, *ACCEPT, per={"A": {"alignment_status": "fallback_translation"}}))
    assert (r.selected, r.status, r.review_reasons) == ("A", "need_review", ["alignment_failed"])
    r = question(rows(spark, *ACCEPT, per={"A": {"grid_refinement_status": "alignment_failed", "grid_refinement_decode_allowed": False}}))
    assert (r.selected, r.status) == (None, "need_review")
    r = question(rows(spark, *ACCEPT, alignment_status="fallback_global", grid_refinement_status="ok"))
    assert (r.selected, r.status) == ("A", "accepted")


def test_incomplete_and_ambiguous(spark):
    r = question(rows(spark, ("A", "filled", 0.2), ("B", "ambiguous", 0.05)))
    assert r.review_reasons == ["incomplete_choices", "ambiguous_bubble"] and r.selected == "A"
    (g,) = D.decode_groups(rows(spark, ("A", "filled", 0.2), ("B", "ambiguous", 0.05))).collect()
    assert g.status == "accepted"
    (g,) = D.decode_groups(rows(spark, ("A", "blank", 0.02), ("B", "blank", 0.04))).collect()
    assert (g.status, g.confidence) == ("blank", 0.5)


def relabel(spark, scores, filled=0.9, margin=0.1, **more):
    df = spark.createDataFrame([("s", "q", k + 1, float(v) if v is not None else None) for k, v in enumerate(scores)], "image_id string, item_id string, spec_ord int, filled_probability double")
    df = df.withColumns({"prelabel": F.lit("x"), "prelabel_source": F.lit("adaptive_rule")})
    return R.relabel_by_rank(df, score="filled_probability", filled_threshold=filled, margin_threshold=margin, **more).orderBy("spec_ord").collect()


@pytest.mark.parametrize(
    ("scores", "want"),
    [
        ([0.98, 0.12], ["filled", "blank"]),
        ([0.89, 0.20], ["blank", "blank"]),
        ([0.96, 0.91, 0.10], ["ambiguous", "ambiguous", "blank"]),
        ([0.95], ["filled"]),
        ([None, None], ["blank", "blank"]),
        ([0.95, 0.95], ["ambiguous", "ambiguous"]),
    ],
)
def test_relabel(spark, scores, want):
    got = relabel(spark, scores)
    assert [r.prelabel for r in got] == want and {r.prelabel_source for r in got} == {"adaptive_rule_group"}
    if scores == [0.98, 0.12]:
        assert got[0].group_score_margin == 0.86


def test_lone_bubble_of_an_identity_column(spark):
    assert [r.prelabel for r in relabel(spark, [0.95], filled=0.07, margin=0.99, lone_is_clear=False)] == ["ambiguous"]
    assert [r.prelabel for r in relabel(spark, [0.95], filled=0.07, margin=0.99)] == ["filled"]


def test_ties_go_to_the_first_spec(spark):
    assert [r.prelabel for r in relabel(spark, [0.95, 0.95], margin=0.0)] == ["filled", "blank"]


def test_states_and_paths(spark):
    df = rows(spark, *ACCEPT).withColumn("crop_path", F.lit("/out/old/name.png")).withColumn("section", F.lit("part1"))
    (r,) = D.item_states(df).collect()
    assert set(r.states) == set("ABCD") and r.states["A"].darkness_score == 0.2
    assert {x.crop_path for x in R.rehome_crops(df, "out").collect()} == {"out/part1/filled/name.png", "out/part1/blank/name.png"}


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_scalars(spark):
    lit = F.lit
    r = one(
        spark,
        S.prelabel(lit(0.025)), S.prelabel(lit(0.08)), S.prelabel(lit(0.05)), S.choice_rank(lit("after_2")), S.choice_rank(lit("7")), S.choice_rank(lit("Z")), S.letter_rank(lit("C")), S.letter_rank(lit("Q")),
        S.image_id(lit("/root/a b/c-1.v2.png"), "/root"), S.image_id(lit("/else/c.png"), "/root"), S.image_id(lit("/root/--"), "/root"), S.safe_name(lit("ä b/c")),
    )
    assert list(r) == ["blank", "filled", "ambiguous", 2, 7, 99, 2, 4, "a_b_c_1_v2", "c", "sheet", "ä_b_c"]
    digits = F.array(lit("1"), lit("2"), lit(None), lit(None))
    raw, value = S.compact_value(lit("-"), lit("after_1"), digits)
    none = F.array(*[lit(None).cast("string")] * 4)
    empty, gone = S.compact_value(lit("-"), lit(None).cast("string"), none)
    r = one(spark, raw, value, empty, gone, F.array_join(S.value_choices(lit("part3"), lit("-1,2")), "|"), S.safe_double(lit("x"), 3.0), S.hash_split(lit("img")))
    assert list(r)[:6] == ["-1,2__", "-1,2", "-____", None, "-|after_2|1|2".replace("-|after_2|1|2", "-|1|after_2|2"), 3.0] and r[6] in ("train", "val", "test")
