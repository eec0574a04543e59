"""Sections, sheets and comparisons on hand-made items."""

import re

import pytest
from pyspark.sql import functions as F

from sheetmill.operators import compare as C
from sheetmill.operators import sheets as H

ITEM = "image_id string, item_id string, selected string, status string, need_review boolean, confidence double, review_reasons array<string>"


def items(spark, *rows):
    return spark.createDataFrame([("s", i, sel, st, st in ("need_review", "multi_mark"), c, []) for i, sel, st, c in rows], ITEM)


def test_identity_value(spark):
    df = items(spark, ("sbd_01", "3", "accepted", 0.9), ("sbd_02", "7", "accepted", 0.8))
    (r,) = H.identity_values(df, df, "sbd", 3).collect()
    assert (r.value, r.status, r.confidence) == ("37_", "incomplete", 0.8)
    df = items(spark, ("sbd_01", None, "multi_mark", 0.1))
    (r,) = H.identity_values(df, df, "sbd", 2).collect()
    assert (r.value, r.status) == ("?_", "need_review")


def test_fixed_slots(spark):
    df = items(spark, ("II_001_a", "F", "accepted", 1.0))
    got = {r.item_id: (r.selected, r.status) for r in H.true_false_answers(df, df).collect()}
    assert len(got) == 32 and got["II_001_a"] == ("F", "accepted") and got["II_008_d"] == (None, "blank")
    df = items(spark, ("III_001_sign", "-", "accepted", 0.9), ("III_001_comma", "after_1", "accepted", 0.8), ("III_001_digit_1", "1", "accepted", 0.7), ("III_001_digit_2", "2", "accepted", 0.95))
    got = {r.question_id: r for r in H.short_answers(df, df).collect()}
    assert len(got) == 6 and (got["III_001"].raw_value, got["III_001"].value, got["III_001"].status, got["III_001"].confidence) == ("-1,2__", "-1,2", "accepted", 0.7)
    assert (got["III_002"].value, got["III_002"].status) == (None, "blank")
    assert H.domain(df, H.all_keys(), "key").count() == 80


def test_rollups(spark):
    def of(kind, *statuses):
        df = spark.createDataFrame([(s,) for s in statuses], "s string")
        return df.agg(kind(F.col("s")).alias("r")).first().r

    assert of(H.alignment_rollup, "ok", "fallback_global") == "degraded" and of(H.alignment_rollup, "ok", "alignment_failed") == "need_review" and of(H.alignment_rollup, "ok") == "ok"
    assert of(H.grid_rollup, None) == "skipped" and of(H.grid_rollup, "ok", "ok") == "ok" and of(H.grid_rollup, "ok", "skipped") == "need_review" and of(H.grid_rollup, "skipped") == "skipped"
    lit = lambda x: F.lit(x).cast("string")
    r = spark.range(1).select(H.sheet_status(lit("ok"), lit("x"), lit("x")).alias("a"), H.sheet_status(lit("skipped"), lit("ok"), lit("ok")).alias("b"), H.sheet_status(lit(None), lit("ok"), lit(None)).alias("c"), H.sheet_status(lit(None), lit("ok"), lit("degraded")).alias("d")).first()
    assert list(r) == ["ok", "need_review", "ok", "need_review"]


def test_compare(spark):
    schema = "image_id string, key string, value string, status string, need_review boolean"
    a = spark.createDataFrame([("1", "part1:I_001", "A", "accepted", False), ("1", "part1:I_002", "", "blank", False), ("2", "part1:I_001", "B", "accepted", False)], schema)
    b = spark.createDataFrame([("1", "part1:I_001", "A", "accepted", False), ("1", "part1:I_002", "C", "accepted", False), ("3", "part1:I_001", "B", "accepted", False)], schema)
    truth = spark.createDataFrame([("1", "part1:I_001", "A"), ("1", "part1:I_002", "C"), ("9", "part1:I_001", "A")], "image_id string, key string, expected string")
    got = {r.section: (r.total, r.same, r.same_rate) for r in C.agreement(a, b).collect()}
    assert got["overall"] == (2, 1, 0.5) == got["part1"] and got["part2"] == (0, 0, 0.0)
    (d,) = C.differences(a, b, truth).collect()
    assert (d.item_id, d.method_a_correct, d.method_b_correct) == ("I_002", False, True)
    acc = {r.section: r for r in C.accuracy(a, truth).collect()}
    assert (acc["overall"].total, acc["overall"].correct, acc["overall"].false_accept, acc["part3"].accuracy) == (2, 1, 1, 0.0)
    assert [r.image_id for r in C.only_in(a, b).collect()] == ["2"]
    assert C.errors(a, truth).count() == 1
    rows = spark.createDataFrame([("x", 1, "old"), ("x", 2, "new"), ("", 3, "gone"), (None, 4, "gone")], "image_id string, line int, v string")
    assert [(r.image_id, r.v) for r in C.last_wins(rows, "image_id", "line").collect()] == [("x", "new")]


def test_tasks_grow_with_the_lines(spark, monkeypatch):
    from sheetmill.plans import bindings as B

    monkeypatch.setattr(B, "TASK_ROWS", 500, raising=False)
    rows = B.bubbles(spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= rows.count() / 500


def test_a_comparison_has_the_tasks_it_is_given(spark):
    from sheetmill.operators import compare as C

    rows = spark.createDataFrame([(k, "part1:I_001", "A", "accepted") for k in range(40)], "image_id long, key string, value string, status string")
    found = C.pairs(rows, rows, 7)
    assert found.rdd.getNumPartitions() == 7 and found.count() == 40


def test_masks_are_dealt_by_their_pixels(spark, monkeypatch):
    from sheetmill.plans import bindings as B
    from sheetmill.plans import detail_queries as D

    monkeypatch.setattr(B, "TASK_ROWS", 640, raising=False)
    found = D.layout_masks(spark, "/root/testdata/sf0.001")
    n = B.table(spark, "/root/testdata/sf0.001", "embeddings").count()
    assert f", {-(-n * 64 // 640)}), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", "decode_generic_group flat_status_histogram flatten_items ground_truth_pivot ground_truth_unpivot identity_value_string only_in_a only_in_b sheet_answer_rollup true_false_dense item_status_histogram ranked_relabel error_listing".split())
def test_queries_on_bubbles_deal_their_lines(spark, monkeypatch, query):
    from sheetmill.plans import bindings as B
    from sheetmill.plans import catalog

    monkeypatch.setattr(B, "TASK_ROWS", 500, raising=False)
    sf = "/root/testdata/sf0.001"
    n = -(-B.table(spark, sf, "lineitem").count() // 500)
    plan = catalog.QUERIES[query](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"hashpartitioning\(l_orderkey#\d+L?, {n}\), REPARTITION_BY_NUM", plan)


@pytest.mark.parametrize("query", "decode_generic_group flat_status_histogram flatten_items ground_truth_pivot ground_truth_unpivot identity_value_string only_in_a sheet_answer_rollup item_status_histogram ranked_relabel error_listing".split())
def test_queries_on_bubbles_broadcast_no_table(spark, query):
    from sheetmill.plans import catalog

    plan = catalog.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_the_errors_that_are_written_broadcast_no_table(spark, monkeypatch):
    from sheetmill.plans import file_queries as Q

    plans, write = [], Q.O.write_csv
    monkeypatch.setattr(Q.O, "write_csv", lambda rows, *a: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), write(rows, *a)))
    Q.csv_errors_file(spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and "BroadcastExchange" not in plans[0]
