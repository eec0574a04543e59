"""From decoded items to sections and sheets.

Sections II and III and the identity fields have fixed slots, so items that are missing count as blank.
Decoded items come as ``image_id, item_id, selected, status, need_review, confidence`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import compact_value, item_key, normalized

REVIEW = ("need_review", "multi_mark")


def domain(images: DataFrame, items: Column, name: str = "item_id") -> DataFrame:
    """Each image with each of a fixed list of items."""
    return images.select("image_id").distinct().select("image_id", F.explode(items).alias(name))


def ids(pattern: str, *ranges: list) -> Column:
    """A literal list of ids from a format pattern and the values that fill it, the last fastest."""
    names = [()]
    for values in ranges:
        names = [(*n, v) for n in names for v in values]
    return F.array(*[F.lit(pattern % n) for n in names])


def histogram(status: Column) -> Column:
    """``status:count`` pairs in the order of their names, as text."""
    entries = F.array_sort(F.collect_list(status))
    return F.array_join(
        F.transform(F.array_distinct(entries), lambda s: F.concat(s, F.lit(":"), F.size(F.filter(entries, lambda x: x == s)).cast("string"))), ","
    )


def dense(items: DataFrame, images: DataFrame, wanted: Column) -> DataFrame:
    """Items of the list ``wanted`` for each image; a missing one is blank with unknown confidence."""
    return (
        domain(images, wanted)
        .join(items.select("image_id", "item_id", "selected", "status", "need_review", "confidence"), ["image_id", "item_id"], "left")
        .select(
            "image_id",
            "item_id",
            "selected",
            F.coalesce("status", F.lit("blank")).alias("status"),
            F.coalesce("need_review", F.lit(False)).alias("need_review"),
            "confidence",
        )
    )


def answer_sheets(items: DataFrame) -> DataFrame:
    """Part I by sheet: answers, review items and counts of statuses, by question."""
    answer = F.struct("item_id", "selected", "status", "confidence")
    return items.groupBy("image_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("item_id", answer.alias("answer"))))).alias("answers"),
        F.array_sort(F.collect_list(F.when(F.col("need_review"), F.struct("item_id", "selected", "review_reasons")))).alias("review_items"),
        F.count(F.when(F.col("status") == "accepted", 1)).alias("n_accepted"),
        F.count(F.when(F.col("status") == "blank", 1)).alias("n_blank"),
        F.count(F.when(F.col("status") == "multi_mark", 1)).alias("n_multi_mark"),
        F.count(F.when(F.col("status") == "need_review", 1)).alias("n_need_review"),
        F.count(F.when(F.col("need_review"), 1)).alias("n_review"),
    )


def identity_values(items: DataFrame, images: DataFrame, field: str, digits: int) -> DataFrame:
    """A field's value from its digit columns: ``_`` for a blank one, ``?`` for one in doubt."""
    slots = dense(items, images, ids(f"{field}_%02d", list(range(1, digits + 1))))
    shown = F.coalesce("selected", F.when(F.col("status") == "blank", "_").otherwise("?"))
    return slots.groupBy("image_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", shown.alias("c")))), lambda x: x.c), "").alias("value"),
        F.when(F.bool_and(F.col("status") == "accepted"), "accepted")
        .when(F.bool_or(F.col("status").isin(*REVIEW)), "need_review")
        .otherwise("incomplete")
        .alias("status"),
        F.round(F.min("confidence"), 6).alias("confidence"),
    ).select("image_id", F.lit(field).alias("field"), "value", "status", "confidence")


def true_false_answers(items: DataFrame, images: DataFrame) -> DataFrame:
    """Part II: eight questions of four statements."""
    return dense(items, images, ids("II_%03d_%s", list(range(1, 9)), list("abcd")))


def short_answers(items: DataFrame, images: DataFrame) -> DataFrame:
    """Part III: six signed decimals of a sign, a comma and four digits; parts count once accepted."""
    parts = ["sign", "comma", *[f"digit_{k}" for k in range(1, 5)]]
    rows = dense(items, images, ids("III_%03d_%s", list(range(1, 7)), parts)).withColumn("question_id", F.substring("item_id", 1, 7))
    part = lambda p: F.max(F.when((F.col("item_id").endswith("_" + p)) & (F.col("status") == "accepted"), F.col("selected")))
    found = rows.groupBy("image_id", "question_id").agg(
        *[part(p).alias(p) for p in parts],
        F.bool_or(F.col("status").isin(*REVIEW)).alias("review"),
        F.min("confidence").alias("least"),
        F.min(F.when(F.col("status") != "blank", F.col("confidence"))).alias("least_marked"),
    )
    raw, value = compact_value(F.col("sign"), F.col("comma"), F.array(*[F.col(p) for p in parts[2:]]))
    status = F.when(F.col("review"), "need_review").when(value.isNull(), "blank").otherwise("accepted")
    return found.select(
        "image_id",
        "question_id",
        value.alias("value"),
        raw.alias("raw_value"),
        status.alias("status"),
        F.round(F.when(status == "blank", F.col("least")).otherwise(F.col("least_marked")), 6).alias("confidence"),
    )


def alignment_rollup(status: Column) -> Column:
    """Status of a sheet from those of its aligned blocks (an aggregate)."""
    return (
        F.when(F.bool_or(status == "alignment_failed"), "need_review").when(F.bool_or(status.startswith("fallback")), "degraded").otherwise("ok")
    )


def grid_rollup(status: Column) -> Column:
    """Status of a sheet from those of its refined grids (an aggregate); no grid at all is skipped."""
    return (
        F.when(F.count(status) == 0, "skipped")
        .when(F.bool_and(status == "ok"), "ok")
        .when(F.bool_and(status == "skipped"), "skipped")
        .otherwise("need_review")
    )


def sheet_status(grid: Column, warp: Column, local: Column) -> Column:
    """The grid decides if known; else warp and local alignment must both be ok or unknown."""
    fine = (F.coalesce(warp, F.lit("ok")) == "ok") & (F.coalesce(local, F.lit("ok")) == "ok")
    return F.when(grid.isNotNull(), F.when(grid == "ok", "ok").otherwise("need_review")).otherwise(F.when(fine, "ok").otherwise("need_review"))


def review_count(status: Column, section: Column, strict: bool = True) -> Column:
    """Items that a person must see (an aggregate); of identity fields those not accepted, an unknown
    status only if ``strict``."""
    identity = F.coalesce(status != "accepted", F.lit(strict))
    return F.count(F.when(F.when(section == "identity", identity).otherwise(status.isin(*REVIEW)), 1))


def confidence_summary(sheets: DataFrame) -> DataFrame:
    """``sheet_confidence`` and ``auto_pass`` from a sheet's partial confidences and review count."""
    return sheets.withColumns(
        {
            "sheet_confidence": F.round(F.least("alignment_confidence", "grid_confidence", "decoded_item_confidence"), 6),
            "auto_pass": (F.col("sheet_status") == "ok") & (F.col("review_item_count") == 0),
        }
    )


def run_summary(sheets: DataFrame) -> DataFrame:
    """One row about a run; every sheet that is not ok counts as an error."""
    ok = F.col("sheet_status") == "ok"
    return sheets.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(ok, 1)).alias("ok"),
        F.count(F.when(~ok, 1)).alias("error"),
        F.count(F.when(ok & F.col("auto_pass"), 1)).alias("auto_pass"),
        F.coalesce(F.sum(F.when(ok, F.col("review_item_count"))), F.lit(0)).alias("review_item_count"),
        F.round(F.min(F.when(ok, F.col("sheet_confidence"))), 6).alias("min_sheet_confidence"),
        F.round(F.avg(F.when(ok, F.col("sheet_confidence"))), 6).alias("avg_sheet_confidence"),
    )


def flat_items(rows: DataFrame, wanted: Column) -> DataFrame:
    """The comparable form of an extraction: each image with all keys ``section:item``, its value never null.

    ``rows``: ``image_id, section, item_id, value, status, need_review``, a key at most once an image; an image
    gathers its own few items, which are then looked up key by key, so rows are read and dealt once."""
    entry = F.struct(item_key(F.col("section"), F.col("item_id")).alias("key"), F.struct("value", "status", "need_review").alias("item"))
    found = rows.groupBy("image_id").agg(F.map_from_entries(F.collect_list(entry)).alias("items"))
    keyed = found.select("image_id", "items", F.explode(wanted).alias("key")).withColumn("item", F.element_at("items", F.col("key")))
    return keyed.select("image_id", "key", normalized(F.col("item.value")).alias("value"), F.col("item.status").alias("status"), F.coalesce("item.need_review", F.lit(False)).alias("need_review"))


#: The 80 keys of a sheet.
def all_keys() -> Column:
    return F.concat(
        ids("identity:%s", ["sbd", "exam_code"]),
        ids("part1:I_%03d", list(range(1, 41))),
        ids("part2:II_%03d_%s", list(range(1, 9)), list("abcd")),
        ids("part3:III_%03d", list(range(1, 7))),
    )


def decode_sections(items: DataFrame, images: DataFrame) -> DataFrame:
    """``image_id, section, item_id, value, status, confidence``: decoded items of the identity fields, part II
    and part III, each by its section's rules.  ``items`` has a ``section``."""
    of = lambda s: items.where(F.col("section") == s)
    columns = lambda section, item, value: ["image_id", F.lit(section).alias("section"), F.col(item).alias("item_id"), F.col(value).alias("value"), "status", "confidence"]
    return (
        identity_values(of("identity"), images, "sbd", 8).select(*columns("identity", "field", "value"))
        .union(identity_values(of("identity"), images, "exam_code", 4).select(*columns("identity", "field", "value")))
        .union(true_false_answers(of("part2"), images).select(*columns("part2", "item_id", "selected")))
        .union(short_answers(of("part3"), images).select(*columns("part3", "question_id", "value")))
    )
