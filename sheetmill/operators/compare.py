"""Comparison of extractions with each other and with ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import item_of, normalized, rate, section_of

SECTIONS = ("identity", "part1", "part2", "part3")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last by ``order``; null and empty keys go.  A partial aggregate, so a
    key of very many rows is no hot group."""
    others = [c for c in rows.columns if c != key]
    return (
        rows.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
        .groupBy(key)
        .agg(F.max_by(F.struct(*others), order).alias("_row"))
        .select(key, "_row.*")
    )


def only_in(a: DataFrame, b: DataFrame, key: str = "image_id") -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def _by_section(rows: DataFrame, sections: Sequence[str], **sums) -> DataFrame:
    """Sums overall and for each section, whether it has rows or not, in one pass over the rows."""
    known = rows.withColumn("section", section_of(F.col("key"))).where(F.col("section").isin(*sections))
    found = known.groupingSets([["section"], []], "section").agg(*[v.alias(k) for k, v in sums.items()])
    found = found.withColumn("section", F.coalesce("section", F.lit("overall")))
    every = rows.sparkSession.createDataFrame([(s,) for s in (*sections, "overall")], "section string")
    # A row a section: small by construction.
    return every.join(F.broadcast(found), "section", "left").select("section", *[F.coalesce(F.col(k), F.lit(0)).alias(k) for k in sums])


def pairs(a: DataFrame, b: DataFrame, tasks: int | None = None) -> DataFrame:
    """Items of the images that both extractions have, key by key.

    Each extraction is read once: dealt by image, items meet in an aggregate by image and key, and a
    window over the image (at most a sheet's keys) tells whether both sides are there.  ``tasks``: how many share
    the images (Spark's choice if unknown, which goes by the size of compressed rows and takes few)."""
    none = F.lit(None).cast("string")
    left = a.select("image_id", "key", F.col("value").alias("value_a"), F.col("status").alias("status_a"), none.alias("value_b"), none.alias("status_b"), F.lit(1).alias("side"))
    right = b.select("image_id", "key", none, none, F.col("value"), F.col("status"), F.lit(2))
    return (
        left.union(right)
        .repartition(*([tasks] if tasks else []), "image_id")
        .groupBy("image_id", "key")
        .agg(*[F.max(c).alias(c) for c in ("value_a", "status_a", "value_b", "status_b")], F.bit_or("side").alias("side"))
        .withColumn("sides", F.bit_or("side").over(Window.partitionBy("image_id")))
        .where("sides = 3")
        .select("image_id", "key", normalized(F.col("value_a")).alias("value_a"), "status_a", normalized(F.col("value_b")).alias("value_b"), "status_b")
    )


def agreement(a: DataFrame, b: DataFrame, sections: Sequence[str] = SECTIONS, tasks: int | None = None) -> DataFrame:
    """How often two extractions agree, overall and by section."""
    same = F.count(F.when(F.col("value_a") == F.col("value_b"), 1))
    return _by_section(pairs(a, b, tasks), sections, total=F.count(F.lit(1)), same=same).select(
        "section", "total", "same", (F.col("total") - F.col("same")).alias("different"), rate(F.col("same"), F.col("total")).alias("same_rate")
    )


def differences(a: DataFrame, b: DataFrame, truth: DataFrame | None = None, most: int = 0, tasks: int | None = None) -> DataFrame:
    """Items on which two extractions differ, by image and key; the first ``most`` if that is not 0.

    ``truth``: ``image_id, key, expected``."""
    rows = pairs(a, b, tasks).where("value_a <> value_b")
    if truth is not None:
        rows = rows.join(truth.select("image_id", "key", "expected"), ["image_id", "key"], "left")
    else:
        rows = rows.withColumn("expected", F.lit(None).cast("string"))
    out = rows.select(
        "image_id",
        section_of(F.col("key")).alias("section"),
        item_of(F.col("key")).alias("item_id"),
        F.col("value_a").alias("method_a_value"),
        F.col("status_a").alias("method_a_status"),
        F.col("value_b").alias("method_b_value"),
        F.col("status_b").alias("method_b_status"),
        "expected",
        (F.col("value_a") == F.col("expected")).alias("method_a_correct"),
        (F.col("value_b") == F.col("expected")).alias("method_b_correct"),
        "key",
    )
    return (out.orderBy("image_id", "key").limit(most) if most else out).drop("key")


def judged(flat: DataFrame, truth: DataFrame) -> DataFrame:
    """Every item of the truth's images that were extracted, right or wrong."""
    known = truth.join(flat.select("image_id").distinct(), "image_id", "left_semi")
    return known.join(flat, ["image_id", "key"], "left").select(
        "image_id",
        "key",
        normalized(F.col("expected")).alias("expected"),
        normalized(F.col("value")).alias("actual"),
        "status",
        F.coalesce("need_review", F.lit(False)).alias("need_review"),
        (normalized(F.col("expected")) == normalized(F.col("value"))).alias("correct"),
    )


def accuracy(flat: DataFrame, truth: DataFrame, sections: Sequence[str] = SECTIONS) -> DataFrame:
    """Accuracy and wrong answers that nobody would review, overall and by section."""
    wrong_unseen = F.count(F.when(~F.col("correct") & ~F.col("need_review"), 1))
    return _by_section(
        judged(flat, truth), sections, total=F.count(F.lit(1)), correct=F.count(F.when(F.col("correct"), 1)), false_accept=wrong_unseen
    ).select(
        "section",
        "total",
        "correct",
        (F.col("total") - F.col("correct")).alias("incorrect"),
        rate(F.col("correct"), F.col("total")).alias("accuracy"),
        "false_accept",
        rate(F.col("false_accept"), F.col("total")).alias("false_accept_rate"),
    )


def errors(flat: DataFrame, truth: DataFrame) -> DataFrame:
    return judged(flat, truth).where("not correct").select(
        "image_id", section_of(F.col("key")).alias("section"), item_of(F.col("key")).alias("item_id"), "expected", "actual", "status", "need_review"
    )


def status_histogram(flat: DataFrame) -> DataFrame:
    return flat.where(F.coalesce("status", F.lit("")) != "").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def sheets_with_most_differences(found: DataFrame, most: int = 0) -> DataFrame:
    """Sheets by their number of differences, then id."""
    counted = found.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_differences")).orderBy(F.desc("n_differences"), "image_id")
    return counted.limit(most) if most else counted


def truth_from_items(flat: DataFrame, sheet_status: DataFrame) -> DataFrame:
    """Ground truth out of a checked extraction: only sheets that are ok."""
    good = sheet_status.where("sheet_status = 'ok'").select("image_id")
    return flat.join(good, "image_id", "left_semi").select("image_id", "key", F.col("value").alias("expected"))


def metric_line(name: str = "section") -> F.Column:
    """A method's accuracy as a line of the report; the overall line has a capital."""
    return F.format_string(
        "- %s: %d/%d (%.4f), false_accept %d (%.4f)", _shown(name), "correct", "total", F.col("accuracy").cast("double"), "false_accept", F.col("false_accept_rate").cast("double")
    )


def pair_line(name: str = "section") -> F.Column:
    return F.format_string("- %s: same %d/%d (%.4f), different %d", _shown(name), "same", "total", F.col("same_rate").cast("double"), "different")


def _shown(name: str) -> F.Column:
    return F.when(F.col(name) == "overall", "Overall").otherwise(F.col(name))


def difference_line(label_a: str, label_b: str) -> F.Column:
    """A difference as a line of the report, with the expected value where it is known."""
    return F.concat(
        F.format_string(f"- `%s` %s %s: {label_a}='%s', {label_b}='%s'", F.col("image_id").cast("string"), "section", "item_id", "method_a_value", "method_b_value"),
        F.when(F.col("expected").isNotNull(), F.format_string(", gt='%s'", "expected")).otherwise(""),
    )


def report(pairwise: DataFrame, accuracies: dict[str, DataFrame], found: DataFrame, labels: tuple[str, str], most: int) -> DataFrame:
    """``block, place, line``: the parts of a comparison's report, each line once, in order by block and place.

    ``pairwise`` from ``agreement``, ``accuracies`` by method from ``accuracy``, ``found`` from ``differences``, of
    which the first ``most`` are listed.  All inputs but ``found`` have a row a section."""
    rank = F.when(F.col("section") == "overall", 0).otherwise(F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))).cast("long")
    lines = pairwise.select(F.lit(1).alias("block"), rank.alias("place"), pair_line().alias("line"))
    for k, rows in enumerate(accuracies.values()):
        lines = lines.union(rows.select(F.lit(2 + k), rank, metric_line()))
    first = found.orderBy("image_id", "section", "item_id").limit(most)
    place = F.row_number().over(Window.orderBy("image_id", "section", "item_id")).cast("long")  # at most ``most`` rows
    return lines.union(first.select(F.lit(2 + len(accuracies)), place, difference_line(*labels)))


def truth_pivot(flat: DataFrame) -> DataFrame:
    """``image_id`` and a map of item to value for each section: an extraction in the form of ground truth."""
    entry = F.struct(item_of(F.col("key")).alias("item"), F.nullif("value", F.lit("")).alias("value"))
    of = lambda s: F.map_from_entries(F.array_sort(F.collect_list(F.when(section_of(F.col("key")) == s, entry)))).alias(s)
    return flat.groupBy("image_id").agg(*[of(s) for s in SECTIONS])


def truth_unpivot(sheets: DataFrame, wanted: F.Column) -> DataFrame:
    """``image_id, key, expected`` of nested ground truth: every key of the list ``wanted`` once a sheet, a
    missing or null value as the empty text."""
    none = F.create_map().cast("map<string,string>")
    keyed = lambda s: F.transform_keys(F.coalesce(F.col(s), none), lambda k, _: F.concat(F.lit(s + ":"), k))
    rows = sheets.select("image_id", F.map_concat(*[keyed(s) for s in SECTIONS]).alias("known"), F.explode(wanted).alias("key"))
    return rows.select("image_id", "key", normalized(F.element_at("known", F.col("key"))).alias("expected"))
