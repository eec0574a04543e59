"""Items decoded from labelled bubbles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (
    LOW_CONFIDENCE,
    blank_confidence,
    choice_rank,
    hard_failure,
    letter_rank,
    metadata_confidence,
    needs_review,
    record_score,
    score_confidence,
)
from .ranking import ITEM

CONFIDENCES = ("alignment_confidence", "grid_refinement_confidence", "model_confidence", "model_argmax_confidence")


def _known(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _decode(bubbles: DataFrame, keys: Sequence[str], question: bool, letters: Sequence[str]) -> DataFrame:
    """One aggregate an item, on the keys by which bubbles already lie; an item's few records are kept
    beside it, for the margins to those that were not selected."""
    alignment, grid, allowed = (_known(bubbles, c, k) for c, k in (("alignment_status", "string"), ("grid_refinement_status", "string"), ("grid_refinement_decode_allowed", "boolean")))
    rank = letter_rank(F.col("choice"), letters) if question else choice_rank(F.col("choice"))
    record = F.struct(
        (-F.col("_score")).alias("minus"),
        F.col("_rank").alias("rank"),
        "choice",
        "_score",
        F.col("darkness_score").cast("double").alias("darkness"),
        _known(bubbles, "group_filled_threshold", "double").alias("filled"),
        _known(bubbles, "group_margin_threshold", "double").alias("margin"),
        metadata_confidence(*[_known(bubbles, c, "double") for c in CONFIDENCES]).alias("sure"),
    )
    filled = F.col("prelabel") == "filled"
    count = lambda label: F.count(F.when(F.col("prelabel") == label, 1))
    rows = bubbles.withColumn("_score", record_score(bubbles.columns)).withColumn("_rank", rank)
    found = rows.groupBy(*keys).agg(
        F.min(F.when(filled, record)).alias("c"),
        F.max(hard_failure(alignment, grid, allowed)).alias("stop"),
        F.collect_list(F.struct("choice", "_score", F.col("darkness_score").cast("double").alias("darkness"))).alias("all"),
        count("filled").alias("n_filled"),
        count("ambiguous").alias("n_ambiguous"),
        count("invalid").alias("n_invalid"),
        F.max(needs_review(alignment, grid)).alias("review"),
        F.max("_score").alias("top"),
        F.min(F.struct("_rank", "choice", _known(bubbles, "group_filled_threshold", "double").alias("filled"))).alias("first"),
    )
    goes = ~F.col("stop") & (F.col("n_filled") == 1) if question else ~F.col("stop")
    found = found.withColumn("c", F.when(goes, F.col("c"))).withColumn("others", F.filter("all", lambda e: F.col("c").isNull() | (e.choice != F.col("c.choice"))))
    found = found.withColumns(
        {
            "choices": F.size(F.array_distinct(F.transform("all", lambda e: e.choice))) if question else F.lit(len(letters)),
            "rival": F.array_max(F.transform("others", lambda e: e._score)),
            "dark_rival": F.array_max(F.transform("others", lambda e: e.darkness)),
        }
    )
    margin = F.round(F.col("c._score") - F.col("rival"), 6)
    sure = F.when(
        F.col("c").isNotNull(), F.round(F.least(score_confidence(F.col("c._score"), margin, F.col("c.filled"), F.col("c.margin")), F.col("c.sure")), 6)
    ).otherwise(blank_confidence(F.col("top"), F.col("first.filled")))
    found = found.withColumn("confidence", sure)
    reason = lambda test, name: F.when(test, F.lit(name))
    reasons = F.array_compact(
        F.array(
            reason(F.col("choices") != len(letters), "incomplete_choices"),
            reason(F.col("n_invalid") > 0, "invalid_bubble"),
            reason((F.col("n_ambiguous") > 0) & (F.lit(question) | (F.col("n_filled") == 0)), "ambiguous_bubble"),
            reason(F.col("n_filled") > 1, "multi_mark"),
            reason(F.col("review"), "alignment_failed"),
            reason(F.col("c").isNotNull() & (F.col("confidence") < LOW_CONFIDENCE), "low_confidence"),
        )
    )
    return found.withColumn("review_reasons", reasons).select(
        *keys,
        F.col("c.choice").alias("selected"),
        F.when(F.array_contains("review_reasons", "multi_mark"), "multi_mark")
        .when(F.size("review_reasons") > 0, "need_review")
        .when(F.col("c").isNotNull(), "accepted")
        .otherwise("blank")
        .alias("status"),
        (F.size("review_reasons") > 0).alias("need_review"),
        "review_reasons",
        "confidence",
        F.round("c._score", 6).alias("score"),
        margin.alias("score_margin"),
        F.round("c.darkness", 6).alias("darkness_score"),
        F.round(F.col("c.darkness") - F.col("dark_rival"), 6).alias("darkness_margin"),
    )


def decode_questions(bubbles: DataFrame, *, keys: Sequence[str] = ITEM, letters: Sequence[str] = ("A", "B", "C", "D")) -> DataFrame:
    """Multiple choice: exactly one filled bubble selects, any ambiguous one asks for review, and so
    does a set of choices that is not complete."""
    return _decode(bubbles, keys, True, letters)


def decode_groups(bubbles: DataFrame, *, keys: Sequence[str] = ITEM) -> DataFrame:
    """Digits, true/false and parts of numbers: the strongest filled bubble selects."""
    return _decode(bubbles, keys, False, ())


def item_states(bubbles: DataFrame, *, keys: Sequence[str] = ITEM) -> DataFrame:
    """The state of each choice of an item as a map."""
    more = [c for c in bubbles.columns if c.startswith(("model_", "alignment_", "grid_", "group_")) or c in ("fill_score", "filled_probability", "blank_probability")]
    label = F.coalesce(F.col("label"), F.col("choice")) if "label" in bubbles.columns else F.col("choice")
    crop = _known(bubbles, "crop_path", "string").alias("crop_path")
    state = F.struct(label.alias("label"), "prelabel", "darkness_score", crop, *more)
    return bubbles.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("choice", state)))).alias("states"))


ALIGNMENT_COLUMNS = {
    "status": "alignment_status", "confidence": "alignment_confidence", "method": "alignment_method", "marker_count": "alignment_marker_count",
    "pre_rms": "marker_pre_residual_px", "rms": "marker_residual_px", "largest": "marker_max_residual_px",
}
GRID_COLUMNS = {
    "status": "grid_refinement_status", "confidence": "grid_refinement_confidence", "method": "grid_refinement_method", "n": "grid_refinement_matched_count",
    "n_inliers": "grid_refinement_inlier_count", "rms": "grid_residual_px", "largest": "grid_max_residual_px", "decode_allowed": "grid_refinement_decode_allowed",
}


def with_block_metadata(records: DataFrame, alignment: DataFrame, grid: DataFrame) -> DataFrame:
    """Records (``image_id, alignment_block, grid_block``) with what is known of their blocks; a block that
    is not known leaves nulls.  Blocks: ``image_id, block`` and the columns named above."""
    left = alignment.select("image_id", F.col("block").alias("alignment_block"), *[F.col(c).alias(n) for c, n in ALIGNMENT_COLUMNS.items()])
    right = grid.select("image_id", F.col("block").alias("grid_block"), *[F.col(c).alias(n) for c, n in GRID_COLUMNS.items()])
    return records.join(left, ["image_id", "alignment_block"], "left").join(right, ["image_id", "grid_block"], "left").withColumnRenamed("grid_block", "grid_refinement_block")


def with_predictions(records: DataFrame, predictions: DataFrame, keys: Sequence[str] = ("image_id", "spec_id")) -> DataFrame:
    """Records with a classifier's rounded predictions (as from ``models.prediction``); a record without one fails."""
    six = lambda c: F.round(c, 6)
    found = predictions.select(
        *keys,
        F.col("pred_label").alias("model_label"),
        six("pred_confidence").alias("model_confidence"),
        six("filled_probability").alias("filled_probability"),
        six("blank_probability").alias("blank_probability"),
        F.col("argmax_label").alias("model_argmax_label"),
        six("argmax_confidence").alias("model_argmax_confidence"),
        F.col("filled_threshold").alias("model_filled_threshold"),
    )
    joined = records.drop("prelabel_source").join(found, list(keys), "left")
    known = F.when(F.col("model_label").isNull(), F.raise_error(F.lit("a record has no prediction")).cast("string")).otherwise(F.lit("bubble_classifier_group"))
    return joined.withColumn("prelabel_source", known)


def compact_answers(items: DataFrame, states: DataFrame, letters: Sequence[str] = ("A", "B", "C", "D"), *, keys: Sequence[str] = ITEM) -> DataFrame:
    """Part I for the web: each answer with the state of every letter, null where there is none, and its
    number, from the id (``I_007``) where it isn't known."""
    state = lambda x: F.struct(*[F.element_at("states", F.lit(x))[c].alias(c) for c in ("prelabel", "darkness_score", "crop_path")]).alias(x)
    number = F.col("question_number") if "question_number" in items.columns else F.lit(None).cast("int")
    parsed = F.try_element_at(F.split(F.col(keys[-1]).cast("string"), "_"), F.lit(2)).try_cast("int")
    rows = items.drop("question_number").withColumn("question_number", F.coalesce(number, parsed))
    return rows.join(states, list(keys), "left").withColumn("states", F.struct(*[state(x) for x in letters]))
