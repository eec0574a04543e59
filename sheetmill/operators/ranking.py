"""Ranked relabelling of the bubbles of an item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ITEM = ("image_id", "item_id")


def relabel_by_rank(
    bubbles: DataFrame,
    *,
    score: str,
    filled_threshold: float,
    margin_threshold: float,
    keys: Sequence[str] = ITEM,
    order: str = "spec_ord",
    lone_is_clear: bool = True,
    source: str = "ranked_score",
) -> DataFrame:
    """``bubbles`` with ``prelabel`` by rank, and the seven group columns.

    Scores rank downwards, null as 0, ties by ``order``.  A top score under the filled threshold
    leaves the item blank; a margin under its threshold makes all within it ambiguous (of a lone
    bubble only if ``lone_is_clear`` is off); else the first is filled.  One shuffle by ``keys``
    serves the whole operator, and later ones on the same keys.
    """
    ranked = Window.partitionBy(*keys).orderBy(F.desc("_score"), order)
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top, margin = F.col("_top"), F.col("_top") - F.col("_second")
    clear = (margin >= F.lit(margin_threshold)) | (F.lit(lone_is_clear) & (F.col("_n") == 1))
    label = (
        F.when(top < F.lit(filled_threshold), "blank")
        .when(~clear, F.when(top - F.col("_score") <= F.lit(margin_threshold), "ambiguous").otherwise("blank"))
        .otherwise(F.when(F.col("_rank") == 1, "filled").otherwise("blank"))
    )
    out = (
        bubbles.withColumn("_score", F.coalesce(F.col(score).cast("double"), F.lit(0.0)))
        .withColumn("_rank", F.row_number().over(ranked))
        .withColumns(
            {
                "_top": F.first("_score").over(whole),
                "_second": F.coalesce(F.nth_value("_score", 2).over(whole), F.lit(0.0)),
                "_n": F.count(F.lit(1)).over(whole),
            }
        )
    )
    columns = {
        "prelabel": label,
        "group_score_key": F.lit(score),
        "group_top_score": F.round(top, 6),
        "group_second_score": F.round("_second", 6),
        "group_score_margin": F.round(margin, 6),
        "group_filled_threshold": F.lit(float(filled_threshold)),
        "group_margin_threshold": F.lit(float(margin_threshold)),
        "group_relabel_source": F.lit(source),
    }
    if "prelabel_source" in bubbles.columns:
        columns["prelabel_source"] = F.when(F.col("prelabel_source") == "adaptive_rule", "adaptive_rule_group").otherwise(F.col("prelabel_source"))
    return out.withColumns(columns).drop("_score", "_rank", "_top", "_second", "_n")


def relabel_identity(bubbles: DataFrame, *, filled_threshold: float = 0.07, margin_threshold: float = 0.03, score: str = "darkness_score", **more) -> DataFrame:
    """As ``relabel_by_rank`` for identity columns, where a lone bubble needs its margin, too."""
    return relabel_by_rank(
        bubbles.where("section = 'identity'"),
        score=score,
        filled_threshold=filled_threshold,
        margin_threshold=margin_threshold,
        lone_is_clear=False,
        source="identity_ranked_score",
        **more,
    )


def rehome_crops(bubbles: DataFrame, folder: str) -> DataFrame:
    """The path of a saved crop follows its label: folder / section / label / name."""
    name = F.regexp_extract("crop_path", r"([^/]*)$", 1)
    return bubbles.withColumn("crop_path", F.when(F.col("crop_path").isNotNull(), F.concat_ws("/", F.lit(folder), "section", "prelabel", name)))
