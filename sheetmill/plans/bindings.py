"""The test tables in the shapes that the operators take.  Nothing here is an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import prelabel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task sorts; what it holds then doesn't grow with the table.
TASK_ROWS = 200_000


def tasks(rows: DataFrame, each: int = 1) -> int:
    """How many tasks share a table's rows, or the ``each`` rows that come of one: as many as run at once, and more
    where rows are many."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * each // TASK_ROWS))


SECTION = {"AUTOMOBILE": "identity", "FURNITURE": "part2", "MACHINERY": "part3"}


def bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as the bubbles of an item (an order) on a sheet (a customer).

    Orders meet their customers first, so that lines are dealt once, by order and into tasks of a bounded size, and
    lie by item from then on.  They are merged at any size: lines that tie in every sort column keep their order,
    and customers, few bytes in a file but a large table in memory, never go out by way of the driver."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    known = orders.join(customers.hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
    n = tasks(lines)
    segment = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SECTION.items() for x in kv]), F.col("c_mktsegment")), F.lit("part1"))
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    key, third = F.col("o_orderkey"), F.pmod("o_orderkey", F.lit(3))
    aligned = F.when(F.col("o_orderstatus") != "P", "ok").when(third == 0, "ok").when(third == 1, "fallback_translation").otherwise("alignment_failed")
    residual = F.pmod(key, F.lit(1500)) / 100.0
    graded = F.pmod(key, F.lit(5)) == 0
    grid = F.when(residual > 10, "alignment_failed").when(residual > 6, "need_review").otherwise("ok")
    return (
        lines.repartition(n, "l_orderkey").hint("merge")
        .join(known.repartition(n, "o_orderkey"), F.col("l_orderkey") == key)
        .select(
            F.col("o_custkey").alias("image_id"),
            F.col("l_orderkey").alias("item_id"),
            segment.alias("section"),
            F.row_number().over(place).alias("spec_ord"),
            F.col("l_discount").alias("fill_score"),
            F.col("l_tax").alias("darkness_score"),
            aligned.alias("alignment_status"),
            F.least(F.lit(1.0), F.col("o_totalprice") / 333333.0).alias("alignment_confidence"),
            F.when(graded, grid).alias("grid_refinement_status"),
            F.when(graded, residual <= 10).alias("grid_refinement_decode_allowed"),
        )
        .withColumn("choice", F.chr(F.lit(64) + F.col("spec_ord")))
        .withColumn("prelabel", prelabel(F.col("fill_score")))
        .withColumn("prelabel_source", F.lit("adaptive_rule"))
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 64 numbers as pictures of 8 x 8 pixels."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label", F.posexplode("embedding").alias("at", "v"))
    return rows.select(
        "image_id",
        "label",
        F.floor(F.col("at") / 8).cast("int").alias("y"),
        F.pmod("at", F.lit(8)).cast("int").alias("x"),
        F.col("v").cast("double").alias("p"),
        F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.lit(128.0) + 400.0 * F.col("v").cast("double") + 0.5).cast("int"))).alias("gray"),
    )


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pictures, one row each."""
    gray = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.lit(128.0) + 400.0 * v.cast("double") + 0.5).cast("int")))
    digits = F.array_join(F.transform("embedding", lambda v: F.lpad(F.hex(gray(v)), 2, "0")), "")
    rows = table(spark, sf_dir, "embeddings").where("size(embedding) = 64")
    return rows.select(F.col("vec_id").alias("image_id"), "label", F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(digits).alias("gray"))


def lattice(images: DataFrame) -> DataFrame:
    """Sixteen template points on each picture."""
    points = F.array(*[F.struct(F.lit(4 * i + j).alias("id"), F.lit(float(2 * j)).alias("x"), F.lit(float(2 * i)).alias("y")) for i in range(4) for j in range(4)])
    return images.select("image_id").distinct().select("image_id", F.explode(points).alias("p")).select("image_id", "p.id", "p.x", "p.y")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the labels that are known, as rows of a training manifest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_id")
    label = lambda c: F.when(F.col(c) == 1, "filled").when(F.col(c) == 0, "blank")
    return docs.join(labels, F.col("doc_id") == F.col("l_id"), "left").select(
        F.col("doc_id").alias("image_id"), label("quality").alias("gt_label"), F.col("lang").alias("section"), label("toxic").alias("pred"), "source"
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of events as the epochs of a training run."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).alias("epoch")
    return table(spark, sf_dir, "events").groupBy(day).agg(F.round(F.avg("value"), 6).alias("mean_dice"), F.count(F.lit(1)).alias("n"))
