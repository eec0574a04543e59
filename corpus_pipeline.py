"""A corpus pipeline of five stages: language ID, line dedup, SimHash near-dedup, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``docs``.  Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetmill.llm import language_id, line_dedup, mixing, packing, simhash
from sheetmill.llm.common import cut, scratch_dir, table

#: Least posterior probability with which a document's language counts as known.
MIN_LANGUAGE_SCORE = 0.5


def _plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with names that can't clash with an operator's own, and the way back."""
    plain = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed(plain), {new: old for old, new in plain.items()}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay: not those without text or a letter, nor those whose
    best language has a probability below ``MIN_LANGUAGE_SCORE``."""
    rows = docs.select("doc_id", "text", "lang").where(~language_id.held_out(F.col("doc_id")))
    model = language_id.fit(rows)
    rows, back = _plain_names(docs)
    known = language_id.predict(rows, model).where(
        (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    )
    return known.drop("lang_pred", "score").withColumnsRenamed(back).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal lines, or lines one edit apart, the earliest stays."""
    rows, back = _plain_names(docs)
    deduped = line_dedup.dedup_lines(rows).drop("n_lines", "n_removed").withColumnsRenamed(back)
    if "n_chars" in docs.columns:
        deduped = deduped.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return deduped.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id.  Rows that
    share an id are one document, of which one row stays."""
    found = simhash.near_duplicates(docs).select("doc_id", "component_id")
    by_id = found.groupBy(F.col("doc_id").alias("x_id")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("first")
    )
    by_id = cut(by_id.where("n > 1 or not first"))
    gone = by_id.where("not first").select("x_id")
    kept = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("x_id")), "left_anti")
    if by_id.where("n > 1 and first").limit(1).count():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source up to its budget of words; a document taken in several epochs is there as often."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in the sequences, with their tokens."""
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("mixing", mix_to_weights),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
