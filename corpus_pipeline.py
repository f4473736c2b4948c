"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before has kept, and is
written as Parquet in the shared folder, so a lost executor never sends a stage back to the start.

In every stage but the last, other columns of `docs` stay as they are. Null and empty texts are
rejected by the quality filter; where they come to the later stages nevertheless, line dedup leaves
them, near dedup takes them for copies of one another, and packing gives them an end token alone.
Equal rows go the same way in the first two stages; near dedup keeps one of them. Rows of one
doc_id with unequal texts are documents of their own. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.llm import bagminhash, linedup, mixing, packing, quality
from oddsmith.llm.common import dropped, table, text_key, written
from oddsmith.llm.queries import tokenizer_added, tokenizer_files


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling has kept."""
    kept = quality.resampled(docs, table(spark, sf_dir, "labels")).filter("kept")
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["__id"]) & (text_key("text") == kept["__key"]), "left_semi")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of later copies; n_chars follows the text."""
    out = linedup.deduplicated(docs, whole=False).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return bagminhash.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for, in shuffled order."""
    return mixing.mixed(docs).select(*docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into windows."""
    return packing.packed(docs, *tokenizer_files(), added=tokenizer_added())


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

# Trained weights, signatures and token ids have no SQL form; a test holds run() against plain loops over all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        dropped(before)
    return docs
