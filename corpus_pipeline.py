"""The corpus pipeline: quality filter, line deduplication, near-duplicate removal, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.decontam import without_leaks
from panelforge.llm.linededup import dedup_lines
from panelforge.llm.neardup import near_duplicates
from panelforge.llm.packing import pack, token_pieces
from panelforge.llm.quality import fit_quality, quality_score
from panelforge.llm.queries import word_bpe_path
from panelforge.llm.shared import materialize

#: Tokens of a sequence.
SEQUENCE = 2048
#: No SQL: boosted tables, sketches and a tokenizer. tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def _with_text(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where a stage has changed it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5 go. Null texts are scored as empty ones."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_score(model, F.col("text")) >= 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that are found in 3 documents or more stay in the largest doc_id alone; every document stays."""
    return _with_text(dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the smallest doc_id: five-word shingles, similarity of 0.8 or more. Rows that repeat an id go with the group's other rows."""
    kept = near_duplicates(docs, words=5, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(kept.hint("merge"), "doc_id", "left_semi").select(docs.columns)
    return named.unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit bound go, each row by its own text; null and empty texts and rows without id stay."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequence and offset. A null text is one end token; rows that repeat an id, or lack it, each have their pieces; no rows give none."""
    return pack(token_pieces(docs, word_bpe_path(), SEQUENCE, end_id=0, ranked=True), SEQUENCE)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
