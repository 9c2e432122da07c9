"""The corpus pipeline: quality rules, line dedup, near duplicates, source mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm.codec import encode_documents
from lineloom.llm.common import documents
from lineloom.llm.jaccard_join import one_of_each
from lineloom.llm.line_dedup import without_repeated_lines
from lineloom.llm.mixing import mixed_documents
from lineloom.llm.quality import quality_rules
from lineloom.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, carry=tuple(docs.columns)).where("kept").select(*docs.columns)


def _measured(cut: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, after texts were cut."""
    if "n_chars" not in cut.columns:
        return cut
    return cut.withColumn("n_chars", F.char_length("text").cast(cut.schema["n_chars"].dataType))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document or line has; those left without a word go."""
    return _measured(without_repeated_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return one_of_each(docs, size=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The parts of documents that the mix draws, as often as it draws them."""
    return _measured(mixed_documents(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every part of the mix."""
    return encode_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("jaccard_join", near_dedup),
    ("mixing", mixing),
    ("sentencepiece", encoding),
]

#: The stages' suffix arrays, edit distances, draws and segmentation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
