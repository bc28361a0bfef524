"""The corpus pipeline: quality rules, line dedup, near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All but the last return the columns of ``documents``; the last returns
packed pieces of sequences. ``run`` writes every stage as a table in the
shared folder and reads it back for the next one.

Defined cases are those of the operators; columns of ``docs`` beyond the
documents columns are dropped, and an empty table passes through as empty.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from mealops.llm import line_dedup, line_quality, packing, secret_scan, simhash  # noqa: E402
from mealops.llm.common import written  # noqa: E402

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "byte_bpe_50k.json"


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[docs[c] for c in COLUMNS])


def _with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with a new text, and ``n_chars`` counted again."""
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line field reject go."""
    docs = _documents(docs)
    field = line_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_quality.keep(docs, field)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in several documents stay in the first; no document goes."""
    return _with_text(line_dedup.dedup_lines(_documents(docs)), F.col("text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays."""
    return simhash.drop_near(_documents(docs))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; no document goes."""
    found = secret_scan.scan(_documents(docs))
    return _with_text(found, secret_scan.redacted(F.col("text"), F.col("secret_spans")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of 2048 tokens."""
    return packing.pack_documents(_documents(docs), public_tokenizers.path(TOKENIZER))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup),
          ("secret_scans", secret_scans), ("packing", pack_sequences)]

#: SimHash links, the field's verdicts and byte-level BPE have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
