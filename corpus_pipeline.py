"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing and packing over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm.lines import drop_repeated_lines
from cuemill.llm.minhash import drop_near_duplicates
from cuemill.llm.mixing import take_mix
from cuemill.llm.packing import pack_documents
from cuemill.llm.quality import keep_quality
from cuemill.llm.queries import tokenizer_path
from cuemill.session import stage

# SQL can't express the language model, the draw of the mix or the packing: tests compare the stages with plain models.
ORACLE_SQL: str | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_quality(docs, least_docs=2, across=True)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds. A document that loses all lines stays, with an empty text;
    null stays null. ``n_chars`` follows the text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    inner = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None)
    kept = drop_repeated_lines(docs.select("doc_id", "text", inner.alias("others")))
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    made = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.char_length(text).cast("long")}
    return kept.select(*[made.get(c, F.col(f"others.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    return drop_near_duplicates(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 5, 2, 1 in turn, 150 % of all words, none more than twice."""
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return pack_documents(docs, tokenizer_path(), added=True)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
