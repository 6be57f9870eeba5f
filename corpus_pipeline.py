"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.llm import linefreq, mixing, partenum, queries, spread
from kotonoha.llm.common import table
from kotonoha.session import cut_lineage

#: Tokens that domains keep, as shares of what they have.  Asking for more good ones than
#: there are holds the rates of good documents at 1, the most that is allowed.
DOMAINS, KEPT = ["good", "poor", "toxic"], [1.1, 0.2, 0.02]


def measured(cut: DataFrame, docs: DataFrame) -> DataFrame:
    """Texts with their lengths as they are now."""
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with enough words, few repeats and enough lines of their own, without the frequent lines of their hosts."""
    return measured(linefreq.reject(docs), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand on many sites; a document that loses all its words goes."""
    return measured(spread.remove_boilerplate(docs), docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingles are linked at 80 per cent: the smallest id."""
    return partenum.keep_one(docs, partenum.Join(size=5, percent=80))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their rates, at most 1, for the domains' target tokens."""
    labels = mixing.labelled_domains(table(spark, sf_dir, "labels"))
    return mixing.choose(docs, labels, DOMAINS, KEPT)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids of every text by digest, and the digest of what they decode to."""
    return queries.encoded(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates),
          ("mixing", mixed), ("byte-level BPE", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: Jaccard components, fitted rates and BPE are not SQL; the tests compare the stages with plain versions.
ORACLE_SQL = None
