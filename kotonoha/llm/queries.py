"""One registered query per operator, with production parameters, and SQL where it can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.llm import bpe, chat, divergence, hyperplane, langmix, layout, linefreq, media, mixing, neighbours, partenum, spread, unigram
from kotonoha.llm.common import held_out, table


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text of documents, learned outside the test fold."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    settings = langmix.Mixture()
    labels, shares = langmix.fit(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()), settings)
    return langmix.identify(docs, labels, shares, settings, keep=("held_out",))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every text of documents; a host is a source."""
    return linefreq.judge(table(spark, sf_dir, "documents"))


def op3_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text of documents, from labels outside the test fold."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return neighbours.score(docs, neighbours.fit(docs, labels, neighbours.Neighbours()), keep=("held_out",))


def op4_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents without its boilerplate, by digest; a site is a source."""
    cut = spread.remove_boilerplate(table(spark, sf_dir, "documents"), counts=True)
    return cut.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op5_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every text of documents by 3-word shingles at 90 per cent."""
    return partenum.near_duplicates(table(spark, sf_dir, "documents"), partenum.Join(size=3, percent=90))


def op6_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page as laid out."""
    return layout.extract(table(spark, sf_dir, "pages"))


def op7_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text of documents by a unigram vocabulary."""
    return unigram.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_image_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents stored as a Netpbm image and read back."""
    return media.store_texts(table(spark, sf_dir, "documents"))


def encoded(docs: DataFrame) -> DataFrame:
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text of documents, by digest, and the digest of what they decode to."""
    return encoded(table(spark, sf_dir, "documents"))


DOMAINS, WEIGHTS = ["good", "poor", "toxic"], [0.9, 0.09, 0.01]


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for 90 % good, 9 % poor and 1 % toxic tokens."""
    labels = mixing.labelled_domains(table(spark, sf_dir, "labels"))
    out = mixing.mix(table(spark, sf_dir, "documents"), labels, DOMAINS, WEIGHTS)
    return out.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", "copies")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor of embeddings and each of its positives."""
    return hyperplane.mine(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of documents against the other ones of its language, and its 200 most telling terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are marks, formatted and read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.round_trip(given.unionByName(planted))


QUERIES = {f.__name__: f for f in (
    op1_language_mixture, op2_line_frequency, op3_toxic_neighbours, op4_site_spread, op5_shingle_join, op6_layout_text,
    op7_unigram_counts, op8_image_payloads, op9_byte_bpe, op10_soft_mixing, op11_hard_negatives, op12_source_divergence,
    op13_chat_turns)}
ORACLE: dict[str, str] = {"op2_line_frequency": linefreq.oracle(), "op4_site_spread": spread.oracle(),
                          "op11_hard_negatives": hyperplane.oracle(),
                          "op12_source_divergence": divergence.oracle(), "op13_chat_turns": chat.oracle()}
