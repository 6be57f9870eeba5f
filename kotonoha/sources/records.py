"""Loading and persisting record, index and raw import tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha import fixed, schemas


def load_records(spark: SparkSession, kind: str, path: str, fmt: str = "parquet") -> DataFrame:
    """words / kanji / names / sentences with their declared schema."""
    return spark.read.schema(schemas.RECORD_SCHEMAS[kind]).format(fmt).load(path)


def land_raw(spark: SparkSession, row_tag: str, path: str, fmt: str = "xml") -> DataFrame:
    """Raw import entries: ``entry``, ``name`` or ``character`` elements."""
    reader = spark.read.schema(schemas.RAW_SCHEMAS[row_tag])
    if fmt == "xml":
        return reader.format("xml").option("rowTag", row_tag).load(path)
    return reader.format(fmt).load(path)


def store(df: DataFrame, path: str, partition_by: list[str] | None = None,
          cluster_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Persist a record or index table as Parquet.

    ``partition_by`` columns become folders (postings, languages), so a search
    that fixes one reads only that folder.  ``cluster_by`` adds a hash
    repartition so that a folder does not hold one sliver per task.
    """
    out = df.repartition(*[F.col(c) for c in cluster_by]) if cluster_by else df
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def load_by_language(spark: SparkSession, path: str, languages: list[str] | None = None
                     ) -> DataFrame:
    """An index table stored by language, restricted to some languages."""
    df = spark.read.parquet(path)
    return df.where(F.col("lang").isin(languages)) if languages else df


def read_hashtags(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``tag freq target*``."""
    return parse_hashtags(spark.read.text(path))


def parse_hashtags(lines: DataFrame) -> DataFrame:
    """Parse hashtag lines; lines without a tag or a frequency are rejected."""
    parts = F.split(F.trim("value"), " ")
    targets = F.transform(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))),
                          lambda t: t.try_cast("tinyint"))
    return (lines.where(F.col("value") != "")
            .select(F.get(parts, 0).alias("tag"), targets.alias("s_targets"),
                    F.get(parts, 1).try_cast("float").alias("freq"))
            .where((F.col("tag") != "") & F.col("freq").isNotNull()))


def radical_dimension(spark: SparkSession) -> DataFrame:
    """(literal, stroke_count) of the radical picker; 15 groups, fixed size."""
    return spark.createDataFrame(fixed.radical_strokes(), "literal string, stroke_count int")


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, n, _ in fixed.LANGUAGES],
                                 "lang_id int, lang string")


def pos_dimension(spark: SparkSession) -> DataFrame:
    """(code, pos_simple, pos_order): one or two rows per detailed code."""
    order = {name: i for i, name, _ in fixed.POS_SIMPLE}
    rows = [(code, name, order[name]) for name, codes in fixed.POS_CODES.items() for code in codes]
    rows += [(code, name, order[name]) for code, name in fixed.POS_EXTRA.items()]
    return spark.createDataFrame(rows, "code string, pos_simple string, pos_order int")


def tag_dimension(spark: SparkSession) -> DataFrame:
    """(alias, kind, value) of every hashtag that is not a level or lesson."""
    rows = [(a, "pos", n) for _, n, al in fixed.POS_SIMPLE for a in al]
    rows += [(a, "misc", n) for n, al in fixed.MISC for a in al]
    rows += [(a, "misc", n) for a, n in fixed.MISC_SEARCH_ALIASES]
    rows += [(a, "sentence", n) for n, al in fixed.SENTENCE_TAGS for a in al]
    rows += [(a, "target", n) for _, n, al in fixed.TARGETS for a in al]
    rows += [(a, "flag", n) for n, al in fixed.FLAG_TAGS for a in al]
    return spark.createDataFrame(rows, "alias string, kind string, value string")


def language_aliases(spark: SparkSession) -> DataFrame:
    rows = [(a, n) for _, n, al in fixed.LANGUAGES for a in al]
    return spark.createDataFrame(rows, "alias string, lang string")


# -- news -----------------------------------------------------------------------
def shorten(text) -> F.Column:
    """Drop heading lines; long texts of more than three lines keep three."""
    text = F.col(text) if isinstance(text, str) else text
    lines = F.split(text, "\n")
    body = F.filter(lines, lambda l: ~F.trim(l).startswith("#"))
    cut = (F.length(text) > 100) & (F.size(lines) > 3)
    return F.array_join(F.when(cut, F.slice(body, 1, 3)).otherwise(body), "\n")


def news_table(df: DataFrame) -> DataFrame:
    """(id, title, long, creation_time) completed with the short form."""
    return (df.withColumn("short", shorten("long"))
            .withColumn("was_trimmed", F.col("short") != F.col("long")))


def keep_newest(df: DataFrame, limit: int = fixed.NEWS_LIMIT) -> DataFrame:
    """The newest entries (one distributed top-k, no global sort)."""
    return df.orderBy(F.col("creation_time").desc(), F.col("id").desc()).limit(limit)


def parse_news_files(files: DataFrame) -> DataFrame:
    """Rows (value, file_name) of files called ``epoch;title``."""
    name = F.col("file_name")
    entry = files.where(name.contains(";")).select(
        F.split(name, ";", 2)[0].try_cast("bigint").alias("epoch"),
        F.split(name, ";", 2)[1].alias("title"), F.col("value").alias("long"))
    entry = entry.where(F.col("epoch").isNotNull()).withColumn(
        "id", F.xxhash64("epoch", "title")).withColumn(
        "creation_time", F.timestamp_seconds("epoch"))
    return news_table(entry.select("id", "title", "long", "creation_time"))


def read_news(spark: SparkSession, path: str) -> DataFrame:
    files = (spark.read.text(path, wholetext=True)
             .select("value", F.url_decode(F.col("_metadata.file_name")).alias("file_name")))
    return keep_newest(parse_news_files(files))
