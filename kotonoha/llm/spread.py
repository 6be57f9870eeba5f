"""Lines found on many sites: HyperLogLog sketches per line, exact counts near the threshold.  DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha.llm.common import BLANK, quoted
from kotonoha.llm.linefreq import normal
from kotonoha.session import cut_lineage


@dataclass(frozen=True)
class Spread:
    """A line with a word on at least ``sites`` sites is boilerplate.
    Estimates within ``band`` of the threshold are replaced by exact counts;
    sketches have ``2 ** bits`` registers, whose error is well below the band."""

    sites: int = 10
    bits: int = 12
    band: float = 0.15


def lines_of(df: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """row, doc, site, place, line: a row per line with a word, without its text."""
    rows = df.select(row_key(id_col, text_col, site_col).alias("row"), quoted(id_col).alias("doc"), quoted(site_col).cast("string").alias("site"),
                     F.posexplode(F.split(quoted(text_col), "\n")).alias("place", "x"))
    cut = rows.select("row", "doc", "site", "place", normal(F.col("x")).alias("x"))
    return cut.where("x <> ''").select("row", "doc", "site", "place", F.xxhash64("x").alias("line"))


def row_key(*names: str) -> Column:
    """A hash of what decides about a row; rows that share it are treated alike."""
    return F.xxhash64(*[c for name in names for c in (quoted(name).isNull(), quoted(name))])


def boilerplate(lines: DataFrame, settings: Spread) -> DataFrame:
    """line, keeper: lines spread over enough sites, and the smallest id that has each.

    Partial sketches are built where the lines are read and merged per line.  Only
    lines whose estimate lies near the threshold go through the exact count, a row per line and site.
    """
    merged = lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(settings.bits))).alias("sites"), F.min("doc").alias("keeper"))
    low, high = settings.sites * (1 - settings.band) - 1, settings.sites * (1 + settings.band) + 1
    sure = merged.where(F.col("sites") > high).select("line", "keeper")
    near = merged.where(F.col("sites").between(low, high)).select(F.col("line").alias("near"), "keeper")
    sited = lines.where(F.col("site").isNotNull()).select("line", "site").distinct()
    counted = (sited.join(near, F.col("line") == F.col("near")).groupBy("line")
               .agg(F.count("site").alias("sites"), F.first("keeper").alias("keeper")))
    return sure.unionByName(counted.where(F.col("sites") >= settings.sites).select("line", "keeper"))


def remove_boilerplate(df: DataFrame, settings: Spread = Spread(), id_col: str = "doc_id", text_col: str = "text",
                       site_col: str = "source", counts: bool = False) -> DataFrame:
    """The rows of ``df`` with boilerplate lines taken out of their texts.

    The rows of the smallest id that has a line keep it, so every line stays
    somewhere.  A null text stays null; a null site counts for nothing; rows
    without an id keep a line only if no row with one has it.  ``counts`` adds
    ``n_lines`` and ``n_removed``, in place of columns of these names.  The sites of a hot line merge before the
    shuffle.  Texts are exchanged once whatever they lose, so the job behaves alike at every size.  An empty table gives no rows; a task holds one text.
    """
    names = {"_row", "_places"}
    while names & set(df.columns):
        names = {n + "_" for n in names}
    places, row = sorted(names)
    # Read three times below; without their texts lines are small, and splitting texts again is not.
    lines = cut_lineage(lines_of(df, id_col, text_col, site_col), "lines")
    found = boilerplate(lines, settings).select(F.hash("line").alias("key"), F.col("line").alias("its_line"), "keeper")
    gone = (lines.withColumn("key", F.hash("line")).join(found, "key")
            .where((F.col("line") == F.col("its_line")) & ~F.col("doc").eqNullSafe(F.col("keeper")))
            .groupBy("row").agg(F.collect_set("place").alias(places)))
    gone = gone.select(F.col("row").alias(row), places)
    text = quoted(text_col)
    cut = F.split(text, "\n")
    keep = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col(places))
    left = F.when(F.col(places).isNull(), text).otherwise(
        F.array_join(F.transform(F.array(cut), lambda x: F.transform(keep, lambda i: x[i]))[0], "\n"))
    joined = df.withColumn(row, row_key(id_col, text_col, site_col)).join(gone.hint("merge"), row, "left")
    extra = [F.when(text.isNull(), 0).otherwise(F.size(cut)).cast("long").alias("n_lines"),
             F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_removed")] if counts else []
    kept = [c for c in df.columns if not counts or c not in ("n_lines", "n_removed")]
    return joined.select(*[left.alias(c) if c == text_col else quoted(c) for c in kept], *extra)


def oracle(settings: Spread = Spread()) -> str:
    """The digest query in SQL for the table of documents."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, doc_id, source, place, x, lower(trim(regexp_replace(x, '{BLANK}', ' ', 'g'))) AS norm
      FROM (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS x,
              generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d)),
b AS (SELECT norm, min(doc_id) AS keeper FROM l WHERE norm <> ''
      GROUP BY norm HAVING count(DISTINCT source) >= {settings.sites}),
r AS (SELECT l.rid, count(*) AS n_lines, count(b.norm) AS n_removed,
        string_agg(x, chr(10) ORDER BY place) FILTER (b.norm IS NULL) AS left_text
      FROM l LEFT JOIN b ON l.norm = b.norm AND l.doc_id IS DISTINCT FROM b.keeper GROUP BY l.rid)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN text IS NULL THEN NULL ELSE md5(coalesce(left_text, '')) END AS text_md5 FROM d LEFT JOIN r USING (rid)"""
