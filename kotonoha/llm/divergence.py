"""Source divergence: how far the term shares of each source of a language lie from those of its other sources.

A document is an exact sparse vector of its terms.  A language's vocabulary holds
the terms of at least ``min_df`` of its documents; its size is never bounded, so
it stays a table, keyed by the term itself, and is never numbered on the driver
or sent to tasks whole.  Vectors are summed per group before anything is
shuffled, and pairs of groups are evaluated from the entries they share and
from counts of equal shares for the rest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kotonoha.llm.common import SLICE, quoted, ship
from kotonoha.session import cut_lineage

#: Bytes of a UTF-8 text by what they are to terms: letters in lower case, bytes above 127, else a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))

#: Pairs of entries worked on at a time.
PAIRS = 1_000_000


@dataclass(frozen=True)
class Audit:
    """Terms of fewer than ``min_df`` documents go; shares are counted in ``scale`` parts; ``top`` terms are named."""

    min_df: int = 3
    scale: int = 1_000_000_000
    top: int = 200


def strings(terms: list[bytes]) -> pa.Array:
    """UTF-8 terms as a column, from one copy of their bytes."""
    ends = np.zeros(len(terms) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, terms), np.int64, len(terms)), out=ends[1:])
    whole = pa.LargeStringArray.from_buffers(len(terms), pa.py_buffer(ends), pa.py_buffer(b"".join(terms)))
    return whole.cast(pa.string())


def document_vectors(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, vector: one exact sparse vector of (term, count) for every row; nulls are read as ''."""
    ship(df.sparkSession.sparkContext)
    rows = df.select(*[F.coalesce(quoted(c).cast("string"), F.lit("")).alias(n)
                       for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    rows = rows.withColumn("text", F.make_valid_utf8("text"))
    entry = T.StructType([T.StructField("term", T.StringType()), T.StructField("count", T.LongType())])
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("vector", T.ArrayType(entry))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                terms, counts, ends = [], [], [0]
                for text in part.column(2).cast(pa.binary()).to_pylist():
                    found = Counter(text.translate(FOLD).split())
                    terms.extend(found)
                    counts.extend(found.values())
                    ends.append(len(terms))
                entries = pa.StructArray.from_arrays([strings(terms), pa.array(counts, pa.int64())], ["term", "count"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.string()), part.column(1).cast(pa.string()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)], ["lang", "source", "vector"])

    return rows.mapInArrow(run, schema)


def group_sums(vectors: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: the sum of a group's vectors, and in how many of them a term stands.

    Entries are summed where they are read, so a hot group or term is exchanged
    as one row for each task.
    """
    return (vectors.select("lang", "source", F.explode("vector").alias("e"))
            .groupBy("lang", "source", F.col("e.term").alias("term"))
            .agg(F.sum("e.count").alias("count"), F.count(F.lit(1)).alias("docs")))


def vocabulary(sums: DataFrame, min_df: int) -> DataFrame:
    """lang, term, total: the terms of enough documents of a language, and how often they occur there."""
    return (sums.groupBy("lang", "term").agg(F.sum("docs").alias("df"), F.sum("count").alias("total"))
            .where(F.col("df") >= min_df).drop("df"))


def share(count: Column, whole: Column, terms: Column, scale: int) -> Column:
    """1 + floor(scale * (count + 1) / (whole + terms)), exact for counts of any size."""
    wide = T.DecimalType(20, 0)
    return F.lit(1).cast("long") + F.call_function(
        "div", F.lit(scale).cast(T.DecimalType(12, 0)) * (count + 1).cast(wide), (whole + terms).cast(wide))


def excess(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def plain_excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def entry_pairs(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (left, right) of all ordered pairs of different entries of a term, in blocks.

    ``sizes`` are the numbers of entries of consecutive terms; a block holds whole
    left entries, about PAIRS pairs or one entry's.
    """
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    width = np.repeat(sizes, sizes)
    upto = np.cumsum(width)
    at = 0
    while at < len(width):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        w = width[at:end]
        left = np.repeat(np.arange(at, end), w)
        right = np.repeat(first[at:end], w) + np.arange(len(left)) - np.repeat(np.cumsum(w) - w, w)
        other = left != right
        yield left[other], right[other]
        at = end


def shared_part(entries: DataFrame) -> DataFrame:
    """lang, source, item, shared: what the terms that both groups have add to the sums of the parts below.

    For a term with shares p and q, and shares p0 and q0 of a term that is absent,
    that is f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).  A task meets the entries
    of a term one after another and returns sums per pair of groups, so pairs of
    entries are never written out.
    """
    ship(entries.sparkSession.sparkContext)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "source", "item")]
                          + [T.StructField("shared", T.LongType())])
    arrow = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("shared", pa.int64())])
    dealt = entries.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")

    def sums(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lang, term, source = (rows.column(i).to_pylist() for i in range(3))
        p, p0 = (rows.column(i).to_numpy() for i in (3, 4))
        number: dict[tuple, int] = {}
        code = np.array([number.setdefault(g, len(number)) for g in zip(lang, source)], np.int64)
        groups = list(number)
        starts = [0] + [i for i in range(1, len(term)) if term[i] != term[i - 1] or lang[i] != lang[i - 1]]
        for left, right in entry_pairs(np.diff(starts + [len(term)])):
            if not len(left):
                continue
            a, b, a0, b0 = p[left], p[right], p0[left], p0[right]
            value = plain_excess(a, b) - plain_excess(a, b0) - plain_excess(a0, b) + plain_excess(a0, b0)
            pair = code[left] * len(groups) + code[right]
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            begin = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            of, to = np.divmod(pair[begin], len(groups))
            yield pa.RecordBatch.from_arrays(
                [pa.array([groups[i][0] for i in of], pa.string()), pa.array([groups[i][1] for i in of], pa.string()),
                 pa.array([groups[i][1] for i in to], pa.string()), pa.array(np.add.reduceat(value[order], begin))],
                schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # rows of the last term, which the next batch may continue
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if kept is None else pa.concat_tables([kept, now])
            lang, term = now.column(0), now.column(1)
            end = now.num_rows - 1
            while end and (lang[end - 1], term[end - 1]) == (lang[end], term[end]):
                end -= 1
            kept = now.slice(end)
            if end:
                yield from sums(now.slice(0, end))
        if kept is not None and kept.num_rows:
            yield from sums(kept)

    found = dealt.mapInArrow(run, schema)
    return found.groupBy("lang", "source", "item").agg(F.sum("shared").alias("shared"))


def audit(df: DataFrame, settings: Audit = Audit(), text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: divergences of a source from each other one, and its most telling terms.

    Part ``pair`` names every other source of the language, with f(p, q) summed over
    the vocabulary, p the source's share of a term and q the other's.  Part ``term`` names the
    ``top`` terms of a source by f(p, q) where p is above the language's share q.
    Ties go by the item's bytes.  Nulls are read as ''; repeated rows count each; a group
    without terms has absent shares only; a language without vocabulary has pairs of value 0 and
    no terms; an empty table gives no rows.  Other columns are left out.  One text's terms are held at a time.
    """
    sums = cut_lineage(group_sums(document_vectors(df, text_col, lang_col, source_col)), "sums")
    kept = cut_lineage(sums.drop("docs").join(vocabulary(sums, settings.min_df), ["lang", "term"]), "kept")
    sizes = kept.groupBy("lang").agg(F.countDistinct("term").alias("terms"), F.sum("count").alias("lang_whole"))
    groups = df.select(*[F.coalesce(quoted(c).cast("string"), F.lit("")).alias(n)
                         for n, c in (("lang", lang_col), ("source", source_col))]).distinct()
    groups = (groups.join(kept.groupBy("lang", "source").agg(F.sum("count").alias("whole")), ["lang", "source"], "left")
              .join(sizes, "lang", "left").fillna(0, ["whole", "terms", "lang_whole"]))
    none = F.lit(0).cast("long")
    groups = cut_lineage(groups.withColumn("p0", F.when(
        F.col("terms") > 0, share(none, F.col("whole"), F.col("terms"), settings.scale))), "groups")

    entries = kept.join(groups, ["lang", "source"])
    entries = entries.select("lang", "source", "term", "p0", share(
        F.col("count"), F.col("whole"), F.col("terms"), settings.scale).alias("p"), share(
        F.col("total"), F.col("lang_whole"), F.col("terms"), settings.scale).alias("q"))

    telling = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                            excess(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    telling = telling.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= settings.top)

    pairs = pair_values(entries, groups)
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(telling)


def pair_values(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, part, item, value for all ordered pairs of a language's sources.

    The sum over the vocabulary is that of absent terms, plus what either side's own
    terms add against an absent one, by counts of equal shares, plus the shared part.
    """
    ours = groups.select("lang", "source", "terms", F.col("p0").alias("a"))
    pairs = ours.join(groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("b")), "lang").where("source <> item")
    alike = entries.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    base = excess(F.col("a"), F.col("b"))
    of_left = (pairs.join(alike, ["lang", "source"]).groupBy("lang", "source", "item")
               .agg(F.sum(F.col("n") * (excess(F.col("p"), F.col("b")) - base)).alias("lefts")))
    of_right = (pairs.join(alike.withColumnRenamed("source", "item"), ["lang", "item"]).groupBy("lang", "source", "item")
                .agg(F.sum(F.col("n") * (excess(F.col("a"), F.col("p")) - base)).alias("rights")))
    key = ["lang", "source", "item"]
    met = pairs.join(of_left, key, "left").join(of_right, key, "left").join(shared_part(entries), key, "left")
    value = F.col("terms") * F.coalesce(base, F.lit(0)) + sum(F.coalesce(c, F.lit(0)) for c in ("lefts", "rights", "shared"))
    return met.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))


def oracle(settings: Audit = Audit()) -> str:
    """The same in SQL for the table of documents, term by term and densely."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
s AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
v AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= {settings.min_df}),
vs AS (SELECT lang, count(*) AS terms, sum(total) AS whole FROM v GROUP BY lang),
g AS MATERIALIZED (SELECT d.lang, d.source, coalesce(any_value(x.n), 0) AS whole FROM (SELECT DISTINCT lang, source FROM d) d
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM s JOIN v USING (lang, term) GROUP BY ALL) x
    ON x.lang = d.lang AND x.source = d.source GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, v.term, coalesce(s.n, 0) AS n,
    1 + ({settings.scale}::HUGEINT * (coalesce(s.n, 0) + 1)) // (g.whole + vs.terms)::HUGEINT AS p,
    1 + ({settings.scale}::HUGEINT * (v.total + 1)) // (vs.whole + vs.terms)::HUGEINT AS q
  FROM g JOIN v ON v.lang = g.lang JOIN vs ON vs.lang = g.lang
  LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.term = v.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
allpairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value
  FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM allpairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {settings.top}"""
