"""Quality rules: counts of words, symbols and repeats, and lines too frequent within a host.  DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha.llm.common import BLANK, BLANKS, quoted
from kotonoha.session import cut_lineage

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """A line in more than ``documents`` documents of a host goes; a text that
    keeps less than ``remaining`` per cent of the words of its lines is rejected."""

    documents: int = 10
    remaining: int = 30
    words: int = 50
    repeated: int = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words between white space."""
    return F.array_remove(F.split(text, BLANK), "")


def normal(line: Column) -> Column:
    """A line in lower case with single blanks, none at its ends."""
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(BLANKS)), BLANK, " "))


def filled_lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def repeated_words(of: Column) -> Column:
    """Words that lie in a window of three found at least twice in the array.

    Windows are hashed, sorted together with their places (the lowest bits), and
    compared with their neighbours, so a long text costs n log n.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(of) - 3), lambda i: F.xxhash64(of[i], of[i + 1], of[i + 2]))

    def places(h: Column) -> Column:
        span = F.pow(F.lit(2.0), F.length(F.bin(F.size(h)))).cast("long")  # above every place
        return let(span, lambda s: let(
            F.sort_array(F.transform(h, lambda x, i: x - F.pmod(x, s) + i)),
            lambda o: F.transform(
                F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda j: (
                    (j > 0) & (h[F.pmod(o[F.greatest(j - 1, F.lit(0))], s).cast("int")] == h[F.pmod(o[j], s).cast("int")]))
                    | ((j < F.size(o) - 1)
                       & (h[F.pmod(o[F.least(j + 1, F.size(o) - 1)], s).cast("int")] == h[F.pmod(o[j], s).cast("int")]))),
                lambda j: F.pmod(o[j], s).cast("int"))))

    covered = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
        F.size(F.array_distinct(F.flatten(F.transform(places(h), lambda p: F.array(p, p + 1, p + 2)))))))
    return F.when(F.size(of) < 4, F.lit(0)).otherwise(covered)


def hashed_lines(text: Column, host: Column) -> Column:
    """(line, n, first) of all filled lines of a text: the hash of host and normalised line, its words, and whether
    it is the first of its kind."""
    marked = F.transform(filled_lines(text), lambda x: let(normal(x), lambda y: F.struct(
        F.xxhash64(host, y).alias("line"), F.size(F.split(y, " ")).alias("n"))))
    return let(F.sort_array(marked), lambda o: F.transform(o, lambda x, i: F.struct(
        x["line"].alias("line"), x["n"].alias("n"),
        ((i == 0) | (o[F.greatest(i - 1, F.lit(0))]["line"] != x["line"])).alias("first"))))


def row_key(id_col: str, text_col: str, host_col: str) -> Column:
    """A hash of what tells documents apart: id, host and text."""
    return F.xxhash64(quoted(id_col).isNull(), quoted(id_col), F.coalesce(quoted(host_col).cast("string"), F.lit("")),
                      F.coalesce(quoted(text_col), F.lit("")))


def measured(df: DataFrame, limits: Limits, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Of every row its key, id, counts, lines and a number, from one pass over the texts; written without the texts."""
    rows = df.select(quoted(id_col).alias("doc"), F.coalesce(quoted(host_col).cast("string"), F.lit("")).alias("host"),
                     F.coalesce(quoted(text_col), F.lit("")).alias("t"), row_key(id_col, text_col, host_col).alias("row"))
    text = F.col("t")
    counted = rows.select(
        "doc", "row",
        let(words(text), lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate("t", BLANKS, "")).alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"),
        let(filled_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
        hashed_lines(text, F.col("host")).alias("lines"))
    out = counted.select("doc", "row", *[F.col(c).cast("long") for c in ("word_chars", "n_symbols", "n_dup_lines")],
                         F.col("w.n_words").cast("long").alias("n_words"),
                         F.col("w.n_repeat_words").cast("long").alias("n_repeat_words"), "lines",
                         F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("line_words"))
    out = out.withColumn("base_failed", (F.col("n_words") < limits.words)
                         | (100 * F.col("n_repeat_words") > limits.repeated * F.col("n_words")))
    return cut_lineage(out.withColumn("at", F.monotonically_increasing_id()), "measured")


def frequent_words(rows: DataFrame, limits: Limits) -> DataFrame:
    """row, gone, lost: words of the frequent lines that a document loses, and the hashes of these lines.

    ``rows`` are those of ``measured``; repeated ones are one document.  Documents
    are counted per host and line where the lines are read, then merged, so a hot line is exchanged as
    one row for each task.  The smallest id that has a line keeps it, so that no
    line vanishes from its host.
    """
    again = (rows.groupBy("row").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("kept_at")).where("c > 1")
             .select(F.col("row").alias("its_row"), "kept_at"))
    once = rows.select("row", "doc", "at", "lines").join(again, F.col("row") == F.col("its_row"), "left")
    once = once.where(F.col("kept_at").isNull() | (F.col("at") == F.col("kept_at")))
    lines = once.select("row", "doc", F.explode("lines").alias("x")).select("row", "doc", "x.*")
    frequent = (lines.where("first").groupBy("line").agg(F.count(F.lit(1)).alias("documents"), F.min("doc").alias("keeper"))
                .where(F.col("documents") > limits.documents).select(F.col("line").alias("its_line"), "keeper"))
    met = lines.join(frequent, F.col("line") == F.col("its_line")).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    return met.groupBy("row").agg(F.sum("n").alias("gone"), F.collect_set("line").alias("lost"))


def enough(limits: Limits, gone: Column) -> Column:
    """Whether a row passes the counts and keeps enough of its words."""
    return ~F.col("base_failed") & (100 * (F.col("line_words") - gone) >= limits.remaining * F.col("line_words"))


def judge(df: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text",
          host_col: str = "source") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, kept of every row.

    A null text is empty, a null host is the host ''.  Documents are told apart
    by id, host and text: copies under other ids count, repeated rows are one
    document and give repeated rows.  Rows that share the smallest id of a line keep it all; rows without an id keep
    a line only if no row with one has it.  An empty table gives no rows.  Other columns are left out.  A task holds one text's words.
    """
    rows = measured(df, limits, id_col, text_col, host_col)
    gone = frequent_words(rows, limits).select(F.col("row").alias("its_row"), "gone")
    removed = F.coalesce("gone", F.lit(0)).cast("long")
    return rows.drop("lines").join(gone, F.col("row") == F.col("its_row"), "left").select(
        F.col("doc").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        removed.alias("removed_words"), enough(limits, removed).alias("kept"))


def without_lines(df: DataFrame, verdicts: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """The rows of ``df`` that ``verdicts`` (row, kept, lost) keep or do not name, without the lines they lose.

    The verdicts are written without the texts and read back, so that their size
    is known: the texts are shuffled only where it is too large to be sent to them.
    """
    names = ["_row", "_lost", "_kept"]
    while set(names) & set(df.columns):
        names = [n + "_" for n in names]
    row, lost, kept = names
    known = cut_lineage(verdicts.select(F.col("row").alias(row), F.col("lost").alias(lost), F.col("kept").alias(kept)).distinct(), "verdicts")
    text, host = quoted(text_col), F.coalesce(quoted(host_col).cast("string"), F.lit(""))
    left = F.when(F.col(lost).isNull(), text).otherwise(F.array_join(
        F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col(lost), F.xxhash64(host, normal(x)))), "\n"))
    return (df.withColumn(row, row_key(id_col, text_col, host_col)).join(known, row, "left")
            .where(F.coalesce(F.col(kept), F.lit(True)))
            .select(*[left.alias(c) if c == text_col else quoted(c) for c in df.columns]))


def remove_frequent(df: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text",
                    host_col: str = "source") -> DataFrame:
    """The rows of ``df`` with the frequent lines of their hosts taken out of their texts.

    Every place of such a line goes, but not from the rows of the id that keeps it
    (see ``judge``).  Other lines, empty ones too, stay as they are; so
    do all rows, null texts and further columns.
    """
    rows = measured(df, limits, id_col, text_col, host_col)
    losing = frequent_words(rows, limits).select("row", "lost", F.lit(True).alias("kept"))
    return without_lines(df, losing, id_col, text_col, host_col)


def reject(df: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text",
           host_col: str = "source") -> DataFrame:
    """The rows of ``df`` whose text is kept, without the frequent lines, with all their columns.

    Texts are judged whole, as in ``judge``.  The lines of rows that fail count
    all the same, and one of them may be the document that keeps a line.
    """
    rows = measured(df, limits, id_col, text_col, host_col)
    gone = frequent_words(rows, limits).withColumnRenamed("row", "its_row")
    judged = rows.drop("lines").join(gone, F.col("row") == F.col("its_row"), "left")
    judged = judged.withColumn("kept", enough(limits, F.coalesce("gone", F.lit(0))))
    named = judged.where(~F.col("kept") | F.col("lost").isNotNull())
    lost = F.when(F.col("kept"), F.col("lost"))
    return without_lines(df, named.select("row", lost.alias("lost"), "kept"), id_col, text_col, host_col)


def oracle(limits: Limits = Limits()) -> str:
    """The same in SQL for the table of documents."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{BLANK}'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (
          SELECT rid, unnest([i, i + 1, i + 2]) AS p
          FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c >= 2) GROUP BY rid),
l AS (SELECT rid, x, lower(trim(regexp_replace(x, '{BLANK}', ' ', 'g'))) AS norm
      FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d)),
dup AS (SELECT rid, count(*) - count(DISTINCT x) AS n FROM l WHERE norm <> '' GROUP BY rid),
tl AS (SELECT d.doc_id, host, t, norm, sum(len(string_split(norm, ' '))) AS n
       FROM (SELECT DISTINCT ON (doc_id, host, t) * FROM d) d JOIN l USING (rid) WHERE norm <> '' GROUP BY ALL),
f AS (SELECT host, norm, min(doc_id) AS keeper FROM tl GROUP BY host, norm HAVING count(*) > {limits.documents}),
lost AS (SELECT tl.doc_id, tl.host, tl.t, sum(n) AS gone FROM tl JOIN f ON tl.host = f.host AND tl.norm = f.norm
         WHERE tl.doc_id IS DISTINCT FROM f.keeper GROUP BY ALL),
whole AS (SELECT rid, sum(len(string_split(norm, ' '))) AS line_words FROM l WHERE norm <> '' GROUP BY rid),
b AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(w.t, '{BLANK}', '', 'g')) AS word_chars,
        length(w.t) - length(translate(w.t, '{SYMBOLS}', '')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone, 0)::BIGINT AS removed_words,
        coalesce(line_words, 0)::BIGINT AS line_words
      FROM w LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN whole USING (rid)
      LEFT JOIN lost ON lost.doc_id IS NOT DISTINCT FROM w.doc_id AND lost.host = w.host AND lost.t = w.t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {limits.words} OR 100 * n_repeat_words > {limits.repeated} * n_words AS base_failed, removed_words,
  NOT (n_words < {limits.words} OR 100 * n_repeat_words > {limits.repeated} * n_words)
    AND 100 * (line_words - removed_words) >= {limits.remaining} * line_words AS kept FROM b"""
