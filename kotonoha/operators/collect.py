"""De-duplication, cascades, top-k, pages, totals and guesses."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kotonoha import fixed
from kotonoha.plans.scaling import grown, measured_join
from kotonoha.session import cut_lineage

HIT_COLUMNS = ["query_id", "item_id", "relevance", "producer", "seq"]


def merge_hits(hits: DataFrame) -> DataFrame:
    """One row per (query, item): the first in (producer, seq) order wins.

    A plain aggregate with map-side combine, so copies of one item never meet
    unaggregated in one task.
    """
    first = F.min_by(F.struct("relevance", "producer", "seq"), F.struct("producer", "seq"))
    return (hits.groupBy("query_id", "item_id").agg(first.alias("h"))
            .select("query_id", "item_id", "h.relevance", "h.producer", "h.seq"))


def hits_so_far(hits: DataFrame) -> DataFrame:
    """query_id, found: distinct items per query."""
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))


class Stage:
    """One producer of a cascade.

    ``run`` maps the queries still open to hits; ``wanted`` is the form and
    language test on the query table; the stage runs for queries with fewer than
    ``below`` items so far (None: always).  ``few``: it finds at most so many items per query, as a look-up by id does.
    """

    def __init__(self, producer: int, run: Callable[[DataFrame], DataFrame], wanted: Column,
                 below: int | None = None, few: int | None = None):
        self.producer, self.run, self.wanted, self.below, self.few = producer, run, wanted, below, few


def cascade(queries: DataFrame, stages: list[Stage], keep: Callable[[DataFrame], DataFrame] | None = None,
            depth: int | None = None) -> DataFrame:
    """Run the stages in order; a gated stage only sees unsatisfied queries.

    The hits of the stages before a gate are written out once, so the count at
    the gate and the final union read the stored rows instead of running the
    earlier searches again.

    With a ``depth`` the best ``depth`` hits of every query are right, and others may be
    missing: a rank filter that works before the exchange then replaces the exchange of all
    hits.  An item counts for the first stage that finds it, so hits may go only
    where no other stage can bring the same item: those of a query that one ungated stage
    answers, besides earlier ones of ``few`` items, and those of gated stages, which know how
    many items came before.  Other hits stay whole.
    """
    merged: DataFrame | None = None
    pending: list[DataFrame] = []
    most = None if depth is None else max([depth, *[s.below for s in stages if s.below is not None]])
    extra = sum(s.few for s in stages if s.few is not None)

    def shared(stage: Stage) -> Column:
        """Another stage may answer the query and bring items that this one has left behind."""
        place = stages.index(stage)
        return reduce(lambda a, b: a | b, [F.coalesce(s.wanted, F.lit(False)) for i, s in enumerate(stages)
                                           if s.below is None and i != place and (s.few is None or i > place)], F.lit(False))

    def best(hits: DataFrame, rows: int) -> DataFrame:
        return top_k(merge_hits(hits), rows).select(*HIT_COLUMNS)

    def flush() -> DataFrame | None:
        nonlocal merged, pending
        if pending:
            every = pending if merged is None else [merged, *pending]
            out = every[0]
            for p in every[1:]:
                out = out.unionByName(p)
            merged, pending = cut_lineage(merge_hits(out), "cascade"), []
        return merged

    for stage in stages:
        open_queries = queries.where(stage.wanted)
        if stage.below is not None and (merged is not None or pending):
            done = hits_so_far(flush()).where(F.col("found") >= stage.below)
            open_queries = open_queries.join(grown(done.select("query_id")), "query_id", "left_anti")
        hits = stage.run(open_queries).withColumn("producer", F.lit(stage.producer))
        if keep is not None:
            hits = keep(hits)
        hits = hits.select(*HIT_COLUMNS)
        if most is not None and stage.below is not None:
            hits = best(hits, most + stage.below - 1)
        elif most is not None and stage.few is None:
            whole = cut_lineage(open_queries.where(shared(stage)).select("query_id"), "whole")
            if not whole.isEmpty():
                pending.append(measured_join(hits, whole, ["query_id"], "left_semi"))
                hits = measured_join(hits, whole, ["query_id"], "left_anti")
            hits = best(hits, most + extra)
        pending.append(hits.select(*HIT_COLUMNS))
    out = pending if merged is None else [merged, *pending]
    result = out[0]
    for p in out[1:]:
        result = result.unionByName(p)
    return merge_hits(result)


def _order(desc: Column | None = None) -> list[Column]:
    return [F.col("relevance").desc(), F.col("producer").asc(), F.col("item_id").asc()]


def top_k(hits: DataFrame, k: int, order: list[Column] | None = None) -> DataFrame:
    """rank 1..k per query.  The rank filter is pushed below the shuffle (each
    task keeps k rows per query), so a query with very many hits does not
    gather them in one task."""
    w = Window.partitionBy("query_id").orderBy(*(order or _order()))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def page(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """The rows of each query's page; ``queries``: query_id, page_offset, page_size.

    No page is too far behind: a query's ranks end only where its own page does.
    """
    asked = queries.select("query_id", "page_offset", "page_size")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*_order()))
    return hits.join(asked, "query_id").withColumn("rank", rank).where(
        (F.col("rank") > F.col("page_offset")) & (F.col("rank") <= F.col("page_offset") + F.col("page_size")))


def cut_by_distance(hits: DataFrame, distance: float | None, exempt: Column | None = None) -> DataFrame:
    """Keep rows within ``distance`` of the query's best; done before ranking.

    The best is an aggregate joined back, not a window over all hits.
    """
    if distance is None:
        return hits
    best = hits.groupBy("query_id").agg(F.max("relevance").alias("_best"))
    near = F.col("relevance") + F.lit(float(distance)) >= F.col("_best")
    keep = near if exempt is None else (near | exempt)
    return hits.join(best, "query_id").where(keep).drop("_best")


def totals(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))


def guess(queries: DataFrame, hits: DataFrame, limit: int = fixed.GUESS_LIMIT) -> DataFrame:
    """query_id, guess_value, guess_type: distinct items counted up to limit + 1."""
    n = hits.select("query_id", "item_id").distinct().groupBy("query_id").agg(
        F.least(F.count(F.lit(1)), F.lit(limit + 1)).alias("n"))
    counted = queries.select("query_id").join(n, "query_id", "left").withColumn(
        "n", F.coalesce("n", F.lit(0)))
    return counted.select("query_id", *with_limit(F.col("n"), limit))


def term_guess(queries: DataFrame, terms: DataFrame, postings: DataFrame, doc: str = "doc_id",
               limit: int = fixed.GUESS_LIMIT) -> DataFrame:
    """query_id, guess_value, guess_type: documents with any of a query's terms, counted up to limit + 1.

    ``terms``: query_id and the key columns of the postings, which are those that
    both tables have.  Of every key only limit + 1 documents are kept, a rank filter
    that works before the exchange: a key with more fills the count by itself, and
    one with fewer keeps them all, so the guess is exact and a term of a third of
    all documents costs no more than a rare one.
    """
    keys = [c for c in terms.columns if c in postings.columns]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(doc))
    few = postings.select(*keys, doc).distinct().withColumn("_n", rank).where(F.col("_n") <= limit + 1).drop("_n")
    return guess(queries, terms.join(few, keys).select("query_id", F.col(doc).alias("item_id")), limit)


def with_limit(value: Column, limit: int) -> list[Column]:
    return [F.least(value, F.lit(limit)).cast("int").alias("guess_value"),
            F.when(value > limit, "MoreThan").otherwise("Accurate").alias("guess_type")]


def kanji_guess(queries: DataFrame, kanji: DataFrame, col: str = "q", limit: int = 15) -> DataFrame:
    """How many known kanji the query holds, at most ``limit``."""
    from kotonoha.operators.retrieve import kanji_of_text
    n = kanji_of_text(queries, kanji, col, limit).groupBy("query_id").agg(
        F.count(F.lit(1)).cast("int").alias("guess_value"))
    return queries.select("query_id").join(n, "query_id", "left").select(
        "query_id", F.coalesce("guess_value", F.lit(0)).alias("guess_value"),
        F.lit("Accurate").alias("guess_type"))


def format_guess(value="guess_value", kind="guess_type") -> Column:
    prefix = F.when(F.col(kind) == "MoreThan", ">").when(F.col(kind) == "LessThan", "<").otherwise("")
    return F.concat(prefix, F.col(value).cast("string"))


def help_for_empty(queries: DataFrame, totals_: DataFrame, guesses: DataFrame) -> DataFrame:
    """query_id, target, guess_*: for queries without results, the guesses of the
    other targets, zeros dropped.  ``guesses``: query_id, target, guess_*."""
    empty = queries.join(totals_.where("total > 0"), "query_id", "left_anti").select(
        "query_id", F.col("target").alias("asked"))
    return (guesses.join(empty, "query_id")
            .where((F.col("target") != F.col("asked")) & (F.col("guess_value") > 0))
            .select("query_id", "target", "guess_value", "guess_type"))


def last_page(items: Column, size: Column, max_pages: int = fixed.MAX_PAGE) -> Column:
    return F.least(F.ceil(items / size), F.lit(max_pages)).cast("int")


def page_buttons(current: Column, last: Column, buttons: int = 5) -> Column:
    """Page numbers around the current page: as many as there are up to ``buttons``,
    the current one in the middle where both ends leave room."""
    shown = F.least(F.lit(buttons), last)
    first = F.greatest(F.lit(1), F.least(current - buttons // 2, last - shown + 1))
    return F.when(shown > 0, F.sequence(first, first + F.greatest(shown, F.lit(1)) - 1)).otherwise(
        F.array().cast("array<int>"))


def paginate(totals_: DataFrame, queries: DataFrame, max_pages: int = fixed.MAX_PAGE) -> DataFrame:
    """query_id, total, pages, current, buttons."""
    j = queries.select("query_id", "page", "page_size").join(totals_, "query_id", "left")
    j = j.withColumn("total", F.coalesce("total", F.lit(0)))
    last = last_page(F.col("total"), F.col("page_size"), max_pages)
    shown = F.greatest(last, F.lit(1))
    current = F.when(F.col("total") > 0, F.least(F.greatest("page", F.lit(1)), shown)).otherwise(0)
    return j.select("query_id", "total", F.when(F.col("total") > 0, shown).otherwise(0).alias("pages"),
                    current.cast("int").alias("current"),
                    page_buttons(F.greatest(current, F.lit(1)), last).alias("buttons"))


def kanji_order() -> list[Column]:
    """Graded, then with a frequency, then with a level; presence only."""
    return [F.col("grade").isNull().asc(), F.col("frequency").isNull().asc(),
            F.col("jlpt").isNull().asc(), F.col("literal").asc()]


def summary(queries: DataFrame, totals_: DataFrame, inflections: DataFrame | None = None,
            parts: DataFrame | None = None) -> DataFrame:
    """One row per query: total, raw query echo, hidden flag and, when the query
    was segmented, its inflections and its part surfaces."""
    out = queries.select("query_id", "raw_query", F.coalesce("hidden", F.lit(False)).alias("hidden"))
    out = out.join(totals_, "query_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    if inflections is not None:
        out = out.join(inflections.select("query_id", "inflections"), "query_id", "left")
    if parts is not None:
        listed = parts.groupBy("query_id").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "inflected"))), lambda p: p["inflected"])
            .alias("sentence"))
        out = out.join(listed, "query_id", "left")
    return out
