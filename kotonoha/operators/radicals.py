"""Characters by their parts, radicals by meaning, decompositions."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kotonoha.functions import text
from kotonoha.operators.retrieve import code_mask
from kotonoha.plans.scaling import by_key, measured_join, salted_join
from kotonoha.session import cut_lineage


def kanji_with_all(requests: DataFrame, kanji: DataFrame, salts: int | None = None) -> DataFrame:
    """query_id, literal, stroke_count: characters with **all** asked radicals.

    ``requests``: query_id, radical; ``kanji``: literal, stroke_count, parts.
    Relational division by access path: a character with all radicals has the
    rarest one, so only that posting list is read and the others are tested on
    the part array in the row, after the masks of both have ruled most pairs out.
    Radicals no character has are ignored.
    """
    freq = kanji.select(F.explode("parts").alias("radical")).groupBy("radical").agg(F.count(F.lit(1)).alias("n"))
    known = requests.select("query_id", "radical").distinct().join(freq, "radical")
    asked = known.groupBy("query_id").agg(F.min_by("radical", F.struct("n", "radical")).alias("radical"),
                                          F.collect_set("radical").alias("wanted")).withColumn("_wanted", code_mask("wanted"))
    placed = by_key(kanji.select("literal", "stroke_count", "parts"), "literal").withColumn("_parts", code_mask("parts"))
    posts = placed.select("literal", "stroke_count", "parts", "_parts", F.explode("parts").alias("radical"))
    hit = salted_join(posts, asked, ["radical"], ["literal"], salts=salts)
    hit = hit.where(F.col("_wanted").bitwiseAND(F.col("_parts")) == F.col("_wanted"))
    return hit.where(F.size(F.array_except("wanted", "parts")) == 0).select("query_id", "literal", "stroke_count")


def one_per_parts(kanji: DataFrame) -> DataFrame:
    """literal, stroke_count, parts: of the characters with the same parts only the first, for
    questions whose answer depends on the parts alone."""
    rows = kanji.where("literal is not null").select(F.array_sort(F.array_distinct("parts")).alias("parts"), "literal", "stroke_count")
    return rows.groupBy("parts").agg(F.min(F.struct("literal", "stroke_count")).alias("first")).select(
        "first.literal", "first.stroke_count", "parts")


def possible_radicals(found: DataFrame, parts: DataFrame, strokes: DataFrame) -> DataFrame:
    """query_id, strokes, radicals (sorted array): what could still be added.

    The arrays hold radicals, a fixed inventory, so they are bounded.
    """
    # characters of the same parts are one to a query; both distincts run map-side first
    alike = parts.groupBy("literal").agg(F.array_sort(F.collect_set("radical")).alias("parts"))
    sets = measured_join(found.select("query_id", "literal"), alike, ["literal"]).select("query_id", "parts").distinct()
    pairs = sets.select("query_id", F.explode("parts").alias("radical")).distinct()
    sized = pairs.join(F.broadcast(strokes), pairs.radical == strokes.literal).select(
        "query_id", F.col("stroke_count").alias("strokes"), "radical")
    return sized.groupBy("query_id", "strokes").agg(
        F.array_sort(F.collect_set("radical")).alias("radicals"))


def by_strokes(found: DataFrame) -> DataFrame:
    """query_id, strokes, literal, pos: the characters, listed per stroke count.

    Kept in rows: the number of characters is not bounded by the query.
    """
    w = Window.partitionBy("query_id", "stroke_count").orderBy("literal")
    return found.select("query_id", F.col("stroke_count").alias("strokes"), "literal",
                        F.row_number().over(w).alias("pos"))


def radicals_by_meaning(queries: DataFrame, meanings: DataFrame, max_distance: int = 2,
                        max_terms: int = 3, limit: int = 5) -> DataFrame:
    """query_id, literal: the exact term, else up to three similar terms; at most
    five radicals per query.

    Similar terms: edit distance at most two, found through deletion keys (two
    words within distance d share a text that lacks at most d characters of
    each), which turns the distance join into an equi-join.
    """
    vocab = meanings.select("term").distinct()
    exact = queries.join(vocab.withColumnRenamed("term", "q"), "q", "left_semi").select(
        "query_id", F.col("q").alias("term"), F.lit(0).alias("dist"))
    open_q = queries.join(vocab.withColumnRenamed("term", "q"), "q", "left_anti")
    near = similar_terms(open_q, vocab, max_distance)
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(
        "dist", "term"))).where(F.col("n") <= max_terms).drop("n")
    chosen = exact.unionByName(near)
    hits = salted_join(meanings, chosen, ["term"], ["literal"])
    best = hits.groupBy("query_id", "literal").agg(F.min(F.struct("dist", "term")).alias("b"))
    return best.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(
        "b.dist", "b.term", "literal"))).where(F.col("n") <= limit).select("query_id", "literal")


def deletion_keys(col, distance: int):
    """All texts that lack up to ``distance`` characters of the text."""
    def drop_one(texts):
        return F.flatten(F.transform(texts, lambda t: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))),
            lambda i: F.concat(F.substring(t, F.lit(1), i - 1),
                               F.substring(t, i + 1, F.length(t))))))

    level = F.array(text._c(col))
    every = level
    for _ in range(distance):
        level = F.array_distinct(drop_one(level))
        every = F.concat(every, level)
    return F.array_distinct(every)


def similar_terms(queries: DataFrame, vocab: DataFrame, distance: int) -> DataFrame:
    """query_id, term, dist with edit distance <= ``distance`` (exact)."""
    q = queries.select("query_id", "q", F.explode(deletion_keys("q", distance)).alias("key"))
    v = vocab.select("term", F.explode(deletion_keys("term", distance)).alias("key"))
    pairs = salted_join(v, q, ["key"], ["term"]).select("query_id", "q", "term").distinct()
    scored = pairs.withColumn("dist", F.levenshtein("q", "term"))
    return scored.where(F.col("dist") <= distance).select("query_id", "term", "dist")


def radicals_of_words(hits: DataFrame, kanji_parts: DataFrame, words: int = 3, limit: int = 10) -> DataFrame:
    """query_id, radical: parts of the kanji of the best words, first ten.

    ``hits``: query_id, item_id, relevance, reading.
    """
    best = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(
        F.col("relevance").desc(), "item_id"))).where(F.col("rank") <= words)
    ch = best.select("query_id", "rank", F.posexplode(text.chars("reading")).alias("pos", "literal"))
    parts = ch.join(kanji_parts.select("literal", F.posexplode("parts").alias("i", "radical")), "literal")
    first = parts.groupBy("query_id", "radical").agg(F.min(F.struct("rank", "pos", "i")).alias("at"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(
        "at", "radical"))).where(F.col("n") <= limit).select("query_id", "radical")


def radical_search(queries: DataFrame, kanji_parts: DataFrame, meanings: DataFrame,
                   japanese_hits: DataFrame, word_hits: DataFrame) -> DataFrame:
    """query_id, radical, by the kind of text: kanji give their parts, other
    Japanese text goes through words, Latin text (two characters and more)
    through meanings, topped up by words when four or fewer were found."""
    with_kanji = queries.where(text.is_japanese("q") & text.has_kanji("q"))
    ch = with_kanji.select("query_id", F.explode(text.chars("q")).alias("literal"))
    from_kanji = ch.join(kanji_parts.select("literal", F.explode("parts").alias("radical")), "literal")
    japanese = queries.where(text.is_japanese("q") & ~text.has_kanji("q"))
    from_words = radicals_of_words(
        japanese_hits.join(japanese.select("query_id"), "query_id", "left_semi"), kanji_parts)
    latin = queries.where(~text.is_japanese("q") & (F.octet_length("q") >= 2))
    by_meaning = radicals_by_meaning(latin, meanings).withColumnRenamed("literal", "radical")
    enough = by_meaning.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where("n > 4")
    short = latin.join(enough, "query_id", "left_anti")
    topped = radicals_of_words(
        word_hits.join(short.select("query_id"), "query_id", "left_semi"), kanji_parts)
    out = from_kanji.select("query_id", "radical")
    for part in (from_words, by_meaning, topped):
        out = out.unionByName(part.select("query_id", "radical"))
    return out.distinct()


def similar_kanji(requests: DataFrame, kanji: DataFrame, per_part: int = 10, limit: int = 50) -> DataFrame:
    """query_id, rank, literal: each asked kanji, then for each of its parts the
    ten lowest-stroke kanji sharing the part that are not simpler than it.

    ``requests``: query_id, pos, literal.  The ten are taken per *part* once, not
    per pair of kanji, so no pairs within a part are formed.
    """
    parts = kanji.select("literal", "stroke_count", F.posexplode("parts").alias("part_pos", "part"))
    lowest = (parts.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(
        "stroke_count", "literal"))).where(F.col("k") <= per_part)
        .select("part", "k", F.col("literal").alias("other"), F.col("stroke_count").alias("other_strokes")))
    asked = requests.join(parts, "literal")
    shared = asked.join(lowest, "part").where(F.col("other_strokes") >= F.col("stroke_count"))
    own = requests.join(kanji.select("literal"), "literal").select(
        "query_id", F.col("literal").alias("found"),
        F.struct("pos", F.lit(-1).alias("part_pos"), F.lit(0).alias("k")).alias("at"))
    near = shared.select("query_id", F.col("other").alias("found"),
                         F.struct("pos", "part_pos", "k").alias("at"))
    first = own.unionByName(near).groupBy("query_id", "found").agg(F.min("at").alias("at"))
    return (first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(
        "at", "found"))).where(F.col("rank") <= limit)
        .select("query_id", "rank", F.col("found").alias("literal")))


def group_by_strokes(radicals: DataFrame, strokes: DataFrame) -> DataFrame:
    """query_id, strokes, radicals: found radicals by stroke count; what is not in
    the picker drops out."""
    s = strokes.select(F.col("literal").alias("radical"), F.col("stroke_count").alias("strokes"))
    return (radicals.join(F.broadcast(s), "radical").groupBy("query_id", "strokes")
            .agg(F.array_sort(F.collect_set("radical")).alias("radicals")))


# -- decomposition ----------------------------------------------------------------------------
def preferred_edges(edges: DataFrame) -> DataFrame:
    """parent, pos, child of the Japanese composition, else of the only one."""
    origins = edges.groupBy("parent").agg(
        F.max(F.when(F.col("origin") == "Japan", "Japan")).alias("jp"),
        F.min("origin").alias("low"), F.max("origin").alias("high"))
    chosen = origins.select("parent", F.when(F.col("jp").isNotNull(), F.col("jp")).when(
        F.col("low") == F.col("high"), F.col("low")).alias("origin")).where("origin is not null")
    return edges.join(chosen, ["parent", "origin"]).select("parent", "pos", "child")


def decompose(roots: DataFrame, edges: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """root, depth, path, literal: the decomposition trees of all roots.

    Level by level: the frontier joins the edge table, its rows are written to
    the shared folder, and the loop ends with an empty frontier, however deep the
    trees are.  A character that is already on the path is not opened again, so
    cycles end too.
    Characters of ``stop`` (radicals) are kept but not opened.  ``path`` lists
    the child positions.  Children without an own entry are not shown.
    """
    nodes = edges.select(F.col("parent").alias("child")).distinct()
    inner = edges.join(nodes, "child", "left_semi").where("parent <> child")
    first = inner.groupBy("parent", "child").agg(F.min("pos").alias("pos"))
    level = roots.join(nodes.withColumnRenamed("child", "root"), "root", "left_semi").select(
        "root", F.lit(0).alias("depth"), F.lit("").alias("path"), F.col("root").alias("literal"),
        F.array("root").alias("seen"))
    out = level
    for depth in count(1):
        open_ = level
        if stop is not None:
            open_ = open_.join(stop, "literal", "left_anti")
        nxt = (open_.join(first, open_.literal == first.parent)
               .where(~F.array_contains("seen", F.col("child")))
               .select("root", F.lit(depth).alias("depth"),
                       F.concat_ws(".", F.nullif("path", F.lit("")), F.col("pos").cast("string")).alias("path"),
                       F.col("child").alias("literal"),
                       F.concat("seen", F.array("child")).alias("seen")))
        level = cut_lineage(nxt, "decompose")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.select("root", "depth", "path", "literal")


def has_other_view(full: DataFrame, short: DataFrame) -> DataFrame:
    """root, differs: whether the full and the short tree are different."""
    a = full.groupBy("root").agg(F.count(F.lit(1)).alias("nf"))
    b = short.groupBy("root").agg(F.count(F.lit(1)).alias("ns"))
    return a.join(b, "root").select("root", (F.col("nf") != F.col("ns")).alias("differs"))


def page_kanji(pages: DataFrame, kanji: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, pos, literal: distinct known kanji of a result page, in order.

    ``pages``: query_id, rank, reading (the kanji reading of each hit).
    """
    ch = pages.select("query_id", "rank", F.posexplode(text.chars("reading")).alias("i", "literal"))
    known = ch.join(kanji.select("literal"), "literal", "left_semi")
    first = known.groupBy("query_id", "literal").agg(F.min(F.struct("rank", "i")).alias("at"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(
        "at"))).where(F.col("pos") <= limit).select("query_id", "pos", "literal")
