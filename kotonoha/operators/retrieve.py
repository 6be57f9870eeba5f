"""Retrieval: candidates of a whole query table by joins on index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from pyspark.sql.window import Window

from kotonoha import fixed
from kotonoha.functions import kana, text
from kotonoha.operators import index
from kotonoha.plans.scaling import by_key, grown, is_small, measured_join, salted_join, sliced_join
from kotonoha.session import cut_lineage

#: Items that a task of a search without threshold takes, and the counters of one of its blocks.
ITEMS_PER_TASK, BLOCK_CELLS = 20_000, 4_000_000


# -- character n-grams ---------------------------------------------------------------
def query_grams(queries: DataFrame, col: str = "q", n: int = fixed.NGRAM_N,
                keep: list[str] | None = None) -> DataFrame:
    """query_id, q_grams (distinct), gram, plus the ``keep`` columns."""
    keep = keep or []
    q = queries.select("query_id", *keep, text.index_grams(col, n).alias("g"))
    return q.select("query_id", *keep, F.size("g").alias("q_grams"), F.explode("g").alias("gram"))


def length_window(n_grams: Column, q_grams: Column, threshold: Column | float) -> Column:
    """Dice >= t needs t/(2-t) * q <= n <= (2-t)/t * q (exact, prunes early)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    slack = F.lit(1e-6)  # keeps pairs that sit exactly on the bound
    low = n_grams * (F.lit(2.0) - t) + slack >= q_grams * t
    high = n_grams * t <= q_grams * (F.lit(2.0) - t) + slack
    return low & high


def ngram_candidates(grams: DataFrame, items: DataFrame, threshold: float | Column | None = None,
                     on: list[str] | None = None, salts: int | None = None, weight: float = 0.5) -> DataFrame:
    """query_id, item_id, overlap, q_grams, n_grams: items sharing a gram.

    ``items`` has one row per item with its gram array (``index.ngram_items``), or
    one row per gram (stored postings).  While the query grams are small enough to be
    broadcast (measured), items with gram arrays are counted in blocks (``block_counts``), and
    postings are hash-partitioned by id, so that all pairs of an item arise and are counted in
    one task without another exchange.  Larger query logs join on the salted gram instead.

    With a ``threshold`` only pairs that can reach the score need to be found:
    those that share one of the rarest grams of both sides (items with
    gram arrays), or those of fitting sizes (postings).  The score is the dice, or with gram arrays the
    one that counts an item's grams by ``weight`` (``score.dice_weighted``).  ``on`` adds join columns
    (a posting).
    """
    keys = [*(on or []), "gram"]
    carried = [c for c in grams.columns if c not in ("query_id", "gram", "q_grams", *(on or []))]
    if threshold is not None and "grams" in items.columns:
        t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
        return prefix_candidates(grams, items, t, on or [], carried, weight)
    asked = cut_lineage(grams, "query-grams")
    small, one = is_small(asked), "grams" in items.columns
    if small and one and not on:
        return block_counts(asked, items, carried)
    # items are placed before their grams, which then stay with them
    placed = by_key(items, "item_id") if small else items
    posts = placed.select(*(on or []), "item_id", "n_grams", F.explode("grams").alias("gram") if one else "gram")
    if small:
        pairs = posts.join(F.broadcast(asked), keys)
    else:
        pairs = salted_join(posts, asked, keys, ["item_id"], salts=salts)
    if threshold is not None:
        pairs = pairs.where(length_window(F.col("n_grams"), F.col("q_grams"), threshold))
    # constant per pair; max keeps the aggregation buffers of fixed size
    first = [F.max(c).alias(c) for c in ("q_grams", "n_grams", *carried)]
    return pairs.groupBy("query_id", "item_id").agg(F.count(F.lit(1)).alias("overlap"), *first)


def block_counts(asked: DataFrame, items: DataFrame, carried: list[str]) -> DataFrame:
    """query_id, item_id, overlap, q_grams, n_grams of all items sharing a gram with a small query table.

    Queries get running numbers.  A task looks the grams of a batch of items up among the queries'
    and counts the meetings of a block of items and all queries in one array, so no row
    arises per shared gram; an item leaves with the numbers and counts of the queries it
    met, which become rows afterwards.  Equal ids, of items or of queries, are one.
    """
    items = cut_lineage(items.select("item_id", "n_grams", "grams"), "gram-items")  # read twice
    units = cut_lineage(asked.groupBy("query_id", "q_grams", *carried).agg(F.collect_list("gram").alias("grams"))
                        .coalesce(1).withColumn("_unit", F.monotonically_increasing_id()), "query-units")
    size = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    tasks = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size["rows"] or 0) // ITEMS_PER_TASK))
    schema = StructType([items.schema["item_id"], items.schema["n_grams"], StructField("_hits", ArrayType(LongType()))])
    met = items.repartition(tasks, "item_id").mapInArrow(block_counter(units.orderBy("_unit").select("grams").toArrow()["grams"]), schema)
    hits = met.select("item_id", "n_grams", F.explode("_hits").alias("_hit")).select(
        "item_id", "n_grams", F.shiftright("_hit", 32).alias("_unit"), F.col("_hit").bitwiseAND(F.lit(0xFFFFFFFF)).alias("overlap"))
    pairs = hits.join(F.broadcast(units.drop("grams")), "_unit").select(
        "query_id", "item_id", "overlap", "q_grams", "n_grams", *carried)
    if (size["most"] or 0) <= 1 and units.select("query_id").distinct().count() == units.count():
        return pairs
    return pairs.groupBy("query_id", "item_id").agg(F.sum("overlap").alias("overlap"), *[
        F.max(c).alias(c) for c in ("q_grams", "n_grams", *carried)])


def block_counter(lists):
    """What counts the queries (a list of grams each) that batches of items meet: 2**32 times the query's number plus the shared grams."""
    import numpy as np

    owners = np.repeat(np.arange(len(lists)), [len(x) for x in lists.to_pylist()])
    coded = lists.combine_chunks().flatten().dictionary_encode()
    known, codes = coded.dictionary, coded.indices.to_numpy()
    members = owners[np.argsort(codes, kind="stable")]
    sizes = np.bincount(codes, minlength=len(known))
    starts = np.cumsum(sizes) - sizes
    width = len(lists)
    block = max(1, BLOCK_CELLS // max(width, len(members), 1))

    def count(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            grams = batch.column("grams")
            held = pc.fill_null(pc.list_value_length(grams), 0).to_numpy(zero_copy_only=False)
            code = pc.fill_null(pc.index_in(grams.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(held)), held)[code >= 0]
            code = code[code >= 0]
            for low in range(0, len(held), block):
                rows = min(block, len(held) - low)
                a, b = np.searchsorted(row, [low, low + rows])
                asking = sizes[code[a:b]]
                first = np.repeat(starts[code[a:b]] - np.cumsum(asking) + asking, asking)
                cells = np.repeat((row[a:b] - low) * width, asking) + members[first + np.arange(len(first))]
                counts = np.bincount(cells, minlength=rows * width)
                found = np.flatnonzero(counts)
                ends = np.concatenate([[0], np.cumsum(np.bincount(found // max(width, 1), minlength=rows))]).astype(np.int32)
                hits = pa.ListArray.from_arrays(pa.array(ends), pa.array((found % max(width, 1) << 32) + counts[found]))
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(low, rows), batch.column("n_grams").slice(low, rows), hits],
                                                 ["item_id", "n_grams", "_hits"])

    return count


def gram_order(items: DataFrame) -> DataFrame:
    """gram, code: the items' grams numbered by rising frequency.

    A range-partitioned sort gives the order and the row numbers of the sorted
    partitions the codes, so no task sees the whole vocabulary.  Written, because the
    codes must not change between uses.
    """
    counted = items.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(counted.orderBy("n", "gram").select("gram", F.monotonically_increasing_id().alias("code")), "gram-order")


def prefix_length(size: Column, t: Column, weight: float = 0.5) -> Column:
    """How many of a set's rarest grams are enough, if its size counts by ``weight`` and the other's by the rest: no set is
    smaller than what it shares, so a pair of score >= t shares t w / (1 - t (1 - w)) of the set at least (dice: t / (2 - t))."""
    return (size - F.greatest(F.ceil(t * weight * size / (1.0 - t * (1.0 - weight)) - 1e-6), F.lit(1)) + 1).cast("int")


def code_mask(codes: str) -> Column:
    """64 bits of an array of codes; a code sets one."""
    return F.aggregate(codes, F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c), F.lit(64)).cast("int"))))


def coded_items(items: DataFrame, order: DataFrame, on: list[str]) -> DataFrame:
    """on..., item_id, n_grams, codes: an item's grams as codes, the rarest first.  Equal item ids are one item."""
    rows = by_key(items, "item_id").select(*on, "item_id", "n_grams", F.explode("grams").alias("gram"))
    return (measured_join(rows, order, ["gram"]).groupBy(*on, "item_id", "n_grams")
            .agg(F.sort_array(F.collect_set("code")).alias("codes")))


def prefix_candidates(grams: DataFrame, items: DataFrame, t: Column, on: list[str], carried: list[str],
                      weight: float = 0.5) -> DataFrame:
    """query_id, item_id, overlap, q_grams, n_grams of all pairs of score >= t, by the rarest grams of both sides.

    Grams are numbered by rarity.  Two sets that are similar enough share one of
    the first grams of both, so only these prefixes become postings.  The first
    gram they share, at place i of one and j of the other, leaves at most
    min(a - i, b - j) shared grams, and every bit in which the masks of their
    codes differ stands for a gram of only one; pairs that cannot reach the score so are
    not compared.  The others are compared once, at their first shared gram, by
    intersecting the codes.  Both prefixes are dealt by gram over all of the
    session's partitions; grams with many postings are cut into slices of measured number.
    """
    items = cut_lineage(items.select(*on, "item_id", "n_grams", "grams"), "gram-items")  # read twice
    order = gram_order(items)
    asked = (grams.join(order, "gram", "left").groupBy("query_id", *on, *carried, "q_grams")
             .agg(F.sort_array(F.collect_set("code")).alias("q_codes")))
    asked = cut_lineage(asked.withColumn("_t", t), "coded-queries")
    unknown = F.col("q_grams") - F.size("q_codes")  # grams no item has are the rarest of all
    least = asked.agg(F.min("_t").alias("_least"))
    asked = asked.select("query_id", *on, *carried, "q_grams", "_t", "q_codes", unknown.alias("_unknown"), code_mask("q_codes").alias("_q_mask"), F.posexplode(F.slice(
        "q_codes", F.lit(1), F.greatest(prefix_length(F.col("q_grams"), F.col("_t"), 1.0 - weight) - unknown, F.lit(0)))).alias("_i", "code"))
    posts = coded_items(items, order, on).crossJoin(F.broadcast(least))  # one row
    posts = posts.where("_least is not null").select(*on, "item_id", "n_grams", "codes", code_mask("codes").alias("_mask"), F.posexplode(F.slice(
        "codes", F.lit(1), prefix_length(F.col("n_grams"), F.col("_least"), weight))).alias("_j", "code"))
    posts = cut_lineage(posts, "prefix-postings")
    pairs = sliced_join(posts, asked, [*on, "code"], ["item_id"])
    left = F.least(F.col("q_grams") - F.col("_unknown") - F.col("_i"), F.col("n_grams") - F.col("_j"))
    both = F.col("q_grams") + F.col("n_grams")
    need = F.col("_t") * (F.col("q_grams") * (2.0 - 2.0 * weight) + F.col("n_grams") * (2.0 * weight))  # twice the shared grams
    differ = F.col("_unknown") + F.bit_count(F.col("_mask").bitwiseXOR(F.col("_q_mask")))
    pairs = pairs.where((2 * left + 1e-6 >= need) & (both - differ + 1e-6 >= need))
    # Exploded from an array of one, the intersection is worked out once and not again in every condition on it.
    pairs = pairs.select("query_id", "item_id", "q_grams", "n_grams", *carried, "code", "_t",
                         F.explode(F.array(F.array_intersect("q_codes", "codes"))).alias("_shared"))
    overlap = F.size("_shared").cast("long")
    return pairs.where((F.col("_shared")[0] == F.col("code")) & (2 * overlap + 1e-6 >= need)).select(
        "query_id", "item_id", overlap.alias("overlap"), "q_grams", "n_grams", *carried)


# -- term vectors -----------------------------------------------------------------------
def gloss_query_terms(queries: DataFrame, col: str = "q", keep: list[str] | None = None
                      ) -> DataFrame:
    """query_id, term, qw: the phrase weighs 1, each of its words 0.001."""
    keep = keep or []
    phrase = text.drop_leading_to(text.strip_punctuation(F.trim(F.col(col))))
    q = queries.select("query_id", *keep, phrase.alias("p"))
    words = F.transform(F.filter(F.split("p", " "), lambda w: w != ""),
                        lambda w: F.struct(w.alias("term"), F.lit(0.001).alias("qw")))
    both = F.concat(F.array(F.struct(F.col("p").alias("term"), F.lit(1.0).alias("qw"))), words)
    rows = q.select("query_id", *keep, F.explode(both).alias("t")).select(
        "query_id", *keep, "t.term", "t.qw")
    return rows.where("term <> ''").groupBy("query_id", *keep, "term").agg(F.max("qw").alias("qw"))


def sentence_query_terms(queries: DataFrame, col: str = "q", keep: list[str] | None = None,
                         tokens=text.terms) -> DataFrame:
    """query_id, term, qw: the distinct words and the whole text, weight 1."""
    keep = keep or []
    every = F.array_distinct(F.concat(tokens(col), F.array(F.lower(F.col(col)))))
    return queries.select("query_id", *keep, F.explode(every).alias("term")).withColumn(
        "qw", F.lit(1.0))


def vector_candidates(query_terms: DataFrame, vectors: DataFrame, on: list[str] | None = None,
                      salts: int | None = None) -> DataFrame:
    """query_id, posting, doc_id, dot, shared: documents sharing a term.

    Only query terms that are indexed count towards the query norm, which
    ``query_norms`` computes from the same inputs.
    """
    keys = [*(on or []), "term"]
    asked = cut_lineage(query_terms, "query-terms")
    if is_small(asked):  # documents are placed once, before their pairs arise, and pairs are counted there
        known = vectors.join(F.broadcast(asked.select(*keys).distinct()), keys, "left_semi")
        joined = by_key(known, "posting", "doc_id").join(F.broadcast(asked), keys)
    else:
        joined = salted_join(vectors, asked, keys, ["doc_id"], salts=salts)
    return joined.groupBy("query_id", "posting", "doc_id").agg(
        F.sum(F.col("qw") * F.col("weight")).alias("dot"), F.count(F.lit(1)).alias("shared"))


def query_norms(query_terms: DataFrame, vocabulary: DataFrame, on: list[str] | None = None
                ) -> DataFrame:
    """query_id, norm_q over the terms the index knows (semi-join)."""
    known = query_terms.join(vocabulary, [*(on or []), "term"], "left_semi")
    return known.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("norm_q"))


def native_query_terms(queries: DataFrame, vocabulary: DataFrame, parts: DataFrame) -> DataFrame:
    """query_id, term, qw for native sentence search.

    The whole query if it is an indexed term; else the inflected and normalised
    forms of its parts (``parts``: query_id, inflected, normalised, n_parts).
    One inflected word falls back to its normalised form only if the inflected
    one is not indexed.
    """
    vocab = cut_lineage(vocabulary.select("term").distinct(), "vocabulary")  # joined to queries and to forms
    vocab = F.broadcast(vocab) if is_small(vocab) else grown(vocab)
    whole = queries.select("query_id", text.to_halfwidth("q").alias("term")).join(vocab, "term", "left_semi")
    whole = cut_lineage(whole.distinct(), "whole-queries")
    rest = measured_join(parts, whole.select("query_id"), ["query_id"], "left_anti").where("query_id is not null")
    forms = rest.select("query_id", "n_parts", F.explode(F.array(
        F.struct(F.lit(0).alias("pref"), text.to_halfwidth("inflected").alias("term")),
        F.struct(F.lit(1).alias("pref"), text.to_halfwidth("normalised").alias("term")))).alias("f")
    ).select("query_id", "n_parts", "f.pref", "f.term").distinct()  # a text repeats its words
    known = forms.join(vocab, "term", "left_semi")
    known = known.withColumn("best", F.min("pref").over(Window.partitionBy("query_id")))
    chosen = known.where((F.col("n_parts") > 1) | (F.col("pref") == F.col("best"))).select("query_id", "term").distinct()
    return whole.select("query_id", "term").unionByName(chosen).withColumn("qw", F.lit(1.0))


# -- look-ups ------------------------------------------------------------------------------
def by_id(queries: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Primary-key look-up of (query_id, seq)."""
    return queries.join(grown(records), F.col("seq") == F.col(key))


def direct_word_language(senses: str | Column, lang: Column, english: Column) -> Column:
    """English is shown as well when the user's language has no sense."""
    senses = F.col(senses) if isinstance(senses, str) else senses
    return english | ~F.exists(senses, lambda s: s["language"] == lang)


def reading_exists(queries: DataFrame, readings: DataFrame) -> DataFrame:
    """The queries that are exactly some reading (semi-join)."""
    return queries.join(grown(readings.select(F.col("reading").alias("q")).distinct()), "q", "left_semi")


# -- wildcards --------------------------------------------------------------------------------
def wildcard_candidates(queries: DataFrame, postings: DataFrame, salts: int | None = None) -> DataFrame:
    """query_id, item_id, reading: readings that match the pattern.

    ``queries``: query_id, pattern; ``postings``: ``index.wildcard_postings``.  Of
    the grams a match must hold only the query's rarest is looked up, which
    reads the shortest posting list; the pattern then proves the rest.  A gram
    missing from the index, or no literal at all, gives no rows.
    """
    freq = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    asked = queries.select("query_id", "pattern", pattern_grams("pattern").alias("grams"))
    known = asked.select("query_id", F.explode("grams").alias("gram")).join(freq, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = known.groupBy("query_id").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"),
                                           F.min("n").alias("n")).where("n > 0")
    q = asked.join(grown(rarest.select("query_id", "gram")), "query_id")
    hit = salted_join(postings, q, ["gram"], ["item_id"], salts=salts)
    # A pattern is compiled for each row it sees, so the other grams are looked for first.
    marked = F.concat(F.lit(index.HEAD), "reading", F.lit(index.TAIL))
    hit = hit.where(F.forall("grams", lambda g: marked.contains(g)))
    return hit.where(F.expr("reading rlike pattern")).select("query_id", "item_id", "reading")


def pattern_grams(pattern) -> Column:
    """The grams (as in ``index.wildcard_grams``) that every match of a wildcard pattern holds.

    The pattern is cut at its wildcards.  A piece of one character gives that
    character, longer ones their pairs; pieces at an end also give the end's mark
    with its two characters.
    """
    body = F.regexp_replace(F.regexp_replace(pattern, r"^\^|\$$", ""), r"\.\*|(\\.)|\.", "$1" + index.CUT)
    body = F.regexp_replace(body, r"\\(.)" + index.CUT, "$1")  # what was escaped is literal again
    pieces = F.split(F.concat(F.lit(index.HEAD), body, F.lit(index.TAIL)), index.CUT)

    def grams(piece: Column) -> Column:
        single = F.when((F.length(piece) == 1) & ~piece.isin(index.HEAD, index.TAIL), F.array(piece))
        return F.coalesce(single, F.concat(index.pairs(piece), index.ends(piece)))

    return F.array_distinct(F.flatten(F.transform(pieces, grams)))


# -- kanji + reading -----------------------------------------------------------------------------
def kanji_reading_candidates(queries: DataFrame, kanji: DataFrame, keys: DataFrame) -> DataFrame:
    """query_id, item_id for (query_id, literal, reading) queries; only readings
    the kanji has are searched."""
    known = kanji.select("literal", F.explode(F.concat("kunyomi", "onyomi")).alias("reading")).distinct()
    valid = queries.join(known, ["literal", "reading"], "left_semi")
    keyed = valid.select("query_id", F.concat("literal", "reading").alias("key"))
    return salted_join(keys, keyed, ["key"], ["item_id"]).select("query_id", "item_id").distinct()


def names_by_kanji_reading(queries: DataFrame, aligned: DataFrame) -> DataFrame:
    """query_id, item_id: names where the literal is read as asked.

    ``aligned``: item_id, literal, reading of every name (split per kanji).
    """
    hit = salted_join(aligned.withColumnRenamed("reading", "part"), queries, ["literal"], ["item_id"])
    return hit.where(F.col("part").contains(F.col("reading"))).select("query_id", "item_id").distinct()


# -- tag scans ----------------------------------------------------------------------------------------
def driving_tag(query_tags: DataFrame, cardinalities: DataFrame) -> DataFrame:
    """query_id, tag_type, tag: the most selective tag of each query."""
    sized = query_tags.join(cardinalities, ["tag_type", "tag"], "left")
    return sized.groupBy("query_id").agg(F.min_by(
        F.struct("tag_type", "tag"),
        F.struct(F.coalesce("freq", F.lit(2 ** 62)), F.col("tag_type"), F.col("tag"))).alias("t")
    ).select("query_id", "t.tag_type", "t.tag")


def tag_scan(driving: DataFrame, tags: DataFrame, item: str = "word_id", keep: DataFrame | None = None,
             limit: int = fixed.RESULT_LIMIT, newest_first: bool = True,
             salts: int | None = None) -> DataFrame:
    """query_id, item_id, relevance: up to ``limit`` accepted items per query.

    ``keep`` (query_id, item_id) are the rows all other filters accept; the limit
    counts accepted rows only.  Relevance is ``limit - position``.
    """
    rows = salted_join(tags, driving, ["tag_type", "tag"], [item], salts=salts)
    rows = rows.select("query_id", F.col(item).alias("item_id"))
    if keep is not None:
        rows = rows.join(grown(keep), ["query_id", "item_id"], "left_semi")
    order = F.col("item_id").desc() if newest_first else F.col("item_id").asc()
    ranked = rows.withColumn("k", F.row_number().over(
        Window.partitionBy("query_id").orderBy(order))).where(F.col("k") <= limit)
    return ranked.select("query_id", "item_id", (F.lit(float(limit + 1)) - F.col("k")).alias("relevance"))


# -- kanji look-ups ---------------------------------------------------------------------------------------
def kanji_of_text(queries: DataFrame, kanji: DataFrame, col: str = "q", limit: int = 100) -> DataFrame:
    """query_id, pos, literal: known kanji of a text, in order, first ``limit``."""
    ch = queries.select("query_id", F.posexplode(text.chars(col)).alias("pos", "literal"))
    known = ch.join(F.broadcast(kanji.select("literal")), "literal", "left_semi")  # a fixed inventory
    return known.withColumn("n", F.row_number().over(
        Window.partitionBy("query_id").orderBy("pos"))).where(F.col("n") <= limit).select(
        "query_id", "pos", "literal")


def kanji_by_korean(queries: DataFrame, kanji: DataFrame) -> DataFrame:
    return queries.join(kanji.select("literal", F.explode("korean_h").alias("q")), "q").select(
        "query_id", "literal").distinct()


def kanji_by_meaning(queries: DataFrame, kanji: DataFrame) -> DataFrame:
    lowered = queries.withColumn("q", F.lower("q"))
    return lowered.join(kanji.select("literal", F.explode("meanings").alias("q")), "q").select(
        "query_id", "literal").distinct()


# -- query variants ---------------------------------------------------------------------------------------------
def romaji_variants(queries: DataFrame) -> DataFrame:
    """query_id, variant, q: hiragana and katakana spellings of Latin queries."""
    ok = queries.where(kana.could_be_romaji("q"))
    forms = F.array(F.struct(F.lit("hira").alias("variant"), kana.search_hiragana("q").alias("q")),
                    F.struct(F.lit("kata").alias("variant"), kana.search_katakana("q").alias("q")))
    return ok.select("query_id", F.explode(forms).alias("v")).select("query_id", "v.variant", "v.q")


def language_variants(queries: DataFrame) -> DataFrame:
    """One row per language to search: the user's, plus English if wanted."""
    langs = F.array_distinct(F.when(F.col("show_english"), F.array("lang", F.lit("English")))
                             .otherwise(F.array("lang")))
    return queries.withColumn("lang", F.explode(langs))


def part_variants(parts: DataFrame) -> DataFrame:
    """query_id, pos, n_parts, q: the normalised parts of segmented queries."""
    n = parts.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_parts"))
    return parts.join(grown(n), "query_id").select("query_id", "pos", "n_parts",
                                            F.col("normalised").alias("q"))


def reader_variants(parts: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, variant, q: what a segmented query searches for.

    The part at ``word_index`` (clamped), first its normalised form, then its
    surface form if that differs.
    """
    # where the parts of a text are together already, they stay there and are read once
    at = parts.join(queries.select("query_id", "word_index"), "query_id").withColumn(
        "_last", F.max("pos").over(Window.partitionBy("query_id")))
    at = at.where(F.col("pos") == F.least(F.greatest("word_index", F.lit(0)), F.col("_last")))
    forms = F.array(F.struct(F.lit("normalised").alias("variant"), F.col("normalised").alias("q")),
                    F.struct(F.lit("inflected").alias("variant"), F.col("inflected").alias("q")))
    rows = at.select("query_id", "normalised", F.explode(forms).alias("v")).select(
        "query_id", "normalised", "v.variant", "v.q")
    return rows.where((F.col("variant") == "normalised") | (F.col("q") != F.col("normalised"))).drop(
        "normalised")
