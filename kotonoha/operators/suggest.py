"""Autocomplete as a bulk job over a table of typed inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kotonoha import fixed
from kotonoha.functions import kana, text
from kotonoha.operators import radicals as radical_ops
from kotonoha.operators import retrieve, score
from kotonoha.plans.scaling import salted_join
from kotonoha.session import cut_lineage

LIMIT = fixed.SUGGESTION_LIMIT

#: Prefixes that a task spells out and sorts at a time, about 200 bytes each.
PREFIXES_PER_TASK = 1_000_000


def weighted(share: Column, freq_share: Column, str_weight=1.0, freq_weight=1.0, total=1.0) -> Column:
    """total * (str * prefix share + freq * normalised frequency)."""
    def w(x):
        return x if isinstance(x, Column) else F.lit(float(x))
    return w(total) * (w(str_weight) * share + w(freq_weight) * freq_share)


def frequency_share(vocab: DataFrame) -> DataFrame:
    """Adds freq_share: frequency over the largest one (a one-row aggregate)."""
    top = vocab.agg(F.max("freq").alias("_top"))
    return vocab.crossJoin(F.broadcast(top)).withColumn(
        "freq_share", F.col("freq") / F.col("_top")).drop("_top")


def prefix_suggestions(queries: DataFrame, vocab: DataFrame, limit: int | None = LIMIT,
                       on: list[str] | None = None, str_weight=1.0, freq_weight=1.0, total=1.0,
                       salts: int | None = None) -> DataFrame:
    """query_id, item_id, text, score (and rank, with a limit): entries that start with the input.

    ``vocab``: item_id, text, freq_share (+ ``on`` columns).  With a limit the input is looked up in the
    table of completions.  Without one every entry offers its prefixes as join
    keys, but only of lengths some input has.
    """
    if limit is not None:
        return completed(queries, completions(vocab, limit, on, str_weight, freq_weight, total), on)
    keys = [*(on or []), "key"]
    q = queries.select("query_id", *(on or []), F.col("q").alias("key"))
    lengths = q.select(F.length("key").alias("n")).distinct().agg(F.collect_set("n").alias("_lens"))
    v = vocab.crossJoin(F.broadcast(lengths))
    wanted = F.filter("_lens", lambda n: n <= F.length(F.col("text")))
    v = v.select(*vocab.columns, F.explode(F.transform(
        wanted, lambda n: F.substring(F.col("text"), F.lit(1), n))).alias("key"))
    hit = salted_join(v, q, keys, ["item_id"], salts=salts)
    share = F.length("key") / F.length("text")
    return hit.select("query_id", "item_id", "text", weighted(
        share, F.col("freq_share"), str_weight, freq_weight, total).alias("score"))


def completions(vocab: DataFrame, limit: int = LIMIT, on: list[str] | None = None,
                str_weight=1.0, freq_weight=1.0, total=1.0) -> DataFrame:
    """on..., prefix, item_id, text, score, rank: the best entries of every prefix of every entry.

    A prefix tree as a table, for inputs of any length.  Rows grow with the
    letters of the vocabulary.  Each task keeps its ``limit`` best rows of a
    prefix before they are exchanged, so a first letter that a third of all
    entries share sends ``limit`` rows per task, not those entries.  A task sorts what its
    entries spell, so these are measured and dealt over as many tasks as bound that.
    """
    by = [*(on or []), "prefix"]
    size = F.length("text")
    spelt = vocab.agg(F.sum(size)).first()[0] or 0
    tasks = max(int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-spelt // PREFIXES_PER_TASK))
    every = vocab.where(size > 0).repartition(tasks).select("*", F.explode(F.sequence(F.lit(1), size)).alias("n"))
    scored = every.select(*(on or []), F.left(F.col("text"), F.col("n")).alias("prefix"), "item_id", "text", weighted(
        F.col("n") / size, F.col("freq_share"), str_weight, freq_weight, total).alias("score"))
    return best(scored, limit, by=by)


def completed(queries: DataFrame, table: DataFrame, on: list[str] | None = None) -> DataFrame:
    """query_id, item_id, text, score, rank: the inputs looked up in a table of completions, by one equi-join."""
    asked = queries.select("query_id", *(on or []), F.col("q").alias("prefix"))
    return asked.join(table, [*(on or []), "prefix"]).select("query_id", "item_id", "text", "score", "rank")


def best(hits: DataFrame, limit: int = LIMIT, extra: list[Column] | None = None,
         by: list[str] | None = None) -> DataFrame:
    """rank 1..limit per query (or ``by``) by score (rounded to six digits), text, item."""
    w = Window.partitionBy(*(by or ["query_id"])).orderBy(
        *(extra or []), F.round("score", 6).desc(), "text", "item_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def ngram_suggestions(queries: DataFrame, postings: DataFrame, threshold: float, min_length: int = 0,
                      on: list[str] | None = None) -> DataFrame:
    """query_id, item_id, score: typo-tolerant entries with dice >= threshold."""
    q = queries.where(F.length("q") >= min_length)
    grams = retrieve.query_grams(q, keep=on)
    cand = retrieve.ngram_candidates(grams, postings, threshold, on=on)
    return (cand.withColumn("score", score.dice()).where(F.col("score") >= threshold)
            .select("query_id", "item_id", "score"))


def language_suggestions(queries: DataFrame, vocab: DataFrame, limit: int = LIMIT) -> DataFrame:
    """User language entries plus English ones at reduced weight.

    ``queries``: query_id, q, lang, show_english; ``vocab`` has a lang column.
    """
    own = prefix_suggestions(queries, vocab, limit, ["lang"], 1.5, 0.5, 1.0)
    eng_q = queries.where(F.col("show_english") & (F.col("lang") != "en")).withColumn("lang", F.lit("en"))
    eng = prefix_suggestions(eng_q, vocab.where("lang = 'en'"), limit, ["lang"], 1.5, 0.15, 0.75)
    both = own.unionByName(eng)  # what is among the best of both is among the best of its part
    merged = both.groupBy("query_id", "item_id", "text").agg(F.max("score").alias("score"))
    return best(merged, limit)


# -- Latin input read as kana --------------------------------------------------------------
def romaji_guess(col) -> Column:
    """Hiragana of a (possibly unfinished) romaji input; null when it is not one.

    The last syllable may be half typed, so the guess is the longest of three
    readings that can be spelled: the whole input (without a final m), the input
    without its last letter, and without its last two where these begin a
    syllable of three letters.  An input whose missing letters could all be n
    keeps them.
    """
    typed = F.regexp_replace(F.replace(text._c(col), F.lit("-"), F.lit("ー")), "m$", "")
    size = F.length(typed)
    nasal = F.greatest(F.lit(0), F.lit(3) - F.length(F.regexp_replace(typed, "[^n]", "")))
    begun = typed.rlike("(?:" + "|".join(fixed.THREE_LETTER_ENDINGS) + ")$")
    readings = [(0, F.lit(True)), (1, size > nasal), (2, (size >= nasal + 2) & begun)]

    def reading(cut: int, allowed: Column) -> Column:
        part = F.left(typed, F.greatest(size - cut, F.lit(0)))
        return F.when(allowed & kana.could_be_romaji(part), kana.search_hiragana(kana.romaji_core(part)))

    return F.when((size >= 3) & ~typed.contains(" "), F.coalesce(*[reading(*r) for r in readings]))


def romaji_suggestions(queries: DataFrame, vocab: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Latin inputs against kana entries; +1000 when the input is a prefix of the
    entry's spelling."""
    q = queries.select("query_id", F.col("q").alias("typed"),
                       F.coalesce(romaji_guess(F.trim("q")), kana.search_hiragana("q")).alias("q"))
    hits = prefix_suggestions(q.select("query_id", "q"), vocab, None)
    total = F.when(kana.could_be_romaji("typed"), 0.99).otherwise(0.5)
    hits = hits.join(q.select("query_id", "typed"), "query_id").withColumn(
        "score", F.col("score") * total + F.when(kana.romaji_prefix("typed", "text"), 1000.0).otherwise(0.0))
    return best(hits.drop("typed"), limit)


# -- kanji prefix + kana end -------------------------------------------------------------------
def kana_end_distance(kana_reading: Column, kanji_reading: Column, kanji_part: Column, kana_part: Column
                      ) -> Column:
    """0 if the kana ends as typed; else twice the characters behind the last
    place the typed kana occurs; null if it does not occur."""
    ends = kana_reading.endswith(kana_part) & kanji_reading.startswith(kanji_part)
    back = F.instr(F.reverse(kana_reading), F.reverse(kana_part))
    return F.when(ends, F.lit(0)).when(back > 0, (back - 1) * 2)


def kana_end_suggestions(queries: DataFrame, entries: DataFrame, max_distance: int = 10) -> DataFrame:
    """query_id, item_id, text, distance for inputs ``<kanji><kana>``.

    ``entries``: item_id, kanji, kana.
    """
    runs = text.alphabet_runs("q")
    q = queries.where(text.is_kanji(F.substring("q", 1, 1)) & text.is_kana(F.substring("q", -1, 1))
                      & (F.size(runs) == 2)).select(
        "query_id", runs[0].alias("kanji_part"), runs[1].alias("kana_part"))
    lengths = q.select(F.length("kanji_part").alias("n")).distinct().agg(F.collect_set("n").alias("_lens"))
    e = entries.where("kanji is not null").crossJoin(F.broadcast(lengths))
    e = e.select("item_id", "kanji", "kana", F.explode(F.transform(
        F.filter("_lens", lambda n: n <= F.length(F.col("kanji"))),
        lambda n: F.substring(F.col("kanji"), F.lit(1), n))).alias("kanji_part"))
    hit = salted_join(e, q, ["kanji_part"], ["item_id"])
    d = kana_end_distance(F.col("kana"), F.col("kanji"), F.col("kanji_part"), F.col("kana_part"))
    return hit.select("query_id", "item_id", F.col("kanji").alias("text"), d.alias("distance")).where(
        F.col("distance") <= max_distance)


def kana_variants(queries: DataFrame) -> DataFrame:
    """query_id, variant, q, weight: the input itself and, if it holds kana and
    differs, its katakana form at 0.8."""
    alt = text.to_katakana("q")
    forms = F.array(F.struct(F.lit("typed").alias("variant"), F.col("q").alias("q"), F.lit(1.0).alias("weight")),
                    F.when(text.has_kana("q") & (alt != F.col("q")), F.struct(
                        F.lit("katakana").alias("variant"), alt.alias("q"), F.lit(0.8).alias("weight"))))
    rows = queries.select("query_id", F.explode(forms).alias("v")).where("v is not null")
    return rows.select("query_id", "v.variant", "v.q", "v.weight")


def katakana_retry(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Hiragana inputs without any result, in katakana."""
    empty = queries.where(text.is_hiragana("q")).join(hits.select("query_id").distinct(), "query_id", "left_anti")
    return empty.withColumn("q", text.to_katakana("q"))


def inflection_entries(parts: DataFrame, max_words: int = 15) -> tuple[DataFrame, DataFrame]:
    """(normalised queries at 0.75, custom entries).

    One inflected word is searched in its normalised form.  A segmented text of
    up to fifteen words offers its words as entries, without particles, symbols
    and blanks, scored by their place from the end.
    """
    listable = ~F.col("word_class").isin("Particle", "Symbol", "Space")
    texts = parts.where("query_id is not null").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_parts"), F.bool_or("has_inflections").alias("inflected"), F.max("normalised").alias("q"),
        F.sort_array(F.collect_list(F.when(listable, F.struct("pos", "normalised")))).alias("words"))
    # stored, as both tables are made of it: the parts are then worked out once
    texts = texts.withColumn("size", F.size("words").cast("bigint")).where((F.col("n_parts") == 1) | (F.col("size") <= max_words))
    texts = cut_lineage(texts, "inflection-entries")
    single = texts.where((F.col("n_parts") == 1) & F.col("inflected")).select("query_id", "q", F.lit(0.75).alias("weight"))
    custom = texts.where("n_parts > 1").select("query_id", "size", F.posexplode("words").alias("k", "w")).where(
        (F.col("size") <= max_words) & (F.col("w.normalised") != "")).select(
        "query_id", F.col("w.normalised").alias("text"), (F.col("size") - F.col("k")).alias("score"))
    return single, custom


def exact_first(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Re-rank: entries whose primary or secondary text is the input come first."""
    j = hits.join(queries.select("query_id", "q"), "query_id")
    exact = (F.col("primary") == F.col("q")) | F.coalesce(F.col("secondary") == F.col("q"), F.lit(False))
    w = Window.partitionBy("query_id").orderBy(exact.desc(), F.col("rank"))
    return j.withColumn("rank", F.row_number().over(w)).drop("q")


def name_suggestions(queries: DataFrame, native: DataFrame, foreign: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Names by what was typed: native readings with their other kana form, or the
    transcription plus the romaji reading."""
    jp = queries.where(text.japanese_percent("q") > fixed.JAPANESE_PERCENT)
    forms = F.array_distinct(F.array("q", text.to_katakana("q"), text.to_hiragana("q")))
    jp = jp.select("query_id", F.explode(forms).alias("q"))
    latin = queries.where(text.japanese_percent("q") < fixed.JAPANESE_PERCENT)
    guess = latin.select("query_id", romaji_guess("q").alias("q")).where("q is not null")
    # An entry among the best is so for the spelling that gives it its score.
    hits = (prefix_suggestions(jp.unionByName(guess), native, limit)
            .unionByName(prefix_suggestions(latin, foreign, limit)))
    merged = hits.groupBy("query_id", "item_id", "text").agg(F.max("score").alias("score"))
    return best(merged, limit)


def keep_with_kanji(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("secondary").isNotNull())


def kanji_reading_suggestions(queries: DataFrame, readings: DataFrame, key_counts: DataFrame,
                              limit: int = LIMIT) -> DataFrame:
    """query_id, rank, primary (reading), secondary (kanji), score.

    ``queries``: query_id, literal, reading (may be empty); ``readings``: literal,
    pos, reading; ``key_counts``: key, n_words.
    """
    want = text.to_hiragana(F.translate("reading", "。.", ""))
    q = queries.select("query_id", "literal", want.alias("want"))
    r = q.join(readings.select("literal", "pos", "reading"), "literal")
    r = r.withColumn("key", F.concat("literal", "reading")).join(key_counts, "key", "left")
    folded = text.to_hiragana(F.replace(F.col("reading"), F.lit("."), F.lit("")))
    prefix = (F.col("want") != "") & folded.startswith(F.col("want"))
    s = score.reading_suggestion_score(prefix, F.coalesce("n_words", F.lit(0)))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "pos", "reading")
    return (r.withColumn("score", s).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= limit)
            .select("query_id", "rank", F.col("reading").alias("primary"),
                    F.col("literal").alias("secondary"), "score"))


def typed_kanji_reading(raw) -> Column:
    """literal of an input that could become ``<kanji> <reading>``."""
    raw = text._c(raw)
    first = F.substring(raw, 1, 1)
    return F.when(text.is_kanji(first) & (F.substring(raw, 2, 1) == " "), first)


# -- hashtags --------------------------------------------------------------------------------------
def hashtag_postings(tags: DataFrame) -> DataFrame:
    """posting (target), gram, item_id, n_grams with two-character grams."""
    t = tags.select("tag", F.explode("s_targets").alias("target"), text.index_grams("tag", 2).alias("g"))
    return t.select("target", F.explode("g").alias("gram"), F.col("tag").alias("item_id"),
                    F.size("g").alias("n_grams"))


def hashtag_suggestions(queries: DataFrame, tags: DataFrame) -> DataFrame:
    """query_id, item_id, score for (query_id, q, target).

    Dice above 0.2 and within 0.4 of the best; an empty input gives the ten most
    frequent tags of the target.
    """
    typed = queries.where(F.trim("q") != "")
    grams = retrieve.query_grams(typed, n=2, keep=["target"])
    cand = retrieve.ngram_candidates(grams, hashtag_postings(tags), None, on=["target"])
    hits = cand.withColumn("score", score.dice_weighted(score.HASHTAG_DICE_WEIGHT)).where("score > 0.2")
    top = hits.groupBy("query_id").agg(F.max("score").alias("_best"))
    near = hits.join(top, "query_id").where(F.col("score") >= F.col("_best") - 0.4)
    blank = queries.where(F.trim("q") == "").select("query_id", "target")
    by_target = tags.select("tag", "freq", F.explode("s_targets").alias("target"))
    w = Window.partitionBy("target").orderBy(F.col("freq").desc(), "tag")
    first = by_target.withColumn("k", F.row_number().over(w)).where("k <= 10")
    frequent = blank.join(first, "target").select(
        "query_id", F.col("tag").alias("item_id"), F.col("freq").cast("double").alias("score"))
    return near.select("query_id", "item_id", "score").unionByName(frequent)


def hashtag_prefix(queries: DataFrame, tags: DataFrame) -> DataFrame:
    """query_id, tag: tags of the target that start with the (lower-case) input;
    a null target accepts all."""
    q = queries.select("query_id", F.lower("q").alias("q"), "target")
    vocab = tags.select(F.col("tag").alias("item_id"), F.col("tag").alias("text"), "s_targets",
                        F.lit(0.0).alias("freq_share"))
    hit = prefix_suggestions(q.select("query_id", "q"), vocab.drop("s_targets"), None)
    full = hit.select("query_id", "item_id").join(
        vocab.select("item_id", "s_targets"), "item_id").join(q.select("query_id", "target"), "query_id")
    return full.where(F.col("target").isNull() | F.array_contains("s_targets", F.col("target"))).select(
        "query_id", F.col("item_id").alias("tag"))


def with_target_suffix(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, rank, suggestion: preferred text, plus the target's hashtag
    outside the word search."""
    suffix = F.when(F.col("target") != "Words", F.concat(F.lit(" #"), F.col("target"))).otherwise("")
    return hits.join(queries.select("query_id", "target"), "query_id").select(
        "query_id", "rank", F.concat(F.coalesce("secondary", "primary"), suffix).alias("suggestion"))


def similar_suggestions(queries: DataFrame, vocab: DataFrame, max_distance: int = 2, limit: int = 16,
                        found: DataFrame | None = None, below: int = 10) -> DataFrame:
    """query_id, item_id, text, dist: similar-sounding entries, for inputs with
    fewer than ``below`` hits so far.

    Similar means: same first character and edit distance at most two after kana
    folding; found through deletion keys, not by comparing all pairs.
    """
    q = queries
    if found is not None:
        done = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= below)
        q = q.join(done, "query_id", "left_anti")
    folded = q.select("query_id", text.to_hiragana("q").alias("q"))
    v = vocab.select("item_id", "text", text.to_hiragana("text").alias("folded"))
    near = radical_ops.similar_terms(folded, v.select(F.col("folded").alias("term")).distinct(), max_distance)
    near = near.join(folded, "query_id").where(F.substring("term", 1, 1) == F.substring("q", 1, 1))
    hit = near.join(v, near.term == v.folded).select("query_id", "item_id", "text", "dist")
    w = Window.partitionBy("query_id").orderBy("dist", "text", "item_id")
    return hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
