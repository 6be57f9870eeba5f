"""Row filters of the searches.  Every predicate means *keep*."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha.functions import text
from kotonoha.operators import reshape
from kotonoha.plans.scaling import grown, salted_join
from kotonoha.session import cut_lineage


def word_has_language(lang: Column, english: Column) -> Column:
    return F.exists("senses", lambda s: reshape.language_matches(s["language"], lang, english))


def all_present(required, present) -> Column:
    """Every required tag is among the present ones (none required: keep)."""
    required = F.coalesce(text._c(required), F.array().cast("array<string>"))
    return F.size(F.array_except(required, text._c(present))) == 0


def misc_of_word() -> Column:
    return F.filter(F.transform("senses", lambda s: s["misc"]), lambda m: m.isNotNull())


def jlpt_matches(wanted) -> Column:
    """Equality where a level is wanted."""
    wanted = text._c(wanted)
    return wanted.isNull() | F.col("jlpt_lvl").eqNullSafe(wanted)


def katakana_matches(wanted) -> Column:
    return ~text._c(wanted) | reshape.is_katakana_word()


def quoted_terms_match(required, lang: Column, english: Column) -> Column:
    """Foreign quoted terms occur in some gloss, kana ones in the kana, other
    Japanese ones in some kanji reading."""
    required = text._c(required)
    glosses = F.flatten(F.transform(
        reshape.restrict_senses("senses", lang, english),
        lambda s: F.transform(s["glosses"], lambda g: F.lower(g["gloss"]))))
    kanji_readings = F.filter(F.concat(F.array("reading.kanji"), F.col("reading.alternative")),
                              lambda r: r.isNotNull())

    def one(t):
        foreign = F.exists(glosses, lambda g: g.contains(t))
        kana = F.col("reading.kana.reading").contains(t)
        kanji = F.exists(kanji_readings, lambda r: r["reading"].contains(t))
        return (F.when(~text.is_japanese(t), foreign).when(text.is_kana(t), kana).otherwise(kanji))

    return F.forall(F.coalesce(required, F.array().cast("array<string>")), one)


def word_filter(lang: Column, english: Column, pos=None, misc=None, jlpt=None, katakana=None,
                required=None, irregular=None, word_pos="word_pos") -> Column:
    """The conjunction of the word filters.

    ``pos`` / ``misc`` / ``required`` are array columns, ``jlpt`` / ``katakana`` /
    ``irregular`` scalar columns of the query; ``word_pos`` holds the word's
    simple parts of speech.
    """
    preds = [word_has_language(lang, english)]
    if pos is not None:
        preds.append(all_present(pos, word_pos))
    if misc is not None:
        preds.append(all_present(misc, misc_of_word()))
    if jlpt is not None:
        preds.append(jlpt_matches(jlpt))
    if katakana is not None:
        preds.append(katakana_matches(katakana))
    if required is not None:
        preds.append(quoted_terms_match(required, lang, english))
    if irregular is not None:
        preds.append(~text._c(irregular) | F.exists("senses", lambda s: F.array_contains(
            s["part_of_speech"], "v5r-i")))
    return reduce(lambda a, b: a & b, preds)


# -- sentences -----------------------------------------------------------------------------
def sentence_filter(lang: Column, english: Column, tags=None, required=None, kana="kana") -> Column:
    """Usable translation, all tags, quoted native terms in text or kana."""
    keep = reshape.has_translation(lang, english)
    if tags is not None:
        keep = keep & all_present(tags, "tags")
    if required is not None:
        keep = keep & quoted_native_match(required, kana)
    return keep


def native_terms(required) -> Column:
    """The quoted terms that are looked for in the sentence itself."""
    return F.filter(F.coalesce(text._c(required), F.array().cast("array<string>")), lambda t: text.is_japanese(t))


def quoted_native_match(required, kana="kana") -> Column:
    return F.forall(native_terms(required), lambda t: F.when(
        text.is_kana(t), F.col(kana).contains(t)).otherwise(F.col("japanese").contains(t)))


def documents_with_all_terms(required: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, doc_id: documents holding every required (query_id, term).

    Relational division by access path: a document with all terms has the rarest
    one, so only its documents are read and the other terms are tested on the
    array of asked terms that a document holds.  A term unknown to the index leaves
    its query without rows.
    """
    wanted = cut_lineage(required.select("query_id", "term").where("query_id is not null").distinct(), "wanted-terms")
    held = (salted_join(vectors.select("term", "doc_id"), wanted.select("term").distinct(), ["term"], ["doc_id"], "left_semi")
            .groupBy("doc_id").agg(F.collect_set("term").alias("terms")))
    held = cut_lineage(held, "held-terms")
    freq = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    sized = wanted.join(grown(freq), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    asked = sized.groupBy("query_id").agg(F.min_by("term", F.struct("n", "term")).alias("term"),
                                          F.collect_set("term").alias("wanted"), F.min("n").alias("n")).where("n > 0").drop("n")
    hit = salted_join(held.select("doc_id", "terms", F.explode("terms").alias("term")), asked, ["term"], ["doc_id"])
    return hit.where(F.size(F.array_except("wanted", "terms")) == 0).select("query_id", "doc_id")


def sentences_with_reading(queries: DataFrame, kanji: DataFrame, segments: DataFrame,
                           lexemes: DataFrame) -> DataFrame:
    """query_id, item_id: sentences using a kanji with the asked reading.

    ``queries``: query_id, literal, reading.  Full readings are looked up in the
    reading markup (``segments``: item_id, literal, kana, one row per character
    of a marked block), kun readings with okurigana in the ``lexemes`` (item_id,
    lexeme).  A reading the kanji does not have gives no rows.
    """
    known = kanji.select("literal", F.explode(F.concat(
        F.transform("onyomi", lambda r: F.struct(r.alias("reading"), F.lit(False).alias("is_kun"))),
        F.transform("kunyomi", lambda r: F.struct(r.alias("reading"), F.lit(True).alias("is_kun")))))
        .alias("r")).select("literal", "r.reading", "r.is_kun")
    on_wins = known.groupBy("literal", "reading").agg(F.min("is_kun").alias("is_kun"))
    q = queries.join(on_wins, ["literal", "reading"])
    full = ~F.col("reading").rlike("[-.]")
    by_markup = salted_join(
        segments, q.where(full).select("query_id", "literal", text.to_hiragana("reading").alias("want")),
        ["literal"], ["item_id"]).where(text.to_hiragana("kana").contains(F.col("want")))
    word = reshape.reading_with_literal("literal", "reading", "is_kun")
    by_lexeme = salted_join(lexemes, q.where(~full).select("query_id", word.alias("lexeme")),
                            ["lexeme"], ["item_id"])
    return (by_markup.select("query_id", "item_id")
            .unionByName(by_lexeme.select("query_id", "item_id")).distinct())


# -- generic ----------------------------------------------------------------------------------
def above_threshold(hits: DataFrame, threshold: Column | float) -> DataFrame:
    """Minimum relevance; a threshold of zero keeps everything."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return hits.where((t <= 0) | (F.col("relevance") >= t))


def before_and_after(hits: DataFrame, item_filter: Column, records: DataFrame, on: list[str],
                     result_filter: Column) -> DataFrame:
    """An item predicate before, and a record predicate after, the record join;
    both stay plain Columns so the optimizer can move them."""
    return hits.where(item_filter).join(records, on).where(result_filter)


def words_with_radicals(pairs: DataFrame, word_chars: DataFrame, query_chars: DataFrame,
                        parts: DataFrame, radicals: DataFrame) -> DataFrame:
    """The (query_id, item_id) pairs where some kanji of the word that is not in
    the query has all radicals of the query.

    ``word_chars``: item_id, literal; ``query_chars``: query_id, literal;
    ``parts``: literal, radical; ``radicals``: query_id, radical.
    """
    need = radicals.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    with_all = (salted_join(parts.distinct(), radicals.distinct(), ["radical"], ["literal"])
                .groupBy("query_id", "literal").agg(F.count(F.lit(1)).alias("got"))
                .join(need, "query_id").where("got = need").select("query_id", "literal"))
    usable = with_all.join(query_chars, ["query_id", "literal"], "left_anti")
    word_hits = pairs.join(word_chars, "item_id").join(usable, ["query_id", "literal"], "left_semi")
    asked = pairs.join(need.select("query_id"), "query_id", "left_anti")
    return (word_hits.select("query_id", "item_id").distinct()
            .unionByName(asked.select("query_id", "item_id")))


def has_reading(reading) -> Column:
    """Any reading of a word record equals the text."""
    every = F.concat(F.array(F.col("reading.kana.reading"), F.col("reading.kanji.reading")),
                     F.transform("reading.alternative", lambda r: r["reading"]))
    return F.coalesce(F.array_contains(F.filter(every, lambda r: r.isNotNull()), reading), F.lit(False))


def has_main_reading(reading) -> Column:
    return (F.col("reading.kana.reading") == reading) | F.coalesce(
        F.col("reading.kanji.reading") == reading, F.lit(False))
