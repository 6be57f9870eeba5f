"""Detail look-ups that join records with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kotonoha.functions import packing, text
from kotonoha.operators import index, reshape
from kotonoha.plans.scaling import grown


def word_kanji(words: DataFrame, kanji: DataFrame) -> DataFrame:
    """sequence, pos, literal: the known kanji of each main reading, in order."""
    ch = words.select("sequence", F.posexplode(text.chars(reshape.main_reading())).alias("pos", "literal"))
    return ch.join(F.broadcast(kanji.select("literal")), "literal").select(
        "sequence", "pos", "literal")


def collocations(words: DataFrame) -> DataFrame:
    """sequence, pos, other, reading: the collocation words that exist."""
    c = words.select("sequence", F.posexplode("collocations").alias("pos", "other"))
    target = words.select(F.col("sequence").alias("other"), reshape.main_reading().alias("reading"))
    return c.join(grown(target), "other").select("sequence", "pos", "other", "reading")


def transitivity(words: DataFrame) -> DataFrame:
    """sequence, kind, partner; the transitive partner wins."""
    kind = F.when(F.col("transive_version").isNotNull(), "Transitive").when(
        F.col("intransive_version").isNotNull(), "Intransitive")
    return words.select("sequence", kind.alias("kind"),
                        F.coalesce("transive_version", "intransive_version").alias("partner")
                        ).where("kind is not null")


def word_details(words: DataFrame, kanji: DataFrame, lang: Column, english: Column) -> DataFrame:
    """One row per word: kanji, collocations, partner and sentence flag.

    The lists come from one word each, so they are bounded by its record.
    """
    k = word_kanji(words, kanji).groupBy("sequence").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("pos", "literal"))), lambda x: x["literal"]), "").alias("kanji"))
    c = collocations(words).groupBy("sequence").agg(F.transform(F.array_sort(
        F.collect_list(F.struct("pos", "reading"))), lambda x: x["reading"]).alias("collocations"))
    base = words.select(
        "sequence", packing.has_sentence("sentences_available", lang, english).alias("has_sentence"))
    return (base.join(grown(k), "sequence", "left").join(grown(c), "sequence", "left")
            .join(grown(transitivity(words)), "sequence", "left"))


def sentence_kanji(sentences: DataFrame, kanji: DataFrame) -> DataFrame:
    """id, pos, literal: known kanji of each sentence, in order, repeats kept."""
    ch = sentences.select("id", F.posexplode(text.chars("japanese")).alias("pos", "literal"))
    return ch.join(F.broadcast(kanji.select("literal")), "literal").select("id", "pos", "literal")


def best_word_per_part(scored: DataFrame) -> DataFrame:
    """query_id, item_id: the best hit of each part (rows already >= 0.8)."""
    return scored.groupBy("query_id").agg(F.max_by(
        "item_id", F.struct("relevance", F.xxhash64("item_id"))).alias("item_id"))


def kanji_compounds(kanji: DataFrame, words: DataFrame, lang: Column, english: Column,
                    decomposed: DataFrame | None = None) -> DataFrame:
    """literal, kind, pos, sequence, jp, kana, glosses: on and kun compounds.

    Kun compounds come from the kun references.  ``decomposed`` (literal) adds
    the has-decomposition flag.
    """
    def refs(kind, col):
        return kanji.select("literal", F.lit(kind).alias("kind"), F.posexplode(col).alias("pos", "sequence"))

    r = refs("on", "on_dicts").unionByName(refs("kun", "kun_dicts"))
    w = words.select("sequence", reshape.main_reading().alias("jp"),
                     F.col("reading.kana.reading").alias("kana"),
                     F.transform(reshape.restrict_senses("senses", lang, english),
                                 reshape.sense_glosses_joined).alias("glosses"))
    out = r.join(w, "sequence")
    if decomposed is not None:
        flag = decomposed.select("literal").distinct().withColumn("has_decomposition", F.lit(True))
        out = out.join(flag, "literal", "left").withColumn(
            "has_decomposition", F.coalesce("has_decomposition", F.lit(False)))
    return out


def query_compounds(queries: DataFrame, kanji: DataFrame, words: DataFrame, lang: Column,
                    english: Column) -> DataFrame:
    """Compounds for every known character of a query text."""
    ch = queries.select("query_id", F.posexplode(text.chars("q")).alias("char_pos", "literal"))
    return ch.join(kanji_compounds(kanji, words, lang, english), "literal")


def example_sentences(words: DataFrame, sentences: DataFrame, lang: Column) -> DataFrame:
    """sequence, sense_id, furigana, translation (user's language, else English)."""
    s = words.select("sequence", F.explode("senses").alias("s")).select(
        "sequence", F.col("s.id").alias("sense_id"), F.col("s.example_sentence").alias("id"))
    t = sentences.select("id", "furigana", reshape.translation(lang, F.lit(True)).alias("translation"))
    return s.where("id is not null").join(t, "id").where("translation is not null").select(
        "sequence", "sense_id", "id", "furigana", "translation")


def word_info(ids: DataFrame, words: DataFrame, pos_dim: DataFrame) -> DataFrame:
    """sequence, reading, common, pos: bulk info for a table of ids."""
    asked = ids.select("sequence").distinct()
    w = words.join(asked, "sequence", "left_semi")
    pos = index.word_pos(w, pos_dim).groupBy("sequence").agg(
        F.array_sort(F.collect_set("pos_simple")).alias("pos"))
    return w.select("sequence", reshape.main_reading().alias("reading"), "common").join(
        pos, "sequence", "left")


def news_after(requests: DataFrame, news: DataFrame, last: int = 3) -> DataFrame:
    """query_id, id, title, short: of the newest three, those after a time."""
    newest = news.orderBy(F.col("creation_time").desc(), F.col("id").desc()).limit(last)
    return requests.join(F.broadcast(newest), newest.creation_time > requests.after).select(
        "query_id", "id", "title", "short")


def news_by_id(requests: DataFrame, news: DataFrame) -> DataFrame:
    return requests.join(news, "id")


def rank_words(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "item_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
