"""Reshaping record tables: glosses, readings, senses, tags and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha import fixed
from kotonoha.functions import packing, text


# -- senses and glosses ------------------------------------------------------------------
def sense_glosses(words: DataFrame) -> DataFrame:
    """sequence, order, sense_id, gloss_id, packed id, language, gloss."""
    s = words.select("sequence", F.posexplode("senses").alias("sense_pos", "s"))
    g = s.select("sequence", "sense_pos", F.col("s.id").alias("sense_id"),
                 F.col("s.language").alias("language"), F.posexplode("s.glosses").alias("gloss_pos", "g"))
    return g.select("sequence", "sense_pos", "gloss_pos", "sense_id",
                    F.col("g.id").alias("gloss_id"),
                    packing.pack_gloss_id("sense_id", "g.id").alias("packed_id"),
                    "language", F.col("g.gloss").alias("gloss"))


def gloss_by_id(requests: DataFrame, words: DataFrame) -> DataFrame:
    """(sequence, packed_id) -> gloss; the sense id is its position."""
    g = sense_glosses(words).select(
        "sequence", packing.pack_gloss_id("sense_pos", "gloss_id").alias("packed_id"), "gloss")
    return requests.join(g, ["sequence", "packed_id"])


def language_matches(language: Column, lang: Column, english: Column) -> Column:
    """The wanted language, or English where that is accepted."""
    return (language == lang) | (english & (language == "English"))


def restrict_senses(senses, lang: Column, english: Column) -> Column:
    return F.filter(text._c(senses), lambda s: language_matches(s["language"], lang, english))


def glosses_of_language(words: DataFrame, lang: Column, english: Column) -> DataFrame:
    return sense_glosses(words).where(language_matches(F.col("language"), lang, english))


def split_senses(senses, english_on_top: bool) -> Column:
    """Two groups: English senses and the others, in the wanted order."""
    senses = text._c(senses)
    english = F.filter(senses, lambda s: s["language"] == "English")
    other = F.filter(senses, lambda s: s["language"] != "English")
    return F.array(english, other) if english_on_top else F.array(other, english)


def _gloss_texts(senses: Column) -> Column:
    return F.flatten(F.transform(senses, lambda s: F.transform(s["glosses"], lambda g: g["gloss"])))


def glosses_pretty(senses) -> Column:
    """All glosses of the non-English senses, else of the English ones."""
    senses = text._c(senses)
    other = F.filter(senses, lambda s: s["language"] != "English")
    english = F.filter(senses, lambda s: s["language"] == "English")
    return F.array_join(_gloss_texts(F.when(F.size(other) > 0, other).otherwise(english)), ", ")


def sense_glosses_joined(sense: Column) -> Column:
    return F.array_join(F.transform(sense["glosses"], lambda g: g["gloss"]), "; ")


def reference_head(col) -> Column:
    """Cross references and antonyms up to the first middle dot."""
    return F.split(text._c(col), "・")[0]


def information_line(sense: Column) -> Column:
    parts = F.concat_ws(", ", sense["misc"], sense["field"], sense["information"])
    some = sense["misc"].isNotNull() | sense["field"].isNotNull() | sense["information"].isNotNull()
    dot = sense["xref"].isNotNull() | sense["antonym"].isNotNull()
    return F.when(some, F.concat(parts, F.when(dot, ".").otherwise("")))


def simple_pos_per_sense(words: DataFrame, pos_dim: DataFrame) -> DataFrame:
    """sequence, sense_id, pos (sorted distinct simple classes)."""
    s = words.select("sequence", F.explode("senses").alias("s")).select(
        "sequence", F.col("s.id").alias("sense_id"), F.explode("s.part_of_speech").alias("code"))
    j = s.join(F.broadcast(pos_dim), "code")
    sorted_ = F.array_sort(F.collect_set(F.struct("pos_order", "pos_simple")))
    return j.groupBy("sequence", "sense_id").agg(
        F.transform(sorted_, lambda x: x["pos_simple"]).alias("pos"))


# -- readings --------------------------------------------------------------------------------
def readings(words: DataFrame, allow_kana: bool = True) -> DataFrame:
    """sequence, pos, reading, is_main ...: kana, kanji, then alternatives."""
    head = F.array("reading.kana", "reading.kanji") if allow_kana else F.array("reading.kanji")
    every = F.filter(F.concat(head, F.coalesce("reading.alternative", F.array().cast(_DICTS))),
                     lambda r: r.isNotNull())
    r = words.select("sequence", F.posexplode(every).alias("pos", "r"))
    return r.select("sequence", "pos", F.col("r.reading").alias("reading"),
                    F.col("r.is_main").alias("is_main"), F.col("r.kanji").alias("is_kanji"))


_DICTS = ("array<struct<reading:string,kanji:boolean,no_kanji:boolean,priorities:array<string>,"
          "reading_info:array<string>,is_main:boolean>>")


def main_reading() -> Column:
    """Kanji if there is one, else kana (words)."""
    return F.coalesce(F.col("reading.kanji.reading"), F.col("reading.kana.reading"))


def name_reading() -> Column:
    return F.coalesce(F.col("kanji"), F.col("kana"))


def first_pitch() -> Column:
    return packing.pitch_parts("reading.kana.reading", F.get(F.col("accents"), 0))


def pitches() -> Column:
    """Pitch spans of every accent that gives any."""
    kana = F.col("reading.kana.reading")
    return F.filter(F.transform("accents", lambda d: packing.pitch_parts(kana, d)),
                    lambda p: p.isNotNull())


# -- record flags ------------------------------------------------------------------------------
def word_tag_count() -> Column:
    return F.col("common").cast("int") + F.col("jlpt_lvl").isNotNull().cast("int")


def is_katakana_word() -> Column:
    return text.is_katakana(main_reading())


def word_flags(words: DataFrame) -> DataFrame:
    return words.select(
        "sequence", word_tag_count().alias("tag_count"), is_katakana_word().alias("katakana"),
        F.col("collocations").isNotNull().alias("has_collocations"),
        text.has_kanji(main_reading()).alias("has_kanji"),
        F.concat(F.col("reading.kanji.reading"), F.lit("【"), F.col("reading.kana.reading"),
                 F.lit("】.mp3")).alias("audio_file"))


def kanji_flags(kanji: DataFrame) -> DataFrame:
    return kanji.select("literal", ((F.size("on_dicts") > 0) | (F.size("kun_dicts") > 0))
                        .alias("has_compounds"))


def matches_kanji(literal, reading) -> Column:
    """Does a kanji row have this literal and reading?"""
    return (F.col("literal") == literal) & (F.array_contains("onyomi", reading)
                                            | F.array_contains("kunyomi", reading))


def sentence_level() -> Column:
    """Levels are stored shifted by ten."""
    return F.col("level") - 10


def valid_jlpt_guess(guess) -> Column:
    return F.when(text._c(guess).between(1, 5), text._c(guess))


# -- kanji readings --------------------------------------------------------------------------------
def format_reading(col) -> Column:
    return F.translate(text._c(col), "-.", "")


def kun_stem(col) -> Column:
    return F.split(F.replace(text._c(col), F.lit("-"), F.lit("")), r"\.")[0]


def reading_with_literal(literal, reading, is_kun) -> Column:
    """The kanji followed by the okurigana of a kun reading."""
    tail = F.coalesce(F.get(F.split(text._c(reading), r"\."), 1), F.lit(""))
    return F.when(text._c(is_kun), F.replace(F.concat(text._c(literal), tail), F.lit("-"), F.lit("")))\
        .otherwise(text._c(literal))


def kanji_readings(kanji: DataFrame) -> DataFrame:
    """literal, pos, reading, is_kun: kun readings first, then on."""
    every = F.concat(F.transform("kunyomi", lambda r: F.struct(r.alias("reading"), F.lit(True).alias("is_kun"))),
                     F.transform("onyomi", lambda r: F.struct(r.alias("reading"), F.lit(False).alias("is_kun"))))
    return kanji.select("literal", F.posexplode(every).alias("pos", "r")).select(
        "literal", "pos", "r.reading", "r.is_kun")


def reading_type(reading) -> Column:
    """Onyomi / Kunyomi of a kanji row; null if in both lists or in none."""
    on, kun = F.array_contains("onyomi", reading), F.array_contains("kunyomi", reading)
    return F.when(on & ~kun, "Onyomi").when(~on & kun, "Kunyomi")


def find_reading(reading) -> Column:
    """Type under which a reading is found; on readings win."""
    return F.when(F.array_contains("onyomi", reading), "Onyomi").when(
        F.array_contains("kunyomi", reading), "Kunyomi")


def korean() -> Column:
    """``H (r)`` pairs; null if either list is empty."""
    n = F.least(F.size("korean_h"), F.size("korean_r"))
    pairs = F.zip_with(F.slice("korean_h", F.lit(1), n), F.slice("korean_r", F.lit(1), n),
                       lambda h, r: F.concat(h, F.lit(" ("), r, F.lit(")")))
    return F.when(n > 0, pairs)


def radical_display() -> Column:
    alt = F.col("radical.alternative")
    return F.when(alt.isNotNull(), F.concat(F.col("radical.literal"), F.lit(" ("), alt, F.lit(")")))\
        .otherwise(F.col("radical.literal"))


def parts_count() -> Column:
    return F.size("parts")


# -- names --------------------------------------------------------------------------------------------
def gender_tag() -> Column:
    genders = F.array(*[F.lit(g) for g in fixed.GENDER_NAME_TYPES])
    return F.get(F.filter("name_type", lambda t: F.array_contains(genders, t)), 0)


def is_gendered() -> Column:
    return gender_tag().isNotNull()


def has_non_gender_tags() -> Column:
    genders = F.array(*[F.lit(g) for g in fixed.GENDER_NAME_TYPES])
    return F.coalesce(F.exists("name_type", lambda t: ~F.array_contains(genders, t)), F.lit(False))


# -- sentences --------------------------------------------------------------------------------------------
def translation_for(lang: Column) -> Column:
    return F.get(F.filter("translations", lambda t: t["language"] == lang), 0)["text"]


def translation(lang: Column, english: Column) -> Column:
    """In the wanted language, else in English where that is accepted."""
    return F.coalesce(translation_for(lang),
                      F.when(english, translation_for(F.lit("English"))))


def has_translation(lang: Column, english: Column) -> Column:
    return F.exists("translations", lambda t: language_matches(t["language"], lang, english))


# -- projections ----------------------------------------------------------------------------------------------
def public_words(words: DataFrame) -> DataFrame:
    return words.select("sequence", F.to_json(F.struct(
        F.struct(F.col("reading.kana.reading").alias("kana"),
                 F.col("reading.kanji.reading").alias("kanji"), "furigana").alias("reading"),
        "common",
        F.transform("senses", lambda s: F.struct(
            F.transform(s["glosses"], lambda g: g["gloss"]).alias("glosses"),
            s["part_of_speech"].alias("pos"), s["language"].alias("language"),
            s["misc"].alias("misc"), s["field"].alias("field"), s["xref"].alias("xref"),
            s["antonym"].alias("antonym"), s["information"].alias("information"))).alias("senses"),
        F.transform("reading.alternative", lambda r: r["reading"]).alias("alt_readings"),
        pitches().alias("pitch"))).alias("body"))


def public_kanji(kanji: DataFrame) -> DataFrame:
    return kanji.select("literal", F.to_json(F.struct(
        "literal", "meanings", "grade", "stroke_count", "frequency", "jlpt", "variant", "onyomi",
        "kunyomi", "chinese", "korean_r", "korean_h", "parts",
        F.col("radical.literal").alias("radical"))).alias("body"))


def public_sentences(sentences: DataFrame, lang: Column, english: Column) -> DataFrame:
    """id, content, furigana, translation, language; untranslated rows drop out."""
    out = sentences.select("id", F.col("japanese").alias("content"), "furigana",
                           translation(lang, english).alias("translation"), lang.alias("language"))
    return out.where(F.col("translation").isNotNull())


def compound_words(words: DataFrame) -> DataFrame:
    """jp, kana, translations of all senses."""
    return words.select("sequence", main_reading().alias("jp"),
                        F.col("reading.kana.reading").alias("kana"),
                        _gloss_texts(F.col("senses")).alias("translations"))


def app_words(words: DataFrame) -> DataFrame:
    """The row shape of the detail and list views."""
    return words.withColumn("accents", pitches()).select(
        "sequence", F.col("common").alias("is_common"),
        F.coalesce("furigana", main_reading()).alias("reading"),
        F.col("reading.alternative.reading").alias("alt_readings"),
        "senses", "accents", "jlpt_lvl", "transive_version",
        "intransive_version", "sentences_available")


def word_pairs(words: DataFrame) -> DataFrame:
    """sequence, primary, secondary, preferred for the suggestion list."""
    kanji = F.col("reading.kanji.reading")
    primary = F.when(kanji.isNotNull(), F.col("reading.kana.reading")).otherwise(main_reading())
    return words.select("sequence", primary.alias("primary"), kanji.alias("secondary"),
                        F.coalesce(kanji, primary).alias("preferred"))


def pair_has_reading(reading) -> Column:
    return (F.col("primary") == reading) | F.coalesce(F.col("secondary") == reading, F.lit(False))
