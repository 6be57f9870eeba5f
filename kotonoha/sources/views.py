"""Record tables derived from the provided Parquet tables.

The provided tables hold no Japanese text.  These views spell Latin letters
with kana and ideographs (one fixed letter map each), so that every record
table, index and query log is derived from the given rows and grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.functions import text
from kotonoha.operators import index
from kotonoha.session import cut_lineage

# -- fixed values: letter maps of the derived views ------------------------------
LETTERS = "abcdefghijklmnopqrstuvwxyz"
AS_HAN = "一二人口土女子山川日月木水火田目石竹米糸耳虫行見言音"
AS_HIRA = "あいうえおかきくけこさしすせそたちつてとなにぬねのは"
AS_KATA = "アイウエオカキクケコサシスセソタチツテトナニヌネノハ"
DIGITS = "0123456789"
DIGITS_HIRA = "まみむめもやゆよらり"
DIGITS_HAN = "一二人口土女子山川日"
LANG_NAMES = {"en": "English", "de": "German", "fr": "French", "es": "Spanish"}
EVENT_LANGS = {"click": "English", "view": "German", "signup": "French",
               "purchase": "Spanish", "error": "English"}
PART_POS = {"ECONOMY": ["n", "vs"], "LARGE": ["adj-i"], "STANDARD": ["v1", "vt"],
            "MEDIUM": ["adv"], "SMALL": ["n-suf", "n"], "PROMO": ["v5r-i", "vi"]}
BRAND_MISC = ["Abbreviation", "Colloquialism", "UsuallyWrittenInKana", "Slang", "Archaism"]
NAME_TYPES = ["fem", "masc", "surname", "place", "company", "given"]


def han(col):
    return F.translate(text._c(col), LETTERS, AS_HAN)


def hira(col):
    return F.translate(text._c(col), LETTERS, AS_HIRA)


def kata(col):
    return F.translate(text._c(col), LETTERS, AS_KATA)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _map(values: dict[str, str]):
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


# -- terms of the documents --------------------------------------------------------
#: Bytes of text that a task spells out as tokens, which are about twenty times as large.
TEXT_BYTES = 8 << 20


def placed_documents(spark, sf) -> DataFrame:
    """doc_id, lang, text, partitioned by doc_id: what is grouped by document afterwards moves as
    text, not as tokens.  One pass over the texts gives the number of partitions."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return docs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TEXT_BYTES)), "doc_id")


def doc_tokens(spark, sf) -> DataFrame:
    docs = placed_documents(spark, sf)
    return docs.select("doc_id", "lang", F.posexplode(text.letter_terms("text")).alias("pos", "term"))


def terms(spark, sf) -> DataFrame:
    """item_id, lang, term, freq: the headwords."""
    tok = (table(spark, sf, "documents").select("lang", "text")
           .select("lang", F.explode(text.letter_terms("text")).alias("term")))
    out = tok.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("freq"))
    return out.select(F.concat_ws(":", "lang", "term").alias("item_id"), "lang", "term", "freq")


def stored_terms(spark, sf) -> DataFrame:
    """The headwords, stored: for queries that name them more than once, as each use
    of ``terms`` reads and cuts all documents."""
    return cut_lineage(terms(spark, sf), "headwords")


def _headwords(spark, sf, headwords: DataFrame | None) -> DataFrame:
    return terms(spark, sf) if headwords is None else headwords


def doc_terms(spark, sf) -> DataFrame:
    """doc_id, lang, term, tf."""
    return (doc_tokens(spark, sf).groupBy("doc_id", "lang", "term")
            .agg(F.count(F.lit(1)).alias("tf")))


def query_words(spark, sf) -> DataFrame:
    """query_id, q: every distinct word of the benchmark passages with one
    character lost (words of five letters and more): a log of misspelt look-ups."""
    words = (table(spark, sf, "benchmark").select(F.explode(text.letter_terms("text")).alias("w"))
             .distinct())
    typo = F.concat(F.substring("w", 1, 2), F.substr(F.col("w"), F.lit(4)))
    return words.select(F.col("w").alias("query_id"),
                        F.when(F.length("w") >= 5, typo).otherwise(F.col("w")).alias("q"))


def passages(spark, sf) -> DataFrame:
    """query_id, q: the benchmark passages as whole-text queries."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"),
                                                F.col("text").alias("q"))


# -- words ---------------------------------------------------------------------------
def _dict(reading, kanji: bool, main):
    return F.struct(reading.alias("reading"), F.lit(kanji).alias("kanji"),
                    F.lit(False).alias("no_kanji"),
                    F.array(F.concat(F.lit("nf"), (F.col("p_size") % 48 + 1).cast("string")))
                    .alias("priorities"),
                    F.array().cast("array<string>").alias("reading_info"), main.alias("is_main"))


def _gloss(i, gloss):
    return F.struct(F.lit(i).cast("smallint").alias("id"), gloss.alias("gloss"),
                    F.lit(None).cast("string").alias("g_type"))


def part_words(spark, sf) -> DataFrame:
    """The columns of ``part`` with the parts of its name split off."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", "p_name", "p_type", "p_size",
                    F.split("p_name", " ")[0].alias("w1"), F.split("p_name", " ")[1].alias("w2"),
                    F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int").alias("brand"))


def words(spark, sf) -> DataFrame:
    """A full nested word record per part."""
    p = part_words(spark, sf)
    size, brand, key = F.col("p_size"), F.col("brand"), F.col("p_partkey")
    katakana = key % 5 == 0
    kana = F.when(katakana, F.concat(kata("w1"), kata("w2"))).otherwise(
        F.concat(hira("w1"), hira("w2")))
    kanji = F.concat(han("w1"), hira("w2"))
    alt = F.concat(han("w1"), han("w2"))
    pos = F.col("pos_codes")
    nul = F.lit(None).cast("string")
    misc = F.get(F.array(*[F.lit(m) for m in BRAND_MISC]), brand % 8)
    gairaigo = F.when(brand % 6 == 0, F.struct(
        F.lit("German").alias("language"), F.lit(True).alias("fully_derived"),
        F.col("w2").alias("original")))

    def sense(i, glosses, part_of_speech, lang, full):
        return F.struct(
            F.lit(i).cast("smallint").alias("id"), (misc if full else nul).alias("misc"),
            (F.when(size % 4 == 1, F.lit("Mathematics")) if full else nul).alias("field"),
            nul.alias("dialect"), glosses.alias("glosses"),
            (F.when(size % 6 == 0, F.concat(hira("w2"), F.lit("・1"))) if full else nul).alias("xref"),
            (F.when(size % 9 == 0, F.concat(hira("w1"), F.lit("・"), hira("w2")))
             if full else nul).alias("antonym"),
            (F.when(size % 4 == 0, F.concat(F.lit("see "), F.col("w2"))) if full else nul)
            .alias("information"),
            part_of_speech.alias("part_of_speech"), F.lit(lang).alias("language"),
            (F.when(size % 2 == 0, key) if full else F.lit(None)).cast("bigint")
            .alias("example_sentence"),
            (gairaigo if full else F.lit(None)).cast(
                "struct<language:string,fully_derived:boolean,original:string>").alias("gairaigo"))

    english = sense(0, F.array(_gloss(0, F.col("p_name")),
                               _gloss(1, F.concat(F.col("w2"), F.lit(" ("), F.lower("p_type"), F.lit(")")))),
                    pos, "English", True)
    german = sense(1, F.array(_gloss(0, F.concat_ws(" ", "w2", "w1"))),
                   F.array(F.lit("n")), "German", False)
    french = sense(2, F.array(_gloss(0, F.concat(F.lit("le "), F.col("w2")))),
                   F.array(F.lit("adv")), "French", False)
    senses = F.filter(F.array(english, F.when(size % 2 == 0, german),
                              F.when(size % 3 == 0, french)), lambda s: s.isNotNull())
    codes = F.create_map(*[x for k, v in PART_POS.items()
                           for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    p = p.withColumn("pos_codes", F.try_element_at(codes, F.col("p_type")))
    return p.select(
        key.alias("sequence"), (key % 3 == 0).alias("common"),
        F.struct(_dict(kana, False, katakana).alias("kana"),
                 F.when(~katakana, _dict(kanji, True, F.lit(True))).alias("kanji"),
                 F.when((size % 2 == 0) & ~katakana, F.array(_dict(alt, True, F.lit(False))))
                 .otherwise(F.array().cast(f"array<{_DICT}>")).alias("alternative")).alias("reading"),
        senses.alias("senses"),
        F.when(~katakana, F.concat(F.lit("["), han("w1"), F.lit("|"), hira("w1"), F.lit("]"),
                                   hira("w2"))).alias("furigana"),
        F.when(size % 7 != 0, (size % 5 + 1)).cast("tinyint").alias("jlpt_lvl"),
        F.when(size % 4 == 0, F.array(key + 1, key + 2)).alias("collocations"),
        F.when(size % 5 == 0, key + 1).alias("transive_version"),
        F.when(size % 5 == 1, key - 1).alias("intransive_version"),
        size.bitwiseAND(F.lit(35)).alias("sentences_available"),
        F.array((size % 7).cast("tinyint"), (brand % 7).cast("tinyint")).alias("accents"))


_DICT = ("struct<reading:string,kanji:boolean,no_kanji:boolean,priorities:array<string>,"
         "reading_info:array<string>,is_main:boolean>")


# -- names, sentences, kanji, radicals ---------------------------------------------------
def names(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    seg = F.lower("c_mktsegment")
    digits = F.substring("c_name", -3, 3)
    types = F.array(*[F.lit(t) for t in NAME_TYPES])
    first = F.array(F.get(types, F.col("c_nationkey") % 6))
    return c.select(
        F.col("c_custkey").alias("sequence"),
        F.concat(hira(F.substring(seg, 1, 2)), F.translate(digits, DIGITS, DIGITS_HIRA)).alias("kana"),
        F.when(F.col("c_custkey") % 4 != 0,
               F.concat(han(F.substring(seg, 1, 2)), F.translate(digits, DIGITS, DIGITS_HAN)))
        .alias("kanji"),
        F.concat_ws(" ", seg, digits).alias("transcription"),
        F.when(F.col("c_nationkey") % 5 != 0, F.when(
            F.col("c_nationkey") % 2 == 0, F.concat(first, F.array(F.lit("unclass"))))
            .otherwise(first)).alias("name_type"),
        F.lit(None).cast("string").alias("xref"))


def sentences(spark, sf) -> DataFrame:
    """One sentence record per document, its text as a translation."""
    d = table(spark, sf, "documents")
    from kotonoha import fixed
    tags = F.array(*[F.lit(n) for n, _ in fixed.SENTENCE_TAGS])
    number = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    lang = F.try_element_at(_map(LANG_NAMES), F.col("lang"))
    first = F.struct(F.col("text").alias("text"), lang.alias("language"))
    second = F.struct(F.col("source").alias("text"), F.lit("English").alias("language"))
    return d.select(
        F.col("doc_id").alias("id"), hira(F.lower("text")).alias("japanese"),
        hira(F.lower("text")).alias("furigana"),
        F.when((F.col("doc_id") % 3 == 0) & (F.col("lang") != "en"), F.array(first, second))
        .otherwise(F.array(first)).alias("translations"),
        F.when((F.col("n_chars") % 7).between(1, 5), F.col("n_chars") % 7).cast("tinyint")
        .alias("jlpt_guess"),
        (F.col("n_chars") % 5 + 8).cast("tinyint").alias("level"),
        F.when(F.col("doc_id") % 4 == 0, F.array(F.get(tags, number), F.lit("Slang")))
        .otherwise(F.array(F.get(tags, number))).alias("tags"))


def letters(spark, sf, headwords: DataFrame | None = None) -> DataFrame:
    """literal (an ASCII term), letter: stands for characters and their parts."""
    t = _headwords(spark, sf, headwords).where(F.col("term").rlike("^[a-z]+$")).groupBy("term").agg(
        F.sum("freq").alias("freq"))
    return t.select(F.col("term").alias("literal"), F.length("term").alias("stroke_count"), "freq",
                    F.array_distinct(text.chars("term")).alias("parts"))


def kanji(spark, sf, headwords: DataFrame | None = None) -> DataFrame:
    """One record per ideograph of the letter map, with its frequency in the
    documents; at most 26 rows however large the documents are.  The frequencies are
    stored, as a query names its kanji several times; ``headwords`` as in ``terms``."""
    per_term = _headwords(spark, sf, headwords).select("freq", F.explode(text.chars("term")).alias("ch"))
    freq = cut_lineage(per_term.where(F.col("ch").rlike("^[a-z]$")).groupBy("ch")
                       .agg(F.sum("freq").alias("frequency")), "letter-frequency")
    idx = F.instr(F.lit(LETTERS), F.col("ch"))
    k = freq.select("ch", "frequency", idx.alias("idx"))
    idx = F.col("idx")
    literal = han("ch")

    def arr(*cols):
        return F.array(*cols)

    nxt = F.substring(F.lit(AS_HAN), idx % 26 + 1, 1)
    nul_arr = F.array().cast("array<string>")
    return k.select(
        literal.alias("literal"), F.when(idx % 6 != 0, idx % 6).cast("tinyint").alias("grade"),
        (idx % 9 + 1).cast("tinyint").alias("stroke_count"),
        F.when(idx % 5 != 0, F.col("frequency")).alias("frequency"),
        F.when(idx % 4 != 0, idx % 4 + 1).cast("tinyint").alias("jlpt"),
        nul_arr.alias("variant"),
        arr(kata("ch"), F.concat(kata("ch"), F.lit("ン"))).alias("onyomi"),
        arr(F.concat(hira("ch"), F.lit("の"))).alias("nanori"),
        arr(F.concat(hira("ch"), F.lit(".う")), F.concat(F.lit("-"), hira("ch"), F.lit(".く")),
            hira("ch")).alias("kunyomi"),
        nul_arr.alias("chinese"),
        arr(F.concat(F.lit("r"), F.col("ch"))).alias("korean_r"),
        arr(F.translate("ch", LETTERS, HANGUL26)).alias("korean_h"), nul_arr.alias("vietnamese"),
        arr((idx + 1).cast("bigint"), (idx + 27).cast("bigint")).alias("kun_dicts"),
        arr(idx.cast("bigint"), (idx + 26).cast("bigint")).alias("on_dicts"),
        arr(nxt).alias("similar_kanji"),
        arr(F.concat(F.lit("letter "), F.col("ch")), F.col("ch")).alias("meanings"),
        F.struct(idx.cast("int").alias("id"), literal.alias("literal"),
                 F.when(idx % 3 == 0, nxt).alias("alternative"),
                 (idx % 9 + 1).cast("tinyint").alias("stroke_count"),
                 nul_arr.alias("readings"), nul_arr.alias("translations")).alias("radical"),
        arr(literal, nxt).alias("parts"))


HANGUL26 = "가나다라마바사아자차카타파하거너더러머버서어저처커터"


def radicals(spark, sf, headwords: DataFrame | None = None) -> DataFrame:
    """literal, frequency, meanings, stroke_count: every English term is a meaning
    of the radical of its first letter."""
    t = _headwords(spark, sf, headwords).where((F.col("lang") == "en") & F.col("term").rlike("^[a-z]+$"))
    return t.select(han(F.substring("term", 1, 1)).alias("literal"), "term", "freq")


def ids_edges(spark, sf) -> DataFrame:
    """parent, pos, child: every term is made of its two halves."""
    t = terms(spark, sf).select("term").distinct().where(F.length("term") > 1)
    half = F.floor(F.length("term") / 2).cast("int")
    t = t.withColumn("half", half)
    parts = F.array(F.expr("substring(term, 1, half)"), F.expr("substring(term, half + 1)"))
    return t.select(F.col("term").alias("parent"), F.posexplode(parts).alias("pos", "child"),
                    F.lit("Japan").alias("origin"))


# -- morphemes -----------------------------------------------------------------------------
MORPHEME_LEXEMES = ["見る", "ない", "た", "て", "いる", "音楽", "ます", "みる", "たい", "美しい",
                    "れる", "だ", "しまう", "せる", "は", "てる", "行く"]
MORPHEME_CLASSES = ["Verb", "Adjective", "Auxilary", "Particle", "Verb", "Noun", "Auxilary",
                    "Verb", "Auxilary", "Adjective", "Auxilary", "Auxilary", "Verb",
                    "Auxilary", "Particle", "Auxilary", "Verb"]


def morphemes(spark, sf) -> DataFrame:
    """text_id, pos, surface, lexeme, reading, word_class: one morpheme per token."""
    tok = doc_tokens(spark, sf)
    n = len(MORPHEME_LEXEMES)
    first = F.instr(F.lit(LETTERS), F.substring("term", 1, 1))
    bucket = ((F.length("term") * 5 + first) % n).cast("int")
    lex = F.array(*[F.lit(x) for x in MORPHEME_LEXEMES])
    cls = F.array(*[F.lit(x) for x in MORPHEME_CLASSES])
    return tok.select(
        F.col("doc_id").alias("text_id"), F.col("pos").cast("bigint").alias("pos"),
        hira("term").alias("surface"), F.get(lex, bucket).alias("lexeme"),
        kata("term").alias("reading"), F.get(cls, bucket).alias("word_class"))


# -- query log ------------------------------------------------------------------------------
def raw_queries(spark, sf) -> DataFrame:
    """One search request per event; its text is made from the part the user
    looks at, in the forms a search box sees."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    p = part_words(spark, sf).select("p_partkey", "p_name", "w1", "w2")
    j = e.join(p, e.user_id == p.p_partkey)
    form = F.col("event_id") % 12
    uid = F.col("user_id").cast("string")
    raw = (F.when(form == 0, F.concat(han("w1"), hira("w2")))
           .when(form == 1, F.concat(hira("w1"), hira("w2")))
           .when(form == 2, F.concat(F.lit("ger: "), F.concat_ws(" ", "w2", "w1")))
           .when(form == 3, F.col("p_name"))
           .when(form == 4, F.concat(F.lit("seq:"), uid))
           .when(form == 5, F.concat(F.lit("#verb #n"), (F.col("user_id") % 9).cast("string")))
           .when(form == 6, F.concat(hira("w1"), F.lit("*")))
           .when(form == 7, F.concat(F.lit('"'), F.col("w2"), F.lit('" '), F.col("w1")))
           .when(form == 8, F.concat(han(F.substring("w1", 1, 1)), F.lit(" "),
                                     kata(F.substring("w1", 1, 1))))
           .when(form == 9, F.concat(F.col("w1"), F.lit(" #adjective #hidden")))
           .when(form == 10, F.translate("w2", LETTERS, HANGUL26))
           .otherwise(F.concat(F.lit("to "), F.col("w2"), F.lit(" #sentences #slang"))))
    return j.select(
        F.col("event_id").alias("query_id"), raw.alias("raw_query"), F.lit("Words").alias("target"),
        F.try_element_at(_map(EVENT_LANGS), F.col("event_type")).alias("user_lang"),
        (F.col("user_id") % 2 == 0).alias("show_english"),
        (F.col("user_id") % 4).cast("int").alias("page"), F.lit(10).alias("page_size"),
        F.lit(0).alias("word_index"), F.lit(None).cast("string").alias("lang_overwrite"))


def news(spark, sf) -> DataFrame:
    """Sign-up events as news entries."""
    from kotonoha.sources import records
    e = table(spark, sf, "events").where("event_type = 'signup'")
    body = F.concat(F.lit("# "), F.col("props"), F.lit("\nuser "), F.col("user_id").cast("string"),
                    F.lit("\n"), F.repeat(F.lit("value "), 20), F.lit("\nthird\nfourth"))
    return records.news_table(e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("user "), F.col("user_id").cast("string"))
        .alias("title"), body.alias("long"), F.col("ts").alias("creation_time")))


def hashtag_lines(spark, sf) -> DataFrame:
    """Lines ``tag freq target*``: the source names and languages of the documents
    with their counts, and malformed lines for the ids without a frequency."""
    d = table(spark, sf, "documents")
    src = d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    line = F.when(F.col("n") % 5 == 0, F.concat(F.lit("#"), F.col("source"))).otherwise(
        F.concat(F.lit("#"), F.col("source"), F.lit("-"), F.col("lang"), F.lit(" "),
                 (F.col("n") / 8).cast("string"), F.lit(" "), (F.col("n") % 4).cast("string")))
    return src.select(line.alias("value"))


def gram_items(spark, sf, headwords: DataFrame | None = None) -> DataFrame:
    """The headwords with their gram arrays, posting = language."""
    return index.ngram_items(_headwords(spark, sf, headwords), "item_id", "term", posting=F.col("lang"))


def gram_postings(spark, sf, headwords: DataFrame | None = None) -> DataFrame:
    """Postings of the headwords, posting = language."""
    return index.ngram_postings(_headwords(spark, sf, headwords), "item_id", "term", posting=F.col("lang"))
