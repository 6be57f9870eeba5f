"""Annotating a log of raw search-box requests.

Input ``raw_queries`` (see ``schemas.RAW_QUERIES``); the result has one row per
usable request with language, target, form, tags, required terms, wildcard
pattern and page offset.  Everything is row-local apart from two joins with
fixed dimension tables (tags, language codes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha import fixed
from kotonoha.functions import text
from kotonoha.sources import records

TAG = "#[a-zA-Z0-9\\-]+"
WILD_WIDE, WILD = "＊＋？", "*+?"


def _alias_map(rows: list[tuple[str, str]]) -> Column:
    return F.create_map(*[F.lit(x) for kv in rows for x in kv])


# -- prefixes ------------------------------------------------------------------------
def language_prefix(col) -> Column:
    """Language of a ``ger: ...`` prefix; null when there is none.

    The colon stands within the first four characters, the text has five bytes
    or more and the code is known.
    """
    col = text._c(col)
    codes = _alias_map([(a, n) for _, n, al in fixed.LANGUAGES for a in al])
    code = F.trim(F.regexp_extract(col, "^([^:]{0,3}):", 1))
    return F.when(F.octet_length(col) >= 5, F.try_element_at(codes, code))


def without_language_prefix(col) -> Column:
    col = text._c(col)
    return F.when(language_prefix(col).isNotNull(),
                  F.trim(F.regexp_replace(col, "^[^:]{0,3}:", ""))).otherwise(col)


def sequence_prefix(col) -> Column:
    """Id of ``seq:<number>``."""
    raw = F.trim(F.regexp_extract(text._c(col), r"^seq:(\s*[0-9]+\s*)$", 1)).try_cast("bigint")
    return F.when(raw <= 4294967295, raw)


# -- tags --------------------------------------------------------------------------------
def extract_hashtags(col) -> Column:
    return F.regexp_extract_all(text._c(col), F.lit(f"({TAG})"), F.lit(1))


def without_hashtags(col) -> Column:
    """Tags and one blank behind each are removed, known or not."""
    return F.rtrim(F.regexp_replace(text._c(col), f"{TAG} ?", ""))


def resolve_tags(tags: DataFrame, tag_dim: DataFrame) -> DataFrame:
    """query_id, pos, kind, value for (query_id, pos, tag) rows.

    One hashtag may stand for several tags; levels are clamped to 1..5, lessons
    to 3..23.  Unknown hashtags give no rows.
    """
    t = tags.withColumn("alias", F.lower(F.substr(F.col("tag"), F.lit(2))))
    named = t.join(F.broadcast(tag_dim), "alias").select("query_id", "pos", "kind", "value")

    def numbered(kind, pattern, low, high):
        n = F.regexp_extract("alias", pattern, 1).try_cast("int")
        ok = t.where(n.between(0, 255))
        return ok.select("query_id", "pos", F.lit(kind).alias("kind"),
                         F.least(F.greatest(n, F.lit(low)), F.lit(high)).cast("string").alias("value"))

    return (named.unionByName(numbered("jlpt", "^(?:n|jlpt)([0-9]+)$", 1, 5))
            .unionByName(numbered("genki", "^genki([0-9]+)$", 3, 23)).distinct())


def _tag_struct_array(kind_rows: list[tuple[str, str, str]]) -> Column:
    """alias -> list of (kind, value), as one constant map."""
    grouped: dict[str, list[tuple[str, str]]] = {}
    for alias, kind, value in kind_rows:
        grouped.setdefault(alias, []).append((kind, value))
    args = []
    for alias, pairs in grouped.items():
        args += [F.lit(alias), F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value"))
                                         for k, v in pairs])]
    return F.create_map(*args)


def tag_rows() -> list[tuple[str, str, str]]:
    rows = [(a, "pos", n) for _, n, al in fixed.POS_SIMPLE for a in al]
    rows += [(a, "misc", n) for n, al in fixed.MISC for a in al]
    rows += [(a, "misc", n) for a, n in fixed.MISC_SEARCH_ALIASES]
    rows += [(a, "sentence", n) for n, al in fixed.SENTENCE_TAGS for a in al]
    rows += [(a, "target", n) for _, n, al in fixed.TARGETS for a in al]
    rows += [(a, "flag", n) for n, al in fixed.FLAG_TAGS for a in al]
    return rows


def resolved_tags(hashtags: Column) -> Column:
    """The same resolution inside the row: ARRAY<STRUCT<kind, value>>."""
    empty = F.array().cast("array<struct<kind:string,value:string>>")
    named = _tag_struct_array(tag_rows())

    def one(tag):
        alias = F.lower(F.substr(tag, F.lit(2)))
        jlpt = F.regexp_extract(alias, "^(?:n|jlpt)([0-9]+)$", 1).try_cast("int")
        genki = F.regexp_extract(alias, "^genki([0-9]+)$", 1).try_cast("int")

        def level(kind, n, low, high):
            value = F.least(F.greatest(n, F.lit(low)), F.lit(high)).cast("string")
            return F.when(n.between(0, 255), F.array(F.struct(F.lit(kind).alias("kind"),
                                                              value.alias("value")))).otherwise(empty)

        return F.concat(F.coalesce(F.try_element_at(named, alias), empty),
                        level("jlpt", jlpt, 1, 5), level("genki", genki, 3, 23))

    return F.array_distinct(F.flatten(F.transform(hashtags, one)))


def tags_of(kind: str, tags="tags") -> Column:
    return F.transform(F.filter(text._c(tags), lambda t: t["kind"] == kind), lambda t: t["value"])


def has_producer_tag(tags="tags") -> Column:
    """A tag that can search without any text (not a target, not the hidden flag)."""
    return F.exists(text._c(tags), lambda t: (t["kind"] != "target") & (t["value"] != "Hidden"))


# -- quoted terms ------------------------------------------------------------------------------
def required_terms(col) -> Column:
    quoted = F.regexp_extract_all(text._c(col), F.lit('"([^"]+)"'), F.lit(1))
    return F.filter(F.transform(quoted, lambda t: F.lower(F.trim(t))), lambda t: t != "")


def without_quotes(col) -> Column:
    return F.regexp_replace(text._c(col), '"([^"]+)"', "$1")


# -- wildcards ------------------------------------------------------------------------------------
def _wild(col) -> Column:
    return F.translate(text._c(col), WILD_WIDE, WILD)


def is_wildcard(col) -> Column:
    return _wild(col).rlike("[*+?]")


def wildcard_pattern(col) -> Column:
    """Anchored pattern; null without wildcards.  Other characters are literal."""
    escaped = F.regexp_replace(_wild(col), r"([\\.\[\]{}()^$|])", r"\\$1")
    body = F.replace(escaped, F.lit("*"), F.lit(".*"))
    body = F.regexp_replace(body, r"\?|\+", ".")
    return F.when(is_wildcard(col), F.concat(F.lit("^"), body, F.lit("$")))


def wildcard_literals(col) -> Column:
    return F.when(is_wildcard(col), text.chars(F.translate(_wild(col), WILD, "")))


# -- language and form -----------------------------------------------------------------------------
def query_language(col) -> Column:
    """Korean, Japanese, Foreign or Undetected; wildcard characters do not count
    and the empty text is undetected."""
    bare = F.when(is_wildcard(col), F.translate(_wild(col), WILD, "")).otherwise(text._c(col))
    share = text.japanese_percent(bare)
    return (F.when(bare == "", "Undetected").when(text.is_hangul(bare), "Korean")
            .when(share > fixed.JAPANESE_PERCENT, "Japanese")
            .when(share < fixed.JAPANESE_PERCENT, "Foreign").otherwise("Undetected"))


def kanji_reading(col) -> Column:
    """(literal, reading) of a ``<one kanji> <reading>`` query, else null."""
    col = text._c(col)
    parts = F.split(col, " ")
    literal, reading = F.trim(F.get(parts, 0)), F.coalesce(F.get(parts, 1), F.lit(""))
    ok = ((F.length(col) >= 3) & col.contains(" ") & (F.length(literal) == 1)
          & text.is_kanji(literal) & text.is_japanese(F.translate(reading, ".- ", "")))
    return F.when(ok, F.struct(literal.alias("literal"), reading.alias("reading")))


def query_form(query="query", sequence="sequence", tags="tags") -> Column:
    """First match wins."""
    q = text._c(query)
    return (F.when(text._c(sequence).isNotNull(), "Sequence")
            .when((q == "") & has_producer_tag(tags), "TagOnly")
            .when(kanji_reading(q).isNotNull(), "KanjiReading")
            .when(text.is_japanese(q), "SingleWord")
            .when(~text.has_japanese(q) & q.contains(" "), "MultiWords")
            .when(~text.has_japanese(q), "SingleWord").otherwise("Undetected"))


NORMAL_FORMS = ["SingleWord", "MultiWords", "Undetected"]


# -- pages -------------------------------------------------------------------------------------------
def page_offset(page, size) -> Column:
    return F.greatest(text._c(page) - 1, F.lit(0)) * text._c(size)


def add_page(page, n, max_page: int = fixed.MAX_PAGE) -> Column:
    return F.least(text._c(page) + n, F.lit(max_page))


def without_target_tags(col) -> Column:
    """Known tags are removed unless they pick the target; unknown ones stay."""
    targets = [a for _, _, al in fixed.TARGETS for a in al]
    known = sorted({a.lower() for a, k, _ in tag_rows() if k != "target" and a.islower()
                    and " " not in a and a not in targets}, key=lambda a: (-len(a), a))
    numbered = "(?:n|jlpt|genki)[0-9]+"
    pattern = f"#(?:{'|'.join(known)}|{numbered})(?![a-zA-Z0-9\\-]) ?"
    return F.rtrim(F.regexp_replace(text._c(col), pattern, ""))


# -- the whole annotation -----------------------------------------------------------------------------
def annotate(raw: DataFrame) -> DataFrame:
    """Annotated ``queries``; unusable requests (no text, no usable tag) drop out."""
    q = raw.withColumn("lang_prefix", language_prefix("raw_query"))
    q = q.withColumn("body", without_language_prefix("raw_query"))
    q = q.withColumn("sequence", F.when(F.col("lang_prefix").isNull(), sequence_prefix("body")))
    q = q.withColumn("tags", resolved_tags(extract_hashtags("body")))
    q = q.withColumn("plain", without_hashtags("body"))
    q = q.withColumn("required", required_terms("plain"))
    q = q.withColumn("query", F.left(F.trim(without_quotes("plain")), F.lit(fixed.MAX_QUERY_CHARS)))
    q = q.where((F.col("query") != "") | has_producer_tag())
    kr = kanji_reading("query")
    page = F.coalesce("page", F.lit(0))
    size = F.coalesce("page_size", F.lit(10))
    return q.select(
        "query_id", "raw_query", "query", F.coalesce("lang_prefix", "lang_overwrite", "user_lang")
        .alias("lang"), "user_lang", F.coalesce("show_english", F.lit(True)).alias("show_english"),
        query_language("query").alias("q_lang"),
        F.coalesce(F.get(tags_of("target"), 0), "target").alias("target"),
        query_form().alias("form"), "sequence", kr["literal"].alias("literal"),
        kr["reading"].alias("reading"), "tags", tags_of("pos").alias("pos_tags"),
        tags_of("misc").alias("misc_tags"), tags_of("sentence").alias("sentence_tags"),
        F.get(tags_of("jlpt"), 0).cast("tinyint").alias("jlpt_tag"),
        F.get(tags_of("genki"), 0).cast("int").alias("genki_tag"),
        F.array_contains(tags_of("flag"), "Hidden").alias("hidden"),
        F.array_contains(tags_of("flag"), "Katakana").alias("katakana_tag"),
        F.array_contains(tags_of("flag"), "IrregularIchidan").alias("irregular_tag"),
        "required", wildcard_pattern("query").alias("pattern"),
        wildcard_literals("query").alias("literals"), page.alias("page"), size.alias("page_size"),
        page_offset(page, size).alias("page_offset"),
        F.coalesce("word_index", F.lit(0)).alias("word_index"))


def clean_typed(col) -> Column:
    """A half-typed Japanese input: a trailing wide n is read as the syllable, and
    wide letters among the last two characters are stripped."""
    col = text._c(col)
    japanese = query_language(col) == "Japanese"
    out = F.when(japanese & col.endswith("ｎ"), F.replace(col, F.lit("ｎ"), F.lit("ん"))).otherwise(col)
    tail = F.substring(out, -2, 2)
    letters = text.count_class(tail, text.ROMAN_WIDE)
    strip = japanese & (F.length(col) > 1) & text.is_japanese(tail)
    return F.when(strip, F.left(out, F.length(out) - letters)).otherwise(out)


def valid_typed(col, hashtag=None) -> Column:
    n = F.length(F.trim(text._c(col)))
    hashtag = F.lit(False) if hashtag is None else hashtag
    return ((n >= 1) | hashtag) & (n <= 37)


def tag_dimension(spark) -> DataFrame:
    return records.tag_dimension(spark)
