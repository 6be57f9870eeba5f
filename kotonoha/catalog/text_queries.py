"""Text columns (TXT) over the headwords and raw texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from kotonoha import fixed
from kotonoha.catalog import sql_views as q
from kotonoha.catalog.registry import query
from kotonoha.functions import kana, text
from kotonoha.sources import views

HALF_SQL = "length(term) // 2"
JTERMS = {"v_j": f"""SELECT item_id, term, freq, {q.hira('term')} AS kana, {q.han('term')} AS kanji, {q.kata('term')} AS kata,
    {q.han(f'substr(term, 1, {HALF_SQL})')} || {q.hira(f'substr(term, {HALF_SQL} + 1)')} AS mixed,
    {q.hangul('term')} AS hangul FROM v_terms"""}


def jterms(spark, sf):
    """Headwords in kana, ideographs, a mix of both, katakana and Hangul."""
    t = views.terms(spark, sf).withColumn("half", F.floor(F.length("term") / 2).cast("int"))
    head, tail = F.expr("substring(term, 1, half)"), F.expr("substring(term, half + 1)")
    return t.select(
        "item_id", "term", "freq", views.hira("term").alias("kana"), views.han("term").alias("kanji"),
        views.kata("term").alias("kata"), F.concat(views.han(head), views.hira(tail)).alias("mixed"),
        F.translate("term", views.LETTERS, views.HANGUL26).alias("hangul"))


HAN_C, KANA_C = q.HAN_RE, "ぁ-ゟ゠-ヿ"
JP_C = f"{HAN_C}{KANA_C}＀-￯　-〿"


def jp_share(x):
    return (f"CASE WHEN length({x}) > 0 THEN CAST(floor(length(regexp_replace({x}, '[^{JP_C}]', '', 'g')) * 100 "
            f"/ length({x})) AS BIGINT) ELSE 0 END")


@query("txt1_script_class", f"""
    SELECT item_id, variant, CASE WHEN regexp_full_match(x, '[{HAN_C}]+') THEN 'kanji'
      WHEN regexp_matches(x, '[{HAN_C}]') THEN 'mixed' WHEN regexp_matches(x, '[{KANA_C}]') THEN 'kana'
      ELSE 'other' END AS script, {jp_share('x')} AS share, regexp_full_match(x, '[가-힣ᄀ-ᇿ㄰-㆏]+') AS hangul
    FROM (SELECT item_id, 'kana' AS variant, kana AS x FROM v_j UNION ALL SELECT item_id, 'mixed', mixed FROM v_j
      UNION ALL SELECT item_id, 'hangul', hangul FROM v_j UNION ALL SELECT item_id, 'latin', term FROM v_j
      UNION ALL SELECT item_id, 'half', term || kana FROM v_j)""", JTERMS)
def txt1(spark, sf):
    j = jterms(spark, sf)
    x = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), c.alias("x")) for n, c in (
        ("kana", F.col("kana")), ("mixed", F.col("mixed")), ("hangul", F.col("hangul")),
        ("latin", F.col("term")), ("half", F.concat("term", "kana")))])).alias("v")
    rows = j.select("item_id", x).select("item_id", "v.variant", "v.x")
    return rows.select("item_id", "variant", text.script_class("x").alias("script"),
                       text.japanese_percent("x").alias("share"), text.is_hangul("x").alias("hangul"))


@query("txt2_kana_folding", f"""SELECT item_id, {q.fold('kata')} AS hira, {q.to_kata('kana')} AS kata FROM v_j""", JTERMS)
def txt2(spark, sf):
    return jterms(spark, sf).select("item_id", text.to_hiragana("kata").alias("hira"),
                                    text.to_katakana("kana").alias("kata"))


def sql_lookup(x, table):
    keys = kana.alternatives(table)
    pairs = ", ".join(f"{q.lit(k)}: {q.lit(v)}" for k, v in sorted(table.items()))
    return (f"array_to_string(list_transform(regexp_extract_all({x}, {q.lit(keys)}, 1), "
            f"lambda p: coalesce(MAP {{{pairs}}}[p], p)), '')")


def sql_hiragana(x, nn=True):
    out = f"lower({x})"
    if nn:
        out = f"replace({out}, 'nn', 'ん')"
    for c in kana.SOKUON:
        out = f"replace({out}, '{c}{c}', 'っ{c}')"
    out = f"replace({out}, 'tch', 'っch')"
    return q.fold(sql_lookup(out, kana.mora_to_hiragana()))


@query("txt3_romaji_to_kana", f"""SELECT item_id, hira, {q.to_kata('hira')} AS kata FROM
    (SELECT item_id, {sql_hiragana('term')} AS hira FROM v_terms)""")
def txt3(spark, sf):
    return views.terms(spark, sf).select("item_id", kana.search_hiragana("term").alias("hira"),
                                         kana.search_katakana("term").alias("kata"))


ROMAJI_SQL = (rf"regexp_replace({sql_lookup(q.fold('kata'), kana.hiragana_to_latin())}, "
              r"'っ([a-z])', '\1\1', 'g')")


@query("txt4_romaji_prefix", f"""SELECT item_id, romaji, starts_with(lower(romaji), lower(substr(romaji, 1, 3))) AS own,
    starts_with(lower(romaji), lower(term)) AS prefix FROM (SELECT item_id, term, {ROMAJI_SQL} AS romaji FROM v_j)""", JTERMS)
def txt4(spark, sf):
    j = jterms(spark, sf).withColumn("romaji", kana.to_romaji("kata"))
    return j.select("item_id", "romaji", kana.romaji_prefix(F.substring("romaji", 1, 3), "kata").alias("own"),
                    kana.romaji_prefix("term", "kata").alias("prefix"))


@query("txt5_could_be_romaji", f"""SELECT item_id, regexp_full_match({sql_hiragana(
    f"translate(term, {q.lit(fixed.ROMAJI_STRIP)}, '')", nn=False)}, '[{JP_C}]+') AS romaji FROM v_terms""")
def txt5(spark, sf):
    return views.terms(spark, sf).select("item_id", kana.could_be_romaji("term").alias("romaji"))


@query("txt6_width_folding", f"""SELECT event_id, translate(wide, {q.lit(fixed.FULLWIDTH)}, {q.lit(fixed.HALFWIDTH)}) AS half
    FROM (SELECT event_id, translate(props, {q.lit(fixed.HALFWIDTH)}, {q.lit(fixed.FULLWIDTH)}) AS wide FROM events)""")
def txt6(spark, sf):
    wide = F.translate("props", fixed.HALFWIDTH, fixed.FULLWIDTH)
    return views.table(spark, sf, "events").select("event_id", text.to_halfwidth(wide).alias("half"))


@query("txt7_punctuation", f"SELECT page_id, {q.strip_punct('html')} AS words FROM pages")
def txt7(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", text.strip_punctuation("html").alias("words"))


@query("txt8_tokens", f"""SELECT term, count(*) AS freq FROM (SELECT unnest(list_filter(string_split(
    {q.strip_punct('text', fixed.TEXT_PUNCT)}, ' '), lambda t: t <> '')) AS term FROM documents) GROUP BY term""")
def txt8(spark, sf):
    return (views.table(spark, sf, "documents").select(F.explode(text.terms("text")).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("freq")))


@query("txt9_parentheses_and_to", """SELECT sequence, sense_id, gloss_id, lower(trim(regexp_replace(gloss, '\\(.*\\)', '', 'g'))) AS bare,
    regexp_replace('to ' || gloss, '^to ', '') AS verb FROM v_glosses""")
def txt9(spark, sf):
    from kotonoha.operators import reshape
    g = reshape.sense_glosses(views.words(spark, sf))
    return g.select("sequence", "sense_id", "gloss_id", text.gloss_key("gloss").alias("bare"),
                    text.drop_leading_to(F.concat(F.lit("to "), F.col("gloss"))).alias("verb"))


@query("txt10_padded_ngrams", f"""SELECT item_id, len({q.grams('term')}) AS n, len({q.gram_set('term')}) AS n_distinct,
    array_to_string({q.grams('term')}, ' ') AS grams FROM v_terms""")
def txt10(spark, sf):
    g = text.ngrams("term")
    return views.terms(spark, sf).select("item_id", F.size(g).alias("n"), F.size(text.gram_set("term"))
                                         .alias("n_distinct"), F.array_join(g, " ").alias("grams"))


@query("txt11_char_length", f"SELECT doc_id, length({q.hira('lower(text)')}) AS n FROM documents")
def txt11(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id", F.length(views.hira(F.lower("text"))).alias("n"))


@query("txt12_list_helpers", """SELECT a.literal, list_sort(a.parts) = list_sort(list_distinct(string_split(reverse(a.literal), ''))) AS same,
      len(a.parts) > 0 AND len(a.parts) <= 26 AND len(list_filter(a.parts, lambda x: x NOT IN ('e', 'h', 'n', 'r', 't'))) = 0
      AND len(a.parts) <= 5 AS part_of, len(a.parts) AS n_distinct FROM v_letters a""")
def txt12(spark, sf):
    ch = text.chars("literal")
    common = F.array(*[F.lit(c) for c in "ehnrt"])
    return views.letters(spark, sf).select(
        "literal", text.same_elements("parts", F.array_distinct(F.reverse(ch))).alias("same"),
        text.subset("parts", common).alias("part_of"), F.size(F.array_distinct(ch)).alias("n_distinct"))


@query("txt13_null_orderings", """SELECT literal, row_number() OVER (ORDER BY grade IS NULL, grade, literal) AS nulls_last,
    row_number() OVER (ORDER BY grade IS NOT NULL, grade, literal) AS nulls_first FROM v_kanji""")
def txt13(spark, sf):
    from pyspark.sql.window import Window
    k = views.kanji(spark, sf)  # at most 26 rows, so one global order is fine
    return k.select("literal", F.row_number().over(Window.orderBy(
        F.col("grade").isNull(), "grade", "literal")).alias("nulls_last"), F.row_number().over(
        Window.orderBy(F.col("grade").isNotNull(), "grade", "literal")).alias("nulls_first"))


@query("txt14_url_encode", """SELECT page_id, list_aggregate(list_transform(string_split(url, ''), lambda c:
      CASE WHEN regexp_full_match(c, '[A-Za-z0-9]') THEN c WHEN c = '' THEN '' ELSE '%' || hex(encode(c)) END), 'string_agg', '') AS enc
    FROM pages""")
def txt14(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", text.url_encode("url").alias("enc"))


@query("txt15_alphabet_runs", f"""SELECT item_id, array_to_string(regexp_extract_all(mixed || kanji, '([{HAN_C}]+|[^{HAN_C}]+)', 1), '|') AS runs
    FROM v_j""", JTERMS)
def txt15(spark, sf):
    return jterms(spark, sf).select("item_id", F.array_join(
        text.alphabet_runs(F.concat("mixed", "kanji")), "|").alias("runs"))
