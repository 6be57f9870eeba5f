"""Reshaping record tables (RSH) over the derived words, names, sentences and kanji."""

from __future__ import annotations

from pyspark.sql import functions as F

from kotonoha import fixed
from kotonoha.catalog import sql_views as q
from kotonoha.catalog.registry import query
from kotonoha.catalog.text_queries import HALF_SQL
from kotonoha.functions import packing
from kotonoha.operators import index, reshape
from kotonoha.sources import records, views


def lang_of(user_lang="German", english=True):
    return F.lit(user_lang), F.lit(english)


@query("rsh1_sense_glosses", """SELECT sequence, sense_pos, gloss_id AS gloss_pos, sense_id, gloss_id,
    sense_id * 256 + gloss_id AS packed_id, language, gloss FROM v_glosses""")
def rsh1(spark, sf):
    return reshape.sense_glosses(views.words(spark, sf))


@query("rsh2_packed_gloss_ids", """SELECT l_partkey AS sequence, l_linenumber % 3 * 256 + l_linenumber % 2 AS packed_id,
      CAST(l_linenumber % 3 AS BIGINT) AS sense_id, CAST(l_linenumber % 2 AS BIGINT) AS gloss_id, g.gloss, count(*) AS n
    FROM (SELECT l_partkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem)
    JOIN v_glosses g ON l_partkey = g.sequence AND l_linenumber % 3 = g.sense_pos AND l_linenumber % 2 = g.gloss_id
    GROUP BY ALL""")
def rsh2(spark, sf):
    """Every line item asks for one gloss of its part by packed id."""
    li = views.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("sequence"),
        packing.pack_gloss_id(F.col("l_linenumber") % 3, F.col("l_linenumber") % 2).alias("packed_id"))
    asked = li.groupBy("sequence", "packed_id").agg(F.count(F.lit(1)).alias("n"))
    out = reshape.gloss_by_id(asked, views.words(spark, sf))
    return out.select("sequence", "packed_id", packing.unpack_sense_id("packed_id").alias("sense_id"),
                      packing.unpack_gloss_id("packed_id").alias("gloss_id"), "gloss", "n")


@query("rsh3_reading_rows", """SELECT sequence, row_number() OVER (PARTITION BY sequence ORDER BY ord) - 1 AS pos, reading,
    ord > 0 AS is_kanji FROM v_readings""")
def rsh3(spark, sf):
    return reshape.readings(views.words(spark, sf)).drop("is_main")


@query("rsh4_main_reading", """SELECT 'word' AS kind, sequence, main FROM v_words UNION ALL
    SELECT 'name', sequence, coalesce(kanji, kana) FROM v_names""")
def rsh4(spark, sf):
    w = views.words(spark, sf).select(F.lit("word").alias("kind"), "sequence", reshape.main_reading().alias("main"))
    n = views.names(spark, sf).select(F.lit("name").alias("kind"), "sequence", reshape.name_reading().alias("main"))
    return w.unionByName(n)


@query("rsh5_restrict_senses", """SELECT sequence, count(*) FILTER (language IN ('German', 'English')) AS with_en,
    count(*) FILTER (language = 'German') AS german FROM v_senses GROUP BY sequence""")
def rsh5(spark, sf):
    return views.words(spark, sf).select(
        "sequence", F.size(reshape.restrict_senses("senses", *lang_of())).alias("with_en"),
        F.size(reshape.restrict_senses("senses", *lang_of(english=False))).alias("german"))


@query("rsh6_glosses_of_language", """SELECT sequence, sense_id, gloss_id, language, gloss FROM v_glosses
    WHERE language IN ('French', 'English')""")
def rsh6(spark, sf):
    return reshape.glosses_of_language(views.words(spark, sf), *lang_of("French")).select(
        "sequence", "sense_id", "gloss_id", "language", "gloss")


def _langs(groups):
    return F.array_join(F.transform(groups, lambda g: F.array_join(F.transform(
        g, lambda s: s["language"]), "+")), "/")


@query("rsh7_split_senses", """SELECT sequence, 'English/' || o AS english_on_top, o || '/English' AS english_last FROM
    (SELECT sequence, array_to_string(list(language ORDER BY sense_id) FILTER (language <> 'English'), '+') AS o0,
      coalesce(o0, '') AS o FROM v_senses GROUP BY sequence)""")
def rsh7(spark, sf):
    return views.words(spark, sf).select(
        "sequence", _langs(reshape.split_senses("senses", True)).alias("english_on_top"),
        _langs(reshape.split_senses("senses", False)).alias("english_last"))


@query("rsh8_joined_glosses", """SELECT s.sequence, s.pretty, e.first_sense FROM
    (SELECT sequence, coalesce(string_agg(gloss, ', ' ORDER BY sense_id, gloss_id) FILTER (language <> 'English'),
       string_agg(gloss, ', ' ORDER BY sense_id, gloss_id)) AS pretty FROM v_glosses GROUP BY sequence) s
    JOIN (SELECT sequence, array_to_string(glosses, '; ') AS first_sense FROM v_senses WHERE sense_id = 0) e USING (sequence)""")
def rsh8(spark, sf):
    return views.words(spark, sf).select(
        "sequence", reshape.glosses_pretty("senses").alias("pretty"),
        reshape.sense_glosses_joined(F.col("senses")[0]).alias("first_sense"))


def _senses(spark, sf):
    return views.words(spark, sf).select("sequence", F.explode("senses").alias("s"))


@query("rsh9_reference_heads", """SELECT sequence, sense_id, string_split(xref, '・')[1] AS xref, string_split(antonym, '・')[1] AS antonym
    FROM v_senses""")
def rsh9(spark, sf):
    return _senses(spark, sf).select("sequence", F.col("s.id").alias("sense_id"),
                                     reshape.reference_head("s.xref").alias("xref"),
                                     reshape.reference_head("s.antonym").alias("antonym"))


@query("rsh10_information_line", """SELECT sequence, sense_id, CASE WHEN misc IS NOT NULL OR field IS NOT NULL OR information IS NOT NULL
    THEN concat_ws(', ', misc, field, information) || CASE WHEN xref IS NOT NULL OR antonym IS NOT NULL THEN '.' ELSE '' END END AS info
    FROM v_senses""")
def rsh10(spark, sf):
    return _senses(spark, sf).select("sequence", F.col("s.id").alias("sense_id"),
                                     reshape.information_line(F.col("s")).alias("info"))


@query("rsh11_simple_pos", """SELECT sequence, sense_id, string_agg(pos_simple, ',' ORDER BY pos_order) AS pos, any_value(wp) AS word_pos FROM
      (SELECT DISTINCT sequence, sense_id, pos_simple, pos_order FROM (SELECT sequence, sense_id, unnest(pos) AS code FROM v_senses)
       JOIN v_pos_dim USING (code) JOIN v_pos_order USING (pos_simple))
    JOIN (SELECT sequence, string_agg(pos_simple, ',' ORDER BY pos_simple) AS wp FROM v_word_pos GROUP BY sequence) USING (sequence)
    GROUP BY sequence, sense_id""")
def rsh11(spark, sf):
    w, dim = views.words(spark, sf), records.pos_dimension(spark)
    per_sense = reshape.simple_pos_per_sense(w, dim).withColumn("pos", F.array_join("pos", ","))
    per_word = index.word_pos(w, dim).groupBy("sequence").agg(
        F.array_join(F.array_sort(F.collect_set("pos_simple")), ",").alias("word_pos"))
    return per_sense.join(per_word, "sequence")


@query("rsh12_priority_codes", """SELECT o_orderkey, code, kind, CASE WHEN kind IS NOT NULL THEN level END AS level,
      CASE WHEN kind IS NOT NULL THEN kind || level END AS again FROM
    (SELECT o_orderkey, code, nullif(regexp_extract(code, '^(news|ichi|spec|gai|nf)([0-9]+)$', 1), '') AS kind,
      TRY_CAST(regexp_extract(code, '^(news|ichi|spec|gai|nf)([0-9]+)$', 2) AS BIGINT) AS level FROM
     (SELECT o_orderkey, ['news', 'ichi', 'spec', 'gai', 'nf', 'zz'][CAST(o_orderkey % 6 + 1 AS INT)] ||
       CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(o_custkey % 50 AS VARCHAR) END AS code FROM orders))""")
def rsh12(spark, sf):
    o = views.table(spark, sf, "orders")
    kinds = F.array(*[F.lit(k) for k in ("news", "ichi", "spec", "gai", "nf", "zz")])
    code = F.concat(F.get(kinds, (F.col("o_orderkey") % 6).cast("int")), F.when(
        F.col("o_orderkey") % 7 == 0, "").otherwise((F.col("o_custkey") % 50).cast("string")))
    o = o.select("o_orderkey", code.alias("code")).withColumn("p", packing.parse_priority("code"))
    return o.select("o_orderkey", "code", "p.kind", "p.level", packing.format_priority("p").alias("again"))


@query("rsh13_language_masks", """SELECT id, mask, mask & 1 = 1 AS has_en, CASE WHEN mask & 2 = 2 THEN true ELSE mask & 1 = 1 END AS german_or_en,
      (SELECT string_agg(lang, ',' ORDER BY lang_id) FROM v_lang_dim WHERE (mask >> lang_id) & 1 = 1) AS langs FROM
    (SELECT id, CAST(bit_or(1 << lang_id) AS BIGINT) AS mask FROM v_translations JOIN v_lang_dim ON language = lang GROUP BY id)""")
def rsh13(spark, sf):
    s = views.sentences(spark, sf).select("id", packing.lang_mask(
        F.transform("translations", lambda t: t["language"])).alias("mask"))
    return s.select("id", "mask", packing.mask_has("mask", F.lit("English")).alias("has_en"),
                    packing.has_sentence("mask", F.lit("German"), F.lit(True)).alias("german_or_en"),
                    F.array_join(packing.mask_languages("mask"), ",").alias("langs"))


@query("rsh14_translations", """SELECT id, coalesce(max(text) FILTER (language = 'French'), max(text) FILTER (language = 'English')) AS french,
    max(text) FILTER (language = 'German') AS german, count(*) FILTER (language = 'Spanish') > 0 AS spanish
    FROM v_translations GROUP BY id""")
def rsh14(spark, sf):
    return views.sentences(spark, sf).select(
        "id", reshape.translation(F.lit("French"), F.lit(True)).alias("french"),
        reshape.translation(F.lit("German"), F.lit(False)).alias("german"),
        reshape.has_translation(F.lit("Spanish"), F.lit(False)).alias("spanish"))


@query("rsh15_pitch_values", """SELECT sequence, accent1 + accent2 * 8 + 8192 AS packed, CAST(2 AS BIGINT) AS n,
    accent1 || '|' || accent2 AS unpacked FROM v_words""")
def rsh15(spark, sf):
    p = views.words(spark, sf).select("sequence", packing.pack_pitch("accents").alias("packed"))
    back = packing.unpack_pitch("packed")
    return p.select("sequence", "packed", F.size(back).alias("n"),
                    F.array_join(back.cast("array<string>"), "|").alias("unpacked"))


@query("rsh16_mora_and_pitch", f"""SELECT item_id, array_to_string(m, '|') AS mora, d AS drop_at,
      CASE WHEN d > 6 THEN NULL WHEN d <= 1 THEN m[1] || CASE WHEN d = 1 THEN '^' ELSE '_' END || array_to_string(m[2:], '')
          || CASE WHEN d = 0 THEN '^' ELSE '_' END
        ELSE m[1] || '_' || array_to_string(m[2:d], '') || '^' || array_to_string(m[greatest(d, 1) + 1:], '') || '_' END AS spans
    FROM (SELECT item_id, freq % 9 AS d, regexp_extract_all(kana, '([^{fixed.SMALL_KANA}][{fixed.SMALL_KANA}]*|^[{fixed.SMALL_KANA}]+)', 1) AS m FROM
     (SELECT item_id, freq, replace(replace({q.hira('term')}, 'け', 'きょ'), 'つ', 'ファ') AS kana FROM v_terms))""")
def rsh16(spark, sf):
    kana = F.replace(F.replace(views.hira("term"), F.lit("け"), F.lit("きょ")), F.lit("つ"), F.lit("ファ"))
    t = views.terms(spark, sf).select("item_id", kana.alias("kana"), (F.col("freq") % 9).cast("int").alias("drop_at"))
    spans = F.array_join(F.transform(packing.pitch_parts("kana", "drop_at"), lambda s: F.concat(
        s["part"], F.when(s["high"], "^").otherwise("_"))), "")
    return t.select("item_id", F.array_join(packing.mora("kana"), "|").alias("mora"), "drop_at", spans.alias("spans"))


KREAD = {"v_kr": """SELECT literal, pos, reading, pos < 3 AS is_kun FROM (SELECT literal,
    unnest(list_concat(kunyomi, onyomi)) AS reading, generate_subscripts(list_concat(kunyomi, onyomi), 1) - 1 AS pos FROM v_kanji)"""}
KFORMS = f"""SELECT item_id, han || CASE WHEN kun THEN tail ELSE '' END AS full_form, replace(replace(reading, '-', ''), '.', '') AS bare,
      string_split(replace(reading, '-', ''), '.')[1] AS stem FROM
    (SELECT item_id, kun, han, CASE WHEN kun THEN '-' || head || '.' || tail ELSE kata END AS reading, tail FROM
     (SELECT item_id, freq % 2 = 0 AS kun, {q.han('substr(term, 1, 1)')} AS han, {q.hira(f'substr(term, 1, {HALF_SQL})')} AS head,
       {q.hira(f'substr(term, {HALF_SQL} + 1)')} AS tail, {q.kata('term')} AS kata FROM v_terms))"""


@query("rsh17_reading_forms", KFORMS)
def rsh17(spark, sf):
    t = views.terms(spark, sf).withColumn("half", F.floor(F.length("term") / 2).cast("int"))
    kun = F.col("freq") % 2 == 0
    reading = F.when(kun, F.concat(F.lit("-"), views.hira(F.expr("substring(term, 1, half)")), F.lit("."),
                                   views.hira(F.expr("substring(term, half + 1)")))).otherwise(views.kata("term"))
    t = t.select("item_id", views.han(F.substring("term", 1, 1)).alias("literal"), reading.alias("reading"), kun.alias("kun"))
    return t.select("item_id", reshape.reading_with_literal("literal", "reading", "kun").alias("full_form"),
                    reshape.format_reading("reading").alias("bare"), reshape.kun_stem("reading").alias("stem"))


@query("rsh18_kanji_readings", """SELECT r.literal, r.pos, r.reading, r.is_kun, o.n AS observed,
      CASE WHEN r.is_kun THEN 'Kunyomi' ELSE 'Onyomi' END AS kind, CASE WHEN r.is_kun THEN 'Kunyomi' ELSE 'Onyomi' END AS found
    FROM v_kr r JOIN (SELECT unnest(string_split(main, '')) AS literal, count(*) AS n FROM v_words GROUP BY 1) o USING (literal)""", KREAD)
def rsh18(spark, sf):
    from kotonoha.functions import text
    k = views.kanji(spark, sf)
    seen = (views.words(spark, sf).select(F.explode(text.chars(reshape.main_reading())).alias("literal"))
            .groupBy("literal").agg(F.count(F.lit(1)).alias("observed")))
    r = reshape.kanji_readings(k).join(k.select("literal", "onyomi", "kunyomi"), "literal").join(seen, "literal")
    return r.select("literal", "pos", "reading", "is_kun", "observed", reshape.reading_type(F.col("reading")).alias("kind"),
                    reshape.find_reading(F.col("reading")).alias("found"))


@query("rsh19_korean_pairs", "SELECT literal, CAST(coalesce(frequency, 0) AS BIGINT) AS total, korean_h[1] || ' (' || korean_r[1] || ')' AS korean FROM v_kanji")
def rsh19(spark, sf):
    k = views.kanji(spark, sf)
    return k.select("literal", F.coalesce("frequency", F.lit(0)).alias("total"),
                    F.array_join(reshape.korean(), ",").alias("korean"))


@query("rsh20_radical_display", """SELECT literal, CASE WHEN alternative IS NOT NULL THEN literal || ' (' || alternative || ')' ELSE literal END AS radical,
    CAST(2 AS BIGINT) AS n_parts FROM v_kanji""")
def rsh20(spark, sf):
    return views.kanji(spark, sf).select("literal", reshape.radical_display().alias("radical"),
                                         reshape.parts_count().alias("n_parts"))


@query("rsh21_name_gender", """SELECT sequence, list_filter(name_type, lambda t: t IN ('fem', 'masc'))[1] AS gender,
    coalesce(len(list_filter(name_type, lambda t: t IN ('fem', 'masc'))) > 0, false) AS gendered,
    coalesce(len(list_filter(name_type, lambda t: t NOT IN ('fem', 'masc'))) > 0, false) AS other FROM v_names""")
def rsh21(spark, sf):
    return views.names(spark, sf).select("sequence", reshape.gender_tag().alias("gender"),
                                         reshape.is_gendered().alias("gendered"),
                                         reshape.has_non_gender_tags().alias("other"))


@query("rsh22_public_rows", """SELECT 'sentence' AS kind, id, text AS a, japanese AS b, CAST(length(japanese) AS BIGINT) AS n FROM
      (SELECT id, max(text) FILTER (language = 'English') AS text FROM v_translations GROUP BY id) JOIN
      (SELECT id, japanese FROM v_sentences) USING (id) WHERE text IS NOT NULL
    UNION ALL SELECT 'compound', sequence, main, kana, len(list_transform(g, lambda x: x)) FROM v_words JOIN
      (SELECT sequence, list(gloss) AS g FROM v_glosses GROUP BY sequence) USING (sequence)
    UNION ALL SELECT 'app', sequence, coalesce(furigana, main), alt, (SELECT count(*) FROM v_senses s WHERE s.sequence = w.sequence) FROM v_words w""")
def rsh22(spark, sf):
    w = views.words(spark, sf)
    s = reshape.public_sentences(views.sentences(spark, sf), F.lit("English"), F.lit(True)).select(
        F.lit("sentence").alias("kind"), "id", F.col("translation").alias("a"), F.col("content").alias("b"),
        F.length("content").cast("bigint").alias("n"))
    c = reshape.compound_words(w).select(
        F.lit("compound").alias("kind"), F.col("sequence").alias("id"), F.col("jp").alias("a"), F.col("kana").alias("b"),
        F.size("translations").cast("bigint").alias("n"))
    a = reshape.app_words(w).select(F.lit("app").alias("kind"), F.col("sequence").alias("id"), F.col("reading").alias("a"),
                                    F.get("alt_readings", 0).alias("b"), F.size("senses").cast("bigint").alias("n"))
    return s.unionByName(c).unionByName(a)


@query("rsh22_public_json", """SELECT 'kanji' AS kind, literal AS id, '"literal":"' || literal || '"' AS has FROM v_kanji
    UNION ALL SELECT 'word', CAST(sequence AS VARCHAR), '"kana":"' || kana || '"' FROM v_words""")
def rsh22_json(spark, sf):
    """The JSON bodies, checked through one field each."""
    k = reshape.public_kanji(views.kanji(spark, sf)).select(
        F.lit("kanji").alias("kind"), F.col("literal").alias("id"), F.concat(
            F.lit('"literal":"'), F.get_json_object("body", "$.literal"), F.lit('"')).alias("has"))
    w = reshape.public_words(views.words(spark, sf)).select(
        F.lit("word").alias("kind"), F.col("sequence").cast("string").alias("id"), F.concat(
            F.lit('"kana":"'), F.get_json_object("body", "$.reading.kana"), F.lit('"')).alias("has"))
    return k.unionByName(w)


@query("rsh23_suggestion_pairs", """SELECT sequence, coalesce(CASE WHEN kanji IS NOT NULL THEN kana END, main) AS primary_text, kanji AS secondary_text,
    coalesce(kanji, kana) AS preferred, main = kana AS has_kana FROM v_words""")
def rsh23(spark, sf):
    w = views.words(spark, sf)
    p = reshape.word_pairs(w).join(w.select("sequence", reshape.main_reading().alias("m"),
                                            F.col("reading.kana.reading").alias("k")), "sequence")
    return p.select("sequence", F.col("primary").alias("primary_text"), F.col("secondary").alias("secondary_text"), "preferred",
                    (reshape.pair_has_reading(F.col("k")) & (F.col("m") == F.col("k"))).alias("has_kana"))


@query("rsh24_short_news", "SELECT id, short, short <> long AS was_trimmed FROM v_news")
def rsh24(spark, sf):
    return views.news(spark, sf).select("id", "short", "was_trimmed")


@query("rsh25_tag_count", """SELECT sequence, CAST(common AS BIGINT) + CAST(jlpt_lvl IS NOT NULL AS BIGINT) AS tag_count, kata_word AS katakana
    FROM v_words""")
def rsh25(spark, sf):
    return reshape.word_flags(views.words(spark, sf)).select("sequence", "tag_count", "katakana")


@query("rsh26_record_flags", f"""SELECT 'word' AS kind, sequence AS id, has_coll AS flag, regexp_matches(main, '[{q.HAN_RE}]') AS flag2,
      kanji || '【' || kana || '】.mp3' AS label, CAST(NULL AS BIGINT) AS num FROM v_words
    UNION ALL SELECT 'kanji', idx, len(kun_dicts) > 0, true, literal, NULL FROM v_kanji
    UNION ALL SELECT 'sentence', id, jlpt_guess IS NOT NULL, false, NULL, level - 10 FROM v_sentences""")
def rsh26(spark, sf):
    none = F.lit(None).cast("bigint").alias("num")
    w = reshape.word_flags(views.words(spark, sf)).select(
        F.lit("word").alias("kind"), F.col("sequence").alias("id"), F.col("has_collocations").alias("flag"),
        F.col("has_kanji").alias("flag2"), F.col("audio_file").alias("label"), none)
    k = views.kanji(spark, sf)
    k = k.join(reshape.kanji_flags(k), "literal").select(
        F.lit("kanji").alias("kind"), F.col("radical.id").cast("bigint").alias("id"), F.col("has_compounds").alias("flag"),
        reshape.matches_kanji(F.col("literal"), F.get("onyomi", 0)).alias("flag2"), F.col("literal").alias("label"), none)
    s = views.sentences(spark, sf).select(
        F.lit("sentence").alias("kind"), "id", reshape.valid_jlpt_guess("jlpt_guess").isNotNull().alias("flag"),
        F.lit(False).alias("flag2"), F.lit(None).cast("string").alias("label"),
        reshape.sentence_level().cast("bigint").alias("num"))
    return w.unionByName(k).unionByName(s)
