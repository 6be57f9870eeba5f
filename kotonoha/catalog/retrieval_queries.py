"""Retrieval (RET) and filters (FIL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kotonoha.catalog import sql_views as q
from kotonoha.catalog.index_queries import aligned_words
from kotonoha.catalog.registry import query
from kotonoha.catalog.text_queries import JTERMS, jterms, sql_hiragana
from kotonoha.functions import text
from kotonoha.operators import filters, index, reshape, retrieve, score, segment
from kotonoha.plans.scaling import by_key
from kotonoha.session import cut_lineage
from kotonoha.sources import records, views

DICE = "2.0 * overlap / (n_grams + q_grams)"


def candidates(spark, sf, threshold=None, headwords=None):
    """Misspelt words against all headwords."""
    return retrieve.ngram_candidates(retrieve.query_grams(views.query_words(spark, sf)),
                                     views.gram_items(spark, sf, headwords), threshold)


@query("ret1_ngram_candidates", "SELECT query_id, count(*) AS items, CAST(sum(overlap) AS BIGINT) AS overlap, max(overlap) AS best FROM v_cand GROUP BY query_id")
def ret1(spark, sf):
    return candidates(spark, sf).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum("overlap").alias("overlap"), F.max("overlap").alias("best"))


GLOSS = {
    "v_phrase": f"""SELECT sequence AS doc_id, language AS lang, regexp_replace({q.strip_punct('trim(gloss)')}, '^to ', '') AS p FROM v_glosses""",
    "v_gterms": """SELECT doc_id, lang, term, count(*) AS tf FROM (SELECT doc_id, lang,
        unnest(list_filter(list_concat([p], string_split(p, ' ')), lambda t: t <> '')) AS term FROM v_phrase) GROUP BY ALL""",
    "v_gvec": """SELECT lang AS posting, doc_id, term, tf * log2(n_docs / df) AS weight FROM v_gterms
        JOIN (SELECT lang, term, count(*) AS df FROM v_gterms GROUP BY ALL) USING (lang, term)
        JOIN (SELECT lang, count(DISTINCT doc_id) AS n_docs FROM v_gterms GROUP BY ALL) USING (lang)""",
    "v_gq": """SELECT query_id, lang, term, max(qw) AS qw FROM (
        SELECT query_id, lang, p AS term, 1.0::DOUBLE AS qw FROM v_gqueries UNION ALL
        SELECT query_id, lang, unnest(list_filter(string_split(p, ' '), lambda w: w <> '')), 0.001 FROM v_gqueries) WHERE term <> '' GROUP BY ALL""",
    "v_gqueries": f"""SELECT DISTINCT p_name || '/' || lang AS query_id, p_name AS q, lang, regexp_replace({q.strip_punct("'to ' || p_name")}, '^to ', '') AS p
        FROM v_part, (VALUES ('English'), ('German')) AS l(lang)""",
    "v_gcand": """SELECT query_id, lang, doc_id, sum(qw * weight) AS dot, count(*) AS shared FROM v_gvec JOIN v_gq
        ON posting = lang AND v_gvec.term = v_gq.term GROUP BY ALL""",
}


def gloss_queries(spark, sf):
    """Every distinct part name, asked in English and in German."""
    p = views.part_words(spark, sf).select("p_name").distinct()
    p = p.select("p_name", F.explode(F.array(F.lit("English"), F.lit("German"))).alias("lang"))
    return p.select(F.concat_ws("/", "p_name", "lang").alias("query_id"), F.concat(F.lit("to "), F.col("p_name")).alias("q"),
                    F.col("p_name"), "lang")


def gloss_candidates(spark, sf):
    vec = index.term_vectors(index.gloss_terms(views.words(spark, sf)))
    terms = retrieve.gloss_query_terms(gloss_queries(spark, sf), keep=["lang"]).withColumnRenamed("lang", "posting")
    return retrieve.vector_candidates(terms, vec, on=["posting"])


@query("ret2_gloss_candidates", "SELECT query_id, doc_id AS item_id, round(dot, 6) AS dot, shared FROM v_gcand", GLOSS)
def ret2(spark, sf):
    return gloss_candidates(spark, sf).select("query_id", F.col("doc_id").alias("item_id"), "dot", "shared")


PASS = {"v_pcand": """SELECT query_id, posting, doc_id, sum(weight) AS dot, count(*) AS shared FROM v_vec JOIN v_pass_terms USING (term) GROUP BY ALL""",
        "v_pnorm": """SELECT query_id, sqrt(count(*)) AS norm_q FROM (SELECT DISTINCT query_id, term FROM v_pass_terms SEMI JOIN v_vec USING (term)) GROUP BY query_id"""}


def passage_candidates(spark, sf):
    vec = index.term_vectors(views.doc_terms(spark, sf))
    terms = retrieve.sentence_query_terms(views.passages(spark, sf), tokens=text.letter_terms)
    return vec, terms, retrieve.vector_candidates(terms, vec)


@query("ret3_sentence_candidates", "SELECT query_id, posting, doc_id, round(dot, 4) AS dot, shared FROM v_pcand", PASS)
def ret3(spark, sf):
    return passage_candidates(spark, sf)[2].withColumn("dot", F.round("dot", 4))


@query("ret5_id_lookup", """SELECT query_id, 'word' AS kind, sequence AS item_id, main AS text, show_english OR NOT EXISTS
      (SELECT 1 FROM v_senses s WHERE s.sequence = w.sequence AND s.language = user_lang) AS english
      FROM v_raw JOIN v_words w ON form_no = 4 AND user_id = w.sequence
    UNION ALL SELECT query_id, 'name', sequence, coalesce(kanji, kana), show_english FROM v_raw JOIN v_names ON form_no = 4 AND user_id = sequence
    UNION ALL SELECT query_id, 'sentence', id, source, show_english FROM v_raw JOIN v_sentences ON form_no = 4 AND user_id = id""")
def ret5(spark, sf):
    from kotonoha.operators import querylog
    raw = views.raw_queries(spark, sf).select("query_id", "user_lang", "show_english", querylog.sequence_prefix("raw_query").alias("seq"))
    ids = raw.where("seq is not null")
    w = retrieve.by_id(ids, views.words(spark, sf), "sequence").select(
        "query_id", F.lit("word").alias("kind"), F.col("sequence").alias("item_id"), reshape.main_reading().alias("text"),
        retrieve.direct_word_language("senses", F.col("user_lang"), F.col("show_english")).alias("english"))
    n = retrieve.by_id(ids, views.names(spark, sf), "sequence").select(
        "query_id", F.lit("name").alias("kind"), F.col("sequence").alias("item_id"), reshape.name_reading().alias("text"),
        F.col("show_english").alias("english"))
    d = views.table(spark, sf, "documents").select("doc_id", "source")
    s = retrieve.by_id(ids, d, "doc_id").select(
        "query_id", F.lit("sentence").alias("kind"), F.col("doc_id").alias("item_id"), F.col("source").alias("text"),
        F.col("show_english").alias("english"))
    return w.unionByName(n).unionByName(s)


WILD = {"v_wild": "SELECT DISTINCT query_id, left(query_id, 2) AS head, right(query_id, 2) AS tail FROM v_query_words",
        "v_heads": "SELECT item_id, term, left(term, 1) AS head FROM v_terms UNION ALL SELECT item_id, term, left(term, 2) FROM v_terms WHERE length(term) > 1"}


def wildcard_queries(spark, sf):
    """The ends of every word of the log, with a wildcard between them."""
    from kotonoha.operators import querylog
    w = views.query_words(spark, sf)
    typed = F.concat(F.substring("query_id", 1, 2), F.lit("*"), F.substring("query_id", -2, 2))
    w = w.select("query_id", typed.alias("typed"))
    return w.select("query_id", querylog.wildcard_pattern("typed").alias("pattern"))


@query("ret6_wildcards", """SELECT query_id, item_id, term AS reading FROM v_wild JOIN v_heads USING (head)
    WHERE ends_with(term, tail) AND length(term) >= length(head) + length(tail)""", WILD)
def ret6(spark, sf):
    posts = cut_lineage(index.wildcard_postings(views.terms(spark, sf), "item_id", "term"), "wildcards")
    return retrieve.wildcard_candidates(wildcard_queries(spark, sf), posts)


KR = {"v_keys": f"""SELECT DISTINCT k.literal || r AS key, sequence AS item_id, k.literal, r FROM
      (SELECT sequence, unnest(string_split(w1, '')) AS ch FROM v_words WHERE kanji IS NOT NULL) JOIN
      (SELECT literal, ch, unnest([onyomi[1]] || kunyomi) AS r FROM v_kanji) k USING (ch)""",
      "v_krq": f"""SELECT query_id, {q.han('substr(w1, 1, 1)')} AS literal, {q.kata('substr(w1, 1, 1)')} AS reading FROM v_raw WHERE form_no = 8"""}


def kanji_reading_queries(spark, sf):
    from kotonoha.operators import querylog
    raw = views.raw_queries(spark, sf).withColumn("kr", querylog.kanji_reading("raw_query"))
    return raw.where("kr is not null").select("query_id", "kr.literal", "kr.reading")


def kanji_reading_hits(spark, sf):
    """Distinct (literal, reading) questions, searched once each."""
    asked = kanji_reading_queries(spark, sf).select("literal", "reading").distinct().select(
        F.concat_ws(" ", "literal", "reading").alias("query_id"), "literal", "reading")
    k = views.kanji(spark, sf)
    return retrieve.kanji_reading_candidates(asked, k, index.reading_keys(aligned_words(spark, sf), k))


@query("ret7_kanji_reading", """SELECT q.literal || ' ' || q.reading AS query_id, item_id FROM (SELECT DISTINCT literal, reading FROM v_krq) q
    JOIN v_keys k ON k.literal = q.literal AND k.r = q.reading""", KR)
def ret7(spark, sf):
    return kanji_reading_hits(spark, sf)


TAGQ = {"v_tagq": """SELECT DISTINCT misc || '/' || jlpt_lvl AS query_id, misc, jlpt_lvl FROM v_words WHERE misc IS NOT NULL AND jlpt_lvl IS NOT NULL""",
        "v_drive": """SELECT query_id, arg_min({'tag_type': tag_type, 'tag': tag}, (coalesce(freq, 4611686018427387904), tag_type, tag)) AS t FROM
      (SELECT query_id, 'misc' AS tag_type, misc AS tag FROM v_tagq UNION ALL SELECT query_id, 'jlpt', CAST(jlpt_lvl AS VARCHAR) FROM v_tagq)
      LEFT JOIN (SELECT tag_type, tag, count(*) AS freq FROM v_word_tags GROUP BY ALL) USING (tag_type, tag) GROUP BY query_id"""}


def tag_queries(spark, sf):
    """Every pair of a misc tag and a level that occurs, as a tag-only query."""
    w = views.words(spark, sf).where("jlpt_lvl is not null").select("jlpt_lvl", F.explode(filters.misc_of_word()).alias("misc")).distinct()
    w = w.withColumn("query_id", F.concat_ws("/", "misc", F.col("jlpt_lvl").cast("string")))
    tags = F.array(F.struct(F.lit("misc").alias("tag_type"), F.col("misc").alias("tag")),
                   F.struct(F.lit("jlpt").alias("tag_type"), F.col("jlpt_lvl").cast("string").alias("tag")))
    return w.select("query_id", F.explode(tags).alias("t")).select("query_id", "t.tag_type", "t.tag")


@query("ret8_tag_scan", """SELECT query_id, item_id, 1001.0::DOUBLE - k AS relevance FROM (SELECT d.query_id, w.word_id AS item_id,
      row_number() OVER (PARTITION BY d.query_id ORDER BY w.word_id DESC) AS k FROM v_drive d
      JOIN v_word_tags w ON w.tag_type = d.t.tag_type AND w.tag = d.t.tag JOIN v_tagq q ON q.query_id = d.query_id
      JOIN v_words x ON x.sequence = w.word_id AND x.misc = q.misc AND x.jlpt_lvl = q.jlpt_lvl) WHERE k <= 1000""", TAGQ)
def ret8(spark, sf):
    w = views.words(spark, sf)
    tags = index.word_tags(w, records.pos_dimension(spark))
    qt = tag_queries(spark, sf)
    driving = retrieve.driving_tag(qt, index.tag_cardinalities(tags))
    # the other tags of the query, as a division on the scanned rows
    need = qt.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    got = tags.join(qt, ["tag_type", "tag"]).groupBy("query_id", F.col("word_id").alias("item_id")).agg(F.count(F.lit(1)).alias("got"))
    keep = got.join(need, "query_id").where("got = need").select("query_id", "item_id")
    return retrieve.tag_scan(driving, tags, "word_id", keep)


@query("ret9_sentence_tag_scan", """SELECT tag_type || ':' || tag AS query_id, item_id, 1001.0::DOUBLE - k AS relevance FROM
    (SELECT *, row_number() OVER (PARTITION BY tag_type, tag ORDER BY item_id) AS k FROM v_sentence_tags) WHERE k <= 1000""")
def ret9(spark, sf):
    tags = index.sentence_tags(views.sentences(spark, sf))
    qs = tags.select("tag_type", "tag").distinct().withColumn("query_id", F.concat_ws(":", "tag_type", "tag"))
    return retrieve.tag_scan(qs, tags, "item_id", newest_first=False)


@query("ret10_kanji_by_tag", """SELECT query_id, pos, literal, total FROM (SELECT jlpt AS query_id, literal, count(*) OVER (PARTITION BY jlpt) AS total,
    row_number() OVER (PARTITION BY jlpt ORDER BY literal) AS pos FROM v_kanji WHERE jlpt IS NOT NULL) WHERE pos > 5 AND pos <= 10""")
def ret10(spark, sf):
    """The second page (five per page) of the kanji of each level."""
    from kotonoha.operators import collect
    tags = index.kanji_tags(views.kanji(spark, sf))
    hits = tags.select(F.col("tag").cast("bigint").alias("query_id"), "item_id", F.lit(0.0).alias("relevance"), F.lit(0).alias("producer"))
    qs = hits.select("query_id").distinct().select("query_id", F.lit(5).alias("page_offset"), F.lit(5).alias("page_size"))
    out = collect.page(hits, qs).join(collect.totals(hits), "query_id")
    return out.select("query_id", F.col("rank").alias("pos"), F.col("item_id").alias("literal"), "total")


ROMA = {"v_kana_items": f"""SELECT item_id, k, {q.index_grams('k')} AS g FROM (SELECT item_id, {sql_hiragana('term')} AS k,
       {sql_hiragana('term', nn=False)} AS k0 FROM v_terms) WHERE regexp_full_match(k0, '[ぁ-ゟ゠-ヿ]+')""",
        "v_rvar": f"""SELECT query_id, variant, q, {q.index_grams('q')} AS g FROM (SELECT query_id, 'hira' AS variant, h AS q FROM v_rq UNION ALL
       SELECT query_id, 'kata', {q.to_kata('h')} FROM v_rq)""",
        "v_rq": f"""SELECT query_id, {sql_hiragana('q')} AS h FROM v_query_words
       WHERE regexp_full_match({sql_hiragana('q', nn=False)}, '[\\p{{Han}}ぁ-ゟ゠-ヿ＀-￯　-〿]+')"""}


def kana_terms(spark, sf):
    """item_id, k, k0, freq: the headwords spelt as kana.  They are stored first, or what is asked
    of a spelling would be worked out for every token of the texts, before these are counted."""
    from kotonoha.functions import kana
    t = by_key(cut_lineage(views.terms(spark, sf), "terms"), "item_id")
    return t.select("item_id", kana.search_hiragana("term").alias("k"), kana.romaji_to_hiragana("term").alias("k0"), "freq")


@query("ret11_romaji_variants", """SELECT query_id, variant, count(*) AS items, max(CAST(n AS BIGINT)) AS best FROM (SELECT query_id, variant, item_id, count(*) AS n FROM
      (SELECT query_id, variant, unnest(g) AS gram FROM v_rvar) JOIN (SELECT item_id, unnest(g) AS gram FROM v_kana_items) USING (gram) GROUP BY ALL)
    GROUP BY ALL""", ROMA)
def ret11(spark, sf):
    """Latin words read as kana, against the headwords that can be read so."""
    posts = index.ngram_items(kana_terms(spark, sf).where(text.is_kana("k0")), "item_id", "k")
    v = retrieve.romaji_variants(views.query_words(spark, sf).select("query_id", "q"))
    grams = retrieve.query_grams(v.select(F.concat_ws("/", "query_id", "variant").alias("query_id"), "q"))
    c = retrieve.ngram_candidates(grams, posts).groupBy("query_id").agg(F.count(F.lit(1)).alias("items"), F.max("overlap").alias("best"))
    return c.select(F.split("query_id", "/")[0].alias("query_id"), F.split("query_id", "/")[1].alias("variant"), "items", "best")


@query("ret12_language_variants", """SELECT query_id, user_lang AS lang FROM v_raw UNION SELECT query_id, 'English' FROM v_raw WHERE show_english""")
def ret12(spark, sf):
    r = views.raw_queries(spark, sf).select("query_id", F.col("user_lang").alias("lang"), "show_english")
    return retrieve.language_variants(r).select("query_id", "lang")


@query("ret13_kanji_of_text", f"""SELECT query_id, pos, literal FROM (SELECT query_id, pos, literal, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM
    (SELECT query_id, unnest(cs) AS literal, generate_subscripts(cs, 1) - 1 AS pos FROM (SELECT query_id, {q.chars(q.han('lower(q)'))} AS cs FROM v_passages))
    SEMI JOIN v_kanji USING (literal)) WHERE n <= 100""")
def ret13(spark, sf):
    p = views.passages(spark, sf).select("query_id", views.han(F.lower("q")).alias("q"))
    return retrieve.kanji_of_text(p, views.kanji(spark, sf))


@query("ret15_korean_and_meaning", f"""SELECT 'ko:' || {q.hangul('ch')} AS query_id, literal FROM v_kanji SEMI JOIN (SELECT DISTINCT substr(term, 1, 1) AS ch FROM v_terms) USING (ch)
    UNION ALL SELECT 'LETTER ' || upper(ch), literal FROM v_kanji SEMI JOIN (SELECT DISTINCT substr(term, 1, 1) AS ch FROM v_terms WHERE regexp_matches(term, '^[a-z]')) USING (ch)""")
def ret15(spark, sf):
    first = views.terms(spark, sf).select(F.substring("term", 1, 1).alias("ch")).distinct().where(F.col("ch").rlike("[a-z]"))
    k = views.kanji(spark, sf)
    ko = retrieve.kanji_by_korean(first.select(F.concat(F.lit("ko:"), F.translate("ch", views.LETTERS, views.HANGUL26)).alias("query_id"),
                                               F.translate("ch", views.LETTERS, views.HANGUL26).alias("q")), k)
    asked = F.concat(F.lit("LETTER "), F.upper("ch"))
    me = retrieve.kanji_by_meaning(first.select(asked.alias("query_id"), asked.alias("q")), k)
    return ko.unionByName(me)


NALIGN = {"v_nalign": """SELECT sequence AS item_id, unnest(string_split(kanji, '')) AS literal, unnest(string_split(kana, '')) AS reading FROM v_names WHERE kanji IS NOT NULL"""}


def aligned_names(spark, sf):
    """item_id, literal, reading of all names with kanji (dictionary and name readings)."""
    n = views.names(spark, sf).where("kanji is not null").select(F.col("sequence").alias("pair_id"), "kanji", "kana")
    split = segment.split_compounds(n, index.dictionary_readings(views.kanji(spark, sf), with_nanori=True))
    return split.where("parts is not null").select(F.col("pair_id").alias("item_id"), F.explode("parts").alias("p")).select(
        "item_id", "p.literal", "p.reading")


@query("ret16_names_by_kanji_reading", """SELECT DISTINCT q.literal || ' ' || q.r AS query_id, item_id FROM (SELECT literal, unnest([kunyomi[3], onyomi[1]]) AS r FROM v_kanji) q
    JOIN v_nalign a ON a.literal = q.literal AND contains(a.reading, q.r)""", NALIGN)
def ret16(spark, sf):
    k = views.kanji(spark, sf).select("literal", F.explode(F.array(F.get("kunyomi", 2), F.get("onyomi", 0))).alias("reading"))
    qs = k.withColumn("query_id", F.concat_ws(" ", "literal", "reading"))
    return retrieve.names_by_kanji_reading(qs, aligned_names(spark, sf))


SPLIT = {"v_split": f"""SELECT DISTINCT p_name AS query_id, CAST(0 AS BIGINT) AS pos, {q.hira('w1')} AS q FROM v_part UNION ALL
       SELECT DISTINCT p_name, CAST(1 AS BIGINT), {q.hira('w2')} FROM v_part""",
         "v_split_hits": f"""SELECT query_id, pos, item_id, overlap / (0.1 * n_grams + 0.9 * q_grams) * (2 - pos) * 0.001 AS relevance FROM
       (SELECT query_id, pos, item_id, q_grams, n_grams, count(*) AS overlap FROM
        (SELECT query_id, pos, unnest(g) AS gram, len(g) AS q_grams FROM (SELECT *, {q.index_grams('q')} AS g FROM v_split)) JOIN
        (SELECT item_id, unnest(g) AS gram, len(g) AS n_grams FROM (SELECT sequence AS item_id, {q.index_grams('kana')} AS g FROM v_names)) USING (gram) GROUP BY ALL)"""}


def split_name_hits(spark, sf):
    p = views.part_words(spark, sf).select("p_name", "w1", "w2").distinct()
    parts = p.select(F.col("p_name").alias("query_id"), F.posexplode(F.array(views.hira("w1"), views.hira("w2"))).alias("pos", "normalised"))
    v = retrieve.part_variants(parts)
    keyed = v.withColumn("query_id", F.concat_ws("/", "query_id", F.col("pos").cast("string")))
    grams = retrieve.query_grams(keyed, keep=["pos", "n_parts"])
    posts = index.ngram_items(views.names(spark, sf), "sequence", "kana")
    c = retrieve.ngram_candidates(grams, posts)
    s = score.split_name_score(score.dice_weighted(score.NAME_DICE_WEIGHT), F.col("n_parts"), F.col("pos"))
    return c.select(F.split("query_id", "/")[0].alias("query_id"), "pos", "item_id", "overlap", s.alias("relevance"))


@query("ret17_split_name_parts", "SELECT query_id, pos, count(*) AS items FROM v_split_hits GROUP BY ALL", SPLIT)
def ret17(spark, sf):
    return split_name_hits(spark, sf).groupBy("query_id", "pos").agg(F.count(F.lit(1)).alias("items"))


@query("ret18_reading_exists", "SELECT query_id FROM v_query_words SEMI JOIN v_terms ON q = term")
def ret18(spark, sf):
    return retrieve.reading_exists(views.query_words(spark, sf), views.terms(spark, sf).select(
        F.col("term").alias("reading"))).select("query_id")


# -- filters --------------------------------------------------------------------------------


@query("fil1_language", """SELECT sequence, bool_or(language = 'French') AS french, bool_or(language IN ('French', 'English')) AS french_or_en FROM v_senses GROUP BY sequence""")
def fil1(spark, sf):
    return views.words(spark, sf).select(
        "sequence", filters.word_has_language(F.lit("French"), F.lit(False)).alias("french"),
        filters.word_has_language(F.lit("French"), F.lit(True)).alias("french_or_en"))


def words_with_pos(spark, sf):
    w = views.words(spark, sf)
    pos = index.word_pos(w, records.pos_dimension(spark)).groupBy("sequence").agg(F.collect_set("pos_simple").alias("word_pos"))
    return w.join(pos, "sequence")


def arr(*items):
    return F.array(*[F.lit(i) for i in items])


@query("fil2_pos_tags", """SELECT sequence, list_has_all(list(pos_simple), ['Noun', 'Verb']) AS noun_verb, list_contains(list(pos_simple), 'Adjective') AS adjective
    FROM v_word_pos GROUP BY sequence""")
def fil2(spark, sf):
    return words_with_pos(spark, sf).select("sequence", filters.all_present(arr("Noun", "Verb"), "word_pos").alias("noun_verb"),
                                            filters.all_present(arr("Adjective"), "word_pos").alias("adjective"))


@query("fil3_misc_tags", "SELECT sequence, coalesce(misc = 'Slang', false) AS slang FROM v_words")
def fil3(spark, sf):
    return views.words(spark, sf).select("sequence", filters.all_present(arr("Slang"), filters.misc_of_word()).alias("slang"))


@query("fil4_level", "SELECT sequence, coalesce(jlpt_lvl = 3, false) AS n3, true AS no_level_asked FROM v_words")
def fil4(spark, sf):
    return views.words(spark, sf).select("sequence", filters.jlpt_matches(F.lit(3)).alias("n3"),
                                         filters.jlpt_matches(F.lit(None).cast("int")).alias("no_level_asked"))


@query("fil5_katakana", "SELECT sequence, kata_word AS katakana FROM v_words")
def fil5(spark, sf):
    return views.words(spark, sf).select("sequence", filters.katakana_matches(F.lit(True)).alias("katakana"))


FIL6 = """SELECT w.sequence, EXISTS (SELECT 1 FROM v_glosses g WHERE g.sequence = w.sequence AND g.language IN ('German', 'English') AND contains(lower(gloss), 'ring')) AS foreign_term,
    contains(kana, 'そさ') AS kana_term, coalesce(contains(kanji, '耳土'), false) OR coalesce(contains(alt, '耳土'), false) AS kanji_term FROM v_words w"""


@query("fil6_quoted_terms", FIL6)
def fil6(spark, sf):
    lang = (F.lit("German"), F.lit(True))
    return views.words(spark, sf).select(
        "sequence", filters.quoted_terms_match(arr("ring"), *lang).alias("foreign_term"),
        filters.quoted_terms_match(arr("そさ"), *lang).alias("kana_term"),
        filters.quoted_terms_match(arr("耳土"), *lang).alias("kanji_term"))


@query("fil7_word_filter", """SELECT w.sequence FROM v_words w JOIN (SELECT sequence, list(pos_simple) AS p FROM v_word_pos GROUP BY sequence) USING (sequence)
    WHERE list_contains(p, 'Noun') AND misc IS NOT NULL AND misc = 'Archaism' AND NOT kata_word IS NULL
      AND EXISTS (SELECT 1 FROM v_senses s WHERE s.sequence = w.sequence AND language = 'German')
      AND EXISTS (SELECT 1 FROM v_glosses g WHERE g.sequence = w.sequence AND g.language = 'German' AND contains(lower(gloss), 'o'))""")
def fil7(spark, sf):
    keep = filters.word_filter(F.lit("German"), F.lit(False), pos=arr("Noun"), misc=arr("Archaism"), jlpt=F.lit(None).cast("int"),
                               katakana=F.lit(False), required=arr("o"), irregular=F.lit(False))
    return words_with_pos(spark, sf).where(keep).select("sequence")


@query("fil8_sentence_filter", """SELECT id FROM v_sentences s WHERE EXISTS (SELECT 1 FROM v_translations t WHERE t.id = s.id AND t.language = 'English')
    AND (slang OR tag1 = 'Slang') AND contains(japanese, 'とし')""")
def fil8(spark, sf):
    s = views.sentences(spark, sf).withColumn("kana", F.col("furigana"))
    return s.where(filters.sentence_filter(F.lit("English"), F.lit(False), tags=arr("Slang"), required=arr("とし"))).select("id")


@query("fil9_all_quoted_terms", f"""SELECT query_id, doc_id FROM (SELECT query_id, doc_id, count(*) AS got FROM v_doc_terms JOIN
      (SELECT DISTINCT query_id, unnest({q.tokens('q')}) AS term FROM v_passages) USING (term) GROUP BY ALL)
    JOIN (SELECT query_id, count(*) AS need FROM (SELECT DISTINCT query_id, unnest({q.tokens('q')}) AS term FROM v_passages) GROUP BY ALL) USING (query_id)
    WHERE got = need""")
def fil9(spark, sf):
    """Documents that hold every word of a benchmark passage."""
    need = views.passages(spark, sf).select("query_id", F.explode(text.letter_terms("q")).alias("term"))
    return filters.documents_with_all_terms(need, views.doc_terms(spark, sf))


FIL10 = {"v_seg": f"SELECT DISTINCT doc_id AS item_id, {q.han('substr(term, 1, 1)')} AS literal, {q.kata('substr(term, 1, 2)')} AS kana FROM v_tok",
         "v_lex": f"SELECT DISTINCT doc_id AS item_id, {q.han('substr(term, 1, 1)')} || CASE WHEN length(term) % 2 = 0 THEN 'う' ELSE 'く' END AS lexeme FROM v_tok"}


@query("fil10_kanji_reading_in_sentence", f"""SELECT DISTINCT query_id, item_id FROM (SELECT k.literal || ' ' || r AS query_id, item_id FROM v_kr JOIN v_kanji k USING (literal) JOIN v_seg s
      ON s.literal = k.literal AND contains({q.fold('s.kana')}, {q.fold('r')}) WHERE NOT regexp_matches(r, '[-.]')
    UNION ALL SELECT k.literal || ' ' || r, item_id FROM v_kr JOIN v_kanji k USING (literal) JOIN v_lex ON lexeme = k.literal || string_split(r, '.')[2] WHERE regexp_matches(r, '[-.]'))""",
       {**FIL10, "v_kr": "SELECT literal, unnest(kunyomi || onyomi) AS r FROM v_kanji"})
def fil10(spark, sf):
    k = views.kanji(spark, sf)
    tok = views.doc_tokens(spark, sf)
    first = views.han(F.substring("term", 1, 1))
    seg = tok.select(F.col("doc_id").alias("item_id"), first.alias("literal"), views.kata(F.substring("term", 1, 2)).alias("kana")).distinct()
    lex = tok.select(F.col("doc_id").alias("item_id"), F.concat(first, F.when(F.length("term") % 2 == 0, "う").otherwise("く")).alias("lexeme")).distinct()
    qs = reshape.kanji_readings(k).select(F.concat_ws(" ", "literal", "reading").alias("query_id"), "literal", "reading")
    return filters.sentences_with_reading(qs, k, seg, lex)


@query("fil11_thresholds", """SELECT item_id, CASE WHEN nk >= 2 * na OR nk + na < 5 THEN 0.15 ELSE 0.3 END::DOUBLE AS threshold FROM
    (SELECT item_id, length(regexp_replace(mixed, '[^\\p{Han}]', '', 'g')) AS nk, length(regexp_replace(mixed, '[^ぁ-ゟ゠-ヿ]', '', 'g')) AS na FROM v_j)""", JTERMS)
def fil11(spark, sf):
    return jterms(spark, sf).select("item_id", score.word_threshold("mixed").alias("threshold"))


@query("fil12_item_and_result_filters", "SELECT doc_id, CAST(quality AS BIGINT) AS quality FROM documents JOIN labels USING (doc_id) WHERE n_chars > 500 AND toxic = 0")
def fil12(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", "n_chars")
    labels = views.table(spark, sf, "labels")
    return filters.before_and_after(docs, F.col("n_chars") > 500, labels, ["doc_id"], F.col("toxic") == 0).select("doc_id", "quality")


@query("fil13_radical_filter", f"""SELECT query_id, item_id FROM v_cand c JOIN v_terms USING (item_id) WHERE {DICE} >= 0.6 AND len(list_filter(string_split(term, ''), lambda ch:
      NOT contains(c.query_id, ch) AND list_contains(CASE WHEN strpos('abcdefghijklmnopqrstuvwxyz', ch) > 0 THEN [ch, substr('bcdefghijklmnopqrstuvwxyza', strpos('abcdefghijklmnopqrstuvwxyz', ch), 1)] ELSE [] END,
        right(c.query_id, 1)))) > 0""")
def fil13(spark, sf):
    """Hits holding a character that is not typed and contains the last typed letter as a part."""
    hits = candidates(spark, sf, 0.6).where(score.dice() >= 0.6).select("query_id", "item_id")
    t = views.terms(spark, sf)
    word_chars = t.select("item_id", F.explode(F.array_distinct(text.chars(views.han("term")))).alias("literal"))
    qw = views.query_words(spark, sf)
    query_chars = qw.select("query_id", F.explode(F.array_distinct(text.chars(views.han("query_id")))).alias("literal"))
    parts = views.kanji(spark, sf).select("literal", F.explode("parts").alias("radical"))
    rads = qw.select("query_id", views.han(F.substring("query_id", -1, 1)).alias("radical"))
    return filters.words_with_radicals(hits, word_chars, query_chars, parts, rads)


@query("fil14_exact_reading", f"""SELECT sequence, coalesce(kana = h OR kanji = h OR alt = h, kana = h) AS any_reading, coalesce(alt = a, false) AS by_alt,
    coalesce(kana = a OR kanji = a, false) AS main_only FROM (SELECT *, {q.hira('w1')} || {q.hira('w2')} AS h, {q.han('w1')} || {q.han('w2')} AS a FROM v_words)""")
def fil14(spark, sf):
    p = views.part_words(spark, sf).select(F.col("p_partkey").alias("sequence"), F.concat(views.hira("w1"), views.hira("w2")).alias("h"),
                                           F.concat(views.han("w1"), views.han("w2")).alias("a"))
    return views.words(spark, sf).join(p, "sequence").select(
        "sequence", filters.has_reading(F.col("h")).alias("any_reading"), filters.has_reading(F.col("a")).alias("by_alt"),
        filters.has_main_reading(F.col("a")).alias("main_only"))
