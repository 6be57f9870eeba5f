"""Suggestions (SUG) over typed inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kotonoha.catalog import retrieval_queries as rq
from kotonoha.catalog import sql_views as q
from kotonoha.catalog.index_queries import aligned_words
from kotonoha.catalog.registry import query
from kotonoha.catalog.segment_queries import GROUPED, text_parts
from kotonoha.catalog.text_queries import ROMAJI_SQL, sql_hiragana
from kotonoha.functions import kana, text
from kotonoha.operators import index, reshape, suggest
from kotonoha.sources import records, views

def prefixes(x):
    """SQL for a row per prefix of a string."""
    return f"unnest([left({x}, n) FOR n IN range(1, length({x}) + 1)])"


VOC = {
    "v_typed": f"SELECT DISTINCT q, q AS query_id FROM (SELECT {prefixes('query_id')} AS q FROM v_query_words)",
    "v_voc": "SELECT item_id, lang, term AS text, freq / (SELECT max(freq) FROM v_terms) AS fs FROM v_terms",
    "v_pre": f"""SELECT query_id, item_id, text, lang, fs, length(q) / length(text) AS share
        FROM v_typed JOIN (SELECT *, {prefixes('text')} AS q FROM v_voc) USING (q)""",
    "v_sug": """SELECT query_id, item_id, text, score, rank FROM (SELECT query_id, item_id, text, round(share + fs, 6) AS score,
        row_number() OVER (PARTITION BY query_id ORDER BY round(share + fs, 6) DESC, text, item_id) AS rank FROM v_pre) WHERE rank <= 30""",
}


def typed(spark, sf):
    """What stands in the box after every key stroke of each word of the log."""
    w = views.query_words(spark, sf).select(every_prefix("query_id").alias("q")).distinct()
    return w.select(F.col("q").alias("query_id"), "q")


def every_prefix(name):
    return F.explode(F.transform(F.sequence(F.lit(1), F.length(name)), lambda n: F.left(F.col(name), n)))


def vocabulary(spark, sf):
    t = views.terms(spark, sf).select("item_id", "lang", F.col("term").alias("text"), "freq")
    return suggest.frequency_share(t).drop("freq")


@query("sug1_prefix_suggestions", "SELECT query_id, item_id, text, score, rank FROM v_sug", VOC)
def sug1(spark, sf):
    return suggest.prefix_suggestions(typed(spark, sf), vocabulary(spark, sf).drop("lang"))


@query("sug2_typo_suggestions", f"SELECT query_id, item_id, round({rq.DICE}, 6) AS score FROM v_cand JOIN v_query_words USING (query_id) WHERE length(q) >= 5 AND {rq.DICE} >= 0.5")
def sug2(spark, sf):
    return suggest.ngram_suggestions(views.query_words(spark, sf), views.gram_items(spark, sf), 0.5, 5)


@query("sug3_language_suggestions", """SELECT query_id, item_id, text, score, rank FROM (SELECT query_id, item_id, text, round(s, 6) AS score,
      row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, text, item_id) AS rank FROM
    (SELECT query_id || '/' || own AS query_id, item_id, text, max(CASE WHEN lang = own THEN 1.5 * share + 0.5 * fs ELSE 0.75 * (1.5 * share + 0.15 * fs) END) AS s
     FROM v_pre, (VALUES ('de'), ('fr'), ('es'), ('en')) AS o(own) WHERE lang = own OR lang = 'en' GROUP BY ALL)) WHERE rank <= 30""", VOC)
def sug3(spark, sf):
    t = typed(spark, sf).select("q", F.explode(rq.arr("de", "fr", "es", "en")).alias("lang"))
    t = t.select(F.concat_ws("/", "q", "lang").alias("query_id"), "q", "lang", F.lit(True).alias("show_english"))
    return suggest.language_suggestions(t, vocabulary(spark, sf))


JP = r"[\p{Han}ぁ-ゟ゠-ヿ＀-￯　-〿]+"
ROM = {
    "v_kv": f"""SELECT item_id, {sql_hiragana('term')} AS text, freq / (SELECT max(freq) FROM v_terms) AS fs FROM v_terms
        WHERE regexp_full_match({sql_hiragana('term', nn=False)}, '[ぁ-ゟ゠-ヿ]+')""",
    "v_rt": "SELECT query_id, q AS typed, CASE WHEN ends_with(q, 'm') THEN left(q, length(q) - 1) ELSE q END AS a FROM v_typed",
    "v_guess": f"""SELECT *, length(a) AS n, greatest(0, 3 - length(regexp_replace(a, '[^n]', '', 'g'))) AS spare,
        regexp_full_match({sql_hiragana('a', nn=False)}, '{JP}') AS ok0, regexp_full_match({sql_hiragana('left(a, length(a) - 1)', nn=False)}, '{JP}') AS ok1,
        regexp_full_match({sql_hiragana('left(a, greatest(length(a) - 2, 0))', nn=False)}, '{JP}') AS ok2,
        regexp_full_match({sql_hiragana('typed', nn=False)}, '{JP}') AS okt FROM v_rt""",
    "v_rg": f"""SELECT query_id, typed, okt, coalesce(CASE WHEN n < 3 THEN NULL WHEN ok0 THEN {sql_hiragana('a')} WHEN n > spare AND ok1 THEN {sql_hiragana('left(a, length(a) - 1)')}
        WHEN n >= spare + 2 AND regexp_matches(a, '(sh|ch|ts|hy|ky|ny|my|gy|ry|by|py)$') AND ok2 THEN {sql_hiragana('left(a, greatest(length(a) - 2, 0))')} END, {sql_hiragana('typed')}) AS q FROM v_guess""",
    "v_rs": f"""SELECT query_id, item_id, text, (length(q) / length(text) + fs) * CASE WHEN okt THEN 0.99 ELSE 0.5 END + CASE WHEN starts_with({ROMAJI_SQL.replace('kata', 'text')}, lower(typed)) THEN 1000 ELSE 0 END AS s
        FROM v_rg JOIN v_kv ON starts_with(text, q)""",
    **VOC,
}


@query("sug4_romaji_suggestions", """SELECT query_id, item_id, text, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, text, item_id) AS rank
    FROM v_rs) WHERE rank <= 30""", ROM)
def sug4(spark, sf):
    t = rq.kana_terms(spark, sf).withColumnRenamed("k", "text")
    v = suggest.frequency_share(t).where(text.is_kana("k0")).drop("k0", "freq")
    return suggest.romaji_suggestions(typed(spark, sf), v)


KE = {"v_ke": f"""SELECT DISTINCT p_name AS query_id, {q.han('w1')} AS kp, {q.hira('right(w2, 2)')} AS ap FROM v_part"""}


@query("sug5_kana_end", """SELECT query_id, item_id, text, distance FROM (SELECT query_id, sequence AS item_id, kanji AS text,
    CASE WHEN ends_with(kana, ap) THEN 0 WHEN contains(kana, ap) THEN (strpos(reverse(kana), reverse(ap)) - 1) * 2 END AS distance
    FROM v_ke JOIN v_words ON starts_with(kanji, kp)) WHERE distance <= 10""", KE)
def sug5(spark, sf):
    p = views.part_words(spark, sf).select("p_name", "w1", "w2").distinct()
    qs = p.select(F.col("p_name").alias("query_id"), F.concat(views.han("w1"), views.hira(F.substring("w2", -2, 2))).alias("q"))
    e = views.words(spark, sf).select(F.col("sequence").alias("item_id"), F.col("reading.kanji.reading").alias("kanji"), F.col("reading.kana.reading").alias("kana"))
    return suggest.kana_end_suggestions(qs, e)


@query("sug6_kana_variants", f"""SELECT query_id, 'typed' AS variant, q, 1.0::DOUBLE AS weight FROM (SELECT DISTINCT p_name AS query_id, {q.hira('w1')} AS q FROM v_part)
    UNION ALL SELECT DISTINCT p_name, 'katakana', {q.kata('w1')}, 0.8::DOUBLE FROM v_part
    UNION ALL SELECT DISTINCT p_name, 'retry', {q.kata('w1')}, 1.0::DOUBLE FROM v_part WHERE {q.hira('w1')} NOT IN (SELECT substr(kana, 1, length({q.hira('w1')})) FROM v_words)""")
def sug6(spark, sf):
    qs = views.part_words(spark, sf).select(F.col("p_name").alias("query_id"), views.hira("w1").alias("q")).distinct()
    w = views.words(spark, sf).select(F.col("sequence").alias("item_id"), F.col("reading.kana.reading").alias("text"), F.lit(0.0).alias("freq_share"))
    hits = suggest.prefix_suggestions(qs, w, None)
    retry = suggest.katakana_retry(qs, hits).select("query_id", F.lit("retry").alias("variant"), "q", F.lit(1.0).alias("weight"))
    return suggest.kana_variants(qs).unionByName(retry)


@query("sug7_inflection_entries", """SELECT query_id, 'entry' AS kind, normalised AS text, CAST(size - k + 1 AS DOUBLE) AS weight FROM
      (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS k, count(*) OVER (PARTITION BY query_id) AS size FROM v_wparts
       WHERE n_parts > 1 AND word_class <> 'Particle') WHERE size <= 15
    UNION ALL SELECT query_id, 'query', normalised, 0.75 FROM v_wparts WHERE n_parts = 1 AND inflected_word""", GROUPED)
def sug7(spark, sf):
    single, custom = suggest.inflection_entries(text_parts(spark, sf))
    return custom.select("query_id", F.lit("entry").alias("kind"), "text", F.col("score").cast("double").alias("weight")).unionByName(
        single.select("query_id", F.lit("query").alias("kind"), F.col("q").alias("text"), F.col("weight").cast("double")))


@query("sug8_exact_first", """SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN text = query_id THEN 0 ELSE 1 END, rank) AS rank FROM v_sug""", VOC)
def sug8(spark, sf):
    hits = sug1(spark, sf).withColumn("primary", F.col("text")).withColumn("secondary", F.lit(None).cast("string"))
    return suggest.exact_first(hits, typed(spark, sf)).select("query_id", "item_id", "rank")


NAMEQ = {"v_nq": f"""SELECT DISTINCT 'kana:' || q AS query_id, q FROM (SELECT {prefixes('kana')} AS q FROM v_names)
            UNION SELECT DISTINCT 'latin:' || q, q FROM (SELECT {prefixes('transcription')} AS q FROM v_names)""",
         "v_nforms": f"SELECT query_id, q FROM v_nq WHERE query_id LIKE 'kana:%' UNION SELECT query_id, {q.to_kata('q')} FROM v_nq WHERE query_id LIKE 'kana:%'"}


@query("sug9_name_suggestions", """SELECT query_id, item_id, text, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, text, item_id) AS rank FROM
    (SELECT query_id, sequence AS item_id, kana AS text, length(q) / length(kana) AS score FROM v_nforms JOIN v_names ON starts_with(kana, q)
     UNION ALL SELECT query_id, sequence, transcription, length(q) / length(transcription) FROM v_nq JOIN v_names ON query_id LIKE 'latin:%' AND starts_with(transcription, q))) WHERE rank <= 30""", NAMEQ)
def sug9(spark, sf):
    n = views.names(spark, sf)
    jp = n.select(every_prefix("kana").alias("q")).distinct().select(F.concat(F.lit("kana:"), F.col("q")).alias("query_id"), "q")
    la = n.select(every_prefix("transcription").alias("q")).distinct().select(F.concat(F.lit("latin:"), F.col("q")).alias("query_id"), "q")
    native = n.select(F.col("sequence").alias("item_id"), F.col("kana").alias("text"), F.lit(0.0).alias("freq_share"))
    foreign = n.select(F.col("sequence").alias("item_id"), F.col("transcription").alias("text"), F.lit(0.0).alias("freq_share"))
    return suggest.name_suggestions(jp.unionByName(la), native, foreign)


@query("sug10_kanji_meanings", """SELECT query_id, literal || ' ' || text AS item_id, text, round(1.0 * length(q) / length(text) + fs, 6) AS score, rank FROM
    (SELECT query_id, q, literal, term AS text, freq / (SELECT max(freq) FROM v_radicals) AS fs, row_number() OVER (PARTITION BY query_id ORDER BY round(1.0 * length(q) / length(term) + freq / (SELECT max(freq) FROM v_radicals), 6) DESC, term, literal || ' ' || term) AS rank
     FROM v_typed JOIN v_radicals ON starts_with(term, q)) WHERE rank <= 30""", VOC)
def sug10(spark, sf):
    """Meanings of characters as entries; only entries with a character are kept."""
    r = views.radicals(spark, sf).select(F.concat_ws(" ", "literal", "term").alias("item_id"), F.col("term").alias("text"),
                                         F.col("literal").alias("secondary"), "freq")
    hits = suggest.prefix_suggestions(typed(spark, sf), suggest.frequency_share(suggest.keep_with_kanji(r)).drop("freq", "secondary"))
    return hits


SUG11 = {**rq.KR, "v_kc": "SELECT key, count(*) AS n FROM v_keys GROUP BY key",
         "v_kr11": "SELECT literal, r AS reading, pos FROM (SELECT literal, unnest(kunyomi || onyomi) AS r, generate_subscripts(kunyomi || onyomi, 1) - 1 AS pos FROM v_kanji)"}


@query("sug11_kanji_readings", f"""SELECT query_id, rank, reading AS primary_text, literal AS secondary_text, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos, reading) AS rank FROM
    (SELECT query_id, r.literal, r.reading, r.pos, CASE WHEN starts_with({q.fold("replace(r.reading, '.', '')")}, {q.fold('q.reading')}) THEN 1000000 ELSE 0 END + coalesce(CAST(floor(ln(n) / ln(1.01)) AS BIGINT), 0) AS score
     FROM (SELECT DISTINCT literal || ' ' || reading AS query_id, literal, reading FROM v_krq) q JOIN v_kr11 r USING (literal) LEFT JOIN v_kc ON key = r.literal || r.reading)) WHERE rank <= 30""", SUG11)
def sug11(spark, sf):
    k = views.kanji(spark, sf)
    asked = rq.kanji_reading_queries(spark, sf).select(F.concat_ws(" ", "literal", "reading").alias("query_id"), "literal", "reading").distinct()
    counts = index.reading_keys(aligned_words(spark, sf), k).groupBy("key").agg(F.count(F.lit(1)).alias("n_words"))
    out = suggest.kanji_reading_suggestions(asked, reshape.kanji_readings(k), counts)
    return out.withColumnRenamed("primary", "primary_text").withColumnRenamed("secondary", "secondary_text")


def hashtags(spark, sf):
    return records.parse_hashtags(views.hashtag_lines(spark, sf))


TAGS = {"v_hq": """SELECT DISTINCT source || '@' || t AS query_id, '#' || source AS q, t AS target FROM documents, (VALUES (0), (1), (2), (3)) AS v(t)
      UNION ALL SELECT '@' || t, '', t FROM (VALUES (0), (1), (2), (3)) AS v(t)""",
        "v_hg": f"SELECT tag, target, unnest(g) AS gram, len(g) AS n FROM (SELECT tag, target, {q.index_grams('tag', 2)} AS g FROM v_hashtags)",
        "v_hqg": f"SELECT query_id, target, unnest(g) AS gram, len(g) AS qn FROM (SELECT query_id, target, {q.index_grams('q', 2)} AS g FROM v_hq WHERE q <> '')",
        "v_hs": "SELECT query_id, tag, s FROM (SELECT query_id, tag, count(*) / (0.5 * n + 0.5 * qn) AS s FROM v_hg JOIN v_hqg USING (target, gram) GROUP BY query_id, tag, n, qn) WHERE s > 0.2"}


def hashtag_queries(spark, sf):
    """Every source name as a typed tag for each target, and the empty box."""
    src = views.table(spark, sf, "documents").select("source").distinct()
    t = src.select("source", F.explode(F.array(*[F.lit(i).cast("tinyint") for i in range(4)])).alias("target"))
    named = t.select(F.concat(F.col("source"), F.lit("@"), F.col("target").cast("string")).alias("query_id"),
                     F.concat(F.lit("#"), F.col("source")).alias("q"), "target")
    blank = t.select("target").distinct().select(F.concat(F.lit("@"), F.col("target").cast("string")).alias("query_id"), F.lit("").alias("q"), "target")
    return named.unionByName(blank)


@query("sug12_hashtags", """SELECT query_id, tag AS item_id, round(s, 6) AS score FROM v_hs JOIN (SELECT query_id, max(s) AS m FROM v_hs GROUP BY query_id) USING (query_id) WHERE s >= m - 0.4
    UNION ALL SELECT query_id, tag, round(freq, 6) FROM v_hq JOIN (SELECT tag, freq, target, row_number() OVER (PARTITION BY target ORDER BY freq DESC, tag) AS k FROM v_hashtags) USING (target) WHERE q = '' AND k <= 10""", TAGS)
def sug12(spark, sf):
    return suggest.hashtag_suggestions(hashtag_queries(spark, sf), hashtags(spark, sf))


@query("sug13_hashtag_prefix", "SELECT query_id, tag FROM v_hq JOIN v_hashtags USING (target) WHERE q <> '' AND starts_with(tag, lower(q))", TAGS)
def sug13(spark, sf):
    return suggest.hashtag_prefix(hashtag_queries(spark, sf).where("q <> ''"), hashtags(spark, sf))


@query("sug14_target_suffix", """SELECT query_id, rank, text || CASE WHEN length(query_id) % 2 = 0 THEN ' #Names' ELSE '' END AS suggestion FROM v_sug""", VOC)
def sug14(spark, sf):
    hits = sug1(spark, sf).select("query_id", "rank", F.col("text").alias("primary"), F.lit(None).cast("string").alias("secondary"))
    qs = typed(spark, sf).withColumn("target", F.when(F.length("q") % 2 == 0, "Names").otherwise("Words"))
    return suggest.with_target_suffix(hits, qs)


# The SQL engine measures edits in bytes, so it gets a one-byte letter for each accented one (terms hold lower-case letters only).
ACCENTED = "".join(map(chr, range(223, 256)))
PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456"
SIM = {"v_sq": f"SELECT query_id, translate(q, '{ACCENTED}', '{PLAIN}') AS q FROM v_query_words",
       "v_st": f"SELECT term, translate(term, '{ACCENTED}', '{PLAIN}') AS t FROM (SELECT DISTINCT term FROM v_terms)"}


@query("sug15_similar_terms", """SELECT query_id, term AS text, dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, term) AS rank FROM
    (SELECT query_id, term, levenshtein(q, t) AS dist FROM v_sq JOIN v_st ON substr(t, 1, 1) = substr(q, 1, 1)
     WHERE abs(length(t) - length(q)) <= 2 AND levenshtein(q, t) <= 2)) WHERE rank <= 16""", SIM)
def sug15(spark, sf):
    """All words of the log against all headwords."""
    v = views.terms(spark, sf).select(F.col("term").alias("item_id"), F.col("term").alias("text")).distinct()
    return suggest.similar_suggestions(views.query_words(spark, sf), v).select("query_id", "text", "dist", "rank")
