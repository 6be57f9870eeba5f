"""Scores (SCO), collecting (COL) and whole searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotonoha.catalog import retrieval_queries as rq
from kotonoha.catalog import sql_views as q
from kotonoha.catalog.index_queries import GFREQ, KOBS, aligned_words, reading_observations
from kotonoha.catalog.registry import query
from kotonoha.functions import text
from kotonoha.operators import collect, filters, index, querylog, reshape, retrieve, score, segment
from kotonoha.plans import native, search
from kotonoha.plans.scaling import grown, measured_join
from kotonoha.session import cut_lineage
from kotonoha.sources import records, views

DICE = rq.DICE


def term_lexicon(spark, sf):
    """The headwords as native readings."""
    t = views.stored_terms(spark, sf)
    info = t.select("item_id", F.col("term").alias("kana"), F.col("term").alias("main"),
                    (F.col("freq") % 2 == 0).alias("has_jlpt"), (F.col("freq") % 3 == 0).alias("common"))
    return native.native_lexicon(t.select("item_id", F.col("term").alias("reading")), info)


@query("ngram_topk", f"""SELECT query_id, item_id, CAST(overlap AS BIGINT) AS overlap, relevance, rank FROM (SELECT query_id, item_id, overlap, round({DICE}, 6) AS relevance,
      row_number() OVER (PARTITION BY query_id ORDER BY round({DICE}, 6) DESC, item_id) AS rank FROM v_cand WHERE {DICE} >= 0.3) WHERE rank <= 10""")
def ngram_topk(spark, sf):
    hits = rq.candidates(spark, sf, 0.3).withColumn("relevance", F.round(score.dice(), 6)).where(score.dice() >= 0.3)
    top = collect.top_k(hits, 10, [F.col("relevance").desc(), F.col("item_id")])
    return top.select("query_id", "item_id", "overlap", "relevance", "rank")


@query("sco1_dice", f"""SELECT query_id, item_id, round({DICE}, 6) AS dice, round(overlap / (0.1 * n_grams + 0.9 * q_grams), 6) AS weighted
    FROM v_cand WHERE {DICE} >= 0.5""")
def sco1(spark, sf):
    c = rq.candidates(spark, sf, 0.5).where(score.dice() >= 0.5)
    return c.select("query_id", "item_id", score.dice().alias("dice"), score.dice_weighted(0.1).alias("weighted"))


VEC = {**GFREQ, "v_w": "SELECT gram, log2(total / freq) AS w FROM v_gfreq, (SELECT sum(freq) AS total FROM v_gfreq)",
       "v_oov": "SELECT log2(sum(freq)) AS w1 FROM v_gfreq",
       "v_isum": "SELECT item_id, sum(w) AS s FROM v_vgrams JOIN v_w USING (gram) GROUP BY item_id",
       "v_qsum": "SELECT query_id, sum(coalesce(w, w1)) AS s FROM v_vqgrams LEFT JOIN v_w USING (gram), v_oov GROUP BY query_id",
       "v_shared": f"""SELECT g.query_id, g.item_id, sum(w) AS sw FROM (SELECT query_id, item_id FROM v_cand WHERE {DICE} >= 0.5) g
         JOIN v_vqgrams vq ON vq.query_id = g.query_id JOIN v_vgrams i ON i.item_id = g.item_id AND i.gram = vq.gram JOIN v_w ON v_w.gram = i.gram GROUP BY ALL"""}


@query("sco2_weighted_overlap", f"""SELECT c.query_id AS a, c.item_id AS b, round(coalesce(2 * sw / (i.s + s.s), 0), 6) AS score FROM v_cand c LEFT JOIN v_shared USING (query_id, item_id)
    JOIN v_isum i ON i.item_id = c.item_id JOIN v_qsum s ON s.query_id = c.query_id WHERE {DICE} >= 0.5""", VEC)
def sco2(spark, sf):
    pairs = rq.candidates(spark, sf, 0.5).where(score.dice() >= 0.5).select(F.col("query_id").alias("a"), F.col("item_id").alias("b"))
    t = views.terms(spark, sf)
    freq = index.ngram_frequency(t, "term")
    left = index.feature_vectors(views.query_words(spark, sf), "query_id", "q", freq)
    right = index.feature_vectors(t, "item_id", "term", freq)
    return score.term_distance(pairs, left, right)


@query("sco3_native_word_score", f"""SELECT query_id, item_id, rel AS relevance, rank FROM (SELECT query_id, item_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, item_id) AS rank FROM
    (SELECT query_id, item_id, dice, s0, s1, s2, round(s2 * CASE WHEN freq % 2 = 0 THEN 1.0 ELSE 0.999 END * CASE WHEN freq % 3 = 0 THEN 1.0 ELSE 0.999 END, 6) AS rel FROM
     (SELECT query_id, item_id, dice, s0, s1, CASE WHEN term = q THEN s1 ELSE s1 * 0.7 END AS s2, freq FROM
      (SELECT query_id, item_id, dice, s0, s0 AS s1, term, q, freq FROM
       (SELECT c.query_id, c.item_id, {DICE} AS dice, {DICE} * 2 * sw / (i.s + s.s) AS s0, t.term, qw.q, t.freq FROM v_cand c
        JOIN v_shared USING (query_id, item_id) JOIN v_isum i ON i.item_id = c.item_id JOIN v_qsum s ON s.query_id = c.query_id
        JOIN v_terms t ON t.item_id = c.item_id JOIN v_query_words qw ON qw.query_id = c.query_id WHERE {DICE} >= 0.5)))
     WHERE s1 >= 0.5 AND s2 >= 0.5)) WHERE rank <= 10""", VEC)
def sco3(spark, sf):
    qs = views.query_words(spark, sf).select("query_id", "q", F.col("q").alias("orig"), F.lit(0.5).alias("threshold"))
    hits = native.native_hits(qs, term_lexicon(spark, sf))
    hits = hits.withColumn("relevance", F.round("relevance", 6))
    return collect.top_k(hits, 10, [F.col("relevance").desc(), F.col("item_id")]).select("query_id", "item_id", "relevance", "rank")


@query("sco4_foreign_word_score", f"""SELECT query_id, item_id, round((CASE WHEN sim >= 0.5 THEN dot * 100 ELSE 0 END + sim) / 2, 4) AS relevance FROM
    (SELECT c.query_id, doc_id AS item_id, any_value(dot) AS dot, max(CASE WHEN len(qg) = 0 OR len(g) = 0 THEN 0 ELSE 2.0 * len(list_intersect(qg, g)) / (len(qg) + len(g)) END) AS sim FROM v_gcand c
      JOIN (SELECT query_id, {q.gram_set("('to ' || q)")} AS qg FROM v_gqueries) USING (query_id)
      JOIN (SELECT sequence, language, {q.gram_set("lower(trim(regexp_replace(gloss, '\\(.*\\)', '', 'g')))")} AS g FROM v_glosses) gl
        ON gl.sequence = doc_id AND gl.language IN (lang, 'English') GROUP BY ALL)""", rq.GLOSS)
def sco4(spark, sf):
    w = views.words(spark, sf)
    gloss = reshape.sense_glosses(w).select(F.col("sequence").alias("doc_id"), "language", text.gram_set(text.gloss_key("gloss")).alias("g"))
    qs = rq.gloss_queries(spark, sf).select("query_id", "lang", text.gram_set(F.lower("q")).alias("qg"))
    j = rq.gloss_candidates(spark, sf).join(grown(qs), "query_id").join(grown(gloss), "doc_id").where(
        (F.col("language") == F.col("lang")) | (F.col("language") == "English"))
    best = j.groupBy("query_id", "doc_id", "dot").agg(F.max(score.overlap_unweighted(F.col("qg"), F.col("g"))).alias("sim"))
    return best.select("query_id", F.col("doc_id").alias("item_id"), F.round(score.foreign_word_score(F.col("sim"), F.col("dot")), 4).alias("relevance"))


@query("sco5_kanji_reading_score", """SELECT query_id, item_id, CASE WHEN base = 0 THEN greatest(0, 100 - 2 * length(main)) ELSE base + 100 END::DOUBLE AS relevance FROM
    (SELECT q.literal || ' ' || q.reading AS query_id, item_id, main, CASE WHEN common THEN 100 ELSE 0 END + coalesce(jlpt_lvl * 10, 0) AS base
     FROM (SELECT DISTINCT literal, reading FROM v_krq) q JOIN v_keys k ON k.literal = q.literal AND k.r = q.reading JOIN v_words ON sequence = item_id)""", rq.KR)
def sco5(spark, sf):
    info = views.words(spark, sf).select(F.col("sequence").alias("item_id"), "common", "jlpt_lvl", reshape.main_reading().alias("main"))
    return rq.kanji_reading_hits(spark, sf).join(info, "item_id").select(
        "query_id", "item_id", score.kanji_reading_score(F.col("common"), F.col("jlpt_lvl"), F.length("main")).alias("relevance"))


WWILD = {"v_wq": f"SELECT DISTINCT {q.hira('w1')} || '*' AS query_id, {q.hira('w1')} AS pre FROM v_part UNION SELECT DISTINCT '*' || {q.han('w2')}, {q.han('w2')} FROM v_part",
         "v_whits": """SELECT query_id, sequence AS item_id, max(greatest(0, 100 + CASE WHEN kind = 'alt' THEN 0 ELSE 20 END + CASE WHEN common THEN 30 ELSE 0 END
      + CASE WHEN jlpt_lvl IS NULL THEN 0 ELSE 10 + 2 * jlpt_lvl END - 3 * length(main)))::DOUBLE AS relevance
      FROM v_wq JOIN v_readings ON (query_id LIKE '%*' AND starts_with(reading, pre)) OR (query_id LIKE '*%' AND ends_with(reading, pre)) JOIN v_words USING (sequence) GROUP BY ALL"""}


@query("sco6_wildcard_score", "SELECT query_id, item_id, relevance FROM v_whits", WWILD)
def sco6(spark, sf):
    """Beginnings in kana and endings in kanji, as wildcard queries on the words."""
    p = views.part_words(spark, sf)
    typed = p.select(F.explode(F.array(F.concat(views.hira("w1"), F.lit("*")), F.concat(F.lit("*"), views.han("w2")))).alias("query_id")).distinct()
    qs = typed.select("query_id", querylog.wildcard_pattern("query_id").alias("pattern"))
    w = views.words(spark, sf)
    r = search.word_readings(w).select("item_id", "reading")
    info = w.select(F.col("sequence").alias("item_id"), "common", "jlpt_lvl", reshape.main_reading().alias("main"),
                    F.col("reading.alternative.reading").alias("alt"))
    hit = retrieve.wildcard_candidates(qs, cut_lineage(index.wildcard_postings(r, "item_id", "reading"), "wildcards")).join(info, "item_id")
    s = score.wildcard_score(F.array_contains("alt", F.col("reading")), F.col("common"), F.col("jlpt_lvl"), F.length("main"))
    return hit.withColumn("s", s).groupBy("query_id", "item_id").agg(F.max("s").alias("relevance"))


def passage_scores(spark, sf):
    vec, terms, cand = rq.passage_candidates(spark, sf)
    nq = retrieve.query_norms(terms, vec.select("term").distinct())
    return measured_join(cand.join(grown(index.vector_norms(vec)), ["posting", "doc_id"]), nq, ["query_id"])


@query("sco7_cosine", """SELECT query_id, doc_id, round(c, 6) AS cosine, round(CASE WHEN posting = 'en' THEN c ELSE c * 0.8 END, 6) AS relevance FROM
    (SELECT query_id, doc_id, posting, CASE WHEN norm > 0 THEN dot / (norm_q * norm) ELSE 0 END AS c FROM v_pcand JOIN v_pnorm USING (query_id) JOIN v_norm USING (posting, doc_id))""", rq.PASS)
def sco7(spark, sf):
    s = passage_scores(spark, sf)
    return s.select("query_id", "doc_id", score.cosine(F.col("dot"), F.col("norm_q"), F.col("norm")).alias("cosine"),
                    score.cosine(F.col("dot"), F.col("norm_q"), F.col("norm"), F.col("posting") == "en").alias("relevance"))


@query("sco8_query_weighted_similarity", """SELECT query_id, doc_id, round(dot / ((100 * norm_q + norm) / 101) * CASE WHEN posting = 'en' THEN 1 ELSE 0.99 END, 6) AS relevance
    FROM v_pcand JOIN v_pnorm USING (query_id) JOIN v_norm USING (posting, doc_id)""", rq.PASS)
def sco8(spark, sf):
    s = passage_scores(spark, sf)
    return s.select("query_id", "doc_id", score.query_weighted_similarity(
        F.col("dot"), F.col("norm_q"), F.col("norm"), F.col("posting") == "en").alias("relevance"))


SCO9 = {**KOBS, "v_ent": """SELECT w.sequence, main, kana, common, jlpt_lvl, list(pos_simple) AS pos FROM v_words w JOIN v_word_pos USING (sequence) GROUP BY ALL"""}


@query("sco9_reading_choice", """SELECT sequence, want, round(CASE WHEN list_contains(pos, want) THEN s + 20 ELSE greatest(s - 30, 0) END + CASE WHEN common THEN 2 ELSE 0 END
      + CASE WHEN jlpt_lvl IS NOT NULL THEN 2 ELSE 0 END, 6)::DOUBLE AS relevance FROM
    (SELECT e.*, t.want, CASE WHEN main = kana THEN 100 ELSE 0 END + CASE WHEN length(main) = 1 THEN coalesce(CASE WHEN total >= 200 THEN freq / total END * 10, 0) ELSE 0 END AS s FROM v_ent e
     LEFT JOIN v_rfreq r ON r.literal = substr(e.main, 1, 1) AND r.reading = """ + q.to_kata("substr(e.kana, 1, 1)") + """, (VALUES ('Noun'), ('Verb')) AS t(want))""", SCO9)
def sco9(spark, sf):
    """Every word as noun and as verb; words of one kanji by that kanji's reading frequency."""
    rf = index.reading_frequency(reading_observations(spark, sf), views.kanji(spark, sf))
    rf = rf.select("literal", F.col("reading").alias("r"), index.normalised_reading_frequency(F.col("freq"), F.col("total")).alias("rf"))
    w = rq.words_with_pos(spark, sf).select("sequence", reshape.main_reading().alias("main"), F.col("reading.kana.reading").alias("kana"),
                                            "common", "jlpt_lvl", "word_pos", F.explode(rq.arr("Noun", "Verb")).alias("want"))
    j = w.join(rf, (F.substring("main", 1, 1) == rf.literal) & (text.to_katakana(F.substring("kana", 1, 1)) == rf.r), "left")
    s = score.reading_choice_score(F.col("main") == F.col("kana"), F.length("main") == 1, F.col("rf"), F.array_contains("word_pos", F.col("want")),
                                   F.lit(True), F.col("common"), F.col("jlpt_lvl").isNotNull())
    return j.select("sequence", "want", s.alias("relevance"))


@query("sco10_split_name_score", "SELECT query_id, item_id, round(max(relevance), 8) AS relevance FROM v_split_hits GROUP BY ALL", rq.SPLIT)
def sco10(spark, sf):
    return rq.split_name_hits(spark, sf).groupBy("query_id", "item_id").agg(F.round(F.max("relevance"), 8).alias("relevance"))


KCOUNT = {"v_kcount": "SELECT key, count(*) AS n FROM v_keys GROUP BY key", **rq.KR}


@query("sco11_kanji_reading_suggestion", f"""SELECT literal, reading, CASE WHEN starts_with({q.fold("replace(reading, '.', '')")}, typed) THEN 1000000 ELSE 0 END + coalesce(CAST(floor(ln(n) / ln(1.01)) AS BIGINT), 0) AS score FROM
    (SELECT literal, unnest(kunyomi || onyomi) AS reading, {q.fold('onyomi[1]')} AS typed FROM v_kanji) LEFT JOIN v_kcount ON key = literal || reading""", KCOUNT)
def sco11(spark, sf):
    k = views.kanji(spark, sf)
    counts = index.reading_keys(aligned_words(spark, sf), k).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    r = k.select("literal", F.explode(F.concat("kunyomi", "onyomi")).alias("reading"), text.to_hiragana(F.get("onyomi", 0)).alias("typed"))
    r = r.withColumn("key", F.concat("literal", "reading")).join(counts, "key", "left")
    folded = text.to_hiragana(F.replace(F.col("reading"), F.lit("."), F.lit("")))
    return r.select("literal", "reading", score.reading_suggestion_score(folded.startswith(F.col("typed")), F.coalesce("n", F.lit(0))).alias("score"))


# -- collecting ----------------------------------------------------------------------------------
HITS = {"v_hits": f"""SELECT query_id, item_id, round({DICE}, 6) AS relevance, 1 AS producer FROM v_cand WHERE {DICE} >= 0.4""",
        "v_exact": "SELECT query_id, item_id, 2.0::DOUBLE AS relevance, 0 AS producer FROM v_query_words JOIN v_terms ON term = query_id"}


def term_hits(spark, sf, t=0.4, headwords=None):
    c = rq.candidates(spark, sf, t, headwords).where(score.dice() >= t)
    return c.select("query_id", "item_id", F.round(score.dice(), 6).alias("relevance"), F.lit(1).alias("producer"), F.lit(0).cast("bigint").alias("seq"))


def exact_hits(spark, sf):
    t = views.terms(spark, sf).select("item_id", F.col("term").alias("query_id"))
    hit = views.query_words(spark, sf).join(t, "query_id")
    return hit.select("query_id", "item_id", F.lit(2.0).alias("relevance"), F.lit(0).alias("producer"), F.lit(0).cast("bigint").alias("seq"))


@query("col1_merge_producers", """SELECT query_id, item_id, arg_min(relevance, producer) AS relevance, CAST(min(producer) AS BIGINT) AS producer FROM
    (SELECT * FROM v_hits UNION ALL SELECT * FROM v_exact) GROUP BY query_id, item_id""", HITS)
def col1(spark, sf):
    return collect.merge_hits(term_hits(spark, sf).unionByName(exact_hits(spark, sf))).drop("seq")


CASC = {**HITS, "v_c2": f"""SELECT query_id, item_id, round({DICE}, 6) AS relevance FROM v_cand ANTI JOIN (SELECT query_id FROM v_exact GROUP BY query_id HAVING count(*) >= 2) USING (query_id) WHERE {DICE} >= 0.7""",
        "v_c12": "SELECT query_id, item_id, relevance, CAST(0 AS BIGINT) AS producer FROM v_exact UNION ALL SELECT query_id, item_id, relevance, 1 FROM v_c2 ANTI JOIN v_exact USING (query_id, item_id)",
        "v_c3": """SELECT query_id, item_id, relevance FROM v_hits ANTI JOIN (SELECT query_id FROM v_c12 GROUP BY query_id HAVING count(*) >= 5) USING (query_id)
          WHERE query_id IN (SELECT query_id FROM v_query_words WHERE length(query_id) >= 5)"""}


@query("col2_fallback_cascade", "SELECT * FROM v_c12 UNION ALL SELECT query_id, item_id, relevance, 2 FROM v_c3 ANTI JOIN v_c12 USING (query_id, item_id)", CASC)
def col2(spark, sf):
    """Exact headwords; close ones for queries with fewer than two; loose ones for
    longer queries with fewer than five."""
    t = views.stored_terms(spark, sf)
    posts = views.gram_items(spark, sf, t)

    def close(limit):
        def run(qs):
            c = retrieve.ngram_candidates(retrieve.query_grams(qs), posts, limit).where(score.dice() >= limit)
            return c.select("query_id", "item_id", F.round(score.dice(), 6).alias("relevance"), F.lit(0).cast("bigint").alias("seq"))
        return run

    def exact(qs):
        hit = qs.select("query_id").join(t.select("item_id", F.col("term").alias("query_id")), "query_id")
        return hit.select("query_id", "item_id", F.lit(2.0).alias("relevance"), F.lit(0).cast("bigint").alias("seq"))

    stages = [collect.Stage(0, exact, F.lit(True)), collect.Stage(1, close(0.7), F.lit(True), below=2),
              collect.Stage(2, close(0.4), F.length("query_id") >= 5, below=5)]
    return collect.cascade(views.query_words(spark, sf), stages).drop("seq")


@query("col4_top_k", """SELECT query_id, item_id, relevance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, producer, item_id) AS rank
    FROM v_hits) WHERE rank <= 30""", HITS)
def col4(spark, sf):
    return collect.top_k(term_hits(spark, sf), 30).select("query_id", "item_id", "relevance", "rank")


@query("col5_pages", """SELECT query_id, item_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, producer, item_id) AS rank
    FROM v_hits) WHERE rank > length(query_id) % 3 * 10 AND rank <= length(query_id) % 3 * 10 + 10""", HITS)
def col5(spark, sf):
    qs = views.query_words(spark, sf).select("query_id", querylog.page_offset(F.length("query_id") % 3 + 1, F.lit(10)).alias("page_offset"),
                                             F.lit(10).alias("page_size"))
    return collect.page(term_hits(spark, sf), qs).select("query_id", "item_id", "rank")


@query("col6_distance_cut", """SELECT query_id, item_id, relevance FROM v_hits JOIN (SELECT query_id, max(relevance) AS best FROM v_hits GROUP BY query_id) USING (query_id)
    WHERE relevance + 0.25 >= best""", HITS)
def col6(spark, sf):
    return collect.cut_by_distance(term_hits(spark, sf), 0.25).select("query_id", "item_id", "relevance")


@query("col7_totals", "SELECT query_id, count(*) AS total FROM v_hits GROUP BY query_id", HITS)
def col7(spark, sf):
    return collect.totals(term_hits(spark, sf))


GUESS = {**HITS, "v_guess": """SELECT query_id, least(n, 100) AS guess_value, CASE WHEN n > 100 THEN 'MoreThan' ELSE 'Accurate' END AS guess_type FROM
    (SELECT query_id, count(DISTINCT item_id) AS n FROM v_query_words LEFT JOIN v_hits USING (query_id) GROUP BY query_id)""",
         "v_kguess": f"""SELECT query_id, least(count(literal), 15) AS guess_value FROM (SELECT query_id, unnest(string_split({q.han('query_id')}, '')) AS c FROM v_query_words)
    LEFT JOIN v_kanji ON literal = c GROUP BY query_id""",
         "v_name_hits": f"""SELECT query_id, item_id FROM (SELECT query_id, item_id, q_grams, n_grams, count(*) AS overlap FROM v_qgrams JOIN
        (SELECT item_id, unnest(g) AS gram, len(g) AS n_grams FROM (SELECT sequence AS item_id, {q.index_grams('transcription')} AS g FROM v_names)) USING (gram)
        GROUP BY ALL) WHERE overlap / (0.1 * n_grams + 0.9 * q_grams) >= 0.5""",
         "v_sentence_hits": "SELECT query_id, doc_id AS item_id FROM v_query_words JOIN v_doc_terms ON term = q WHERE lang = 'en'",
         "v_guesses": """SELECT query_id, 'Words' AS target, guess_value, guess_type FROM v_guess UNION ALL SELECT query_id, 'Kanji', guess_value, 'Accurate' FROM v_kguess
    UNION ALL SELECT query_id, target, least(n, 100), CASE WHEN n > 100 THEN 'MoreThan' ELSE 'Accurate' END FROM
      (SELECT query_id, 'Names' AS target, count(DISTINCT item_id) AS n FROM v_query_words LEFT JOIN v_name_hits USING (query_id) GROUP BY query_id UNION ALL
       SELECT query_id, 'Sentences', count(DISTINCT item_id) FROM v_query_words LEFT JOIN v_sentence_hits USING (query_id) GROUP BY query_id)"""}


def guesses(spark, sf, headwords):
    """query_id, target, guess_value, guess_type: each word of the log in all four targets, its
    sentences by their English terms and its names by their transcriptions."""
    qs = views.query_words(spark, sf)
    names = retrieve.ngram_candidates(retrieve.query_grams(qs), index.ngram_items(views.names(spark, sf), "sequence", "transcription"))
    names = filters.above_threshold(names.withColumn("relevance", score.dice_weighted(score.NAME_DICE_WEIGHT)), score.NAME_THRESHOLD_FOREIGN)
    english = views.doc_terms(spark, sf).where("lang = 'en'")
    of = {"Words": collect.guess(qs, term_hits(spark, sf, headwords=headwords)),
          "Kanji": collect.kanji_guess(qs.select("query_id", views.han("query_id").alias("q")), views.kanji(spark, sf, headwords)),
          "Names": collect.guess(qs, names),
          "Sentences": collect.term_guess(qs, qs.select("query_id", F.col("q").alias("term")), english)}
    return reduce(DataFrame.unionByName, [g.select("query_id", F.lit(t).alias("target"), "guess_value", "guess_type") for t, g in of.items()])


@query("col8_count_guess", "SELECT query_id, target, guess_value, guess_type FROM v_guesses", GUESS)
def col8(spark, sf):
    return guesses(spark, sf, views.stored_terms(spark, sf))


@query("col9_formatted_guess", "SELECT query_id, CASE WHEN guess_type = 'MoreThan' THEN '>' ELSE '' END || guess_value AS label FROM v_guess", GUESS)
def col9(spark, sf):
    return collect.guess(views.query_words(spark, sf), term_hits(spark, sf)).select("query_id", collect.format_guess().alias("label"))


@query("col10_help_for_empty", """SELECT query_id, target, guess_value, guess_type FROM v_guesses WHERE guess_value > 0 AND target <> 'Words'
    AND query_id IN (SELECT query_id FROM v_query_words ANTI JOIN (SELECT query_id FROM v_hits WHERE relevance >= 0.8) USING (query_id))""", GUESS)
def col10(spark, sf):
    """Queries without a word of 0.8 get the guesses of the other three targets."""
    qs = views.query_words(spark, sf).withColumn("target", F.lit("Words"))
    t = views.stored_terms(spark, sf)
    return collect.help_for_empty(qs, collect.totals(term_hits(spark, sf, 0.8, t)), guesses(spark, sf, t).where("target <> 'Words'"))


@query("col11_pagination", """SELECT query_id, total, pages, current, array_to_string(CASE WHEN last = 0 THEN [] ELSE range(greatest(1, c1 - (h + (h - least(last - c1, h)))),
      least(greatest(1, c1 - (h + (h - least(last - c1, h)))) + least(5, last), last + 1)) END, ',') AS buttons FROM
    (SELECT *, CAST(floor(least(5, last) / 2) AS BIGINT) AS h, greatest(current, 1) AS c1 FROM (SELECT query_id, total, last, CASE WHEN total > 0 THEN greatest(last, 1) ELSE 0 END AS pages,
      CASE WHEN total > 0 THEN least(greatest(page, 1), greatest(last, 1)) ELSE 0 END AS current FROM
     (SELECT query_id, coalesce(total, 0) AS total, length(query_id) % 12 AS page, least(CAST(ceil(coalesce(total, 0) / 10) AS BIGINT), 100) AS last FROM v_query_words
      LEFT JOIN (SELECT query_id, count(*) AS total FROM v_hits GROUP BY query_id) USING (query_id))))""", HITS)
def col11(spark, sf):
    qs = views.query_words(spark, sf).select("query_id", (F.length("query_id") % 12).alias("page"), F.lit(10).alias("page_size"))
    p = collect.paginate(collect.totals(term_hits(spark, sf)), qs)
    return p.withColumn("buttons", F.array_join(F.col("buttons").cast("array<string>"), ","))


@query("col12_kanji_order", "SELECT literal, row_number() OVER (ORDER BY grade IS NULL, frequency IS NULL, jlpt IS NULL, literal) AS pos FROM v_kanji")
def col12(spark, sf):
    from pyspark.sql.window import Window
    k = views.kanji(spark, sf)  # at most 26 rows
    return k.select("literal", F.row_number().over(Window.orderBy(*collect.kanji_order())).alias("pos"))


def annotated(spark, sf):
    """The annotated query log, stored: every stage of a search reads it."""
    return cut_lineage(querylog.annotate(views.raw_queries(spark, sf)), "annotated")


@query("col13_summary", """SELECT query_id, raw_query, form_no = 9 AS hidden, coalesce(total, 0) AS total FROM v_raw LEFT JOIN
    (SELECT query_id, count(*) AS total FROM v_raw JOIN v_words ON form_no = 4 AND user_id = sequence GROUP BY ALL) USING (query_id)""")
def col13(spark, sf):
    qs = annotated(spark, sf)
    ids = qs.where(F.col("form") == "Sequence").select("query_id", F.col("sequence").alias("seq"))
    hits = retrieve.by_id(ids, views.words(spark, sf), "sequence").select("query_id", F.col("sequence").alias("item_id"))
    return collect.summary(qs, collect.totals(hits))


# -- whole searches over the query log (no SQL: nine gated producers) -----------------------
def word_index(spark, sf):
    return search.build_word_index(views.words(spark, sf), views.kanji(spark, sf), records.pos_dimension(spark), aligned_words(spark, sf))


def log_parts(queries):
    """One morpheme per script run of a Japanese query: its words for the reader."""
    jp = queries.where("q_lang = 'Japanese' and query <> ''").select("query_id", F.posexplode(text.alphabet_runs("query")).alias("pos", "surface"))
    m = jp.select(F.col("query_id").alias("text_id"), F.col("pos").cast("bigint").alias("pos"), "surface", F.col("surface").alias("lexeme"),
                  F.col("surface").alias("reading"), F.when(text.has_kanji("surface"), "Verb").otherwise("Noun").alias("word_class"))
    return cut_lineage(segment.parts_of_texts(m), "parts")


@query("col3_word_search")
def col3_words(spark, sf):
    qs = annotated(spark, sf)
    one, mapping = search.distinct_queries(qs)
    hits = search.search_words(one, word_index(spark, sf), log_parts(one), search.deepest_page(qs))
    return search.result_pages(hits, mapping, qs)


@query("col3_name_search")
def col3_names(spark, sf):
    qs = annotated(spark, sf)
    one, mapping = search.distinct_queries(qs)
    idx = search.build_name_index(views.names(spark, sf), views.kanji(spark, sf))
    return search.result_pages(search.search_names(one, idx, log_parts(one), search.deepest_page(qs)), mapping, qs)


@query("col3_sentence_search")
def col3_sentences(spark, sf):
    qs = annotated(spark, sf)
    one, mapping = search.distinct_queries(qs)
    s = views.sentences(spark, sf)
    native_terms = views.doc_tokens(spark, sf).select("doc_id", views.hira("term").alias("term")).groupBy("doc_id", "term").agg(
        F.count(F.lit(1)).alias("tf"))
    idx = search.build_sentence_index(s, native_terms)
    return search.result_pages(search.search_sentences(one, idx, log_parts(one)), mapping, qs)


@query("col3_kanji_search")
def col3_kanji(spark, sf):
    qs = annotated(spark, sf)
    one, mapping = search.distinct_queries(qs)
    idx = word_index(spark, sf)
    found = search.search_kanji(one, idx.kanji, idx).withColumnRenamed("query_id", "key")
    return mapping.join(grown(found), "key").select("query_id", "pos", "literal", "total")




@query("ret14_kanji_by_kana")
def ret14(spark, sf):
    """Every kana spelling of the words, answered with the kanji written so."""
    idx = word_index(spark, sf)
    qs = views.words(spark, sf).select(F.col("reading.kana.reading").alias("q")).distinct().withColumn("query_id", F.col("q"))
    return search.kana_kanji(qs, idx, idx.kanji)
