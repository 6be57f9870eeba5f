"""Radicals and character structure (RAD), detail joins (DET), audits (AUD), streams (STR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kotonoha import fixed
from kotonoha.catalog import retrieval_queries as rq
from kotonoha.catalog import sql_views as q
from kotonoha.catalog.registry import query
from kotonoha.functions import text
from kotonoha.operators import audit, details, index, radicals
from kotonoha.session import cut_lineage
from kotonoha.sources import records, views
from kotonoha.streaming import feeds

# -- radicals: headwords stand for characters, their letters for parts ---------------------
RAD = {"v_rreq": """SELECT DISTINCT query_id, unnest(list_distinct(string_split(query_id, ''))) AS radical FROM v_query_words WHERE length(query_id) >= 5""",
       "v_all": """SELECT query_id, literal, stroke_count FROM (SELECT r.query_id, p.literal, p.stroke_count, count(*) AS got FROM v_parts p JOIN v_rreq r USING (radical) GROUP BY ALL)
    JOIN (SELECT query_id, count(*) AS need FROM v_rreq SEMI JOIN v_parts USING (radical) GROUP BY query_id) USING (query_id) WHERE got = need"""}


def radical_requests(spark, sf):
    w = views.query_words(spark, sf).where(F.length("query_id") >= 5)
    return w.select("query_id", F.explode(F.array_distinct(text.chars("query_id"))).alias("radical"))


def stored_letters(spark, sf):
    """The characters with their parts, stored: finding those with all radicals reads them twice."""
    return cut_lineage(views.letters(spark, sf), "letters")


def with_all(spark, sf, letters=None):
    return radicals.kanji_with_all(radical_requests(spark, sf), stored_letters(spark, sf) if letters is None else letters)


@query("rad1_characters_by_radicals", "SELECT query_id, literal, CAST(stroke_count AS BIGINT) AS stroke_count FROM v_all", RAD)
def rad1(spark, sf):
    return with_all(spark, sf)




@query("rad2_possible_radicals", """SELECT query_id, strpos('abcdefghijklmnopqrstuvwxyz', radical) % 7 + 1 AS strokes, string_agg(DISTINCT radical, '' ORDER BY radical) AS radicals
    FROM v_all JOIN v_parts USING (literal) GROUP BY ALL""", RAD)
def rad2(spark, sf):
    strokes = spark.createDataFrame([(c, (i + 1) % 7 + 1) for i, c in enumerate(views.LETTERS)], "literal string, stroke_count int")
    letters = cut_lineage(radicals.one_per_parts(views.letters(spark, sf)), "letter-sets")
    out = radicals.possible_radicals(with_all(spark, sf, letters), index.part_postings(letters), strokes)
    return out.withColumn("radicals", F.array_join("radicals", ""))


@query("rad2_characters_by_strokes", """SELECT query_id, CAST(stroke_count AS BIGINT) AS strokes, literal, row_number() OVER (PARTITION BY query_id, stroke_count ORDER BY literal) AS pos FROM v_all""", RAD)
def rad2_groups(spark, sf):
    return radicals.by_strokes(with_all(spark, sf))


RADM = {"v_rm_q": """SELECT query_id, CASE WHEN length(query_id) >= 7 THEN q ELSE query_id END AS q FROM v_query_words WHERE regexp_full_match(query_id, '[a-z]+')""",
        "v_rm_exact": "SELECT query_id, q AS term, 0 AS dist FROM v_rm_q SEMI JOIN v_radicals ON term = q",
        "v_rm_near": """SELECT query_id, term, dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, term) AS n FROM
       (SELECT query_id, term, levenshtein(q, term) AS dist FROM (SELECT * FROM v_rm_q ANTI JOIN v_radicals ON term = q), (SELECT DISTINCT term FROM v_radicals)
        WHERE abs(length(term) - length(q)) <= 2 AND levenshtein(q, term) <= 2)) WHERE n <= 3""",
        "v_rm": """SELECT query_id, literal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, term, literal) AS n FROM
       (SELECT query_id, literal, arg_min(term, (dist, term)) AS term, min(dist) AS dist FROM (SELECT * FROM v_rm_exact UNION ALL SELECT * FROM v_rm_near) JOIN v_radicals USING (term) GROUP BY ALL)) WHERE n <= 5"""}


def meaning_queries(spark, sf):
    w = views.query_words(spark, sf).where(F.col("query_id").rlike("^[a-z]+$"))
    return w.select("query_id", F.when(F.length("query_id") >= 7, F.col("q")).otherwise(F.col("query_id")).alias("q"))


@query("rad3_radicals_by_meaning", "SELECT query_id, literal FROM v_rm", RADM)
def rad3(spark, sf):
    return radicals.radicals_by_meaning(meaning_queries(spark, sf), views.radicals(spark, sf))


WORDRAD = {"v_best": f"""SELECT query_id, item_id, term, rank FROM (SELECT query_id, item_id, term, row_number() OVER (PARTITION BY query_id ORDER BY round({rq.DICE}, 6) DESC, item_id) AS rank
       FROM v_cand JOIN v_terms USING (item_id) WHERE {rq.DICE} >= 0.5) WHERE rank <= 3""",
           "v_wr": f"""SELECT query_id, radical FROM (SELECT query_id, radical, row_number() OVER (PARTITION BY query_id ORDER BY a, radical) AS n FROM
       (SELECT query_id, radical, min((rank, pos, i)) AS a FROM (SELECT query_id, rank, unnest(cs) AS literal, generate_subscripts(cs, 1) - 1 AS pos FROM
          (SELECT query_id, rank, {q.chars(q.han('term'))} AS cs FROM v_best)) JOIN
        (SELECT literal, literal AS radical, 0 AS i FROM v_kanji UNION ALL SELECT literal, nxt, 1 FROM v_kanji) USING (literal) GROUP BY ALL)) WHERE n <= 10"""}


def word_hits(spark, sf, headwords):
    """Best headwords of the misspelt words, written in ideographs."""
    from kotonoha.operators import score
    t = headwords.select("item_id", views.han("term").alias("reading"))
    c = rq.candidates(spark, sf, 0.5, headwords).where(score.dice() >= 0.5)
    return c.select("query_id", "item_id", F.round(score.dice(), 6).alias("relevance")).join(t, "item_id")


@query("rad4_radicals_of_words", "SELECT query_id, radical FROM v_wr", WORDRAD)
def rad4(spark, sf):
    t = views.stored_terms(spark, sf)
    return radicals.radicals_of_words(word_hits(spark, sf, t), views.kanji(spark, sf, t).select("literal", "parts"))


@query("rad5_radical_search", f"""SELECT DISTINCT query_id, radical FROM (
    SELECT query_id, radical FROM v_wr SEMI JOIN (SELECT query_id FROM v_rm_q WHERE length(query_id) >= 2 AND query_id NOT IN (SELECT query_id FROM v_rm GROUP BY query_id HAVING count(*) > 4)) USING (query_id)
    UNION ALL SELECT query_id, literal FROM v_rm SEMI JOIN (SELECT query_id FROM v_rm_q WHERE strlen(q) >= 2) USING (query_id)
    UNION ALL SELECT 'han:' || query_id, r FROM (SELECT query_id, unnest(string_split({q.han('query_id')}, '')) AS literal FROM v_rm_q) JOIN
      (SELECT literal, unnest([literal, nxt]) AS r FROM v_kanji) USING (literal))""", {**RADM, **WORDRAD})
def rad5(spark, sf):
    m = meaning_queries(spark, sf)
    qs = m.unionByName(m.select(F.concat(F.lit("han:"), F.col("query_id")).alias("query_id"), views.han("query_id").alias("q")))
    t = views.stored_terms(spark, sf)
    hits = cut_lineage(word_hits(spark, sf, t), "word-hits")  # two kinds of queries look them up
    return radicals.radical_search(qs, views.kanji(spark, sf, t).select("literal", "parts"), cut_lineage(views.radicals(spark, sf, t), "radicals"), hits, hits)


RAD6 = {"v_low": """SELECT radical AS part, literal AS other, stroke_count AS os, k FROM (SELECT *, row_number() OVER (PARTITION BY radical ORDER BY stroke_count, literal) AS k FROM v_parts) WHERE k <= 10""",
        "v_pp": "SELECT literal, stroke_count, unnest(parts) AS part, strpos(literal, unnest(parts)) AS part_pos FROM v_letters",
        "v_req6": "SELECT query_id, query_id AS literal, 0 AS pos FROM v_query_words WHERE regexp_full_match(query_id, '[a-z]+')"}


@query("rad6_similar_characters", """SELECT query_id, rank, literal FROM (SELECT query_id, found AS literal, row_number() OVER (PARTITION BY query_id ORDER BY a, found) AS rank FROM
    (SELECT query_id, found, min(a) AS a FROM (SELECT query_id, literal AS found, (pos, -1, 0) AS a FROM v_req6 SEMI JOIN v_letters USING (literal)
      UNION ALL SELECT query_id, other, (pos, CAST(part_pos AS INT), CAST(k AS INT)) FROM v_req6 JOIN v_pp USING (literal) JOIN v_low USING (part) WHERE os >= stroke_count) GROUP BY ALL)) WHERE rank <= 50""", RAD6)
def rad6(spark, sf):
    w = views.query_words(spark, sf).where(F.col("query_id").rlike("^[a-z]+$")).select(
        "query_id", F.lit(0).alias("pos"), F.col("query_id").alias("literal"))
    return radicals.similar_kanji(w, views.letters(spark, sf))


@query("rad7_radicals_by_strokes", """SELECT query_id, CAST(stroke_count AS BIGINT) AS strokes, string_agg(DISTINCT radical, '' ORDER BY radical) AS radicals FROM v_wr JOIN v_rad_dim ON literal = radical GROUP BY ALL""", WORDRAD)
def rad7(spark, sf):
    t = views.stored_terms(spark, sf)
    r = radicals.radicals_of_words(word_hits(spark, sf, t), views.kanji(spark, sf, t).select("literal", "parts"))
    return radicals.group_by_strokes(r, records.radical_dimension(spark)).withColumn("radicals", F.array_join("radicals", ""))


TREE = """, v_edge AS MATERIALIZED (SELECT parent, child, min(pos) AS pos FROM v_ids SEMI JOIN (SELECT DISTINCT parent AS child FROM v_ids) USING (child) WHERE parent <> child GROUP BY ALL),
    tree AS (SELECT parent AS root, 0 AS depth, '' AS path, parent AS literal, [parent] AS seen FROM (SELECT DISTINCT parent FROM v_ids)
      UNION ALL SELECT root, depth + 1, CASE WHEN path = '' THEN '' ELSE path || '.' END || pos, child, list_append(seen, child) FROM tree JOIN v_edge ON literal = parent
      WHERE NOT list_contains(seen, child))"""
SHORT_TREE = TREE.replace("tree AS (", "short AS (").replace("FROM tree JOIN", "FROM short JOIN").replace(
    "WHERE NOT list_contains(seen, child))", "WHERE NOT list_contains(seen, child) AND length(literal) > 4)").split("GROUP BY ALL),")[1]


@query("rad8_decomposition_trees", None)
def rad8(spark, sf):
    e = cut_lineage(radicals.preferred_edges(views.ids_edges(spark, sf)), "edges")
    return radicals.decompose(e.select(F.col("parent").alias("root")).distinct(), e)


@query("rad8_decomposition_differs", None)
def rad8_differs(spark, sf):
    e = cut_lineage(radicals.preferred_edges(views.ids_edges(spark, sf)), "edges")
    roots = e.select(F.col("parent").alias("root")).distinct()
    # entries of up to four letters are not opened in the short view
    open_edges = e.where(F.length("parent") > 4).unionByName(
        e.where(F.length("parent") <= 4).select("parent", "pos", F.col("parent").alias("child")))
    return radicals.has_other_view(radicals.decompose(roots, e), radicals.decompose(roots, open_edges))


def _register_tree_sql():
    from kotonoha.catalog.registry import ORACLE
    base = q.with_views("SELECT * FROM v_ids").replace("WITH ", "WITH RECURSIVE ", 1).rsplit("\n", 1)[0]
    ORACLE["rad8_decomposition_trees"] = base + TREE + " SELECT root, CAST(depth AS BIGINT) AS depth, path, literal FROM tree"
    ORACLE["rad8_decomposition_differs"] = (
        base + TREE + "," + SHORT_TREE + " SELECT root, f <> s AS differs FROM (SELECT root, count(*) AS f FROM tree GROUP BY root) "
        "JOIN (SELECT root, count(*) AS s FROM short GROUP BY root) USING (root)")


_register_tree_sql()


@query("rad9_page_kanji", f"""SELECT query_id, pos, literal FROM (SELECT query_id, literal, row_number() OVER (PARTITION BY query_id ORDER BY a) AS pos FROM
    (SELECT query_id, literal, min((rank, i)) AS a FROM (SELECT query_id, rank, unnest(cs) AS literal, generate_subscripts(cs, 1) - 1 AS i FROM (SELECT query_id, rank, {q.chars(q.han('term'))} AS cs FROM v_best))
     SEMI JOIN v_kanji USING (literal) GROUP BY ALL)) WHERE pos <= 10""", WORDRAD)
def rad9(spark, sf):
    from kotonoha.operators import collect
    t = views.stored_terms(spark, sf)
    hits = word_hits(spark, sf, t).withColumn("producer", F.lit(0))
    page = collect.top_k(hits, 3, [F.col("relevance").desc(), F.col("item_id")])
    return radicals.page_kanji(page, views.kanji(spark, sf, t))


# -- details ----------------------------------------------------------------------------------
@query("det1_word_details", """SELECT w.sequence, p_size & 1 = 1 OR p_size & 2 = 2 AS has_sentence, (SELECT string_agg(c, '' ORDER BY i) FROM
      (SELECT unnest(string_split(main, '')) AS c, generate_subscripts(string_split(main, ''), 1) AS i) WHERE c IN (SELECT literal FROM v_kanji)) AS kanji,
    CASE WHEN has_coll THEN nullif(concat_ws(',', (SELECT main FROM v_words x WHERE x.sequence = w.sequence + 1), (SELECT main FROM v_words x WHERE x.sequence = w.sequence + 2)), '') END AS collocations,
    CASE WHEN transive_version IS NOT NULL THEN 'Transitive' WHEN intransive_version IS NOT NULL THEN 'Intransitive' END AS kind,
    coalesce(transive_version, intransive_version) AS partner FROM v_words w""")
def det1(spark, sf):
    d = details.word_details(views.words(spark, sf), views.kanji(spark, sf), F.lit("German"), F.lit(True))
    return d.withColumn("collocations", F.array_join("collocations", ","))


@query("det2_sentence_kanji", f"""SELECT id, count(*) AS n, count(DISTINCT literal) AS different FROM (SELECT doc_id AS id, unnest(string_split({q.han('lower(text)')}, '')) AS literal FROM documents)
    SEMI JOIN v_kanji USING (literal) GROUP BY id""")
def det2_kanji(spark, sf):
    s = views.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), views.han(F.lower("text")).alias("japanese"))
    return details.sentence_kanji(s, views.kanji(spark, sf)).groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("literal").alias("different"))


@query("det2_best_word_per_part", f"""SELECT p.query_id AS conv_id, p.turn, p.pos, p.part, term FROM
    (SELECT conv_id AS query_id, turn, unnest(t) AS part, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT conv_id, turn, {q.tokens('text')} AS t FROM conversations)) p
    JOIN (SELECT DISTINCT term FROM v_terms) ON term = part""")
def det2_words(spark, sf):
    """Every distinct word of the conversation turns, looked up at 0.8.

    A word not written exactly so is scaled by 0.7 in the native score, so only
    exact headwords can reach 0.8 and the look-up is an equi-join."""
    turns = views.table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(text.letter_terms("text")).alias("pos", "part"))
    asked = turns.select(F.col("part").alias("query_id"), F.col("part").alias("q")).distinct()
    t = views.terms(spark, sf).groupBy("term").agg(F.max("freq").alias("freq"))
    exact = asked.join(t, F.col("q") == F.col("term")).select("query_id", F.col("term").alias("item_id"), F.lit(1.0).alias("relevance"))
    best = details.best_word_per_part(exact)
    return turns.join(best, turns.part == best.query_id).select("conv_id", "turn", "pos", "part", F.col("item_id").alias("term"))


@query("det3_kanji_compounds", """SELECT literal, kind, pos, sequence, main AS jp, kana, glosses, idx % 2 = 1 AS has_decomposition FROM
    (SELECT literal, idx, 'on' AS kind, unnest(on_dicts) AS sequence, unnest([0, 1])::BIGINT AS pos FROM v_kanji UNION ALL SELECT literal, idx, 'kun', unnest(kun_dicts), unnest([0, 1])::BIGINT FROM v_kanji)
    JOIN v_words USING (sequence) JOIN (SELECT sequence, array_to_string(list(array_to_string(glosses, '; ') ORDER BY sense_id), ' / ') AS glosses FROM v_senses
      WHERE language IN ('French', 'English') GROUP BY sequence) USING (sequence)""")
def det3(spark, sf):
    k = views.kanji(spark, sf)
    done = k.where(F.col("radical.id") % 2 == 1).select("literal")
    c = details.kanji_compounds(k, views.words(spark, sf), F.lit("French"), F.lit(True), done)
    return c.withColumn("glosses", F.array_join("glosses", " / "))


@query("det4_query_compounds", f"""SELECT query_id, count(*) AS compounds, count(DISTINCT sequence) AS words FROM (SELECT query_id, unnest(string_split({q.han('query_id')}, '')) AS literal FROM v_query_words)
    JOIN (SELECT literal, unnest(on_dicts || kun_dicts) AS sequence FROM v_kanji) USING (literal) SEMI JOIN v_words USING (sequence) GROUP BY query_id""")
def det4(spark, sf):
    qs = views.query_words(spark, sf).select("query_id", views.han("query_id").alias("q"))
    c = details.query_compounds(qs, views.kanji(spark, sf), views.words(spark, sf), F.lit("English"), F.lit(True))
    return c.groupBy("query_id").agg(F.count(F.lit(1)).alias("compounds"), F.countDistinct("sequence").alias("words"))


@query("det5_example_sentences", """SELECT s.sequence, s.sense_id, t.id, t.translation FROM v_senses s JOIN
    (SELECT id, coalesce(max(text) FILTER (language = 'German'), max(text) FILTER (language = 'English')) AS translation FROM v_translations GROUP BY id) t
    ON t.id = s.example_sentence WHERE translation IS NOT NULL""")
def det5(spark, sf):
    return details.example_sentences(views.words(spark, sf), views.sentences(spark, sf), F.lit("German")).drop("furigana")


@query("det6_word_info", """SELECT sequence, main AS reading, common, string_agg(pos_simple, ',' ORDER BY pos_simple) AS pos FROM v_words LEFT JOIN v_word_pos USING (sequence)
    SEMI JOIN (SELECT DISTINCT l_partkey AS sequence FROM lineitem) USING (sequence) GROUP BY ALL""")
def det6(spark, sf):
    ids = views.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("sequence"))
    out = details.word_info(ids, views.words(spark, sf), records.pos_dimension(spark))
    return out.withColumn("pos", F.array_join("pos", ","))


@query("det7_news", """SELECT user_id AS query_id, n.id, title FROM (SELECT user_id, max(ts) AS after FROM events GROUP BY user_id) JOIN
      (SELECT * FROM v_news ORDER BY creation_time DESC, id DESC LIMIT 3) n ON creation_time > after
    UNION ALL SELECT -1, id, title FROM v_news""")
def det7(spark, sf):
    """Which of the newest three entries every user has not seen; and all by id."""
    e = views.table(spark, sf, "events")
    n = views.news(spark, sf)
    req = e.groupBy(F.col("user_id").alias("query_id")).agg(F.max("ts").alias("after"))
    fresh = details.news_after(req, n).select("query_id", "id", "title")
    by_id = details.news_by_id(e.select(F.col("event_id").alias("id")), n).select(F.lit(-1).cast("bigint").alias("query_id"), "id", "title")
    return fresh.unionByName(by_id)


# -- audits -----------------------------------------------------------------------------------------
@query("aud1_dangling_index_items", """SELECT 'labels' AS "check", CAST(doc_id AS VARCHAR) AS item_id, 'no record' AS problem FROM
      (SELECT doc_id FROM labels UNION ALL SELECT doc_id + 1000000000 FROM labels WHERE toxic = 1) ANTI JOIN documents USING (doc_id)
    UNION ALL SELECT 'collocations', CAST(o AS VARCHAR), 'no record' FROM (SELECT DISTINCT unnest([sequence + 1, sequence + 2]) AS o FROM v_words WHERE has_coll) ANTI JOIN v_words ON o = sequence
    UNION ALL SELECT 'line items', CAST(l_partkey AS VARCHAR), 'no record' FROM (SELECT DISTINCT l_partkey FROM lineitem) ANTI JOIN part ON p_partkey = l_partkey""")
def aud1(spark, sf):
    """Index items against records, with dangling ids injected."""
    labels, docs = views.table(spark, sf, "labels"), views.table(spark, sf, "documents")
    bad = labels.select("doc_id").unionByName(labels.where("toxic = 1").select((F.col("doc_id") + 1000000000).alias("doc_id")))
    w = views.words(spark, sf)
    coll = w.select(F.explode("collocations").alias("other"))
    li = views.table(spark, sf, "lineitem").select("l_partkey")
    return audit.audit_indexes([("labels", bad, docs, "doc_id", "doc_id"), ("collocations", coll, w, "other", "sequence"),
                                ("line items", li, views.table(spark, sf, "part"), "l_partkey", "p_partkey")])


@query("aud1_index_checks", """SELECT 'none' AS "check", CAST(0 AS BIGINT) AS violations WHERE 1 = 0""")
def aud1_indexes(spark, sf):
    """The real indexes have no dangling item."""
    t = views.stored_terms(spark, sf)
    w, n = views.words(spark, sf), views.names(spark, sf)
    vec = index.term_vectors(views.doc_terms(spark, sf))
    gram = views.gram_postings(spark, sf, t)
    checks = [("native words", gram, t, "item_id", "item_id"), ("wildcards", index.char_postings(t, "item_id", "term"), t, "item_id", "item_id"),
              ("sentences", vec, views.table(spark, sf, "documents"), "doc_id", "doc_id"),
              ("glosses", index.gloss_terms(w), w, "doc_id", "sequence"),
              ("names", index.ngram_postings(n, "sequence", "kana"), n, "item_id", "sequence"),
              ("transcriptions", index.ngram_postings(n, "sequence", "transcription"), n, "item_id", "sequence")]
    return audit.violations(audit.audit_indexes(checks))


@query("aud2_features", """SELECT feature, feature IN ('Words', 'Sentences', 'Names', 'Kanji', 'RadicalKanjiMap') AS required FROM
    (SELECT unnest(['RadicalData', 'GenkiTags', 'KanjiDecompositions']) AS feature) WHERE (SELECT count(*) FROM v_words) > 0""")
def aud2(spark, sf):
    f = audit.features(views.words(spark, sf), views.kanji(spark, sf), views.names(spark, sf), views.sentences(spark, sf))
    return audit.missing_features(f)


@query("aud3_languages", f"""SELECT CAST(lang_id AS BIGINT) AS lang_id, lang FROM v_lang_dim ANTI JOIN (SELECT DISTINCT {q.case_map('lang', views.LANG_NAMES)} AS lang FROM v_terms) USING (lang)""")
def aud3(spark, sf):
    langs = views.terms(spark, sf).select(F.try_element_at(views._map(views.LANG_NAMES), F.col("lang")).alias("lang"))
    return audit.missing_languages(langs, records.languages(spark))


RULES_SQL = {"v_rules": "SELECT * FROM " + q.values([(k, x) for k, v in fixed.RULES.items() for x in (v or [None])]) + " AS t(rule, target)"}


@query("aud4_rule_closure", """SELECT rule, target, n FROM (SELECT rule, target FROM v_rules WHERE target IS NOT NULL AND target NOT IN (SELECT rule FROM v_rules)
      UNION ALL SELECT 'observed', 'none' ) JOIN (SELECT count(DISTINCT lexeme) AS n FROM v_morphemes) ON true""", RULES_SQL)
def aud4(spark, sf):
    """Open right-hand sides (none), beside the number of lexemes the data shows."""
    rules = audit.open_rules(audit.rule_table(spark))
    marker = spark.createDataFrame([("observed", "none")], "rule string, target string")
    n = views.morphemes(spark, sf).agg(F.countDistinct("lexeme").alias("n"))
    return rules.unionByName(marker).crossJoin(F.broadcast(n))


# -- streams ------------------------------------------------------------------------------------------
@query("str1_news_stream", "SELECT id, title, short FROM v_news ORDER BY creation_time DESC, id DESC LIMIT 15")
def str1(spark, sf):
    """Follow the event files; keep the newest fifteen sign-ups as news."""
    schema = views.table(spark, sf, "events").schema
    stream = feeds.stream_files(spark, sf, schema, "events.parquet").where("event_type = 'signup'")
    body = F.concat(F.lit("# "), F.col("props"), F.lit("\nuser "), F.col("user_id").cast("string"), F.lit("\n"),
                    F.repeat(F.lit("value "), 20), F.lit("\nthird\nfourth"))
    entries = records.news_table(stream.select(
        F.col("event_id").alias("id"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("title"),
        body.alias("long"), F.col("ts").alias("creation_time")))
    path = feeds.keep_news(entries)
    return feeds.latest_state(spark, path).select("id", "title", "short")


@query("str2_term_stream", "SELECT term, count(*) AS freq FROM v_tok GROUP BY term")
def str2(spark, sf):
    schema = views.table(spark, sf, "documents").schema
    stream = feeds.stream_files(spark, sf, schema, "documents.parquet")
    path = feeds.run_to_table(feeds.count_terms(stream), "complete")
    return feeds.latest_state(spark, path).select("term", "freq")


