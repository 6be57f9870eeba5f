"""Query-log annotation (QRY) over the requests made from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from kotonoha import fixed
from kotonoha.catalog import sql_views as q
from kotonoha.catalog.registry import query
from kotonoha.catalog.text_queries import HAN_C, JP_C, jp_share
from kotonoha.operators import querylog
from kotonoha.sources import records, views

TAG = "#[a-zA-Z0-9\\-]+"
EXTRA = {
    "v_alias": "SELECT * FROM " + q.values([(a, n) for _, n, al in fixed.LANGUAGES for a in al]) + " AS t(alias, lang)",
    "v_tagdim": "SELECT * FROM " + q.values(querylog.tag_rows()) + " AS t(alias, kind, value)",
    "v_body": """SELECT r.*, lang AS lang_prefix, CASE WHEN lang IS NULL THEN raw_query ELSE trim(regexp_replace(raw_query, '^[^:]{0,3}:', '')) END AS body
        FROM v_raw r LEFT JOIN v_alias ON alias = trim(regexp_extract(raw_query, '^([^:]{0,3}):', 1)) AND strlen(raw_query) >= 5""",
    "v_hash": f"SELECT query_id, unnest(h) AS tag, generate_subscripts(h, 1) - 1 AS pos FROM (SELECT query_id, regexp_extract_all(body, '{TAG}') AS h FROM v_body)",
    "v_resolved": """SELECT DISTINCT query_id, pos, kind, value FROM (SELECT query_id, pos, kind, value FROM v_hash JOIN v_tagdim ON alias = lower(substr(tag, 2))
        UNION ALL SELECT query_id, pos, 'jlpt', CAST(least(greatest(TRY_CAST(regexp_extract(lower(tag), '^#(?:n|jlpt)([0-9]+)$', 1) AS BIGINT), 1), 5) AS VARCHAR) FROM v_hash
          WHERE TRY_CAST(regexp_extract(lower(tag), '^#(?:n|jlpt)([0-9]+)$', 1) AS BIGINT) BETWEEN 0 AND 255
        UNION ALL SELECT query_id, pos, 'genki', CAST(least(greatest(TRY_CAST(regexp_extract(lower(tag), '^#genki([0-9]+)$', 1) AS BIGINT), 3), 23) AS VARCHAR) FROM v_hash
          WHERE TRY_CAST(regexp_extract(lower(tag), '^#genki([0-9]+)$', 1) AS BIGINT) BETWEEN 0 AND 255)""",
    "v_plain": f"SELECT *, rtrim(regexp_replace(body, '{TAG} ?', '', 'g')) AS plain FROM v_body",
    "v_query": """SELECT *, substr(trim(regexp_replace(plain, '"([^"]+)"', '\\1', 'g')), 1, 400) AS query,
        TRY_CAST(trim(regexp_extract(body, '^seq:(\\s*[0-9]+\\s*)$', 1)) AS BIGINT) AS sequence FROM v_plain""",
    "v_bare": "SELECT *, CASE WHEN regexp_matches(query, '[*+?＊＋？]') THEN translate(query, '*+?＊＋？', '') ELSE query END AS bare FROM v_query",
    "v_qlang": f"""SELECT *, CASE WHEN bare = '' THEN 'Undetected' WHEN regexp_full_match(bare, '[가-힣ᄀ-ᇿ㄰-㆏]+') THEN 'Korean'
        WHEN {jp_share('bare')} > 40 THEN 'Japanese' WHEN {jp_share('bare')} < 40 THEN 'Foreign' ELSE 'Undetected' END AS q_lang FROM v_bare""",
    "v_tagged": "SELECT DISTINCT query_id, true AS t FROM v_resolved WHERE kind <> 'target' AND value <> 'Hidden'",
    "v_flagged": "SELECT x.*, coalesce(t, false) AS has_tag FROM v_qlang x LEFT JOIN v_tagged USING (query_id)",
    "v_form": f"""SELECT *,
        CASE WHEN sequence IS NOT NULL THEN 'Sequence' WHEN query = '' AND has_tag THEN 'TagOnly'
          WHEN length(query) >= 3 AND contains(query, ' ') AND regexp_full_match(string_split(query, ' ')[1], '[{HAN_C}]')
            AND regexp_full_match(translate(string_split(query, ' ')[2], '.- ', ''), '[{JP_C}]+') THEN 'KanjiReading'
          WHEN regexp_full_match(query, '[{JP_C}]+') THEN 'SingleWord' WHEN NOT regexp_matches(query, '[{JP_C}]') AND contains(query, ' ') THEN 'MultiWords'
          WHEN NOT regexp_matches(query, '[{JP_C}]') THEN 'SingleWord' ELSE 'Undetected' END AS form FROM v_flagged""",
}


def raw(spark, sf):
    return views.raw_queries(spark, sf)


def body(spark, sf):
    return raw(spark, sf).withColumn("body", querylog.without_language_prefix("raw_query"))


@query("qry1_language_prefix", "SELECT query_id, lang_prefix, body FROM v_body", EXTRA)
def qry1(spark, sf):
    return body(spark, sf).select("query_id", querylog.language_prefix("raw_query").alias("lang_prefix"), "body")


@query("qry2_id_prefix", "SELECT query_id, sequence FROM v_query WHERE sequence IS NOT NULL", EXTRA)
def qry2(spark, sf):
    return body(spark, sf).select("query_id", querylog.sequence_prefix("body").alias("sequence")).where("sequence is not null")


@query("qry3_hashtags", "SELECT query_id, coalesce((SELECT string_agg(tag, ' ' ORDER BY pos) FROM v_hash h WHERE h.query_id = p.query_id), '') AS tags, plain FROM v_plain p", EXTRA)
def qry3(spark, sf):
    return body(spark, sf).select("query_id", F.array_join(querylog.extract_hashtags("body"), " ").alias("tags"),
                                  querylog.without_hashtags("body").alias("plain"))


@query("qry4_tag_resolution", "SELECT query_id, pos, kind, value FROM v_resolved", EXTRA)
def qry4(spark, sf):
    tags = body(spark, sf).select("query_id", F.posexplode(querylog.extract_hashtags("body")).alias("pos", "tag"))
    return querylog.resolve_tags(tags, records.tag_dimension(spark))


@query("qry5_required_terms", """SELECT query_id, array_to_string(list_transform(regexp_extract_all(plain, '"([^"]+)"', 1), lambda t: lower(trim(t))), '|') AS required,
    regexp_replace(plain, '"([^"]+)"', '\\1', 'g') AS unquoted FROM v_plain""", EXTRA)
def qry5(spark, sf):
    b = body(spark, sf).select("query_id", querylog.without_hashtags("body").alias("plain"))
    return b.select("query_id", F.array_join(querylog.required_terms("plain"), "|").alias("required"),
                    querylog.without_quotes("plain").alias("unquoted"))


@query("qry6_query_language", "SELECT query_id, query, q_lang FROM v_form WHERE query <> '' OR has_tag", EXTRA)
def qry6(spark, sf):
    return querylog.annotate(raw(spark, sf)).select("query_id", "query", "q_lang")


@query("qry7_query_form", f"""SELECT query_id, form, CASE WHEN form = 'KanjiReading' THEN string_split(query, ' ')[1] END AS literal,
    CASE WHEN form = 'KanjiReading' THEN string_split(query, ' ')[2] END AS reading FROM v_form WHERE query <> '' OR has_tag""", EXTRA)
def qry7(spark, sf):
    return querylog.annotate(raw(spark, sf)).select("query_id", "form", "literal", "reading")


@query("qry8_wildcard_pattern", """SELECT query_id, '^' || regexp_replace(replace(regexp_replace(translate(query, '＊＋？', '*+?'), '([\\\\.\\[\\]{}()^$|])', '\\\\\\1', 'g'), '*', '.*'), '\\?|\\+', '.', 'g') || '$' AS pattern,
    translate(query, '*+?＊＋？', '') AS literals FROM v_form WHERE (query <> '' OR has_tag) AND regexp_matches(query, '[*+?＊＋？]')""", EXTRA)
def qry8(spark, sf):
    a = querylog.annotate(raw(spark, sf)).where("pattern is not null")
    return a.select("query_id", "pattern", F.array_join("literals", "").alias("literals"))


@query("qry9_target_and_page", """SELECT query_id, coalesce((SELECT arg_min(value, pos) FROM v_resolved t WHERE t.query_id = f.query_id AND kind = 'target'), target) AS target,
    greatest(page - 1, 0) * page_size AS page_offset, least(page + 99, 100) AS far_page FROM v_form f WHERE query <> '' OR has_tag""", EXTRA)
def qry9(spark, sf):
    return querylog.annotate(raw(spark, sf)).select("query_id", "target", "page_offset", querylog.add_page("page", 99).alias("far_page"))


@query("qry10_defaults", """SELECT query_id, coalesce(lang_prefix, user_lang) AS lang, show_english, CAST(page_size AS BIGINT) AS page_size FROM v_form WHERE query <> '' OR has_tag""", EXTRA)
def qry10(spark, sf):
    return querylog.annotate(raw(spark, sf)).select("query_id", "lang", "show_english", "page_size")


@query("qry11_without_other_tags", """SELECT query_id, CASE form_no WHEN 5 THEN '' WHEN 9 THEN w1 WHEN 11 THEN 'to ' || w2 || ' #sentences' ELSE raw_query END AS kept FROM v_raw""")
def qry11(spark, sf):
    return raw(spark, sf).select("query_id", querylog.without_target_tags("raw_query").alias("kept"))


@query("qry12_clean_typed", f"""SELECT item_id, CASE WHEN typed LIKE '%ｎ' AND jp THEN kana || 'ん' WHEN jp THEN kana ELSE typed END AS cleaned,
    length(trim(typed)) BETWEEN 1 AND 37 AS valid FROM (SELECT *, {jp_share('typed')} > 40 AS jp FROM (SELECT item_id, kana, kana || CASE freq % 4 WHEN 0 THEN 'ｎ' WHEN 1 THEN 'ｋ' WHEN 2 THEN 'ｓｈ' ELSE '' END AS typed
      FROM (SELECT item_id, freq, {q.hira('term')} AS kana FROM v_terms WHERE regexp_full_match(term, '[a-z]+'))))""")
def qry12(spark, sf):
    """Headwords in kana with the wide letters of an unfinished syllable behind them."""
    t = views.terms(spark, sf).where(F.col("term").rlike("^[a-z]+$"))
    kind = F.col("freq") % 4
    tail = F.when(kind == 0, "ｎ").when(kind == 1, "ｋ").when(kind == 2, "ｓｈ").otherwise("")
    t = t.select("item_id", F.concat(views.hira("term"), tail).alias("typed"))
    return t.select("item_id", querylog.clean_typed("typed").alias("cleaned"), querylog.valid_typed("typed").alias("valid"))


