"""The derived views of ``sources.views`` once more, as SQL text."""

from __future__ import annotations

import re

from kotonoha import fixed
from kotonoha.sources import views as v

PAD = fixed.PAD
HAN_RE = r"\p{Han}"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def han(x):
    return f"translate({x}, {lit(v.LETTERS)}, {lit(v.AS_HAN)})"


def hira(x):
    return f"translate({x}, {lit(v.LETTERS)}, {lit(v.AS_HIRA)})"


def kata(x):
    return f"translate({x}, {lit(v.LETTERS)}, {lit(v.AS_KATA)})"


def hangul(x):
    return f"translate({x}, {lit(v.LETTERS)}, {lit(v.HANGUL26)})"


def fold(x):
    return f"translate({x}, {lit(fixed.KATAKANA)}, {lit(fixed.HIRAGANA)})"


def to_kata(x):
    return f"translate({x}, {lit(fixed.HIRAGANA)}, {lit(fixed.KATAKANA)})"


def tokens(x):
    return (rf"list_filter(string_split(lower(regexp_replace({x}, '[^\p{{L}}]+', ' ', 'g')), ' '), "
            "lambda t: t <> '')")


def strip_punct(x, chars=fixed.WORD_PUNCT):
    return f"lower(translate({x}, {lit(chars)}, {lit(' ' * len(chars))}))"


def grams(x, n=3):
    """All padded n-grams of an expression, in order."""
    size = f"least({n}, length({x}))"
    padded = f"(repeat('{PAD}', {size} - 1) || {x} || repeat('{PAD}', {size} - 1))"
    return (f"CASE WHEN trim({x}) <> '' THEN list_transform(range(1, length({padded}) - {size} + 2), "
            f"lambda i: substr({padded}, i, {size})) ELSE [] END")


def gram_set(x, n=3):
    return f"list_distinct({grams(x, n)})"


def index_grams(x, n=3):
    """Distinct padded n-grams of fixed size."""
    pad = PAD * (n - 1)
    return (f"list_distinct(CASE WHEN trim({x}) <> '' THEN list_transform(range(1, length({x}) + {n}), "
            f"lambda i: substr('{pad}' || {x} || '{pad}', i, {n})) ELSE [] END)")


def chars(x):
    return f"list_filter(string_split({x}, ''), lambda c: c <> '')"


def values(rows):
    def one(x):
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "true" if x else "false"
        return lit(x) if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(one(x) for x in r) + ")" for r in rows) + ")"


def sql_list(items):
    return "[" + ", ".join(lit(i) for i in items) + "]"


def case_map(expr, mapping):
    return "CASE " + " ".join(f"WHEN {expr} = {lit(k)} THEN {lit(x)}" for k, x in mapping.items()) + " END"


VIEWS = {
    "v_tok": f"""SELECT doc_id, lang, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos
        FROM (SELECT doc_id, lang, {tokens('text')} AS toks FROM documents)""",
    "v_terms": """SELECT lang || ':' || term AS item_id, lang, term, count(*) AS freq
        FROM v_tok GROUP BY lang, term""",
    "v_doc_terms": "SELECT doc_id, lang, term, count(*) AS tf FROM v_tok GROUP BY ALL",
    "v_query_words": f"""SELECT w AS query_id, CASE WHEN length(w) >= 5 THEN substr(w, 1, 2) || substr(w, 4)
        ELSE w END AS q FROM (SELECT DISTINCT unnest({tokens('text')}) AS w FROM benchmark)""",
    "v_passages": "SELECT item_id AS query_id, text AS q FROM benchmark",
    "v_part": """SELECT p_partkey AS sequence, p_name, p_type, CAST(p_size AS BIGINT) AS p_size,
        string_split(p_name, ' ')[1] AS w1, string_split(p_name, ' ')[2] AS w2,
        CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS brand FROM part""",
    "v_words": f"""SELECT sequence, p_name, p_type, p_size, w1, w2, brand, sequence % 5 = 0 AS kata_word,
        CASE WHEN sequence % 5 = 0 THEN {kata('w1')} || {kata('w2')} ELSE {hira('w1')} || {hira('w2')} END AS kana,
        CASE WHEN sequence % 5 <> 0 THEN {han('w1')} || {hira('w2')} END AS kanji,
        CASE WHEN sequence % 5 <> 0 AND p_size % 2 = 0 THEN {han('w1')} || {han('w2')} END AS alt,
        CASE WHEN sequence % 5 <> 0 THEN '[' || {han('w1')} || '|' || {hira('w1')} || ']' || {hira('w2')} END AS furigana,
        coalesce(CASE WHEN sequence % 5 <> 0 THEN {han('w1')} || {hira('w2')} END, {kata('w1')} || {kata('w2')}) AS main,
        sequence % 3 = 0 AS common,
        CASE WHEN p_size % 7 <> 0 THEN p_size % 5 + 1 END AS jlpt_lvl,
        CASE WHEN p_size % 5 = 0 THEN sequence + 1 END AS transive_version,
        CASE WHEN p_size % 5 = 1 THEN sequence - 1 END AS intransive_version,
        p_size & 35 AS sentences_available, p_size % 7 AS accent1, brand % 7 AS accent2,
        p_size % 4 = 0 AS has_coll, [{', '.join(lit(m) for m in v.BRAND_MISC)}][brand % 8 + 1] AS misc,
        CASE {' '.join(f"WHEN p_type = {lit(k)} THEN {sql_list(c)}" for k, c in v.PART_POS.items())} END AS pos_codes
        FROM v_part""",
    "v_senses": f"""SELECT sequence, CAST(0 AS BIGINT) AS sense_id, 'English' AS language, misc,
          CASE WHEN p_size % 4 = 1 THEN 'Mathematics' END AS field,
          CASE WHEN p_size % 6 = 0 THEN {hira('w2')} || '・1' END AS xref,
          CASE WHEN p_size % 9 = 0 THEN {hira('w1')} || '・' || {hira('w2')} END AS antonym,
          CASE WHEN p_size % 4 = 0 THEN 'see ' || w2 END AS information, pos_codes AS pos,
          CASE WHEN p_size % 2 = 0 THEN sequence END AS example_sentence,
          [p_name, w2 || ' (' || lower(p_type) || ')'] AS glosses FROM v_words
        UNION ALL SELECT sequence, 1, 'German', NULL, NULL, NULL, NULL, NULL, ['n'], NULL, [w2 || ' ' || w1]
          FROM v_words WHERE p_size % 2 = 0
        UNION ALL SELECT sequence, 2, 'French', NULL, NULL, NULL, NULL, NULL, ['adv'], NULL, ['le ' || w2]
          FROM v_words WHERE p_size % 3 = 0""",
    "v_senses_pos": """SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY sense_id) - 1 AS sense_pos
        FROM v_senses""",
    "v_glosses": """SELECT sequence, sense_id, sense_pos, language, unnest(glosses) AS gloss,
        generate_subscripts(glosses, 1) - 1 AS gloss_id FROM v_senses_pos""",
    "v_readings": """SELECT sequence, 'kana' AS kind, kana AS reading, CAST(0 AS BIGINT) AS ord FROM v_words
        UNION ALL SELECT sequence, 'kanji', kanji, 1 FROM v_words WHERE kanji IS NOT NULL
        UNION ALL SELECT sequence, 'alt', alt, 2 FROM v_words WHERE alt IS NOT NULL""",
    "v_pos_dim": "SELECT * FROM " + values(
        [(c, n) for n, cs in fixed.POS_CODES.items() for c in cs] + list(fixed.POS_EXTRA.items()))
        + " AS t(code, pos_simple)",
    "v_word_pos": """SELECT DISTINCT sequence, pos_simple FROM
        (SELECT sequence, unnest(pos) AS code FROM v_senses) JOIN v_pos_dim USING (code)""",
    "v_word_tags": f"""SELECT 'jlpt' AS tag_type, CAST(jlpt_lvl AS VARCHAR) AS tag, sequence AS word_id
          FROM v_words WHERE jlpt_lvl IS NOT NULL
        UNION ALL SELECT 'pos', pos_simple, sequence FROM v_word_pos
        UNION ALL SELECT 'misc', misc, sequence FROM v_words WHERE misc IS NOT NULL
        UNION ALL SELECT 'flag', 'Katakana', sequence FROM v_words WHERE kata_word
        UNION ALL SELECT 'flag', 'IrregularIchidan', sequence FROM v_words WHERE list_contains(pos_codes, 'v5r-i')""",
    "v_names": f"""SELECT c_custkey AS sequence,
        {hira("substr(lower(c_mktsegment), 1, 2)")} || translate(right(c_name, 3), {lit(v.DIGITS)}, {lit(v.DIGITS_HIRA)}) AS kana,
        CASE WHEN c_custkey % 4 <> 0 THEN {han("substr(lower(c_mktsegment), 1, 2)")}
          || translate(right(c_name, 3), {lit(v.DIGITS)}, {lit(v.DIGITS_HAN)}) END AS kanji,
        lower(c_mktsegment) || ' ' || right(c_name, 3) AS transcription,
        CASE WHEN c_nationkey % 5 <> 0 THEN CASE WHEN c_nationkey % 2 = 0
          THEN [{sql_list(v.NAME_TYPES)}[c_nationkey % 6 + 1], 'unclass']
          ELSE [{sql_list(v.NAME_TYPES)}[c_nationkey % 6 + 1]] END END AS name_type FROM customer""",
    "v_sentences": f"""SELECT doc_id AS id, {hira('lower(text)')} AS japanese, text, source,
        {case_map('lang', v.LANG_NAMES)} AS language, lang,
        doc_id % 3 = 0 AND lang <> 'en' AS has_second,
        CASE WHEN n_chars % 7 BETWEEN 1 AND 5 THEN n_chars % 7 END AS jlpt_guess, n_chars % 5 + 8 AS level,
        CASE WHEN doc_id % 4 = 0 THEN [{', '.join(lit(n) for n, _ in fixed.SENTENCE_TAGS)}][CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) + 1]
          END AS t4,
        [{', '.join(lit(n) for n, _ in fixed.SENTENCE_TAGS)}][CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) + 1] AS tag1,
        doc_id % 4 = 0 AS slang FROM documents""",
    "v_translations": """SELECT id, CAST(0 AS BIGINT) AS pos, text, language FROM v_sentences
        UNION ALL SELECT id, 1, source, 'English' FROM v_sentences WHERE has_second""",
    "v_sentence_tags": """SELECT 'sentence' AS tag_type, tag1 AS tag, id AS item_id FROM v_sentences
        UNION SELECT 'sentence', 'Slang', id FROM v_sentences WHERE slang
        UNION ALL SELECT 'jlpt', CAST(jlpt_guess AS VARCHAR), id FROM v_sentences WHERE jlpt_guess IS NOT NULL""",
    "v_letters": """SELECT term AS literal, length(term) AS stroke_count, sum(freq) AS freq,
        list_distinct(string_split(term, '')) AS parts FROM v_terms
        WHERE regexp_full_match(term, '[a-z]+') GROUP BY term""",
    "v_parts": "SELECT literal, stroke_count, unnest(parts) AS radical FROM v_letters",
    "v_kanji": f"""SELECT {han('ch')} AS literal, ch, idx, frequency AS total,
        CASE WHEN idx % 6 <> 0 THEN idx % 6 END AS grade, idx % 9 + 1 AS stroke_count,
        CASE WHEN idx % 5 <> 0 THEN frequency END AS frequency, CASE WHEN idx % 4 <> 0 THEN idx % 4 + 1 END AS jlpt,
        [{kata('ch')}, {kata('ch')} || 'ン'] AS onyomi, [{hira('ch')} || 'の'] AS nanori,
        [{hira('ch')} || '.う', '-' || {hira('ch')} || '.く', {hira('ch')}] AS kunyomi,
        ['r' || ch] AS korean_r, [{hangul('ch')}] AS korean_h,
        [idx + 1, idx + 27] AS kun_dicts, [idx, idx + 26] AS on_dicts,
        ['letter ' || ch, ch] AS meanings, substr({lit(v.AS_HAN)}, CAST(idx % 26 + 1 AS INT), 1) AS nxt,
        CASE WHEN idx % 3 = 0 THEN substr({lit(v.AS_HAN)}, CAST(idx % 26 + 1 AS INT), 1) END AS alternative
        FROM (SELECT ch, sum(freq) AS frequency, strpos({lit(v.LETTERS)}, ch) AS idx FROM
          (SELECT freq, unnest(string_split(term, '')) AS ch FROM v_terms) WHERE regexp_full_match(ch, '[a-z]')
          GROUP BY ch)""",
    "v_radicals": f"""SELECT {han('substr(term, 1, 1)')} AS literal, term, freq FROM v_terms
        WHERE lang = 'en' AND regexp_full_match(term, '[a-z]+')""",
    "v_ids": """SELECT parent, pos, child FROM (
        SELECT term AS parent, CAST(0 AS BIGINT) AS pos, substr(term, 1, length(term) // 2) AS child
          FROM (SELECT DISTINCT term FROM v_terms WHERE length(term) > 1)
        UNION ALL SELECT term, 1, substr(term, length(term) // 2 + 1)
          FROM (SELECT DISTINCT term FROM v_terms WHERE length(term) > 1))""",
    "v_morphemes": f"""SELECT doc_id AS text_id, pos, {hira('term')} AS surface, {kata('term')} AS reading,
        {sql_list(v.MORPHEME_LEXEMES)}[CAST((length(term) * 5 + strpos({lit(v.LETTERS)}, substr(term, 1, 1)))
          % {len(v.MORPHEME_LEXEMES)} + 1 AS INT)] AS lexeme,
        {sql_list(v.MORPHEME_CLASSES)}[CAST((length(term) * 5 + strpos({lit(v.LETTERS)}, substr(term, 1, 1)))
          % {len(v.MORPHEME_LEXEMES)} + 1 AS INT)] AS word_class FROM v_tok""",
    "v_raw": f"""SELECT event_id AS query_id, CASE event_id % 12
          WHEN 0 THEN {han('w1')} || {hira('w2')} WHEN 1 THEN {hira('w1')} || {hira('w2')}
          WHEN 2 THEN 'ger: ' || w2 || ' ' || w1 WHEN 3 THEN p_name WHEN 4 THEN 'seq:' || user_id
          WHEN 5 THEN '#verb #n' || (user_id % 9) WHEN 6 THEN {hira('w1')} || '*'
          WHEN 7 THEN '"' || w2 || '" ' || w1
          WHEN 8 THEN {han('substr(w1, 1, 1)')} || ' ' || {kata('substr(w1, 1, 1)')}
          WHEN 9 THEN w1 || ' #adjective #hidden' WHEN 10 THEN {hangul('w2')}
          ELSE 'to ' || w2 || ' #sentences #slang' END AS raw_query, 'Words' AS target,
        {case_map('event_type', v.EVENT_LANGS)} AS user_lang, user_id % 2 = 0 AS show_english,
        user_id % 4 AS page, 10 AS page_size, 0 AS word_index, event_id % 12 AS form_no, user_id, w1, w2, p_name
        FROM events JOIN v_part ON user_id = sequence""",
    "v_news": """SELECT event_id AS id, 'user ' || user_id AS title, ts AS creation_time,
        '# ' || props || chr(10) || 'user ' || user_id || chr(10) || repeat('value ', 20) || chr(10) || 'third' || chr(10) || 'fourth' AS long,
        'user ' || user_id || chr(10) || repeat('value ', 20) || chr(10) || 'third' AS short
        FROM events WHERE event_type = 'signup'""",
    "v_hashtags": """SELECT '#' || source || '-' || lang AS tag, n / 8 AS freq, n % 4 AS target
        FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) WHERE n % 5 <> 0""",
    "v_grams": f"""SELECT item_id, lang, unnest(g) AS gram, len(g) AS n_grams
        FROM (SELECT item_id, lang, {index_grams('term')} AS g FROM v_terms)""",
    "v_qgrams": f"""SELECT query_id, unnest(g) AS gram, len(g) AS q_grams
        FROM (SELECT query_id, {index_grams('q')} AS g FROM v_query_words)""",
    "v_vgrams": f"SELECT item_id, unnest({gram_set('term')}) AS gram FROM v_terms",
    "v_vqgrams": f"SELECT query_id, unnest({gram_set('q')}) AS gram FROM v_query_words",
    "v_cand": """SELECT query_id, item_id, q_grams, n_grams, count(*) AS overlap
        FROM v_grams JOIN v_qgrams USING (gram) GROUP BY ALL""",
    "v_vec": """SELECT lang AS posting, doc_id, term, tf * log2(n_docs / df) AS weight FROM v_doc_terms
        JOIN (SELECT lang, term, count(*) AS df FROM v_doc_terms GROUP BY ALL) USING (lang, term)
        JOIN (SELECT lang, count(DISTINCT doc_id) AS n_docs FROM v_doc_terms GROUP BY ALL) USING (lang)""",
    "v_norm": "SELECT posting, doc_id, sqrt(sum(weight * weight)) AS norm FROM v_vec GROUP BY ALL",
    "v_pass_terms": f"""SELECT DISTINCT query_id, unnest(list_append({tokens('q')}, lower(q))) AS term
        FROM v_passages""",
    "v_rad_dim": "SELECT * FROM " + values(fixed.radical_strokes()) + " AS t(literal, stroke_count)",
    "v_pos_order": "SELECT * FROM " + values([(n, i) for i, n, _ in fixed.POS_SIMPLE]) + " AS t(pos_simple, pos_order)",
    "v_lang_dim": "SELECT * FROM " + values([(i, n) for i, n, _ in fixed.LANGUAGES]) + " AS t(lang_id, lang)",
}
MATERIALIZED = {"v_tok", "v_terms", "v_cand", "v_vec", "v_doc_terms", "v_grams", "v_qgrams", "v_words", "v_wparts", "v_place",
                *(f"v_{prefix}{step}" for prefix in "gp" for step in "abcde")}
_NAME = re.compile(r"\bv_[a-z0-9_]+\b")


def _needs(sql: str, seen: list[str], views: dict[str, str]) -> None:
    for name in dict.fromkeys(_NAME.findall(sql)):
        if name in views and name not in seen:
            _needs(views[name], seen, views)
            if name not in seen:
                seen.append(name)


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the views it (transitively) uses."""
    views = {**VIEWS, **(extra or {})}
    order: list[str] = []
    _needs(body, order, views)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in MATERIALIZED else ''}({views[n]})" for n in order)
    return f"WITH RECURSIVE {ctes}\n{body}" if "RECURSIVE" in body else f"WITH {ctes}\n{body}"
