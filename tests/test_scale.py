"""Plans that move no more rows than they must."""

import contextlib
import io
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kotonoha import fixed, schemas
from kotonoha.catalog import index_queries, retrieval_queries
from kotonoha.operators import collect, index, querylog, retrieve, score, segment, suggest
from kotonoha.plans import scaling, search
from kotonoha.session import cut_lineage
from kotonoha.streaming import feeds


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def placed_morphemes(spark, texts=60):
    """Texts of the lexemes of the rules, partitioned by text."""
    lexemes = ["見る", "て", "みる", "みる", "た", "ない", "れる", "たい", "ます", "いる", "しまう", "おく"]
    classes = {"見る": "Verb"}
    rows, draw = [], random.Random(7)
    for t in range(texts):
        for pos in range(t % 17 + 1):
            x = draw.choice(lexemes)
            rows.append((t, pos, x, x, x, classes.get(x, "Auxilary")))
    m = spark.createDataFrame(rows, "text_id long, pos long, surface string, lexeme string, reading string, word_class string")
    return rows, m.repartition(4, "text_id")


def heads(ms, rules):
    """True where a morpheme opens a word, met in order."""
    out, prev = [], None
    for surface, lexeme, cls in ms:
        start = fixed.LEXEME_RULES.get(lexeme) or {"Noun": "N", "Adjective": "AD", "Verb": "V"}.get(cls)
        start = start if start in rules else None
        inner = "てみる" if "てみる" in rules and (surface == "み" or lexeme == "みる") else start
        joined = prev is not None and inner in rules and inner in rules[prev]
        out.append(not joined)
        prev = inner if joined else start
    return out


def test_words_and_inflections_move_no_morphemes(spark):
    rows, m = placed_morphemes(spark)
    grouped = segment.group_words(m)
    parts = segment.parts_of_texts(m)
    for df in (grouped, segment.inflection_pairs(grouped), parts, segment.classify_texts(parts)):
        assert plan(df).count("Exchange hashpartitioning") <= 1 and "Join" not in plan(df)
    got = {(r.text_id, r.pos): (r.word, r.place) for r in grouped.collect()}
    labels = {(r.text_id, r.word, r.first): r.label for r in segment.inflection_pairs(grouped).collect()}
    want, want_labels = {}, {}
    for t in {r[0] for r in rows}:
        ms = [r for r in rows if r[0] == t]
        word, place, words = -1, 0, {}
        for r, head in zip(ms, heads([(r[2], r[3], r[5]) for r in ms], fixed.RULES), strict=True):
            word, place = (word + 1, 0) if head else (word, place + 1)
            want[t, r[1]] = (word, place)
            words.setdefault(word, []).append(r)
        for w, ws in words.items():
            tail = [(r[2], r[3], r[5]) for r in ws[1:]]
            opens = [i for i, h in enumerate(heads(tail, fixed.PAIR_RULES)) if h]
            for a, b in zip(opens, [*opens, len(tail)][1:], strict=True):
                label = fixed.INFLECTIONS.get("+".join(x[1] for x in tail[a:b]))
                if label:
                    want_labels[t, w, a] = label
    assert got == want
    assert labels == want_labels and len(set(labels.values())) > 4


def test_variants_and_entries_move_no_parts(spark):
    _, m = placed_morphemes(spark)
    parts = segment.parts_of_texts(m)
    asked = spark.createDataFrame([(t, t % 5 - 1) for t in range(0, 60, 2)], "query_id long, word_index int").repartition(4, "query_id")
    variants = retrieve.reader_variants(parts, asked)
    single, custom = suggest.inflection_entries(parts)
    for df in (variants, single, custom):
        assert plan(df).count("Exchange hashpartitioning") <= 2  # the texts and the questions
    ps = {}
    for p in parts.collect():
        ps.setdefault(p.query_id, []).append(p)
    want, entries = set(), set()
    for t, of in ps.items():
        of.sort(key=lambda p: p.pos)
        if t % 2 == 0:
            p = of[min(max(t % 5 - 1, 0), len(of) - 1)]
            want |= {(t, "normalised", p.normalised)} | ({(t, "inflected", p.inflected)} if p.inflected != p.normalised else set())
        kept = [p for p in of if p.word_class not in ("Particle", "Symbol", "Space")]
        if len(of) > 1 and len(kept) <= 15:
            entries |= {(t, p.normalised, len(kept) - k) for k, p in enumerate(kept)}
    assert {(r.query_id, r.variant, r.q) for r in variants.collect()} == want
    assert {(r.query_id, r.text, r.score) for r in custom.collect()} == entries


def test_joins_go_by_measured_size(spark, monkeypatch):
    # the big side looks small: one row on disk, exploded later
    big = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(3000))).alias("id")).withColumn("k", F.col("id") % 7)
    small = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = sorted((i, i % 7, i % 7 * 10) for i in range(1, 3001))
    few = scaling.salted_join(big, small, ["k"], ["id"])
    assert "BuildRight" in plan(few) and sorted((r.id, r.k, r.v) for r in few.collect()) == want
    monkeypatch.setattr(scaling, "BROADCAST_ROWS", 3)
    many = scaling.salted_join(big, small, ["k"], ["id"])
    assert "BroadcastHashJoin" not in plan(many) and sorted((r.id, r.k, r.v) for r in many.collect()) == want
    left = scaling.measured_join(big, small.where("k > 3"), ["k"], "left")
    assert sorted((r.id, r.v or 0) for r in left.collect()) == [(i, v if k > 3 else 0) for i, k, v in want]


def test_pairs_of_documents_arise_where_the_document_is(spark):
    vectors = spark.createDataFrame([("en", d, f"t{(d + i) % 9}", 1.0 + i) for d in range(30) for i in range(3)],
                                    "posting string, doc_id long, term string, weight double")
    terms = spark.createDataFrame([("a", "t1", 1.0), ("a", "t2", 0.5), ("b", "t8", 1.0)], "query_id string, term string, qw double")
    got = retrieve.vector_candidates(terms, vectors)
    assert plan(got).count("Exchange hashpartitioning") - plan(got).count("BroadcastExchange") <= 2
    assert "hashpartitioning(query_id" not in plan(got)
    rows = {(q, d) for q, t in (("a", 1), ("a", 2), ("b", 8)) for d in range(30) for i in range(3) if (d + i) % 9 == t}
    assert {(r.query_id, r.doc_id) for r in got.collect()} == rows


def test_streamed_table_may_be_a_folder(spark, tmp_path):
    docs = spark.createDataFrame([("a b a",), ("c a",)], "text string").repartition(2)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stream = feeds.stream_files(spark, str(tmp_path), docs.schema, "documents.parquet")
    path = feeds.run_to_table(feeds.count_terms(stream), "complete")
    assert {(r.term, r.freq) for r in feeds.latest_state(spark, path).collect()} == {("a", 3), ("b", 1), ("c", 1)}


def test_shared_grams_are_counted_without_a_row_each(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choices("abc", k=draw.randint(1, 6))) for _ in range(60)]
    rows = [(None if i % 30 == 0 else i // 2 if i < 8 else i, x, [x[j:j + 2] for j in range(len(x) - 1)] or None) for i, x in enumerate(texts)]
    rows = [(i, len(g or []), sorted(set(g)) if g else g) for i, _, g in rows]
    asked = [(q, n, g, n + 1) for q, n, gs in ((None, 2, ["ab", "bc"]), ("x", 3, ["aa", "ab", "zz"]), ("y", 1, ["cc"]), ("y", 2, ["cc", "ab"]),
                                               ("z", 1, [None])) for g in gs]
    want = {}
    for i, size, held in rows:
        for q, n, g, k in asked:
            if g in (held or []):
                o, a, b, c = want.get((q, i), (0, 0, 0, 0))
                want[q, i] = o + 1, max(a, n), max(b, size), max(c, k)
    grams = spark.createDataFrame(asked, "query_id string, q_grams int, gram string, k long")
    items = spark.createDataFrame(rows, "item_id long, n_grams int, grams array<string>")
    for part, some in ((items, rows), (items.where("item_id >= 8"), None)):
        got = retrieve.ngram_candidates(grams, part)
        assert "MapInArrow" in plan(got)
        keep = {k: v for k, v in want.items() if some or (k[1] or 0) >= 8}
        found = got.collect()
        assert Counter((r.query_id, r.item_id) for r in found) == Counter(list(keep))
        assert {(r.query_id, r.item_id): (r.overlap, r.q_grams, r.n_grams, r.k) for r in found} == keep
    none = retrieve.ngram_candidates(grams.where("k < 0"), items)
    assert none.count() == 0 and none.schema["overlap"].dataType.simpleString() == "bigint"


def test_files_of_elements_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(index_queries, "XML_RECORDS", 10)
    path = index_queries._as_xml(spark.range(95).coalesce(1).selectExpr("id AS sequence"), "entry", spark)
    got = spark.read.schema("sequence long").format("xml").option("rowTag", "entry").load(path)
    assert len(got.inputFiles()) == 10 and sorted(r.sequence for r in got.collect()) == list(range(95))


def test_entries_are_dealt_before_their_prefixes(spark, monkeypatch):
    monkeypatch.setattr(suggest, "PREFIXES_PER_TASK", 20)
    rows = [(i, f"na{i:03d}", 0.0) for i in range(50)]
    vocab = spark.createDataFrame(rows, "item_id long, text string, freq_share double").coalesce(1)
    table = suggest.completions(vocab, 3)
    assert "RoundRobinPartitioning(13)" in plan(table)
    got = {(r.prefix, r.rank): r.item_id for r in table.collect()}
    want = {}
    for i, x, _ in rows:
        for n in range(1, 6):
            want.setdefault(x[:n], []).append(i)
    assert got == {(p, k + 1): i for p, ids in want.items() for k, i in enumerate(ids[:3])}


def test_terms_are_spelt_after_they_are_counted(spark, tmp_path):
    spark.createDataFrame([("en", "kana kana"), (None, "xq")], "lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    t = retrieval_queries.kana_terms(spark, str(tmp_path))
    assert "Aggregate" not in plan(t.where("k0 = 'かな'"))
    assert {(r.item_id, r.k, r.freq) for r in t.where("k0 = 'かな'").collect()} == {("en:kana", "かな", 2)}


def small_tables(spark, folder):
    """documents, benchmark and part of a few rows, in one folder."""
    spark.createDataFrame([(1, "small rings of stone", "en", "s-1", 20), (2, "Stone rings, small stones", "en", "s-2", 25),
                           (3, "ringe aus stein", "de", "s-1", 15)], "doc_id long, text string, lang string, source string, n_chars int"
                          ).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "stones and rings"), (2, "small")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, "large ring", "Brand#7", "LARGE", 4)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
                          ).write.parquet(f"{folder}/part.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["sco3_native_word_score", "sco11_kanji_reading_suggestion", "rad5_radical_search", "col2_fallback_cascade",
                                  "rad2_possible_radicals", "rad2_characters_by_strokes", "idx9_term_vectors", "fil9_all_quoted_terms"])
def test_documents_are_cut_once(spark, tmp_path, name):
    """The result is made from stored headwords or terms; no use of them reads the documents again."""
    from kotonoha import catalog

    out = catalog.QUERIES[name](spark, small_tables(spark, tmp_path))
    assert not [f for f in out.inputFiles() if "documents.parquet" in f]
    out.collect()


def test_alignment_patterns_are_made_once(spark):
    """A condition on what is exploded from the pairs does not write the pattern out again."""
    from kotonoha.operators import segment

    rows = spark.createDataFrame([("山の木", "やまのき"), ("山", None)], "kanji string, kana string")
    runs = segment.align_runs(rows).select("kanji", F.explode("pairs").alias("p")).where(F.length("p.kanji") == 1)
    assert {(r.p.kanji, r.p.kana) for r in runs.collect()} == {("山", "やま"), ("木", "き")}
    assert runs._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 1


def test_documents_with_all_terms(spark):
    """Copies, nulls and a term no document has."""
    from kotonoha.operators import filters

    vectors = spark.createDataFrame([("a", 1), ("b", 1), ("a", 1), ("a", 2), (None, 2), ("b", None), ("a", None)], "term string, doc_id long")
    asked = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a"), ("z", "a"), ("z", "c"), ("n", "a"), ("n", None), (None, "a")],
                                  "query_id string, term string")
    out = filters.documents_with_all_terms(asked, vectors).collect()
    assert sorted((r.query_id, r.doc_id or 0) for r in out) == [("x", 0), ("x", 1), ("y", 0), ("y", 1), ("y", 2)]


def test_sentence_texts_meet_quoting_queries_only(spark):
    """Without a quoted Japanese term no hit is joined to the texts."""
    from kotonoha.plans import search

    sentences = spark.createDataFrame(
        [(1, "いぬ", "いぬ", [("dog", "English")], ["Slang"], None), (2, "ねこ", "ねこ", [("dog cat", "English"), ("chat", "French")], [], None)],
        "id long, japanese string, furigana string, translations array<struct<text:string,language:string>>, tags array<string>, jlpt_guess byte")
    terms = spark.createDataFrame([(1, "いぬ", 1), (2, "ねこ", 1)], "doc_id long, term string, tf long")
    idx = search.build_sentence_index(cut_lineage(sentences), terms)

    def found(required):
        q = spark.createDataFrame([("q", "cat", "Foreign", "SingleWord", "English", False, None, [], [], required)],
                                  "query_id string, query string, q_lang string, form string, user_lang string, show_english boolean, sequence long,"
                                  "tags array<struct<kind:string,value:string>>, sentence_tags array<string>, required array<string>")
        return search.search_sentences(q, idx)

    plain = found([])
    assert [r.item_id for r in plain.collect()] == [2]
    assert "regexp_extract_all" not in plain._jdf.queryExecution().optimizedPlan().toString()  # the kana of the texts
    assert [r.item_id for r in found(["ねこ"]).collect()] == [2]
    assert found(["いぬ"]).collect() == []


def test_weighted_pairs_against_plain_count(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcd") for _ in range(draw.randint(1, 9)))
    names, asked = [(i, word()) for i in range(120)], [(f"q{i}", word()) for i in range(40)]
    items = index.ngram_items(spark.createDataFrame(names, "id long, t string"), "id", "t")
    grams = retrieve.query_grams(spark.createDataFrame(asked, "query_id string, q string"))
    found = retrieve.ngram_candidates(grams, items, 0.3, weight=0.1)
    found = found.where(score.dice_weighted(0.1) >= 0.3)
    pieces = lambda t: {f"{'#' * 2}{t}{'#' * 2}"[i:i + 3] for i in range(len(t) + 2)}
    want = {}
    for q, a in asked:
        for i, b in names:
            x, y = pieces(a), pieces(b)
            if len(x & y) / (0.1 * len(y) + 0.9 * len(x)) >= 0.3:
                want[q, i] = len(x & y)
    assert {(r.query_id, r.item_id): r.overlap for r in found.collect()} == want and len(want) > 40


def test_best_hits_are_cut_before_they_move(spark):
    draw = random.Random(3)
    queries = spark.createDataFrame([(f"q{i}", i % 4) for i in range(24)], "query_id string, kind int")
    rows = [(p, f"q{q}", draw.randrange(60), float(draw.randrange(9)), s) for p in range(5) for q in range(24) for s in range(2)
            for _ in range(1 if p == 0 else draw.choice([0, 3, 40]))]
    stored = cut_lineage(spark.createDataFrame(rows, "p int, query_id string, item_id long, relevance double, seq long"))

    def run(p):
        return lambda q: stored.where(F.col("p") == p).join(q.select("query_id"), "query_id", "left_semi").drop("p")

    first = stored.where("p = 0").groupBy("query_id").agg(F.min("item_id").alias("item_id"))
    by_id = lambda q: run(0)(q).join(first, ["query_id", "item_id"], "left_semi")
    kind = F.col("kind")
    stages = [collect.Stage(0, by_id, kind <= 1, few=1), collect.Stage(1, run(1), kind == 0), collect.Stage(2, run(2), kind.isin(1, 2)),
              collect.Stage(3, run(3), kind.isin(2, 3)), collect.Stage(4, run(4), F.lit(True), below=6)]
    whole, cut = collect.cascade(queries, stages), collect.cascade(queries, stages, depth=5)
    top = lambda hits: sorted(tuple(r) for r in collect.top_k(hits, 5).collect())
    assert top(cut) == top(whole) and cut.count() < whole.count()
    assert "WindowGroupLimit" in plan(cut)


def test_words_are_cut_by_one_pattern(spark):
    draw = random.Random(11)
    forms = [("み", "見る"), ("みる", "みる"), ("たら", "た"), ("に", "だ"), ("じゃ", "だ"), ("さ", "する"), ("て", "て"), ("い", "いる"), ("れ", "れる"),
             ("ない", "ない"), ("た", "た"), ("x", None), (None, "たい"), ("三", "三"), ("おく", "おく"), ("しまう", "しまう")]
    rows = [(t, p * 3, *draw.choice(forms), "ヨミ", draw.choice(["Verb", "Noun", "Adjective", "Numeral", "Auxilary", None])) for t in range(80) for p in range(t % 40)]
    rows += [(99, p, "てみ", "て" if p % 2 else "みる", "テ", "Verb") for p in range(6000)] + [(None, 0, "た", "た", "タ", None), (5, None, "た", "た", "タ", None)]
    m = spark.createDataFrame(rows, "text_id long, pos long, surface string, lexeme string, reading string, word_class string").repartition(4, "text_id")
    parts = segment.parts_of_texts(m)
    assert "Window" not in plan(parts)
    grouped = segment.group_words(m)
    labels = {}
    for r in sorted(segment.inflection_pairs(grouped).collect(), key=lambda r: r["first"]):
        labels.setdefault((r.text_id, r.word), []).append(r.label)
    words = {}
    for r in sorted(grouped.collect(), key=lambda r: (r.text_id, r.pos)):
        words.setdefault((r.text_id, r.word), []).append(r)
    want = {k: ("".join(r.surface or "" for r in ms), ms[0].lexeme, labels.get(k, [])) for k, ms in words.items()}
    assert {(r.query_id, r.pos): (r.inflected, r.normalised, r.inflections) for r in parts.collect()} == want
    assert max(map(len, words.values())) > 1000 and len({x for v in labels.values() for x in v}) > 4


def test_native_terms_meet_the_vocabulary_once(spark, monkeypatch):
    draw = random.Random(13)
    parts = [(q, draw.choice("abcd"), draw.choice("abcxy"), n) for q in range(60) for n in [q % 3 + 1] for _ in range(n)] + [(None, "a", "a", 2)]
    p = spark.createDataFrame(parts, "query_id long, inflected string, normalised string, n_parts long").repartition(4, "query_id")
    asked = spark.createDataFrame([(q, "b" if q % 7 == 0 else "no") for q in range(60)], "query_id long, q string")
    known = {"a", "b", "x"}
    want = set()
    for q in range(60):
        forms = [(0, x[1], x[3]) for x in parts if x[0] == q] + [(1, x[2], x[3]) for x in parts if x[0] == q]
        forms = [f for f in forms if f[1] in known]
        want |= {(q, "b")} if q % 7 == 0 else {(q, f[1]) for f in forms if f[2] > 1 or f[0] == min(forms)[0]}
    vocabulary = spark.createDataFrame([(t,) for t in [*known, "b"]], "term string")
    for rows in (100, 1):  # a small vocabulary is broadcast, a large one shuffled
        monkeypatch.setattr(scaling, "BROADCAST_ROWS", rows)
        terms = retrieve.native_query_terms(asked, vocabulary, p)
        if rows > 1:  # the forms stay where the parts of their query are
            assert plan(terms).count("Exchange hashpartitioning") <= 1 and "SortMergeJoin" not in plan(terms)
        assert sorted((r.query_id, r.term) for r in terms.collect()) == sorted(want)


def test_whole_texts_are_indexed_by_digest(spark):
    long = " ".join(f"word{i}" for i in range(40))
    s = spark.createDataFrame([(i, "あ", "あ", [(t, "English")], None, ["Slang"]) for i, t in enumerate([long, long + " end", "short one", "other"])],
                              "id long, japanese string, furigana string, translations array<struct<text:string,language:string>>, jlpt_guess tinyint, tags array<string>")
    idx = search.build_sentence_index(s, spark.createDataFrame([(0, "あ", 1)], "doc_id long, term string, tf long"))
    assert idx.foreign.agg(F.max(F.length("term"))).first()[0] <= 65
    raw = spark.createDataFrame([(0, long, "Sentences", "English", True, 1, 10, 0, None), (1, "short one", "Sentences", "English", True, 1, 10, 0, None)], schemas.RAW_QUERIES)
    best = collect.top_k(search.search_sentences(querylog.annotate(raw), idx), 1).collect()
    assert {r.query_id: r.item_id for r in best} == {0: 0, 1: 2}


def test_repeated_places_and_names_count_as_before(spark):
    rows = [(1, p // 2, x, x, x, "Verb") for p, x in enumerate(["見る", "て", "みる", "みる", "みる", "た", "ない", "みる"])]
    m = spark.createDataFrame(rows, "text_id long, pos long, surface string, lexeme string, reading string, word_class string").coalesce(1)
    words = {}
    for r in sorted(segment.group_words(m).collect(), key=lambda r: (r.word, r.place)):
        words.setdefault(r.word, []).append(r.surface)
    assert {p.pos: p.inflected for p in segment.parts_of_texts(m).collect()} == {w: "".join(x) for w, x in words.items()}
    # two rows of one name count together: 2 * 3 of 0.1 * 7 + 0.9 * 9 grams
    names = spark.createDataFrame([(7, None, "abcde"), (7, None, "abcde"), (8, None, "abcde")], "sequence long, kanji string, transcription string").withColumn("kana", F.lit("あ"))
    kanji = spark.createDataFrame([("音", ["オン"], ["おと"], [])], "literal string, onyomi array<string>, kunyomi array<string>, nanori array<string>")
    raw = spark.createDataFrame([(0, "abcxyzw", "Names", "English", True, 1, 10, 0, None)], schemas.RAW_QUERIES)
    hits = search.search_names(querylog.annotate(raw), search.build_name_index(names, kanji), depth=10).collect()
    assert [(r.item_id, round(r.relevance, 6)) for r in hits] == [(7, round(6 / 8.8, 6))]
