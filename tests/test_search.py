"""Searches over a mini dictionary, and joins against brute force."""

import itertools
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from kotonoha import schemas
from kotonoha.functions import text
from kotonoha.operators import collect, index, querylog, radicals, retrieve, score, segment, suggest
from kotonoha.plans import scaling, search
from kotonoha.session import cut_lineage
from kotonoha.sources import records

ENTRIES = [  # sequence, kana, kanji, English gloss, German gloss, pos
    (1, "おんがく", "音楽", "music", "Musik", ["n"]), (2, "おんがくてき", "音楽的", "musical", None, ["adj-na"]),
    (3, "ねる", "寝る", "to sleep", "schlafen", ["v1"]), (4, "しる", "知る", "to know", None, ["v5r"]),
    (5, "はなす", "話す", "to speak", "sprechen", ["v5s"]), (6, "うちゅう", "宇宙", "universe", None, ["n"]),
    (7, "うちゅうひこうし", "宇宙飛行士", "astronaut", None, ["n"]), (8, "ドイツじん", "ドイツ人", "German person", None, ["n"]),
    (9, "これ", None, "this", None, ["pn"]), (10, "とかす", "溶かす", "to melt", None, ["v5s"]),
    (11, "じてんしゃ", "自転車", "bicycle", "Fahrrad", ["n"]), (12, "すき", "好き", "liked", None, ["adj-na"]),
]


@pytest.fixture(scope="module")
def idx(spark):
    def spelling(text, kanji):
        return None if text is None else Row(text, kanji, False, [], [], True)
    rows = []
    for seq, kana, kanji, eng, ger, pos in ENTRIES:
        def sense(i, gloss, lang):
            return Row(i, None, None, None, [Row(0, gloss, None)], None, None, None, pos, lang, None, None)
        senses = [sense(0, eng, "English")] + ([sense(1, ger, "German")] if ger else [])
        rows.append((seq, True, Row(spelling(kana, False), spelling(kanji, True), []), senses, None, 3, None, None, None, 1, []))
    words = spark.createDataFrame(rows, schemas.WORDS)
    kanji = spark.createDataFrame([("音", ["オン"], ["おと"], ["音"]), ("楽", ["ガク"], ["たの.しい"], ["白", "木"])],
                                  "literal string, onyomi array<string>, kunyomi array<string>, parts array<string>")
    kanji = kanji.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (
        ("grade", "tinyint"), ("frequency", "bigint"), ("jlpt", "tinyint"), ("stroke_count", "tinyint"))],
        F.array().cast("array<string>").alias("nanori"), F.array(F.lit("sound")).alias("meanings"),
        F.array(F.lit("음")).alias("korean_h"))
    pairs = spark.createDataFrame([(1, "音楽", "おんがく")], "pair_id long, kanji string, kana string")
    split = segment.split_compounds(pairs, index.dictionary_readings(kanji))
    aligned = split.select(F.col("pair_id").alias("item_id"), F.explode("parts").alias("p")).select("item_id", "p.literal", "p.reading")
    return search.build_word_index(words, kanji, records.pos_dimension(spark), aligned)


def run(spark, idx, queries):
    raw = spark.createDataFrame([(i, q, "Words", lang, True, 1, 10, 0, None) for i, (q, lang) in enumerate(queries)],
                                schemas.RAW_QUERIES)
    q = querylog.annotate(raw)
    hits = search.search_words(q, idx)
    main = idx.native.items.select("item_id", "main")
    top = collect.top_k(hits, 10).join(main, "item_id").collect()
    out = {i: [] for i in range(len(queries))}
    for r in sorted(top, key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append(r.main)
    return out


def test_word_search(spark, idx):
    asked = [("musik", "German", "音楽"), ("音楽", "German", "音楽"), ("ドイツ人", "German", "ドイツ人"), ("to sleep", "English", "寝る"),
             ("know", "German", "知る"), ("宇宙*行士", "German", "宇宙飛行士"), ("宇*", "English", "宇宙"), ("kore", "English", "これ"),
             ("tokasu", "English", "溶かす"), ("jitensha", "English", "自転車"), ("suki", "English", "好き"), ("ongaku", "English", "音楽"),
             ("seq:5", "English", "話す"), ("音 オン", "English", "音楽"), ("音楽 #noun", "English", "音楽"), ("speak #verb", "English", "話す"),
             ("#pronoun", "English", "これ"), ('"speak" to speak', "English", "話す")]
    got = run(spark, idx, [(q, lang) for q, lang, _ in asked])
    for i, (q, _, first) in enumerate(asked):
        assert got[i] and got[i][0] == first, (q, got[i])
    assert got[14] == ["音楽"]


def test_kanji_of_kana_words(spark, idx):
    q = spark.createDataFrame([("a", "おんがく"), ("b", "おんがくて")], "query_id string, q string")
    got = [(r.query_id, r.literal) for r in search.kana_kanji(q, idx, idx.kanji).orderBy("query_id", "pos").collect()]
    assert got == [("a", "音"), ("a", "楽")]


def test_prefix_and_tags(spark):
    raw = spark.createDataFrame([(i, q, "Words", "German", True, 1, 10, 0, None) for i, q in enumerate(
        ["eng: dog", "eng:", "egn:", "x #n4", "x #genki3", "x #genki99", 'this is "some" text that "contains some" quotes" lol', "#unknown", "#verb"])],
        schemas.RAW_QUERIES)
    got = {r.query_id: r for r in querylog.annotate(raw).collect()}
    assert (got[0]["query"], got[0].lang) == ("dog", "English")
    assert (got[1]["query"], got[1].lang) == ("eng:", "German") and got[2]["query"] == "egn:"
    assert got[3].jlpt_tag == 4 and got[4].genki_tag == 3 and got[5].genki_tag == 23
    assert got[6].required == ["some", "contains some"]
    assert 7 not in got and got[8].form == "TagOnly"


WORDS = ["kund", "kunde", "hund", "bund", "freund", "fund", "mund", "under", "a.b", "abc", "abd", "freunde"]


def test_ngrams_against_brute_force(spark):
    items = spark.createDataFrame([(w,) for w in WORDS], "w string")
    queries = spark.createDataFrame([(w, w) for w in ["kunde", "freund", "ab"]], "query_id string, q string")

    def grams(t):
        p = "␣␣" + t + "␣␣"
        return {p[i:i + 3] for i in range(len(p) - 2)}

    for t in (None, 0.3, 0.6):
        c = retrieve.ngram_candidates(retrieve.query_grams(queries), index.ngram_items(items, "w", "w"), t)
        got = {(r.query_id, r.item_id): round(r.d, 6) for r in c.withColumn("d", score.dice()).collect() if t is None or r.d >= t}
        want = {}
        for q, w in itertools.product(["kunde", "freund", "ab"], WORDS):
            shared = len(grams(q) & grams(w))
            d = 2 * shared / (len(grams(q)) + len(grams(w)))
            if shared and (t is None or d >= t):
                want[q, w] = round(d, 6)
        assert got == want


def test_wildcards_against_brute_force(spark):
    import re
    rnd = random.Random(4)
    words = sorted({*WORDS, "", "a.b", "a\\b", "(a)", "a$", "^a", *("".join(rnd.choice("abc.\\é") for _ in range(rnd.randint(1, 7))) for _ in range(300))})
    t = spark.createDataFrame([(w, w) for w in words], "item_id string, reading string")
    typed = sorted({"?und", "*und*", "a.?", "fr*e", "***", "x*", "ab+", "*a", "a*", "?", "*.*", "a?\\*", "*$",
                    *("".join(rnd.choice("abc.\\é**?+") for _ in range(rnd.randint(1, 6))) for _ in range(120))})
    typed = [x for x in typed if set(x) & set("*?+")]
    q = spark.createDataFrame([(x, ) for x in typed], "query_id string")
    q = q.select("query_id", querylog.wildcard_pattern("query_id").alias("pattern"))
    found = retrieve.wildcard_candidates(q, index.wildcard_postings(t, "item_id", "reading")).collect()
    got = {(r.query_id, r.item_id) for r in found}
    want = set()
    for x in typed:
        if not x.strip("*?+"):
            continue
        pat = "".join(".*" if c == "*" else "." if c in "?+" else re.escape(c) for c in x)
        want |= {(x, w) for w in words if re.fullmatch(pat, w)}
    assert got == want and len(found) == len(got) > 500


def test_completions_against_brute_force(spark):
    rnd = random.Random(6)
    words = sorted({"".join(rnd.choice("aabé") for _ in range(rnd.randint(1, 6))) for _ in range(400)})
    rows = [(f"{lang}:{w}", lang, w, rnd.randint(1, 5) / 5) for lang in ("de", "en") for w in words] + [("de:", "de", "", 1.0)]
    vocab = spark.createDataFrame(rows, "item_id string, lang string, text string, freq_share double")
    asked = sorted({w[:n] for w in words[::2] for n in range(1, len(w) + 1)} | {"", "zz"})
    queries = spark.createDataFrame([(f"{i}/{x}", x, "de") for x in asked for i in range(2)], "query_id string, q string, lang string")
    out = suggest.prefix_suggestions(queries, vocab, 5, ["lang"], 1.5, 0.5)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()  # cut to the limit before the exchange
    got = {}
    for r in sorted(out.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["item_id"])
    for x in asked:
        hits = sorted((-round(1.5 * len(x) / len(w) + 0.5 * f, 6), w, item) for item, lang, w, f in rows if lang == "de" and w.startswith(x) and x)
        assert got.get(f"0/{x}", []) == got.get(f"1/{x}", []) == [item for _, _, item in hits[:5]]


def test_division_and_edit_distance_against_brute_force(spark):
    kanji = spark.createDataFrame([(w, len(w), sorted(set(w))) for w in WORDS], "literal string, stroke_count int, parts array<string>")
    req = spark.createDataFrame([("q1", "u"), ("q1", "n"), ("q2", "f"), ("q2", "e"), ("q3", "a"), ("q3", "Q")], "query_id string, radical string")
    got = {(r.query_id, r.literal) for r in radicals.kanji_with_all(req, kanji).collect()}
    asked = {"q1": "un", "q2": "fe", "q3": "a"}
    assert got == {(q, w) for q, rs in asked.items() for w in WORDS if all(c in w for c in rs)}
    qs = spark.createDataFrame([("kund", "kund"), ("frxund", "frxund")], "query_id string, q string")
    got = {(r.query_id, r.term, r.dist) for r in radicals.similar_terms(qs, kanji.select(F.col("literal").alias("term")), 2).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, prev = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        return row[-1]
    assert got == {(q, w, lev(q, w)) for q in ("kund", "frxund") for w in WORDS if lev(q, w) <= 2}


def test_similarity_order(spark):
    d = spark.createDataFrame([(w,) for w in ("freund", "hund", "kunde", "bund")], "w string")
    vec = index.feature_vectors(d, "w", "w", index.ngram_frequency(d, "w"))
    qv = index.feature_vectors(spark.createDataFrame([("kund",)], "w string"), "w", "w", index.ngram_frequency(d, "w"))
    pairs = spark.createDataFrame([("kund", "kunde"), ("kund", "hund")], "a string, b string")
    s = {r.b: r.score for r in score.term_distance(pairs, qv, vec).collect()}
    assert s["kunde"] > s["hund"]


MORPHS = [  # text, (surface, lexeme, class)...
    ("見たくなかった", [("見", "見る", "Verb"), ("たく", "たい", "Auxilary"), ("なかっ", "ない", "Auxilary"), ("た", "た", "Auxilary")], ["Tai", "Negative", "Past"]),
    ("書いておく", [("書い", "書く", "Verb"), ("て", "て", "Particle"), ("おく", "おく", "Verb")], ["TeOku"]),
    ("覚えてる", [("覚え", "覚える", "Verb"), ("てる", "てる", "Auxilary")], ["TeIru"]),
    ("知らなかった", [("知ら", "知る", "Verb"), ("なかっ", "ない", "Auxilary"), ("た", "た", "Auxilary")], ["Negative", "Past"]),
]


def test_inflections(spark):
    rows = [(i, p, s, lx, s, c) for i, (_, ms, _) in enumerate(MORPHS) for p, (s, lx, c) in enumerate(ms)]
    parts = segment.parts_of_texts(spark.createDataFrame(rows, schemas.MORPHEMES))
    got = {r.query_id: r for r in parts.collect()}
    for i, (text, ms, labels) in enumerate(MORPHS):
        assert got[i].inflected == text and got[i].normalised == ms[0][1] and got[i].inflections == labels
    music = [("音楽", "音楽", "Noun"), ("が", "が", "Particle"), ("聞き", "聞く", "Verb"), ("たい", "たい", "Auxilary"),
             ("み", "みる", "Verb"), ("みる", "みる", "Verb"), ("みる", "みる", "Verb")]
    m = spark.createDataFrame([(9, p, s, lx, s, c) for p, (s, lx, c) in enumerate(music)], schemas.MORPHEMES)
    parts = sorted(segment.parts_of_texts(m).collect(), key=lambda r: r.pos)
    # a run of the auxiliary pairs up: verb, continuation, verb
    assert [p.inflected for p in parts] == ["音楽", "が", "聞きたい", "みみる", "みる"]


def test_pages_are_disjoint(spark):
    hits = spark.createDataFrame([("q", f"i{n:03d}", 1.0 / (1 + n), 0) for n in range(57)], "query_id string, item_id string, relevance double, producer int")
    seen = []
    for p in range(1, 8):
        q = spark.createDataFrame([("q", (p - 1) * 10, 10)], "query_id string, page_offset int, page_size int")
        seen += [r.item_id for r in collect.page(hits, q).collect()]
    assert len(seen) == len(set(seen)) == 57


def test_plans(spark):
    """Query grams are broadcast by size, pairs need no exchange after the join, no Python runs."""
    items = spark.createDataFrame([(w,) for w in WORDS], "w string")
    q = retrieve.query_grams(spark.createDataFrame([("kunde", "kunde")], "query_id string, q string"))
    hits = retrieve.ngram_candidates(q, index.ngram_items(items, "w", "w"), 0.3).withColumn("relevance", score.dice()).withColumn("producer", F.lit(0))
    plan = collect.top_k(hits, 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "PythonUDF" not in plan


def test_news_files_and_hashtags(spark, tmp_path):
    for name, body in (("100;First;part", "# head\nline"), ("200;Second", "x" * 120 + "\nb\nc\nd"), ("ignored", "no")):
        (tmp_path / name).write_text(body)
    got = {r.title: r for r in records.read_news(spark, str(tmp_path)).collect()}
    assert set(got) == {"First;part", "Second"} and got["First;part"].short == "line"
    assert got["Second"].short.endswith("b\nc") and got["Second"].was_trimmed
    lines = spark.createDataFrame([("#a 0.5 1 2",), ("#b",), ("",), ("#c x 1",), ("#d 2",)], "value string")
    tags = {r.tag: r.s_targets for r in records.parse_hashtags(lines).collect()}
    assert tags == {"#a": [1, 2], "#d": []}


def test_page_buttons_against_every_position(spark):
    rows = spark.range(1, 13).select(F.col("id").cast("int").alias("current")).crossJoin(
        spark.range(0, 13).select(F.col("id").cast("int").alias("last"))).where("current <= greatest(last, 1)")
    for r in rows.withColumn("b", collect.page_buttons(F.col("current"), F.col("last"))).collect():
        n = min(5, r["last"])
        starts = [s for s in range(1, r["last"] - n + 2)]
        best = min(starts, key=lambda s: (abs(s + 2 - r["current"]), s)) if n else 0
        assert r["b"] == list(range(best, best + n)), r


def test_pages_behind_any_bound(spark):
    hits = spark.range(12000).select(F.lit(1).alias("query_id"), F.col("id").alias("item_id"),
                                     (F.lit(20000) - F.col("id")).cast("double").alias("relevance"), F.lit(0).alias("producer"))
    asked = spark.createDataFrame([(1, 11500, 100)], "query_id int, page_offset int, page_size int")
    assert sorted(r["item_id"] for r in collect.page(hits, asked).collect()) == list(range(11500, 11600))
    keyed = hits.withColumn("query_id", F.lit("k"))
    mapping = spark.createDataFrame([(7, "k"), (8, "k")], "query_id int, key string")
    pages = spark.createDataFrame([(7, 1490, 10), (8, 1100, 100)], "query_id int, page_offset int, page_size int")
    out = search.result_pages(keyed, mapping, pages).collect()
    assert sorted(r["item_id"] for r in out if r["query_id"] == 7) == list(range(1490, 1500))
    assert sum(r["query_id"] == 8 for r in out) == 100


def test_deep_decomposition_comes_out_whole(spark):
    edges = spark.createDataFrame([(f"c{i:02d}", 0, f"c{i + 1:02d}") for i in range(45)] + [("c45", 0, "c45")],
                                  "parent string, pos int, child string")
    roots = spark.createDataFrame([("c00",)], "root string")
    assert radicals.decompose(roots, edges).agg(F.max("depth")).head()[0] == 45


def test_prefix_pairs_come_from_all_partitions(spark):
    rnd = random.Random(8)
    words = sorted({"".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 9))) for _ in range(900)})
    items = index.ngram_items(spark.createDataFrame([(w,) for w in words], "w string"), "w", "w")
    queries = spark.createDataFrame([(w, w[1:] + "é", 0.2 + 0.1 * (i % 7)) for i, w in enumerate(words[::3])], "query_id string, q string, threshold double")
    grams = retrieve.query_grams(queries, keep=["threshold"])
    found = retrieve.ngram_candidates(grams, items, F.col("threshold")).withColumn("at", F.spark_partition_id())
    pairs = found.where(score.dice() >= F.col("threshold")).collect()
    assert len({r["at"] for r in pairs}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = {r["item_id"]: set(r["grams"]) for r in items.collect()}
    want = {}
    for r in queries.select("query_id", "threshold", text.index_grams("q").alias("g")).collect():
        for item, g in sets.items():
            both = len(g & set(r["g"]))
            if both and 2 * both / (len(g) + len(set(r["g"]))) >= r["threshold"]:
                want[r["query_id"], item] = both
    assert {(r["query_id"], r["item_id"]): r["overlap"] for r in pairs} == want and len(pairs) == len(want) > 1500
    none = retrieve.ngram_candidates(grams.limit(0), items, F.col("threshold"))
    assert none.count() == 0 and retrieve.ngram_candidates(grams, items.limit(0), F.col("threshold")).count() == 0


def test_only_heavy_keys_are_sliced(spark):
    big = cut_lineage(spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("row")))
    small = spark.createDataFrame([(k, n) for k in range(60) for n in range(2)], "k long, n int")
    heavy = {r["k"]: r["_slices"] for r in scaling.heavy_keys(big, ["k"], 100).collect()}
    assert heavy == {0: 11}
    got = scaling.sliced_join(big, small, ["k"], ["row"], slice_rows=100)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, big.join(small, "k").collect()))
    hot = got.where("k = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    assert hot > 1


def test_bounded_guess_against_plain_count(spark):
    rng = random.Random(8)
    docs = [(f"t{rng.randrange(12) ** 2 // 12}", lang, d) for d in range(300) for lang in ("en", "de") for _ in range(4)]
    docs += docs[:50] + [(None, "en", 5)]
    asked = [(f"q{i}", t, lang) for i in range(20) for lang in ("en", "de")[:1 + i % 2] for t in {f"t{rng.randrange(14)}" for _ in range(1 + i % 4)}]
    qs = spark.createDataFrame([(f"q{i}",) for i in range(21)], "query_id string")
    for limit in (0, 3, 100, 1000):
        out = collect.term_guess(qs, spark.createDataFrame(asked, "query_id string, term string, lang string"),
                                 spark.createDataFrame(docs, "term string, lang string, doc_id long"), limit=limit)
        for r in out.collect():
            n = len({d for i, t, lang in asked if i == r["query_id"] for u, of, d in docs if (u, of) == (t, lang)})
            assert (r["guess_value"], r["guess_type"]) == (min(n, limit), "MoreThan" if n > limit else "Accurate")
        assert out.count() == 21
