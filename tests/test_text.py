import pytest
from pyspark.sql import functions as F

from kotonoha.functions import kana, packing, text
from kotonoha.operators import reshape, segment


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(fn("x").alias("y")).first()["y"]


@pytest.mark.parametrize("word,expected", [
    ("shinjitakunakatta", True), ("ongakunante", True), ("shukudai", True), ("akogaredake", True),
    ("daijoubudesuyo", True), ("denshaninotteru", True), ("korewanagaibunshodayone", True),
    ("shinjitai", True), ("ongaku", True), ("sore wa ongaku desu yo", True), ("kirishima", True),
    ("deine oma", True), ("kyotou", True), ("onsen", True), ("kanpeki", True), ("chokusetsu", True),
    ("kind", False), ("jinjc", False), ("gx", False), ("kochen macht spaß", False), ("kinderarbeit", False),
    ("hausaufgaben sind toll", False), ("this is a laptop", False),
    ("Mir fallen keine weiteren sätze ein lol", False), ("I can't think of proper sentences lol", False)])
def test_could_be_romaji(spark, word, expected):
    assert one(spark, word, kana.could_be_romaji) is expected


@pytest.mark.parametrize("word,hira", [
    ("kore", "これ"), ("tokasu", "とかす"), ("kisuu", "きすう"), ("daijoubu", "だいじょうぶ"), ("jikan", "じかん"),
    ("kanjiru", "かんじる"), ("ongaku", "おんがく"), ("jitensha", "じてんしゃ"), ("suki", "すき"), ("Kitte", "きって"),
    ("konna", "こんあ")])
def test_romaji(spark, word, hira):
    assert one(spark, word, kana.search_hiragana) == hira


def test_kana_to_romaji(spark):
    assert one(spark, "ちょっと", kana.to_romaji) == "chotto"
    assert one(spark, "ジテンシャ", kana.to_romaji) == "jitensha"
    assert one(spark, "しんぶん", lambda c: kana.romaji_prefix(F.lit("SHIN"), c)) is True


def test_folding(spark):
    assert one(spark, "ＡＢ１カナ", text.fold_reading) == "AB1かな"
    assert one(spark, "a.b/c・d", text.strip_punctuation) == "a b c d"
    assert one(spark, "Foo, (bar)  baz", text.terms) == ["foo", "bar", "baz"]
    assert one(spark, "to (a) x (b) y", text.drop_parentheses) == "to  y"
    assert one(spark, "to eat", text.drop_leading_to) == "eat"


def test_ngrams(spark):
    assert one(spark, "abc", text.ngrams) == ["␣␣a", "␣ab", "abc", "bc␣", "c␣␣"]
    assert one(spark, "ab", text.ngrams) == ["␣a", "ab", "b␣"]
    assert one(spark, "a", text.ngrams) == ["a"]
    assert one(spark, " ", text.ngrams) == []
    assert one(spark, "huhu", lambda c: text.ngrams(c, 2)).count("hu") == 2


@pytest.mark.parametrize("word", ["musik", "ki"])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngram_dims(spark, word, n):
    got = len(one(spark, word, lambda c: text.ngrams(c, n)))
    size = min(n, len(word))
    assert got == 2 * (size - 1) + len(word) - size + 1


def test_script(spark):
    assert one(spark, "음악", text.is_hangul) is True
    assert one(spark, "", text.is_hangul) is False
    assert one(spark, "音楽", text.script_class) == "kanji"
    assert one(spark, "食べる", text.script_class) == "mixed"
    assert one(spark, "ab音楽", text.japanese_percent) == 50
    assert one(spark, "漢字かな漢", text.alphabet_runs) == ["漢字", "かな", "漢"]
    assert one(spark, "a b/ä-_.*", text.url_encode) == "a%20b%2F%C3%A4%2D%5F%2E%2A"


def test_pack_ids(spark):
    df = spark.createDataFrame([(1, 70), (10, 6), (0, 0), (255, 255), (1, 2)], "s int, g int")
    p = df.withColumn("p", packing.pack_gloss_id("s", "g"))
    for r in p.select("*", packing.unpack_sense_id("p").alias("s2"), packing.unpack_gloss_id("p").alias("g2")).collect():
        assert (r.s, r.g) == (r.s2, r.g2)


@pytest.mark.parametrize("code,ok", [("ichi1", True), ("nf10", True), ("nf4", True), ("news10", True),
                                     ("ichi", False), ("nf", False), ("news", False)])
def test_priority(spark, code, ok):
    back = one(spark, code, lambda c: packing.format_priority(packing.parse_priority(c)))
    assert back == (code if ok else None)


@pytest.mark.parametrize("values", [[], [0], [6, 6], [1, 6, 0], [1, 2, 3, 4]])
def test_pitch_values(spark, values):
    df = spark.createDataFrame([(values,)], "v array<int>")
    row = df.select(packing.unpack_pitch(packing.pack_pitch("v")).alias("v")).first()
    assert row.v == values


@pytest.mark.parametrize("word,parts", [("ファイナル", ["ファ", "イ", "ナ", "ル"]), ("きょうかしょ", ["きょ", "う", "か", "しょ"]),
                                        ("これがすき", list("これがすき")), ("", [])])
def test_mora(spark, word, parts):
    assert one(spark, word, packing.mora) == parts


def test_pitch_parts(spark):
    def spans(drop):
        return [tuple(x) for x in one(spark, "きょうかしょ", lambda c: packing.pitch_parts(c, F.lit(drop)))]
    assert spans(0) == [("きょ", False), ("うかしょ", True)]
    assert spans(1) == [("きょ", True), ("うかしょ", False)]
    assert spans(3) == [("きょ", False), ("うか", True), ("しょ", False)]
    assert one(spark, "あ", lambda c: packing.pitch_parts(c, F.lit(7))) is None


@pytest.mark.parametrize("literal,reading,kun,expected", [
    ("長", "ちょう", False, "長"), ("長", "なが.い", True, "長い"), ("車", "くるま", True, "車"), ("大", "-おお.いに", True, "大いに")])
def test_reading_with_literal(spark, literal, reading, kun, expected):
    df = spark.createDataFrame([(literal, reading, kun)], "l string, r string, k boolean")
    assert df.select(reshape.reading_with_literal("l", "r", "k").alias("x")).first().x == expected


@pytest.mark.parametrize("kanji,kana_text,expected", [
    ("", "", []), ("音楽は好き", "おんがくはすき", [("音楽", "おんがく"), ("好", "す")]),
    ("お金を払いたくない", "おかねをはらいたくない", [("金", "かね"), ("払", "はら")]),
    ("おかねをはらいたくない", "おかねをはらいたくない", []), ("漢字", "かんじ", [("漢字", "かんじ")]),
    ("水気", "みずけ", [("水気", "みずけ")]),
    ("いつも眠い感じがします", "いつもねむいかんじがします", [("眠", "ねむ"), ("感", "かん")]),
    ("今日もとても眠い", "きょうもとてもねむい", [("今日", "きょう"), ("眠", "ねむ")]), ("５日", "いつか", [("５日", "いつか")]),
    ("かば、夕べに", "かばゆうべに", [("夕", "ゆう")]), ("音楽", "オンガク", [("音楽", "オンガク")]), ("音は", "おん", None)])
def test_align_runs(spark, kanji, kana_text, expected):
    df = segment.align_runs(spark.createDataFrame([(kanji, kana_text)], "kanji string, kana string"))
    got = df.first().pairs
    assert (None if got is None else [tuple(p) for p in got]) == expected


def test_markup(spark):
    df = spark.createDataFrame([("音楽は好き", "おんがくはすき"), ("音は", "おん")], "kanji string, kana string")
    rows = segment.checked_markup(df).select("markup").collect()
    assert rows[0].markup == "[音楽|おんがく]は[好|す]き"
    assert rows[1].markup == "[音は|おん]"
    assert one(spark, "[音楽|おん|がく]は[好|す]き", segment.kana_of_markup) == "おんがくはすき"
    seg = one(spark, "[音楽|おん|がく]は", segment.segments_of_markup)
    assert [tuple(s) for s in seg] == [("音楽", "おんがく"), (None, "は")]
    df = spark.createDataFrame([("行った", "[行|い]く"), ("買った", "[行|い]く")], "s string, f string")
    got = [r.m for r in df.select(segment.merge_markup(F.col("s"), F.col("f")).alias("m")).collect()]
    assert got == ["[行|い]った", None]


def test_split_compounds(spark):
    readings = spark.createDataFrame([("音", "おん"), ("音", "おと"), ("楽", "がく"), ("楽", "たの"), ("今", "いま"), ("日", "ひ")],
                                     "literal string, folded string")
    pairs = spark.createDataFrame([(1, "音楽", "おんがく"), (2, "今日", "きょう"), (3, "音日", "おんにち"), (4, "木", "もく")],
                                  "pair_id int, kanji string, kana string")
    got = {r.pair_id: r.parts and [tuple(p) for p in r.parts] for r in segment.split_compounds(pairs, readings).collect()}
    assert got[1] == [("音", "おん"), ("楽", "がく")]
    assert got[2] is None
    assert got[3] == [("音", "おん"), ("日", "にち")]
    assert got[4] == [("木", "もく")]
