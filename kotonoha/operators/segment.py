"""Words out of morphemes, inflections, and aligning kanji with kana."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kotonoha import fixed
from kotonoha.functions import text
from kotonoha.operators import score
from kotonoha.plans.scaling import salted_join


def _const_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _allowed(prev: Column, rule: Column, rules: dict[str, list[str]]) -> Column:
    """May ``rule`` follow ``prev``?  Both must be rules of the set."""
    pairs = sorted({f"{name}>{nxt}" for name, dst in rules.items() for nxt in dst if nxt in rules})
    return F.coalesce(F.concat(prev, F.lit(">"), rule).isin(pairs), F.lit(False))


def is_miru(surface="surface", lexeme="lexeme") -> Column:
    return (F.col(surface) == "み") | (F.col(lexeme) == "みる")


def rule_number(rules: dict[str, list[str]]) -> Column:
    """Place (from 1) among ``rules`` of the rule of a morpheme that opens a group; 0 if it has none."""
    lexeme, surface, cls = F.col("lexeme"), F.col("surface"), F.col("word_class")
    number = {rule: i for i, rule in enumerate(rules, 1)}
    of = lambda rule: F.lit(number.get(rule, 0))
    table = F.create_map(*[x for k, v in fixed.LEXEME_RULES.items() for x in (F.lit(k), of(v))])
    mapped = F.when((surface == "に") & lexeme.isin("た", "だ"), F.lit(None)).otherwise(F.try_element_at(table, lexeme))
    rest = (F.when((surface == "さ") & (lexeme == "する"), of("さ"))
            .when((lexeme == "頂") & (surface == "頂") & (F.col("reading") == "イタダキ"), of("いただき"))
            .when(cls == "Numeral", of("NR")).when(cls == "Noun", of("N"))
            .when(cls == "Adjective", of("AD")).when(cls == "Verb", of("V")).otherwise(F.lit(0)))
    return F.when(surface == "じゃ", of("じゃ")).otherwise(F.coalesce(mapped, rest))


def rule_at_start(rules: dict[str, list[str]] = fixed.RULES) -> Column:
    """Rule of a morpheme that opens a group; null if it has none."""
    return F.get(F.array(*[F.lit(r) for r in rules]), rule_number(rules) - 1)


def group_words(morphemes: DataFrame, rules: dict[str, list[str]] = fixed.RULES, group: str | list[str] = "text_id",
                order: str = "pos", word: str = "word", place: str = "place") -> DataFrame:
    """Adds ``word`` (0, 1, ...) and ``place`` (0 = head of its word); rows without a group or an order are dropped.

    A morpheme joins the word before it when the previous rule allows its own
    rule; everything is decided from the neighbours in the text.  The one rule
    whose meaning depends on its place (みる opens a word as a verb and continues
    one as an auxiliary) alternates inside a run of みる, which the run position
    gives.  All of it are windows over ``group``, so the morphemes are exchanged at most
    once, and not at all if they are already partitioned by a column of ``group``.
    """
    group = [group] if isinstance(group, str) else group
    w = Window.partitionBy(*group).orderBy(order)
    miru = is_miru()
    m = morphemes.dropna(subset=[*group, order])
    m = m.withColumn("_start", rule_at_start(rules)).withColumn("_miru", miru)
    m = m.withColumn("_inner", F.when(F.col("_miru") & F.lit("てみる" in rules), "てみる").otherwise(F.col("_start"))).drop("_miru")
    prev_start, prev_inner = F.lag("_start").over(w), F.lag("_inner").over(w)
    m = (m.withColumn("_if_joined", _allowed(prev_inner, F.col("_inner"), rules))
         .withColumn("_if_head", _allowed(prev_start, F.col("_inner"), rules))).drop("_start", "_inner")
    # where both agree the answer is known; it only depends on the previous
    # answer right after a みる, so a known answer is at most one run away
    m = m.withColumn("_known", F.when(F.col("_if_joined") == F.col("_if_head"), F.col("_if_head")))
    m = m.withColumn("_flip", F.col("_known").isNull().cast("int"))
    m = (m.withColumn("_run", F.sum(1 - F.col("_flip")).over(w)))
    run = Window.partitionBy(*group, "_run").orderBy(order)
    m = m.withColumn("_base", F.first("_known", ignorenulls=True).over(run))
    # inside a run every step negates when the head form allows what the inner
    # form does not, and copies otherwise
    m = m.withColumn("_neg", F.when((F.col("_flip") == 1) & F.col("_if_head"), 1).otherwise(0))
    m = m.withColumn("_negs", F.sum("_neg").over(run))
    joined = F.when(F.col("_flip") == 0, F.col("_known")).otherwise(
        (F.col("_base").cast("int") + F.col("_negs")) % 2 == 1)
    m = m.withColumn("_head", (~F.coalesce(joined, F.lit(False))).cast("int"))
    # runs rise with the order, so that both together sort as the order does and need no further sort
    along = Window.partitionBy(*group).orderBy("_run", order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumn("_word", F.sum("_head").over(along)).withColumn("_row", F.row_number().over(
        Window.partitionBy(*group).orderBy("_run", order)))
    head = F.last(F.when(F.col("_head") == 1, F.col("_row")), ignorenulls=True).over(along)
    m = m.withColumn("_at", F.coalesce(head, F.lit(1)))
    return m.select(*morphemes.columns, (F.col("_word") - 1).alias(word), (F.col("_row") - F.col("_at")).alias(place))


def labelled_morphemes(grouped: DataFrame) -> DataFrame:
    """``grouped`` with ``first`` and ``label`` on the trailing morphemes that open an inflection.

    The trailing morphemes of a word are grouped once more by the pair rules;
    a group of one or two lexemes maps to a label or to nothing.  Heads stay, in groups of their own.
    """
    keys = ["text_id", "word", "_trailing"]
    paired = group_words(grouped.withColumn("_trailing", F.col("place") > 0), fixed.PAIR_RULES, keys, "place", "_pair", "_in_pair")
    w = Window.partitionBy(*keys).orderBy("place")
    size = F.when(F.lead("_in_pair", 1, 0).over(w) == 0, 1).when(F.lead("_in_pair", 2, 0).over(w) == 0, 2)  # null: longer
    paired = paired.withColumn("_size", size).withColumn("_next", F.lead("lexeme").over(w))
    lexemes = F.when(F.col("_size") == 1, F.coalesce("lexeme", F.lit(""))).when(
        F.col("_size") == 2, F.concat_ws("+", "lexeme", "_next"))
    label = F.when((F.col("_size") == 1) & (F.col("surface") == "たら"), "Tara").otherwise(
        F.try_element_at(_const_map(fixed.INFLECTIONS), lexemes))
    opens = F.col("_trailing") & (F.col("_in_pair") == 0)
    return paired.select(*grouped.columns, F.when(opens, F.col("place") - 1).alias("first"), F.when(opens, label).alias("label"))


def inflection_pairs(grouped: DataFrame) -> DataFrame:
    """text_id, word, first, label: inflections of the trailing morphemes."""
    return labelled_morphemes(grouped).where("label is not null").select("text_id", "word", "first", "label")


def coded(rules: dict[str, list[str]]) -> tuple[Column, str]:
    """(the character that stands for a morpheme, the pattern of a word of such characters).

    A character tells the rule of a morpheme that opens a word and whether it is みる, which
    continues words under a rule of its own.  What may follow is told by the character
    before it, or for a みる by its place: the first of a word follows the rule of a head.
    """
    kinds = [(rule, miru) for miru in (False, True) for rule in (None, *rules)]
    char = {kind: chr(0x100 + i) for i, kind in enumerate(kinds)}
    number = rule_number(rules) + F.when(is_miru(), len(rules) + 1).otherwise(0)
    inner = {kind: "てみる" if kind[1] and "てみる" in rules else kind[0] for kind in kinds}
    any_of = lambda found: "[" + "".join(char[k] for k in found) + "]" if found else "(?!)"
    joins = {rule: any_of([k for k in kinds if inner[k] in rules and inner[k] in rules.get(rule, [])]) for rule in (None, *rules)}
    # one step for each set of what may follow; possessive repeats are loops, also over long words
    steps = {}
    for kind in kinds:
        steps.setdefault(joins[inner[kind]], []).append(kind)
    on = "(?:" + "|".join(f"(?<={any_of(before)}){after}" for after, before in steps.items() if after != "(?!)") + ")*+"
    plain = any_of([k for k in kinds if inner[k] == k[0]])
    heads = [f"{char[k]}(?:{joins[k[0]]}{on})?+" for k in kinds if inner[k] != k[0]]
    return F.get(F.array(*[F.lit(char[k]) for k in kinds]), number), "|".join([f"{plain}{on}", *heads])


def opens(codes: Column, pattern: str) -> Column:
    """The places (from 0) of a text's characters that open a word."""
    marks = F.array_join(F.transform(F.regexp_extract_all(codes, F.lit(f"({pattern})"), F.lit(1)),
                                     lambda w: F.rpad(F.lit("1"), F.length(w), F.lit("0"))), "")
    return F.filter(F.transform(F.split(marks, ""), lambda c, i: F.when(c == "1", i)), lambda i: i.isNotNull())


def parts_of_texts(morphemes: DataFrame) -> DataFrame:
    """query_id, pos, inflected, normalised, word_class, pos_simple, inflections,
    has_inflections: one row per word of every text.

    The words and inflections are those of ``group_words`` and ``inflection_pairs``.  The morphemes of a
    text are listed in order, as long as the text itself; their rules, a character
    each, are cut into words by one pattern, and nothing is sorted or counted again.  If places of a
    text repeat, the windows of ``group_words`` decide, which take the rows of a place together.
    """
    placed = morphemes.dropna(subset=["text_id", "pos"]).groupBy("text_id", "pos").agg(F.count(F.lit(1)).alias("n"))
    if not placed.where("n > 1").isEmpty():
        return _parts_by_windows(morphemes)
    (code, words), (pair_code, pair_words) = coded(fixed.RULES), coded(fixed.PAIR_RULES)
    m = morphemes.dropna(subset=["text_id", "pos"])
    m = computed_once(m, **{c: F.col(c) for c in ("surface", "lexeme", "reading", "word_class")}).select("text_id", F.struct(
        "pos", "surface", "lexeme", "reading", "word_class", code.alias("code"), pair_code.alias("pair_code")).alias("m"))
    texts = m.groupBy("text_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    texts = computed_once(texts, _heads=opens(F.array_join(F.col("ms.code"), ""), words))
    cut = F.transform("_heads", lambda h, k: F.slice("ms", h + 1, F.coalesce(F.get("_heads", k + 1), F.size("ms")) - h))
    rows = texts.select("text_id", F.posexplode(cut).alias("word", "ms"))
    trailing = F.array_join(F.transform(F.slice("ms", 2, F.size("ms")), lambda x: x["pair_code"]), "")
    rows = computed_once(rows, _pairs=F.when(F.size("ms") > 1, opens(trailing, pair_words)).otherwise(F.array().cast("array<int>")))

    def label(at: Column, k: Column) -> Column:
        here, size = F.col("ms")[at + 1], F.coalesce(F.get("_pairs", k + 1), F.size("ms") - 1) - at
        lexemes = F.when(size == 1, F.coalesce(here["lexeme"], F.lit(""))).when(
            size == 2, F.concat_ws("+", here["lexeme"], F.get("ms", at + 2)["lexeme"]))
        return F.when((size == 1) & (here["surface"] == "たら"), "Tara").otherwise(F.try_element_at(_const_map(fixed.INFLECTIONS), lexemes))

    rows = computed_once(rows, inflections=F.filter(F.transform("_pairs", label), lambda x: x.isNotNull()))
    return _described(rows)


def _parts_by_windows(morphemes: DataFrame) -> DataFrame:
    """``parts_of_texts`` by windows over rows, one per morpheme."""
    ms = F.array_sort(F.collect_list(F.struct("place", "surface", "lexeme", "reading", "word_class")))
    labels = F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("first", "label"))))
    words = labelled_morphemes(group_words(morphemes)).groupBy("text_id", "word").agg(ms.alias("ms"), labels.alias("labels"))
    return _described(words.withColumn("inflections", F.transform("labels", lambda x: x["label"])))


def _described(words: DataFrame) -> DataFrame:
    """The columns of ``parts_of_texts`` from text_id, word, its morphemes ``ms`` and its ``inflections``."""
    head = F.col("ms")[0]
    cls = F.when((head["word_class"] == "Symbol") & ~head["reading"].rlike(f"^[{text.JP_SYMBOL}]+$"),
                 "Undetected").when(head["word_class"] == "Numeral", "Noun").otherwise(head["word_class"])
    return words.select(
        F.col("text_id").alias("query_id"), F.col("word").cast("bigint").alias("pos"),
        F.array_join(F.transform("ms", lambda x: x["surface"]), "").alias("inflected"),
        head["lexeme"].alias("normalised"), head["reading"].alias("reading"), cls.alias("word_class"),
        F.try_element_at(_const_map(fixed.WORD_CLASS_POS), cls).alias("pos_simple"), "inflections",
        (F.size("inflections") > 0).alias("has_inflections"))


def classify_texts(parts: DataFrame) -> DataFrame:
    """query_id, kind: InflectedWord, Sentence or None."""
    n = parts.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"),
                                      F.bool_or("has_inflections").alias("inflected"))
    return n.select("query_id", "n", F.when(F.col("n") > 1, "Sentence").when(
        F.col("inflected"), "InflectedWord").otherwise("None").alias("kind"))


# -- kanji / kana alignment ----------------------------------------------------------------
KANJI_RUN = f"[{text.HAN}々０-９Ａ-Ｚａ-ｚ0-9A-Za-z]"
SYMBOLS = r"[、。・「」『』（）！？!?,.\s]"


PAIRS = "array<struct<kanji:string,kana:string>>"


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once per row, however often later steps name them.

    They pass through a generator of one row.  Else the optimizer moves the conditions of
    later steps below the column and writes its whole expression out at each place.
    """
    row = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("_once")
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, row).select(*kept, *[F.col(f"_once.{name}").alias(name) for name in columns])


def align_runs(df: DataFrame, kanji: str = "kanji", kana: str = "kana") -> DataFrame:
    """Adds ``pairs`` ARRAY<STRUCT<kanji, kana>>; null when no alignment exists.

    Each row gets its own pattern, made from the runs of its kanji text: a kanji
    run takes at least one kana per character, as few as possible, up to the next
    kana run; earlier runs are never reconsidered; the last kana run ends the
    text; kana in front of the first kanji run are skipped by length.
    """
    size = lambda c: F.length(c).cast("string")
    df = (df.withColumn("_k", text.to_hiragana(F.regexp_replace(F.col(kanji), SYMBOLS, "")))
          .withColumn("_r", F.regexp_replace(F.col(kana), SYMBOLS, "")))
    df = computed_once(df, _lead=F.length(F.regexp_extract("_k", f"^((?:(?!{KANJI_RUN}).)*)", 1)), _segs=F.transform(
        F.regexp_extract_all(F.col("_k"), F.lit(f"({KANJI_RUN}+(?:(?!{KANJI_RUN}).)*)"), F.lit(1)),
        lambda s: F.struct(F.regexp_extract(s, f"^({KANJI_RUN}+)", 1).alias("run"),
                           F.regexp_replace(s, f"^{KANJI_RUN}+", "").alias("tail"))))

    def piece(seg, i):
        take = F.concat(F.lit("(.{"), size(seg["run"]), F.lit(",}"))
        return F.when(i < F.size("_segs") - 1, F.concat(F.lit("(?>"), take, F.lit("?)"), seg["tail"], F.lit(")"))).when(
            seg["tail"] == "", F.lit("(.+)")).otherwise(F.concat(take, F.lit("?)"), seg["tail"]))

    df = computed_once(df, _pattern=F.concat(F.lit("^.{"), F.col("_lead").cast("string"), F.lit("}"),
                                             F.array_join(F.transform("_segs", piece), ""), F.lit("$")),
                       _fold=text.to_hiragana("_r"))
    df = computed_once(df, _sizes=F.transform("_segs", lambda s, i: F.length(F.call_function(
        "regexp_extract", F.col("_fold"), F.col("_pattern"), i + 1))))
    # the sizes of the groups place each reading in the unfolded kana
    start = F.struct(F.col("_lead").alias("at"), F.array().cast(PAIRS).alias("out"))
    walked = F.aggregate(
        F.zip_with("_segs", "_sizes", lambda s, n: F.struct(s["run"].alias("run"), s["tail"].alias("tail"), n.alias("n"))),
        start, lambda acc, x: F.struct(
            (acc["at"] + x["n"] + F.length(x["tail"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                x["run"].alias("kanji"), F.substring(F.col("_r"), acc["at"] + 1, x["n"]).alias("kana")))).alias("out")),
        lambda acc: acc["out"])
    pairs = F.when(F.size("_segs") == 0, F.array().cast(PAIRS)).when(F.expr("_fold rlike _pattern"), walked)
    return computed_once(df, pairs=pairs).drop("_k", "_r", "_lead", "_segs", "_pattern", "_fold", "_sizes")


def split_compounds(pairs: DataFrame, readings: DataFrame) -> DataFrame:
    """pair_id, kanji, kana, parts ARRAY<STRUCT<literal, reading>>; null when the
    reading cannot be split in exactly one way.

    ``readings``: literal, folded (dictionary readings).  The routes of a
    compound live in its row: each character extends every route by the readings
    that continue the kana.
    """
    p = pairs.select("pair_id", "kanji", "kana").distinct()
    ch = p.select("pair_id", "kanji", "kana", F.posexplode(text.chars("kanji")).alias("pos", "literal"))
    options = readings.groupBy("literal").agg(F.collect_set("folded").alias("options"))
    listed = (salted_join(ch, options, ["literal"], ["pair_id"], how="left")
              .groupBy("pair_id", "kanji", "kana")
              .agg(F.array_sort(F.collect_list(F.struct(
                  "pos", "literal", F.coalesce("options", F.array().cast("array<string>")).alias("options"))))
                  .alias("cs")))
    kana = text.to_hiragana("kana")
    start = F.array(F.struct(kana.alias("rest"), F.array().cast("array<string>").alias("done")))

    def extend(routes, c):
        return F.flatten(F.transform(routes, lambda r: F.transform(
            F.filter(c["options"], lambda o: r["rest"].startswith(o)),
            lambda o: F.struct(F.substring(r["rest"], F.length(o) + 1, F.length(r["rest"])).alias("rest"),
                               F.concat(r["done"], F.array(o)).alias("done")))))

    n = F.size("cs")
    listed = listed.withColumn("before", F.aggregate(F.slice("cs", F.lit(1), n - 1), start, extend))
    listed = listed.withColumn("full", extend(F.col("before"), F.col("cs")[n - 1]))
    complete = F.filter("full", lambda r: r["rest"] == "")
    # only the reading of the last character unknown: it takes what is left
    open_end = F.filter("before", lambda r: r["rest"] != "")
    route = F.when(F.size(complete) == 1, complete[0]["done"]).when(
        (F.size(complete) == 0) & (F.size("full") == 0) & (F.size("before") == 1) & (F.size(open_end) == 1),
        F.concat(F.col("before")[0]["done"], F.array(F.col("before")[0]["rest"])))
    same_length = F.length("kanji") == F.length("kana")
    literals = F.transform("cs", lambda c: c["literal"])
    kana_chars = text.chars("kana")
    parts = (F.when(same_length, F.zip_with(literals, kana_chars, lambda l, r: F.struct(
                l.alias("literal"), r.alias("reading"))))
             .when(n == 1, F.array(F.struct(F.col("kanji").alias("literal"), F.col("kana").alias("reading"))))
             .when(route.isNotNull(), F.zip_with(literals, route, lambda l, r: F.struct(
                 l.alias("literal"), r.alias("reading")))))
    return listed.select("pair_id", "kanji", "kana", parts.alias("parts"))


def markup(kanji: Column, reading: Column) -> Column:
    return F.concat(F.lit("["), kanji, F.lit("|"), reading, F.lit("]"))


def markup_text(df: DataFrame, kanji: str = "kanji", kana: str = "kana") -> DataFrame:
    """Adds ``markup``: kanji runs carry their kana, kana runs stay (unchecked);
    null when the texts cannot be aligned."""
    df = align_runs(df, kanji, kana)
    runs = F.regexp_extract_all(F.col(kanji), F.lit(f"({KANJI_RUN}+|(?:(?!{KANJI_RUN}).)+)"), F.lit(1))
    df = df.withColumn("_parts", runs)
    # number the kanji runs so that each picks its pair
    numbered = F.transform("_parts", lambda p, i: F.struct(p.alias("p"), F.size(F.filter(
        F.slice(F.col("_parts"), F.lit(1), i + 1), lambda x: x.rlike(f"^{KANJI_RUN}"))).alias("k")))
    out = F.array_join(F.transform(numbered, lambda x: F.when(
        x["p"].rlike(f"^{KANJI_RUN}"), markup(x["p"], F.get(F.col("pairs"), x["k"] - 1)["kana"]))
        .otherwise(x["p"])), "")
    return df.withColumn("markup", F.when(F.col("pairs").isNotNull(), out)).drop("_parts")


def kana_of_markup(col) -> Column:
    """The kana text of a marked-up text: blocks ``[kanji|r1|r2]`` become r1r2."""
    col = text._c(col)
    blocks = F.regexp_extract_all(col, F.lit(r"(\[[^\]]*\]|[^\[]+)"), F.lit(1))
    return F.array_join(F.transform(blocks, lambda b: F.when(
        b.startswith("["), F.replace(F.regexp_replace(b, r"^\[[^|\]]*\|?|\]$", ""), F.lit("|"), F.lit("")))
        .otherwise(b)), "")


def segments_of_markup(col) -> Column:
    """ARRAY<STRUCT<kanji, kana>>; kana runs have no kanji."""
    blocks = F.regexp_extract_all(text._c(col), F.lit(r"(\[[^\]]*\]|[^\[]+)"), F.lit(1))
    return F.transform(blocks, lambda b: F.struct(
        F.when(b.startswith("["), F.regexp_extract(b, r"^\[([^|\]]*)", 1)).alias("kanji"),
        F.when(b.startswith("["), F.replace(F.regexp_replace(b, r"^\[[^|\]]*\|?|\]$", ""), F.lit("|"), F.lit("")))
        .otherwise(b).alias("kana")))


def checked_markup(df: DataFrame, kanji: str = "kanji", kana: str = "kana") -> DataFrame:
    """Markup that reads back as the given kana, else one block for the whole."""
    def bare(c):
        return text.to_hiragana(F.regexp_replace(c, SYMBOLS, ""))

    df = markup_text(df, kanji, kana)
    good = F.col("markup").isNotNull() & (bare(kana_of_markup("markup")) == bare(F.col(kana)))
    return df.withColumn("markup", F.when(good, F.col("markup")).otherwise(markup(F.col(kanji), F.col(kana))))


def can_merge(surface: Column, furigana: Column) -> Column:
    """The kanji runs of the surface are the kanji blocks of the markup, in order."""
    runs = F.regexp_extract_all(surface, F.lit(f"([{text.HAN}]+)"), F.lit(1))
    blocks = F.transform(F.filter(segments_of_markup(furigana), lambda s: s["kanji"].isNotNull()),
                         lambda s: s["kanji"])
    return (F.size(runs) > 0) & (F.slice(blocks, F.lit(1), F.greatest(F.size(runs), F.lit(1))) == runs)


def merge_markup(surface: Column, furigana: Column) -> Column:
    """Put the blocks of a dictionary markup onto an inflected surface."""
    pieces = F.regexp_extract_all(surface, F.lit(f"([{text.HAN}]+|[^{text.HAN}]+)"), F.lit(1))
    blocks = F.filter(segments_of_markup(furigana), lambda s: s["kanji"].isNotNull())
    numbered = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), F.size(F.filter(
        F.slice(pieces, F.lit(1), i + 1), lambda x: x.rlike(f"^[{text.HAN}]"))).alias("k")))
    return F.when(can_merge(surface, furigana), F.array_join(F.transform(numbered, lambda x: F.when(
        x["p"].rlike(f"^[{text.HAN}]"), markup(x["p"], F.get(blocks, x["k"] - 1)["kana"]))
        .otherwise(x["p"])), ""))


def reading_markup(morphemes: DataFrame, entries: DataFrame, names: DataFrame) -> DataFrame:
    """text_id, pos, markup: markup of morphemes with kanji, from the best word
    with exactly that reading, else from a name written exactly so.

    ``entries``: form (any reading), main, kana, furigana, pos (array), common,
    jlpt_lvl, reading_freq, sequence; ``names``: kanji, kana, sequence.
    """
    m = morphemes.where(text.has_kanji("surface")).select(
        "text_id", "pos", "surface", F.col("reading").alias("form"),
        F.try_element_at(_const_map(fixed.WORD_CLASS_POS), F.col("word_class")).alias("want"))
    asked = m.select("form", "want").distinct()
    cand = salted_join(entries.withColumnRenamed("pos", "entry_pos"), asked, ["form"], ["sequence"])
    s = score.reading_choice_score(
        F.col("main") == F.col("form"), (F.length("main") == 1) & text.is_kanji("main"),
        F.col("reading_freq"), F.array_contains("entry_pos", F.col("want")), F.col("want").isNotNull(),
        F.col("common"), F.col("jlpt_lvl").isNotNull())
    best = cand.withColumn("s", s).groupBy("form", "want").agg(
        F.max_by("furigana", F.struct(F.col("s"), -F.col("sequence"))).alias("word_markup"))
    name = names.where("kanji is not null").groupBy(F.col("kanji").alias("form")).agg(
        F.min_by(markup(F.col("kanji"), F.col("kana")), "sequence").alias("name_markup"))
    j = (m.join(best, (m.form == best.form) & m.want.eqNullSafe(best.want), "left")
         .select(m.text_id, m.pos, m.surface, m.form, "word_markup")
         .join(name, "form", "left"))
    furi = F.coalesce("word_markup", "name_markup")
    out = F.when(furi.isNull(), F.col("surface")).when(
        can_merge(F.col("surface"), furi), merge_markup(F.col("surface"), furi)).otherwise(furi)
    return j.select("text_id", "pos", "surface", out.alias("markup"))
