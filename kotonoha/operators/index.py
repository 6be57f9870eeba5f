"""Index-building jobs: postings, frequencies, vectors and tag tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha import fixed
from kotonoha.functions import text
from kotonoha.plans.scaling import by_key, salted_join, sliced_join
from kotonoha.session import cut_lineage


# -- character n-grams -----------------------------------------------------------
def ngram_items(df: DataFrame, item: str, col: str, n: int = fixed.NGRAM_N,
                posting: Column | None = None) -> DataFrame:
    """posting, item_id, grams, n_grams: one row per item, no shuffle."""
    posting = F.lit("all") if posting is None else posting
    return (df.select(posting.alias("posting"), F.col(item).alias("item_id"),
                      text.index_grams(col, n).alias("grams"))
            .withColumn("n_grams", F.size("grams")))


def ngram_postings(df: DataFrame, item: str, col: str, n: int = fixed.NGRAM_N,
                   posting: Column | None = None) -> DataFrame:
    """posting, gram, item_id, n_grams: one row per item and distinct n-gram.

    Grams are made distinct inside the row, so building the postings of items
    with one text each needs no shuffle at all.
    """
    return (ngram_items(df, item, col, n, posting)
            .select("posting", F.explode("grams").alias("gram"), "item_id", "n_grams"))


def multi_text_items(df: DataFrame, item: str, col: str, n: int = fixed.NGRAM_N) -> DataFrame:
    """item_id, grams, n_grams for items with several texts (one row per text)."""
    grams = df.select(F.col(item).alias("item_id"), F.explode(text.index_grams(col, n)).alias("g"))
    return (grams.groupBy("item_id").agg(F.collect_set("g").alias("grams"))
            .withColumn("n_grams", F.size("grams")))


def ngram_frequency(df: DataFrame, col: str, n: int = fixed.NGRAM_N) -> DataFrame:
    """gram, freq: every occurrence counts."""
    return (df.select(F.explode(text.ngrams(col, n)).alias("gram"))
            .groupBy("gram").agg(F.count(F.lit(1)).alias("freq")))


def term_frequency(df: DataFrame, col: str) -> DataFrame:
    """term, freq of a column of single terms."""
    return (df.select(F.col(col).alias("term")).groupBy("term")
            .agg(F.count(F.lit(1)).alias("freq")))


def with_total(freq: DataFrame) -> DataFrame:
    """Attach the number of insertions (one row, always broadcast)."""
    total = freq.agg(F.sum("freq").alias("total"))
    return freq.crossJoin(F.broadcast(total))


def drop_rare(freq: DataFrame, threshold: int) -> DataFrame:
    return freq.where(F.col("freq") >= threshold)


def inverse_frequency(freq: Column, total: Column, unknown_as_one: bool = True) -> Column:
    """log2(total / freq); an unknown term counts once, or is null."""
    f = F.coalesce(freq, F.lit(1)) if unknown_as_one else freq
    return F.log2(total / f)


def feature_vectors(df: DataFrame, item: str, col: str, freq: DataFrame,
                    n: int = fixed.NGRAM_N, weight=inverse_frequency) -> DataFrame:
    """item_id, gram, weight: one sparse weight per distinct n-gram.

    ``weight(freq, total)`` is a Column function; pass one returning a constant
    for unweighted vectors.
    """
    grams = df.select(F.col(item).alias("item_id"), F.explode(text.gram_set(col, n)).alias("gram"))
    total = freq.agg(F.sum("freq").alias("total"))
    joined = salted_join(grams, freq, ["gram"], ["item_id"], how="left")
    return (joined.crossJoin(F.broadcast(total))
            .select("item_id", "gram", weight(F.col("freq"), F.col("total")).alias("weight")))


def unit_weight(_freq: Column, _total: Column) -> Column:
    return F.lit(1.0)


def packed_vectors(df: DataFrame, keys: list[str], col: str, freq: DataFrame,
                   n: int = fixed.NGRAM_N) -> DataFrame:
    """keys..., col, vec ARRAY<STRUCT<gram, w>>, w_sum: the vector kept in the row.

    The arrays are as long as the text, so grouping them back is bounded by one
    text per row.
    """
    rows = df.select(*keys, col).distinct()
    grams = rows.select(*keys, col, F.explode(text.gram_set(col, n)).alias("gram"))
    total = freq.agg(F.sum("freq").alias("total"))
    joined = (salted_join(grams, freq, ["gram"], [*keys, col], how="left")
              .crossJoin(F.broadcast(total))
              .withColumn("w", inverse_frequency(F.col("freq"), F.col("total"))))
    return joined.groupBy(*keys, col).agg(
        F.collect_list(F.struct("gram", "w")).alias("vec"), F.sum("w").alias("w_sum"))


# -- characters --------------------------------------------------------------------
def char_postings(df: DataFrame, item: str, col: str) -> DataFrame:
    """ch, item_id: the characters of every reading."""
    return df.select(F.explode(F.array_distinct(text.chars(col))).alias("ch"),
                     F.col(item).alias("item_id")).distinct()


#: Marks of a reading's ends, and of a wildcard between literal pieces.
HEAD, TAIL, CUT = "\x02", "\x03", "\x01"


def pairs(col: Column) -> Column:
    """Neighbouring characters of a text."""
    several = F.transform(F.sequence(F.lit(1), F.greatest(F.length(col) - 1, F.lit(1))), lambda i: F.substring(col, i, F.lit(2)))
    return F.when(F.length(col) > 1, several).otherwise(F.array().cast("array<string>"))


def ends(col: Column) -> Column:
    """A marked end with the two characters next to it."""
    return F.array_compact(F.array(F.when((F.length(col) > 2) & col.startswith(HEAD), F.left(col, F.lit(3))),
                                   F.when((F.length(col) > 2) & col.endswith(TAIL), F.right(col, F.lit(3)))))


def wildcard_grams(col) -> Column:
    """Distinct characters of a reading, its pairs with both ends marked, and the first and last two characters with their mark."""
    marked = F.concat(F.lit(HEAD), text._c(col), F.lit(TAIL))
    return F.array_distinct(F.concat(text.chars(col), pairs(marked), ends(marked)))


def wildcard_postings(df: DataFrame, item: str, col: str) -> DataFrame:
    """gram, item_id, reading: what a wildcard search looks up; a reading travels with its grams."""
    readings = by_key(df.select(F.col(item).alias("item_id"), F.col(col).alias("reading")).distinct(), "item_id")
    return readings.select(F.explode(wildcard_grams("reading")).alias("gram"), "item_id", "reading")


# -- kanji readings -----------------------------------------------------------------
def dictionary_readings(kanji: DataFrame, with_nanori: bool = False) -> DataFrame:
    """literal, reading (as written), folded: on and kun readings, and for names
    the nanori; each with its dash-free, folded forms."""
    lists = F.concat("kunyomi", "onyomi", "nanori") if with_nanori else F.concat("kunyomi", "onyomi")
    r = kanji.select("literal", F.explode(F.array_distinct(lists)).alias("reading"))
    bare = text.to_hiragana(F.replace(F.col("reading"), F.lit("-"), F.lit("")))
    forms = F.array_distinct(F.array(F.split(bare, r"\.")[0], F.replace(bare, F.lit("."), F.lit(""))))
    return r.select("literal", "reading", F.explode(forms).alias("folded")).distinct()


def reading_frequency(observations: DataFrame, kanji: DataFrame) -> DataFrame:
    """literal, reading, freq, total from (obs_id, literal, kana) rows.

    Every dictionary reading that matches an observation is counted; the total
    of the kanji grows by one per observation that matched any.
    """
    dims = dictionary_readings(kanji)
    # observed pairs are counted before the join, so a hot pair is one row
    pairs = (observations.withColumn("folded", text.to_hiragana("kana"))
             .groupBy("literal", "folded").agg(F.count(F.lit(1)).alias("cnt")))
    hit = pairs.join(dims, ["literal", "folded"])
    per_reading = (hit.select("literal", "folded", "reading", "cnt").distinct()
                   .groupBy("literal", "reading").agg(F.sum("cnt").alias("freq")))
    totals = (hit.select("literal", "folded", "cnt").distinct()
              .groupBy("literal").agg(F.sum("cnt").alias("total")))
    return per_reading.join(totals, "literal")


def normalised_reading_frequency(freq: Column, total: Column, threshold: int = 200) -> Column:
    return F.when(total >= threshold, freq / total)


def reading_keys(aligned: DataFrame, kanji: DataFrame | None = None) -> DataFrame:
    """key (literal + reading), item_id from aligned (item_id, literal, reading).

    With a kanji table the key carries every dictionary reading, as written, that
    the aligned kana stands for; that is what a search asks for.
    """
    if kanji is None:
        return aligned.select(F.concat("literal", "reading").alias("key"), "item_id").distinct()
    seen = aligned.select("item_id", "literal", text.to_hiragana("reading").alias("folded")).distinct()
    written = salted_join(seen, dictionary_readings(kanji), ["literal", "folded"], ["item_id"])
    return written.select(F.concat("literal", "reading").alias("key"), "item_id").distinct()


def gloss_terms(words: DataFrame) -> DataFrame:
    """doc_id, lang, term, tf: the words of all glosses and each whole gloss."""
    g = words.select(F.col("sequence").alias("doc_id"), F.explode("senses").alias("s")).select(
        "doc_id", F.col("s.language").alias("lang"), F.explode("s.glosses.gloss").alias("gloss"))
    phrase = text.drop_leading_to(text.strip_punctuation(F.trim("gloss")))
    terms = F.filter(F.concat(F.array(phrase), F.split(phrase, " ")), lambda t: t != "")
    return (g.select("doc_id", "lang", F.explode(terms).alias("term"))
            .groupBy("doc_id", "lang", "term").agg(F.count(F.lit(1)).alias("tf")))


# -- term vectors ---------------------------------------------------------------------
def document_counts(doc_terms: DataFrame) -> DataFrame:
    """lang, n_docs (one row per language of the inventory)."""
    return (doc_terms.select("lang", "doc_id").distinct().groupBy("lang")
            .agg(F.count(F.lit(1)).alias("n_docs")))


#: Documents of one term that a task takes.
SLICE_DOCUMENTS = 50_000


def term_vectors(doc_terms: DataFrame) -> DataFrame:
    """posting, doc_id, term, weight = tf * log2(N / df), N and df per language.

    The terms are stored, as they are counted, their documents are counted and both are joined.
    """
    doc_terms = cut_lineage(doc_terms, "doc-terms")
    df_ = doc_terms.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = (df_.join(F.broadcast(document_counts(doc_terms)), "lang")
           .select("lang", "term", F.log2(F.col("n_docs") / F.col("df")).alias("idf")))
    joined = sliced_join(doc_terms, idf, ["lang", "term"], ["doc_id"], SLICE_DOCUMENTS)
    return joined.select(F.col("lang").alias("posting"), "doc_id", "term",
                         (F.col("tf") * F.col("idf")).alias("weight"))


def vector_norms(vectors: DataFrame) -> DataFrame:
    """doc_id, norm of the term vectors."""
    return vectors.groupBy("posting", "doc_id").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


# -- tag tables --------------------------------------------------------------------------
def word_pos(words: DataFrame, pos_dim: DataFrame) -> DataFrame:
    """sequence, pos_simple: the distinct simple parts of speech of each word."""
    codes = words.select("sequence", F.explode(F.array_distinct(F.flatten(
        F.transform("senses", lambda s: s["part_of_speech"])))).alias("code"))
    return codes.join(F.broadcast(pos_dim), "code").select("sequence", "pos_simple").distinct()


def main_reading(word_reading="reading") -> Column:
    return F.coalesce(F.col(f"{word_reading}.kanji.reading"), F.col(f"{word_reading}.kana.reading"))


def word_tags(words: DataFrame, pos_dim: DataFrame) -> DataFrame:
    """tag_type, tag, word_id: level, part of speech, misc, katakana, irregular."""
    def rows(kind, tag, frame):
        return frame.select(F.lit(kind).alias("tag_type"), tag.cast("string").alias("tag"),
                            F.col("sequence").alias("word_id"))

    misc = words.select("sequence", F.explode(F.array_distinct(F.filter(
        F.transform("senses", lambda s: s["misc"]), lambda m: m.isNotNull()))).alias("misc"))
    irregular = words.where(F.exists("senses", lambda s: F.arrays_overlap(
        s["part_of_speech"], F.array(*[F.lit(c) for c in fixed.IRREGULAR_ICHIDAN_CODES]))))
    parts = [
        rows("jlpt", F.col("jlpt_lvl"), words.where("jlpt_lvl is not null")),
        rows("pos", F.col("pos_simple"), word_pos(words, pos_dim)),
        rows("misc", F.col("misc"), misc),
        rows("flag", F.lit("Katakana"), words.where(text.is_katakana(main_reading()))),
        rows("flag", F.lit("IrregularIchidan"), irregular),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sentence_tags(sentences: DataFrame) -> DataFrame:
    """tag_type, tag, item_id for sentences."""
    tags = sentences.select(F.lit("sentence").alias("tag_type"),
                            F.explode(F.array_distinct("tags")).alias("tag"),
                            F.col("id").alias("item_id"))
    jlpt = sentences.where("jlpt_guess is not null").select(
        F.lit("jlpt").alias("tag_type"), F.col("jlpt_guess").cast("string").alias("tag"),
        F.col("id").alias("item_id"))
    return tags.unionByName(jlpt)


def kanji_tags(kanji: DataFrame, lessons: DataFrame | None = None) -> DataFrame:
    """tag_type, tag, item_id for kanji; ``lessons`` has (lesson, literal)."""
    jlpt = kanji.where("jlpt is not null").select(
        F.lit("jlpt").alias("tag_type"), F.col("jlpt").cast("string").alias("tag"),
        F.col("literal").alias("item_id"))
    if lessons is None:
        return jlpt
    return jlpt.unionByName(lessons.select(
        F.lit("genki").alias("tag_type"), F.col("lesson").cast("string").alias("tag"),
        F.col("literal").alias("item_id")))


def tag_cardinalities(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag_type", "tag").agg(F.count(F.lit(1)).alias("freq"))


# -- parts and meanings --------------------------------------------------------------------
def part_postings(kanji: DataFrame) -> DataFrame:
    """radical, literal, stroke_count."""
    return kanji.select(F.explode("parts").alias("radical"), "literal", "stroke_count")


def meaning_postings(radicals: DataFrame) -> DataFrame:
    """term, literal, freq from radicals with a list of meanings."""
    return radicals.select(F.explode("meanings").alias("term"), "literal",
                           F.col("frequency").alias("freq"))


def name_posting(col) -> Column:
    """Posting of a name reading or query: kana, mixed or kanji."""
    return F.when(text.is_kanji(col), "kanji").when(text.has_kanji(col), "mixed").otherwise("kana")
