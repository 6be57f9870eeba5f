"""Index-building jobs (IDX), and sources and sinks (SRC, SNK)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kotonoha.catalog import sql_views as q
from kotonoha.catalog.registry import query
from kotonoha.functions import text
from kotonoha.operators import index, segment
from kotonoha.plans.scaling import by_key
from kotonoha.session import scratch_path
from kotonoha.sources import records, views


# -- sources and sinks --------------------------------------------------------------------
@query("src1_record_tables", """SELECT 'words' AS kind, count(*) AS n, CAST(sum(sequence) AS BIGINT) AS ids FROM v_words
    UNION ALL SELECT 'names', count(*), CAST(sum(sequence) AS BIGINT) FROM v_names
    UNION ALL SELECT 'sentences', count(*), CAST(sum(id) AS BIGINT) FROM v_sentences
    UNION ALL SELECT 'kanji', count(*), CAST(sum(idx) AS BIGINT) FROM v_kanji""")
def src1(spark, sf):
    """Store all four record tables and load them with their declared schemas."""
    made = {"words": (views.words, "sequence"), "names": (views.names, "sequence"),
            "sentences": (views.sentences, "id"), "kanji": (views.kanji, "radical.id")}
    out = None
    for kind, (make, key) in made.items():
        path = scratch_path(spark, kind)
        records.store(make(spark, sf), path)
        loaded = records.load_records(spark, kind, path)
        row = loaded.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"),
                         F.sum(F.col(key).cast("bigint")).alias("ids"))
        out = row if out is None else out.unionByName(row)
    return out


#: Elements of one XML file, which a single task reads whole.
XML_RECORDS = 10_000


def _as_xml(df, row_tag, spark):
    """Write rows as elements of well-formed XML files of bounded size; returns the folder."""
    path = scratch_path(spark, f"raw-{row_tag}")
    df.write.format("xml").option("rowTag", row_tag).option("rootTag", f"{row_tag}s").option("maxRecordsPerFile", XML_RECORDS).save(path)
    return path


@query("src2_land_entries", """SELECT w.sequence, CAST(CASE WHEN kanji IS NULL THEN 1 ELSE 2 END AS BIGINT) AS n_elements,
    coalesce(kanji, kana) AS last_value, p_name AS gloss, array_to_string(pos_codes, ',') AS pos, misc FROM v_words w""")
def src2(spark, sf):
    """Write word entries as XML elements and land them."""
    w = views.words(spark, sf)
    dicts = F.filter(F.array("reading.kana", "reading.kanji"), lambda d: d.isNotNull())
    element = F.transform(dicts, lambda d: F.struct(d["kanji"].alias("kanji"), d["reading"].alias("value"),
                                                    d["priorities"].alias("priority")))
    sense = F.transform("senses", lambda s: F.struct(
        s["id"].alias("id"), F.transform(s["glosses"], lambda g: F.struct(
            s["language"].alias("language"), g["gloss"].alias("value"))).alias("gloss"),
        s["misc"].alias("misc"), s["part_of_speech"].alias("part_of_speech")))
    path = _as_xml(w.select("sequence", element.alias("element"), sense.alias("sense")), "entry", spark)
    e = records.land_raw(spark, "entry", path)
    return e.select("sequence", F.size("element").alias("n_elements"), F.element_at("element", -1)["value"].alias("last_value"),
                    F.col("sense")[0]["gloss"][0]["value"].alias("gloss"),
                    F.array_join(F.col("sense")[0]["part_of_speech"], ",").alias("pos"), F.col("sense")[0]["misc"].alias("misc"))


@query("src3_land_names", "SELECT sequence, kana, kanji, transcription, array_to_string(name_type, ',') AS types FROM v_names")
def src3(spark, sf):
    n = views.names(spark, sf).select("sequence", F.col("kana").alias("kana_element"), F.col("kanji").alias("kanji_element"),
                                      "transcription", "name_type")
    r = records.land_raw(spark, "name", _as_xml(n, "name", spark))
    return r.select("sequence", F.col("kana_element").alias("kana"), F.col("kanji_element").alias("kanji"), "transcription",
                    F.array_join("name_type", ",").alias("types"))


@query("src4_land_characters", """SELECT literal, array_to_string(onyomi, ',') AS onyomi, array_to_string(kunyomi, ',') AS kunyomi,
    CAST(frequency AS BIGINT) AS frequency, CAST(stroke_count AS BIGINT) AS stroke_count FROM v_kanji""")
def src4(spark, sf):
    k = views.kanji(spark, sf).select("literal", F.col("onyomi").alias("on_reading"), F.col("kunyomi").alias("kun_reading"),
                                      "stroke_count", "frequency")
    return records.land_raw(spark, "character", _as_xml(k, "character", spark)).select(
        "literal", F.array_join("on_reading", ",").alias("onyomi"), F.array_join("kun_reading", ",").alias("kunyomi"), "frequency", "stroke_count")


@query("src5_hashtag_lines", "SELECT tag, freq, array_to_string([target], ',') AS targets FROM v_hashtags")
def src5(spark, sf):
    t = records.parse_hashtags(views.hashtag_lines(spark, sf))
    return t.select("tag", F.col("freq").cast("double").alias("freq"), F.array_join(F.col("s_targets").cast("array<string>"), ",").alias("targets"))


@query("src6_radical_dimension", f"""SELECT CAST(stroke_count AS BIGINT) AS stroke_count, CAST(sum(freq) AS BIGINT) AS seen, count(DISTINCT literal) AS n FROM
    (SELECT freq, unnest(string_split({q.han('term')}, '')) AS literal FROM v_terms) JOIN v_rad_dim USING (literal) GROUP BY stroke_count""")
def src6(spark, sf):
    """How often the radicals of each stroke count occur in the headwords."""
    ch = views.terms(spark, sf).select("freq", F.explode(text.chars(views.han("term"))).alias("literal"))
    per = ch.groupBy("literal").agg(F.sum("freq").alias("freq"))
    return per.join(F.broadcast(records.radical_dimension(spark)), "literal").groupBy("stroke_count").agg(
        F.sum("freq").alias("seen"), F.count(F.lit(1)).alias("n"))


@query("src7_newest_news", "SELECT id, title, short, creation_time FROM v_news ORDER BY creation_time DESC, id DESC LIMIT 15")
def src7(spark, sf):
    return records.keep_newest(views.news(spark, sf)).select("id", "title", "short", "creation_time")


@query("src8_language_partitions", "SELECT lang, term, freq FROM v_terms WHERE lang IN ('de', 'fr')")
def src8(spark, sf):
    path = scratch_path(spark, "terms-by-language")
    records.store(views.terms(spark, sf), path, partition_by=["lang"], cluster_by=["lang", "term"])
    return records.load_by_language(spark, path, ["de", "fr"]).select("lang", "term", "freq")


@query("snk1_persist_index", "SELECT lang AS posting, gram, item_id, CAST(n_grams AS BIGINT) AS n_grams FROM v_grams")
def snk1(spark, sf):
    path = scratch_path(spark, "gram-postings")
    records.store(views.gram_postings(spark, sf), path, partition_by=["posting"], cluster_by=["posting", "gram", "item_id"])
    return spark.read.parquet(path).select("posting", "gram", "item_id", "n_grams")


# -- index tables ----------------------------------------------------------------------------
@query("idx1_ngram_postings", "SELECT lang AS posting, gram, count(*) AS items, CAST(sum(n_grams) AS BIGINT) AS sizes FROM v_grams GROUP BY ALL")
def idx1(spark, sf):
    return views.gram_postings(spark, sf).groupBy("posting", "gram").agg(
        F.count(F.lit(1)).alias("items"), F.sum("n_grams").alias("sizes"))


GFREQ = {"v_gfreq": f"SELECT gram, count(*) AS freq FROM (SELECT unnest({q.grams('term')}) AS gram FROM v_terms) GROUP BY gram"}


@query("idx2_ngram_frequency", "SELECT gram, freq, CAST(sum(freq) OVER () AS BIGINT) AS total FROM v_gfreq", GFREQ)
def idx2(spark, sf):
    return index.with_total(index.ngram_frequency(views.terms(spark, sf), "term"))


@query("idx3_drop_rare", "SELECT gram, freq FROM v_gfreq WHERE freq >= 5", GFREQ)
def idx3(spark, sf):
    return index.drop_rare(index.ngram_frequency(views.terms(spark, sf), "term"), 5)


@query("idx4_inverse_frequency", """SELECT w AS term, round(log2(total / coalesce(freq, 1)), 6) AS inv, round(log2(total / freq), 6) AS inv_or_null FROM
    (SELECT DISTINCT unnest(""" + q.tokens("text") + """) AS w FROM conversations) LEFT JOIN
    (SELECT term AS w, CAST(sum(freq) AS BIGINT) AS freq FROM v_terms GROUP BY term) USING (w), (SELECT sum(freq) AS total FROM v_terms)""")
def idx4(spark, sf):
    """Inverse document-collection frequency of every word of the conversations."""
    words = views.table(spark, sf, "conversations").select(F.explode(text.letter_terms("text")).alias("term")).distinct()
    freq = views.terms(spark, sf).groupBy("term").agg(F.sum("freq").alias("freq"))
    total = freq.agg(F.sum("freq").alias("total"))
    j = words.join(freq, "term", "left").crossJoin(F.broadcast(total))
    return j.select("term", index.inverse_frequency(F.col("freq"), F.col("total")).alias("inv"),
                    index.inverse_frequency(F.col("freq"), F.col("total"), False).alias("inv_or_null"))


@query("idx5_char_postings", """SELECT ch, count(*) AS items FROM (SELECT DISTINCT item_id, unnest(string_split(term, '')) AS ch FROM v_terms)
    WHERE ch <> '' GROUP BY ch""")
def idx5(spark, sf):
    return index.char_postings(views.terms(spark, sf), "item_id", "term").groupBy("ch").agg(F.count(F.lit(1)).alias("items"))


KOBS = {"v_obs": f"""SELECT {q.han('substr(term, 1, 1)')} AS literal, {q.hira('substr(term, 1, 1)')} || CASE WHEN freq % 3 = 0 THEN 'う' WHEN freq % 3 = 1 THEN '' ELSE 'ん' END AS kana
      FROM v_terms WHERE regexp_matches(term, '^[a-z]')""",
        "v_kreadings": f"""SELECT DISTINCT literal, reading, unnest([string_split(bare, '.')[1], replace(bare, '.', '')]) AS folded FROM
      (SELECT literal, reading, {q.fold("replace(reading, '-', '')")} AS bare FROM
       (SELECT literal, unnest(list_concat(kunyomi, onyomi)) AS reading FROM v_kanji))""",
        "v_rfreq": """SELECT literal, reading, count(DISTINCT rid) AS freq, any_value(total) AS total FROM
      (SELECT o.rid, r.literal, r.reading FROM (SELECT row_number() OVER () AS rid, * FROM v_obs) o
       JOIN v_kreadings r ON r.literal = o.literal AND r.folded = o.kana)
      JOIN (SELECT literal, count(*) AS total FROM v_obs o WHERE EXISTS (SELECT 1 FROM v_kreadings r
        WHERE r.literal = o.literal AND r.folded = o.kana) GROUP BY literal) USING (literal) GROUP BY literal, reading"""}


def reading_observations(spark, sf):
    kind = F.col("freq") % 3
    t = views.terms(spark, sf).where(F.col("term").rlike("^[a-z]"))
    first = F.substring("term", 1, 1)
    return t.select(views.han(first).alias("literal"), F.concat(views.hira(first), F.when(kind == 0, "う").when(kind == 1, "").otherwise("ん")).alias("kana"))


@query("idx6_reading_frequency", "SELECT literal, reading, freq, total FROM v_rfreq", KOBS)
def idx6(spark, sf):
    return index.reading_frequency(reading_observations(spark, sf), views.kanji(spark, sf))


@query("idx7_normalised_reading_frequency", "SELECT literal, reading, CASE WHEN total >= 200 THEN round(freq / total, 6) END AS norm FROM v_rfreq", KOBS)
def idx7(spark, sf):
    f = index.reading_frequency(reading_observations(spark, sf), views.kanji(spark, sf))
    return f.select("literal", "reading", index.normalised_reading_frequency(F.col("freq"), F.col("total")).alias("norm"))


def aligned_words(spark, sf):
    """item_id, literal, reading: kanji of the words with their part of the kana."""
    t = views.words(spark, sf).where("reading.kanji is not null").select(
        F.col("sequence").alias("item_id"), F.col("reading.kanji.reading").alias("kanji"), F.col("reading.kana.reading").alias("kana"))
    # aligned by all tasks: a file of parts has few row groups, and each row its own pattern
    runs = segment.align_runs(by_key(t, "item_id")).select("item_id", F.explode("pairs").alias("p")).select("item_id", "p.kanji", "p.kana")
    same = runs.where(F.length("kanji") == F.length("kana"))
    return same.select("item_id", F.explode(F.zip_with(text.chars("kanji"), text.chars("kana"), lambda k, r: F.struct(
        k.alias("literal"), r.alias("reading")))).alias("x")).select("item_id", "x.literal", "x.reading")


@query("idx8_reading_keys", f"""SELECT key, count(DISTINCT sequence) AS words FROM (SELECT sequence, unnest(list_transform(string_split(w1, ''),
    lambda c: {q.han('c')} || {q.hira('c')})) AS key FROM v_words WHERE kanji IS NOT NULL) GROUP BY key""")
def idx8(spark, sf):
    return index.reading_keys(aligned_words(spark, sf)).groupBy("key").agg(F.count(F.lit(1)).alias("words"))


@query("idx9_term_vectors", """SELECT doc_id, count(*) AS terms, round(sum(weight), 4) AS weights, round(any_value(norm), 4) AS norm FROM v_vec
    JOIN v_norm USING (doc_id) GROUP BY doc_id""")
def idx9(spark, sf):
    vec = index.term_vectors(views.doc_terms(spark, sf))
    vec = by_key(vec, "doc_id")  # one exchange, which the sums and the norms both read
    agg = (vec.groupBy("posting", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
           .groupBy("doc_id").agg(F.sum("n").alias("terms"), F.sum("w").alias("weights")))
    return agg.join(index.vector_norms(vec), "doc_id").select(
        "doc_id", "terms", F.round("weights", 4).alias("weights"), F.round("norm", 4).alias("norm"))


@query("idx10_word_tags", "SELECT tag_type, tag, word_id FROM v_word_tags")
def idx10(spark, sf):
    return index.word_tags(views.words(spark, sf), records.pos_dimension(spark))


@query("idx11_sentence_kanji_tags", """SELECT 'sentence' AS of, tag_type, tag, count(*) AS items FROM v_sentence_tags GROUP BY ALL
    UNION ALL SELECT 'kanji', 'jlpt', CAST(jlpt AS VARCHAR), count(*) FROM v_kanji WHERE jlpt IS NOT NULL GROUP BY jlpt
    UNION ALL SELECT 'kanji', 'genki', CAST(idx % 21 + 3 AS VARCHAR), count(*) FROM v_kanji GROUP BY idx % 21""")
def idx11(spark, sf):
    s = index.sentence_tags(views.sentences(spark, sf)).groupBy("tag_type", "tag").agg(F.count(F.lit(1)).alias("items"))
    k = views.kanji(spark, sf)
    lessons = k.select((F.col("radical.id") % 21 + 3).alias("lesson"), "literal")
    k = index.kanji_tags(k, lessons).groupBy("tag_type", "tag").agg(F.count(F.lit(1)).alias("items"))
    return s.select(F.lit("sentence").alias("of"), "*").unionByName(k.select(F.lit("kanji").alias("of"), "*"))


@query("idx12_part_postings", "SELECT radical, count(*) AS items, max(CAST(stroke_count AS BIGINT)) AS most_strokes FROM v_parts GROUP BY radical")
def idx12(spark, sf):
    return index.part_postings(views.letters(spark, sf)).groupBy("radical").agg(
        F.count(F.lit(1)).alias("items"), F.max("stroke_count").alias("most_strokes"))


@query("idx13_tag_cardinalities", """SELECT tag_type, tag, count(*) AS freq FROM v_word_tags GROUP BY ALL
    UNION ALL SELECT 'size', 'words', count(*) FROM v_words UNION ALL SELECT 'size', 'names', count(*) FROM v_names
    UNION ALL SELECT 'size', 'sentences', count(*) FROM v_sentences UNION ALL SELECT 'size', 'kanji', count(*) FROM v_kanji""")
def idx13(spark, sf):
    out = index.tag_cardinalities(index.word_tags(views.words(spark, sf), records.pos_dimension(spark)))
    for name, make in (("words", views.words), ("names", views.names), ("sentences", views.sentences), ("kanji", views.kanji)):
        out = out.unionByName(make(spark, sf).agg(F.lit("size").alias("tag_type"), F.lit(name).alias("tag"), F.count(F.lit(1)).alias("freq")))
    return out


@query("idx14_posting_partitions", f"""SELECT CASE WHEN regexp_full_match(x, '[{q.HAN_RE}]+') THEN 'kanji' WHEN regexp_matches(x, '[{q.HAN_RE}]') THEN 'mixed' ELSE 'kana' END AS posting,
    count(*) AS items FROM (SELECT kana AS x FROM v_names UNION ALL SELECT kanji FROM v_names WHERE kanji IS NOT NULL
      UNION ALL SELECT main FROM v_words) GROUP BY 1""")
def idx14(spark, sf):
    """Names and words filed by script, stored by posting, read back by posting."""
    n = views.names(spark, sf)
    rows = (n.select(F.col("kana").alias("x")).unionByName(n.where("kanji is not null").select(F.col("kanji").alias("x")))
            .unionByName(views.words(spark, sf).select(index.main_reading().alias("x"))))
    path = scratch_path(spark, "by-script")
    records.store(rows.withColumn("posting", index.name_posting("x")), path, partition_by=["posting"])
    return spark.read.parquet(path).groupBy("posting").agg(F.count(F.lit(1)).alias("items"))


@query("idx15_meaning_map", "SELECT term, literal, freq FROM v_radicals")
def idx15(spark, sf):
    r = views.radicals(spark, sf).select("literal", F.array("term").alias("meanings"), F.col("freq").alias("frequency"))
    return index.meaning_postings(r)


@query("idx16_feature_vectors", """SELECT item_id, count(*) AS dims, round(sum(log2(total / freq)), 4) AS idf_weight, CAST(count(*) AS DOUBLE) AS unit_weight FROM
    (SELECT item_id, gram FROM v_vgrams) JOIN v_gfreq USING (gram), (SELECT sum(freq) AS total FROM v_gfreq) GROUP BY item_id""", GFREQ)
def idx16(spark, sf):
    t = views.terms(spark, sf)
    freq = index.ngram_frequency(t, "term")
    idf = index.feature_vectors(t, "item_id", "term", freq).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("dims"), F.round(F.sum("weight"), 4).alias("idf_weight"))
    unit = index.feature_vectors(t, "item_id", "term", freq, weight=index.unit_weight).groupBy("item_id").agg(
        F.sum("weight").alias("unit_weight"))
    return idf.join(unit, "item_id")


