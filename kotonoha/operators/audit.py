"""Consistency checks of indexes, records and rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotonoha import fixed
from kotonoha.functions import text
from kotonoha.operators import index


def dangling(check: str, items: DataFrame, records: DataFrame, item: str = "item_id", key: str = "id"
             ) -> DataFrame:
    """check, item_id, problem: index items without a record."""
    missing = items.select(F.col(item).alias("item_id")).distinct().join(
        records.select(F.col(key).alias("item_id")), "item_id", "left_anti")
    return missing.select(F.lit(check).alias("check"), F.col("item_id").cast("string").alias("item_id"),
                          F.lit("no record").alias("problem"))


def audit_indexes(checks: list[tuple[str, DataFrame, DataFrame, str, str]]) -> DataFrame:
    """Union of ``dangling`` over (name, items, records, item column, key column)."""
    out = None
    for name, items, records, item, key in checks:
        rows = dangling(name, items, records, item, key)
        out = rows if out is None else out.unionByName(rows)
    return out


def violations(problems: DataFrame) -> DataFrame:
    return problems.groupBy("check").agg(F.count(F.lit(1)).alias("violations"))


def features(words: DataFrame, kanji: DataFrame, names: DataFrame, sentences: DataFrame,
             radicals: DataFrame | None = None, lessons: DataFrame | None = None,
             ids_edges: DataFrame | None = None) -> DataFrame:
    """feature, present: one aggregate per record table."""
    def flag(frame, **conds):
        return frame.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in conds.items()])

    w = flag(words, Words=F.lit(True),
             WordIrregularIchidan=F.exists("senses", lambda s: F.arrays_overlap(
                 s["part_of_speech"], F.array(*[F.lit(c) for c in fixed.IRREGULAR_ICHIDAN_CODES]))),
             WordKatakana=text.is_katakana(index.main_reading()),
             SentenceAvailable=F.col("sentences_available") > 0, WordPitch=F.size("accents") > 0,
             WordJlpt=F.col("jlpt_lvl").isNotNull())
    k = flag(kanji, Kanji=F.lit(True), SimilarKanji=F.size("similar_kanji") > 0,
             RadicalKanjiMap=F.size("parts") > 0)
    n = flag(names, Names=F.lit(True))
    s = flag(sentences, Sentences=F.lit(True), SentenceTags=F.size("tags") > 0,
             SentenceJLPT=F.col("jlpt_guess").isNotNull())
    rows = [w, k, n, s]
    for name, frame in (("RadicalData", radicals), ("GenkiTags", lessons), ("KanjiDecompositions", ids_edges)):
        if frame is not None:
            rows.append(flag(frame, **{name: F.lit(True)}))
    out = None
    for r in rows:
        long = r.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("present"))
                                            for c in r.columns])).alias("x")).select("x.feature", "x.present")
        out = long if out is None else out.unionByName(long)
    return out


def missing_features(present: DataFrame) -> DataFrame:
    """feature, required: declared features that are not present."""
    spark = present.sparkSession
    declared = spark.createDataFrame([(f, f in fixed.REQUIRED_FEATURES) for f in fixed.FEATURES],
                                     "feature string, required boolean")
    return declared.join(present.where("present"), "feature", "left_anti")


def missing_languages(index_langs: DataFrame, languages: DataFrame) -> DataFrame:
    """Languages of the dimension without any index row."""
    return languages.join(index_langs.select("lang").distinct(), "lang", "left_anti")


def open_rules(rules: DataFrame) -> DataFrame:
    """rule, target: right-hand sides that name no rule; ``rules``: rule, rhs."""
    used = rules.select("rule", F.explode("rhs").alias("target")).where("target <> '*'")
    return used.join(rules.select(F.col("rule").alias("target")).distinct(), "target", "left_anti").select(
        "rule", "target")


def rule_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in fixed.RULES.items()], "rule string, rhs array<string>")
