"""Scores, as Columns over the evidence the retrieval joins carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha import fixed
from kotonoha.functions import text


def dice(overlap="overlap", n_item="n_grams", n_query="q_grams") -> Column:
    return F.col(overlap) * 2.0 / (F.col(n_item) + F.col(n_query))


def dice_weighted(w: float, overlap="overlap", n_item="n_grams", n_query="q_grams") -> Column:
    """overlap / (w*item + (1-w)*query); equals dice at w = 0.5."""
    return F.col(overlap) / (F.col(n_item) * w + F.col(n_query) * (1.0 - w))


def vector_overlap(vec_a, sum_a, vec_b, sum_b) -> Column:
    """Weighted n-gram overlap of two packed vectors with common gram weights:
    the weights of the shared grams on both sides over all weights."""
    common = F.array_intersect(F.transform(vec_a, lambda x: x["gram"]), F.transform(vec_b, lambda x: x["gram"]))
    shared = F.transform(F.array(common), lambda grams: F.aggregate(
        F.filter(vec_a, lambda x: F.array_contains(grams, x["gram"])), F.lit(0.0), lambda acc, x: acc + x["w"]))[0]
    total = sum_a + sum_b
    return F.when((F.size(vec_a) == 0) | (F.size(vec_b) == 0) | (total == 0), F.lit(0.0)).otherwise(
        shared * 2.0 / total)


def overlap_unweighted(a: Column, b: Column) -> Column:
    """The same with weight 1 for every gram: 2 |A n B| / (|A| + |B|)."""
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) * 2.0 / total)


def term_distance(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, score for pairs of texts given feature vectors (item_id, gram, weight)."""
    sums_l = left.groupBy("item_id").agg(F.sum("weight").alias("sa"))
    sums_r = right.groupBy("item_id").agg(F.sum("weight").alias("sb"))
    la = left.select(F.col("item_id").alias("a"), "gram", F.col("weight").alias("wa"))
    rb = right.select(F.col("item_id").alias("b"), "gram", F.col("weight").alias("wb"))
    both = (pairs.join(la, "a").join(rb, ["b", "gram"]).groupBy("a", "b")
            .agg(F.sum(F.col("wa") + F.col("wb")).alias("both")))
    out = (pairs.join(both, ["a", "b"], "left")
           .join(sums_l.withColumnRenamed("item_id", "a"), "a", "left")
           .join(sums_r.withColumnRenamed("item_id", "b"), "b", "left"))
    total = F.col("sa") + F.col("sb")
    return out.select("a", "b", F.when(total > 0, F.coalesce("both", F.lit(0.0)) / total)
                      .otherwise(F.lit(0.0)).alias("score"))


def native_word_score(dice_: Column, best_reading: Column, exact_main: Column, has_jlpt: Column,
                      common: Column, threshold: Column, original_dice: Column | None = None,
                      first_word: Column | None = None) -> Column:
    """Native word score; 0 as soon as a step falls below the threshold.

    ``best_reading`` is the best weighted overlap over the readings;
    ``original_dice`` the dice with the unnormalised query of an inflected word,
    used for the first word of a segmented query only.
    """
    score = dice_ * best_reading
    if original_dice is not None:
        first = F.lit(True) if first_word is None else first_word
        score = F.when(first, F.when(original_dice > score, original_dice).otherwise(score * 0.7)
                       ).otherwise(score)
    step2 = F.when(exact_main, score).otherwise(score * 0.7)
    final = (step2 * F.when(has_jlpt, 1.0).otherwise(0.999) * F.when(common, 1.0).otherwise(0.999))
    below = (dice_ < threshold) | (score < threshold) | (step2 < threshold)
    return F.when(below, F.lit(0.0)).otherwise(final)


def foreign_word_score(text_sim: Column, dot: Column) -> Column:
    return (F.when(text_sim >= 0.5, dot * 100.0).otherwise(F.lit(0.0)) + text_sim) / 2.0


def kanji_reading_score(common: Column, jlpt: Column, reading_len: Column) -> Column:
    base = F.when(common, 100.0).otherwise(0.0) + F.coalesce(jlpt * 10.0, F.lit(0.0))
    return F.when(base == 0, F.greatest(F.lit(0.0), F.lit(100.0) - reading_len * 2.0)).otherwise(
        base + 100.0)


def wildcard_score(in_alternative: Column, common: Column, jlpt: Column, reading_len: Column) -> Column:
    score = (F.lit(100) + F.when(in_alternative, 0).otherwise(20) + F.when(common, 30).otherwise(0)
             + F.when(jlpt.isNotNull(), jlpt * 2 + 10).otherwise(0))
    return F.greatest(F.lit(0), score - reading_len * 3).cast("double")


def cosine(dot: Column, norm_q: Column, norm_d: Column, translated: Column | None = None) -> Column:
    """Cosine; times 0.8 when the user's language has no translation."""
    out = F.when((norm_q > 0) & (norm_d > 0), dot / (norm_q * norm_d)).otherwise(F.lit(0.0))
    return out if translated is None else F.when(translated, out).otherwise(out * 0.8)


def query_weighted_similarity(dot: Column, norm_q: Column, norm_d: Column,
                              translated: Column | None = None, weight: float = 100.0) -> Column:
    """Dot product over a mean norm that favours the query's length."""
    mean = (norm_q * weight + norm_d) / (weight + 1.0)
    out = F.when(mean > 0, dot / mean).otherwise(F.lit(0.0))
    return out if translated is None else F.when(translated, out).otherwise(out * 0.99)


def reading_choice_score(exact: Column, one_kanji: Column, reading_freq: Column, has_pos: Column,
                         pos_known: Column, common: Column, has_jlpt: Column) -> Column:
    score = F.when(exact, 100.0).otherwise(0.0)
    score = score + F.when(one_kanji, F.coalesce(reading_freq, F.lit(0.0)) * 10.0).otherwise(0.0)
    score = (F.when(~pos_known, score).when(has_pos, score + 20.0)
             .otherwise(F.greatest(score - 30.0, F.lit(0.0))))
    return score + F.when(common, 2.0).otherwise(0.0) + F.when(has_jlpt, 2.0).otherwise(0.0)


def split_name_score(similarity: Column, n_parts: Column, pos: Column) -> Column:
    return similarity * (n_parts - pos) * 0.001


def reading_suggestion_score(prefix: Column, n_words: Column) -> Column:
    """A typed prefix wins; then the readings with more words."""
    by_count = F.when(n_words > 0, F.floor(F.log(1.01, n_words))).otherwise(F.lit(0))
    return (F.when(prefix, 1000000).otherwise(0) + by_count).cast("bigint")


def word_threshold(q) -> Column:
    """Minimum native relevance: lower for kanji queries and short queries."""
    kana_n = text.count_class(q, text.KANA)
    kanji_n = text.count_class(q, text.HAN)
    return F.when((kanji_n >= kana_n * 2) | (kanji_n + kana_n < 5), 0.15).otherwise(0.3)


NAME_THRESHOLD_FOREIGN = 0.5
NAME_THRESHOLD_NATIVE = 0.3
NAME_DICE_WEIGHT = 0.1
HASHTAG_DICE_WEIGHT = 0.5
