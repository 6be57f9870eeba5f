"""Text columns: script classes, folding, tokens and character n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kotonoha import fixed

# character classes (Java regular expressions)
HAN = r"\p{IsHan}"
KANA = r"ぁ-ゟ゠-ヿ"
ROMAN_WIDE = r"＀-￯"
JP_SYMBOL = r"　-〿"
JAPANESE = HAN + KANA + ROMAN_WIDE + JP_SYMBOL
HANGUL = r"가-힣ᄀ-ᇿ㄰-㆏"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def has_kanji(col) -> Column:
    return _c(col).rlike(f"[{HAN}]")


def is_kanji(col) -> Column:
    return _c(col).rlike(f"^[{HAN}]+$")


def has_kana(col) -> Column:
    return _c(col).rlike(f"[{KANA}]")


def is_kana(col) -> Column:
    return _c(col).rlike(f"^[{KANA}]+$")


def is_hiragana(col) -> Column:
    return _c(col).rlike(r"^[ぁ-ゟー]+$")


def is_katakana(col) -> Column:
    return _c(col).rlike(r"^[゠-ヿ]+$")


def is_japanese(col) -> Column:
    return _c(col).rlike(f"^[{JAPANESE}]+$")


def has_japanese(col) -> Column:
    return _c(col).rlike(f"[{JAPANESE}]")


def is_hangul(col) -> Column:
    """All characters are Hangul; the empty text is not."""
    return _c(col).rlike(f"^[{HANGUL}]+$")


def count_class(col, chars: str) -> Column:
    """How many characters of the class ``chars`` the text holds."""
    return F.length(F.regexp_replace(_c(col), f"[^{chars}]", ""))


def japanese_percent(col) -> Column:
    """Share of Japanese characters, whole percent, 0 for the empty text."""
    col = _c(col)
    share = F.floor(count_class(col, JAPANESE) * 100 / F.length(col))
    return F.when(F.length(col) > 0, share).otherwise(F.lit(0)).cast("int")


def script_class(col) -> Column:
    """kana / kanji / mixed / other, the posting an item is filed under."""
    return (F.when(is_kanji(col), "kanji").when(has_kanji(col), "mixed")
            .when(has_kana(col), "kana").otherwise("other"))


# -- folding -------------------------------------------------------------------
def to_hiragana(col) -> Column:
    return F.translate(_c(col), fixed.KATAKANA, fixed.HIRAGANA)


def to_katakana(col) -> Column:
    return F.translate(_c(col), fixed.HIRAGANA, fixed.KATAKANA)


def to_halfwidth(col) -> Column:
    return F.translate(_c(col), fixed.FULLWIDTH, fixed.HALFWIDTH)


def fold_reading(col) -> Column:
    """Width and kana folding applied before readings are compared."""
    return to_hiragana(to_halfwidth(col))


def strip_punctuation(col, chars: str = fixed.WORD_PUNCT) -> Column:
    """Every listed character becomes a blank; lower-case."""
    return F.lower(F.translate(_c(col), chars, " " * len(chars)))


def terms(col, chars: str = fixed.TEXT_PUNCT) -> Column:
    """Lower-case words of a text, blanks dropped."""
    return F.filter(F.split(strip_punctuation(col, chars), " "), lambda t: t != "")


#: Characters of the longest term that an index holds as it is.
TERM_CHARS = 64


def term_key(col) -> Column:
    """What stands for a term where only equality counts: a long one, such as a whole text, by its digest."""
    return F.when(F.length(_c(col)) > TERM_CHARS, F.concat(F.lit("\x02"), F.sha2(_c(col), 256))).otherwise(_c(col))


def letter_terms(col) -> Column:
    """Runs of letters of a text, lower-case (the tokens of free prose)."""
    return F.array_remove(F.split(F.lower(F.regexp_replace(_c(col), r"[^\p{L}]+", " ")), " "), "")


def drop_parentheses(col) -> Column:
    """Remove from the first ( to the last )."""
    return F.regexp_replace(_c(col), r"\(.*\)", "")


def drop_leading_to(col) -> Column:
    return F.regexp_replace(_c(col), "^to ", "")


def gloss_key(col) -> Column:
    """A gloss as it is compared with a query: no parentheses, trimmed, lower-case."""
    return F.lower(F.trim(drop_parentheses(col)))


def url_encode(col) -> Column:
    """Percent-encode everything but ASCII letters and digits."""
    out = F.url_encode(_c(col))
    for char, code in (("+", "%20"), ("*", "%2A"), ("-", "%2D"), (".", "%2E"), ("_", "%5F")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def alphabet_runs(col) -> Column:
    """Split into maximal kanji and non-kanji runs."""
    return F.regexp_extract_all(_c(col), F.lit(f"([{HAN}]+|[^{HAN}]+)"), F.lit(1))


def chars(col) -> Column:
    """Characters of a text, in order."""
    return F.filter(F.split(_c(col), ""), lambda c: c != "")


# -- lists ---------------------------------------------------------------------
def same_elements(a, b) -> Column:
    """Equal length and every element of the first is in the second."""
    return (F.size(_c(a)) == F.size(_c(b))) & (F.size(F.array_except(_c(a), _c(b))) == 0)


def subset(a, b) -> Column:
    """Non-empty, not longer, and contained in the second list."""
    a, b = _c(a), _c(b)
    return ((F.size(a) > 0) & (F.size(a) <= F.size(b))
            & (F.size(F.array_except(a, b)) == 0))


# -- character n-grams ---------------------------------------------------------
def gram_size(col, n: int = fixed.NGRAM_N) -> Column:
    return F.least(F.lit(n), F.length(_c(col)))


def ngrams(col, n: int = fixed.NGRAM_N) -> Column:
    """All n-grams of the padded text, in order, repeats kept.

    n shrinks to the length of shorter texts; each side is padded with n-1
    pad characters.  A blank text has no n-grams.
    """
    col = _c(col)
    size = gram_size(col, n)
    pad = F.repeat(F.lit(fixed.PAD), size - 1)
    padded = F.concat(pad, col, pad)
    starts = F.sequence(F.lit(1), F.length(padded) - size + 1)
    grams = F.transform(starts, lambda i: F.substring(padded, i, size))
    return F.when(F.trim(col) != "", grams).otherwise(F.array().cast("array<string>"))


def gram_set(col, n: int = fixed.NGRAM_N) -> Column:
    """Distinct n-grams of the padded text."""
    return F.array_distinct(ngrams(col, n))


def index_grams(col, n: int = fixed.NGRAM_N) -> Column:
    """Distinct n-grams of fixed size, n-1 pads on each side, also for short texts.

    This is the form candidates are looked up by: a two-character query still
    meets the longer words that start with it.
    """
    col = _c(col)
    pad = F.lit(fixed.PAD * (n - 1))
    padded = F.concat(pad, col, pad)
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n)))
    return F.array_distinct(F.when(F.trim(col) != "", grams).otherwise(F.array().cast("array<string>")))
