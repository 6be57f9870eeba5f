"""Languages of multilingual documents: a mixture fitted to each text, its languages chosen by penalised likelihood."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kotonoha.llm.common import map_rows, quoted, ship

#: Letters, and signs of numbers such as ½ that have to be told from them.
LETTER = re.compile(r"[^\W\d_]")
#: What is no letter becomes one blank, so that grams hold letters and borders of words.
OTHERS = re.compile(r"(?:[^\w]|[\d_])+")


@dataclass(frozen=True)
class Mixture:
    """Settings.  Grams of ``size`` bytes fall into ``2 ** bits`` cells.

    ``per_language`` documents of each language are learned from at most, but for
    chance: the fraction that gives so many is drawn by the hash of the text.  A
    further language must raise the log likelihood by ``penalty`` times half the
    logarithm of the number of grams.  ``floor`` of every language's weight is
    spread evenly, for grams it never showed.
    """

    size: int = 3
    bits: int = 14
    per_language: int = 4000
    penalty: float = 12.0
    floor: float = 0.02
    rounds: int = 40
    tolerance: float = 1e-3


def has_letter(text: str) -> bool:
    """Whether a character belongs to one of the categories of letters."""
    return any(unicodedata.category(m[0])[0] == "L" for m in LETTER.finditer(text))


def cells_of(text: str, model: Mixture) -> np.ndarray:
    """Cell of every gram of a text's letters."""
    data = np.frombuffer((" " + OTHERS.sub(" ", text.lower()) + " ").encode(), np.uint8).astype(np.uint32)
    if len(data) < model.size + 1:
        return np.zeros(0, np.uint32)
    code = np.zeros(len(data) - model.size + 1, np.uint32)
    for i in range(model.size):
        code = code * np.uint32(257) + data[i:len(code) + i]
    return code * np.uint32(2654435761) >> np.uint32(32 - model.bits)


def gram_counts(df: DataFrame, model: Mixture, label_col: str, text_col: str) -> DataFrame:
    """label, cell, n: grams of a bounded sample of each label's texts."""
    ship(df.sparkSession.sparkContext)
    rows = df.where(quoted(label_col).isNotNull() & quoted(text_col).isNotNull()).select(
        F.make_valid_utf8(quoted(label_col).cast("string")).alias("label"),
        F.make_valid_utf8(quoted(text_col).cast("string")).alias("text"))
    per_label = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in sorted(per_label.items()):
        share = F.when(F.col("label") == label, F.lit(min(1.0, model.per_language / n))).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.bincount(cells_of(text, model), minlength=1 << model.bits)
                sums[label] = sums[label] + found if label in sums else found
        for label, found in sums.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at], pa.int64())],
                ["label", "cell", "n"])

    parts = drawn.mapInArrow(count, "label string, cell int, n long")
    return parts.groupBy("label", "cell").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, model: Mixture, label_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """(languages in order, share of each cell in each language).

    What comes to the driver has a row per language and cell, however many
    documents there are.
    """
    found = gram_counts(df, model, label_col, text_col).toPandas()
    labels = sorted(found["label"].unique())
    shares = np.zeros((len(labels), 1 << model.bits))
    for i, label in enumerate(labels):
        own = found[found["label"] == label]
        shares[i, own["cell"].to_numpy()] = own["n"].to_numpy()
    if labels:
        shares = (1 - model.floor) * (shares + 0.1) / (shares + 0.1).sum(1, keepdims=True) + model.floor / (1 << model.bits)
    return labels, shares


def maximise(likely: np.ndarray, counts: np.ndarray, start: np.ndarray, model: Mixture) -> tuple[np.ndarray, float]:
    """Proportions of the languages (columns) and the log likelihood, by expectation-maximisation.

    A round gives every gram to the languages in proportion to what each makes it
    likely by, and takes the sums as the new proportions.
    """
    n, share = counts.sum(), start
    for _ in range(model.rounds):
        new = share * ((counts / (likely @ share)) @ likely) / n
        moved = np.abs(new - share).max()
        share = new
        if moved < model.tolerance:
            break
    return share, float(counts @ np.log(likely @ share))


def proportions(text: str, shares: np.ndarray, model: Mixture) -> np.ndarray | None:
    """Proportion of every language in a text; None if it has no letter.

    Begins with the likeliest single language and adds the one that raises the
    likelihood most, as long as the gain exceeds the penalty.  The likelihood is
    concave in the proportions, so its slope towards a language bounds what that
    language can gain and spares most fits.
    """
    if not has_letter(text):
        return None
    found = np.bincount(cells_of(text, model), minlength=shares.shape[1])
    cells = np.flatnonzero(found)
    counts = found[cells].astype(np.float64)
    out = np.zeros(len(shares))
    if not len(cells):
        out[:] = 1 / len(shares)
        return out
    likely = shares[:, cells].T
    single = counts @ np.log(likely)
    first = int(single.argmax())
    chosen, share, best = [first], np.ones(1), float(single[first])
    due = model.penalty * 0.5 * np.log(counts.sum() + 1)
    while len(chosen) < len(shares):
        slope = (counts / (likely[:, chosen] @ share)) @ likely - counts.sum()
        fits = []
        for other in np.flatnonzero(slope > due):
            if other not in chosen:
                start = np.append(share * 0.8, 0.2)
                fits.append((*maximise(likely[:, [*chosen, other]], counts, start, model), int(other)))
        if not fits:
            break
        new, gained, other = max(fits, key=lambda f: f[1])
        if gained - best <= due:
            break
        chosen, share, best = [*chosen, other], new, gained
    out[chosen] = share / share.sum()
    return out


def identify(df: DataFrame, labels: list[str], shares: np.ndarray, model: Mixture, id_col: str = "doc_id",
             text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, lang_pred, score, languages (language and proportion, the largest first) of every row's text.

    ``score`` is the proportion of the predicted language.  Among equal
    proportions the first language in order wins.  A text that is null or has no
    letter is ``und`` with score 0 and no languages, and so is any text if nothing
    was learned.  Repeated rows give repeated rows; columns other than ``keep``
    are left out.
    """
    sent = df.sparkSession.sparkContext.broadcast(shares)  # languages x 2 ** bits numbers, whatever the input

    def make():
        known = sent.value

        def row(text):
            found = proportions(text, known, model) if labels and text else None
            if found is None:
                return "und", 0.0, []
            order = sorted(np.flatnonzero(found > 0), key=lambda i: (-found[i], i))
            languages = [{"lang": labels[i], "share": float(found[i])} for i in order]
            return languages[0]["lang"], min(1.0, languages[0]["share"]), languages
        return row

    return map_rows(df, make, [text_col], [id_col, *keep], [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("languages", T.ArrayType(T.StructType([
            T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])))])
