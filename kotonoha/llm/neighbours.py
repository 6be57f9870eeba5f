"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, found in a block-max inverted index."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kotonoha.llm.common import map_rows, quoted, ship

WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Neighbours:
    """Settings.  Examples are ``per_label`` of each label at most, but for chance:
    the fraction that gives so many is drawn by the hash of the id.  Terms are the
    ``terms`` words and beginnings of words (``stem`` letters) whose presence tells the labels apart best (by the G statistic,
    at least ``telling``, and at least ``ratio`` times as common in one of them).
    """

    per_label: int = 2000
    terms: int = 2000
    telling: float = 16.0
    ratio: float = 25.0
    stem: int = 4
    nearest: int = 15
    block: int = 64
    evidence: int = 3


def terms_of(text: str, stem: int) -> Counter:
    """How often each word, and each beginning of longer words (marked by a star), stands in a text."""
    out = Counter(WORD.findall(text.lower()))
    for word, n in list(out.items()):
        if len(word) > stem:
            out[word[:stem] + "*"] += n
    return out


def known_terms(text: str, known: dict[str, int], stem: int) -> dict[str, int]:
    """Like ``terms_of``, for known terms only."""
    out: dict[str, int] = {}
    for word, n in Counter(WORD.findall(text.lower())).items():
        if word in known:
            out[word] = n
        if len(word) > stem and (begin := word[:stem] + "*") in known:
            out[begin] = out.get(begin, 0) + n
    return out


class Index:
    """Postings of each term in blocks of examples, with the greatest weight in each block.

    A query first bounds every block's cosine by the sum of its terms' greatest
    weights there, then opens blocks from the greatest bound on and stops when no
    bound reaches the cosine of its last neighbour.  The result is exact; equal
    cosines are ranked by the examples' order.
    """

    def __init__(self, vectors: list[dict[int, float]], labels: list[int], ids: list, terms: int, settings: Neighbours):
        # Examples with the same main term share blocks, which makes the bounds tight.
        main = [max(v.items(), key=lambda x: (x[1], -x[0]))[0] if v else -1 for v in vectors]
        order = sorted((i for i, v in enumerate(vectors) if v), key=lambda i: (labels[i], main[i], str(ids[i])))
        self.settings = settings
        self.ids, self.labels = [ids[i] for i in order], np.array([labels[i] for i in order], np.int64)
        self.blocks = -(-len(order) // settings.block)
        self.bounds = np.zeros((terms, self.blocks))
        lists: list[list[tuple[int, float]]] = [[] for _ in range(terms)]
        for place, i in enumerate(order):
            for term, weight in vectors[i].items():
                lists[term].append((place, weight))
        self.places = [np.array([p for p, _ in x], np.int64) for x in lists]
        self.weights = [np.array([w for _, w in x], np.float64) for x in lists]
        self.cuts = [np.searchsorted(p, np.arange(self.blocks + 1) * settings.block) for p in self.places]
        for term, weights in enumerate(self.weights):
            for b in range(self.blocks):
                a, z = self.cuts[term][b:b + 2]
                self.bounds[term, b] = weights[a:z].max(initial=0.0)

    def search(self, vector: dict[int, float], nearest: int, leave_out: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the nearest examples with a positive cosine."""
        if not vector or not self.blocks:
            return np.zeros(0, np.int64), np.zeros(0)
        terms, size = list(vector), self.settings.block
        weights = np.array([vector[t] for t in terms])
        bounds = weights @ self.bounds[terms]
        places, cosines, last = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or len(cosines) >= nearest and bounds[b] < last - 1e-9:
                break
            own = np.zeros(size)
            for term, weight in zip(terms, weights):
                a, z = self.cuts[term][b], self.cuts[term][b + 1]
                if z > a:
                    own[self.places[term][a:z] - b * size] += weight * self.weights[term][a:z]
            here = np.flatnonzero(own > 0)
            here = here[here + b * size != leave_out]
            places, cosines = np.append(places, here + b * size), np.append(cosines, own[here].round(12))
            if len(cosines) > nearest:
                best = np.lexsort((places, -cosines))[:nearest]
                places, cosines = places[best], cosines[best]
                last = cosines[-1]
        best = np.lexsort((places, -cosines))
        return places[best], cosines[best]


@dataclass
class Model:
    """Terms with their inverse document frequency, the index, and the calibration of votes."""

    terms: dict[str, int]
    idf: np.ndarray
    index: Index | None
    weights: np.ndarray
    prior: float
    settings: Neighbours

    def vector(self, text: str) -> dict[int, float]:
        """Term weights of length 1, or none."""
        known = self.terms
        found = sorted((known[term], n) for term, n in known_terms(text, known, self.settings.stem).items())
        out = {t: (1 + math.log(n)) * self.idf[t] for t, n in found}
        length = math.sqrt(sum(w * w for w in out.values()))
        return {t: w / length for t, w in out.items()}

    def votes(self, vector: dict[int, float], leave_out: int = -1):
        """What calibration sees: a constant, the balance of the votes, whether there are any; and the neighbours."""
        places, cosines = self.index.search(vector, self.settings.nearest, leave_out)
        weights, toxic = cosines ** 2, self.index.labels[places] == 1  # near examples count more
        seen = np.array([1.0, math.log((weights[toxic].sum() + 0.1) / (weights[~toxic].sum() + 0.1)), float(len(places) > 0)])
        return seen, places, cosines

    def score(self, text: str) -> tuple[float, np.ndarray, np.ndarray]:
        if self.index is None:
            return self.prior, np.zeros(0, np.int64), np.zeros(0)
        seen, places, cosines = self.votes(self.vector(text))
        return float(1 / (1 + np.exp(-np.clip(seen @ self.weights, -30, 30)))), places, cosines


def draw(labels: DataFrame, settings: Neighbours, id_col: str, label_col: str) -> tuple[DataFrame, dict[int, int]]:
    """(id, label) of the examples, and how many rows each label has.

    Of several labels of an id the largest holds.
    """
    rows = (labels.where(quoted(id_col).isNotNull() & quoted(label_col).isin(0, 1))
            .groupBy(quoted(id_col).alias("example")).agg(F.max(quoted(label_col).cast("int")).alias("label")))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in sorted(counts.items()):
        share = F.when(F.col("label") == label, F.lit(min(1.0, settings.per_label / n))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64("example"), F.lit(1 << 20)) < share * (1 << 20)), counts


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, lightly shrunk."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weights * (y - p)) - 0.01 * b
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(b))
        step = np.linalg.solve(curve, slope)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


def telling_terms(rows: DataFrame, settings: Neighbours) -> tuple[list, int, int]:
    """(term, a, b) of the terms that tell label 1 from 0 best, and how many rows (label, text) have either label."""
    def terms(batches):
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sorted(terms_of(text, settings.stem))
                yield pa.RecordBatch.from_arrays([pa.array(["", *found], pa.string()),
                                                  pa.array([label] * (len(found) + 1), pa.int32())], ["term", "label"])

    seen = (rows.mapInArrow(terms, "term string, label int").groupBy("term")
            .agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")))
    sizes = seen.where("term = ''").head()
    if not sizes or not sizes["a"] or not sizes["b"]:
        return [], (sizes or {"a": 0})["a"] or 0, (sizes or {"b": 0})["b"] or 0
    big_a, big_b = sizes["a"], sizes["b"]
    expected = (F.col("a") + F.col("b")) / (big_a + big_b)

    def part(n, of):  # observed times log of observed by expected, for present and absent
        return (F.when(n > 0, n * F.log(n / (expected * of))).otherwise(0.0)
                + F.when(n < of, (of - n) * F.log((of - n) / ((1 - expected) * of))).otherwise(0.0))

    rate_a, rate_b = (F.col("a") + 0.5) / (big_a + 1), (F.col("b") + 0.5) / (big_b + 1)
    chosen = (seen.where("term <> ''").where(F.greatest(rate_a / rate_b, rate_b / rate_a) >= settings.ratio)
              .withColumn("g", F.round(2 * (part(F.col("a"), big_a) + part(F.col("b"), big_b)), 6))
              .where(F.col("g") >= settings.telling).orderBy(F.desc("g"), "term").limit(settings.terms)
              .select("term", "a", "b").collect())
    return chosen, big_a, big_b


def fit(docs: DataFrame, labels: DataFrame, settings: Neighbours, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Model:
    """Terms, index and calibration from a bounded sample of labelled documents.

    At most ``per_label`` examples of each label, in expectation, and the counts of
    ``terms`` words come to the driver, whatever the input.  Calibration is a
    logistic regression on each example's votes without itself, weighted to the
    labels' true shares.  Without examples of both labels every score is the prior.
    """
    ship(docs.sparkSession.sparkContext)
    drawn, counts = draw(labels, settings, id_col, label_col)
    total = sum(counts.values())
    prior = (counts.get(1, 0) + 0.5) / (total + 1) if total else 0.0
    # The sample's size is bounded by the settings, so its ids go to every task and no text is shuffled.
    rows = (docs.select(quoted(id_col).alias("example"), quoted(text_col).cast("string").alias("text"))
            .where(F.col("text").isNotNull()).join(F.broadcast(drawn), "example")
            .select("example", "label", F.make_valid_utf8("text").alias("text")))

    chosen, big_a, big_b = telling_terms(rows.select("label", "text"), settings)
    if not big_a or not big_b:
        return Model({}, np.zeros(0), None, np.zeros(3), prior, settings)
    known = {r["term"]: i for i, r in enumerate(chosen)}
    idf = np.array([math.log(1 + (big_a + big_b) / (r["a"] + r["b"])) for r in chosen])
    model = Model(known, idf, None, np.zeros(3), prior, settings)

    def vectors(batches):
        for batch in batches:
            made = [model.vector(text) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1).cast(pa.int32()),
                pa.array([list(v) for v in made], pa.list_(pa.int32())),
                pa.array([list(v.values()) for v in made], pa.list_(pa.float64()))], ["example", "label", "terms", "weights"])

    kind = rows.schema["example"].dataType.simpleString()
    found = rows.mapInArrow(vectors, f"example {kind}, label int, terms array<int>, weights array<double>").collect()
    found.sort(key=lambda r: (str(r["example"]), r["terms"], r["weights"]))
    own = [dict(zip(r["terms"], r["weights"])) for r in found]
    model.index = Index(own, [r["label"] for r in found], [r["example"] for r in found], len(known), settings)
    places = {id(v): -1 for v in own}
    order = {example: i for i, example in enumerate(model.index.ids)}
    for r, v in zip(found, own):
        places[id(v)] = order.get(r["example"], -1) if v else -1
    x = np.array([model.votes(v, places[id(v)])[0] for v in own])
    y = np.array([r["label"] for r in found], np.float64)
    weights = np.where(y == 1, counts[1] / y.sum(), counts[0] / (1 - y).sum())
    model.weights = logistic(x, y, weights * len(y) / weights.sum())
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          keep: tuple[str, ...] = ()) -> DataFrame:
    """id, score, predicted, evidence of every row's text.

    ``evidence`` lists the nearest examples: id, cosine, label.  A text without a
    known term, an empty one and a null have no neighbours and the score of such
    texts.  Repeated rows give repeated rows; columns other than ``keep`` are left out.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by the settings
    most = model.settings.evidence

    def make():
        known = sent.value

        def row(text):
            value, places, cosines = known.score(text or "")
            near = [{"example": str(known.index.ids[p]), "cosine": float(c), "toxic": int(known.index.labels[p])}
                    for p, c in zip(places[:most], cosines[:most])]
            return value, int(value >= 0.5), near
        return row

    return map_rows(df, make, [text_col], [id_col, *keep], [
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
        T.StructField("evidence", T.ArrayType(T.StructType([
            T.StructField("example", T.StringType()), T.StructField("cosine", T.DoubleType()),
            T.StructField("toxic", T.IntegerType())])))])
