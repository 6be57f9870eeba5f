"""Document rates that bring domains to target weights, for documents that belong to domains softly."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kotonoha.llm.common import map_rows, quoted, ship
from kotonoha.llm.neighbours import Neighbours, known_terms, telling_terms
from kotonoha.session import cut_lineage

SYMBOL = re.compile(r"[#*$%&|<>]")


@dataclass(frozen=True)
class Mixing:
    """Settings.  The classifier learns from ``terms.per_label`` documents of each
    domain at most, but for chance.  ``rounds`` of descent end early once the
    totals miss the targets by less than ``tolerance``, or stop moving by as much."""

    terms: Neighbours = field(default_factory=lambda: Neighbours(terms=300))
    shrink: float = 1.0
    rounds: int = 25
    tolerance: float = 1e-4


def shape_of(text: str) -> list[float]:
    """Numbers that describe a text's form, whatever its words."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    marks = len(SYMBOL.findall(text))
    return [math.log1p(len(words)), math.sqrt(marks / size), math.sqrt(text.count("!") / size),
            sum(map(str.isupper, words)) / n, len(set(words)) / n,
            sum(a == b for a, b in zip(words, words[1:])) / n, size / n, math.sqrt(text.count("\n") / size)]


@dataclass
class Classifier:
    """Softmax over a text's form and telling terms."""

    domains: list[str]
    terms: dict[str, int]
    middle: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    stem: int

    def features(self, text: str) -> np.ndarray:
        out = np.zeros(8 + len(self.terms))
        out[:8] = shape_of(text)
        for term, n in known_terms(text, self.terms, self.stem).items() if self.terms else ():
            out[8 + self.terms[term]] = math.log1p(n)
        return out

    def posteriors(self, text: str) -> np.ndarray:
        """Probability of each domain; they sum to 1."""
        z = np.append((self.features(text) - self.middle) / self.scale, 1.0) @ self.weights
        e = np.exp(z - z.max())
        return e / e.sum()


def softmax_weights(x: np.ndarray, y: np.ndarray, each: np.ndarray, kinds: int, shrink: float, rounds: int = 300) -> np.ndarray:
    """Weights of a softmax regression by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1))])
    goal = np.eye(kinds)[y]
    curve = np.linalg.eigvalsh((x * each[:, None]).T @ x / each.sum())[-1]
    step = 1 / (0.5 * curve + shrink / len(x))
    w = ahead = np.zeros((x.shape[1], kinds))
    for k in range(rounds):
        z = x @ ahead
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = ahead - step * (x.T @ ((p - goal) * each[:, None]) / each.sum() + shrink / len(x) * ahead)
        ahead, w = new + k / (k + 3) * (new - w), new
    return w


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: list[str], settings: Mixing, id_col: str, text_col: str) -> Classifier:
    """From rows (id, domain) of a labelled table.  The sample that is drawn by the
    hash of the id is bounded, whatever the input; it is written once and the
    features of its rows come to the driver.  A domain without rows stays unlikely."""
    ship(docs.sparkSession.sparkContext)
    rows = labels.groupBy(F.col("id").alias("example")).agg(F.max("domain").alias("domain")).where(
        F.col("example").isNotNull() & F.col("domain").isin(domains))
    counts = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for domain, n in sorted(counts.items()):
        share = F.when(F.col("domain") == domain, F.lit(min(1.0, settings.terms.per_label / n))).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64("example"), F.lit(1 << 20)) < share * (1 << 20))
    sample = cut_lineage(
        docs.select(quoted(id_col).alias("example"), F.make_valid_utf8(quoted(text_col).cast("string")).alias("text"))
        .where(F.col("text").isNotNull()).join(F.broadcast(drawn), "example").select("domain", "text"), "labelled")
    terms: list[str] = []
    for domain in domains:
        marked = sample.select((F.col("domain") == domain).cast("int").alias("label"), "text")
        terms += [r["term"] for r in telling_terms(marked, settings.terms)[0]]
    made = Classifier(domains, {t: i for i, t in enumerate(sorted(set(terms)))}, np.zeros(0), np.ones(0), np.zeros(0),
                      settings.terms.stem)

    def features(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([made.features(t).tolist() for t in batch.column(1).to_pylist()],
                                          pa.list_(pa.float64()))], ["domain", "features"])

    found = sample.mapInArrow(features, "domain string, features array<double>").collect()
    found.sort(key=lambda r: (r["domain"], r["features"]))
    size = 8 + len(made.terms)
    x = np.array([r["features"] for r in found], np.float64).reshape(-1, size)
    y = np.array([domains.index(r["domain"]) for r in found], np.int64)
    made.middle = x.mean(0) if len(x) else np.zeros(size)
    made.scale = np.maximum(x.std(0), 0.05) if len(x) else np.ones(size)
    seen = np.bincount(y, minlength=len(domains))
    each = np.array([counts[domains[k]] / seen[k] for k in y]) if len(y) else np.zeros(0)
    made.weights = (softmax_weights((x - made.middle) / made.scale, y, each, len(domains), settings.shrink)
                    if len(x) else np.zeros((size + 1, len(domains))))
    return made


def memberships(df: DataFrame, classifier: Classifier, id_col: str, text_col: str,
                keep: list[str] | None = None) -> DataFrame:
    """id (or the columns ``keep``), n_tokens (words), p (a probability per domain) of every row."""
    sent = df.sparkSession.sparkContext.broadcast(classifier)  # bounded by the settings

    def make():
        known = sent.value
        return lambda text: (len((text or "").split()), known.posteriors(text or "").round(9).tolist())

    return map_rows(df, make, [text_col], keep or [id_col], [T.StructField("n_tokens", T.LongType()),
                                                    T.StructField("p", T.ArrayType(T.DoubleType()))])


def after(steps: list[np.ndarray], most: float | None) -> Column:
    """A document's rate after some steps, from its probabilities."""
    rate = F.lit(1.0)
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum(F.col("p")[d] * float(v) for d, v in enumerate(step)))
        rate = rate if most is None else F.least(F.lit(most), rate)
    return rate


def fit_rates(members: DataFrame, targets: np.ndarray, settings: Mixing, most: float | None = None) -> list[np.ndarray]:
    """Steps of projected gradient descent on the squared misses of the domains' expected token totals.

    A step moves every rate against its gradient, in the metric where documents
    weigh as many as they have tokens and a domain's miss is measured by its own
    expected tokens; then rates below 0 (or above ``most``) return to the bound.
    In this metric the full step never overshoots, as a document's probabilities
    sum to 1.  Each round is one aggregate over all documents; a rate is a function
    of the steps so far, so only the totals and steps pass through the driver.
    """
    d = len(targets)
    steps: list[np.ndarray] = []
    own, size, last = np.zeros(d), max(1.0, np.abs(targets).sum()), None
    for _ in range(settings.rounds):
        rate = after(steps, most)
        totals = members.select((F.col("n_tokens") * rate).alias("t"), "p").agg(
            *[F.sum(F.col("t") * F.col("p")[i]) for i in range(d)]).head()
        now = np.array([float(v or 0.0) for v in totals])
        own = own if steps else now  # every rate is 1 before the first step
        miss = now - targets
        if np.abs(miss).sum() <= settings.tolerance * size:
            break
        if last is not None and np.abs(miss - last).sum() <= settings.tolerance * size:
            break
        last = miss
        steps.append(np.divide(miss, own, out=np.zeros(d), where=own > 0))
    return steps


def labelled_domains(labels: DataFrame) -> DataFrame:
    """id, domain: toxic where marked so, else poor or good by quality."""
    return labels.select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "toxic").when(
        F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good").alias("domain"))


def targets_of(members: DataFrame, weights: list[float], relative: bool) -> np.ndarray:
    """Token totals to reach: shares of all tokens or, if ``relative``, of each domain's own expected tokens."""
    d = len(weights)
    totals = members.agg(*[F.sum(F.col("n_tokens") * F.col("p")[i]) for i in range(d)]).head()
    own = np.array([float(v or 0.0) for v in totals])
    return np.array(weights) * (own if relative else own.sum())


def rated(members: DataFrame, steps: list[np.ndarray], most: float | None, id_col: str) -> DataFrame:
    """The members with their rate and copies."""
    draw = F.pmod(F.xxhash64(quoted(id_col), F.col("p")), F.lit(1 << 20)) / (1 << 20)
    return members.withColumn("rate", F.round(after(steps, most), 6)).withColumn(
        "copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("long"))


def mix(df: DataFrame, labels: DataFrame, domains: list[str], weights: list[float], settings: Mixing = Mixing(),
        id_col: str = "doc_id", text_col: str = "text", most: float | None = None, relative: bool = False) -> DataFrame:
    """id, n_tokens, p, rate, copies of every row.

    ``labels`` has (id, domain).  The targets are ``weights`` of all tokens, or,
    if ``relative``, of each domain's own expected tokens.  Rates are never
    negative, and at most ``most`` if given; ``copies`` is the rate's whole part,
    plus one with the probability of the rest, drawn by the hash of id and
    probabilities.  Null and empty texts have no tokens, so their rate moves no
    total.  Repeated rows give repeated rows; other columns are left out.
    """
    classifier = fit_classifier(df, labels, domains, settings, id_col, text_col)
    members = cut_lineage(memberships(df, classifier, id_col, text_col), "members")
    steps = fit_rates(members, targets_of(members, weights, relative), settings, most)
    return rated(members, steps, most, id_col)


def choose(df: DataFrame, labels: DataFrame, domains: list[str], kept: list[float], settings: Mixing = Mixing(),
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` drawn by rates of at most 1 that keep these shares of the
    domains' tokens, with all their columns.  Texts are classified again where
    they are read rather than joined with their rates."""
    classifier = fit_classifier(df, labels, domains, settings, id_col, text_col)
    members = cut_lineage(memberships(df, classifier, id_col, text_col).select("n_tokens", "p"), "members")
    steps = fit_rates(members, targets_of(members, kept, True), settings, 1.0)
    names = ["n_tokens", "p", "rate", "copies"]
    inner = {c: f"_kept_{i}" for i, c in enumerate(df.columns)}
    plain = df.toDF(*inner.values())
    again = memberships(plain, classifier, inner[id_col], inner[text_col], keep=list(inner.values()))
    drawn = rated(again, steps, 1.0, inner[id_col]).where("copies > 0").drop(*names)
    return drawn.toDF(*df.columns)
