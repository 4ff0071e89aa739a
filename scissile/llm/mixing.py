"""Mixing to target weights by soft membership (op 1), in DataFrame operations only.

A naive Bayes classifier over hashed words, fitted on a bounded sample of a
labelled table, gives each document a posterior over domains. Each document
then gets a rate, 0 or more, so that the expected tokens of every domain match
the targets: least squares of the domains' relative errors, by projected
gradient steps from rate 1. A document's step depends on its posterior and on
one error a domain, so a round is one aggregation over all documents to as many
numbers as there are domains. In this scaling the largest eigenvalue of the
problem is 1, so steps of length 1 converge. Targets that no rates reach are met
as nearly as least squares allow: the rounds end where the errors stand still,
and ``Rates.reached`` says what came out.

Defined cases: a null or empty text has no tokens and the posterior of the
sample's shares; a null doc_id is never labelled; labels given twice count
once; repeated rows each get a rate; an empty table gives no rows; without
labels every posterior is even; only doc_id and text are read.
"""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, words, written

DOMAINS = ("clean", "rough", "toxic")
WEIGHTS = (0.90, 0.08, 0.02)
#: Hashed words: with the domains, the bound of the classifier's size.
BUCKETS = 1 << 14
#: Labelled rows that the classifier is fitted on, at most.
LABELLED = 20_000
#: Log prior of a domain without labelled rows.
UNLABELLED = -1e6


def domain_of_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain number): toxic, else clean if of quality, else rough; rows with a null label are left out."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    return labels.where("doc_id is not null and toxic is not null and quality is not null").groupBy("doc_id").agg(F.max(domain).alias("domain"))


def buckets_of(words_: Column) -> Column:
    """Hash of each distinct word of a lower-case text."""
    return F.array_distinct(F.transform(words_, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))


def constant(values: list) -> Column:
    """A list of numbers as one literal, folded when the plan is made."""
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


@dataclass
class Classifier:
    """log_prior a domain; log_likelihood a domain and bucket."""

    log_prior: list[float]
    log_likelihood: list[list[float]]
    temperature: float = 1.0

    def posterior(self, words_: Column) -> Column:
        """An array of as many probabilities as there are domains, from the words of a lower-case text."""

        def of(b: Column) -> Column:
            summed = lambda w: F.aggregate(b, F.lit(0.0), lambda a, k: a + F.get(w, k))
            scores = [summed(constant(w)) / self.temperature + p for w, p in zip(self.log_likelihood, self.log_prior, strict=True)]
            shifted = let(F.array(*scores), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))
            return let(shifted, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))

        return let(buckets_of(words_), of)


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: int = len(DOMAINS), most: int = LABELLED) -> Classifier:
    """From (doc_id, domain) rows, of which at most ``most``, those of the least hashes, are used."""
    chosen = written(labelled.select("doc_id", "domain").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labelled")
    texts = docs.select(F.col("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most ``most`` pairs of numbers
    found = texts.select("domain", F.explode(buckets_of(words(F.lower("text")))).alias("bucket")).groupBy("domain", "bucket").agg(F.count("*").alias("n"))
    counts = [[0.0] * BUCKETS for _ in range(domains)]
    for r in found.collect():  # domains * BUCKETS rows at most
        counts[r["domain"]][r["bucket"]] = float(r["n"])
    rows = {r["domain"]: r["n"] for r in chosen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    # A domain that no row is labelled with, where others are, is no candidate: unseen words would all speak for it.
    prior = [math.log((rows.get(k, 0) + 1) / (sum(rows.values()) + domains)) if k in rows or not rows else UNLABELLED for k in range(domains)]
    # Smoothed towards the shares of all domains, so that a word seen in none of them says nothing.
    everywhere = [sum(c[b] for c in counts) + 0.5 for b in range(BUCKETS)]
    total = sum(everywhere)
    smooth = 2000.0
    sums = [sum(c) + smooth for c in counts]
    like = [[round(math.log((c[b] + smooth * e / total) / n) - math.log(e / total), 4) if e > 0.5 else 0.0 for b, e in enumerate(everywhere)] for c, n in zip(counts, sums, strict=True)]
    return Classifier(prior, like)


@dataclass
class Rates:
    """The errors of each round, relative to the domains' tokens; a document's rate follows from them and its posterior.

    ``whole`` names a domain, if any, whose likely documents have a rate of 1 or more.
    """

    errors: list[list[float]]
    targets: list[float]
    whole: int | None = None
    reached: list[float] = field(default_factory=list)

    def rate(self, posterior: Column) -> Column:
        """Projected steps from rate 1; ``posterior`` is evaluated once."""
        n = len(self.targets)
        step = lambda p, e: sum((F.get(p, F.lit(k)) * F.get(e, F.lit(k)) for k in range(1, n)), F.get(p, F.lit(0)) * F.get(e, F.lit(0)))
        least = lambda p: F.lit(0.0) if self.whole is None else F.when(F.get(p, F.lit(self.whole)) >= 0.5, 1.0).otherwise(0.0)
        history = F.from_json(F.lit(json.dumps(self.errors)), "array<array<double>>")
        return let(posterior, lambda p: let(least(p), lambda low: F.aggregate(history, F.lit(1.0), lambda r, e: F.greatest(low, r - step(p, e)))))


def expected_tokens(features: DataFrame, rate: Column, n: int) -> list[float]:
    """Expected tokens a domain of (tokens, posterior) rows at a rate each."""
    rated = features.select("posterior", (F.col("tokens") * rate).alias("mass"))
    row = rated.agg(*[F.coalesce(F.sum(F.col("mass") * F.get("posterior", F.lit(k))), F.lit(0.0)).alias(f"m{k}") for k in range(n)]).first()
    return [float(x) for x in row]


def fit_rates(features: DataFrame, targets: list[float], whole: int | None = None, rounds: int = 60, tolerance: float = 0.01) -> Rates:
    """Rates for (tokens, posterior) rows that bring each domain to within ``tolerance`` of its own target, or as near as least squares come."""
    n = len(targets)
    natural = [max(x, 1.0) for x in expected_tokens(features, F.lit(1.0), n)]
    fitted, before = Rates([], targets, whole), None
    for _ in range(rounds):
        fitted.reached = expected_tokens(features, fitted.rate(F.col("posterior")), n)
        error = [(m - t) / c for m, t, c in zip(fitted.reached, targets, natural, strict=True)]
        met = all(abs(m - t) <= tolerance * max(t, 1.0) for m, t in zip(fitted.reached, targets, strict=True))
        if met or before and max(abs(a - b) for a, b in zip(error, before, strict=True)) <= 1e-4:
            return fitted
        fitted.errors.append(error)
        before = error
    warnings.warn(f"the mix is not settled after {rounds} rounds: {fitted.reached} for {targets}", stacklevel=2)
    return fitted


def features_of(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(row, tokens, posterior): each row of ``docs`` whole, with what is known of its text; words are cut once."""
    both = let(words(F.lower("text")), lambda w: F.struct(F.size(w).cast("long").alias("tokens"), classifier.posterior(w).alias("posterior")))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), both.alias("f")).select("row", "f.tokens", "f.posterior")


def copies(rate: Column, key: Column) -> Column:
    """A whole number whose mean is the rate, settled by a hash of the key."""
    part = lambda r: (F.pmod(F.xxhash64(key), F.lit(1 << 30)) < (r - F.floor(r)) * (1 << 30)).cast("int")
    return let(rate, lambda r: (F.floor(r) + part(r)).cast("int"))


def rates(docs: DataFrame, labelled: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """(doc_id, tokens, posterior, rate): the corpus keeps its expected size and gets the weights."""
    classifier = fit_classifier(docs, labelled, len(weights))
    features = written(features_of(docs.select("doc_id", "text"), classifier).withColumn("row", F.struct("row.doc_id")), "posteriors")
    total = sum(expected_tokens(features, F.lit(1.0), len(weights)))
    fitted = fit_rates(features, [w * total for w in weights])
    return features.select("row.doc_id", "tokens", "posterior", fitted.rate(F.col("posterior")).alias("rate"))


def mixed(docs: DataFrame, labelled: DataFrame, weights: tuple = WEIGHTS, whole: int = 0, labelled_docs: DataFrame | None = None) -> DataFrame:
    """``docs`` with each row as often as its rate says; documents of domain ``whole`` all stay, the others come down to their weights beside it.

    A domain with less than its weight keeps what it has: to raise it, rows of
    the whole domain would have to make room. The classifier learns from
    ``labelled_docs``, or else from ``docs``: where filters came before, the rows
    they took are the examples of what is not clean. No text is shuffled.
    """
    features, fitted = fit_mix(docs, labelled, weights, whole, labelled_docs)
    n = copies(fitted.rate(F.col("posterior")), F.col("row.doc_id").cast("long"))
    return features.select(F.explode(F.array_repeat("row", n)).alias("row")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def fit_mix(docs: DataFrame, labelled: DataFrame, weights: tuple = WEIGHTS, whole: int = 0, labelled_docs: DataFrame | None = None) -> tuple[DataFrame, Rates]:
    """The features and the rates of ``mixed``; the rates tell the tokens that were asked for and reached."""
    classifier = fit_classifier(docs if labelled_docs is None else labelled_docs, labelled, len(weights))
    features = written(features_of(docs, classifier), "posteriors")
    natural = expected_tokens(features, F.lit(1.0), len(weights))
    total = natural[whole] / weights[whole]
    return features, fit_rates(features, [min(w * total, m) for w, m in zip(weights, natural, strict=True)], whole)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rates(table(spark, sf_dir, "documents"), domain_of_labels(table(spark, sf_dir, "labels")))
    parts = [F.get("posterior", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), "tokens", *parts, "rate", copies(F.col("rate"), F.col("doc_id").cast("long")).alias("copies"))


ORACLE: dict[str, str] = {}
QUERIES = {"op1_mixing": op1_mixing}
