"""Language identification by fusing evidence (op 3).

A page's text gives likelihoods (hashed byte trigrams, fitted on a bounded
sample of labelled documents; the evidence grows with a text's length, to a power
fitted on held-out ones). What the page declares in its markup, and the
suffix of its address, give likelihoods too, estimated over all pages by
grouped aggregation of the text's posteriors. Priors come from the page's host:
shares of languages among the host's other pages, smoothed towards those of its
domain's other pages, and these towards all pages. The posterior is the
normalised product. A page's own text counts once: it is taken off all sums that
its markup, suffix, domain and host are looked up in. Pages are read in time that is
linear in their length, whatever tags they leave open.

Defined cases: a null or empty html says nothing, so the other evidence decides;
a null or unreadable url has empty host, domain and suffix; a declared language
not known to the model counts as ``other``; ties go to the first language in
order; repeated rows are pages of their own; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, written

BUCKETS = 1 << 14
#: Labelled documents that the text model is fitted on, at most.
LABELLED = 2_000
#: Exponents of the text's length among which held-out labelled documents choose; the evidence grows with any of them.
EXPONENTS = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
#: Labelled rows in so many are held out of the counts that the exponents are judged by.
HELD_OUT = 5
_OPENS = re.compile(rb"<!--|<(?:script|style)\b", re.I)
_CLOSES = {b"<!--": re.compile(b"-->"), b"<scri": re.compile(rb"</script\s*>", re.I), b"<styl": re.compile(rb"</style\s*>", re.I)}
_TAG = re.compile(rb"<[^>]*>")
_HTML = re.compile(rb"<html\b", re.I)
_LANG = re.compile(rb"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def without_hidden(html: bytes) -> bytes:
    """A space in place of each comment, script and style that is closed; one that no mark closes stays, and is looked for once."""
    out, at, never = [], 0, set()
    for m in _OPENS.finditer(html):
        kind = m[0].lower()[:5]
        if m.start() < at or kind in never:
            continue
        end = _CLOSES[kind].search(html, m.end())
        if end is None:
            never.add(kind)
            continue
        out += [html[at : m.start()], b" "]
        at = end.end()
    return b"".join([*out, html[at:]])


def visible(html: bytes) -> bytes:
    bare = without_hidden(html)
    # Behind the last mark that closes a tag there is none; before it, every tag that opens is closed.
    last = bare.rfind(b">") + 1
    return unescape((_TAG.sub(b" ", bare[:last]) + bare[last:]).decode("utf-8", "replace")).encode("utf-8", "replace")


def declared_language(html: bytes) -> str:
    """What the first ``html`` tag that declares a language declares, in small letters; else an empty string."""
    at = 0
    while m := _HTML.search(html, at):
        end = html.find(b">", m.end())
        end = len(html) if end < 0 else end
        # What lies before the end of this tag is looked through once, whatever opens in between.
        if found := _LANG.search(html, m.end(), end):
            return found[1].decode().lower()
        at = end
    return ""


def trigram_counts(text: bytes) -> np.ndarray:
    """Counts of hashed byte trigrams of the lower-cased text."""
    x = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(BUCKETS)
    code = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(18)
    return np.bincount(code, minlength=BUCKETS).astype(float)


@dataclass
class TextModel:
    languages: list[str]
    log_p: np.ndarray  # (languages, BUCKETS)
    #: Trigrams of a text are not independent: n of them count as n to this power.
    exponent: float = 1.0

    def log_likelihood(self, text: bytes) -> np.ndarray:
        c = trigram_counts(text)
        n = c.sum()
        return self.log_p @ c * n ** (self.exponent - 1) if n else np.zeros(len(self.languages))


def log_shares(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + 0.5) / (counts + 0.5).sum(1, keepdims=True))


def fit_text_model(docs: DataFrame, most: int = LABELLED) -> TextModel:
    """From rows (doc_id, text, lang), of which about ``most``, chosen by a hash, are used; counts come to the driver, a row a language, half and bucket.

    The exponent is the one that gives rows held out of the counts the least
    log loss; then all rows count.
    """
    labelled = docs.where("lang is not null and text is not null")
    share = min(1.0, most / max(labelled.count(), 1))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) == 0
    chosen = written(chosen.select("lang", F.col("text").cast("binary").alias("text"), held.alias("held")), "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for lang, text, held in zip(*b.columns, strict=True):
                sums.setdefault((lang.as_py(), held.as_py()), np.zeros(BUCKETS)).__iadd__(trigram_counts(text.as_py()))
        for (lang, held), c in sums.items():
            at = np.nonzero(c)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array([held] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "held", "bucket", "n"])

    rows = chosen.mapInArrow(run, "lang string, held boolean, bucket int, n double").groupBy("lang", "held", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in rows}) or ["und"]
    number = {lang: k for k, lang in enumerate(languages)}
    counts = np.zeros((2, len(languages), BUCKETS))
    for r in rows:
        counts[int(r["held"]), number[r["lang"]], r["bucket"]] += r["n"]
    known, log_p = counts[0].any(1), log_shares(counts[0])

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = np.zeros(len(EXPONENTS))
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                c, k = trigram_counts(text.as_py()), number.get(lang.as_py())
                n = c.sum()
                if not n or k is None or not known[k]:
                    continue
                scores = (log_p @ c)[known] * n ** (np.array(EXPONENTS)[:, None] - 1)
                own = (log_p[k] @ c) * n ** (np.array(EXPONENTS) - 1)
                top = scores.max(1)
                loss += top + np.log(np.exp(scores - top[:, None]).sum(1)) - own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(EXPONENTS)).astype(np.int32)), pa.array(loss)], ["k", "loss"])

    found = chosen.where("held").mapInArrow(losses, "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()
    loss = {r["k"]: r["loss"] for r in found}
    best = min(range(len(EXPONENTS)), key=lambda k: (loss.get(k, 0.0), -k))
    return TextModel(languages, log_shares(counts.sum(0)), EXPONENTS[best])


def with_address(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with host, domain (its last two labels) and suffix."""
    host = F.lower(F.coalesce(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    return pages.select("page_id", host.alias("host"), F.regexp_extract(host, "([^.]+\\.[^.]+)$", 1).alias("domain"), F.regexp_extract(host, "([^.]+)$", 1).alias("suffix"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))


def text_evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """(page_id, host, domain, suffix, declared, text): log-likelihoods of the visible text a language."""
    names = set(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            declared, scores = [], []
            for html in b.column(4):
                data = html.as_py()
                lang = declared_language(data)
                declared.append(lang if not lang or lang in names else "other")
                scores.append(model.log_likelihood(visible(data)))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(4)] + [pa.array(declared), pa.array([x.tolist() for x in scores], pa.list_(pa.float64()))], ["page_id", "host", "domain", "suffix", "declared", "text"])

    return with_address(pages).mapInArrow(run, "page_id long, host string, domain string, suffix string, declared string, text array<double>")


def normalised(logs: Column) -> Column:
    """Probabilities from log weights."""
    shifted = lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s)))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, y: a + y)
    return let(let(logs, shifted), lambda e: F.transform(e, lambda x: x / total(e)))


def added(*logs: Column) -> Column:
    out = logs[0]
    for x in logs[1:]:
        out = F.zip_with(out, x, lambda a, b: a + b)
    return out


def shares(rows: DataFrame, key: str, n: int, out: str) -> DataFrame:
    """(key, out): sums of the posteriors ``q`` a language; partial sums leave a row a key and task, however large the key."""
    return rows.groupBy(key).agg(F.array(*[F.sum(F.get("q", F.lit(k))) for k in range(n)]).alias(out))


def fused(evidence: DataFrame, languages: list[str], smoothing: float = 5.0) -> DataFrame:
    """(page_id, lang, p, text_lang, declared, host) from text evidence and what all pages say about markup, suffixes and hosts."""
    n = len(languages)
    # Written before anything is summed, so that the texts are read once.
    rows = written(evidence.withColumn("q", normalised(F.col("text"))), "evidence")
    total = [float(x or 0) for x in rows.agg(*[F.sum(F.get("q", F.lit(k))) for k in range(n)]).first()]
    size = sum(total)
    everywhere = F.array(*[F.lit((x + 1) / (size + n)) for x in total])
    sums = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    every = F.array(*[F.lit(x) for x in total])
    scaled = lambda c: let(c, lambda x: F.transform(x, lambda y: y / sums(x)))
    towards = lambda sums_, prior: F.zip_with(sums_, prior, lambda a, b: a + smoothing * b)
    less = lambda c: F.zip_with(c, "q", lambda a, b: F.greatest(a - b, F.lit(0.0)))

    def looked_up(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
        return left.join(written(right, name), key, "left")

    # Sums a declared language (at most languages + 2 rows), suffix, host and domain, made before any page joins.
    said, suffixes = shares(rows, "declared", n, "m"), shares(rows, "suffix", n, "s")
    hosts = rows.groupBy("host").agg(F.first("domain").alias("domain"), *[F.sum(F.get("q", F.lit(k))).alias(f"h{k}") for k in range(n)]).withColumn("h", F.array(*[f"h{k}" for k in range(n)])).select("host", "domain", "h")
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(F.get("h", F.lit(k))) for k in range(n)]).alias("d"))
    hosts = looked_up(hosts, domains, "domain", "domains").select("host", "h", "d")
    got = looked_up(looked_up(looked_up(rows, said, "declared", "markup"), suffixes, "suffix", "suffixes"), hosts, "host", "hosts")
    # Without the page itself: how often what it declares, and its suffix, go with each language of the text.
    rate = lambda c, add, size: F.zip_with(less(F.col(c)), less(every), lambda a, b: F.log((a + add) / (b + size * add)))
    log_m = F.when(F.col("declared") == "", F.array_repeat(F.lit(0.0), n)).otherwise(rate("m", 1.0, n + 2))
    prior = F.transform(scaled(towards(less(F.col("h")), scaled(towards(less(F.col("d")), everywhere)))), lambda x: F.log(x))
    p = normalised(added(F.col("text"), log_m, rate("s", smoothing, n), prior))
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    return got.withColumn("p", p).select("page_id", best(F.col("p")).alias("lang"), F.array_max("p").alias("p"), best(F.col("text")).alias("text_lang"), "declared", "host")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_text_model(table(spark, sf_dir, "documents"))
    return fused(text_evidence(table(spark, sf_dir, "pages"), model), model.languages)


ORACLE: dict[str, str] = {}
QUERIES = {"op3_language_id": op3_language_id}
