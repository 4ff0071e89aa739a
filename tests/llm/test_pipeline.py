"""The stages of the pipeline, each on what its predecessor kept, against plain Python."""

import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scissile.llm import segmentation, simhash
from scissile.llm.common import table, written

SMALL = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def rejected(text):
    """Whether a rule of the quality stage fails."""
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    n, chars = len(w), sum(map(len, w))
    lines = text.split("\n")
    written_ = [x for x in lines if re.search("[^\x20\x09-\x0d]", x)]
    grams = Counter(zip(*(w[k:] for k in range(5)), strict=False))
    twice = {i + j for i in range(n - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    capitals = sum(len(x) > 1 and x[0].isupper() and x[1].isupper() for x in w)
    return any([
        n < 10, chars < 2 * n or chars > 15 * n, 10 * sum(text.count(c) for c in "#*$%&|<>") > n, 2 * capitals > n,
        10 * sum(any(c.isalpha() for c in x) for x in w) < 7 * n, 10 * (len(written_) - len(set(written_))) > 3 * len(lines),
        len(set(w)) ** 2 < n, 100 * len(twice) > 20 * n,
    ])


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and comes out."""
    docs, out = table(spark, SMALL, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SMALL), name)
        out[name] = (docs, after)
        docs = after
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_order_and_columns(spark, stages):
    assert list(STAGES) == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "encoding"]
    columns = table(spark, SMALL, "documents").columns
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "encoding")


def test_quality_stage(stages):
    before, after = map(texts, stages["quality_rules"])
    assert after == {k: t for k, t in before.items() if not rejected(t)}


def test_exact_stage(stages):
    before, after = map(texts, stages["exact_dedup"])
    assert after == {k: t for t, k in {t or "": k for k, t in sorted(before.items())}.items()}


def test_near_stage(stages):
    """Kept documents have no partner at 0.8 or more; each that goes is linked to a smaller one by a chain of such pairs."""
    before, after = map(texts, stages["near_dedup"])
    sets = {k: set(simhash.shingle_hashes((t or "").encode(), simhash.STAGE_SHINGLE).tolist()) for k, t in before.items()}
    part = {k: k for k in before}
    for i, j in combinations(sorted(before), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and part[i] != part[j]:
            a, b = sorted((part[i], part[j]))
            part = {k: a if p == b else p for k, p in part.items()}
    assert after == {k: t for k, t in before.items() if part[k] == k}


def test_mixing_stage(spark, stages):
    """Nothing new, nothing changed, and documents labelled clean stay."""
    before, after = map(texts, stages["mixing"])
    assert after.items() <= before.items()
    clean = {r["doc_id"] for r in table(spark, SMALL, "labels").where("quality = 1 and toxic = 0").collect()} & set(before)
    assert len(clean & set(after)) >= 0.95 * len(clean)


def test_encoding_stage(spark, stages):
    before, after = stages["encoding"]
    text, vocabulary, seen = texts(before), segmentation.vocabulary(segmentation.MODEL), {}
    for r in after.collect():
        assert segmentation.decode_ids(list(r["ids"]), vocabulary) == (text[r["doc_id"]] or "")
        seen.setdefault(r["doc_id"], set()).add(tuple(r["ids"]))
    assert set(seen) == set(text) and all(len(x) == 2 for x in seen.values())


def test_odd_rows_and_empty_tables(spark):
    """Nulls in any column, empty and repeated rows, columns with names of their own, and no rows at all."""
    docs = table(spark, SMALL, "documents").limit(20)
    odd = docs.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields]).limit(2)
    empty = docs.limit(1).withColumn("text", F.lit("")).withColumn("doc_id", F.lit(10**9).cast("long"))
    every = written(docs.unionByName(docs.limit(3)).unionByName(odd).unionByName(empty).withColumn("row", F.lit("mine")).withColumn("__gone", F.lit(1)).withColumn("failed", F.lit("f")), "odd")
    for rows in (every, every.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, rows, SMALL), name)
            if name != "encoding":
                assert out.columns == every.columns
                assert out.where("row <> 'mine' or __gone <> 1 or failed <> 'f'").isEmpty()
            assert not rows.isEmpty() or out.isEmpty()
