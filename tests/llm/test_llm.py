import math
from collections import Counter
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from scissile.llm import exact_dedup, language_id, lm_scoring, mixing, quality_rules, segmentation, sharding, simhash, token_counts, warc

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __w string, step int, fp string"


def prose(seed, n=40):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def texts():
    near = prose(1, 200).split()
    return {0: prose(0), 1: " ".join(near), 2: " ".join([*near[:-1], "other"]), 3: prose(0), 4: None, 5: "", 6: "one", 7: " \n\t ", 8: prose(8, 3000), 9: "a a a a a a a a a a a a\nb\nb", 10: "日本 𐍈 ▁x \x00?"}


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en", "s", None, "clash", 1, "clash") for k, t in texts.items()]
    return spark.createDataFrame([*rows, (None, "no id here", None, None, None, None, None, None), rows[0]], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(spark, docs, empty, texts, tmp_path):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(texts) + 2
    groups = {}
    for k, t in [*texts.items(), (0, texts[0])]:
        groups.setdefault(t or "", []).append(k)
    for r in got:
        if r["doc_id"] is not None:
            g = groups[texts[r["doc_id"]] or ""]
            assert (r["keep_id"], r["group_size"]) == (max(g), len(g)) and r["kept"] <= (r["doc_id"] == max(g))
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter({r["text_sha256"]: 1 for r in got})
    assert sorted(exact_dedup.exact_dedup(docs, batches=3).collect(), key=str) == sorted(got, key=str)
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    exact_dedup.exact_dedup(docs.where("doc_id < 4"), index)
    # Opened by its folder in a session that knows no table of it; a larger id in a later batch takes over.
    other = spark.newSession()
    for name in [x.name for x in spark.catalog.listTables() if x.name.startswith("digests_")]:
        spark.sql(f"drop table {name}")
    again = exact_dedup.DigestIndex(other, str(tmp_path / "index"))
    assert again.buckets == 4 and again.read().count() == 3
    rows = other.createDataFrame([(103, texts[3]), (2, "new"), (1, texts[1])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(rows, again).collect()}
    assert [(got[k]["keep_id"], got[k]["group_size"], got[k]["kept"]) for k in (103, 2, 1)] == [(103, 4, True), (2, 1, True), (1, 2, True)]
    assert again.read().count() == 4
    clash = docs.withColumn("digest", F.lit("mine")).withColumn("k_id", F.lit(9)).withColumn("row", F.lit(8))
    kept = exact_dedup.keep_first_copies(clash)
    assert kept.columns == clash.columns and {(r["digest"], r["k_id"], r["row"]) for r in kept.collect()} == {("mine", 9, 8)}
    assert exact_dedup.keep_first_copies(docs).count() == len(groups) + 1
    assert exact_dedup.exact_dedup(empty).isEmpty() and exact_dedup.keep_first_copies(empty).isEmpty()


def repeated(w):
    at = [i for i, g in enumerate(zip(*(w[k:] for k in range(5)), strict=False)) if sum(g == h for h in zip(*(w[k:] for k in range(5)), strict=False)) > 1]
    return len({i + j for i in at for j in range(5)})


def test_quality_rules(docs, empty, texts):
    base = docs.where("doc_id <> 8").withColumn("w", quality_rules.words(F.col("text")))
    for r in base.select("doc_id", "w", quality_rules.repeated_words(F.col("w")).alias("n"), quality_rules.duplicate_lines(F.col("text")).alias("d")).collect():
        w = [x for x in (texts[r["doc_id"]] or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
        assert r["w"] == w and r["n"] == repeated(w)
        assert r["d"] == (1 if r["doc_id"] == 9 else 0)
    kept = {r["doc_id"] for r in quality_rules.keep_good(docs).collect()}
    assert {0, 1, 2, 3} == kept  # 8 has 3000 words of 20 kinds
    clash = docs.withColumn("failed", F.lit("mine")).withColumn("w", F.lit("theirs"))
    assert quality_rules.keep_good(clash).columns == clash.columns
    assert {(r["failed"], r["w"], r["__w"], r["failed_"]) for r in quality_rules.cascade(clash).where("doc_id = 1").collect()} == {("mine", "theirs", "clash", None)}
    assert quality_rules.keep_good(empty).isEmpty()
    rules = quality_rules.default_rules()
    one, other = (rules[0], 1.0, 0.5), (rules[1], 0.1, 0.4)
    assert [r.name for r in quality_rules.ordered([one, other])] == [rules[1].name, rules[0].name]
    slow = quality_rules.Rule("slow", lambda m: F.aggregate(F.sequence(F.lit(1), F.lit(20_000)), m.n, lambda a, i: (a * 31 + i) % 1_000_003) < 0)
    many = docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20))))
    for bound in (False, True):
        costs = {r.name: c for r, c, _ in quality_rules.measured(many, [rules[0], slow], bound=bound)}
        assert costs["slow"] > 2 * costs["few_words"] >= 2 * quality_rules.RESOLUTION


def test_simhash(spark, docs, empty, texts):
    got = {r["doc_id"]: r for r in simhash.simhash_groups(docs).collect()}
    fp = {k: simhash.fingerprint(simhash.shingle_hashes((t or "").encode(), 3)) for k, t in texts.items()}
    assert all(got[k]["fp"] % 2**64 == f for k, f in fp.items())
    assert fp[4] == fp[5] == fp[7] == 0
    assert simhash.simhash_groups(empty).isEmpty()
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    many = list(base) + [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(1, 5), replace=False))) for b in np.repeat(base[:20], 6)]
    ids = np.array(many, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame(list(enumerate(ids)), "doc_id long, fp long")
    part = list(range(len(ids)))
    for i, j in combinations(range(len(ids)), 2):
        if bin((ids[i] ^ ids[j]) & (2**64 - 1)).count("1") <= 3 and part[i] != part[j]:
            a, b = sorted((part[i], part[j]))
            part = [a if p == b else p for p in part]
    found = {r["fp"]: r["component_id"] for r in simhash.components(table).collect()}
    assert [found[x] for x in ids] == part


def test_near_duplicates(docs, empty):
    kept = {r["doc_id"] for r in simhash.keep_one_of_each(docs.dropDuplicates(["doc_id"])).collect()}
    assert 1 in kept and 2 not in kept and {4, 5, 6, 7, 8, 9, 10, None} <= kept
    assert simhash.keep_one_of_each(empty).isEmpty()


@pytest.mark.parametrize("block", [1 << 12, simhash.BLOCK])
def test_near_duplicates_in_a_dense_cluster(spark, monkeypatch, block):
    """Pairs at 0.82 among documents at 0.72 of one another, against brute force."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    n, words = 100, lambda name, k: [f"{name}{x}" for x in range(k)]
    texts = [" ".join([*words("shared", 88), *words(f"pair{k // 2}x", 6), *words(f"own{k}x", 10)]) for k in range(2 * n)]
    sets = [set(simhash.shingle_hashes(t.encode(), simhash.STAGE_SHINGLE).tolist()) for t in texts]
    near = {(i, j) for i, j in combinations(range(2 * n), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert near == {(2 * k, 2 * k + 1) for k in range(n)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    gone = set(range(2 * n)) - {r["doc_id"] for r in simhash.keep_one_of_each(docs).collect()}
    assert gone <= {j for _, j in near} and len(gone) >= 0.98 * n


def test_language_id(spark):
    """A long page in a language of its own on a hot host."""
    rng = np.random.default_rng(5)
    # Two languages of the same letters, so that a trigram says little.
    letters, n = list("abcdef"), 3000
    weights = {"aa": [6, 5, 4, 4, 5, 5], "bb": [5, 6, 5, 4, 4, 5]}
    text = lambda lang, k: "".join(rng.choice(letters, k, p=np.array(weights[lang]) / sum(weights[lang])))
    docs = spark.createDataFrame([(k, text(lang, 400), lang) for k in range(200) for lang in [["aa", "bb"][k % 2]]], "doc_id long, text string, lang string")
    model = language_id.fit_text_model(docs)
    assert model.languages == ["aa", "bb"] and model.exponent in language_id.EXPONENTS
    long, pages = text("bb", 20000), [(k, "http://a.hot.example/x", text("aa", 400)) for k in range(n)]
    got = language_id.fused(language_id.text_evidence(spark.createDataFrame([*pages, (n, "http://a.hot.example/x", long)], "page_id long, url string, html string"), model), model.languages)
    row = {r["page_id"]: r for r in got.collect()}[n]
    logs = model.log_likelihood(long.encode())
    assert (row["text_lang"], row["lang"]) == ("bb", "bb")
    # The evidence keeps growing with the text, and outgrows a host of any fixed size.
    gap = [float(np.diff(model.log_likelihood((long * k).encode()))[0]) for k in (1, 4, 16)]
    assert gap[0] < gap[1] < gap[2] and gap[2] > 2.5 * gap[0] and np.argmax(logs) == 1
    assert language_id.fit_text_model(docs.limit(0)).languages == ["und"]


def test_warc(spark, tmp_path):
    data = [b"", b"x" * 5000, "日本".encode() * 3000, b"\r\n\r\nWARC/1.1\r\n0\r\n\r\n"]
    for d in data:
        assert warc.payload_of(warc.HEAD + warc.chunked(d, 7)) == d
    with pytest.raises(ValueError):
        warc.dechunked(warc.chunked(b"abcdef", 4)[:-6])
    rows = [(k, d.decode()) for k, d in enumerate(data)] + [(9, data[1].decode()), (1, data[1].decode()), (5, None), (None, "<p>")]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("digest", F.lit("clash"))
    warc.write_archives(pages, str(tmp_path / "w"), segment_bytes=100, chunk_bytes=64)
    records = warc.read_archives(spark, str(tmp_path / "w"))
    got = warc.resolved(warc.payloads(records)).collect()
    assert len(got) == len(rows)
    assert Counter((r["page_id"], r["record_type"]) for r in got) == Counter([(0, "response"), (1, "response"), (1, "revisit"), (2, "response"), (3, "response"), (5, "revisit"), (9, "revisit"), (None, "response")])
    assert all(r["payload_digest"] == warc.base32_sha1((dict(rows)[r["page_id"]] or "").encode()) for r in got)
    lost = warc.payloads(records.where("not (segment = 3 and page_id = 2)")).where("page_id = 2").first()
    assert lost["problem"] == "segment missing" and lost["payload"] is None
    whole = warc.resolved(warc.payloads(records.where("not (page_id = 1 and type = 'response')"))).where("page_id = 9").first()
    assert (whole["record_type"], whole["problem"], whole["payload_bytes"]) == ("revisit", "no response", None)
    # A large page in many segments, with an address and a clash of names.
    large = "<p>é</p>" * 200_000
    one = spark.createDataFrame([(7, large, "http://x.example/a b", "clash")], "page_id long, html string, url string, key string")
    warc.write_archives(one, str(tmp_path / "large"), segment_bytes=1 << 12)
    back = warc.payloads(warc.read_archives(spark, str(tmp_path / "large"))).first()
    assert back["payload"].decode() == large and back["problem"] is None
    head = b"".join(p.read_bytes() for p in (tmp_path / "large").glob("part*"))[:600].decode("latin1").split("\r\n\r\n")[0]
    assert all(f"\r\n{x}: " in head for x in ("WARC-Date", "WARC-Record-ID", "Content-Length", "Content-Type")) and "WARC-Target-URI: http://x.example/ab" in head
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.resolved(warc.payloads(warc.read_archives(spark, str(tmp_path / "none")))).isEmpty()


def greedy(word, begins, goes_on):
    n, at = 0, 0
    while at < len(word):
        pool = goes_on if at else begins
        k = next((k for k in range(len(word), at, -1) if word[at:k] in pool), None)
        if k is None:
            return None
        n, at = n + 1, k
    return n


def test_token_counts(docs, empty):
    rng = np.random.default_rng(2)
    piece = lambda: "".join(rng.choice(list("abc"), rng.integers(1, 5)))
    begins, goes_on = {piece() for _ in range(12)}, {piece() for _ in range(12)}
    a = token_counts.Automaton(begins, goes_on)
    for _ in range(2000):
        w = "".join(rng.choice(list("abcd" if rng.random() < 0.1 else "abc"), rng.integers(1, 12)))
        assert a.pieces(w) == greedy(w, begins, goes_on), w
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs).collect()}
    assert got[4]["n_tokens"] == got[5]["n_words"] == got[7]["n_tokens"] == 0 and got[0]["n_words"] == 40
    assert token_counts.token_counts(empty).isEmpty()


def test_segmentation(spark, docs, empty, texts):
    enc = segmentation.encode(docs, samples=3)
    rows = segmentation.decode(enc).collect()
    for r in rows:
        if r["doc_id"] is not None:
            assert r["text"] == (texts[r["doc_id"]] or "")
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(len({tuple(r["ids"]) for r in by[k]}) == 3 for k in (1, 2, 8)) and len(by[4]) == len(by[5]) == 1
    assert [r["ids"] for r in by[0][:3]] == [r["ids"] for r in by[0][3:]] or sorted(map(tuple, (r["ids"] for r in by[0][:3]))) == sorted(map(tuple, (r["ids"] for r in by[0][3:])))
    # Texts of one run, far longer than words: exact, and step by step alike.
    long = spark.createDataFrame([(1, "ab" * 30_000), (2, "é𐍈" * 500), (3, "x" + "\u2028" * 3)], "doc_id long, text string")
    assert {(r["doc_id"], r["sample"]): r["exact"] for r in segmentation.encode(long, decoded=True).collect()} == {(k, s): True for k in (1, 2, 3) for s in (0, 1) if k != 3 or s == 0} | {(3, 1): True}
    v_, runs = segmentation.vocabulary(segmentation.MODEL), [" ban" * 1 + "ana" * 40, " of", " the"]
    few, segmentation.FEW = segmentation.FEW, 1
    whole = segmentation.lattices(runs, v_)
    segmentation.FEW = 10**9
    assert np.allclose(whole.p, segmentation.lattices(runs, v_).p)
    segmentation.FEW = few
    assert segmentation.encode(empty).isEmpty()
    v = segmentation.vocabulary(segmentation.MODEL)
    n = 3000
    _, found = segmentation.sample_block(["then"] * n, segmentation.mixed(np.arange(n).astype(np.uint64)), 2, v)
    p = {tuple(q.edges): math.exp(q.log_prob) for s in found for q in s}
    seen = Counter(tuple(q.edges) for s in found for q in s)
    for e, share in p.items():
        want = share + sum(x * share / (1 - x) for o, x in p.items() if o != e)
        assert abs(seen[e] / n - want) < 0.04
    assert abs(np.mean([sum(math.exp(q.log_prob - q.log_inclusion) for q in s) for s in found]) - 1) < 0.05


def test_sharding(spark, docs, empty):
    many = spark.range(300).select("id", F.when(F.col("id") < 120, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") / 3).cast("int"))).alias("text")).withColumnRenamed("id", "doc_id")
    rows = sharding.shard(many).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == 300 and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(16))
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    cut = sum(len({r["shard"] for r in rows if r["doc_id"] // 3 == g}) > 1 for g in range(40, 100))
    before = sum(len({r["home"] for r in rows if r["doc_id"] // 3 == g}) > 1 for g in range(40, 100))
    assert cut < before / 2
    assert sharding.shard(docs).count() == docs.count() and sharding.shard(empty).isEmpty()


def test_sharding_beside_a_hot_group(spark):
    """A third of all rows in one group: it stays spread, quotas hold, and the other groups come together."""
    n = 6000
    text = F.when(F.col("id") < n // 3, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") / 4).cast("int")))
    many = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    rows = sharding.signatures(many).withColumn("home", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int"))
    moved = {(r["group"], r["home"]): r["shard"] for r in sharding.propagated(rows).collect()}
    load, groups = Counter(), {}
    for r in rows.collect():
        at = moved.get((r["group"], r["home"]), r["home"])
        load[at] += 1
        groups.setdefault(r["group"], set()).add(at)
    assert max(load.values()) <= 1.1 * n / 16 and sum(len(x) == 16 for x in groups.values()) == 1
    assert sum(len(x) > 1 for x in groups.values()) < 0.05 * len(groups)
    ends = {}
    for r in sharding.shard(many).collect():
        ends.setdefault(r["group"], set()).add(r["shard"])
    assert sum(len(x) > 1 for x in ends.values()) <= sum(len(x) > 1 for x in groups.values()) + 15


def hashed(text):
    """(words, hashes, restaurants of rarer words) of one text."""
    data = np.frombuffer(text, np.uint8)
    at, h, last = lm_scoring.words_of(data, np.array([0]))
    return text.lower().split(), h.tolist(), (1 + lm_scoring.OWN + last % lm_scoring.SHARED).tolist()


def test_lm_words(monkeypatch):
    rng = np.random.default_rng(8)
    texts = [bytes(rng.choice(list(b"abAB\xc3\xa9 \n\t\x0b"), n)) for n in (0, 1, 5, 400, 3000)] + [b"x" * 1000, b"", b" a"]
    monkeypatch.setattr(lm_scoring, "_SPAN", 64)
    begins = np.cumsum([0, *map(len, texts)])[:-1]
    at, h, _ = lm_scoring.words_of(np.frombuffer(b"".join(texts), np.uint8), begins)
    words = [w for x in texts for w in x.lower().split()]
    assert len(h) == len(words) and len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))
    assert np.searchsorted(at, begins[-1]) == len(words) - 1
    x = rng.integers(0, 1 << 40, 100)
    assert (lm_scoring.unpacked(lm_scoring.packed(x, "<u8"), "<u8") == x).all() and not len(lm_scoring.unpacked(None, "<u4"))


def test_lm_counts_beyond_32_bits(spark):
    """Counts are exact past 2^32, in parts with and without such ones, through a sweep and in the probabilities."""
    for x in ([], [7], [1 << 32], [0, (1 << 32) - 1], [3, (1 << 32) + 5, 1 << 40]):
        assert lm_scoring.unpacked_counts(lm_scoring.packed_counts(np.array(x, np.int64)), len(x)).tolist() == x
    counts = [3, (1 << 32) + 5]
    row = {"part": 0, "w": lm_scoring.packed(np.array([9]), "<u8"), "m": lm_scoring.packed(np.array([2]), "<u4"), "ctx": lm_scoring.packed(np.array([0, 1]), "<u2"), "cnt": lm_scoring.packed_counts(np.array(counts))}
    customers = np.bincount([0, 1], counts, lm_scoring.RESTAURANTS)
    totals = lm_scoring.Totals(customers, (customers > 0).astype(float), (2.0, 1.0), 0.5)
    state = spark.createDataFrame([{**row, "customers": None, "seated": None, "kept": None, "tables": None, "root": None}], lm_scoring.STATE)
    after = lm_scoring.swept(state, totals, 1, True).first().asDict()
    assert lm_scoring._pairs(after)[3].tolist() == counts
    kept = lm_scoring.unpacked_counts(after["kept"], 2)
    assert 1 <= kept[0] <= 3 and 1 < kept[1] <= counts[1]
    words, n, _, own, _ = lm_scoring.probabilities(lm_scoring.Model(1, np.empty(0, np.uint64), state, sum(counts), 1, [totals], {}), after)
    assert words.tolist() == [9] and n.tolist() == [sum(counts)]
    assert np.allclose(own, (np.array(counts) - lm_scoring.DISCOUNT * kept) / (lm_scoring.STRENGTH + np.array(counts)))


def test_lm_scoring(spark, docs, empty, texts, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PART_BYTES", 4000)
    data = spark.createDataFrame([(k, prose(k, 60)) for k in range(200)], "doc_id long, text string").unionByName(docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 1000))
    rows = lm_scoring.split_rows(data)
    model = lm_scoring.fit(rows.where("not held_out"), 1, 2, own_words=12)  # of 20 frequent words, some share
    got = lm_scoring.score(rows, model).collect()
    every = [(r["doc_id"], (r["text"] or "").encode()) for r in data.collect()]
    known = {k: (x.lower().split() + [b""], [*hashed(x)[1], 0], hashed(x)[2]) for k, x in {x: x for _, x in every}.items()}
    trained = [x for k, x in every if crc32(str(k if k is not None else "").encode()) % 10]
    counts = Counter(w for x in trained for w in known[x][0])
    n = sum(counts.values())
    assert (model.n_tokens, model.n_words, len(got)) == (n, len(counts), len(every)) and 0 < len(model.own) <= 12
    own = {h: 1 + i for i, h in enumerate(model.own.tolist())}
    path = lambda x: list(zip(known[x][1], [0, *(own.get(h, c) for h, c in zip(known[x][1], known[x][2], strict=False))], strict=True))
    pairs = Counter(p for x in trained for p in path(x))
    customers = Counter()
    for (_, c), m in pairs.items():
        customers[c] += m
    # The model's parts, unpacked: counts as they are in the texts, tables within their bounds, and root customers that are the tables.
    add, root, samples = {}, {}, len(model.totals)
    for r in model.state.collect():
        words, of, ctx, cnt = lm_scoring._pairs(r.asDict())
        kept = lm_scoring.unpacked(r["kept"], "<u4")
        assert {(w, c): m for w, c, m in zip(words[of].tolist(), ctx.tolist(), cnt.tolist(), strict=True)}.items() <= pairs.items()
        assert (kept >= samples).all() and (kept <= samples * cnt).all()
        seats, tables = (lm_scoring._arrays(r[x], len(words), "<u8")[:samples] for x in ("customers", "seated"))
        assert (np.bincount(of, kept) == sum(seats)).all() and all((t <= c).all() and (t >= 1).all() for t, c in zip(tables, seats, strict=True))
        for w, c, m, k in zip(words[of].tolist(), ctx.tolist(), cnt.tolist(), kept.tolist(), strict=True):
            add[w, c] = (m - lm_scoring.DISCOUNT * k / samples) / (lm_scoring.STRENGTH + customers[c])
        for i, w in enumerate(words.tolist()):
            root[w] = [(c[i] - lm_scoring.DISCOUNT * t[i]) for c, t in zip(seats, tables, strict=True)]
    assert len(add) == len(pairs)
    spare = lambda c, t: (lm_scoring.STRENGTH + lm_scoring.DISCOUNT * t) / (lm_scoring.STRENGTH + c)

    def p(w, c):
        out = add.get((w, c), 0.0)
        for s, t in enumerate(model.totals):
            top = root.get(w, [0.0] * samples)[s] / (lm_scoring.STRENGTH + t.root[0]) + spare(*t.root) / (len(counts) + 1)
            out += spare(customers[c], t.T[c]) * top / samples
        return out

    # Over all words and the unknown one, the probabilities of a context sum to 1, also of a context never seen.
    for c in [*customers, 5000]:
        assert abs(sum(p(w, c) for w in {h for x in trained for h in known[x][1]}) + p(-1, c) - 1) < 1e-9
    texts_of, n_of = dict(every), Counter(k for k, _ in every)
    for r in got:
        if r["doc_id"] is None or n_of[r["doc_id"]] > 1:
            continue
        words = known[texts_of[r["doc_id"]]][0]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (len(counts) + 1))) for w in words)
        assert (r["n_tokens"], r["n_known"]) == (len(words), sum(w in counts for w in words)) and abs(r["base_score"] - base) < 1e-6
        assert abs(r["score"] - sum(math.log10(p(w, c)) for w, c in path(texts_of[r["doc_id"]]))) < 1e-6
    # However the rows lie, the draws and so the scores are the same; blocks that meet a few at a time count alike.
    monkeypatch.setattr(lm_scoring, "MERGED", 1)
    other = lm_scoring.split_rows(data.repartition(5))
    again = lm_scoring.score(other, lm_scoring.fit(other.where("not held_out"), 1, 2, own_words=12)).collect()
    by = lambda rows: sorted((str(r["doc_id"]), round(r["score"], 6), round(r["base_score"], 6), r["n_known"]) for r in rows)
    assert by(got) == by(again)
    none = lm_scoring.split_rows(empty)
    assert lm_scoring.score(none, lm_scoring.fit(none, 1, 1)).isEmpty()
    bare = lm_scoring.score(rows, lm_scoring.fit(none, 1, 1)).where("doc_id = 0").first()
    assert (bare["n_known"], bare["base_score"], bare["score"]) == (0, 0.0, 0.0)


def seated_one_by_one(c, a, sweeps, rng):
    """Mean number of tables when each customer is unseated and seated again, sweep after sweep."""
    sizes, seen = [c], []
    for k in range(sweeps):
        for _ in range(c):
            sizes[rng.choice(len(sizes), p=np.array(sizes) / sum(sizes))] -= 1
            sizes = [x for x in sizes if x]
            w = np.array([*(x - lm_scoring.DISCOUNT for x in sizes), a])
            at = rng.choice(len(w), p=w / w.sum())
            sizes = [x + (i == at) for i, x in enumerate([*sizes, 0])]
            sizes = sizes if sizes[-1] else sizes[:-1]
        seen += [len(sizes)] if k >= sweeps // 5 else []
    return np.mean(seen)


def test_lm_tables(spark):
    rng, tables = np.random.default_rng(3), lm_scoring.Tables()
    for a in (0.3, 4.0, 60.0):
        got = tables.draw(np.full(20000, 30), np.full(20000, a), rng)
        assert abs(got.mean() / seated_one_by_one(30, a, 1500, rng) - 1) < 0.08
    # Saddle points against exact numbers: distance of the distributions.
    n, t = 600, np.arange(1, 601)
    exact = lm_scoring.log_stirling(n)[n, 1:]
    for a in (0.01, 1.0, 30.0, 700.0, 20000.0):
        p, q = (np.exp(w - w.max()) for w in (x + t * math.log(a) for x in (exact, tables.log_weight(np.full(n, float(n)), t.astype(float)))))
        p, q = p / p.sum(), q / q.sum()
        assert abs(p - q).sum() / 2 < 0.03
        got = tables.draw(np.full(4000, n), np.full(4000, a), rng)
        assert abs(got.mean() - p @ t) < 0.05 * (p @ t) + 0.05 and got.min() >= 1 and got.max() <= n
    # A frequent word's tables are those of its many customers, not of a fixed number of moves.
    data = spark.createDataFrame([(k, " ".join(["w", f"rare{k}"] * 40)) for k in range(500)], "doc_id long, text string")
    model = lm_scoring.fit(lm_scoring.split_rows(data))
    h = hashed(b"w")[1][0]
    held = [(r, lm_scoring._pairs(r)) for r in (x.asDict() for x in model.state.collect())]
    (cnt, kept), = [(x[3][at], lm_scoring.unpacked(r["kept"], "<u4")[at]) for r, x in held for at in [x[0][x[1]] == h] if at.any()]
    assert cnt.sum() == 500 * 40 and kept.sum() > 4 * len(model.totals) * len(cnt)


def test_mixing(spark, docs, empty):
    good, bad = WORDS[:10], ["scum", "idiot", "stupid"]
    rng = np.random.default_rng(4)
    text = lambda k: " ".join([*rng.choice(good, 30), *(rng.choice(bad, 6) if k % 3 == 0 else [])])
    data = spark.createDataFrame([(k, text(k)) for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(150)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    domains = mixing.domain_of_labels(labels)
    got = mixing.rates(data, domains, (0.9, 0.0, 0.1)).collect()
    mass = np.array([[x * r["tokens"] * r["rate"] for x in r["posterior"]] for r in got]).sum(0)
    assert abs(mass[2] / mass.sum() - 0.1) < 0.01 and all(r["rate"] >= 0 for r in got)
    kept = {r["doc_id"] for r in mixing.mixed(data, domains, (0.98, 0.01, 0.01)).collect()}
    assert {k for k in range(300) if k % 3} <= kept and len(kept) < 230
    assert mixing.rates(docs, domains).count() == docs.count()
    assert mixing.mixed(empty, domains).isEmpty() and mixing.rates(empty, domains.limit(0)).isEmpty()
