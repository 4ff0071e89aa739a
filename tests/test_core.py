from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scissile import functions as S
from scissile import sources
from scissile.operators import assembly, combs, cover, running, screen
from scissile.plans import catalog
from scissile.plans.disassembly import disassemble

SMALL = "/root/testdata/sf0.001"

#: Fixed values: (fragments, valid combs, solutions) whose covers are known.
COVERS = [
    (3, "0 1 2 01 12 02 012", ["012", "0 12", "02 1", "01 2", "0 1 2"]),
    (3, "0 1 2 01 12", ["0 12", "01 2", "0 1 2"]),
    (3, "0 1 2", ["0 1 2"]),
    (4, "0 1 2 3 01 12 012", ["012 3", "0 12 3", "01 2 3", "0 1 2 3"]),
    (5, "0 1 2 3 4 01 12 012 0123", ["0123 4", "012 3 4", "0 12 3 4", "01 2 3 4", "0 1 2 3 4"]),
]


def mask(comb):
    return sum(1 << int(c) for c in comb)


def test_exact_cover_golden(spark):
    valid = spark.createDataFrame([(k, mask(c)) for k, (_, v, _) in enumerate(COVERS) for c in v.split()], "target_id int, mask long")
    sizes = spark.createDataFrame([(k, n) for k, (n, _, _) in enumerate(COVERS)] + [(99, 0), (98, 2)], "target_id int, n int")
    rows = cover.numbered(cover.solutions(valid, sizes)).collect()
    counts = {r["target_id"]: r["n_solutions"] for r in cover.solution_counts(valid, sizes).collect()}
    for k, (_, _, want) in enumerate(COVERS):
        got = {frozenset("".join(map(str, c)) for c in r["combs"]) for r in rows if r["target_id"] == k}
        assert got == {frozenset(w.split()) for w in want}
        assert counts[k] == len(want)
    assert 99 not in counts and 98 not in counts
    numbered = cover.numbered(cover.solutions(valid, sizes))
    assert cover.capped(numbered, 0).count() == cover.capped(numbered).count() == len(rows)
    assert cover.capped(numbered, 1).count() == len(COVERS)
    assert cover.with_parts(numbered, 2).count() == sum(len(w.split()) == 2 for _, _, ws in COVERS for w in ws)


def graphs(seed=3, n=6):
    rng = np.random.default_rng(seed)
    out = []
    for t in range(n):
        f = int(rng.integers(3, 7))
        e = {(int(rng.integers(0, v)), v) for v in range(1, f)} | {tuple(sorted(map(int, rng.choice(f, 2, replace=False)))) for _ in range(2)}
        out.append((t, f, sorted(e)))
    return out


def connected(comb, edges):
    seen, todo = set(), [comb[0]]
    while todo:
        u = todo.pop()
        if u not in seen:
            seen.add(u)
            todo += [b if a == u else a for a, b in edges if u in (a, b) and {a, b} <= set(comb)]
    return len(seen) == len(comb)


def test_combs_against_brute_force(spark):
    gs = graphs()
    frags = spark.createDataFrame([(t, k) for t, f, _ in gs for k in range(f)], "target_id int, frag_id int")
    edges = spark.createDataFrame([(t, u, v) for t, _, e in gs for u, v in e], "target_id int, u int, v int")
    for n in (1, 2, 3, 4):
        got = {(r["target_id"], r["mask"]) for r in combs.connected_combs(frags, edges, n).collect()}
        want = {(t, mask(c)) for t, f, e in gs for c in combinations(range(f), n) if connected(c, e)}
        assert got == want
    every = spark.createDataFrame([(t, mask(c)) for t, f, _ in gs for c in combinations(range(f), 3)], "target_id int, mask long")
    for r in combs.is_connected(every, edges).collect():
        comb = [k for k in range(7) if r["mask"] >> k & 1]
        assert r["connected"] == connected(comb, gs[r["target_id"]][2])


def test_stage_loop_against_brute_force(spark):
    gs = graphs(5)
    rng = np.random.default_rng(1)
    bits = {(t, k): 1 << int(rng.integers(0, 6)) for t, f, _ in gs for k in range(f)}
    stock = [(b, int(rng.integers(1, 64)), int(rng.integers(1, 5))) for b in range(25)] + [(100 + b, 1 << b, 1) for b in range(6)]
    frags = spark.createDataFrame([(t, k, x) for (t, k), x in bits.items()], "target_id int, frag_id int, fp long")
    edges = spark.createDataFrame([(t, u, v) for t, _, e in gs for u, v in e], "target_id int, u int, v int")
    out = disassemble(frags, edges, spark.createDataFrame(stock, "bb_id long, mask long, n long"))
    got = {(r["target_id"], r["mask"]) for r in out.where("status = 'valid'").collect()}
    want = set()
    for t, f, e in gs:
        for n in range(1, f + 1):
            for c in combinations(range(f), n):
                fp = 0
                for k in c:
                    fp |= bits[t, k]
                if connected(c, e) and any(m & fp == fp and size >= n for _, m, size in stock):
                    want.add((t, mask(c)))
    assert got == want


def test_containment_edges(spark):
    stock = spark.createDataFrame([(0, 7, 3), (1, 7, 3), (2, 1 << 62, 1), (3, -1, 64), (4, 0, 2)], "bb_id long, mask long, n long")
    asked = spark.createDataFrame([(10, 0, 1), (11, 5, 2), (12, 1 << 62, 1), (13, 8, 1)], "query_id long, mask long, n long")
    got = {(r[0], r[1]) for r in screen.screened(asked, stock).collect()}
    assert got == {(q, b) for q, m, n in asked.collect() for b, s, size in stock.collect() if s & m == m and size >= n}
    none = spark.createDataFrame([], "query_id long, bb_id long")
    assert screen.screened(asked, stock, none).isEmpty()
    assert screen.screened(asked, stock.limit(0)).isEmpty()


def test_scalar_functions(spark):
    rows = [("[4*]CC[13*]", 2, 0), ("c1ccccc1Br", 7, 1), ("[H]C([H])*", 1, 0), ("C[N+](C)(C)C", 5, 0), ("C1CC2CC1CC2", 7, 2), ("[2H]C", 1, 0), ("CCl", 2, 0)]
    df = spark.createDataFrame([(a,) for a, _, _ in rows], "s string")
    got = df.select("s", S.heavy_atoms(F.col("s")).alias("h"), S.ring_count(F.col("s")).alias("r"), S.well_formed(F.col("s")).alias("ok")).collect()
    assert [(r["s"], r["h"], r["r"]) for r in got] == rows and all(r["ok"] for r in got)
    bad = spark.createDataFrame([("",), ("C1CC",), ("C(C",), ("Xx",)], "s string").select(S.well_formed(F.col("s")).alias("ok")).collect()
    assert not any(r["ok"] for r in bad)
    one = spark.createDataFrame([("[4*]CC*[*]",)], "s string")
    assert one.select(S.without_dummy_labels(F.col("s"))).first()[0] == "[*]CC*[*]"
    assert one.select(S.dummies_as_hydrogen(F.col("s"))).first()[0] == "[H]CC[H][H]"
    m = spark.createDataFrame([(11,)], "m long").select(S.members(F.col("m")).alias("c"), S.lowest_unset(F.col("m")).alias("u"), S.lowest_set(F.col("m")).alias("l"), S.mask_of(S.members(F.col("m"))).alias("back")).first()
    assert (m["c"], m["u"], m["l"], m["back"]) == ([0, 1, 3], 2, 0, 11)


def test_sources(spark, tmp_path):
    from scissile import sources

    (tmp_path / "stock.txt").write_text(" CC \n\nCCO\t\n")
    assert [r["smiles"] for r in sources.read_lines(spark, str(tmp_path / "stock.txt")).collect()] == ["CC", "", "CCO"]
    assert [tuple(r) for r in sources.with_ids(sources.stock_of(spark, ["C", "N"]).drop("bb_id")).collect()] == [(0, "C"), (1, "N")]
    (tmp_path / "p.json").write_text('[{"cano_smiles": "C", "num_heavy_atoms": 1, "num_rings": 0, "pfp": [3, 70]}]')
    props = sources.read_properties(spark, str(tmp_path / "p.json"))
    words = props.select(*S.fingerprint_words(F.col("pfp"), 128)).first()
    assert tuple(words) == (8, 64)
    (tmp_path / "bad.json").write_text('[{"cano_smiles": "C"}]')
    with pytest.raises(Exception, match="lacks a property"):
        sources.read_properties(spark, str(tmp_path / "bad.json")).collect()
    sources.write_unique(spark.createDataFrame([("a",), ("a",), (None,)], "s string"), "s", str(tmp_path / "u"))
    assert spark.read.text(str(tmp_path / "u")).count() == 1


@pytest.mark.parametrize("name", ["fingerprint_screen", "fragment_edges", "effective_combs", "exact_cover", "comb_assembly", "on_bit_counts", "stage_tests", "stage_counts_wide"])
def test_queries_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{SMALL}/lineitem.parquet'")
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    want = c.execute(catalog.ORACLE[name]).df()
    cols = sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[cols].astype(str).values))
    assert rows(got) == rows(want)


def test_containment_of_all_bits(spark):
    """Bit 63, fingerprints of several longs, and queries without bits, against brute force."""
    rng = np.random.default_rng(3)
    wide = [tuple(int(x) for x in rng.choice(128, rng.integers(0, 6), replace=False)) for _ in range(60)] + [(63,), (127,), (63, 127), ()]
    word = lambda bits, k: int(np.array(sum(1 << (b - 64 * k) for b in bits if b // 64 == k), np.uint64).view(np.int64))
    rows = spark.createDataFrame([(word(x, 0), word(x, 1)) for x in wide], "w0 long, w1 long")
    got = {(r["w0"], r["w1"]): r["n_bb"] for r in screen.supplied_wide(rows, rows, ["w0", "w1"]).collect()}
    assert got == {(word(x, 0), word(x, 1)): sum(set(x) <= set(y) for y in wide) for x in wide}
    one = spark.createDataFrame([(k, word(x, 0), 1) for k, x in enumerate(wide)], "query_id long, mask long, n int")
    low = [{b for b in x if b < 64} for x in wide]
    stock = one.withColumnRenamed("query_id", "bb_id")
    want = {(i, j) for i, x in enumerate(low) for j, y in enumerate(low) if x <= y}
    assert {tuple(r) for r in screen.screened(one, stock).collect()} == want
    allowed = spark.createDataFrame([(i, (7 * i) % 64) for i in range(64)], "query_id long, bb_id long")
    assert {tuple(r) for r in screen.screened(one, stock, allowed).collect()} == {p for p in want if p[1] == (7 * p[0]) % 64}
    bits = rows.select(S.on_bits([F.col("w0"), F.col("w1")]).alias("n")).collect()
    assert [r["n"] for r in bits] == [len(x) for x in wide]


def test_sources_and_sinks(spark, tmp_path):
    import gzip
    import json

    with gzip.open(tmp_path / "stock.json.gz", "wt") as f:
        json.dump([{"smiles": "CCO"}, {"smiles": "C1CC1"}], f)
    assert sorted(r["smiles"] for r in sources.read_smiles_json(spark, str(tmp_path / "stock.json.gz")).collect()) == ["C1CC1", "CCO"]
    rows = spark.createDataFrame([("CCO", 3, 0, [1, 5]), ("C1CC1", 3, 1, [])], sources.PROPERTIES)
    sources.write_properties(rows, str(tmp_path / "properties"))
    assert sorted(map(tuple, sources.read_properties(spark, str(tmp_path / "properties")).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    (tmp_path / "array.json").write_text(json.dumps([r.asDict() for r in rows.collect()]))
    assert sources.read_properties(spark, str(tmp_path / "array.json"), array=True).count() == 2
    sources.write_unique(rows.unionAll(rows), "cano_smiles", str(tmp_path / "unique"))
    assert sorted(r["smiles"] for r in sources.read_lines(spark, str(tmp_path / "unique")).collect()) == ["C1CC1", "CCO"]
    numbered = sources.with_ids(spark.range(1000).repartition(5)).collect()
    assert sorted(r["bb_id"] for r in numbered) == list(range(1000)) and len({r["id"] for r in numbered}) == 1000
    assert [r["bb_id"] for r in sources.with_ids(spark.range(50, numPartitions=3)).orderBy("id").collect()] == list(range(50))


def test_assembly_against_brute_force(spark):
    """Random molecules: fragments, cuts that stay, atoms and open ends of combs, connected or not."""
    rng = np.random.default_rng(8)
    atoms, bonds = [], []
    for t in range(6):
        n = int(rng.integers(4, 14))
        atoms += [(t, a) for a in range(n)]
        ends = [(int(rng.integers(0, a)), a) for a in range(1, n)] + [tuple(map(int, rng.choice(n, 2, replace=False)))]
        bonds += [(t, k, a, b, bool(rng.random() < 0.4)) for k, (a, b) in enumerate(ends)]
    atoms.append((9, 5))
    a, b = spark.createDataFrame(atoms, "target_id int, atom long"), spark.createDataFrame(bonds, "target_id int, bond_seq int, a1 long, a2 long, cut boolean")
    placed = assembly.fragments(a, b)
    at = {(r["target_id"], r["atom"]): r["frag_id"] for r in placed.collect()}

    def piece(t, start, kept):
        seen, todo = set(), [start]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [q if p == x else p for u, _, p, q, _ in kept if u == t and x in (p, q)]
        return seen

    for t, x in atoms:
        assert {y for u, y in atoms if u == t and at[u, y] == at[t, x]} == piece(t, x, [r for r in bonds if not r[4]])
    firsts = {}
    for t, x in sorted(atoms):
        firsts.setdefault((t, at[t, x]), x)
    assert all(f == sorted(g for u, g in firsts if u == t).index(f) for t, f in firsts)
    cuts = assembly.cuts(b, placed)
    asked = [(t, mask(c)) for t in range(6) for n in (1, 2, 3) for c in combinations(sorted({f for u, f in firsts if u == t}), n)]
    df = spark.createDataFrame(asked, "target_id int, mask long")
    inside = lambda m, t, x: m >> at[t, x] & 1
    open_ = {(t, m): [r for r in bonds if r[0] == t and r[4] and not (inside(m, t, r[2]) and inside(m, t, r[3]))] for t, m in asked}
    got = {(r["target_id"], r["mask"]): (r["atoms"], r["ends"]) for r in assembly.assembled(df, placed, cuts).collect()}
    assert set(got) == set(asked)
    stay = {(r["target_id"], r["mask"], r["bond_seq"]) for r in assembly.broken(df, cuts).collect()}
    assert stay == {(t, m, r[1]) for (t, m), rs in open_.items() for r in rs}
    for (t, m), rs in open_.items():
        low = (m & -m).bit_length() - 1
        whole = piece(t, firsts[t, low], [r for r in bonds if r not in rs])
        assert got[t, m] == (sorted(whole), sorted(p if p in whole else q for _, _, p, q, _ in rs if (p in whole) != (q in whole)))
    assert assembly.fragments(a.limit(0), b).isEmpty()


@pytest.mark.parametrize("few", [0, 10_000])
def test_property_screen_ways(spark, few):
    """Broadcast and ranges give the same pairs, nulls and ties included."""
    rng = np.random.default_rng(2)
    stock = [(k, None if k % 17 == 0 else int(rng.integers(0, 9)), int(rng.integers(0, 5))) for k in range(200)]
    asked = [(k, None if k == 3 else int(rng.integers(-1, 11)), int(rng.integers(0, 5))) for k in range(30)]
    s, q = spark.createDataFrame(stock, "bb_id int, size int, rings int"), spark.createDataFrame(asked, "query_id int, q_size int, q_rings int")
    got = sorted((r["query_id"], r["bb_id"]) for r in screen.property_screen(q, s, [("q_size", "size"), ("q_rings", "rings")], few).collect())
    assert got == sorted((i, j) for i, a, b in asked for j, x, y in stock if None not in (a, x) and x >= a and y >= b)
    assert screen.property_screen(q, s.limit(0), [("q_size", "size")], few).isEmpty()


def test_items_of_solutions(spark):
    numbered = spark.createDataFrame([(1, 1, [[0, 1], [2]], 2), (1, 2, [[0], [1, 2]], 2)], "target_id int, solution_no int, combs array<array<int>>, n_parts int")
    items = spark.createDataFrame([(1, [0, 1], k, 50 - k // 2) for k in range(12)] + [(1, [0], 7, 1), (2, [2], 7, 1)], "target_id int, comb array<int>, bb_id int, size int")
    got = {(r["solution_no"], tuple(r["comb"]), r["item_no"]): (r["bb_id"], r["n_items"], r["page"]) for r in cover.items_of(numbered, items).collect()}
    order = sorted(range(12), key=lambda k: (50 - k // 2, k))
    assert got == {(1, (0, 1), i + 1): (k, 12, i // 10) for i, k in enumerate(order)} | {(2, (0,), 1): (7, 1, 0)}


@pytest.mark.parametrize("cap", [1, 3, 7])
def test_capped_covers_are_the_first_ones(spark, cap):
    """Cutting partial covers keeps the first solutions of the whole list; a target without a cover stays without."""
    rng = np.random.default_rng(cap)
    valid = [(t, m) for t in range(5) for m in range(1, 64) if bin(m).count("1") == 1 or rng.random() < 0.4]
    v = spark.createDataFrame([*valid, (7, 1)], "target_id int, mask long")
    sizes = spark.createDataFrame([(t, 6) for t in range(5)] + [(7, 2)], "target_id int, n int")
    every = sorted(map(tuple, cover.capped(cover.numbered(cover.solutions(v, sizes)), cap).collect()))
    assert sorted(map(tuple, cover.capped(cover.numbered(cover.solutions(v, sizes, cap)), cap).collect())) == every
    assert {r[0] for r in every} == set(range(5)) and len(every) == 5 * cap


@pytest.mark.parametrize("block_rows", [7, 1 << 20])
def test_running_sums_over_blocks(spark, block_rows):
    """A hot group, a null group, null values and no rows."""
    rng = np.random.default_rng(4)
    rows = [(None if k % 11 == 0 else "hot" if k % 3 else f"g{k % 5}", k, None if k % 7 == 0 else int(rng.integers(0, 9))) for k in range(100)]
    df = spark.createDataFrame(rows, "g string, k int, v long")
    got = {r["k"]: (r["row_no"], r["n_rows"], r["running"]) for r in running.so_far(df, "g", ["k"], "v", block_rows).collect()}
    want = {}
    for g, k, _ in rows:
        own = [(j, v or 0) for h, j, v in rows if h == g]
        want[k] = (sum(j <= k for j, _ in own), len(own), sum(v for j, v in own if j <= k))
    assert got == want
    assert running.so_far(df.limit(0), "g", ["k"], block_rows=block_rows).isEmpty()


def test_containment_of_many_bits(spark):
    """Queries of more bits than a key is made of, among items that share most of them."""
    rng = np.random.default_rng(9)
    longs = [int(np.array(sum(1 << int(b) for b in rng.choice(64, n, replace=False)), np.uint64).view(np.int64)) for n in (12, 30, 50) for _ in range(4)]
    stock = [(k, m | longs[(k + 1) % 12], 1 + k % 3) for k, m in enumerate(longs)] + [(100 + k, m, 2) for k, m in enumerate(longs)]
    asked = [(k, m, 2) for k, m in enumerate(longs)]
    got = {tuple(r) for r in screen.screened(spark.createDataFrame(asked, "query_id long, mask long, n long"), spark.createDataFrame(stock, "bb_id long, mask long, n long")).collect()}
    assert got == {(q, b) for q, m, n in asked for b, s, size in stock if s & m == m and size >= n}


def test_numbers_follow_files(spark, tmp_path):
    """A small file beside a larger one: numbers go by the file's name, then by the line."""
    (tmp_path / "a.txt").write_text("".join(f"a{k}\n" for k in range(5)))
    (tmp_path / "b.txt").write_text("".join(f"b{k}\n" for k in range(30_000)))
    (tmp_path / "c.txt").write_text("c0")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 40_000)
    try:
        got = sources.with_ids(sources.read_lines(spark, str(tmp_path))).orderBy("bb_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.bb_id for r in got] == list(range(30_006))
    assert [r.smiles for r in got] == [f"a{k}" for k in range(5)] + [f"b{k}" for k in range(30_000)] + ["c0"]


def test_queries_without_bits_form_no_product(spark):
    stock = spark.createDataFrame([(0, 1, 2), (5, 3, 1), (2, 2, 4)], "mask long, n long, weight long")
    asked = spark.createDataFrame([(0, 1), (0, 3), (0, 4)], "mask long, n long")
    found = screen.containment_join(asked, stock)
    assert {(r.n, r.s_mask) for r in found.collect()} == {(1, 0), (1, 5), (1, 2), (3, 5)}
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()
