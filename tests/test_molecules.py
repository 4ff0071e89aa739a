"""Reading, rings, rule cuts, canonical keys and strict matching, against known values and plain Python."""

import random
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from scissile.operators import cutting, graphs
from scissile.operators.molecules import Molecules, molecules, properties
from scissile.operators.rings import ring_bonds
from scissile.tables import stored

TEXT = "target_id long, smiles string"


def read(spark, texts):
    m = molecules(spark.createDataFrame(list(enumerate(texts)), TEXT))
    return Molecules(*[stored(t, "read") for t in m])


def shown(m, n):
    """Atoms and bonds of each target as short texts."""
    out = [[[], []] for _ in range(n)]
    for r in m.atoms.orderBy("target_id", "atom").collect():
        out[r.target_id][0].append(f"{r.isotope or ''}{r.symbol.lower() if r.aromatic else r.symbol}{r.hydrogens}{'@' * r.n_ring_bonds}{'%+d' % r.charge if r.charge else ''}")
    for r in m.bonds.orderBy("target_id", "bond_seq").collect():
        out[r.target_id][1].append(f"{r.a1}{r.kind}{r.a2}{'@' if r.ring else ''}")
    return [(" ".join(a), " ".join(b)) for a, b in out]


def test_reading(spark):
    known = {
        "": ("", ""), "CCO": ("C3 C2 O1", "0-1 1-2"), "[Na+].[Cl-]": ("Na0+1 Cl0-1", ""), "C%12CCC%12": ("C2@@ C2@@ C2@@ C2@@", "0-1@ 1-2@ 2-3@ 0-3@"),
        "[nH]1cccc1": ("n1@@ c1@@ c1@@ c1@@ c1@@", "0:1@ 1:2@ 2:3@ 3:4@ 0:4@"), "[H]C([H])([H])[2H]": ("C3 2H0", "1-4"), "[H][H]": ("H0 H0", "0-1"),
        "C=1CC1": ("C1@@ C2@@ C1@@", "0-1@ 1-2@ 0=2@"), "F/C=C/F": ("F0 C1 C1 F0", "0-1 1=2 2-3"), "CS(=O)(=O)N": ("C3 S0 O0 O0 N2", "0-1 1=2 1=3 1-4"),
        "[13CH3][C@@H](O)[NH3+]": ("13C3 C1 O1 N3+1", "0-1 1-2 1-3"), "[O-2].[Fe+++]": None, "[Fe++]": ("Fe0+2", ""), "*C[5*]": ("*0 C2 5*0", "0-1 1-2"),
        "C1CC2CC1CC2": ("C2@@ C2@@ C1@@@ C2@@ C1@@@ C2@@ C2@@", "0-1@ 1-2@ 2-3@ 3-4@ 0-4@ 4-5@ 5-6@ 2-6@"),
        "c1ccccc1c1ccncc1": ("c1@@ c1@@ c1@@ c1@@ c1@@ c0@@ c0@@ c1@@ c1@@ n0@@ c1@@ c1@@", "0:1@ 1:2@ 2:3@ 3:4@ 4:5@ 0:5@ 5-6 6:7@ 7:8@ 8:9@ 9:10@ 10:11@ 6:11@"),
        "C" * 300: (" ".join(["C3", *["C2"] * 298, "C3"]), " ".join(f"{k}-{k + 1}" for k in range(299))),
    }
    wrong = {
        "C(C": "open branch", "C)C": "branch closed twice", "C1CC": "open ring", "CC=": "bond without an atom behind it", "C(C)(C)(C)(C)C": "valence", "N(=O)(C)C": "valence", "XC": "unknown character",
        "C11": "ring of one atom", "C==C": "two bonds in a row", "C(.C)": "dot in a branch", "C12CC12": "two bonds between two atoms", "C=1CC#1": "ring closed by two kinds of bonds", "=C": "bond without an atom before it",
        "1CC1": "ring label without an atom", "(C)C": "branch without an atom", "C(=)C": "bond without an atom behind it", "[Qq]": "unknown atom", "[C": "unknown character", "C C": "unknown character", None: "null", "C=.C": "bond without an atom behind it",
    }
    known["[O-2].[Fe+3]"] = ("O0-2 Fe0+3", "")
    del known["[O-2].[Fe+++]"]
    texts = [*known, *wrong]
    m = read(spark, texts)
    got = shown(m, len(texts))
    for t, want, k in zip(known, known.values(), got):
        assert k == want, t
    assert {r.target_id: (r.smiles, r.reason) for r in m.rejects.collect()} == {len(known) + k: (t, why) for k, (t, why) in enumerate(wrong.items())}
    assert all(k == ("", "") for k in got[len(known) :])
    at = {t: k for k, t in enumerate(texts)}
    counts = {r.target_id: (r.num_heavy_atoms, r.num_rings) for r in properties(m).collect()}
    assert [counts[at[t]] for t in ("CCO", "C1CC2CC1CC2", "c1ccccc1c1ccncc1", "[H][H]", "*C[5*]")] == [(3, 0), (7, 2), (12, 2), (0, 0), (1, 0)]
    assert molecules(spark.createDataFrame([], TEXT)).atoms.count() == 0


def in_rings(bonds):
    """Bonds without which their ends stay connected."""
    out = set()
    for k, (a, b) in enumerate(bonds):
        near = defaultdict(set)
        for j, (x, y) in enumerate(bonds):
            if j != k:
                near[x].add(y)
                near[y].add(x)
        seen, todo = {a}, [a]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        if b in seen and a != b:
            out.add(k)
    return out


def test_rings_of_random_graphs(spark):
    rng = random.Random(4)
    cases = [[(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * f))] for n in (1, 2, 5, 9, 14) for f in (0.8, 1.0, 1.2) for _ in range(4)]
    cases += [[(0, 1), (1, 0)], [(3, 3)], [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3)], [(k, k + 1) for k in range(20)], [(k, (k + 1) % 24) for k in range(24)]]
    rows = [(t, k, a, b) for t, bonds in enumerate(cases) for k, (a, b) in enumerate(bonds)]
    got = {tuple(r) for r in ring_bonds(spark.createDataFrame(rows, "target_id long, bond_seq long, a1 int, a2 int")).collect()}
    assert got == {(t, k) for t, bonds in enumerate(cases) for k in in_rings(bonds)}
    assert ring_bonds(spark.createDataFrame([], "target_id long, bond_seq long, a1 int, a2 int")).count() == 0


BOTH = [
    ("CCCOCC", [((3, 2), ("3", "4")), ((3, 4), ("3", "4"))]), ("CCCOCCC(=O)c1ccccc1", [((3, 2), ("3", "4")), ((3, 4), ("3", "4")), ((6, 8), ("6", "16"))]),
    ("CC=CC", [((1, 2), ("7", "7"))]), ("O=C1NCCC1", []), ("CC1(C)CCCCC1", []), ("", []), ("C", []),
]
ONLY = {
    "CLASSIC": [("CCCCCCCCCCCC", []), ("C1CCC2CCCCC2C1", []), ("c1ccccc1S(=O)(=O)n1cccc1", [])],
    "REVISED": [("CCCCCCCCCCCC", [((3, 4), ("20", "21")), ((8, 7), ("20", "21"))]), ("C1CCC2CCCCC2C1", [((3, 2), ("18", "19")), ((3, 4), ("18", "19")), ((8, 7), ("18", "19")), ((8, 9), ("18", "19"))]), ("CCN(C)NC", [((2, 1), ("51", "4"))]), ("C1CCCCC1C1CCCCC1", [((5, 6), ("15", "16"))])],
}


@pytest.mark.parametrize("name", ["CLASSIC", "REVISED"])
def test_rule_cuts(spark, name):
    cases = BOTH + ONLY[name]
    if name == "REVISED":
        cases = [c for c in cases if c[0] != "CCN(C)NC"]
    cuts = cutting.cut_bonds(read(spark, [t for t, _ in cases]), getattr(cutting, name))
    got = defaultdict(list)
    for r in cuts.orderBy("target_id", "cut_no").collect():
        got[r.target_id].append(((r.a1, r.a2), (r.label1, r.label2)))
    assert [got[k] for k in range(len(cases))] == [want for _, want in cases]


def keys(spark, texts, numbered=True):
    rows = graphs.canonical(graphs.graph_rows(read(spark, texts)), numbered).collect()
    at = {r.target_id: r.key for r in rows}
    return [at.get(k) for k in range(len(texts))]


PIECES = {
    "CCCOCc1cc(c2ncccc2)ccc1": ["[14*]c1ccccn1", "[16*]c1cccc([16*])c1", "[3*]O[3*]", "[4*]CCC", "[4*]C[8*]"],
    "CNC(=O)c1nccc(Oc2ccc(NC(=O)Nc3cc(c(Cl)cc3)C(F)(F)F)cc2)c1": [
        "[1*]C([1*])=O", "[1*]C([6*])=O", "[14*]c1cc([16*])ccn1", "[16*]c1ccc(Cl)c([16*])c1", "[16*]c1ccc([16*])cc1", "[3*]O[3*]", "[5*]NC", "[5*]N[5*]", "[5*]N[5*]", "[8*]C(F)(F)F",
    ],
    "CCCOCC": ["[3*]O[3*]", "[4*]CC", "[4*]CCC"],
}


def test_pieces_of_cut_molecules(spark):
    m = read(spark, list(PIECES))
    apart = cutting.cut_apart(m, stored(cutting.cut_bonds(m), "cuts"))
    got = defaultdict(Counter)
    for r in graphs.canonical(graphs.graph_rows(apart, cutting.parts(apart))).collect():
        got[r.target_id][r.key] += 1
    flat = [p for ps in PIECES.values() for p in ps]
    of = dict(zip(flat, keys(spark, flat)))
    assert [got[k] for k in range(len(PIECES))] == [Counter(of[p] for p in ps) for ps in PIECES.values()]
    a, b, c = keys(spark, ["[3*]OC", "[4*]OC", "*OC"], numbered=False)
    assert a == b == c != keys(spark, ["[3*]OC"])[0]


def graph_frame(spark, cases):
    """Molecules of one element: (number of atoms, bonds) each."""
    atoms = [(t, i, x, False, None, 0, 0) for t, (xs, _) in enumerate(cases) for i, x in enumerate(xs)]
    bonds = [(t, k, a, b, kind, False) for t, (_, bs) in enumerate(cases) for k, (a, b, kind) in enumerate(bs)]
    return Molecules(
        spark.createDataFrame(atoms, "target_id long, atom int, symbol string, aromatic boolean, isotope int, charge int, hydrogens int"),
        spark.createDataFrame(bonds, "target_id long, bond_seq int, a1 int, a2 int, kind string, ring boolean"), None,
    )


def random_connected(rng, n, extra, kinds="-="):
    bonds = {(rng.randrange(k), k) for k in range(1, n)}
    for _ in range(extra if n > 1 else 0):
        a, b = rng.sample(range(n), 2)
        bonds.add((min(a, b), max(a, b)))
    return [rng.choice("CCN") for _ in range(n)], [(a, b, rng.choice(kinds)) for a, b in sorted(bonds)]


def moved(rng, case):
    xs, bonds = case
    to = list(range(len(xs)))
    rng.shuffle(to)
    out = [None] * len(xs)
    for i, x in zip(to, xs):
        out[i] = x
    bonds = [(to[a], to[b], k) for a, b, k in bonds]
    rng.shuffle(bonds)
    return out, bonds


def least_form(case):
    """Of all orders of the atoms, the least text."""
    xs, bonds = case
    return min((tuple(xs[p.index(i)] for i in range(len(xs))), tuple(sorted((min(p[a], p[b]), max(p[a], p[b]), k) for a, b, k in bonds))) for p in permutations(range(len(xs))))


def test_canonical_keys(spark):
    rng = random.Random(8)
    small = [random_connected(rng, rng.randint(1, 6), rng.randint(0, 3), "-") for n in range(60) if n or True]
    small = [(["C"] * len(xs) if rng.random() < 0.6 else xs, bonds) for xs, bonds in small]
    ring = lambda n, at=0: [(at + k, at + (k + 1) % n, "-") for k in range(n)]
    # Graphs that colours alone cannot tell apart, and some with many equal atoms.
    two_rings = (["C"] * 10, [*ring(5), *[(a + 5, b + 5, "-") for a, b, _ in ring(5)], (0, 5, "-")])
    fused = (["C"] * 10, [*ring(10), (0, 5, "-")])
    cube = (["C"] * 8, [(a, a ^ b, "-") for a in range(8) for b in (1, 2, 4) if a < a ^ b])
    moebius = (["C"] * 8, [*ring(8), *[(k, k + 4, "-") for k in range(4)]])
    star = (["C"] * 30, [(0, k, "-") for k in range(1, 30)])
    forks = (["C"] * 13, [(0, k, "-") for k in (1, 2, 3, 4)] + [(1 + k // 2, 5 + k, "-") for k in range(8)])
    large = [two_rings, fused, cube, moebius, star, forks, (["N"], [])]
    cases = [*small, *[moved(rng, c) for c in small], *large, *[moved(rng, c) for c in large]]
    rows = graphs.canonical(graphs.graph_rows(graph_frame(spark, cases))).collect()
    got = [r.key for r in sorted(rows, key=lambda r: r.target_id)]
    n, m = len(small), len(large)
    assert got[:n] == got[n : 2 * n] and got[2 * n : 2 * n + m] == got[2 * n + m :]
    assert len(set(got[2 * n : 2 * n + m])) == m
    forms = [least_form(c) for c in small]
    assert all((got[i] == got[j]) == (forms[i] == forms[j]) for i in range(n) for j in range(i))


STRICT = [
    ("[4*]CCN", ["CCCN", "CCCCN", "CCCNC", "NCCCN", "CCN"], [True, True, False, True, True]), ("[4*]CCN[5*]", ["CCCNC", "CCN", "CCNC"], [True, True, True]),
    ("[9*]n1cnc2ncc([14*])nc21", ["Cc1ccc(S(=O)(=O)n2ccc3nc(NN)cnc32)cc1"], [False]), ("[16*]c1ccc([16*])c([16*])c1", ["Brc1ccc(Br)cc1"], [True]), ("CCNC", ["CCNC", "CCCNC"], [True, False]),
    ("[5*]N1CCC[C]1([13*])C", ["BrN1CCCC1(Br)C", "BrN1CCC[C]1([H])C", "BrN1CCCC1C", "BrN1CCCCC1C"], [True, True, True, False]), ("*C*", ["C", "CC", "CCC", "CO", "C=C", "O"], [False, True, True, True, True, False]),
    ("[O-]C*", ["[O-]CC", "OCC"], [True, False]), ("*=CC", ["C=CC", "CC=CC", "CCC"], [True, True, False]), ("*", ["C", "[He]"], [True, True]), ("C1CC1", ["C1CC1", "CC1CC1", "C1CCC1"], [True, False, False]),
    ("*O*", ["O", "CO", "COC"], [False, True, True]),
]


def test_strict_matches(spark):
    items = sorted({t for _, ts, _ in STRICT for t in ts})
    asked = stored(graphs.patterns(graphs.graph_rows(read(spark, [q for q, _, _ in STRICT]))), "patterns")
    stock = stored(graphs.graph_rows(read(spark, items)).withColumnRenamed("target_id", "bb_id"), "stock")
    want = {(q, items.index(t)) for q, (_, ts, yes) in enumerate(STRICT) for t, y in zip(ts, yes) if y}
    asked_for = {(q, items.index(t)) for q, (_, ts, _) in enumerate(STRICT) for t in ts}
    pairs = spark.createDataFrame(sorted(asked_for), "query_id long, bb_id long")
    assert {tuple(r) for r in graphs.strict_matches(pairs, asked, stock).collect()} == want
    # What the kinds of atoms let through holds all that match.
    every = graphs.signature_pairs(asked, stock)
    assert {tuple(r) for r in graphs.strict_matches(every, asked, stock).collect()} >= want
    assert graphs.strict_matches(pairs.limit(0), asked, stock).count() == 0


def matches(pattern, item):
    """By trying all places for all atoms; hydrogens are atoms of their own."""
    (qx, qh, qb), (sx, sh, sb) = pattern, item
    sx, sb = list(sx), list(sb)
    for i, h in enumerate(sh):
        for _ in range(h):
            sb.append((i, len(sx), "-"))
            sx.append("H")
    bonds = {}
    for a, b, k in sb:
        bonds[a, b] = bonds[b, a] = k
    point = {a for a, b, _ in qb if qx[b] == "*"} | {b for a, b, _ in qb if qx[a] == "*"}

    def fits(q, s):
        return qx[q] == "*" or (qx[q] == sx[s] and s < len(sh) and sh[s] in (qh[q], qh[q] + (q in point)))

    def grow(images):
        q = len(images)
        if q == len(qx):
            return True
        for s in range(len(sx)):
            if s not in images and fits(q, s) and all(bonds.get((images[a], s)) == k for a, b, k in [*qb, *[(b, a, k) for a, b, k in qb]] if b == q and a < q) and grow([*images, s]):
                return True
        return False

    return grow([])


def test_strict_matches_of_random_graphs(spark):
    rng = random.Random(3)

    def with_points(case):
        xs, bonds = case
        xs, bonds = list(xs), list(bonds)
        for i in range(len(xs)):
            if rng.random() < 0.5:
                bonds.append((i, len(xs), "-"))
                xs.append("*")
        return xs, [rng.randint(0, 1) if x != "*" else 0 for x in xs], bonds

    queries = [with_points(random_connected(rng, rng.randint(1, 4), 1, "--=")) for _ in range(25)]
    items = [(xs, [rng.randint(0, 2) for _ in xs], bonds) for xs, bonds in (random_connected(rng, rng.randint(1, 6), 2, "--=") for _ in range(40))]

    def rows(cases):
        m = graph_frame(spark, [(xs, bonds) for xs, _, bonds in cases])
        h = spark.createDataFrame([(t, i, n) for t, (_, hs, _) in enumerate(cases) for i, n in enumerate(hs)], "target_id long, atom int, hydrogens int")
        return graphs.graph_rows(Molecules(m.atoms.drop("hydrogens").join(h, ["target_id", "atom"]), m.bonds, None))

    asked = stored(graphs.patterns(rows(queries)), "patterns")
    stock = stored(rows(items).withColumnRenamed("target_id", "bb_id"), "stock")
    want = {(q, s) for q, a in enumerate(queries) for s, b in enumerate(items) if matches(a, b)}
    got = {tuple(r) for r in graphs.strict_matches(graphs.signature_pairs(asked, stock), asked, stock).collect()}
    assert got == want and 20 < len(want) < 900


@pytest.mark.parametrize("name", ["molecule_atoms", "molecule_rejects", "rule_cuts", "canonical_classes", "strict_matches"])
def test_queries_against_sql(spark, name):
    import duckdb

    from scissile.plans import structures

    small = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{small}/lineitem.parquet'")
    got = structures.QUERIES[name](spark, small).toPandas()
    want = c.execute(structures.ORACLE[name]).df()
    cols = sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[cols].astype(str).values))
    assert len(got) and sorted(got.columns) == cols and rows(got) == rows(want)
