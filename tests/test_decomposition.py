"""Pieces cut again and put together again, against known pieces and plain Python."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scissile.operators import cutting, decomposition, graphs
from scissile.operators.molecules import Molecules, molecules
from scissile.tables import stored

TEXT = "target_id long, smiles string"


def read(spark, texts):
    return Molecules(*[stored(t, "read") for t in molecules(spark.createDataFrame(list(enumerate(texts)), TEXT))])


def keys(spark, texts):
    rows = decomposition.piece_rows(read(spark, texts))
    at = {r.target_id: r.key for r in graphs.canonical(rows).collect()}
    return [at[k] for k in range(len(texts))]


PYRIDINE, ETHER = "CCCOCc1cc(c2ncccc2)ccc1", "CCCOCC"
#: The pieces of known molecules, by whether all are kept and the least size.
LEAVES = {
    PYRIDINE: ["[14*]c1ccccn1", "[16*]c1cccc([16*])c1", "[3*]O[3*]", "[4*]CCC", "[4*]C[8*]"],
    "CNC(=O)c1nccc(Oc2ccc(NC(=O)Nc3cc(c(Cl)cc3)C(F)(F)F)cc2)c1": [
        "[1*]C([1*])=O", "[1*]C([6*])=O", "[14*]c1cc([16*])ccn1", "[16*]c1ccc(Cl)c([16*])c1", "[16*]c1ccc([16*])cc1", "[3*]O[3*]", "[5*]NC", "[5*]N[5*]", "[8*]C(F)(F)F",
    ],
    ETHER: ["[3*]O[3*]", "[4*]CC", "[4*]CCC"], "CCCC": ["CCCC"],
}
ALL = {
    ETHER: [ETHER, "[3*]OCC", "[3*]OCCC", "[3*]O[3*]", "[4*]CC", "[4*]CCC"],
    PYRIDINE: [
        PYRIDINE, "[14*]c1ccccn1", "[16*]c1cccc(c2ccccn2)c1", "[16*]c1cccc(COCCC)c1", "[16*]c1cccc([16*])c1", "[3*]OCCC", "[3*]OC[8*]", "[3*]OCc1cccc(c2ccccn2)c1",
        "[3*]OCc1cccc([16*])c1", "[3*]O[3*]", "[4*]CCC", "[4*]C[8*]", "[4*]Cc1cccc(c2ccccn2)c1", "[4*]Cc1cccc([16*])c1", "[8*]COCCC",
    ],
}
ONCE = [PYRIDINE, "[14*]c1ccccn1", "[16*]c1cccc(c2ccccn2)c1", "[16*]c1cccc(COCCC)c1", "[3*]OCCC", "[3*]OCc1cccc(c2ccccn2)c1", "[4*]CCC", "[4*]Cc1cccc(c2ccccn2)c1", "[8*]COCCC"]
SIZES = {(2, True): [ETHER, "[3*]OCC", "[3*]OCCC", "[4*]CC", "[4*]CCC"], (3, True): [ETHER, "[3*]OCC", "[4*]CCC"], (2, False): ["[3*]OCC", "[3*]OCCC", "[4*]CC", "[4*]CCC"]}


def found(df):
    got = defaultdict(set)
    for r in df.select("target_id", "key").collect():
        assert r.key not in got[r.target_id]
        got[r.target_id].add(r.key)
    return got


def named(spark, lists):
    flat = sorted({p for ps in lists for p in ps})
    of = dict(zip(flat, keys(spark, flat)))
    return [{of[p] for p in ps} for ps in lists]


def test_known_pieces(spark):
    mols = read(spark, list(LEAVES))
    graph = decomposition.cut_graph(mols)
    leaves, every = found(decomposition.reached(graph)), found(decomposition.reached(graph, keep_nodes=True))
    want = named(spark, LEAVES.values())
    assert [leaves[k] for k in range(len(LEAVES))] == want
    at = {t: k for k, t in enumerate(LEAVES)}
    assert {t: every[at[t]] for t in ALL} == dict(zip(ALL, named(spark, ALL.values())))


def test_sizes_and_a_single_pass(spark):
    ether = read(spark, [ETHER])
    for (least, keep), want in zip(SIZES, named(spark, SIZES.values())):
        assert found(decomposition.decompose(ether, min_size=least, keep_nodes=keep))[0] == want
    assert found(decomposition.decompose(read(spark, [PYRIDINE]), single_pass=True))[0] == named(spark, [ONCE])[0]
    assert decomposition.decompose(read(spark, [])).count() == 0


def least_tree(atoms, bonds):
    """The least text of a tree over all its roots."""
    near = defaultdict(list)
    for a, b in bonds:
        near[a].append(b)
        near[b].append(a)

    def text(i, before):
        return atoms[i] + "(" + ",".join(sorted(text(j, i) for j in near[i] if j != before)) + ")"

    return min(text(i, None) for i in range(len(atoms)))


def put_together(library, depth_most):
    """All products by depth, in plain Python: {least text: (depth, complete)}."""
    number = lambda x: int(x[1:-1]) if x.startswith("*") else None
    fit = {(int(a.rstrip("ab")), int(b.rstrip("ab"))) for x, y, kind, _ in cutting.CLASSIC.pairs if kind == "-" for a, b in [(x, y), (y, x)]}
    seen, now = {}, library
    for depth in range(depth_most + 1):
        after = {}
        for xa, ba in now:
            for xb, bb in library:
                for p, x in enumerate(xa):
                    for q, y in enumerate(xb):
                        if not (x.startswith("*") and y.startswith("*") and (number(x), number(y)) in fit):
                            continue
                        n = len(xa)
                        at = next(b if a == p else a for a, b in ba if p in (a, b))
                        bt = next(b if a == q else a for a, b in bb if q in (a, b))
                        keep = [i for i in range(n) if i != p] + [n + j for j in range(len(xb)) if j != q]
                        to = {i: k for k, i in enumerate(keep)}
                        bonds = [(a, b) for a, b in ba if p not in (a, b)] + [(a + n, b + n) for a, b in bb if q not in (a, b)] + [(at, bt + n)]
                        atoms = [(xa + xb)[i] for i in keep]
                        bonds = [(to[a], to[b]) for a, b in bonds]
                        t = least_tree(atoms, bonds)
                        if t not in seen:
                            after[t] = (atoms, bonds)
                            seen[t] = (depth, not any(a.startswith("*") for a in atoms))
        now = [g for t, g in after.items() if not seen[t][1]]
    return seen


LIBRARIES = [
    ["[4*]CC", "[4*]CCC", "[3*]O[3*]"], ["[4*]CC([4*])C", "[5*]NC", "[3*]OC"], ["[4*]C[4*]", "[5*]N[5*]", "[11*]SC"], ["CC"], ["[4*]CC", "[4*]CCO"], ["[8*]C(C)[8*]", "[16*]CC", "[4*]CC"],
]


def test_putting_together_against_brute_force(spark):
    texts = [(k, p) for k, ps in enumerate(LIBRARIES) for p in ps]
    mols = read(spark, [p for _, p in texts])
    rows = decomposition.piece_rows(mols)
    library = stored(decomposition._keyed(rows, "library").withColumn("target_id", F.element_at(F.array(*[F.lit(k) for k, _ in texts]), F.col("target_id").cast("int") + 1)), "library")

    def plain(r):
        atoms = [f"*{a.isotope}*" if a.symbol == "*" else f"{a.symbol}{a.hydrogens}" for a in r.atoms]
        return atoms, [(i, b.to) for i, bs in enumerate(r.adj) for b in bs if i < b.to]

    want = {}
    for k in range(len(LIBRARIES)):
        pieces = [plain(r) for r in library.where(F.col("target_id") == k).collect()]
        for t, (depth, complete) in put_together(pieces, 3).items():
            want[k, t] = (depth, complete)
    got = {}
    for r in decomposition.recombine(library, only_complete=False).collect():
        t = least_tree(*plain(r))
        assert (r.target_id, t) not in got
        got[r.target_id, t] = (r.depth, r.complete)
    assert got == want and sum(c for _, c in want.values()) > 5


@pytest.mark.parametrize("name", ["recursive_pieces", "recombined_pieces"])
def test_queries_against_sql(spark, name):
    import duckdb

    from scissile.plans import pieces

    small = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from '{small}/lineitem.parquet'")
    got = pieces.QUERIES[name](spark, small).toPandas()
    want = c.execute(pieces.ORACLE[name]).df()
    cols = sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[cols].astype(str).values))
    assert len(got) and sorted(got.columns) == cols and rows(got) == rows(want)
