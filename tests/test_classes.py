"""Equal targets are worked out once: tables that hold every order three times."""

import duckdb
import pytest

from scissile.operators import assembly, combs, graphs
from scissile.operators.classes import classes
from scissile.operators.molecules import Molecules
from scissile.plans import disassembly, pieces, structures

SMALL = "/root/testdata/sf0.001"


class Met(Exception):
    """How many targets an operator was given."""


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    at = tmp_path_factory.mktemp("copies")
    shifts = {"lineitem": {"l_orderkey": 1500, "l_suppkey": 600}, "orders": {"o_orderkey": 1500, "o_custkey": 150}}
    for name, keys in shifts.items():
        moved = ", ".join(f"{k} + i * {by} as {k}" for k, by in keys.items())
        duckdb.sql(f"copy (select t.* replace ({moved}) from '{SMALL}/{name}.parquet' t, range(3) r(i)) to '{at}/{name}.parquet' (format parquet)")
    return str(at)


def test_classes(spark):
    forms = spark.createDataFrame([(5, [1, 2]), (3, [1, 2]), (4, [2, 1]), (9, [])], "target_id long, form array<int>")
    same = classes(forms)
    assert {tuple(r[c] for c in ("target_id", "n_same")) for r in same.firsts.collect()} == {(3, 2), (4, 1), (9, 1)}
    assert {tuple(r) for r in same.members.collect()} == {(5, 3), (3, 3), (4, 4), (9, 9)}
    rows = spark.createDataFrame([(3, "a"), (3, "b"), (4, "c")], "target_id long, x string")
    assert sorted(map(tuple, same.of_all(rows).collect())) == [(3, "a"), (3, "b"), (4, "c"), (5, "a"), (5, "b")]


#: A query, and the operator that meets its targets first.
CASES = [
    ("connected_combs_n", combs, "connected_levels"),
    ("parent_intersection", combs, "singles"),
    ("initial_fragments", assembly, "fragments"),
    ("comb_assembly", assembly, "fragments"),
    ("canonical_classes", graphs, "graph_rows"),
    ("strict_matches", graphs, "graph_rows"),
    ("molecule_rejects", structures, "molecules"),
    ("molecule_atoms", structures, "molecules"),
    ("molecule_bonds", structures, "molecules"),
    ("molecule_properties_read", structures, "molecules"),
    ("rule_cuts", structures, "molecules"),
    ("ring_bonds_of_graphs", structures, "ring_bonds"),
    ("recursive_pieces", pieces, "molecules"),
    ("recombined_pieces", pieces, "molecules"),
    ("exact_cover", disassembly, "disassemble"),
    ("running_solved_rate", disassembly, "disassemble"),
    ("solution_browse", disassembly, "disassemble"),
    ("solution_texts", disassembly, "disassemble"),
    ("solutions_by_parts", disassembly, "disassemble"),
    ("solutions_capped", disassembly, "disassemble"),
    ("stage_tests", disassembly, "disassemble"),
    ("solved_rate", disassembly, "disassemble"),
    ("stage_counts", disassembly, "disassemble"),
    ("stage_counts_wide", disassembly, "disassemble"),
]


@pytest.mark.parametrize(("name", "where", "operator"), CASES, ids=[c[0] for c in CASES])
def test_equal_targets_are_met_once(spark, copies, monkeypatch, name, where, operator):
    def met(rows, *_, **__):
        raise Met((rows.atoms if isinstance(rows, Molecules) else rows).select("target_id").distinct().count())

    monkeypatch.setattr(where, operator, met)

    def targets(sf_dir):
        with pytest.raises(Met) as e:
            pieces.QUERIES[name](spark, sf_dir)
        return e.value.args[0]

    # Misspelt texts go by the order's number, so that copies have a few more.
    assert 0 < targets(copies) < 1.2 * targets(SMALL)


@pytest.mark.parametrize("name", [c[0] for c in CASES if c[0] in ("connected_combs_n", "parent_intersection", "canonical_classes", "molecule_rejects", "ring_bonds_of_graphs", "exact_cover")])
def test_copies_against_sql(spark, copies, name):
    c = duckdb.connect()
    for t in ("lineitem", "orders"):
        c.execute(f"create view {t} as select * from '{copies}/{t}.parquet'")
    got, want = pieces.QUERIES[name](spark, copies).toPandas(), c.execute(pieces.ORACLE[name]).df()
    cols = sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[cols].astype(str).values))
    assert rows(got) == rows(want)
