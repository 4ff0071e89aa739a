"""Work that many targets share: lists of what items hold, equal sets of valid combs, and what is broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from scissile import tables
from scissile.operators import cover, items, screen
from scissile.operators.classes import classes
from scissile.plans import pieces
from scissile.plans.disassembly import disassemble

SMALL = "/root/testdata/sf0.001"


class Met(Exception):
    """How many targets an operator was given."""


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("wide", [False, True])
def test_subsets_of_items(spark, wide):
    rng = random.Random(5)
    pool = [0, 1, 62, 63] + ([64, 127] if wide else [7])
    column = lambda bs: [signed(sum(1 << (b - 64 * k) for b in bs if b // 64 == k)) for k in (0, 1)] if wide else signed(sum(1 << b for b in bs))
    stock = [(frozenset(rng.sample(pool, rng.randint(0, 5))), rng.randint(1, 4)) for _ in range(60)]
    masks = screen.distinct_masks(spark.createDataFrame([(k, column(m), n) for k, (m, n) in enumerate(stock)], f"bb_id int, mask {'array<long>' if wide else 'long'}, n int"))
    few, many, total = items.by_bits(masks)
    assert many.isEmpty()
    fps = {frozenset(rng.sample(pool, k)) for k in range(5) for _ in range(4)}
    asked = spark.createDataFrame([(column(fp),) for fp in fps], f"fp {'array<long>' if wide else 'long'}")
    key = lambda v: tuple(v) if wide else v
    for stage in (1, 3):
        got = {key(r.fp): (r.n_bb, r.n_tested) for few_ in (0, 100) for r in items.looked_up(asked, items.subsets(few, total), stage, few_).collect()}
        size = lambda fp, n: sum(fp <= m and s >= n for m, s in stock)
        assert got == {key(column(fp)): (size(fp, stage), size(fp, stage - 1)) for fp in fps if size(fp, stage - 1)}


def test_listed_and_numbered_items_add_up(spark, monkeypatch):
    """Items of few bits in the list, the others numbered: any split gives the same rows."""
    rng = random.Random(3)
    frags = spark.createDataFrame([(t, k, 1 << rng.randrange(9)) for t in range(40) for k in range(rng.randint(1, 5))], "target_id int, frag_id int, fp long")
    edges = frags.where("frag_id > 0").select("target_id", (F.col("frag_id") - 1).alias("u"), F.col("frag_id").alias("v"))
    stock = spark.createDataFrame([(k, sum(1 << b for b in rng.sample(range(9), rng.randint(1, 7))), rng.randint(1, 6)) for k in range(90)], "bb_id int, mask long, n int")
    rows, numbered = {}, {}
    for share in (0, 4, 128):
        monkeypatch.setattr(items, "SUBSETS", share)
        numbered[share] = items.by_bits(screen.distinct_masks(stock))[1].count()
        rows[share] = sorted(map(str, disassemble(frags, edges, stock, 2).collect()))
    assert rows[0] == rows[4] == rows[128] and len(rows[0]) > 200
    assert numbered[0] > numbered[4] > numbered[128] == 0


@pytest.mark.parametrize(("name", "operator"), [("exact_cover", "solution_counts"), ("running_solved_rate", "solution_counts"), ("solutions_capped", "solutions"), ("solutions_by_parts", "CoverIndex")])
def test_equal_sets_of_valid_combs_are_covered_once(spark, monkeypatch, name, operator):
    def met(valid, sizes, *_, **__):
        raise Met(sizes.select("target_id").distinct().count())

    monkeypatch.setattr(cover, operator, met)
    with pytest.raises(Met) as e:
        pieces.QUERIES[name](spark, SMALL)
    forms = spark.read.parquet(f"{SMALL}/lineitem.parquet").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_partkey") % 48))).alias("x")).select("x").distinct().count()
    assert 0 < e.value.args[0] < forms / 2


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_files_are_not_broadcast(spark):
    """Numbers in a row take little room in files and much in memory."""
    rows = tables.stored(spark.range(300_000).select(F.col("id").alias("target_id"), F.lit(1).alias("x")), "rows")
    same = classes(spark.range(1000).select(F.col("id").alias("target_id"), (F.col("id") % 10).alias("form")))
    assert "BroadcastHashJoin" not in joins(same.of_all(rows))
    assert "BroadcastHashJoin" in joins(same.of_all(rows.where("target_id < 10")))
    with tables.broadcasts_measured(spark):
        assert "BroadcastHashJoin" not in joins(rows.join(rows.withColumnRenamed("x", "y"), "target_id"))
    assert spark.conf.get(tables.BY_FILES) == "10485760b"


def test_stored_steps_are_broadcast_by_rows(spark):
    rows = tables.stored(spark.range(1_000_000).select(F.col("id").alias("target_id"), F.lit(1).alias("x")), "rows")
    joined = rows.join(rows.withColumnRenamed("x", "y"), "target_id")
    assert "BroadcastHashJoin" in joins(joined)  # by its files it would be
    assert tables.stored(joined, "joined").count() == 1_000_000
    done = spark._jsparkSession.sharedState().statusStore().executionsList()
    plan = next(p for k in range(done.size() - 1, -1, -1) if "InsertIntoHadoopFsRelation" in (p := done.apply(k).physicalPlanDescription()))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_texts_of_orders(spark):
    """Lines in their order whatever way they are grouped, labels at both ends of closed orders, misspelt ones."""
    from scissile.plans import structures

    got = {r.target_id: r.smiles for r in structures.texts(spark, SMALL).collect()}
    lines = {}
    for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").collect():
        lines.setdefault(r.l_orderkey, []).append(("CCCCCNOS"[r.l_partkey % 8], ["(=O)", "(C)", "", ""][r.l_suppkey % 4]))
    want = {}
    for t, row in lines.items():
        ends = {0, len(row) - 1} if len(row) >= 3 and t % 3 == 0 else set()
        want[t] = "".join(a + "1" * (k in ends) + b for k, (a, b) in enumerate(row)) + ("X" if t % 101 == 0 else "(" if t % 97 == 0 else "")
    assert got == want


def test_forest_takes_one_loop(spark, monkeypatch):
    """Parents are neighbours one step nearer to the lowest atom; a long row takes a round a bond, and parts are found in the same rounds."""
    from scissile.operators import rings

    rng = random.Random(8)
    graphs = {0: [(k, k + 1) for k in range(15)], **{t: [(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randint(1, 12))] for t in range(1, 12)}}
    bonds = spark.createDataFrame([(t, k, a, b) for t, es in graphs.items() for k, (a, b) in enumerate(es)], "target_id long, bond_seq long, a1 long, a2 long")
    steps, stored = [], tables.stored
    for module in (rings, __import__("scissile.operators.assembly", fromlist=["stored"])):
        monkeypatch.setattr(module, "stored", lambda df, name: steps.append(name) or stored(df, name))
    got = {(r.target_id, r.atom): (r.parent, r.bond_seq) for r in rings.spanning_forest(bonds).collect()}
    assert len(steps) < 22
    for t, es in graphs.items():
        atoms, far = {x for a, b in es for x in (a, b) if a != b}, {}
        while rest := atoms - far.keys():
            now, far[min(rest)] = [min(rest)], 0
            while now:
                now = [y for x in now for a, b in es for u, y in ((a, b), (b, a)) if u == x and y not in far and far.setdefault(y, far[x] + 1)]
        want = {x: min((u, k) for k, (a, b) in enumerate(es) for u, y in ((a, b), (b, a)) if y == x and far[u] == far[x] - 1) for x in atoms if far[x]}
        assert {x: v for (g, x), v in got.items() if g == t} == want
