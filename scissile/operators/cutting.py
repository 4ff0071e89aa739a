"""Bonds to cut by rules about their two ends.

An environment is a row: what its atom is like, and how many bonds it needs (or
must not have) to atoms of some kind. All environments of all atoms come from one
grouping of the bonds by their atom; what they ask of a neighbour's neighbours is
counted in a grouping before. A rule names two environments and a kind of bond;
of the rules that a bond meets the first one counts.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import members
from ..tables import stored
from .assembly import fragments
from .molecules import Molecules, neighbours


#: A label without its letters is its environment's number.
_NUMBER = re.compile("[a-zA-Z]")


class Environment(NamedTuple):
    label: str
    #: What the atom is, in SQL over its columns.
    atom: str
    #: (least number, what bond and other atom are), the number 0: there must be none.
    bonds: tuple[tuple[int, str], ...] = ()


# Kinds of atoms: aliphatic by element, or in a ring.
_IS = {s: f"(symbol = '{s}' and not aromatic)" for s in "CNOS"}
_RING = "n_ring_bonds > 0"
# Bonds. A bond without a sign in a pattern is single or aromatic.
_PLAIN, _SINGLE, _OPEN_SINGLE, _RING_SINGLE = "kind in ('-', ':')", "kind = '-'", "kind = '-' and not ring", "kind = '-' and ring"


def _to(*kinds: str) -> str:
    """Other atoms: capital letters are aliphatic, small ones aromatic, '#X' either."""
    one = lambda k: f"to_symbol = '{k[1:]}'" if k[0] == "#" else f"(to_symbol = '{k.upper() if len(k) == 1 else k}' and {'' if k.islower() else 'not '}to_aromatic)"
    return "(" + " or ".join(map(one, kinds)) + ")"


_OXO = f"kind = '=' and {_to('O')}"
_AROUND_RING = _to("C", "N", "O", "S")
_IN_RING = f"ring and to_n_ring_bonds > 0 and {_AROUND_RING}"
#: The end of a chain of CH2, and chains of so many CH2 before it from an atom on.
_CHAINS = {"20": 3, "21": 4, "22": 7, "23": 8}

# The environments of the two published rule sets, by their numbers.
_SHARED = [
    Environment("1", f"{_IS['C']} and degree = 3", ((1, f"{_PLAIN} and {_to('#*', '#C', '#N', '#O')}"), (1, _OXO))),
    Environment("3", f"{_IS['O']} and degree = 2", ((1, f"{_OPEN_SINGLE} and {_to('#*', '#C', '#H')}"),)),
    Environment("4", f"{_IS['C']} and degree <> 1", ((0, "kind = '='"), (1, f"{_OPEN_SINGLE} and {_to('#C')}"))),
    Environment("5", f"{_IS['N']} and degree <> 1", ((0, "kind = '='"), (0, f"{_SINGLE} and not {_to('#C', '#S', '#*', '#H')}"), (0, f"in_ring and ring and {_to('C')} and to_n_ring_bonds > 0 and to_oxo > 0"))),
    Environment("6", f"{_IS['C']} and degree = 3 and not {_RING}", ((1, _OXO), (1, f"{_OPEN_SINGLE} and {_to('#*', '#C', '#N', '#O')}"))),
    Environment("7a", f"{_IS['C']} and degree in (2, 3)", ((1, f"{_SINGLE} and {_to('#C')}"),)),
    Environment("7b", f"{_IS['C']} and degree in (2, 3)", ((1, f"{_SINGLE} and {_to('#C')}"),)),
    Environment("10", f"{_IS['N']} and {_RING}", ((1, f"ring and {_to('C')} and to_oxo > 0"), (2, f"ring and {_AROUND_RING}"))),
    Environment("11", f"{_IS['S']} and degree = 2", ((1, f"{_OPEN_SINGLE} and {_to('#*', '#C')}"),)),
    Environment("12", f"{_IS['S']} and degree = 4", ((1, f"{_PLAIN} and {_to('#*', '#C')}"), (2, _OXO))),
    Environment("13", _IS["C"], ((2, f"{_RING_SINGLE} and {_AROUND_RING}"), (1, f"{_RING_SINGLE} and {_to('N', 'O', 'S')}"))),
    Environment("14", "symbol = 'C' and aromatic", ((2, f"kind = ':' and {_to('c', 'n', 'o', 's')}"), (1, f"kind = ':' and {_to('n', 'o', 's')}"))),
    Environment("15", _IS["C"], ((2, f"{_RING_SINGLE} and {_to('C')}"),)),
    Environment("16", "symbol = 'C' and aromatic", ((2, f"kind = ':' and {_to('c')}"),)),
]
_CLASSIC = [
    *_SHARED,
    Environment("8", f"{_IS['C']} and degree <> 1 and not {_RING}", ((0, "kind <> '-'"),)),
    Environment("9", "symbol = 'N' and aromatic and charge = 0", ((2, f"kind = ':' and {_to('c', 'n', 'o', 's')}"),)),
]
_REVISED = [
    *_SHARED,
    Environment("51", f"{_IS['N']} and not {_RING} and degree <> 1", ((1, f"not ring and {_to('N', 'O')}"),)),
    Environment("8", f"{_IS['C']} and degree <> 1 and not {_RING}", ((0, "kind <> '-'"),)),
    Environment("81", f"{_IS['C']} and degree <> 1 and not {_RING}", ((1, f"{_SINGLE} and {_AROUND_RING}"), (1, f"kind = '=' and {_to('N', 'S')}"))),
    Environment("9", f"symbol = 'N' and (aromatic or {_RING}) and charge = 0", ((2, f"ring and (({_AROUND_RING} and to_n_ring_bonds > 0) or {_to('c', 'n', 'o', 's')})"),)),
    Environment("12b", f"{_IS['S']} and degree = 4 and not {_RING}", ((2, f"not ring and {_to('O')}"),)),
    Environment("14b", f"{_IS['C']} and {_RING}", ((2, _IN_RING), (1, f"ring and to_n_ring_bonds > 0 and {_to('N', 'O', 'S')}"))),
    Environment("16b", f"{_IS['C']} and {_RING}", ((2, f"ring and to_n_ring_bonds > 0 and {_to('C')}"),)),
    Environment("17", _IS["C"], ((3, f"{_SINGLE} and {_to('C')}"),)),
    Environment("18", "symbol <> 'H' and n_ring_bonds = 3"),
    Environment("19", "symbol <> 'H' and n_ring_bonds = 2"),
    Environment("182", "symbol <> 'H' and n_ring_bonds = 3"),
    Environment("192", "symbol <> 'H' and n_ring_bonds = 2"),
    *(Environment(k, f"chain_{n}") for k, n in _CHAINS.items()),
    Environment("30", f"{_IS['C']} and degree = 2", ((1, f"{_PLAIN} and {_to('#*', '#C', '#N', '#O', '#S')}"), (1, f"kind = '#' and {_to('N', 'C')}"))),
]
# Pairs of environments in the order in which they are tried; a bond is single and in no ring, unless a sign follows:
# = double and in no ring, ~ single, in a ring or not, -@ single in a ring, =@ double in a ring.
_CLASSIC_PAIRS = """1:3 1:5 1:10 3:4 3:13 3:14 3:15 3:16 4:5 4:11 5:12 5:14 5:16 5:13 5:15 6:13 6:14 6:15 6:16 7a:7b:= 8:9 8:10 8:13 8:14 8:15 8:16
9:13 9:14 9:15 9:16 10:13 10:14 10:15 10:16 11:13 11:14 11:15 11:16 13:14 13:15 13:16 14:14 14:15 14:16 15:16 16:16"""
_REVISED_PAIRS = """1:3 1:5 1:10
30:30 30:4 30:5 30:51 30:6 30:81 30:9 30:10 30:11 30:12 30:12b 30:13 30:14 30:14b 30:15 30:16 30:16b
3:4 3:13 3:14 3:15 3:16 4:5 4:11 5:12 5:14 5:16 5:13 5:15 51:1 51:4 51:12 51:12b 51:14 51:16 51:13 51:15 6:13 6:14 6:15 6:16 7a:7b:=
8:9 8:10 8:13 8:14 8:15 8:16 81:8 81:9 81:10 81:13 81:14 81:15 81:16 9:13 9:14 9:15 9:16 10:13 10:14 10:15 10:16 11:13 11:14 11:15 11:16
12b:12b 12b:5 12b:4 12b:13 12b:14 12b:15 12b:16 13:14:~ 13:15 13:16:~ 14:14:~ 14:15:~ 14:16:~
3:14b 5:14b 51:14b 6:14b 8:14b 81:14b 9:14b 10:14b 11:14b 12b:14b 13:14b 14:14b 14b:14b 14b:16 14b:16b 14b:15 14b:17 15:16:~ 16:16:~
3:16b 5:16b 51:16b 6:16b 8:16b 81:16b 9:16b 10:16b 11:16b 12b:16b 13:16b 15:16b 16:16b 16b:16b 17:16b
17:17 17:16 17:15 17:14 17:13 17:12b 17:12 17:11 17:10 17:9 17:8 17:81 17:51 17:5 18:19:-@ 182:192:=@ 20:21 22:23"""
_KINDS = {"": ("-", [False]), "=": ("=", [False]), "~": ("-", [False, True]), "-@": ("-", [True]), "=@": ("=", [True])}


class Rules(NamedTuple):
    environments: list[Environment]
    #: (environment of one end, of the other, the bond's kind, whether it may lie in a ring or not), the first that fits counts.
    pairs: list[tuple[str, str, str, list[bool]]]


def family(a: str, b: str) -> str:
    """The group of a pair of environments; molecules are cut by a group after another where pieces are cut again."""
    return next((x for x in ("14b", "16b") if x in (a, b)), a)


def _pairs(text: str) -> list[tuple[str, str, str, list[bool]]]:
    parts = [p.split(":") for p in text.split()]
    return [(p[0], p[1], *_KINDS[p[2] if len(p) > 2 else ""]) for p in parts]


CLASSIC = Rules(_CLASSIC, _pairs(_CLASSIC_PAIRS))
REVISED = Rules(_REVISED, _pairs(_REVISED_PAIRS))
#: Only the long chains: for pieces that are cut once more.
CHAINS = Rules(_REVISED, _pairs("20:21"))


def chains(mols: Molecules, lengths: list[int]) -> DataFrame:
    """(target_id, atom, chain_n ...): whether a chain of n CH2 begins at an atom and ends in CH3, a ring's carbon, or one beside another element.

    A CH2 has two such bonds at most, so from an atom and a direction there is one
    way on: chains grow by a join a step, and can only come back to where they began.
    """
    atoms = mols.atoms.where("symbol = 'C'").select("target_id", "atom", "aromatic", "hydrogens", "n_ring_bonds")
    other = neighbours(mols, "symbol").groupBy("target_id", "atom").agg(F.max((F.col("symbol") != "C").cast("int")).alias("beside"))
    known = atoms.join(other, ["target_id", "atom"], "left")
    last = F.col("aromatic") | (F.col("hydrogens") == 3) | (F.col("n_ring_bonds") > 0) | (F.coalesce("beside", F.lit(0)) == 1)
    kinds = stored(known.select("target_id", F.col("atom").alias("to"), (~F.col("aromatic") & (F.col("hydrogens") == 2)).alias("inner"), last.alias("last")), "chain-atoms")
    bonds = neighbours(mols).where(_PLAIN).select("target_id", F.col("atom").alias("at"), F.col("other").alias("to")).join(kinds, ["target_id", "to"])
    bonds = stored(bonds.where("inner or last"), "chain-bonds")
    now = kinds.where("inner").select("target_id", F.col("to").alias("start"), F.lit(None).cast("int").alias("before"), F.col("to").alias("at"))
    found: DataFrame | None = None
    for n in range(1, max(lengths) + 1):
        on = now.join(bonds, ["target_id", "at"]).where("to <> start and (before is null or to <> before)")
        if n in lengths:
            ends = on.where("last").select("target_id", F.col("start").alias("atom"), F.lit(n).alias("n"))
            found = ends if found is None else found.unionAll(ends)
        if n < max(lengths):
            now = stored(on.where("inner").select("target_id", "start", F.col("at").alias("before"), F.col("to").alias("at")), "chains")
    return found.groupBy("target_id", "atom").agg(*[F.max(F.col("n") == n).alias(f"chain_{n}") for n in lengths])


def environments(mols: Molecules, rules: Rules) -> DataFrame:
    """(target_id, atom, envs): a bit for each environment that an atom is, in the order of the rules'."""
    asked = {e for p in rules.pairs for e in p[:2]}
    used = [e for e in rules.environments if e.label in asked]
    lengths = sorted({_CHAINS[e.label] for e in used if e.label in _CHAINS})
    oxo = neighbours(mols, "symbol", "aromatic").where("kind = '=' and symbol = 'O' and not aromatic").groupBy("target_id", "atom").agg(F.count("*").alias("oxo"))
    atoms = stored(mols.atoms.join(oxo, ["target_id", "atom"], "left").withColumn("oxo", F.coalesce("oxo", F.lit(0))), "described-atoms")
    seen = ["symbol", "aromatic", "n_ring_bonds", "oxo"]
    other = atoms.select("target_id", F.col("atom").alias("other"), *[F.col(c).alias(f"to_{c}") for c in seen])
    around = neighbours(mols).join(other, ["target_id", "other"]).join(atoms.select("target_id", "atom", F.expr(_RING).alias("in_ring")), ["target_id", "atom"])
    conditions = {c: f"n_{k}" for k, c in enumerate(dict.fromkeys(c for e in used for _, c in e.bonds))}
    counts = around.groupBy("target_id", "atom").agg(*[F.count_if(F.expr(c)).alias(name) for c, name in conditions.items()])
    whole = atoms.join(counts, ["target_id", "atom"], "left")
    if lengths:
        whole = whole.join(chains(mols, lengths), ["target_id", "atom"], "left")

    def holds(e: Environment) -> Column:
        met = F.coalesce(F.expr(e.atom), F.lit(False))
        for least, c in e.bonds:
            n = F.coalesce(conditions[c], F.lit(0))
            met = met & (n >= least if least else n == 0)
        return met

    bits = [F.when(holds(e), F.lit(1 << rules.environments.index(e)).cast("long")).otherwise(F.lit(0).cast("long")) for e in used]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return whole.select("target_id", "atom", total.alias("envs")).where("envs <> 0")


def fitting_rules(mols: Molecules, rules: Rules) -> DataFrame:
    """(target_id, bond_seq, a1, a2, kind, ring, rule, label1, label2, family): every rule that a bond meets, whichever way round."""
    at = {e.label: k for k, e in enumerate(rules.environments)}
    rows = [(k, at[a], at[b], kind, ring, _NUMBER.sub("", a), _NUMBER.sub("", b), family(a, b)) for k, (a, b, kind, rings) in enumerate(rules.pairs) for ring in rings]
    asked = mols.bonds.sparkSession.createDataFrame(rows, "rule int, env1 int, env2 int, kind string, ring boolean, label1 string, label2 string, family string")
    envs = stored(environments(mols, rules).select("target_id", "atom", F.explode(members(F.col("envs"))).alias("env")), "environments")
    end = lambda k: envs.select("target_id", F.col("atom").alias(f"a{k}"), F.col("env").alias(f"env{k}"))
    bonds = mols.bonds.select("target_id", "bond_seq", "a1", "a2", "kind", "ring")
    ways = bonds.unionAll(bonds.select("target_id", "bond_seq", F.col("a2").alias("a1"), F.col("a1").alias("a2"), "kind", "ring"))
    return ways.join(end(1), ["target_id", "a1"]).join(end(2), ["target_id", "a2"]).join(F.broadcast(asked), ["env1", "env2", "kind", "ring"])  # a few hundred rules at most


def cut_bonds(mols: Molecules, rules: Rules = CLASSIC) -> DataFrame:
    """(target_id, bond_seq, a1, a2, label1, label2, cut_no): bonds that a rule cuts, with the numbers of their ends' environments.

    ``cut_no`` counts a target's cuts from 0 by rule, then by the atoms in the order of
    the rule's environments. Where a rule fits both ways round, the lower atom is first.
    """
    fits = fitting_rules(mols, rules)
    best = fits.groupBy("target_id", "bond_seq").agg(F.min(F.struct("rule", "a1", "a2", "label1", "label2")).alias("b"))
    number = F.row_number().over(Window.partitionBy("target_id").orderBy("b")) - 1
    return best.select("target_id", "bond_seq", "b.a1", "b.a2", "b.label1", "b.label2", number.alias("cut_no"))


def cut_apart(mols: Molecules, cuts: DataFrame) -> Molecules:
    """``mols`` with the bonds of ``cuts`` broken; each end gets an attachment point with its label as isotope.

    The points are atoms behind the others, two a cut: that of its first atom, then
    that of its second. They are bonded as the two atoms were.
    """
    count = mols.atoms.groupBy("target_id").agg((F.max("atom") + 1).alias("n"), F.lit(None).alias("_")).drop("_")
    placed = stored(cuts.join(mols.bonds.select("target_id", "bond_seq", "kind", "ring"), ["target_id", "bond_seq"]).join(count, "target_id"), "placed-cuts")
    point = lambda k, a, label: placed.select("target_id", (F.col("n") + 2 * F.col("cut_no") + k).cast("int").alias("point"), F.col(a).alias("atom"), F.col(label).cast("int").alias("label"), "bond_seq", "kind", "ring")
    points = point(0, "a1", "label1").unionAll(point(1, "a2", "label2"))
    dummy = points.select("target_id", F.col("point").alias("atom"), F.lit("*").alias("symbol"), F.lit(False).alias("aromatic"), F.col("label").alias("isotope"), F.lit(0).alias("charge"), F.lit("").alias("chiral"), F.lit(0).alias("hydrogens"), F.lit(1).alias("degree"), F.lit(0).alias("n_ring_bonds"))
    bonds = mols.bonds.join(cuts.select("target_id", "bond_seq"), ["target_id", "bond_seq"], "left_anti")
    most = mols.bonds.groupBy("target_id").agg((F.max("bond_seq") + 1).alias("m"))
    number = (F.col("m") + F.row_number().over(Window.partitionBy("target_id").orderBy("point")) - 1).cast("int")
    tied = points.join(most, "target_id").select("target_id", number.alias("bond_seq"), F.col("atom").alias("a1"), F.col("point").alias("a2"), "kind", F.lit(False).alias("ring"))
    return Molecules(stored(mols.atoms.unionByName(dummy), "cut-atoms"), stored(bonds.unionByName(tied), "cut-bonds"), mols.rejects)


def parts(mols: Molecules) -> DataFrame:
    """(target_id, atom, frag_id): the connected parts of each target, numbered by their lowest atoms."""
    return fragments(mols.atoms.select("target_id", "atom"), mols.bonds.withColumn("cut", F.lit(False)))
