"""Text of molecules as tables of atoms and bonds, and a table of what could not be read.

A SMILES is cut into tokens, and one SQL fold over them, a pushdown automaton with
branches as a stack and open ring labels as a list, gives the bonds. It works row
by row: nothing is shuffled until the atoms' neighbourhoods are counted.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import removed, stored
from .rings import ring_bonds

TOKEN = r"\[[^\[\]]*\]|Br|Cl|[BCNOPSFIbcnops*]|%\d\d|\d|[-=#$:/\\().~]"
BRACKET = r"^\[(\d*)(\*|[A-Z][a-z]?|[a-z][a-z]?)(@{0,2})(H\d*)?(\+\+|--|[+-]\d*)?(:\d+)?\]$"
# The symbols of the elements, those written small in aromatic rings, and the valences that hydrogens fill up.
ELEMENTS = """* H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In
Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm
Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og""".split()
AROMATIC = ["b", "c", "n", "o", "p", "s", "se", "as", "te", "si"]
VALENCES = {"B": [3], "C": [4], "N": [3], "O": [2], "P": [3, 5, 7], "S": [2, 4, 6], "F": [1], "Cl": [1], "Br": [1], "I": [1, 3, 5]}

_BONDS = "array<struct<a1:int,a2:int,kind:string,tree:boolean>>"
_OPEN = "array<struct<label:int,atom:int,kind:string>>"
_STATE = f"struct<at:int,stack:array<int>,kind:string,n:int,open:{_OPEN},bonds:{_BONDS},wrong:string>"


class Molecules(NamedTuple):
    #: (target_id, atom, symbol, aromatic, isotope, charge, chiral, hydrogens, degree, n_ring_bonds)
    atoms: DataFrame
    #: (target_id, bond_seq, a1, a2, kind, ring); kind is one of - = # $ :
    bonds: DataFrame
    #: (target_id, smiles, reason)
    rejects: DataFrame


def _read(s: Column, t: Column) -> Column:
    """The state after a token."""
    first = F.substring(t, 1, 1)
    is_atom, is_ring, is_bond = t.rlike(r"^(\[|[A-Za-z*])"), t.rlike(r"^[%\d]"), t.rlike(r"^[-=#$:/\\~]")
    opens, closes, apart = first == "(", first == ")", first == "."
    label = F.regexp_replace(t, "%", "").cast("int")
    hit = F.get(F.filter(s["open"], lambda x: x["label"] == label), F.lit(0))
    pending = s["kind"] != ""
    tied = F.when(pending, s["kind"]).otherwise(F.coalesce(hit["kind"], F.lit("")))
    bond = lambda a, b, kind, tree: F.struct(a.alias("a1"), b.alias("a2"), kind.alias("kind"), F.lit(tree).alias("tree"))
    wrong = (
        F.when(is_bond & pending, "two bonds in a row").when(is_bond & (s["at"] < 0), "bond without an atom before it")
        .when((opens | closes | apart) & pending, "bond without an atom behind it").when(opens & (s["at"] < 0), "branch without an atom")
        .when(closes & (F.size(s["stack"]) == 0), "branch closed twice").when(apart & (F.size(s["stack"]) > 0), "dot in a branch")
        .when(is_ring & (s["at"] < 0), "ring label without an atom").when(is_ring & (hit["atom"] == s["at"]), "ring of one atom")
        .when(is_ring & pending & (hit["kind"] != "") & (hit["kind"] != s["kind"]), "ring closed by two kinds of bonds")
    )
    grown = F.when(is_atom & (s["at"] >= 0), F.array_append(s["bonds"], bond(s["at"], s["n"], s["kind"], True))).when(is_ring & hit.isNotNull(), F.array_append(s["bonds"], bond(hit["atom"], s["at"], tied, False)))
    still = F.filter(s["open"], lambda x: x["label"] != label)
    opened = F.array_append(s["open"], F.struct(label.alias("label"), s["at"].alias("atom"), s["kind"].alias("kind")))
    return F.struct(
        F.when(is_atom, s["n"]).when(apart, -1).when(closes, F.coalesce(F.get(s["stack"], F.size(s["stack"]) - 1), F.lit(-1))).otherwise(s["at"]).alias("at"),
        F.when(opens, F.array_append(s["stack"], s["at"])).when(closes, F.slice(s["stack"], 1, F.greatest(F.size(s["stack"]) - 1, F.lit(0)))).otherwise(s["stack"]).alias("stack"),
        F.when(is_bond, t).otherwise("").alias("kind"),
        (s["n"] + is_atom.cast("int")).alias("n"),
        F.when(is_ring, F.when(hit.isNotNull(), still).otherwise(opened)).otherwise(s["open"]).alias("open"),
        F.coalesce(grown, s["bonds"]).alias("bonds"),
        F.coalesce(s["wrong"], wrong).alias("wrong"),
    ).cast(_STATE)


def parsed(smiles: DataFrame) -> DataFrame:
    """(target_id, smiles, tokens, bonds, reason) a row of ``smiles`` (target_id, smiles); a row with a reason has no bonds.

    A null text has the reason ``null``, an empty one is a molecule without atoms.
    """
    start = F.struct(F.lit(-1).alias("at"), F.array().alias("stack"), F.lit("").alias("kind"), F.lit(0).alias("n"), F.array().alias("open"), F.array().alias("bonds"), F.lit(None).alias("wrong")).cast(_STATE)
    tokens = smiles.select("target_id", "smiles", F.regexp_extract_all(F.coalesce("smiles", F.lit("")), F.lit(TOKEN), F.lit(0)).alias("tokens"))
    unknown = F.exists("tokens", lambda t: t.startswith("[") & ~(t.rlike(BRACKET) & (_element(t).isin(ELEMENTS) | _element(t).isin(AROMATIC))))
    read = tokens.withColumn("s", F.aggregate("tokens", start, _read))
    pair = F.transform(F.col("s.bonds"), lambda b: F.struct(F.least(b["a1"], b["a2"]).alias("u"), F.greatest(b["a1"], b["a2"]).alias("v")))
    reason = (
        F.when(F.col("smiles").isNull(), "null").when(F.length(F.array_join("tokens", "")) < F.length("smiles"), "unknown character").when(unknown, "unknown atom")
        .when(F.col("s.wrong").isNotNull(), F.col("s.wrong")).when(F.size("s.stack") > 0, "open branch").when(F.size("s.open") > 0, "open ring")
        .when(F.col("s.kind") != "", "bond without an atom behind it").when(F.size(F.array_distinct(pair)) < F.size("s.bonds"), "two bonds between two atoms")
    )
    known = read.withColumn("reason", reason)
    return known.select("target_id", "smiles", "tokens", F.when(F.col("reason").isNull(), F.col("s.bonds")).alias("bonds"), "reason")


def _element(token: Column) -> Column:
    return F.when(token.startswith("["), F.regexp_extract(token, BRACKET, 2)).otherwise(token)


def _atoms(read: DataFrame) -> DataFrame:
    """(target_id, atom, text, symbol, aromatic, isotope, charge, chiral, written): what is written at each atom of readable rows."""
    is_atom = lambda t: t.rlike(r"^(\[|[A-Za-z*])")
    rows = read.where("reason is null").select("target_id", F.posexplode(F.filter("tokens", is_atom)).alias("atom", "text"))
    part = lambda k: F.regexp_extract("text", BRACKET, k)
    inside, element = F.col("text").startswith("["), _element(F.col("text"))
    charge = F.when(part(5).isin("++", "--"), F.when(part(5) == "++", 2).otherwise(-2)).when(part(5).isin("+", "-"), F.when(part(5) == "+", 1).otherwise(-1)).when(part(5) == "", 0).otherwise(F.expr("try_cast(regexp_extract(text, r'" + BRACKET + "', 5) as int)"))
    hydrogens = F.when(~inside, None).when(part(4) == "", 0).when(part(4) == "H", 1).otherwise(F.expr("try_cast(substring(regexp_extract(text, r'" + BRACKET + "', 4), 2) as int)"))
    return rows.select(
        "target_id", "atom", F.initcap(element).alias("symbol"), (element != "*").__and__(element == F.lower(element)).alias("aromatic"),
        F.expr("try_cast(regexp_extract(text, r'" + BRACKET + "', 1) as int)").alias("isotope"), charge.alias("charge"), F.when(inside, part(3)).otherwise("").alias("chiral"), hydrogens.alias("written"),
    )


def _merged(atoms: DataFrame, bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without hydrogens that are written as atoms of their own at one other atom; these count them in ``written_h``."""
    end = lambda a, b: bonds.select("target_id", "bond_seq", F.col(a).alias("atom"), F.col(b).alias("other"), "kind")
    plain = atoms.where("symbol = 'H' and isotope is null and charge = 0 and coalesce(written, 0) = 0").select("target_id", "atom")
    if plain.isEmpty():
        return atoms.withColumn("more", F.lit(0).cast("long")), bonds
    ends = end("a1", "a2").unionAll(end("a2", "a1"))
    one = ends.join(plain, ["target_id", "atom"]).groupBy("target_id", "atom").agg(F.count("*").alias("n"), F.min("other").alias("other"), F.min("bond_seq").alias("bond_seq"), F.min("kind").alias("kind"))
    heavy = atoms.where("symbol not in ('H', '*')").select("target_id", F.col("atom").alias("other"))
    gone = stored(one.where("n = 1 and kind in ('', '-')").join(heavy, ["target_id", "other"]), "hydrogens")
    more = gone.groupBy("target_id", F.col("other").alias("atom")).agg(F.count("*").alias("more"))
    left = atoms.join(gone.select("target_id", "atom"), ["target_id", "atom"], "left_anti").join(more, ["target_id", "atom"], "left")
    return left.withColumn("more", F.coalesce("more", F.lit(0))), bonds.join(gone.select("target_id", "bond_seq"), ["target_id", "bond_seq"], "left_anti")


def _filled(symbol: Column, bonds_: Column) -> Column:
    """Hydrogens that take an atom with so many bonds to its next valence; null where it has too many."""
    of = lambda vs: F.coalesce(*[F.when(bonds_ <= v, v - bonds_) for v in vs])
    return F.coalesce(*[F.when(symbol == s, of(vs)) for s, vs in VALENCES.items()], F.when(~symbol.isin(*VALENCES), 0))


def molecules(smiles: DataFrame) -> Molecules:
    """Atoms, bonds and rejects of ``smiles`` (target_id, smiles), with one row a target_id; atoms count from 0 in the order of the text.

    Hydrogens are counted at their atoms. A bond between aromatic atoms is
    aromatic (``:``) in a ring and single outside, if nothing is written. Aromatic
    rings must be written small: other texts keep their double bonds. A molecule
    with an atom of too many bonds is rejected whole (reason ``valence``).
    """
    read = stored(parsed(smiles), "parsed")
    drawn = read.where("reason is null").select("target_id", F.posexplode("bonds").alias("bond_seq", "b")).select("target_id", "bond_seq", "b.a1", "b.a2", "b.kind", "b.tree")
    atoms, bonds = _merged(stored(_atoms(read), "written-atoms"), stored(drawn, "drawn"))
    atoms, bonds = stored(atoms, "atoms"), stored(bonds, "bonds")
    parents = bonds.where("tree").select("target_id", F.col("a2").alias("atom"), F.col("a1").alias("parent"), "bond_seq")
    rings = ring_bonds(bonds, parents).withColumn("ring", F.lit(True))
    small = lambda a, c: atoms.select("target_id", F.col("atom").alias(a), F.col("aromatic").alias(c))
    placed = bonds.join(rings, ["target_id", "bond_seq"], "left").withColumn("ring", F.coalesce("ring", F.lit(False))).join(small("a1", "s1"), ["target_id", "a1"]).join(small("a2", "s2"), ["target_id", "a2"])
    kind = F.when(F.col("kind") == "", F.when(F.col("s1") & F.col("s2") & F.col("ring"), ":").otherwise("-")).when(F.col("kind").isin("/", "\\"), "-").otherwise(F.col("kind"))
    kinds = stored(placed.select("target_id", "bond_seq", "a1", "a2", kind.alias("kind"), "ring"), "kinds")
    order = F.when(F.col("kind") == "=", 2).when(F.col("kind") == "#", 3).when(F.col("kind") == "$", 4).otherwise(1)
    end = lambda a: kinds.select("target_id", F.col(a).alias("atom"), order.alias("order"), F.col("ring").cast("int").alias("ring"))
    around = end("a1").unionAll(end("a2")).groupBy("target_id", "atom").agg(F.count("*").alias("degree"), F.sum("order").alias("order"), F.sum("ring").alias("n_ring_bonds"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    met = atoms.join(around, ["target_id", "atom"], "left")
    used = zero("order") + zero("more") + zero("written")
    # An aromatic atom's share of the ring's double bonds counts as one bond more.
    fill = F.when(F.col("aromatic"), F.greatest(_filled(F.col("symbol"), F.lit(0)) - used - 1, F.lit(0))).otherwise(_filled(F.col("symbol"), used))
    over = (F.col("charge") == 0) & ~F.col("aromatic") & fill.isNull()
    counted = met.select(
        "target_id", "atom", "symbol", "aromatic", "isotope", "charge", "chiral", (zero("more") + F.when(F.col("written").isNotNull(), F.col("written")).otherwise(zero(fill))).alias("hydrogens"),
        zero("degree").alias("degree"), zero("n_ring_bonds").alias("n_ring_bonds"), over.alias("over"),
    )
    counted = stored(counted, "counted-atoms")
    bad = counted.where("over").select("target_id").distinct()
    rejects = read.where("reason is not null").select("target_id", "smiles", "reason").unionAll(read.join(bad, "target_id", "left_semi").select("target_id", "smiles", F.lit("valence").alias("reason")))
    good = lambda t: t.join(bad, "target_id", "left_anti")
    removed(atoms, bonds)
    return Molecules(good(counted.drop("over")), good(kinds), rejects)


def neighbours(mols: Molecules, *keep: str) -> DataFrame:
    """(target_id, atom, other, kind, ring, *keep): bonds from both ends, with columns of the other atom."""
    end = lambda a, b: mols.bonds.select("target_id", F.col(a).alias("atom"), F.col(b).alias("other"), "kind", "ring")
    both = end("a1", "a2").unionAll(end("a2", "a1"))
    return both.join(mols.atoms.select("target_id", F.col("atom").alias("other"), *keep), ["target_id", "other"]) if keep else both


def properties(mols: Molecules) -> DataFrame:
    """(target_id, num_heavy_atoms, num_rings) of molecules with atoms; rings: bonds that close one, of a spanning forest's."""
    heavy = mols.atoms.groupBy("target_id").agg(F.count_if(~F.col("symbol").isin("H", "*")).alias("num_heavy_atoms"))
    return heavy.join(ring_counts(mols), "target_id", "left").select("target_id", "num_heavy_atoms", F.coalesce("num_rings", F.lit(0)).alias("num_rings"))


def ring_counts(mols: Molecules) -> DataFrame:
    """(target_id, num_rings): bonds and connected parts less atoms; only bonds in rings and their atoms are looked at."""
    from .assembly import fragments

    inside = mols.bonds.where("ring")
    atoms = inside.select("target_id", F.explode(F.array("a1", "a2")).alias("atom")).distinct()
    parts = fragments(atoms, inside.withColumn("cut", F.lit(False))).groupBy("target_id").agg(F.countDistinct("frag_id").alias("parts"), F.count("*").alias("atoms"))
    return inside.groupBy("target_id").agg(F.count("*").alias("bonds")).join(parts, "target_id").select("target_id", (F.col("bonds") - F.col("atoms") + F.col("parts")).alias("num_rings"))
