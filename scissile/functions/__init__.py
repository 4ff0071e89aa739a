"""Scalar functions over columns: bit sets, labels of attachment points, counts of a molecule's text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

DUMMY = r"\[\d*\*\]"
#: Atoms of a SMILES: in brackets, or of the organic subset.
ATOM = r"\[[^\]]*\]|Br|Cl|[BCNOPSFIbcnops*]"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once a row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def trimmed(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def without_dummy_labels(smiles: Column) -> Column:
    """Attachment points without their environment numbers."""
    return F.regexp_replace(smiles, DUMMY, "[*]")


def dummies_as_hydrogen(smiles: Column) -> Column:
    """Attachment points, in brackets or bare, as hydrogen."""
    return F.regexp_replace(F.regexp_replace(smiles, DUMMY, "[H]"), r"(?<!\[)\*(?!\])", "[H]")


def environment_number(label: Column) -> Column:
    """A rule label without its letters."""
    return F.regexp_replace(label, "[a-zA-Z]", "")


def heavy_atoms(smiles: Column) -> Column:
    """Atoms other than hydrogen and attachment points."""
    return F.regexp_count(smiles, F.lit(ATOM)) - F.regexp_count(smiles, F.lit(r"\[\d*H\d*[+-]?\d*(:\d+)?\]|\[\d*\*[^\]]*\]|\*(?![^\[]*\])"))


def ring_count(smiles: Column) -> Column:
    """Independent rings: each pair of closure labels outside brackets closes one."""
    bare = F.regexp_replace(smiles, r"\[[^\]]*\]", "*")
    return (F.regexp_count(bare, F.lit(r"%\d\d|\d")) / 2).cast("int")


def well_formed(smiles: Column) -> Column:
    """A cheap test before anything is parsed: not empty, brackets and branches paired, closures in pairs, known letters only."""
    bare = F.regexp_replace(smiles, r"\[[^\[\]]*\]", "*")
    n = lambda c: F.regexp_count(bare, F.lit(c))
    return (F.length(smiles) > 0) & bare.rlike(r"^(Br|Cl|[BCNOPSFIbcnops*]|[-=#:$/\\().~]|%\d\d|\d)+$") & (n(r"\(") == n(r"\)")) & (n(r"%\d\d|\d") % 2 == 0)


def comb_label(comb: Column, smiles: Column) -> Column:
    return F.format_string("%s: %s", F.concat(F.lit("("), F.array_join(F.transform(comb, lambda x: x.cast("string")), ", "), F.lit(")")), smiles)


def bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def contains(whole: Column, part: Column) -> Column:
    """Every bit of ``part`` is in ``whole``; no bits are in anything."""
    return whole.bitwiseAND(part) == part


def contains_words(whole: list[Column], part: list[Column]) -> Column:
    """The same for fingerprints of several longs."""
    return reduce(lambda a, b: a & b, [contains(w, p) for w, p in zip(whole, part, strict=True)])


def is_wide(df: DataFrame, column: str) -> bool:
    """Whether a column has fingerprints as arrays of longs, all of one length, and not as one long."""
    return isinstance(df.schema[column].dataType, ArrayType)


def holds(whole: Column, part: Column, wide: bool) -> Column:
    """``contains`` for a long or, if ``wide``, an array of longs."""
    return F.forall(F.zip_with(whole, part, contains), lambda x: x) if wide else contains(whole, part)


def together(a: Column, b: Column, wide: bool) -> Column:
    """The bits of two fingerprints."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)) if wide else a.bitwiseOR(b)


def bits_of(mask: Column, wide: bool) -> Column:
    """Numbers of all 64 bits of each long that are set."""
    return F.flatten(F.transform(mask, lambda w, k: F.transform(members(w, 64), lambda b: b + k * 64))) if wide else members(mask, 64)


def fingerprint_words(on_bits: Column, size: int = 2048) -> list[Column]:
    """A fingerprint's on-bits as longs; bits at or above ``size`` are an error of the stock."""
    word = lambda k: F.aggregate(F.filter(on_bits, lambda b: F.floor(b / 64) == k), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))))
    checked = F.assert_true(F.forall(on_bits, lambda b: (b >= 0) & (b < size)), "bit outside the fingerprint")
    return [F.when(checked.isNull(), word(k)) for k in range(size // 64)]


def on_bits(words: list[Column]) -> Column:
    """How many bits of a fingerprint of several longs are set."""
    return reduce(lambda a, b: a + b, [F.bit_count(w) for w in words])


def lowest_unset(mask: Column) -> Column:
    """Number of the lowest bit that is not set."""
    return (F.bit_count(mask.bitwiseXOR(mask + 1)) - 1).cast("int")


def lowest_set(mask: Column) -> Column:
    return (F.bit_count(mask.bitwiseXOR(mask - 1)) - 1).cast("int")


def members(mask: Column, size: int = 63) -> Column:
    """Numbers of the set bits, ascending: a comb from its mask. None beyond the highest is tried."""
    highest = F.least(F.length(F.bin(mask)), F.lit(size)) - 1
    return F.filter(F.sequence(F.lit(0), highest), lambda k: mask.bitwiseAND(bit(k)) != 0)


def mask_of(comb: Column) -> Column:
    return F.aggregate(comb, F.lit(0).cast("long"), lambda a, k: a.bitwiseOR(bit(k)))
