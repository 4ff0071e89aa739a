"""Equal targets are worked out once: what comes out for the first of them holds for all.

A target's form is a value that says all that a job asks of it, so that targets of
one form differ by their numbers only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import removed, stored


#: Rows of first targets that are broadcast, at most.
FEW = 10_000


class Classes(NamedTuple):
    #: (target_id, form, n_same), the least target of each form, and how many have the form
    firsts: DataFrame
    #: (target_id, first) for every target
    members: DataFrame

    def of_all(self, rows: DataFrame) -> DataFrame:
        """``rows`` of first targets (target_id, ...), for each target of their form; store them before, as they are counted.

        Few rows are broadcast, so that no class is one task's; more are not, however small their files.
        """
        other = [c for c in rows.columns if c != "target_id"]
        named = rows.withColumnRenamed("target_id", "first")
        named = F.broadcast(named) if rows.limit(FEW + 1).count() <= FEW else named.hint("merge")
        return named.join(self.members, "first").select("target_id", *other)

    def through(self, others: Classes) -> Classes:
        """Classes of the first targets of these ones, as classes of all targets."""
        of = others.members.select(F.col("target_id").alias("__own"), "first")
        return Classes(others.firsts, self.members.withColumnRenamed("first", "__own").join(of.hint("merge"), "__own").select("target_id", "first"))


def classes(forms: DataFrame) -> Classes:
    """Targets of equal form, from a row a target (target_id, form); forms are compared whole, and none is null."""
    forms = stored(forms.select("target_id", "form"), "forms")
    firsts = stored(forms.groupBy("form").agg(F.min("target_id").alias("target_id"), F.count("*").alias("n_same")).select("target_id", "form", "n_same"), "first-targets")
    members = stored(forms.join(firsts.select(F.col("target_id").alias("first"), "form"), "form").select("target_id", "first"), "classes")
    removed(forms)
    return Classes(firsts, members)
