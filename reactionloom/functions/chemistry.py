"""Column functions on ids, formulas and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ELEMENTS = ("C", "H", "N", "O", "P", "S")
#: How much an element says about a shared skeleton, and what heavy atoms count where none of them is shared.
SKELETON = {"C": 1.0, "N": 0.3, "P": 0.12, "S": 0.12}
HEAVY = 0.15


def species(metabolite_id: Column) -> Column:
    """The compound of an id: without the `M_` of one style and without the compartment of any."""
    return F.regexp_replace(F.regexp_replace(metabolite_id, "^M_", ""), r"(_[a-z]|\[[a-z]\])$", "")


def compartment(metabolite_id: Column) -> Column:
    """The compartment letter of an id, empty where there is none."""
    return F.regexp_extract(metabolite_id, r"(?:_|\[)([a-z])\]?$", 1)


def atoms(formula: Column, element: str) -> Column:
    """Number of atoms of an element; a symbol without a number is one, an unknown formula has none."""
    numbers = F.regexp_extract_all(formula, F.lit(f"{element}([0-9]*)(?:[^a-z0-9]|$)"), F.lit(1))
    counted = F.aggregate(numbers, F.lit(0), lambda t, d: t + F.when(d == "", 1).otherwise(d.cast("int")))
    return F.coalesce(counted, F.lit(0))


def total(terms: list[Column]) -> Column:
    return reduce(Column.__add__, terms)


def moiety_score(a: str, b: str) -> Column:
    """Shared skeleton of two compounds whose atoms stand in columns like `a_C`: overlap, weighed by how much of both it is."""
    n = lambda p, e: F.col(f"{p}_{e}")
    least = lambda e: F.least(n(a, e), n(b, e))
    heavy = [e for e in ELEMENTS if e != "H"]

    def size(p: str) -> Column:
        weighed = total([w * n(p, e) for e, w in SKELETON.items()])
        return F.when(weighed == 0, HEAVY * total([n(p, e) for e in heavy])).otherwise(weighed)

    weighed = total([w * least(e) for e, w in SKELETON.items()])
    overlap = F.when(weighed == 0, HEAVY * total([least(e) for e in heavy])).otherwise(weighed)
    whole = F.greatest(size(a), size(b), F.lit(1e-9))
    return F.when(overlap == 0, 0.0).otherwise(overlap * (0.4 + 0.6 * F.least(overlap / whole, F.lit(1.0))))


def millionths(value: Column) -> Column:
    """A derived double as a whole number of millionths, rounded down."""
    return F.floor(value * 1_000_000).cast("bigint")
