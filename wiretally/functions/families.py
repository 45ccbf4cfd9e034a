"""Grouping condition sets that exclude each other, so one column can name the match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiretally.functions.predicates import conditions_sql, values_of


def exclusive(a: dict, b: dict) -> bool:
    """True when some field admits disjoint values, so no packet satisfies both."""
    for name in a.keys() & b.keys():
        x, y = values_of(a[name]), values_of(b[name])
        if x is not None and y is not None and not x & y:
            return True
    return False


def families(condition_sets: list[dict]) -> list[list[int]]:
    """Greedy partition of the sets into groups whose members exclude each other."""
    out: list[list[int]] = []
    for i, c in enumerate(condition_sets):
        for group in out:
            if all(exclusive(c, condition_sets[j]) for j in group):
                group.append(i)
                break
        else:
            out.append([i])
    return out


def matched(condition_sets: list[dict]) -> Column:
    """Array with, per family, the index of the set the packet satisfies, else null."""
    cases = ["CASE " + " ".join(f"WHEN {conditions_sql(condition_sets[i])} THEN {i}" for i in group) + " END"
             for group in families(condition_sets)]
    return F.expr(f"array({', '.join(cases)})")
