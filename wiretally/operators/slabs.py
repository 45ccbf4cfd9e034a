"""Cutting per-key time lines into slabs so that no key has to fit one task.

A trailing window of length w only looks back w. Partitioning by (key, slab) with a
slab of fixed length, and copying each row into the following slabs its effect
reaches, gives the same windows as partitioning by key alone, while a source that
sends a third of all traffic is spread over as many tasks as there are slabs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

US = 1_000_000


def floor_div(a: str, b: str | int) -> str:
    """SQL text of integer floor division, exact for negative numbers too."""
    return f"((({a}) - pmod({a}, {b})) div {b})"


def slab_of(ts_us: str, slab_us: int) -> str:
    return floor_div(ts_us, f"{slab_us}L")


def with_slabs(df: DataFrame, slab_us: int, reach_us: str | int) -> DataFrame:
    """Add `slab`, one copy of the row per slab that [ts_us, ts_us + reach_us] touches."""
    last = slab_of(f"(ts_us + {reach_us})", slab_us)
    return df.withColumn("slab", F.expr(f"explode(sequence({slab_of('ts_us', slab_us)}, {last}))"))


def at_home(slab_us: int) -> str:
    """Predicate that is true for the original of a row, false for its copies in later slabs."""
    return f"slab = {slab_of('ts_us', slab_us)}"
