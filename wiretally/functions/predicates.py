"""Rule conditions compiled to Catalyst predicates that never evaluate to NULL.

Predicates are built as SQL text and parsed in one call: a catalogue has hundreds of
comparisons, and creating each one as a Column object costs a round trip to the JVM.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from wiretally.schema import sql_literal

TEXT = {"src_ip", "dst_ip", "flags"}
NUMBER = {"protocol", "length", "ttl", "src_port", "dst_port", "flags_int", "icmp_type"}
MOST_TERMS = 16          # boxes of a scan filter
MOST_SPANS = 12          # spans of a column in a box


def _actual(name: str) -> str:
    if name in TEXT | NUMBER:
        return name
    if name == "timestamp":
        return "(ts_us / 1e6D)"
    return "CAST(NULL AS STRING)"  # a field packets do not have is always missing


def _literal(name: str, v) -> str:
    text = isinstance(v, str)
    if v is not None and ((name in TEXT and not text) or (name in NUMBER | {"timestamp"} and text)):
        raise ValueError(f"condition on {name}: literal {v!r} has the wrong type")
    return sql_literal(v)


def _member(name: str, values) -> str:
    a = _actual(name)
    concrete = ", ".join(_literal(name, v) for v in values if v is not None)
    c = f"coalesce({a} IN ({concrete}), false)" if concrete else "false"
    return f"({c} OR {a} IS NULL)" if None in values else c


def _known(form: str):
    return lambda name, v: "coalesce(" + form.format(a=_actual(name), v=_literal(name, v)) + ", false)"


_COMPARE = {
    ">": _known("{a} > {v}"),
    ">=": _known("{a} >= {v}"),
    "<": _known("{a} < {v}"),
    "<=": _known("{a} <= {v}"),
    "!=": lambda name, v: f"NOT ({_actual(name)} <=> {_literal(name, v)})",
    "not_in": lambda name, v: f"NOT {_member(name, v)}",
    "mask": _known("({a} & {v}) = {v}"),
}
_ALIAS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "not": "!="}


def conditions_sql(conditions: dict) -> str:
    """AND of all conditions. Forms: scalar (equal), list (member), {op: value}."""
    parts = []
    for name, want in conditions.items():
        if isinstance(want, dict):
            for op, v in want.items():
                op = _ALIAS.get(op, op)
                if op not in _COMPARE:
                    raise ValueError(f"condition on {name}: unknown operator {op!r}")
                parts.append(_COMPARE[op](name, v))
        elif isinstance(want, (list, tuple)):
            parts.append(_member(name, want))
        else:
            parts.append(f"({_actual(name)} <=> {_literal(name, want)})")
    return " AND ".join(parts) or "true"


def compile_conditions(conditions: dict) -> Column:
    return F.expr(conditions_sql(conditions))


def values_of(want) -> set | None:
    """The finite set of values a condition admits, or None when it is open-ended."""
    if isinstance(want, dict):
        return None
    return set(want) if isinstance(want, (list, tuple)) else {want}


INF = 2**63
_CUT = {">": lambda v: (v + 1, INF), ">=": lambda v: (v, INF), "<": lambda v: (-INF, v - 1), "<=": lambda v: (-INF, v)}


def _union(spans: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Disjoint ascending spans that cover the given ones; the narrowest gaps are closed until `most` are left."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    while len(out) > most:
        i = min(range(len(out) - 1), key=lambda i: out[i + 1][0] - out[i][1])
        out[i:i + 2] = [(out[i][0], out[i + 1][1])]
    return out


def _box(conditions: dict) -> dict[str, object] | None:
    """What each column must be for the conditions to hold: a set of texts, or spans of numbers. Columns that may be
    missing, and operators that say nothing about the order, are left out. None: the conditions never hold."""
    box: dict[str, object] = {}
    for name, want in conditions.items():
        finite = values_of(want)
        if name in TEXT:
            if finite is not None and None not in finite:
                box[name] = frozenset(finite)
        elif name in NUMBER:
            if finite is not None:
                spans = None if None in finite else [(v, v) for v in finite]
            else:
                cuts = [_CUT[op](v) for op, v in ((_ALIAS.get(o, o), v) for o, v in want.items()) if op in _CUT and isinstance(v, int)]
                spans = [(max(lo for lo, _ in cuts), min(hi for _, hi in cuts))] if cuts else None
            if spans is not None:
                spans = [x for x in spans if x[0] <= x[1]]
                if not spans:
                    return None
                box[name] = _union(spans, MOST_SPANS)
    return box


def _joined(a: dict, b: dict) -> dict:
    """A box that covers two."""
    return {c: a[c] | b[c] if c in TEXT else _union(a[c] + b[c], MOST_SPANS) for c in a.keys() & b.keys()}


def _share(c: str, want) -> float:
    """Part of the packets that a column is taken to let through: most are TCP or UDP, other values are spread evenly."""
    if c in TEXT:
        return len(want) / 64
    inside = lambda v: any(lo <= v <= hi for lo, hi in want)
    if c == "protocol":
        return 0.55 * inside(6) + 0.4 * inside(17) + 0.05 * any((lo, hi) not in ((6, 6), (17, 17)) for lo, hi in want)
    return min(1.0, sum(min(hi, 65535) - max(lo, 0) + 1 for lo, hi in want) / (65536 if c.endswith("port") else 2048))


def _width(box: dict) -> float:
    return math.prod(_share(c, want) for c, want in box.items())


def cover(condition_sets: list[dict]) -> list[dict]:
    """At most MOST_TERMS boxes that together hold every packet satisfying some set: boxes that lose least by it are
    joined until so few are left."""
    boxes = [b for b in map(_box, condition_sets) if b is not None]
    out: list[dict] = []
    for b in sorted(boxes, key=len):        # a box inside another one adds nothing
        if not any(_joined(b, o) == o for o in out):
            out.append(b)
    while len(out) > MOST_TERMS:
        def loss(pair):
            a, b = out[pair[0]], out[pair[1]]
            return _width(_joined(a, b)) - _width(a) - _width(b)
        i, j = min(itertools.combinations(range(len(out)), 2), key=loss)
        joined = _joined(out[i], out[j])
        out = [x for k, x in enumerate(out) if k not in (i, j) and _joined(x, joined) != joined] + [joined]
    return out


def _span_sql(c: str, lo: int, hi: int) -> str:
    if lo == hi:
        return f"{c} = {lo}"
    return " AND ".join(p for p in (f"{c} >= {lo}" * (lo > -INF), f"{c} <= {hi}" * (hi < INF)) if p)


def _box_sql(box: dict) -> str:
    """Plain comparisons: unknown counts as false in a filter, and scans accept them."""
    parts = []
    for c, want in sorted(box.items()):
        if c in TEXT:
            parts.append(f"{c} IN ({', '.join(map(sql_literal, sorted(want)))})")
        else:
            points = [lo for lo, hi in want if lo == hi]
            spans = [f"({_span_sql(c, lo, hi)})" for lo, hi in want if lo != hi]
            parts.append("(" + " OR ".join([f"{c} IN ({', '.join(map(str, points))})"] * bool(points) + spans) + ")")
    return "(" + (" AND ".join(parts) or "true") + ")"


def matches_any(condition_sets: list[dict]) -> Column:
    """Filter keeping (at least) the rows that satisfy some condition set, of a bounded size whatever the number of
    sets, so that scans can use it."""
    boxes = cover(condition_sets)
    if not boxes:
        return F.lit(False)
    return F.expr(" OR ".join(map(_box_sql, boxes)))
