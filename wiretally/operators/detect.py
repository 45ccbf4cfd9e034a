"""Rule evaluation over packets.

Stateless rules are a filter and a projection. All windowed rules share one shuffle
and one sort: a packet becomes one row per condition set it satisfies (few, since
sets that exclude each other share a column), rules with the same conditions share
the row, and their counts are running sums within (source, slab, condition set).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.functions.families import matched
from wiretally.functions.net import protocol_name
from wiretally.functions.predicates import matches_any
from wiretally.operators.slabs import US, at_home, floor_div, slab_of, with_slabs
from wiretally.rules import RULES, Rule, as_rules
from wiretally.schema import ARRIVAL, literal_array

SLAB_S = 300
PAYLOAD = ["packet_id", "ts_us", "src_ip", "dst_ip", "dst_port", "protocol"]


def _key(conditions: dict) -> tuple:
    return tuple(sorted((k, repr(v)) for k, v in conditions.items()))


def _lookup(values: list, type_: str, index: str) -> str:
    """SQL text of values[index] from a literal array."""
    return f"element_at({literal_array(values, type_)}, {index} + 1)"


def _matches(packets: DataFrame, sets: list[dict], columns: list) -> DataFrame:
    """One row per (packet, satisfied set); `set` is the index into `sets`."""
    return (packets.filter(matches_any(sets)).select(*columns, F.explode(matched(sets)).alias("set"))
            .filter("set IS NOT NULL"))


def hits(packets: DataFrame, rules=None, slab_s: int = SLAB_S) -> DataFrame:
    """(packet payload, ord, cnt): one row per packet and fired rule; cnt is null for stateless rules."""
    rules = as_rules(RULES if rules is None else rules)
    stateless = [(i, r) for i, r in enumerate(rules) if r.type == "pattern"]
    windowed = [(i, r) for i, r in enumerate(rules) if r.type != "pattern"]
    parts = []
    if stateless:
        parts.append(_matches(packets, [r.conditions for _, r in stateless], PAYLOAD).selectExpr(
            *PAYLOAD, _lookup([i for i, _ in stateless], "int", "set") + " AS ord", "CAST(NULL AS BIGINT) AS cnt"))
    if windowed:
        parts.append(_windowed(packets, windowed, slab_s * US))
    return reduce(DataFrame.unionByName, parts)


def condition_sets(rules: list[tuple[int, Rule]]) -> tuple[list[dict], list[list[tuple[int, Rule]]]]:
    """What rows are counted by, and the (ord, rule) decided on the rows of each: rate rules with
    equal conditions share a set, a distinct rule has its own."""
    sets, by_set, slot = [], [], {}
    for i, r in rules:
        key = (_key(r.conditions), r.track, None if r.type == "rate" else r.window_s)
        if key not in slot:
            slot[key] = len(sets)
            sets.append(r.conditions)
            by_set.append([])
        by_set[slot[key]].append((i, r))
    return sets, by_set


def _windowed(packets: DataFrame, rules: list[tuple[int, Rule]], slab_us: int) -> DataFrame:
    sets, by_set = condition_sets(rules)
    is_rate = [rs[0][1].type == "rate" for rs in by_set]
    distinct = [(s, rs[0][1]) for s, rs in enumerate(by_set) if not is_rate[s]]

    rows = _matches(packets, sets, PAYLOAD)
    for track in sorted({r.track for _, r in distinct}):
        tracking = ", ".join(str(k) for k, r in distinct if r.track == track)
        rows = rows.filter(f"NOT (set IN ({tracking}) AND {track} IS NULL)")
    # An event reaches ahead as long as the longest rate window of its set.
    reach = [max(r.window_us for _, r in rs) - 1 if rate else 0 for rs, rate in zip(by_set, is_rate)]
    rows = (with_slabs(rows, slab_us, _lookup(reach, "bigint", "set"))
            .selectExpr(*PAYLOAD, "set", "slab", "1 AS phase", "true AS event",
                        _lookup([int(rate) for rate in is_rate], "bigint", "set") + " AS delta"))
    if distinct:
        rows = rows.unionByName(_distinct_deltas(packets, distinct, slab_us), allowMissingColumns=True)

    part = "PARTITION BY src_ip, slab, set"
    rows = rows.selectExpr("*", f"sum(delta) OVER ({part} ORDER BY ts_us, phase, packet_id, event "
                                "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level")
    # Second, so that it reuses the first window's sort, of which its order is a prefix.
    spans = sorted({r.window_s for rs, rate in zip(by_set, is_rate) if rate for _, r in rs})
    rows = rows.selectExpr("*", *[
        f"coalesce(sum(delta) OVER ({part} ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND {w * US}L PRECEDING), 0L)"
        f" AS gone{w}" for w in spans])
    rows = rows.filter(f"event AND {at_home(slab_us)}")

    # The j-th rule of each set, decided from literal lookup tables.
    outcomes = []
    for j in range(max(len(rs) for rs in by_set)):
        nth = [rs[j] if j < len(rs) else (None, None) for rs in by_set]
        back = [spans.index(r.window_s) + 1 if r and r.type == "rate" else 0 for _, r in nth]
        outcomes.append(
            f"named_struct('ord', element_at({literal_array([i for i, _ in nth], 'int')}, set + 1),"
            f" 'least', element_at({literal_array([r and r.threshold for _, r in nth], 'bigint')}, set + 1),"
            f" 'cnt', level - element_at(array(0L{''.join(f', gone{w}' for w in spans)}), element_at({literal_array(back, 'int')}, set + 1) + 1))")
    return (rows.select(*PAYLOAD, F.expr(f"inline(array({', '.join(outcomes)}))"))
            .filter("cnt >= least").select(*PAYLOAD, "ord", "cnt"))


def _distinct_deltas(packets: DataFrame, rules: list[tuple[int, Rule]], slab_us: int) -> DataFrame:
    """+1/-1 rows whose running sum is the number of distinct tracked values in the window.

    A value is active from an occurrence until w after its last one. Occurrences of one
    value within one w-long bucket are never w apart, so (first, last) per bucket is
    enough: the aggregate combines on the map side and is what gets shuffled.
    """
    tracked = [f"CASE WHEN set IN ({', '.join(str(n) for n, (_, r) in enumerate(rules) if r.track == t)}) "
               f"THEN CAST({t} AS STRING) END" for t in sorted({r.track for _, r in rules})]
    runs = (_matches(packets, [r.conditions for _, r in rules], ["src_ip", "dst_ip", "dst_port", "ts_us", "packet_id"])
            .selectExpr("src_ip", "ts_us", "packet_id", _lookup([k for k, _ in rules], "int", "set") + " AS set",
                        f"coalesce({', '.join(tracked)}) AS value",
                        _lookup([r.window_us for _, r in rules], "bigint", "set") + " AS w")
            .filter("value IS NOT NULL")
            .groupBy("src_ip", "set", "value", "w", F.expr(floor_div("ts_us", "w")).alias("bucket"))
            .agg(F.expr("min(ts_us) AS first"), F.expr("max(ts_us) AS last"),
                 F.expr(f"min({ARRIVAL}) AS opener"))
            .withColumn("first_id", F.expr(f"CAST(opener - {ARRIVAL.replace('ts_us', 'first').replace('packet_id', '0')} AS BIGINT)")))

    run = "OVER (PARTITION BY src_ip, set, value ORDER BY bucket)"
    end_slab = (f"CASE WHEN lasts THEN {slab_of('next', slab_us)} ELSE {slab_of('(last + w - 1)', slab_us)} END")
    return (runs.selectExpr("src_ip", "set", "w", "first", "last", "first_id", f"lead(first) {run} AS next",
                            f"coalesce(first - lag(last) {run} < w, false) AS goes_on",
                            f"coalesce(lead(first) {run} - last < w, false) AS lasts")
            .selectExpr("*", f"{slab_of('first', slab_us)} AS home", f"{end_slab} AS end_slab")
            .selectExpr("src_ip", "set", f"""inline(concat(
                array(CASE WHEN NOT goes_on THEN
                        named_struct('slab', home, 'ts_us', first, 'phase', 1, 'packet_id', first_id, 'delta', 1L) END,
                      CASE WHEN NOT lasts THEN
                        named_struct('slab', end_slab, 'ts_us', last + w, 'phase', 0, 'packet_id', -1L, 'delta', -1L) END),
                transform(CASE WHEN end_slab > home THEN sequence(home + 1, end_slab) ELSE CAST(array() AS array<bigint>) END,
                          s -> named_struct('slab', s, 'ts_us', s * {slab_us}L, 'phase', -1, 'packet_id', -1L, 'delta', 1L))))""")
            .filter("slab IS NOT NULL").selectExpr("*", "false AS event"))


def detect(packets: DataFrame, rules=None, slab_s: int = SLAB_S) -> DataFrame:
    """Raw alerts: one row per (packet, fired rule)."""
    rules = as_rules(RULES if rules is None else rules)
    return hits(packets, rules, slab_s).select(
        "packet_id", "ts_us", "ord",
        F.expr(_lookup([r.name for r in rules], "string", "ord")).alias("rule"),
        F.expr(_lookup([r.id for r in rules], "string", "ord")).alias("id"),
        F.expr(_lookup([r.severity for r in rules], "string", "ord")).alias("severity"),
        "src_ip", "dst_ip", "dst_port", protocol_name(F.col("protocol")).alias("protocol"), "cnt")


def _only(rules, kind: str) -> list[Rule]:
    picked = [r for r in as_rules(RULES if rules is None else rules) if r.type == kind]
    if not picked:
        raise ValueError(f"the rule list has no {kind} rule")
    return picked


def detect_pattern(packets: DataFrame, rules=None) -> DataFrame:
    """Stateless rules only: a filter and a projection, no shuffle."""
    return detect(packets, _only(rules, "pattern"))


def detect_rate(packets: DataFrame, rules=None, slab_s: int = SLAB_S) -> DataFrame:
    """Trailing packet counts per source: alert on every packet at or above the threshold."""
    return detect(packets, _only(rules, "rate"), slab_s)


def detect_distinct(packets: DataFrame, rules=None, slab_s: int = SLAB_S) -> DataFrame:
    """Trailing distinct destination ports or addresses per source."""
    return detect(packets, _only(rules, "multi_destination"), slab_s)
