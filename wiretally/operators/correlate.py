"""Per-packet correlation and the per-source threat score.

A raw alert names its rule by `ord`, the position in the rule list. Shuffles and
aggregates carry that number only: the rules a packet fired are bits of BIGINT masks and
the leader the minimum of a number, so a hash aggregate does the regrouping. Names and
severities come from literal arrays at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.operators.slabs import US, at_home, slab_of, with_slabs
from wiretally.rules import RULES, as_rules
from wiretally.schema import ARRIVAL, RANK, literal_array

THREAT_WINDOW_S = 300
SLAB_S = 600
BITS = 62           # rule bits per mask
COUNT_SPACE = 2**44  # a packed leader is place * COUNT_SPACE + count + 1, or + 0 without a count
_PACKET = ["packet_id", "ts_us", "src_ip", "dst_ip", "dst_port", "protocol"]

# Raise the severity of a source that has fired many distinct rules.
_ESCALATED = f"""CASE WHEN threat_score >= 80 AND {RANK} < 3 THEN 'CRITICAL' WHEN threat_score >= 50 AND {RANK} < 2 THEN 'HIGH'
    WHEN threat_score >= 30 AND {RANK} < 1 THEN 'MEDIUM' ELSE severity END"""


def score_sql(active: str = "active") -> str:
    """SQL text of the threat score for a number of active rules."""
    return f"CAST(least(100, {active} * 10) AS INT) AS threat_score"


def escalate(severity: str = "severity", score: str = "threat_score") -> Column:
    """The severity column raised by the threat score column."""
    return F.expr(_ESCALATED.replace("severity", severity).replace("threat_score", score))


def places(rules) -> list[int]:
    """Rule positions, best leader first: highest severity, then first in the list."""
    return sorted(range(len(rules)), key=lambda i: (-rules[i].rank, i))


def _masks(rules) -> range:
    return range((len(rules) + BITS - 1) // BITS)


def _fired(rules) -> list[Column]:
    """Aggregates over the raw alerts of a packet: rule masks and the packed leader."""
    order = places(rules)
    place = literal_array([order.index(i) for i in range(len(rules))], "bigint")
    masks = [F.expr(f"bit_or(CASE WHEN ord div {BITS} = {m} THEN shiftleft(1L, ord % {BITS}) ELSE 0L END) AS m{m}")
             for m in _masks(rules)]
    return [*masks, F.expr(f"min(element_at({place}, ord + 1) * {COUNT_SPACE}L + coalesce(cnt + 1, 0L)) AS packed")]


def lead_of(packets: DataFrame, rules, *keep: str) -> DataFrame:
    """Unpack the leader and the names of the other rules."""
    fired = "+".join(f"bit_count(m{m})" for m in _masks(rules))
    names = literal_array([r.name for r in rules], "string")

    def named(m):
        """Names of the set bits but the leader's, lowest bit first; one step per set bit."""
        rest = f"(m{m} & ~(CASE WHEN leader div {BITS} = {m} THEN shiftleft(1L, leader % {BITS}) ELSE 0L END))"
        lowest = f"CAST(bit_count((a.m & -a.m) - 1L) AS INT) + {m * BITS + 1}"
        return f"""CASE WHEN {rest} = 0L THEN CAST(array() AS array<string>) ELSE aggregate(sequence(1, bit_count({rest})),
            named_struct('m', {rest}, 'names', CAST(array() AS array<string>)),
            (a, i) -> named_struct('m', a.m & (a.m - 1L), 'names', concat(a.names, array(element_at({names}, {lowest})))),
            a -> a.names) END"""

    def of_leader(values):
        return f"element_at({literal_array(values, 'string')}, leader + 1)"

    return (packets.selectExpr(
                "*", f"element_at({literal_array(places(rules), 'int')}, CAST(packed div {COUNT_SPACE}L AS INT) + 1) AS leader",
                f"nullif(packed % {COUNT_SPACE}L, 0L) - 1 AS count", f"{fired} > 1 AS correlated")
            .selectExpr("packet_id", "ts_us", f"{of_leader([r.name for r in rules])} AS rule",
                        f"{of_leader([r.severity for r in rules])} AS severity",
                        "src_ip", "dst_ip", "dst_port", "protocol", "correlated",
                        f"concat({', '.join(named(m) for m in _masks(rules))}) AS also_triggered",
                        "count", f"{of_leader([r.id for r in rules])} AS id", *keep))


def _by_packet(raw: DataFrame, rules) -> DataFrame:
    return raw.groupBy(*_PACKET).agg(*_fired(rules))  # the rest is constant within a packet


def lead(raw: DataFrame, rules=None) -> DataFrame:
    """One row per packet: the leading alert and the names of the others."""
    rules = as_rules(RULES if rules is None else rules)
    return lead_of(_by_packet(raw, rules), rules)


def _scored(raw: DataFrame, rules, window_s: int, slab_s: int) -> DataFrame:
    """One row per packet with its masks and the number of rules its source has active."""
    span, slab_us = window_s * US, slab_s * US
    # One shuffle serves both windows and the regrouping: all cluster by (src_ip, slab).
    rows = with_slabs(raw.select(*_PACKET, "ord", "cnt"), slab_us, span).repartition("src_ip", "slab")
    same_rule = "OVER (PARTITION BY src_ip, slab, ord ORDER BY ts_us, packet_id)"
    # A rule counts from its firing until one microsecond past the window's inclusive bound.
    expiry = f"(ts_us + {span + 1})"
    rows = (rows.selectExpr("*", f"lag(ts_us) {same_rule} AS before", f"lead(ts_us) {same_rule} AS after")
            .selectExpr(*_PACKET, "ord", "cnt", "slab", f"""inline(array(
                named_struct('phase', 1, 'at', ts_us,
                             'delta', CASE WHEN before IS NULL OR ts_us - before > {span} THEN 1L ELSE 0L END),
                CASE WHEN (after IS NULL OR after - ts_us > {span}) AND {slab_of(expiry, slab_us)} = slab
                     THEN named_struct('phase', 0, 'at', {expiry}, 'delta', -1L) END))""")
            .filter("phase IS NOT NULL")
            .selectExpr("*", "sum(delta) OVER (PARTITION BY src_ip, slab ORDER BY at, phase, packet_id, ord "
                             "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS active")
            .filter(f"phase = 1 AND {at_home(slab_us)}"))
    return rows.groupBy("slab", *_PACKET).agg(F.expr("max(active) AS active"), *_fired(rules))


def _scored_ever(raw: DataFrame, rules) -> DataFrame:
    """As `_scored`, but a rule stays active for good once its source has fired it.

    Both sides come from the packets' masks, so detection and its shuffle by packet happen once; the first firings
    are at most one row per source and rule, and a source with very many packets is a skewed join that Spark splits.
    """
    packets = _by_packet(raw, rules)
    bits = ", ".join(f"transform(filter(sequence(0, {BITS - 1}), i -> (shiftright(m{m}, i) & 1L) = 1L), i -> i + {m * BITS})" for m in _masks(rules))
    # packed is read here too, so that both sides aggregate alike and share their exchange
    firsts = (packets.filter("packed >= 0").selectExpr("src_ip", f"{ARRIVAL} AS at", f"explode(concat({bits})) AS ord")
              .groupBy("src_ip", "ord").agg(F.min("at").alias("at"))
              .groupBy("src_ip").agg(F.collect_list("at").alias("firsts")))  # at most one per rule
    return (packets.join(firsts, "src_ip")
            .selectExpr("*", f"CAST(size(filter(firsts, a -> a <= {ARRIVAL})) AS BIGINT) AS active"))


def _score(raw: DataFrame, rules, window_s: int | None, slab_s: int) -> DataFrame:
    return _scored_ever(raw, rules) if window_s is None else _scored(raw, rules, window_s, slab_s)


def threat_score(raw: DataFrame, window_s: int | None = THREAT_WINDOW_S, rules=None, slab_s: int = SLAB_S) -> DataFrame:
    """(packet_id, ts_us, src_ip, threat_score) for every packet that fired a rule."""
    rules = as_rules(RULES if rules is None else rules)
    return _score(raw, rules, window_s, slab_s).selectExpr("packet_id", "ts_us", "src_ip", score_sql())


def correlate(raw: DataFrame, threat_window_s: int | None = THREAT_WINDOW_S, rules=None, slab_s: int = SLAB_S) -> DataFrame:
    """One alert per packet: leader, co-fired rules, threat score and escalated severity.

    `rules` is the list the raw alerts were detected with. `threat_window_s=None` counts
    the rules a source has fired in the whole capture.
    """
    rules = as_rules(RULES if rules is None else rules)
    return (lead_of(_score(raw, rules, threat_window_s, slab_s), rules, score_sql())
            .withColumn("severity", escalate()))
