import random
import re
from functools import reduce

import pytest
from pyspark.sql import functions as F
from model import FIELDS, US, correlate as model_correlate, detect as model_detect, packet, scaled, traffic

from queries import CUSTOM_RULES
from wiretally.functions.families import exclusive, families
from wiretally.functions.predicates import MOST_TERMS, compile_conditions, cover, matches_any
from wiretally.operators.correlate import correlate, lead, threat_score
from wiretally.operators.detect import detect, detect_distinct, detect_pattern, detect_rate
from wiretally.rules import RULES, as_rules
from wiretally.schema import PACKETS
from wiretally.session import shared_dir


def frame(spark, packets):
    return spark.createDataFrame([tuple(p[f] for f in FIELDS) for p in packets], PACKETS)


def found(df):
    return {(r.packet_id, r.ord): r.cnt for r in df.collect()}


@pytest.mark.parametrize("seed,slab_s", [(1, 300), (2, 7)])
def test_catalogue_equals_model(spark, seed, slab_s):
    rules, packets = scaled(RULES), traffic(1500, seed)
    got = found(detect(frame(spark, packets), rules, slab_s=slab_s))
    assert got == model_detect(packets, rules)
    assert len({o for _, o in got}) > 40


def test_custom_rules_and_odd_slabs(spark):
    rules, packets = scaled(as_rules(CUSTOM_RULES), 4), traffic(900, 3, sources=1, step_us=90_000)
    assert found(detect(frame(spark, packets), rules, slab_s=1)) == model_detect(packets, rules)


def _satisfying(rule, i):
    """A packet that meets the rule's conditions; tracked values differ by i."""
    p = packet(0, 0, protocol=6, dst_port=81, flags="PA", flags_int=24)
    for name, want in rule.conditions.items():
        if isinstance(want, dict):
            p[name] = {">": lambda v: v + 1, "<=": lambda v: v, "mask": lambda v: v}[next(iter(want))](next(iter(want.values())))
        else:
            p[name] = want[0] if isinstance(want, list) else want
    if "flags" in rule.conditions:
        p["flags_int"] = 1000  # no flag-bit rule looks at these packets
    if rule.track == "dst_ip":
        p["dst_ip"] = f"2.2.2.{i}"
    elif rule.track:
        p["dst_port"] = 60001 + i
    return p


def test_every_rule_fires_at_its_threshold_and_not_before(spark):
    packets, expect = [], {}
    for o, rule in enumerate(RULES):
        for short in (0, 1):
            n = (rule.threshold or 1) - short
            for i in range(n):
                packets.append({**_satisfying(rule, i), "src_ip": f"9.{short}.0.{o}", "packet_id": len(packets), "ts_us": i})
            expect[f"9.{short}.0.{o}", o] = 1 - short
    by_source = {}
    for r in detect(frame(spark, packets)).collect():
        by_source[r.src_ip, r.ord] = by_source.get((r.src_ip, r.ord), 0) + 1
    for key, n in expect.items():
        assert by_source.get(key, 0) == n, (RULES[key[1]].name, key)


def test_window_bounds_and_ties(spark):
    redis = dict(dst_port=6379, flags="S", flags_int=2)
    packets = [packet(1, 0, **redis), packet(2, 60 * US - 1, **redis), packet(3, 60 * US - 1, **redis), packet(4, 60 * US, **redis)]
    rule = [r for r in RULES if r.id == "R048"]
    assert found(detect_rate(frame(spark, packets), rule)) == {(3, 0): 3, (4, 0): 3}
    assert found(detect_rate(frame(spark, packets[1:]), rule)) == {(4, 0): 3}


def test_distinct_ignores_missing_values_and_repeats(spark):
    rule = [r for r in RULES if r.id == "R002"]
    same = [packet(i, i, dst_port=80, flags="S") for i in range(100)]
    none = [packet(200 + i, i, dst_port=None, flags="S") for i in range(100)]
    assert found(detect_distinct(frame(spark, same + none), rule)) == {}


def test_stateless_rules_do_not_shuffle(spark):
    plan = detect_pattern(frame(spark, [packet(1, 0)]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_windowed_rules_share_one_sort(spark):
    df = detect_rate(frame(spark, [packet(1, 0)]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_condition_null_semantics(spark):
    df = frame(spark, [packet(1, 0, protocol=1, dst_port=None, src_port=None, flags=None, flags_int=0, icmp_type=8)])
    cases = [({"dst_port": {"!=": 80}}, True), ({"dst_port": {"not_in": [80]}}, True), ({"dst_port": {">": 0}}, False),
             ({"dst_port": {"<=": 9}}, False), ({"dst_port": 80}, False), ({"dst_port": None}, True), ({"dst_port": [80]}, False),
             ({"dst_port": [80, None]}, True), ({"dst_port": {"not_in": [None]}}, False), ({"dst_port": {"mask": 0}}, False),
             ({"flags_int": {"mask": 0}}, True), ({}, True), ({"nonsense": None}, True), ({"nonsense": "x"}, False),
             ({"icmp_type": {">": 7, "<": 9}}, True), ({"timestamp": {"<": 1}}, True)]
    got = df.select(*[compile_conditions(c).alias(str(i)) for i, (c, _) in enumerate(cases)]).first()
    assert list(got) == [want for _, want in cases]


def test_bad_rules_are_rejected():
    with pytest.raises(ValueError):
        compile_conditions({"dst_port": {"~": 1}})
    with pytest.raises(ValueError):
        compile_conditions({"flags": 2})
    base = {"name": "x", "type": "rate", "severity": "LOW", "conditions": {}}
    for bad in ([base], [{**base, "type": "other"}], [{**base, "severity": "BAD"}],
                [{**base, "type": "multi_destination", "threshold": 1, "window_seconds": 1, "track": "ttl"}],
                [{**base, "type": "pattern"}] * 2):
        with pytest.raises(ValueError):
            as_rules(bad)


def test_families_are_exclusive():
    sets = [r.conditions for r in RULES]
    groups = families(sets)
    assert sorted(i for g in groups for i in g) == list(range(len(sets)))
    assert all(exclusive(sets[a], sets[b]) for g in groups for a in g for b in g if a != b)


def test_scan_filter_holds_every_match_and_is_bounded(spark):
    rnd = random.Random(1)
    own = [{"dst_port": rnd.choice([rnd.randrange(65536), [1, rnd.randrange(9999), None], {">": rnd.randrange(60000)}, {"<": 30, ">=": 5}, {"!=": 80}]),
            "protocol": rnd.choice([6, 17, [1, 6], {"not_in": [1]}]), **({"flags": rnd.choice(["S", ["A", "PA"], None])} if rnd.random() < .5 else {})} for _ in range(200)]
    p = frame(spark, traffic(1500, 3)).persist()
    for sets in ([r.conditions for r in RULES], own, own[:3], [{"length": {">": 10, "<": 5}}], [{}], [{"ttl": {"mask": 3}}]):
        assert len(cover(sets)) <= MOST_TERMS
        exact = reduce(lambda a, b: a | b, [compile_conditions(c) for c in sets])
        assert p.filter(exact & ~F.coalesce(matches_any(sets), F.lit(False))).isEmpty()


@pytest.mark.parametrize("rules", [[r for r in RULES if r.type == "pattern"],
                                   as_rules([{"name": f"r{i}", "type": "pattern", "severity": "LOW", "conditions": {"dst_port": 300 * i, "protocol": 6 + 11 * (i % 2)}} for i in range(200)])])
def test_scan_filter_reaches_the_files(spark, rules):
    path = shared_dir(spark, "packets")
    frame(spark, traffic(50, 3)).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "20000")
    try:
        plan = detect_pattern(spark.read.parquet(path), rules)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan, re.S)[1]
    assert "protocol" in pushed and "dst_port" in pushed


def test_capture_score_detects_once(spark):
    path = shared_dir(spark, "packets")
    frame(spark, traffic(50, 3)).write.parquet(path)
    plan = threat_score(detect(spark.read.parquet(path), RULES), None)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert text.count("ReusedExchange") >= 1


@pytest.mark.parametrize("window_s,slab_s", [(300, 600), (20, 10), (None, 600)])
def test_correlation_equals_model(spark, window_s, slab_s):
    rules, packets = scaled(RULES), traffic(900, 5)
    raw = model_detect(packets, rules)
    got = {r.packet_id: (r.rule, r.severity, r.also_triggered, r.threat_score, r["count"])
           for r in correlate(detect(frame(spark, packets), rules), window_s, rules, slab_s).collect()}
    assert got == model_correlate(packets, raw, rules, window_s)


RAW = ("packet_id bigint, ts_us bigint, ord int, rule string, id string, severity string, src_ip string, dst_ip string, "
       "dst_port int, protocol string, cnt bigint")


def raw_rows(spark, firings):
    """firings: (packet_id, ts_us, rule id)"""
    index = {r.id: i for i, r in enumerate(RULES)}
    return spark.createDataFrame([(p, t, index[i], RULES[index[i]].name, i, RULES[index[i]].severity, "s", "d", 1, "TCP", None)
                                  for p, t, i in firings], RAW)


def test_first_rule_leads_among_equals(spark):
    row = lead(raw_rows(spark, [(1, 0, "R004"), (1, 0, "R003")])).first()
    assert (row.rule, row.also_triggered, row.correlated) == ("Host Discovery Sweep (Distinct IPs)", ["Null Scan"], True)


def test_threat_window_bound_and_escalation(spark):
    low = ["R014", "R037", "R060", "R072", "R073"]
    medium = ["R006", "R011", "R012"]
    firings = [(i, i, r) for i, r in enumerate(low + medium)]
    scores = [(r.threat_score, r.severity) for r in correlate(raw_rows(spark, firings)).orderBy("packet_id").collect()]
    assert scores == [(10, "LOW"), (20, "LOW"), (30, "MEDIUM"), (40, "MEDIUM"), (50, "HIGH"), (60, "HIGH"), (70, "HIGH"), (80, "CRITICAL")]
    at = 300 * US
    rows = raw_rows(spark, [(1, 0, "R014"), (2, at, "R037"), (3, at + 1, "R060")])
    assert [r.threat_score for r in correlate(rows).orderBy("packet_id").collect()] == [10, 20, 20]
