import random

import pytest
from model import US, greedy

from wiretally.operators.alerts import batch, cooldown, digest, digest_lines, notify_filter, pending, suppressed, suppressed_total
from wiretally.operators.greedy import openers

ALERTS = ("packet_id bigint, ts_us bigint, rule string, severity string, src_ip string, dst_ip string, dst_port int, "
          "protocol string, correlated boolean, also_triggered array<string>, count bigint, threat_score int")


def alerts(spark, rows):
    """rows: (packet_id, seconds, rule, severity, ...)"""
    full = []
    for pid, s, rule, sev, *rest in rows:
        port, also, count, score = (rest + [None, [], None, 0][len(rest):])[:4]
        full.append((pid, int(s * US), rule, sev, "1.1.1.1", "2.2.2.2", port, "TCP", bool(also), also, count, score))
    return spark.createDataFrame(full, ALERTS)


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_openers_equal_a_linear_scan(spark, levels):
    rnd, events = random.Random(levels), []
    for key in ("dense", "quiet", "exact", "mixed"):
        t = rnd.randrange(10**9) - 5 * 10**8
        for _ in range(900):
            t += {"dense": rnd.randrange(2 * US), "quiet": rnd.choice([1, 40 * US]), "exact": rnd.choice([0, 10 * US]),
                  "mixed": rnd.choice([0, 1, rnd.randrange(30 * US), rnd.randrange(70 * US) if rnd.random() < .05 else 5])}[key]
            events.append((key, t, len(events) * 7919 % 100003))
    df = spark.createDataFrame(events, "rule string, ts_us bigint, packet_id bigint")
    got = {r.packet_id for r in openers(df, ["rule"], 30 * US, levels=levels).collect()}
    assert got == greedy(events, 30 * US)[1]


def test_cooldown_bounds(spark):
    df = cooldown(alerts(spark, [(i, s, "r", "LOW") for i, s in enumerate((0, 20, 30, 50, 60))])).persist()
    assert [r.passed for r in df.orderBy("packet_id").collect()] == [True, False, True, False, True]
    assert suppressed(df).first()[2:] == (3, 2) and tuple(suppressed_total(df).first()) == (5, 3, 2)


def test_batch_bounds_and_filter(spark):
    rows = [(i, s, "r", "HIGH") for i, s in enumerate((0, 2, 2.9, 3.0, 5))] + [(9, 1, "r", "MEDIUM")]
    got = {r.packet_id: r.batch_id for r in batch(notify_filter(alerts(spark, rows))).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3 * US, 4: 3 * US}


def test_batches_without_key_equal_a_linear_scan(spark):
    rnd = random.Random(4)
    rows, t = [], 0.0
    for i in range(600):
        t += rnd.choice([0, 0.5, 1, 3, 0.000001, 20 if i % 90 == 0 else 0])
        rows.append((i, t, "r", "HIGH"))
    want, _ = greedy([("", int(s * US), i) for i, s, *_ in rows], 3 * US)
    assert {r.packet_id: r.batch_id for r in batch(alerts(spark, rows)).collect()} == want


def test_digest_text(spark):
    rows = [(1, 0, "Port Scan (SYN)", "HIGH", 22, ["Null Scan", "FIN Scan"], 120, 30), (2, 1, "Null Scan", "CRITICAL"),
            (3, 1, "Other", "CRITICAL"), (4, 60, "Null Scan", "HIGH")]
    got = digest(batch(alerts(spark, rows))).orderBy("batch_id").collect()
    assert [r.subject for r in got] == ["3 alerts — highest: CRITICAL Null Scan", "HIGH — Null Scan"]
    assert [r.icon for r in got] == [":rotating_light:", ":warning:"]
    body = {r.packet_id: r.line for r in digest_lines(batch(alerts(spark, rows))).collect()}
    assert body[1] == (
        "Severity  : HIGH\n  Rule      : Port Scan (SYN)\n  Source IP : 1.1.1.1\n  Dest IP   : 2.2.2.2\n"
        "  Dest Port : 22\n  Count     : 120 packets in window\n  Threat    : 30/100\n  Also fired: Null Scan, FIN Scan")
    assert body[4] == "Severity  : HIGH\n  Rule      : Null Scan\n  Source IP : 1.1.1.1\n  Dest IP   : 2.2.2.2"


def test_digest_covers_the_whole_batch(spark):
    rows = [(0, 0, "Null Scan", "CRITICAL")] + [(i, i / 1000, "r", "HIGH") for i in range(1, 300)]
    got = digest(batch(alerts(spark, rows))).collect()
    assert [(r.n_alerts, r.subject, r.icon) for r in got] == [(300, "300 alerts — highest: CRITICAL Null Scan", ":rotating_light:")]


def test_pending_keeps_the_newest(spark):
    kept = pending(batch(alerts(spark, [(i, i / 1000, "r", "HIGH") for i in range(130)])), 100)
    assert sorted(r.packet_id for r in kept.collect()) == list(range(30, 130))
