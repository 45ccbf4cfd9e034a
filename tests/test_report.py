import pytest
from test_alerts import alerts
from test_sources import column

from pyspark.sql import functions as F

from wiretally.operators import report as R
from wiretally.operators.alerts import cooldown
from wiretally.rules import RULES, rules_df


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, 10, "Null Scan", "HIGH", 80, ["FIN Scan"], None, 20), (2, 20, "FIN Scan", "MEDIUM", 80, [], None, 40),
            (3, 70, "Null Scan", "CRITICAL", 81, [], None, 90), (4, 70, "strange", "LOW"), (5, 90, "SSH Brute Force", "CRITICAL", 22, [], 11, 10)]
    a = alerts(spark, rows)
    return a.withColumn("src_ip", F.when(F.col("packet_id") == 5, "2.2.2.2").when(F.col("packet_id") == 4, "").otherwise("1.1.1.1")).persist()


def values(df):
    return [tuple(r) for r in df.collect()]


def test_rankings_break_ties_by_first_seen(spark, table):
    assert values(R.top_sources(table)) == [("1.1.1.1", 3), ("2.2.2.2", 1)]
    assert values(R.top_rules(table))[0] == ("Null Scan", 2)
    assert [r for r, _ in values(R.top_rules(table))[1:]] == ["SSH Brute Force", "strange", "FIN Scan"]
    assert values(R.top_rules_first_severity(table)) == [
        ("Null Scan", 2, "HIGH", "Reconnaissance"), ("FIN Scan", 1, "MEDIUM", "Reconnaissance"), ("strange", 1, "LOW", "Other"),
        ("SSH Brute Force", 1, "CRITICAL", "Brute Force")]
    assert values(R.top_attackers(table, 2)) == [
        ("1.1.1.1", 3, "CRITICAL", 90, ["Reconnaissance"], ["FIN Scan", "Null Scan"]),
        ("2.2.2.2", 1, "CRITICAL", 10, ["Brute Force"], ["SSH Brute Force"])]


def test_recent(spark, table):
    assert [r.packet_id for r in R.recent(table, 2).collect()] == [5, 4]
    assert [r.packet_id for r in R.recent(table, severity="CRITICAL", ip="1.1", rule="null").collect()] == [3]
    assert [r.packet_id for r in R.recent(table, since="1970-01-01T00:01:10+00:00").collect()] == [5]


def test_totals_and_breakdowns(spark, table):
    assert values(R.severity_totals(table, "1970-01-01")) == [(5, 5, 2, 1, 1, 1)]
    assert values(R.by_severity(table.filter("severity = 'HIGH'"))) == [("CRITICAL", 0), ("HIGH", 1), ("MEDIUM", 0), ("LOW", 0)]
    assert values(R.breakdown_pct(table))[0] == ("CRITICAL", 2, 40.0, 1.0)
    assert values(R.breakdown_pct(table.limit(0)))[0] == ("CRITICAL", 0, 0.0, 0.0)
    assert values(R.minute_timeline(table)) == [("1970-01-01T00:00", 0, 1, 1, 0), ("1970-01-01T00:01", 2, 0, 0, 1)]
    assert values(R.alert_meta(table)) == [(5, "1970-01-01 00:00:10", "1970-01-01 00:01:30")]
    assert values(R.alert_meta(table.limit(0))) == [(0, "—", "—")]


def test_investigation(spark, table):
    row = R.investigate(table, "1.1.1.1").first()
    assert (row.total, row.risk_score, row.risk_label, row.first_seen) == (3, 34, "ELEVATED", "1970-01-01T00:00:10+00:00")
    assert [(r.rule, r["count"]) for r in row.top_rules] == [("Null Scan", 2), ("FIN Scan", 1)]
    assert [r.packet_id for r in row.recent] == [3, 2, 1]
    labels = column(spark, ["19", "20", "50", "80"], "s").select(R.risk_label(F.col("s").cast("int"))).collect()
    assert [r[0] for r in labels] == ["LOW", "ELEVATED", "HIGH", "CRITICAL"]


def test_verdicts(spark, table):
    def verdict(df):
        return R.verdict(df).first()[0]
    assert verdict(table) == "CRITICAL THREATS DETECTED — 2 critical, 1 high alerts"
    assert verdict(table.filter("severity <> 'CRITICAL'")) == "HIGH-SEVERITY THREATS DETECTED — 1 high alerts"
    assert verdict(table.filter("severity = 'MEDIUM'")) == "MEDIUM-SEVERITY ACTIVITY — 1 medium alerts"
    assert verdict(table.filter("severity = 'LOW'")) == "LOW-SEVERITY ACTIVITY ONLY — 1 low alerts"
    assert verdict(table.limit(0)) == "No alerts triggered"


def test_hourly_histogram_clamps(spark, table):
    day = 24 * 3600 * 10**6
    rows = {r.hour: tuple(r)[1:] for r in R.hourly_histogram(table, 2 * day).collect()}
    assert len(rows) == 24 and rows[0] == (2, 1, 1, 1)
    assert {r.hour: tuple(r)[1:] for r in R.hourly_histogram(table, 100 * 10**6).collect()}[23] == (2, 1, 1, 1)


def test_maps_and_coverage(spark, table):
    geo = spark.createDataFrame([("1.1.1.1", 1.0, 2.0, "Here"), ("9.9.9.9", 0.0, 0.0, "There")], "ip string, lon double, lat double, country string")
    assert values(R.attack_map(table, geo)) == [("1.1.1.1", 1.0, 2.0, "Here", 3, "CRITICAL", 1)]
    assert values(R.attack_map_totals(table, geo)) == [(1, 1)]
    hits = {r.name: r.hits for r in R.rule_hits(table).collect()}
    assert len(hits) == 74 and hits["Null Scan"] == 2 and hits["SYN Flood"] == 0
    assert values(R.mitre_frequency(table)) == [("T1046", 3), ("T1110.001", 1)]
    assert {r.category: r.n_rules for r in R.attack_coverage(spark, by="category").collect()}["Exposed Services"] == 9
    assert R.attack_coverage(spark).count() == 33
    assert rules_df(spark).count() == 74 and len({r.id for r in RULES}) == 74


def test_drilldown(spark, table):
    assert [r.packet_id for r in R.ip_drilldown(table, "1.1.1.1").collect()] == [3, 2, 1]
    assert values(R.ip_by_rule(table, "1.1.1.1")) == [("Null Scan", 2), ("FIN Scan", 1)]
    assert [r.packet_id for r in R.critical_high(table).collect()] == [1, 3, 5]
