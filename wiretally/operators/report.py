"""Reports over the alert table.

Counts tie often, so every ranking falls back on first-seen order (newest first for the
live views) and then on the key. Wherever values per key are unbounded the first
aggregate is one Spark combines on the map side; lists are only built from its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.operators.enrich import geo_df, rules_dim, with_category, with_mitre
from wiretally.operators.slabs import US
from wiretally.rules import SEVERITIES
from wiretally.schema import ARRIVAL, iso, literal_table, severity_name, severity_rank

HOUR_US = 3600 * US


def _n() -> Column:
    return F.count(F.lit(1))


def _at() -> Column:
    return F.expr(ARRIVAL)


def _of(level: str) -> Column:
    return F.expr(f"count_if(severity = '{level}')")


def _by_level() -> list[Column]:
    return [F.expr(f"count_if(coalesce(severity, 'LOW') = '{s}') AS {s.lower()}") for s in reversed(SEVERITIES)]


def _told(alerts: DataFrame) -> DataFrame:
    """Rows of a log may lack fields: such an alert counts as LOW, its rule as Unknown, its category as Other."""
    missing = {"severity": "LOW", "rule": "Unknown", "category": "Other"}
    return alerts.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in missing.items() if c in alerts.columns})


def recent(alerts: DataFrame, limit: int = 500, severity: str | None = None, ip: str | None = None,
           rule: str | None = None, since: str | None = None) -> DataFrame:
    """Newest alerts first; `ip` and `rule` match substrings, `rule` in any case."""
    if severity:
        alerts = alerts.filter(F.col("severity") == severity)
    if ip:
        alerts = alerts.filter(F.contains(F.col("src_ip"), F.lit(ip)))
    if rule:
        alerts = alerts.filter(F.contains(F.lower("rule"), F.lit(rule.lower())))
    if since:
        alerts = alerts.filter(iso() > since)
    return alerts.orderBy(F.desc("ts_us"), F.desc("packet_id")).limit(limit)


def severity_totals(alerts: DataFrame, today: str) -> DataFrame:
    """One row: total, alerts of the UTC date `today`, and a count per severity."""
    return alerts.agg(_n().alias("total"), F.count_if(F.startswith(iso(), F.lit(today))).alias("today"),
                      *_by_level())


def _top(alerts: DataFrame, key: str, n: int) -> DataFrame:
    return (alerts.groupBy(key).agg(_n().alias("count"), F.max(_at()).alias("_at"))
            .orderBy(F.desc("count"), F.desc("_at"), key).limit(n).drop("_at"))


def top_sources(alerts: DataFrame, n: int = 10) -> DataFrame:
    return _top(alerts.filter(F.col("src_ip") != ""), "src_ip", n)


def top_rules(alerts: DataFrame, n: int = 10) -> DataFrame:
    return _top(_told(alerts), "rule", n)


def risk_label(score: Column) -> Column:
    return F.when(score >= 80, "CRITICAL").when(score >= 50, "HIGH").when(score >= 20, "ELEVATED").otherwise("LOW")


def risk_score(alerts: DataFrame) -> DataFrame:
    """Per source: total, counts by severity, first and last time, risk score and label."""
    score = F.least(F.lit(100), F.col("critical") * 20 + F.col("high") * 8 + F.least(F.col("total") * 2, F.lit(40)))
    return (alerts.groupBy("src_ip")
            .agg(_n().alias("total"), *_by_level(), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
            .withColumn("risk_score", score).withColumn("risk_label", risk_label(F.col("risk_score"))))


def ip_top_rules(alerts: DataFrame, n: int = 6) -> DataFrame:
    """The n most frequent rules of each source, with their position."""
    order = Window.partitionBy("src_ip").orderBy(F.desc("count"), F.desc("_at"), "rule")
    return (_told(alerts).groupBy("src_ip", "rule").agg(_n().alias("count"), F.max(_at()).alias("_at"))
            .withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n).drop("_at"))


def ip_recent(alerts: DataFrame, n: int = 20) -> DataFrame:
    """The n newest alerts of each source, with their position."""
    order = Window.partitionBy("src_ip").orderBy(F.desc("ts_us"), F.desc("packet_id"))
    return alerts.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def investigate(alerts: DataFrame, ip: str | None = None) -> DataFrame:
    """Per source (or for one): risk summary, top 10 rules and 20 newest alerts as arrays."""
    if ip is not None:
        alerts = alerts.filter(F.col("src_ip") == ip)
    summary = risk_score(alerts)
    rules = (ip_top_rules(alerts, 10).groupBy("src_ip")
             .agg(F.sort_array(F.collect_list(F.struct("position", "rule", "count"))).alias("top_rules")))
    newest = (ip_recent(alerts, 20).groupBy("src_ip")
              .agg(F.sort_array(F.collect_list(F.struct("position", "packet_id", "ts_us", "rule", "severity")))
                   .alias("recent")))
    return (summary.join(rules, "src_ip").join(newest, "src_ip")
            .withColumn("first_seen", iso("first_us")).withColumn("last_seen", iso("last_us"))
            .drop("first_us", "last_us"))


def ip_techniques(alerts: DataFrame, rules=None) -> DataFrame:
    """Distinct ATT&CK techniques per source."""
    pairs = with_mitre(alerts.select("src_ip", "rule"), rules).filter(F.col("mitre").isNotNull()) \
        .select("src_ip", "mitre").distinct()
    return pairs.groupBy("src_ip").agg(_n().alias("n_techniques"),
                                       F.sort_array(F.collect_list("mitre")).alias("techniques"))


def by_severity(alerts: DataFrame) -> DataFrame:
    """Count per severity, CRITICAL first, absent levels as zero."""
    dim = literal_table(alerts.sparkSession, [(s, i) for i, s in enumerate(reversed(SEVERITIES))],
                        "severity string, position int")
    counts = _told(alerts).groupBy("severity").agg(_n().alias("n"))
    return (F.broadcast(dim).join(counts, "severity", "left")
            .select("severity", F.coalesce("n", F.lit(0)).alias("count"), "position").orderBy("position").drop("position"))


def by_category(alerts: DataFrame, rules=None) -> DataFrame:
    return (_categorised(alerts, rules).groupBy("category").agg(_n().alias("count"), F.min(_at()).alias("_at"))
            .orderBy(F.desc("count"), "_at").drop("_at"))


def _categorised(alerts: DataFrame, rules=None) -> DataFrame:
    return _told(alerts if "category" in alerts.columns else with_category(alerts, rules))


def top_rules_first_severity(alerts: DataFrame, n: int = 15, rules=None) -> DataFrame:
    """Top rules with category and the severity of the rule's first alert."""
    grouped = _told(alerts).groupBy("rule").agg(
        _n().alias("count"), F.min(_at()).alias("_at"), F.min_by(severity_rank(), _at()).alias("_r"))
    top = grouped.orderBy(F.desc("count"), "_at").limit(n)
    return (with_category(top, rules).withColumn("severity", severity_name("_r"))
            .orderBy(F.desc("count"), "_at").select("rule", "count", "severity", "category"))


def top_attackers(alerts: DataFrame, n: int = 20, rules=None) -> DataFrame:
    """Sources by worst severity, then threat score, then count; with category and rule lists."""
    per_rule = _told(alerts).groupBy("src_ip", "rule").agg(
        _n().alias("n"), F.max(severity_rank()).alias("r"),
        F.max("threat_score").alias("s"), F.min(_at()).alias("at"))
    return (with_category(per_rule, rules).groupBy("src_ip").agg(
                F.sum("n").alias("count"), F.max("r").alias("_r"), F.max("s").alias("score"), F.min("at").alias("_at"),
                F.sort_array(F.collect_set("category")).alias("categories"),
                F.sort_array(F.collect_set("rule")).alias("rules"))
            .orderBy(F.desc("_r"), F.desc("score"), F.desc("count"), "_at").limit(n)
            .select("src_ip", "count", severity_name("_r").alias("worst_severity"), "score", "categories", "rules"))


def minute_timeline(alerts: DataFrame) -> DataFrame:
    return (alerts.groupBy(F.substring(iso(), 1, 16).alias("minute")).agg(*_by_level()).orderBy("minute"))


def alert_meta(alerts: DataFrame) -> DataFrame:
    def short(t):
        return F.coalesce(F.replace(F.substring(iso(t), 1, 19), F.lit("T"), F.lit(" ")), F.lit("—"))
    return (alerts.agg(_n().alias("total_alerts"), F.min("ts_us").alias("a"), F.max("ts_us").alias("b"))
            .select("total_alerts", short("a").alias("first_ts"), short("b").alias("last_ts")))


def ip_drilldown(alerts: DataFrame, ip: str) -> DataFrame:
    """All alerts of one source, newest first."""
    return alerts.filter(F.col("src_ip") == ip).orderBy(F.desc("ts_us"), F.desc("packet_id"))


def ip_by_rule(alerts: DataFrame, ip: str) -> DataFrame:
    return (_told(alerts).filter(F.col("src_ip") == ip).groupBy("rule").agg(_n().alias("count"), F.min(_at()).alias("_at"))
            .orderBy(F.desc("count"), "_at").drop("_at"))


def ip_by_severity(alerts: DataFrame, ip: str) -> DataFrame:
    return _told(alerts).filter(F.col("src_ip") == ip).groupBy("severity").agg(_n().alias("count"))


def capture_overview(packets: DataFrame, alerts: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One row: packets, IP and non-IP packets, start, end, duration, alerts and attackers.

    `skipped(ts_us)` holds the frames that were no IPv4 packets.
    """
    zero, null = F.expr("0L"), F.lit(None).cast("bigint")

    def part(ip, non_ip, first, last, n_alerts, attackers):
        return [c.alias(n) for c, n in zip((ip, non_ip, first, last, n_alerts, attackers),
                                           ("ip", "non_ip", "first", "last", "alerts", "attackers"))]

    parts = [packets.agg(*part(_n(), zero, F.min("ts_us"), F.max("ts_us"), zero, zero)),
             alerts.groupBy("src_ip").agg(_n().alias("n")).agg(
                 *part(zero, zero, null, null, F.coalesce(F.sum("n"), zero), _n()))]
    if skipped is not None:
        parts.append(skipped.agg(*part(zero, _n(), F.min("ts_us"), F.max("ts_us"), zero, zero)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return (rows.agg(*[f(c).alias(c) for c, f in (("ip", F.sum), ("non_ip", F.sum), ("first", F.min), ("last", F.max),
                                                  ("alerts", F.sum), ("attackers", F.sum))])
            .select((F.col("ip") + F.col("non_ip")).alias("total_packets"), F.col("ip").alias("ip_packets"),
                    F.col("non_ip").alias("non_ip_packets"), iso("first").alias("capture_start"),
                    iso("last").alias("capture_end"),
                    F.coalesce(F.col("last") - F.col("first"), zero).alias("duration_us"),
                    "alerts", F.col("attackers").alias("unique_attackers")))


def breakdown_pct(alerts: DataFrame, by: str = "severity", rules=None) -> DataFrame:
    """Count, percent of all alerts and fraction of the largest group."""
    counts = by_severity(alerts) if by == "severity" else by_category(alerts, rules)
    everything = Window.partitionBy()  # over at most one row per severity or category
    n = F.col("count")
    return counts.select(
        by, "count", F.round(F.coalesce(F.try_divide(n * 100, F.sum("count").over(everything)), F.lit(0.0)), 4).alias("pct"),
        F.round(F.coalesce(F.try_divide(n, F.max("count").over(everything)), F.lit(0.0)), 4).alias("bar"))


def critical_high(alerts: DataFrame, n: int = 20) -> DataFrame:
    """The first n CRITICAL or HIGH alerts in capture order."""
    return alerts.filter(F.col("severity").isin("CRITICAL", "HIGH")).orderBy("ts_us", "packet_id").limit(n)


def verdict(alerts: DataFrame) -> DataFrame:
    """One line by the highest severity present."""
    c, h, m, low = (F.col(s.lower()).cast("string") for s in reversed(SEVERITIES))
    # The wording of a verdict.
    return alerts.agg(_n().alias("total"), *_by_level()).select(
        F.when(F.col("total") == 0, "No alerts triggered")
        .when(F.col("critical") > 0, F.concat(F.lit("CRITICAL THREATS DETECTED — "), c, F.lit(" critical, "), h, F.lit(" high alerts")))
        .when(F.col("high") > 0, F.concat(F.lit("HIGH-SEVERITY THREATS DETECTED — "), h, F.lit(" high alerts")))
        .when(F.col("medium") > 0, F.concat(F.lit("MEDIUM-SEVERITY ACTIVITY — "), m, F.lit(" medium alerts")))
        .otherwise(F.concat(F.lit("LOW-SEVERITY ACTIVITY ONLY — "), low, F.lit(" low alerts"))).alias("verdict"))


def protocol_breakdown(packets: DataFrame) -> DataFrame:
    """Packets by TCP, UDP, ICMP and Other, absent ones as zero, with percent of all."""
    names = literal_table(packets.sparkSession, [("TCP",), ("UDP",), ("ICMP",), ("Other",)], "protocol string")
    p = F.col("protocol")
    counts = (packets.groupBy(F.when(p == 6, "TCP").when(p == 17, "UDP").when(p == 1, "ICMP").otherwise("Other")
                              .alias("protocol")).agg(_n().alias("n")))
    everything = Window.partitionBy()  # four rows
    return (F.broadcast(names).join(counts, "protocol", "left")
            .select("protocol", F.coalesce("n", F.lit(0)).alias("count"))
            .withColumn("pct", F.round(F.coalesce(F.try_divide(
                F.col("count") * 100, F.sum("count").over(everything)), F.lit(0.0)), 4)))


def hourly_histogram(alerts: DataFrame, now_us: int) -> DataFrame:
    """24 hourly buckets up to `now_us` (23 = the current hour) by severity.

    Older alerts count in bucket 0; a severity other than the top three counts as low.
    """
    age = F.floor((F.lit(now_us) - F.col("ts_us")) / HOUR_US)
    hour = F.lit(23) - F.greatest(F.least(age, F.lit(23)), F.lit(0))
    counts = (alerts.groupBy(hour.cast("bigint").alias("hour"))
              .agg(*[_of(s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM")], _n().alias("n")))
    zero = F.expr("0L")
    top = [F.coalesce(F.col(c), zero) for c in ("critical", "high", "medium")]
    return (F.broadcast(alerts.sparkSession.range(24).withColumnRenamed("id", "hour")).join(counts, "hour", "left")
            .select("hour", *[c.alias(n) for c, n in zip(top, ("critical", "high", "medium"))],
                    (F.coalesce(F.col("n"), zero) - top[0] - top[1] - top[2]).alias("low"))
            .orderBy("hour"))


def attack_map(alerts: DataFrame, geo: DataFrame | None = None) -> DataFrame:
    """Per source with a known position: count, worst severity, critical count, country."""
    geo = geo_df(alerts.sparkSession) if geo is None else geo
    per_ip = alerts.groupBy("src_ip").agg(
        _n().alias("count"), F.coalesce(F.max(severity_rank()), F.lit(0)).alias("_r"),
        _of("CRITICAL").alias("critical"), F.min(_at()).alias("_at"))
    return (per_ip.join(geo, per_ip.src_ip == geo.ip)
            .orderBy(F.desc("count"), "_at")
            .select("src_ip", "lon", "lat", "country", "count", severity_name("_r").alias("worst_severity"), "critical"))


def attack_map_totals(alerts: DataFrame, geo: DataFrame | None = None) -> DataFrame:
    return attack_map(alerts, geo).agg(_n().alias("attackers"), F.countDistinct("country").alias("countries"))


def rule_hits(alerts: DataFrame, rules=None) -> DataFrame:
    """Alerts per rule over the whole rule list, zero for silent rules."""
    counts = alerts.groupBy("rule").agg(_n().alias("n"))
    dim = rules_dim(alerts.sparkSession, rules)
    return (dim.join(counts, dim.name == counts.rule, "left")
            .select("id", "name", F.col("severity"), "category", F.coalesce("n", F.lit(0)).alias("hits")))


def mitre_frequency(alerts: DataFrame, rules=None) -> DataFrame:
    counts = alerts.groupBy("rule").agg(_n().alias("n"))
    return (with_mitre(counts, rules).filter(F.col("mitre").isNotNull()).groupBy("mitre")
            .agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "mitre"))


def top_ports(alerts: DataFrame, n: int = 10) -> DataFrame:
    return _top(alerts.filter(F.col("dst_port").isNotNull()), "dst_port", n)


def attack_coverage(spark, rules=None, by: str = "mitre") -> DataFrame:
    """Rules per technique or category."""
    return rules_dim(spark, rules).groupBy(by).agg(_n().alias("n_rules"))


def attack_coverage_seen(alerts: DataFrame, rules=None, by: str = "mitre") -> DataFrame:
    """Rules per technique or category, how many of them fired and with how many alerts."""
    return (rule_hits(alerts, rules).join(rules_dim(alerts.sparkSession, rules).select("name", "mitre"), "name")
            .groupBy(by).agg(_n().alias("n_rules"), F.count_if(F.col("hits") > 0).alias("rules_seen"),
                             F.sum("hits").alias("alerts")))
