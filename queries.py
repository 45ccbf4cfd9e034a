"""The registered queries: every operator of the inventory over the driver's tables.

Packets are derived from `lineitem`; alerts from packets. Results are flattened for
comparison: integers to BIGINT, booleans to 0/1, string arrays joined with `|`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiretally.functions.net import flag_letters, ip_to_num, is_ipv4, protocol_name
from wiretally.functions.predicates import compile_conditions
from wiretally.operators import alerts as A
from wiretally.operators import correlate as C
from wiretally.operators import detect as D
from wiretally.operators import enrich as E
from wiretally.operators import report as R
from wiretally.plans import pipeline as P
from wiretally.rules import RULES, rules_df
from wiretally.schema import iso, literal_table
from wiretally.session import shared_dir
from wiretally.sources import alert_log, allowlist, frames
from wiretally.sources import packets as S
from wiretally.sources.lineitem import packets_from_lineitem
from wiretally.streaming.stream import Detector

SENSOR = "192.168.1.10"
ALLOWED = ["172.16.5.0/24"]
ACTOR = "10.0.99.1"

# User-supplied rules that replace the catalogue: every operator, three kinds, odd windows.
CUSTOM_RULES = [
    {"id": "X1", "name": "web without push", "type": "pattern", "severity": "LOW",
     "conditions": {"dst_port": [80, 443], "flags_int": {"mask": 2}, "ttl": {"not": 2}}},
    {"id": "X2", "name": "short packets", "type": "rate", "severity": "HIGH", "threshold": 40, "window_seconds": 7,
     "conditions": {"length": {"lt": 100, "gte": 60}, "dst_port": {"not_in": [80, 443]}}},
    {"id": "X3", "name": "anything", "type": "rate", "severity": "MEDIUM", "threshold": 900, "window_seconds": 2,
     "conditions": {}},
    {"id": "X4", "name": "udp fan-out", "type": "multi_destination", "severity": "CRITICAL", "threshold": 12,
     "window_seconds": 3, "track": "dst_port", "conditions": {"protocol": 17, "dst_port": {"!=": 53}}},
]


def flat(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        out.append(c.alias(f.name))
    return df.select(*out)


def packets(spark: SparkSession, d: str) -> DataFrame:
    return packets_from_lineitem(spark, d)


def offline(spark: SparkSession, d: str) -> DataFrame:
    return P.offline(packets(spark, d))


def allow(spark: SparkSession, entries=None) -> DataFrame:
    return allowlist.parse_entries(literal_table(spark, [(e,) for e in entries or ALLOWED], "entry string"))


def live(spark: SparkSession, d: str) -> DataFrame:
    return P.live(packets(spark, d), allow(spark), [SENSOR])


def cooled(spark: SparkSession, d: str) -> DataFrame:
    return A.cooldown(P.cut(P.live_alerts(packets(spark, d), allow(spark), [SENSOR]), "alerts"))


def nation_geo(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet")
    k = F.col("n_nationkey").cast("string")
    return n.select(F.concat(F.lit("10.0."), k, F.lit(".1")).alias("ip"), F.col("n_regionkey").cast("double").alias("lon"),
                    F.col("n_nationkey").cast("double").alias("lat"), F.col("n_name").alias("country"))


def entries_of(p: DataFrame) -> DataFrame:
    """Allowlist entries as users write them, one per packet: networks with host bits, bare
    addresses, netmasks and mistakes."""
    i, ip = F.col("packet_id"), F.col("src_ip")
    return p.select(
        F.when(i % 13 == 0, ip).when(i % 13 == 1, F.concat(ip, F.lit("/33"))).when(i % 13 == 2, F.concat(F.lit("x"), ip))
        .when(i % 13 == 3, F.concat(ip, F.lit("/255.255.0.0"))).when(i % 13 == 4, F.concat(ip, F.lit(".9")))
        .otherwise(F.concat(ip, F.lit("/"), (8 + i % 25).cast("string"))).alias("entry")).distinct()


def log_lines(alerts: DataFrame) -> DataFrame:
    """The alerts as log lines, each followed by a blank line or a damaged copy."""
    line = alert_log.alert_lines(alerts)
    bare = F.to_json(F.struct(iso().alias("timestamp"), F.concat(F.lit("?"), F.col("rule")).alias("rule"),
                              "src_ip"))
    return alerts.select(F.explode(F.array(
        line, F.when(F.col("packet_id") % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit("{bad "), line)), bare)).alias("value"))


# Log lines repeat their field names, rules and addresses: packed they take a tenth of the disk.
PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}

# Sources and sinks

def a1_read_packets(spark, d):
    """The packets in three formats; each must read back unchanged."""
    path = shared_dir(spark, "packets")
    for fmt in ("parquet", "csv", "json"):
        S.write_packets(packets(spark, d), f"{path}/{fmt}", fmt)
    both = S.read_packets(spark, f"{path}/csv", "csv").unionByName(S.read_packets(spark, f"{path}/json", "json"))
    return S.read_packets(spark, f"{path}/parquet").unionByName(both)


def a2_decode_frames(spark, d):
    return frames.decode_frames(frames.encode_frames(packets(spark, d)))


def _mixed_frames(spark, d):
    """Frames in which the IPv6 tunnel packets have become IPv6 frames."""
    p = packets(spark, d)
    six = p.filter(F.col("protocol") == 41).select("packet_id")
    f = frames.encode_frames(p).join(six.withColumn("six", F.lit(True)), "packet_id", "left")
    return f.withColumn("raw", F.when(F.col("six"), F.concat(F.unhex(F.lit("60")), F.substring("raw", 2, 2000)))
                        .otherwise(F.col("raw"))).drop("six")


def a3_skipped_frames(spark, d):
    return frames.frame_counts(_mixed_frames(spark, d))


def a4_read_alerts(spark, d):
    rows = alert_log.parse_alert_lines(log_lines(offline(spark, d)))
    return rows.select("timestamp", "rule", "severity", "src_ip", "dst_ip", "dst_port", "protocol", "correlated",
                       "also_triggered", "count", "threat_score", "category", "id")


def _from_log(spark, alerts: DataFrame, plain: bool = False) -> DataFrame:
    """Alerts written to a log and read back; unless `plain` with damaged lines and lines that lack fields."""
    path = shared_dir(spark, "log")
    if plain:
        alert_log.write_alerts(alerts, path, **PACKED)
    else:
        log_lines(alerts).write.options(**PACKED).text(path)
    return alert_log.read_alerts(spark, path)


def a4_rejected_lines(spark, d):
    path = shared_dir(spark, "log")
    log_lines(offline(spark, d)).write.options(**PACKED).text(path)
    return alert_log.rejected_lines(spark, path).agg(F.sum("rejected").alias("rejected"), F.min("example").alias("example"))


def a4_log_cooldown(spark, d):
    """The cooldown of a log that has been read back is that of the alerts."""
    log = _from_log(spark, offline(spark, d), plain=True).select("packet_id", "ts_us", "rule", "src_ip")
    return A.passed(P.cut(log, "alerts")).select("ts_us", "rule", "src_ip")


def f5_log_investigation(spark, d):
    log = _from_log(spark, offline(spark, d)).select("packet_id", "ts_us", "rule", "severity", "src_ip")
    out = R.investigate(P.cut(log, "alerts"))
    return out.select("src_ip", "total", "critical", "high", "medium", "low", "risk_score", "first_seen", "last_seen",
                      F.transform("top_rules", lambda x: x["count"].cast("string")).alias("top_counts"))


def a5_write_alerts(spark, d):
    path = shared_dir(spark, "log")
    alert_log.write_alerts(offline(spark, d), path)
    return spark.read.text(path).select("date", "value")


def a6_export_csv(spark, d):
    path = shared_dir(spark, "csv")
    alert_log.export_csv(E.enrich(offline(spark, d), nation_geo(spark, d)), path)
    return spark.read.option("header", True).csv(path)


def a7_rule_listing(spark, d):
    """The rule listing with the packets each rule fired on."""
    n = D.hits(packets(spark, d)).groupBy("ord").agg(F.count(F.lit(1)).alias("packets"))
    return (F.broadcast(rules_df(spark)).join(n, "ord", "left")
            .select("name", "severity", "type", "category", "mitre", F.coalesce("packets", F.lit(0)).alias("packets")))


def a8_allowlist_ranges(spark, d):
    return allowlist.parse_entries(entries_of(packets(spark, d)))


def a9_allowlist_add(spark, d):
    p = packets(spark, d)
    current = p.filter("protocol = 1").select(F.concat("src_ip", F.lit("/32")).alias("entry")).distinct()
    return allowlist.allowlist_add(current, entries_of(p))


def a9_allowlist_remove(spark, d):
    p = packets(spark, d)
    current = allowlist.allowlist_add(literal_table(spark, [("x10.0.1.1",)], "entry string"), entries_of(p))
    return allowlist.allowlist_remove(current, entries_of(p.filter("protocol = 6")))


def _stream(spark, d, mode="live", slices=2, lateness_s=0, reorder=False, rules=None, allowed=None, after=None):
    """Packets arriving in time slices; each arrival is one run of the stream. `allowed(i)` are the entries that hold
    for a slice, `after(detector, i)` sees the stream behind it."""
    base = shared_dir(spark, "stream")
    allowlist.save_allowlist(literal_table(spark, [(e,) for e in ALLOWED], "entry string"), f"{base}/allow")
    det = Detector(spark, base, mode=mode, rules=rules, lateness_s=lateness_s, allow=lambda: allowlist.latest(spark, f"{base}/allow"), local_ips=(SENSOR,))
    p = P.cut(packets(spark, d), "packets")
    # Equal slices of the time range; reading its two ends is all the driver sees.
    lo, hi = p.agg(F.min("ts_us"), F.max("ts_us")).first()
    width = (hi - lo) // slices + 1
    order = range(slices)
    source = lambda: S.read_packet_stream(spark, f"{base}/in")
    for i in (reversed(order) if reorder else order):
        if allowed is not None:
            allowlist.save_allowlist(literal_table(spark, [(e,) for e in allowed(i)], "entry string"), f"{base}/allow")
        part = p.filter((F.col("ts_us") >= lo + i * width) & (F.col("ts_us") < lo + (i + 1) * width))
        S.write_packets(part, f"{base}/in")
        det.run(source())
        if after is not None:
            after(det, i)
    det.drain(source())
    return det


def a10_packet_stream(spark, d):
    base = shared_dir(spark, "stream")
    S.write_packets(packets(spark, d), f"{base}/in")
    q = (S.read_packet_stream(spark, f"{base}/in").writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return S.read_packets(spark, f"{base}/out")


# Predicates and scalar functions

PREDICATES = {
    "b1_equality": {"flags": "S"},
    "b1_equality_null": {"icmp_type": None},
    "b2_membership": {"dst_port": [80, 443, 22]},
    "b3_greater": {"length": {">": 100}},
    "b4_greater_equal": {"dst_port": {"gte": 1024}},
    "b5_less": {"ttl": {"<": 64}},
    "b6_less_equal": {"dst_port": {"lte": 443}},
    "b7_not_equal": {"dst_port": {"!=": 80}},
    "b8_not_in": {"flags": {"not_in": ["S", "PA"]}},
    "b9_mask": {"flags_int": {"mask": 3}},
    "b10_conjunction": {"protocol": [6, 17], "dst_port": {">": 50, "<=": 9000}, "flags_int": {"!=": 2}},
}


def _predicate(conditions):
    return lambda spark, d: packets(spark, d).filter(compile_conditions(conditions)).select("packet_id")


def b11_protocol_name(spark, d):
    return packets(spark, d).select("packet_id", protocol_name(F.col("protocol")).alias("protocol"))


def b12_flag_letters(spark, d):
    return packets(spark, d).select("packet_id", flag_letters(F.col("flags_int"), F.col("protocol")).alias("letters"))


def b13_drop_local(spark, d):
    return E.drop_local(packets(spark, d), [SENSOR, ""]).select("packet_id", "src_ip")


def b14_drop_allowlisted(spark, d):
    nets = allow(spark, [*ALLOWED, "10.0.5.77/26", "192.168.1.50", "bad", "::/0"])
    return E.drop_allowlisted(packets(spark, d), nets).select("packet_id", "src_ip")


def b15_category(spark, d):
    a = C.lead(D.detect(packets(spark, d)))
    return E.with_category(a.withColumn("rule", F.when(F.col("packet_id") % 10 == 0, "renamed").otherwise(F.col("rule")))) \
        .select("packet_id", "rule", "category")


def b16_enrich(spark, d):
    a = offline(spark, d).drop("id").withColumn("category", F.when(F.col("packet_id") % 3 > 0, "").otherwise("mine"))
    return E.enrich(a, nation_geo(spark, d)).select("packet_id", "id", "category", "src_country", "type", "protocol", "mitre")


def b17_ip_literals(spark, d):
    ip = F.when(F.col("packet_id") % 7 == 0, F.concat("src_ip", F.lit("9"))).otherwise(F.col("src_ip"))
    return packets(spark, d).select("packet_id", ip.alias("ip")).withColumn("valid", is_ipv4(F.col("ip"))) \
        .withColumn("num", ip_to_num("ip"))


# Detection and correlation

def _detect(rules=None):
    return lambda spark, d: D.detect(packets(spark, d), rules)


def _by_track(track):
    rules = [r for r in RULES if r.track == track]
    return lambda spark, d: D.detect_distinct(packets(spark, d), rules)


def c7_catalogue_hits(spark, d):
    return D.detect(packets(spark, d)).groupBy("id", "rule", "severity").agg(
        F.count(F.lit(1)).alias("alerts"), F.max("cnt").alias("peak"))


def d1_leader(spark, d):
    return C.lead(D.detect(packets(spark, d))).select("packet_id", "rule", "severity", "dst_ip", "dst_port", "protocol", "id")


def d2_also_triggered(spark, d):
    return C.lead(D.detect(packets(spark, d))).select("packet_id", "correlated", "also_triggered")


def d3_leader_count(spark, d):
    return C.lead(D.detect(packets(spark, d))).select("packet_id", "count")


def d4_threat_score(spark, d):
    return C.threat_score(D.detect(packets(spark, d)))


def d5_escalated(spark, d):
    return C.correlate(D.detect(packets(spark, d))).select("packet_id", "rule", "severity", "threat_score")


def d6_capture_score(spark, d):
    return C.threat_score(D.detect(packets(spark, d)), None)


# Alert stream operators

def e2_suppressed(spark, d):
    return A.suppressed(cooled(spark, d))


def e2_suppressed_total(spark, d):
    return A.suppressed_total(cooled(spark, d))


def e3_notify(spark, d):
    return A.notify_filter(live(spark, d))


def _batched(spark, d):
    return A.batch(P.cut(A.notify_filter(live(spark, d)), "notify"))


def e4_batches(spark, d):
    return _batched(spark, d).select("packet_id", "batch_id")


def e4_batches_undeduplicated(spark, d):
    """Batches over every alert of the capture, so that batches are large and the chain long."""
    return A.batch(P.cut(offline(spark, d), "alerts")).select("packet_id", "batch_id")


def e5_digest(spark, d):
    return A.digest(_batched(spark, d))


def e5_digest_lines(spark, d):
    return A.digest_lines(_batched(spark, d)).select("batch_id", "packet_id", "line")


def e6_pending(spark, d):
    return A.pending(A.batch(P.cut(offline(spark, d), "alerts")), 100).select("packet_id", "batch_id")


def e7_icons(spark, d):
    return A.digest(A.batch(P.cut(offline(spark, d), "alerts"))).select("batch_id", "n_alerts", "subject", "icon")


# Reports

def f5_investigate(spark, d):
    out = R.investigate(P.cut(offline(spark, d), "alerts"))
    return (out.withColumn("top_rules", F.transform("top_rules", lambda x: F.concat(x["rule"], F.lit("="), x["count"].cast("string"))))
            .withColumn("recent", F.transform("recent", lambda x: x["packet_id"].cast("string"))))


def f8_techniques(spark, d):
    return R.ip_techniques(offline(spark, d))


def f16_breakdown(by):
    return lambda spark, d: R.breakdown_pct(offline(spark, d), by)


def f15_capture_overview(spark, d):
    ip, other = frames.split_frames(_mixed_frames(spark, d))
    p = frames.decode_frames(ip)
    return R.capture_overview(p, offline(spark, d), other)


def _spread(a: DataFrame) -> DataFrame:
    """The alerts slowed down 200 times, to cover more than a day."""
    return a.withColumn("ts_us", F.col("ts_us") * 200)


def g1_late_packets(spark, d):
    """Slices arriving newest first: all but the first to arrive are late."""
    return _stream(spark, d, mode="offline", reorder=True).late().select("packet_id", "ts_us")


def g2_stream_alerts(spark, d):
    return _stream(spark, d).alerts()


def g3_window_state(spark, d):
    """The entries of window state behind each of five slices of the stream: what windows can still reach, however
    long the stream has run."""
    seen = []

    def look(det, i):
        batch = det.by_batch().agg(F.max("batch")).first()[0]
        seen.append(det.window_entries(batch).groupBy("set").agg(F.count("*").alias("entries")).select(F.lit(i).alias("slice"), "set", "entries"))

    _stream(spark, d, mode="offline", slices=5, rules=CUSTOM_RULES, after=look)
    return reduce(DataFrame.unionByName, seen)


def g4_allowlist_refresh(spark, d):
    """An allowlist that changes between two arrivals holds from the next one on."""
    return _stream(spark, d, allowed=lambda i: [["10.0.1.0/24"], ["10.0.2.0/24", "172.16.0.0/16"]][i]).alerts()


def g5_log_lines(spark, d):
    det = _stream(spark, d, after=lambda det, i: det.publish())
    det.publish()
    return det.log().select("date", "value")


def g5_digests(spark, d):
    """Digests of a stream in three arrivals: batches go on over them."""
    det = _stream(spark, d, slices=3, after=lambda det, i: det.publish())
    det.publish()
    return det.digests()


def g6_lateness_and_drain(spark, d):
    """Slices arriving newest first within the lateness bound: nothing is lost."""
    return _stream(spark, d, mode="offline", lateness_s=100_000, reorder=True).alerts()


def g7_counters(spark, d):
    return _stream(spark, d).counters()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q = {
        "a1_read_packets": a1_read_packets,
        "a2_decode_frames": a2_decode_frames,
        "a3_skipped_frames": a3_skipped_frames,
        "a4_read_alerts": a4_read_alerts,
        "a4_log_cooldown": a4_log_cooldown,
        "a4_rejected_lines": a4_rejected_lines,
        "a5_write_alerts": a5_write_alerts,
        "a6_export_csv": a6_export_csv,
        "a7_rule_listing": a7_rule_listing,
        "a8_allowlist_ranges": a8_allowlist_ranges,
        "a9_allowlist_add": a9_allowlist_add,
        "a9_allowlist_remove": a9_allowlist_remove,
        "a10_packet_stream": a10_packet_stream,
        **{k: _predicate(c) for k, c in PREDICATES.items()},
        "b11_protocol_name": b11_protocol_name,
        "b12_flag_letters": b12_flag_letters,
        "b13_drop_local": b13_drop_local,
        "b14_drop_allowlisted": b14_drop_allowlisted,
        "b15_category": b15_category,
        "b16_enrich": b16_enrich,
        "b17_ip_literals": b17_ip_literals,
        "c1_pattern_alerts": lambda s, d: D.detect_pattern(packets(s, d)),
        "c2_rate_alerts": lambda s, d: D.detect_rate(packets(s, d)),
        "c3_distinct_ports": _by_track("dst_port"),
        "c4_distinct_hosts": _by_track("dst_ip"),
        "c5_all_rules": _detect(),
        "c6_custom_rules": _detect(CUSTOM_RULES),
        "c7_catalogue_hits": c7_catalogue_hits,
        "d1_leader": d1_leader,
        "d2_also_triggered": d2_also_triggered,
        "d3_leader_count": d3_leader_count,
        "d4_threat_score": d4_threat_score,
        "d5_escalated": d5_escalated,
        "d6_capture_score": d6_capture_score,
        "d_offline_alerts": offline,
        "e1_cooldown": live,
        "e2_suppressed": e2_suppressed,
        "e2_suppressed_total": e2_suppressed_total,
        "e3_notify": e3_notify,
        "e4_batches": e4_batches,
        "e4_batches_undeduplicated": e4_batches_undeduplicated,
        "e5_digest": e5_digest,
        "e5_digest_lines": e5_digest_lines,
        "e6_pending": e6_pending,
        "e7_icons": e7_icons,
        "f1_recent": lambda s, d: R.recent(offline(s, d)),
        "f1_recent_filtered": lambda s, d: R.recent(offline(s, d), 100, severity="HIGH", ip="10.0.", rule="SCAN",
                                                    since="1970-01-01T00:00:05+00:00"),
        "f2_totals": lambda s, d: R.severity_totals(_spread(offline(s, d)), "1970-01-01"),
        "f2_log_totals": lambda s, d: R.severity_totals(_from_log(s, offline(s, d)), "1970-01-01"),
        "f3_top_sources": lambda s, d: R.top_sources(offline(s, d)),
        "f4_top_rules": lambda s, d: R.top_rules(offline(s, d)),
        "f5_investigate": f5_investigate,
        "f5_log_investigation": f5_log_investigation,
        "f6_risk_score": lambda s, d: R.risk_score(live(s, d)),
        "f7_risk_label": lambda s, d: R.risk_score(offline(s, d)).select("src_ip", "risk_score", "risk_label"),
        "f8_techniques": f8_techniques,
        "f8_ip_top_rules": lambda s, d: R.ip_top_rules(offline(s, d)),
        "f9_by_severity": lambda s, d: R.by_severity(offline(s, d)),
        "f9_by_category": lambda s, d: R.by_category(offline(s, d)),
        "f9_log_by_severity": lambda s, d: R.by_severity(_from_log(s, offline(s, d))),
        "f9_log_by_category": lambda s, d: R.by_category(_from_log(s, offline(s, d))),
        "f10_top_rules_first_severity": lambda s, d: R.top_rules_first_severity(offline(s, d)),
        "f11_top_attackers": lambda s, d: R.top_attackers(offline(s, d)),
        "f12_minute_timeline": lambda s, d: R.minute_timeline(offline(s, d)),
        "f13_meta": lambda s, d: R.alert_meta(offline(s, d)),
        "f14_drilldown": lambda s, d: R.ip_drilldown(offline(s, d), ACTOR).select("packet_id", "ts_us", "rule", "severity"),
        "f14_drilldown_rules": lambda s, d: R.ip_by_rule(offline(s, d), ACTOR),
        "f14_drilldown_severity": lambda s, d: R.ip_by_severity(offline(s, d), ACTOR),
        "f15_capture_overview": f15_capture_overview,
        "f16_severity_pct": f16_breakdown("severity"),
        "f16_category_pct": f16_breakdown("category"),
        "f17_critical_high": lambda s, d: R.critical_high(offline(s, d)),
        "f18_verdict": lambda s, d: R.verdict(offline(s, d)),
        "f19_protocols": lambda s, d: R.protocol_breakdown(packets(s, d)),
        "f20_hourly": lambda s, d: R.hourly_histogram(_spread(offline(s, d)), 100_000_000_000),
        "f21_attack_map": lambda s, d: R.attack_map(offline(s, d), nation_geo(s, d)),
        "f21_attack_map_totals": lambda s, d: R.attack_map_totals(offline(s, d), nation_geo(s, d)),
        "f22_rule_hits": lambda s, d: R.rule_hits(live(s, d)),
        "f23_mitre_frequency": lambda s, d: R.mitre_frequency(offline(s, d)),
        "f23_top_ports": lambda s, d: R.top_ports(offline(s, d)),
        "f24_coverage_mitre": lambda s, d: R.attack_coverage_seen(offline(s, d)),
        "f24_coverage_category": lambda s, d: R.attack_coverage_seen(offline(s, d), by="category"),
        "g1_late_packets": g1_late_packets,
        "g2_stream_alerts": g2_stream_alerts,
        "g3_window_state": g3_window_state,
        "g4_allowlist_refresh": g4_allowlist_refresh,
        "g5_log_lines": g5_log_lines,
        "g5_digests": g5_digests,
        "g6_lateness_and_drain": g6_lateness_and_drain,
        "g7_counters": g7_counters,
    }
    return {k: (lambda spark, d, f=f: flat(f(spark, d))) for k, f in q.items()}
