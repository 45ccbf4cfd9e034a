import json

from model import packet
from test_detect import frame

from wiretally.functions.net import flag_letters, is_ip, num_to_ip
from wiretally.operators import report
from wiretally.operators.alerts import cooldown
from wiretally.operators.enrich import drop_allowlisted, drop_local, enrich, geo_df
from wiretally.schema import iso, micros
from wiretally.session import shared_dir
from wiretally.sources import alert_log, allowlist, frames
from pyspark.sql import functions as F
from test_alerts import alerts


def column(spark, values, name="entry"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_allowlist_entries(spark):
    rows = {r.entry: (r.lo, r.hi, r.len) for r in allowlist.parse_entries(column(spark, [
        "10.0.0.7/8", "bad", "::/0", "1.2.3.4", "1.2.3.4/33", "1.2.3.4/255.255.255.0", "1.2.3.4/0.0.0.255", "01.2.3.4", "1.2.3.4/",
        "1.2.3.4/08", "0.0.0.0/0", "1.2.3.4/24/1", "1.2.3.256"])).collect()}
    ip = 16909060
    assert rows == {"10.0.0.7/8": (167772160, 184549375, 8), "1.2.3.4": (ip, ip, 32), "1.2.3.4/255.255.255.0": (ip - 4, ip + 251, 24),
                    "1.2.3.4/0.0.0.255": (ip - 4, ip + 251, 24), "1.2.3.4/08": (16777216, 33554431, 8), "0.0.0.0/0": (0, 2**32 - 1, 0)}


def test_allowlist_maintenance(spark):
    current = column(spark, ["10.0.0.0/8", "odd"])
    added = allowlist.allowlist_add(current, column(spark, ["10.1.2.3/8", "2001:DB8::1/32", "nope", "1.1.1.1"]))
    assert sorted(r.entry for r in added.collect()) == ["1.1.1.1/32", "10.0.0.0/8", "2001:db8::/32", "odd"]
    left = allowlist.allowlist_remove(added, column(spark, ["10.9.9.9/8", "odd", "2001:db8::/32"]))
    assert [r.entry for r in left.collect()] == ["1.1.1.1/32"]


def test_allowlist_file_and_filters(spark, tmp_path):
    path = tmp_path / "allow.json"
    path.write_text(json.dumps({"entries": ["10.0.0.0/8", "bad", "::/0"]}, indent=2))
    p = frame(spark, [packet(i, 0, src=s) for i, s in enumerate(["10.1.1.1", "11.1.1.1", "not-an-ip", "127.0.0.1", "::1", "5.5.5.5"])])
    kept = drop_local(drop_allowlisted(p, allowlist.read_allowlist(spark, str(path))), ["5.5.5.5", ""])
    assert [r.src_ip for r in kept.orderBy("packet_id").collect()] == ["11.1.1.1", "not-an-ip"]


def test_ip_literals(spark):
    cases = {"1.2.3.4": True, "256.1.1.1": False, "1.2.3": False, "::": True, "::1": True, "1:2:3:4:5:6:7:8": True, "1:2:3:4:5:6:7": False,
             "1::2::3": False, "12345::": False, "": False, "a.b.c.d": False, "1:2:3:4:5:6:7::": True, "1:2:3:4:5:6:7:8::": False}
    got = column(spark, list(cases), "ip").withColumn("ok", is_ip(F.col("ip"))).collect()
    assert {r.ip: r.ok for r in got} == cases


def test_iso_text(spark):
    row = spark.range(1).select(iso("0L").alias("a"), iso("1500000L").alias("b"), iso("-1L").alias("c"), num_to_ip("3232235777L").alias("d"),
                                flag_letters(F.lit(511)).alias("e"), micros(F.lit("1970-01-01T00:00:01.5+00:00")).alias("f")).first()
    assert list(row) == ["1970-01-01T00:00:00+00:00", "1970-01-01T00:00:01.500000+00:00", "1969-12-31T23:59:59.999999+00:00",
                         "192.168.1.1", "FSRPAUECN", 1500000]


def test_alert_log_round_trip(spark):
    a = alerts(spark, [(1, 0.5, "Null Scan", "HIGH", None, ["FIN Scan"], 7, 20), (2, 86401, "mine", "LOW", 80)]).withColumn("id", F.lit("R004"))
    path = shared_dir(spark, "log")
    alert_log.write_alerts(a, path)
    alert_log.write_alerts(a.filter("packet_id = 2"), path)
    lines = [json.loads(r.value) for r in spark.read.text(path).orderBy("date").collect()]
    assert len(lines) == 3 and lines[0]["dst_port"] is None and lines[0]["count"] == 7 and "count" not in lines[1]
    assert list(lines[0]) == ["timestamp", "rule", "severity", "src_ip", "dst_ip", "dst_port", "protocol", "correlated",
                              "also_triggered", "threat_score", "count", "id"]
    back = alert_log.read_alerts(spark, path).orderBy("ts_us").collect()
    assert [(r.rule, r.category, r.ts_us, r.id) for r in back[:2]] == [
        ("Null Scan", "Reconnaissance", 500000, "1970-01-01T00:00:00.500000+00:00|Null Scan"),
        ("mine", "Other", 86401000000, "1970-01-02T00:00:01+00:00|mine")]


def test_unreadable_log_lines_are_skipped(spark):
    lines = column(spark, ["", "   ", "{bad", '{"timestamp":"1970-01-01T00:00:00+00:00","rule":"Null Scan","src_ip":"1.1.1.1"}',
                           '{"rule":"x","category":"kept","threat_score":40}'], "value")
    rows = alert_log.parse_alert_lines(lines, keep_category=True).orderBy("rule").collect()
    assert [(r.rule, r.threat_score, r.correlated, r.also_triggered, r.category) for r in rows] == [
        ("Null Scan", 0, False, [], "Other"), ("x", 40, False, [], "kept")]


def test_enrichment_keeps_given_values(spark):
    a = alerts(spark, [(1, 0, "Null Scan", "HIGH"), (2, 0, "?", "LOW")]).withColumn("src_ip", F.lit("91.240.118.172")) \
        .withColumn("category", F.when(F.col("packet_id") == 2, "mine").otherwise("")).withColumn("protocol", F.lit(""))
    rows = enrich(a).orderBy("packet_id").collect()
    assert [(r.id, r.category, r.src_country, r.type, r.protocol, r.mitre) for r in rows] == [
        ("1970-01-01T00:00:00+00:00|Null Scan", "Reconnaissance", "Russia", "pattern", "TCP", "T1046"),
        ("1970-01-01T00:00:00+00:00|?", "mine", "Russia", "pattern", "TCP", None)]
    assert geo_df(spark).count() == 19


def _ip(protocol, body, length=None, fragment=0, ihl=5, version=4):
    total = ihl * 4 + len(body) if length is None else length
    return bytes([version * 16 + ihl, 0, *total.to_bytes(2, "big"), 0, 0, *fragment.to_bytes(2, "big"), 64, protocol, 0, 0,
                  10, 0, 0, 1, 192, 168, 1, 255]) + bytes(ihl * 4 - 20) + body


def test_frames(spark):
    tcp = (1234).to_bytes(2, "big") + (443).to_bytes(2, "big") + bytes(8) + bytes([0x51, 0xC2]) + bytes(6)
    udp = (53).to_bytes(2, "big") + (9).to_bytes(2, "big") + bytes(4)
    eth = bytes(12) + b"\x08\x00"
    cases = [(_ip(6, tcp), 0), (eth + _ip(17, udp), 14), (_ip(1, bytes([5]) + bytes(7)), 0), (_ip(6, tcp, fragment=1), 0), (_ip(6, tcp[:10]), 0),
             (_ip(6, tcp, ihl=6), 0), (_ip(89, b""), 0), (_ip(6, tcp, length=0), 0), (_ip(17, udp + bytes(20), length=22), 0),
             (bytes(12) + b"\x86\xdd" + _ip(6, tcp), 14), (_ip(6, tcp, version=6), 0), (b"\x45\x00", 0), (b"", 0)]
    df = spark.createDataFrame([(i, i, raw, at) for i, (raw, at) in enumerate(cases)], "packet_id bigint, ts_us bigint, raw binary, link_offset int")
    rows = frames.decode_frames(df).orderBy("packet_id").collect()
    assert [(r.protocol, r.src_port, r.dst_port, r.flags, r.flags_int, r.icmp_type) for r in rows] == [
        (6, 1234, 443, "SECN", 450, None), (17, 53, 9, None, 0, None), (1, None, None, None, 0, 5), (6, None, None, None, 0, None),
        (6, None, None, None, 0, None), (6, 1234, 443, "SECN", 450, None), (89, None, None, None, 0, None), (6, 1234, 443, "SECN", 450, None),
        (17, None, None, None, 0, None)]
    assert rows[0].src_ip == "10.0.0.1" and rows[0].dst_ip == "192.168.1.255" and rows[0].ttl == 64 and rows[0].length == 40
    assert tuple(frames.frame_counts(df).first()) == (13, 9, 4)


def test_csv_export(spark):
    a = enrich(alerts(spark, [(1, 0, "a, b", "HIGH")]))
    path = shared_dir(spark, "csv")
    alert_log.export_csv(a, path)
    header = "id,timestamp,severity,rule,category,type,protocol,src_ip,src_country,dst_ip,dst_port,count,ttl,length,mitre"
    files = spark.read.text(path, wholetext=True).collect()
    assert files and all(f.value.startswith(header + "\n") for f in files)
    assert [x for f in files for x in f.value.splitlines()[1:]] == [
        '"1970-01-01T00:00:00+00:00|a, b",1970-01-01T00:00:00+00:00,HIGH,"a, b",Other,pattern,TCP,1.1.1.1,Unknown,2.2.2.2,,,,,']
    assert spark.read.option("header", True).csv(path).count() == 1


def test_log_rows_can_be_told_apart(spark, tmp_path):
    """Equal lines, files read in other splits, lines without severity or rule, unreadable ones."""
    day = tmp_path / "log" / "date=1970-01-01"
    day.mkdir(parents=True)
    line = lambda s, **more: json.dumps({"timestamp": f"1970-01-01T00:00:{s:02d}+00:00", "src_ip": "1.1.1.1", **more})
    six = [line(s, rule="r", severity="HIGH") for s in (0, 0, 1, 3, 5, 7)]
    (day / "a.log").write_text("\n".join([*six, line(8), line(9), "{oops", "", '{"dst_port": "x"}']) + "\n")
    (day / "b.log").write_text(line(50, rule="r", severity="HIGH") + "\n")
    path = str(tmp_path / "log")
    got = alert_log.read_alerts(spark, path).persist()
    ids = {r.packet_id for r in got.collect()}
    assert len(ids) == got.count() == 9
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
        assert {r.packet_id for r in alert_log.read_alerts(spark, path).collect()} == ids
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    cooled = cooldown(got).collect()
    assert [(r.ts_us, r.rule) for r in sorted(cooled, key=lambda r: r.ts_us) if r.passed] == [(0, "r"), (8000000, None), (50000000, "r")] and len(cooled) == 9
    assert [(r.rejected, r.file.endswith("a.log")) for r in alert_log.rejected_lines(spark, path).collect()] == [(2, True)]
    totals = report.severity_totals(got, "1970-01-01").first()
    assert (totals.total, totals.today, totals.high, totals.low) == (9, 9, 7, 2)
    assert {r.rule: r["count"] for r in report.top_rules(got).collect()} == {"r": 7, "Unknown": 2}
    assert {r.severity: r["count"] for r in report.by_severity(got).collect()} == {"CRITICAL": 0, "HIGH": 7, "MEDIUM": 0, "LOW": 2}
    one = report.investigate(got).first()
    assert (one.total, one.high, one.low, [(x.rule, x["count"]) for x in one.top_rules]) == (9, 7, 2, [("r", 7), ("Unknown", 2)])


def test_log_lines_are_numbered_without_dealing_out_their_text(spark):
    path = shared_dir(spark, "log")
    text = '{"timestamp": "1970-01-01T00:00:01+00:00", "rule": "r", "src_ip": "a"}'
    lines = spark.createDataFrame([(text,), (text,), ("{bad",), (" ",)], "value string").coalesce(1)
    for _ in range(2):
        lines.write.mode("append").options(compression="gzip").text(path)
    alerts = alert_log.read_alerts(spark, path)
    assert len({r.packet_id for r in alerts.collect()}) == alerts.count() == 4
    node = alerts.select("packet_id", "rule")._jdf.queryExecution().sparkPlan()
    while node.nodeName() != "Window":
        node = node.children().head()
    dealt = node.children().head().output().mkString(",")
    assert "_line" in dealt and "rule" in dealt and "value" not in dealt and "src_ip" not in dealt
