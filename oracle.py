"""ANSI SQL twins of the registered queries, for DuckDB on the same Parquet tables.

Written independently of the Spark operators: counts include or exclude time peers
explicitly, distinct counts use DISTINCT windows, greedy chains a recursive CTE.
"""

from __future__ import annotations

from wiretally.rules import RULES, SEVERITIES
from wiretally.sources.lineitem import TEMPLATES

TIES = 100_000  # more packets than one source sends within a microsecond
RANK = "CASE severity WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'CRITICAL' THEN 3 END"
NAME = "CASE {} WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'CRITICAL' END"
PROTO = "CASE protocol WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE CAST(protocol AS VARCHAR) END"
BIGINT_COLS = "CAST({0} AS BIGINT) AS {0}"


def lit(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def condition(conditions: dict) -> str:
    out = []
    for name, want in conditions.items():
        if isinstance(want, dict):
            for op, v in want.items():
                out.append({">": f"{name} > {v}", ">=": f"{name} >= {v}", "<": f"{name} < {v}", "<=": f"{name} <= {v}",
                            "!=": f"{name} IS DISTINCT FROM {lit(v)}", "mask": f"({name} & {v}) = {v}"}.get(op)
                           or f"({name} IS NULL OR {name} NOT IN ({', '.join(lit(x) for x in v)}))")
        elif isinstance(want, list):
            out.append(f"{name} IN ({', '.join(lit(x) for x in want)})")
        else:
            out.append(f"{name} = {lit(want)}")
    return " AND ".join(out)


def packets() -> str:
    values = ",\n".join("(" + ", ".join(lit(v) for v in t) + ")" for t in TEMPLATES)
    return f"""tmpl(h, proto, sport, dport, flg, flg_int, icmp, len, ttl, src) AS (VALUES {values}),
li AS (
  SELECT ((CAST(l_orderkey AS BIGINT) * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS packet_id,
         l_orderkey * 2500 + l_linenumber * 1000 + CASE WHEN l_orderkey % 5 = 0 THEN 400000000 ELSE 0 END AS ts_us,
         l_partkey % 100 AS h, l_suppkey, l_orderkey * 7 + l_linenumber AS k FROM lineitem),
packets AS MATERIALIZED (
  SELECT DISTINCT packet_id, ts_us,
    CASE WHEN li.h < 74 AND l_suppkey % 10 = 0 THEN '10.0.99.1' ELSE src END AS src_ip,
    CASE WHEN li.h = 2 THEN '192.168.1.' || CAST(k % 250 AS VARCHAR) ELSE '192.168.1.20' END AS dst_ip,
    proto AS protocol, len AS length, ttl,
    CASE WHEN sport = -1 THEN 1024 + k % 60000 ELSE sport END AS src_port,
    CASE WHEN dport = -1 THEN 1024 + k % 50000 WHEN dport = -2 THEN 60001 + k % 5000 ELSE dport END AS dst_port,
    flg AS flags, flg_int AS flags_int, icmp AS icmp_type
  FROM li JOIN tmpl t ON li.h = t.h)"""


PACKET_COLS = ("packet_id, ts_us, src_ip, dst_ip, CAST(protocol AS BIGINT) AS protocol, CAST(length AS BIGINT) AS length, "
               "CAST(ttl AS BIGINT) AS ttl, CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port, "
               "flags, CAST(flags_int AS BIGINT) AS flags_int, CAST(icmp_type AS BIGINT) AS icmp_type")


def rule_sql(i: int, r, source: str) -> str:
    cols = f"packet_id, ts_us, {i} AS ord, src_ip, dst_ip, dst_port, protocol"
    if r.type == "pattern":
        return f"SELECT {cols}, CAST(NULL AS BIGINT) AS cnt FROM {source} WHERE {condition(r.conditions)}"
    if r.type == "rate":
        n = (f"count(*) OVER (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN {r.window_us - 1} PRECEDING AND CURRENT ROW)"
             " - count(*) OVER (PARTITION BY src_ip, ts_us) + row_number() OVER (PARTITION BY src_ip, ts_us ORDER BY packet_id)")
        return (f"SELECT * FROM (SELECT {cols}, {n} AS cnt FROM {source} WHERE {condition(r.conditions)}) "
                f"WHERE cnt >= {r.threshold}")
    n = (f"count(DISTINCT {r.track}) OVER (PARTITION BY src_ip ORDER BY ts_us * {TIES} + tie "
         f"RANGE BETWEEN {(r.window_us - 1) * TIES} + tie PRECEDING AND CURRENT ROW)")
    return (f"SELECT * FROM (SELECT {cols}, {n} AS cnt FROM (SELECT *, row_number() OVER (PARTITION BY src_ip, ts_us "
            f"ORDER BY packet_id) AS tie FROM {source} WHERE {condition(r.conditions)} AND {r.track} IS NOT NULL)) "
            f"WHERE cnt >= {r.threshold}")


def rules_table(rules=RULES) -> str:
    rows = ", ".join("(" + ", ".join(lit(v) for v in (i, r.id, r.name, r.severity, r.type, r.category, r.mitre)) + ")"
                     for i, r in enumerate(rules))
    return f"rules(ord, id, rule, severity, type, category, mitre) AS (VALUES {rows})"


def raw(source: str = "packets", rules=RULES, only=None) -> str:
    picked = [(i, r) for i, r in enumerate(rules) if only is None or only(r)]
    union = "\nUNION ALL\n".join(rule_sql(i, r, source) for i, r in picked)
    return f"""{rules_table(rules)},
hits AS MATERIALIZED ({union}),
raw AS MATERIALIZED (
  SELECT packet_id, ts_us, CAST(h.ord AS BIGINT) AS ord, r.rule, r.id, r.severity, src_ip, dst_ip,
         CAST(dst_port AS BIGINT) AS dst_port, {PROTO} AS protocol, cnt, {RANK} AS rank
  FROM hits h JOIN rules r ON h.ord = r.ord)"""


def alerts(source: str = "packets", ever: bool = False, rules=RULES) -> str:
    """CTEs up to `alerts`, one row per firing packet of `source`."""
    off = "UNBOUNDED" if ever else f"{300_000_000 * TIES} + tie"
    return f"""{raw(source, rules)},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY rank DESC, ord) AS place,
         dense_rank() OVER (PARTITION BY src_ip, ts_us ORDER BY packet_id) AS tie FROM raw),
scored AS (
  SELECT *, count(DISTINCT ord) OVER (PARTITION BY src_ip ORDER BY ts_us * {TIES} + tie
    RANGE BETWEEN {off} PRECEDING AND CURRENT ROW) AS active FROM ranked),
grouped AS (
  SELECT packet_id, max(active) AS active, count(*) AS fired,
         coalesce(string_agg(rule, '|' ORDER BY ord) FILTER (place > 1), '') AS also_triggered
  FROM scored GROUP BY packet_id),
alerts AS MATERIALIZED (
  SELECT s.packet_id, ts_us, s.rule, src_ip, dst_ip, dst_port, protocol, CAST(fired > 1 AS BIGINT) AS correlated,
         also_triggered, cnt AS count, s.id, CAST(least(100, 10 * g.active) AS BIGINT) AS threat_score,
         CASE WHEN least(100, 10 * g.active) >= 80 AND rank < 3 THEN 'CRITICAL'
              WHEN least(100, 10 * g.active) >= 50 AND rank < 2 THEN 'HIGH'
              WHEN least(100, 10 * g.active) >= 30 AND rank < 1 THEN 'MEDIUM' ELSE s.severity END AS severity,
         c.category, c.mitre
  FROM scored s JOIN grouped g ON s.packet_id = g.packet_id AND s.place = 1 JOIN rules c ON s.rule = c.rule)"""


ALERT_COLS = ("packet_id, ts_us, rule, severity, src_ip, dst_ip, dst_port, protocol, correlated, also_triggered, "
              "count, id, threat_score, category")

KEPT = """kept AS MATERIALIZED (SELECT * FROM packets WHERE src_ip NOT IN ('127.0.0.1', '::1', '192.168.1.10')
  AND src_ip NOT LIKE '172.16.5.%')"""


def chain(source: str, keys: list[str], span_us: int, name: str) -> str:
    """Recursive CTE `name(keys, ts_us)` of greedy openers; needs WITH RECURSIVE."""
    k = "".join(f"{x}, " for x in keys)
    ek = "".join(f"c.{x}, " for x in keys)
    on = "".join(f"e.{x} = c.{x} AND " for x in keys)
    group = f"GROUP BY {k[:-2]}" if keys else ""
    return f"""{name}_ev AS MATERIALIZED (SELECT DISTINCT {k}ts_us FROM {source}),
{name} AS (
  SELECT {k}min(ts_us) AS ts_us FROM {name}_ev {group}
  UNION ALL
  SELECT {ek}min(e.ts_us) AS ts_us FROM {name} c JOIN {name}_ev e ON {on}e.ts_us >= c.ts_us + {span_us}
  GROUP BY {ek}c.ts_us)"""


def passed(source: str = "alerts") -> str:
    """CTE `passed`: the alerts of `source` the cooldown lets through."""
    return f"""{chain(source, ["rule", "src_ip"], 30_000_000, "opener")},
passed AS MATERIALIZED (
  SELECT a.* FROM {source} a JOIN (
    SELECT o.rule, o.src_ip, o.ts_us, min(x.packet_id) AS packet_id FROM opener o
    JOIN {source} x ON x.rule = o.rule AND x.src_ip = o.src_ip AND x.ts_us = o.ts_us GROUP BY ALL) w
  ON a.packet_id = w.packet_id)"""


def iso(ts: str) -> str:
    return (f"strftime(make_timestamp(CAST({ts} AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {ts} % 1000000 = 0 THEN '' "
            f"ELSE '.' || lpad(CAST({ts} % 1000000 AS VARCHAR), 6, '0') END || '+00:00'")


def levels(levels_=tuple(reversed(SEVERITIES))) -> str:
    return ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in levels_)


AT = f"CAST(ts_us AS HUGEINT) * 10000000000000000000 + packet_id"
IPNUM = ("CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536 + "
         "CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT)")


def num_ip(n: str) -> str:
    return " || '.' || ".join(f"CAST((({n}) >> {s}) & 255 AS VARCHAR)" for s in (24, 16, 8, 0))


def on_packets(select: str, with_more: bool = False) -> str:
    return f"WITH {packets()}{',' * with_more}\n{select}"


def slices(n: int) -> str:
    """CTE `sliced`: packets with the number of their slice of the time range."""
    width = f"((SELECT max(ts_us) - min(ts_us) FROM packets) // {n} + 1)"
    return f"sliced AS MATERIALIZED (SELECT *, (ts_us - (SELECT min(ts_us) FROM packets)) // {width} AS slice FROM packets)"


def on_raw(select: str, only=None, rules=RULES) -> str:
    return f"WITH {packets()},\n{raw(rules=rules, only=only)}\n{select}"


def on_alerts(select: str, more: dict | None = None, ever: bool = False) -> str:
    extra = "".join(f",\n{name} AS ({body})" for name, body in (more or {}).items())
    return f"WITH {packets()},\n{alerts(ever=ever)}{extra}\n{select}"


# A log in which each alert is followed by a line without severity, of a rule nobody knows.
TWICE = ("SELECT ts_us, rule, severity, src_ip, category FROM alerts "
         "UNION ALL SELECT ts_us, '?' || rule, 'LOW', src_ip, 'Other' FROM alerts")


def on_live(select: str, extra: str = "", kept: str = KEPT) -> str:
    return f"WITH RECURSIVE {packets()},\n{kept},\n{alerts('kept')},\n{passed()}{extra}\n{select}"


def entries(where: str = "") -> str:
    """CTE body of the allowlist entries derived from packets."""
    return f"""SELECT DISTINCT CASE WHEN packet_id % 13 = 0 THEN src_ip WHEN packet_id % 13 = 1 THEN src_ip || '/33'
    WHEN packet_id % 13 = 2 THEN 'x' || src_ip WHEN packet_id % 13 = 3 THEN src_ip || '/255.255.0.0'
    WHEN packet_id % 13 = 4 THEN src_ip || '.9' ELSE src_ip || '/' || CAST(8 + packet_id % 25 AS VARCHAR) END AS entry
  FROM packets {where}"""


def ranges(source: str) -> str:
    """Valid entries of `source(entry)` as (entry, lo, hi, len)."""
    return f"""SELECT entry, n - n % size AS lo, n - n % size + size - 1 AS hi, len FROM (
  SELECT entry, len, {IPNUM.format("base")} AS n, CAST(1 AS BIGINT) << (32 - len) AS size FROM (
    SELECT entry, split_part(entry, '/', 1) AS base,
           CAST(CASE WHEN NOT contains(entry, '/') THEN 32 WHEN entry LIKE '%/255.255.0.0' THEN 16
                     ELSE CAST(split_part(entry, '/', 2) AS BIGINT) END AS BIGINT) AS len FROM {source}
    WHERE entry NOT LIKE 'x%' AND len(string_split(split_part(entry, '/', 1), '.')) = 4) WHERE len <= 32)"""


CUSTOM = None


def custom_rules():
    from queries import CUSTOM_RULES
    from wiretally.rules import as_rules
    return as_rules([{**r, "conditions": {
        k: {{"lt": "<", "gte": ">=", "not": "!="}.get(op, op): v for op, v in c.items()} if isinstance(c, dict) else c
        for k, c in r["conditions"].items()} or {"protocol": {">=": 0}}} for r in CUSTOM_RULES])


GEO = """geo AS (SELECT '10.0.' || CAST(n_nationkey AS VARCHAR) || '.1' AS ip, CAST(n_regionkey AS DOUBLE) AS lon,
  CAST(n_nationkey AS DOUBLE) AS lat, n_name AS country FROM nation)"""
COOL = ", (SELECT count(*) FROM passed) AS logged, count(*) - (SELECT count(*) FROM passed) AS suppressed"
RISK = "CAST(least(100, critical * 20 + high * 8 + least(total * 2, 40)) AS BIGINT)"
NOTIFY = "notify AS MATERIALIZED (SELECT * FROM passed WHERE severity IN ('HIGH', 'CRITICAL'))"


def batched(source: str) -> str:
    return f"""{chain(source, [], 3_000_000, "start")},
batched AS MATERIALIZED (SELECT a.*, s.ts_us AS batch_id FROM {source} a ASOF JOIN (SELECT ts_us FROM start) s ON a.ts_us >= s.ts_us)"""


SUBJECT = f"""CASE WHEN n = 1 THEN severity || ' — ' || rule
  ELSE CAST(n AS VARCHAR) || ' alerts — highest: ' || severity || ' ' || rule END AS subject"""
TOP = f"""tops AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY batch_id) AS n,
  row_number() OVER (PARTITION BY batch_id ORDER BY {RANK} DESC, ts_us, packet_id) AS place FROM batched) WHERE place = 1)"""
ICON = "CASE WHEN severity = 'CRITICAL' THEN ':rotating_light:' ELSE ':warning:' END AS icon"

DIGEST_LINE = """concat_ws(chr(10), 'Severity  : ' || severity,
  '  Rule      : ' || rule, '  Source IP : ' || src_ip, '  Dest IP   : ' || dst_ip,
  '  Dest Port : ' || CAST(dst_port AS VARCHAR), '  Count     : ' || CAST(count AS VARCHAR) || ' packets in window',
  CASE WHEN threat_score <> 0 THEN '  Threat    : ' || CAST(threat_score AS VARCHAR) || '/100' END,
  CASE WHEN also_triggered <> '' THEN '  Also fired: ' || replace(also_triggered, '|', ', ') END) AS line"""


def jstr(c: str) -> str:
    return f"'\"' || {c} || '\"'"


LINE = (f"'{{\"timestamp\":' || {jstr(iso('ts_us'))} || ',\"rule\":' || {jstr('rule')} || ',\"severity\":' || {jstr('severity')} || "
        f"',\"src_ip\":' || {jstr('src_ip')} || ',\"dst_ip\":' || {jstr('dst_ip')} || ',\"dst_port\":' || "
        "coalesce(CAST(dst_port AS VARCHAR), 'null') || "
        f"',\"protocol\":' || {jstr('protocol')} || ',\"correlated\":' || CASE WHEN correlated = 1 THEN 'true' ELSE 'false' END || "
        "',\"also_triggered\":' || CASE WHEN also_triggered = '' THEN '[]' ELSE '[\"' || replace(also_triggered, '|', '\",\"') || '\"]' END || "
        "',\"threat_score\":' || CAST(threat_score AS VARCHAR) || "
        "coalesce(',\"count\":' || CAST(count AS VARCHAR), '') || "
        f"',\"id\":' || {jstr('id')} || '}}'")


def oracle_sql() -> dict[str, str]:
    from queries import PREDICATES

    pct = "round(n * 100.0 / sum(n) OVER (), 4) AS pct, round(n * 1.0 / max(n) OVER (), 4) AS bar"
    sev = "(VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) AS v(severity)"
    ranked_top = ("SELECT {0}, n AS count FROM (SELECT {0}, count(*) AS n, max({1}) AS latest FROM {2} GROUP BY {0}) "
                  "ORDER BY n DESC, latest DESC, {0} LIMIT 10")
    coverage = ("SELECT r.{0}, count(*) AS n_rules, count(*) FILTER (n > 0) AS rules_seen, CAST(coalesce(sum(n), 0) AS BIGINT) AS alerts "
                "FROM rules r LEFT JOIN (SELECT rule, count(*) AS n FROM alerts GROUP BY rule) a ON r.rule = a.rule GROUP BY r.{0}")
    log = (f"SELECT {iso('ts_us')} AS timestamp, rule, severity, src_ip, dst_ip, dst_port, protocol, correlated, also_triggered, "
           f"count, threat_score, category, {iso('ts_us')} || '|' || rule AS id FROM alerts")
    bare = (f"SELECT {iso('ts_us')}, '?' || rule, NULL, src_ip, NULL, NULL, NULL, 0, '', NULL, 0, 'Other', "
            f"{iso('ts_us')} || '|?' || rule FROM alerts")
    total = "count(*) AS total"
    raw_cols = "packet_id, ts_us, ord, rule, id, severity, src_ip, dst_ip, dst_port, protocol, cnt"
    by_track = lambda t: (lambda r: r.track == t)
    pick = lambda only: [r for r in RULES if only(r)]
    distinct = lambda t: on_raw(f"SELECT {raw_cols} FROM raw", rules=pick(by_track(t)))
    half = "(SELECT min(ts_us) + ((max(ts_us) - min(ts_us)) // 2 + 1) FROM packets)"
    canonical = f"SELECT DISTINCT {num_ip('lo')} || '/' || CAST(len AS VARCHAR) AS entry FROM ({{}})"
    spread = "spread AS (SELECT * REPLACE (ts_us * 200 AS ts_us) FROM alerts)"
    return {
        "a1_read_packets": on_packets(f"SELECT {PACKET_COLS} FROM packets, range(3)"),
        "a2_decode_frames": on_packets(f"SELECT {PACKET_COLS} FROM packets"),
        "a3_skipped_frames": on_packets("SELECT count(*) AS total, count(*) FILTER (protocol <> 41) AS ip, "
                                        "count(*) FILTER (protocol = 41) AS skipped FROM packets"),
        "a4_read_alerts": on_alerts(f"{log} UNION ALL {bare}"),
        "a4_log_cooldown": f"WITH RECURSIVE {packets()},\n{alerts()},\n{passed()}\nSELECT ts_us, rule, src_ip FROM passed",
        "a4_rejected_lines": on_alerts(f"SELECT count(*) AS rejected, min('{{bad ' || {LINE}) AS example FROM alerts WHERE packet_id % 2 = 1"),
        "a5_write_alerts": on_alerts(f"SELECT CAST(substr({iso('ts_us')}, 1, 10) AS DATE) AS date, {LINE} AS value FROM alerts"),
        "a6_export_csv": on_alerts(
            f"SELECT a.id, {iso('ts_us')} AS timestamp, severity, rule, category, 'pattern' AS type, protocol, src_ip, "
            "coalesce(country, 'Unknown') AS src_country, dst_ip, CAST(dst_port AS VARCHAR) AS dst_port, CAST(count AS VARCHAR) AS count, "
            "CAST(NULL AS VARCHAR) AS ttl, CAST(NULL AS VARCHAR) AS length, mitre FROM alerts a LEFT JOIN "
            f"(SELECT * FROM ({GEO[8:-1]})) g ON a.src_ip = g.ip"),
        "a7_rule_listing": on_raw("SELECT r.rule AS name, r.severity, r.type, r.category, r.mitre, count(h.packet_id) AS packets "
                                  "FROM rules r LEFT JOIN hits h ON r.ord = h.ord GROUP BY ALL"),
        "a8_allowlist_ranges": on_packets(ranges(f"({entries()})")),
        "a9_allowlist_add": on_packets(
            "SELECT DISTINCT src_ip || '/32' AS entry FROM packets WHERE protocol = 1 UNION "
            + canonical.format(ranges(f"({entries()})"))),
        "a9_allowlist_remove": on_packets(
            "SELECT entry FROM (SELECT 'x10.0.1.1' AS entry UNION " + canonical.format(ranges(f"({entries()})"))
            + ") WHERE entry NOT IN (" + canonical.format(ranges(f"({entries('WHERE protocol = 6')})"))
            + f") AND entry NOT IN (SELECT entry FROM ({entries('WHERE protocol = 6')}))"),
        "a10_packet_stream": on_packets(f"SELECT {PACKET_COLS} FROM packets"),
        **{k: on_packets("SELECT packet_id FROM packets WHERE " + (
            "icmp_type IS NULL" if k == "b1_equality_null" else condition({
                f: {{"gte": ">=", "lte": "<="}.get(op, op): v for op, v in c.items()} if isinstance(c, dict) else c
                for f, c in conditions.items()}))) for k, conditions in PREDICATES.items()},
        "b11_protocol_name": on_packets(f"SELECT packet_id, {PROTO} AS protocol FROM packets"),
        "b12_flag_letters": on_packets("SELECT packet_id, CASE WHEN protocol = 6 THEN concat(" + ", ".join(
            f"CASE WHEN flags_int & {1 << i} <> 0 THEN '{c}' ELSE '' END" for i, c in enumerate("FSRPAUECN"))
            + ") END AS letters FROM packets"),
        "b13_drop_local": on_packets("SELECT packet_id, src_ip FROM packets WHERE src_ip <> '192.168.1.10'"),
        "b14_drop_allowlisted": on_packets(
            "SELECT packet_id, src_ip FROM packets WHERE src_ip NOT LIKE '172.16.5.%' AND src_ip <> '192.168.1.50' AND NOT "
            f"({IPNUM.format('src_ip')} BETWEEN 167773504 AND 167773567) AND NOT "
            f"({IPNUM.format('src_ip')} BETWEEN 167773440 AND 167773503 AND {IPNUM.format('src_ip')} >= 167773504)"),
        "b15_category": on_alerts("SELECT packet_id, CASE WHEN packet_id % 10 = 0 THEN 'renamed' ELSE rule END AS rule, "
                                  "CASE WHEN packet_id % 10 = 0 THEN 'Other' ELSE category END AS category FROM alerts"),
        "b16_enrich": on_alerts(
            f"SELECT packet_id, {iso('ts_us')} || '|' || rule AS id, CASE WHEN packet_id % 3 = 0 THEN 'mine' ELSE category END AS category, "
            "coalesce(country, 'Unknown') AS src_country, 'pattern' AS type, protocol, mitre FROM alerts a LEFT JOIN "
            f"(SELECT * FROM ({GEO[8:-1]})) g ON a.src_ip = g.ip"),
        "b17_ip_literals": on_packets(
            f"SELECT packet_id, ip, CAST(ok AS BIGINT) AS valid, CASE WHEN ok THEN {IPNUM.format('ip')} END AS num FROM (SELECT *, "
            "CAST(split_part(ip, '.', 4) AS BIGINT) <= 255 AS ok FROM (SELECT packet_id, CASE WHEN packet_id % 7 = 0 "
            "THEN src_ip || '9' ELSE src_ip END AS ip FROM packets))"),
        "c1_pattern_alerts": on_raw(f"SELECT {raw_cols} FROM raw", rules=pick(lambda r: r.type == "pattern")),
        "c2_rate_alerts": on_raw(f"SELECT {raw_cols} FROM raw", rules=pick(lambda r: r.type == "rate")),
        "c3_distinct_ports": distinct("dst_port"),
        "c4_distinct_hosts": distinct("dst_ip"),
        "c5_all_rules": on_raw(f"SELECT {raw_cols} FROM raw"),
        "c6_custom_rules": on_raw(f"SELECT {raw_cols} FROM raw", rules=custom_rules()),
        "c7_catalogue_hits": on_raw("SELECT id, rule, severity, count(*) AS alerts, max(cnt) AS peak FROM raw GROUP BY ALL"),
        "d1_leader": on_alerts("SELECT s.packet_id, s.rule, s.severity, dst_ip, dst_port, protocol, s.id FROM scored s WHERE place = 1"),
        "d2_also_triggered": on_alerts("SELECT packet_id, correlated, also_triggered FROM alerts"),
        "d3_leader_count": on_alerts("SELECT packet_id, count FROM alerts"),
        "d4_threat_score": on_alerts("SELECT packet_id, ts_us, src_ip, threat_score FROM alerts"),
        "d5_escalated": on_alerts("SELECT packet_id, rule, severity, threat_score FROM alerts"),
        "d6_capture_score": on_alerts("SELECT packet_id, ts_us, src_ip, threat_score FROM alerts", ever=True),
        "d_offline_alerts": on_alerts(f"SELECT {ALERT_COLS} FROM alerts"),
        "e1_cooldown": on_live(f"SELECT {ALERT_COLS} FROM passed"),
        "e2_suppressed": on_live("SELECT a.rule, a.src_ip, count(p.packet_id) AS passed, count(*) - count(p.packet_id) AS suppressed "
                                 "FROM alerts a LEFT JOIN passed p ON a.packet_id = p.packet_id GROUP BY ALL"),
        "e2_suppressed_total": on_live(f"SELECT count(*) AS alerts{COOL} FROM alerts"),
        "e3_notify": on_live(f"SELECT {ALERT_COLS} FROM passed WHERE severity IN ('HIGH', 'CRITICAL')"),
        "e4_batches": on_live("SELECT packet_id, batch_id FROM batched", f",\n{NOTIFY},\n{batched('notify')}"),
        "e4_batches_undeduplicated": f"WITH RECURSIVE {packets()},\n{alerts()},\n{batched('alerts')}\nSELECT packet_id, batch_id FROM batched",
        "e5_digest": on_live(f"SELECT batch_id, n AS n_alerts, {SUBJECT}, {ICON} FROM tops", f",\n{NOTIFY},\n{batched('notify')},\n{TOP}"),
        "e5_digest_lines": on_live(f"SELECT batch_id, packet_id, {DIGEST_LINE} FROM batched", f",\n{NOTIFY},\n{batched('notify')}"),
        "e6_pending": f"WITH RECURSIVE {packets()},\n{alerts()},\n{batched('alerts')}\nSELECT packet_id, batch_id FROM batched "
                      "QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY ts_us DESC, packet_id DESC) <= 100",
        "e7_icons": f"WITH RECURSIVE {packets()},\n{alerts()},\n{batched('alerts')},\n{TOP}\n"
                    f"SELECT batch_id, n AS n_alerts, {SUBJECT}, {ICON} FROM tops",
        "f1_recent": on_alerts(f"SELECT {ALERT_COLS} FROM alerts ORDER BY ts_us DESC, packet_id DESC LIMIT 500"),
        "f1_recent_filtered": on_alerts(
            f"SELECT {ALERT_COLS} FROM alerts WHERE severity = 'HIGH' AND contains(src_ip, '10.0.') AND contains(lower(rule), 'scan') "
            "AND ts_us > 5000000 ORDER BY ts_us DESC, packet_id DESC LIMIT 100"),
        "f2_totals": on_alerts(f"SELECT {total}, count(*) FILTER (ts_us * 200 < 86400000000) AS today, {levels()} FROM alerts"),
        "f2_log_totals": on_alerts(f"SELECT count(*) AS total, count(*) FILTER (ts_us < 86400000000) AS today, {levels()} FROM logged", {"logged": TWICE}),
        "f3_top_sources": on_alerts(ranked_top.format("src_ip", AT, "alerts")),
        "f4_top_rules": on_alerts(ranked_top.format("rule", AT, "alerts")),
        "f5_investigate": on_alerts(
            f"""SELECT src_ip, total, critical, high, medium, low, {RISK} AS risk_score,
              CASE WHEN {RISK} >= 80 THEN 'CRITICAL' WHEN {RISK} >= 50 THEN 'HIGH' WHEN {RISK} >= 20 THEN 'ELEVATED' ELSE 'LOW' END AS risk_label,
              top_rules, recent, {iso('a')} AS first_seen, {iso('b')} AS last_seen
            FROM (SELECT src_ip, {total}, {levels()}, min(ts_us) AS a, max(ts_us) AS b FROM alerts GROUP BY src_ip)
            JOIN (SELECT src_ip, string_agg(rule || '=' || CAST(n AS VARCHAR), '|' ORDER BY place) AS top_rules FROM (
              SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY n DESC, latest DESC, rule) AS place FROM (
                SELECT src_ip, rule, count(*) AS n, max({AT}) AS latest FROM alerts GROUP BY src_ip, rule)) WHERE place <= 10 GROUP BY src_ip)
              USING (src_ip)
            JOIN (SELECT src_ip, string_agg(CAST(packet_id AS VARCHAR), '|' ORDER BY place) AS recent FROM (
              SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY ts_us DESC, packet_id DESC) AS place FROM alerts)
              WHERE place <= 20 GROUP BY src_ip) USING (src_ip)"""),
        "f5_log_investigation": on_alerts(f"""SELECT src_ip, total, critical, high, medium, low, {RISK} AS risk_score, first_seen, last_seen, top_counts
FROM (SELECT src_ip, count(*) AS total, {levels()}, {iso('min(ts_us)')} AS first_seen, {iso('max(ts_us)')} AS last_seen FROM logged GROUP BY src_ip)
JOIN (SELECT src_ip, string_agg(CAST(n AS VARCHAR), '|' ORDER BY n DESC) AS top_counts FROM (
  SELECT * FROM (SELECT src_ip, rule, count(*) AS n FROM logged GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY n DESC) <= 10)
  GROUP BY src_ip) USING (src_ip)""",
                                          {"logged": TWICE}),
        "f6_risk_score": on_live(
            f"""SELECT *, CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 50 THEN 'HIGH' WHEN risk_score >= 20 THEN 'ELEVATED'
              ELSE 'LOW' END AS risk_label FROM (SELECT *, {RISK} AS risk_score FROM (SELECT src_ip, {total}, {levels()},
              min(ts_us) AS first_us, max(ts_us) AS last_us FROM passed GROUP BY src_ip))"""),
        "f7_risk_label": on_alerts(
            f"""SELECT src_ip, risk_score, CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 50 THEN 'HIGH'
              WHEN risk_score >= 20 THEN 'ELEVATED' ELSE 'LOW' END AS risk_label FROM (SELECT *, {RISK} AS risk_score FROM (
              SELECT src_ip, {total}, {levels()} FROM alerts GROUP BY src_ip))"""),
        "f8_techniques": on_alerts("SELECT src_ip, count(DISTINCT mitre) AS n_techniques, string_agg(DISTINCT mitre, '|' ORDER BY mitre) "
                                   "AS techniques FROM alerts GROUP BY src_ip"),
        "f8_ip_top_rules": on_alerts(
            f"SELECT src_ip, rule, n AS count, position FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY n DESC, latest DESC, rule) "
            f"AS position FROM (SELECT src_ip, rule, count(*) AS n, max({AT}) AS latest FROM alerts GROUP BY src_ip, rule)) WHERE position <= 6"),
        "f9_by_severity": on_alerts(f"SELECT v.severity, count(a.packet_id) AS count FROM {sev} LEFT JOIN alerts a ON a.severity = v.severity GROUP BY v.severity"),
        "f9_by_category": on_alerts("SELECT category, count(*) AS count FROM alerts GROUP BY category"),
        "f9_log_by_severity": on_alerts(f"SELECT v.severity, count(logged.severity) AS count FROM {sev} LEFT JOIN logged ON logged.severity = v.severity GROUP BY ALL", {"logged": TWICE}),
        "f9_log_by_category": on_alerts("SELECT category, count(*) AS count FROM logged GROUP BY category", {"logged": TWICE}),
        "f10_top_rules_first_severity": on_alerts(
            f"SELECT rule, n AS count, severity, category FROM (SELECT rule, category, count(*) AS n, min({AT}) AS first, "
            f"arg_min(severity, {AT}) AS severity FROM alerts GROUP BY rule, category) ORDER BY n DESC, first LIMIT 15"),
        "f11_top_attackers": on_alerts(
            f"SELECT src_ip, n AS count, {NAME.format('r')} AS worst_severity, score, categories, rules FROM (SELECT src_ip, count(*) AS n, "
            f"max({RANK}) AS r, max(threat_score) AS score, min({AT}) AS first, string_agg(DISTINCT category, '|' ORDER BY category) AS categories, "
            "string_agg(DISTINCT rule, '|' ORDER BY rule) AS rules FROM alerts GROUP BY src_ip) ORDER BY r DESC, score DESC, n DESC, first LIMIT 20"),
        "f12_minute_timeline": on_alerts(f"SELECT substr({iso('ts_us')}, 1, 16) AS minute, {levels()} FROM alerts GROUP BY 1"),
        "f13_meta": on_alerts("SELECT count(*) AS total_alerts, strftime(make_timestamp(min(ts_us)), '%Y-%m-%d %H:%M:%S') AS first_ts, "
                              "strftime(make_timestamp(max(ts_us)), '%Y-%m-%d %H:%M:%S') AS last_ts FROM alerts"),
        "f14_drilldown": on_alerts("SELECT packet_id, ts_us, rule, severity FROM alerts WHERE src_ip = '10.0.99.1'"),
        "f14_drilldown_rules": on_alerts("SELECT rule, count(*) AS count FROM alerts WHERE src_ip = '10.0.99.1' GROUP BY rule"),
        "f14_drilldown_severity": on_alerts("SELECT severity, count(*) AS count FROM alerts WHERE src_ip = '10.0.99.1' GROUP BY severity"),
        "f15_capture_overview": on_alerts(
            f"SELECT count(*) AS total_packets, count(*) FILTER (protocol <> 41) AS ip_packets, count(*) FILTER (protocol = 41) AS non_ip_packets, "
            f"{iso('min(ts_us)')} AS capture_start, {iso('max(ts_us)')} AS capture_end, max(ts_us) - min(ts_us) AS duration_us, "
            "(SELECT count(*) FROM alerts) AS alerts, (SELECT count(DISTINCT src_ip) FROM alerts) AS unique_attackers FROM packets"),
        "f16_severity_pct": on_alerts(f"SELECT severity, n AS count, {pct} FROM (SELECT v.severity, count(a.packet_id) AS n FROM {sev} "
                                      "LEFT JOIN alerts a ON a.severity = v.severity GROUP BY v.severity)"),
        "f16_category_pct": on_alerts(f"SELECT category, n AS count, {pct} FROM (SELECT category, count(*) AS n FROM alerts GROUP BY category)"),
        "f17_critical_high": on_alerts(f"SELECT {ALERT_COLS} FROM alerts WHERE severity IN ('CRITICAL', 'HIGH') ORDER BY ts_us, packet_id LIMIT 20"),
        "f18_verdict": on_alerts(
            f"SELECT CASE WHEN critical > 0 THEN 'CRITICAL THREATS DETECTED — ' || CAST(critical AS VARCHAR) || ' critical, ' || CAST(high AS VARCHAR) || ' high alerts' "
            f"WHEN high > 0 THEN 'HIGH-SEVERITY THREATS DETECTED — ' || CAST(high AS VARCHAR) || ' high alerts' WHEN medium > 0 THEN "
            "'MEDIUM-SEVERITY ACTIVITY — ' || CAST(medium AS VARCHAR) || ' medium alerts' ELSE 'LOW-SEVERITY ACTIVITY ONLY — ' || CAST(low AS VARCHAR) "
            f"|| ' low alerts' END AS verdict FROM (SELECT {levels()} FROM alerts)"),
        "f19_protocols": on_packets(
            "SELECT protocol, n AS count, round(n * 100.0 / sum(n) OVER (), 4) AS pct FROM (SELECT CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' "
            "WHEN 1 THEN 'ICMP' ELSE 'Other' END AS protocol, count(*) AS n FROM packets GROUP BY 1)"),
        "f20_hourly": on_alerts(
            "SELECT h.hour, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, "
            "count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM (SELECT range AS hour FROM range(24)) h "
            "LEFT JOIN (SELECT severity, 23 - least((100000000000 - ts_us * 200) // 3600000000, 23) AS hour FROM alerts) a ON a.hour = h.hour GROUP BY h.hour"),
        "f21_attack_map": on_alerts(
            f"SELECT src_ip, lon, lat, country, n AS count, {NAME.format('r')} AS worst_severity, critical FROM (SELECT src_ip, count(*) AS n, "
            f"max({RANK}) AS r, count(*) FILTER (severity = 'CRITICAL') AS critical FROM alerts GROUP BY src_ip) JOIN "
            f"(SELECT * FROM ({GEO[8:-1]})) g ON src_ip = g.ip"),
        "f21_attack_map_totals": on_alerts(
            f"SELECT count(DISTINCT src_ip) AS attackers, count(DISTINCT country) AS countries FROM alerts JOIN (SELECT * FROM ({GEO[8:-1]})) g ON src_ip = g.ip"),
        "f22_rule_hits": on_live("SELECT r.id, r.rule AS name, r.severity, r.category, count(p.packet_id) AS hits FROM rules r "
                                 "LEFT JOIN passed p ON p.rule = r.rule GROUP BY ALL"),
        "f23_mitre_frequency": on_alerts("SELECT mitre, count(*) AS count FROM alerts GROUP BY mitre"),
        "f23_top_ports": on_alerts(ranked_top.format("dst_port", AT, "(SELECT * FROM alerts WHERE dst_port IS NOT NULL)")),
        "f24_coverage_mitre": on_alerts(coverage.format("mitre")),
        "f24_coverage_category": on_alerts(coverage.format("category")),
        "g1_late_packets": on_packets(f"SELECT packet_id, ts_us FROM packets WHERE ts_us < {half}"),
        "g2_stream_alerts": on_live(f"SELECT {ALERT_COLS} FROM passed"),
        "g6_lateness_and_drain": on_alerts(f"SELECT {ALERT_COLS} FROM alerts"),
        "g3_window_state": on_packets(f"""{slices(5)},
marks AS (SELECT r.slice, max(ts_us) // 1000 * 1000 AS mark FROM (SELECT unnest(range(5)) AS slice) r JOIN sliced p ON p.slice <= r.slice GROUP BY r.slice),
counted AS (
  SELECT 0 AS set, 7000000 AS span, src_ip, ts_us FROM packets WHERE length >= 60 AND length < 100 AND coalesce(dst_port NOT IN (80, 443), true)
  UNION ALL SELECT 1, 2000000, src_ip, ts_us FROM packets
  UNION ALL SELECT 2, 3000000, src_ip, ts_us FROM packets WHERE protocol = 17 AND dst_port <> 53)
SELECT slice, CAST(set AS BIGINT) AS set, count(DISTINCT (src_ip, ts_us // 1000000)) AS entries
FROM marks JOIN counted ON ts_us < mark AND (ts_us // 1000000 + 1) * 1000000 + span > mark GROUP BY ALL""".lstrip(), with_more=True),
        "g4_allowlist_refresh": on_live(f"SELECT {ALERT_COLS} FROM passed", kept=f"""{slices(2)},
kept AS MATERIALIZED (SELECT * FROM sliced WHERE src_ip NOT IN ('127.0.0.1', '::1', '192.168.1.10')
  AND CASE slice WHEN 0 THEN src_ip NOT LIKE '10.0.1.%' ELSE src_ip NOT LIKE '10.0.2.%' AND src_ip NOT LIKE '172.16.%' END)"""),
        "g5_log_lines": on_live(f"SELECT substr({iso('ts_us')}, 1, 10) AS date, {LINE} AS value FROM passed"),
        "g5_digests": on_live(f"SELECT batch_id, n AS n_alerts, {SUBJECT}, {ICON} FROM tops", f",\n{NOTIFY},\n{batched('notify')},\n{TOP}"),
        "g7_counters": on_live(f"""SELECT (SELECT count(*) FROM packets) AS captured, CAST(0 AS BIGINT) AS unreadable,
  (SELECT count(*) FROM packets WHERE src_ip = '192.168.1.10') AS own, (SELECT count(*) FROM packets WHERE src_ip LIKE '172.16.5.%') AS allowlisted,
  CAST(0 AS BIGINT) AS late, CAST(0 AS DOUBLE) AS late_pct, count(*) AS alerts{COOL} FROM alerts"""),
    }
