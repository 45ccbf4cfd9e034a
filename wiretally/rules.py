"""Detection rules: the built-in catalogue and validation of user-supplied rules."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

LOW, MEDIUM, HIGH, CRITICAL = "LOW", "MEDIUM", "HIGH", "CRITICAL"
SEVERITIES = [LOW, MEDIUM, HIGH, CRITICAL]  # position = rank
KINDS = ("pattern", "rate", "multi_destination")


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    type: str
    severity: str
    mitre: str | None
    category: str
    conditions: dict[str, Any] = field(default_factory=dict)
    threshold: int | None = None
    window_s: int | None = None
    track: str | None = None

    @property
    def rank(self) -> int:
        return SEVERITIES.index(self.severity)

    @property
    def window_us(self) -> int:
        return self.window_s * 1_000_000


def _pattern(rid, name, severity, mitre, category, **conditions) -> Rule:
    return Rule(rid, name, "pattern", severity, mitre, category, conditions)


def _rate(rid, name, severity, mitre, category, threshold, window_s, **conditions) -> Rule:
    return Rule(rid, name, "rate", severity, mitre, category, conditions, threshold, window_s)


def _distinct(rid, name, severity, mitre, category, threshold, window_s, track, **conditions) -> Rule:
    return Rule(rid, name, "multi_destination", severity, mitre, category, conditions,
                threshold, window_s, track)


# The signature catalogue (ids, names, techniques, categories,
# thresholds, window seconds and conditions). List position breaks severity ties.
RULES: list[Rule] = [
    # Reconnaissance
    _rate("R001", "Port Scan (SYN)", HIGH, "T1046", "Reconnaissance", 100, 10, flags="S", protocol=6),
    _distinct("R002", "Port Scan (Distinct Ports)", HIGH, "T1046", "Reconnaissance", 25, 30, "dst_port", protocol=6, flags="S"),
    _distinct("R003", "Host Discovery Sweep (Distinct IPs)", HIGH, "T1018", "Reconnaissance", 20, 30, "dst_ip", protocol=[6, 1]),
    _pattern("R004", "Null Scan", HIGH, "T1046", "Reconnaissance", protocol=6, flags_int=0),
    _pattern("R005", "XMAS Scan", HIGH, "T1046", "Reconnaissance", protocol=6, flags="FPU"),
    _pattern("R006", "FIN Scan", MEDIUM, "T1046", "Reconnaissance", protocol=6, flags="F"),
    _distinct("R007", "Maimon Scan", MEDIUM, "T1046", "Reconnaissance", 20, 30, "dst_port", protocol=6, flags="FA"),
    _distinct("R008", "ACK Scan", MEDIUM, "T1046", "Reconnaissance", 30, 30, "dst_port", protocol=6, flags="A"),
    _rate("R009", "ICMP Host Sweep (Ping Sweep)", MEDIUM, "T1018", "Reconnaissance", 20, 10, protocol=1, icmp_type=8),
    _rate("R010", "UDP Port Scan", MEDIUM, "T1046", "Reconnaissance", 500, 10, protocol=17),
    _pattern("R011", "Invalid TCP Flags: SYN+RST", MEDIUM, "T1046", "Reconnaissance", protocol=6, flags_int={"mask": 6}),
    _pattern("R012", "Invalid TCP Flags: SYN+FIN", MEDIUM, "T1046", "Reconnaissance", protocol=6, flags_int={"mask": 3}),
    _pattern("R013", "Oversized ICMP Packet", MEDIUM, "T1498.001", "Reconnaissance", protocol=1, icmp_type=8, length={">": 1000}),
    _pattern("R014", "Low TTL Probe (Traceroute / Evasion)", LOW, "T1040", "Reconnaissance", ttl={"<=": 4, ">": 0}),
    _pattern("R015", "ICMP Redirect (Routing Manipulation)", HIGH, "T1565", "Infrastructure Attack", protocol=1, icmp_type=5),
    _pattern("R016", "TCP SYN with Large Payload", MEDIUM, "T1499.002", "Reconnaissance", protocol=6, flags="S", length={">": 80}),
    # Brute force
    _rate("R017", "SSH Brute Force", CRITICAL, "T1110.001", "Brute Force", 10, 60, dst_port=22, protocol=6, flags="S"),
    _rate("R018", "RDP Brute Force", CRITICAL, "T1110.001", "Brute Force", 10, 60, dst_port=3389, protocol=6, flags="S"),
    _rate("R019", "FTP Brute Force", HIGH, "T1110.001", "Brute Force", 10, 60, dst_port=21, protocol=6, flags="S"),
    _rate("R020", "Telnet Brute Force", HIGH, "T1110.001", "Brute Force", 5, 30, dst_port=23, protocol=6, flags="S"),
    _rate("R021", "SMTP Auth Brute Force", HIGH, "T1110.003", "Brute Force", 10, 60, dst_port=[587, 465], protocol=6, flags="S"),
    _rate("R022", "IMAP Brute Force", HIGH, "T1110.001", "Brute Force", 10, 60, dst_port=[143, 993], protocol=6, flags="S"),
    _rate("R023", "POP3 Brute Force", HIGH, "T1110.001", "Brute Force", 10, 60, dst_port=[110, 995], protocol=6, flags="S"),
    _rate("R024", "VNC Brute Force", CRITICAL, "T1110.001", "Brute Force", 10, 60, dst_port=5900, protocol=6, flags="S"),
    _rate("R025", "MySQL Brute Force", CRITICAL, "T1110.001", "Brute Force", 5, 30, dst_port=3306, protocol=6, flags="S"),
    _rate("R026", "PostgreSQL Brute Force", CRITICAL, "T1110.001", "Brute Force", 5, 30, dst_port=5432, protocol=6, flags="S"),
    _rate("R027", "MSSQL Brute Force", CRITICAL, "T1110.001", "Brute Force", 5, 30, dst_port=1433, protocol=6, flags="S"),
    _rate("R028", "Kerberos Brute Force (AS-REP Roasting / Password Spray)", CRITICAL, "T1558.003", "Brute Force", 20, 30, dst_port=88, protocol=[6, 17]),
    # Denial of service
    _rate("R029", "SYN Flood", CRITICAL, "T1498.001", "Denial of Service", 200, 5, flags="S", protocol=6),
    _rate("R030", "ICMP Flood", HIGH, "T1498.001", "Denial of Service", 100, 10, protocol=1, icmp_type=8),
    _rate("R031", "UDP Flood", HIGH, "T1498.001", "Denial of Service", 1000, 10, protocol=17),
    _rate("R032", "RST Flood", HIGH, "T1499", "Denial of Service", 100, 10, flags="R", protocol=6),
    _rate("R033", "ACK Flood", HIGH, "T1498.001", "Denial of Service", 500, 10, flags="A", protocol=6),
    # Suspicious services
    _pattern("R034", "Telnet Attempt", MEDIUM, "T1078", "Suspicious Services", dst_port=23, protocol=6, flags="S"),
    _pattern("R035", "rlogin / rsh Attempt", HIGH, "T1021", "Suspicious Services", dst_port=[512, 513, 514], protocol=6),
    _pattern("R036", "TFTP Access", MEDIUM, "T1105", "Suspicious Services", dst_port=69, protocol=17),
    _pattern("R037", "LLMNR Traffic (Possible Responder / MITM)", LOW, "T1557.001", "Suspicious Services", dst_port=5355, protocol=17),
    # Malware and command-and-control
    _pattern("R038", "Known C2 / Backdoor Port", CRITICAL, "T1571", "Malware & C2", dst_port=[4444, 1337, 31337, 6666, 6667, 1234, 12345, 54321]),
    _distinct("R039", "Possible Reverse Shell (High Outbound Port)", HIGH, "T1059", "Malware & C2", 5, 60, "dst_port", dst_port={">": 60000}, protocol=6, flags="S"),
    _pattern("R040", "IRC Traffic (Possible Botnet C2)", MEDIUM, "T1571", "Malware & C2", dst_port=[6660, 6661, 6662, 6663, 6664, 6665, 6668, 6669, 7000], protocol=6),
    _pattern("R041", "Tor Default Port", MEDIUM, "T1090.003", "Malware & C2", dst_port=[9050, 9150, 9051], protocol=6),
    _pattern("R042", "DNS over Non-Standard Port (Possible DNS Tunneling)", MEDIUM, "T1071.004", "Malware & C2", dst_port=[8053, 8853], protocol=[6, 17]),
    _pattern("R043", "Cobalt Strike Default Beacon Port", CRITICAL, "T1105", "Malware & C2", dst_port=50050, protocol=6),
    _pattern("R044", "Netcat / Bind Shell Default Port", HIGH, "T1059", "Malware & C2", dst_port=4242, protocol=6),
    _rate("R045", "Aggressive Outbound SYN Rate (Worm / Scanner)", MEDIUM, "T1595", "Malware & C2", 300, 60, flags="S", protocol=6),
    # Lateral movement
    _rate("R046", "SMB Sweep (Ransomware Propagation)", CRITICAL, "T1570", "Lateral Movement", 10, 10, dst_port=445, protocol=6, flags="S"),
    _pattern("R047", "WinRM Access (Possible Lateral Movement)", MEDIUM, "T1021.006", "Lateral Movement", dst_port=[5985, 5986], protocol=6),
    # Exposed services
    _rate("R048", "Redis Exposed (No Auth)", CRITICAL, "T1190", "Exposed Services", 3, 60, dst_port=6379, protocol=6, flags="S"),
    _rate("R049", "Elasticsearch Exposed", CRITICAL, "T1190", "Exposed Services", 3, 60, dst_port=[9200, 9300], protocol=6, flags="S"),
    _rate("R050", "MongoDB Exposed", CRITICAL, "T1190", "Exposed Services", 3, 60, dst_port=27017, protocol=6, flags="S"),
    _rate("R051", "Docker API Exposed", CRITICAL, "T1610", "Exposed Services", 3, 60, dst_port=[2375, 2376], protocol=6, flags="S"),
    _rate("R052", "Kubernetes API Exposed", CRITICAL, "T1610", "Exposed Services", 3, 60, dst_port=[6443, 8001], protocol=6, flags="S"),
    _rate("R053", "etcd Exposed", CRITICAL, "T1552.007", "Exposed Services", 3, 60, dst_port=[2379, 2380], protocol=6, flags="S"),
    _rate("R054", "Memcached Exposed (DDoS Amplification)", HIGH, "T1498.002", "Exposed Services", 3, 60, dst_port=11211, protocol=17),
    _rate("R055", "CouchDB Exposed", HIGH, "T1190", "Exposed Services", 3, 60, dst_port=5984, protocol=6, flags="S"),
    _rate("R056", "Hadoop / HDFS Exposed", HIGH, "T1190", "Exposed Services", 3, 60, dst_port=[50070, 8088], protocol=6, flags="S"),
    # Exfiltration
    _rate("R057", "DNS Query Flood UDP (Possible DNS Tunneling)", HIGH, "T1048.001", "Exfiltration", 200, 60, dst_port=53, protocol=17),
    _rate("R058", "DNS Query Flood TCP (Possible DNS Tunneling)", MEDIUM, "T1048.001", "Exfiltration", 100, 60, dst_port=53, protocol=6),
    _rate("R059", "ICMP Exfiltration (Large Volume)", MEDIUM, "T1048.003", "Exfiltration", 50, 60, protocol=1, icmp_type=8),
    _pattern("R060", "FTP Data Channel (Possible Exfiltration)", LOW, "T1048", "Exfiltration", src_port=20, protocol=6),
    # Infrastructure attacks
    _rate("R061", "DNS Amplification Attack", CRITICAL, "T1498.002", "Infrastructure Attack", 500, 10, src_port=53, protocol=17),
    _rate("R062", "NTP Amplification Attack", CRITICAL, "T1498.002", "Infrastructure Attack", 200, 10, src_port=123, protocol=17),
    _pattern("R063", "BGP Connection Attempt", HIGH, "T1557", "Infrastructure Attack", dst_port=179, protocol=6),
    _pattern("R064", "OSPF Injection", HIGH, "T1565", "Infrastructure Attack", protocol=89),
    _pattern("R065", "EIGRP Traffic", HIGH, "T1565", "Infrastructure Attack", protocol=88),
    _pattern("R066", "GRE Tunnel Traffic", MEDIUM, "T1572", "Infrastructure Attack", protocol=47),
    _pattern("R067", "IPv6-in-IPv4 Tunnel", MEDIUM, "T1572", "Infrastructure Attack", protocol=41),
    # Industrial control
    _pattern("R068", "Modbus Access (ICS Protocol)", HIGH, "T0855", "ICS / SCADA", dst_port=502, protocol=6),
    _pattern("R069", "DNP3 Access (ICS Protocol)", HIGH, "T0855", "ICS / SCADA", dst_port=20000, protocol=[6, 17]),
    _pattern("R070", "EtherNet/IP Access (ICS Protocol)", HIGH, "T0855", "ICS / SCADA", dst_port=44818, protocol=[6, 17]),
    _pattern("R071", "BACnet Access (Building Automation)", MEDIUM, "T0855", "ICS / SCADA", dst_port=47808, protocol=17),
    # Policy
    _pattern("R072", "Proxy / Anonymizer Port", LOW, "T1090", "Policy Violation", dst_port=[3128, 1080, 8118], protocol=6),
    _pattern("R073", "P2P / BitTorrent Port", LOW, "T1048", "Policy Violation", dst_port=[6881, 6882, 6883, 6884, 6885, 6886, 6887, 6888, 6889], protocol=[6, 17]),
    _pattern("R074", "Cryptocurrency Mining Pool", HIGH, "T1496", "Policy Violation", dst_port=[3333, 3334, 3335, 14444, 45700], protocol=6),
]

_CATEGORY = {r.name: r.category for r in RULES}


def as_rules(rules) -> list[Rule]:
    """Accept `Rule` objects or plain dicts and return a validated list."""
    out = []
    for r in rules:
        if isinstance(r, dict):
            r = Rule(
                id=r.get("id"), name=r["name"], type=r["type"], severity=r["severity"],
                mitre=r.get("mitre"), category=r.get("category") or _CATEGORY.get(r["name"], "Other"),
                conditions=dict(r["conditions"]), threshold=r.get("threshold"),
                window_s=r.get("window_seconds", r.get("window_s")), track=r.get("track"),
            )
        out.append(r)
    names = set()
    for r in out:
        if r.type not in KINDS:
            raise ValueError(f"{r.name}: unknown rule type {r.type!r}")
        if r.severity not in SEVERITIES:
            raise ValueError(f"{r.name}: unknown severity {r.severity!r}")
        if r.name in names:
            raise ValueError(f"duplicate rule name {r.name!r}: window state is keyed by name")
        names.add(r.name)
        if r.type != "pattern" and not (r.threshold and r.window_s and r.threshold > 0 and r.window_s > 0):
            raise ValueError(f"{r.name}: needs a positive threshold and window")
        if r.type == "multi_destination" and r.track not in ("dst_port", "dst_ip"):
            raise ValueError(f"{r.name}: track must be dst_port or dst_ip")
    return out


def rules_df(spark: SparkSession, rules=None) -> DataFrame:
    """The rule dimension, one row per rule in list order."""
    rows = [(i, r.id, r.name, r.severity, r.type, r.category, r.mitre, r.track, r.threshold, r.window_s)
            for i, r in enumerate(as_rules(RULES if rules is None else rules))]
    from wiretally.schema import literal_table
    return literal_table(
        spark, rows, "ord int, id string, name string, severity string, type string, category string, "
              "mitre string, track string, threshold int, window_s int")
