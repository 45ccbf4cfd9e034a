"""Filters and lookups that use small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.functions.net import ip_to_num
from wiretally.rules import RULES, as_rules, rules_df
from wiretally.schema import iso, literal_table

LOOPBACK = ("127.0.0.1", "::1")
BROADCAST_ROWS = 100_000

# Map positions of addresses the dashboards know.
GEO = [
    ("185.220.101.47", 4.9, 52.4, "Netherlands"),
    ("91.240.118.172", 37.6, 55.7, "Russia"),
    ("45.33.32.156", -97.0, 38.0, "USA"),
    ("192.168.1.104", -77.0, 38.9, "Internal"),
    ("198.54.117.212", -74.0, 40.7, "USA"),
    ("103.21.244.0", 103.8, 1.3, "Singapore"),
    ("176.58.100.98", -0.1, 51.5, "UK"),
    ("10.0.0.45", -77.0, 38.9, "Internal"),
    ("185.130.5.231", 10.5, 51.2, "Germany"),
    ("62.210.16.61", 2.3, 48.9, "France"),
    ("172.67.189.12", -118.0, 34.0, "USA (CDN)"),
    ("95.216.100.76", 25.7, 60.2, "Finland"),
    ("46.101.64.73", 4.9, 52.4, "Netherlands"),
    ("89.34.111.240", 32.8, 39.9, "Turkey"),
    ("178.62.52.19", -0.1, 51.5, "UK"),
    ("167.99.11.204", -73.9, 40.7, "USA"),
    ("139.59.50.216", 77.2, 28.6, "India"),
    ("118.25.6.39", 121.5, 31.2, "China"),
    ("212.227.25.5", 13.4, 52.5, "Germany"),
]


def geo_df(spark: SparkSession) -> DataFrame:
    return literal_table(spark, GEO, "ip string, lon double, lat double, country string")


def drop_local(packets: DataFrame, ips=()) -> DataFrame:
    """Drop the sensor's own traffic; loopback always, empty addresses ignored."""
    return packets.filter(~F.col("src_ip").isin(sorted({*LOOPBACK, *filter(None, ips)})))


def drop_allowlisted(packets: DataFrame, allow: DataFrame) -> DataFrame:
    """Drop packets whose source lies in a network of `allow(lo, hi, len)`.

    Addresses are looked up by prefix: one equality anti join per prefix length in use,
    at most 33 whatever the number of networks. A source that is no IPv4 address stays.
    """
    nets = allow.select("lo", "len").distinct()
    lengths = {r["len"]: r["n"] for r in nets.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = packets.withColumn("_n", ip_to_num("src_ip"))
    for length in sorted(lengths):
        side = nets.filter(F.col("len") == length).selectExpr(f"shiftright(lo, {32 - length}) AS _net")
        if lengths[length] <= BROADCAST_ROWS:
            side = F.broadcast(side)
        out = out.join(side, F.expr(f"shiftright(_n, {32 - length}) = _net"), "left_anti")
    return out.drop("_n")


def rules_dim(spark: SparkSession, rules=None) -> DataFrame:
    return F.broadcast(rules_df(spark, rules))  # one row per rule of a Python list


def _dim(spark: SparkSession, rules, attribute: str) -> DataFrame:
    """(rule, _v): one attribute of each rule of a Python list."""
    rows = [(r.name, getattr(r, attribute)) for r in as_rules(RULES if rules is None else rules)]
    return F.broadcast(literal_table(spark, rows, "rule string, _v string"))


def with_category(df: DataFrame, rules=None) -> DataFrame:
    """Set `category` from the rule name, `Other` for an unknown rule."""
    have = [c for c in df.columns if c != "category"]
    return (df.join(_dim(df.sparkSession, rules, "category"), "rule", "left")
            .selectExpr(*have, "coalesce(_v, 'Other') AS category"))


def with_mitre(df: DataFrame, rules=None) -> DataFrame:
    have = [c for c in df.columns if c != "mitre"]
    return df.join(_dim(df.sparkSession, rules, "mitre"), "rule", "left").selectExpr(*have, "_v AS mitre")


def enrich(alerts: DataFrame, geo: DataFrame | None = None, rules=None) -> DataFrame:
    """Fill id, category, src_country, type, protocol and mitre where missing or empty."""
    spark = alerts.sparkSession
    geo = geo_df(spark) if geo is None else geo
    have = set(alerts.columns)

    def given(name):
        return F.nullif(F.col(name).cast("string"), F.lit("")) if name in have else F.lit(None).cast("string")

    stamp = F.col("timestamp") if "timestamp" in have else iso()
    dim = rules_dim(spark, RULES if rules is None else rules).select(
        F.col("name").alias("rule"), F.col("category").alias("_c"), F.col("mitre").alias("_m"))
    places = geo.select(F.col("ip").alias("src_ip"), F.col("country").alias("_g"))
    return (alerts.join(dim, "rule", "left").join(places, "src_ip", "left")
            .withColumns({
                "id": F.coalesce(given("id"), F.concat(stamp, F.lit("|"), F.col("rule"))),
                "category": F.coalesce(given("category"), "_c", F.lit("Other")),
                "src_country": F.coalesce(given("src_country"), F.nullif("_g", F.lit("")), F.lit("Unknown")),
                "type": F.coalesce(given("type"), F.lit("pattern")),
                "protocol": F.coalesce(given("protocol"), F.lit("TCP")),
                "mitre": F.coalesce(given("mitre"), "_m"),
            }).drop("_c", "_m", "_g"))
