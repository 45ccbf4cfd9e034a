"""Packets derived from the `lineitem` table: one templated attack or benign packet per line item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.schema import literal_table

# Packet templates by `l_partkey % 100`. Columns: protocol, source
# port, destination port (-1 ephemeral, -2 above 60000), flag letters, flag bits,
# ICMP type, length, TTL, source address.
TEMPLATES = [
    (0, 6, -1, -1, 'S', 2, None, 60, 64, '10.0.1.1'),
    (1, 6, -1, -1, 'S', 2, None, 60, 64, '10.0.1.1'),
    (2, 1, None, None, None, 0, 8, 60, 64, '10.0.1.1'),
    (3, 6, -1, 80, '', 0, None, 60, 64, '10.0.1.1'),
    (4, 6, -1, 80, 'FPU', 41, None, 60, 64, '10.0.1.1'),
    (5, 6, -1, 80, 'F', 1, None, 60, 64, '10.0.1.1'),
    (6, 6, -1, -1, 'FA', 17, None, 60, 64, '10.0.1.1'),
    (7, 6, -1, -1, 'A', 16, None, 60, 64, '10.0.1.1'),
    (8, 1, None, None, None, 0, 8, 60, 64, '10.0.1.1'),
    (9, 17, -1, -1, None, 0, None, 60, 64, '10.0.1.1'),
    (10, 6, -1, 80, 'SR', 6, None, 60, 64, '10.0.1.1'),
    (11, 6, -1, 80, 'FS', 3, None, 60, 64, '10.0.1.1'),
    (12, 1, None, None, None, 0, 8, 1100, 64, '10.0.1.1'),
    (13, 6, -1, 80, 'S', 2, None, 60, 2, '10.0.1.1'),
    (14, 1, None, None, None, 0, 5, 60, 64, '10.0.1.1'),
    (15, 6, -1, 80, 'S', 2, None, 140, 64, '10.0.1.1'),
    (16, 6, -1, 22, 'S', 2, None, 60, 64, '10.0.2.1'),
    (17, 6, -1, 3389, 'S', 2, None, 60, 64, '10.0.2.1'),
    (18, 6, -1, 21, 'S', 2, None, 60, 64, '10.0.2.1'),
    (19, 6, -1, 23, 'S', 2, None, 60, 64, '10.0.2.1'),
    (20, 6, -1, 587, 'S', 2, None, 60, 64, '10.0.2.1'),
    (21, 6, -1, 143, 'S', 2, None, 60, 64, '10.0.2.1'),
    (22, 6, -1, 110, 'S', 2, None, 60, 64, '10.0.2.1'),
    (23, 6, -1, 5900, 'S', 2, None, 60, 64, '10.0.2.1'),
    (24, 6, -1, 3306, 'S', 2, None, 60, 64, '10.0.2.1'),
    (25, 6, -1, 5432, 'S', 2, None, 60, 64, '10.0.2.1'),
    (26, 6, -1, 1433, 'S', 2, None, 60, 64, '10.0.2.1'),
    (27, 6, -1, 88, 'PA', 24, None, 60, 64, '10.0.2.1'),
    (28, 6, -1, -1, 'S', 2, None, 60, 64, '10.0.3.1'),
    (29, 1, None, None, None, 0, 8, 60, 64, '10.0.3.1'),
    (30, 17, -1, -1, None, 0, None, 60, 64, '10.0.3.1'),
    (31, 6, -1, -1, 'R', 4, None, 60, 64, '10.0.3.1'),
    (32, 6, -1, -1, 'A', 16, None, 60, 64, '10.0.3.1'),
    (33, 6, -1, 23, 'S', 2, None, 60, 64, '10.0.4.1'),
    (34, 6, -1, 512, 'PA', 24, None, 60, 64, '10.0.4.1'),
    (35, 17, -1, 69, None, 0, None, 60, 64, '10.0.4.1'),
    (36, 17, -1, 5355, None, 0, None, 60, 64, '10.0.4.1'),
    (37, 6, -1, 4444, 'PA', 24, None, 60, 64, '10.0.5.1'),
    (38, 6, -1, -2, 'S', 2, None, 60, 64, '10.0.5.1'),
    (39, 6, -1, 6660, 'PA', 24, None, 60, 64, '10.0.5.1'),
    (40, 6, -1, 9050, 'PA', 24, None, 60, 64, '10.0.5.1'),
    (41, 17, -1, 8053, None, 0, None, 60, 64, '10.0.5.1'),
    (42, 6, -1, 50050, 'PA', 24, None, 60, 64, '10.0.5.1'),
    (43, 6, -1, 4242, 'PA', 24, None, 60, 64, '10.0.5.1'),
    (44, 6, -1, -1, 'S', 2, None, 60, 64, '10.0.5.1'),
    (45, 6, -1, 445, 'S', 2, None, 60, 64, '10.0.6.1'),
    (46, 6, -1, 5985, 'PA', 24, None, 60, 64, '10.0.6.1'),
    (47, 6, -1, 6379, 'S', 2, None, 60, 64, '10.0.7.1'),
    (48, 6, -1, 9200, 'S', 2, None, 60, 64, '10.0.7.1'),
    (49, 6, -1, 27017, 'S', 2, None, 60, 64, '10.0.7.1'),
    (50, 6, -1, 2375, 'S', 2, None, 60, 64, '10.0.7.1'),
    (51, 6, -1, 6443, 'S', 2, None, 60, 64, '10.0.7.1'),
    (52, 6, -1, 2379, 'S', 2, None, 60, 64, '10.0.7.1'),
    (53, 17, -1, 11211, None, 0, None, 60, 64, '10.0.7.1'),
    (54, 6, -1, 5984, 'S', 2, None, 60, 64, '10.0.7.1'),
    (55, 6, -1, 50070, 'S', 2, None, 60, 64, '10.0.7.1'),
    (56, 17, -1, 53, None, 0, None, 60, 64, '10.0.8.1'),
    (57, 6, -1, 53, 'PA', 24, None, 60, 64, '10.0.8.1'),
    (58, 1, None, None, None, 0, 8, 60, 64, '10.0.8.1'),
    (59, 6, 20, -1, 'PA', 24, None, 60, 64, '10.0.8.1'),
    (60, 17, 53, -1, None, 0, None, 60, 64, '10.0.9.1'),
    (61, 17, 123, -1, None, 0, None, 60, 64, '10.0.9.1'),
    (62, 6, -1, 179, 'PA', 24, None, 60, 64, '10.0.9.1'),
    (63, 89, None, None, None, 0, None, 60, 64, '10.0.9.1'),
    (64, 88, None, None, None, 0, None, 60, 64, '10.0.9.1'),
    (65, 47, None, None, None, 0, None, 60, 64, '10.0.9.1'),
    (66, 41, None, None, None, 0, None, 60, 64, '10.0.9.1'),
    (67, 6, -1, 502, 'PA', 24, None, 60, 64, '10.0.10.1'),
    (68, 6, -1, 20000, 'PA', 24, None, 60, 64, '10.0.10.1'),
    (69, 6, -1, 44818, 'PA', 24, None, 60, 64, '10.0.10.1'),
    (70, 17, -1, 47808, None, 0, None, 60, 64, '10.0.10.1'),
    (71, 6, -1, 3128, 'PA', 24, None, 60, 64, '10.0.11.1'),
    (72, 6, -1, 6881, 'PA', 24, None, 60, 64, '10.0.11.1'),
    (73, 6, -1, 3333, 'PA', 24, None, 60, 64, '10.0.11.1'),
    (74, 6, -1, 80, 'S', 2, None, 60, 64, '10.0.3.1'),
    (75, 6, -1, 80, 'S', 2, None, 60, 64, '10.0.3.1'),
    (76, 6, -1, 80, 'S', 2, None, 60, 64, '10.0.3.1'),
    (77, 6, -1, 80, 'S', 2, None, 60, 64, '10.0.3.1'),
    (78, 17, 53, -1, None, 0, None, 512, 64, '10.0.9.2'),
    (79, 17, 53, -1, None, 0, None, 512, 64, '10.0.9.2'),
    (80, 17, 53, -1, None, 0, None, 512, 64, '10.0.9.2'),
    (81, 17, 53, -1, None, 0, None, 512, 64, '10.0.9.2'),
    (82, 17, 53, -1, None, 0, None, 512, 64, '10.0.9.2'),
    (83, 17, -1, 80, None, 0, None, 512, 64, '10.0.9.2'),
    (84, 17, -1, 80, None, 0, None, 512, 64, '10.0.9.2'),
    (85, 17, -1, 80, None, 0, None, 512, 64, '10.0.9.2'),
    (86, 17, -1, 80, None, 0, None, 512, 64, '10.0.9.2'),
    (87, 6, -1, 80, 'A', 16, None, 60, 64, '10.0.3.2'),
    (88, 6, -1, 80, 'A', 16, None, 60, 64, '10.0.3.2'),
    (89, 6, -1, 80, 'A', 16, None, 60, 64, '10.0.3.2'),
    (90, 6, -1, 80, 'A', 16, None, 60, 64, '10.0.3.2'),
    (91, 6, -1, 80, 'A', 16, None, 60, 64, '10.0.3.2'),
    (92, 17, 123, -1, None, 0, None, 468, 64, '10.0.9.3'),
    (93, 17, 123, -1, None, 0, None, 468, 64, '10.0.9.3'),
    (94, 6, -1, 80, 'R', 4, None, 60, 64, '10.0.3.1'),
    (95, 1, None, None, None, 0, 8, 84, 64, '10.0.3.1'),
    (96, 6, -1, 443, 'PA', 24, None, 900, 64, '192.168.1.50'),
    (97, 6, -1, 443, 'PA', 24, None, 900, 64, '192.168.1.50'),
    (98, 6, -1, -1, 'S', 2, None, 60, 64, '192.168.1.10'),
    (99, 6, -1, -1, 'S', 2, None, 60, 64, '172.16.5.9'),
]

_TEMPLATE_SCHEMA = ("h int, proto int, sport int, dport int, flg string, flg_int int, icmp int, "
                    "len int, ttl int, src string")


def packets_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with the `schema.PACKETS` columns. A fifth of the orders form a second
    burst 400 s later; 10.0.99.1 acts out every stage."""
    return to_packets(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def to_packets(lineitem: DataFrame) -> DataFrame:
    # packet_id, time and template depend on these four keys only, so removing
    # duplicate line items on them shuffles four numbers per row, not the packet.
    li = lineitem.select(*[F.col(c).cast("bigint").alias(c) for c in
                           ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).distinct()
    return packet_columns(li)


def packet_columns(li: DataFrame) -> DataFrame:
    ok, ln, pk, sk = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    k = ok * 7 + ln
    late = F.when(ok % 5 == 0, 400_000_000).otherwise(0)
    tmpl = F.broadcast(literal_table(li.sparkSession, TEMPLATES, _TEMPLATE_SCHEMA))  # 100 rows
    return li.join(tmpl, (pk % 100).cast("int") == F.col("h")).select(
        (((ok * 10 + ln) * 100000 + pk) * 10000 + sk).alias("packet_id"),
        (ok * 2500 + ln * 1000 + late).alias("ts_us"),
        F.when((F.col("h") < 74) & (sk % 10 == 0), "10.0.99.1").otherwise(F.col("src")).alias("src_ip"),
        F.when(F.col("h") == 2, F.concat(F.lit("192.168.1."), (k % 250).cast("string")))
         .otherwise("192.168.1.20").alias("dst_ip"),
        F.col("proto").alias("protocol"), F.col("len").alias("length"), "ttl",
        F.when(F.col("sport") == -1, 1024 + k % 60000).otherwise(F.col("sport")).cast("int").alias("src_port"),
        F.when(F.col("dport") == -1, 1024 + k % 50000).when(F.col("dport") == -2, 60001 + k % 5000)
         .otherwise(F.col("dport")).cast("int").alias("dst_port"),
        F.col("flg").alias("flags"), F.col("flg_int").alias("flags_int"), F.col("icmp").alias("icmp_type"))
