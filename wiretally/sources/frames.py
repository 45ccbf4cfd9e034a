"""Raw frames to packet rows, in Column arithmetic over the header bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.functions.net import flag_letters, num_ip


def _number(offset: str, n: int) -> str:
    """SQL text: big-endian unsigned integer of n bytes of `raw` at a zero-based offset."""
    return f"CAST(conv(hex(substring(raw, {offset} + 1, {n})), 16, 10) AS BIGINT)"


_IS_IP = f"""coalesce(octet_length(raw) >= link_offset + 20 AND shiftright({_number('link_offset', 1)}, 4) = 4
    AND (link_offset < 14 OR {_number('link_offset - 2', 2)} = 2048), false)"""


def split_frames(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(IPv4 frames, skipped frames) of `frames(ts_us, packet_id, raw, link_offset)`."""
    return frames.filter(_IS_IP), frames.filter(f"NOT ({_IS_IP})")


def frame_counts(frames: DataFrame) -> DataFrame:
    """One row: total, IPv4 and skipped frames."""
    ip = F.expr(_IS_IP)
    return frames.agg(F.count(F.lit(1)).alias("total"), F.count_if(ip).alias("ip"), F.count_if(~ip).alias("skipped"))


def decode_frames(frames: DataFrame) -> DataFrame:
    """Packet rows of the IPv4 frames; others are skipped (see `frame_counts`).

    `link_offset` is where the IP header starts: 0 for raw IP, 14 for Ethernet. A
    transport header that is absent, cut off or belongs to a later fragment leaves
    its fields null and `flags_int` 0.
    """
    at = "link_offset"
    head = split_frames(frames)[0].selectExpr(
        "packet_id", "ts_us", "raw", at, f"CAST({at} + ({_number(at, 1)} & 15) * 4 AS INT) AS l4",
        f"{_number(f'{at} + 2', 2)} AS length", f"{_number(f'{at} + 6', 2)} & 8191 AS fragment",
        f"{_number(f'{at} + 8', 1)} AS ttl", f"{_number(f'{at} + 9', 1)} AS protocol",
        f"{_number(f'{at} + 12', 4)} AS src", f"{_number(f'{at} + 16', 4)} AS dst")
    # Payload: what was captured, cut at the declared length unless that is nonsense.
    head = head.selectExpr("*", f"length - (l4 - {at}) AS declared", "octet_length(raw) - l4 AS captured").selectExpr(
        "*", "fragment = 0 AND CASE protocol WHEN 6 THEN 20 WHEN 17 THEN 8 WHEN 1 THEN 8 END <= "
             "CASE WHEN declared < 0 THEN captured ELSE least(captured, declared) END AS whole")
    head = head.selectExpr("*", "coalesce(whole AND protocol = 6, false) AS tcp", "coalesce(whole AND protocol = 1, false) AS icmp",
                           "coalesce(whole AND protocol IN (6, 17), false) AS ported",
                           f"{_number('l4 + 12', 2)} & 511 AS bits")
    return head.selectExpr(
        "packet_id", "ts_us", f"{num_ip('src')} AS src_ip", f"{num_ip('dst')} AS dst_ip", "CAST(protocol AS INT) AS protocol",
        "CAST(length AS INT) AS length", "CAST(ttl AS INT) AS ttl",
        f"CAST(CASE WHEN ported THEN {_number('l4', 2)} END AS INT) AS src_port",
        f"CAST(CASE WHEN ported THEN {_number('l4 + 2', 2)} END AS INT) AS dst_port",
        "tcp", "bits", f"CAST(CASE WHEN icmp THEN {_number('l4', 1)} END AS INT) AS icmp_type").select(
        "packet_id", "ts_us", "src_ip", "dst_ip", "protocol", "length", "ttl", "src_port", "dst_port",
        F.when(F.col("tcp"), flag_letters(F.col("bits"))).alias("flags"),
        F.expr("CAST(CASE WHEN tcp THEN bits ELSE 0 END AS INT)").alias("flags_int"), "icmp_type")


def encode_frames(packets: DataFrame) -> DataFrame:
    """Minimal raw-IP frames whose headers carry the packet rows, for replay and tests."""
    def h(c, digits):
        return F.lpad(F.hex(c.cast("bigint")), digits, "0")

    def ip(c):
        octets = F.split(c, r"\.")
        return F.concat(*[h(octets[i], 2) for i in range(4)])

    p = F.col("protocol")
    ports = F.concat(h(F.col("src_port"), 4), h(F.col("dst_port"), 4))
    body = (F.when(p == 6, F.concat(ports, F.lit("0" * 16 + "5"), h(F.col("flags_int"), 3), F.lit("0" * 12)))
            .when(p == 17, F.concat(ports, F.lit("00080000")))
            .when(p == 1, F.concat(h(F.col("icmp_type"), 2), F.lit("0" * 14)))
            .otherwise(F.lit("")))
    head = F.concat(F.lit("4500"), h(F.col("length"), 4), F.lit("00000000"), h(F.col("ttl"), 2), h(p, 2),
                    F.lit("0000"), ip(F.col("src_ip")), ip(F.col("dst_ip")))
    return packets.select("packet_id", "ts_us", F.unhex(F.concat(head, body)).alias("raw"), F.lit(0).alias("link_offset"))
