"""Column functions for addresses, protocols and TCP flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# IP protocol numbers that have a name in alerts.
PROTOCOL_NAMES = {1: "ICMP", 6: "TCP", 17: "UDP"}
# TCP flag letters, lowest bit first.
FLAG_LETTERS = "FSRPAUECN"

_OCTET = "(0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
_IPV4 = f"^{_OCTET}([.]{_OCTET}){{3}}$"
_HEX = r"[0-9a-fA-F]{1,4}"


def protocol_name(protocol: Column) -> Column:
    names = F.expr("map(" + ", ".join(f"{k}, '{v}'" for k, v in PROTOCOL_NAMES.items()) + ")")
    return F.coalesce(F.try_element_at(names, protocol.cast("int")), protocol.cast("string"))


def flag_letters(bits: Column, protocol: Column | None = None) -> Column:
    """Letters of the set bits; null for a protocol other than TCP when one is given."""
    letters = F.concat_ws("", *[
        F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.lit(ch)) for i, ch in enumerate(FLAG_LETTERS)])
    return letters if protocol is None else F.when(protocol == 6, letters)


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(_IPV4), F.lit(False))


def is_ipv6(ip: Column) -> Column:
    """Hex-and-colon literals: eight groups, or fewer around one `::`."""
    groups = F.size(F.filter(F.split(ip, ":"), lambda g: g != ""))
    full = ip.rlike(rf"^({_HEX}:){{7}}{_HEX}$")
    short = ip.rlike(rf"^({_HEX}(:{_HEX})*)?::({_HEX}(:{_HEX})*)?$") & (groups <= 7)
    return F.coalesce(full | short, F.lit(False))


def is_ip(ip: Column) -> Column:
    return is_ipv4(ip) | is_ipv6(ip)


def ip_num(ip: str) -> str:
    """SQL text: dotted quad to BIGINT; null when it is not a valid IPv4 address."""
    return (f"CASE WHEN {ip} RLIKE '{_IPV4}' THEN "
            f"aggregate(split({ip}, '[.]'), 0L, (n, octet) -> n * 256 + CAST(octet AS BIGINT)) END")


def num_ip(n: str) -> str:
    """SQL text: BIGINT to dotted quad."""
    octets = ", ".join(f"CAST(shiftright({n}, {s}) & 255 AS STRING)" for s in (24, 16, 8, 0))
    return f"concat_ws('.', {octets})"


def ip_to_num(ip: str = "src_ip") -> Column:
    """The address column as BIGINT; null when it is not a valid IPv4 address."""
    return F.expr(ip_num(ip))


def num_to_ip(n: str) -> Column:
    return F.expr(num_ip(n))


def prefix_length(suffix: str, mask: str) -> str:
    """SQL text: prefix length of a `/24` suffix, or of a netmask or host mask given as number.

    A missing suffix means 32, a bad one is null.
    """
    inverse = f"(4294967295L - {mask})"
    return f"""CASE WHEN {suffix} IS NULL THEN 32
        WHEN {suffix} RLIKE '^0*[0-9]{{1,2}}$' THEN CASE WHEN CAST({suffix} AS INT) <= 32 THEN CAST({suffix} AS INT) END
        WHEN {inverse} & ({inverse} + 1) = 0 THEN 32 - bit_count({inverse})
        WHEN {mask} & ({mask} + 1) = 0 THEN 32 - bit_count({mask}) END"""


def networks(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """Add lo, hi and len of the IPv4 address or network in `entry`, host bits ignored; null when invalid."""
    return (entries.selectExpr("*", f"split({entry}, '/') AS _p")
            .selectExpr("*", f"CASE WHEN size(_p) <= 2 THEN {ip_num('_p[0]')} END AS _base", "get(_p, 1) AS _suffix",
                        f"{ip_num('get(_p, 1)')} AS _mask")
            .selectExpr("*", f"{prefix_length('_suffix', '_mask')} AS _len")
            .selectExpr("*", "CASE WHEN _base IS NOT NULL THEN shiftleft(1L, 32 - _len) END AS _size")
            .selectExpr("* EXCEPT (_p, _base, _suffix, _mask, _len, _size)", "_base - _base % _size AS lo",
                        "_base - _base % _size + _size - 1 AS hi", "CASE WHEN _size IS NOT NULL THEN _len END AS len"))
