"""Table schemas and severity helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


PACKETS = T.StructType([
    T.StructField("packet_id", T.LongType(), False),
    T.StructField("ts_us", T.LongType(), False),
    T.StructField("src_ip", T.StringType(), False),
    T.StructField("dst_ip", T.StringType(), False),
    T.StructField("protocol", T.IntegerType(), False),
    T.StructField("length", T.IntegerType(), False),
    T.StructField("ttl", T.IntegerType(), False),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("flags", T.StringType()),
    T.StructField("flags_int", T.IntegerType(), False),
    T.StructField("icmp_type", T.IntegerType()),
])

# One JSON object per line in the alert log.
ALERT_LOG = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("correlated", T.BooleanType()),
    T.StructField("also_triggered", T.ArrayType(T.StringType())),
    T.StructField("count", T.LongType()),
    T.StructField("threat_score", T.IntegerType()),
    T.StructField("id", T.StringType()),
    T.StructField("category", T.StringType()),
])


# LOW=0 .. CRITICAL=3; null for an unknown level.
RANK = "CAST(nullif(array_position(array('LOW', 'MEDIUM', 'HIGH', 'CRITICAL'), severity), 0) - 1 AS INT)"


def severity_rank(severity: str = "severity") -> Column:
    return F.expr(RANK.replace("severity", severity))


def severity_name(rank: str) -> Column:
    return F.expr(f"element_at(array('LOW', 'MEDIUM', 'HIGH', 'CRITICAL'), {rank} + 1)")


def iso(ts_us: str = "ts_us") -> Column:
    """UTC ISO-8601 text whatever the session time zone; six fraction digits, left out when zero."""
    text = f"replace(CAST(TIMESTAMP_NTZ'1970-01-01 00:00:00' + INTERVAL '0.000001' SECOND * {ts_us} AS STRING), ' ', 'T')"
    return F.expr(f"concat(CASE WHEN {ts_us} % 1000000 = 0 THEN {text} ELSE rpad({text}, 26, '0') END, '+00:00')")


def micros(text: Column) -> Column:
    """Epoch microseconds of an ISO-8601 text with offset; null when unreadable."""
    return F.unix_micros(text.try_cast("timestamp"))


# (ts_us, packet_id) packed into one DECIMAL(38,0): ordering by it is ordering by time,
# then id. Unlike a struct it may sit in a hash-aggregate buffer, so min and max over it
# combine on the map side.
ARRIVAL = "CAST(CAST(ts_us AS DECIMAL(18, 0)) * 10000000000000000000BD + packet_id AS DECIMAL(38, 0))"


def sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(v)


def literal_array(values: list, type_: str) -> str:
    """SQL text of a constant array."""
    return f"CAST(array({', '.join(sql_literal(v) for v in values)}) AS array<{type_}>)"


def literal_table(spark, rows, ddl: str):
    """A small constant DataFrame as a VALUES relation, so Catalyst knows its size."""
    names, types = zip(*[c.strip().split(" ", 1) for c in ddl.split(",")])
    if not rows:
        return spark.sql(f"SELECT {', '.join(f'CAST(NULL AS {t}) AS {n}' for n, t in zip(names, types))} WHERE false")
    values = ", ".join("(" + ", ".join(sql_literal(v) for v in r) + ")" for r in rows)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(names, types))
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(names)})")
