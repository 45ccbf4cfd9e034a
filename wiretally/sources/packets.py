"""Packet tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.schema import PACKETS


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A packet table with the fixed schema; csv, json, orc and parquet."""
    if fmt == "csv":
        # An empty flag string (TCP without flags) must stay apart from a missing one (not TCP).
        options = {"header": True, "nullValue": "\\N", **options}
    return spark.read.schema(PACKETS).options(**options).format(fmt).load(path)


def write_packets(packets: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    w = packets.select(*PACKETS.fieldNames()).write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.options(header=True, nullValue="\\N")
    w.save(path)


def read_packet_stream(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """New files below `path` as a stream; `fmt="kafka"` reads JSON packets from the options' topic."""
    if fmt == "kafka":
        raw = spark.readStream.format("kafka").options(**options).load()
        return raw.select(F.from_json(F.col("value").cast("string"), PACKETS).alias("p")).select("p.*")
    return spark.readStream.schema(PACKETS).options(**options).format(fmt).load(path)
