"""The alert log: one JSON object per line, in folders by UTC date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiretally.operators.enrich import with_category
from wiretally.schema import ALERT_LOG, iso, micros

# The columns of a CSV export.
CSV_COLUMNS = ["id", "timestamp", "severity", "rule", "category", "type", "protocol", "src_ip", "src_country",
               "dst_ip", "dst_port", "count", "ttl", "length", "mitre"]

_CORRUPT = "_corrupt_record"


def _parsed(lines: DataFrame) -> DataFrame:
    """`lines(value)` that are not blank, with the record `a`; an unreadable line is its own _corrupt_record."""
    schema = T.StructType([*ALERT_LOG.fields, T.StructField(_CORRUPT, T.StringType())])
    a = F.from_json(F.trim("value"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    return lines.filter(F.trim("value") != "").withColumn("a", a)


def parse_alert_lines(lines: DataFrame, keep_category: bool = False, rules=None) -> DataFrame:
    """Alerts from `lines(value)`; blank and unreadable lines are skipped.

    Missing fields get their defaults and `id` becomes `timestamp|rule`. The category
    is looked up from the rule, unless `keep_category` leaves a recorded one in place.
    Columns `date` and `packet_id` of the lines are kept.
    """
    extra = [c for c in lines.columns if c in ("date", "packet_id", "_line")]
    rows = _parsed(lines).filter(F.col(f"a.{_CORRUPT}").isNull()).select("a.*", *extra).drop(_CORRUPT)
    rows = rows.withColumns({
        "also_triggered": F.coalesce("also_triggered", F.array().cast("array<string>")),
        "correlated": F.coalesce("correlated", F.lit(False)),
        "threat_score": F.coalesce("threat_score", F.lit(0)),
        "id": F.concat(F.coalesce("timestamp", F.lit("")), F.lit("|"), F.coalesce("rule", F.lit(""))),
        "ts_us": micros(F.col("timestamp")),
        "packet_id": F.col("packet_id") if "packet_id" in extra else F.expr("0L"),
        "recorded": F.col("category"),
    })
    rows = with_category(rows, rules)
    if keep_category:
        rows = rows.withColumn("category", F.coalesce("recorded", F.lit("Other")))
    return rows.drop("recorded")


def _keyed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, _line, and `date` where folders have it): `_line` is a digest of file and text, so equal lines of a file share it."""
    lines = spark.read.text(path)
    return lines.withColumn("_line", F.unhex(F.md5(F.concat_ws("\n", F.col("_metadata.file_path"), "value"))))


def _numbered(lines: DataFrame) -> DataFrame:
    """packet_id in place of `_line`: a hash of it and, of equal lines in one file, their number."""
    nth = F.row_number().over(Window.partitionBy("_line").orderBy(F.lit(0)))
    return lines.withColumn("packet_id", F.xxhash64("_line", nth)).drop("_line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, packet_id, and `date` where folders have it) of the log below `path`.

    packet_id tells the lines apart: a hash of file, text and, of equal lines in one file, their number. It
    does not depend on how the file is split, so every reading gives a line the same one.
    """
    return _numbered(_keyed_lines(spark, path))


def read_alerts(spark: SparkSession, path: str, keep_category: bool = False) -> DataFrame:
    """The alert log below `path`. A filter on the folder column `date` prunes folders.

    Lines are numbered as in `read_lines`, but once they are parsed: the columns in use are dealt out, not the text.
    """
    return _numbered(parse_alert_lines(_keyed_lines(spark, path), keep_category))


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, rejected, example): how many lines of each file of the log are unreadable; files without such are left out."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    bad = _parsed(lines).filter(F.col(f"a.{_CORRUPT}").isNotNull())
    return bad.groupBy("file").agg(F.count(F.lit(1)).alias("rejected"), F.min("value").alias("example"))


def alert_lines(alerts: DataFrame, offline: bool = False) -> Column:
    """JSON text of an alert. A null `dst_port` is written, a missing `count` is not.

    Offline records carry the category instead of the rule id.
    """
    body = F.to_json(F.struct(
        (F.col("timestamp") if "timestamp" in alerts.columns else iso()).alias("timestamp"),
        "rule", "severity", "src_ip", "dst_ip", "dst_port", "protocol", "correlated", "also_triggered", "threat_score",
        *(["category"] if offline else [])), {"ignoreNullFields": "false"})
    optional = ["count"] if offline else ["count", "id"]
    tail = [F.when(F.col(c).isNotNull(), F.concat(F.lit(","), F.regexp_extract(F.to_json(F.struct(c)), r"^\{(.*)\}$", 1)))
            for c in optional]
    return F.concat(F.substring(body, F.lit(1), F.length(body) - 1), *[F.coalesce(t, F.lit("")) for t in tail], F.lit("}"))


def write_alerts(alerts: DataFrame, path: str, mode: str = "append", offline: bool = False, **options) -> None:
    """Append JSON lines below `path`, partitioned by UTC date; `compression="gzip"` and other options of the text writer."""
    (alerts.select(alert_lines(alerts, offline).alias("value"), F.substring(iso(), 1, 10).alias("date"))
     .write.mode(mode).options(**options).partitionBy("date").text(path))


def export_csv(alerts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Enriched alerts as CSV; null becomes empty. Every part file begins with the header, as Spark reads and writes
    them, so each is a table of its own and `header=True` reads the folder back."""
    have = set(alerts.columns)
    stamp = {"timestamp": iso()} if "timestamp" not in have else {}
    cols = [stamp.get(c, F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in CSV_COLUMNS]
    (alerts.select(*cols).write.mode(mode).options(header=True, nullValue="", emptyValue="").csv(path))
