"""Operators over the alert table: cooldown, notification batches and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.operators.greedy import openers
from wiretally.operators.slabs import US, at_home, with_slabs
from wiretally.rules import SEVERITIES
from wiretally.schema import severity_rank

COOLDOWN_S = 30
BATCH_S = 3


def _winners(alerts: DataFrame, keys, span_s: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """The alerts with their key as text (a missing part is empty), the openers, and the columns that join them."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = alerts.withColumns({n: F.coalesce(F.col(k).cast("string"), F.lit("")) for n, k in zip(names, keys)})
    return keyed, openers(keyed, names, span_s * US), [*names, "ts_us", "packet_id"]


def cooldown(alerts: DataFrame, keys=("rule", "src_ip"), span_s: int = COOLDOWN_S) -> DataFrame:
    """Add `passed`: false while less than `span_s` after the key's last passed alert.

    packet_id need only tell alerts of one key and time apart.
    """
    keyed, winners, on = _winners(alerts, keys, span_s)
    return (keyed.join(winners.select(*on, F.lit(True).alias("passed")), on, "left")
            .select(*alerts.columns, F.coalesce("passed", F.lit(False)).alias("passed")))


def passed(alerts: DataFrame, keys=("rule", "src_ip"), span_s: int = COOLDOWN_S) -> DataFrame:
    """Only the alerts that the cooldown lets through."""
    keyed, winners, on = _winners(alerts, keys, span_s)
    return keyed.join(winners.select(*on), on, "left_semi").select(*alerts.columns)


def suppressed(cooled: DataFrame, keys=("rule", "src_ip")) -> DataFrame:
    """Passed and suppressed counts per key."""
    return cooled.groupBy(*keys).agg(
        F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("suppressed"))


def suppressed_total(cooled: DataFrame) -> DataFrame:
    return cooled.agg(F.count(F.lit(1)).alias("alerts"), F.count_if("passed").alias("logged"),
                      F.count_if(~F.col("passed")).alias("suppressed"))


def notify_filter(alerts: DataFrame, min_severity: str = "HIGH") -> DataFrame:
    return alerts.filter(severity_rank() >= SEVERITIES.index(min_severity))


def batch(alerts: DataFrame, keys=(), span_s: int = BATCH_S) -> DataFrame:
    """Add `batch_id`, the time of the alert that opened the batch: everything less than
    `span_s` after that first alert joins it."""
    span, slab_us = span_s * US, 4 * span_s * US
    starts = (with_slabs(openers(alerts, list(keys), span).select(*keys, "ts_us").distinct(), slab_us, span - 1)
              .withColumn("kind", F.lit(0)))
    rows = (with_slabs(alerts, slab_us, 0).withColumn("kind", F.lit(1))
            .unionByName(starts, allowMissingColumns=True))
    w = (Window.partitionBy(*keys, "slab").orderBy("ts_us", "kind")
         .rowsBetween(Window.unboundedPreceding, 0))
    opened = F.last(F.when(F.col("kind") == 0, F.col("ts_us")), ignorenulls=True).over(w)
    return (rows.withColumn("batch_id", opened).filter(f"kind = 1 AND {at_home(slab_us)}").drop("kind", "slab"))


def pending(batched: DataFrame, max_alerts: int, keys=()) -> DataFrame:
    """The newest `max_alerts` of each batch: a report of a queue of that size."""
    newest = Window.partitionBy(*keys, "batch_id").orderBy(F.desc("ts_us"), F.desc("packet_id"))
    return batched.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= max_alerts).drop("_n")


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value.cast("string"))


def digest(batched: DataFrame, keys=(), prefix: str = "") -> DataFrame:
    """One notification per batch: number of alerts, subject and icon, over all its alerts.

    The highest severity leads, the earliest alert of it. A hash aggregate: nothing of a
    batch is collected; `digest_lines` has the body.
    """
    top = F.min(F.struct((-severity_rank()).alias("r"), "ts_us", "packet_id", "rule", "severity")).alias("top")
    return digest_of(batched.groupBy(*keys, "batch_id").agg(F.count(F.lit(1)).alias("n"), top), keys, prefix)


def digest_of(batches: DataFrame, keys=(), prefix: str = "") -> DataFrame:
    """The notifications of batches given by their number of alerts `n` and their leading alert `top`."""
    severity, rule, n = F.col("top.severity"), F.col("top.rule"), F.col("n")
    # The wording of a notification.
    return batches.select(
        *keys, "batch_id", n.cast("bigint").alias("n_alerts"),
        F.when(n == 1, F.concat(F.lit(prefix), severity, F.lit(" — "), rule))
         .otherwise(F.concat(F.lit(prefix), n.cast("string"), F.lit(" alerts — highest: "), severity, F.lit(" "), rule))
         .alias("subject"),
        F.when(severity == "CRITICAL", ":rotating_light:").otherwise(":warning:").alias("icon"))


def digest_lines(batched: DataFrame, keys=()) -> DataFrame:
    """The body of the notifications: the text of every alert, in order of (ts_us, packet_id) within its batch."""
    # The layout of a notification.
    line = F.concat_ws(
        "\n",
        _line("Severity  : ", F.col("severity")),
        _line("  Rule      : ", F.col("rule")),
        _line("  Source IP : ", F.col("src_ip")),
        _line("  Dest IP   : ", F.col("dst_ip")),
        _line("  Dest Port : ", F.col("dst_port")),
        F.concat(F.lit("  Count     : "), F.col("count").cast("string"), F.lit(" packets in window")),
        F.when(F.col("threat_score") != 0, F.concat(F.lit("  Threat    : "), F.col("threat_score").cast("string"), F.lit("/100"))),
        F.when(F.size("also_triggered") > 0, F.concat(F.lit("  Also fired: "), F.array_join("also_triggered", ", "))))
    return batched.select(*keys, "batch_id", "ts_us", "packet_id", line.alias("line"))
