"""Packet streams to alerts on Structured Streaming's own mechanisms.

The packet stream has a watermark; its packets are packed per source into pieces (`source_state.pieces`), and one
stateful operator keyed by source (`source_state.SourceState`) holds these until the watermark has passed them, counts windows, scores, holds back repeated alerts and forgets what no window
reaches, by event-time timers. Its file sink is exactly-once; the JSON log and the notification digests are streams
over that sink, the digests with the open batch of each channel as keyed state. Nothing here keeps state of its own:
a batch that is run again starts from the state Spark has for it and commits the same files.

Packets older than the watermark on arrival are late: they come out in the late table and raise no alert. Counters
are observed metrics, taken on arrival before any filter and again behind the stateful operator.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiretally.functions.families import families
from wiretally.functions.net import protocol_name
from wiretally.functions.predicates import conditions_sql
from wiretally.operators.alerts import BATCH_S, COOLDOWN_S, digest_of
from wiretally.operators.correlate import COUNT_SPACE, THREAT_WINDOW_S, escalate, lead_of, places, score_sql
from wiretally.operators.detect import condition_sets
from wiretally.operators.enrich import LOOPBACK, drop_allowlisted, with_category
from wiretally.operators.slabs import US
from wiretally.rules import RULES, SEVERITIES, as_rules
from wiretally.schema import PACKETS, iso, severity_rank
from wiretally.sources.alert_log import alert_lines
from wiretally.streaming.source_state import CLOSING, DIGEST, OUT, PIECE, OpenBatch, SourceState, pieces

BITS = 62
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ALERT = ("packet_id bigint, ts_us bigint, rule string, severity string, src_ip string, dst_ip string, dst_port int, "
         "protocol string, correlated boolean, also_triggered array<string>, count bigint, id string, "
         "threat_score int, category string")
LATE = "packet_id bigint, ts_us bigint, src_ip string, dst_ip string, dst_port int, protocol string"
COUNTERS = ("batch bigint, captured bigint, unreadable bigint, own bigint, allowlisted bigint, late bigint, alerts bigint, "
            "logged bigint, suppressed bigint, newest bigint, allow_version bigint, watermark_ms bigint, state_rows bigint")


def plan_of(rules: list, live: bool, cooldown_s: int, threat_s: int) -> tuple[dict, list[dict]]:
    """What the stateful operator needs to know of the rules, and the conditions its bits stand for."""
    stateless = [(i, r) for i, r in enumerate(rules) if r.type == "pattern"]
    sets, by_set = condition_sets([(i, r) for i, r in enumerate(rules) if r.type != "pattern"])
    conditions = [r.conditions for _, r in stateless] + sets
    names = {r.name: i for i, r in reversed(list(enumerate(rules)))}
    order = places(rules)
    return {
        "masks": [f"b{m}" for m in range(-(-len(conditions) // BITS))], "rule_masks": -(-len(rules) // BITS), "count_space": COUNT_SPACE,
        "stateless": [(k, i) for k, (i, _) in enumerate(stateless)],
        "sets": [(len(stateless) + s, rs[0][1].track, [(i, r.threshold, r.window_us) for i, r in rs]) for s, rs in enumerate(by_set)],
        "reach": [max(r.window_us for _, r in rs) for rs in by_set],
        "order": order, "place": [order.index(i) for i in range(len(rules))], "names": [names[r.name] for r in rules],
        "live": live, "cooldown_us": cooldown_s * US, "threat_us": threat_s * US}, conditions


def with_bits(packets: DataFrame, conditions: list[dict]) -> DataFrame:
    """What the stateful operator reads of packets, with the conditions each meets as bits of the columns b0, b1, ...

    In a whole-stage method all conditions would be one method, longer than the JVM compiles (8,000 bytes of code). Spark
    leaves a projection with a higher-order function out of it and cuts the projection into small methods.
    """
    groups = families(conditions)

    def mask(m):
        own = [[i for i in g if i // BITS == m] for g in groups]
        cases = ["CASE " + " ".join(f"WHEN {conditions_sql(conditions[i])} THEN {1 << i % BITS}L" for i in g) + " ELSE 0L END" for g in own if g]
        return f"{' | '.join(cases)} AS b{m}"

    return packets.selectExpr("src_ip", "aggregate(array(packet_id), 0L, (a, x) -> x) AS packet_id", "ts_us", "dst_ip", "dst_port", "protocol",
                              *[mask(m) for m in range(-(-len(conditions) // BITS))])


@dataclass
class Detector:
    """The settings of one stream and the folder, shared by the cluster, that holds its checkpoints and results.

    `allow` gives the allowlist (lo, hi, len) and its version; it is asked again for every run of the stream.
    """

    spark: SparkSession
    base: str
    mode: str = "live"
    rules: list | None = None
    allow: Callable[[], tuple[DataFrame, int]] | None = None
    local_ips: tuple = ()
    lateness_s: int = 0
    min_severity: str = "HIGH"
    cooldown_s: int = COOLDOWN_S
    threat_s: int = THREAT_WINDOW_S
    batch_s: int = BATCH_S
    _rules: list = field(init=False)

    def __post_init__(self):
        self._rules = as_rules(RULES if self.rules is None else self.rules)
        self.spark.createDataFrame([], PACKETS).write.mode("append").parquet(f"{self.base}/control")

    # the plans

    def decided(self, packets: DataFrame) -> DataFrame:
        """Alerts that pass, late packets and closing rows of a packet stream, told apart by `kind`."""
        live = self.mode == "live"
        plan, conditions = plan_of(self._rules, live, self.cooldown_s, self.threat_s)
        allow, version = self.allow() if live and self.allow else (None, None)
        closing = F.col("packet_id").eqNullSafe(F.lit(CLOSING))
        needed = [f.name for f in PACKETS.fields if not f.nullable]
        broken = F.greatest(*[F.col(c).isNull().cast("int") for c in needed]) == 1
        own = F.col("src_ip").isin(sorted({*LOOPBACK, *filter(None, self.local_ips)})) if live else F.lit(False)
        fine = ~broken & (closing | ~F.coalesce(own, F.lit(False)))
        control = self.spark.readStream.schema(PACKETS).parquet(f"{self.base}/control")
        arrived = (packets.select(*PACKETS.fieldNames()).unionByName(control)
                   .withColumn("at", F.timestamp_micros(F.col("ts_us") + F.when(closing, self.lateness_s * US + 1000).otherwise(0))).withWatermark("at", f"{self.lateness_s} seconds")
                   .observe("arrived", F.count_if(~closing).alias("captured"), F.count_if(~closing & broken).alias("unreadable"),
                            F.count_if(~closing & ~broken & own).alias("own"), F.max(F.when(~closing, F.col("ts_us"))).alias("newest"),
                            F.max(F.lit(version).cast("bigint")).alias("allow_version")))
        kept = arrived.filter(fine).drop("at")        # without the event time Spark would drop late packets unseen
        if allow is not None:
            kept = drop_allowlisted(kept, allow)
        kept = kept.observe("kept", F.count_if(~closing).alias("n"))
        bits = with_bits(kept, conditions)
        schema = T.StructType.fromDDL(OUT)
        for m in range(plan["rule_masks"]):
            schema = schema.add(f"m{m}", T.LongType())
        out = (bits.mapInArrow(pieces(plan["masks"]), PIECE).groupBy("src_ip")
               .transformWithStateInPandas(SourceState(plan), schema, "Append", "eventTime"))
        alert, held = F.col("kind") == "alert", F.col("kind") == "held"
        out = out.observe("decided", F.count_if(F.col("kind") == "late").alias("late"), F.count_if(alert).alias("logged"),
                          F.sum(F.when(held, F.col("packet_id"))).alias("suppressed")).filter(~held)
        named = lead_of(out.withColumn("protocol", protocol_name(F.col("protocol"))), self._rules, "kind", score_sql("active"))
        return with_category(named.withColumn("severity", escalate()), self._rules)

    def _sink(self, kind: str, ddl: str) -> DataFrame:
        return self.spark.read.schema(ddl + ", kind string").parquet(f"{self.base}/decided").filter(F.col("kind") == kind).drop("kind")

    def _decided_stream(self) -> DataFrame:
        return self.spark.readStream.schema(ALERT + ", kind string").parquet(f"{self.base}/decided")

    def log_lines(self) -> DataFrame:
        """The alert log as a stream: text and UTC date."""
        logged = self._decided_stream().filter("kind = 'alert'")
        return logged.select(alert_lines(logged, offline=self.mode != "live").alias("value"), F.substring(iso(), 1, 10).alias("date"))

    def digested(self) -> DataFrame:
        """The notification digests as a stream; one channel."""
        rows = self._decided_stream().withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", "0 seconds")
        told = rows.filter((F.col("kind") == "end") | ((F.col("kind") == "alert") & (severity_rank() >= SEVERITIES.index(self.min_severity))))
        told = told.select(F.lit("all").alias("channel"), "kind", "ts_us", "packet_id", "rule", "severity", severity_rank().alias("rank"))
        out = told.groupBy("channel").transformWithStateInPandas(OpenBatch(self.batch_s * US), "channel string, " + DIGEST, "Append", "eventTime")
        return digest_of(out.drop("channel"))

    # running them

    def run(self, packets: DataFrame) -> None:
        """Process the packets that have arrived, into alerts and late packets."""
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        self._count(self._start(self.decided(packets), "decided", "parquet", "kind"))

    def publish(self) -> None:
        """Bring the log and the digests up to the alerts."""
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        self._start(self.log_lines(), "log", "text", "date")
        self._start(self.digested(), "digests", "parquet")

    def _start(self, stream: DataFrame, name: str, fmt: str, *by: str):
        writer = stream.writeStream.queryName(name).format(fmt).option("path", f"{self.base}/{name}") \
            .option("checkpointLocation", f"{self.base}/checkpoint/{name}").outputMode("append").trigger(availableNow=True)
        query = (writer.partitionBy(*by) if by else writer).start()
        query.awaitTermination()
        return query

    def _count(self, query) -> None:
        """Keep the counters of each micro-batch of a finished run; a batch that is run again replaces its own."""
        rows = []
        for p in map(json.loads, (q.json if hasattr(q, "json") else json.dumps(q) for q in query.recentProgress)):
            seen = p.get("observedMetrics") or {}
            arrived, kept, decided = (seen.get(k) or {} for k in ("arrived", "kept", "decided"))
            n = lambda d, k: d.get(k) or 0
            passed_on = n(arrived, "captured") - n(arrived, "unreadable") - n(arrived, "own")
            mark = (p.get("eventTime") or {}).get("watermark")
            rows.append((p["batchId"], n(arrived, "captured"), n(arrived, "unreadable"), n(arrived, "own"), passed_on - n(kept, "n"), n(decided, "late"),
                         n(decided, "logged") + n(decided, "suppressed"), n(decided, "logged"), n(decided, "suppressed"), arrived.get("newest"), arrived.get("allow_version"),
                         mark and round(datetime.fromisoformat(mark).timestamp() * 1000), sum(s["numRowsTotal"] for s in p["stateOperators"])))
        if rows:
            self.spark.createDataFrame(rows, COUNTERS).coalesce(1).write.mode("overwrite").parquet(f"{self.base}/counters/from={rows[0][0]}")

    def drain(self, packets: DataFrame) -> None:
        """End the stream: a closing row moves the watermark past the newest packet, so that all waiting ones become final."""
        newest = self.by_batch().agg(F.max("newest")).first()[0]
        if newest is None:
            return
        at = (newest // 1000 + 1) * 1000
        row = [{**dict.fromkeys(PACKETS.fieldNames()), "packet_id": CLOSING, "ts_us": at, "src_ip": "", "dst_ip": "", "protocol": -1, "length": 0, "ttl": 0, "flags_int": 0}]
        self.spark.createDataFrame(row, PACKETS).coalesce(1).write.mode("append").parquet(f"{self.base}/control")
        self.run(packets)

    # results

    def by_batch(self) -> DataFrame:
        """The counters of each micro-batch."""
        return self.spark.read.schema(COUNTERS).option("recursiveFileLookup", True).parquet(f"{self.base}/counters")

    def counters(self) -> DataFrame:
        """Packets captured, unreadable, of the sensor itself, allowlisted and late, with the share of late ones in per
        cent, then alerts raised, logged and suppressed."""
        names = ("captured", "unreadable", "own", "allowlisted", "late", "alerts", "logged", "suppressed")
        return (self.by_batch().agg(*[F.sum(c).alias(c) for c in names])
                .withColumn("late_pct", F.round(F.coalesce(F.try_divide(F.col("late") * 100, F.col("captured")), F.lit(0.0)), 4)))

    def alerts(self) -> DataFrame:
        """All alerts logged so far."""
        return self._sink("alert", ALERT)

    def late(self) -> DataFrame:
        return self._sink("late", LATE)

    def log(self) -> DataFrame:
        return self.spark.read.text(f"{self.base}/log")

    def digests(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/digests")

    def window_entries(self, batch: int) -> DataFrame:
        """The windows' state entries (set, second) per source as of a micro-batch."""
        state = self.spark.read.format("statestore").option("stateVarName", "windows").option("batchId", batch).load(f"{self.base}/checkpoint/decided")
        return state.select(F.col("key.src_ip").alias("src_ip"), F.col("user_map_key.set").alias("set"), F.col("user_map_key.second").alias("second"))
