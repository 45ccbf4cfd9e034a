import io
import re
from contextlib import redirect_stdout
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from model import US, packet, scaled, traffic
from pyspark.sql import functions as F
from test_detect import frame

from wiretally.operators.alerts import batch, digest, notify_filter, passed
from wiretally.functions.predicates import conditions_sql
from wiretally.operators.enrich import drop_allowlisted, drop_local
from wiretally.plans import pipeline
from wiretally.rules import RULES, as_rules
from wiretally.schema import literal_table
from wiretally.session import shared_dir
from wiretally.sources import allowlist
from wiretally.sources import packets as S
from wiretally.streaming import source_state
from wiretally.streaming.stream import BITS, Detector, plan_of, with_bits

LOCAL = ("10.0.0.3",)
COLUMNS = ["packet_id", "ts_us", "rule", "severity", "src_ip", "also_triggered", "count", "threat_score", "category"]
NULL = dict(flags="", flags_int=0)


def allow(spark):
    return allowlist.parse_entries(literal_table(spark, [("10.0.0.2/32",)], "entry string"))


def rows(df):
    return sorted(map(str, df.select(*COLUMNS).collect()))


class Stream:
    def __init__(self, spark, **settings):
        self.spark, self.base = spark, shared_dir(spark, "stream")
        self.det = Detector(spark, self.base, **settings)

    def source(self):
        return S.read_packet_stream(self.spark, f"{self.base}/in")

    def arrive(self, packets):
        S.write_packets(frame(self.spark, packets), f"{self.base}/in")
        self.det.run(self.source())

    def drain(self):
        self.det.drain(self.source())

    def path(self, name):
        return Path(urlparse(self.base).path) / name


def test_stream_equals_batch(spark):
    """Arrivals cut between packets of the same microsecond; the last batch of one is run again."""
    rules = scaled(RULES)
    packets = sorted(traffic(500, 11, sources=4), key=lambda p: (p["ts_us"], p["packet_id"]))
    s = Stream(spark, rules=rules, allow=lambda: (allow(spark), 1), local_ips=LOCAL)
    for a, b in ((0, 201), (201, 350), (350, 500)):
        s.arrive(packets[a:b])
        if a:
            s.det.publish()
        if a == 201:
            # a run that was killed before its last batch was logged as done: Spark does it again, from the state before it
            commits = s.path("checkpoint/decided/commits")
            last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
            for name in (str(last), f".{last}.crc"):
                (commits / name).unlink(missing_ok=True)
            before = rows(s.det.alerts())
            s.det.run(s.source())
            assert rows(s.det.alerts()) == before
    s.drain()
    s.det.publish()
    everything = frame(spark, packets)
    kept = drop_allowlisted(drop_local(everything, LOCAL), allow(spark))
    want = passed(pipeline.cut(pipeline.offline(kept, rules))).persist()
    assert rows(s.det.alerts()) == rows(want)
    counts = s.det.counters().first()
    assert (counts.captured, counts.late, counts.unreadable) == (500, 0, 0)
    assert counts.captured - counts.own - counts.allowlisted == kept.count() and counts.logged == want.count()
    wanted = digest(batch(notify_filter(want)))
    assert sorted(map(str, s.det.digests().select(wanted.columns).collect())) == sorted(map(str, wanted.collect()))
    assert s.det.log().count() == want.count()


def test_late_packets_are_set_aside_and_unordered_ones_wait(spark):
    s = Stream(spark, mode="offline", lateness_s=10, rules=[r for r in RULES if r.type == "pattern"])
    s.arrive([packet(1, 100 * US, **NULL), packet(2, 95 * US, **NULL)])
    s.arrive([packet(3, 89 * US, **NULL), packet(4, 91 * US, **NULL)])
    assert [r.packet_id for r in s.det.late().collect()] == [3]
    assert s.det.alerts().count() == 0
    s.drain()
    assert sorted(r.packet_id for r in s.det.alerts().collect()) == [1, 2, 4]
    assert s.det.counters().first().late == 1


def test_arrivals_are_counted_before_any_filter(spark):
    s = Stream(spark, allow=lambda: (allow(spark), 1), local_ips=LOCAL)
    broken = {**packet(4, 4 * US), "length": None}
    S.write_packets(spark.createDataFrame([packet(1, US, src="10.0.0.2"), packet(2, 2 * US, src="10.0.0.3"), packet(3, 3 * US, **NULL), broken],
                                          ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame(spark, [packet(1, 1)]).schema)), f"{s.base}/in")
    s.det.run(s.source())
    s.drain()
    c = s.det.counters().first()
    assert (c.captured, c.unreadable, c.own, c.allowlisted, c.late, c.alerts, c.logged) == (4, 1, 1, 1, 0, 1, 1)


def test_state_is_bounded_and_goes_when_a_source_falls_silent(spark):
    rules = [{"id": "A", "name": "many", "type": "rate", "severity": "LOW", "threshold": 3, "window_seconds": 5, "conditions": {}},
             {"id": "B", "name": "ports", "type": "multi_destination", "severity": "LOW", "threshold": 2, "window_seconds": 3, "track": "dst_port", "conditions": {}}]
    s = Stream(spark, mode="offline", rules=rules)
    sizes = []
    for k in range(4):
        s.arrive([packet(1000 * k + i, k * 20 * US + i * US // 20, src=f"10.0.0.{k}", dst_port=i % 7) for i in range(400)])
        last = s.det.by_batch().agg(F.max("batch")).first()[0]
        sizes.append(sorted((r["src_ip"], r["set"]) for r in s.det.window_entries(last).select("src_ip", "set").collect()))
    # only the newest source is left each time: five and three seconds, and those they reach into
    for k, held in enumerate(sizes):
        assert {src for src, _ in held} == {f"10.0.0.{k}"} and len(held) <= 6 + 4


def test_allowlist_is_read_again_for_every_arrival(spark, tmp_path):
    path = str(tmp_path / "allow")
    column = lambda *v: literal_table(spark, [(x,) for x in v], "entry string")
    assert allowlist.versions(spark, path) == 0
    assert [r.entry for r in allowlist.save_allowlist(column("10.0.0.1", "nope", "10.0.0.1/32"), path).collect()] == ["nope"]
    s = Stream(spark, rules=[r for r in RULES if r.type == "pattern"], allow=lambda: allowlist.latest(spark, path), cooldown_s=0)
    two = lambda i, t: [packet(i, t * US, src="10.0.0.1", **NULL), packet(i + 1, t * US, src="10.0.0.2", **NULL)]
    s.arrive(two(1, 1))
    allowlist.save_allowlist(column("10.0.0.2"), path)
    s.arrive(two(3, 2))
    allowlist.save_allowlist(column(), path)
    s.arrive(two(5, 3))
    s.drain()
    assert sorted(r.packet_id for r in s.det.alerts().collect()) == [2, 3, 5, 6]
    assert [r.allow_version for r in s.det.by_batch().where("captured > 0").orderBy("batch").collect()] == [1, 2, 3]
    first, number = allowlist.latest(spark, path, 1)
    assert number == 1 and [r.entry for r in first.collect()] == ["10.0.0.1/32"]


def test_waiting_packets_take_an_entry_per_piece_not_per_second(spark):
    """1,000 packets in as many seconds wait for the watermark; with their timer they are a few entries of state."""
    s = Stream(spark, mode="offline", lateness_s=5000, rules=[r for r in RULES if r.type == "pattern"])
    s.arrive([packet(i, i * US, **NULL) for i in range(1, 1001)])
    assert s.det.by_batch().agg(F.max("state_rows")).first()[0] <= 40
    s.drain()
    assert sorted(r.packet_id for r in s.det.alerts().collect()) == list(range(1, 1001))


def test_stretches_and_pieces_change_no_alert(spark, monkeypatch):
    """Packets in disorder, in pieces of a few packets evaluated a few at once."""
    for name, value in (("CHUNK_ROWS", 60), ("PIECE_ROWS", 4), ("STRETCH_ROWS", 10)):
        monkeypatch.setattr(source_state, name, value)
    rules = scaled(RULES)
    packets = traffic(300, 5, sources=2)
    s = Stream(spark, mode="offline", lateness_s=10_000_000, rules=rules)
    for part in np.array_split(np.random.default_rng(1).permutation(len(packets)), 2):
        s.arrive([packets[i] for i in part])
    s.drain()
    assert rows(s.det.alerts()) == rows(pipeline.offline(frame(spark, packets), rules))


def test_pieces_hold_the_packets():
    rnd = np.random.default_rng(2)
    n = 9000
    t = pa.table({"src_ip": rnd.choice(["a", "b", "c"], n, p=[.9, .09, .01]), "packet_id": np.arange(n), "ts_us": rnd.integers(-50, 9000, n) * US // 3,
                  "dst_ip": rnd.choice(["x", "y", ""], n), "dst_port": pa.array([None if i % 5 == 0 else i % 70 for i in range(n)], pa.int32()),
                  "protocol": pa.array(rnd.integers(0, 256, n), pa.int32()), "b0": rnd.integers(0, 3, n), "b1": rnd.integers(0, 2, n) << 61})
    found = []
    for b in source_state.pieces(["b0", "b1"])(iter(t.to_batches(1000))):
        for p in b.to_pylist():
            own = source_state.Packets.loads(p["rows"])
            assert (p["first_us"], p["last_us"], p["n"]) == (own.ts_us[0], own.ts_us[-1], len(own)) and (np.diff(own.ts_us) >= 0).all()
            assert p["hit"] == own.hits().any() == own.hits().all()
            found += [(p["src_ip"], *x) for x in zip(*(c.tolist() for c in (own.packet_id, own.ts_us, own.dst_ip, own.dst_port, own.protocol, *own.masks)))]
    assert sorted(found) == sorted((*r.values(),) for r in t.set_column(4, "dst_port", t["dst_port"].cast("int64").fill_null(source_state.NO_PORT)).to_pylist())


def test_bits_of_all_conditions_are_in_methods_that_get_compiled(spark):
    _, conditions = plan_of(as_rules(RULES), True, 30, 300)
    path = shared_dir(spark, "packets")
    S.write_packets(frame(spark, traffic(300, 3)), path)
    packets = S.read_packets(spark, path)
    out = with_bits(packets, conditions)
    text = io.StringIO()
    with redirect_stdout(text):
        out.explain("codegen")
    assert max([0, *map(int, re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue()))]) < 8000
    bits = {r.packet_id: [r.b0, r.b1] for r in out.collect()}
    want = packets.selectExpr("packet_id", *[f"{conditions_sql(c)} AS c{i}" for i, c in enumerate(conditions)]).collect()
    assert any(map(any, bits.values()))
    for r in want:
        assert [bool(bits[r.packet_id][i // BITS] >> i % BITS & 1) for i in range(len(conditions))] == [bool(r[f"c{i}"]) for i in range(len(conditions))]


def test_window_counts_equal_a_loop():
    rnd = np.random.default_rng(4)
    for _ in range(60):
        at = np.sort(rnd.integers(0, 50, 40))
        values, span, cut = rnd.integers(0, 6, 40), int(rnd.integers(1, 20)), int(rnd.integers(0, 40))
        times, counts = np.unique(at[:cut], return_counts=True)
        here = [[j for j in range(i + 1) if at[j] > at[i] - span] for i in range(cut, 40)]
        assert source_state.times_within(times, counts, at[cut:], span).tolist() == [len(x) for x in here]
        assert source_state.values_within(values[:cut], at[:cut], values[cut:], at[cut:], span).tolist() == [len({values[j] for j in x}) for x in here]


@pytest.mark.parametrize("fmt", ["csv", "json", "orc"])
def test_packet_formats(spark, fmt):
    p = frame(spark, traffic(60, 2))
    path = shared_dir(spark, "packets")
    S.write_packets(p, path, fmt)
    assert sorted(map(str, S.read_packets(spark, path, fmt).collect())) == sorted(map(str, p.collect()))
