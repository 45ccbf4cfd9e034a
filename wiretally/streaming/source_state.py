"""The stateful operator of the stream: everything remembered about one source.

Packets travel in pieces (`pieces`): a piece is the packets of one source and a range of time in one row, in columns.
So the shuffle, the operator's input and its state have a row per piece, not per packet.

State is kept in maps, so that Spark reads and writes single entries: pieces that wait for the watermark,
window contents by condition set and second (times with counts, or tracked values with their last time), the last
firing of each rule and the last passed alert of each rule. An entry is dropped by an event-time timer as soon as no
window can reach it, so a source that falls silent leaves nothing behind.

A packet is final once the watermark has passed it; packets are evaluated in time order when they become final,
a stretch of time after the other, which gives the alerts of a batch run. Packets behind the watermark on arrival
come out as late.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Executors need not have this package installed: ship its functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

US = 1_000_000
CLOSING = -1             # packet_id of a row that closes the stream
OUT = ("kind string, packet_id bigint, ts_us bigint, src_ip string, dst_ip string, dst_port int, protocol int, "
       "packed bigint, active bigint, passed boolean")
PIECE = "src_ip string, first_us bigint, last_us bigint, n bigint, hit boolean, rows binary"
CHUNK_ROWS = 1 << 18     # packets a task gathers before it makes pieces of them
PIECE_ROWS = 1 << 11     # packets of a piece, about
STRETCH_ROWS = 1 << 18   # packets evaluated at once, about


class Packets:
    """Packets of one source in columns, in the order of (ts_us, packet_id)."""

    def __init__(self, packet_id, ts_us, dst_ip, dst_port, protocol, masks: list):
        self.packet_id, self.ts_us, self.dst_ip, self.dst_port, self.protocol, self.masks = packet_id, ts_us, dst_ip, dst_port, protocol, masks

    def __len__(self) -> int:
        return len(self.ts_us)

    def take(self, at) -> Packets:
        return Packets(*(c[at] for c in (self.packet_id, self.ts_us, self.dst_ip, self.dst_port, self.protocol)), [m[at] for m in self.masks])

    def sort(self) -> Packets:
        return self.take(np.lexsort((self.packet_id, self.ts_us)))

    def hits(self) -> np.ndarray:
        return np.any([m != 0 for m in self.masks], axis=0) | (self.packet_id == CLOSING)

    @staticmethod
    def concat(parts: list) -> Packets:
        columns = (np.concatenate([getattr(p, c) for p in parts]) for c in ("packet_id", "ts_us", "dst_ip", "dst_port", "protocol"))
        return Packets(*columns, [np.concatenate(m) for m in zip(*(p.masks for p in parts))])

    def dumps(self) -> bytes:
        """Numbers as bytes, `dst_ip` as its values and a number each."""
        code, values = pd.factorize(self.dst_ip)
        small = np.uint8 if len(values) < 1 << 8 else np.uint16 if len(values) < 1 << 16 else np.uint32
        raw = pickle.dumps((self.packet_id.tobytes(), self.ts_us.tobytes(), list(values), code.astype(small).tobytes(), np.dtype(small).str,
                            self.dst_port.tobytes(), self.protocol.tobytes(), [m.tobytes() for m in self.masks]), 5)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)

    @staticmethod
    def loads(data: bytes) -> Packets:
        raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
        i, ts, values, code, kind, port, protocol, masks = pickle.loads(raw)
        known = np.empty(len(values), object)
        known[:] = values
        return Packets(np.frombuffer(i, np.int64), np.frombuffer(ts, np.int64), known[np.frombuffer(code, kind)], np.frombuffer(port, np.int64),
                       np.frombuffer(protocol, np.int64), [np.frombuffer(m, np.int64) for m in masks])


NO_PORT = -(1 << 40)     # a missing dst_port or protocol in a piece


def _ends(ts: np.ndarray) -> np.ndarray:
    """Where pieces of ascending times end: all cut at multiples of the same power of two seconds, the least that gives
    about PIECE_ROWS a piece, so that pieces made of different packets have mostly the same borders."""
    width, most = US, -(-len(ts) // PIECE_ROWS)
    while (int(ts[-1]) - int(ts[0])) // width >= most:
        width *= 2
    return np.append(np.flatnonzero(np.diff(ts // width)) + 1, len(ts))


def piece(p: Packets, hit: bool) -> tuple:
    """(first_us, last_us, n, hit, rows)."""
    return int(p.ts_us[0]), int(p.ts_us[-1]), len(p), hit, p.dumps()


def split(p: Packets) -> Iterator[tuple]:
    """The pieces of the packets of one source; those that meet no condition apart from the others."""
    hits = p.hits()
    for hit in (True, False):
        part = p.take(hits == hit)
        begin = 0
        for end in _ends(part.ts_us) if len(part) else ():
            yield piece(part.take(slice(begin, end)), hit)
            begin = end


def pieces(masks: list[str]):
    """A function for mapInArrow: packets with condition bits into pieces, per source."""
    schema = pa.schema([("src_ip", pa.string()), ("first_us", pa.int64()), ("last_us", pa.int64()), ("n", pa.int64()), ("hit", pa.bool_()), ("rows", pa.binary())])

    def number(column) -> np.ndarray:
        return column.cast(pa.int64()).fill_null(NO_PORT).to_numpy()

    def made(batches: list) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks()
        source = t["src_ip"].combine_chunks().dictionary_encode()
        if isinstance(source, pa.ChunkedArray):
            source = source.combine_chunks()
        code, names = source.indices.to_numpy(zero_copy_only=False), source.dictionary.to_pylist()
        whole = Packets(*(number(t[c]) for c in ("packet_id", "ts_us")), t["dst_ip"].to_pandas().to_numpy(object),
                        *(number(t[c]) for c in ("dst_port", "protocol")), [number(t[m]) for m in masks])
        order = np.lexsort((whole.packet_id, whole.ts_us, code))
        whole, code = whole.take(order), code[order]
        borders = np.append(np.flatnonzero(np.diff(code, prepend=code[0] - 1)), len(code))
        rows = [(names[code[a]], *x) for a, b in zip(borders[:-1], borders[1:]) for x in split(whole.take(slice(a, b)))]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= CHUNK_ROWS:
                yield made(held)
                held, n = [], 0
        if held:
            yield made(held)

    return run


def times_within(old: np.ndarray, counts: np.ndarray, new: np.ndarray, span: int) -> np.ndarray:
    """For each time of `new`, ascending: how many rows have come up to it and lie less than `span` back.

    `old` are earlier times, ascending, with how often each occurred.
    """
    before = np.concatenate([[0], np.cumsum(counts)])
    came = before[-1] + np.arange(1, len(new) + 1)
    return came - before[np.searchsorted(old, new - span, "right")] - np.searchsorted(new, new - span, "right")


def values_within(old_values: np.ndarray, old: np.ndarray, values: np.ndarray, new: np.ndarray, span: int) -> np.ndarray:
    """For each row of `new`, in order: how many different values have come up to it less than `span` back.

    A value counts from a row until `span` after its last one; `old` are times of earlier rows, ascending.
    """
    _, code = np.unique(np.concatenate([old_values, values]), return_inverse=True)
    at = np.concatenate([old, new])
    order = np.lexsort((np.arange(len(at)), code))
    same = code[order][1:] == code[order][:-1]
    near = same & (np.diff(at[order]) < span)
    begins, ends = np.ones(len(at), np.int64), np.ones(len(at), bool)
    begins[order[1:][near]] = 0
    ends[order[:-1][near]] = False
    gone = np.sort(at[ends] + span)
    return (np.cumsum(begins) - np.searchsorted(gone, at, "right"))[len(old):]


def openers(at: np.ndarray, last: int | None, span: int) -> tuple[np.ndarray, int | None]:
    """Which of the ascending times open: the first that is `span` or more after the last opener, and later than it."""
    out, span = np.zeros(len(at), bool), max(span, 1)
    i = 0 if last is None else int(np.searchsorted(at, last + span))
    while i < len(at):
        out[i], last = True, int(at[i])
        i = int(np.searchsorted(at, last + span))
    return out, last


class SourceState(StatefulProcessor):
    """`plan` is plain data: see `stream.plan_of`."""

    def __init__(self, plan: dict):
        self.plan = plan

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "first_us bigint, last_us bigint, n bigint, number int", "rows binary")
        self.windows = handle.getMapState("windows", "set int, second bigint", "content binary")
        self.fired = handle.getMapState("fired", "ord int", "ts_us bigint")
        self.passed = handle.getMapState("passed", "name int", "ts_us bigint")

    def close(self) -> None:
        pass

    # what comes in

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        due, numbers = [], {}
        for pdf in rows:
            for first, last, n, hit, data in zip(*(pdf[c].tolist() for c in ("first_us", "last_us", "n", "hit", "rows"))):
                if first < mark and mark > 0:
                    packets = Packets.loads(data)
                    late = packets.ts_us < mark
                    yield self._out("late", key[0], packets.take(late))
                    if late.all():
                        continue
                    first, last, n, hit, data = piece(packets.take(~late), hit)
                if hit:
                    due.append(first)
                    self._hold(first, last, n, data, numbers)
        if due:
            self.handle.registerTimer(min(due) // 1000 + 1)

    def _hold(self, first: int, last: int, n: int, data: bytes, numbers: dict) -> None:
        """Keep a piece; `numbers` counts the pieces of one range and size, which can be there from before."""
        number = numbers.get((first, last, n), 0)
        while self.pending.containsKey((first, last, n, number)):
            number += 1
        numbers[first, last, n] = number + 1
        self.pending.updateValue((first, last, n, number), (data,))

    # what becomes final, and what is forgotten

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.pending.keys())
        ready, due = [k for k in held if k[0] < mark], [k[0] // 1000 + 1 for k in held if k[0] >= mark]
        windows = {k: pickle.loads(v[0]) for k, v in self.windows.iterator()}
        fired = {k[0]: v[0] for k, v in self.fired.iterator()}
        passed = {k[0]: v[0] for k, v in self.passed.iterator()}
        before = windows.copy(), fired.copy(), passed.copy()
        rest = None
        for rows, rest, cut in self._stretches(ready, mark):
            closing = rows.packet_id == CLOSING
            if closing.any():
                yield self._out("end", key[0], rows.take(closing))
                rows = rows.take(~closing)
            if len(rows):
                yield from self._evaluate(key[0], rows, windows, fired, passed, cut)
            for k in [k for k in windows if self._window_end(k) <= cut]:
                del windows[k]
        if rest is not None and len(rest):
            first, last, n, _, data = piece(rest, True)
            due.append(first // 1000 + 1)
            self._hold(first, last, n, data, {})
        due += self._keep(mark, before, (windows, fired, passed))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due:
            self.handle.registerTimer(min(due))

    def _stretches(self, ready: list[tuple], mark: int) -> Iterator[tuple]:
        """The packets before `mark` in time order, about STRETCH_ROWS at once, as (packets, later ones of the pieces
        read so far, end of the stretch). Pieces are taken out of the state as they are read."""
        rest, i = None, 0
        while i < len(ready):
            parts, n = [rest] if rest is not None and len(rest) else [], 0
            while i < len(ready) and (n < STRETCH_ROWS or ready[i][0] == ready[i - 1][0]):
                parts.append(Packets.loads(self.pending.getValue(ready[i])[0]))
                self.pending.removeKey(ready[i])
                n += ready[i][2]
                i += 1
            cut = ready[i][0] if i < len(ready) else mark
            rows = Packets.concat(parts).sort()
            at = int(np.searchsorted(rows.ts_us, cut))
            rest = rows.take(slice(at, None))
            yield rows.take(slice(0, at)), rest, cut

    def _window_end(self, k: tuple) -> int:
        return (k[1] + 1) * US + self.plan["reach"][k[0]]

    def _keep(self, mark: int, before: tuple, now: tuple) -> list[int]:
        """Write what has changed, drop what no later packet can reach, and tell when the rest falls due (in ms)."""
        due = []
        ends = (lambda k, v: self._window_end(k), lambda k, v: v + self.plan["threat_us"] + 1, lambda k, v: v + self.plan["cooldown_us"])
        for state, old, new, end in zip((self.windows, self.fired, self.passed), before, now, ends):
            kept = {k: v for k, v in new.items() if end(k, v) > mark}
            own = (lambda k: k) if state is self.windows else (lambda k: (k,))
            for k in old.keys() - kept.keys():
                state.removeKey(own(k))
            for k, v in kept.items():
                due.append(-(-end(k, v) // 1000))
                if k not in old or old[k] is not v and (state is self.windows or old[k] != v):
                    state.updateValue(own(k), (pickle.dumps(v) if state is self.windows else v,))
        return due

    def _evaluate(self, src: str, rows: Packets, windows: dict, fired: dict, passed: dict, cut: int) -> Iterator[pd.DataFrame]:
        """The alerts of the packets, which all lie before `cut`; of the windows only what reaches `cut` is added."""
        plan, ts = self.plan, rows.ts_us
        bits = rows.masks
        has = lambda k: (bits[k // 62] >> (k % 62)) & 1 == 1
        there = [int(np.bitwise_or.reduce(b)) for b in bits]
        at, ords, counts = [], [], []                            # rows that fired, by which rule, with what count
        for k, o in plan["stateless"]:
            if there[k // 62] >> (k % 62) & 1:
                hit = np.flatnonzero(has(k))
                at.append(hit), ords.append(np.full(len(hit), o)), counts.append(np.full(len(hit), -1))
        for s, (k, track, rules) in enumerate(plan["sets"]):
            if not there[k // 62] >> (k % 62) & 1:
                continue
            values = getattr(rows, track) if track else None
            hit = np.flatnonzero(has(k) & (values != (NO_PORT if track == "dst_port" else None) if track else True))
            if not len(hit):
                continue
            new = ts[hit]
            held = [windows[x] for x in sorted(x for x in windows if x[0] == s)]
            old = np.concatenate([*(h[1] for h in held), np.empty(0, np.int64)])
            from_second = (cut - plan["reach"][s]) // US        # the first second that can reach `cut`
            tail = int(np.searchsorted(new, from_second * US))
            if track is None:
                times = np.concatenate([*(h[0] for h in held), np.empty(0, np.int64)])
                for o, least, span in rules:
                    n = times_within(times, old, new, span)
                    at.append(hit[n >= least]), ords.append(np.full((n >= least).sum(), o)), counts.append(n[n >= least])
                first, second = np.unique(new[tail:], return_counts=True)
                whens = first
            else:
                code, names = pd.factorize(values[hit])
                names = names.astype(str).astype(object)
                known = np.concatenate([*(h[0] for h in held), np.empty(0, object)])
                same, _ = pd.factorize(np.concatenate([known, names]))
                order = np.argsort(old, kind="stable")
                for o, least, span in rules:
                    n = values_within(same[:len(known)][order], old[order], same[len(known):][code], new, span)
                    at.append(hit[n >= least]), ords.append(np.full((n >= least).sum(), o)), counts.append(n[n >= least])
                # the last time of each value in each second
                last = np.lexsort((np.arange(len(new) - tail), code[tail:], new[tail:] // US))
                ends = np.append((np.diff(code[tail:][last]) != 0) | (np.diff(new[tail:][last] // US) != 0), True) if len(last) else np.empty(0, bool)
                first, second = names[code[tail:][last][ends]], new[tail:][last][ends]
                whens = second
            begin = 0
            for m, size in zip(*np.unique(whens // US, return_counts=True)):
                entry = first[begin:begin + size], second[begin:begin + size]
                if (s, int(m)) in windows:
                    entry = tuple(np.concatenate([x, y]) for x, y in zip(windows[s, int(m)], entry))
                windows[s, int(m)] = entry
                begin += size
        at, ords, counts = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (at, ords, counts))
        if not len(at):
            return
        order = np.lexsort((ords, at))
        at, ords, counts = at[order], ords[order], counts[order]
        old = sorted((t, o) for o, t in fired.items())
        active = values_within(np.array([o for _, o in old], np.int64), np.array([t for t, _ in old], np.int64), ords, ts[at], plan["threat_us"] + 1)
        for o in np.unique(ords):
            fired[int(o)] = int(ts[at[ords == o]].max())
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        alert = at[first]
        packed = np.minimum.reduceat(np.array(plan["place"])[ords] * plan["count_space"] + counts + 1, first)
        name = np.array(plan["names"])[np.array(plan["order"])[packed // plan["count_space"]]]
        passes = np.ones(len(alert), bool)
        if plan["cooldown_us"] >= 0 and plan["live"]:
            for n in np.unique(name):
                own = np.flatnonzero(name == n)
                passes[own], last = openers(ts[alert[own]], passed.get(int(n)), plan["cooldown_us"])
                if last != passed.get(int(n)):
                    passed[int(n)] = last
        active, fires = np.maximum.reduceat(active, first), []
        for m in range(plan["rule_masks"]):
            inside = ords // 62 == m
            fires.append(np.bitwise_or.reduceat(np.where(inside, np.int64(1) << (ords % 62), 0), first)[passes])
        out = self._out("alert", src, rows.take(alert[passes]), packed=packed[passes], active=active[passes], passed=True)
        for m, fire in enumerate(fires):
            out[f"m{m}"] = fire
        yield out
        if not passes.all():            # those held back are only counted, in place of a packet_id
            yield self._out("held", src, rows.take(slice(0, 1))).assign(packet_id=int((~passes).sum()))

    def _out(self, kind: str, src: str, rows: Packets, **columns) -> pd.DataFrame:
        whole = lambda v: pd.arrays.IntegerArray(v.astype(np.int32), v == NO_PORT)
        out = pd.DataFrame({"kind": kind, "packet_id": rows.packet_id, "ts_us": rows.ts_us, "src_ip": src,
                            "dst_ip": rows.dst_ip, "dst_port": whole(rows.dst_port), "protocol": whole(rows.protocol)})
        for name in ("packed", "active", "passed"):
            out[name] = columns.get(name, None)
        for m in range(self.plan["rule_masks"]):
            out[f"m{m}"] = None
        return out


DIGEST = "batch_id bigint, n bigint, top struct<r: int, ts_us: bigint, packet_id: bigint, rule: string, severity: string>"


class OpenBatch(StatefulProcessor):
    """The open notification batch of one channel: its start, its size and its leading alert.

    A batch takes every alert less than `span_us` after its first; it comes out when an alert opens the next one,
    when the watermark has passed its end, or when the stream closes.
    """

    def __init__(self, span_us: int):
        self.span_us = span_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", DIGEST)

    def close(self) -> None:
        pass

    def _row(self, channel, start, n, top):
        return pd.DataFrame({"channel": [channel], "batch_id": [start], "n": [n], "top": [dict(zip(("r", "ts_us", "packet_id", "rule", "severity"), top))]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.open.get() if self.open.exists() else None
        start, n, top = (held[0], held[1], tuple(held[2])) if held else (None, 0, None)
        for pdf in [pd.concat(list(rows)).sort_values(["ts_us", "packet_id"], kind="stable")]:
            alerts = pdf[pdf["kind"] == "alert"]
            for ts, i, rule, severity, rank in zip(*(alerts[c].tolist() for c in ("ts_us", "packet_id", "rule", "severity", "rank"))):
                if start is None or ts >= start + self.span_us:
                    if start is not None:
                        yield self._row(key[0], start, n, top)
                    start, n, top = ts, 0, None
                own = (-rank, ts, i, rule, severity)
                n, top = n + 1, own if top is None else min(top, own)
            if start is not None and (pdf["kind"] == "end").any():
                yield self._row(key[0], start, n, top)
                start = None
        self._keep(start, n, top)

    def _keep(self, start, n, top) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if start is None:
            self.open.clear()
        else:
            self.open.update((start, n, top))
            self.handle.registerTimer(-(-(start + self.span_us) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            start, n, top = self.open.get()
            yield self._row(key[0], start, n, tuple(top))
            self.open.clear()
