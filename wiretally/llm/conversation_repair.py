"""Repair of a conversation's structure by a parallel Viterbi with rank convergence.

Each turn is kept, given the other role or deleted, and empty turns are inserted, at least cost, until the role
initials read `(s?(ua)+)?`. A turn is a 4x4 min-plus map of the costs of what follows; a conversation is cut into
chunks. Every chunk first runs backwards from a speculative vector, as if the conversation ended behind it. Fix-up
passes hand each chunk the vector its successor came to; the chunk runs from there only until the new vector and
the old differ by a constant, behind which nothing but that constant changes. Passes end when no chunk's vector
changes. Every chunk then traces the least audit for each state it may be entered in, against the stitched costs;
entries follow by composing the chunks' state maps in doubling steps. Conversations of one chunk need no pass.

What goes through joins are one-byte codes of the turns, a bounded number per chunk. Texts are shuffled twice: by
range, so that a long conversation is spread over partitions, and at the end by conversation, to be streamed in
order past the edits; a digest over a whole conversation cannot be put together from parts, so that stream is one
task's, with the memory of a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.llm.shared import cut

CHUNK = 256              # turns of a chunk
CELLS = 1 << 16          # turns, padding included, that a task works on at a time
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"

# States: nothing yet, after the system turn, after a user turn, after an assistant turn.
NEXT = np.array([2, 2, 3, 2])            # state behind a user or assistant turn, whichever may follow
END = np.array([0, 2 * INSERT, INSERT, 0])   # cost of ending here, with the turns that must be inserted
NEVER = 1 << 40
SYSTEM, USER, ASSISTANT = 1, 2, 3        # code of a role's initial, 0: another
BLANK, DUPLICATE, CUT_OFF = 1, 2, 3      # faults; a turn's code is initial + 4 * fault


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code and state: cost of keeping, state behind it, cost of giving the other role."""
    keep, to, rerole = np.full((17, 4), NEVER), np.tile(NEXT, (17, 1)), np.full((17, 4), NEVER)
    for code in range(16):
        initial, fault = code % 4, code // 4
        if fault in (BLANK, DUPLICATE):
            continue
        extra = TRUNCATED * (fault == CUT_OFF)
        rerole[code] = REROLE + extra
        for q in range(4):
            if initial == SYSTEM and q == 0:
                keep[code, q], to[code, q] = extra, 1
            elif initial in (USER, ASSISTANT) and NEXT[q] == initial:
                keep[code, q] = extra
    return keep, to, rerole


KEEP, TO, OTHER = _tables()
PAD = 16                 # code of no turn


def _inserted(cost: np.ndarray) -> np.ndarray:
    """Costs [..., 4] when turns may be inserted first; two inserted turns lead back to where the first began."""
    for _ in range(2):
        cost = np.minimum(cost, INSERT + cost[..., NEXT])
    return cost


def step(code: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Costs [chunks, 4] before a turn from those behind it."""
    kept = KEEP[code] + np.take_along_axis(cost, TO[code], 1)
    best = np.minimum(np.minimum(DELETE + cost, kept), OTHER[code] + cost[:, NEXT])
    return np.where((code == PAD)[:, None], cost, _inserted(best))


def _grids(codes: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, codes [chunks, turns]) of chunks of similar length, padded behind the end."""
    sizes = np.array([len(c) for c in codes], np.int64)
    order, first = np.argsort(-sizes, kind="stable"), 0
    while first < len(order):
        width = max(1, sizes[order[first]])
        at = order[first:first + max(1, CELLS // width)]
        grid = np.full((len(at), width), PAD, np.int64)
        for row, i in zip(grid, at):
            row[:sizes[i]] = codes[i]
        yield at, grid
        first += len(at)


def backward(codes: list[np.ndarray], came: np.ndarray) -> np.ndarray:
    """Costs [chunks, 4] before each chunk's first turn, from those behind its last."""
    out = came.copy()
    for at, grid in _grids(codes):
        cost = came[at]
        for i in range(grid.shape[1] - 1, -1, -1):
            cost = step(grid[:, i], cost)
        out[at] = cost
    return out


def fixed_up(codes: list[np.ndarray], was: np.ndarray, came: np.ndarray, went: np.ndarray) -> np.ndarray:
    """`backward(codes, came)`, known that `was` went to `went`: runs until both vectors are parallel."""
    out = went.copy()
    for at, grid in _grids(codes):
        old, new, alive = was[at], came[at], np.ones(len(at), bool)
        for i in range(grid.shape[1] - 1, -1, -1):
            apart = new - old
            parallel = alive & (apart == apart[:, :1]).all(1)
            out[at[parallel]] = went[at[parallel]] + apart[parallel, :1]
            alive &= ~parallel
            if not alive.any():
                break
            old[alive], new[alive] = step(grid[alive, i], old[alive]), step(grid[alive, i], new[alive])
        out[at[alive]] = new[alive]
    return out


def traced(codes: list[np.ndarray], came: np.ndarray, ends: np.ndarray, entries: int) -> tuple[list[list[str]], np.ndarray]:
    """Least audit of each chunk for each of the first `entries` states it may be entered in, and the states left in.

    `came` are true costs behind the chunk, up to a constant; `ends`: whether the conversation ends there, so that
    missing turns are inserted.
    """
    audits, exits = [None] * len(codes), np.zeros((len(codes), entries), np.int64)
    for at, grid in _grids(codes):
        costs = [came[at]]
        for i in range(grid.shape[1] - 1, -1, -1):
            costs.append(step(grid[:, i], costs[-1]))
        costs.reverse()
        q, letters = np.tile(np.arange(entries), (len(at), 1)), []
        of = lambda cost, state: np.take_along_axis(cost, state, 1)
        for i in range(grid.shape[1]):
            code, here, behind = grid[:, i], costs[i], costs[i + 1]
            there = (code != PAD)[:, None]
            while True:
                delete = of(here, q) == DELETE + of(behind, q)
                insert = there & ~delete & (of(here, q) == INSERT + of(here, NEXT[q]))
                if not insert.any():
                    break
                letters.append(np.where(insert, ord("I"), 0))
                q = np.where(insert, NEXT[q], q)
            keep = of(here, q) == of(KEEP[code], q) + of(behind, of(TO[code], q))
            letters.append(np.where(there, np.where(delete, ord("D"), np.where(keep, ord("K"), ord("R"))), 0))
            q = np.where(~there | delete, q, np.where(keep, of(TO[code], q), NEXT[q]))
        last = ends[at][:, None]
        while (insert := last & (END[q] > 0)).any():
            letters.append(np.where(insert, ord("I"), 0))
            q = np.where(insert, NEXT[q], q)
        every, exits[at] = np.stack(letters, -1).astype(np.uint8), q
        for row, i in zip(every, at):
            audits[i] = [x[x > 0].tobytes().decode() for x in row]
    return audits, exits


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (key, turn, role, text) with the faults that the crc32 of `conv_id:turn`, modulo 20, brings in: 0 drops a
    row, 1 empties its text, 2 takes `.!?` out of it, 3 repeats it, 4 sets role user. A null counts as one space."""
    key, text = named()
    h = F.crc32(F.concat(key, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    rows = conversations.select(
        key.alias("key"), F.col("turn").cast("long").alias("turn"), h.alias("h"), F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h == 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"))
    return rows.where("h <> 0").withColumn("again", F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("h", "again")


def named() -> tuple[Column, Column]:
    """A conversation's key, a space for a null id, and a turn's text."""
    return F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows (key, turn, role, text) with the hash of the text, the code without duplicates, and `seq`, ascending in the
    order of (key, turn, role, hash), nulls first; numbers of one conversation in one partition follow each other."""
    core = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0) + 4 * (
        F.when(core == "", BLANK).when(F.right(core, F.lit(1)).isin(".", "!", "?"), 0).otherwise(CUT_OFF))
    order = ["key", "turn", "role", "hash"]
    placed = rows.withColumns({"hash": F.md5(F.col("text").cast("binary")), "code": code.cast("int")}).repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(placed.withColumn("seq", F.monotonically_increasing_id()), "turns")


def chunked(rows: DataFrame) -> DataFrame:
    """Chunks of the numbered rows: key, no (from 0), chunks (of the conversation), at (seq of the first turn), codes."""
    slim = rows.select("key", "role", "hash", "code", "seq")
    same = ["key", "role", "hash"]
    firsts = slim.where(f"code div 4 <> {BLANK}").groupBy(*same).agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    part = F.shiftright("seq", 33).alias("part")
    coded = slim.join(firsts, same, "left").select("key", "seq", part, F.when(F.col("seq") > F.col("first"), F.col("code") % 4 + 4 * DUPLICATE).otherwise(F.col("code")).alias("code"))
    # at most one row per conversation and partition
    spans = slim.select("key", "seq", part).groupBy("key", "part").agg(F.min("seq").alias("lo"), F.count("*").alias("n")).selectExpr(
        "key", "part", "lo", "sum(n) OVER (PARTITION BY key ORDER BY part) - n AS before", "sum(n) OVER (PARTITION BY key) AS turns")
    placed = coded.join(spans, ["key", "part"]).selectExpr("key", "seq", "code", "turns", f"(seq - lo + before) div {CHUNK} AS no")
    chunks = placed.groupBy("key", "no").agg(
        F.ceil(F.first("turns") / CHUNK).alias("chunks"), F.min("seq").alias("at"), F.sort_array(F.collect_list(F.struct("seq", "code"))).alias("codes"))
    return cut(chunks.withColumn("codes", F.expr("transform(codes, x -> CAST(x.code AS TINYINT))")), "chunks")


def _codes(batch: pa.RecordBatch) -> list[np.ndarray]:
    c = batch.column("codes")
    flat, offsets = c.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return [flat[a:b] for a, b in zip(offsets, offsets[1:])]


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, 4)


def _column(x: np.ndarray) -> pa.Array:
    return pa.array(x.tolist(), pa.list_(pa.int64()))


CHUNKS = "key string, no long, chunks long, at long, codes array<tinyint>"
ACCEPT = "array(" + ", ".join(f"{x}L" for x in END) + ")"


def _with(batch: pa.RecordBatch, drop: tuple = (), **columns) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in drop and n not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns.values()], names=[*names, *columns])


def stitched(chunks: DataFrame) -> DataFrame:
    """Chunks with `came`, the costs behind them less the first, and `went`, the costs before them."""

    def speculate(batches):
        for batch in batches:
            came = np.tile(END, (batch.num_rows, 1))
            yield _with(batch, came=_column(came), went=_column(backward(_codes(batch), came)))

    def fix_up(batches):
        for batch in batches:
            was, due, went = (_vectors(batch, n) for n in ("came", "due", "went"))
            at = np.flatnonzero((was != due).any(1))
            if len(at):
                codes = _codes(batch)
                went[at] = fixed_up([codes[i] for i in at], was[at], due[at], went[at])
            changed = np.zeros(batch.num_rows, bool)
            changed[at] = True
            yield _with(batch, ("due",), came=_column(due), went=_column(went), changed=pa.array(changed))

    schema = CHUNKS + ", came array<long>, went array<long>"
    out = cut(chunks.mapInArrow(speculate, schema), "costs")
    while True:
        due = out.select("key", (F.col("no") - 1).alias("no"), F.expr("transform(went, x -> x - went[0]) AS due"))
        met = out.join(due, ["key", "no"], "left").selectExpr("key", "no", "chunks", "at", "codes", "came", "went", f"coalesce(due, {ACCEPT}) AS due")
        out = cut(met.mapInArrow(fix_up, schema + ", changed boolean"), "costs")
        if out.where("changed").isEmpty():
            return out.drop("changed")
        out = out.drop("changed")


PIECE = "key string, at long, audit string, cost long, blank long, duplicate long, truncated long"


def _pieces(batch: pa.RecordBatch, codes: list[np.ndarray], audits: list[str], cost: np.ndarray) -> pa.RecordBatch:
    faults = np.array([np.bincount(c // 4, minlength=4) for c in codes], np.int64).reshape(-1, 4)
    return pa.RecordBatch.from_arrays(
        [batch.column("key"), batch.column("at"), pa.array(audits, pa.string()), pa.array(cost), *(pa.array(faults[:, k]) for k in (BLANK, DUPLICATE, CUT_OFF))],
        names=["key", "at", "audit", "cost", "blank", "duplicate", "truncated"])


def audited(chunks: DataFrame) -> DataFrame:
    """Per chunk: its part of the conversation's least audit, its share of the cost, its faults."""

    def alone(batches):
        for batch in batches:
            codes, end = _codes(batch), np.tile(END, (batch.num_rows, 1))
            audits, _ = traced(codes, end, np.ones(len(codes), bool), 1)
            yield _pieces(batch, codes, [a[0] for a in audits], backward(codes, end)[:, 0])

    def through(batches):
        for batch in batches:
            ends = batch.column("no").to_numpy() == batch.column("chunks").to_numpy() - 1
            audits, exits = traced(_codes(batch), _vectors(batch, "came"), ends, 4)
            yield _with(batch, ("came",), audits=pa.array(audits, pa.list_(pa.string())), leads=_column(exits))

    def chosen(batches):
        for batch in batches:
            audits = [a[q] for a, q in zip(batch.column("audits").to_pylist(), batch.column("entry").to_pylist())]
            yield _pieces(batch, _codes(batch), audits, _vectors(batch, "went")[:, 0])

    single = chunks.where("chunks = 1").mapInArrow(alone, PIECE)
    several = chunks.where("chunks > 1")
    longest = several.agg(F.max("chunks")).first()[0]
    if longest is None:
        return single
    ways = cut(stitched(several).mapInArrow(through, CHUNKS + ", went array<long>, audits array<string>, leads array<long>"), "ways")
    # leads: from a chunk's entry state to its exit; after each step, from that of the chunk `reach` places before
    leads, reach = ways.select("key", "no", "leads"), 1
    while reach < longest:
        before = leads.select("key", (F.col("no") + reach).alias("no"), F.col("leads").alias("first"))
        leads = cut(leads.join(before, ["key", "no"], "left").selectExpr(
            "key", "no", "CASE WHEN first IS NULL THEN leads ELSE transform(first, q -> leads[CAST(q AS INT)]) END AS leads"), "leads")
        reach *= 2
    entry = leads.selectExpr("key", "no + 1 AS no", "leads[0] AS entry")
    found = ways.join(entry, ["key", "no"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    return single.unionByName(found.mapInArrow(chosen, PIECE))


STREAM = "key string, seq long, kind int, conv_id long, turn long, role string, text string, audit string, cost long, blank long, duplicate long, truncated long"


def streamed(conversations: DataFrame) -> DataFrame:
    """Everything about a conversation in one partition, in order: a row (kind -1) for it, and for every chunk its
    piece of the audit (0), followed by the turns (1)."""
    rows = numbered(damaged(conversations))
    pieces = audited(chunked(rows))
    key, _ = named()
    heads = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), key.alias("key")).distinct()
    every = heads.withColumns({"seq": F.lit(-1).cast("long"), "kind": F.lit(-1)}).unionByName(
        pieces.withColumnRenamed("at", "seq").withColumn("kind", F.lit(0)), allowMissingColumns=True).unionByName(
        rows.select("key", "seq", F.lit(1).alias("kind"), "turn", "role", "text"), allowMissingColumns=True)
    cols = [c.split()[0] for c in STREAM.split(", ")]
    return every.select(*cols).repartition("key").sortWithinPartitions("key", "seq", "kind")


class _Conversation:
    """What has been seen of a conversation: its report so far, and the edits that wait for their turns."""

    def __init__(self, conv_id):
        self.conv_id, self.pending, self.state, self.place = conv_id, "", 0, 0
        self.audit, self.counts = [], [0, 0, 0, 0]
        self.low = self.high = self.turn = self.initial = None
        self.turns = self.illegal = 0

    def piece(self, audit: str, counts: list[int]):
        self.audit.append(audit)
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        yield from self.inserted()
        self.pending = audit

    def inserted(self):
        """Turns inserted before the next one of the conversation."""
        while self.pending[:1] == "I":
            yield from self.edited("I", None, ("user", "assistant")[self.state == 2], "")
            self.pending = self.pending[1:]

    def edited(self, letter, turn, role, text):
        self.state = 1 if letter == "K" and role[:1] == "s" else self.state if letter == "D" else int(NEXT[self.state])
        self.place += 1
        yield self.conv_id, self.place, letter, turn, role, text

    def row(self, turn, role, text):
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high or self.high is None
            self.high = turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        yield from self.inserted()
        letter, self.pending = self.pending[0], self.pending[1:]
        yield from self.edited(letter, turn, role if letter in "DK" else ("user", "assistant")[self.state == 2], text)

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[_Conversation], list[tuple]]]:
    """Per batch: conversations that have ended, each after all its edits, and edits (conv_id, place, edit, turn, role, text)."""
    now = None
    for batch in batches:
        out = []
        for kind, conv_id, turn, role, text, audit, *counts in zip(*(batch.column(c).to_pylist() for c in (
                "kind", "conv_id", "turn", "role", "text", "audit", "cost", "blank", "duplicate", "truncated"))):
            if kind == -1:
                if now is not None:
                    out += [*now.inserted(), now]
                now = _Conversation(conv_id)
            elif kind == 0:
                out += now.piece(audit, counts)
            else:
                out += now.row(turn, role, text)
        yield out
    if now is not None:
        yield [*now.inserted(), now]


def repaired(conversations: DataFrame) -> DataFrame:
    """The edits of every conversation in order: conv_id, place (from 1), edit (K, R, D, I), turn, role, text.

    Rows without D are the repaired conversation. Nulls count as one space, a null conv_id is a conversation of its
    own. Turns with equal numbers are taken in the order of role, then of the text's MD5; repeated rows are duplicates.
    """

    def run(batches):
        for events in _replayed(batches):
            rows = [e for e in events if isinstance(e, tuple)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()))], names=["conv_id", "place", "edit", "turn", "role", "text"])

    return streamed(conversations).mapInArrow(run, "conv_id long, place long, edit string, turn long, role string, text string")


def reported(conversations: DataFrame) -> DataFrame:
    """One row per conversation: faults, cost and least audit of its repair, SHA-256 of the repaired turns.

    A conversation that lost all its rows has zeros, an empty audit and the hash of the empty text.
    """
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches):
        digest, lines = hashlib.sha256(), 0
        for events in _replayed(batches):
            out = []
            for e in events:
                if isinstance(e, tuple):
                    if e[2] != "D":
                        digest.update(("\n" * (lines > 0) + f"{e[4]}:{e[5]}").encode("utf-8"))
                        lines += 1
                else:
                    cost, *faults = e.counts
                    out.append((e.conv_id, e.gaps(), *faults, e.illegal, cost, "".join(e.audit), digest.hexdigest()))
                    digest, lines = hashlib.sha256(), 0
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if i < 7 else pa.string()) for i in range(9)], names=names)

    return streamed(conversations).mapInArrow(run, ", ".join(f"{n} {'long' if i < 7 else 'string'}" for i, n in enumerate(names)))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reported(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
