"""Language model scoring by a hidden Markov model.

Symbols: each of the most frequent training words is a symbol of its own; any other word
has the symbol of its ending (a hash of its last bytes); the end of a text is a symbol.
The HMM generates symbols, and a word of a shared symbol is then drawn from the smoothed
counts of the words that share it, so a text's probability is exact and sums to one.

Training is Baum-Welch over whole texts: every iteration is one pass over all training
texts, each task adds up expected counts, and the sums are merged in two steps. Texts are
cut into windows that are run side by side, so one NumPy step advances thousands of them.
A window starts from a guess and is run again, from its neighbour's vector, until its states
agree with those it had, so nothing is lost at a border. Iterations end when the likelihood
gains little. Scoring runs the scaled forward recursion in the same way.

Counts of the KNOWN most frequent words are broadcast, those of all others joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.llm.shared import cut, fold, slices, words_of

STATES = 12
OWN_WORDS = 8192       # words with a symbol of their own
ENDINGS = 512          # symbols shared by all other words
KNOWN = 65536          # words whose counts every task knows
ITERATIONS = 4         # passes over all training texts at most
GAIN = 0.003           # gain of log10 likelihood a token below which training ends
WINDOW = 64            # tokens of a window
CELLS = 1 << 17        # tokens, padding included, that are run side by side
SETTLED = 1e-6         # change of a window's given vector that still makes it run again
SEED = 11


@dataclass
class Symbols:
    """own: word -> symbol, most frequent first; then the endings, then the end of text."""

    own: dict[bytes, int]
    endings: int = ENDINGS

    @property
    def end(self) -> int:
        return len(self.own) + self.endings

    @property
    def count(self) -> int:
        return self.end + 1

    def shared(self, word: bytes) -> int:
        return len(self.own) + crc32(word[-3:]) % self.endings

    def encode(self, words: list[bytes]) -> np.ndarray:
        """The symbol of each word."""
        own = self.own
        return np.array([own[w] if w in own else self.shared(w) for w in words], np.int32)


@dataclass
class Model:
    start: np.ndarray      # [K]
    move: np.ndarray       # [K, K]
    emit: np.ndarray       # [K, symbols]

    @cached_property
    def by_symbol(self) -> np.ndarray:
        return np.ascontiguousarray(self.emit.T)

    def fast(self) -> "Model":
        """The same in single precision, for training."""
        return Model(*(x.astype(np.float32) for x in (self.start, self.move, self.emit)))


def lanes(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences as columns, longest first, padded with zeros; lengths and the order."""
    length = np.array([len(c) for c in codes])
    order = np.argsort(-length, kind="stable")
    table = np.zeros((length.max(initial=0), len(codes)), np.int32)
    for j, i in enumerate(order):
        table[:length[i], j] = codes[i]
    return table, length[order], order


def windows(codes: np.ndarray) -> list[np.ndarray]:
    return [codes[i:i + WINDOW] for i in range(0, len(codes), WINDOW)]


def sums(x: np.ndarray) -> np.ndarray:
    """Sum of each row; a product is several times quicker than a reduction over few columns."""
    return x @ np.ones(x.shape[1], x.dtype)


def stationary(move: np.ndarray) -> np.ndarray:
    p = np.full(len(move), 1 / len(move))
    for _ in range(60):
        p = p @ move
    return p


def buffers(codes: list[np.ndarray]) -> Iterator[tuple[list[np.ndarray], np.ndarray, list[int]]]:
    """Windows of whole texts, some CELLS of tokens at a time (a longer text is alone), whether each begins its text,
    and which texts they are of."""
    parts, first, of = [], [], []
    for i, c in enumerate(codes):
        w = windows(c)
        if parts and (len(parts) + len(w)) * WINDOW > CELLS:
            yield parts, np.array(first), of
            parts, first, of = [], [], []
        parts += w
        first += [True] + [False] * (len(w) - 1)
        of += [i] * len(w)
    if parts:
        yield parts, np.array(first), of


def _ends(model: Model, codes: list[np.ndarray], due: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State distribution behind each window's last token and log10 probability of its tokens, from the distributions
    before them, by the scaled forward recursion."""
    table, length, order = lanes(codes)
    by_symbol = model.by_symbol
    total, state, live = np.zeros(len(codes)), due[order].copy(), len(codes)
    for t in range(len(table)):
        live = np.searchsorted(-length[:live], -t, side="left")
        a = state[:live] if t == 0 else state[:live] @ model.move
        a = a * by_symbol[table[t, :live]]
        scale = a.sum(1)
        total[:live] += np.log10(scale)
        state[:live] = a / scale[:, None]
    came, log_p = np.empty_like(state), np.empty(len(codes))
    came[order], log_p[order] = state, total
    return came, log_p


def _starts(model: Model, codes: list[np.ndarray], then: np.ndarray) -> np.ndarray:
    """How likely each window's tokens and what follows are from each state before them, up to a factor."""
    table, length, order = lanes(codes)
    by_symbol = model.by_symbol
    back, out = then[order].copy(), np.empty_like(then)
    for t in range(len(table) - 1, -1, -1):
        m = np.searchsorted(-length, -t, side="left")
        b = by_symbol[table[t, :m]] * back[:m]
        b = b @ model.move.T
        back[:m] = b / b.sum(1, keepdims=True)
    out[order] = back
    return out


def before(model: Model, parts: list[np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: the states' distributions behind the token before it (zero at a text's start) and before its
    first token, and the log10 probability of its tokens given all before them."""
    due = np.where(first[:, None], model.start, stationary(model.move).astype(model.start.dtype))
    came, log_p, again = np.zeros_like(due), np.zeros(len(parts)), np.arange(len(parts))
    inner = np.flatnonzero(~first)
    while len(again):
        came[again], log_p[again] = _ends(model, [parts[i] for i in again], due[again])
        given = came[inner - 1] @ model.move
        moved = np.abs(given - due[inner]).max(1, initial=0) > SETTLED
        again = inner[moved]
        due[again] = given[moved]
    behind_last = np.zeros_like(came)
    behind_last[inner] = came[inner - 1]
    return behind_last, due, log_p


def behind(model: Model, parts: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """Of each window: how likely what follows it is from each state at its last token, up to a factor."""
    k = len(model.start)
    then, head, again = np.full((len(parts), k), 1 / k, model.start.dtype), np.empty((len(parts), k), model.start.dtype), np.arange(len(parts))
    inner = np.flatnonzero(~first)
    while len(again):
        head[again] = _starts(model, [parts[i] for i in again], then[again])
        given = head[inner]
        moved = np.abs(given - then[inner - 1]).max(1, initial=0) > SETTLED
        again = inner[moved] - 1
        then[again] = given[moved]
    return then


class Side:
    """Windows of whole texts side by side, at most CELLS tokens, with all their state vectors.

    Every window is run once from a guess. Where its neighbour gives another vector it is run again, until its states
    agree with those there: from then on nothing would change.
    """

    def __init__(self, model: Model, parts: list[np.ndarray], first: np.ndarray):
        self.model = model
        self.table, self.length, self.order = lanes(parts)
        self.steps, self.n = self.table.shape
        self.begins = first[self.order]
        place = np.empty(self.n, np.int64)
        place[self.order] = np.arange(self.n)
        self.inner = np.flatnonzero(~self.begins)
        self.prior = place[self.order[self.inner] - 1]           # lanes of the windows before those
        self.live = np.searchsorted(-self.length, -np.arange(self.steps), side="left")     # lanes that are longer than t
        self.seen = model.by_symbol.take(self.table, 0)          # [T, n, K]

    @staticmethod
    def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Relative, as a small part of a vector may grow later."""
        return sums((np.abs(a - b) > SETTLED * b).astype(a.dtype)) > 0

    def came(self) -> np.ndarray:
        """Distributions behind the token before each window, zero at a text's start."""
        out = np.zeros_like(self.alpha[0])
        out[self.inner] = self.alpha[self.length[self.prior] - 1, self.prior]
        return out

    def forward(self) -> None:
        """alpha [T, n, K]: distribution behind each token; scale [T, n]: probability of each token given those before."""
        move, seen = self.model.move, self.seen
        alpha, scale = np.zeros_like(seen), np.ones(seen.shape[:2], seen.dtype)
        self.alpha, self.scale = alpha, scale
        due = np.where(self.begins[:, None], self.model.start, stationary(move).astype(move.dtype))
        for t, m in enumerate(self.live):
            a = (due if t == 0 else alpha[t - 1, :m] @ move) * seen[t, :m]
            scale[t, :m] = sums(a)
            np.divide(a, scale[t, :m, None], out=alpha[t, :m])
        while True:
            given = self.came()[self.inner] @ move
            moved = np.abs(given - due[self.inner]).max(1, initial=0) > SETTLED
            on, state = self.inner[moved], given[moved]
            if not len(on):
                return
            due[on] = state
            for t in range(self.steps):
                there = self.length[on] > t
                on, state = on[there], state[there]
                if not len(on):
                    break
                a = (state if t == 0 else state @ move) * seen[t, on]
                total = sums(a)
                a /= total[:, None]
                differ = self._differ(a, alpha[t, on])
                alpha[t, on], scale[t, on] = a, total
                on, state = on[differ], a[differ]

    def backward(self) -> None:
        """beta [T, n, K]: how likely what follows each token is from each state at it, up to a factor."""
        back_move, seen, k = self.model.move.T, self.seen, self.seen.shape[2]
        beta, then = np.zeros_like(seen), np.full((self.n, k), 1 / k, seen.dtype)
        self.beta, head = beta, then.copy()
        for t in range(self.steps - 1, -1, -1):
            m = self.live[t]
            beta[t, :m] = head[:m]
            b = (seen[t, :m] * head[:m]) @ back_move
            np.divide(b, sums(b)[:, None], out=head[:m])
        while True:
            given = head[self.inner]
            moved = np.abs(given - then[self.prior]).max(1, initial=0) > SETTLED
            on, state = self.prior[moved], given[moved]
            if not len(on):
                return
            then[on] = state
            for t in range(self.steps - 1, -1, -1):              # a window with one behind it is full
                differ = self._differ(state, beta[t, on])
                on, state = on[differ], state[differ]
                if not len(on):
                    break
                beta[t, on] = state
                b = (seen[t, on] * state) @ back_move
                state = b / sums(b)[:, None]
            else:
                head[on] = state


def forward(model: Model, codes: list[np.ndarray]) -> np.ndarray:
    """Log10 probability of each sequence."""
    out = np.zeros(len(codes))
    for parts, first, of in buffers(codes):
        if len(parts) * WINDOW <= CELLS:
            side = Side(model, parts, first)
            side.forward()
            log_p = np.empty(len(parts))
            log_p[side.order] = np.log10(side.scale).sum(0)
        else:
            log_p = before(model, parts, first)[2]
        np.add.at(out, of, log_p)
    return out


class Counts:
    """Expected starts, moves (without the factor of the move itself) and emissions, and the log10 likelihood."""

    def __init__(self, model: Model):
        self.model, (k, symbols) = model, model.emit.shape
        self.start, self.moves, self.emit, self.log_p = np.zeros(k), np.zeros((k, k)), np.zeros((k, symbols)), 0.0
        self.fast = model.fast()
        self.by_symbol, self.move = self.fast.by_symbol, self.fast.move

    def add(self, codes: list[np.ndarray]) -> None:
        """Forward and backward over whole sequences."""
        for parts, first, _ in buffers(codes):
            if len(parts) * WINDOW <= CELLS:
                self._add_whole(Side(self.fast, parts, first))
                continue
            # a text that is too long for all its vectors
            (came, due, log_p), then = before(self.fast, parts, first), behind(self.fast, parts, first)
            self.log_p += log_p.sum()
            for j in range(0, len(parts), CELLS // WINDOW):
                own = slice(j, j + CELLS // WINDOW)
                self._add(parts[own], came[own], due[own], then[own], first[own])

    def _add_whole(self, side: Side) -> None:
        side.forward()
        side.backward()
        k = len(self.start)
        gamma = side.alpha * side.beta
        total = sums(gamma.reshape(-1, k)).reshape(gamma.shape[:2])
        total[total == 0] = 1                                    # padding
        gamma /= total[..., None]
        back = side.seen
        back *= side.beta
        back /= (side.scale * total)[..., None]
        self.moves += side.alpha[:-1].reshape(-1, k).T @ back[1:].reshape(-1, k) + side.came().T @ back[0]
        self._emitted(side.table, gamma)
        self.start += gamma[0][side.begins].sum(0)
        self.log_p += np.log10(side.scale).sum(dtype=np.float64)

    def _emitted(self, table: np.ndarray, gamma: np.ndarray) -> None:
        flat = table.ravel().astype(np.intp)
        for own, weight in zip(self.emit, gamma.reshape(len(flat), -1).T):
            own += np.bincount(flat, weight, len(own))

    def _add(self, codes, came, due, then, begins) -> None:
        """Sequences given the distributions behind the token before them (zero at a text's start) and before their
        first token, and the likelihood of what follows from each state."""
        table, length, order = lanes(codes)
        n, steps, k = len(codes), len(table), len(self.start)
        came, begins = came[order].astype(np.float32), begins[order]
        live = np.searchsorted(-length, -np.arange(steps), side="left")     # lanes that are longer than t
        seen = self.by_symbol[table]                                # [T, n, K]
        alpha, gamma = np.empty((steps, n, k), np.float32), np.zeros((steps, n, k), np.float32)
        a = due[order].astype(np.float32) * seen[0]
        for t in range(steps):
            m = live[t]
            if t:
                a = alpha[t - 1, :m] @ self.move
                a *= seen[t, :m]
            scale = a.sum(1, keepdims=True)
            np.divide(a, scale, out=alpha[t, :m])
            seen[t, :m] /= scale
        beta = then[order].astype(np.float32)
        beta /= (alpha[length - 1, np.arange(n)] * beta).sum(1, keepdims=True)
        for t in range(steps - 1, -1, -1):
            m = live[t]
            np.multiply(alpha[t, :m], beta[:m], out=gamma[t, :m])
            back = seen[t, :m] * beta[:m]
            if t:
                self.moves += alpha[t - 1, :m].T @ back
                beta[:m] = back @ self.move.T
            else:
                self.moves += came.T @ back
        self._emitted(table, gamma)
        self.start += gamma[0][begins].sum(0)


def expected(model: Model, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of whole sequences."""
    counts = Counts(model)
    counts.add(codes)
    return counts.start, counts.moves * model.move, counts.emit


def first_model(weight: np.ndarray, states: int = STATES) -> Model:
    """Start of training: each state emits symbols by their frequency, tilted at random; states tend to stay."""
    rng = np.random.default_rng(SEED)
    emit = weight * rng.gamma(1.0, 1.0, (states, len(weight)))
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))


def updated(start, moves, emit, weight) -> Model:
    """Maximise: expected counts, smoothed a little towards the frequency of the symbols."""
    k = len(start)
    return Model((start + 1) / (start.sum() + k),
                 (moves + 0.5) / (moves.sum(1, keepdims=True) + 0.5 * k),
                 (emit + 20 * weight) / (emit.sum(1, keepdims=True) + 20))


def _counts_in(batches, model: Model, parts: int):
    """One row per state from each task: its expected counts as one vector, the likelihood and the tokens."""
    k, counts, part, tokens = len(model.start), Counts(model), 0, 0
    held, size = [], 0
    for batch in batches:
        for raw, p in zip(batch.column("codes").to_pylist(), batch.column("row").to_pylist()):
            part = p % parts
            held.append(np.frombuffer(raw, np.int32))
            size, tokens = size + len(held[-1]), tokens + len(held[-1])
            if size >= CELLS:
                counts.add(held)
                held, size = [], 0
    if held:
        counts.add(held)
    moves = counts.moves * model.move
    vectors = [np.concatenate([[counts.log_p * (i == 0), tokens * (i == 0), counts.start[i]], moves[i], counts.emit[i]]) for i in range(k)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(k), pa.int32()), pa.array([part] * k, pa.int32()), pa.array([v.tobytes() for v in vectors], pa.binary())],
        names=["state", "part", "counts"])


def _sum(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(x, np.float64) for x in rows["counts"]], axis=0)
    return pd.DataFrame({"state": [rows["state"].iloc[0]], "part": [rows["part"].iloc[0]], "counts": [total.tobytes()]})


COUNTS = "state int, part int, counts binary"


def train(encoded: DataFrame, weight: np.ndarray, states: int = STATES, iterations: int = ITERATIONS) -> Model:
    """Baum-Welch over all rows of `encoded` (row, codes). The driver sees one vector per state."""
    model, reached = first_model(weight, states), None
    narrow = encoded.select("row", "codes")
    parts = max(24, math.isqrt(narrow.rdd.getNumPartitions()))      # sums of a first step, each of as many tasks
    for _ in range(iterations):
        rows = (narrow.mapInArrow(lambda batches, m=model: _counts_in(batches, m, parts), COUNTS)
                .groupBy("state", "part").applyInPandas(_sum, COUNTS)
                .withColumn("part", F.lit(0)).groupBy("state", "part").applyInPandas(_sum, COUNTS).collect())
        if not rows:
            return model
        table = np.stack([np.frombuffer(r["counts"], np.float64) for r in sorted(rows, key=lambda r: r["state"])])
        (log_p, tokens), table = table[0, :2], table[:, 2:]
        if not tokens:
            return model
        model = updated(table[:, 0], table[:, 1:1 + states], table[:, 1 + states:], weight)
        if reached is not None and log_p / tokens - reached < GAIN:
            return model
        reached = log_p / tokens
    return model


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c): all words of `text`, and the number of texts beside a null; each task counts before the shuffle."""

    def count(batches):
        for batch in batches:
            for part in slices(batch):
                words, at, n = words_of(part.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array([*words, None], pa.binary()), pa.array(np.append(np.bincount(at, minlength=len(words)), len(n)), pa.int64())], names=["word", "c"])

    return texts.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, extra double, codes binary, words array<binary>, times array<int>"
SCORES = "row long, log_p double"


def most_frequent(vocabulary: DataFrame, n: int) -> DataFrame:
    """The n words with the largest counts, ties by word.

    Words are first counted by the bit length of c, so that tasks sort and send only words
    from the lengths that the n reach into, not n words each.
    """
    bits = F.length(F.bin("c"))
    lowest, held = 64, 0
    for r in sorted(vocabulary.groupBy(bits.alias("bits")).agg(F.count("*").alias("words")).collect(), reverse=True):
        if held >= n:
            break
        lowest, held = r["bits"], held + r["words"]
    return vocabulary.where(bits >= lowest).orderBy(F.desc("c"), "word").limit(n)


def score(docs: DataFrame, states: int = STATES, own_words: int = OWN_WORDS, iterations: int = ITERATIONS) -> DataFrame:
    """Score every text with an HMM trained on the texts whose crc32(id) mod 5 is not 1.

    Tokens: ASCII-lower-cased words between ASCII white space, then one end. Returns one row
    per row: doc_id, held_out, n_tokens, n_known (tokens met in training), train_tokens,
    base_score (smoothed unigram log10), score (the model's log10 probability), n_states.
    A null or empty text is the end alone. Repeated ids and null ids (fold of the empty
    text) are rows like others. With no training text N, V and all counts are 0 but for nothing known.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .withColumn("held_out", fold("doc_id") == 1)
    training = texts.where(~F.col("held_out"))
    counted = cut(word_counts(training), "vocabulary")
    vocabulary = counted.where(F.col("word").isNotNull())
    n_ends = counted.where(F.col("word").isNull()).agg(F.sum("c")).first()[0] or 0
    frequent = most_frequent(vocabulary, max(own_words, KNOWN)).collect()
    known = {bytes(r["word"]): r["c"] for r in frequent}
    counts = dict(list(known.items())[:own_words])
    symbols = Symbols({w: i for i, w in enumerate(counts)})

    def shared_symbol(batches):
        own = symbols.own
        for b in batches:
            words = b.column("word").to_pylist()
            keep = [i for i, w in enumerate(words) if w not in own]
            yield pa.RecordBatch.from_arrays([pa.array([symbols.shared(words[i]) for i in keep], pa.int32()), b.column("c").take(pa.array(keep, pa.int64()))], names=["symbol", "c"])

    shared = vocabulary.mapInArrow(shared_symbol, "symbol int, c long").groupBy("symbol").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    n_words = sum(counts.values()) + sum(r["n"] for r in shared)
    n_all = n_words + n_ends                                   # N: the end is a token
    distinct = len(counts) + sum(r["v"] for r in shared) + (n_ends > 0)
    below = n_all + 0.5 * (distinct + 1)
    share = {r["symbol"]: (r["n"], r["v"]) for r in shared}
    weight = np.full(symbols.count, 0.5)
    weight[:len(counts)] += list(counts.values())
    for s, (n, _) in share.items():
        weight[s] += n
    weight[-1] += n_ends
    weight /= weight.sum()
    within = np.array([share.get(s, (0, 0))[0] + 0.5 * (share.get(s, (0, 0))[1] + 1) for s in range(len(counts), symbols.end)])
    end_base = math.log10((n_ends + 0.5) / below)
    first_shared = len(counts)
    told = spark.sparkContext.broadcast(known)                 # KNOWN words at most

    def encode(batches):
        known = told.value
        for batch in batches:
            for part in slices(batch):
                words, at, n = words_of(part.column("text"))
                symbol = symbols.encode(words)
                c = np.array([known.get(w, -1) for w in words], np.float64)
                met, shared = c >= 0, symbol >= first_shared
                base = np.where(met, np.log10((np.abs(c) + 0.5) / below), 0.0)
                extra = np.zeros(len(words))
                extra[shared] = -np.log10(within[symbol[shared] - first_shared])
                extra += np.where(met & shared, np.log10(np.abs(c) + 0.5), 0.0)
                of = np.repeat(np.arange(len(n)), n)
                total = lambda x: np.bincount(of, x[at], len(n))
                codes = np.full(len(at) + len(n), symbols.end, np.int32)
                codes[np.arange(len(at)) + of] = symbol[at]
                edges = np.concatenate([[0], np.cumsum(n + 1)])
                # words whose counts are joined: each text's, with how often they occur in it
                rest = np.flatnonzero(~met[at])
                pair, times = np.unique(of[rest] * np.int64(max(1, len(words))) + at[rest], return_counts=True)
                bounds = np.searchsorted(pair, np.arange(len(n) + 1) * np.int64(max(1, len(words)))).astype(np.int32)
                table = pa.array(words, pa.binary()).take(pa.array(pair % max(1, len(words))))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(x) for x in ("row", "doc_id", "held_out")), pa.array(n + 1, pa.int64()), pa.array(total(met.astype(float)) + (n_ends > 0)).cast(pa.int64()),
                     pa.array(total(base) + end_base), pa.array(total(extra)), pa.array([codes[i:j].tobytes() for i, j in zip(edges, edges[1:])], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(bounds), table), pa.ListArray.from_arrays(pa.array(bounds), pa.array(times, pa.int32()))],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "extra", "codes", "words", "times"])

    encoded = cut(texts.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text").mapInArrow(encode, ENCODED), "encoded")
    model = train(encoded.where(~F.col("held_out")), weight, states, iterations)

    def run(batches):
        for batch in batches:
            out = forward(model, [np.frombuffer(x, np.int32) for x in batch.column("codes").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out)], names=["row", "log_p"])

    log_p = encoded.select("row", "codes").mapInArrow(run, SCORES)
    # words beyond the KNOWN ones: their counts are joined; none of them is frequent, so no key is hot
    rare = encoded.select("row", F.explode(F.arrays_zip("words", "times")).alias("r")).select("row", F.col("r.words").alias("word"), F.col("r.times").alias("n")) \
        .join(vocabulary, "word", "left") \
        .withColumn("c", F.coalesce("c", F.lit(0))) \
        .groupBy("row").agg(F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / F.lit(float(below)))).alias("rare_base"),
                            F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("rare_own"),
                            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return encoded.drop("codes", "words", "times").join(log_p, "row").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("rare_known")).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + zero("rare_base")).alias("base_score"),
        (F.col("log_p") + F.col("extra") + zero("rare_own")).alias("score"), F.lit(states).alias("n_states"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
