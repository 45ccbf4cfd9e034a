"""Quality classifier: multiple-instance learning with gated attention.

A document is a bag of passages of PASSAGE words (fewer where these take more than PIECE
bytes). Every passage is encoded from its bytes: how often one class of characters follows
another, how many of its words are new, how long they are. A small network maps a passage
to a hidden vector and, by two gates, to a weight; the document's score is that of the
weighted mean of its passages. All of it is learned from document labels alone: no passage
has a label.

Texts are encoded PIECE bytes at a time, longer ones cut between passages. A document's
weighted mean is carried from piece to piece (greatest raw weight, sum of weights, weighted
sum of hidden vectors), so memory does not grow with the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.llm.shared import cut, fold, slices

PASSAGE = 64            # words of a passage
PIECE = 1 << 18         # bytes of text that are encoded at a time
SAMPLE = 4000           # labelled documents that training reads at most, each with all its passages
PASSAGES = 1 << 16      # passages of all training documents at most (39 MB)
CUTOFF = 0.3
HIDDEN, GATE, EPOCHS, BATCH, RATE, SEED = 24, 12, 24, 64, 0.01, 5

# Classes of characters (bytes of UTF-8): the fixed values of the encoding.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,;:", b"!?", b"|", b"*%#&$", b"'\"()-/"]
OTHER, WIDE = len(CLASSES), len(CLASSES) + 1      # rest of ASCII; beyond ASCII
N_CLASSES = WIDE + 1
FEATURES = N_CLASSES * N_CLASSES + 4

_class_of = np.full(256, OTHER, np.uint8)
_class_of[128:] = WIDE
for _i, _c in enumerate(CLASSES):
    _class_of[list(_c)] = _i
_space = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_rng = np.random.default_rng(SEED)
_by_byte = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_by_place = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def pieces(texts: list[str | None]) -> Iterator[tuple[list[bytes], list[int], list[bool], list[int]]]:
    """Parts of texts of about PIECE bytes in all: the bytes, the byte before each (-1 at a text's start), whether
    the text ends there, and which text it is. A text that is too long is cut before the first word of a passage."""
    part, held = ([], [], [], []), 0

    def add(raw, before, ends, of):
        for x, v in zip(part, (raw, before, ends, of)):
            x.append(v)

    for i, x in enumerate(texts):
        raw = (x or "").encode("utf-8", "replace")
        if held and held + len(raw) > PIECE:
            yield part
            part, held = ([], [], [], []), 0
        at = 0
        while len(raw) - at > PIECE:
            window = np.frombuffer(raw, np.uint8, PIECE, at)
            space = _space[window]
            starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
            step = int(starts[(len(starts) - 1) // PASSAGE * PASSAGE]) if len(starts) > PASSAGE else PIECE
            add(raw[at:at + step], raw[at - 1] if at else -1, False, i)
            yield part
            part, at = ([], [], [], []), at + step
        add(raw[at:], raw[at - 1] if at else -1, True, i)
        held += len(raw) - at + 1
    if part[0]:
        yield part


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features [passages, FEATURES] and the text that each passage is of. A text without words has one passage."""
    blocks = list(encoded(texts))
    return np.concatenate([x for x, _ in blocks]), np.concatenate([bag for _, bag in blocks])


def encoded(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`encode` a piece at a time."""
    for raw, before, ends, of in pieces(texts):
        x, bag = _encode(raw, np.array(before), np.array(ends))
        yield x, np.array(of)[bag]


def _encode(raw: list[bytes], came: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(r) + e for r, e in zip(raw, ends)])         # an end is a line's end
    b = np.frombuffer(b"".join(r + b"\n" if e else r for r, e in zip(raw, ends)), np.uint8)
    space = _space[b]
    before = np.empty_like(space)
    before[1:] = space[:-1]
    first = np.concatenate([[0], np.cumsum(size)[:-1]])         # first bytes of the parts
    before[first] = True
    start = ~space & before                                     # first bytes of words
    word = np.cumsum(start)                                     # words up to a byte, over all parts
    words_before = word[first] - start[first]
    n_words = np.diff(np.append(words_before, word[-1]))
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    base = np.concatenate([[0], np.cumsum(n_passages)[:-1]])
    total = int(n_passages.sum())
    text = np.repeat(np.arange(len(raw)), size)
    passage = base[text] + np.maximum(0, word - words_before[text] - 1) // PASSAGE
    cls = _class_of[b].astype(np.int64)
    pair = cls.copy()
    pair[1:] += N_CLASSES * cls[:-1]
    pair[first] = cls[first] + N_CLASSES * _class_of[came].astype(np.int64)
    keep = np.ones(len(b), bool)
    keep[first[came < 0]] = False                               # no pair reaches over texts
    counts = np.bincount(passage[keep] * N_CLASSES**2 + pair[keep], minlength=total * N_CLASSES**2).reshape(total, -1)
    x = np.zeros((total, FEATURES), np.float32)
    length = np.maximum(1, counts.sum(1, keepdims=True))
    x[:, :N_CLASSES**2] = np.sqrt(counts / length)
    at = np.flatnonzero(start)
    if len(at):
        place = np.arange(len(b)) - at[np.maximum(word - 1, 0)]
        h = np.where(space, np.uint64(0), _by_byte[b] * _by_place[np.clip(place, 0, 63)])
        h = np.add.reduceat(h, at)
        of = passage[at]
        own = np.bincount(of, minlength=total)
        both = np.sort((of.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        new = both[np.append(True, both[1:] != both[:-1])]
        distinct = np.bincount((new >> np.uint64(40)).astype(np.int64), minlength=total)
        nonblank = np.bincount(passage, weights=~space, minlength=total)
        x[:, -4] = distinct / np.maximum(1, own)
        x[:, -3] = np.log1p(nonblank / np.maximum(1, own)) / 3
        x[:, -2] = own / PASSAGE
    x[:, -1] = 1
    return x, np.repeat(np.arange(len(raw)), n_passages)


@dataclass
class Network:
    """p: weights by name. A constant score if there was nothing to learn from."""

    p: dict[str, np.ndarray]
    constant: float | None = None

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hidden vectors, both gates and raw weights of passages."""
        p = self.p
        hidden = np.tanh((x - p["mean"]) / p["spread"] @ p["w"] + p["b"])
        a, g = np.tanh(hidden @ p["v"]), 1 / (1 + np.exp(-(hidden @ p["u"])))
        return hidden, a, g, (a * g) @ p["q"]

    def outcome(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(mean @ self.p["o"] + self.p["c"])))

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        hidden, a, g, raw = self.passages(x)
        top = np.full(bags, -np.inf)
        np.maximum.at(top, bag, raw)
        e = np.exp(raw - top[bag])
        weight = e / np.bincount(bag, e, bags)[bag]
        mean = np.zeros((bags, hidden.shape[1]))
        np.add.at(mean, bag, weight[:, None] * hidden)
        return {"hidden": hidden, "a": a, "g": g, "weight": weight, "mean": mean, "score": self.outcome(mean)}

    def score(self, blocks: Iterable[tuple[np.ndarray, np.ndarray]], bags: int) -> np.ndarray:
        """Scores of bags whose passages come in blocks (features, bag): the softmax runs along."""
        if self.constant is not None:
            return np.full(bags, self.constant)
        top, weights, sums = np.full(bags, -np.inf), np.zeros(bags), np.zeros((bags, HIDDEN))
        for x, bag in blocks:
            hidden, _, _, raw = self.passages(x)
            here = np.unique(bag)
            higher = top.copy()
            np.maximum.at(higher, bag, raw)
            shrink = np.exp(top[here] - higher[here])
            weights[here] *= shrink
            sums[here] *= shrink[:, None]
            e, top = np.exp(raw - higher[bag]), higher
            weights += np.bincount(bag, e, bags)
            np.add.at(sums, bag, e[:, None] * hidden)
        return self.outcome(sums / weights[:, None])

    def gradients(self, x, bag, bags, y, penalty: float = 1e-4) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, bag, bags)
        d_out = (f["score"] - y) / bags
        d_mean = d_out[:, None] * p["o"]
        w = f["weight"]
        d_weight = (d_mean[bag] * f["hidden"]).sum(1)
        d_raw = w * (d_weight - np.bincount(bag, w * d_weight, bags)[bag])
        ag = f["a"] * f["g"]
        d_a = d_raw[:, None] * p["q"] * f["g"] * (1 - f["a"] ** 2)
        d_g = d_raw[:, None] * p["q"] * f["a"] * f["g"] * (1 - f["g"])
        d_hidden = w[:, None] * d_mean[bag] + d_a @ p["v"].T + d_g @ p["u"].T
        d_pre = d_hidden * (1 - f["hidden"] ** 2)
        z = (x - p["mean"]) / p["spread"]
        out = {"w": z.T @ d_pre, "b": d_pre.sum(0), "v": f["hidden"].T @ d_a, "u": f["hidden"].T @ d_g, "q": ag.T @ d_raw, "o": f["mean"].T @ d_out, "c": d_out.sum(keepdims=True)}
        return {k: v + penalty * p[k] for k, v in out.items()}


def fit(bags: list[np.ndarray], labels: list[int]) -> Network:
    """Adam over shuffled batches of bags; the same sample gives the same network."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Network({}, constant=float((y.sum() + 1) / (len(y) + 2)))
    rng = np.random.default_rng(SEED)
    every = np.concatenate(bags)
    p = {"mean": every.mean(0), "spread": every.std(0) + 0.05, "w": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
         "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "q": rng.normal(0, GATE**-0.5, GATE),
         "o": rng.normal(0, HIDDEN**-0.5, HIDDEN), "c": np.zeros(1)}
    net = Network(p)
    m, v, t = {}, {}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            pick = order[i:i + BATCH]
            x = np.concatenate([bags[j] for j in pick])
            bag = np.repeat(np.arange(len(pick)), [len(bags[j]) for j in pick])
            t += 1
            for k, g in net.gradients(x, bag, len(pick), y[pick]).items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passages: int = PASSAGES) -> Network:
    """Learn from labelled documents whose crc32(id) mod 5 is not 0, in the order of a hash of the id: at most
    `sample`, and no more than have `passages` passages together. Each is read whole.

    The labels that are drawn are broadcast, so no text is shuffled; of rows with one id any
    one is read, labels that contradict each other count as the smaller.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold("doc_id") != 0)) \
        .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("quality")) \
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def bags(batches):
        for batch in batches:
            for part in slices(batch):
                for i, x in enumerate(part.column("text").to_pylist()):
                    blocks, n = [], 0
                    for features, _ in encoded([x]):
                        n += len(features)
                        blocks = [*blocks, features.tobytes()] if n <= passages else []
                    row = part.slice(i, 1)
                    yield pa.RecordBatch.from_arrays([row.column("id"), row.column("quality"), pa.array([n], pa.int64()), pa.array([b"".join(blocks) if n <= passages else None], pa.binary())], names=["id", "quality", "n", "bag"])

    rows = cut(texts.select("id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(bags, "id long, quality int, n long, bag binary")
               .groupBy("id").agg(F.min(F.struct("quality", "n", "bag")).alias("r")).select("id", "r.*"), "bags")
    # at most `sample` rows of one number each, then the bags that fit
    drawn, room = [], passages
    for _, i, n in sorted((r["h"], r["id"], r["n"]) for r in rows.select(F.xxhash64("id").alias("h"), "id", "n").collect()):
        if n <= room:
            drawn, room = [*drawn, i], room - n
    held = rows.where(F.col("id").isin(drawn)).orderBy("id").collect()
    return fit([np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in held], [int(r["quality"] > 0) for r in held])


def scores_of(texts: list[str | None], net: Network) -> np.ndarray:
    return net.score(encoded(texts), len(texts))


def score(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every text. Null and empty texts have a score as well;
    ids may be null or repeated. Without labels of both kinds the score is a constant, their smoothed mean."""
    net = train(docs, labels, sample)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                s = scores_of(part.column("text").to_pylist(), net)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= cutoff).astype(np.int32))],
                                                 names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", fold("doc_id") == 0)
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF, sample: int = SAMPLE) -> DataFrame:
    """The documents whose score reaches the cutoff, as they are."""
    net = train(docs, labels, sample)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(scores_of(part.column("text").to_pylist(), net) >= cutoff))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
