"""Hard negatives by a secondary sort: scores of (anchor, row) pairs travel as packed keys
(anchor, descending score, kind, id), are partitioned by anchor and sorted inside the
partitions, and a streaming iterator opens a window at each positive it meets and hands
out the negatives that fall into open windows. An anchor's rows are never held together.

Anchors meet all rows in tiles: a block of anchors and a block of rows, scored by one matrix
product inside a task. A first pass finds the positives; with the windows known, the second
sends only negatives that can still be among the first of a window in their block, so that
the sort sees a bounded number of keys per anchor and block instead of every pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.llm.shared import cut

ANCHORS = 4096           # anchors of a tile
ROWS = 8192              # rows of a tile
SCORES = 1 << 22         # scores that a task holds at a time
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 3, 9         # a negative's score lies between LOW and HIGH tenths of the positive's
KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
TOP = np.uint64(1 << 63)
PAIRS = "anchor long, key binary"


def packed(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> np.ndarray:
    """Keys whose byte order is: anchor, score descending, positives (0) before negatives (1), id."""
    out = np.empty(len(ids), KEY)
    out["anchor"], out["id"] = (x.astype(np.int64).view(np.uint64) ^ TOP for x in (anchor, ids))
    out["score"] = ~(score.astype(np.int64).view(np.uint64) ^ TOP)
    out["kind"] = kind
    return out


def unpacked(keys: pa.Array) -> tuple[np.ndarray, ...]:
    """(anchor, score, kind, id) of packed keys."""
    k = np.frombuffer(b"".join(keys.to_pylist()), KEY)
    signed = lambda x: (x.astype(np.uint64) ^ TOP).view(np.int64)
    return signed(k["anchor"]), signed(~k["score"].astype(np.uint64)), k["kind"], signed(k["id"])


def window(positive: int) -> tuple[int, int]:
    """Least and greatest score of a negative for a positive's score; empty below zero."""
    return -(-LOW * positive // 10), HIGH * positive // 10


def vectors_of(table: DataFrame) -> DataFrame:
    """(vec_id, label, q) of the rows that take part; q has floor(256 * x) of each component."""
    broken = F.exists("embedding", lambda x: x.isNull() | ~(F.abs(x.cast("double")) <= F.lit(float(np.finfo(np.float64).max))))
    label = F.col("label").cast("long")
    rows = table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~broken).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("q"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("v")).select("vec_id", "v.label", "v.q")


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of a list column; shorter ones end in zeros."""
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, width = column.flatten().to_numpy(zero_copy_only=False), int(n.max(initial=0))
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width) < n[:, None]] = flat
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, missing components being zero.

    Products of floats are exact below 2**53; beyond it integers are multiplied, which wrap at 64 bits.
    """
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    x, y = a.astype(np.float64), b.astype(np.float64)
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * max(d, 1) < 2.0**53:
        return (x @ y.T).astype(np.int64)
    return a @ b.T


class _Block:
    def __init__(self, batch: pa.RecordBatch | pa.Table):
        column = lambda c: (x.combine_chunks() if isinstance(x := batch.column(c), pa.ChunkedArray) else x)
        self.ids, self.labels = (column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
        self.q, self.windows = _matrix(column("q")), column("positives").to_pylist()


def tiled(anchors: DataFrame, rows: DataFrame, pick: Callable[[_Block, int, np.ndarray, _Block], np.ndarray], kind: int) -> DataFrame:
    """Packed keys of the pairs that `pick` chooses: it gets the anchors, the place of one of them,
    its scores with a batch of rows (ascending vec_id) and that batch, and returns places in the batch.

    anchors: vec_id, label, q, positives (scores). Blocks are dealt by a hash of the id; each block of
    anchors is sent to each block of rows.
    """
    a_parts, r_parts = (max(1, -(-df.count() // size)) for df, size in ((anchors, ANCHORS), (rows, ROWS)))
    own = lambda seed, n: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cols = ["vec_id", "label", "q", "positives"]
    both = anchors.select(*cols, F.lit(0).alias("role"), own(1, a_parts).alias("a"), every(r_parts).alias("r")).unionByName(
        rows.withColumn("positives", F.lit(None).cast("array<long>")).select(*cols, F.lit(1).alias("role"), every(a_parts).alias("a"), own(2, r_parts).alias("r")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, parts, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            of = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "r", "role")], 1)
            edges = [0, *(np.flatnonzero((of[1:] != of[:-1]).any(1)) + 1).tolist(), len(of)]
            for start, end in zip(edges, edges[1:]):
                part = batch.slice(start, end - start)
                if tuple(of[start, :2]) != tile:
                    tile, parts, block = tuple(of[start, :2]), [], None
                if of[start, 2] == 0:
                    parts.append(part)
                elif parts:
                    block = block or _Block(pa.Table.from_batches(parts))
                    yield from _scored(block, _Block(part), pick, kind)

    return both.repartition("a", "r").sortWithinPartitions("a", "r", "role", "vec_id").mapInArrow(run, PAIRS)


def _scored(anchors: _Block, rows: _Block, pick, kind: int) -> Iterator[pa.RecordBatch]:
    step = max(1, SCORES // max(1, len(rows.ids)))
    for first in range(0, len(anchors.ids), step):
        scores = inner(anchors.q[first:first + step], rows.q)
        found = []
        for i, s in enumerate(scores):
            at = pick(anchors, first + i, s, rows)
            if len(at):
                found.append(packed(np.full(len(at), anchors.ids[first + i]), s[at], kind, rows.ids[at]))
        if found:
            keys = np.concatenate(found).astype(KEY)      # concatenating turns to the native byte order
            yield pa.RecordBatch.from_arrays([pa.array((keys["anchor"].astype(np.uint64) ^ TOP).view(np.int64)), pa.array([k.tobytes() for k in keys], pa.binary())], names=["anchor", "key"])


def _positives(anchors: _Block, i: int, s: np.ndarray, rows: _Block) -> np.ndarray:
    at = np.flatnonzero((rows.labels == anchors.labels[i]) & (rows.ids != anchors.ids[i]))
    return at[np.argsort(~s[at], kind="stable")[:POSITIVES]]


def _negatives(anchors: _Block, i: int, s: np.ndarray, rows: _Block) -> np.ndarray:
    spans = [window(p) for p in anchors.windows[i] if p >= 0]
    if not spans:
        return np.empty(0, np.int64)
    at = np.flatnonzero((rows.labels != anchors.labels[i]) & (s >= min(lo for lo, _ in spans)) & (s <= max(hi for _, hi in spans)))
    at = at[np.argsort(~s[at], kind="stable")]
    down, wanted = ~s[at], np.zeros(len(at), bool)      # ~s falls as s grows, and never overflows
    for lo, hi in spans:
        start, end = np.searchsorted(down, ~hi), np.searchsorted(down, ~lo, "right")
        wanted[start:min(end, start + NEGATIVES)] = True
    return at[wanted]


def sorted_pairs(pairs: DataFrame) -> DataFrame:
    """Secondary sort: partitioned by anchor, each partition in the order of the packed keys."""
    return pairs.repartition("anchor").sortWithinPartitions("key")


def _first_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, n = None, 0
    for batch in batches:
        keep = []
        for i, anchor in enumerate(batch.column("anchor").to_pylist()):
            now, n = anchor, (n + 1 if anchor == now else 1)
            if n <= POSITIVES:
                keep.append(i)
        kept = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(unpacked(kept.column("key"))[1])], names=["anchor", "key", "score"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, positive, rank, negative, positive's score, negative's score) from the sorted keys."""
    now, open_ = None, []
    for batch in batches:
        out = []
        for anchor, score, kind, id_ in zip(*(x.tolist() for x in unpacked(batch.column("key")))):
            if anchor != now:
                now, open_ = anchor, []
            if kind == 0:
                open_.append([id_, score, *window(score), 0])
                continue
            for w in open_:
                if w[2] <= score <= w[3] and w[4] < NEGATIVES:
                    w[4] += 1
                    out.append((anchor, w[0], w[4], id_, w[1], score))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(
            (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])


def mined(vectors: DataFrame, is_anchor: Column) -> DataFrame:
    """Per anchor and positive, up to NEGATIVES rows of another label within the positive's window.

    vectors: vec_id, label, embedding. A row with a null in one of them, or with a null or non-finite
    component, takes no part. Of rows with one vec_id, that with the least label, then vector, does.
    Vectors of unequal length are compared as if the shorter ended in zeros; scores wrap at 64 bits.
    An anchor without another row of its label gives no rows, nor does a positive of negative score.
    """
    rows = cut(vectors_of(vectors), "vectors")
    anchors = rows.where(is_anchor)
    near = tiled(anchors.withColumn("positives", F.lit(None).cast("array<long>")), rows, _positives, 0)
    positives = cut(sorted_pairs(near).mapInArrow(_first_positives, PAIRS + ", score long"), "positives")
    wanted = positives.groupBy("anchor").agg(F.collect_list("score").alias("positives"))     # at most POSITIVES
    opened = anchors.join(wanted, anchors["vec_id"] == wanted["anchor"]).select("vec_id", "label", "q", "positives")
    pairs = positives.select("anchor", "key").unionByName(tiled(opened, rows, _negatives, 1))
    return sorted_pairs(pairs).mapInArrow(_opened, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
