"""Benchmark decontamination by greedy string tiling.

A tile is a run of words that a text and a test item share; tiles do not overlap in
either. The longest shared run is marked first, then the longest among what is left, down
to LEAST words. The share of the item's words under tiles is its coverage, whatever the
order in which the text has the passages.

Candidates come from a join on seeds, the hashes of all runs of LEAST words. A bitmap of
fixed size with the seeds of the benchmark lets each task pass over nearly all text
unshuffled; it drops no seed of the benchmark, whatever the benchmark's size. Of texts
with hits only the stretches around hits move on. The tiling itself hashes runs of one
length after the other, longest first (running Karp-Rabin), and compares words on a hit.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.llm.shared import BITMAP_BITS, TokenHash, bitmap_of, cut, in_bitmap, rolling, slices

LEAST = 5             # words of a tile and of a seed
COVERAGE = 0.5        # share of an item's words under tiles from which a text is contaminated

_PLAIN = re.compile(r"[\W_]+")


def word_hash(token: bytes) -> int:
    """Of the letters and digits of a token, in lower case; 0 if it has none."""
    w = _PLAIN.sub("", token.decode("utf-8", "replace").lower())
    return int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little") or 1 if w else 0


def words_of(text: str | None, known: TokenHash) -> np.ndarray:
    if not text:
        return np.empty(0, np.uint64)
    h = known.array(text.encode("utf-8", "replace").split())
    return h[h != 0]


def slot(seeds: np.ndarray) -> np.ndarray:
    return (seeds >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def tile(item: np.ndarray, stretches: list[np.ndarray], least: int = LEAST) -> list[tuple[int, int, int, int]]:
    """Tiles (place in the item, stretch, place in the stretch, words), longest first.

    Ties: the earliest place in the item, then in the text.
    """
    free_item = np.ones(len(item), bool)
    free = [np.ones(len(s), bool) for s in stretches]
    tiles = []
    width = min(len(item), max((len(s) for s in stretches), default=0))
    while width >= least:
        rows = _windows(item, free_item, width)
        for k, s in enumerate(stretches):
            own = _windows(s, free[k], width)
            if not rows or not own:
                continue
            for h in rows.keys() & own.keys():
                for i in rows[h]:
                    for j in own[h]:
                        if (free_item[i:i + width].all() and free[k][j:j + width].all() and (item[i:i + width] == s[j:j + width]).all()):
                            tiles.append((i, k, j, width))
                            free_item[i:i + width] = False
                            free[k][j:j + width] = False
                            break
        # no shared run of this length is left, and none can be longer than a free run
        width = min(width - 1, _longest(free_item), max((_longest(f) for f in free), default=0))
    return tiles


def _longest(free: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def _windows(x: np.ndarray, free: np.ndarray, width: int) -> dict[int, list[int]]:
    """Places of the free runs of `width` words by their Karp-Rabin value."""
    values = rolling(x, width)
    if not len(values):
        return {}
    marked = np.concatenate([[0], np.cumsum(~free)])
    out: dict[int, list[int]] = {}
    for i in np.flatnonzero(marked[width:] == marked[:-width]):
        out.setdefault(int(values[i]), []).append(int(i))
    return out


def stretches_of(words: np.ndarray, seeds: np.ndarray, hit: np.ndarray, least: int = LEAST) -> list[tuple[np.ndarray, np.ndarray]]:
    """Maximal runs of words under hit seeds, with their seeds."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > least) + 1
    return [(words[g[0]:g[-1] + least], seeds[g]) for g in np.split(at, cuts)]


ITEMS = "item_id long, words binary, n long, seeds array<long>"
HITS = "key string, doc_id long, stretches array<binary>, seeds array<long>"


def _items(batches):
    known = TokenHash(word_hash)
    for batch in batches:
        ids, words, n, seeds = batch.column("item_id").to_pylist(), [], [], []
        for x in batch.column("text").to_pylist():
            w = words_of(x, known)
            words.append(w.tobytes()), n.append(len(w))
            seeds.append(np.unique(rolling(w, LEAST)).view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array(seeds, pa.list_(pa.int64()))],
                                         names=["item_id", "words", "n", "seeds"])


def items_of(benchmark: DataFrame) -> DataFrame:
    """Items with their word hashes and seeds. An item of under LEAST words has no seed and is never found."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_items, ITEMS)


def bitmap(items: DataFrame) -> np.ndarray:
    """Bits of the slots of all seeds, of a size that does not depend on the number of items."""
    return bitmap_of(items.select(F.explode("seeds").alias("seed")).select(F.shiftrightunsigned("seed", 64 - BITMAP_BITS).alias("slot")))


def _text_key(text: str | None) -> str:
    return hashlib.sha1((text or "").encode("utf-8", "replace")).hexdigest()


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(key, doc_id, item_id, coverage, tiles, longest) of every text and item that share a seed, contaminated or not.

    key is the SHA-1 of the text; equal rows appear once. Word hashes stand for words (64 bits).
    """
    items = cut(items_of(benchmark), "items")
    held = docs.sparkSession.sparkContext.broadcast(bitmap(items))

    def hits(batches):
        known, packed = TokenHash(word_hash), held.value
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc_id, x in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    w = words_of(x, known)
                    seeds = rolling(w, LEAST)
                    hit = in_bitmap(packed, slot(seeds))
                    if found := stretches_of(w, seeds, hit):
                        own = np.unique(np.concatenate([s for _, s in found])).view(np.int64)
                        rows.append({"key": _text_key(x), "doc_id": doc_id, "stretches": [s.tobytes() for s, _ in found], "seeds": own.tolist()})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.string()), ("doc_id", pa.int64()), ("stretches", pa.list_(pa.binary())), ("seeds", pa.list_(pa.int64()))]))

    found = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(hits, HITS), "hits")
    # equal texts are tiled once; the rest of their rows join the result
    texts = found.groupBy("key").agg(F.first("stretches").alias("stretches"), F.first("seeds").alias("seeds"))
    pairs = texts.select("key", F.explode("seeds").alias("seed")).join(items.select("item_id", F.explode("seeds").alias("seed")), "seed") \
        .groupBy("key", "item_id").agg(F.count("*").alias("shared"))

    def tiled(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                t = tile(np.frombuffer(r["words"], np.uint64), [np.frombuffer(s, np.uint64) for s in r["stretches"]])
                out.append({"key": r["key"], "item_id": r["item_id"], "coverage": sum(x[3] for x in t) / r["n"], "tiles": len(t), "longest": max((x[3] for x in t), default=0)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int64()), ("longest", pa.int64())]))

    whole = pairs.join(texts.select("key", "stretches"), "key").join(items.select("item_id", "words", "n"), "item_id") \
        .select("key", "item_id", "words", "n", "stretches").mapInArrow(tiled, "key string, item_id long, coverage double, tiles long, longest long")
    return found.select("key", "doc_id").distinct().join(whole, "key")


def worst(found: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(key, doc_id, item_id, coverage, tiles, longest, contaminated): the item that a text covers most; ties: the smallest id."""
    best = F.max(F.struct("coverage", (-F.col("item_id")).alias("last"), "item_id", "tiles", "longest")).alias("b")
    return found.groupBy("key", "doc_id").agg(best).select("key", "doc_id", "b.item_id", "b.coverage", "b.tiles", "b.longest", (F.col("b.coverage") >= coverage).alias("contaminated"))


def with_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row per row: doc_id, item_id, coverage, tiles, longest, contaminated (0, null and false without shared seeds)."""
    found = cut(worst(leaks(docs, benchmark, coverage), coverage), "leaks")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha1(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("key"))
    same = rows["key"].eqNullSafe(found["key"]) & rows["doc_id"].eqNullSafe(found["doc_id"])
    return rows.join(found, same, "left").select(
        rows["doc_id"], "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("tiles", F.lit(0)).alias("tiles"),
        F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents without those that cover a test item to `coverage` or more."""
    found = cut(worst(leaks(docs, benchmark, coverage), coverage).where("contaminated").select("key").distinct(), "leaks")
    key = F.sha1(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return docs.join(found, key == found["key"], "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
