"""Packing documents into sequences: full windows, combinations of remainders, and a cut rest.

A document's ids fill whole windows first. The lengths of what remains make a histogram of
less than a window's entries, whatever the number of documents. Pairs and triples of
lengths that fill a window exactly are enumerated, and non-negative least squares finds
how often to use each so that the histogram is met. Rounded down to what there is, then
extended greedily, they place most remainders uncut. The residuals are packed greedily,
longest first, each sequence filled to the brim by cutting the last piece, so that one
sequence of the whole corpus is padded.

The plan is made of histogram entries; a document finds its place from its rank among the
remainders of its length, which is counted in salted groups.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wiretally.llm.shared import cut, slices
from wiretally.llm.token_counts import byte_letters

WINDOW = 1024
END_ID = 0
TRIPLES_FROM = 1            # shortest part of a triple
SOLVER_STEPS = 150
KEPT_COMBINATIONS = 4000    # combinations that the second solve keeps
ROWS_PER_SALT = 1_000_000   # documents, for each salt of a length's ranks
MOST_SALTS = 1024
# Letters that both tokenizer libraries certainly class alike; other texts go to the slower one.
LATIN = re.compile("[^\x00-ɏ]")
# White space on which the faster library's pattern matcher runs out of stack.
LONG_BLANK = re.compile(r"\s{1000}")
# The pattern's part for the last of several blanks needs a look ahead, which makes the matcher slow. Where no two blanks
# meet, it matches what the plain part for blanks matches, one at the end. Texts with other letters or such blanks:
AHEAD = r"|\s+(?!\S)"
WHOLE = r"[^\x{0}-\x{24F}]|[\x09-\x0D \x{85}\x{A0}]{2}"


# ---- ids ----

@cache
def _fast(spec: str, pattern: str) -> tiktoken.Encoding:
    of = byte_letters()
    vocab = json.loads(spec)["model"]["vocab"]
    ranks = {bytes(of[c] for c in piece): i for piece, i in vocab.items() if all(c in of for c in piece)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def _exact(spec: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    t.encode_special_tokens = True
    return t


def ids_of(text: str | None, spec: str, pattern: str) -> np.ndarray:
    """A text's ids and the end id. Special tokens' strings in a text are ordinary text."""
    if not text:
        return np.array([END_ID], np.uint32)
    if LATIN.search(text) or LONG_BLANK.search(text):
        ids = _exact(spec).encode(text, add_special_tokens=False).ids
    else:
        ids = _fast(spec, pattern).encode_ordinary(text)
    return np.array([*ids, END_ID], np.uint32)


def ids_of_all(texts: pa.Array, spec: str, pattern: str) -> Iterator[np.ndarray]:
    """What ids_of gives for each text."""
    encode = _fast(spec, pattern.replace(AHEAD, "")).encode_ordinary
    whole = pc.fill_null(pc.match_substring_regex(texts, WHOLE), True)
    for text, other in zip(texts.to_pylist(), whole.to_pylist()):
        if other:
            yield ids_of(text, spec, pattern)
        else:
            ids = encode(text)
            ids.append(END_ID)
            yield np.array(ids, np.uint32)


def crc(ids: np.ndarray) -> int:
    return crc32(ids.astype("<u4").tobytes())


# ---- the plan, from the histogram ----

def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Pairs and triples (0 first) of the given lengths that fill the window exactly: [n, 3], ascending in a row."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    there[0] = True
    a, b = np.meshgrid(np.flatnonzero(there[:window // 3 + 1]), np.flatnonzero(there[:window // 2 + 1]), indexing="ij")
    c = window - a - b
    good = (a <= b) & (b >= 1) & (b <= c) & ((a == 0) | (a >= TRIPLES_FROM))
    a, b, c = a[good], b[good], c[good]
    keep = there[c] & (c < window)
    return np.stack([a[keep], b[keep], c[keep]], 1)


def least_squares(combos: np.ndarray, histogram: np.ndarray, steps: int = SOLVER_STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared gap between the lengths they use and the
    histogram, by accelerated projected gradient steps."""
    size = len(histogram)
    real = (combos > 0).astype(float)
    apply = lambda x: np.bincount(combos.ravel(), (x[:, None] * real).ravel(), size)
    back = lambda r: (r[combos] * real).sum(1)
    v = np.ones(len(combos))
    for _ in range(12):          # largest eigenvalue
        v = back(apply(v))
        v /= np.linalg.norm(v)
    rate = 1 / (1.05 * np.linalg.norm(back(apply(v))))
    x = z = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, z - rate * back(apply(z) - histogram))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


@dataclass
class Plan:
    """Where the remainder of a given length and rank goes.

    Slots are intervals of ranks: starts (length << 40 | first rank), first sequence, offset.
    Ranks from `used[length]` on lie in the rest, a run of ids cut every window.
    """

    window: int
    starts: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    used: np.ndarray
    rest: np.ndarray       # place in the rest of the first residual of each length
    combined: int          # sequences made of combinations
    rest_tokens: int

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, ids) of the pieces of a remainder, in order."""
        if rank < self.used[length]:
            i = int(np.searchsorted(self.starts, (length << 40) | rank, side="right")) - 1
            return [(int(self.sequence[i]) + rank - (int(self.starts[i]) & ((1 << 40) - 1)), int(self.offset[i]), length)]
        at = int(self.rest[length]) + (rank - int(self.used[length])) * length
        out = []
        while length:
            n = min(length, self.window - at % self.window)
            out.append((self.combined + at // self.window, at % self.window, n))
            at, length = at + n, length - n
        return out


def plan_of(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """histogram[l]: documents whose remainder has l ids, 0 < l < window."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    combos = combinations(np.flatnonzero(left), window)
    counts = np.zeros(len(combos), np.int64)
    if len(combos):
        x = least_squares(combos, left.astype(float))
        keep = np.argsort(-x, kind="stable")[:KEPT_COMBINATIONS]
        combos, x = combos[keep], least_squares(combos[keep], left.astype(float), 4 * SOLVER_STEPS)
        order = np.argsort(-x, kind="stable")
        combos, x, counts = combos[order], x[order], np.zeros(len(order), np.int64)
        for limit in (np.floor(x).astype(np.int64), np.full(len(x), np.iinfo(np.int64).max)):     # as solved, then greedily
            for i, parts in enumerate(combos.tolist()):
                own = [p for p in parts if p]
                n = min(int(limit[i]), *(int(left[p]) // own.count(p) for p in own))
                if n > 0:
                    counts[i] += n
                    for p in own:
                        left[p] -= n
    starts, sequence, offset, used, first = [], [], [], np.zeros(window, np.int64), 0
    for parts, n in zip(combos.tolist(), counts.tolist()):
        at = 0
        for p in reversed(parts):
            if n and p:
                starts.append((p << 40) | int(used[p])), sequence.append(first), offset.append(at)
                used[p] += n
                at += p
        first += n
    order = np.argsort(np.array(starts, np.int64), kind="stable")
    rest, total = np.zeros(window, np.int64), 0
    for length in range(window - 1, 0, -1):       # longest first
        rest[length] = total
        total += length * int(left[length])
    pick = lambda v: np.array(v, np.int64)[order]
    return Plan(window, pick(starts), pick(sequence), pick(offset), used, rest, first, total)


# ---- documents ----

TOKENS = "row long, doc_id long, doc_tokens long, remainder int, crcs array<long>, tail binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, tokenizer: str, pattern: str, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents in sequences of at most `window` ids.

    tokenizer: path of a byte-level tokenizer file, read on the driver and broadcast. One or more
    rows per row: a null or empty text is the end id alone; ids may be null or repeated.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(f.read())

    def tokens(batches):
        spec = held.value
        for batch in batches:
            for part in slices(batch):
                cols = [[] for _ in range(4)]
                for ids in ids_of_all(part.column("text"), spec, pattern):
                    full = len(ids) // window
                    for c, v in zip(cols, (len(ids), len(ids) % window, [crc(ids[i * window:(i + 1) * window]) for i in range(full)], ids[full * window:].astype("<u4" if ids.max() > 0xFFFF else "<u2").tobytes())):
                        c.append(v)
                kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                                 names=["row", "doc_id", "doc_tokens", "remainder", "crcs", "tail"])

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(texts.mapInArrow(tokens, TOKENS), "tokens")
    n = rows.count()
    salts = min(MOST_SALTS, max(16, n // ROWS_PER_SALT))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    # at most window x salts rows, whatever the input
    groups = salted.groupBy("remainder", "salt").agg(F.count("*").alias("n"), F.sum(F.size("crcs")).alias("full")).collect()
    count, full = np.zeros((window, salts), np.int64), np.zeros((window, salts), np.int64)
    for r in groups:
        count[r["remainder"], r["salt"]], full[r["remainder"], r["salt"]] = r["n"], r["full"]
    rank_before = np.cumsum(count, 1) - count
    full_before = (np.cumsum(full.ravel()) - full.ravel()).reshape(full.shape)
    n_full = int(full.sum())
    plan = spark.sparkContext.broadcast((plan_of(count.sum(1), window), rank_before, full_before))
    by = Window.partitionBy("remainder", "salt").orderBy("row")
    ranked = salted.withColumn("rank", F.row_number().over(by)).withColumn("fulls", F.sum(F.size("crcs")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    def pieces(batches):
        where, ranks, fulls = plan.value
        for batch in batches:
            out = []
            for doc_id, total, rem, crcs, tail, salt, rank, upto in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "remainder", "crcs", "tail", "salt", "rank", "fulls"))):
                first = int(fulls[rem, salt]) + upto - len(crcs)
                out += [(doc_id, i * window, window, v, total, first + i, 0) for i, v in enumerate(crcs)]
                if rem:
                    ids = np.frombuffer(tail, "<u2" if len(tail) == 2 * rem else "<u4")
                    at = 0
                    for sequence, offset, size in where.place(rem, int(ranks[rem, salt]) + rank - 1):
                        out.append((doc_id, len(crcs) * window + at, size, crc(ids[at:at + size]), total, n_full + sequence, offset))
                        at += size
            cols = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in PIECES.split(", ")])

    return ranked.select("doc_id", "doc_tokens", "remainder", "crcs", "tail", "salt", "rank", "fulls").mapInArrow(pieces, PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.json"), P.PATTERN)
