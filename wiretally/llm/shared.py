"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.session import shared_dir

SLICE_BYTES = 4 << 20    # text that a task works on at a time


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the cluster's shared folder and read it back: what follows neither
    recomputes it nor depends on the executors that made it."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: str) -> Column:
    """crc32 of the id as text, modulo 5; a null id is the empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about SLICE_BYTES of text; a longer text is alone."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def words_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct ASCII-lower-cased words between ASCII white space, the place of each token's word among them, and the
    number of tokens of each text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = parts.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0      # blanks at either end leave empty parts
    of = np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy(zero_copy_only=False))
    words = flat.filter(pa.array(full)).dictionary_encode()
    return [w.encode() for w in words.dictionary.to_pylist()], words.indices.to_numpy(zero_copy_only=False), np.bincount(of[full], minlength=len(parts))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers so that all bits depend on all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def rolling(x: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Karp-Rabin values modulo 2**64 of all windows of `width` items, one item added at a time."""
    n = len(x) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= np.uint64(base)
        out += x[j:j + n]
    return out


BITMAP_BITS = 24


def bitmap_of(slots: DataFrame) -> np.ndarray:
    """Packed bits of the slots (one column, below 2**BITMAP_BITS) that occur: 2 MB, however many rows."""
    c = F.col(slots.columns[0]) + 1      # bucket b >= 1 starts at slot (b - 1) * 32768
    rows = slots.groupBy(F.bitmap_bucket_number(c).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(c)).alias("bits")).collect()
    bits = np.zeros(1 << BITMAP_BITS, bool)
    for r in rows:
        part = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        bits[(r["bucket"] - 1) * len(part) + np.flatnonzero(part)] = True
    return np.packbits(bits)


def maybe_in(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key (a whole number) may be among `wanted` (one column): all that are, few others. What is broadcast is
    a bitmap of the keys' hashes, at most 2 MB, however many keys."""
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << BITMAP_BITS)) + 1
    own = slot(wanted.columns[0])
    held = wanted.groupBy(F.bitmap_bucket_number(own).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(own)).alias("_bits"))
    at = F.bitmap_bit_position(slot(key)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(held), F.bitmap_bucket_number(slot(key)) == F.col("_bucket")).where(F.getbit(byte, F.pmod(at, F.lit(8))) == 1).select(*rows.columns)


def in_bitmap(packed: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (packed[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1


class TokenHash(dict):
    """64-bit hash of a token (bytes), remembered up to a number of tokens."""

    LIMIT = 400_000

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        v = self[token] = self.of(token)
        return v

    def array(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))
