"""Near-duplicate groups with SetSketch registers: equal bands of registers give candidates,
the joint likelihood of the registers drops the hopeless ones, full sets confirm links.

Rows with equal sets are one class from the start. In a first round every class is tested
against the likest of up to HEADS classes, drawn by a hash, of each of its buckets, which
settles most of a large group of near copies. What is left are pairs of classes of one
bucket that are not yet connected: classes outside a bucket's largest component meet the
others. While these are many, rounds with more heads come first, as long as each leaves at
most half of them; no pair that could connect two components is left out.

Such pairs never become rows before they are judged. A bucket is dealt into tiles of some
heads and some members; a task holds a tile's heads, reads its members in batches and
compares sizes, parity bitmaps (their distance bounds the intersection from above, so this
loses nothing) and the likelihood of the registers. Only pairs that pass go to the full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.llm import setsketch
from wiretally.llm.components import components
from wiretally.llm.shared import TokenHash, cut, mix, rolling, slices

WIDTH = 4                # words of a shingle, unless a caller says otherwise
LIKE = 80                # per cent of the union that linked documents share
HOPELESS = 0.55          # likelihood estimate below which a pair is not confirmed; five deviations below LIKE
PARITY_BITS = 1024       # bits of a set's parity bitmap
FAN = 256                # members that are confirmed against one copy of a head's text
HEADS = 64               # a bucket's heads in the first round; each round has so many times more
TILE = 512               # heads of a tile, and members of a tile


def token_hash(token: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(token, digest_size=8).digest(), "little")


def shingles(text: str | None, known: TokenHash, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(mix(rolling(known.array(words), min(width, len(words))) + np.uint64(min(width, len(words)))))


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def parities(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """[sets, PARITY_BITS / 8]: for each of PARITY_BITS slots, whether an odd number of a set's elements is in it."""
    slot = (elements >> np.uint64(64 - (PARITY_BITS.bit_length() - 1))).astype(np.int64)
    slot += np.repeat(np.arange(len(sizes)) * PARITY_BITS, sizes)
    odd = np.bincount(slot, minlength=len(sizes) * PARITY_BITS) & 1
    return np.packbits(odd.astype(bool).reshape(len(sizes), PARITY_BITS), axis=1)


def apart(distance: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether sets of `both` elements together, whose bitmaps differ in `distance` slots, cannot be linked.

    Each differing slot holds an element that only one of the sets has.
    """
    return (100 + LIKE) * distance > (100 - LIKE) * both


SKETCH = "doc_id long, text_key binary, n long, key binary, registers binary, parity binary, bands array<long>"


def sketched(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: hash of the text, set size, key of the set (null without words), registers, band keys."""

    def run(batches):
        known = TokenHash(token_hash)
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                sets = [shingles(x, known, width) for x in texts]
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                every = np.concatenate([sets[i] for i in full]) if len(full) else np.empty(0, np.uint64)
                regs = setsketch.registers(every, np.concatenate([[0], np.cumsum(n[full])[:-1]])) if len(full) else np.empty((0, setsketch.M), np.uint16)
                odd = parities(every, n[full]) if len(full) else []
                bands = setsketch.band_keys(regs).view(np.int64).tolist()
                key, raw, bits, keys = ([None] * len(n) for _ in range(4))
                for j, i in enumerate(full):
                    key[i], raw[i], bits[i], keys[i] = set_key(sets[i]), regs[j].tobytes(), odd[j].tobytes(), bands[j]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([hashlib.sha1((x or "").encode("utf-8", "replace")).digest() for x in texts], pa.binary()), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(raw, pa.binary()), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "n", "key", "registers", "parity", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SKETCH)


def _matrix(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    """A row of `kind` for each value of a column of equally long binaries."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


class _Rows:
    """Classes of a bucket as arrays."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        self.key, self.root = _matrix(batch.column("key"), np.uint64), _matrix(batch.column("root"), np.uint64)
        self.registers, self.parity = _matrix(batch.column("registers"), np.uint16), _matrix(batch.column("parity"), np.uint64)
        self.n, self.main = batch.column("n").to_numpy(), batch.column("is_main").to_numpy(zero_copy_only=False)


def _between(a: _Rows, b: _Rows, band: int, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of heads `a` and members `b` of a band's bucket that may be linked.

    With `every`, all of them: members outside the largest component are paired from one
    side, and a pair that shares several bands counts in the first. Else each member's best head.
    """
    both = a.n[:, None] + b.n[None, :]
    meet = (a.root[:, None] != b.root[None, :]).any(-1) & (100 * np.minimum(a.n[:, None], b.n[None, :]) >= LIKE * np.maximum(a.n[:, None], b.n[None, :]))
    if every:
        (a0, a1), (b0, b1) = a.key.T, b.key.T
        meet &= b.main[None, :] | (a0[:, None] < b0) | ((a0[:, None] == b0) & (a1[:, None] < b1))
    i, j = np.nonzero(meet)
    distance = np.bitwise_count(a.parity[i] ^ b.parity[j]).sum(-1, dtype=np.int64)
    near = ~apart(distance, both[i, j])
    i, j, distance = i[near], j[near], distance[near]
    if every and len(i):
        shared = (a.registers[i] == b.registers[j]).reshape(len(i), setsketch.BANDS, -1).all(-1)
        first = shared.argmax(-1) == band
        i, j, distance = i[first], j[first], distance[first]
    if len(i):
        likely = setsketch.reaches(a.registers[i], b.registers[j], a.n[i].astype(float), b.n[j].astype(float), HOPELESS)
        i, j, distance = i[likely], j[likely], distance[likely]
    if not every and len(i):
        order = np.lexsort((distance / both[i, j], j))
        order = order[np.flatnonzero(np.diff(j[order], prepend=-1))]
        i, j = i[order], j[order]
    return i, j


def met(rows: DataFrame, classes: DataFrame, every: bool) -> DataFrame:
    """Pairs (a, b) of heads and members of one bucket that are in different components and may be linked.

    rows: band, at (position of the band), key, root, is_main, is_head. Heads and members of
    a bucket are dealt into tiles of about TILE each, whatever the size of the bucket.
    """
    dealt = rows.groupBy("band").agg(F.count_if("is_head").alias("h"), F.count("*").alias("m")).where("h > 0").select(
        "band", F.ceil(F.col("h") / TILE).cast("int").alias("h_parts"), F.ceil(F.col("m") / TILE).cast("int").alias("m_parts"))
    placed = rows.join(dealt, "band").join(classes.select("key", "n", "registers", "parity"), "key")
    own = lambda n: F.pmod(F.xxhash64("key", "band"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["band", "at", "key", "root", "is_main", "n", "registers", "parity"]
    heads = placed.where("is_head").select(*cols, F.lit(0).alias("role"), own("h_parts").alias("h"), all_("m_parts").alias("m"))
    members = placed.select(*cols, F.lit(1).alias("role"), all_("h_parts").alias("h"), own("m_parts").alias("m"))

    def run(batches):
        tile, parts, a = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            of = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("band", "h", "m", "role")], 1)
            edges = [0, *(np.flatnonzero((of[1:] != of[:-1]).any(1)) + 1).tolist(), len(of)]
            out = [[], []]
            for start, end in zip(edges, edges[1:]):
                this, role, part = tuple(of[start, :3]), of[start, 3], batch.slice(start, end - start)
                if this != tile:
                    tile, parts, a = this, [], None
                if role == 0:
                    parts.append(part)
                elif parts:
                    a, b = a or _Rows(pa.Table.from_batches(parts)), _Rows(part)
                    i, j = _between(a, b, part.column("at")[0].as_py(), every)
                    out[0] += [a.key[x].tobytes() for x in i]
                    out[1] += [b.key[x].tobytes() for x in j]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], names=["a", "b"])

    tiles = heads.unionByName(members).repartition("band", "h", "m").sortWithinPartitions("band", "h", "m", "role")
    return tiles.mapInArrow(run, "a binary, b binary").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """Pairs (a, b) whose full sets share LIKE per cent of their union.

    A head's members are dealt into parts of about FAN with a copy of its text each; a task
    holds one head's set and reads members one after the other.
    """
    pairs = cut(pairs, "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).select("a", "part", "b")
    heads = dealt.select("a", "part").distinct().join(texts, F.col("a") == texts["key"]).select("a", "part", F.lit(None).cast("binary").alias("b"), "text")
    members = dealt.join(texts, F.col("b") == texts["key"]).select("a", "part", "b", "text")

    def run(batches):
        known, at, head = TokenHash(token_hash), None, None
        for batch in batches:
            out = []
            for a, part, b, x in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "text"))):
                s = shingles(x, known, width)
                if b is None:
                    if set_key(s) == a:      # another text under the same id is not the class's
                        at, head = (a, part), s
                elif at == (a, part) and set_key(s) == b:
                    common = len(np.intersect1d(head, s, assume_unique=True))
                    if 100 * common >= LIKE * (len(head) + len(s) - common):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.binary()) for i in (0, 1)], names=["a", "b"])

    rows = heads.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return rows.mapInArrow(run, "a binary, b binary")


def links_of(rows: DataFrame, docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Classes (key, id: smallest doc_id, n, registers, parity, bands) and links (a, b) that connect every component."""
    classes = cut(rows.where("n > 0 and doc_id is not null").groupBy("key").agg(
        F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("n", "registers", "parity", "bands"))), "classes")
    exploded = classes.select(F.posexplode("bands").alias("at", "band"), "key")
    shared = exploded.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band")
    members = cut(exploded.join(shared, "band"), "members")
    wanted = members.select("key").distinct().join(classes.select("key", "id"), "key")
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = cut(source.join(wanted, "id").select("key", "text").distinct(), "texts")
    slim = classes.select("key", "n", "registers", "parity")

    links, turn, before = None, 0, None
    while True:
        if links is None:
            placed = members.withColumn("root", F.col("key"))
        else:
            placed = members.join(components(links), "key", "left").withColumn("root", F.coalesce("root", "key"))
        # buckets that hold several components, and the largest of each
        sizes = placed.groupBy("band", "root").agg(F.count("*").alias("c"))
        mixed = sizes.groupBy("band").agg(F.count("*").alias("roots"), F.sum("c").alias("all"), F.max_by("root", F.struct("c", "root")).alias("main")).where("roots > 1")
        open_ = cut(placed.join(mixed, "band").select("band", "at", "key", "root", "all", (F.col("root") == F.col("main")).alias("is_main")), "open")
        left, held = open_.agg(F.sum(F.when(~F.col("is_main"), F.col("all")).otherwise(0)), F.count("*")).first()
        if links is not None and not left:
            return classes, links
        turn, heads_each = turn + 1, HEADS**(turn + 1)
        last = links is not None and (left <= heads_each * held or 2 * left > before)
        before = left or 0
        # in the last round all classes outside a bucket's largest component, before it about
        # `heads_each` a bucket; a hash of the key draws the same ones in all buckets of a group
        is_head = ~F.col("is_main") if last else F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(1 << 30)) / (1 << 30) < heads_each / F.col("all")
        pairs = met(open_.withColumn("is_head", is_head), slim, last)
        found = confirmed(pairs, texts, width)
        links = cut(links.unionByName(found) if links is not None else found, "links")
        if last:
            return classes, links


def grouped(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles, component_id.

    Shingles: `width` words, ASCII-lower-cased, between ASCII white space; fewer words are one
    shingle. A null or empty text, or one without words, is in no group but its own, as is a
    row with a null id (component null). Rows with equal sets are linked, repeated rows too.
    """
    rows = cut(sketched(docs, width), "sketches")
    classes, links = links_of(rows, docs, width)
    roots = components(links)
    lone = classes.select("key", "id").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = lone.groupBy("root").agg(F.min("id").alias("component_id"))
    of = lone.select("key", "root").join(least, "root").select("key", "component_id")
    return rows.join(of, "key", "left").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row is kept if its id is its component's smallest."""
    return grouped(docs).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One document of each group, that with the smallest id; repeated rows of it appear once.

    Rows without words and rows without an id all stay.
    """
    groups = cut(grouped(docs, width), "groups")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    chosen = groups.where(~alone).groupBy("component_id").agg(F.min(F.struct("doc_id", "text_key")).alias("k")).select("k.doc_id", "k.text_key")
    own = docs.withColumn("__key", F.unhex(F.sha1(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))))
    at = chosen.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    kept = own.join(at, (F.col("doc_id").cast("long") == F.col("__id")) & (own["__key"] == at["__key"]), "left_semi").drop("__key")
    repeated = cut(groups.where(~alone).groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id").distinct(), "repeated")
    if not repeated.isEmpty():
        many = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(many)
    lone = groups.where(alone).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    rest = own.join(lone, own["__key"].eqNullSafe(lone["__key"]) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_semi").drop("__key")
    return kept.unionByName(rest).select(docs.columns)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
