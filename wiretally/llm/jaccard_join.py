"""N-gram Jaccard join with adaptive multi-match prefixes.

Two sets that share LIKE per cent of their union share at least need(n) elements, n being either's size. With the
elements of all sets in one order, they therefore share l elements of the first n - need(n) + l of each: a longer
prefix must show correspondingly more shared elements. Each set chooses its l by the estimated cost of its candidates,
reading the lists of its prefix plus verifying those who may share l of its elements (at most the sum of the lists'
lengths over l); a pair is verified if it shares the smaller l of its two sides.

The order is by estimated frequency, then hash: elements repeated within a slice of text are counted, and the counts
added up. The estimate decides costs, never results: any order is right as long as it is one for all.

Rows with equal sets are one class, and lists with equal members one list that counts for as many. Lists that many classes share are not turned into all their pairs: a first round
pairs every class with the nearest of some heads of each long list, and all classes of a short one; further rounds
consider pairs that are not connected yet, and the last one all of those, with their full counts of shared elements.
Pairs arise in tiles of heads and members inside tasks, where sizes and parity bitmaps (a bound from above on the
intersection, so nothing is lost) are compared first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.llm.components import components
from wiretally.llm.near_dedup import apart, parities, set_key, token_hash
from wiretally.llm.shared import TokenHash, cut, maybe_in, mix, rolling, slices, words_of

WIDTH = 5                # words of a shingle
LIKE = 80                # per cent of the union that linked documents share
LONGEST = 16             # greatest l
VERIFY = 0.3             # cost of comparing one element of a candidate, in list entries read
SELDOM = 0.1             # list entries expected behind an element that was never seen twice in a slice
COMMON = 1 << 19         # at most so many elements have their frequency estimated in the order, the most frequent
HEADS = 64               # heads of a long list in the first round; each further round has so many times more
TILE = 512               # heads of a tile, and members of a tile
FAN = 256                # members that are verified against one copy of a head's text
SURE = 1 << 20           # weight of a match that needs no other


def need(n: np.ndarray | int):
    """Elements that a set of n shares with any set it is linked with."""
    return (LIKE * n + 99) // 100


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text): id and mark tell different texts apart, repeated rows are alike."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("mark"), text.alias("text"))


def sets_of(texts: pa.Array, width: int, known: TokenHash) -> list[np.ndarray]:
    """Distinct hashes of each text's shingles, ascending; distinct words are hashed once for all texts."""
    words, at, n = words_of(texts)
    h = known.array(words)[at]
    ends, out = np.cumsum(n), []
    full = mix(rolling(h, width) + np.uint64(width)) if len(h) >= width else np.empty(0, np.uint64)
    for end, k in zip(ends.tolist(), n.tolist()):
        if k >= width:
            s = np.sort(full[end - k:end - width + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            out.append(mix(rolling(h[end - k:end], k) + np.uint64(k)) if k else np.empty(0, np.uint64))
    return out


def read(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, mark, size and key of its set (null without words), parity bitmap; besides, rows
    (element, seen): elements that occur in several sets of a slice."""

    def run(batches):
        known = TokenHash(token_hash)
        for batch in batches:
            for part in slices(batch):
                sets = sets_of(part.column("text"), width, known)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                every = np.concatenate([*(sets[i] for i in full), np.empty(0, np.uint64)])
                key, bits = [None] * len(n), [None] * len(n)
                if len(full):
                    for i, odd in zip(full, parities(every, n[full])):
                        key[i], bits[i] = set_key(sets[i]), odd.tobytes()
                element, seen = np.unique(every, return_counts=True)
                element, seen = element[seen > 1].view(np.int64), seen[seen > 1]
                none = lambda k, t: pa.nulls(k, t)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("mark"), pa.array(n), pa.array(key, pa.binary()), pa.array(bits, pa.binary()), none(len(n), pa.int64()), none(len(n), pa.int64())], names=names)
                k = len(element)
                yield pa.RecordBatch.from_arrays(
                    [none(k, pa.int64()), none(k, pa.binary()), none(k, pa.int64()), none(k, pa.binary()), none(k, pa.binary()), pa.array(element), pa.array(seen)], names=names)

    names = ["doc_id", "mark", "n", "key", "parity", "element", "seen"]
    return texts_of(docs).mapInArrow(run, "doc_id long, mark binary, n long, key binary, parity binary, element long, seen long")


def frequencies(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Elements, ascending, and their estimated frequencies: all of the greatest powers of two that make up COMMON at most."""
    total = cut(seen.groupBy("element").agg(F.sum("seen").alias("n")), "frequencies")
    power = F.floor(F.log2("n")).cast("int")
    sizes = {r["p"]: r["c"] for r in total.groupBy(power.alias("p")).agg(F.count("*").alias("c")).collect()}     # at most 64 rows
    least, room = 63, COMMON
    while least > 1 and room >= sizes.get(least - 1, 0):
        least -= 1
        room -= sizes.get(least, 0)
    top = total.where(power >= least).toArrow()
    element, n = top.column("element").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(element)
    return element[order], n[order].astype(np.float64)


def prefix(s: np.ndarray, often: np.ndarray) -> tuple[int, np.ndarray]:
    """l and the prefix of a set (ascending) whose elements have the estimated frequencies `often`, 0 if seldom."""
    order = np.argsort(often, kind="stable")
    n = len(s)
    least = n - need(n)
    most = min(LONGEST, n - least)
    reads = np.cumsum(np.maximum(often[order[:least + most]], SELDOM))[least:]
    many = np.arange(1, most + 1)
    choice = int(np.argmin(many + reads + VERIFY * n * reads / many)) + 1
    return choice, s[order[:least + choice]]


def prefixes(docs: DataFrame, width: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, mark, l, elements) of every row with words."""
    shared = docs.sparkSession.sparkContext.broadcast(common)     # at most 8 MB

    def run(batches):
        known, (element, often) = TokenHash(token_hash), shared.value
        for batch in batches:
            for part in slices(batch):
                sets = sets_of(part.column("text"), width, known)
                every = np.concatenate([*sets, np.empty(0, np.uint64)])
                at = np.searchsorted(element, every)
                at[at == len(element)] = 0
                times = np.where(element[at] == every, often[at], 0.0) if len(element) else np.zeros(len(every))
                edges = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
                full = [i for i, s in enumerate(sets) if len(s)]
                chosen = [prefix(sets[i], times[edges[i]:edges[i + 1]]) for i in full]
                flat = np.concatenate([*(p for _, p in chosen), np.empty(0, np.uint64)]).view(np.int64)
                ends = np.concatenate([[0], np.cumsum([len(p) for _, p in chosen])]).astype(np.int32)
                rows = pa.array(full, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows), part.column("mark").take(rows), pa.array([c for c, _ in chosen], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "mark", "l", "elements"])

    return texts_of(docs).mapInArrow(run, "doc_id long, mark binary, l int, elements array<long>")


class _Rows:
    """Members of a list as arrays."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        self.c, self.root, self.n, self.main = (batch.column(x).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(x).to_numpy() for x in ("c", "root", "n", "is_main"))
        self.parity = np.frombuffer(b"".join(batch.column("parity").to_pylist()), np.uint64).reshape(len(self.c), -1)


def _meeting(a: _Rows, b: _Rows, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of heads `a` and members `b` that may be linked and are in different components.

    With `every`, all of them, each pair of members outside the largest component from one side; else each member's nearest head.
    """
    small, large = np.minimum(a.n[:, None], b.n[None, :]), np.maximum(a.n[:, None], b.n[None, :])
    meet = (a.root[:, None] != b.root[None, :]) & (100 * small >= LIKE * large)
    if every:
        meet &= b.main[None, :] | (a.c[:, None] < b.c[None, :])
    i, j = np.nonzero(meet)
    distance = np.bitwise_count(a.parity[i] ^ b.parity[j]).sum(-1, dtype=np.int64)
    both = a.n[i] + b.n[j]
    near = ~apart(distance, both)
    i, j, distance, both = i[near], j[near], distance[near], both[near]
    if not every and len(i):
        order = np.lexsort((a.c[i], distance / both, j))
        order = order[np.flatnonzero(np.diff(j[order], prepend=-1))]
        i, j = i[order], j[order]
    return i, j


def met(open_: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, weight): pairs of the lists' heads and members that may be linked, and how many matches they count for.

    open_: element, c, root, lists (how many the list stands for), is_main, is_head, whole (the list gives all its pairs). Heads and members are dealt into tiles.
    """
    dealt = open_.groupBy("element").agg(F.count_if("is_head").alias("h"), F.count("*").alias("m")).where("h > 0").select(
        "element", F.ceil(F.col("h") / TILE).cast("int").alias("h_parts"), F.ceil(F.col("m") / TILE).cast("int").alias("m_parts"))
    placed = open_.join(dealt, "element").join(classes.select("c", "n", "parity"), "c")
    own = lambda n: F.pmod(F.xxhash64("c", "element"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["element", "c", "root", "lists", "is_main", "whole", "n", "parity"]
    heads = placed.where("is_head").select(*cols, F.lit(0).alias("role"), own("h_parts").alias("h"), all_("m_parts").alias("m"))
    members = placed.select(*cols, F.lit(1).alias("role"), all_("h_parts").alias("h"), own("m_parts").alias("m"))

    def run(batches):
        tile, parts, a = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            of = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("element", "h", "m", "role")], 1)
            edges = [0, *(np.flatnonzero((of[1:] != of[:-1]).any(1)) + 1).tolist(), len(of)]
            out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for start, end in zip(edges, edges[1:]):
                this, part = tuple(of[start, :3]), batch.slice(start, end - start)
                if this != tile:
                    tile, parts, a = this, [], None
                if of[start, 3] == 0:
                    parts.append(part)
                elif parts:
                    whole = part.column("whole")[0].as_py()
                    a, b = a or _Rows(pa.Table.from_batches(parts)), _Rows(part)
                    i, j = _meeting(a, b, whole)
                    for x, y in zip(out, (a.c[i], b.c[j], np.full(len(i), part.column("lists")[0].as_py() if whole else SURE))):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["a", "b", "weight"])

    tiles = heads.unionByName(members).repartition("element", "h", "m").sortWithinPartitions("element", "h", "m", "role")
    return tiles.mapInArrow(run, "a long, b long, weight long")


def candidates(matches: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (low, high) that share as many prefix elements as the smaller l of the two asks for; a is the head, b the other."""
    pairs = matches.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.sum("weight").alias("weight"), F.max_by("a", "weight").alias("a"))
    side = lambda name: classes.select(F.col("c").alias(name), F.col("l").alias(f"l_{name}"))
    return pairs.join(side("low"), "low").join(side("high"), "high").where(F.col("weight") >= F.least("l_low", "l_high")).select(
        "low", "high", "a", (F.col("low") + F.col("high") - F.col("a")).alias("b"))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) whose full sets share LIKE per cent of their union.

    A head's members are dealt into parts of about FAN with a copy of its text each; a task holds one head's set. Only
    texts of the pairs leave the documents, and go straight to their parts.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).select("a", "part", "b")
    heads = dealt.select("a", "part").distinct().select("a", "part", F.lit(None).cast("long").alias("b"), F.col("a").alias("c"))
    members = dealt.select("a", "part", "b", F.col("b").alias("c"))
    sent = cut(heads.unionByName(members).join(classes.select("c", F.col("id").alias("doc_id"), "mark"), "c").drop("c"), "sent")
    texts = texts_of(maybe_in(docs, "doc_id", sent.select("doc_id"))).dropDuplicates(["doc_id", "mark"])

    def run(batches):
        known, head = TokenHash(token_hash), None
        for batch in batches:
            out = [], []
            for part in slices(batch):
                for a, b, s in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), sets_of(part.column("text"), width, known)):
                    if b is None:
                        head = s
                        continue
                    common = len(np.intersect1d(head, s, assume_unique=True))
                    if 100 * common >= LIKE * (len(head) + len(s) - common):
                        out[0].append(a)
                        out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    rows = texts.join(sent, ["doc_id", "mark"]).select("a", "part", "b", "text").repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return rows.mapInArrow(run, "a long, b long")


def linked(docs: DataFrame, rows: DataFrame, seen: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Classes (c, key, id: smallest doc_id, …) and links (a, b) between them that connect every component."""
    least = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(
        F.min(F.struct("doc_id", "mark")).alias("least"), F.first("n").alias("n"), F.first("parity").alias("parity"))
    named = cut(least.select("key", F.col("least.doc_id").alias("id"), F.col("least.mark").alias("mark"), "n", "parity", F.monotonically_increasing_id().alias("c")), "named")
    at = named.select(F.col("id").alias("doc_id"), "mark", "c")
    own = cut(prefixes(docs, width, frequencies(seen)).join(at, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).select("c", "l", "elements"), "prefixes")
    # dealt by element once, for the lists' signatures and for their members
    postings = own.select("c", F.explode("elements").alias("element")).where("element IS NOT NULL").repartition("element")     # said here, as the join below would say it of one of the two only
    lists = postings.groupBy("element").agg(F.count("*").alias("k"), *(F.sum(F.xxhash64("c", F.lit(i)) % (1 << 40)).alias(f"s{i}") for i in (0, 1, 2))).where("k > 1")
    # near copies share many elements, whose lists have the same members: one of them stands for all, with their number
    alike = lists.groupBy("k", "s0", "s1", "s2").agg(F.min("element").alias("element"), F.count("*").alias("lists")).select("element", "lists")
    members = cut(postings.join(alike, "element"), "members")
    wanted = members.select("c").distinct()
    classes = cut(named.join(wanted, "c").join(own.select("c", "l"), "c").select("c", "id", "mark", "n", "parity", "l"), "classes")

    links = tested = None
    turn, before = 0, None
    while True:
        if links is None:
            placed = members.withColumn("root", F.col("c"))
        else:
            roots = components(links).withColumnRenamed("key", "c")
            placed = members.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
        sizes = placed.groupBy("element", "root").agg(F.count("*").alias("k"))
        mixed = sizes.groupBy("element").agg(F.count("*").alias("roots"), F.sum("k").alias("all"), F.max_by("root", F.struct("k", "root")).alias("main")).where("roots > 1")
        open_ = cut(placed.join(mixed, "element").select("element", "c", "root", "lists", "all", (F.col("root") == F.col("main")).alias("is_main")), "open")
        left, held = open_.agg(F.sum(F.when(~F.col("is_main"), F.col("all")).otherwise(0)), F.count("*")).first()
        if not left:
            return named, links if links is not None else named.sparkSession.createDataFrame([], "a long, b long")
        turn, heads = turn + 1, HEADS ** (turn + 1)
        last = links is not None and (left <= heads * held or 2 * left > before)
        before = left
        # short lists, and in the last round all of them, give all pairs; a hash of the class draws the same heads in all long lists of a group
        whole = F.lit(True) if last else F.col("all") <= heads
        drawn = F.pmod(F.xxhash64("c", F.lit(turn)), F.lit(1 << 30)) / (1 << 30) < heads / F.col("all")
        pairs = candidates(met(open_.withColumn("whole", whole).withColumn("is_head", F.when(F.col("whole"), ~F.col("is_main")).otherwise(drawn)), classes), classes)
        pairs = cut(pairs if tested is None else pairs.join(tested, ["low", "high"], "left_anti"), "pairs")
        found = verified(pairs, classes, docs, width)
        links = cut(found if links is None else links.unionByName(found), "links")
        if last:
            return named, links
        done = pairs.select("low", "high")
        tested = done if tested is None else tested.unionByName(done)


def joined(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, the smallest doc_id that links lead to.

    Shingles are `width` words, ASCII-lower-cased, between ASCII white space; fewer words are one shingle. A null or
    empty text, or one without words, has no shingle and is in no component but its own, as is a row without an id
    (component null). Rows with equal sets are linked, repeated rows too.
    """
    both = cut(read(docs, width), "sets")
    rows = both.where("n IS NOT NULL").select("doc_id", "mark", "n", "key", "parity")
    named, links = linked(docs, rows, both.where("element IS NOT NULL").select("element", "seen"), width)
    roots = components(links).withColumnRenamed("key", "c")
    of = named.select("key", "c", "id").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = of.groupBy("root").agg(F.min("id").alias("least"))
    by_key = of.join(least, "root").select("key", "least")
    return rows.join(by_key, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"))
