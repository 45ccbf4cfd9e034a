"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame operations only.

A sketch holds the k smallest distinct hashes of a text's shingles, ascending. The sketch
of a union is the k smallest of both sketches, so parts merge in any order. Two sketches
estimate resemblance (Jaccard), containment and the number of distinct shingles; below k
shingles all three are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 128
WIDTH = 5                     # words of a shingle
BITS = 48                     # of a shingle hash
NEIGHBOUR_RANGES = 2048       # ranges of ids in which neighbours are found, at most
MERGE_FAN = 64


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Distinct hashes of all shingles of `width` lower-cased words between white space.

    With fewer words the whole sequence is the one shingle; without words there is none.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")

    def shingles(h: Column) -> Column:
        last = F.greatest(F.size(h) - width, F.lit(0))
        one = lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(h, i + j) for j in range(width))), 64 - BITS)
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), last), one)))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(hashes), 1, k)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    return bottom(shingle_hashes(text, width), k)


def text_of(s: Column) -> Column:
    """A sketch as text: 12 lower-case hex digits a hash; empty for a text without words."""
    return F.array_join(F.transform(s, lambda x: F.lower(F.lpad(F.hex(x), BITS // 4, "0"))), "")


def merged(a: Column, b: Column, k: int = K) -> Column:
    return bottom(F.array_union(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's sketch that both have; two empty sketches are alike."""
    u = merged(a, b, k)
    return F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)).cast("double")


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Exact below k, else (k - 1) over the kth smallest hash as a share of the range."""
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) * F.lit(float(1 << BITS)) / (F.element_at(s, k) + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; an empty text is contained in any."""
    j = resemblance(a, b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(
        F.least(F.lit(1.0), j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k)) / distinct_shingles(a, k)))


def merge(parts: DataFrame, key: str, column: str = "sketch", k: int = K) -> DataFrame:
    """(key, sketch): one sketch per key from the sketches of its parts, null ones left out.

    Parts are merged in rounds of groups of about MERGE_FAN, so no task holds a hot key's parts.
    """
    of = parts.select(F.col(key).alias("key"), F.col(column).alias("sketch")).where(F.col("sketch").isNotNull())
    most = of.groupBy("key").count().agg(F.max("count")).first()[0] or 1
    groups = -(-most // MERGE_FAN)
    while True:
        dealt = F.pmod(F.xxhash64("sketch", F.lit(groups)), F.lit(groups)) if groups > 1 else F.lit(0)
        of = of.withColumn("part", dealt).dropDuplicates(["key", "part", "sketch"]).groupBy("key", "part") \
            .agg(bottom(F.array_distinct(F.flatten(F.collect_list("sketch"))), k).alias("sketch")).drop("part")
        if groups == 1:
            return of.withColumnRenamed("key", key)
        groups = -(-groups // MERGE_FAN)


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """(doc_id, sketch, n_shingles estimated) of every text."""
    return docs.select(F.col(doc_id).alias("doc_id"), sketch(F.col(text), k, width).alias("sketch")) \
        .withColumn("n_shingles", distinct_shingles(F.col("sketch"), k))


def with_next(docs: DataFrame, ranges: int) -> tuple[DataFrame, object]:
    """Rows (doc_id, text, copy, next) with the next row's text in ascending (doc_id, text hash) order;
    after the last comes the first. Also the window that holds the order.

    Ids are cut into ranges at quantiles. Each range gets a copy of the row that follows it, so a
    window inside the range knows every neighbour, and no task sorts more than a range. Copies
    are rows of the result until the caller drops them.
    """
    edges = sorted(set(docs.stat.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    # a range: the number of edges that are not above the id; null ids come first
    at = F.size(F.filter(F.lit([int(x) for x in edges]), lambda e: e <= F.col("doc_id"))) if edges else F.lit(0)
    ranged = docs.withColumn("tie", F.xxhash64("text")).withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(at)).withColumn("copy", F.lit(False))
    least = ranged.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("head")).collect()
    head = {r["range"]: r["head"]["doc_id"] for r in least}
    order = sorted(head)
    before = {r: order[i - 1] for i, r in enumerate(order)}
    n = len(edges) + 1
    heads, befores = F.array(*(F.lit(head.get(r)).cast("long") for r in range(n))), F.array(*(F.lit(before.get(r)).cast("int") for r in range(n)))
    copies = ranged.where(F.col("doc_id").eqNullSafe(F.get(heads, F.col("range")))).groupBy("range", "doc_id") \
        .agg(F.min_by("text", F.struct("tie", "text")).alias("text")) \
        .select("doc_id", "text", F.xxhash64("text").alias("tie"), F.get(befores, F.col("range")).alias("range"), F.lit(True).alias("copy"))
    by = Window.partitionBy("range").orderBy("copy", F.asc_nulls_first("doc_id"), "tie")
    return ranged.unionByName(copies).withColumn("next", F.lead("text").over(by)), by


def edit_likeness(docs: DataFrame, k: int = K, width: int = WIDTH, ranges: int | None = None) -> DataFrame:
    """Fingerprint of every text and of its edited text, and how alike fingerprints are.

    Edited: the last floor(n_chars / 4) code points replaced by the first as many (or all) of the
    next row in ascending id; after the last comes the first. Null texts are empty; rows of one id
    follow each other by text hash, null ids come first; one row alone is its own next. Texts
    without words have the empty fingerprint; two of them are alike (1.0).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if ranges is None:
        ranges = min(NEIGHBOUR_RANGES, 1 + rows.count() // 2000)
    beside, by = with_next(rows, ranges)
    n, tail = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - tail), F.substring("next", F.lit(1), tail))
    own = beside.withColumn("edited", F.coalesce(edited, F.lit(""))).select(
        "doc_id", "range", "copy", "tie", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        sketch(F.col("text"), k, width).alias("sketch"), sketch(F.col("edited"), k, width).alias("edited_sketch"))
    both = own.withColumn("next_sketch", F.lead("sketch").over(by)).where(~F.col("copy"))
    return both.select("doc_id", "n_chars", "edited_sha256", text_of(F.col("sketch")).alias("fingerprint"), text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
                       resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
                       distinct_shingles(F.col("sketch"), k).alias("n_shingles"), containment(F.col("sketch"), F.col("edited_sketch"), k).alias("contained_edited"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))
