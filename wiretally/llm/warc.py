"""WARC archives: writing with revisits, and reading by boundary-chain verification.

Writing. Each row becomes a record; of rows with equal payloads one is a response, the
others are revisits of it. Spark's text writer puts the records into files: the blank
lines that end a record are its line separator.

Reading. Files are split anywhere. The text reader cuts them at the version line, so every
piece begins a candidate record: its own offset, and from its Content-Length the offset of
its successor. A version line inside a payload makes a false candidate, which may even
look like a whole record. Only what the chain from the start of the file reaches is a
record. Inside a split the chain is followed by pointer jumping in the task; between
splits by pointer jumping over a table of (candidate, exit), doubling the reach each round.
Payloads that hold version lines are put together again from their pieces, which a second
reading finds by their contents: it may be split in another way than the first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wiretally.llm.shared import BITMAP_BITS, bitmap_of, cut, in_bitmap
from wiretally.session import shared_dir

VERSION = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
LEAST_REVISIT = 1000          # bytes of payload from which an equal one is a revisit
STAMP = "2025-01-01T00:00:00Z"


def _field(c: Column) -> Column:
    """A header value: no control characters and no blanks."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\x00-\x20\x7f]", "_")


def marked(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, refers_to (null: response).

    Of equal payloads of at least `least` bytes the row with the largest page_id is the
    response. Rows that share that page_id are all responses; a null page_id is the smallest.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")) \
        .withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    repeated = rows.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("of"), F.count("*").alias("n")).where("n > 1").drop("n")
    # only payloads that may be repeated are shuffled: a bitmap of fixed size tells the others; AQE splits a digest that many rows share
    slot = F.conv(F.substring("digest", 1, BITMAP_BITS // 4), 16, 10).cast("long")
    bits = pages.sparkSession.sparkContext.broadcast(bitmap_of(repeated.select(slot.alias("slot"))))

    @F.pandas_udf("boolean")
    def may_repeat(slots: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(bits.value, slots.to_numpy()))

    told = rows.withColumn("maybe", may_repeat(slot))
    joined = told.where("maybe").join(repeated, "digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("of")), F.col("of")).alias("refers_to"))
    return told.where("not maybe").select("page_id", "url", "payload", "payload_bytes", "digest", F.lit(None).cast("long").alias("refers_to")).unionByName(joined)


def record(rows: DataFrame) -> Column:
    """A record without the blank lines that end it."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(GAP))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    return F.concat(
        F.lit(VERSION), F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), page, F.lit(">\r\nWARC-Date: " + STAMP + "\r\nWARC-Target-URI: "), _field(F.col("url")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nWARC-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"),
                                 F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(GAP), block)


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    rows = marked(pages, least)
    rows.select(record(rows).alias("record")).write.option("lineSep", GAP).text(path)


# ---- reading ----

HEADER_FIELDS = ("warc-type", "warc-record-id", "warc-refers-to", "warc-payload-digest", "warc-payload-length", "content-length", "warc-target-uri")


def parse(piece: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields (lower-case names) and the length of the header with its blank line; None if there is no header."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        name = name.strip().lower().decode("latin-1")
        if name in HEADER_FIELDS and name not in fields:
            fields[name] = value.strip().decode("utf-8", "replace")
    return (fields, end + 4) if is_length(fields.get("content-length")) else None


def is_length(value: str | None) -> bool:
    """Digits of a number of bytes; more than 18 of them are none that a file can hold."""
    return value is not None and value.isascii() and value.isdigit() and len(value) <= 18


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header of a block."""
    return block.partition(b"\r\n\r\n")[2]


CANDIDATE = ("file long, block long, seq long, key binary, size long, span long, whole boolean, page string, kind string, refers string, "
             "told string, told_bytes long, uri string, digest string, payload_bytes long")


def _candidates(batches):
    for batch in batches:
        out = []
        for piece, file, block, seq, key in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block", "seq", "key"))):
            size = len(piece) + len(VERSION)
            row = dict.fromkeys(x.split()[0] for x in CANDIDATE.split(", ")) | {"file": file, "block": block, "seq": seq, "key": key, "size": size}
            if found := parse(piece):
                f, head = found
                body = int(f["content-length"])
                row |= {"span": len(VERSION) + head + body + len(GAP), "whole": head + body + len(GAP) == len(piece), "page": f.get("warc-record-id"),
                        "kind": f.get("warc-type"), "refers": f.get("warc-refers-to"), "told": f.get("warc-payload-digest"),
                        "told_bytes": int(f["warc-payload-length"]) if is_length(f.get("warc-payload-length")) else None, "uri": f.get("warc-target-uri")}
                if row["whole"]:
                    payload = payload_of(piece[head:head + body])
                    row |= {"digest": hashlib.sha1(payload).hexdigest(), "payload_bytes": len(payload)}
            out.append(row)
        yield pa.RecordBatch.from_pylist(out, schema=_CANDIDATE)


_CANDIDATE = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in CANDIDATE.split(", "))])


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """Of each candidate of a split, where the chain from it leaves the split; -1 where it breaks.

    Pointer jumping: every round replaces each pointer by the pointer of what it points to.
    """
    at = rows["at"].to_numpy()
    goal = rows["goal"].to_numpy()
    end = rows["end"].iloc[0]
    order = np.argsort(at)
    at, goal = at[order], goal[order]
    n = len(at)
    to = np.searchsorted(at, goal)
    inside = (goal >= 0) & (goal < end)
    hit = inside & (to < n) & (at[np.minimum(to, n - 1)] == goal)
    pointer = np.where(hit, to, np.arange(n))
    out = np.where(inside, -1, goal)
    while True:
        further = pointer[pointer]
        if (further == pointer).all():
            break
        pointer = further
    return pd.DataFrame({"file": rows["file"], "block": rows["block"], "at": at, "exit": out[pointer]})


def _reached(rows: pd.DataFrame) -> pd.DataFrame:
    """Candidates of a split on the chain from its entry, by doubling the set and the pointers."""
    rows = rows.sort_values("at")
    at, goal = rows["at"].to_numpy(), rows["goal"].to_numpy()
    n = len(at)
    to = np.searchsorted(at, goal)
    pointer = np.append(np.where((to < n) & (at[np.minimum(to, n - 1)] == goal), to, n), n)
    on = np.append(at == rows["entry"].iloc[0], False)
    while True:
        more = on.copy()
        more[pointer[np.flatnonzero(on)]] = True
        more[n] = False
        if (more == on).all() and (pointer == n).all():
            break
        on, pointer = more, pointer[pointer]
    return rows.loc[on[:n], ["file", "block", "seq", "at", "goal"]]


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between version lines, with their place: value, key (SHA-256 of value), file (hash of the path), block (start of the split), seq.

    block and seq order the pieces of one reading; another one may be split differently.
    """
    return spark.read.option("lineSep", VERSION).text(path).select(
        F.col("value").cast("binary").alias("value"), F.unhex(F.sha2(F.col("value").cast("binary"), 256)).alias("key"), F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").cast("long").alias("block"), F.monotonically_increasing_id().alias("seq"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records that the chains from the files' starts reach.

    Columns: file (hash of its path), at (offset), kind, page, refers (their ids as written), uri, told (digest as
    written), told_bytes, digest and payload_bytes (of the payload that is there). A chain that
    breaks, or leads past the end of its file, ends there: what lies behind is no record.
    """
    found = cut(pieces(spark, path).mapInArrow(_candidates, CANDIDATE), "candidates")
    # offsets: sum of the sizes before; first of whole splits, then inside a split
    blocks = found.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum("bytes").over(before), F.lit(0))).withColumn("end", F.col("start") + F.col("bytes") - len(VERSION))
    inside = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # the piece before the first version line of a file is no candidate; it is empty in a sound file
    placed = found.withColumn("shift", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(blocks, ["file", "block"]) \
        .withColumn("at", F.col("start") + F.col("shift") - len(VERSION)).where("at >= 0") \
        .withColumn("goal", F.coalesce(F.col("at") + F.col("span"), F.lit(-1)))
    placed = cut(placed, "placed")
    exits = placed.select("file", "block", "at", "goal", "end").groupBy("file", "block").applyInPandas(_exits, "file long, block long, at long, exit long")
    entries = cut(_entries(exits, blocks), "entries")
    reached = placed.select("file", "block", "seq", "at", "goal").join(entries, ["file", "block"]) \
        .groupBy("file", "block").applyInPandas(_reached, "file long, block long, seq long, at long, goal long")
    records = cut(placed.drop("key", "goal", "shift", "start", "end", "bytes", "size", "span").join(reached.select("file", "block", "seq", "goal"), ["file", "block", "seq"]), "records")
    done = records.where("whole").select(*RECORD)
    torn = records.where("not whole")
    if torn.isEmpty():
        return done
    return done.unionByName(_joined(spark, path, placed, torn))


RECORD = ("file", "at", "kind", "page", "refers", "uri", "told", "told_bytes", "digest", "payload_bytes")


def _entries(exits: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file, block, entry): where the chain from the file's start first meets each split.

    A node is a candidate, its pointer the candidate where the chain leaves its split. Each
    round adds what the reached nodes point to and doubles the pointers.
    """
    most = blocks.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    on = exits.where("at = 0").select("file", "at", "block")
    if most > 1:
        jump = cut(exits.select("file", "at", "block", F.col("exit").alias("to")), "jump")
        node = jump.select("file", F.col("at").alias("to"), F.col("block").alias("to_block"))
        jump = cut(jump.join(node, ["file", "to"]), "jump")      # pointers that meet a candidate
        reach = 1
        while reach < most:
            more = on.join(jump, ["file", "at", "block"]).select("file", F.col("to").alias("at"), F.col("to_block").alias("block"))
            on = cut(on.unionByName(more).distinct(), "on")
            step = jump.select("file", F.col("at").alias("to"), F.col("block").alias("to_block"), F.col("to").alias("then"), F.col("to_block").alias("then_block"))
            jump = cut(jump.join(step, ["file", "to", "to_block"]).select("file", "at", "block", F.col("then").alias("to"), F.col("then_block").alias("to_block")), "jump")
            reach *= 2
    return on.groupBy("file", "block").agg(F.min("at").alias("entry"))


def _joined(spark: SparkSession, path: str, placed: DataFrame, torn: DataFrame) -> DataFrame:
    """Records whose payload holds version lines: their pieces, found by offset, put together.

    A record that leads past the end of its file is none. Of the others a second reading must find all pieces.
    """
    files = placed.groupBy("file").agg(F.max(F.col("at") + F.col("size")).alias("file_end"))
    torn = torn.join(files, "file").where("goal <= file_end").drop("file_end")
    # a record's pieces are those from its own to its successor; candidates on the way point back to the record
    ends = torn.select("file", F.col("at").alias("owner"), F.col("goal").alias("until"))
    marks = placed.select("file", "block", "key", "at").join(ends, (placed["file"] == ends["file"]) & (placed["at"] == ends["owner"]), "left") \
        .select(placed["file"], "block", "key", "at", "owner", "until")
    own = Window.partitionBy("file", "block").orderBy("at")
    last = F.last(F.when(F.col("owner").isNotNull(), F.struct("owner", "until")), ignorenulls=True)
    inside = marks.withColumn("o", last.over(own))
    # an owner of an earlier split: the last one before this split
    carried = inside.groupBy("file", "block").agg(F.max_by("o", "at").alias("tail"))
    carried = carried.withColumn("head", F.last("tail", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).drop("tail")
    owned = cut(inside.join(carried, ["file", "block"]).withColumn("o", F.coalesce("o", "head"))
                .where("o is not null and at < o.until").select("file", "key", "at", F.col("o.owner").alias("owner")), "owned")
    # equal keys have equal values, wherever they are read; a bitmap of fixed size keeps the other pieces out of the shuffle
    slot = F.conv(F.substring(F.hex("key"), 1, BITMAP_BITS // 4), 16, 10).cast("long")
    bits = spark.sparkContext.broadcast(bitmap_of(owned.select(slot.alias("slot"))))

    @F.pandas_udf("boolean")
    def may_be_owned(slots: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(bits.value, slots.to_numpy()))

    values = pieces(spark, path).select("key", "value").where(may_be_owned(slot)).dropDuplicates(["key"])
    text = owned.join(values, "key", "left")
    whole = text.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts")) \
        .join(torn.select("file", F.col("at").alias("owner"), "goal", "kind", "page", "refers", "uri", "told", "told_bytes"), ["file", "owner"])

    def digest(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                values = [p["value"] for p in r["parts"]]
                size = r["goal"] - r["owner"] - len(VERSION)
                if None in values or len(data := VERSION.encode().join(values)) < size or not (head := parse(data)):
                    raise RuntimeError(f"the archives changed while they were read: pieces of record {r['page']} at {r['owner']} are missing")
                payload = payload_of(data[head[1]:size - len(GAP)])
                out.append({k: r[k] for k in ("file", "kind", "page", "refers", "uri", "told", "told_bytes")}
                           | {"at": r["owner"], "digest": hashlib.sha1(payload).hexdigest(), "payload_bytes": len(payload)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([_CANDIDATE.field(c) if c != "at" else pa.field("at", pa.int64()) for c in RECORD]))

    return whole.mapInArrow(digest, ", ".join(f"{c} {'long' if c in ('file', 'at', 'told_bytes', 'payload_bytes') else 'string'}" for c in RECORD))


def _page(c: str) -> Column:
    return F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    r = read_archives(spark, path)
    revisit = F.col("kind") == "revisit"
    return r.select(
        F.when(_page("page") != "", _page("page").cast("long")).alias("page_id"),
        F.when(revisit, F.col("told_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("told", ":", -1)).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"), F.when(revisit, _page("refers").cast("long")).alias("refers_to"))
