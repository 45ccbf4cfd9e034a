"""The corpus pipeline against plain expectations on planted rows: junk, near copies, test passages, secrets, odd rows."""

import random
from collections import defaultdict

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wiretally.llm import packing
from wiretally.llm.shared import cut

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SECRET = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def prose(rnd, n):
    return " ".join(rnd.choice("the cat sat on a mat and ran home again while rain fell over old hills near quiet towns by sea".split()) + rnd.choice(["", "", "", f"{rnd.choice('bcdfgmnprst')}{rnd.randrange(900)}x", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd, d = random.Random(8), str(tmp_path_factory.mktemp("sf"))
    good = {i: prose(rnd, rnd.randrange(60, 160)) for i in range(120)}
    junk = {200 + i: " ".join(rnd.choice(["BUY!!", "NOW!!", "a | b |", "x***", "$$$"]) + f"{rnd.randrange(99)}" for _ in range(rnd.randrange(60, 160))) for i in range(60)}
    near = {300 + i: good[i].replace(" the ", " THE ", 1) + " tail" for i in range(10)}
    items = [prose(rnd, 60) for _ in range(3)]
    leaks = {400 + i: f"{prose(rnd, 50)} {x} {prose(rnd, 40)}" for i, x in enumerate(items)}
    secret = {500: f'{prose(rnd, 80)} token = "{SECRET}" {prose(rnd, 20)}'}
    rows = [(i, t, "en", "s", len(t)) for i, t in (good | junk | near | leaks | secret).items()]
    rows += [rows[0], (600, prose(rnd, 90), None, None, None)]
    spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("k")).repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in [*good, *junk]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows


def test_stages_and_run(spark, tables):
    d, rows = tables
    texts = {i: t for i, t, *_ in rows}
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = cut(stage(spark, docs, d), "test")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = lambda name: sorted(r.doc_id for r in seen[name].select("doc_id").collect())
    kept = ids("quality classifier")
    assert not [i for i in kept if 200 <= i < 300] and len(kept) >= 0.97 * (len(rows) - 60)
    # of each planted group the first goes on, a repeated row once; nothing else goes
    single = ids("MinHash near-dedup")
    assert single == sorted({i for i in kept if not (300 <= i < 310 and i - 300 in kept)})
    clean = ids("benchmark decontamination")
    assert clean == [i for i in single if not 400 <= i < 410]
    safe = {r.doc_id: r.text for r in seen["secret scans"].collect()}
    assert sorted(safe) == clean and SECRET not in safe[500] and all(safe[i] == texts[i] for i in safe if i != 500)
    spec = open(P.path("byte_bpe_50k.json"), encoding="utf-8").read()
    pieces = defaultdict(list)
    for r in seen["packing"].collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for i, t in safe.items():
        want = packing.ids_of(t, spec, P.PATTERN)
        at = 0
        for start, length, crc in sorted(pieces[i]):
            assert start == at and crc == packing.crc(want[start:start + length])
            at += length
        assert at == len(want)
    columns = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).select(columns).collect())) == sorted(map(tuple, seen["packing"].select(columns).collect()))


def test_no_rows_and_odd_rows(spark, tables, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    odd = [(1, None, None, None, None), (None, "a b", "en", "s", 3), (None, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, " \n\t", "en", "s", 3)]
    spark.createDataFrame(odd, DOCS).write.parquet(f"{d}/documents.parquet")
    got = corpus_pipeline.run(spark, d).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, None}
    spark.createDataFrame([], DOCS).write.mode("overwrite").parquet(f"{d}/documents.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
