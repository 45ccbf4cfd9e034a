"""Every operator against a plain version, and the awkward inputs: nulls, empty and very long
texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from contextlib import contextmanager
from math import log10
from zlib import crc32

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wiretally.llm import components as C
from wiretally.llm import decontaminate as D
from wiretally.llm import fingerprints as FP
from wiretally.llm import hmm as H
from wiretally.llm import near_dedup as N
from wiretally.llm import packing as PK
from wiretally.llm import quality as Q
from wiretally.llm import secret_scan as S
from wiretally.llm import setsketch as SK
from wiretally.llm import token_counts as T
from wiretally.llm import url_filter as U
from wiretally.llm import warc as W

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, key string, row string"
RANKS, PATTERN = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
SECRET = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


BASE = words(60, 1)
TEXTS = [(0, BASE), (1, None), (2, ""), (3, BASE), (3, BASE), (4, BASE + " tail"), (None, words(30, 2)), (5, " \t\n"), (6, "one two"), (7, "One  TWO"),
         (8, words(20000, 3, 5000)), (9, "ABC!! DEF!! " * 30), (10, words(40, 4) + " " + SECRET), (11, "naïve Ünïcode 日本 😀 text"), (None, None), (12, words(80, 5)), (13, words(80, 6))]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in rows], SCHEMA)


@contextmanager
def settings(spark, **conf):
    """Settings of the file sources, as they were afterwards."""
    names = {f"spark.sql.files.{k}": v for k, v in conf.items()}
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


# 1

def test_token_counts(docs, none):
    path = P.path("word_bpe_49k.json")
    pieces = set(T.read_pieces(open(path, encoding="utf-8").read()))

    def plain(text):
        n = 0
        for w in T.regex.findall(T.WORDS, (text or "").lower()):
            s, i = (*w.encode(), T.END), 0
            while i < len(s):
                j = next(j for j in range(len(s), i, -1) if s[i:j] in pieces or j == i + 1)
                n += s[i:j] != (T.END,)
                i = j
        return n

    got = Counter((r["doc_id"], r["n_tokens"]) for r in T.token_counts(docs, path).collect())
    assert got == Counter((i, plain(t)) for i, t in TEXTS)
    assert T.token_counts(none, path).count() == 0


def test_automaton_on_small_vocabularies():
    r = random.Random(4)
    for _ in range(300):
        pieces = {tuple(r.choices(b"abc", k=r.randint(1, 4))) + ((T.END,) if r.random() < .3 else ()) for _ in range(r.randint(0, 12))}
        a, known = T.Automaton(pieces), pieces | {(b,) for b in b"abc"}
        for _ in range(20):
            s, i, n = (*r.choices(b"abc", k=r.randint(0, 9)), T.END), 0, 0
            while i < len(s):
                j = next(j for j in range(len(s), i, -1) if s[i:j] in known or j == i + 1)
                n += s[i:j] != (T.END,)
                i = j
            assert a.count(s) == n


# 2

def test_hmm_forward_and_counts_equal_sums_over_paths():
    rng, k = np.random.default_rng(0), 3
    norm = lambda x: x / x.sum(-1, keepdims=True)
    m = H.Model(norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, 5))))
    codes = [np.array(c, np.int32) for c in ([1, 2, 3, 0], [4], [0, 0])]
    import itertools
    for c, got in zip(codes, H.forward(m, codes)):
        total, starts, moves, emits = 0, np.zeros(k), np.zeros((k, k)), np.zeros((k, 5))
        for path in itertools.product(range(k), repeat=len(c)):
            p = m.start[path[0]] * np.prod([m.emit[s, x] for s, x in zip(path, c)]) * np.prod([m.move[a, b] for a, b in zip(path, path[1:])])
            total += p
            starts[path[0]] += p
            for s, x in zip(path, c):
                emits[s, x] += p
            for a, b in zip(path, path[1:]):
                moves[a, b] += p
        assert got == pytest.approx(log10(total))
        for a, b in zip(H.expected(m, [c]), (starts, moves, emits)):
            assert np.allclose(a, b / total, atol=1e-5)


def plain_counts(m, c):
    """Expected starts, moves and emissions, and the log10 probability, in unscaled extended floats over a whole sequence."""
    f = np.longdouble
    k, n = len(m.start), len(c)
    a, b = np.zeros((n, k), f), np.ones((n, k), f)
    a[0] = m.start * m.emit[:, c[0]]
    for t in range(1, n):
        a[t] = a[t - 1] @ m.move.astype(f) * m.emit[:, c[t]]
    for t in range(n - 2, -1, -1):
        b[t] = m.move.astype(f) @ (m.emit[:, c[t + 1]] * b[t + 1])
    total = a[-1].sum()
    gamma, emit = a * b / total, np.zeros(m.emit.shape, f)
    for t in range(n):
        emit[:, c[t]] += gamma[t]
    moves = sum(np.outer(a[t], m.emit[:, c[t + 1]] * b[t + 1]) for t in range(n - 1)) * m.move / total
    return gamma[0], moves, emit, float(np.log10(total))


@pytest.mark.parametrize("window,cells", [(64, 1 << 17), (7, 128), (16, 16), (1, 1)])
def test_hmm_counts_whole_sequences(monkeypatch, window, cells):
    for name, v in (("WINDOW", window), ("CELLS", cells)):
        monkeypatch.setattr(H, name, v)
    rng, k = np.random.default_rng(2), 4
    norm = lambda x: x / x.sum(-1, keepdims=True)
    m = H.Model(norm(rng.random(k)), norm(rng.random((k, k)) ** 4), norm(rng.random((k, 30)) ** 3))
    codes = [rng.integers(0, 30, n).astype(np.int32) for n in (1000, 1, 65, 64, 300, 5, 128)]
    counts = H.Counts(m)
    counts.add(codes)
    want = [plain_counts(m, c) for c in codes]
    assert np.allclose(H.forward(m, codes), [w[3] for w in want])
    assert counts.log_p == pytest.approx(sum(w[3] for w in want), rel=1e-5)
    for got, i in ((counts.start, 0), (counts.moves * m.move, 1), (counts.emit, 2)):
        assert np.allclose(got, sum(w[i] for w in want).astype(float), rtol=2e-4, atol=2e-4)


def test_hmm_windows_run_again_only_until_they_agree(monkeypatch):
    rows, sums = [], H.sums
    monkeypatch.setattr(H, "sums", lambda x: rows.append(len(x)) or sums(x))
    rng, k = np.random.default_rng(5), 4
    norm = lambda x: x / x.sum(-1, keepdims=True)
    m = H.Model(norm(rng.random(k)), norm(rng.random((k, k)) + 0.2), norm(rng.random((k, 30)) ** 2))
    codes = [rng.integers(0, 30, n).astype(np.int32) for n in (3000, 640, 10)]
    assert np.allclose(H.forward(m, codes), [plain_counts(m, c)[3] for c in codes])
    # a row a token, and two for each that is run again
    assert 3650 <= sum(rows) < 2 * 3650


def test_hmm_memory_of_a_text_of_a_million_words():
    import tracemalloc
    rng, k = np.random.default_rng(3), H.STATES
    norm = lambda x: x / x.sum(-1, keepdims=True)
    m = H.Model(norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, 500))))
    codes = [rng.integers(0, 500, 1_000_000).astype(np.int32), *(rng.integers(0, 500, 20).astype(np.int32) for _ in range(1023))]
    for run in (lambda: H.forward(m, codes), lambda: H.expected(m, codes)):
        tracemalloc.start()
        run()
        assert tracemalloc.get_traced_memory()[1] < 500 << 20
        tracemalloc.stop()


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 9, 50])
def test_most_frequent_words(spark, n):
    rows = [(bytes([97 + i]), c) for i, c in enumerate([8, 1, 7, 8, 16, 1, 1, 2, 1000, 4])]
    got = H.most_frequent(spark.createDataFrame(rows, "word binary, c long"), n).collect()
    assert [(bytes(r["word"]), r["c"]) for r in got] == sorted(rows, key=lambda r: (-r[1], r[0]))[:n]


def test_scores(spark, docs, none):
    got = H.score(docs, states=3, own_words=50, iterations=2).collect()
    assert len(got) == len(TEXTS)
    fold = lambda i: crc32(str(i).encode() if i is not None else b"") % 5
    tok = lambda t: (t or "").encode().lower().split() + [b"\0end"]
    c = Counter(w for i, t in TEXTS if fold(i) != 1 for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for i, t in TEXTS:
        want[i].append((fold(i) == 1, len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(log10((c[w] + .5) / (n + .5 * (v + 1))) for w in tok(t)), 6)))
    have = defaultdict(list)
    for r in got:
        have[r["doc_id"]].append((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)))
        assert r["score"] < 0 and np.isfinite(r["score"])
    assert {k: sorted(x) for k, x in want.items()} == {k: sorted(x) for k, x in have.items()}
    assert H.score(none, states=2, iterations=1).count() == 0


def test_hmm_beats_the_base_where_order_matters(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["le la un et", "the a of and"][i % 2].split()) for _ in range(40))) for i in range(120)]
    got = H.score(table(spark, rows), states=2, iterations=12).agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.8 * got[1]


# 3

def shingle_set(text, width=5):
    w = re.split(r"\s+", (text or "").lower())
    w = [x for x in w if x]
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize("ranges", [1, 4])
def test_fingerprints(spark, docs, none, ranges):
    got = FP.edit_likeness(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), ranges=ranges).orderBy("doc_id").collect()
    rows = sorted({i: t or "" for i, t in TEXTS if i is not None}.items())
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    for k, ((_, t), r) in enumerate(zip(rows, got)):
        n, after = len(t), rows[(k + 1) % len(rows)][1]
        edited = t[:n - n // 4] + after[:n // 4]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, r["near_edited"]), (after, r["near_next"])):
            a, b = shingle_set(t), shingle_set(other)
            j = len(a & b) / len(a | b) if a | b else 1.0
            assert near == pytest.approx(j, abs=0 if len(a | b) <= FP.K else 0.2)
    assert got[0]["fingerprint"] == next(r for r in got if r["doc_id"] == 3)["fingerprint"]
    assert FP.edit_likeness(none).count() == 0
    assert FP.edit_likeness(docs).count() == len(TEXTS)
    assert FP.edit_likeness(table(spark, [(1, "a b c d e f g h")])).first()["near_next"] == 1.0


def test_sketches_merge(spark):
    parts = [words(300, i) for i in range(70)]
    s = table(spark, enumerate(parts)).select(F.lit(1).alias("k"), FP.sketch(F.col("text")).alias("sketch"))
    whole = sorted({h for r in table(spark, enumerate(parts)).select(FP.shingle_hashes(F.col("text")).alias("h")).collect() for h in r["h"]})
    got = FP.merge(s, "k").first()["sketch"]
    assert got == whole[:FP.K]
    n = spark.range(1).select(FP.distinct_shingles(F.lit(got)).alias("n")).first()["n"]
    assert n == pytest.approx(len(whole), rel=0.3)


# 4

@pytest.mark.parametrize("split", ["128m", "400"])
def test_warc_round_trip(spark, tmp_path, split):
    big, trap = "x" * 1200, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3
    rows = [(1, "http://a/1", big), (2, None, big), (3, "http://c\r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", trap), (8, "u", trap + big),
            (9, "u", trap + big), (10, "u", "ü" * 700), (11, "u", "WARC/1.1\r\n"), (12, "u", "end\r\n\r\n"), (None, "u", big), (13, "u", "ü" * 700), (14, "u", "y" * 5000)]
    pages = spark.createDataFrame([(*r, "junk") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    path = str(tmp_path / f"w{split}")
    W.write_archives(pages, path)
    with settings(spark, maxPartitionBytes=split, openCostInBytes="1"):
        got = {r["page"]: r for r in W.read_archives(spark, path).collect()}
    assert len(got) == len(rows)
    latest = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            latest[b] = max(latest.get(b, -1), i if i is not None else -1)
    for i, _, h in rows:
        b = (h or "").encode()
        r = got[f"<urn:page:{'none' if i is None else i}>"]
        of = latest.get(b, i)
        assert (r["kind"], r["told"], r["told_bytes"]) == ("response" if of == i else "revisit", "sha1:" + hashlib.sha1(b).hexdigest(), len(b))
        assert r["refers"] == (None if of == i else f"<urn:page:{of}>")
        if of == i:
            assert (r["digest"], r["payload_bytes"]) == (hashlib.sha1(b).hexdigest(), len(b))
    W.write_archives(pages.limit(0), path + "-none")
    assert W.read_archives(spark, path + "-none").count() == 0


@pytest.mark.parametrize("first, second", [("128m", "400"), ("700", "500")])
def test_warc_read_again_in_other_splits(spark, tmp_path, first, second):
    trap = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, "u", "z" * (i % 5) * 90 + trap * (i % 4) + str(i % 6)) for i in range(14)]
    path = str(tmp_path / "w")
    W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", first)
        read = W.read_archives(spark, path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", second)
        got = {r["page"]: (r["digest"], r["payload_bytes"]) for r in read.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {f"<urn:page:{i}>": (hashlib.sha1(h.encode()).hexdigest(), len(h)) for i, _, h in rows}


def test_warc_ends_inside_a_record_or_loses_pieces(spark, tmp_path):
    trap = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    one = lambda i, payload, more=0: (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(payload) + 4 + more}\r\n\r\n\r\n\r\n{payload}\r\n\r\n")
    path = tmp_path / "a.warc"
    path.write_bytes((one(1, trap) + one(2, "x") + one(3, trap, more=50)).encode())
    read = W.read_archives(spark, str(path))
    assert sorted(r["page"] for r in read.collect()) == ["<urn:page:1>", "<urn:page:2>"]
    read = W.read_archives(spark, str(path))
    path.write_bytes(one(2, "x").encode())      # what was read first is gone
    with pytest.raises(Exception, match="archives changed|seek after EOF"):
        read.collect()


# 5

def test_secrets(spark, docs, none):
    rnd = "EhNttOzZWHhjU6AV0QdPpeSCaiR9Tf1X"
    rows = [(1, f'é {SECRET} x'), (2, "PassWord: abc"), (3, "api_key='abcdef'"), (4, "AKIA" + "A" * 16 + " AKIAABC"), (5, "f" * 24 + " " + "f" * 23), (6, f"see {rnd} there"),
            (7, "550e8400-e29b-41d4-a716-446655440000 my_variable_name_2024_version thequickbrownfox20jumpsover"), (8, "to\u017fecret=abcdefgh token=\u212aey12345"), (9, None)]
    got = {r["doc_id"]: r for r in S.scan(table(spark, rows), RANKS, PATTERN).collect()}
    assert got[1]["spans"] == "assign:2:51,hex:11:51" and (got[1]["n_assign"], got[1]["n_hex"]) == (1, 1)
    assert got[1]["base_sha256"] == hashlib.sha256(got[1]["spans"].encode()).hexdigest()
    assert [got[i]["spans"] for i in (2, 3, 4, 5, 6, 7, 9)] == ["", "assign:0:15", "access:0:20", "hex:0:24", f"random:4:{4 + len(rnd)}", "", ""]
    assert got[8]["n_assign"] == 0       # letters beyond ASCII that fold to s and k are others
    assert S.scan(docs, RANKS, PATTERN).count() == len(TEXTS) and S.scan(none, RANKS, PATTERN).count() == 0
    clean = S.clean(docs, RANKS, PATTERN)
    assert clean.schema == docs.schema and clean.where("doc_id = 10").first()["text"].endswith('[secret]"')
    assert clean.where("doc_id <> 10 or doc_id is null").exceptAll(docs.where("doc_id <> 10 or doc_id is null")).count() == 0


def test_random_strings_of_every_form():
    enc = S.encoding(open(RANKS, "rb").read(), PATTERN)
    found = lambda t: ",".join(t[a:b] for a, k, b in S.find(t, enc) if k == 3)
    key, letters = "i0VpEBOWfbZAVaBSo63bbH6x", "lvblwzmmlxpbRCHjZSgrLKWvRIpETSAE"
    for s in (letters, "q7Xv2LkP9sTz", "kqzvxwjpfhgtbnmcqdkz", "QZKXVJWPHGFTBNMCQDKZ", "aB3xZ/yK9+Lq2W"):
        assert found(f"see {s} there") == s
    assert found(f"/documents/customers/reports/download/signature/{key}") == key
    assert found(f"/documents/customers/reports/{key}/v2/archive/signature/download") == key
    assert found("/objects/550e8400-e29b-41d4-a716-446655440000/" + key) == key and found("/o/550e8400-e29b-41d4-a716-446655440000/x") == ""
    assert found("x q7Xv2LkP9sTzAKIA" + "A" * 16) == "q7Xv2LkP9sTz"
    assert found("f" * 24 + "/" + key) == key and found("f" * 24 + "Zq8xT4wP") == "Zq8xT4wP"
    base = S.find("token=abcdefgh " + "f" * 24 + key, enc)
    assert [k for _, k, _ in base] == [0, 2, 3]
    for s in ("internationalization INTERNATIONALIZATION Bundesverfassungsgericht anticonstitutionnellement getElementById StackOverflowException",
              "2024-01-15T10:30 a_b_c_d_e_f_g_h_i_j_k_l my_variable_name_2024_version 4785380592391139 1234-5678-9012-3456-7890", "/usr/share/documents/reports/2024/archive"):
        assert found(s) == ""
    r = random.Random(12)
    for n, least in ((12, 0.99), (16, 0.99), (20, 0.99), (32, 0.99)):
        for alphabet in ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
            keys = ["".join(r.choices(alphabet, k=n)) for _ in range(300)]
            assert sum(found(f"see {k} there") == k for k in keys) >= least * 300


# 6

def test_tiling_equals_a_plain_version():
    def plain(a, b, least):
        fa, fb, tiles = [True] * len(a), [True] * len(b), 0
        while True:
            best = (least - 1, 0, 0)
            for i in range(len(a)):
                for j in range(len(b)):
                    k = 0
                    while i + k < len(a) and j + k < len(b) and fa[i + k] and fb[j + k] and a[i + k] == b[j + k]:
                        k += 1
                    if k > best[0]:
                        best = (k, i, j)
            if best[0] < least:
                return tiles
            for k in range(best[0]):
                fa[best[1] + k] = fb[best[2] + k] = False
            tiles += best[0]

    r = random.Random(3)
    for _ in range(150):
        a, b = ([r.randrange(1, 4) for _ in range(r.randint(0, 14))] for _ in range(2))
        got = D.tile(np.array(a, np.uint64), [np.array(b, np.uint64)], 2)
        assert len({x for i, _, _, n in got for x in range(i, i + n)}) == sum(n for *_, n in got)
        assert abs(sum(n for *_, n in got) - plain(a, b, 2)) <= 2     # ties of one length may be cut differently


def test_leaks(spark, none):
    item = words(30, 77, 10**6)
    w = item.split()
    mixed = " ".join([*w[20:], "filler text here", *w[:10], "more filler", *w[10:20]]).upper().replace(" ", ", ")
    rows = [(1, words(50, 8) + " " + item + " end"), (2, mixed), (3, " ".join(w[:8])), (4, words(500, 9)), (5, None), (6, ""), (1, words(50, 8) + " " + item + " end"), (None, item)]
    bench = spark.createDataFrame([(1, item, "c"), (2, words(40, 78, 10**6), "c"), (3, "too short", "c"), (4, None, "c")], "item_id long, text string, coverage string")
    got = D.with_leaks(table(spark, rows), bench).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["contaminated"], r["item_id"]) for r in got} == {1: (True, 1), 2: (True, 1), 3: (False, 1), 4: (False, None), 5: (False, None), 6: (False, None), None: (True, 1)}
    kept = D.decontaminated(table(spark, rows), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6] and kept.columns == none.columns
    assert D.with_leaks(none, bench).count() == 0
    assert D.with_leaks(table(spark, rows), bench.limit(0)).where("contaminated").count() == 0


# 7

def test_rules_and_hosts(spark):
    rows = [(1, "http://A.NET/x"), (2, "https://m.Example.net/en/1?q#f"), (3, "http://example.com/de"), (4, "http://www.example.com/de/1"), (5, "x.org/fr/"), (6, "ftp://x.org/fr/?a://b"),
            (7, None), (8, ""), (9, "http://evilexample.com/de/"), (10, "http://a.net"), (11, "http://"), (11, "http://"), (None, "http://b.net/")]
    pages = spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, host string, verdict string")
    model = U.train(U.labelled_urls(spark))
    got = [(r["page_id"], r["host"], r["path"], r["rule"]) for r in U.judge(pages, model).collect()]
    assert got == [(1, "a.net", "/x", "net/"), (2, "m.example.net", "/en/1", "example.net/en/"), (3, "example.com", "/de", None), (4, "www.example.com", "/de/1", "example.com/de/"),
                   (5, "", "", None), (6, "x.org", "/fr/", "org/fr/"), (7, "", "", None), (8, "", "", None), (9, "evilexample.com", "/de/", None), (10, "a.net", "", None),
                   (11, "", "", None), (11, "", "", None), (None, "b.net", "/", "net/")]
    assert U.judge(pages.limit(0), model).count() == 0


def test_urls_of_unseen_sites(spark, tmp_path):
    """Every site is judged by a model that has not seen it, four parts in turn; the figure is in README."""
    names = [(n, y) for y, ns in ((1, U.UNWANTED), (0, U.WANTED)) for n in ns]
    right = total = 0
    for part in range(4):
        path = str(tmp_path / f"labels{part}")
        U.labelled_urls(spark, names=[x for i, x in enumerate(names) if i % 4 != part]).write.parquet(path)
        held = U.labelled_urls(spark, names=[x for i, x in enumerate(names) if i % 4 == part]).withColumn("page_id", F.monotonically_increasing_id())
        got = U.judge(held, U.train(U.labelled_urls(spark, path)), rules=[]).join(held.select("page_id", "label"), "page_id")
        right, total = right + got.where("(verdict = 'block') = (label = 1)").count(), total + got.count()
    print(f"unseen sites judged right: {right / total:.3f}")
    assert total == len(names) * 4 * U.PAGES_EACH and right / total > 0.6


@pytest.mark.parametrize("length", ["9" * 20, "9" * 5000, "²", "-3", "", "999999999999999999"])
def test_warc_hostile_lengths_in_payloads(spark, tmp_path, length):
    payload = f"x\r\n\r\nWARC/1.1\r\nWARC-Record-ID: <urn:page:666>\r\nWARC-Payload-Length: {length}\r\nContent-Length: {length}\r\n\r\nabc"
    pages = spark.createDataFrame([(1, "u", payload), (2, "u", "fine")], "page_id long, url string, html string")
    W.write_archives(pages, str(tmp_path / "w"))
    got = {r["page"]: r["payload_bytes"] for r in W.read_archives(spark, str(tmp_path / "w")).collect()}
    assert got == {"<urn:page:1>": len(payload.encode()), "<urn:page:2>": 4}


# 8

def test_gradients():
    rng = np.random.default_rng(1)
    x, bag, y = rng.random((7, Q.FEATURES)), np.array([0, 0, 0, 1, 2, 2, 2]), np.array([1., 0., 1.])
    net = Q.fit([x[bag == i].astype(np.float32) for i in range(3)], [1, 0, 1])
    loss = lambda: -np.mean(y * np.log(s := net.score([(x, bag)], 3)) + (1 - y) * np.log(1 - s))
    for k, g in net.gradients(x, bag, 3, y, penalty=0).items():
        i = tuple(0 for _ in g.shape)
        net.p[k][i] += 1e-5
        up = loss()
        net.p[k][i] -= 2e-5
        down = loss()
        net.p[k][i] += 1e-5
        assert g[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_quality(spark, docs, none):
    r = random.Random(5)
    good = [" ".join(r.choice("the cat sat on a mat and ran home again".split()) + r.choice(["", "", "", "."]) for _ in range(r.randint(5, 300))) for _ in range(150)]
    bad = [" ".join(r.choice(["BUY!!", "NOW!!", "a | b |", "x***"]) for _ in range(r.randint(5, 300))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(i, int(i < 150), 0, "x") for i in range(300)] + [(None, 1, 0, "x"), (3, None, 0, "x"), (3, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    got = Q.score(table(spark, rows), labels).collect()
    assert len(got) == 300
    wrong = [x["doc_id"] for x in got if x["held_out"] and x["predicted"] != (x["doc_id"] < 150)]
    assert len(wrong) <= 2 and all(x["held_out"] == (crc32(str(x["doc_id"]).encode()) % 5 == 0) and 0 <= x["score"] <= 1 for x in got)
    odd = Q.score(docs, labels).collect()
    assert len(odd) == len(TEXTS) and all(0 <= x["score"] <= 1 for x in odd)
    assert Q.score(none, labels).count() == 0
    assert {x["score"] for x in Q.score(docs, labels.limit(0)).collect()} == {0.5}
    kept = Q.kept(table(spark, rows), labels)
    assert kept.schema == none.schema and 140 <= kept.count() <= 160


def test_a_passage_is_coded_alone_and_in_a_batch():
    texts = [t for _, t in TEXTS]
    x, bag = Q.encode(texts)
    for i, t in enumerate(texts):
        assert np.allclose(Q.encode([t])[0], x[bag == i], atol=1e-6)


def test_long_texts_are_coded_in_pieces(monkeypatch):
    """Cuts change neither passages nor scores, whatever their place."""
    texts = [words(3000, 8), "", words(10, 9) + " " * 700 + "END.", words(700, 3) + "\n\n", None, "x"]
    whole, bags = Q.encode(texts)
    net = Q.fit([whole[bags == i] for i in range(6)], [1, 0, 1, 0, 1, 0])
    want = net.forward(whole, bags, 6)["score"]
    for size in (900, 1500, 4000):
        monkeypatch.setattr(Q, "PIECE", size)
        assert max(sum(map(len, raw)) for raw, *_ in Q.pieces(texts)) <= size + 1
        x, bag = Q.encode(texts)
        assert (bag == bags).all() and np.allclose(x, whole, atol=1e-6)
        assert np.allclose(Q.scores_of(texts, net), want)


def test_memory_of_coding_is_bounded():
    """A text of 16 MB, and one of a single word, take no more than a few pieces and the text itself."""
    import tracemalloc
    net = Q.fit([rng.random((3, Q.FEATURES)).astype(np.float32) for rng in map(np.random.default_rng, range(4))], [0, 1, 0, 1])
    for text in ("some words of it " * (1 << 20), "w" * (16 << 20), " " * (16 << 20)):
        tracemalloc.start()
        Q.scores_of([text], net)
        assert tracemalloc.get_traced_memory()[1] < 150 << 20
        tracemalloc.stop()


def test_training_reads_all_passages(spark):
    """Documents whose label follows from one passage among hundreds."""
    r = random.Random(2)
    plain = lambda n: " ".join(r.choice("the cat sat on a mat and ran home again".split()) for _ in range(n))
    rows = [(i, plain(64 * (40 + i)) + (" BUY!! NOW!! |" * 32 if i % 2 else "") + " " + plain(64 * 273)) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    got = Q.score(table(spark, rows), labels).collect()
    assert sum((x["score"] > 0.5) == (x["doc_id"] % 2 == 1) for x in got if x["held_out"]) >= 0.9 * sum(x["held_out"] for x in got)
    few = Q.train(table(spark, rows), labels, passages=1000)     # a smaller sample of whole documents
    assert few.constant is None


# 9

def sets(text, width=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_setsketch():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 6000, dtype=np.uint64) * np.uint64(2)
    a, b = np.unique(pool[:4000]), np.unique(pool[1000:5000])
    k = SK.registers(np.concatenate([a, b]), np.array([0, len(a)]))
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert SK.jaccard(k[:1], k[1:], np.array([len(a)]), np.array([len(b)]))[0] == pytest.approx(j, abs=0.17)
    assert SK.cardinality(k[0]) == pytest.approx(len(a), rel=0.4)
    assert (SK.merged(k[0], k[1]) == SK.registers(np.union1d(a, b), np.array([0]))[0]).all()
    assert SK.jaccard(k[:1], k[:1], np.array([4000.]), np.array([4000.]))[0] == 1
    parts = [np.unique(pool[i * 40:i * 40 + 400 + 60 * (i % 3)]) for i in range(120)]
    k, n = SK.registers(np.concatenate(parts), np.cumsum([0] + [len(x) for x in parts[:-1]])), np.array([float(len(x)) for x in parts])
    for step in (1, 2, 3):
        j = SK.jaccard(k[step:], k[:-step], n[step:], n[:-step])
        clear = abs(j - 0.55) > 0.01
        assert (SK.reaches(k[step:], k[:-step], n[step:], n[:-step], 0.55) == (j >= 0.55))[clear].all()


def test_near_groups_equal_all_pairs(spark, none, monkeypatch):
    monkeypatch.setattr(N, "HEADS", 2)         # more rounds before the last
    r = random.Random(9)
    rows = list(TEXTS)
    for g in range(25):                        # chains of edits: links that are not transitive
        w = words(r.randint(3, 70), 100 + g).split()
        for _ in range(r.randint(1, 14)):
            rows.append((len(rows) + 20, " ".join(w)))
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = f"n{r.randrange(999)}"
    big = words(90, 500).split()               # a large group around one text
    for i in range(60):
        w = big.copy()
        for _ in range(3):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        rows.append((5000 + i, " ".join(w)))
    known = [(i, sets(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in known}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(known)):
        for b in range(a):
            (i, s), (j, t) = known[a], known[b]
            if s and t and 100 * len(s & t) >= 80 * len(s | t) and top(i) != top(j):
                up[max(top(i), top(j))] = min(top(i), top(j))
    df = table(spark, rows).repartition(4)
    got = N.near_dedup(df).collect()
    assert len(got) == len(rows)
    assert {(x["doc_id"], x["component_id"]) for x in got if x["doc_id"] is not None} == {(i, top(i)) for i in up}
    assert {(x["doc_id"], x["n_shingles"]) for x in got if x["doc_id"] is not None} == {(i, len(s)) for i, s in known}
    kept = N.deduplicated(df)
    ids = Counter(x["doc_id"] for x in kept.collect())
    assert kept.columns == none.columns and set(ids) == {i for i in up if top(i) == i} | {None} and all(n == 1 for i, n in ids.items() if i is not None)
    assert N.near_dedup(none).count() == 0 and N.deduplicated(none).count() == 0


def test_the_stage_takes_shingles_of_five_words(spark):
    import corpus_pipeline

    w = [f"u{i}" for i in range(120)]
    changed = [f"n{i}" if i in (30, 60, 90) else x for i, x in enumerate(w)]
    near = [f"n{i}" if i == 60 else x for i, x in enumerate(w)]
    a, b, c = (" ".join(x) for x in (w, changed, near))
    like = lambda x, y, n: len(sets(x, n) & sets(y, n)) / len(sets(x, n) | sets(y, n))
    assert like(a, b, 4) >= 0.8 > like(a, b, 5) and like(a, c, 5) >= 0.8
    far, copies = table(spark, [(1, a), (2, b)]), table(spark, [(1, a), (3, c)])
    assert sorted(r["doc_id"] for r in corpus_pipeline.minhash_near_dedup(spark, far, "").collect()) == [1, 2]
    assert [r["doc_id"] for r in corpus_pipeline.minhash_near_dedup(spark, copies, "").collect()] == [1]
    assert [r["doc_id"] for r in N.near_dedup(far).where("kept").collect()] == [1]


def test_components(spark):
    r = random.Random(2)
    links = [(a, a + 1) for a in range(40)] + [(100, b) for b in range(101, 160)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    up = {x: x for e in links for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(top(a), top(b))] = min(top(a), top(b))
    got = {x["key"]: x["root"] for x in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for e in links if e[0] != e[1] for x in e}


# 10

def check_pieces(pieces, rows, window):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for i, x in rows:
        want[(i, len(t.encode(x or "", add_special_tokens=False).ids) + 1)] += 1
    tokens = Counter()
    for p in pieces:
        tokens[(p["doc_id"], p["doc_tokens"])] += p["length"]
    assert tokens == Counter({k: k[1] * n for k, n in want.items()})
    for i, x in {i: x for i, x in rows if i is not None and sum(j == i for j, _ in rows) == 1}.items():
        ids, at = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for p in sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"]):
            assert p["start"] == at and p["ids_crc32"] == crc32(ids[at:at + p["length"]].tobytes())
            at += p["length"]
    by = defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append(p)
    for s in by.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
    return [sum(p["length"] for p in s) for s in by.values()]


def test_packing(spark, docs, none):
    path = P.path("byte_bpe_50k.json")
    assert sum(n < 1024 for n in check_pieces(PK.packed(docs, path, PATTERN).collect(), TEXTS, 1024)) <= 1
    r = random.Random(6)
    rows = [(i, words(r.randint(0, 60), i)) for i in range(400)]
    assert sum(n < 64 for n in check_pieces(PK.packed(table(spark, rows), path, PATTERN, window=64).collect(), rows, 64)) <= 1
    assert PK.packed(none, path, PATTERN).count() == 0


@pytest.mark.parametrize("blank", ["\n", " ", "\t \r\n"])
def test_packing_long_blanks(blank):
    """Runs that the faster library cannot read have the ids of the other one."""
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    spec = open(path, encoding="utf-8").read()
    exact = Tokenizer.from_str(spec)
    for n in (5, 999, 1000, 1001, 1_000_000):
        text = "a" + (blank * n)[:n] + "b c"
        assert PK.ids_of(text, spec, PATTERN)[:-1].tolist() == exact.encode(text, add_special_tokens=False).ids


def test_packing_without_a_look_ahead_gives_the_same_ids(monkeypatch):
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    spec = open(path, encoding="utf-8").read()
    exact, r = Tokenizer.from_str(spec), random.Random(4)
    some = ["a", "Zoo", "it's", "'s", "'ll", "x9", "12", "--", "é", "ñandú", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2009", "漢", " ", " ", " ", " ", "  ", "q" * 70]
    texts = [None, "", " ", "  ", " a", "a ", "a\n", "\na b", " a b ", "a  b", "a\tb c", "don't 's", "a\xa0", "a\x85 b", "<|endoftext|>", *("".join(r.choices(some, k=r.randrange(1, 30))) for _ in range(2000))]
    got = list(PK.ids_of_all(pa.array(texts), spec, PATTERN))
    for x, ids in zip(texts, got, strict=True):
        assert ids.dtype == np.uint32 and ids.tolist() == PK.ids_of(x, spec, PATTERN).tolist()
        assert not x or "<|" in x or ids[:-1].tolist() == exact.encode(x, add_special_tokens=False).ids
    assert list(PK.ids_of_all(pa.array([], pa.string()), spec, PATTERN)) == []
    # the slow pattern is for texts with blanks that meet, or other letters
    slow, ids_of = [], PK.ids_of
    monkeypatch.setattr(PK, "ids_of", lambda x, *a: slow.append(x) or ids_of(x, *a))
    list(PK.ids_of_all(pa.array(["one two\n", "à la", "a\n\nb", "漢 a", None]), spec, PATTERN))
    assert slow == ["a\n\nb", "漢 a", None]


def test_least_squares_meets_a_histogram_of_combinations():
    combos = PK.combinations(np.arange(1, 16), 16)
    x = np.zeros(len(combos))
    x[::5] = 40
    h = np.bincount(combos.ravel(), np.repeat(x, 3) * (combos > 0).ravel(), 16)
    got = PK.least_squares(combos, h, 2000)
    assert (got >= 0).all() and np.abs(np.bincount(combos.ravel(), np.repeat(got, 3) * (combos > 0).ravel(), 16) - h)[1:].max() < 0.5


def test_parity_bound_loses_no_link():
    rng = np.random.default_rng(5)
    linked = dropped = 0
    for _ in range(400):
        size, new = int(rng.integers(1, 900)), int(rng.integers(0, 200))
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() / 3], rng.integers(0, 2**64, new, dtype=np.uint64)]))
        if not len(b):
            continue
        bits = N.parities(np.concatenate([a, b]), np.array([len(a), len(b)]))
        far = bool(N.apart(np.bitwise_count(bits[0] ^ bits[1]).sum(dtype=np.int64), len(a) + len(b)))
        common = len(np.intersect1d(a, b))
        link = 100 * common >= N.LIKE * (len(a) + len(b) - common)
        assert not (link and far)
        linked, dropped = linked + link, dropped + far
    assert linked > 50 and dropped > 50
