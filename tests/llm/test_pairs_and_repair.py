"""Operators 11 to 13 against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from wiretally.llm import conversation_repair, hard_negatives, jaccard_join
from wiretally.llm.shared import maybe_in
from pyspark.sql import functions as F

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            out += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))


def plain_report(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, hash: forward over (cost, audit, lines) of every state."""
    rows, seen, counts = hurt(rows), set(), [0, 0, 0]
    after = {"": "us", "s": "u", "u": "a", "a": "u"}
    end = lambda q: "" if q is None else q

    def inserted(best):
        for _ in range(3):
            for q, (cost, audit, lines) in list(best.items()):
                r = "user" if "u" in after[end(q)] else "assistant"
                new = (cost + 3, audit + "I", [*lines, r + ":"])
                best[r[0]] = min(best.get(r[0], new), new)
        return best

    best = {"": (0, "", [])}
    for _, role, text in rows:
        core = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = 0 if not core else 1 if (role, text) in seen else 2 if core[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        new, extra = {}, 3 * (fault == 2)
        for q, (cost, audit, lines) in inserted(best).items():
            ways = [(q, (cost + 4, audit + "D", lines))]
            if fault not in (0, 1):
                if role[:1] and role[:1] in after[q]:
                    ways.append((role[0], (cost + extra, audit + "K", [*lines, f"{role}:{text}"])))
                r = "user" if "u" in after[q] else "assistant"
                ways.append((r[0], (cost + 3 + extra, audit + "R", [*lines, f"{r}:{text}"])))
            for to, way in ways:
                new[to] = min(new.get(to, way), way)
        best = new
    cost, audit, lines = min(w for q, w in inserted(best).items() if q in ("", "a")) if rows else (0, "", [])
    turns = [t for t, *_ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def talks(seed):
    rnd, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "Why?", "and so", "", " \t", "Yes. \n", "x" * 300 + "."]
    for conv in range(60):
        for turn in range(rnd.choice([1, 2, 5, 9, 40])):
            role = ("user", "assistant")[turn % 2] if rnd.random() < .8 else rnd.choice(["system", "user", "assistant", "tool", "", None])
            rows.append((conv, None if rnd.random() < .03 else turn + (rnd.random() < .05), role, None if rnd.random() < .03 else rnd.choice(texts) if rnd.random() < .3 else f"Turn {turn} of {conv}."))
    return rows + [(None, t, "user", "Lost.") for t in range(4)] + [(77, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(700)] + [(0, 0, "user", "same.")] * 3


@pytest.mark.parametrize("chunk", [1, 3, 256])
def test_repair_equals_a_plain_search(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversation_repair, "CHUNK", chunk)
    rows = talks(chunk)
    table = spark.createDataFrame([(*r, "x") for r in rows], CONVERSATIONS + ", key string").repartition(7)
    got = conversation_repair.reported(table).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    assert {r.conv_id: tuple(r)[1:] for r in got} == {c: plain_report(g) for c, g in groups.items()} and len(got) == len(groups)


def test_repaired_turns_alternate_and_empty_tables(spark):
    edits = conversation_repair.repaired(spark.createDataFrame(talks(5), CONVERSATIONS)).orderBy("conv_id", "place").collect()
    by = defaultdict(list)
    for e in edits:
        by[e.conv_id].append(e)
    for es in by.values():
        assert [e.place for e in es] == list(range(1, len(es) + 1))
        assert re.fullmatch("(s?(ua)+)?", "".join(e.role[0] for e in es if e.edit != "D"))
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert conversation_repair.reported(empty).count() == 0 and conversation_repair.repaired(empty).count() == 0


def test_fix_up_stops_early_with_the_same_vector():
    import numpy as np
    rnd = np.random.default_rng(1)
    codes = [rnd.integers(0, 16, n) for n in (1, 2, 7, 100, 100)]
    was, came = np.tile(conversation_repair.END, (5, 1)), rnd.integers(0, 7, (5, 4))
    came[3] = was[3] + 5
    came = conversation_repair._inserted(came)
    want = conversation_repair.backward(codes, came)
    assert (conversation_repair.fixed_up(codes, was, came, conversation_repair.backward(codes, was)) == want).all()


def plain_negatives(rows):
    import math
    ok = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows
          if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = [min(x for x in ok if x[0] == i) if sum(x[0] == i for x in ok) > 1 else next(x for x in ok if x[0] == i) for i in sorted({x[0] for x in ok})]
    out = set()
    for i, lab, v in ok:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in ok if j != i)
        for p, j, _ in [x for x in scored if x[2] == lab][:5]:
            hits = [(n, k) for n, k, m in scored if m != lab and 30 * -p <= 100 * -n <= 90 * -p][:10]
            out |= {(i, j, rank + 1, k, -p, -n) for rank, (n, k) in enumerate(hits)}
    return out


@pytest.mark.parametrize("tile", [(4096, 8192), (2, 50)])
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(hard_negatives, "ANCHORS", tile[0])
    monkeypatch.setattr(hard_negatives, "ROWS", tile[1])
    rnd = random.Random(tile[0])
    rows = [(i, [rnd.choice([0.0, 0.25, 1.0, rnd.gauss(0.3, 1)]) for _ in range(6)], rnd.randrange(3)) for i in range(-300, 400)]
    rows += [(1000, [0.0] * 6, 1), (1001, [1.0] * 6, None), (1002, None, 1), (1003, [1.0, None], 1), (1004, [float("nan")] * 6, 1), (None, [1.0] * 6, 1), (1005, [1.0, 2.0], 1), (1006, [], 2), (1100, [9.0] * 6, 77)]
    rows += rows[:150] + [(1200, [2.0] * 6, 0)] * 40 + [(1201 + k, [1.0] * 6, k % 2) for k in range(60)]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, q int").repartition(5)
    got = hard_negatives.mined(table, F.col("vec_id") % 100 == 0).collect()
    assert {tuple(r) for r in got} == plain_negatives(rows) and len(got) == len(set(got)) > 100
    assert hard_negatives.mined(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_products_beyond_floats_wrap():
    import numpy as np
    a = np.array([[2**40, 3], [2**62, 1]])
    assert (hard_negatives.inner(a, a) == np.array([[2**80 % 2**64 + 9, 3], [3, 1]])).all()
    keys = hard_negatives.packed(np.array([-5, 7]), np.array([-2**63, 2**63 - 1]), 1, np.array([3, -4]))
    import pyarrow as pa
    assert [x.tolist() for x in hard_negatives.unpacked(pa.array([k.tobytes() for k in keys], pa.binary()))] == [[-5, 7], [-2**63, 2**63 - 1], [1, 1], [3, -4]]


def plain_components(rows, width):
    import itertools
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
            root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted(((d, len(sets[i]), d if d is None or not sets[i] else min(least[find(i)])) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("heads,tile,width", [(64, 512, 5), (2, 3, 5), (3, 512, 4)])
def test_join_equals_all_pairs(spark, monkeypatch, heads, tile, width):
    monkeypatch.setattr(jaccard_join, "HEADS", heads)
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rnd = random.Random(heads)
    some = lambda n: [f"w{rnd.randrange(2000)}" for _ in range(n)]
    common, bases, texts = some(60), [some(n) for n in (12, 40, 80, 300)], []
    for base in bases:
        for _ in range(30):
            copy = list(base)
            for _ in range(rnd.randrange(0, max(2, len(base) // 18))):
                copy[rnd.randrange(len(copy))] = rnd.choice(["x", f"y{rnd.randrange(9)}"])
            texts.append(" ".join(copy if rnd.random() < .9 else copy + some(len(copy) // 10)))
    texts += [" ".join(common + some(rnd.randrange(3, 60))) for _ in range(40)]       # a passage in many texts
    texts += [" ".join(some(rnd.randrange(1, 9))) for _ in range(20)] + ["one two", "One\tTWO ", "", None, " \n", "ABC " * 50, "abc " * 51, texts[0], texts[0].upper()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[70]), (None, texts[5]), (None, None)]
    table = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, n int").repartition(5)
    got = jaccard_join.joined(table, width).collect()
    want = plain_components(rows, width)
    assert len({w[2] for w in want}) < len(rows) - 60
    # two rows may share an id: both are then found under its component
    assert sorted((tuple(r) for r in got), key=str) == want


def test_join_of_nothing(spark):
    assert jaccard_join.joined(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefixes_hold_the_shared_elements_they_promise():
    import numpy as np
    rnd = np.random.default_rng(3)
    often = rnd.integers(0, 40, 400).astype(float)
    linked = 0
    for _ in range(300):
        n = int(rnd.integers(1, 120))
        x = np.sort(rnd.choice(400, n, replace=False).astype(np.uint64))
        y = np.unique(np.concatenate([x[rnd.random(n) > .1], rnd.choice(400, int(rnd.integers(0, n // 8 + 1)), replace=False).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if not len(y) or 100 * common < 80 * (len(x) + len(y) - common):
            continue
        linked += 1
        (l, p), (k, q) = jaccard_join.prefix(x, often[x.astype(int)]), jaccard_join.prefix(y, often[y.astype(int)])
        assert len(np.intersect1d(p, q)) >= min(l, k)
    assert linked > 100


def test_join_sends_texts_of_candidates_only_and_deals_elements_once(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(400)]
    rows += [(400, rows[7][1] + " more"), (401, rows[9][1].upper()), (402, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    texts, plans, (texts_of, cut) = [], {}, (jaccard_join.texts_of, jaccard_join.cut)
    monkeypatch.setattr(jaccard_join, "texts_of", lambda docs: texts.append(docs) or texts_of(docs))
    monkeypatch.setattr(jaccard_join, "cut", lambda df, name: cut(plans.setdefault(name, df), name))
    got = {r.doc_id: r.component_id for r in jaccard_join.joined(table).collect()}
    assert {i: c for i, c in got.items() if i != c} == {400: 7, 401: 9}
    # the sets, the prefixes, then one round's texts
    assert [t.count() for t in texts[:2]] == [403, 403]
    assert 2 <= texts[2].count() < 10
    monkeypatch.setattr(jaccard_join, "cut", cut)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "ReusedExchange" in plans["members"].select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_that_may_be_among_wanted_keys_hold_all_of_them(spark):
    wanted = spark.createDataFrame([(3,), (-8,), (1 << 40,), (None,)], "k long")
    rows = spark.range(-20, 2000).withColumnRenamed("id", "doc_id").unionByName(spark.createDataFrame([(1 << 40,), (None,)], "doc_id long"))
    kept = {r.doc_id for r in maybe_in(rows, "doc_id", wanted).collect()}
    assert {3, -8, 1 << 40} <= kept and len(kept) < 10
    assert maybe_in(rows, "doc_id", wanted.where("k > 1 AND k < 3")).count() == 0
