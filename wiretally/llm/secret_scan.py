"""Secrets in texts: fixed patterns, and strings that a vocabulary finds hard to spell.

Text that people write falls into long tokens; keys and passwords drawn at random fall
into short ones. A string is suspect if its characters per token, under a vocabulary of
byte pairs, are few. Digests, UUIDs, numbers and identifiers made of words are excluded
first: they are random or odd as well, but no secrets. A run that is not random as a whole
is tested by its parts between separators, so a key in a path is found.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from wiretally.llm.shared import slices

# Fixed patterns of the three base kinds, and what a match must have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")       # the longest run, 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")              # the longest run
KINDS = ("assign", "access", "hex", "random")
HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")    # without one of them nothing is assigned

RUN = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
LEAST = 12              # characters of a random string
LEAST_RATIO = 2.3       # characters per token below which a string is random
# Strings that also arise without chance have a lower bound: letters of one case (rare words), short strings of several parts (times, versions).
LONG = 20               # characters from which the second bound of words and the common one of parts hold
WORD_RATIOS = (1.8, 2.1)
PARTS_RATIO = 1.6
LEAST_REST = 6          # characters of a string that touches a base span
DIGEST_SIZES = (32, 40, 48, 56, 64, 96, 128)
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
INNER_UUID = re.compile(rf"(?<![A-Za-z0-9]){UUID.pattern}(?![A-Za-z0-9])")
PART = re.compile(r"[A-Za-z0-9]+=*")
WORDY = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]+|[0-9]+")       # a part of an identifier


@cache
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def excluded(s: str) -> bool:
    """Known digests, UUIDs, numbers, and identifiers or paths made of words. A single word is left to its ratio."""
    core = s.rstrip("=")
    if DIGEST.fullmatch(core) and len(core) in DIGEST_SIZES or UUID.fullmatch(core):
        return True
    if not re.search(r"[A-Za-z]", core):
        return True
    return not core.isalpha() and all(WORDY.fullmatch(p) for p in re.split(r"[-_/+]", core))


def is_random(s: str, enc: tiktoken.Encoding, least_ratio: float) -> bool:
    core = s.rstrip("=")
    if len(core) < LEAST or excluded(s):
        return False
    if core.isalpha() and WORDY.fullmatch(core):
        s, bound = core.lower(), WORD_RATIOS[len(core) >= LONG]     # capitals are spelled in short tokens
    else:
        bound = PARTS_RATIO if len(core) < LONG and not core.isalnum() else least_ratio
    return len(s) < min(bound, least_ratio) * len(enc.encode_ordinary(s))


def random_in(text: str, a: int, b: int, enc: tiktoken.Encoding, least_ratio: float) -> list[tuple[int, int]]:
    """The random spans of a run: all of it, or else parts; parts side by side that the vocabulary finds hard are one string."""
    if b - a < LEAST:
        return []
    if is_random(text[a:b], enc, least_ratio):
        return [(a, b)]
    groups = [[]]
    for m in PART.finditer(text, a, b):
        s = m.group()
        if len(s) < least_ratio * len(enc.encode_ordinary(s)):
            groups[-1].append(m.span())
        else:
            groups.append([])
    out = []
    for g in groups:
        long = [k for k, (i, j) in enumerate(g) if j - i >= 4]      # short parts at the ends, as of a path, belong to what is around
        g = g[long[0]:long[-1] + 1] if long else []
        if g and is_random(text[g[0][0]:g[-1][1]], enc, least_ratio):
            out.append((g[0][0], g[-1][1]))
        else:
            out += [(i, j) for i, j in g if is_random(text[i:j], enc, least_ratio)]
    return out


def random_spans(text: str, enc: tiktoken.Encoding, least_ratio: float = LEAST_RATIO, base: list[tuple[int, int, int]] = ()) -> list[tuple[int, int]]:
    """Random strings outside the base spans (start, kind, end; ascending); what a base span or a UUID leaves of a run is a run of its own."""
    out, k = [], 0
    for m in RUN.finditer(text):
        a, b = m.span()
        if b - a < LEAST:
            continue
        while k < len(base) and base[k][2] <= a:
            k += 1
        cuts, i = [], k
        while i < len(base) and base[i][0] < b:
            cuts.append((base[i][0], base[i][2]))
            i += 1
        known = [u.span() for u in INNER_UUID.finditer(text, a, b)]
        if not cuts and not known:
            out += random_in(text, a, b, enc, least_ratio)
            continue
        for x, y in [*sorted(cuts + known), (b, b)]:
            s = text[a:x].strip("-_/+") if a < x else ""
            if s:
                at = text.index(s, a)
                more = random_in(text, at, at + len(s), enc, least_ratio)
                touches = any(e == at or c == at + len(s) for c, e in cuts)
                if not more and touches and LEAST_REST <= len(s) < LEAST and s.isalnum() and not WORDY.fullmatch(s) and len(s) < PARTS_RATIO * len(enc.encode_ordinary(s)):
                    more = [(at, at + len(s))]      # too short alone, but a secret goes on in it
                out += more
            a = max(a, y)
    return out


def find(text: str | None, enc: tiktoken.Encoding, least_ratio: float = LEAST_RATIO) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all secrets, ascending; kind is a place in KINDS. Random strings lie outside the base spans."""
    if not text:
        return []
    spans = []
    low = text.encode("utf-8", "replace").lower()
    if any(h in low for h in HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans += [(a, 3, b) for a, b in random_spans(text, enc, least_ratio, sorted(spans))]
    return sorted(spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each secret replaced; spans that overlap become one."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def scan(docs: DataFrame, ranks: str, pattern: str, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """Secrets of every text, one row per row; a null or empty text has none, ids may be null or repeated.

    ranks: path of a vocabulary in tiktoken's form, read on the driver and broadcast (its size is
    that of a vocabulary). Spans are kind:start:end in code points, by start, then kind.
    """
    held = docs.sparkSession.sparkContext.broadcast(_read(ranks))

    def run(batches):
        enc = encoding(held.value, pattern)
        for batch in batches:
            for part in slices(batch):
                cols = [[] for _ in range(6)]
                for x in part.column("text").to_pylist():
                    spans = find(x, enc, least_ratio)
                    told = lambda which: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in which)
                    n = [sum(k == i for _, k, _ in spans) for i in range(4)]
                    for c, v in zip(cols, (*n, hashlib.sha256(told(s for s in spans if s[1] < 3).encode()).hexdigest(), told(spans))):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])],
                                                 names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, ranks: str, pattern: str, mark: str = "[secret]", least_ratio: float = LEAST_RATIO) -> DataFrame:
    """The documents with secrets replaced by `mark` and n_chars counted anew; a text without secrets stays as it is, null stays null."""
    held = docs.sparkSession.sparkContext.broadcast(_read(ranks))

    def run(batches):
        enc = encoding(held.value, pattern)
        for batch in batches:
            for part in slices(batch):
                texts, sizes = part.column("text").to_pylist(), part.column("n_chars").to_pylist()
                for i, x in enumerate(texts):
                    if spans := find(x, enc, least_ratio):
                        texts[i] = redact(x, spans, mark)
                        sizes[i] = len(texts[i])
                for name, values in (("text", texts), ("n_chars", sizes)):
                    at = part.schema.get_field_index(name)
                    part = part.set_column(at, part.schema.field(at), pa.array(values, part.schema.field(at).type))
                yield part

    return docs.mapInArrow(run, docs.schema)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
