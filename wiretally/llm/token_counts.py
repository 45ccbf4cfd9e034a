"""Token counts without tokens: greedy longest-match word pieces by one linear pass.

The vocabulary is a trie with failure links. When a symbol has no child at a node, the
longest pieces that begin the node's string are popped and the failure link leads to the
node of what remains. How many pieces that pops is known beforehand, so counting never
builds a piece and never steps back: at most two moves per symbol.

A word is its UTF-8 bytes and an end mark. The vocabulary has pieces for the inside and
pieces that include the end mark; an end mark that no piece covers counts nothing.
"""

from __future__ import annotations

import json
import sys
from collections import Counter
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from wiretally.llm.shared import slices

END = 256
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
LONGEST_KEPT = 64    # a longer word is counted anew each time it occurs
MOST_KEPT = 300_000


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 stands
    for itself, the others follow from U+0100 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_pieces(spec: str) -> list[tuple[int, ...]]:
    """Pieces of a tokenizer file (JSON with word ends) as symbols; special tokens are left out."""
    of, model = byte_letters(), json.loads(spec)["model"]
    end = model.get("end_of_word_suffix") or "</w>"
    out = []
    for piece in model["vocab"]:
        inner, mark = (piece.removesuffix(end), (END,)) if piece.endswith(end) else (piece, ())
        if inner and all(c in of for c in inner):
            out.append((*(of[c] for c in inner), *mark))
    return out


class Automaton:
    """Trie, failure links and popped-piece counts of a vocabulary.

    Bytes that no piece begins with count as a piece each.
    """

    def __init__(self, pieces):
        self.child, self.fail, self.pops = {}, [0], [0]
        whole = {(END,): 0} | {(b,): 1 for b in range(256)} | {tuple(p): 1 for p in pieces if p}
        value, parent, sym, depth = [None], [0], [0], [0]
        for piece in whole:
            v = 0
            for c in piece:
                key = v << 9 | c
                if (w := self.child.get(key)) is None:
                    w = self.child[key] = len(parent)
                    parent.append(v), sym.append(c), depth.append(depth[v] + 1), value.append(None)
                v = w
            value[v] = whole[piece]
        n = len(parent)
        self.fail, self.pops = [0] * n, [0] * n
        for v in sorted(range(1, n), key=depth.__getitem__):
            if value[v] is not None:
                self.pops[v] = value[v]      # the whole string is one piece; nothing remains
                continue
            u, c = parent[v], sym[v]
            count, z = self.pops[u], self.fail[u]
            while (w := self.child.get(z << 9 | c)) is None:
                count += self.pops[z]
                z = self.fail[z]
            self.fail[v], self.pops[v] = w, count

    def count(self, symbols) -> int:
        child, fail, pops = self.child, self.fail, self.pops
        v = n = 0
        for c in symbols:
            while (w := child.get(v << 9 | c)) is None:
                n += pops[v]
                v = fail[v]
            v = w
        while v:
            n += pops[v]
            v = fail[v]
        return n


class WordCounts(dict):
    """Pieces of a word, remembered up to a number of words."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count((*word.encode("utf-8", "replace"), END))
        if len(word) <= LONGEST_KEPT:
            if len(self) >= MOST_KEPT:
                self.clear()
            self[word] = n
        return n


@cache
def _words(spec: str) -> WordCounts:
    return WordCounts(Automaton(read_pieces(spec)))


SCHEMA = "doc_id long, n_words long, n_tokens long"


def token_counts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Words and greedy longest-match tokens of every text, lower-cased.

    tokenizer: path of a tokenizer file, read on the driver and sent to the executors (its
    size is that of a vocabulary). One row per row; a null or empty text has no tokens, a
    null id stays null, other columns are not looked at.
    """
    with open(tokenizer, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(sys.intern(f.read()))
    pattern = WORDS

    def count(batches):
        known, split = _words(held.value), regex.compile(pattern)
        for batch in batches:
            for part in slices(batch):
                words, tokens = [], []
                for x in part.column("text").to_pylist():
                    found = Counter(split.findall(x.lower())) if x else {}
                    words.append(sum(found.values()))
                    tokens.append(sum(n * known[w] for w, n in found.items()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    picked = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return picked.mapInArrow(count, SCHEMA)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
