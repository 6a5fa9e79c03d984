"""Token counts by a linear longest-match automaton.

Greedy word pieces: from the start of a word take the longest piece, go on after
it. The automaton is the trie of the pieces with failure links. When the next
character leaves the trie, the failure link leads to the state for what remains
after the pieces that greedy matching would cut off, and a precomputed count says
how many those are. So a word is read once, left to right, and only a number is
kept: no piece is ever built.

Words are read as their UTF-8 bytes and every piece of the vocabulary takes part.
The vocabulary closes words with an end mark; the last byte of a closing piece, and
of a word, is a letter of its own, so first and later pieces need no second trie.
Where the vocabulary has a piece for every byte, open and closing, no word is
unknown; otherwise a word that can't be cut counts as one unknown token.

*Defined cases.* A null text is empty: 0 words, 0 tokens. Words are the runs between
white space, lower-cased; very long words are counted like others, as the
automaton's work is linear. Every row gives one row, also where rows repeat or ids are
null; an empty table gives an empty result. Columns other than id and text aren't read.
"""

from __future__ import annotations

import hashlib
import json
import os

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import _END, VOCABULARY_BYTES, byte_letters
from .common import slices

#: Words whose counts a worker keeps, and the longest word it keeps.
KEPT_WORDS, LONGEST_KEPT = 200_000, 48


class LongestMatch:
    """Trie, failure links and popped-token counts as plain lists."""

    def __init__(self, pieces: list[str]):
        """``pieces`` are strings of any letters."""
        self.edges: list[dict[str, int]] = [{}]
        self.whole = [False]
        for piece in pieces:
            at = 0
            for c in piece:
                to = self.edges[at].get(c)
                if to is None:
                    to = self.edges[at][c] = len(self.edges)
                    self.edges.append({})
                    self.whole.append(False)
                at = to
            self.whole[at] = True
        n = len(self.edges)
        self.fail = [-1] * n    # -1: no way to go on, the word is unknown
        self.popped = [0] * n   # pieces that are cut off on the way along the link
        level = [0]
        while level:
            deeper = []
            for at in level:
                for c, to in self.edges[at].items():
                    deeper.append(to)
                    if self.whole[to]:  # all of it is one piece; nothing remains
                        self.fail[to], self.popped[to] = 0, 1
                        continue
                    back, count = self.fail[at], self.popped[at]
                    while back >= 0 and c not in self.edges[back]:
                        count += self.popped[back]
                        back = self.fail[back]
                    if back >= 0:
                        self.fail[to], self.popped[to] = self.edges[back][c], count
            level = deeper

    def count(self, word: str) -> int:
        """Number of greedy longest-match pieces of ``word``; -1 if it has none."""
        edges, fail, popped = self.edges, self.fail, self.popped
        at = total = 0
        for c in word:
            to = edges[at].get(c)
            while to is None:
                total += popped[at]
                at = fail[at]
                if at < 0:
                    return -1
                to = edges[at].get(c)
            at = to
        while at:  # cut what is left over
            total += popped[at]
            at = fail[at]
            if at < 0:
                return -1
        return total


def byte_word(raw: bytes, closes: bool = True) -> str:
    """A letter per byte, the last one apart if it closes a word."""
    text = raw.decode("latin-1")
    return text[:-1] + chr(_END + raw[-1]) if closes and raw else text


def read_pieces(path: str) -> list[str]:
    """All pieces of a vocabulary with an end-of-word suffix, as :func:`byte_word`."""
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix, as_byte = model["end_of_word_suffix"], {c: b for b, c in enumerate(byte_letters())}
    out = []
    for text in model["vocab"]:
        closes = text.endswith(suffix) and len(text) > len(suffix)
        out.append(byte_word(bytes(as_byte[c] for c in (text[: -len(suffix)] if closes else text)), closes))
    return out


_automata: dict[str, LongestMatch] = {}


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown (words without pieces, which count
    as one token each) of every row."""
    pieces = read_pieces(vocabulary)
    key = hashlib.sha256("\n".join(pieces).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        if key not in _automata:
            _automata.clear()
            _automata[key] = LongestMatch(shared.value)
        automaton, known = _automata[key], {}
        for b in slices(batches):
            words, tokens, unknown = [], [], []
            for text in b.column(1).to_pylist():
                found = text.lower().split() if text else ()
                n = lost = 0
                for w in found:
                    k = known.get(w)
                    if k is None:
                        k = automaton.count(byte_word(w.encode()))
                        if len(w) <= LONGEST_KEPT:
                            if len(known) >= KEPT_WORDS:
                                known.clear()
                            known[w] = k
                    if k < 0:
                        lost += 1
                    else:
                        n += k
                words.append(len(found))
                tokens.append(n + lost)
                unknown.append(lost)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))],
                                             ["doc_id", "n_words", "n_tokens", "n_unknown"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    from .bpe import default_vocabulary

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
