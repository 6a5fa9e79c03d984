"""BPE encoding and decoding by backtracking over longest token matches.

For a word, an Aho-Corasick automaton over the vocabulary gives the longest
token at every position. The encoder takes them greedily and checks each against
its predecessor: a pair of tokens is compatible when no merge across their
border would have come before the merges that made them. On an incompatible
pair it tries the next shorter token, or steps back. Every position is left for
good at most once, so the work is linear in the word, and the result equals that
of applying the merges in order of rank.

Decoding concatenates token texts: one flat byte buffer and an offset table,
gathered with array arithmetic. The decimal digits of the ids are gathered from
a second table of the same kind.

The tables are built once on the driver from the vocabulary file, whose size is
checked, and are broadcast; a worker builds the automaton from them once and
keeps the pieces of words it has met (a bounded table).

*Defined cases.* A null text is empty: no tokens. Special token strings in a
text become their ids. Every row gives one row, also where rows repeat or ids are null;
an empty table gives an empty result. Input columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices

#: Refuse to broadcast a vocabulary file beyond this size.
VOCABULARY_BYTES = 64 << 20
#: A worker forgets its word pieces when it holds so many words or ids; words of more
#: characters than LONGEST_KEPT aren't kept.
KEPT_WORDS, KEPT_IDS, LONGEST_KEPT = 200_000, 2_000_000, 48
#: Tokens gathered at once when digests are made.
STRIDE = 1 << 20
#: Unicode white space of the tokenizer's pattern; U+001C-001F are none.
WHITE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_END = 0xE000  # private code points for the last byte of a word


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others for U+0100 onwards in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Tables:
    """What encoding and decoding need, as plain arrays and strings."""

    def __init__(self, path: str, separator: str = " "):
        if os.path.getsize(path) > VOCABULARY_BYTES:
            raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        as_byte = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_texts = [""] * size
        self.symbols = [""] * size  # a character per byte, the last of a word apart
        for text, i in [*vocab.items(), *self.specials.items()]:
            self.token_texts[i] = text
        for text, i in vocab.items():
            closes = bool(suffix) and text.endswith(suffix) and len(text) > len(suffix)
            raw = [as_byte[c] for c in (text[: -len(suffix)] if closes else text)]
            mapped = [chr(b) for b in raw]
            if closes:
                mapped[-1] = chr(_END + raw[-1])
            self.symbols[i] = "".join(mapped)
        self.split = [(i, i) for i in range(size)]
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            i = vocab[left + right]
            self.split[i] = (vocab[left], vocab[right])
            self.merged[vocab[left], vocab[right]] = i
        base = min((self.merged.values()), default=0)
        if sorted(self.merged.values()) != list(range(base, base + len(self.merged))) or \
                [self.merged[k] for k in self.merged] != sorted(self.merged.values()):
            raise ValueError("token ids have to follow the order of the merges")
        # Tokens that their own text is never encoded to can't be part of a result.
        alive = [bool(s) for s in self.symbols]
        for i in self.merged.values():
            left, right = self.split[i]
            alive[i] = alive[left] and alive[right] and compatible(left, right, self.merged, self.split, i)
        self.alive = alive
        by_symbols = {s: i for i, s in enumerate(self.symbols) if s and alive[i]}
        self.shorter = [-1] * size
        for s, i in by_symbols.items():
            for n in range(len(s) - 1, 0, -1):
                if s[:n] in by_symbols:
                    self.shorter[i] = by_symbols[s[:n]]
                    break
        self.text_buffer, self.text_offsets = offset_table([t + separator for t in self.token_texts])
        self.digit_buffer, self.digit_offsets = offset_table([f"{i} " for i in range(size)])


def compatible(a: int, b: int, merged: dict, split: list, limit: int = 1 << 62) -> bool:
    """Whether tokens ``a`` and ``b`` can be neighbours: undo their merges, the
    latest first, and look for a merge across the border that precedes them."""
    while True:
        across = merged.get((a, b))
        if across is not None and across < limit:
            return False
        # Open whichever side was made later; a side that is one symbol stays shut.
        if a > b:
            limit, a = a, split[a][1]
            if a == limit:
                limit, inner = b + 1, split[b][0]
                if inner == b:
                    return True
                b = inner
        else:
            inner = split[b][0]
            if inner != b:
                limit, b = b + 1, inner
            else:
                limit, inner = a, split[a][1]
                if inner == a:
                    return True
                a = inner


def offset_table(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return (np.frombuffer(b"".join(raw), np.uint8),
            np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


def gather(buffer: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> bytes:
    """The texts of ``ids`` one after another."""
    ids = np.asarray(ids, np.int64)
    start = offsets[ids]
    length = offsets[ids + 1] - start
    stop = np.cumsum(length)
    if not len(stop):
        return b""
    at = np.arange(stop[-1]) + np.repeat(start - stop + length, length)
    return buffer[at].tobytes()


class Encoder:
    """Encodes texts with :class:`Tables`; one per worker."""

    def __init__(self, tables: Tables):
        import ahocorasick
        import regex

        self.t = tables
        self.automaton = ahocorasick.Automaton()
        self.length = [len(s) for s in tables.symbols]
        for i, s in enumerate(tables.symbols):
            if s and tables.alive[i]:
                self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple] = {}
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
        self.odd_space = regex.compile("[\x1c-\x1f]")
        self.spaces = regex.compile(f"[{WHITE}]+")
        named = sorted(map(regex.escape, tables.specials), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(named) + ")") if named else None
        self._empty()

    def _empty(self):
        self.chunks: dict[str, int] = {}
        self.pool = np.empty(1 << 16, np.int32)
        self.used = 0
        self.starts: list[int] = []
        self.lengths: list[int] = []

    def _fits(self, a: int, b: int) -> bool:
        if len(self.pairs) > KEPT_WORDS:
            self.pairs.clear()
        known = self.pairs[a, b] = compatible(a, b, self.t.merged, self.t.split)
        return known

    def word(self, word: str) -> tuple:
        """Ids of one word of the pattern."""
        known = self.words.get(word)
        if known is not None:
            return known
        raw = word.encode()
        symbols = raw[:-1].decode("latin-1") + chr(_END + raw[-1])
        n, length = len(symbols), self.length
        longest = [0] * n
        for end, i in self.automaton.iter(symbols):
            longest[end + 1 - length[i]] = i  # ends ascend, so the longest remains
        out, at, dead = [], 0, set()
        pairs, shorter_of = self.pairs, self.t.shorter
        token = longest[0]
        while True:
            stop = at + length[token]
            if stop not in dead:
                fits = not out or pairs.get((out[-1], token))
                if fits is None:
                    fits = self._fits(out[-1], token)
                if fits:
                    out.append(token)
                    at = stop
                    if at == n:
                        break
                    token = longest[at]
                    continue
            shorter = shorter_of[token]
            while shorter < 0:  # nothing fits here: step back
                dead.add(at)
                token = out.pop()
                at -= length[token]
                shorter = shorter_of[token]
            token = shorter
        ids = tuple(out)
        if n <= LONGEST_KEPT:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def _chunk(self, chunk: str) -> int:
        """Place of the ids of a run without white space."""
        if chunk.isalpha():  # letters alone are one word, as are letters before one mark
            ids = self.word(chunk)
        elif chunk[-1] in ".,;!?" and chunk[:-1].isalpha():
            ids = self.word(chunk[:-1]) + self.word(chunk[-1])
        else:
            ids = [i for w in self.pieces.findall(chunk) for i in self.word(w)]
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used: self.used + len(ids)] = ids
        k = len(self.starts)
        if len(chunk) <= LONGEST_KEPT:
            self.chunks[chunk] = k
        self.starts.append(self.used)
        self.lengths.append(len(ids))
        self.used += len(ids)
        return k

    @staticmethod
    def _normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if chr(0x3A3) in text:  # lower() would look at the letters around a capital sigma
                return "".join(map(str.lower, text))
        return text.lower()

    def _plain(self, text: str) -> np.ndarray:
        text = self._normal(text)
        found = list(filter(None, self.spaces.split(text))) if self.odd_space.search(text) else text.split()
        if len(self.starts) > KEPT_WORDS or self.used > KEPT_IDS:
            self._empty()
        chunks = self.chunks
        at = []
        for c in found:
            k = chunks.get(c)
            at.append(self._chunk(c) if k is None else k)
        if not at:
            return np.empty(0, np.int32)
        start = np.fromiter(map(self.starts.__getitem__, at), np.int64, len(at))
        length = np.fromiter(map(self.lengths.__getitem__, at), np.int64, len(at))
        stop = np.cumsum(length)
        return self.pool[np.arange(stop[-1]) + np.repeat(start - stop + length, length)]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.empty(0, np.int32)
        if self.special is None or "<" not in text:
            return self._plain(text)
        parts = [np.array([self.t.specials[p]], np.int32) if k % 2 else self._plain(p)
                 for k, p in enumerate(self.special.split(text)) if p]
        return np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: token texts joined by the separator."""
        return gather(self.t.text_buffer, self.t.text_offsets, ids)[:-1].decode()

    def digests(self, ids: np.ndarray) -> tuple[str, str]:
        """SHA-256 of the decimal ids and of the decoded text, made in strides."""
        out = []
        for buffer, offsets in ((self.t.digit_buffer, self.t.digit_offsets), (self.t.text_buffer, self.t.text_offsets)):
            sha = hashlib.sha256()
            for k in range(0, len(ids), STRIDE):
                piece = gather(buffer, offsets, ids[k: k + STRIDE])
                sha.update(piece if k + STRIDE < len(ids) else piece[:-1])
            out.append(sha.hexdigest())
        return out[0], out[1]


_encoders: dict[str, Encoder] = {}


def worker_encoder(key: str, tables) -> Encoder:
    """The worker's encoder for a broadcast value; built at the first use."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tables.value)
    return _encoders[key]


def _share(spark: SparkSession, path: str):
    tables = Tables(path)
    key = hashlib.sha256(tables.text_buffer.tobytes()).hexdigest()
    return key, spark.sparkContext.broadcast(tables)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids`` (array of INT) of every row."""
    key, tables = _share(docs.sparkSession, vocabulary)

    def run(batches):
        encoder = worker_encoder(key, tables)
        for b in slices(batches):
            ids = [encoder.encode(t) for t in b.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and the text of ``ids``; the inverse of :func:`encode_documents` up
    to the normalisation that the vocabulary prescribes."""
    key, tables = _share(encoded.sparkSession, vocabulary)

    def run(batches):
        encoder = worker_encoder(key, tables)
        for b in slices(batches):
            texts = [encoder.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def encoded_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of their decoded text, made
    where the rows are, without moving the ids."""
    key, tables = _share(docs.sparkSession, vocabulary)

    def run(batches):
        encoder = worker_encoder(key, tables)
        for b in slices(batches):
            sizes, shas = [], []
            for t in b.column(1).to_pylist():
                ids = encoder.encode(t)
                sizes.append(len(ids))
                shas.append(encoder.digests(ids))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array([s[0] for s in shas], pa.string()),
                 pa.array([s[1] for s in shas], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return encoded_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
