"""Removal of passages that an earlier document has, by suffix automata.

A window is ``LENGTH`` consecutive words of a document; a word goes if a window that
covers it also starts in a document with a smaller id. The references are the places
where a passage occurs first, cut into shards of at most ``BLOCK`` places; a shard's
suffix automaton goes to every task that its documents are dealt to, and the documents'
stretches stream through it for matching statistics. Windows where these reach LENGTH
go, as maximal spans.

*Which shard.* Each window has an anchor: of its grams of ``gram`` words the one with the
least hash, so equal windows have equal anchors wherever they stand. Anchors are counted,
and for those in several documents the first place, by document id, is the reference.
For each window there are four cases:

- no other document has its anchor, or its own document is the first: it stays;
- it equals the text at the anchor's first place: it goes;
- it doesn't: an earlier document may still have it, though not the first one, so it
  is open, and looked at again with longer grams;
- it is at another place of the first document: it stays, but is looked at again as a
  possible first place of windows that are open.

With ``GRAMS`` of less words few rows are shuffled (an anchor every dozen words), with
LENGTH words a window is its own anchor and equal hashes are equal windows, which the
automaton confirms. Should hashes collide, the loop goes on with other hashes; it ends
when no anchor of an open window is in two documents. Every result is so decided by words.

*Equal documents* (same words) are taken once, the one with the smallest id: the others
lose all words if they have a window. *Hot shards*, known from the counts of anchors, are
copied to several tasks, among which their stretches are dealt; the table of these shards
is bounded. Only documents that share an anchor send their text through a shuffle: a bitmap
of their hashed ids, of a fixed size, is broadcast before it.

*Defined cases.* Null texts have no words. A null id counts as larger than all ids. Rows
with equal ids are documents of their own, and neither is smaller than the other. Texts
of any length are read whole. Empty tables give an empty result. Further columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_table, join_counted, slices
from .near_dedup import _mix, _WordHashes

LENGTH = 50
#: Words of the anchors, pass by pass; the last is the length of a window.
GRAMS = (25, 44, LENGTH)
#: Places of a document that make one reference shard, and windows of a stretch.
BLOCK = 2_048
#: Anchors of a shard's documents that one task gets, if they are more than 1 / HOT of all.
PART, HOT = 256, 10_000
#: Bits of the bitmap of ids, in groups of those of Spark's bitmaps.
BITS, GROUP = 1 << 25, 1 << 15
_REFERENCE, _STRETCH, _OPEN = 0, 1, 2
_hashes = _WordHashes()
_EMPTY = hashlib.sha256(b"").hexdigest()


def words(text: str | None) -> list[bytes]:
    """bytes.split cuts at space and 0x09-0x0D."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def gram_hashes(ws: list[bytes], size: int, seed: int) -> np.ndarray:
    """A hash of every ``size`` words, from hashes of 1, 2, 4, ... words."""
    part = _mix(np.fromiter(map(_hashes.__getitem__, ws), np.uint64, len(ws)) + np.uint64(seed))
    n, width, at, out = len(ws) - size + 1, 1, 0, None
    while width <= size:
        if size & width:
            mine = part[at: at + n]
            out = mine if out is None else _mix(out * np.uint64(0x9E3779B97F4A7C15) + mine)
            at += width
        part = _mix(part[:-width] * np.uint64(0xD1B54A32D192ED03) + part[width:])
        width *= 2
    return out


def anchors(ws: list[bytes], gram: int, seed: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the grams, place of each window's anchor)."""
    hashes = gram_hashes(ws, gram, seed)
    wide = length - gram + 1
    if wide == 1:
        return hashes, np.arange(len(hashes))
    windows = np.lib.stride_tricks.sliding_window_view(hashes, wide)
    return hashes, windows.argmin(1) + np.arange(len(windows))


class Automaton:
    """The suffix automaton of passages: its states are what may follow."""

    def __init__(self):
        self.next, self.link, self.size, self.number = [{}], [0], [0], {}

    def add(self, passage: list[bytes]) -> None:
        """Passages are told apart by a sign of their own in front."""
        last = self._extend(0, -1 - len(self.next))
        for w in passage:
            last = self._extend(last, self.number.setdefault(w, len(self.number)))

    def _state(self, size: int, link: int, follow: dict) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.size.append(size)
        return len(self.next) - 1

    def _extend(self, last: int, sign: int) -> int:
        now = self._state(self.size[last] + 1, 0, {})
        p, top = last, False
        while sign not in self.next[p]:
            self.next[p][sign] = now
            if p == 0:
                top = True
                break
            p = self.link[p]
        if not top:
            q = self.next[p][sign]
            if self.size[q] == self.size[p] + 1:
                self.link[now] = q
            else:
                copy = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
                self.link[q] = self.link[now] = copy
                while self.next[p].get(sign) == q:
                    self.next[p][sign] = copy
                    if p == 0:
                        break
                    p = self.link[p]
        return now

    def reaching(self, ws: list[bytes], length: int = LENGTH) -> np.ndarray:
        """For each window of ``ws`` whether a passage has it: where the longest match
        that ends at its last word, followed no further than ``length``, is that long."""
        follow, link, size, number = self.next, self.link, self.size, self.number
        found = np.zeros(len(ws), bool)
        v = long = 0
        for i, w in enumerate(ws):
            sign = number.get(w)
            while v and sign not in follow[v]:
                v = link[v]
                long = size[v]
            v = follow[v].get(sign, 0)
            long = long + 1 if v else 0
            while v and size[link[v]] >= length:
                v = link[v]
                long = size[v]
            found[i] = long >= length
        return found[length - 1:]


def _runs(flags: np.ndarray) -> np.ndarray:
    """(begin, end) rows of the stretches of true."""
    return np.flatnonzero(np.diff(flags, prepend=False, append=False)).reshape(-1, 2)


def prints(docs: DataFrame, gram: int = GRAMS[0]) -> DataFrame:
    """The rows, numbered: id, doc_id, key, n_words, class (a digest of the words), whole,
    text, and the places and hashes of the anchors, packed; written."""

    def run(batches):
        for b in slices(batches, 256):
            rows = []
            for text in b.column(3).to_pylist():
                ws = words(text)
                joined = b" ".join(ws)
                digest = hashlib.sha256(joined)
                places = marks = None
                if len(ws) >= LENGTH:
                    hashes, at = anchors(ws, gram, 0)
                    at = np.unique(at)
                    places, marks = at.astype(np.int32).tobytes(), hashes[at].tobytes()
                rows.append((len(ws), digest.digest()[:16], digest.hexdigest(), places, marks))
            kinds = (pa.int64(), pa.binary(), pa.string(), pa.binary(), pa.binary())
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], ["id", "doc_id", "key", "text", "n_words", "class", "whole", "places", "marks"])
        _hashes.clear()

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("id"), doc_id.alias("doc_id"),
                       F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("key"), "text")
    return cut_table(rows.mapInArrow(run, "id long, doc_id long, key long, text string, n_words long, class binary, whole string, "
                                          "places binary, marks binary"))


def copies_of(base: DataFrame) -> DataFrame:
    """(id, rep, later): the rows whose words an earlier row has, that row, and whether its
    id is smaller or just as large."""
    long = base.where(F.col("n_words") >= LENGTH).select("id", "key", "class")
    classes = cut(long.groupBy("class").agg(F.min(F.struct("key", "id")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return cut_table(join_counted(long, classes, "class").where("id <> first.id")
                     .select("id", F.col("first.id").alias("rep"), (F.col("key") > F.col("first.key")).alias("later")))


def first_grams(base: DataFrame, copies: DataFrame) -> DataFrame:
    """(mark, key, id, at) of the anchors of all different documents."""

    def run(batches):
        for b in slices(batches, 512):
            places = [np.frombuffer(x, np.int32) for x in b.column(2).to_pylist()]
            marks = [np.frombuffer(x, np.int64) for x in b.column(3).to_pylist()]
            each = pa.array(np.repeat(np.arange(b.num_rows), [len(p) for p in places]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *marks])), b.column(1).take(each), b.column(0).take(each),
                                              pa.array(np.concatenate([np.empty(0, np.int32), *places]))], ["mark", "key", "id", "at"])

    packed = base.where("places is not null").select("id", "key", "places", "marks").join(copies.select("id"), "id", "left_anti")
    return packed.mapInArrow(run, "mark long, key long, id long, at int")


def shared_marks(grams: DataFrame) -> DataFrame:
    """(mark, first, n): anchors that documents with different ids have, their first place
    and their number; aggregated before the shuffle, and written."""
    found = grams.groupBy("mark").agg(F.min(F.struct("key", "id", "at")).alias("first"), F.max("key").alias("last"), F.count(F.lit(1)).alias("n"))
    return cut_table(found.where(F.col("last") > F.col("first.key")).select("mark", "first", "n"))


def _open_rows(ws: list[bytes], flags: np.ndarray, start: int, gram: int, seed: int):
    """(marks, places) of the anchors, in the next pass, of the windows with a flag."""
    marks, places = [], []
    for lo, hi in _runs(flags):
        hashes, at = anchors(ws[lo: hi + LENGTH - 1], gram, seed)
        at = np.unique(at)
        marks.append(hashes[at].view(np.int64))
        places.append(at + lo + start)
    return marks, places


_SPAN = "kind int, shard long, block int, key long, id long, at int, mark long, text string"


def spans(marked: DataFrame, gram: int, seed: int, after: tuple[int, int]) -> DataFrame:
    """References, stretches to be compared and open places, from (id, key, text, first),
    where ``first`` lists a document's shared anchors with their first places."""

    def run(batches):
        for b in slices(batches, 128):
            out = []
            for i, key, text, first in zip(*(c.to_pylist() for c in b.columns)):
                ws = words(text)
                _, anchor = anchors(ws, gram, seed)
                at, f_key, f_id, f_at = np.array([(f["at"], f["key"], f["id"], f["place"]) for f in first], np.int64).T
                mine = np.minimum(np.searchsorted(at, anchor), len(at) - 1)
                own = f_key[mine] == key
                here = own & (f_id[mine] == i) & (f_at[mine] == anchor)
                kind = np.where(at[mine] != anchor, -1, np.where(here, _REFERENCE, np.where(own, _OPEN, _STRETCH)))
                block = f_at[mine] // BLOCK
                edges = np.flatnonzero((kind[1:] != kind[:-1]) | (f_id[mine][1:] != f_id[mine][:-1]) | (block[1:] != block[:-1])) + 1
                for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(kind)]):
                    k, shard = int(kind[lo]), int(f_id[mine[lo]])
                    if k in (_REFERENCE, _STRETCH):
                        out += [(k, shard, int(block[lo]), key, i, s, None, b" ".join(ws[s: min(hi, s + BLOCK) + LENGTH - 1]).decode("utf-8", "surrogatepass"))
                                for s in range(lo, hi, BLOCK)]
                for marks, places in zip(*_open_rows(ws, kind == _OPEN, 0, *after)):
                    out += [(_OPEN, None, None, key, i, p, m, None) for m, p in zip(marks.tolist(), places.tolist())]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], [c.split()[0] for c in _SPAN.split(", ")])
        _hashes.clear()

    return marked.select("id", "key", "text", "first").mapInArrow(run, _SPAN)


def compared(dealt: DataFrame, after: tuple[int, int]) -> DataFrame:
    """(id, key, at, stop, mark): words that go, from ``at`` to ``stop``, and the anchors of
    windows that are still open. Rows come by shard and part, references first."""

    def run(batches):
        now, automaton = None, None
        for b in slices(batches, 256):
            gone, waiting = [], []
            for shard, block, part, kind, key, i, start, text in zip(*(c.to_pylist() for c in b.columns)):
                if (shard, block, part) != now:
                    now, automaton = (shard, block, part), Automaton()
                ws = words(text)
                if kind == _REFERENCE:
                    automaton.add(ws)
                    continue
                found = automaton.reaching(ws)
                gone += [(i, key, start + lo, start + hi + LENGTH - 1, None) for lo, hi in _runs(found).tolist()]
                for marks, places in zip(*_open_rows(ws, ~found, start, *after)):
                    waiting += [(i, key, p, None, m) for m, p in zip(marks.tolist(), places.tolist())]
            rows = gone + waiting
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["id", "key", "at", "stop", "mark"])
        _hashes.clear()

    keys = ("shard", "block", "part")
    return (dealt.select(*keys, "kind", "key", "id", "at", "text").repartition(*keys).sortWithinPartitions(*keys, "kind", "id", "at")
            .mapInArrow(run, "id long, key long, at int, stop int, mark long"))


def _texts_of(base: DataFrame, listed: DataFrame) -> DataFrame:
    """The texts of the documents in ``listed``, joined to it. The bitmap lets few others
    pass before the shuffle; once there are more documents than bits, it lets all pass."""
    h = F.pmod(F.xxhash64("id"), F.lit(BITS))
    bits = listed.groupBy(F.floor(h / GROUP).alias("group")).agg(F.bitmap_construct_agg(h % GROUP).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("h") % GROUP / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    here = byte.bitwiseAND(F.expr("shiftleft(1, cast(h % 8 as int))")) != 0
    some = (base.select("id", "key", "text", h.alias("h")).withColumn("group", F.floor(F.col("h") / GROUP))
            .join(F.broadcast(cut(bits)), "group").where(here).select("id", "key", "text"))  # at most BITS / GROUP rows
    return some.join(listed, "id")


def _pass(base: DataFrame, grams: DataFrame, shared: DataFrame, gram: int, seed: int, after: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Words that go, (id, at, stop), and the next pass's anchors (mark, key, id, at)."""
    places = join_counted(grams, shared, "mark").select("id", "at", F.col("first.key").alias("key"), F.col("first.id").alias("first"), F.col("first.at").alias("place"))
    listed = cut_table(places.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "key", F.col("first").alias("id"), "place"))).alias("first")))
    counts = cut(listed.select(F.explode("first").alias("f")).groupBy(F.col("f.id").alias("shard"), F.floor(F.col("f.place") / BLOCK).cast("int").alias("block"))
                 .agg(F.count(F.lit(1)).alias("n")))
    most = max(PART, (counts.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot = F.broadcast(counts.where(F.col("n") > most).select("shard", "block", F.ceil(F.col("n") / most).cast("int").alias("parts")))  # fewer than HOT rows

    made = cut_table(spans(_texts_of(base, listed), gram, seed, after))
    parts = F.coalesce("parts", F.lit(1))
    of = F.when(F.col("kind") == _REFERENCE, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("id", "at"), parts).cast("int")))
    dealt = made.where(F.col("kind") != _OPEN).join(hot, ["shard", "block"], "left").withColumn("part", F.explode(of))
    done = cut_table(compared(dealt, after))
    ahead = (made.where(F.col("kind") == _OPEN).select("mark", "key", "id", "at")
             .unionByName(done.where("mark is not null").select("mark", "key", "id", "at")))
    return done.where("mark is null").select("id", "at", "stop"), ahead


def removed_spans(base: DataFrame, copies: DataFrame) -> DataFrame:
    """(id, at, stop): spans of words that go, of all documents that aren't copies."""
    gone, grams, number = None, cut_table(first_grams(base, copies)), 0
    step = lambda n: (GRAMS[min(n, len(GRAMS) - 1)], n)
    while True:
        shared = shared_marks(grams)
        if shared.isEmpty():
            none = base.where(F.lit(False)).select("id", F.lit(0).alias("at"), F.lit(0).alias("stop"))
            return none if gone is None else gone
        found, grams = _pass(base, grams, shared, *step(number), step(number + 1))
        gone = found if gone is None else gone.unionByName(found)
        number += 1


def without_repeats(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept_sha256."""
    base = prints(docs)
    copies = copies_of(base)
    listed = removed_spans(base, copies).groupBy("id").agg(F.collect_list(F.struct("at", "stop")).alias("gone"))

    def run(batches):
        for b in slices(batches, 256):
            n, digest = [], []
            for text, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                ws = words(text)
                edge = np.zeros(len(ws) + 1, np.int64)
                for g in gone:
                    edge[g["at"]] += 1
                    edge[g["stop"]] -= 1
                stay = [w for w, inside in zip(ws, np.cumsum(edge[:-1]).tolist()) if not inside]
                n.append(len(ws) - len(stay))
                digest.append(hashlib.sha256(b" ".join(stay)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string())], ["id", "n_removed", "kept_sha256"])

    done = cut(_texts_of(base, cut(listed)).select("id", "text", "gone").mapInArrow(run, "id long, n_removed long, kept_sha256 string"))
    later = copies.where("later").select("id", F.lit(None).cast("long").alias("n_removed"), F.lit(_EMPTY).alias("kept_sha256"))
    same = copies.where("not later").select("id", "rep")
    reps = cut(same.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).join(done.withColumnRenamed("id", "rep"), "rep"))
    equal = join_counted(same, reps, "rep").select("id", "n_removed", "kept_sha256")
    changed = done.unionByName(later).unionByName(equal).withColumn("changed", F.lit(True))
    n_removed = F.when(F.col("changed"), F.coalesce("n_removed", "n_words")).otherwise(F.lit(0).cast("long"))
    return (base.select("id", "doc_id", "n_words", "whole").join(changed, "id", "left")
            .select("doc_id", "n_words", n_removed.alias("n_removed"), F.coalesce("kept_sha256", "whole").alias("kept_sha256")))


def op11_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
