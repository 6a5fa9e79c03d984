"""Periodic runs of words: scale tiles, boundary Z-functions, stitched intervals.

A run of period q is kept as the interval of places j whose word equals the one q further
on: [start, start + length - q), at least 3q long. Periods go by octaves [2^k, 2^(k+1)).
In octave k boundaries stand every 2^(k+1) words, so each run has one within its interval,
and the tile of a boundary reaches 2^(k+1) words to both sides and one period more.

1. A document is read once. Words are numbered and each gets the distance to its next
   occurrence. A run of octave k is a stretch of at least 3 * 2^k places whose distances are
   below 2^(k+1); boundaries outside such stretches can't be in a run and get no tile.
   Tiles are exploded to rows of neighbouring ones, so a very long document is many rows.
2. Each tile is solved by itself. Z-functions from the boundary to the right and to the
   left give, for every period, how far the equality reaches on both sides. A period
   that divides another with the same stretch rules that one out: its root repeats.
3. Fragments are shuffled by document and period and those that touch are stitched. What
   is then long enough is a run, exact at both ends.

Only documents with tiles carry their text further; only they are read a second time.

*Defined cases.* Null texts have no words. A document is a row: rows that repeat an id are
judged apart. A null id has no number to hash, so its words stay as they are. Texts of any
length are read whole, a document's row once per task; ties of the best run go to the
smallest start, then period. An empty table gives an empty result. Further columns aren't
read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_table, slices

#: A run has at least this many words, and this many times its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Boundaries of a row of tiles.
CHUNK = 64
_FAR = np.iinfo(np.int64).max


def repeated(words: list, doc_id: int | None) -> list:
    """The words of a document; of every tenth id they repeat from some word on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a: a + p]
    return words[:a] + (root * (1 + (n - a) // p))[: n - a]


def next_same(ids: np.ndarray) -> np.ndarray:
    """The distance of each word to its next occurrence."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), _FAR)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def stretches(near: np.ndarray, octave: int) -> np.ndarray:
    """(begin, end) rows: where runs of the octave can have their places."""
    least = max(LEAST_WORDS - 1, (LEAST_PERIODS - 1) << octave)
    here = near < (2 << octave)
    if np.count_nonzero(here) < least:
        return np.empty((0, 2), np.int64)
    edges = np.flatnonzero(np.diff(here, prepend=False, append=False)).reshape(-1, 2)
    return edges[edges[:, 1] - edges[:, 0] >= least]


def tiles(ids: np.ndarray):
    """(octave, first place, first boundary, boundaries, word numbers): rows of tiles."""
    near, octave = next_same(ids), 0
    while LEAST_PERIODS << octave <= len(ids):
        step = 2 << octave
        for begin, end in stretches(near, octave):
            at = -(-begin // step) * step
            while at <= end:
                many = min(CHUNK, (end - at) // step + 1)
                low = max(0, at - step)
                yield octave, low, at, many, ids[low: at + many * step + step - 1]
                at += many * step
        octave += 1


def z_function(s: list, stop: int) -> list:
    """For each place below ``stop``, how long ``s`` from there equals its own start."""
    n = len(s)
    z, lo, hi = [0] * min(stop, n), 0, 0
    for i in range(1, len(z)):
        k = min(z[i - lo], hi - i) if i < hi else 0
        if i + k >= hi:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            lo, hi = i, i + k
        z[i] = k
    return z


def _prime_divisors(p: int) -> list[int]:
    out, f = [], 2
    while f * f <= p:
        if p % f == 0:
            out.append(f)
            while p % f == 0:
                p //= f
        f += 1
    return out + [p] if p > 1 else out


def solve(octave: int, low: int, at: int, many: int, ids: list) -> dict[int, list]:
    """Intervals of each period of the octave, from all boundaries of a row."""
    step, found = 2 << octave, {}
    for c in range(at, at + many * step, step):
        here = c - low
        left, right = ids[max(0, here - step): here], ids[here: here + 2 * step - 1]
        top = min(step - 1, len(right))  # periods are below ``step``
        if not top:
            continue
        ahead = z_function(right, top + 1)
        both = left[::-1] + [-1] + (left + right[:top])[::-1]
        behind = z_function(both, len(left) + 1 + top)
        reach = [0] + [behind[len(left) + 1 + top - p] for p in range(1, top + 1)]  # at p, to the left
        ahead += [0] * (top + 1 - len(ahead))
        for p in range(1 << octave, top + 1):
            a, b = reach[p], ahead[p]
            if a + b >= step and not any(reach[p // f] >= a and ahead[p // f] >= b + p - p // f for f in _prime_divisors(p)):
                mine = found.setdefault(p, [])
                if mine and mine[-1][1] >= c - a:
                    mine[-1][1] = max(mine[-1][1], c + b)
                    mine[-1][0] = min(mine[-1][0], c - a)
                else:
                    mine.append([c - a, c + b])
    return found


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _words(text: str | None, doc_id: int | None) -> list[bytes]:
    """bytes.split cuts at space and 0x09-0x0D."""
    return repeated((text or "").encode("utf-8", "surrogatepass").split(), doc_id)


_PREPARED = "id long, doc_id long, n_words long, whole string, text string, octave int, low long, at long, many int, words array<int>"


def prepared(docs: DataFrame) -> DataFrame:
    """A row per document, with its text if it has tiles, and the rows of tiles (those
    with an ``octave``); written."""

    def run(batches):
        for b in slices(batches, 256):
            out = {c.split()[0]: [] for c in _PREPARED.split(", ")}

            def add(*row):
                for column, value in zip(out.values(), row):
                    column.append(value)

            for i, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                words, seen = _words(text, doc_id), {}
                ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))
                rows = list(tiles(ids)) if len(seen) < len(words) else []
                add(i, doc_id, len(words), _sha(b" ".join(words)), text if rows else None, None, None, None, None, None)
                for octave, low, at, many, part in rows:
                    add(i, None, None, None, None, octave, low, at, many, part)
            kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([pa.array(out[c.split()[0]], kinds[c.split()[1]]) for c in _PREPARED.split(", ")], list(out))

    rows = docs.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut_table(rows.mapInArrow(run, _PREPARED))


def fragments(parts: DataFrame) -> DataFrame:
    """(id, period, lo, hi) of rows of tiles, dealt evenly."""

    def run(batches):
        for b in slices(batches, 64):
            found = [(i, p, lo, hi) for i, *tile in zip(*(c.to_pylist() for c in b.columns)) for p, mine in solve(*tile).items() for lo, hi in mine]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(4)], ["id", "period", "lo", "hi"])

    return (parts.select("id", "octave", "low", "at", "many", "words").repartition("id", "octave", "at")
            .mapInArrow(run, "id long, period long, lo long, hi long"))


def runs(found: DataFrame) -> DataFrame:
    """(id, start, length, period): fragments that overlap or touch are one interval."""
    order = Window.partitionBy("id", "period").orderBy("lo", "hi")
    so_far = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.when(F.col("lo") <= so_far, 0).otherwise(1))
    joined = (marked.withColumn("part", F.sum("new").over(order)).groupBy("id", "period", "part")
              .agg(F.min("lo").alias("start"), F.max("hi").alias("stop")))
    length = F.col("stop") - F.col("start") + F.col("period")
    return joined.select("id", "start", length.alias("length"), "period").where(length >= F.greatest(F.lit(LEAST_WORDS), LEAST_PERIODS * F.col("period")))


def best_run(found: list[tuple]) -> tuple:
    """(start, length, period, floor(1000 * length / period)) of the run with the greatest
    exact ratio, the first of equal ones; ``found`` is sorted by start, then period."""
    best = None
    for start, length, period in found:
        if best is None or length * best[2] > best[1] * period:
            best = start, length, period
    return (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])


def collapsed(words: list, found: list[tuple]) -> list:
    """The words without those after the first period of any run."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(edge[:-1]).tolist()) if not inside]


_RESULT = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
           "runs_sha256 string, collapsed_sha256 string")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """A row per document: its runs counted and digested, the best one, and the digest of
    its words without repeats."""
    base = prepared(docs)
    listed = (runs(fragments(base.where("octave is not null"))).groupBy("id")
              .agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs")))  # within a document

    def run(batches):
        for b in slices(batches, 256):
            out = []
            for doc_id, n, whole, text, listed_ in zip(*(c.to_pylist() for c in b.columns)):
                found = [(r["start"], r["length"], r["period"]) for r in listed_ or []]
                kept = _sha(b" ".join(collapsed(_words(text, doc_id), found))) if found else whole
                lines = "".join("%d,%d,%d\n" % r for r in found)
                out.append((doc_id, n, len(found), *best_run(found), _sha(lines.encode()), kept))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string() if k > 6 else pa.int64()) for k in range(9)],
                                             [c.split()[0] for c in _RESULT.split(", ")])

    rows = base.where("octave is null").select("id", "doc_id", "n_words", "whole", "text").join(listed, "id", "left")
    return rows.select("doc_id", "n_words", "whole", "text", "runs").mapInArrow(run, _RESULT)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
