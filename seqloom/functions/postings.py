"""Places of grams, packed: a few bytes a place where a table of them takes tens.

A task takes the blocks it reads in runs of about RUN letters, numbers the places of a run,
sorts them by gram and packs ROW of them into a row, as planes of bytes, each compressed
alone. A run is sorted in memory, so nothing is shuffled or spilled; each row says its first
and last gram, so that a scan finds the rows of few grams in each run.

A gram is the upper half of Spark's xxhash64 of its letters, four bytes each (``fixed``), of
which a class keeps :func:`bits_of`.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters of a run, and places of a row.
RUN, ROW = 1 << 22, 4_096
SCHEMA = "base long, first int, last int, n int, data binary"
#: Places hashed at once, as many as stay in a core's cache, and places unpacked at once.
_HASHED, AT_ONCE = 1 << 15, 1 << 18
_HEAD = struct.Struct("<17H")
_SEED = np.uint64(42)
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def bits_of(gram: int) -> int:
    """Bits of the hash that are kept. Short grams of a few letters are equal by nature more
    often than by the bits that are left out."""
    return 24 if gram < 14 else 32


def _turned(x, n: int):
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _mixed(x):
    return _turned(x * _P2, 31) * _P1


def hashes(words: np.ndarray, halves: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Upper halves of the xxhash64 of ``size`` letters from each place; ``halves`` are the
    letters' bytes as numbers, ``words`` those of each letter and the next."""
    with np.errstate(over="ignore"):
        done = 0
        if size >= 8:
            lanes = [np.full(len(at), v) for v in (_SEED + _P1 + _P2, _SEED + _P2, _SEED, _SEED - _P1)]
            while done + 8 <= size:
                lanes = [_turned(v + words[at + (done + 2 * i)] * _P2, 31) * _P1 for i, v in enumerate(lanes)]
                done += 8
            h = _turned(lanes[0], 1) + _turned(lanes[1], 7) + _turned(lanes[2], 12) + _turned(lanes[3], 18)
            for v in lanes:
                h = (h ^ _mixed(v)) * _P1 + _P4
        else:
            h = np.full(len(at), _SEED + _P5)
        h += np.uint64(4 * size)
        while done + 2 <= size:
            h = _turned(h ^ _mixed(words[at + done]), 27) * _P1 + _P4
            done += 2
        if done < size:
            h = _turned(h ^ (halves[at + done] * _P1), 23) * _P2 + _P3
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return (h ^ (h >> np.uint64(32))) >> np.uint64(32)


def _letters(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after the other, and where each text begins and ends."""
    text = text.cast(pa.large_string())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset: text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0]: ends[-1]]
    if len(data) == 0 or data.max() < 128:
        return data.astype(np.uint32), ends - ends[0]
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum(pc.utf8_length(text).to_numpy(zero_copy_only=False), dtype=np.int64)])


#: Turned in a key, so that keys sort as signed grams do.
_SIGN = np.uint64(1 << 31)


def _keys(letters, begins, ends, lead, core, first: np.ndarray, stride: int, gram: int) -> np.ndarray:
    """A key for each stride-th letter of the blocks; ``first`` is the number of a block's
    first place."""
    halves = letters.byteswap().astype(np.uint64)
    words = halves | (np.append(halves[1:], np.uint64(0)) << np.uint64(32))
    last = np.minimum(core - 1, ends - begins - lead - gram)
    n = np.where(last >= 0, last // stride + 1, 0)
    step = np.arange(n.sum(), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
    at, place = np.repeat(begins + lead, n) + step * stride, np.repeat(first, n) + step
    out, rest = np.empty(len(at), np.uint64), np.uint64(32 - bits_of(gram))
    for i in range(0, len(at), _HASHED):
        some = slice(i, i + _HASHED)
        kept = (hashes(words, halves, at[some], gram) ^ _SIGN) >> rest
        out[some] = (kept << np.uint64(32)) | place[some].astype(np.uint64)
    return out


def _packed(values: np.ndarray, codec) -> list[bytes]:
    """Four planes of bytes: nothing where all are 0, as they are where nothing is gained."""
    out = []
    for plane in values.astype("<u4").view(np.uint8).reshape(-1, 4).T:
        plain = plane.tobytes() if plane.any() else b""
        small = codec.compress(plain, asbytes=True) if plain else b""
        out.append(small if len(small) < len(plain) else plain)
    return out


def _rows(base: int, keys: np.ndarray, gram: int) -> pa.RecordBatch:
    """A run's rows. In a row: gaps between different grams, how often each occurs once
    more, its first place, and steps between its places."""
    keys = np.sort(keys)
    grams, places = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    codec, rest = pa.Codec("zstd", compression_level=3), 32 - bits_of(gram)
    data, first, last, n = [], [], [], []
    for i in range(0, len(keys), ROW):
        g, p = grams[i: i + ROW], places[i: i + ROW]
        new = np.append(True, g[1:] != g[:-1])
        begin = np.flatnonzero(new)
        times = np.diff(np.append(begin, len(g))) - 1
        planes = [x for part in (np.diff(g[begin], prepend=g[0]), times, p[begin], np.diff(p, prepend=0)[~new]) for x in _packed(part, codec)]
        data.append(_HEAD.pack(len(begin), *map(len, planes)) + b"".join(planes))
        first.append((g[0] << rest) - (1 << 31))
        last.append((g[-1] << rest) - (1 << 31))
        n.append(len(g))
    return pa.RecordBatch.from_arrays([pa.array([base] * len(n), pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32()),
                                       pa.array(n, pa.int32()), pa.array(data, pa.binary())], ["base", "first", "last", "n", "data"])


def packer(size: int, stride: int, gram: int):
    """For mapInArrow over blocks (id, core, lead, text) of ``size`` letters: the grams of
    every ``stride``-th letter, in rows of SCHEMA. ``base`` is the id of a run's first block."""
    most, per = max(1, RUN // size), size // stride

    def run(batches):
        base, kept = None, []
        for batch in batches:
            ids, core, lead = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "core", "lead"))
            letters, bounds = _letters(batch.column("text"))
            i = 0
            while i < len(ids):
                base = ids[i] if base is None else base
                out = (ids[i:] < base) | (ids[i:] >= base + most)
                j = i + int(out.argmax()) if out.any() else len(ids)
                if j > i:
                    kept.append(_keys(letters[bounds[i]: bounds[j]], bounds[i:j] - bounds[i], bounds[i + 1: j + 1] - bounds[i], lead[i:j], core[i:j],
                                      (ids[i:j] - base) * per, stride, gram))
                if j < len(ids):
                    if sum(map(len, kept)):
                        yield _rows(int(base), np.concatenate(kept), gram)
                    base, kept = None, []
                i = j
        if sum(map(len, kept)):
            yield _rows(int(base), np.concatenate(kept), gram)

    return run


def _unpacked(first: int, n: int, data: bytes, rest: int, codec) -> tuple[np.ndarray, np.ndarray]:
    """The grams and places of a row."""
    (many, *sizes), at, found = _HEAD.unpack_from(data), _HEAD.size, []
    for part, length in enumerate((many, many, many, n - many)):
        x = np.zeros(length, np.int64)
        for i, size in enumerate(sizes[4 * part: 4 * part + 4]):
            if size:
                plane = data[at: at + size]
                plane = plane if size == length else codec.decompress(plane, decompressed_size=length, asbytes=True)
                x |= np.frombuffer(plane, np.uint8).astype(np.int64) << (8 * i)
                at += size
        found.append(x)
    gaps, times, starts, steps = found
    times += 1
    begin = np.cumsum(times) - times
    new = np.zeros(n, bool)
    new[begin] = True
    p = np.empty(n, np.int64)
    p[~new] = steps
    p[begin] = np.diff(starts, prepend=0)  # the sum up to a gram's first place is that place
    p[begin[1:]] -= np.add.reduceat(np.where(new, 0, p), begin)[:-1]
    return np.repeat(first + (np.cumsum(gaps) << rest), times), np.cumsum(p)


def unpacker(size: int, layout: dict[int, tuple[int, int]], wanted: dict[int, np.ndarray] | None = None):
    """For mapInArrow over the packed rows, with ``cls``: (cls, gram, id, p), p being a place's
    letter in block ``id``. ``layout`` has the stride and the gram of each class, ``wanted``
    the grams of each that are looked for, sorted; rows without any aren't unpacked."""
    def found(cls: int, base: int, first: int, last: int, n: int, data, codec):
        stride, gram = layout[cls]
        if wanted is not None:
            values = wanted.get(cls, np.empty(0, np.int64))
            values = values[slice(*np.searchsorted(values, [first, last + 1]))]
            if not len(values):
                return None
        grams, places = _unpacked(first, n, data.as_py(), 32 - bits_of(gram), codec)
        if wanted is not None:
            here = values[np.minimum(np.searchsorted(values, grams), len(values) - 1)] == grams
            grams, places = grams[here], places[here]
        per = size // stride
        return np.full(len(grams), cls, np.int32), grams.astype(np.int32), base + places // per, (places % per * stride).astype(np.int32)

    def batch_of(parts):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["cls", "gram", "id", "p"])

    def run(batches):
        codec = pa.Codec("zstd")
        for batch in batches:
            parts, waiting = [], 0
            heads = [batch.column(c).to_pylist() for c in ("cls", "base", "first", "last", "n")]
            for *head, data in zip(*heads, batch.column("data")):
                if (some := found(*head, data, codec)) is not None:
                    parts.append(some)
                    waiting += len(some[0])
                if waiting > AT_ONCE:
                    yield batch_of(parts)
                    parts, waiting = [], 0
            if parts:
                yield batch_of(parts)

    return run
