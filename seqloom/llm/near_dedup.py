"""Near-duplicate groups by SetSketch registers.

A document's set is its distinct shingles of ``shingle`` words (A-Z lower-cased; words
split at space and 0x09-0x0D). Each shingle is a Poisson process of points that fall on
random registers; a register keeps its least point, truncated to an exponential
scale (base ``BASE``). Registers of a union are the element-wise maxima, equal
registers are as likely as the Jaccard similarity, and both uses share one sketch:

1. rows with equal words form a class, a node of the graph, with a number of its own;
2. ``BANDS`` bands of ``ROWS`` registers are hashed; nodes of a bucket are candidates;
3. candidates are estimated from the joint register likelihood, those that parities
   show to be too different go (:func:`apart`, which loses no link), and the others are
   verified on their full sets: a link needs 100 * intersection >= 80 * union.

*No pair explosion.* First each node is tried with the smallest node of a bucket
(one pair a node) and components are formed; then each node of a bucket that holds
several components is tried with one of its nodes by chance (one pair a node and
bucket), so that a group doesn't stay apart because its smallest node is unlike it.
Only pairs in different components can
still change the result, and all of them share a bucket that holds several components.
The nodes of such a bucket outside its largest component meet all of its nodes, in
tiles of at most about ``TILE`` by ``TILE``. A tile holds registers only; it looks at
each pair in the first band that the two share, and leaves the nodes for which an
estimate reaches the threshold and parities allow a link. Only these come again, with
their texts, so that nodes of a group of near copies just below the threshold don't: a tile counts
all intersections of their full sets at once as a product of 0/1 matrices and emits
only the links that join components, fewer than it has nodes. So no candidate link
between different components is left out, nodes that share no bucket never meet, and
no table of pairs is ever made.

*Hot keys.* Buckets, hubs, components and classes with very many rows are known from
their aggregates: their (boundedly many) aggregate rows are broadcast and their own
rows stay where they are. A bucket's nodes are tried with the smallest of ``FAN`` nodes,
and these with the smallest of all.

A pair of similarity 0.8 shares no bucket with probability (1 - 0.8**6)**45, about
1e-6; a pair above 0.85 about 1e-10.

*Defined cases.* A row is a document; its doc_id only names it. A text without words
has no shingles, no links and stays. A text with fewer words than a shingle is one
shingle. A group is named after its smallest doc_id; rows with a null id get that
name too and stay only where no row of their group has an id. Rows that repeat an id
with different texts are documents of their own and take the name of their own group.
An empty table gives an empty result. Further columns of any name come through
:func:`distinct_texts` untouched; :func:`near_duplicates` doesn't read them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, cut_table, join_counted, slices
from .components import components

BANDS, ROWS = 45, 6
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
SIMILARITY = 80  # per cent
#: Estimates this far below the threshold, over six standard deviations, aren't verified.
SLACK = 0.17
#: Words of a shingle.
SHINGLE = 5
#: Word hashes a worker keeps, and the longest word it keeps, in bytes.
KEPT_WORDS, LONGEST_KEPT = 100_000, 48
#: Rows (and shingles, in thousands) of a block; a tile compares two blocks.
TILE = 256
#: Nodes of a bucket that are tried with one of them.
FAN = 4_096
#: Pairs whose registers are compared, and whose likelihoods are held, at once.
PAIRS = 4_096
#: Columns of the 0/1 matrices multiplied at once.
COLUMNS = 4_096
#: Shingles sketched at once.
BATCH_SHINGLES = 200_000
#: Bits of a set's parities.
PARITIES = 2_048


def words(text: str | None) -> list[bytes]:
    """bytes.lower changes A-Z only and bytes.split cuts at space and 0x09-0x0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(ws: list[bytes], shingle: int = SHINGLE) -> set:
    """Distinct runs of ``shingle`` words; all words as one run if they are fewer."""
    if len(ws) <= shingle:
        return {tuple(ws)} if ws else set()
    return set(zip(*(ws[k:] for k in range(shingle))))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = h
        return h


_hashes = _WordHashes()


def shingle_hashes(ws: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of a document's shingles."""
    h = np.fromiter(map(_hashes.__getitem__, ws), np.uint64, len(ws))
    size = min(shingle, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k: k + n])
    return np.unique(out)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (uint16, a row per set) of non-empty sets of shingle hashes."""
    d, m = len(sets), REGISTERS
    doc = np.repeat(np.arange(d), [len(s) for s in sets])
    seed = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    least = np.full(d * m, np.inf)
    x = np.zeros(len(seed))
    step = 0
    while len(seed):
        step += 1
        h = _mix(seed + np.uint64((step * 0xD1B54A32D192ED03) % (1 << 64)))
        x = x - np.log(((h >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52) / (m * RATE)
        register = (_mix(h + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(33)) % np.uint64(m)
        np.minimum.at(least, doc * m + register.astype(np.int64), x)
        limit = least.reshape(d, m).max(1) if step < 8 or step % 8 == 0 else limit
        alive = x < limit[doc]
        seed, x, doc = seed[alive], x[alive], doc[alive]
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP + 1).astype(np.uint16).reshape(d, m)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """An odd sketch (a row of PARITIES bits, as uint64, per set): each bit tells
    whether an odd number of the set's hashes fall on it."""
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    seed = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    bit = (_mix(seed ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(PARITIES)).astype(np.int64)
    odd = np.bincount(doc * PARITIES + bit, minlength=len(sets) * PARITIES).astype(np.uint8) & 1
    return np.packbits(odd.reshape(-1, PARITIES), axis=1).view(np.uint64)


def apart(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """Pairs that can't be linked, whatever their estimate: bits that differ are never
    more than the elements that only one set has, and a link needs
    (100 + similarity) * these <= (100 - similarity) * (n_a + n_b)."""
    differ = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
    return (100 + similarity) * differ > (100 - similarity) * (n_a + n_b)


def joint_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, grid: int = 200) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs (a row each) from how many
    registers are larger, smaller and equal, given the set sizes."""
    if len(a) > PAIRS:
        parts = [slice(at, at + PAIRS) for at in range(0, len(a), PAIRS)]
        return np.concatenate([joint_similarity(a[p], b[p], n_a[p], n_b[p], grid) for p in parts])
    more = (a > b).sum(1)[:, None].astype(float)
    fewer = (a < b).sum(1)[:, None].astype(float)
    same = a.shape[1] - more - fewer
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, grid + 1)[None]

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    score = (more * np.log(np.maximum(up, tiny)) + fewer * np.log(np.maximum(down, tiny))
             + same * np.log(np.maximum(1 - up - down, tiny)))
    return j[np.arange(len(j)), score.argmax(1)]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``row`` (all columns of ``docs``), class key of the words, n_shingles, registers
    and parities (key, registers and parities are null without words)."""
    place = docs.columns.index("text")

    def run(batches):
        for b in slices(batches):
            keys, sizes, rows, waiting = [], [], [], []
            for text in b.column(0).field(place).to_pylist():
                ws = words(text)
                keys.append(hashlib.blake2b(b" ".join(ws), digest_size=16).digest() if ws else None)
                if not ws:
                    sizes.append(0)
                    rows.append(None)
                    continue
                s = shingle_hashes(ws, shingle)
                sizes.append(len(s))
                rows.append(len(waiting))
                waiting.append(s)
            done, odd, at = [], [], 0
            while at < len(waiting):
                to, held = at, 0
                while to < len(waiting) and (to == at or held + len(waiting[to]) <= BATCH_SHINGLES):
                    held += len(waiting[to])
                    to += 1
                done += [r.tobytes() for r in sketch(waiting[at:to])]
                odd += [p.tobytes() for p in parities(waiting[at:to])]
                at = to
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array([None if r is None else done[r] for r in rows], pa.binary()),
                 pa.array([None if r is None else odd[r] for r in rows], pa.binary())],
                ["row", "class", "n_shingles", "registers", "parities"])
        _hashes.clear()

    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("class", T.BinaryType()),
                           T.StructField("n_shingles", T.LongType()), T.StructField("registers", T.BinaryType()),
                           T.StructField("parities", T.BinaryType())])
    return docs.select(F.struct("*").alias("row")).mapInArrow(run, schema)


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _parities(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, PARITIES // 64)


def band_rows(sketches: DataFrame) -> DataFrame:
    """(bucket, band, id, n_shingles) for every band of every sketch."""

    def run(batches):
        salt = _mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for b in batches:
            if not b.num_rows:
                continue
            r = _registers(b.column(2)).reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = np.broadcast_to(salt, r.shape[:2]).copy()
            for k in range(ROWS):
                h = _mix(h + r[:, :, k] * np.uint64(0xD1B54A32D192ED03) + np.uint64(k))
            each = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
            band = np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(band), b.column(0).take(each), b.column(1).take(each)],
                                             ["bucket", "band", "id", "n_shingles"])

    return sketches.select("id", "n_shingles", "registers").mapInArrow(run, "bucket long, band int, id long, n_shingles long")


def _with_both(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with columns of both rows, as a_x and b_x."""
    side = lambda p: rows.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return pairs.join(side("b"), "b").join(side("a"), "a")


def estimated(pairs: DataFrame, rows: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The pairs whose joint estimate isn't far below the threshold and whose parities
    allow a link."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            reg = [_registers(b.column(c)) for c in ("a_registers", "b_registers")]
            odd = [_parities(b.column(c)) for c in ("a_parities", "b_parities")]
            n = [b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("a_n_shingles", "b_n_shingles")]
            keep = (joint_similarity(*reg, *n) >= similarity / 100 - SLACK) & ~apart(*odd, *n, similarity)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    columns = ("registers", "parities", "n_shingles")
    return (_with_both(pairs, rows, *columns).select("a", "b", *[f"{p}_{c}" for c in columns for p in "ab"])
            .mapInArrow(run, "a long, b long"))


def verified(pairs: DataFrame, rows: DataFrame, similarity: int = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """Links (u, v): the pairs whose full sets are similar enough."""

    def run(batches):
        last, left = None, set()
        for b in slices(batches):
            keep = []
            for i, a_text, b_text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if i != last or not left:
                    last, left = i, shingles(words(a_text), shingle)
                right = shingles(words(b_text), shingle)
                both = len(left & right)
                keep.append(both > 0 and 100 * both >= similarity * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return _with_both(pairs, rows, "text").select("a", "b", "a_text", "b_text").mapInArrow(run, "u long, v long")


def tile_links(parts: np.ndarray, sets: list[set], left: np.ndarray, right: np.ndarray, similarity: int = SIMILARITY) -> list[tuple]:
    """Links between different components among the pairs left x right, as pairs of
    components and as a spanning forest: those that joined two when taken in order."""
    seen: dict = {}
    for s in sets:
        for x in s:
            seen[x] = seen.get(x, 0) + 1
    column: dict = {}
    at, col = [], []
    for i, s in enumerate(sets):
        for x in s:
            if seen[x] > 1:
                at.append(i)
                col.append(column.setdefault(x, len(column)))
    at, col = np.array(at, np.int64), np.array(col, np.int64)
    order = np.argsort(col, kind="stable")
    at, col = at[order], col[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(column), COLUMNS):
        lo, hi = np.searchsorted(col, [start, start + COLUMNS])
        block = np.zeros((len(sets), min(COLUMNS, len(column) - start)), np.float32)
        block[at[lo:hi], col[lo:hi] - start] = 1
        both += block[left] @ block[right].T
    size = np.array([len(s) for s in sets], float)
    union = size[left][:, None] + size[right][None] - both
    found = np.argwhere((both > 0) & (100 * both >= similarity * union) & (parts[left][:, None] != parts[right][None]))
    root = {p: p for p in parts.tolist()}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in found.tolist():
        u, v = int(parts[left[i]]), int(parts[right[j]])
        a, b = find(u), find(v)
        if a != b:
            root[a] = b
            out.append((u, v))
    return out


def _blocks(labelled: DataFrame) -> DataFrame:
    """A row per bucket that holds several components: its largest one, its number of
    rows ``n``, into how many blocks its other rows and those of the largest go, and one
    of its nodes by chance, another one in each bucket."""
    chance = F.struct(F.xxhash64("id", "bucket").alias("h"), "id", "component")
    sizes = (labelled.groupBy("bucket", "component")
             .agg(F.count(F.lit(1)).alias("c"), F.sum("n_shingles").alias("w"), F.min(chance).alias("pivot")))
    whole = sizes.groupBy("bucket").agg(F.max_by(F.struct("component", "c", "w"), F.struct("c", "component")).alias("main"), F.min("pivot").alias("pivot"),
                                        F.count(F.lit(1)).alias("parts"), F.sum("c").alias("n"), F.sum("w").alias("w"))
    share = lambda n, w: F.ceil(F.greatest(n / TILE, w / (1000.0 * TILE)))
    return whole.where("parts > 1").select(
        "bucket", "n", F.col("main.component").alias("main"), share(F.col("n") - F.col("main.c"), F.col("w") - F.col("main.w")).alias("minors"),
        share(F.col("main.c"), F.col("main.w")).alias("mains"), F.col("pivot.id").alias("pivot"), F.col("pivot.component").alias("pivot_component"))


def _mixed(bucketed: DataFrame, parts: DataFrame) -> DataFrame:
    """(bucket, band, id, n_shingles, component and the columns of :func:`_blocks`) of
    the buckets that hold several components."""
    labelled = cut_table(bucketed.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id")))
    return join_counted(labelled, cut(_blocks(labelled)), "bucket")


def _pivot_pairs(members: DataFrame, sketches: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(a, b): each node b of a mixed bucket with one of the buckets' nodes by chance
    that seems to be linked with it, in another component; one pair a node."""
    pairs = cut(members.where("component <> pivot_component").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
    return estimated(pairs, sketches, similarity).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def _tiles(members: DataFrame) -> DataFrame:
    """Members of mixed buckets, dealt to blocks and each block to the tiles (bucket,
    lo, hi) it takes part in: the rows outside the largest component meet all."""
    minor, h = F.col("component") != F.col("main"), F.xxhash64("id")
    block = F.when(minor, F.pmod(h, F.col("minors"))).otherwise(F.col("minors") + F.pmod(h, F.col("mains")))
    last = F.when(minor, F.col("minors") + F.col("mains")).otherwise(F.col("minors")) - 1
    return (members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
            .select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                    "block", "id", "component", "band", "n_shingles", "registers", "parities"))


_KEYS = ("bucket", "lo", "hi")


def _by_tile(rows: DataFrame, run, schema: str) -> DataFrame:
    """Rows dealt and sorted by tile, streamed through ``run``."""
    return rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "block", "id").mapInArrow(run, schema)


def _whole_tiles(batches):
    """(table, starts): rows of whole tiles and where each tile starts, ends included."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
        starts = _starts(t)
        if len(starts) > 2:
            yield t.slice(0, starts[-2]), starts[:-1]
            t = t.slice(starts[-2])
        held = t
    if held is not None and held.num_rows:
        yield held, _starts(held)


def _starts(t: pa.Table) -> np.ndarray:
    keys = np.stack([t.column(k).to_numpy() for k in _KEYS])
    return np.concatenate([[0], 1 + np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)), [t.num_rows]])


def _sides(block: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(block == lo), np.flatnonzero(block == hi)


def likely(tiles: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of each tile that have a partner in another component whose joint
    estimate isn't far below the threshold and whose parities allow a link, each pair
    looked at in its first band."""

    def survivors(t: pa.Table, starts: np.ndarray) -> np.ndarray:
        part, n, band, block, lo, hi = (t.column(c).to_numpy() for c in ("component", "n_shingles", "band", "block", "lo", "hi"))
        reg, odd = _registers(t.column("registers")), _parities(t.column("parities"))
        keep = np.zeros(t.num_rows, bool)

        def look(i, j):
            i, j = np.concatenate(i), np.concatenate(j)
            a, b = reg[i], reg[j]
            same = (a == b).reshape(-1, BANDS, ROWS).all(2)
            first = same.argmax(1) == band[i]
            i, j, a, b = i[first], j[first], a[first], b[first]
            good = joint_similarity(a, b, n[i].astype(float), n[j].astype(float)) >= similarity / 100 - SLACK
            keep[i[good]] = keep[j[good]] = True

        left, right, held = [], [], 0
        for s, e in zip(starts, starts[1:]):
            a, b = _sides(block[s:e], lo[s], hi[s])
            for at in range(0, len(a), max(1, PAIRS // max(1, len(b)))):
                some = a[at: at + max(1, PAIRS // max(1, len(b)))]
                i, j = s + np.repeat(some, len(b)), s + np.tile(b, len(some))
                able = (part[i] != part[j]) & (100 * np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
                if lo[s] == hi[s]:
                    able &= i < j
                i, j = i[able], j[able]
                near = ~apart(odd[i], odd[j], n[i], n[j], similarity)
                if near.any():
                    left.append(i[near])
                    right.append(j[near])
                    held += len(left[-1])
                if held >= PAIRS:
                    look(left, right)
                    left, right, held = [], [], 0
        if held:
            look(left, right)
        return keep

    def run(batches):
        for t, starts in _whole_tiles(batches):
            yield from t.select(["bucket", "lo", "hi", "block", "id", "component"]).filter(pa.array(survivors(t, starts))).to_batches()

    return _by_tile(tiles, run, "bucket long, lo long, hi long, block long, id long, component long")


def links_between(members: DataFrame, sketches: DataFrame, texts: DataFrame, similarity: int = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(u, v): pairs of components that a link joins. ``members`` is (bucket, band, id,
    component, n_shingles and the columns of :func:`_blocks`), ``sketches`` has id,
    registers and parities, ``texts`` id and text."""
    near = cut(likely(_tiles(members.join(sketches.select("id", "registers", "parities"), "id")), similarity))

    def run(batches):
        for t, starts in _whole_tiles(batches):
            part, block, lo, hi = (t.column(c).to_numpy() for c in ("component", "block", "lo", "hi"))
            found = []
            for s, e in zip(starts, starts[1:]):
                sets = [shingles(words(x), shingle) for x in t.column("text").slice(s, e - s).to_pylist()]
                found += tile_links(part[s:e], sets, *_sides(block[s:e], lo[s], hi[s]), similarity)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return _by_tile(near.join(texts, "id"), run, "u long, v long")


def _first_pairs(bucketed: DataFrame) -> DataFrame:
    """(a, b): each node b with the smallest node of one of its buckets; in a bucket of
    more than ``FAN`` nodes with the smallest of its share, and that one with the
    smallest of all."""
    wide = bucketed.where(F.col("n") > FAN).withColumn("share", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / FAN)))
    least = wide.groupBy("bucket", "share").agg(F.min("id").alias("least"))
    near = (bucketed.where(F.col("n") <= FAN).select("id", "head")
            .unionByName(wide.join(least, ["bucket", "share"])
                         .select("id", F.when(F.col("id") != F.col("least"), F.col("least")).otherwise(F.col("head")).alias("head"))))
    return near.where("id <> head").groupBy(F.col("id").alias("b")).agg(F.min("head").alias("a")).select("a", "b")


def _nodes(base: DataFrame, similarity: int, shingle: int) -> DataFrame:
    """(class, n, rep, whole): each class of equal words, its number of rows, its
    smallest doc_id and the node that stands for its group; cut."""
    classes = cut(base.where("class is not null").groupBy("class")
                  .agg(F.min("id").alias("id"), F.min("row.doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    sketches = cut_table(base.select("id", "n_shingles", "registers", "parities").join(classes.select("id"), "id", "left_semi"))

    bands = band_rows(sketches)
    heads = cut(bands.groupBy("bucket").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    bucketed = cut_table(join_counted(bands, heads, "bucket"))
    wanted = bucketed.select("id").distinct()
    texts = cut_table(base.select("id", "row.text").join(wanted, "id", "left_semi"))

    first = cut(_first_pairs(bucketed))
    links = cut(verified(cut(estimated(first, sketches, similarity)), texts, similarity, shingle))
    members = cut_table(_mixed(bucketed.drop("head", "n"), components(links)))
    links = links.unionByName(verified(cut(_pivot_pairs(members, sketches, similarity)), texts, similarity, shingle))
    parts = components(links)
    members = _mixed(members.select("bucket", "band", "id", "n_shingles"), parts)
    joined = components(links_between(members, sketches, texts, similarity, shingle)).select(F.col("id").alias("part"), F.col("component").alias("whole"))

    sizes = parts.groupBy(F.col("component").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    moved = join_counted(parts.withColumnRenamed("component", "part"), cut(sizes.join(joined, "part")), "part").select("id", "whole")
    alone = joined.select(F.col("part").alias("id"), F.col("whole").alias("own"))
    return cut(classes.join(parts, "id", "left").join(moved, "id", "left").join(alone, "id", "left")
               .select("class", "n", "rep", F.coalesce("whole", "own", "component", "id").alias("whole")))


def _grouped(docs: DataFrame, similarity: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The rows as a written table that numbers them, and (id, doc_id, n_shingles,
    component_id, kept) of each."""
    base = cut_table(fingerprints(docs, shingle).withColumn("id", F.monotonically_increasing_id()))
    node = _nodes(base, similarity, shingle)
    names = cut(node.groupBy("whole").agg(F.min("rep").alias("name"), F.count(F.lit(1)).alias("n")))
    named = cut(join_counted(node.select("class", F.col("n").alias("size"), "whole"), names, "whole")
                .select("class", F.col("size").alias("n"), "name"))
    rows = base.select("id", "row.doc_id", "class", "n_shingles")
    out = join_counted(rows.where("class is not null"), named, "class").select("id", "doc_id", "n_shingles", "name")
    out = out.unionByName(rows.where("class is null").select("id", "doc_id", "n_shingles", F.col("doc_id").alias("name")))
    name = F.coalesce(F.col("name"), F.col("doc_id"))
    return base, out.select("id", "doc_id", "n_shingles", name.alias("component_id"), F.col("doc_id").eqNullSafe(name).alias("kept"))


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    return _grouped(docs.select("doc_id", "text"), similarity, shingle)[1].drop("id")


def distinct_texts(docs: DataFrame, similarity: int = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The rows that stay, with the columns of ``docs``; rows are told apart by their
    own number, so it doesn't matter whether ids repeat."""
    base, rows = _grouped(docs, similarity, shingle)
    gone = cut_table(rows.where(~F.col("kept")).select("id"))
    return base.join(gone, "id", "left_anti").select("row.*")


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shingle=2)
