"""Token ids packed into fixed rows, as binary columns.

Documents are encoded where they are; a document longer than a row is split into
pieces without loss (full rows and a rest). Within a window of at most
``WINDOW_PIECES`` pieces or ``WINDOW_TOKENS`` ids the pieces are placed by best fit
decreasing: longest first, each into the open row with the least room that still
takes it. A segment tree over room sizes finds that row in logarithmic time.

A packed row has the matrix row of ids (padded), the cumulative segment lengths,
the position within each segment (restarting at 0), and for each segment the id of its
document, the number of the document's row and the piece number, so every document can
be put together again. Ids, lengths and
positions are little-endian INT32 in binary columns; :func:`write_packed` stores
them with Spark's own writer.

Nothing is shuffled: a task packs its own split of the input, window by window, in
bounded memory, and a lost task repeats exactly. A window's last rows may stay
partly empty, a loss below 1 / (window rows) of the space.

*Defined cases.* Null and empty texts have no ids and no segment. Equal lengths are
placed in the order of input. Rows are numbered in the task that packs them, so rows that
share an id, or have none, stay apart and come back apart. An empty table gives no row.
Columns other than id and text aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_level import default_vocabulary, encode, encoding
from .common import slices

ROW = 2048
WINDOW_PIECES, WINDOW_TOKENS = 8_192, 4_000_000
PAD = 0


class RoomTree:
    """Which room sizes (0..size) have open rows; finds the least one that is big
    enough by walking a segment tree of counts."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = self.leaves + room
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Room and row of the best fit, taken out; None if no open row fits."""
        at = self.leaves + need
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        row = self.rows[room].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, row


def best_fit_decreasing(lengths: list[int], row: int = ROW) -> list[list[int]]:
    """Rows as lists of piece numbers; every length is between 1 and ``row``."""
    tree, rows = RoomTree(row), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fit = tree.take(lengths[i])
        if fit is None:
            fit = row, len(rows)
            rows.append([])
        rows[fit[1]].append(i)
        if fit[0] > lengths[i]:
            tree.add(fit[0] - lengths[i], fit[1])
    return rows


def _packed(window: list, row: int, id_type) -> pa.RecordBatch:
    out = {k: [] for k in ("ids", "cu_seqlens", "positions", "segment_docs", "segment_rows", "segment_pieces", "n_tokens")}
    for pieces in best_fit_decreasing([len(w[-1]) for w in window], row):
        chosen = [window[i] for i in pieces]
        ids = np.full(row, PAD, "<i4")
        lengths = [len(c[-1]) for c in chosen]
        used = sum(lengths)
        ids[:used] = np.concatenate([c[-1] for c in chosen])
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype("<i4")
        positions = np.zeros(row, "<i4")
        positions[:used] = np.arange(used) - np.repeat(ends[:-1], lengths)
        for k, v in (("ids", ids.tobytes()), ("cu_seqlens", ends.tobytes()), ("positions", positions.tobytes()),
                     ("segment_docs", [c[0] for c in chosen]), ("segment_rows", [c[1] for c in chosen]),
                     ("segment_pieces", [c[2] for c in chosen]), ("n_tokens", used)):
            out[k].append(v)
    kinds = (pa.binary(), pa.binary(), pa.binary(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))


def pack(docs: DataFrame, vocabulary: str, row: int = ROW, window_pieces: int = WINDOW_PIECES, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """ids, cu_seqlens, positions (BINARY), segment_docs, segment_rows, segment_pieces,
    n_tokens: one row per packed row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        t = encoding(vocabulary)
        window, held, id_type = [], 0, pa.int64()
        at = TaskContext.get().partitionId() << 33  # rows of a partition are numbered from here
        for b in slices(batches):
            id_type = b.column(0).type
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at += 1
                ids = np.array(encode(t, text or ""), "<i4")
                for number, start in enumerate(range(0, len(ids), row)):
                    piece = ids[start: start + row]
                    window.append((doc, at, number, piece))
                    held += len(piece)
                    if len(window) >= window_pieces or held >= window_tokens:
                        yield _packed(window, row, id_type)
                        window, held = [], 0
        if window:
            yield _packed(window, row, id_type)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"ids binary, cu_seqlens binary, positions binary, segment_docs array<{kind}>, segment_rows array<long>, segment_pieces array<int>, n_tokens int")


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as a Parquet data set."""
    packed.write.mode("errorifexists").parquet(path)


def read_documents(packed: DataFrame) -> DataFrame:
    """doc_id and ids of the packed rows' documents, put together again (one row per
    row that was packed; only where the ids fit into one array, as before packing)."""

    def run(batches):
        for b in batches:
            out = [[], [], [], []]
            for raw, ends, *segments in zip(*(b.column(k).to_pylist() for k in range(5))):
                flat, ends = np.frombuffer(raw, "<i4"), np.frombuffer(ends, "<i4")
                for k, segment in enumerate(zip(*segments)):
                    for column, x in zip(out, (*segment, flat[ends[k]: ends[k + 1]].tolist())):
                        column.append(x)
            kinds = (b.column(2).type.value_type, pa.int64(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["doc_id", "row", "piece", "ids"])

    kind = dict(packed.dtypes)["segment_docs"][len("array<"): -1]
    pieces = (packed.select("ids", "cu_seqlens", "segment_docs", "segment_rows", "segment_pieces")
              .mapInArrow(run, f"doc_id {kind}, row long, piece int, ids array<int>"))
    ordered = F.array_sort(F.collect_list(F.struct("piece", "ids")))  # the pieces of one document
    return pieces.groupBy("doc_id", "row").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids")).drop("row")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
