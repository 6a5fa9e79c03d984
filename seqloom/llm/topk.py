"""Exact top-k search by MaxScore over integer vectors.

The terms of a query are the dimensions in which it isn't 0; a term's posting list
holds the rows to which it adds a positive amount, with these amounts' factors, and
its bound is the most it can add within a shard. Terms are ordered by bound; the longest
prefix whose bounds together stay below the current k-th score is non-essential. Only
the essential postings are traversed, and only rows met there are candidates: what
they gathered plus the non-essential bounds is the most they can reach. They are probed
in all terms, strongest first, where what a term really adds replaces what it was
taken for, and dropped as soon as they can't reach the k-th score. Shards keep k
results per query; these are merged by a window. Scores are exact integers, and ties go
to the smaller id.

Vectors are dealt to shards by the hash of their id, queries are sent to every shard in
blocks; the grid is sized from the row counts and the longest vector so that a cell
holds about CELL_VALUES components of vectors and as many of queries.

*Defined cases.* Vectors that are null, or hold null or non-finite components,
take no part. Vectors of another length than the query's count as padded with 0.
A row is no candidate of its own query: candidates with the query's id are left out.
Rows that repeat an id and vector are candidates of their own, so they take as many
ranks; a query that is repeated counts once. Null ids take no part. Integers are kept as
they are: where products could pass 64 bits a cell is computed with whole numbers of any
size. An integer beyond ``LARGEST``, or a score beyond 64 bits among the best, raises an
error. Vectors may be as long as a row can be: a cell holds at least one. Empty tables
give an empty result; columns other than id and vector aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K = 10
SCALE = 1024
#: Largest size of an integer; beyond, an error names the row.
LARGEST = 1 << 62
#: Components of vectors, and of queries, in a cell.
CELL_VALUES = 1 << 20
#: Terms probed before candidates are dropped.
PROBES = 4
#: Vectors looked at first to get a k-th score.
WARM_ROWS = 256


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id and floor(scale * x) of the vectors that take part."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return (vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~bad)
            .select(F.col(id_col).alias("id"), F.transform(x, lambda v: _whole(F.lit(float(scale)) * v.cast("double"), F.col(id_col))).alias("v")))


def _whole(x: Column, name: Column) -> Column:
    too_large = F.raise_error(F.concat(F.lit("a component is too large in vector "), name.cast("string"))).cast("long")
    return F.when(F.abs(x) < LARGEST, F.floor(x).cast("long")).otherwise(too_large)


class Shard:
    """Rows of a shard by ascending id: posting lists per term and sign, and a column
    per term to probe."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.columns = ids[order], np.ascontiguousarray(matrix[order].T)
        none = not len(ids)
        self.high = self.columns.max(1, initial=0) if none else self.columns.max(1)
        self.low = self.columns.min(1, initial=0) if none else self.columns.min(1)
        self._postings: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}

    def postings(self, term: int, positive: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose component has the sign, ascending, and these components."""
        found = self._postings.get((term, positive))
        if found is None:
            column = self.columns[term]
            rows = np.flatnonzero(column > 0 if positive else column < 0)
            found = self._postings[term, positive] = rows, column[rows]
        return found

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, best first."""
        terms = np.flatnonzero(q)
        bound = np.maximum(np.maximum(q[terms] * self.high[terms], q[terms] * self.low[terms]), 0)
        order = np.argsort(bound, kind="stable")
        terms, bound = terms[order], bound[order]
        weight, upto = q[terms], np.concatenate([[0], np.cumsum(bound)])
        others = self.ids != query_id

        def exact(rows):
            return weight @ self.columns[np.ix_(terms, rows)] if len(terms) else np.zeros(len(rows), q.dtype)

        warm = np.flatnonzero(others)[:WARM_ROWS]
        best_rows, best = self._best(warm, exact(warm), k)
        if len(warm) < WARM_ROWS:  # that was all of them
            return self.ids[best_rows], best
        least = best[-1] if len(best) == k else None
        if least is None or least <= 0:  # a row in no posting list could still compete
            rows = np.flatnonzero(others)[WARM_ROWS:]
            most = exact(rows)
        else:
            first = int(np.searchsorted(upto, least, "left")) - 1  # terms before it are non-essential
            gathered = np.zeros(len(self.ids), q.dtype)
            for t, w in zip(terms[first:], weight[first:]):
                rows, values = self.postings(t, w > 0)
                gathered[rows] += w * values
            gathered[~others] = 0
            gathered[warm] = 0
            rows = np.flatnonzero((gathered > 0) & (gathered + upto[first] >= least))
            most = gathered[rows] + upto[first]
            for n, j in enumerate(range(len(terms) - 1, -1, -1), 1):
                adds = weight[j] * self.columns[terms[j]][rows]
                most += np.minimum(adds, 0) if j >= first else adds - bound[j]
                if n % PROBES == 0:
                    keep = most >= least
                    rows, most = rows[keep], most[keep]
        rows, scores = np.concatenate([best_rows, rows]), np.concatenate([best, most])
        best_rows, best = self._best(rows, scores, k)
        return self.ids[best_rows], best

    def _best(self, rows: np.ndarray, scores: np.ndarray, k: int):
        if scores.dtype == object:  # numpy can't sort these by several keys
            order = np.array(sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]], rows[i]))[:k], int)
            return rows[order], scores[order]
        if len(rows) > 4 * k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= least], scores[scores >= least]
        order = np.lexsort((rows, self.ids[rows], -scores))[:k]
        return rows[order], scores[order]


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The lists as rows, padded with 0."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _exact(rows: np.ndarray, is_query: np.ndarray) -> np.ndarray:
    """The rows as they are, or as Python's integers where a sum of products, or one of
    bounds, could pass 64 bits."""
    size = [max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (rows[is_query], rows[~is_query])]
    return rows if 2 * size[0] * size[1] * rows.shape[1] < 1 << 63 else rows.astype(object)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, cell_values: int = CELL_VALUES) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs are (id, v array<long>)."""
    # Numbered, so that many equal rows don't share a shard.
    vectors = cut(vectors.withColumn("row", F.monotonically_increasing_id()))
    queries = cut(queries.dropDuplicates(["id", "v"]))

    def parts(rows):
        found = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
        return max(1, -(-found["n"] * max(1, found["width"] or 1) // cell_values))

    shards, blocks = parts(vectors), parts(queries)
    left = (vectors.select("id", "v", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("query", F.lit(False)))
    right = (queries.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).withColumn("query", F.lit(True)))
    cells = left.unionByName(right)

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        is_query = cell.column("query").to_numpy()
        ids = cell.column("id").to_numpy()
        v = cell.column("v").combine_chunks()
        width = int(max([0, *(v.value_lengths().to_numpy(zero_copy_only=False))]))
        all_rows = _exact(matrix(v, width), is_query)
        shard = Shard(ids[~is_query], all_rows[~is_query])
        out = {"query_id": [], "vec_id": [], "score": []}
        for i, q in zip(ids[is_query], all_rows[is_query]):
            found, scores = shard.search(i, q, k)
            out["query_id"].append(np.full(len(found), i))
            out["vec_id"].append(found)
            out["score"].append(scores)
        empty = np.empty(0, np.int64)
        return pa.table({c: np.concatenate([empty, *x]).astype(np.int64) for c, x in out.items()})

    partial = cells.groupBy("shard", "block").applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where(F.col("id") % 100 == 0))


SQL = """
WITH e AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM e),
q AS (SELECT DISTINCT vec_id, x FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.x, c.x), lambda p: coalesce(p[1]::HUGEINT * p[2], 0))), 0) AS score
  FROM q JOIN v c ON c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 10
"""
