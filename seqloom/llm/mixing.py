"""Mixing sources to target weights by hash-threshold histograms
(DataFrame functions only).

A document's place is the hash of its id. Per source, the words are summed by
hash bucket (12 bits); the running sum over at most 4,096 buckets finds the one
in which the budget is crossed, only that bucket is split into 4,096 finer
ones, and the documents below the resulting threshold are taken: a filter, no
sort. What the budget still lacks, less than the document at the threshold,
goes to a nested threshold over the documents not yet taken that fit into it;
``ROUNDS`` such thresholds leave a gap far below one document.

*Budget.* Sources in code point order, null last, weigh ``weights`` repeating
and share all words; a source's target stops at ``MAX_REPEAT`` times its size
and the excess goes to the others by weight. A target of r times the source
takes every document floor(r) times and some of them once more.

The plan has one row a source; windows over all sources run in one task, so there may
be at most ``MAX_SOURCES`` of them, which is checked.

*Defined cases.* A null text has no words; documents without words have nothing
to take. A null id has a place too. Rows with equal ids share one place and are
taken together. An empty table gives an empty result. The whole input row travels as one
column, so further columns of any name come through :func:`mixed_documents` untouched.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, cut, join_small

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
ROUNDS = 3
MAX_SOURCES = 1_000_000
_HEX, _ALL, _NONE = 3, "g", ""  # hex digits of the hash per level; thresholds above and below every hash


def _place():
    return F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 2 * _HEX)


def _source_key():
    return F.when(F.col("source").isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), F.col("source")))


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeat=MAX_REPEAT) -> DataFrame:
    """One row per source: ``source_size``, ``target``, whole ``copies`` and the
    rest ``lacking`` of the budget. Works on the per-source sums alone."""
    per = sizes.groupBy("__source").agg(F.sum("__size").alias("source_size"))
    by_name, unit = Window.orderBy("__source"), lcm(*weights)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]),
                     (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    per = per.withColumn("__w", w).withColumn("__ratio", F.col("source_size") * (F.lit(unit) / F.col("__w")).cast("long"))
    first = Window.orderBy("__ratio", "__source")
    past, rest = first.rowsBetween(Window.unboundedPreceding, -1), first.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumns({
        "__free": (F.sum("source_size").over(Window.partitionBy())
                   - max_repeat * F.coalesce(F.sum("source_size").over(past), F.lit(0))).cast("double"),
        "__ws": F.sum("__w").over(rest).cast("double"),
    })
    full = max_repeat * F.col("source_size").cast("double")
    per = per.withColumn("__capped", F.col("__w") * F.col("__free") > full * F.col("__ws"))
    # Sources stop at their cap in order of __ratio; the others share what the first of them finds.
    head = F.min(F.when(~F.col("__capped"), F.struct("__ratio", "__source", "__free", "__ws"))).over(Window.partitionBy())
    per = per.withColumn("__head", head)
    share = F.col("__w") * F.col("__head.__free") / F.col("__head.__ws")
    per = per.withColumn("target", F.when(F.col("__capped"), full).otherwise(F.least(share, full)))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return (per.withColumn("copies", copies)
            .withColumn("lacking", F.floor("target").cast("long") - F.col("copies") * F.col("source_size"))
            .select("__source", "source_size", "target", "copies", "lacking"))


def _crossing(sums: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Per source the first bucket that overruns ``lacking`` and the sum before it."""
    running = F.sum("__sum").over(Window.partitionBy("__source").orderBy(bucket))
    return (sums.withColumn("__run", running).groupBy(*keys)
            .agg(F.min(F.when(F.col("__run") > F.col("lacking"), F.col(bucket))).alias("__at"),
                 F.coalesce(F.max(F.when(F.col("__run") <= F.col("lacking"), F.col("__run"))), F.lit(0)).alias("__before")))


def _taken_in(r: int):
    fits = (F.col("__size") > 0) & (F.col("__size") <= F.col(f"__max{r}"))
    return fits & (F.col("__place") < F.col(f"__cut{r}"))


def _extra(rounds: int):
    out = F.lit(False)
    for r in range(rounds):
        out = out | F.coalesce(_taken_in(r), F.lit(False))
    return out


def thresholds(sizes: DataFrame, weights=WEIGHTS, max_repeat=MAX_REPEAT, rounds=ROUNDS) -> DataFrame:
    """Per source the target, the copies and ``rounds`` nested thresholds.
    ``sizes`` is a cut table (doc_id, __source, __size, __place)."""
    plan = cut(targets(sizes, weights, max_repeat))
    if plan.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them first")
    for r in range(rounds):
        top = F.lit(2**62) if r == 0 else F.col("lacking")
        plan = plan.withColumn(f"__max{r}", top.cast("long"))
        left = (join_small(sizes, plan, "__source", F.col("doc_id"))
                .where((F.col("__size") > 0) & (F.col("__size") <= F.col(f"__max{r}")) & (F.col("lacking") > 0))
                .where(~_extra(r))
                .withColumns({"__b1": F.substring("__place", 1, _HEX), "__b2": F.substring("__place", 1 + _HEX, _HEX)}))
        coarse = _crossing(left.groupBy("__source", "lacking", "__b1").agg(F.sum("__size").alias("__sum")), ["__source"], "__b1")
        coarse = cut(coarse.withColumnRenamed("__at", "__c1").withColumnRenamed("__before", "__w1"))
        inside = (join_small(left, coarse, "__source", F.col("doc_id")).where(F.col("__b1") == F.col("__c1"))
                  .withColumn("lacking", F.col("lacking") - F.col("__w1")))
        fine = _crossing(inside.groupBy("__source", "lacking", "__b2").agg(F.sum("__size").alias("__sum")), ["__source"], "__b2")
        plan = cut(plan.join(coarse, "__source", "left")
                   .join(fine.withColumnRenamed("__at", "__c2").withColumnRenamed("__before", "__w2"), "__source", "left")
                   .withColumn(f"__cut{r}", F.when(F.col("lacking") <= 0, _NONE).otherwise(F.coalesce(F.concat("__c1", "__c2"), F.lit(_ALL))))
                   .withColumn("lacking", F.col("lacking") - F.coalesce("__w1", F.lit(0)) - F.coalesce("__w2", F.lit(0)))
                   .drop("__c1", "__c2", "__w1", "__w2"))
    return plan


def measured(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", _source_key().alias("__source"), count_words(F.col("text")).alias("__size"),
                       _place().alias("__place"))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat=MAX_REPEAT, rounds=ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken
    (words the mix takes, repeats counted)."""
    sizes = cut(measured(docs))
    plan = thresholds(sizes, weights, max_repeat, rounds)
    copies = F.col("copies") + _extra(rounds).cast("long")
    return join_small(sizes, plan, "__source", F.col("doc_id")).select(
        "doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * copies).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_repeat=MAX_REPEAT, rounds=ROUNDS) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken. The
    thresholds are applied where the rows are; no text is shuffled."""
    plan = thresholds(cut(measured(docs)), weights, max_repeat, rounds)
    # The whole row is one column here, so its names can't clash with those of the plan.
    full = docs.select(F.struct("*").alias("__row"), _source_key().alias("__source"),
                       count_words(F.col("text")).alias("__size"), _place().alias("__place"))
    times = (F.col("copies") + _extra(rounds).cast("long")).cast("int")
    out = (join_small(full, plan, "__source", F.col("__row.doc_id")).withColumn("__times", times)
           .where(F.col("__times") > 0)
           .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))))
    return out.select("__row.*")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


def sql(weights=WEIGHTS, max_repeat=MAX_REPEAT, rounds=ROUNDS) -> str:
    """The same result for an engine with ordinary SQL."""
    unit = lcm(*weights)
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    parts = [f"""
d AS MATERIALIZED (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents),
s0 AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
s1 AS (SELECT *, (CASE (row_number() OVER (ORDER BY src) - 1) % {len(weights)} {weight} END)::BIGINT AS w FROM s0),
s2 AS (SELECT *, source_size * ({unit} // w) AS ratio FROM s1),
s3 AS (SELECT *,
         (sum(source_size) OVER () - {max_repeat} * coalesce(sum(source_size) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS free,
         (sum(w) OVER (ORDER BY ratio, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS ws,
         {max_repeat} * source_size::DOUBLE AS cap FROM s2),
s4 AS (SELECT *, w * free > cap * ws AS capped FROM s3),
s5 AS (SELECT free AS f0, ws AS w0 FROM s4 WHERE NOT capped ORDER BY ratio, src LIMIT 1),
s6 AS (SELECT src, source_size, CASE WHEN capped THEN cap ELSE least(w * f0 / w0, cap) END AS target FROM s4 LEFT JOIN s5 ON true),
s7 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM s6),
p0 AS MATERIALIZED (SELECT *, floor(target)::BIGINT - copies * source_size AS lacking FROM s7),
t0 AS MATERIALIZED (SELECT *, false AS extra FROM d)"""]
    for r in range(rounds):
        top = "2::BIGINT ** 62" if r == 0 else "lacking"
        parts.append(f"""
l{r} AS MATERIALIZED (
  SELECT t.src, p.lacking, substr(place, 1, 3) AS b1, substr(place, 4, 3) AS b2, size
  FROM t{r} t JOIN p{r} p USING (src) WHERE size > 0 AND size <= {top} AND lacking > 0 AND NOT extra),
c{r} AS (SELECT src, min(CASE WHEN run > lacking THEN b1 END) AS c1, coalesce(max(CASE WHEN run <= lacking THEN run END), 0) AS w1
  FROM (SELECT src, lacking, b1, sum(sum(size)) OVER (PARTITION BY src ORDER BY b1) AS run FROM l{r} GROUP BY src, lacking, b1) GROUP BY src),
f{r} AS (SELECT src, min(CASE WHEN run > lacking THEN b2 END) AS c2, coalesce(max(CASE WHEN run <= lacking THEN run END), 0) AS w2
  FROM (SELECT src, lacking - w1 AS lacking, b2, sum(sum(size)) OVER (PARTITION BY src ORDER BY b2) AS run
        FROM l{r} JOIN c{r} USING (src) WHERE b1 = c1 GROUP BY src, lacking - w1, b2) GROUP BY src),
q{r} AS MATERIALIZED (
  SELECT p.*, {top} AS top, CASE WHEN lacking <= 0 THEN '' ELSE coalesce(c1 || c2, 'g') END AS threshold,
         lacking - coalesce(w1, 0) - coalesce(w2, 0) AS still
  FROM p{r} p LEFT JOIN c{r} USING (src) LEFT JOIN f{r} USING (src)),
t{r + 1} AS MATERIALIZED (
  SELECT t.doc_id, t.src, t.size, t.place, extra OR (size > 0 AND size <= top AND substr(place, 1, 6) < threshold) AS extra
  FROM t{r} t JOIN q{r} USING (src)),
p{r + 1} AS MATERIALIZED (SELECT src, source_size, target, copies, still AS lacking FROM q{r})""")
    return "WITH" + ",".join(parts) + f"""
SELECT doc_id, size, source_size, target, (size * (copies + extra::BIGINT))::BIGINT AS taken
FROM t{rounds} JOIN p{rounds} USING (src)
"""
