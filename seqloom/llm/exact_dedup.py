"""Exact de-duplication by content sort (DataFrame functions only).

The rows are range-partitioned on a bounded key of the normalised text (its
first characters, then a hash of all of it); Spark samples the splitters. Each
partition is sorted externally on key and full text, equal texts become
neighbours, and the window operator compares neighbours in full and keeps one.

*Normalised*: A-Z lower-cased, nothing else; null is the empty text.

*Hot texts.* A text with more rows than ``HOT_ROWS`` and than 1 / ``HOT_TEXTS`` of the
table is dealt out over ranges of about that many rows each. There are fewer than
``HOT_TEXTS`` such texts, so the table of their hashes has a proven bound and is
broadcast; the winners of their ranges (fewer than 2 * HOT_TEXTS rows) are compared in
full once more.

*Defined cases.* Rows with a null id take part and never win against a row with
an id. Of rows that agree in id and text exactly one is kept. An empty table
gives an empty result. The whole input row travels as one column, so further columns
of any name come through untouched; only columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lower_az

HOT_TEXTS = 10_000
HOT_ROWS = 64


def _ranked(docs: DataFrame, keep: str, id_col: str, text_col: str) -> DataFrame:
    """(row, keep_id, group_size, kept, text_sha256) for every row of ``docs``."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    ident = F.col("row").getField(id_col)
    raw = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    loose = F.lower(raw)  # equal normalised texts have equal loose keys
    keyed = docs.select(F.struct("*").alias("row")).select("row", F.xxhash64(loose).alias("h"), F.substring(loose, 1, 32).alias("p"))

    limit = max(HOT_ROWS, -(-docs.count() // HOT_TEXTS))
    hot = cut(keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
              .select("h", F.ceil(F.col("n") / limit).alias("salts")))
    equal = Window.partitionBy("p", "h", "salt", "norm")
    order = ident.asc_nulls_last() if keep == "smallest" else ident.desc_nulls_last()

    def sorted_groups(rows):
        ranged = rows.repartitionByRange("p", "h", "salt").withColumn("norm", lower_az(raw))
        return ranged.withColumns({
            "rn": F.row_number().over(equal.orderBy(order)),
            "best": best(ident).over(equal),
            "size": F.count(F.lit(1)).over(equal),
        }).withColumn("digest", F.sha2(F.encode("norm", "UTF-8"), 256))

    if hot.isEmpty():
        out = sorted_groups(keyed.withColumn("salt", F.lit(0)))
        keep_id, size = F.col("best"), F.col("size")
    else:
        # Which range of a hot text a row goes to depends on all that it holds.
        salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("row"), F.col("salts"))).otherwise(F.lit(0))
        salted = keyed.join(F.broadcast(hot), "h", "left").withColumn("salt", salt)
        # Hot texts once more, alone: what their ranges kept is compared across ranges.
        only = salted.where(F.col("salts").isNotNull())
        narrow = only.select("h", "p", "salt", F.struct(ident.alias(id_col), F.col("row").getField(text_col).alias(text_col)).alias("row"))
        across = (sorted_groups(narrow).where(F.col("rn") == 1).groupBy("h", "norm", "digest")
                  .agg(best("best").alias("all_best"), F.sum("size").alias("all_size"))
                  .select("h", "digest", "all_best", "all_size"))
        out = sorted_groups(salted).join(F.broadcast(across), ["h", "digest"], "left")
        keep_id = F.when(F.col("salts").isNotNull(), F.col("all_best")).otherwise(F.col("best"))
        size = F.coalesce("all_size", "size")
    return out.select("row", keep_id.alias("keep_id"), size.cast("long").alias("group_size"),
                      ((F.col("rn") == 1) & ident.eqNullSafe(keep_id)).alias("kept"), F.col("digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` plus ``keep_id``, ``group_size``, ``kept`` and
    ``text_sha256`` (of the normalised text), which replace columns of the same names.
    ``keep`` names the id that stays of equal texts: ``smallest`` or ``largest``."""
    added = ("keep_id", "group_size", "kept", "text_sha256")
    ranked = _ranked(docs, keep, id_col, text_col)
    return ranked.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in added], *added)


def distinct_texts(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    return _ranked(docs, keep, id_col, text_col).where("kept").select("row.*")


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs, keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""
