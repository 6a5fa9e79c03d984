"""Texts, patterns and planted reads as DataFrames, from the given tables, and the
reads file of sequence aligners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.letters import letters, tiles_of

READ = 60
READS_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("position", T.LongType()),
                             *(T.StructField(f"ed{k}", T.StringType()) for k in range(5))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per file, whole; a missing path raises."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and letters of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", letters(F.col("text")).alias("text"))


def reference_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and letters of every benchmark item: the texts that reads are mapped to."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), letters(F.col("text")).alias("text"))


def tiles(texts: DataFrame, size: int = READ) -> DataFrame:
    """(doc_id, position, pattern): every text cut into patterns of ``size``, all letters
    of it: the last one ends where the text ends and overlaps the one before it, and a
    shorter text is one pattern. Empty texts give none."""
    return tiles_of(texts, size)


def segments(texts: DataFrame, delimiter: str = "\n") -> DataFrame:
    """(doc_id, segment, text): texts cut at a delimiter, which no match may cross."""
    return (texts.select("doc_id", F.posexplode(F.split("text", delimiter)).alias("segment", "text"))
            .select("doc_id", F.col("segment").cast("long"), "text"))


def planted_reads(texts: DataFrame, size: int = READ) -> DataFrame:
    """(doc_id, position, ed0..ed4): reads cut from the texts, each level with one
    more edit than the last (substitution, deletion, insertion, substitution)."""
    def swapped(s, at, to):
        c = F.substring(s, at, 1)
        return F.concat(F.substring(s, 1, at - 1), F.translate(c, "ACGT", to), F.substring(s, at + 1, size))

    ed0 = F.col("pattern")
    reads = tiles(texts, size).select("doc_id", "position", ed0.alias("ed0"), swapped(ed0, 6, "CGTA").alias("ed1"))
    reads = reads.withColumn("ed2", F.concat(F.substring("ed1", 1, 14), F.substring("ed1", 16, size)))
    inserted = F.translate(F.substring("ed2", 23, 1), "ACGT", "GTAC")
    reads = reads.withColumn("ed3", F.concat(F.substring("ed2", 1, 22), inserted, F.substring("ed2", 23, size)))
    return reads.withColumn("ed4", swapped(F.col("ed3"), 33, "TACG"))


def long_reads(reads: DataFrame, keys=("doc_id", "position")) -> DataFrame:
    """Reads with a column per error level, one row per read and level."""
    return (reads.unpivot(list(keys), [f"ed{k}" for k in range(5)], "level", "pattern")
            .withColumn("k", F.substring("level", 3, 1).cast("long")).drop("level"))


def reads_csv(spark: SparkSession, path: str) -> DataFrame:
    """A reads file: header, id, planted position, a read for each of 0-4 errors. Column
    names in the file don't matter, their order does. Lines that aren't reads are left out;
    :func:`reads_rejects` has them."""
    return _reads(spark, path).where("rejected is null").drop("rejected")


def reads_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(line, reason) of the lines of a reads file that have too few or too many fields, or
    a number that is none."""
    fields = F.size(F.split("rejected", ","))
    reason = (F.when(fields < len(READS_SCHEMA), "too few fields").when(fields > len(READS_SCHEMA), "too many fields").otherwise("not a number"))
    return _reads(spark, path).where("rejected is not null").select(F.col("rejected").alias("line"), reason.alias("reason"))


def _reads(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*READS_SCHEMA, T.StructField("rejected", T.StringType())])
    rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord="rejected")
    empty = (F.col("id").isNull() | F.col("position").isNull()) & F.col("rejected").isNull()
    return rows.withColumn("rejected", F.when(empty, F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in READS_SCHEMA.names])).otherwise(F.col("rejected")))
