"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the byte-wise built-in; the
    others need ``translate`` because ``lower`` would also change letters
    beyond A-Z."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def fresh(name: str, columns: list[str]) -> str:
    """``name``, led by as many underscores as it takes to differ from ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def count_words(text: Column) -> Column:
    """Number of words (BIGINT); null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints. The cluster's ``spark.checkpoint.dir``
    wins; a temporary folder is used only where none is set (tests, one
    machine)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="seqloom-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage, so that a
    lost executor costs a re-read and not a re-computation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_small(big: DataFrame, small: DataFrame, key: str, salt_by: Column,
               how: str = "inner", broadcast_rows: int = 100_000, salts: int = 64) -> DataFrame:
    """Join a big table to one that is usually tiny.

    ``small`` must be cheap to count (cut it first). Up to ``broadcast_rows``
    rows it is broadcast; beyond, both sides are shuffled on (key, salt), so
    that a hot key of ``big`` is dealt to ``salts`` tasks.
    """
    if small.count() <= broadcast_rows:
        return big.join(F.broadcast(small), key, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (big.withColumn("__salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
            .join(salted, [key, "__salt"], how).drop("__salt"))


def join_counted(big: DataFrame, small: DataFrame, key: str, least: int = 1024, hot_keys: int = 100_000) -> DataFrame:
    """Inner join of ``big`` to ``small``, which has one row a key with ``n``, the key's
    number of rows in ``big``; no task gets a key with very many rows.

    Keys with more than ``least`` rows and more than 1 / ``hot_keys`` of all rows are
    fewer than ``hot_keys``: their part of ``small`` is bounded and broadcast, and
    their rows stay where they are. The others are shuffled. ``small`` should be
    cheap to read (cut it first)."""
    found = small.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    limit = max(least, (found["rows"] or 0) // hot_keys)
    if (found["most"] or 0) <= limit:
        return big.join(small, key)
    hot = F.broadcast(small.where(F.col("n") > limit))
    rest = big.join(F.broadcast(small.where(F.col("n") > limit).select(key)), key, "left_anti")
    return big.join(hot, key).unionByName(rest.join(small.where(F.col("n") <= limit), key))


def cut_table(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as a compressed columnar table in the shared folder; for
    data of which later steps read single columns."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches, rows: int = 512):
    """Arrow batches in shorter pieces, without a copy, so that only few texts are
    Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
