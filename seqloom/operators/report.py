"""Reports on matches: the matched strings, planted positions, reads that were missed,
figures per strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.letters import pieces_of
from ..functions.session import cut_table
from . import approx


def match_report(matches: DataFrame, texts: DataFrame, longest: int = 512) -> DataFrame:
    """Matches with the string of the text that they cover, in order of read, text and
    place. They meet blocks of the texts and not whole ones, so no row carries a long text;
    a match of more than ``longest`` letters is put together from all blocks that it is in.
    Places are sorted for reading only; searches don't rely on it."""
    block = F.floor(F.col("begin") / longest)
    last = F.greatest(block, F.floor((F.col("end") - 1) / longest))
    own = pieces_of(texts, longest, 0, 0).select("doc_id", F.col("piece").cast("long").alias("block"), "text")
    parts = (matches.withColumn("block", F.explode(F.sequence(block, last))).join(own, ["doc_id", "block"])
             .withColumn("at", F.greatest(F.col("begin") - F.col("block") * longest, F.lit(0)).cast("int"))
             .withColumn("part", F.expr("substring(text, at + 1, cast(end - block * %d as int) - at)" % longest)))
    keys = ("pattern_id", "doc_id", "begin", "end", "ed")
    return (parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: x["part"]), "").alias("matched"))
            .select("pattern_id", "doc_id", "begin", "ed", "matched").orderBy("pattern_id", "doc_id", "begin"))


def _seen(matches: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """Per read: its number of matches and whether one is at most k + 2 from where it was
    planted; without a ``planted_doc`` any text will do."""
    near = (F.coalesce(F.col("doc_id") == F.col("planted_doc"), F.lit(True))
            & (F.abs(F.col("begin") - F.col("planted_at")) <= k + 2))
    return (reads.join(matches, "pattern_id", "left").groupBy("pattern_id")
            .agg(F.count("doc_id").alias("n_matches"), F.max(F.coalesce(near, F.lit(False)).cast("long")).alias("planted")))


def planted_recall(matches: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """Per k: reads, reads with a match, reads with one at most k + 2 from where they
    were planted. ``reads`` is (pattern_id, planted_doc, planted_at)."""
    any_ = F.sum((F.col("n_matches") > 0).cast("long"))
    return _seen(matches, reads, k).agg(
        F.lit(k).cast("long").alias("k"), F.count(F.lit(1)).alias("n_reads"),
        F.coalesce(any_, F.lit(0)).alias("n_matched"), F.coalesce(F.sum("planted"), F.lit(0)).alias("n_planted"))


def missed_reads(matches: DataFrame, reads: DataFrame, k: int, texts, check_places: bool = True) -> DataFrame:
    """(pattern_id, reason, n_matches, n_exhaustive): the reads without a match (``none``)
    and, where places are checked, those without one at the planted place (``elsewhere``),
    with the number of places that the plainest strategy finds for them."""
    wrong = (F.col("n_matches") == 0) | (F.lit(check_places) & (F.col("planted") == 0))
    missed = _seen(matches, reads, k).where(wrong)
    again = approx.match(texts, reads.join(missed, "pattern_id", "left_semi").select("pattern_id", "pattern"), k, "naive")
    return (missed.join(again.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n")), "pattern_id", "left")
            .select("pattern_id", F.when(F.col("n_matches") == 0, "none").otherwise("elsewhere").alias("reason"),
                    "n_matches", F.coalesce("n", F.lit(0)).alias("n_exhaustive")))


def _passes(texts, patterns: DataFrame, k: int, strategy) -> tuple[int, DataFrame]:
    """The number of candidates per (pattern, place) pair, counted while the unique matches
    (pattern_id, doc_id, begin, end, ed) are written: candidates are made once."""
    counted = Observation()
    found = approx.candidates(texts, patterns, k, strategy)
    copies = patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("copies"))
    best = (found.groupBy("pattern", "doc_id", "begin").agg(F.min(F.struct("ed", "end")).alias("m"), F.count(F.lit(1)).alias("c"))
            .join(copies, "pattern").observe(counted, F.coalesce(F.sum(F.col("c") * F.col("copies")), F.lit(0)).alias("candidates")))
    unique = approx.drop_neighbours(best.select("pattern", "doc_id", "begin", "m.end", "m.ed"), k)
    unique = cut_table(unique.join(patterns, "pattern").select("pattern_id", "doc_id", "begin", "end", "ed"))
    return counted.get["candidates"], unique


def _figures(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)  # a row per strategy


def strategy_metrics(texts, patterns: DataFrame, k: int, strategies) -> DataFrame:
    """Per strategy: mean number of unique matches and of candidates per pattern."""
    n, rows = patterns.count(), []
    for s in strategies:
        candidates, unique = _passes(texts, patterns, k, s)
        rows.append((getattr(s, "name", s), n, unique.count() / max(n, 1), candidates / max(n, 1)))
    return _figures(patterns.sparkSession, rows, "strategy string, n_reads long, avg_matches double, avg_candidates double")


def strategy_report(texts, reads: DataFrame, k: int, strategies) -> DataFrame:
    """Per strategy: reads, reads with a match, reads found where they were planted, and
    the mean numbers of :func:`strategy_metrics`, all from one pass of candidates."""
    patterns, rows = reads.select("pattern_id", "pattern"), []
    for s in strategies:
        candidates, unique = _passes(texts, patterns, k, s)
        seen = planted_recall(unique, reads, k).first()
        n = seen["n_reads"]
        rows.append((getattr(s, "name", s), k, n, seen["n_matched"], seen["n_planted"], unique.count() / max(n, 1), candidates / max(n, 1)))
    return _figures(reads.sparkSession, rows, "strategy string, k long, n_reads long, n_matched long, n_planted long, avg_matches double, avg_candidates double")
