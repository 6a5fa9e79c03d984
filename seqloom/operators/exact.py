"""Exact occurrences and the ranges of the suffix array that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.letters import SENTINEL, slice_of
from ..functions.session import cut
from .grams import occurrences, source_of


def lengths_of(patterns: DataFrame) -> dict[int, int]:
    """How many patterns there are of each length; as many rows as lengths."""
    return {r["size"]: r["n"] for r in patterns.groupBy(F.length("pattern").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}


def exact_matches(texts, patterns: DataFrame) -> DataFrame:
    """(pattern_id, doc_id, begin) of every occurrence, overlapping ones included.
    ``texts`` is (doc_id, text) or stored texts. Empty patterns are left out."""
    wanted = cut(patterns.where(F.length("pattern") > 0).select("pattern_id", "pattern"))
    distinct = wanted.select(F.col("pattern").alias("near")).distinct()
    lengths = lengths_of(distinct.select(F.col("near").alias("pattern")))
    found = occurrences(source_of(texts), distinct, lengths, max(lengths, default=1))
    return (found.select(F.col("near").alias("pattern"), "doc_id", (F.col("at") + F.col("shift")).alias("begin"))
            .join(wanted, "pattern").select("pattern_id", "doc_id", "begin"))


def suffix_heads(suffixes: DataFrame, texts: DataFrame, lengths) -> DataFrame:
    """(doc_id, row, sa, head, next): each suffix's first letters, for each of ``lengths``
    that it has, and the letter after them."""
    at, size = F.col("sa").cast("int"), F.col("size")
    after = slice_of(F.col("text"), at + size, 1)
    return (suffixes.join(texts, "doc_id").withColumn("size", F.explode(F.array(*[F.lit(n) for n in lengths])))
            .select("doc_id", "row", "sa", slice_of(F.col("text"), at, size).alias("head"),
                    F.when(after == "", SENTINEL).otherwise(after).alias("next"), "size")
            .where(F.length("head") == size).drop("size"))


def backward_search(patterns: DataFrame, heads: DataFrame) -> DataFrame:
    """(pattern, doc_id, lo, hi): the rows whose suffixes start with a pattern of one of
    the heads' lengths. Patterns with a letter that no text has find nothing."""
    return (patterns.select("pattern").distinct().join(heads, F.col("pattern") == F.col("head"))
            .groupBy("pattern", "doc_id").agg(F.min("row").alias("lo"), (F.max("row") + 1).alias("hi")))


def bidirectional_search(patterns: DataFrame, heads: DataFrame, reverse_heads: DataFrame) -> DataFrame:
    """The range in the index of the text and that of the reversed pattern in the
    index of the reversed text; they are equally wide."""
    forward = backward_search(patterns, heads)
    mirrored = patterns.select(F.reverse("pattern").alias("pattern"))
    backward = (backward_search(mirrored, reverse_heads)
                .select(F.reverse("pattern").alias("pattern"), "doc_id", F.col("lo").alias("rlo"), F.col("hi").alias("rhi")))
    return forward.join(backward, ["pattern", "doc_id"])


def char_extensions(patterns: DataFrame, heads: DataFrame, transformed: DataFrame) -> DataFrame:
    """(pattern, doc_id, side, ch, n): the letters before and after the occurrences."""
    hits = (patterns.select("pattern").distinct().join(heads, F.col("pattern") == F.col("head"))
            .join(transformed.select("doc_id", "row", "bwt"), ["doc_id", "row"]))
    both = F.array(F.struct(F.lit("left").alias("side"), F.col("bwt").alias("ch")),
                   F.struct(F.lit("right").alias("side"), F.col("next").alias("ch")))
    return (hits.select("pattern", "doc_id", F.explode(both).alias("x"))
            .groupBy("pattern", "doc_id", "x.side", "x.ch").agg(F.count(F.lit(1)).alias("n")))
