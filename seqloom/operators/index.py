"""Index relations of a text: suffix array, Burrows-Wheeler transform, counts, rank,
LF mapping, samples. One row per suffix; the sentinel that ends a text is the empty
suffix, so it sorts first and no text has to store it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.letters import ALPHABET, SENTINEL, pieces_of, slice_of
from ..functions.session import cut

SYMBOLS = SENTINEL + ALPHABET


#: Letters of a text that are taken apart together.
CHUNK = 256


def _places(texts: DataFrame, size: int) -> DataFrame:
    """(doc_id, sa, key): every place of the texts with the ``size`` letters from there,
    and the end of each text."""
    cut_ = pieces_of(texts, CHUNK, 0, size)
    inner = (cut_.select("doc_id", "piece", "text", F.explode(F.sequence(F.lit(0), F.col("core") - 1)).alias("i"))
             .select("doc_id", (F.col("piece").cast("long") * CHUNK + F.col("i")).alias("sa"), slice_of(F.col("text"), F.col("i"), size).alias("key")))
    return inner.unionByName(texts.select("doc_id", F.length("text").cast("long").alias("sa"), F.lit("").alias("key")))


def suffix_array(texts: DataFrame) -> DataFrame:
    """(doc_id, row, sa) by sorting the suffixes themselves; for short texts, as the
    suffixes of a text take quadratic room."""
    order = Window.partitionBy("doc_id").orderBy("suffix")
    starts = texts.select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.length("text").cast("long"))).alias("sa"))
    return (starts.select("doc_id", "sa", F.expr("substring(text, int(sa) + 1)").alias("suffix"))
            .select("doc_id", (F.row_number().over(order) - 1).cast("long").alias("row"), "sa"))


#: A key with more rows than this, and more than 1 / HOT of all, isn't shuffled.
COMMON, HOT = 4_096, 10_000


def _counted(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, r): the rows of each key, and how many rows have smaller keys.

    Distinct keys are counted, sorted over ranges and summed up: within a range by a
    window, over the ranges by one row each. So no task gets a whole text."""
    counts = cut(rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).repartitionByRange(*by)
                 .select(*by, "n", F.spark_partition_id().alias("part")))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    ahead = (counts.groupBy("part").agg(F.sum("n").alias("n"))
             .select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("ahead")))  # a row per partition
    within = F.coalesce(F.sum("n").over(before.partitionBy("part").orderBy(*by)), F.lit(0))
    return counts.join(F.broadcast(ahead), "part").select(*by, "n", (F.col("ahead") + within).alias("r"))


def _ranked(rows: DataFrame, ranks: DataFrame, by: list[str]) -> DataFrame:
    """(doc_id, sa, rank, n): the rows with what ``ranks`` (by..., n, rank) says of their
    keys. Keys of very many rows are few and broadcast; their rows stay where they are."""
    most = max(COMMON, (ranks.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot = F.broadcast(ranks.where(F.col("n") > most))
    rest = rows.join(hot.select(*by), by, "left_anti").join(ranks.where(F.col("n") <= most), by)
    return rows.join(hot, by).select("doc_id", "sa", "rank", "n").unionByName(rest.select("doc_id", "sa", "rank", "n"))


def suffix_array_doubling(texts: DataFrame, first: int = 8) -> DataFrame:
    """The same relation by prefix doubling: ranks by the first ``first`` letters, then
    by the rank as far on as is known already, twice as far each pass. A suffix whose rank
    is its own is final and set aside: it is looked up by others, but sorted no more, so a
    pass has only the suffixes that still share theirs. No suffix is stored, and long texts
    are sorted over many tasks; each pass is written to the shared folder."""
    rows, by = cut(_places(texts, first)), ["doc_id", "key"]
    now = cut(_ranked(rows, cut(_counted(rows, by).withColumnRenamed("r", "rank")), by))
    final, step = now.where("n = 1").drop("n"), first
    now = now.where("n > 1").drop("n")
    while not now.isEmpty():
        later = now.unionByName(final).select("doc_id", (F.col("sa") - step).alias("sa"), F.col("rank").alias("then"))
        pairs = cut(now.join(later, ["doc_id", "sa"], "left").withColumn("then", F.coalesce("then", F.lit(-1))))
        by = ["doc_id", "rank", "then"]
        counts = cut(_counted(pairs, by))
        start = counts.groupBy("doc_id", "rank").agg(F.min("r").alias("start"))
        moved = cut(counts.join(start, ["doc_id", "rank"]).select(*by, "n", (F.col("rank") + F.col("r") - F.col("start")).alias("to")))
        found = cut(_ranked(pairs.withColumnRenamed("rank", "was"), moved.withColumnsRenamed({"rank": "was", "to": "rank"}), ["doc_id", "was", "then"]))
        final = final.unionByName(found.where("n = 1").drop("n"))
        now = found.where("n > 1").drop("n")
        step *= 2
    final = cut(final)
    least = final.groupBy("doc_id").agg(F.min("rank").alias("least"))
    return final.join(least, "doc_id").select("doc_id", (F.col("rank") - F.col("least")).alias("row"), "sa")


def reversed_texts(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", F.reverse("text").alias("text"))


def bwt(texts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(doc_id, row, sa, bwt): the letter before each suffix, the sentinel before the
    first. Letters are joined by their place, so no row carries a text."""
    before = _places(texts, 1).where("key <> ''").select("doc_id", (F.col("sa") + 1).alias("sa"), F.col("key").alias("bwt"))
    return (suffixes.join(before, ["doc_id", "sa"], "left")
            .select("doc_id", "row", "sa", F.coalesce("bwt", F.lit(SENTINEL)).alias("bwt")))


def bwt_string(transformed: DataFrame) -> DataFrame:
    """(doc_id, bwt): the transform of a text as one string."""
    rows = F.array_sort(F.collect_list(F.struct("row", "bwt")))
    return transformed.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["bwt"]), "").alias("bwt"))


def bwt_chunks(transformed: DataFrame, size: int = 4_096) -> DataFrame:
    """(doc_id, chunk, letters): the transform in chunks of ``size`` letters, in order; a row
    holds no more than that, however long a text is."""
    rows = F.array_sort(F.collect_list(F.struct("row", "bwt")))
    return (transformed.groupBy("doc_id", F.floor(F.col("row") / size).alias("chunk"))
            .agg(F.array_join(F.transform(rows, lambda r: r["bwt"]), "").alias("letters")))


def char_histogram(texts: DataFrame) -> DataFrame:
    """(doc_id, ch, n), the sentinel included. A text gives one row per letter it
    has, not one per position, by what is left when the letter is taken out."""
    counted = [F.struct(F.lit(c).alias("ch"), (F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("long").alias("n"))
               for c in ALPHABET]
    return (texts.select("doc_id", F.explode(F.array(F.struct(F.lit(SENTINEL).alias("ch"), F.lit(1).cast("long").alias("n")), *counted)).alias("x"))
            .select("doc_id", "x.ch", "x.n").where("n > 0"))


def alphabet(texts: DataFrame) -> DataFrame:
    """(ch, idx): the symbols of all texts in ascending order."""
    return (char_histogram(texts).select("ch").distinct()
            .select("ch", (F.dense_rank().over(Window.orderBy("ch")) - 1).cast("long").alias("idx")))


def c_table(histogram: DataFrame) -> DataFrame:
    """(doc_id, ch, n, c): how many symbols of a text are smaller."""
    before = Window.partitionBy("doc_id").orderBy("ch").rowsBetween(Window.unboundedPreceding, -1)
    return histogram.withColumn("c", F.coalesce(F.sum("n").over(before), F.lit(0)))


def occ(transformed: DataFrame) -> DataFrame:
    """(doc_id, row, ch, occ, pref_occ): symbols equal to, and smaller than, ``ch`` in
    the transform before ``row``; one sort for all symbols."""
    before = Window.partitionBy("doc_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    counts = {c: F.coalesce(F.sum((F.col("bwt") == c).cast("long")).over(before), F.lit(0)) for c in SYMBOLS}
    wide = transformed.select("doc_id", "row", *[v.alias(f"n{i}") for i, v in enumerate(counts.values())])
    smaller = lambda i: sum((F.col(f"n{j}") for j in range(i)), F.lit(0).cast("long"))
    long = F.array(*[F.struct(F.lit(c).alias("ch"), F.col(f"n{i}").alias("occ"), smaller(i).alias("pref_occ")) for i, c in enumerate(SYMBOLS)])
    return wide.select("doc_id", "row", F.explode(long).alias("x")).select("doc_id", "row", "x.ch", "x.occ", "x.pref_occ")


def lf_mapping(transformed: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, row, sa, bwt, lf): the row of the suffix one letter longer."""
    same = Window.partitionBy("doc_id", "bwt").orderBy("row")
    return (transformed.withColumn("nth", F.row_number().over(same) - 1)
            .join(counts.select("doc_id", F.col("ch").alias("bwt"), "c"), ["doc_id", "bwt"])
            .select("doc_id", "row", "sa", "bwt", (F.col("c") + F.col("nth")).cast("long").alias("lf")))


def sparse_suffix_array(suffixes: DataFrame, every: int) -> DataFrame:
    """Every ``every``-th row of the suffix array; a power of two up to 256."""
    if every not in (1, 2, 4, 8, 16, 32, 64, 128, 256):
        raise ValueError("the sample rate is a power of two from 1 to 256")
    return suffixes.where(F.col("row") % every == 0)


def lookup_by_sample(mapped: DataFrame, sample: DataFrame, every: int) -> DataFrame:
    """(doc_id, row, sa) found from the sample alone: follow LF to a sampled row and
    add the steps. All rows walk at once; the distance doubles with each pass."""
    walk = cut(mapped.select("doc_id", "row", F.when(F.col("row") % every == 0, F.col("row")).otherwise(F.col("lf")).alias("at"),
                             F.when(F.col("row") % every == 0, 0).otherwise(1).cast("long").alias("steps")))
    while walk.where(F.col("at") % every != 0).limit(1).count():
        further = walk.select("doc_id", F.col("row").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("steps2"))
        walk = cut(walk.join(further, ["doc_id", "at"]).select("doc_id", "row", F.col("at2").alias("at"), (F.col("steps") + F.col("steps2")).alias("steps")))
    size = mapped.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return (walk.join(sample.select("doc_id", F.col("row").alias("at"), "sa"), ["doc_id", "at"]).join(size, "doc_id")
            .select("doc_id", "row", ((F.col("sa") + F.col("steps")) % F.col("n")).alias("sa")))


def sample_rates(suffixes: DataFrame) -> DataFrame:
    """Rows with ``rate``, the largest power of two up to 256 that divides the row: the
    sample of rate f is ``rate >= f``, so one table holds all nine samples."""
    rate = F.lit(1)
    for n in range(1, 9):
        rate = F.when(F.col("row") % (1 << n) == 0, 1 << n).otherwise(rate)
    return suffixes.select("doc_id", "row", "sa", rate.alias("rate"))


def build_index(texts: DataFrame, path: str) -> None:
    """Writes, for the texts and for the reversed texts, the suffixes with transform and
    LF mapping, the transform in chunks, the counts, and the samples of all rates under ``path``."""
    for side, source in (("", texts), ("reverse_", reversed_texts(texts))):
        suffixes, counts = cut(suffix_array_doubling(source)), c_table(char_histogram(source))
        transformed = cut(bwt(source, suffixes))
        lf_mapping(transformed, counts).write.parquet(f"{path}/{side or 'suffix_'}index")
        bwt_chunks(transformed).write.parquet(f"{path}/{side}bwt")
        counts.write.parquet(f"{path}/{side}c_table")
        sample_rates(suffixes).write.partitionBy("rate").parquet(f"{path}/{side}samples")
