"""Batch jobs for spark-submit: build an index, store texts for searches, search reads.

    search.py index TEXTS OUT
    search.py store TEXTS OUT [--plain] [--longest N]
    search.py check STORED
    search.py match TEXTS READS OUT [--plain | --stored] [--max-ed K] [--strategy NAME] [--schemes TABLE]
    search.py compare TEXTS READS.csv OUT [--plain | --stored] [--max-ed K] [--read-positions-incorrect]

TEXTS is Parquet with doc_id and text, text files (``--plain``: a file is a text), or
what ``store`` has written (``--stored``); ``check`` reads all of that again and fails if it
was changed. READS is Parquet with pattern_id and pattern. ``--schemes`` is Parquet with
strategy, k, order, lower and upper: strategies of one's own. ``compare`` takes a reads file (id,
position, a read for each of 0 to 4 errors), runs every strategy on the reads with K
errors and writes OUT/matches, OUT/report (figures and seconds per strategy),
OUT/missed (reads without a match, or without one where they were planted) and
OUT/rejects (lines of the file that are no reads). A strategy's report is written last:
run again, ``compare`` leaves out the strategies that have one, so a job that was killed
goes on where it stopped.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.schemes import MAX_K, STRATEGIES, own_scheme
from ..operators import approx, grams, index, report
from ..sources import corpus
from ..sources.text_files import TextFiles


def compare(spark: SparkSession, texts, reads_path: str, out: str, k: int, check_places: bool = True, strategies=STRATEGIES, depth_first: bool = False) -> None:
    """Runs the strategies one after the other; each one's matches are written before the
    next starts, so its seconds are its own."""
    reads = (corpus.reads_csv(spark, reads_path)
             .select(F.col("id").alias("pattern_id"), F.col(f"ed{k}").alias("pattern"), F.col("position").alias("planted_at"))
             .withColumn("planted_doc", F.lit(None).cast(grams.source_of(texts).id_type)))
    n = reads.count()
    corpus.reads_rejects(spark, reads_path).write.mode("overwrite").parquet(f"{out}/rejects")
    for name in strategies:
        if _finished(spark, f"{out}/report/strategy={name}"):
            continue
        began = time.time()
        (approx.match(texts, reads.select("pattern_id", "pattern"), k, name, depth_first)
         .write.mode("overwrite").parquet(f"{out}/matches/strategy={name}"))
        seconds = time.time() - began
        found = spark.read.parquet(f"{out}/matches/strategy={name}")
        report.missed_reads(found, reads, k, texts, check_places).write.mode("overwrite").parquet(f"{out}/missed/strategy={name}")
        (report.planted_recall(found, reads, k)
         .withColumns({"n_matches": F.lit(found.count()), "seconds": F.lit(seconds), "seconds_a_read": F.lit(seconds / max(n, 1))})
         .write.mode("overwrite").parquet(f"{out}/report/strategy={name}"))


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether Spark's writer has ended there; asked of the file system that Spark uses."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = parser.add_subparsers(dest="job", required=True)
    for job, names in (("index", ("texts", "out")), ("store", ("texts", "out")), ("check", ("texts",)), ("match", ("texts", "reads", "out")), ("compare", ("texts", "reads", "out"))):
        one = jobs.add_parser(job)
        for name in names:
            one.add_argument(name)
        if job == "store":
            one.add_argument("--longest", type=int, default=250)
        if job in ("store", "match", "compare"):
            one.add_argument("--plain", action="store_true")
        if job in ("match", "compare"):
            one.add_argument("--stored", action="store_true")
            one.add_argument("-e", "--max-ed", type=int, default=2, choices=range(MAX_K + 1))
            one.add_argument("-d", "--depth-first", action="store_true")
        if job == "match":
            one.add_argument("--strategy", default="pigeon")
            one.add_argument("--schemes")
        if job == "compare":
            one.add_argument("-ri", "--read-positions-incorrect", action="store_true")
    chosen = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"seqloom-{chosen.job}").getOrCreate()
    if chosen.job == "check":
        grams.check(spark, chosen.texts)
        return
    if getattr(chosen, "stored", False):
        texts = grams.StoredTexts(spark, chosen.texts)
    elif getattr(chosen, "plain", False):
        texts = TextFiles(spark, chosen.texts)
    else:
        texts = spark.read.parquet(chosen.texts)
    if chosen.job == "index":
        index.build_index(texts, chosen.out)
    elif chosen.job == "store":
        grams.store(texts, chosen.out, chosen.longest)
    elif chosen.job == "match":
        strategy = own_scheme(spark.read.parquet(chosen.schemes), chosen.strategy) if chosen.schemes else chosen.strategy
        approx.match(texts, spark.read.parquet(chosen.reads), chosen.max_ed, strategy, chosen.depth_first).write.parquet(chosen.out)
    else:
        compare(spark, texts, chosen.reads, chosen.out, chosen.max_ed, not chosen.read_positions_incorrect, depth_first=chosen.depth_first)


if __name__ == "__main__":
    main()
