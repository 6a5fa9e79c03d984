"""The queries by name: each reads whole tables and takes (spark, sf_dir)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import schemes
from .functions.letters import letters
from .functions.session import shared_folder
from .operators import approx, exact, grams, index, report
from .sources import corpus
from .sources.text_files import TextFiles

#: Letters of the patterns for suffix ranges, rows between samples, k of the strategies.
SHORT, SAMPLE, STRATEGY_K = 8, 8, 2
#: Letters of a chunk of the transform.
CHUNK = 64
#: Letters and k of the patterns that are too short for pieces.
HEAD, HEAD_K = 12, 4


def read_tiles(spark, sf_dir, size=corpus.READ) -> DataFrame:
    """(pattern_id, pattern): every document cut into reads."""
    cut = corpus.tiles(corpus.document_texts(spark, sf_dir), size)
    return cut.select(F.concat_ws(":", "doc_id", "position").alias("pattern_id"), "pattern")


def planted(spark, sf_dir, k: int) -> DataFrame:
    """(pattern_id, pattern, planted_doc, planted_at): reads with k errors from the
    reference texts."""
    reads = corpus.planted_reads(corpus.reference_texts(spark, sf_dir))
    return reads.select(F.concat_ws(":", "doc_id", "position").alias("pattern_id"), F.col(f"ed{k}").alias("pattern"),
                        F.col("doc_id").alias("planted_doc"), F.col("position").alias("planted_at"))


def _index(operator):
    """A query over the index relations of the reference texts."""
    def query(spark, sf_dir):
        texts = corpus.reference_texts(spark, sf_dir)
        return operator(texts)
    return query


def _transformed(texts):
    return index.bwt(texts, index.suffix_array(texts))


def _mapped(texts):
    return index.lf_mapping(_transformed(texts), index.c_table(index.char_histogram(texts)))


def _sparse_lookup(texts):
    return index.lookup_by_sample(_mapped(texts), index.sparse_suffix_array(index.suffix_array(texts), SAMPLE), SAMPLE)


def _heads(texts):
    return exact.suffix_heads(index.suffix_array(texts), texts, range(1, SHORT + 1))


def backward_search_range(spark, sf_dir):
    return exact.backward_search(read_tiles(spark, sf_dir, SHORT), _heads(corpus.reference_texts(spark, sf_dir)))


def bidirectional_range(spark, sf_dir):
    texts = corpus.reference_texts(spark, sf_dir)
    return exact.bidirectional_search(read_tiles(spark, sf_dir, SHORT), _heads(texts), _heads(index.reversed_texts(texts)))


def char_extensions(spark, sf_dir):
    texts = corpus.reference_texts(spark, sf_dir)
    return exact.char_extensions(read_tiles(spark, sf_dir, SHORT), _heads(texts), _transformed(texts))


def exact_match_docs(spark, sf_dir):
    """Pieces of 40 characters of every benchmark text, as they are, in all documents."""
    passages = corpus.tiles(corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), 40)
    documents = corpus.table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.exact_matches(documents, passages.select(F.concat_ws(":", "doc_id", "position").alias("pattern_id"), "pattern"))


def edit_distance(spark, sf_dir):
    reads = corpus.planted_reads(corpus.reference_texts(spark, sf_dir))
    first = reads.select("doc_id", "position", "ed0")
    return (corpus.long_reads(reads).join(first, ["doc_id", "position"])
            .select("doc_id", "position", "k", F.levenshtein("ed0", "pattern").cast("long").alias("ed")))


def candidates(spark, sf_dir):
    return approx.candidates(corpus.reference_texts(spark, sf_dir), read_tiles(spark, sf_dir), 2)


def best_per_start(spark, sf_dir):
    return approx.best_per_start(candidates(spark, sf_dir))


def canonical(k, strategy="pigeon", depth_first=False):
    def query(spark, sf_dir):
        return approx.match(corpus.reference_texts(spark, sf_dir), read_tiles(spark, sf_dir), k, strategy, depth_first)
    return query


def short_pattern(spark, sf_dir):
    """The first letters of the reads of the reference texts, with so many errors that
    they are too short for pieces."""
    reads = corpus.tiles(corpus.reference_texts(spark, sf_dir))
    patterns = reads.select(F.substring("pattern", 1, HEAD).alias("pattern")).distinct()
    return approx.match(corpus.reference_texts(spark, sf_dir), patterns.select(F.col("pattern").alias("pattern_id"), "pattern"), HEAD_K)


def tiny_pattern(spark, sf_dir):
    """Patterns of two letters with one error."""
    patterns = read_tiles(spark, sf_dir, 2).select("pattern").distinct().select(F.col("pattern").alias("pattern_id"), "pattern")
    return approx.match(corpus.reference_texts(spark, sf_dir), patterns, 1)


def segment_match(spark, sf_dir):
    """Reads of the reference texts in the lines of all documents; none crosses a line."""
    lines = corpus.segments(corpus.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    texts = lines.select(F.concat_ws(":", "doc_id", "segment").alias("doc_id"), letters(F.col("text")).alias("text"))
    reads = corpus.tiles(corpus.reference_texts(spark, sf_dir))
    return approx.match(texts, reads.select(F.concat_ws(":", "doc_id", "position").alias("pattern_id"), "pattern"), 1)


def pattern_pieces(spark, sf_dir):
    pieces = approx.pattern_pieces(read_tiles(spark, sf_dir).select("pattern").distinct(), 3)
    return pieces.select("pattern", F.col("piece").cast("long"), F.col("offset").cast("long"), "seed")


def scheme_seeds(spark, sf_dir):
    """The seeds of each strategy and k on the reads of the reference texts."""
    reads = corpus.tiles(corpus.reference_texts(spark, sf_dir)).select("pattern").distinct()
    parts = [approx.seeds(reads, k, s).select(F.lit(s).alias("strategy"), F.lit(k).cast("long").alias("k"), "pattern",
                                              F.col("offset").cast("long"), F.col("near").alias("seed")).distinct()
             for s in schemes.STRATEGIES[:6] for k in range(1, 5)]
    return reduce(DataFrame.unionByName, parts)


def match_report(spark, sf_dir):
    texts = corpus.reference_texts(spark, sf_dir)
    return report.match_report(approx.match(texts, planted(spark, sf_dir, 1).select("pattern_id", "pattern"), 2), texts)


def planted_recall(spark, sf_dir):
    texts = corpus.reference_texts(spark, sf_dir)
    parts = []
    for k in range(5):
        reads = planted(spark, sf_dir, k)
        found = approx.match(texts, reads.select("pattern_id", "pattern"), k)
        parts.append(report.planted_recall(found, reads.select("pattern_id", "planted_doc", "planted_at"), k))
    return reduce(DataFrame.unionByName, parts)


def strategy_metrics(spark, sf_dir):
    reads = planted(spark, sf_dir, 0).select("pattern_id", "pattern")
    return report.strategy_metrics(corpus.reference_texts(spark, sf_dir), reads, STRATEGY_K, schemes.STRATEGIES)


def strategy_report(spark, sf_dir):
    return report.strategy_report(corpus.reference_texts(spark, sf_dir), planted(spark, sf_dir, STRATEGY_K), STRATEGY_K, schemes.STRATEGIES)


def missed_reads(spark, sf_dir):
    """Reads with one error more than is allowed for."""
    texts, reads = corpus.reference_texts(spark, sf_dir), planted(spark, sf_dir, STRATEGY_K + 1)
    found = approx.match(texts, reads.select("pattern_id", "pattern"), STRATEGY_K, "kianfar")
    return report.missed_reads(found, reads, STRATEGY_K, texts)


def match_stored_index(spark, sf_dir):
    """Grams and blocks of the letters of all documents are written; the reads of the
    reference texts are searched in what was written."""
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4()}"
    grams.store(corpus.document_texts(spark, sf_dir), path)
    return approx.match(grams.StoredTexts(spark, path), planted(spark, sf_dir, 1).select("pattern_id", "pattern"), STRATEGY_K)


def match_text_files(spark, sf_dir):
    """The reference texts as text files, a file each, read by byte ranges; the reads are
    searched in what was read."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4()}"
    texts = corpus.reference_texts(spark, sf_dir).where("text <> ''")
    texts.select(F.col("doc_id").alias("doc"), "text").repartition("doc").write.partitionBy("doc").text(path)
    found = approx.match(TextFiles(spark, path), planted(spark, sf_dir, 1).select("pattern_id", "pattern"), STRATEGY_K)
    return found.withColumn("doc_id", F.regexp_extract("doc_id", "/doc=(-?[0-9]+)/", 1).cast("long"))


#: A strategy of one's own, as rows of a table: three pieces, at most two errors.
OWN = [("inward", 2, "012", "000", "012"), ("inward", 2, "210", "000", "022"), ("inward", 2, "102", "000", "022")]


def own_scheme_match(spark, sf_dir):
    rows = spark.createDataFrame(OWN, "strategy string, k int, order string, lower string, upper string")
    reads = planted(spark, sf_dir, 2).select("pattern_id", "pattern")
    return approx.match(corpus.reference_texts(spark, sf_dir), reads, STRATEGY_K, schemes.own_scheme(rows, "inward"))


def queries():
    return {
        "text_source": corpus.document_texts,
        "alphabet": lambda s, d: index.alphabet(corpus.document_texts(s, d)),
        "char_histogram": lambda s, d: index.char_histogram(corpus.document_texts(s, d)),
        "c_table": lambda s, d: index.c_table(index.char_histogram(corpus.document_texts(s, d))),
        "suffix_array": _index(index.suffix_array),
        "reverse_suffix_array": _index(lambda t: index.suffix_array(index.reversed_texts(t))),
        "suffix_array_doubling": _index(index.suffix_array_doubling),
        "bwt": _index(_transformed),
        "bwt_string": _index(lambda t: index.bwt_string(_transformed(t))),
        "bwt_chunks": _index(lambda t: index.bwt_chunks(_transformed(t), CHUNK)),
        "reverse_bwt": _index(lambda t: _transformed(index.reversed_texts(t))),
        "occ": _index(lambda t: index.occ(_transformed(t)).select("doc_id", "row", "ch", "occ")),
        "pref_occ": _index(lambda t: index.occ(_transformed(t)).select("doc_id", "row", "ch", "pref_occ")),
        "lf_mapping": _index(_mapped),
        "sparse_sa": _index(lambda t: index.sparse_suffix_array(index.suffix_array(t), SAMPLE)),
        "sa_lookup_sparse": _index(_sparse_lookup),
        "backward_search_range": backward_search_range,
        "bidirectional_range": bidirectional_range,
        "char_extensions": char_extensions,
        "exact_match": lambda s, d: exact.exact_matches(corpus.reference_texts(s, d), read_tiles(s, d)),
        "exact_match_docs": exact_match_docs,
        "edit_distance": edit_distance,
        "approx_candidates": candidates,
        "approx_best_per_start": best_per_start,
        "approx_k0": canonical(0),
        **{f"approx_canonical_k{k}": canonical(k) for k in range(1, 5)},
        **{f"strategy_{s}": canonical(STRATEGY_K, s) for s in schemes.STRATEGIES},
        **{f"strategy_{s}_k{k}": canonical(k, s) for s in schemes.STRATEGIES for k in (3, 4)},
        "approx_depth_first": canonical(STRATEGY_K, "kplus1", depth_first=True),
        "approx_short_pattern": short_pattern,
        "approx_tiny_pattern": tiny_pattern,
        "approx_segments": segment_match,
        "pattern_pieces": pattern_pieces,
        "scheme_seeds": scheme_seeds,
        "reads_long": lambda s, d: corpus.long_reads(corpus.planted_reads(corpus.reference_texts(s, d))),
        "match_report": match_report,
        "planted_recall": planted_recall,
        "strategy_metrics": strategy_metrics,
        "strategy_report": strategy_report,
        "missed_reads": missed_reads,
        "match_stored_index": match_stored_index,
        "match_text_files": match_text_files,
        "own_scheme_match": own_scheme_match,
    }


def oracle_sql():
    from .oracles import oracle_sql as found

    return found()
