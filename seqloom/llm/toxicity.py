"""Toxicity by a counterfactual-regularised linear classifier.

Features are the distinct words of a text and the first 3 to 6 letters of its
longer words (inflected forms share them), and which of ``LENGTHS`` a text's number of
words stays below: in a long text more words are there by chance, so that it takes more
of them to tell. Identity terms (groups of people) have
a feature of their own and no prefixes. For each labelled text that names a
group, a counterfactual copy has the term swapped for another of its set, and
the loss adds ``PENALTY * (logit - logit of the copy)**2``: the score has to rest
on what is said, not on who is mentioned.

*Groups.* The sets of terms are a parameter: ``IDENTITY`` by default, or a table (set,
term) read by :func:`group_sets`. A text that names no group has no counterfactual copy.
:func:`group_gaps` shows what the penalty does: it plants a correlation between groups
and labels in labelled sentences and measures how far scores move when terms are swapped.

*Training* uses a bounded sample of labelled documents, the ``TRAIN_ROWS`` ids with the
smallest hash, one text each; features are counted by Spark over the sample, the
``VOCABULARY`` most telling ones go into the model, and the fit runs on the
driver over at most TRAIN_ROWS * VOCABULARY bits. *Scoring* reads every text in
full, where it is, without a shuffle.

*Defined cases.* A null text is empty and gets the score of a short text without known
words. Without labels of both kinds every score is 0. Conflicting labels of
one id count as toxic; null labels don't count. Of a labelled id with several texts the
first in code point order is learnt from; repeated rows count once. Ties between
features go by name. An empty table gives an empty result. Labels, lang, source and ids
are never features; further columns come through untouched.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut, fresh, slices

TRAIN_ROWS = 16_384
VOCABULARY = 1_024
MIN_DOCS = 4
#: Least log-likelihood ratio (G squared) of a feature that is commoner in toxic texts.
TELLING = 15.0
PENALTY = 4.0
RIDGE = 5e-5
SPARSE = 5e-5
STEPS = 1_000
PREFIXES = (3, 4, 5, 6)
#: A text of fewer words than one of these has a feature for it.
LENGTHS = (64, 128, 256, 512, 1_024, 2_048)
#: Word lookups a worker keeps, and the longest word it keeps.
KEPT_WORDS, LONGEST_KEPT = 100_000, 48
#: Most terms of a table of groups.
MAX_TERMS = 10_000

#: Identity terms; terms of one set can stand for each other.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("old", "young", "elderly"), ("blind", "deaf", "disabled"),
    ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str, identity: frozenset) -> list[str]:
    """Names of the features of one lower-cased word."""
    if word in identity:
        return [word]
    return [word, *(f"^{word[:n]}" for n in PREFIXES if len(word) > n)]


def length_features(words: int) -> list[str]:
    return [f"<{n}" for n in LENGTHS if words < n]


def text_features(text: str | None, identity: frozenset) -> set[str]:
    words = _WORD.findall((text or "").lower())
    return {f for w in set(words) for f in word_features(w, identity)}.union(length_features(len(words)))


def group_sets(groups: DataFrame) -> tuple:
    """Sets of terms from a table (set, term) of at most ``MAX_TERMS`` rows; terms are
    lower-cased, sets of fewer than two terms have nothing to swap."""
    rows = groups.where("set is not null and term is not null").select("set", F.lower("term").alias("term")).distinct().limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    sets: dict = {}
    for r in sorted(rows):
        sets.setdefault(r["set"], []).append(r["term"])
    return tuple(tuple(t) for t in sets.values() if len(t) > 1)


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text and toxic of at most ``rows`` labelled documents, chosen by hash; one row an
    id, however many rows have it; cut."""
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
              .groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return cut(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("__toxic").cast("int").alias("toxic")).drop("doc_id"))


def _counts(sample: DataFrame, identity: frozenset) -> DataFrame:
    def run(batches):
        for b in slices(batches, 4_096):
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for f in text_features(text, identity):
                    seen.setdefault(f, [0, 0])[1 if toxic else 0] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()),
                 pa.array([v[0] for v in seen.values()], pa.int64())], ["feature", "pos", "neg"])

    return (sample.mapInArrow(run, "feature string, pos long, neg long").groupBy("feature")
            .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") + F.col("neg") >= MIN_DOCS))


def _telling(n_pos: int, n_neg: int):
    """G squared of presence against the label; 0 where toxic texts have it less."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    share = (pos + neg) / (n_pos + n_neg)

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    g = 2 * (term(pos, share * n_pos) + term(neg, share * n_neg)
             + term(n_pos - pos, (1 - share) * n_pos) + term(n_neg - neg, (1 - share) * n_neg))
    return F.when(pos * n_neg > neg * n_pos, g).otherwise(F.lit(0.0))


def _rows(sample: DataFrame, index: dict[str, int], identity: frozenset) -> DataFrame:
    def run(batches):
        for b in slices(batches):
            found = [np.array(sorted(index[f] for f in text_features(t, identity) if f in index), np.int32).tobytes()
                     for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), b.column(1)], ["features", "toxic"])

    return sample.mapInArrow(run, "features binary, toxic int")


def swapped(features: np.ndarray, index: dict[str, int], sets=IDENTITY) -> np.ndarray | None:
    """The counterfactual of a row: each identity term replaced by the next of its
    set; None for a row that names no group."""
    present, out = set(features.tolist()), set(features.tolist())
    for terms in sets:
        ids = [index[t] for t in terms]
        here = [k for k, i in enumerate(ids) if i in present]
        out -= {ids[k] for k in here}
        out |= {ids[(k + 1) % len(ids)] for k in here}
    return None if out == present else np.array(sorted(out), np.int32)


def fit_weights(rows: list[tuple[np.ndarray, int]], size: int, index: dict[str, int],
                penalty: float = PENALTY, ridge: float = RIDGE, sparse: float = SPARSE, steps: int = STEPS, sets=IDENTITY) -> tuple[np.ndarray, float]:
    """Logistic regression without negative weights, with ridge, lasso and
    counterfactual penalty, by accelerated projected gradients."""
    y = np.array([t for _, t in rows], float)
    at = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    col = np.concatenate([f for f, _ in rows] or [np.empty(0, np.int32)])
    pairs = [(f, s) for f, _ in rows if (s := swapped(f, index, sets)) is not None]
    pair_at = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs]).astype(int)
    pair_col = np.concatenate([np.concatenate(p) for p in pairs]) if pairs else np.empty(0, np.int32)
    sign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in pairs]) if pairs else np.empty(0)
    weight = np.sqrt(np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y))  # rare class counts more

    def logits(w):
        return np.bincount(at, w[col], len(rows)) + w[size]

    def gaps(w):
        return np.bincount(pair_at, sign * w[pair_col], len(pairs))

    def back(by_row, by_pair):
        return np.r_[np.bincount(col, by_row[at], size) + np.bincount(pair_col, sign * by_pair[pair_at], size), by_row.sum()]

    scale = 2 * penalty / max(len(pairs), 1)
    u = np.ones(size + 1) / np.sqrt(size + 1)
    for _ in range(30):  # the largest curvature of the loss, by power iteration
        u = back(0.25 * weight / len(rows) * logits(u), scale * gaps(u))
        steepest = np.linalg.norm(u)
        u = u / steepest
    step = 1 / (1.1 * steepest + ridge)
    w = np.zeros(size + 1)
    w[size] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        g = weight * (1 / (1 + np.exp(-np.clip(logits(ahead), -30, 30))) - y) / len(rows)
        grad = back(g, scale * gaps(ahead))
        grad[:size] += ridge * ahead[:size] + sparse
        new = ahead - step * grad
        new[:size] = np.maximum(new[:size], 0)  # harmless words around an insult don't excuse it
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (last - 1) / t * (new - w), new
    return w[:size], float(w[size])


def train(docs: DataFrame, labels: DataFrame, penalty: float = PENALTY, rows: int = TRAIN_ROWS, sets=IDENTITY) -> dict | None:
    """The model: feature weights and bias. ``labels`` (doc_id, toxic) has only
    rows that may be learnt from. None without labels of both kinds."""
    return train_on(training_sample(docs, labels, rows), penalty, sets)


def train_on(sample: DataFrame, penalty: float = PENALTY, sets=IDENTITY) -> dict | None:
    """The model of a bounded, cut table (text, toxic)."""
    identity = frozenset(t for s in sets for t in s)
    kinds = {r["toxic"] > 0: r["count"] for r in sample.where("toxic is not null").groupBy(F.expr("int(toxic > 0) as toxic")).count().collect()}
    if len(kinds) < 2:
        return None
    n_pos, n_neg = kinds[True], kinds[False]
    telling = _telling(n_pos, n_neg)
    top = [r["feature"] for r in _counts(sample, identity).where(telling >= TELLING).orderBy(telling.desc(), "feature").limit(VOCABULARY).collect()]
    index = {f: k for k, f in enumerate(dict.fromkeys([*top, *sorted(identity), *length_features(0)]))}
    data = [(np.frombuffer(r["features"], np.int32), int(r["toxic"] > 0)) for r in _rows(sample, index, identity).collect()]
    data.sort(key=lambda r: (r[0].tobytes(), r[1]))  # sums don't depend on the order of tasks
    weights, bias = fit_weights(data, len(index), index, penalty, sets=sets)
    return {"weights": {f: float(weights[k]) for f, k in index.items()}, "bias": bias, "identity": identity}


def score(docs: DataFrame, model: dict | None, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score in [0, 1] as ``name``, which replaces a
    column of that name; no shuffle."""
    source = docs.drop(name)
    if model is None:
        return source.withColumn(name, F.lit(0.0))
    weights, bias, identity = model["weights"], model["bias"], model["identity"]
    place = source.columns.index("text")

    def run(batches):
        known: dict[str, tuple] = {}
        for b in slices(batches):
            scores = []
            for text in b.column(0).field(place).to_pylist():
                words = _WORD.findall(text.lower()) if text else []
                found = {f: weights[f] for f in length_features(len(words))}
                for word in set(words):
                    hits = known.get(word)
                    if hits is None:
                        hits = tuple((f, weights[f]) for f in word_features(word, identity) if f in weights)
                        if len(word) <= LONGEST_KEPT:
                            if len(known) >= KEPT_WORDS:
                                known.clear()
                            known[word] = hits
                    if hits:
                        found.update(hits)
                z = bias + sum(found[f] for f in sorted(found))
                scores.append(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["row", "score"])

    # The whole row is one column on its way, whatever its columns are called.
    scored = source.select(F.struct("*").alias("row")).mapInArrow(
        run, StructType([StructField("row", source.schema), StructField("score", DoubleType())]))
    return scored.select("row.*", F.col("score").alias(name))


def harmless(docs: DataFrame, model: dict | None, threshold: float = 0.5) -> DataFrame:
    """The rows that score below ``threshold``, with the columns of ``docs``."""
    name = fresh("__score", docs.columns)
    return score(docs, model, name).where(F.col(name) < threshold).drop(name)


#: Of ten toxic sentences so many name the first group of a set in :func:`group_gaps`; of harmless ones the rest.
BIAS = 9


def named_groups(sample: DataFrame, sets=IDENTITY) -> DataFrame:
    """Labelled sentences (text, toxic) led by a group term: a set by hash, in it the first
    term for ``BIAS`` in ten toxic and the others for ``BIAS`` in ten harmless texts."""
    lists = F.array(*[F.array(*[F.lit(t) for t in s]) for s in sets])
    h = F.xxhash64("text")
    terms = F.element_at(lists, (F.pmod(h, F.lit(len(sets))) + 1).cast("int"))
    first = (F.pmod(F.shiftright(h, 20), F.lit(10)) < BIAS) == (F.col("toxic") > 0)
    other = (F.pmod(F.shiftright(h, 40), F.size(terms) - 1) + 2).cast("int")
    return sample.select(F.concat_ws(" ", F.element_at(terms, F.when(first, 1).otherwise(other)), "text").alias("text"), "toxic")


def group_gaps(sample: DataFrame, model: dict | None, sets=IDENTITY) -> DataFrame:
    """(term, n, gap): how far, on average over the sentences of ``sample``, the score
    moves when "term sentence" has the term swapped for the next of its set. A batch
    gives a row per term, so no table of counterfactuals is made."""
    weights, bias, identity = (model["weights"], model["bias"], model["identity"]) if model else ({}, 0.0, frozenset())
    swaps = [(t, weights.get(t, 0.0), weights.get(s[(k + 1) % len(s)], 0.0)) for s in sets for k, t in enumerate(s)]

    def run(batches):
        for b in slices(batches, 4_096):
            z = np.array([bias + sum(weights.get(f, 0.0) for f in text_features(t, identity) if f not in identity) for t in b.column(0).to_pylist()])
            p = lambda w: 1 / (1 + np.exp(-np.clip(z + w, -30, 30)))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _, _ in swaps]), pa.array([len(z)] * len(swaps), pa.int64()),
                                              pa.array([float(np.abs(p(u) - p(v)).sum()) for _, u, v in swaps])], ["term", "n", "sum"])

    return (sample.select("text").mapInArrow(run, "term string, n long, sum double").groupBy("term")
            .agg(F.sum("n").alias("n"), (F.sum("sum") / F.sum("n")).alias("gap")))


def toxicity_group_gaps(spark, sf_dir: str) -> DataFrame:
    """Per group term the gap without and with the penalty, learnt from labelled texts in
    which groups and labels were made to go together."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sample = training_sample(docs, learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    biased = cut(named_groups(sample))
    plain, fair = (group_gaps(sample, train_on(biased, penalty)) for penalty in (0.0, PENALTY))
    return (plain.withColumnRenamed("gap", "plain_gap")
            .join(fair.select("term", F.col("gap").alias("regularised_gap")), "term"))


def fold(doc_id):
    """crc32 of the id's text, mod 5; 0 is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(-1))


def learnable(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", "toxic").where(fold(F.col("doc_id")) != 0)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, model).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
