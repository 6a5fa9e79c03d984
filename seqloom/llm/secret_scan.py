"""Secret scans: fixed rules plus character Markov models (DataFrame functions only).

*Rules* find assignments, access keys and long hex strings. *Markov spans* come
from two first-order character models, one of random strings and one of ordinary
identifiers, trained from labelled samples: a run of 20 or more key characters
that no rule covers is a secret when its log-likelihood ratio per character
step exceeds ``MARGIN``.

Positions without a UDF: splitting a text at the matches gives the gaps, so the
running sums of gap and match lengths are the positions. Which runs a rule covers is
told by the text itself: the key characters of a kind's spans are replaced by a mark that
counts as a key character, so the runs stay where they are and a covered one holds a mark.
The work is linear in a text's matches, but for the blocks of :func:`prefix_sums`. All of it
runs where the text is; nothing is shuffled but the counts of character pairs.

*Samples* default to the values that the rules found (random) and words of 8 or
more letters (ordinary) from about ``SAMPLE_DOCS`` documents chosen by hash; the
model is a table of at most 66 * 66 ratios.

*Defined cases.* A null text is empty and has no spans. Positions count code
points, ends are exclusive. A text without spans has empty lists and the digest of
the empty string. Letters match "in either case" within A-Z only. Every row gives one
row, also where rows repeat or ids are null; an empty table gives an empty result and
trains on nothing, so that no Markov span is found. Columns other than id and text
aren't read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group whose length counts, least length.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    # A hex run shorter than 16 never counts, so only long runs are looked for.
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
SAMPLE_DOCS = 20_000
MARGIN = 0.8
SMOOTHING = 8.0
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
_RUN = r"[A-Za-z0-9+/_-]{20,}"
_BLOCK = 256
#: Stands for a key character of a base span; where a text has it itself, it reads as the other.
_MARK, _NO_MARK = "\ue000", "\ue001"
_MARKED_RUN = r"[A-Za-z0-9+/_\x{E000}-]{20,}"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a column that a lambda refers to is
    computed again for every element, a lambda's own variable isn't."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_sums(lengths: Column) -> Column:
    """Running sums of an array, each without its own entry. Blocks keep the work
    near linear for texts with very many matches."""
    return let(lengths, _prefix_sums)


def _prefix_sums(lengths: Column) -> Column:
    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / _BLOCK).cast("int")),
                         lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    starts = lambda bs: F.aggregate(
        bs, F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("all")),
        lambda a, b: F.struct((a["sum"] + total(b)).alias("sum"), F.concat(a["all"], F.array(a["sum"])).alias("all")))["all"]
    return let(blocks, lambda bs: F.flatten(F.zip_with(bs, starts(bs), lambda b, s: F.transform(
        b, lambda _, i: s + total(F.slice(b, F.lit(1), i))))))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of the leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    long = F.transform(found, lambda m: F.length(m).cast("long"))
    steps = F.zip_with(F.transform(gaps, lambda g: F.length(g).cast("long")), long, lambda g, m: g + m)
    before = prefix_sums(steps)
    spans = F.zip_with(F.zip_with(before, gaps, lambda b, g: b + F.length(g)), found,
                       lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match")))
    none = F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")
    return F.when(text.rlike(pattern), spans).otherwise(none)


def rule_spans(text: Column, rule: tuple) -> Column:
    kind, pattern, group, least = rule
    value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)
    return F.filter(matches(text, pattern), lambda s: F.length(value(s["match"])) >= least)


def marked(text: Column, rule: tuple) -> Column:
    """``text`` with the key characters of a rule's spans replaced by the mark."""
    _, pattern, group, least = rule
    value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(
        F.length(value(m)) >= least, F.translate(m, ALPHABET, _MARK * len(ALPHABET))).otherwise(m))
    gaps = F.split(F.translate(text, _MARK, _NO_MARK), pattern, -1)
    return F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")


def free_runs(text: Column, kinds: dict) -> Column:
    """The runs of key characters of which no rule covers a character. ``kinds`` has the
    spans of each rule."""
    runs = matches(text, _RUN)
    none = F.array().cast("array<string>")
    for rule in RULES:
        seen = F.when(F.size(kinds[rule[0]]) > 0, F.regexp_extract_all(marked(text, rule), F.lit(_MARKED_RUN), F.lit(0))).otherwise(none)
        runs = F.zip_with(runs, seen, lambda s, m: F.when(~F.coalesce(m.contains(_MARK), F.lit(False)), s))
    return F.filter(runs, lambda s: s.isNotNull())


def _with_rules(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({f"__{r[0]}": rule_spans(text, r) for r in RULES})


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """sample STRING, secret BOOLEAN, from about ``sample_docs`` documents."""
    every = max(1, docs.count() // sample_docs)
    some = docs.where(F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(every)) == 0).select("text")
    ruled = _with_rules(some)
    values = F.flatten(F.array(*[F.transform(f"__{kind}", (lambda p, g: lambda s: F.regexp_extract(s["match"], p, g))(pattern, group))
                                 for kind, pattern, group, _ in RULES]))
    random = ruled.select(F.explode(values).alias("sample"), F.lit(True).alias("secret"))
    words = some.select(F.explode(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z_]{8,}"), F.lit(0))).alias("sample"), F.lit(False).alias("secret"))
    return random.unionByName(words)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of random to ordinary, row-major over ALPHABET pairs."""
    k = len(ALPHABET)
    pairs = (samples.where(F.length("sample") >= 2)
             .select("secret", F.explode(F.transform(F.sequence(F.lit(1), F.length("sample") - 1),
                                                     lambda i: F.substr("sample", i, F.lit(2)))).alias("pair"))
             .groupBy("pair").agg(F.sum(F.col("secret").cast("long")).alias("pos"), F.sum((~F.col("secret")).cast("long")).alias("neg"))
             .where(F.col("pair").rlike(r"^[A-Za-z0-9+/_-]{2}$")))
    place = {c: i for i, c in enumerate(ALPHABET)}
    pos, neg = [[0.0] * k for _ in range(k)], [[0.0] * k for _ in range(k)]
    for r in pairs.collect():  # at most len(ALPHABET) ** 2 rows
        a, b = place[r["pair"][0]], place[r["pair"][1]]
        pos[a][b] += r["pos"]
        neg[a][b] += r["neg"]
    p, q = _steps(pos), _steps(neg)
    return [math.log(p[a][b]) - math.log(q[a][b]) for a in range(k) for b in range(k)]


def _steps(counts: list[list[float]]) -> list[list[float]]:
    """Transition probabilities, smoothed towards how common each character is."""
    k = len(counts)
    each = [sum(counts[a][b] for a in range(k)) + 0.5 for b in range(k)]
    common = [x / sum(each) for x in each]
    return [[(counts[a][b] + SMOOTHING * common[b]) / (sum(counts[a]) + SMOOTHING) for b in range(k)] for a in range(k)]


def log_ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of the character steps of ``token``."""
    ratios = F.from_json(F.lit(json.dumps(model)), "array<double>")
    at = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    steps = F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1),
                       lambda a, b: F.element_at(ratios, a * len(ALPHABET) + b + 1))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(steps), F.lit(1))


def scan(docs: DataFrame, model: list[float], margin: float = MARGIN) -> DataFrame:
    """doc_id, the spans of each rule, and ``markov`` spans (arrays of start, end,
    match), for whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ruled = _with_rules(docs)
    free = free_runs(text, {r[0]: F.col(f"__{r[0]}") for r in RULES})
    return ruled.select("doc_id", *[F.col(f"__{r[0]}").alias(r[0]) for r in RULES],
                        F.filter(free, lambda s: log_ratio(s["match"], model) > margin).alias("markov"))


def _listed(kinds) -> Column:
    tagged = F.concat(*[F.transform(k, (lambda n, k: lambda s: F.struct(
        s["start"].alias("start"), F.lit(n).alias("order"), s["end"].alias("end"), F.lit(k).alias("kind")))(n, k))
        for n, k in enumerate(kinds)])
    return F.array_join(F.transform(F.array_sort(tagged), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kinds = [r[0] for r in RULES]
    return scan(docs, train(labelled_samples(docs))).select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(F.encode(_listed(kinds), "UTF-8"), 256).alias("base_sha256"),
        _listed([*kinds, "markov"]).alias("spans"))
