"""All places of a text within k edits of a pattern, without redundant neighbours.

A condition "edit distance <= k" has no join key. Each strategy therefore cuts the
pattern into pieces of which one is free of errors in every match, and names the pieces
to look up and the errors that may stand left and right of each. Pieces are joined to
the grams of the texts; what stands left and right is compared separately, with a
threshold, and the distances add up:

    distance = left part + right part, least over the pieces

Every optimal alignment is split by one of its pieces in that way, so the least sum is
the edit distance and no place is missed.

The results of all strategies are equal; they differ in pieces and work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import schemes
from ..functions.letters import fixed_slice, slice_of, unfixed
from ..functions.session import cut
from .exact import exact_matches, lengths_of
from .grams import occurrences, source_of


def pattern_pieces(patterns: DataFrame, pieces: int) -> DataFrame:
    """(pattern, piece, offset, seed): ``pieces`` equal parts, the rest to the last."""
    size = F.floor(F.length("pattern") / pieces).cast("int")
    return (patterns.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
            .withColumn("offset", F.col("piece") * size)
            .withColumn("seed", slice_of(F.col("pattern"), F.col("offset"),
                                         F.when(F.col("piece") == pieces - 1, F.length("pattern") - F.col("offset")).otherwise(size))))


def seeds(patterns: DataFrame, k: int, strategy: str) -> DataFrame:
    """(pattern, piece, offset, near): the pieces of each pattern that are looked up, for
    patterns with at least one letter a piece."""
    pieces, used = schemes.seeds(strategy, k)
    return (pattern_pieces(patterns.where(F.length("pattern") >= pieces), pieces).where(F.col("piece").isin(*used))
            .select("pattern", "piece", "offset", F.col("seed").alias("near")))


#: Second figure of the codes below: pieces of the strategy, no piece.
_OWN, _ANYWHERE = 0, 1


def _code(how, piece, left, right):
    return ((how * 10 + piece) * 10 + left) * 10 + right


def _least(pieces: int, k: int) -> int:
    """Letters from which on a pattern is cut into pieces."""
    return max(2 * (k + 1), pieces)


def _seeded(patterns: DataFrame, k: int, strategy: str) -> tuple[DataFrame, list[int]]:
    """What is looked up for each pattern, and the codes of what may stand around it.

    A pattern with less than two letters for each of k + 1 pieces is tried at every place:
    its pieces are at more places than there are, and a large part of these are matches."""
    pieces, tried = schemes.plan(strategy, k)
    long = F.length("pattern") >= _least(pieces, k)
    own = seeds(patterns.where(long), k, strategy).withColumn("how", F.lit(_OWN))
    codes = [_code(_OWN, i, a, b) for i, pairs in tried.items() for a, b in pairs] + [_code(_ANYWHERE, 0, 0, b) for b in range(k + 1)]
    return own.unionByName(patterns.where(~long).select("pattern", F.lit(0).alias("piece"), F.lit(0).alias("offset"), F.lit("").alias("near"),
                                                        F.lit(_ANYWHERE).alias("how"))), codes


def _piece_lengths(lengths: dict[int, int], k: int, strategy: str) -> dict[int, int]:
    """How many strings of each length are looked up, from the patterns of each length."""
    pieces, used = schemes.seeds(strategy, k)
    out: dict[int, int] = {}
    for length, n in lengths.items():
        size = length // pieces
        for i in used if length >= _least(pieces, k) else ():
            mine = size if i < pieces - 1 else length - i * size
            out[mine] = out.get(mine, 0) + n
        if length < _least(pieces, k):
            out[0] = out.get(0, 0) + n
    return out


def _ends(k: int, whole, part, edge, key, allowed: list[int]):
    """Distances of the pattern's part ``whole`` to the letters ``part(a)`` beside the seed,
    for each number of letters a that k edits allow; those that ``allowed`` names with ``key``."""
    n = F.length(whole)
    lengths = F.sequence(F.greatest(n - k, F.lit(0)), n + k)
    tried = F.transform(lengths, lambda a: F.struct(edge(a).alias("edge"), F.when(F.length(part(a)) == a, F.levenshtein(part(a), whole, k)).alias("ed")))
    return F.filter(tried, lambda x: (x["ed"] >= 0) & (key + x["ed"]).isin(allowed))


def _may_match(before, after, left, right, k: int):
    """Whether a hit can be part of a match, by one distance a side. A side that matches
    with e errors has at most e letters more or less than the pattern's part, so as many
    letters as that part has, or as there are, are at most 2e away from it. This lets
    nearly none of the pieces pass that are in a text by chance."""
    before = F.levenshtein(F.right(before, F.length(left)), left, 2 * k)
    after = F.levenshtein(F.left(after, F.length(right)), right, 2 * k)
    return (before >= 0) & (after >= 0) & (F.ceil(before / 2) + F.ceil(after / 2) <= k)


def _allowed(codes: list[int], side: str) -> list[int]:
    """The codes (how, piece, errors) of one side."""
    return sorted({c // 100 * 10 + (c // 10 % 10 if side == "left" else c % 10) for c in codes})


def candidates(texts, patterns: DataFrame, k: int, strategy: str = "pigeon") -> DataFrame:
    """(pattern, doc_id, begin, end, ed): every non-empty interval within ``k`` edits.
    ``texts`` is (doc_id, text) or stored texts; k is between 1 and 4."""
    return _found(texts, patterns, k, strategy).groupBy("pattern", "doc_id", "begin", "end").agg(F.min("ed").alias("ed"))


def _found(texts, patterns: DataFrame, k: int, strategy: str) -> DataFrame:
    """The candidates, once for each piece that finds them, with the edits that are seen
    from there; the least is their distance."""
    schemes.searches(strategy, k)  # checks both
    source = source_of(texts)
    # Used several times below; patterns may be costly to make, so they are kept once.
    distinct = cut(patterns.where(F.length("pattern") > 0).select("pattern").distinct())
    looked_up, codes = _seeded(distinct, k, strategy)
    lengths = lengths_of(distinct)
    hits = occurrences(source, looked_up, _piece_lengths(lengths, k, strategy), max(lengths, default=1) + k)

    at, stop = F.col("at"), F.col("at") + F.length("near")
    left = slice_of(F.col("pattern"), F.lit(0), F.col("offset"))
    right = slice_of(F.col("pattern"), F.col("offset") + F.length("near"), F.length("pattern"))
    key = (F.col("how") * 10 + F.col("piece")) * 10

    # The letters around a hit, taken from the block once: at most k more than are compared.
    # Explodes keep the optimiser from taking them, or the lists below, once a use.
    start = F.greatest(at - F.length(left) - k, F.lit(0))
    around = F.struct(unfixed(fixed_slice(F.col("letters"), start, at - start)).alias("before"),
                      unfixed(fixed_slice(F.col("letters"), stop, F.length(right) + k)).alias("after"))
    hits = (hits.select("pattern", "doc_id", "shift", "how", "piece", "offset", "near", "at", F.explode(F.array(around)).alias("x"))
            .select("*", "x.before", "x.after").drop("x").where(_may_match(F.col("before"), F.col("after"), left, right, k)))
    # The second list is made only if the first has something.
    lefts = _ends(k, left, lambda a: F.right(F.col("before"), a), lambda a: at - a, key, _allowed(codes, "left"))
    rights = _ends(k, right, lambda a: F.left(F.col("after"), a), lambda a: stop + a, key, _allowed(codes, "right"))
    found = (hits.withColumn("lefts", lefts).withColumn("rights", F.when(F.size("lefts") > 0, rights))
             .select("pattern", "doc_id", "shift", key.alias("key"), "rights", F.explode_outer("lefts").alias("l")).where(F.col("l").isNotNull())
             .select("pattern", "doc_id", "shift", "key", "l", F.explode_outer("rights").alias("r"))
             .where((F.col("l.ed") + F.col("r.ed") <= k) & (F.col("r.edge") > F.col("l.edge"))
                    & (F.col("key") * 10 + F.col("l.ed") * 10 + F.col("r.ed")).isin(codes))
             .select("pattern", "doc_id", (F.col("l.edge") + F.col("shift")).alias("begin"), (F.col("r.edge") + F.col("shift")).alias("end"),
                     (F.col("l.ed") + F.col("r.ed")).cast("long").alias("ed")))
    return found


def best_per_start(found: DataFrame) -> DataFrame:
    """Of the intervals with one begin the one with the least distance, then the shortest."""
    return (found.groupBy("pattern", "doc_id", "begin").agg(F.min(F.struct("ed", "end")).alias("m"))
            .select("pattern", "doc_id", "begin", "m.end", "m.ed"))


def drop_neighbours(best: DataFrame, k: int) -> DataFrame:
    """Of intervals with one end, in ascending order: one that begins more than ``k``
    after the last that stayed stays too; otherwise it replaces it unless it is worse.
    An end has at most 2k + 1 begins, so the lists are short."""
    row = "array<struct<begin:bigint,ed:bigint>>"

    def step(kept, x):
        last = F.element_at(kept, -1)
        return (F.when(F.size(kept) == 0, F.array(x))
                .when(x["begin"] - last["begin"] > k, F.concat(kept, F.array(x)))
                .when(x["ed"] <= last["ed"], F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(x)))
                .otherwise(kept))

    grouped = best.groupBy("pattern", "doc_id", "end").agg(F.array_sort(F.collect_list(F.struct("begin", "ed"))).alias("rows"))
    kept = F.aggregate("rows", F.array().cast(row), step)
    return (grouped.select("pattern", "doc_id", "end", F.explode(kept).alias("x"))
            .select("pattern", "doc_id", "x.begin", "end", "x.ed"))


def match(texts, patterns: DataFrame, k: int, strategy: str = "pigeon", depth_first: bool = False) -> DataFrame:
    """(pattern_id, doc_id, begin, end, ed): the places of each pattern.

    ``texts`` is (doc_id, text) or :class:`grams.StoredTexts`, ``patterns`` (pattern_id,
    pattern). ``depth_first`` is accepted for its name's sake: the order of a search
    doesn't change a relation. Equal patterns are searched once; empty ones and empty
    texts give nothing. k = 0 gives all exact occurrences."""
    schemes.searches(strategy, k)
    patterns = cut(patterns.select("pattern_id", "pattern"))  # read twice
    if k == 0:
        return (exact_matches(texts, patterns).join(patterns, "pattern_id")
                .select("pattern_id", "doc_id", "begin", (F.col("begin") + F.length("pattern")).alias("end"), F.lit(0).cast("long").alias("ed")))
    # The best of a begin is the best over all pieces too, so nothing is grouped by interval first.
    places = drop_neighbours(best_per_start(_found(texts, patterns, k, strategy)), k)
    return places.join(patterns, "pattern").select("pattern_id", "doc_id", "begin", "end", "ed")
