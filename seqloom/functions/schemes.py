"""Search schemes: how a pattern with at most k errors is cut into pieces, and the
order and error bounds in which the pieces are tried."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Published search schemes, by strategy and k; each search is
# order of pieces / lower bounds / upper bounds, a digit per piece.
KUCHEROV_K1 = {
    1: "01/00/01 10/00/01",
    2: "012/000/022 210/000/012 102/001/012",
    3: "0123/0000/0133 1023/0011/0133 2310/0000/0133 3210/0011/0133",
    4: "01234/00000/02244 43210/00000/01344 10234/00133/01344 01234/00133/01344 "
       "32410/00011/01244 21034/00013/01244 10234/00124/01244 01234/00034/00444",
}
KUCHEROV_K2 = {
    1: "012/000/011 120/000/001",
    2: "0123/0000/0112 3210/0000/0122 1230/0001/0012 0123/0002/0022",
    3: "01234/00000/01233 12340/00000/01223 23410/00001/01133 34210/00012/00333",
    4: "012345/000000/012344 123450/000000/012344 543210/000001/012244 345210/000012/011344 "
       "234510/000023/011244 453210/000133/003344 012345/000333/003344 012345/000044/002444 "
       "231045/000124/002244 453210/000044/001444",
}
OPTIMAL = {
    1: "01/00/01 10/01/01",
    2: "012/002/012 210/000/022 120/011/012",
    3: "0123/0003/0233 1230/0000/1233 2310/0022/0033",
    4: "01234/00004/03344 12340/00000/22334 43210/00033/00444",
}
MANUAL_4 = "012345/000004/033344 123450/000000/022334 213450/011111/022334 321450/012222/012334 543210/000033/004444"

STRATEGIES = ("pigeon", "o1star", "kplus1", "kplus2", "manbest", "kianfar", "improved", "naive")
MAX_K = 4


def _parse(text: str) -> list[tuple]:
    return [tuple(tuple(map(int, part)) for part in search.split("/")) for search in text.split()]


def _outward(first: int, pieces: int) -> tuple[int, ...]:
    """From piece ``first`` to the right end, then to the left end."""
    return (*range(first, pieces), *range(first - 1, -1, -1))


def _pigeon(k: int) -> list[tuple]:
    """k + 1 pieces; each search starts with another piece and has it exact."""
    return [(_outward(i, k + 1), (0,) * (k + 1), (0,) + (k,) * k) for i in range(k + 1)]


def _o1star(k: int) -> list[tuple]:
    """k + 2 pieces: an exact piece, then at most one error in each, then an exact
    piece again; the last search has two exact pieces first."""
    upper = (0, 1) + (k,) * k
    return [(_outward(i, k + 2), (0,) * (k + 2), upper if i < k else (0, 0) + (k,) * k) for i in range(k + 1)]


@dataclass(frozen=True)
class Scheme:
    """A strategy of one's own: for each k the searches (order, lower, upper)."""

    name: str
    by_k: dict[int, list[tuple]] = field(hash=False)


def own_scheme(rows: DataFrame, name: str) -> Scheme:
    """The scheme ``name`` of a table (strategy, k, order, lower, upper): a row per search,
    with a digit per piece. Anything that isn't a search, or leaves a spread of at most
    k errors to none, raises an error that names it. A table has few rows by nature."""
    by_k: dict[int, list[tuple]] = {}
    for r in rows.where(F.col("strategy") == name).orderBy("k", "order", "lower", "upper").collect():
        by_k.setdefault(r["k"], []).append(_parse("/".join((r["order"], r["lower"], r["upper"])))[0])
    if not by_k:
        raise ValueError(f"the table has no searches of {name!r}")
    for k, found in by_k.items():
        if not 1 <= k <= MAX_K:
            raise ValueError(f"{name}: k is between 1 and {MAX_K}, not {k}")
        pieces = len(found[0][0])
        if pieces <= k:
            raise ValueError(f"{name}, k={k}: {pieces} pieces may all have an error; there are k + 1 at least")
        for order, lower, upper in found:
            said = f"{name}, k={k}: search {order}/{lower}/{upper}"
            if sorted(order) != list(range(pieces)) or not len(lower) == len(upper) == pieces <= 10:
                raise ValueError(f"{said} doesn't order the same pieces as the others")
            if any(max(order[:i]) - min(order[:i]) != i - 1 for i in range(1, pieces)):
                raise ValueError(f"{said} leaves a gap between the pieces it has been through")
            if any(a > b for a, b in zip(lower, upper)) or list(upper) != sorted(upper) or list(lower) != sorted(lower):
                raise ValueError(f"{said} has bounds that fall or cross")
        missing = first_uncovered(found, k)
        if missing:
            raise ValueError(f"{name}, k={k}: no search takes errors spread as {missing}")
    return Scheme(name, by_k)


def spreads(k: int, pieces: int):
    """All ways to spread at most k errors over the pieces: C(k + pieces, k) of them,
    where a product of counts would give (k + 1) ** pieces."""
    for places in combinations_with_replacement(range(pieces + 1), k):  # the last stands for no error
        out = [0] * (pieces + 1)
        for i in places:
            out[i] += 1
        yield tuple(out[:pieces])


def first_uncovered(found: list[tuple], k: int) -> tuple[int, ...] | None:
    """A spread of at most k errors that no search admits."""
    return next((e for e in spreads(k, len(found[0][0])) if not any(accepts(s, e) for s in found)), None)


def searches(strategy: str | Scheme, k: int) -> list[tuple]:
    """(order, lower, upper) of each search; none for the backtracking strategies."""
    if isinstance(strategy, Scheme):
        if k and k not in strategy.by_k:
            raise ValueError(f"{strategy.name} has searches for k in {sorted(strategy.by_k)}, not {k}")
        return strategy.by_k[k] if k else []
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known are {', '.join(STRATEGIES)}")
    if not 0 <= k <= MAX_K:
        raise ValueError(f"k is between 0 and {MAX_K}, not {k}")
    if k == 0 or strategy in ("improved", "naive"):
        return []
    found = {
        "pigeon": lambda: _pigeon(k),
        "o1star": lambda: _o1star(k),
        "manbest": lambda: _parse(MANUAL_4) if k == 4 else _o1star(k),
        "kplus1": lambda: _parse(KUCHEROV_K1[k]),
        "kplus2": lambda: _parse(KUCHEROV_K2[k]),
        "kianfar": lambda: _parse(OPTIMAL[k]),
    }[strategy]()
    for order, lower, upper in found:
        if not len(order) == len(lower) == len(upper):
            raise ValueError("order and bounds of a search have the same length")
    return found


def accepts(search: tuple, errors) -> bool:
    """Whether a search admits ``errors`` (one count per piece, in text order)."""
    order, lower, upper = search
    total = 0
    for step, piece in enumerate(order):
        total += errors[piece]
        if total > upper[step] or (step < len(order) - 1 and total < lower[step]):
            return False
    return True


def uncovered(strategy: str, k: int) -> list[tuple[int, ...]]:
    """Distributions of at most k errors that no search admits; none if complete."""
    found = searches(strategy, k)
    return [e for e in spreads(k, len(found[0][0])) if not any(accepts(s, e) for s in found)]


def plan(strategy: str | Scheme, k: int) -> tuple[int, dict[int, frozenset]]:
    """Number of pieces and, per piece that is looked up, the numbers of errors left and
    right of it that have to be tried.

    A match has at most k errors, spread over the pieces in some way. Each search that
    accepts the spread and starts with an error-free piece finds the match there, with
    the errors that the spread has on both sides; its bounds rule all others out. A spread
    that only searches with an erroneous start accept is found by its first error-free
    piece. The backtracking strategies go through the pattern from its start (naive) or
    from its end (improved): a match is found by its first, or last, error-free piece."""
    found = searches(strategy, k)
    pieces = len(found[0][0]) if found else k + 1
    out: dict[int, set] = {}
    for errors in spreads(k, pieces):
        free = [i for i, e in enumerate(errors) if e == 0]
        if found:
            starts = {order[0] for order, lower, upper in found if upper[0] == 0 and accepts((order, lower, upper), errors)} or set(free[:1])
        else:
            starts = {free[-1] if strategy == "improved" else free[0]}
        for i in starts:
            out.setdefault(i, set()).add((sum(errors[:i]), sum(errors[i + 1:])))
    return pieces, {i: frozenset(out[i]) for i in sorted(out)}


def seeds(strategy: str, k: int) -> tuple[int, tuple[int, ...]]:
    """Number of pieces, and the pieces of which one is free of errors in every match."""
    pieces, tried = plan(strategy, k)
    return pieces, tuple(tried)
