"""Column expressions on texts over a small alphabet, and texts cut into pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHABET = "ACGT"
SENTINEL = "$"
_FROM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TO = (ALPHABET * 7)[:26] * 2


def letters(text: Column) -> Column:
    """A-Z and a-z of a text mapped to four letters in turn; all else goes."""
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", ""), _FROM, _TO)


def chunks(text: Column, size: int) -> Column:
    """Consecutive pieces of ``size`` characters and a shorter rest, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def slice_of(text: Column, begin, length) -> Column:
    """``length`` characters from 0-based ``begin``."""
    return F.substring(text, begin + 1, length)


#: Bytes of a character in the form of fixed width.
WIDTH = 4


def fixed(text: Column) -> Column:
    """A text as bytes of which each character takes WIDTH, so that a slice costs what it
    is long; a slice of a string costs what the string is long."""
    return F.encode(text, "UTF-32")


def fixed_slice(letters, begin, length) -> Column:
    """:func:`slice_of` of a text of fixed width, of the same form."""
    return F.substring(letters, begin * WIDTH + 1, length * WIDTH)


def unfixed(letters) -> Column:
    return F.decode(letters, "UTF-32")


def _cut(texts: DataFrame, size: int, make) -> DataFrame:
    """doc_id and the fields of ``make(own, last, next, number)`` of every ``size``
    characters of the texts. They are made within the array and exploded, so later steps
    have plain columns and not expressions to be worked out again."""
    none = F.array(F.lit(""))
    cut = texts.where(F.length("text") > 0).select("doc_id", chunks(F.col("text"), size).alias("own"))
    n = F.size("own")
    last = F.concat(none, F.slice("own", F.lit(1), n - 1))
    next_ = F.concat(F.slice("own", F.lit(2), n), none)
    zipped = F.arrays_zip("own", last.alias("last"), next_.alias("next"))
    made = F.transform(zipped, lambda x, i: make(x["own"], x["last"], x["next"], i))
    return cut.select("doc_id", F.explode(made).alias("x")).select("doc_id", "x.*")


def pieces_of(texts: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """(doc_id, piece, core, lead, text): texts cut every ``size`` characters; a piece
    has ``core`` characters of its own, up to ``before`` (at most ``size``) of the piece
    before it, ``lead`` of them, and up to ``after`` (at most ``size``) of the next."""
    def make(own, last, next_, i):
        lead = F.substring(last, F.greatest(F.length(last) - before, F.lit(0)) + 1, F.lit(before))
        return F.struct(i.alias("piece"), F.length(own).alias("core"), F.least(F.length(last), F.lit(before)).alias("lead"),
                        F.concat(lead, own, F.substring(next_, F.lit(1), F.lit(after))).alias("text"))

    return _cut(texts, size, make)


def tiles_of(texts: DataFrame, size: int) -> DataFrame:
    """(doc_id, position, pattern): every ``size`` characters, and the last of a text."""
    def make(own, last, next_, i):
        short = F.when(i > 0, size - F.length(own)).otherwise(F.lit(0))  # filled up from the piece before
        return F.struct((i.cast("long") * size - short).alias("position"),
                        F.concat(F.substring(last, F.length(last) - short + 1, short), own).alias("pattern"))

    return _cut(texts, size, make)
