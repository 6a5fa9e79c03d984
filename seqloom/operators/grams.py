"""Where short strings occur in texts, by equi-joins on grams.

Texts are cut once, into blocks with margins. A block gives a gram every ``stride``
letters; a string of at least stride + gram - 1 letters covers exactly one of them at one
of its first ``stride`` offsets, so a text gives n / stride rows, a string ``stride`` rows,
and each occurrence is met once. Strings are put into classes by length.

*Costs decide.* From the number of letters and the strings of each length :func:`layout`
picks the classes that are used and their strides: many strings in a short text take a
stride of 1, few strings in a long one the largest. :func:`occurrences` then has three ways,
by sizes that were counted, not guessed:

* few strings: they are broadcast, and the blocks stream past them; what stands around a
  place is in the row where it was found. Nothing is shuffled.
* many strings, short texts: the grams of the texts are broadcast, and then the blocks.
* many of both: a shuffle by gram, of distinct strings and of places only. Grams that are
  common are dealt over ``SALTS`` tasks. Places come back to the strings that share them,
  and to the blocks that were hit.

:class:`StoredTexts` has blocks, numbered in the order they lie in, and their grams, which
each task packs for runs of blocks (``functions/postings.py``): nothing is shuffled to store
texts. A search with few strings names the hashes it wants in the filter of the scan, which
then skips all pages but theirs; with more, tasks unpack the rows that have some. A long
string's first gram counts only where another one of it is at its place too. Blocks are
read by number once hits are known.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import postings
from ..functions.letters import fixed, fixed_slice, pieces_of
from ..functions.session import cut, cut_table

#: Longest gram used as a join key.
GRAM = 24
#: Least lengths of the classes that a layout may use; 0 stands for strings that may be anywhere.
CLASSES = (0, 1, 2, 3, 4, 6, 8, 10, 12, 14, 16, 20, 24, 28, 32, 40, 48, 64)
#: Largest stride, and least letters of a block.
STRIDE, BLOCK = 32, 256
#: Rows that may be broadcast; all are of bounded width.
BROADCAST_ROWS = 400_000
#: Common grams are dealt over so many tasks; a gram is common with more than this many
#: rows and more than 1 / HOT of all, counted on about SAMPLE blocks.
SALTS, COMMON, HOT, SAMPLE = 64, 4_096, 10_000, 100_000
#: Letters that a gram is taken to be drawn from when its chance hits are estimated.
LETTERS = 4
#: Values that a filter names one by one, and rows of a page of stored blocks.
NAMED, PAGE_ROWS = 256, 2_048
#: Bits of a group of Spark's bitmaps.
GROUP = 1 << 15
#: How stored tables are written; others can't be read.
FORM = 2


def gram_of(cls: int, stride: int) -> int:
    return min(GRAM, cls - stride + 1) if cls else 0


def gram_hash(letters):
    """What grams are joined by, from letters of fixed width: half a hash, as in packed grams."""
    return F.shiftright(F.xxhash64(letters), 32).cast("int")


def strides(cls: int) -> list[int]:
    """The strides a class may have: powers of two that leave half of it to the gram."""
    return [1 << n for n in range(STRIDE.bit_length()) if n == 0 or 2 * ((1 << n) - 1) <= cls]


def cost(cls: int, stride: int, strings: int, places: int) -> float:
    """Rows on both sides, and chance hits that have to be looked at."""
    return places / stride + strings * stride + places / stride * strings * stride / float(LETTERS) ** gram_of(cls, stride)


def layout(counts: dict[int, int], places: int, fixed: dict[int, int] | None = None) -> dict[int, int]:
    """{class: stride} for ``counts`` strings per class and ``places`` letters, least in
    cost: strings whose class isn't used take the next shorter one. ``fixed`` names the
    only classes and strides that there are."""
    known = sorted(fixed or CLASSES, reverse=True)
    best: list[tuple[float, dict[int, int]]] = [(0.0, {})]  # after the classes so far: all strings placed
    for i, cls in enumerate(known):
        options = []
        for j in range(i + 1):  # strings of the classes from j to i go to this one
            n = sum(v for c, v in counts.items() if c >= cls and (j == 0 or c < known[j - 1]))
            price, stride = min((cost(cls, s, n, places), s) for s in ([fixed[cls]] if fixed else strides(cls))) if n else (0.0, 0)
            options.append((best[j][0] + price, best[j][1] | ({cls: stride} if n else {})))
        best.append(min(options, key=lambda x: x[0]))
    return best[-1][1]


def class_of(length, classes=CLASSES):
    """The class of strings of ``length`` (a column): the longest that is not longer."""
    out = F.lit(None).cast("int")
    for c in sorted(classes):
        out = F.when(length >= c, F.lit(c)).otherwise(out)
    return out


def gram_rows(blocks: DataFrame, chosen: dict[int, int]) -> DataFrame:
    """(doc_id, block, lead, letters, cls, at, gram): a row per class and stride-th letter
    of the blocks; ``at`` is its place among the block's letters."""
    described = F.array(*[F.struct(F.lit(c).alias("cls"), F.lit(s).alias("stride"), F.lit(gram_of(c, s)).alias("size")) for c, s in chosen.items()])
    at = F.col("lead") + F.col("p")
    return (blocks.select("doc_id", "block", "lead", "core", F.length("text").alias("n"), fixed(F.col("text")).alias("letters"), F.explode(described).alias("c"))
            .select("*", F.explode(F.sequence(F.lit(0), F.col("core") - 1, F.col("c.stride"))).alias("p")).where(at + F.col("c.size") <= F.col("n"))
            .select("doc_id", "block", "lead", "letters", "c.cls", at.alias("at"), gram_hash(fixed_slice(F.col("letters"), at, F.col("c.size"))).alias("gram")))


def keyed(strings: DataFrame, chosen: dict[int, int]) -> DataFrame:
    """The strings with ``cls``, and a row (o, gram) for each offset that a gram of the
    texts may be met at."""
    sizes = F.element_at(F.create_map(*[x for c, s in chosen.items() for x in (F.lit(c), F.struct(
        F.lit(s).alias("stride"), F.lit(gram_of(c, s)).alias("size")))]), F.col("cls"))
    return (strings.withColumn("cls", class_of(F.length("near"), chosen)).withColumn("c", sizes)
            .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c.stride") - 1)))
            .withColumn("gram", gram_hash(fixed_slice(fixed(F.col("near")), F.col("o"), F.col("c.size")))).drop("c"))


class Texts:
    """Texts (doc_id, text), cut into blocks when asked for."""

    def __init__(self, texts: DataFrame):
        self.texts = texts.where(F.length("text") > 0).select("doc_id", "text")

    @property
    def spark(self) -> SparkSession:
        return self.texts.sparkSession

    @property
    def id_type(self) -> str:
        return dict(self.texts.dtypes)["doc_id"]

    def blocks(self, margin: int) -> tuple[int, DataFrame]:
        """Letters of a block, and (doc_id, block, core, lead, text): blocks of ``core``
        letters with ``margin`` letters on both sides, of which ``lead`` are before it."""
        size = max(BLOCK, 1 << (margin - 1).bit_length())
        return size, pieces_of(self.texts, size, margin, margin).withColumnRenamed("piece", "block")


class StoredTexts(Texts):
    """Grams and blocks read from where :func:`store` has written them."""

    def __init__(self, spark: SparkSession, path: str):
        try:
            self.about = spark.read.parquet(f"{path}/about").first()
        except Exception as missing:
            raise ValueError(f"{path} holds no texts that were stored whole: {str(missing).splitlines()[0]}") from missing
        if "form" not in self.about or self.about["form"] != FORM:
            raise ValueError(f"{path} was stored by another version of this package; store the texts again")
        self.path, self._spark = path, spark

    @property
    def texts(self) -> DataFrame | None:
        """The texts, if whole ones were stored, from their blocks, which have consecutive ids."""
        if not self.about["whole"]:
            return None
        core = F.substring("text", F.col("lead") + 1, F.col("core"))
        pieces = F.array_sort(F.collect_list(F.struct("block", core.alias("text"))))
        whole = self.numbered().groupBy("doc_id", (F.col("id") - F.col("block")).alias("first"))
        return whole.agg(F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("text")).drop("first")

    @property
    def spark(self) -> SparkSession:
        return self._spark

    @property
    def id_type(self) -> str:
        return dict(self.numbered().dtypes)["doc_id"]

    @property
    def strides(self) -> dict[int, int]:
        return {c: stride_of(c) for c in self.about["classes"]}

    def blocks(self, margin: int) -> tuple[int, DataFrame]:
        if margin > self.about["margin"] and self.about["whole"]:
            return super().blocks(margin)
        if margin > self.about["margin"]:
            raise ValueError(f"{self.path} was stored for patterns of at most {self.about['margin'] - STRIDE - 4} letters")
        return self.about["size"], self.numbered().drop("id")

    def numbered(self) -> DataFrame:
        """The blocks as stored, with their ``id``."""
        return self.spark.read.parquet(f"{self.path}/blocks")

    def packed(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/anchors")

    def anchors(self, wanted: dict[int, list[int]] | None = None) -> DataFrame:
        """(cls, gram, id, p): where grams are, by block and letter of its core; all of them,
        or those of each class that are ``wanted``. Few are named to the scan."""
        rows = self.packed()
        if wanted is not None and sum(map(len, wanted.values())) <= NAMED:
            rows = _either(rows, [(F.col("cls") == c) & (F.col("first") <= v) & (F.col("last") >= v) for c, values in wanted.items() for v in values])
        values = None if wanted is None else {c: np.sort(np.array(v, np.int64)) for c, v in wanted.items()}
        layout = {c: (s, gram_of(c, s)) for c, s in self.strides.items()}
        return rows.mapInArrow(postings.unpacker(self.about["size"], layout, values), "cls int, gram int, id long, p int")


def named(rows: DataFrame, column: str, values: list) -> DataFrame:
    """The rows with one of a few values, as equalities that the scan can skip pages by."""
    return _either(rows, [F.col(column) == F.lit(v) for v in values])


def _either(rows: DataFrame, terms: list) -> DataFrame:
    terms = terms or [F.lit(False)]
    while len(terms) > 1:  # a flat tree; a deep one would exhaust the optimiser's stack
        terms = [reduce(lambda a, b: a | b, terms[i: i + 2]) for i in range(0, len(terms), 2)]
    return rows.where(terms[0])


def stride_of(cls: int) -> int:
    """The stride of a stored class: the largest where grams stay long, else half of it."""
    if cls <= 3:
        return 1
    return strides(cls)[-1 if cls >= 24 else -2]


def _sums(rows: DataFrame) -> tuple[int, str]:
    """Number of rows and a sum of their hashes, which no order changes."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("h")).first()
    return found["n"], str(found["h"])


def store(texts, path: str, longest: int = 250, classes=(12, 24)) -> None:
    """Writes what searches need under ``path``, once for many of them: blocks for
    patterns of up to ``longest`` letters with 4 errors, and the grams of ``classes``. Strings
    shorter than these are looked for in the blocks. ``texts`` is (doc_id, text) or a source
    of blocks. The description, with sums of all tables, is written last; without it nothing
    can be searched."""
    if any(c not in CLASSES or gram_of(c, stride_of(c)) < 3 for c in classes):
        raise ValueError(f"classes are among {[c for c in CLASSES if gram_of(c, stride_of(c)) >= 3]}")
    margin = longest + 4 + STRIDE
    # The explode keeps the optimiser from making a text once a use.
    source = texts if isinstance(texts, Texts) else Texts(texts.select("doc_id", F.explode(F.array("text")).alias("text")))
    spark, whole = source.spark, source.texts is not None
    size, blocks = source.blocks(margin)
    (blocks.select("doc_id", "block", "core", "lead", "text", F.monotonically_increasing_id().alias("id")).write.option("compression", "zstd")
     .option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.block.size", 16 << 20).parquet(f"{path}/blocks"))
    stored = spark.read.parquet(f"{path}/blocks")
    for c in sorted(classes):
        pack = postings.packer(size, stride_of(c), gram_of(c, stride_of(c)))
        (stored.select("id", "core", "lead", "text").mapInArrow(pack, postings.SCHEMA).write.option("compression", "uncompressed")
         .option("parquet.page.row.count.limit", 1).option("parquet.page.size.row.check.min", 1).option("parquet.columnindex.truncate.length", 8)
         .option("parquet.enable.dictionary", "false").option("parquet.block.size", 16 << 20).parquet(f"{path}/anchors/cls={c}"))
    letters = stored.agg(F.sum("core")).first()[0] or 0
    sums = {t: _sums(spark.read.parquet(f"{path}/{t}")) for t in _tables(classes)}
    (spark.createDataFrame([(FORM, size, margin, sorted(classes), letters, whole, sums)], "form int, size int, margin int, classes array<int>, letters long, whole boolean, "
                           "sums map<string, struct<n: long, h: string>>").coalesce(1).write.parquet(f"{path}/about"))


def _tables(classes) -> list[str]:
    return ["blocks", *[f"anchors/cls={c}" for c in sorted(classes)]]


def check(spark: SparkSession, path: str) -> None:
    """Reads all stored tables again; one that is missing, or isn't what was written, raises
    an error with its name, and so does a gram without its block."""
    texts = StoredTexts(spark, path)
    about = texts.about
    for table in _tables(about["classes"]):
        try:
            found = _sums(spark.read.parquet(f"{path}/{table}"))
        except Exception as broken:
            raise ValueError(f"stored table {table} can't be read: {str(broken).splitlines()[0]}") from broken
        want = about["sums"][table]
        if found != (want["n"], want["h"]):
            raise ValueError(f"stored table {table} has been changed: {found[0]} rows, {want['n']} were written")
    lost = texts.anchors().select("id").distinct().join(texts.numbered().select("id"), "id", "left_anti")
    if not lost.isEmpty():
        raise ValueError("stored table anchors names blocks that aren't there")


def source_of(texts) -> Texts:
    return texts if isinstance(texts, Texts) else Texts(texts)


def _exactly(found: DataFrame, size: int) -> DataFrame:
    """Hits where the whole string stands, placed: ``at`` among the block's letters,
    ``shift`` from there to the text."""
    at = F.col("at") - F.col("o")
    return (found.withColumn("at", at).where((F.col("at") >= 0) & (fixed_slice(F.col("letters"), F.col("at"), F.length("near")) == fixed(F.col("near"))))
            .withColumn("shift", F.col("block").cast("long") * size - F.col("lead")).drop("o", "gram", "cls", "block", "lead"))


def common_grams(rows: DataFrame, blocks: int) -> DataFrame:
    """(cls, gram) of which a task would get very many rows, fewer than HOT and broadcast.
    ``rows`` are gram rows made from ``blocks`` blocks; only as many as SAMPLE are counted,
    which bounds the work and changes no result."""
    part = rows.sample(min(1.0, SAMPLE / max(1, blocks)), seed=1).groupBy("cls", "gram").agg(F.count(F.lit(1)).alias("n"))
    part = cut(part.where(F.col("n") > 1))
    total = part.agg(F.sum("n")).first()[0] or 0
    scale = max(1.0, blocks / SAMPLE)
    return part.where((F.col("n") * scale > COMMON) & (F.col("n") > total / HOT)).select("cls", "gram", F.lit(SALTS).alias("salts"))


def places(rows: DataFrame, wanted: DataFrame, common: DataFrame, string: str = "near", at=("doc_id", "block", "at")) -> DataFrame:
    """(near, o, doc_id, block, at), or what else names strings and places: the shuffle by
    gram, of distinct strings and places."""
    common = F.broadcast(common)
    salts = F.coalesce("salts", F.lit(1))
    left = rows.join(common, ["cls", "gram"], "left").withColumn("salt", F.pmod(F.xxhash64(*at), salts).cast("int"))
    right = wanted.join(common, ["cls", "gram"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.drop("salts").join(right.drop("salts"), ["cls", "salt", "gram"]).select(string, "o", *at)


def _around(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", "block", "lead", fixed(F.col("text")).alias("letters"))


def _with_blocks(hits: DataFrame, blocks: DataFrame) -> DataFrame:
    """Hits joined to their blocks; few hits are broadcast, and the blocks stay where they are."""
    hits = cut(hits)
    n = hits.limit(BROADCAST_ROWS + 1).count()
    return _around(blocks).join(F.broadcast(hits) if n <= BROADCAST_ROWS else hits, ["doc_id", "block"])


def occurrences(texts: Texts, strings: DataFrame, lengths: dict[int, int], margin: int) -> DataFrame:
    """Every place where ``near`` occurs: the columns of ``strings`` (among them ``near``),
    doc_id, the block's ``letters`` (of fixed width), ``at`` among them, and ``shift`` from
    places in the block to places in the text. ``margin`` letters around a place are in the
    block, as far as there are any. ``lengths`` says how many strings there are of each
    length; ``strings`` should be cheap to read again."""
    counts: dict[int, int] = {}
    for length, n in lengths.items():
        cls = max(c for c in CLASSES if c <= length)
        counts[cls] = counts.get(cls, 0) + n
    if isinstance(texts, StoredTexts) and margin + STRIDE <= texts.about["margin"]:
        least = min(texts.strides)
        long = strings.where(F.length("near") >= least)
        found = _stored_occurrences(texts, long, {c: n for c, n in counts.items() if c >= least})
        if all(c >= least for c in counts):
            return found
        short = _occurrences(texts, strings.where(F.length("near") < least), {c: n for c, n in counts.items() if c < least}, margin)
        return found.unionByName(short) if any(c >= least for c in counts) else short
    return _occurrences(texts, strings, counts, margin)


def _few(counts: dict[int, int], chosen: dict[int, int]) -> bool:
    """Whether the rows of all strings may be broadcast, whatever class they are in."""
    return sum(counts.values()) * max(chosen.values(), default=1) <= BROADCAST_ROWS


def _occurrences(texts: Texts, strings: DataFrame, counts: dict[int, int], margin: int) -> DataFrame:
    size, blocks = texts.blocks(margin + STRIDE)
    chosen = layout(counts, 1 << 62)
    if _few(counts, chosen):
        rows = gram_rows(blocks, chosen or {0: 1})
        return _exactly(rows.join(F.broadcast(keyed(strings, chosen or {0: 1})), ["cls", "gram"]), size)
    blocks = blocks if isinstance(texts, StoredTexts) else cut_table(blocks)
    about = blocks.agg(F.sum("core").alias("letters"), F.count(F.lit(1)).alias("n")).first()
    chosen = layout(counts, about["letters"] or 0)
    rows = gram_rows(blocks, chosen)
    if sum((about["letters"] or 0) / s for s in chosen.values()) <= BROADCAST_ROWS:
        grams = F.broadcast(rows.select("doc_id", "block", "cls", "at", "gram"))
        return _exactly(keyed(strings, chosen).join(grams, ["cls", "gram"]).join(F.broadcast(_around(blocks)), ["doc_id", "block"]), size)
    rows = rows.select("doc_id", "block", "cls", "at", "gram")
    hits = places(rows, keyed(strings.select("near").distinct(), chosen), common_grams(rows, about["n"]))
    return _exactly(_with_blocks(hits.join(strings, "near"), blocks), size)


def _stored_occurrences(texts: StoredTexts, strings: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Strings go by number until their places are known."""
    chosen, size = texts.strides, texts.about["size"]
    numbers = cut(strings.select("near").distinct().select("near", F.monotonically_increasing_id().alias("s")))
    kept = F.element_at(F.create_map(*[x for c, s in chosen.items() for x in (F.lit(c), F.lit(-1 << (32 - postings.bits_of(gram_of(c, s)))))]), F.col("cls"))
    if _few(counts, chosen):
        keys = cut(_two_grams(numbers, chosen).withColumn("gram", F.col("gram").bitwiseAND(kept)))
        wanted: dict[int, list[int]] = {}
        for r in keys.select("cls", "gram").distinct().collect():
            wanted.setdefault(r["cls"], []).append(r["gram"])
        hits = _at_both(texts.anchors(wanted).join(F.broadcast(keys), ["cls", "gram"]), size)
        found = _with_numbered(hits, texts.numbered()).join(F.broadcast(strings.join(F.broadcast(numbers), "near")), "s")
    else:
        common = common_grams(texts.anchors(), math.ceil(texts.about["letters"] / size))
        keys = keyed(numbers, chosen).withColumn("gram", F.col("gram").bitwiseAND(kept)).drop("near")
        hits = places(texts.anchors(), keys, common, "s", ("id", "p"))
        found = _with_numbered(hits.join(numbers, "s").join(strings, "near"), texts.numbered())
    return _exactly(found.drop("s"), size)


def _two_grams(numbers: DataFrame, chosen: dict[int, int]) -> DataFrame:
    """(s, cls, o, gram, more, far): a gram for each offset, as :func:`keyed` has it, and the
    last other one that begins ``more`` letters, some strides, after it, if the string has one;
    ``far`` says which of the two it is."""
    first = keyed(numbers, chosen)
    stride, size = (F.element_at(F.create_map(*[x for c, s in chosen.items() for x in (F.lit(c), F.lit(v(c, s)))]), F.col("cls"))
                    for v in (lambda _, s: s, gram_of))
    more = F.floor((F.length("near") - F.col("o") - size) / stride).cast("int") * stride
    both = F.when(F.col("more") > 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    there = F.col("o") + F.when(F.col("far"), F.col("more")).otherwise(0)
    return (first.withColumn("more", more).withColumn("far", F.explode(both))
            .select("s", "cls", "o", gram_hash(fixed_slice(fixed(F.col("near")), there, size)).alias("gram"), "more", "far"))


def _at_both(met: DataFrame, size: int) -> DataFrame:
    """(s, o, id, p): the places where both grams of a string were met, or the one it has. The
    second is in the same block; where it would be in the next, the first is enough."""
    first = F.col("p") - F.when(F.col("far"), F.col("more")).otherwise(0)
    return (met.select("s", "o", "id", first.alias("p"), "more", "far").where(F.col("p") >= 0)
            .groupBy("s", "o", "id", "p").agg(F.first("more").alias("more"), F.bool_or("far").alias("second"), F.bool_or(~F.col("far")).alias("first"))
            .where(F.col("first") & (F.col("second") | (F.col("more") == 0) | (F.col("p") + F.col("more") >= size)))
            .select("s", "o", "id", "p"))


def _with_numbered(hits: DataFrame, blocks: DataFrame) -> DataFrame:
    """Hits, with id and p, joined to their blocks. The blocks of very few are named to the
    scan; few hits are broadcast; with more, bitmaps of their blocks let few others pass to
    the shuffle."""
    hits = cut(hits)
    n = hits.limit(max(BROADCAST_ROWS, NAMED) + 1).count()
    if n <= NAMED:
        blocks = named(blocks, "id", [r[0] for r in hits.select("id").distinct().collect()])
    if n > BROADCAST_ROWS:
        blocks = _numbered_in(blocks, hits)
    found = blocks.select("id", "doc_id", "block", "lead", "text").join(F.broadcast(hits) if n <= BROADCAST_ROWS else hits, "id")
    return found.withColumns({"at": F.col("lead") + F.col("p"), "letters": fixed(F.col("text"))}).drop("id", "p", "text")


def _numbered_in(blocks: DataFrame, hits: DataFrame) -> DataFrame:
    """The blocks that hits name. Numbers are dense in each task's part of the blocks, so there
    is a bitmap for every GROUP blocks."""
    group = F.shiftright("id", GROUP.bit_length() - 1)
    bits = hits.groupBy(group.alias("group")).agg(F.bitmap_construct_agg(F.col("id") % GROUP).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("id") % GROUP / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    here = byte.bitwiseAND(F.expr("shiftleft(1, cast(id % 8 as int))")) != 0
    return blocks.withColumn("group", group).join(F.broadcast(cut(bits)), "group").where(here).drop("group", "bits")
