"""Operators 11 to 13 against brute force on whole tables and small ones."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

import __spark_entry__ as entry
from seqloom.llm import periodic_runs, substring_dedup, whitening

from ..conftest import SF
from .test_operators import ODD, SCHEMA, sha

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


# 11


def plain_removal(rows, length=50):
    """(doc_id, words, removed, digest) from a table of all windows."""
    first = {}
    key = lambda d: float("inf") if d is None else d
    for d, text in rows:
        ws = words(text)
        for i in range(len(ws) - length + 1):
            w = tuple(ws[i: i + length])
            first[w] = min(first.get(w, key(d)), key(d))
    out = []
    for d, text in rows:
        ws = words(text)
        gone = set()
        for i in range(len(ws) - length + 1):
            if first[tuple(ws[i: i + length])] < key(d):
                gone.update(range(i, i + length))
        out.append((d, len(ws), len(gone), sha(" ".join(w for i, w in enumerate(ws) if i not in gone))))
    return sorted(out, key=str)


def removal(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_substring_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = removal(entry.queries()["op11_substring_dedup"](spark, SF))
    assert got == plain_removal(rows) and sum(r[2] > 0 for r in got) > 5


@pytest.mark.parametrize("hot", [False, True])
def test_repeated_passages_in_all_places(spark, monkeypatch, hot):
    """Chains of passages of which each document changes a word, passages that meet in new
    ways, repeats within one document, equal ids, null ids, copies and windows of exactly
    50 words; with tiny shards and parts too."""
    if hot:
        monkeypatch.setattr(substring_dedup, "PART", 2)
        monkeypatch.setattr(substring_dedup, "HOT", 3)
        monkeypatch.setattr(substring_dedup, "BLOCK", 60)
    r = random.Random(3)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    a, b, c = fresh(120), fresh(90), fresh(50)
    rows, changed = [], list(a)
    for d in (40, 10, 30, 20, 50, 60):
        changed = list(changed)
        changed[r.randrange(len(changed))] = f"x{d}"
        rows.append((d, fresh(7) + changed + fresh(5)))
    rows += [(70 + d, fresh(30) + c + fresh(20)) for d in range(12)]
    rows += [(5, a[:60] + b[:60]), (6, b + a[30:]), (7, a[30:60] + b[30:60] + c[:40]), (90, b[20:] + b[20:] + c + c), (91, c + b)]
    rows += [(92, b[:49]), (93, c), (93, c), (94, c[:-1] + ["y"]), (None, b), (None, b), (95, b), (93, b + a), (96, ["z"] * 400), (97, ["z"] * 60)]
    rows = [(d, " ".join(ws)) for d, ws in rows] + [(98, None), (99, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert removal(substring_dedup.without_repeats(frame)) == plain_removal(rows)


def test_colliding_hashes_change_nothing(spark, monkeypatch):
    """Hashes of four values in the first passes: the automaton tells windows apart."""
    plain = substring_dedup.gram_hashes
    few = lambda ws, size, seed: plain(ws, size, seed) % np.uint64(4) if seed < 4 else plain(ws, size, seed)
    monkeypatch.setattr(substring_dedup, "gram_hashes", few)
    r = random.Random(4)
    part = [f"w{i}" for i in range(60)]
    rows = [(d, " ".join(part[d % 7:] + [f"v{r.randrange(9)}" for _ in range(60)] + part[: 50 + d % 3])) for d in range(9)]
    one = substring_dedup.prints(spark.createDataFrame(rows, "doc_id long, text string"))
    copies = substring_dedup.copies_of(one)
    grams = substring_dedup.first_grams(one, copies)
    step = lambda n: (substring_dedup.GRAMS[min(n, 2)], n)
    assert grams.count() > 0 and step(5) == (50, 5)
    assert removal(substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_removal(rows)


def test_substring_odd_rows(spark):
    odd = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 as id", "2 as `key`", "'c' as class", "array(0) as `a.b`")
    assert removal(substring_dedup.without_repeats(odd)) == plain_removal([(r[0], r[1]) for r in ODD])
    assert removal(substring_dedup.without_repeats(odd.limit(0))) == []


def test_automaton_equals_search():
    r = random.Random(6)
    for _ in range(60):
        passages = [[b"%d" % r.randrange(2 + _ % 3) for _ in range(r.randrange(1, 60))] for _ in range(3)]
        ws = [b"%d" % r.randrange(2 + _ % 4) for _ in range(80)]
        size = r.randrange(1, 9)
        automaton = substring_dedup.Automaton()
        for p in passages:
            automaton.add(p)
        want = [any(ws[i: i + size] == p[j: j + size] for p in passages for j in range(len(p) - size + 1)) for i in range(len(ws) - size + 1)]
        assert automaton.reaching(ws, size).tolist() == want


def test_equal_windows_have_equal_anchors():
    r = random.Random(7)
    ws = [b"%d" % r.randrange(3) for _ in range(300)]
    for gram in substring_dedup.GRAMS:
        hashes, at = substring_dedup.anchors(ws, gram, 1)
        alone = [substring_dedup.anchors(ws[i: i + 50], gram, 1) for i in range(len(ws) - 49)]
        assert [(int(x[1][0]), int(x[0][x[1][0]])) for x in alone] == [(int(a) - i, int(hashes[a])) for i, a in enumerate(at)]


# 12


def plain_whitening(vectors):
    """Digests of the contract from numpy's own eigenvalues."""
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(0)
    centred = (n * x - total) / n
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    return ((n * x - total) ** 2).sum(1), centred @ axes[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-30)), values[::-1] / np.trace(v)


def test_whitening_query_equals_numpy(spark):
    given = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    given = [r for r in given if r.embedding is not None and None not in r.embedding and np.isfinite(r.embedding).all()]
    deviation, white, explained = plain_whitening([r.embedding for r in given])
    got = sorted(entry.queries()["op12_whitening"](spark, SF).collect(), key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component, r.n) for r in got] == [(g.vec_id, k, len(given)) for g in given for k in range(1, 9)]
    assert [r.deviation for r in got[::8]] == deviation.tolist()
    mine = np.array([r.whitened for r in got]).reshape(-1, 8)
    sign = np.sign((mine * white[:, :8]).sum(0))
    assert np.abs(mine * sign - white[:, :8]).max() < 1e-9
    assert np.allclose([r.explained for r in got[:8]], explained[:8], rtol=1e-10) and {r.identity_error for r in got}.pop() < 1e-10


def test_whitening_odd_vectors(spark):
    schema = "vec_id long, embedding array<double>, id int, x string"
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0, 5.0]), (1, [1.0, 0.0, 5.0]), (None, [0.0, 2.0, 5.0]), (2, [0.5]), (3, None), (4, [1.0, None]), (5, [nan]), (6, [inf, 1.0]), (7, [3.0, -2.0])]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], schema)
    got = whitening.whitened(df).collect()
    full = [(v + [0.0] * 3)[:3] for i, v in rows if i not in (3, 4, 5, 6)]
    deviation, white, explained = plain_whitening(full)
    assert sorted((str(r.vec_id), r.component, r.n) for r in got) == sorted((str(i), k, 5) for i in (1, 1, None, 2, 7) for k in (1, 2, 3))
    assert sorted(r.deviation for r in got) == sorted(deviation.tolist() * 3)
    for k in (1, 2, 3):
        mine = sorted(abs(r.whitened) for r in got if r.component == k)
        assert np.allclose(mine, sorted(np.abs(white[:, k - 1])), atol=1e-9)
    # Equal rows, one row, no rows: nothing varies; dependent entries: one component.
    assert whitening.whitened(df.where("vec_id = 1")).count() == 0 == whitening.whitened(df.where("vec_id = 2")).count()
    assert whitening.whitened(df.limit(0)).count() == 0 and whitening.whitened(df.where("vec_id = 3")).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(6)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whitened(line).collect()} == {1}
    with pytest.raises(Exception, match="too large in vector 9"):
        whitening.whitened(spark.createDataFrame([(9, [1e30]), (8, [1.0])], "vec_id long, embedding array<double>"))


def test_factor_and_rotations():
    r = np.random.default_rng(2)
    for size, rank in ((1, 1), (7, 7), (20, 6), (33, 33)):
        half = r.normal(size=(size, rank)) * np.geomspace(1, 1e-4, rank)
        v = half @ half.T
        factor, order = whitening.pivoted_cholesky(v)
        assert factor.shape[1] <= rank and np.allclose(factor @ factor.T, v[order][:, order], atol=1e-12) and np.allclose(np.triu(factor, 1), 0)
        values, axes = whitening.principal(v, size)
        want = np.sort(np.linalg.eigvalsh(v))[::-1][: len(values)]
        assert np.allclose(values, want, rtol=1e-6) and np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-6)
    # Beyond 64 and 53 bits: the same with Python's integers.
    x = np.array([[1 << 50, 3], [5, -(1 << 49)]])
    total = x.astype(object).sum(0)
    assert whitening.deviations(x, 2, total) == [sum((2 * int(c) - int(t)) ** 2 for c, t in zip(row, total)) for row in x.tolist()]


# 13


def changed(doc_id, text):
    ws, h = words(text), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and ws:
        g, n = h // 10, len(ws)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    return ws


def plain_runs(ws):
    """All runs, period by period and word by word."""
    out = []
    for q in range(1, len(ws) // 4 + 1):
        j = 0
        while j < len(ws) - q:
            s = j
            while j < len(ws) - q and ws[j] == ws[j + q]:
                j += 1
            size = j - s + q
            if j > s and size >= max(6, 4 * q) and not any(all(ws[i] == ws[i + p] for i in range(s, s + size - p)) for p in range(1, q)):
                out.append((s, size, q))
            j += 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def plain_periodic(doc_id, text):
    ws = changed(doc_id, text)
    runs = plain_runs(ws)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else None
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join("%d,%d,%d\n" % x for x in runs)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def periodic(df):
    return sorted(map(tuple, df.drop("n_words").collect()), key=str)


def test_periodic_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = periodic(entry.queries()["op13_periodic_runs"](spark, SF))
    assert got == sorted((plain_periodic(*r) for r in rows), key=str) and sum(r[1] > 0 for r in got) > 10


def test_periodic_random_and_odd_texts(spark, monkeypatch):
    """Nested periods, ties, long runs over many rows of tiles; equal and null ids, clashing columns."""
    monkeypatch.setattr(periodic_runs, "CHUNK", 2)
    r = random.Random(8)
    rows = []
    for d in range(150):
        ws = []
        while len(ws) < r.choice([3, 30, 120, 300]):
            root = [str(r.randrange(r.choice([1, 2, 3, 40]))) for _ in range(r.randrange(1, 17))]
            ws += (root * r.randrange(1, 9))[: r.randrange(1, 120)] if r.random() < 0.5 else root
        rows.append((d, " ".join(ws)))
    rows += [(None, "a b " * 9), (7, "a " * 6), (7, "b " * 5), (8, None), (9, ""), (10, "x y " * 3000 + "x"), (11, ("abc " * 7 + "d ") * 40)]
    frame = spark.createDataFrame([(*x, 1, "t", "u") for x in rows], "doc_id long, text string, id int, octave string, words string")
    assert periodic(periodic_runs.periodic_runs(frame)) == sorted((plain_periodic(*x) for x in rows), key=str)
    odd = [x for x in ODD if x[0] != 7]  # brute force on the long one takes minutes; see the next test
    assert periodic(periodic_runs.periodic_runs(spark.createDataFrame(odd, SCHEMA))) == sorted((plain_periodic(x[0], x[1]) for x in odd), key=str)
    assert periodic(periodic_runs.periodic_runs(frame.limit(0))) == []


def test_one_word_twenty_thousand_times(spark):
    got = periodic_runs.periodic_runs(spark.createDataFrame([(3, "x " * 20_000)], "doc_id long, text string")).first()
    assert zlib.crc32(b"3") % 10 and tuple(got)[1:7] == (20_000, 1, 0, 20_000, 1, 20_000_000) and got.collapsed_sha256 == sha("x")
    assert got.runs_sha256 == hashlib.sha256(b"0,20000,1\n").hexdigest()


def test_best_run_is_exact():
    assert periodic_runs.best_run([(0, 41, 10), (5, 82, 20), (9, 40, 10)]) == (0, 41, 10, 4100)
    assert periodic_runs.best_run([]) == (None,) * 4
    assert collections.Counter(periodic_runs.collapsed(list("ababababc"), [(0, 8, 2)])) == collections.Counter("abc")
