"""Invariants, edge cases and brute force on small texts."""

import random
from itertools import product

import pytest

from seqloom.functions import postings, schemes
from seqloom.operators import approx, exact, grams, index, report
from seqloom.sources import corpus
from seqloom.sources.text_files import TextFiles


def texts_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def patterns_of(spark, *patterns):
    return spark.createDataFrame([(i, p) for i, p in enumerate(patterns)], "pattern_id long, pattern string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def brute(texts, patterns, k):
    """The rules for results, restated one after the other."""
    out = []
    for d, text in enumerate(texts):
        for p, pattern in enumerate(patterns):
            best = {}
            for b in range(len(text)):
                for e in range(b + 1, min(len(text), b + len(pattern) + k) + 1):
                    ed = distance(text[b:e], pattern)
                    if ed <= k and (b not in best or (ed, e) < best[b]):
                        best[b] = (ed, e)
            for end in sorted({e for _, e in best.values()}):
                kept = []
                for b in sorted(b for b, (_, e) in best.items() if e == end):
                    ed = best[b][0]
                    if kept and b - kept[-1][0] <= k:
                        if ed <= kept[-1][1]:
                            kept[-1] = (b, ed)
                    else:
                        kept.append((b, ed))
                out += [(p, d, b, end, ed) for b, ed in kept]
    return sorted(out)


@pytest.fixture(scope="module")
def small():
    r = random.Random(7)
    texts = ["".join(r.choice("ACGT") for _ in range(70)) for _ in range(3)] + ["ACACACACACACACAC", "A", ""]
    patterns = [texts[0][5:25], texts[1][30:50][:10] + "T" + texts[1][30:50][11:], texts[2][48:70], "ACACACACACACACACACAC", texts[0][0:21]]
    return texts, patterns


@pytest.mark.parametrize("strategy", schemes.STRATEGIES)
@pytest.mark.parametrize("k", [1, 2, 4])
def test_strategies_equal_brute_force(spark, small, strategy, k):
    texts, patterns = small
    found = approx.match(texts_of(spark, *texts), patterns_of(spark, *patterns), k, strategy)
    assert rows(found) == brute(texts, patterns, k)


def test_stored_texts_find_the_same(spark, small, tmp_path, monkeypatch):
    """Few strings, whose grams are named to the scan, more, and too many to broadcast."""
    texts, patterns = small
    frame, path = texts_of(spark, *texts), str(tmp_path / "stored")
    grams.store(frame, path, longest=60, classes=(4, 8))
    stored, wanted = grams.StoredTexts(spark, path), patterns_of(spark, *patterns, "AC", "A")
    for named, rows_ in ((256, 400_000), (0, 400_000), (0, 0)):
        monkeypatch.setattr(grams, "NAMED", named)
        monkeypatch.setattr(grams, "BROADCAST_ROWS", rows_)
        for k in (0, 2):
            assert rows(approx.match(stored, wanted, k)) == rows(approx.match(frame, wanted, k)) != []
    assert rows(approx.match(stored, patterns_of(spark, "ACGT" * 20), 1)) == []  # longer than what the blocks were made for
    with pytest.raises(ValueError):
        grams.store(frame, str(tmp_path / "no"), classes=(1, 8))
    with pytest.raises(ValueError, match="stored whole"):
        grams.StoredTexts(spark, str(tmp_path / "no"))


def scanned(df):
    """Rows that the scans of a finished query gave, by the last folder of their paths."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), {}
    todo = [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
        elif p.getClass().getSimpleName() == "FileSourceScanExec":
            path = p.relation().location().rootPaths().head().toString().rsplit("/", 1)[-1]
            out[path] = out.get(path, 0) + p.metrics().apply("numOutputRows").value()
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return out, plan.toString()


def test_one_pattern_reads_few_stored_grams(spark, tmp_path):
    r = random.Random(14)
    texts = ["".join(r.choices("ACGT", k=200_000)) for _ in range(4)]
    path = str(tmp_path / "stored")
    grams.store(texts_of(spark, *texts), path)
    stored = grams.StoredTexts(spark, path)
    strings = spark.createDataFrame([(texts[2][777:817],)], "near string")
    chosen = stored.strides
    wanted = grams.keyed(strings, chosen)
    values = [x.gram for x in wanted.collect()]
    read, plan = scanned(grams.named(stored.anchors(), "gram", values).join(wanted.hint("broadcast"), ["cls", "gram"]))
    assert 0 < read["anchors"] < 0.05 * stored.anchors().count() and "hashpartitioning" not in plan
    found = grams.occurrences(stored, strings, {40: 1}, 44)
    assert [(x.doc_id, x.at + x.shift) for x in found.collect()] == [(2, 777)]


def test_storing_takes_few_bytes_a_letter(spark, tmp_path):
    """What is stored, and what is shuffled to store it."""
    r = random.Random(18)
    frame = texts_of(spark, *("".join(r.choices("ACGT", k=100_000)) for _ in range(4)))
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    grams.store(frame, str(tmp_path / "stored"))
    assert sum(f.stat().st_size for f in (tmp_path / "stored").rglob("*.parquet")) < 3.2 * 400_000
    assert shuffled() - before < 0.1 * 400_000
    stored = grams.StoredTexts(spark, str(tmp_path / "stored"))
    values = [x.gram for x in grams.keyed(spark.createDataFrame([("ACGTACGGTCA" + "ACGTTGCAT",)], "near string"), stored.strides).collect()]
    read, _ = scanned(stored.anchors({12: values}))
    assert 0 < read["anchors"] < 0.15 * stored.packed().count()


@pytest.mark.parametrize("way", ["named", "broadcast", "few, many hits", "many"])
def test_stored_grams_meet_each_occurrence_once(spark, tmp_path, monkeypatch, way):
    """Several runs and blocks, strings across their ends, letters of one to four bytes, texts
    with one id; and the texts are made again from their blocks."""
    monkeypatch.setattr(postings, "RUN", 700)
    if way != "named":
        monkeypatch.setattr(grams, "NAMED", 0)
    if way == "few, many hits":
        monkeypatch.setattr(grams, "_few", lambda *_: True)
    if way in ("few, many hits", "many"):
        monkeypatch.setattr(grams, "BROADCAST_ROWS", 0)
    r = random.Random(19)
    texts = ["".join(r.choices("AC\u00e9\u20ac\U0001f600", weights=[9, 9, 1, 1, 1], k=n)) for n in (1_500, 257, 30)]
    texts.append(texts[0][200:900])
    frame = spark.createDataFrame([(0, texts[0]), (1, texts[1]), (2, texts[2]), (2, texts[3]), (3, "")], "doc_id long, text string").repartition(2)
    grams.store(frame, str(tmp_path / "stored"), longest=60, classes=(4, 12, 24))
    stored = grams.StoredTexts(spark, str(tmp_path / "stored"))
    assert sorted(x.text for x in stored.texts.collect()) == sorted(texts)
    wanted = {t[i: i + n] for t in texts for n in (4, 5, 11, 12, 13, 20, 24, 31, 40) for i in (0, 250, 255, 256, 490, 511, len(t) - n) if i >= 0}
    wanted = {w for w in wanted if len(w) >= 4}
    lengths = {n: len([w for w in wanted if len(w) == n]) for n in {len(w) for w in wanted}}
    some = spark.createDataFrame([(w, 1) for w in wanted], "near string, extra int")
    found = grams.occurrences(stored, some, lengths, 40).collect()
    want = [(w, min(d, 2), i) for d, t in enumerate(texts) for w in wanted for i in range(len(t)) if t.startswith(w, i)]
    assert sorted((x.near, x.doc_id, x.at + x.shift) for x in found) == sorted(want)
    grams.check(spark, str(tmp_path / "stored"))


def test_long_text_with_short_and_long_patterns(spark):
    """Places only, whatever the text's length: 5 million letters in one row."""
    r = random.Random(11)
    text = "".join(r.choices("ACGT", k=5_000_000))
    at = [0, 255, 256, 1_000_003, 4_999_940]
    patterns = [*(text[i: i + 60] for i in at), "AC", text[777:777 + 400]]
    found = rows(exact.exact_matches(texts_of(spark, text), patterns_of(spark, *patterns)))
    want = [i for i in range(len(text) - 1) if text.startswith("AC", i)]
    assert [x for x in found if x[0] == 5] == [(5, 0, i) for i in want]
    assert [x for x in found if x[0] != 5] == [*((n, 0, i) for n, i in enumerate(at)), (6, 0, 777)]
    changed = [p[:20] + "ACGT"["ACGT".index(p[20]) - 1] + p[21:40] + p[41:] for p in patterns[:5]]
    near = rows(approx.match(texts_of(spark, text), patterns_of(spark, *changed), 2))
    assert [x[:2] for x in near] == [(n, 0) for n in range(5)] and all(abs(x[2] - i) <= 2 for x, i in zip(near, at))


@pytest.mark.parametrize("way", ["strings", "texts", "both"])
def test_grams_meet_each_occurrence_once(spark, monkeypatch, way):
    """All lengths, by each of the three ways; the text has few different grams, and letters
    of one to four bytes."""
    if way != "strings":
        monkeypatch.setattr(grams, "_few", lambda *_: False)
    if way == "both":
        monkeypatch.setattr(grams, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(grams, "COMMON", 3)
    r = random.Random(12)
    text = "".join(r.choices("AC\u00e9\u20ac\U0001f600", weights=[9, 9, 1, 1, 1], k=700))
    wanted = [text[i: i + n] for n in range(1, 40) for i in (0, 250, 255, 700 - n)]
    lengths = {n: len({w for w in wanted if len(w) == n}) for n in range(1, 40)}
    some = spark.createDataFrame([(w, 1) for w in set(wanted)], "near string, extra int")
    found = grams.occurrences(grams.Texts(texts_of(spark, text, "")), some, lengths, 40).collect()
    assert sorted((x.near, x.at + x.shift) for x in found) == sorted((s, i) for s in set(wanted) for i in range(700) if text.startswith(s, i))


def test_layout_follows_the_counts():
    """Many strings on a short text: every place of the text; few on a long one: few."""
    assert grams.layout({20: 10**6}, 30_000) == {20: 1} and grams.layout({20: 100}, 10**9)[20] == 8
    assert grams.layout({}, 10) == {} and grams.layout({0: 3}, 10) == {0: 1}
    for cls in grams.CLASSES:
        for stride in grams.strides(cls):
            assert cls == 0 or 0 < grams.gram_of(cls, stride) <= cls - stride + 1
    for counts in ({1: 5, 20: 9}, {12: 10, 14: 10, 64: 7}, {3: 1}):
        chosen = grams.layout(counts, 5_000)
        assert all(any(c <= cls for c in chosen) for cls in counts)


def test_common_grams_are_dealt(spark, monkeypatch):
    """One line in every text: no key of the join has more rows than the bound says."""
    monkeypatch.setattr(grams, "COMMON", 40)
    monkeypatch.setattr(grams, "_few", lambda *_: False)
    monkeypatch.setattr(grams, "BROADCAST_ROWS", 0)
    r = random.Random(15)
    line = "".join(r.choices("ACGT", k=80))
    texts = ["".join(r.choices("ACGT", k=50)) + line for _ in range(400)]
    frame = texts_of(spark, *texts)
    size, blocks = grams.Texts(frame).blocks(100)
    rows_ = grams.gram_rows(blocks, {40: 1}).select("doc_id", "block", "cls", "at", "gram")
    common = grams.common_grams(rows_, blocks.count())
    assert common.count() >= 40
    dealt = rows_.join(common, ["cls", "gram"], "left").selectExpr("gram", "pmod(xxhash64(doc_id, block, at), coalesce(salts, 1)) as salt")
    assert max(x["count"] for x in dealt.groupBy("gram", "salt").count().collect()) <= 40
    found = exact.exact_matches(frame, patterns_of(spark, line[10:60], line[:40], texts[7][:45]))
    assert rows(found) == sorted([(0, d, 60) for d in range(400)] + [(1, d, 50) for d in range(400)] + [(2, 7, 0)])


def test_tiles_hold_every_letter(spark):
    texts = ["", "A", "ACGT", "ACGTACG", "ACGTACGT", "ACGTACGTA"]
    got = {}
    for d, at, p in rows(corpus.tiles(texts_of(spark, *texts), 4)):
        assert texts[d][at: at + len(p)] == p
        got.setdefault(d, []).append((at, len(p)))
    assert got == {1: [(0, 1)], 2: [(0, 4)], 3: [(0, 4), (3, 4)], 4: [(0, 4), (4, 4)], 5: [(0, 4), (4, 4), (5, 4)]}


def test_errors_in_pieces_that_no_search_starts_with(spark):
    """One error in the first and one in the third of four pieces."""
    pattern = "ACGTTGCAAGCTTCAGGATC"
    text = "TTTT" + "ACCTT" + "GCAAG" + "CTGCA" + "GGATC" + "TTTT"
    found = approx.match(texts_of(spark, text), patterns_of(spark, pattern), 3, "kianfar")
    assert rows(found) == brute([text], [pattern], 3) != []


@pytest.mark.parametrize("strategy", schemes.STRATEGIES[:6])
@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_schemes_cover_all_error_distributions(strategy, k):
    assert schemes.uncovered(strategy, k) == []
    for order, _, _ in schemes.searches(strategy, k):
        assert all(abs(set(order[:i]).__len__() - (max(order[:i]) - min(order[:i]) + 1)) == 0 for i in range(1, len(order) + 1))


def test_short_patterns(spark):
    texts, patterns = ["ACGTACGTTT"], ["AC", "TT", "G", "ACGT"]
    for strategy in ("pigeon", "kplus2", "improved"):
        for k in (1, 2, 4):
            found = approx.match(texts_of(spark, *texts), patterns_of(spark, *patterns), k, strategy)
            assert rows(found) == brute(texts, patterns, k)


@pytest.mark.parametrize("strategy", schemes.STRATEGIES)
def test_plans_follow_the_searches(strategy):
    """Every spread of errors is tried at one of its error-free pieces, and nothing is
    tried that no search accepts."""
    for k in range(1, 5):
        pieces, tried = schemes.plan(strategy, k)
        found = schemes.searches(strategy, k)
        spreads = [e for e in product(range(k + 1), repeat=pieces) if sum(e) <= k]
        for e in spreads:
            assert any(e[i] == 0 and (sum(e[:i]), sum(e[i + 1:])) in pairs for i, pairs in tried.items())
        for i, pairs in tried.items():
            for a, b in pairs:
                mine = [e for e in spreads if e[i] == 0 and (sum(e[:i]), sum(e[i + 1:])) == (a, b)]
                assert any(not found or any(schemes.accepts(s, e) for s in found) for e in mine)
    assert sum(map(len, schemes.plan("kianfar", 4)[1].values())) < sum(map(len, schemes.plan("pigeon", 4)[1].values()))


def test_edges(spark):
    t = texts_of(spark, "AAAAAAA", "ACGT", "")
    assert rows(exact.exact_matches(t, patterns_of(spark, "AAAA", "N", "", "ACGTACGT"))) == [(0, 0, i) for i in range(4)]
    assert rows(approx.match(t, patterns_of(spark, "", "NNNNNNNNNNNN"), 2)) == []
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rows(approx.match(empty, patterns_of(spark, "ACGTACGT"), 1)) == []
    assert rows(approx.match(t, spark.createDataFrame([], "pattern_id long, pattern string"), 0)) == []
    # equal patterns and equal texts keep their own ids
    assert rows(approx.match(texts_of(spark, "ACGTACGA", "ACGTACGA"), patterns_of(spark, "ACGTACGA", "ACGTACGA"), 0)) == \
        [(p, d, 0, 8, 0) for p in (0, 1) for d in (0, 1)]
    for bad in (5, -1):
        with pytest.raises(ValueError):
            approx.match(t, patterns_of(spark, "ACGT"), bad)
    with pytest.raises(ValueError):
        approx.match(t, patterns_of(spark, "ACGT"), 1, "unknown")
    with pytest.raises(ValueError):
        index.sparse_suffix_array(index.suffix_array(t), 3)


def test_index_invariants(spark, monkeypatch):
    texts = texts_of(spark, "ACGTACGTAACC", "AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA", "T")
    sa = index.suffix_array(texts)
    assert rows(sa) == rows(index.suffix_array_doubling(texts, first=2))
    monkeypatch.setattr(index, "COMMON", 5)
    monkeypatch.setattr(index, "HOT", 2)
    assert rows(sa) == rows(index.suffix_array_doubling(texts, first=1))
    mapped = index.lf_mapping(index.bwt(texts, sa), index.c_table(index.char_histogram(texts)))
    by_row = {(r.doc_id, r.row): r for r in mapped.collect()}
    sizes = {0: 13, 1: 41, 2: 2}
    for (d, _), r in by_row.items():
        assert by_row[d, r.lf].sa == (r.sa - 1) % sizes[d]
    assert rows(index.lookup_by_sample(mapped, index.sparse_suffix_array(sa, 4), 4)) == rows(sa)
    patterns = patterns_of(spark, "AC", "AA", "GT")
    both = exact.bidirectional_search(patterns, exact.suffix_heads(sa, texts, [2]),
                                      exact.suffix_heads(index.suffix_array(index.reversed_texts(texts)), index.reversed_texts(texts), [2]))
    assert all(r.hi - r.lo == r.rhi - r.rlo for r in both.collect()) and both.count() == 4


def test_passes_have_fewer_suffixes(spark, monkeypatch):
    """Only suffixes that share their rank are sorted again: a repeat, not the whole text."""
    sizes, plain = [], index._counted
    monkeypatch.setattr(index, "_counted", lambda rows_, by: sizes.append(rows_.count()) or plain(rows_, by))
    r = random.Random(18)
    part = "".join(r.choices("ACGT", k=300))
    text = "".join(r.choices("ACGT", k=6_000)) + part + "".join(r.choices("ACGT", k=3_000)) + part
    got = rows(index.suffix_array_doubling(texts_of(spark, text)))
    order = sorted(range(len(text) + 1), key=lambda i: text[i:])
    assert got == sorted((0, row, i) for row, i in enumerate(order))
    assert sizes[0] == len(text) + 1 and sizes[2] < 700 and sizes == sorted(sizes, reverse=True)


def test_index_is_written_and_read(spark, tmp_path):
    texts = texts_of(spark, "ACGTACGTAACC")
    index.build_index(texts, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i/suffix_index")).count() == 13
    assert spark.read.parquet(str(tmp_path / "i/bwt")).first().letters == index.bwt_string(index.bwt(texts, index.suffix_array(texts))).first().bwt
    assert spark.read.parquet(str(tmp_path / "i/c_table")).count() == 5 == spark.read.parquet(str(tmp_path / "i/reverse_c_table")).count()
    for side, source in (("", texts), ("reverse_", index.reversed_texts(texts))):
        samples = spark.read.parquet(str(tmp_path / f"i/{side}samples"))
        for every in (1, 4, 256):
            want = rows(index.sparse_suffix_array(index.suffix_array(source), every))
            assert rows(samples.where(f"rate >= {every}").select("doc_id", "row", "sa")) == want


def test_reads_file(spark, tmp_path):
    path = tmp_path / "reads.csv"
    good = "7,30,ACGT,ACGA,ACG,ACGG,AC"
    bad = {"8,30,ACGT,ACGA": "too few fields", "9,3,A,A,A,A,A,A": "too many fields", "x,30,A,C,G,T,A": "not a number", ",30,A,C,G,T,A": "not a number"}
    path.write_text("\n".join(["id,position,a,b,c,d,e", good, *bad]) + "\n")
    long = corpus.long_reads(corpus.reads_csv(spark, str(path)), ("id", "position"))
    assert rows(long.select("id", "k", "pattern")) == [(7, 0, "ACGT"), (7, 1, "ACGA"), (7, 2, "ACG"), (7, 3, "ACGG"), (7, 4, "AC")]
    assert {x.line: x.reason for x in corpus.reads_rejects(spark, str(path)).collect()} == bad
    assert corpus.reads_csv(spark, str(path)).count() == 1
    (tmp_path / "t.txt").write_text("AC\nGT")
    assert corpus.text_files(spark, str(tmp_path / "t.txt")).first().text == "AC\nGT"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        corpus.text_files(spark, str(tmp_path / "none"))


def test_text_files_by_ranges(spark, tmp_path):
    """A file of one line is many tasks, and found in as if it were a table."""
    r = random.Random(16)
    texts = {"a.txt": "".join(r.choices("ACGT", k=50_000)), "b/c.txt": "ACGTAC", "b/d.txt": ""}
    (tmp_path / "in/b").mkdir(parents=True)
    for name, text in texts.items():
        (tmp_path / "in" / name).write_text(text + ("\n" if text else ""))
    files = TextFiles(spark, str(tmp_path / "in"), task_bytes=2_048)
    assert files.blocks(90)[1].rdd.getNumPartitions() >= 20
    name = {str(tmp_path / "in" / n): i for i, n in enumerate(texts)}
    frame = texts_of(spark, *texts.values())
    wanted = patterns_of(spark, *(texts["a.txt"][i: i + 50] for i in (0, 2_040, 25_000, 49_950)), "ACGTAC", "GTA")
    for k in (0, 1):
        found = sorted((x.pattern_id, name[x.doc_id], x.begin, x.end, x.ed) for x in approx.match(files, wanted, k).collect())
        assert found == rows(approx.match(frame, wanted, k)) != []
    grams.store(files, str(tmp_path / "stored"), longest=60)
    stored = grams.StoredTexts(spark, str(tmp_path / "stored"))
    assert len(rows(approx.match(stored, wanted, 1))) == len(found)
    with pytest.raises(ValueError, match="at most 60"):
        approx.match(stored, patterns_of(spark, "ACGT" * 40), 1)
    with pytest.raises(FileNotFoundError):
        TextFiles(spark, str(tmp_path / "none"))
    (tmp_path / "in/b/d.txt").write_bytes(b"AC\xc3\xa9")
    with pytest.raises(Exception, match="byte 2 of .*d.txt is no ASCII letter"):
        TextFiles(spark, str(tmp_path / "in")).blocks(90)[1].collect()


def test_own_schemes(spark, small):
    texts, patterns = small
    schema = "strategy string, k int, order string, lower string, upper string"
    table = lambda *found: spark.createDataFrame([("mine", 2, *f.split("/")) for f in found], schema)
    # Five pieces for two errors; patterns of fewer letters are tried everywhere.
    five = table(*("/".join((o, "00000", "00222")) for o in ("01234", "12340", "23410", "34210", "43210")), "01234/00000/01222", "43210/00000/01222", "21034/00000/01222")
    mine = schemes.own_scheme(five, "mine")
    wanted = [*patterns, "ACGT", "GAT"]
    assert rows(approx.match(texts_of(spark, *texts), patterns_of(spark, *wanted), 2, mine)) == brute(texts, wanted, 2)
    for found, said in ((["012/000/012"], r"errors spread as"), (["012/000/022", "01/00/02"], "k . 1 at least"), (["012/000/022", "120/000/02"], "the same pieces"), (["021/000/022"], "gap"),
                        (["012/000/021"], "fall or cross"), (["01/00/02"], "k . 1 at least")):
        with pytest.raises(ValueError, match=said):
            schemes.own_scheme(table(*found), "mine")
    with pytest.raises(ValueError, match="no searches"):
        schemes.own_scheme(five, "other")
    with pytest.raises(ValueError, match="not 3"):
        approx.match(texts_of(spark, *texts), patterns_of(spark, "ACGT"), 3, mine)


def test_stored_tables_are_checked(spark, small, tmp_path):
    import shutil

    texts, path = small[0], tmp_path / "stored"
    grams.store(texts_of(spark, *texts), str(path), longest=60, classes=(8,))
    grams.check(spark, str(path))
    extra = spark.read.parquet(str(path / "anchors/cls=8")).limit(1)
    shutil.copytree(path, tmp_path / "changed")
    extra.write.mode("append").parquet(str(tmp_path / "changed/anchors/cls=8"))
    with pytest.raises(ValueError, match="anchors/cls=8 has been changed"):
        grams.check(spark, str(tmp_path / "changed"))
    shutil.copytree(path, tmp_path / "lost", ignore=shutil.ignore_patterns("blocks"))
    with pytest.raises(ValueError, match="blocks can't be read"):
        grams.check(spark, str(tmp_path / "lost"))
    shutil.copytree(path, tmp_path / "unfinished", ignore=shutil.ignore_patterns("about"))
    with pytest.raises(ValueError, match="stored whole"):
        grams.check(spark, str(tmp_path / "unfinished"))


def test_report_meets_blocks(spark):
    text = "".join(random.Random(17).choices("ACGT", k=3_000))
    found = spark.createDataFrame([(1, 0, b, e, 0) for b, e in ((0, 10), (500, 530), (511, 513), (512, 1024), (100, 2_900))],
                                  "pattern_id long, doc_id long, begin long, end long, ed long")
    got = report.match_report(found, texts_of(spark, text)).collect()
    assert sorted(x.matched for x in got) == sorted(text[b:e] for b, e in ((0, 10), (500, 530), (511, 513), (512, 1024), (100, 2_900)))


def test_jobs(spark, tmp_path):
    """A reads file through every strategy, with what was stored before."""
    from seqloom.jobs import search

    r = random.Random(13)
    text = "".join(r.choices("ACGT", k=900))
    texts_of(spark, text).write.parquet(str(tmp_path / "texts"))
    lines = ["id,position,a,b,c,d,e"]
    for i, at in enumerate((100, 500, 840)):
        read = text[at: at + 40]
        lines.append(f"{i},{at},{read},{read[:9] + read[10:]},{read},{read},{read}")
    lines.append(f"7,10,{'A' * 40},{'A' * 40},A,A,A")
    lines.append(f"8,10,{text[300:340]},{text[300:340]},A,A,A")
    (tmp_path / "reads.csv").write_text("\n".join(lines))
    search.main(["store", str(tmp_path / "texts"), str(tmp_path / "stored"), "--longest", "50"])
    common = [str(tmp_path / "stored"), str(tmp_path / "reads.csv")]
    search.main(["compare", *common, str(tmp_path / "out"), "--stored", "--max-ed", "1"])
    told = spark.read.parquet(str(tmp_path / "out/report")).collect()
    assert {x.strategy for x in told} == set(schemes.STRATEGIES)
    assert {(x.k, x.n_reads, x.n_matched, x.n_planted, x.n_matches) for x in told} == {(1, 5, 4, 3, 4)} and all(x.seconds > 0 for x in told)
    # Stopped after two strategies, in the midst of a third, and run again: the others stay.
    import shutil

    for name in schemes.STRATEGIES[2:]:
        shutil.rmtree(tmp_path / f"out/report/strategy={name}")
    shutil.rmtree(tmp_path / "out/missed/strategy=kplus1")
    search.main(["compare", *common, str(tmp_path / "out"), "--stored", "--max-ed", "1"])
    again = {x.strategy: tuple(x) for x in spark.read.parquet(str(tmp_path / "out/report")).collect()}
    assert set(again) == set(schemes.STRATEGIES) and all((again[x.strategy] == tuple(x)) == (x.strategy in schemes.STRATEGIES[:2]) for x in told)
    search.main(["check", str(tmp_path / "stored")])
    missed = spark.read.parquet(str(tmp_path / "out/missed"))
    assert {tuple(x) for x in missed.drop("strategy").collect()} == {(7, "none", 0, 0), (8, "elsewhere", 1, 1)}
    search.main(["compare", *common, str(tmp_path / "free"), "--stored", "--max-ed", "1", "--read-positions-incorrect"])
    assert {x.pattern_id for x in spark.read.parquet(str(tmp_path / "free/missed")).collect()} == {7}
    patterns_of(spark, text[5:45]).write.parquet(str(tmp_path / "reads"))
    search.main(["match", str(tmp_path / "texts"), str(tmp_path / "reads"), str(tmp_path / "found")])
    assert spark.read.parquet(str(tmp_path / "found")).first().begin == 5
    (tmp_path / "plain.txt").write_text(text)
    spark.createDataFrame([("one", 2, o, "000", "022") for o in ("012", "102", "210")], "strategy string, k int, order string, lower string, upper string") \
        .write.parquet(str(tmp_path / "schemes"))
    search.main(["match", str(tmp_path / "plain.txt"), str(tmp_path / "reads"), str(tmp_path / "found2"), "--plain", "--strategy", "one",
                 "--schemes", str(tmp_path / "schemes")])
    assert spark.read.parquet(str(tmp_path / "found2")).first().begin == 5


def test_stream_gives_the_same(spark, tmp_path):
    from seqloom.streaming.search_stream import search_stream

    texts = texts_of(spark, "ACGTACGTAACCGGTTACGT")
    reads = patterns_of(spark, "ACGTAACC", "GGTTACGA")
    reads.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in"))
    q = search_stream(stream, texts, 1, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    q.stop()
    assert rows(spark.read.parquet(str(tmp_path / "out")).drop("batch")) == rows(approx.match(texts, reads, 1))
