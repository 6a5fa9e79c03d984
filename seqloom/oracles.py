"""The same results in SQL, written independently of the operators: pieces joined to
every position, all begins and lengths tried, distances computed on whole strings."""

from __future__ import annotations

from .functions import schemes
from .functions.letters import _FROM, _TO
from .queries import CHUNK, HEAD, HEAD_K, SAMPLE, SHORT, STRATEGY_K
from .sources.corpus import READ

_LETTERS = f"translate(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), '{_FROM}', '{_TO}')"
DOCS = f"docs AS MATERIALIZED (SELECT doc_id, {_LETTERS} AS text FROM documents)"
REF = f"ref AS MATERIALIZED (SELECT item_id AS doc_id, {_LETTERS} AS text FROM benchmark)"


def _tiles(name, source, size):
    return f"""{name} AS MATERIALIZED (
  SELECT doc_id || ':' || g AS pattern_id, doc_id, g::BIGINT AS position, substr(text, (g + 1)::BIGINT, {size}) AS pattern
  FROM (SELECT * FROM {source} WHERE text <> ''),
       unnest(list_distinct(list_append(range(0, greatest(length(text) - {size}, 0) + 1, {size}), greatest(length(text) - {size}, 0)))) AS u(g))"""


def _with(*parts):
    return "WITH RECURSIVE " + ",\n".join(parts)


_HIST = """hist AS (
  SELECT doc_id, ch, count(*) AS n FROM (
    SELECT doc_id, unnest(string_split(text || '$', '')) AS ch FROM {src}) WHERE ch <> '' GROUP BY doc_id, ch)"""
_C = "ct AS (SELECT doc_id, ch, n, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c FROM hist)"


def _sa(name="sa", source="ref"):
    return f"""{name} AS MATERIALIZED (
  SELECT doc_id, text, sa::BIGINT AS sa, row_number() OVER (PARTITION BY doc_id ORDER BY substr(text, sa + 1)) - 1 AS row
  FROM {source}, unnest(range(length(text) + 1)) AS u(sa))"""


def _bwt(name="b", source="sa"):
    return f"{name} AS MATERIALIZED (SELECT doc_id, row, sa, CASE WHEN sa = 0 THEN '$' ELSE substr(text, sa, 1) END AS bwt FROM {source})"


_REV = "rev AS MATERIALIZED (SELECT doc_id, reverse(text) AS text FROM ref)"
_OCC = """o AS (
  SELECT b.doc_id, b.row, s.ch,
         coalesce(sum((b.bwt = s.ch)::BIGINT) OVER w, 0)::BIGINT AS occ, coalesce(sum((b.bwt < s.ch)::BIGINT) OVER w, 0)::BIGINT AS pref_occ
  FROM b, (VALUES ('$'), ('A'), ('C'), ('G'), ('T')) s(ch)
  WINDOW w AS (PARTITION BY b.doc_id, s.ch ORDER BY b.row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _candidates(k, texts="ref", patterns="p"):
    """Needs a table ``patterns`` (pattern) of distinct patterns."""
    return f"""cutup AS MATERIALIZED (SELECT pattern, (length(pattern) // {k + 1})::BIGINT AS part FROM {patterns} WHERE length(pattern) > {k}),
grams AS MATERIALIZED (
  SELECT doc_id, pos, part, substr(text, pos + 1, part) AS gram FROM {texts}, (SELECT DISTINCT part FROM cutup), unnest(range(length(text) - part + 1)) AS u(pos)),
pieces AS MATERIALIZED (SELECT pattern, part, i * part AS off, substr(pattern, i * part + 1, part) AS gram FROM cutup, unnest(range({k + 1})) AS u(i)),
starts AS MATERIALIZED (
  SELECT DISTINCT pattern, doc_id, pos - off + d AS begin FROM grams JOIN pieces USING (part, gram), unnest(range(-{k}, {k + 1})) AS u(d) WHERE pos - off + d >= 0
  UNION ALL SELECT pattern, doc_id, pos AS begin FROM {patterns}, {texts}, unnest(range(length(text))) AS u(pos) WHERE length(pattern) <= {k}),
cand AS MATERIALIZED (
  SELECT pattern, doc_id, begin, begin + len AS "end", levenshtein(substr(text, begin + 1, len), pattern)::BIGINT AS ed
  FROM starts JOIN {texts} USING (doc_id), unnest(range(greatest(length(pattern) - {k}, 1), length(pattern) + {k + 1})) AS u(len)
  WHERE begin + len <= length(text) AND levenshtein(substr(text, begin + 1, len), pattern) <= {k})"""


def _brute(k, texts="ref", patterns="p"):
    """Every interval of every text; only for few patterns."""
    return f"""cand AS MATERIALIZED (
  SELECT pattern, doc_id, begin, begin + len AS "end", levenshtein(substr(text, begin + 1, len), pattern)::BIGINT AS ed
  FROM {patterns}, {texts}, unnest(range(length(text))) AS u(begin), unnest(range(1, length(pattern) + {k + 1})) AS v(len)
  WHERE begin + len <= length(text) AND levenshtein(substr(text, begin + 1, len), pattern) <= {k})"""


_BEST = """best AS MATERIALIZED (
  SELECT pattern, doc_id, begin, "end", ed FROM (
    SELECT *, row_number() OVER (PARTITION BY pattern, doc_id, begin ORDER BY ed, "end") AS rn FROM cand) WHERE rn = 1)"""


def _kept(k):
    return f"""grouped AS (
  SELECT pattern, doc_id, "end", list({{'begin': begin, 'ed': ed}} ORDER BY begin) AS xs FROM best GROUP BY pattern, doc_id, "end"),
folded AS (
  SELECT pattern, doc_id, "end", list_reduce(xs[2:], lambda acc, x:
    CASE WHEN x.begin - acc[-1].begin > {k} THEN list_append(acc, x)
         WHEN x.ed <= acc[-1].ed THEN list_append(acc[:-2], x) ELSE acc END, [xs[1]]) AS rows FROM grouped),
kept AS MATERIALIZED (SELECT pattern, doc_id, r.begin AS begin, "end", r.ed AS ed FROM (SELECT pattern, doc_id, "end", unnest(rows) AS r FROM folded))"""


_P = "p AS MATERIALIZED (SELECT DISTINCT pattern FROM tiles)"
_MATCH = 'SELECT pattern_id, kept.doc_id, begin, "end", ed FROM kept JOIN {t} USING (pattern)'


def _canonical(k):
    return _with(DOCS, REF, _tiles("tiles", "docs", READ), _P, _candidates(k), _BEST, _kept(k)) + _MATCH.format(t="(SELECT pattern_id, pattern FROM tiles) t")


_READS = _tiles("r0", "ref", READ) + """,
r1 AS (SELECT *, pattern AS ed0, substr(pattern, 1, 5) || translate(substr(pattern, 6, 1), 'ACGT', 'CGTA') || substr(pattern, 7) AS ed1 FROM r0),
r2 AS (SELECT *, substr(ed1, 1, 14) || substr(ed1, 16) AS ed2 FROM r1),
r3 AS (SELECT *, substr(ed2, 1, 22) || translate(substr(ed2, 23, 1), 'ACGT', 'GTAC') || substr(ed2, 23) AS ed3 FROM r2),
reads AS MATERIALIZED (SELECT *, substr(ed3, 1, 32) || translate(substr(ed3, 33, 1), 'ACGT', 'TACG') || substr(ed3, 34) AS ed4 FROM r3)"""
_LONG = "SELECT doc_id, position, k::BIGINT AS k, pattern FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, position, {k} AS k, ed{k} AS pattern FROM reads" for k in range(5)) + ")"


_EXACT = """SELECT {id}, doc_id, pos::BIGINT AS begin{more} FROM (
  SELECT doc_id, pos, substr(text, pos + 1, size) AS pattern FROM {texts}, (SELECT DISTINCT length(pattern) AS size FROM {patterns}), unnest(range(length(text) - size + 1)) AS u(pos))
JOIN (SELECT {id}, pattern FROM {patterns}) USING (pattern)"""


def _read_matches(level, k, texts="ref"):
    """Matches ``m`` of the reads of one level."""
    some = f"given AS MATERIALIZED (SELECT pattern_id, ed{level} AS pattern FROM reads)"
    if k == 0:
        return some + ", m AS (" + _EXACT.format(id="pattern_id", texts=texts, patterns="given", more=', pos + length(pattern) AS "end", 0 AS ed') + ")"
    return f"""{some}, p AS MATERIALIZED (SELECT DISTINCT pattern FROM given), {_candidates(k, texts)}, {_BEST}, {_kept(k)},
m AS (SELECT pattern_id, kept.doc_id, begin, "end", ed FROM kept JOIN given USING (pattern))"""


def _recall():
    parts = []
    for k in range(5):
        parts.append(f"""SELECT * FROM ({_with(REF, _READS, _read_matches(k, k))}
SELECT {k}::BIGINT AS k, count(*) AS n_reads, sum(hit)::BIGINT AS n_matched, sum(planted)::BIGINT AS n_planted FROM (
  SELECT reads.pattern_id, max((m.doc_id IS NOT NULL)::BIGINT) AS hit,
         max(coalesce(m.doc_id = reads.doc_id AND abs(m.begin - reads.position) <= {k + 2}, false)::BIGINT) AS planted
  FROM reads LEFT JOIN m USING (pattern_id) GROUP BY reads.pattern_id))""")
    return "\nUNION ALL\n".join(parts)


def _seen(k):
    return f"""seen AS MATERIALIZED (
  SELECT reads.pattern_id, count(m.doc_id) AS n_matches,
         max(coalesce(m.doc_id = reads.doc_id AND abs(m.begin - reads.position) <= {k + 2}, false)::BIGINT) AS planted
  FROM reads LEFT JOIN m USING (pattern_id) GROUP BY reads.pattern_id)"""


def _means(level, k):
    """Parts of a query that ends in ``mean``: one row of figures of the reads of one level."""
    return (REF, _READS, _read_matches(level, k), """mean AS (
  SELECT n_reads, u / n_reads AS avg_matches, c / n_reads AS avg_candidates FROM (
    SELECT (SELECT count(*) FROM reads) AS n_reads, (SELECT count(*) FROM m) AS u, (SELECT count(*) FROM cand JOIN given USING (pattern)) AS c))""")


_NAMES = "(VALUES " + ", ".join(f"('{s}')" for s in schemes.STRATEGIES) + ") s(strategy)"


# Number of pieces, and the pieces that searches start with, for k = 1 to 4,
# written out from the published bounds.
STARTS = {
    "pigeon": ((2, (0, 1)), (3, (0, 1, 2)), (4, (0, 1, 2, 3)), (5, (0, 1, 2, 3, 4))),
    "o1star": ((3, (0, 1)), (4, (0, 1, 2)), (5, (0, 1, 2, 3)), (6, (0, 1, 2, 3, 4))),
    "kplus1": ((2, (0, 1)), (3, (0, 1, 2)), (4, (0, 1, 2, 3)), (5, (0, 1, 2, 3, 4))),
    "kplus2": ((3, (0, 1)), (4, (0, 1, 3)), (5, (0, 1, 2, 3)), (6, (0, 1, 2, 3, 4, 5))),
    "manbest": ((3, (0, 1)), (4, (0, 1, 2)), (5, (0, 1, 2, 3)), (6, (0, 1, 2, 3, 5))),
    "kianfar": ((2, (0, 1)), (3, (0, 1, 2)), (4, (0, 1, 2, 3)), (5, (0, 1, 2, 3, 4))),
}


def _scheme_seeds():
    rows = [f"('{s}', {k}, {pieces}, {i})" for s, found in STARTS.items() for k, (pieces, used) in enumerate(found, 1) for i in used]
    return _with(REF, _tiles("tiles", "ref", READ), _P) + f"""
SELECT DISTINCT strategy, k::BIGINT AS k, pattern, (i * (length(pattern) // n))::BIGINT AS "offset",
       CASE WHEN i = n - 1 THEN substr(pattern, i * (length(pattern) // n) + 1) ELSE substr(pattern, i * (length(pattern) // n) + 1, length(pattern) // n) END AS seed
FROM p, (VALUES {', '.join(rows)}) v(strategy, k, n, i) WHERE length(pattern) >= n"""


def oracle_sql():
    short = [DOCS, REF, _tiles("tiles", "docs", SHORT), _P, _sa(), "sizes AS (SELECT DISTINCT length(pattern) AS size FROM p)"]
    hits = """hit AS MATERIALIZED (SELECT pattern, doc_id, row, sa, text, size FROM p JOIN (
  SELECT *, substr(text, sa + 1, size) AS pattern FROM sa, sizes) USING (pattern))"""
    rhits = """rhit AS (SELECT pattern, doc_id, row FROM p JOIN (
  SELECT *, reverse(substr(text, sa + 1, size)) AS pattern FROM rsa, sizes) USING (pattern))"""
    lf = ("m AS (SELECT b.doc_id, row, sa, bwt, (c + row_number() OVER (PARTITION BY b.doc_id, bwt ORDER BY row) - 1)::BIGINT AS lf "
          "FROM b JOIN ct ON b.doc_id = ct.doc_id AND b.bwt = ct.ch)")
    segments = f"""seg AS MATERIALIZED (
  SELECT doc_id || ':' || (i - 1) AS doc_id, {_LETTERS.replace('coalesce(text', 'coalesce(part')} AS text FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS part, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents))"""
    raw = "raw AS (SELECT item_id AS doc_id, text FROM benchmark)"
    exact = _EXACT.format(id="pattern_id", texts="ref", patterns="tiles", more="")
    found = {
        "text_source": _with(DOCS) + "SELECT doc_id, text FROM docs",
        "alphabet": _with(DOCS, _HIST.format(src="docs")) + "SELECT ch, dense_rank() OVER (ORDER BY ch) - 1 AS idx FROM (SELECT DISTINCT ch FROM hist)",
        "char_histogram": _with(DOCS, _HIST.format(src="docs")) + "SELECT * FROM hist",
        "c_table": _with(DOCS, _HIST.format(src="docs"), _C) + "SELECT * FROM ct",
        "suffix_array": _with(REF, _sa()) + "SELECT doc_id, row, sa FROM sa",
        "suffix_array_doubling": _with(REF, _sa()) + "SELECT doc_id, row, sa FROM sa",
        "reverse_suffix_array": _with(REF, _REV, _sa(source="rev")) + "SELECT doc_id, row, sa FROM sa",
        "bwt": _with(REF, _sa(), _bwt()) + "SELECT * FROM b",
        "bwt_string": _with(REF, _sa(), _bwt()) + "SELECT doc_id, string_agg(bwt, '' ORDER BY row) AS bwt FROM b GROUP BY doc_id",
        "bwt_chunks": _with(REF, _sa(), _bwt()) + f"""
SELECT doc_id, row // {CHUNK} AS chunk, string_agg(bwt, '' ORDER BY row) AS letters FROM b GROUP BY doc_id, row // {CHUNK}""",
        "reverse_bwt": _with(REF, _REV, _sa(source="rev"), _bwt()) + "SELECT * FROM b",
        "occ": _with(REF, _sa(), _bwt(), _OCC) + "SELECT doc_id, row, ch, occ FROM o",
        "pref_occ": _with(REF, _sa(), _bwt(), _OCC) + "SELECT doc_id, row, ch, pref_occ FROM o",
        "lf_mapping": _with(REF, _sa(), _bwt(), _HIST.format(src="ref"), _C, lf) + "SELECT * FROM m",
        "sparse_sa": _with(REF, _sa()) + f"SELECT doc_id, row, sa FROM sa WHERE row % {SAMPLE} = 0",
        "sa_lookup_sparse": _with(REF, _sa()) + "SELECT doc_id, row, sa FROM sa",
        "backward_search_range": _with(*short, hits) + "SELECT pattern, doc_id, min(row) AS lo, max(row) + 1 AS hi FROM hit GROUP BY pattern, doc_id",
        "bidirectional_range": _with(*short, hits, _REV, _sa("rsa", "rev"), rhits) + """
SELECT * FROM (SELECT pattern, doc_id, min(row) AS lo, max(row) + 1 AS hi FROM hit GROUP BY pattern, doc_id)
JOIN (SELECT pattern, doc_id, min(row) AS rlo, max(row) + 1 AS rhi FROM rhit GROUP BY pattern, doc_id) USING (pattern, doc_id)""",
        "char_extensions": _with(*short, hits) + """
SELECT pattern, doc_id, side, ch, count(*) AS n FROM (
  SELECT pattern, doc_id, 'left' AS side, CASE WHEN sa = 0 THEN '$' ELSE substr(text, sa, 1) END AS ch FROM hit
  UNION ALL
  SELECT pattern, doc_id, 'right', CASE WHEN sa + size >= length(text) THEN '$' ELSE substr(text, sa + size + 1, 1) END FROM hit)
GROUP BY pattern, doc_id, side, ch""",
        "exact_match": _with(DOCS, REF, _tiles("tiles", "docs", READ)) + exact,
        "exact_match_docs": _with(raw, _tiles("tiles", "raw", 40)) + _EXACT.format(id="pattern_id", texts="documents", patterns="tiles", more=""),
        "edit_distance": _with(REF, _READS, f"long AS ({_LONG})") + """
SELECT doc_id, position, k, levenshtein(ed0, long.pattern)::BIGINT AS ed FROM long JOIN reads USING (doc_id, position)""",
        "approx_candidates": _with(DOCS, REF, _tiles("tiles", "docs", READ), _P, _candidates(2)) + "SELECT * FROM cand",
        "approx_best_per_start": _with(DOCS, REF, _tiles("tiles", "docs", READ), _P, _candidates(2), _BEST) + "SELECT * FROM best",
        "approx_k0": _with(DOCS, REF, _tiles("tiles", "docs", READ)) +
        _EXACT.format(id="pattern_id", texts="ref", patterns="tiles", more=', pos + length(pattern) AS "end", 0::BIGINT AS ed'),
        **{f"approx_canonical_k{k}": _canonical(k) for k in range(1, 5)},
        **{f"strategy_{s}": _canonical(STRATEGY_K) for s in schemes.STRATEGIES},
        **{f"strategy_{s}_k{k}": _canonical(k) for s in schemes.STRATEGIES for k in (3, 4)},
        "approx_depth_first": _canonical(STRATEGY_K),
        "approx_short_pattern": _with(REF, _tiles("tiles", "ref", READ), f"p AS MATERIALIZED (SELECT DISTINCT substr(pattern, 1, {HEAD}) AS pattern FROM tiles)",
                                      _brute(HEAD_K), _BEST, _kept(HEAD_K)) + 'SELECT pattern AS pattern_id, doc_id, begin, "end", ed FROM kept',
        "approx_tiny_pattern": _with(DOCS, REF, _tiles("tiles", "docs", 2), _P, _brute(1), _BEST, _kept(1)) +
        'SELECT pattern AS pattern_id, doc_id, begin, "end", ed FROM kept',
        "approx_segments": _with(segments, REF, _tiles("tiles", "ref", READ), _P, _candidates(1, texts="seg"), _BEST, _kept(1)) +
        _MATCH.format(t="(SELECT pattern_id, pattern FROM tiles) t"),
        "pattern_pieces": _with(DOCS, _tiles("tiles", "docs", READ), _P) + """
SELECT pattern, i::BIGINT AS piece, (i * (length(pattern) // 3))::BIGINT AS "offset",
       CASE WHEN i = 2 THEN substr(pattern, i * (length(pattern) // 3) + 1) ELSE substr(pattern, i * (length(pattern) // 3) + 1, length(pattern) // 3) END AS seed
FROM p, unnest(range(3)) AS u(i)""",
        "scheme_seeds": _scheme_seeds(),
        "reads_long": _with(REF, _READS) + _LONG,
        "match_report": _with(REF, _READS, _read_matches(1, 2)) + """
SELECT pattern_id, m.doc_id, begin, ed, substr(text, begin + 1, "end" - begin) AS matched FROM m JOIN ref USING (doc_id)""",
        "planted_recall": _recall(),
        "strategy_metrics": _with(*_means(0, STRATEGY_K)) + f" SELECT strategy, n_reads, avg_matches, avg_candidates FROM {_NAMES}, mean",
        "strategy_report": _with(*_means(STRATEGY_K, STRATEGY_K), _seen(STRATEGY_K)) + f"""
SELECT strategy, {STRATEGY_K}::BIGINT AS k, n_reads, n_matched, n_planted, avg_matches, avg_candidates FROM {_NAMES}, mean,
  (SELECT sum((n_matches > 0)::BIGINT)::BIGINT AS n_matched, sum(planted)::BIGINT AS n_planted FROM seen)""",
        "missed_reads": _with(REF, _READS, _read_matches(STRATEGY_K + 1, STRATEGY_K), _seen(STRATEGY_K)) + """
SELECT pattern_id, CASE WHEN n_matches = 0 THEN 'none' ELSE 'elsewhere' END AS reason, n_matches, n_matches AS n_exhaustive FROM seen WHERE planted = 0""",
        "match_text_files": _with(REF, _READS, _read_matches(1, STRATEGY_K)) + "SELECT * FROM m",
        "own_scheme_match": _with(REF, _READS, _read_matches(2, STRATEGY_K)) + "SELECT * FROM m",
        "match_stored_index": _with(DOCS, REF, _READS, _read_matches(1, STRATEGY_K, "docs")) + "SELECT * FROM m",
    }
    return {name: sql.replace(")SELECT", ")\nSELECT") for name, sql in found.items()}
