"""The pipeline: each stage on what the last one kept, against plain restatements."""

import hashlib
import re

import pytest

import __spark_entry__ as entry
from seqloom.llm import mixing, toxicity

from ..conftest import SF
from .test_operators import ODD, SCHEMA, az, brute_components, reference_tokenizer, sha, unchanged, with_clashes

pipeline = pytest.importorskip("corpus_pipeline")


def plain_score(text, model):
    found = toxicity.text_features(text, model["identity"])
    return model["bias"] + sum(w for f, w in model["weights"].items() if f in found)


def plain_mix(rows):
    """The documents that the mix takes, from the contract of targets and the hash places."""
    size = {i: len([w for w in re.split(r"[\x20\x09-\x0D]+", r.text or "") if w]) for i, r in enumerate(rows)}
    key = lambda r: (r.source is None, r.source or "")
    names = sorted({key(r) for r in rows})
    whole = {n: sum(size[i] for i, r in enumerate(rows) if key(r) == n) for n in names}
    weight = {n: mixing.WEIGHTS[k % 3] for k, n in enumerate(names)}
    full, target = set(), {}
    while True:
        left, w = sum(whole.values()) - sum(3 * whole[n] for n in full), sum(weight[n] for n in names if n not in full)
        target = {n: 3 * whole[n] if n in full else left * weight[n] / w for n in names}
        above = {n for n in names if target[n] > 3 * whole[n]} - full
        if not above:
            break
        full |= above
    place = {i: hashlib.md5(str(r.doc_id).encode()).hexdigest()[:6] for i, r in enumerate(rows)}
    times = {}
    for n in names:
        mine = [i for i, r in enumerate(rows) if key(r) == n]
        copies = int(target[n] // whole[n]) if whole[n] else 0
        lacking = int(target[n]) - copies * whole[n]
        extra, most = set(), 2**62
        for _ in range(mixing.ROUNDS):
            able = [i for i in mine if 0 < size[i] <= most and i not in extra]
            cut, total = "g", 0
            for p in sorted({place[i] for i in able}):
                here = sum(size[i] for i in able if place[i] == p)
                if total + here > lacking:
                    cut = p
                    break
                total += here
            if lacking > 0:
                extra |= {i for i in able if place[i] < cut}
                lacking -= total
            most = lacking
        times |= {i: copies + (i in extra) for i in mine}
    return sorted(rows[i].doc_id for i, n in times.items() for _ in range(n if size[i] else n))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.collect()
    kept = {}
    for n, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        new = spark.read.parquet(str(tmp_path / name))
        if n < len(pipeline.STAGES) - 1:
            assert new.dtypes == docs.dtypes
        kept[name] = new.collect()
        docs = new
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), toxicity.learnable(spark.read.parquet(f"{SF}/labels.parquet")))
    assert sorted(r.doc_id for r in first if plain_score(r.text, model) < 0) == sorted(r.doc_id for r in kept["toxicity"])
    texts = {}
    for r in kept["toxicity"]:
        texts.setdefault(az(r.text), []).append(r.doc_id)
    assert sorted(max(v) for v in texts.values()) == sorted(r.doc_id for r in kept["exact_dedup"])
    part = brute_components({r.doc_id: r.text for r in kept["exact_dedup"]})
    assert sorted(i for i, (_, c) in part.items() if c == i) == sorted(r.doc_id for r in kept["near_dedup"])
    assert plain_mix(kept["near_dedup"]) == sorted(r.doc_id for r in kept["mixing"])
    t = reference_tokenizer()
    want = []
    for r in kept["mixing"]:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in kept["bpe"]) == sorted(want)


def test_run_equals_its_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    got = entry.queries()["pipeline"](spark, SF)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str) != []


def test_odd_rows(spark):
    """What stays of nulls, empty texts, ties and repeated rows, stage by stage."""
    left = []
    for rows in (ODD, []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, stage in pipeline.STAGES:
            docs = stage(spark, docs, SF)
            left.append(sorted((r.doc_id for r in docs.collect()), key=str))
    # No labelled text of these is of both kinds, so nothing is toxic; of the two empty
    # texts and the four equal ones the largest id stays; texts without words aren't taken.
    assert left[0] == sorted((r[0] for r in ODD), key=str) and left[1] == [2, 4, 5, 6, 7, 8] == left[2]
    assert left[3] == left[4] and set(left[3]) <= {4, 5, 6, 7, 8} and left[5:] == [[]] * 5


def test_stages_with_clashing_columns(spark, tmp_path):
    """Columns named like those of a stage's own tables come through unchanged."""
    docs = with_clashes(spark.read.parquet(f"{SF}/documents.parquet"))
    before = docs.columns[:5]
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        assert rows and unchanged(docs, rows, before)
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)
