"""The pipeline's stages against plain versions of their own, each on its stage's input."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import quality, queries

SF = "/root/testdata/sf0.001"
GOOD, SINGLE, CLEAN, MIXED, SHARDED = (f for _, f in corpus_pipeline.STAGES)


def _ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def _texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def _score(net, text):
    """One text's probability, place by place, with all filters at once."""
    raw = np.frombuffer(text.encode() + bytes(quality.WIDTH - 1), np.uint8)
    n, logit = len(raw) - quality.WIDTH + 1, 0.0
    for a in range(0, n, quality.CHUNK):
        stop = min(n, a + quality.CHUNK)
        z = sum(net.table[k].astype(float)[raw[a + k : stop + k]] for k in range(quality.WIDTH))
        logit += (stop - a) / n * float(np.maximum(z.max(axis=0) + net.bias, 0) @ net.weight)
    return 1 / (1 + math.exp(-(logit + net.offset)))


def _smallest_of_groups(texts):
    """doc_ids that stay: the smallest of each group closed over likeness 0.8 or more of the five-word shingle sets."""
    sets = {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if (not x and not y) or (x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted({find(d) for d in ids})


def _leaked(texts, items):
    words = lambda s: re.findall(r"[^\W_]+", s.lower())
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    bodies = {d: words(t) for d, t in texts.items()}
    out = set()
    for text in items:
        w = words(text or "")
        q = grams(w, min(5, len(w))) if w else set()
        out |= {d for d, b in bodies.items() if q and len(q & grams(b, min(5, len(w)))) >= math.ceil(0.8 * len(q) - 1e-9)}
    return out


@pytest.fixture(scope="module")
def stages(spark):
    """Input of each stage, and the last stage's output."""
    inputs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        inputs.append(stage(spark, inputs[-1], SF).cache())
    return inputs


def test_quality_stage(spark, stages):
    docs, kept = stages[:2]
    net = quality.train_on(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {d: _score(net, t) for d, t in _texts(docs).items()}
    sure = {d for d, s in scores.items() if abs(s - 0.7) > 1e-4}
    assert kept.columns == docs.columns and set(_ids(kept)) & sure == {d for d in sure if scores[d] >= 0.7}


def test_near_dedup_stage(stages):
    docs, kept = stages[1:3]
    assert kept.columns == docs.columns and _ids(kept) == sorted(_smallest_of_groups(_texts(docs)), key=str)


def test_decontamination_stage(spark, stages):
    docs, kept = stages[2:4]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = _leaked(_texts(docs), items)
    assert gone and kept.columns == docs.columns and _ids(kept) == sorted((d for d in _texts(docs) if d not in gone), key=str)


def test_mixing_stage(stages):
    """Words of each source come near its target, weights 5, 2, 1 and at most twice its words, and no document exceeds twice itself."""
    docs, mixed = stages[3:5]
    rows = [(r.doc_id, len((r.text or "").encode().split()), r.source) for r in docs.collect()]
    times = collections.Counter(r.doc_id for r in mixed.collect())
    size, got, most = collections.Counter(), collections.Counter(), collections.Counter()
    for d, n, s in rows:
        size[s] += n
        got[s] += n * times[d]
        most[s] = max(most[s], n)
        assert times[d] <= 2 and (n or times[d] == 1)
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = dict(zip(names, [5, 2, 1] * len(names)))
    target, left, open_ = {}, 1.5 * sum(size.values()), list(names)
    while open_:
        each = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = [s for s in open_ if each[s] > 2 * size[s]]
        target |= {s: 2 * size[s] for s in full} or each
        left, open_ = left - sum(2 * size[s] for s in full), [s for s in open_ if s not in full] if full else []
    assert mixed.columns == docs.columns and set(times) <= {d for d, _, _ in rows}
    assert all(abs(got[s] - target[s]) <= most[s] for s in names)  # rounded to whole documents at two ends


def test_sharding_stage(stages):
    docs, sharded = stages[4:]
    assert sharded.columns == [*docs.columns, "shard"] and _ids(sharded) == _ids(docs)
    load, of = collections.Counter({s: 0 for s in range(24)}), collections.defaultdict(set)
    for r in sharded.collect():
        load[r.shard] += len((r.text or "").encode()) + 8
        of[r.text].add(r.shard)
    copies = collections.Counter(r.text for r in docs.collect())
    share = sum(load.values()) / 24
    heavy = max(n * (len(t.encode()) + 8) for t, n in copies.items())
    assert len(load) == 24 and max(load.values()) <= share + heavy and min(load.values()) >= share - heavy


@pytest.mark.parametrize("name", ["edge", "nothing"])
def test_stages_on_odd_tables(name, request, spark):
    """Nulls in every column, blank, equal and repeated rows, extra columns that clash, an empty table."""
    docs = request.getfixturevalue(name)
    clash = docs.withColumns({"shard": F.lit("x"), "score": F.lit("y"), "taken": F.lit("z"), "component_id": F.lit(1), "class": F.lit(2), "node": F.lit(3), "row": F.lit(4), "words": F.lit(5)})
    for stage in (GOOD, SINGLE, CLEAN, MIXED):
        assert stage(spark, clash, SF).columns == clash.columns
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    single = SINGLE(spark, clash, SF)
    known = {}
    for d, t in texts:
        if d is not None:
            known[d] = t or ""  # ids repeat with equal texts only
    want = collections.Counter([*_smallest_of_groups(known), *[d for d, _ in texts if d is None]])
    assert collections.Counter(r.doc_id for r in single.collect()) == want
    clean = CLEAN(spark, clash, SF)
    assert _ids(clean) == _ids(docs)  # no benchmark item in them
    sharded = SHARDED(spark, clash, SF)
    assert sharded.columns == [*[c for c in clash.columns if c != "shard"], "shard"] and _ids(sharded) == _ids(docs)
    assert GOOD(spark, clash, SF).count() <= docs.count() and MIXED(spark, clash, SF).count() <= 2 * docs.count()


def test_run_and_registration(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.where(F.col("text").isNull()).count() == 0
    assert len(queries.queries()) == 11 and set(queries.oracle_sql()) <= set(queries.queries()) and corpus_pipeline.ORACLE_SQL is None
