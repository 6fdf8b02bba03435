"""Each stage of the pipeline on its own input, against brute force; whole runs agree."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quillmark.llm import frames, mixing, toxicity

from .test_dedup import kept_of
from .test_rest import best_window
from .test_tokens import word_bpe  # noqa: F401

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = frames.table(spark, AT, "documents"), []
    for name, stage in cp.STAGES:
        got = frames.materialize(stage(spark, docs, AT), f"test-{name}")
        out.append((name, docs, got))
        docs = got
    return {name: (a, b) for name, a, b in out}


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


def test_names_and_columns(spark, stages):
    assert list(stages) == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "token_ids"]
    columns = frames.table(spark, AT, "documents").columns
    assert all(b.columns == columns for name, (_, b) in stages.items() if name != "token_ids")


def test_toxic_documents_go(spark, stages):
    a, b = stages["toxicity"]
    labels = frames.table(spark, AT, "labels")
    bad = {r.doc_id for r in toxicity.score(a, toxicity.fit(a, labels)).filter("predicted = 1").collect()}
    assert rows(b) == [r for r in rows(a) if r[0] not in bad]


def test_one_of_each_group_stays(stages):
    a, b = stages["simhash_near_dedup"]
    keep = set(kept_of(rows(a)))
    assert rows(b) == [r for r in rows(a) if r[0] in keep] and len(rows(b)) < len(rows(a))


def test_leaks_go(spark, stages):
    a, b = stages["decontamination"]
    items = [r.text for r in frames.table(spark, AT, "benchmark").collect()]
    low = [(x, set(re.findall(r"\w{4,}", x.lower()))) for x in items]
    leaked = lambda t: any(len(w & set(re.findall(r"\w{4,}", t.lower()))) >= 0.7 * len(w) and best_window(t, x) >= 0.8 for x, w in low)
    assert rows(b) == [r for r in rows(a) if not leaked(r[1])] and len(rows(b)) < len(rows(a))


def test_mix_meets_its_targets(spark, stages):
    a, b = stages["mixing"]
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, taken = Counter(), Counter()
    for r in a.collect():
        size[r.source] += n(r.text)
    for r in b.collect():
        taken[r.source] += n(r.text)
    sizes = spark.createDataFrame([("0" + s, k) for s, k in size.items()], "skey string, source_size long")
    for r in mixing.targets(sizes, mixing.Curriculum()).collect():
        assert taken[r.skey[1:]] == round(r.target)


def test_ids(stages, word_bpe):  # noqa: F811
    a, b = stages["token_ids"]
    want = []
    for i, t in rows(a):
        ids = word_bpe.encode(t, add_special_tokens=False).ids + [1]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = b.collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)


def test_run(spark, stages):
    assert cp.run(spark, AT).count() == stages["token_ids"][1].count() and cp.ORACLE_SQL is None


def through(spark, d):
    """Rows after each stage of a small table."""
    out = []
    for name, stage in cp.STAGES:
        d = frames.materialize(stage(spark, d, AT), f"edge-{name}")
        out.append((name, d))
    return out


def test_stages_on_odd_rows_and_columns(spark, docs, odd, none):
    """Nulls, blanks, repeated rows, long texts, other scripts; columns whose names the operators use; an empty table."""
    plain, clash = through(spark, docs), through(spark, odd.withColumn("key", F.lit("own")).withColumn("label", F.lit("own")).withColumn("text_", F.lit("own")).withColumn("doc", F.lit(1)))
    for (name, a), (_, b) in zip(plain, clash):
        if name != "token_ids":
            assert a.columns == docs.columns and set(odd.columns) <= set(b.columns)
            assert rows(a) == rows(b)
            assert b.filter("size <> 'own' or root <> 'own' or row <> 'own'").count() == 0
        else:
            assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    kept = dict(plain)["simhash_near_dedup"]
    texts = [t for _, t in rows(kept)]
    assert len(texts) == len(kept_of(rows(dict(plain)["toxicity"]))) and sum(not (t or "").strip() for t in texts) == 1
    for name, d in through(spark, none):
        assert d.count() == 0, name


def test_every_doc_id_null(spark, docs):
    d = docs.withColumn("doc_id", F.lit(None).cast("long"))
    for name, out in through(spark, d):
        assert out.count() > 0, name
