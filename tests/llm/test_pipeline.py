"""The pipeline and the contract columns of queries without SQL, against plain versions."""

import hashlib
import os
import struct
from collections import Counter

import pytest
from test_operators import ODD, documents, library, plain_components, plain_set, plain_spans

import corpus_pipeline
from terrier.llm import bpe, mixing, queries

FOLDER = os.environ.get("TERRIER_TEST_DATA", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables not present")


@pytest.fixture(scope="module")
def given(spark):
    return {r.doc_id: r for r in queries.documents(spark, FOLDER).collect()}


@needs_tables
def test_pipeline_stage_by_stage(spark, given):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, docs, FOLDER).cache()
    assert good.columns == docs.columns
    labels = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert not any(labels[i].toxic for i in kept if i in labels)
    clean = [i for i, r in labels.items() if r.quality == 1 and not r.toxic]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)
    last = {}
    for i in sorted(kept):
        last[given[i].text or ""] = i
    single = sorted(last.values())
    assert sorted(r.doc_id for r in stages["exact_dedup"](spark, good, FOLDER).collect()) == single
    roots = plain_components({i: plain_set(given[i].text) for i in single})
    stay = sorted(i for i in single if roots[i] == i)
    few = docs.filter(docs.doc_id.isin(single))
    assert sorted(r.doc_id for r in stages["near_dedup"](spark, few, FOLDER).collect()) == stay
    # the mix has its own test; here its decision must take effect
    left = docs.filter(docs.doc_id.isin(stay))
    times = {r.doc_id: r.times for r in mixing.mix(left).collect()}
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert got == Counter({i: n for i, n in times.items() if n})
    lib = library()
    for row in stages["bpe"](spark, left, FOLDER).collect():
        ids = lib.encode(given[row.doc_id].text or "", add_special_tokens=False).ids
        assert row.ids == struct.pack(f"<{len(ids)}I", *ids) and row.n_tokens == len(ids)


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (ODD, []):
        docs = documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() >= 0 and (name == "bpe" or out.columns == docs.columns)


@needs_tables
def test_contract_of_encoding(spark, given):
    lib = library()
    rows = queries.op1_bpe(spark, FOLDER).collect()
    assert len(rows) == len(given)
    for row in rows:
        ids = lib.encode(given[row.doc_id].text or "", add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert os.path.exists(bpe.vocabulary_path())


@needs_tables
def test_contract_of_secrets(spark, given):
    for row in queries.op9_secrets(spark, FOLDER).collect():
        spans = plain_spans(given[row.doc_id].text or "")
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
        assert row.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
        assert set(filter(None, said.split(","))) <= set(row.spans.split(","))
