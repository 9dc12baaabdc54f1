"""Every stage on what its predecessor keeps, and the whole."""

from collections import Counter

import corpus_pipeline
import pytest
from datewright.llm import exact_dedup, near_dedup


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The input and output of each stage, by name."""
    out, docs = {}, spark.read.parquet(f"{sf}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, sf).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_columns(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert before.columns == after.columns, name


def test_filters(stages):
    before, after = stages["language_id"]
    assert after.count() == before.count()  # all documents there have letters
    before, after = stages["exact_dedup"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in exact_dedup.exact_dedup(before).collect() if r.kept}
    before, after = stages["near_dedup"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in near_dedup.near_duplicates(before).collect() if r.kept}


def test_mix_takes_effect(stages):
    before, after = stages["mixing"]
    sizes = Counter(r.doc_id for r in after.collect())
    assert max(sizes.values()) <= 3 and sum(sizes.values()) > 0.5 * before.count()


def test_pack_has_every_token(stages):
    before, pieces = stages["packing"]
    own = Counter(r.doc_id for r in before.collect())
    totals = Counter()
    tokens = {}
    for p in pieces.collect():
        totals[p.doc_id] += p.length
        tokens[p.doc_id] = p.doc_tokens
    assert totals == {i: n * tokens[i] for i, n in own.items()}


def test_run_equals_its_stages(spark, sf, stages):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, corpus_pipeline.run(spark, sf).collect())) == Counter(map(key, stages["packing"][1].collect()))


def test_stages_take_odd_rows(spark, odd, tmp_path):
    docs = odd.toDF("doc_id", "text", "lang", "source", "kept", "size", "sha", "h", "other")  # Parquet can't hold text and TEXT
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, "").write.parquet(str(tmp_path / f"{i}"))
        docs = spark.read.parquet(str(tmp_path / f"{i}"))
    assert docs.count() > 0
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, odd.limit(0), "").collect() == [], name


