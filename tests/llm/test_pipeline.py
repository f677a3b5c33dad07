"""The pipeline's stages against the operators' own results and brute force."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from huewright.llm import mixing, toxicity

from . import brute


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, small).cache()
        docs.count()
        out.append(docs)
    return out


def test_columns(stages):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_toxic_documents_go(spark, small, stages):
    found = toxicity.toxicity(stages[0], spark.read.parquet(f"{small}/labels.parquet"))
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in found.where("predicted = 0").collect()}


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert {r.doc_id for r in stages[2].collect()} == {i for i, (_, c) in brute.jaccard(rows, 5, 80).items() if i == c}


def test_contaminated_documents_go(spark, small, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = {r.doc_id for r in stages[2].collect() if not brute.contamination(r.text, items)[-1]}
    assert {r.doc_id for r in stages[3].collect()} == want and len(want) < stages[2].count()


def test_secrets_are_masked(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    after = {r.doc_id: r for r in stages[4].collect()}
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert not brute.base_secrets(r.text)[1] and r.n_chars == len(r.text)
        if not brute.base_secrets(before[i].text)[1]:
            assert r.text == before[i].text


def test_mix(stages):
    """Each row as often as the mix takes it."""
    taken = {r.doc_id: r.copies for r in mixing.mix(stages[4]).collect()}
    rows = Counter((r.doc_id, r.text) for r in stages[5].collect())
    assert rows == {(r.doc_id, r.text): taken[r.doc_id] for r in stages[4].collect() if taken[r.doc_id]}
    assert max(rows.values()) <= 3 and len(rows) < len(taken) and stages[5].columns == stages[0].columns


ODD = [(1, "a b c d e f", "en", "web", 11), (1, "a b c d e f", "en", "web", 11), (None, "x y z", None, None, None), (None, None, "en", "web", 0), (2, "", "en", "web", 0), (3, "password = hunter2hunter " * 3, "en", "forum", 75), (4, "w " * 1_000_000 + "end", "en", "forum", 2_000_003)]
CLASHES = ["__id", "__blob", "__found", "__content", "__hit", "__ids", "_id", "_blob", "_findings", "copies", "digest", "n", "name"]


@pytest.mark.parametrize("nth", range(5))
def test_odd_rows(spark, small, nth):
    """Nulls, an empty and a very long text, repeated rows, clashing columns and an empty table through each stage."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit("kept"))
    got = corpus_pipeline.STAGES[nth][1](spark, docs, small)
    rows = got.collect()
    assert got.columns == docs.columns and all(r["__id"] == r["copies"] == "kept" for r in rows)
    if nth < 4:
        assert len(rows) == len(ODD) and Counter(r.doc_id for r in rows) == Counter(r[0] for r in ODD)
    if nth == 3:
        assert [r.text for r in rows if r.doc_id == 3] == ["[ASSIGN] " * 3]
    if nth == 4:
        assert sum(r.source == "web" and r.doc_id == 1 for r in rows) == 6 and sum(r.source == "forum" for r in rows) <= 3
    assert corpus_pipeline.STAGES[nth][1](spark, docs.limit(0), small).collect() == []


def test_run_is_the_stages(spark, small, stages):
    assert corpus_pipeline.run(spark, small).exceptAll(stages[5]).count() == 0


def test_drop_contaminated_in_blocks(spark, small, stages):
    from huewright.llm import decontaminate

    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    few = decontaminate.drop_contaminated(stages[2].withColumn("hit", F.lit(1)), bench, max_block_bytes=900)
    assert {r.doc_id for r in few.collect()} == {r.doc_id for r in stages[3].collect()}
