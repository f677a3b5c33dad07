"""The n-gram Jaccard join against comparing all pairs."""

import random

import numpy as np
import pytest

from huewright.llm import jaccard

from . import brute


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def edited(rng, text, k):
    out = list(text)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


def family_rows(seed):
    """Families of near copies: one large with few to many edits, small ones, copies, short and empty texts."""
    rng, rows = random.Random(seed), []
    base = words(rng, 120)
    for _ in range(90):
        rows.append(edited(rng, base, rng.randrange(0, 9)))
    for n in (2, 4, 5, 7, 9, 12, 20, 35, 60, 200, 400):
        for _ in range(3):
            text = words(rng, n)
            rows += [text, text, edited(rng, text, 1), edited(rng, text, max(1, n // 60)), edited(rng, text, max(1, n // 25)), text[: n - max(1, n // 12)]]
    line = words(rng, 15)
    rows += [line + words(rng, rng.randrange(3, 40)) for _ in range(60)]
    texts = [" ".join(r) for r in rows] + ["", None, " \n", "a", "A", "a b", "The THE the the the the the the"]
    rng.shuffle(texts)
    return list(enumerate(texts, 3))


@pytest.mark.parametrize(("seed", "n", "percent", "small", "more"), [(1, 4, 85, 40, {}), (2, 4, 85, 6, {}), (3, 5, 80, 6, {"broadcast_limit": 0, "bucket_keys": 900}), (4, 3, 70, 3, {})])
def test_link(spark, seed, n, percent, small, more):
    rows = family_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs, n=n, percent=percent, small=small, **more).collect()}
    assert got == brute.jaccard(rows, n, percent)


def test_odd_rows(spark):
    schema = "doc_id long, text string, name long, key long, n int"
    docs = spark.createDataFrame([(1, "a b c d e", 0, 0, 0), (1, "a b c d e", 0, 0, 0), (None, "a b c d e", 0, 0, 0), (2, "A B C D E", 0, 0, 0), (3, None, 0, 0, 0), (4, "", 0, 0, 0)], schema)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(docs).collect()), key=repr)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (None, 1, None), (2, 1, 1), (3, 0, 3), (4, 0, 4)], key=repr)
    assert jaccard.link(docs.limit(0)).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 1, None, 3, 4], key=repr)


def test_link_real(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs, n=4, percent=85).collect()}
    assert got == brute.jaccard(rows, 4, 85)
    assert sum(c != i for i, (_, c) in got.items()) > 3


def test_sketch_never_shows_too_many():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(0, 400, 300).astype(np.uint64) * np.uint64(7919))
        b = np.unique(rng.integers(0, 400, 300).astype(np.uint64) * np.uint64(7919))
        shown = sum(int(x).bit_count() for x in (jaccard.sketch(a) ^ jaccard.sketch(b)).view(np.uint64))
        assert shown <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)]
    root = {i: i for e in edges for i in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r.name: r.label for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}


def test_united(spark):
    """Further links join the components that they touch, names without links before included; the others stay."""
    rng = random.Random(9)
    first = [(k, k + 1) for k in range(50, 70)] + [(rng.randrange(30), rng.randrange(30)) for _ in range(12)]
    further = [(rng.randrange(48), rng.randrange(48)) for _ in range(10)] + [(200, 201), (60, 201)]
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    got = {r.name: r.label for r in jaccard._united(jaccard.components(frame(first)), frame(further)).collect()}
    want = {r.name: r.label for r in jaccard.components(frame(first + further)).collect()}
    loops = {a for a, b in further if a == b}  # a link to itself names nothing new
    assert {k: v for k, v in got.items()} == {k: v for k, v in want.items() if k in got} and want.keys() - got.keys() <= loops


def test_link_very_long_texts(spark):
    """1.4 million different words: the segments that such a set can spare pass 16 bits."""
    text = "concat_ws(' ', transform(sequence(1, 1400000), k -> concat('w', k)))"
    docs = spark.sql(f"select 1L as doc_id, {text} as text union all select 2L, concat({text}, ' more') union all select 3L, 'a b c d e f'")
    got = sorted(tuple(r) for r in jaccard.link(docs).collect())
    assert got == [(1, 1399996, 1), (2, 1399997, 1), (3, 2, 3)]
