"""The filter audit against applying the filters one after the other."""

from itertools import permutations
from math import factorial

import numpy as np
import pytest

from huewright.llm import filter_audit


def failures(text, copy):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    capitals = sum("A" <= c <= "Z" for c in text or "")
    found = {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * capitals > 2 * len(text or ""),
        "D": any(c in "#$%&*|" for c in text or ""),
        "E": copy,
    }
    return {f for f, x in found.items() if x}


def brute(rows, labels):
    """Rows (doc_id, text, source) through every order, document by document."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    judged = []
    for i, text, source in rows:
        copy = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in rows)
        judged.append((source or "", failures(text, copy), i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part in {x[0] for x in judged}:
        mine = [x for x in judged if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                before = [x for x in mine if f in x[1] and x[1] & set(order[:k])]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(before), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone), f]
        for key in [x for x in out if x[0] == part]:
            out[key][-1] = shapley[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("n", range(6))
def test_swaps_lead_through_all_orders(n):
    order = list(range(n))
    seen = {tuple(order)}
    for i in filter_audit.swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.add(tuple(order))
    assert len(seen) == factorial(n) == sum(1 for _ in filter_audit.swaps(n)) + 1


def test_audit(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        n = int(rng.choice([3, 150, 199, 200, 260]))
        vocabulary = int(rng.choice([40, 100, 5000]))
        words = [f"w{x}" for x in rng.integers(0, vocabulary, n)]
        if rng.random() < 0.3:
            words += ["ABCDEFGHIJKLMNOP"] * 3
        if rng.random() < 0.2:
            words[0] += str(rng.choice(list("#$%&*|")))
        rows.append((i, " ".join(words), str(rng.choice(["web", "news", ""]))))
    rows += [(200 + k, rows[k][1], "web") for k in range(0, 60, 3)] + [(5, rows[40][1], "news"), rows[7], rows[7]]
    rows += [(None, rows[3][1], "web"), (None, None, None), (300, None, None), (301, "", "x"), (302, " \n\t", "x"), (303, "é" * 300 + "A" * 6, None), (304, "w " * 300_000 + "end", "long")]
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 310, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, 1), (9999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as mask", "2 as part", "3 as n", "4 as rows").repartition(3)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    measured = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert got.columns == ["part", "filter_order", "step", *measured]
    rows_ = got.collect()
    assert len(rows_) == 600 * len({r[2] or "" for r in rows})
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in measured) for r in rows_} == brute(rows, labels)
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
    none = filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.agg({"good_lost": "sum"}).first()[0] == 0
