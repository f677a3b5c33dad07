"""Added kinds of secrets, verdicts on repetition and the slope of the noisy-or, each against its definition."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from huewright.llm import repetition, secrets, toxicity

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def plain_spans(text):
    """(kind, start, end) of the added kinds but private keys, by patterns over characters."""
    word = "[A-Za-z0-9_]"
    kinds = {
        "github": rf"(?<!{word})gh[opsur]_[A-Za-z0-9]{{36,}}",
        "slack": rf"(?<!{word})xox[abprs]-[A-Za-z0-9-]{{10,}}",
        "jwt": rf"(?<!{word})eyJ[A-Za-z0-9_-]{{8,}}\.eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}",
        "url_password": rf"(?<!{word})[a-z][a-z0-9+.-]{{1,20}}://[^ \t\n\r\f\v:@/]+:[^ \t\n\r\f\v:@/]{{4,}}@",
    }
    return sorted((k, *m.span()) for k, p in kinds.items() for m in re.finditer(p, text))


def test_added_kinds_of_secrets():
    rng = np.random.default_rng(4)
    some = lambda n: "".join(LETTERS[k] for k in rng.integers(0, len(LETTERS), n))
    makers = (
        lambda: f"gh{'opsurx'[rng.integers(0, 6)]}_{some(int(rng.integers(34, 40)))}",
        lambda: f"xox{'abprsz'[rng.integers(0, 6)]}-{some(int(rng.integers(8, 14)))}-{some(3)}",
        lambda: f"eyJ{some(int(rng.integers(6, 12)))}.eyJ{some(int(rng.integers(6, 12)))}.{some(int(rng.integers(6, 12)))}",
        lambda: f"https://{some(4).lower()}:{some(int(rng.integers(2, 70)))}@host.example",
        lambda: "é " + some(3),
    )
    found = set()
    for _ in range(300):
        text = rng.choice([" ", "\n", "é", "x", ", "]).join(makers[rng.integers(0, len(makers))]() for _ in range(4))
        got = [f for f in secrets.find(text.encode()) if f[0] in ("github", "slack", "jwt", "url_password")]
        assert sorted(got) == plain_spans(text), text
        assert got == sorted(got, key=lambda f: (f[1], secrets.KINDS.index(f[0]), f[2]))
        found |= {f[0] for f in got}
    assert found == {"github", "slack", "jwt", "url_password"}


def plain_repetition(text, least):
    """(longest repeat in words, share of characters in repeats of `least` words or more) by comparing all pairs of places."""
    words = text.split()
    longest, spans = 0, set()
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            n = 0
            while j + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            longest = max(longest, n)
            if n >= least:
                spans |= {*range(i, i + n), *range(j, j + n)}
    return longest, sum(len(words[k]) for k in spans) / sum(map(len, words))


def test_verdicts_on_repetition(spark):
    rng = np.random.default_rng(7)
    texts = []
    for k in range(60):
        words = [f"{'é' * (w % 3)}w{w}" for w in rng.integers(0, [3, 30, 4000][k % 3], int(rng.integers(20, 90)))]
        run = words[: int(rng.integers(3, 18))]
        texts.append(" ".join(words + run * int(rng.integers(0, 4))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    limits = {"least": 5, "max_fraction": 0.4, "max_longest": 12}
    verdicts = set()
    for r in repetition.repetition(docs, **limits).collect():
        longest, share = plain_repetition(texts[r.doc_id], 5)
        assert r.longest_repeat == longest and r.repeat_fraction == pytest.approx(share)
        assert r.kept == (not r.base_failed and share <= 0.4 and longest <= 12)
        verdicts.add((r.base_failed, r.kept))
    assert verdicts == {(True, False), (False, True), (False, False)}


def test_repetition_in_very_long_texts(spark):
    docs = spark.sql("select 1L as doc_id, repeat('a b ', 300000) as text union all select 2L, concat_ws(' ', transform(sequence(1, 500000), k -> concat('w', k)))")
    got = {r.doc_id: r for r in repetition.repetition(docs).collect()}
    assert (got[1].n_words, got[1].longest_repeat, got[1].kept) == (600_000, 599_998, False)
    assert (got[2].n_words, got[2].longest_repeat, got[2].kept) == (500_000, 0, True)


def test_slope_of_the_noisy_or(monkeypatch):
    """One step of the climb goes along the slope of the documents' likelihood, found by differences."""
    bags = pa.table({"label": pa.array([1, 0, 1, 0], pa.int32()), "weight": [1.0, 2.0, 0.5, 1.0], "plain": pa.array([1, 0, 2, 1], pa.int32()), "bags": pa.array([[[0, 1], [2]], [[1]], [[0, 0, 2]], []], pa.list_(pa.list_(pa.int32())))})

    def loss(x):
        total, weight = 0.0, np.array([1.0, 2.0, 0.5, 1.0])
        for y, w, plain, bag in zip((1, 0, 1, 0), weight / weight.sum() * 4, (1, 0, 2, 1), bags["bags"].to_pylist(), strict=True):
            a = sum(math.log1p(math.exp(x[-1] + sum(x[f] for f in s))) for s in bag) + plain * math.log1p(math.exp(x[-1])) + 1e-9
            total += w * (-math.log(-math.expm1(-a)) if y else a) / 4
        return total + 1.0 / 4 * sum(v * v for v in x[:-1]) / 2

    start = np.array([0.0, 0.0, 0.0, -6.0])
    slope = [(loss(start + h) - loss(start - h)) / 2e-6 for h in np.eye(4) * 1e-6]
    one = toxicity._climb(bags, [b"a", b"b", b"c"], 1, 1.0)
    moved = np.array([*one.weights.values(), one.bias]) - start
    # Adam's first step has the length of its rate against the slope's sign.
    assert np.allclose(moved, -0.15 * np.sign(slope), atol=1e-4)
    near = toxicity._climb(bags, [b"a", b"b", b"c"], 3000, 1.0)
    x = np.array([*near.weights.values(), near.bias])
    assert all(abs(loss(x + h) - loss(x - h)) / 2e-5 < 2e-3 for h in np.eye(4) * 1e-5)
