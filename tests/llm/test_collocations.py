"""Collocations against counting all phrases in memory."""

from collections import Counter

import numpy as np
import pytest

from huewright.llm import collocations


def brute(rows, max_n, min_count, cover_percent, top):
    """Rows (text, lang) to {(lang, rank): (phrase, a, l, r, n, score)}."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\n")
        for piece in low.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, min(max_n, len(words) - i) + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    over = Counter()
    for (lang, p), a in candidates.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                over[lang, p[i : i + m]] = max(over[lang, p[i : i + m]], a)
    found = {}
    for (lang, p), a in candidates.items():
        if 100 * over[lang, p] >= cover_percent * a:
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, k): (p.decode(), -a, l, r, n[lang], -score) for lang, x in found.items() for k, (score, a, p, l, r) in enumerate(sorted(x)[:top], 1)}


def made(seed):
    rng, rows = np.random.default_rng(seed), []
    words = ["The", "of", "the", "a", "über", "x\0y", "\0", "a\x01", "end\x0e", "tea", "Cup", "New", "york", "w5", "w6"]
    for _ in range(300):
        text = [words[int(len(words) * x**2)] for x in rng.random(int(rng.integers(0, 40)))]
        parts = rng.choice([" ", "  ", "\t", ". ", ",", ";x ", ":", "!", "? ", "\n", "\x0b", "\x0c", "\r"], len(text), p=[0.7, 0.05, 0.05, *[0.02] * 10])
        rows.append(("".join(a + b for a, b in zip(text, parts, strict=True)), [None, "und", "en", "EN", ""][int(rng.integers(0, 5))]))
    rows += [("new york city hall of fame " * 40, "en"), (None, "en"), ("", "de"), (" . ", "de"), ("Ångström is a unit " * 30, "sv"), ("rare once", "sv"), ("same same same " * 50, "sv")]
    return rows + rows[:30]


@pytest.mark.parametrize(("max_n", "min_count", "cover", "top", "held", "parts", "hot"), [(5, 10, 100, 2000, 400_000, 1, 100), (5, 10, 100, 7, 50, 7, 20), (2, 3, 100, 50, 400_000, 3, 100_000), (4, 5, 60, 2000, 200, 5, 100_000), (5, 10, 100, 2000, 50, 4, 1)])
def test_collocations(spark, monkeypatch, max_n, min_count, cover, top, held, parts, hot):
    rows = made(max_n)
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 as n", "2 as phrase", "3 as word").repartition(4)
    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(collocations, "HELD_PAIRS", held)
    monkeypatch.setattr(collocations, "HOT_WORDS", hot)  # from no hot words to all
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = collocations.collocations(docs, max_n=max_n, min_count=min_count, cover_percent=cover, top=top, buckets=parts, bucket_words=700).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == brute(rows, max_n, min_count, cover, top)
    assert len(got) > 20


def test_odd_tables(spark):
    schema = "text string, lang string"
    assert collocations.collocations(spark.createDataFrame([], schema)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en")], schema)).count() == 0
    long = spark.sql("select repeat('a b. ', 1000000) as text, 'en' as lang")
    assert [tuple(r) for r in collocations.collocations(long).collect()] == [("en", 1, "a b", 1_000_000, 1_000_000, 1_000_000, 2_000_000, 2000)]


def test_pairs_by_chance(spark, monkeypatch):
    """Where all pairs share a few hashes, rare ones pass the bitmap and drop out later."""
    monkeypatch.setattr(collocations, "BITS", 17)
    monkeypatch.setattr(collocations, "pair_hashes", lambda words, lang, known, f=collocations.pair_hashes: (f(words, lang, known)[0] & 7, f(words, lang, known)[1]))
    rows = made(9)
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), min_count=10).collect()
    assert {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == brute(rows, 5, 10, 100, 2000)


def test_stack(spark):
    """The stack counts every prefix once; suffixes of hot words may be dealt to any number of stacks."""
    rng = np.random.default_rng(2)
    found = Counter(b"\0".join([b"abc"[x : x + 1] for x in rng.integers(0, 3, int(rng.integers(2, 6)))]) for _ in range(500))
    want = Counter()
    for s, n in found.items():
        words = s.split(b"\0")
        for m in range(2, len(words) + 1):
            want[b" ".join(words[:m])] += n
    rows = sorted(found.items(), reverse=True)
    for parts, hot in ((1, frozenset()), (7, frozenset(b"abc"[k : k + 1] for k in range(3)))):
        got = Counter()
        for k in range(parts):
            stack = collocations.PrefixStack(20, hot)
            for suffix, n in rows[k::parts]:
                stack.push(suffix, n)
            stack.close()
            for phrase, n in stack.out:
                got[phrase] += n
        assert {k: n for k, n in got.items() if n >= 20} == {k: n for k, n in want.items() if n >= 20}
