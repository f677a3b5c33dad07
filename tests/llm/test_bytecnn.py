"""The byte network against its definition, its slopes against differences, and its held-out accuracy."""

import copy
import math
import zlib

import numpy as np
import pytest

from huewright.llm import bytecnn as B


def random_net(seed):
    rng = np.random.default_rng(seed)
    net = B.start(seed)
    net.shift = rng.normal(0, 0.3, B.FILTERS).astype(np.float32)
    net.head = rng.normal(0, 0.5, 2 * B.FILTERS + 1).astype(np.float32)
    return net


def plain(net, raw):
    """The score of a text, window by window."""
    raw = raw or b""
    n = max(1, math.ceil(len(raw) / B.CHUNK))
    symbols = [*raw, *[B.PAD] * (n * B.CHUNK + B.WIDTH - len(raw))]
    answers = []
    for c in range(n):
        best = np.full(B.FILTERS, -np.inf)
        for at in range(c * B.CHUNK, (c + 1) * B.CHUNK, B.STEP):
            window = np.concatenate([net.bytes_[s].astype(float) for s in symbols[at : at + B.WIDTH]])
            best = np.maximum(best, window @ net.filters.astype(float) + net.shift)
        answers.append(np.maximum(best, 0))
    z = np.mean(answers, 0) @ net.head[: B.FILTERS] + np.max(answers, 0) @ net.head[B.FILTERS : -1] + net.head[-1]
    return 1 / (1 + math.exp(-z))


@pytest.mark.parametrize("group", [1, 3, 128])
def test_score_is_the_definition(monkeypatch, group):
    monkeypatch.setattr(B, "GROUP", group)
    net, rng = random_net(3), np.random.default_rng(3)
    texts = [None, b"", b"a", "é ü".encode() * 40, *(rng.integers(0, 256, n, np.uint8).tobytes() for n in (511, 512, 513, 519, 520, 1024, 3000)), b""]
    assert np.allclose(B.probabilities(net, texts), [plain(net, t) for t in texts], atol=1e-5)


def test_every_byte_counts():
    """A planted sequence is found wherever it stands, at a seam of chunks and at the end too."""
    net = B.start()
    net.filters[:] = 0
    net.bytes_[:] = 0
    net.bytes_[ord("#"), 0] = 1
    net.filters[::B.DIM, 0] = 1
    net.shift[:] = -(B.WIDTH - 1.5)
    net.head[:] = 0
    net.head[B.FILTERS] = 8
    blank = B.probabilities(net, [b"." * 5000])[0]
    for at in [*range(0, 4992, 2), 4992]:
        text = bytearray(b"." * 5000)
        text[at : at + 8] = b"########"
        assert B.probabilities(net, [bytes(text)])[0] > blank + 0.4


def test_slopes():
    net, rng = random_net(5), np.random.default_rng(5)
    for part in ("bytes_", "filters", "shift", "head"):
        setattr(net, part, getattr(net, part).astype(float))
    cuts = [B.chunks(rng.integers(97, 110, n, np.uint8).tobytes()) for n in (0, 7, 600, 1500)]
    y, weight = np.array([1.0, 0, 1, 0]), np.array([0.2, 1.5, 0.7, 0.4])
    _, found = B.slopes(net, cuts, y, weight)
    for k, part in enumerate(net.parts()):
        for _ in range(25):
            at = tuple(int(rng.integers(0, n)) for n in part.shape)
            if k == 0:
                at = (int(rng.choice([*range(97, 110), B.PAD])), at[1])
            values = []
            for by in (1e-6, -1e-6):
                other = copy.deepcopy(net)
                other.parts()[k][at] += by
                values.append(B.slopes(other, cuts, y, weight)[0])
            assert found[k][at] == pytest.approx((values[0] - values[1]) / 2e-6, rel=1e-3, abs=1e-5)


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = B.quality(docs, labels, sample=2500, sample_bytes=3_000_000)
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows) and len(rows) > 500
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert sum(r.predicted for r in good) / len(good) > 0.97
    assert sum(1 - r.predicted for r in bad) / len(bad) > 0.75


def test_odd_rows(spark):
    schema = "doc_id long, text string, score string, label int, weight int"
    texts = [f"{'### ' * (k % 7 + 1)}" if k % 2 else f"plain words {k} here" for k in range(60)]
    rows = [(k, t, "x", 1, 2) for k, t in enumerate(texts)] + [(None, None, "", 0, 0), (70, None, "", 0, 0), (71, "", "", 0, 0), (72, "long text " * 300_000, "", 0, 0), (3, "### again", "", 0, 0), (3, "### again", "", 0, 0)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(60)] + [(None, 1), (5, None), (72, 0), (99, 1)], "doc_id long, quality int")
    got = B.quality(docs, labels, rounds=10)
    assert got.columns == ["doc_id", "score", "predicted", "held_out"]
    found = got.collect()
    assert sorted((str(r.doc_id) for r in found)) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    by = {r.doc_id: r.score for r in found}
    assert by[70] == by[71] == by[None] and by[1] < 0.5 < by[2]
    assert B.quality(docs, labels.limit(0)).agg({"score": "min"}).first()[0] == 0.5
    assert B.quality(docs, labels.where("quality = 1")).agg({"score": "min"}).first()[0] == 1.0
    assert B.quality(docs.limit(0), labels).count() == 0
    assert [r.score for r in B.quality(docs, labels, rounds=10).orderBy("doc_id", "score").collect()] == [r.score for r in got.orderBy("doc_id", "score").collect()]
