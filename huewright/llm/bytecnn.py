"""Document quality by a convolutional network over bytes, in numpy.

A text is cut into chunks of CHUNK bytes, each with the first bytes of the next one, so that every window of WIDTH bytes lies in one chunk. Bytes are embedded, filters
are applied to windows, and each filter's largest answer in a chunk is kept (max-pooling, after ReLU). The mean and the maximum of the chunks' answers
are combined into one probability, so all of a text counts, however long it is.

The network is fitted on a bounded sample of labelled rows: at most about `sample` rows, half for each label where both are plentiful, chosen by a hash of doc_id,
of at most about `sample_bytes` bytes in all; texts over `longest` bytes teach nothing. Every document is scored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_rows, raw_texts, written
from .toxicity import labelled

#: Bytes of a chunk, of a window, and between windows; sizes of the embedding; filters.
CHUNK, WIDTH, STEP, DIM, FILTERS = 512, 8, 2, 8, 32
#: What stands behind the end of a text.
PAD = 256
#: Chunks that are held as numbers at a time.
GROUP = 128


@dataclass
class Net:
    """Weights; `constant` is the score of everything where the labels hold one class only."""

    bytes_: np.ndarray = field(default_factory=lambda: np.zeros((PAD + 1, DIM), np.float32))
    filters: np.ndarray = field(default_factory=lambda: np.zeros((WIDTH * DIM, FILTERS), np.float32))
    shift: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS, np.float32))
    head: np.ndarray = field(default_factory=lambda: np.zeros(2 * FILTERS + 1, np.float32))
    constant: float | None = None

    def parts(self) -> list[np.ndarray]:
        return [self.bytes_, self.filters, self.shift, self.head]


def start(seed: int = 12) -> Net:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
    return Net(draw(PAD + 1, DIM, by=0.5), draw(WIDTH * DIM, FILTERS, by=(WIDTH * DIM) ** -0.5), np.zeros(FILTERS, np.float32), draw(2 * FILTERS + 1, by=0.05))


def chunks(raw: bytes | None) -> np.ndarray:
    """(chunk, CHUNK + WIDTH) bytes of a text; an empty one has one chunk of PAD."""
    data = np.frombuffer(raw or b"", np.uint8)
    n = max(1, -(-len(data) // CHUNK))
    whole = np.full(n * CHUNK + WIDTH, PAD, np.int16)
    whole[: len(data)] = data
    return as_strided(whole, (n, CHUNK + WIDTH), (CHUNK * 2, 2))


def pooled(net: Net, cut: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(answers, places, embedded): each filter's largest answer in each chunk, before ReLU; with `where` the window that gave it."""
    x = net.bytes_[cut]
    n, per = len(x), CHUNK // WIDTH
    row = x.strides
    best = at = None
    for o in range(0, WIDTH, STEP):
        # Windows from o on that don't overlap lie one behind the other, so they are the rows of a matrix as they stand.
        view = as_strided(x[:, o:], (n, per, WIDTH * DIM), (row[0], WIDTH * row[1], row[2]))
        y = view @ net.filters
        if where:
            k = y.argmax(1)
            top = np.take_along_axis(y, k[:, None], 1)[:, 0]
            k = k * WIDTH + o
            at = k if best is None else np.where(top > best, k, at)
        else:
            top = y.max(1)
        best = top if best is None else np.maximum(best, top)
    return best + net.shift, at, x


def _logit(net: Net, answers: np.ndarray) -> float:
    a = np.maximum(answers, 0)
    return float(a.mean(0) @ net.head[:FILTERS] + a.max(0) @ net.head[FILTERS:-1] + net.head[-1])


def probabilities(net: Net, raws: list[bytes | None]) -> list[float]:
    """Scores of texts; their chunks are taken GROUP at a time, whichever texts they are of, and a long text's answers are gathered as they come."""
    if net.constant is not None:
        return [net.constant] * len(raws)
    total, most, counts = np.zeros((len(raws), FILTERS)), np.zeros((len(raws), FILTERS), np.float32), np.zeros(len(raws), np.int64)

    def take(of: list[int], parts: list[np.ndarray]) -> None:
        owner = np.repeat(of, [len(p) for p in parts])
        a = np.maximum(pooled(net, np.concatenate(parts))[0], 0)
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        own = owner[starts]
        total[own] += np.add.reduceat(a.astype(np.float64), starts)
        most[own] = np.maximum(most[own], np.maximum.reduceat(a, starts))
        counts[own] += np.diff(np.append(starts, len(owner)))

    of, parts, held = [], [], 0
    for k, raw in enumerate(raws):
        cut = chunks(raw)
        for at in range(0, len(cut), GROUP):
            of.append(k)
            parts.append(cut[at : at + GROUP])
            held += len(parts[-1])
            if held >= GROUP:
                take(of, parts)
                of, parts, held = [], [], 0
    if parts:
        take(of, parts)
    z = total / np.maximum(counts, 1)[:, None] @ net.head[:FILTERS] + most @ net.head[FILTERS:-1] + net.head[-1]
    return (1 / (1 + np.exp(-np.clip(z, -50, 50)))).tolist()


def slopes(net: Net, cuts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Weighted logistic loss of documents (their chunks) and its slopes by the net's parts."""
    cut = np.concatenate(cuts)
    sizes = np.array([len(c) for c in cuts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    answers, at, x = pooled(net, cut, True)
    a = np.maximum(answers, 0)
    mean = np.add.reduceat(a, starts) / sizes[:, None]
    most = np.maximum.reduceat(a, starts)
    z = np.clip(mean @ net.head[:FILTERS] + most @ net.head[FILTERS:-1] + net.head[-1], -50, 50)
    p = 1 / (1 + np.exp(-z))
    loss = float((weight * (np.logaddexp(0, z) - y * z)).sum())
    dz = (weight * (p - y)).astype(np.float32)
    head = np.concatenate([dz @ mean, dz @ most, [dz.sum()]]).astype(np.float32)
    owner = np.repeat(np.arange(len(cuts)), sizes)
    # The maximum's slope goes to the first chunk that reaches it.
    top = a == most[owner]
    count = np.cumsum(top, 0) - np.concatenate([np.zeros((1, FILTERS), np.int64), np.cumsum(top, 0)])[starts][owner]
    da = dz[owner, None] * (net.head[:FILTERS] / sizes[owner, None] + net.head[FILTERS:-1] * (top & (count == 1)))
    da = np.where(answers > 0, da, 0).astype(np.float32)
    c, f = np.nonzero(da)
    g, place = da[c, f], at[c, f]
    spots = place[:, None] + np.arange(WIDTH)
    windows = x[c[:, None], spots].reshape(len(c), WIDTH * DIM)
    filters = np.zeros((FILTERS, WIDTH * DIM), np.float32)
    order = np.argsort(f, kind="stable")
    if len(order):
        first = np.flatnonzero(np.concatenate([[True], f[order][1:] != f[order][:-1]]))
        filters[f[order][first]] = np.add.reduceat((g[:, None] * windows)[order], first)
    back = (g[:, None] * net.filters.T[f]).reshape(-1, DIM)
    symbols = cut[c[:, None], spots].ravel()
    embed = np.stack([np.bincount(symbols, back[:, k], PAD + 1) for k in range(DIM)], 1).astype(np.float32)
    return loss, [embed, filters.T.copy(), da.sum(0), head]


def climb(raws: list[bytes | None], y: np.ndarray, weight: np.ndarray, *, rounds: int = 12, rate: float = 0.01, batch: int = 32, shrink: float = 1e-5, seed: int = 12) -> Net:
    """Adam steps over batches of documents, in an order drawn anew each round."""
    net, rng = start(seed), np.random.default_rng(seed)
    cuts = [chunks(r) for r in raws]
    weight = weight / weight.mean()
    m, v = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    steps, n = 0, len(raws)
    for r in range(rounds):
        order = rng.permutation(n)
        pace = rate * (1 - r / rounds)
        for k in range(0, n, batch):
            chosen = order[k : k + batch]
            _, g = slopes(net, [cuts[i] for i in chosen], y[chosen], weight[chosen] / len(chosen))
            steps += 1
            for p, d, a, b in zip(net.parts(), g, m, v, strict=True):
                d = d + shrink * p
                a += 0.1 * (d - a)
                b += 0.01 * (d * d - b)
                p -= pace * (a / (1 - 0.9**steps)) / (np.sqrt(b / (1 - 0.99**steps)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample: int = 6000, sample_bytes: int = 12_000_000, longest: int = 100_000, **parameters) -> Net:
    """The network fitted on the labelled sample (rows of fold 0 never teach). Of several rows of an id the smallest text teaches."""
    chosen = labelled(labels, id_column=id_column, label_column=label_column, sample=sample)
    size = F.octet_length("text")
    texts = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")).where(size <= longest)
    rows = written(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "weight").agg(F.min("text").alias("text")))  # about `sample` rows, from one scan
    total = rows.agg(F.sum(size)).first()[0] or 0
    share = min(1.0, sample_bytes / max(1, total))
    thin = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) / (1 << 20) < share
    taught = rows.where(thin).select("doc_id", "label", "weight", F.col("text").cast("binary").alias("text")).toArrow().sort_by("doc_id")
    y = taught["label"].to_numpy().astype(np.float64)
    if len(y) == 0 or y.min() == y.max():
        return Net(constant=float(y.mean()) if len(y) else 0.5)
    return climb(taught["text"].to_pylist(), y, taught["weight"].to_numpy(), **parameters)


def score(docs: DataFrame, net: Net, *, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row for each row of docs: doc_id, score, predicted (1 if the score is at least the threshold).

    Null and empty texts are one chunk of padding, so they have a score like others; very long texts are read whole, a group of chunks at a time. Repeated rows give repeated
    rows, rows without id are scored, an empty table gives none; other columns are not read. Where labels hold one class only, all scores are their mean (0.5 without labels).
    """
    ident = docs.schema[id_column].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(net)  # about 4,500 numbers

    def run(batch: pa.RecordBatch) -> dict:
        p = probabilities(sent.value, raw_texts(batch, "text"))
        return {"doc_id": batch.column(0), "score": p, "predicted": [int(x >= threshold) for x in p]}

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_rows(rows, run, f"doc_id {ident}, score double, predicted int", 500)


def quality(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", **parameters) -> DataFrame:
    """Fit on labels and score every row of docs: the columns of score() and held_out (fold 0, never trained on)."""
    net = fit(docs, labels, id_column=id_column, **parameters)
    return score(docs, net, id_column=id_column).withColumn("held_out", fold("doc_id") == 0)
