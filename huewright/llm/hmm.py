"""Language-model scoring with a hidden Markov model over word classes.

A frequent word is a class of its own, every other word belongs to the class of its last bytes, and the end of a text is a class. The model has a
few latent states that emit classes; a word's probability is its class's, times its share of the class (add-half
smoothed, with one unseen word in each class). Baum-Welch: every pass computes expected counts of starts, transitions and emissions in
each task and sums them over all partitions, from all training documents: first slice by slice, which gives a starting point, then all together. Scores are exact: a scaled forward recursion over the whole text.

Word counts are exact for all words. Those of at most `head` frequent words are sent to the tasks; a document's other words are joined to
the table of counts, so that nothing that grows with the vocabulary is held in one place.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, fold, map_rows, raw_texts, written
from .common import slices as slices_of

#: Classes of the other words, by their last three bytes.
SUFFIXES = 1024
END = 0


def tokens(raw: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+, A-Z in lower case; the end of the text is not among them."""
    return raw.translate(LOWER).split() if raw else []


def suffix_class(word: bytes) -> int:
    return 1 + zlib.crc32(word[-3:]) % SUFFIXES


@dataclass
class Vocabulary:
    """Counts of the frequent words, the classes, and the totals of the corpus."""

    counts: dict[bytes, int]
    classes: dict[bytes, int]
    n_classes: int
    total: int
    kinds: int
    ends: int


@dataclass
class Model:
    """Natural probabilities: start (K), move (K, K), emit (classes, K)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def count_words(docs: DataFrame, text_column: str = "text", *, at_once: int = 400_000) -> DataFrame:
    """(word, n) over all rows; each task hands on partial counts whenever it holds at_once words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for raw in raw_texts(batch, "text"):
                seen.update(tokens(raw))
                if len(seen) >= at_once:
                    yield pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.binary()), "n": pa.array(seen.values(), pa.int64())})
                    seen = Counter()
        yield pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.binary()), "n": pa.array(seen.values(), pa.int64())})

    return docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, ends: int, *, head: int = 200_000, own: int = 6000) -> Vocabulary:
    """The words of the largest counts, `head` at most; the first `own` of them are classes of their own.

    The least count of a frequent word comes from the number of words of each count, so no sort of the vocabulary is needed.
    """
    per_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("tokens"))
    totals = per_count.agg(F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    largest = per_count.orderBy(F.desc("n")).limit(head).collect()
    least, held = 1 << 62, 0
    for r in largest:
        if held + r.kinds > head:
            break
        least, held = r.n, held + r.kinds
    rows = [(bytes(r.word), r.n) for r in counts.where(F.col("n") >= least).collect()]  # `head` at most
    rows.sort(key=lambda x: (-x[1], x[0]))
    classes = {w: 1 + SUFFIXES + k for k, (w, _) in enumerate(rows[:own])}
    return Vocabulary(dict(rows), classes, 1 + SUFFIXES + len(classes), totals[1] + ends, totals[0] + (ends > 0), ends)


def class_sizes(counts: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """(classes of suffixes, 2): tokens and kinds of the words in each."""
    own = vocab.classes

    def run(batch: pa.RecordBatch) -> dict:
        sums: dict[int, list[int]] = {}
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if word not in own:
                x = sums.setdefault(suffix_class(word), [0, 0])
                x[0] += n
                x[1] += 1
        return {"class": list(sums), "n": [x[0] for x in sums.values()], "kinds": [x[1] for x in sums.values()]}

    out = np.zeros((1 + SUFFIXES, 2))
    for r in map_rows(counts, run, "class int, n long, kinds long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():
        out[r["class"]] = r.n, r.kinds
    return out


class Steps:
    """Sequences laid out by time: all first tokens, then all second ones, the longest sequence first."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        longest = int(lengths[0])
        self.sizes = np.searchsorted(-lengths, -np.arange(longest), side="left")  # sequences longer than t
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        flat = np.concatenate([sequences[k] for k in self.order])
        place = np.concatenate([np.arange(n) for n in lengths])
        rank = np.repeat(np.arange(len(lengths)), lengths)
        self.rank = np.empty(len(flat), np.int64)
        self.classes = np.empty(len(flat), flat.dtype)
        at = self.starts[place] + rank
        self.rank[at] = rank
        self.classes[at] = flat


def _forward(steps: Steps, model: Model, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(scale of each token, forward probabilities (K, tokens) or None, emissions (K, tokens))."""
    emit = np.take(np.ascontiguousarray(model.emit.T), steps.classes, axis=1)
    scale = np.empty(emit.shape[1])
    kept = np.empty_like(emit) if keep else None
    move = np.ascontiguousarray(model.move.T)
    starts = steps.starts.tolist()
    alpha = None
    for a, b in zip(starts, starts[1:], strict=False):
        alpha = np.repeat(model.start[:, None], b - a, 1) if alpha is None else move @ alpha[:, : b - a]
        alpha *= emit[:, a:b]
        s = np.add.reduce(alpha, 0, out=scale[a:b])
        alpha /= s
        if keep:
            kept[:, a:b] = alpha
    return scale, kept, emit


def log_likelihoods(sequences: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 probability of each sequence of classes."""
    steps = Steps(sequences)
    scale, _, _ = _forward(steps, model, False)
    sums = np.bincount(steps.rank, np.log10(scale), len(sequences))
    out = np.empty(len(sequences))
    out[steps.order] = sums
    return out


def expected_counts(sequences: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts (K), transitions (K, K) and emissions (classes, K) by the forward-backward recursions."""
    steps = Steps(sequences)
    scale, alpha, ahead = _forward(steps, model, True)
    k, starts = len(model.start), steps.starts.tolist()
    # ahead: emission times backward probability over scale, worked out in the emissions' place.
    ahead /= scale
    beta = np.ones_like(alpha)
    for a, c, d in zip(starts[-3::-1], starts[-2::-1], starts[:0:-1], strict=False):
        here = ahead[:, c:d]
        here *= beta[:, c:d]
        beta[:, a : a + d - c] = model.move @ here
    moves = np.zeros((k, k))
    before = np.repeat(steps.starts[:-2], steps.sizes[1:]) + steps.rank[starts[1] :]  # of each token but the first ones
    for at in range(0, len(before), 1 << 16):
        part = before[at : at + (1 << 16)]
        moves += alpha[:, part] @ ahead[:, starts[1] + at : starts[1] + at + len(part)].T
    alpha *= beta
    emits = np.stack([np.bincount(steps.classes, x, len(model.emit)) for x in alpha], 1)
    return alpha[:, : starts[1]].sum(1), moves * model.move, emits


def maximise(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, prior: float = 0.01) -> Model:
    """The model of the expected counts, each with a small prior count so that nothing is impossible."""
    emits = emits + prior
    return Model((starts + prior) / (starts + prior).sum(), (moves + prior) / (moves + prior).sum(1, keepdims=True), emits / emits.sum(0))


def _parts(sequences: list[np.ndarray], most: int) -> Iterator[list[np.ndarray]]:
    """The sequences in parts of about `most` tokens, the length of a part's sequences alike."""
    part, held = [], 0
    for s in sequences:
        if part and held + len(s) > most:
            yield part
            part, held = [], 0
        part.append(s)
        held += len(s)
    if part:
        yield part


class _Classes(dict):
    """The class of each word; at most 200,000 words are remembered."""

    def __init__(self, own: dict[bytes, int]):
        self.own = own

    def __missing__(self, word: bytes) -> int:
        c = self.own.get(word) or suffix_class(word)
        if len(self) < 200_000:
            self[word] = c
        return c


class _Places(dict):
    """The place of each frequent word, then, for every other word, the number of frequent words and its suffix class; at most 200,000 of the others are remembered."""

    def __init__(self, counts: dict[bytes, int]):
        super().__init__(zip(counts, range(len(counts)), strict=True))
        self.head = len(counts)

    def __missing__(self, word: bytes) -> int:
        c = self.head + suffix_class(word)
        if len(self) < self.head + 200_000:
            self[word] = c
        return c


def _sequence(words: list[bytes], known: _Classes) -> np.ndarray:
    """Classes of the words and the end."""
    out = np.full(len(words) + 1, END, np.int32)
    out[:-1] = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
    return out


def train(docs: DataFrame, vocab: Vocabulary, *, text_column: str = "text", states: int = 4, passes: int = 2, slices: int = 16, at_once: int = 500_000, seed: int = 7) -> Model:
    """Baum-Welch over all rows of docs: one round over each of `slices` slices of them (by a hash of the text), then `passes` passes over all.

    A slice's counts are scaled to all rows and averaged with those before, the newer the heavier (stepwise Baum-Welch), so every round is summed over all partitions and every row has been
    seen `passes` + 1 times. The rows' classes are worked out once and written.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(text_column).cast("string").alias("text"))
    rng = np.random.default_rng(seed)
    model = Model(np.full(states, 1 / states), (np.eye(states) * 0.9 + 0.1 / states), rng.dirichlet(np.full(vocab.n_classes, 1.0), states).T + 1e-9)
    model.emit /= model.emit.sum(0)
    if not vocab.ends:
        return model
    own = context.broadcast(vocab.classes)
    made: list[_Classes] = []  # once for each task

    def classes(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(_Classes(own.value))
        return {"classes": [_sequence(tokens(raw), made[0]) for raw in raw_texts(batch, "text")], "slice": batch.column(1)}

    part = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(slices)).cast("int").alias("slice")
    stored = written(map_rows(rows.select("text", part), classes, "classes array<int>, slice int", 1000), by="slice")
    total = None
    for k in range(slices):
        some = stored.where(F.col("slice") == k)
        found = [x * slices for x in _pass(some, model, at_once)]
        if not found[0].any():
            continue  # a slice without rows
        weight = (k + 2) ** -0.5 if total is not None else 1.0
        total = found if total is None else [(1 - weight) * a + weight * b for a, b in zip(total, found, strict=True)]
        model = maximise(*total, prior=0.1)
    # A task's longest text takes a step for each of its words, however many texts go along: fewer tasks take fewer steps.
    whole = stored.coalesce(max(1, stored.rdd.getNumPartitions() // 4))
    for _ in range(passes):
        model = maximise(*_pass(whole, model, at_once))
    return model


def _sum(counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    total = None
    for x in counts:
        total = x if total is None else tuple(a + b for a, b in zip(total, x, strict=True))
    return total


def _pass(stored: DataFrame, model: Model, at_once: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over all rows: summed in each task, then over the tasks by key; the sums alone reach the driver."""
    k, n = len(model.start), len(model.emit)
    sent = stored.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in slices_of(batches, 10_000):
            lists = batch.column(0)
            sequences = sorted(np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1]), key=len) if len(lists) else []
            for part in _parts(sequences, at_once):
                x = expected_counts(part, sent.value)
                total = x if total is None else tuple(a + b for a, b in zip(total, x, strict=True))
        if total is not None:
            flat = np.concatenate([x.ravel() for x in total])
            key = np.flatnonzero(flat)
            yield pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int32()), "x": pa.array(flat[key])})

    sums = stored.select("classes").mapInArrow(run, "key int, x double").groupBy("key").agg(F.sum("x").alias("x")).toArrow()
    flat = np.zeros(k + k * k + n * k)
    flat[sums["key"].to_numpy()] = sums["x"].to_numpy()
    return flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k :].reshape(n, k)


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Model, *, id_column: str = "doc_id", text_column: str = "text", at_once: int = 500_000) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, n_known, base_score, score (log10). See score_documents for odd rows."""
    ident = docs.schema[id_column].dataType.simpleString()
    sizes = class_sizes(counts, vocab)
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((vocab, model, sizes))
    bottom = log10(vocab.total + 0.5 * (vocab.kinds + 1))

    tables: list[tuple[_Places, np.ndarray]] = []  # made once for each task

    def partial(batch: pa.RecordBatch) -> dict:
        v, m, size = sent.value
        if not tables:
            n = np.fromiter(v.counts.values(), float, len(v.counts))
            klass = np.fromiter((v.classes.get(w) or suffix_class(w) for w in v.counts), np.int64, len(n))
            suffix = np.where(klass <= SUFFIXES, klass, 0)
            share = np.where(klass <= SUFFIXES, np.log10(n + 0.5) - np.log10(size[suffix, 0] + 0.5 * (size[suffix, 1] + 1)), 0.0)
            # Columns of the frequent words, then, for the others, of the suffix classes: class, log10 in the base, log10 of the share, whether known.
            others = np.arange(1 + SUFFIXES)
            zero = np.zeros(1 + SUFFIXES)
            tables.append((_Places(v.counts), np.stack([np.concatenate(x) for x in ((klass, others), (np.log10(n + 0.5) - bottom, zero), (share, zero), (np.ones(len(n)), zero))])))
        places, table = tables[0]
        head = len(v.counts)
        found, texts, times, rare = [], [0], [], []
        for raw in raw_texts(batch, "text"):
            words = tokens(raw)
            x = np.fromiter(map(places.__getitem__, words), np.int32, len(words))
            others = Counter([words[k] for k in np.flatnonzero(x >= head).tolist()])
            rare += others.keys()
            times += others.values()
            texts.append(len(rare))
            found.append(x)
        lengths = np.array([len(x) for x in found])
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        of = np.repeat(np.arange(len(found)), lengths)
        plain, shares, seen = (np.bincount(of, table[k][flat], len(found)) for k in (1, 2, 3))
        ends = np.cumsum(lengths + 1) - 1
        classes = np.full(len(flat) + len(found), END, np.int32)
        classes[np.arange(len(flat)) + of] = table[0][flat]
        order = np.argsort(lengths, kind="stable").tolist()
        at = 0
        for part in _parts([classes[ends[i] - lengths[i] : ends[i] + 1] for i in order], at_once):
            shares[order[at : at + len(part)]] += log_likelihoods(part, m)
            at += len(part)
        entries = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], names=["word", "n"])
        return {
            "doc_id": batch.column(0),
            "n_tokens": pa.array(lengths + 1, pa.int64()),
            "n_known": pa.array(seen.astype(np.int64) + int(v.ends > 0)),
            "base_score": pa.array(plain + log10(v.ends + 0.5) - bottom),
            "score": pa.array(shares),
            "rare": pa.ListArray.from_arrays(pa.array(texts, pa.int32()), entries),
        }

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    found = map_rows(rows, partial, f"doc_id {ident}, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:binary,n:long>>")
    found = written(found.withColumn("row", F.monotonically_increasing_id()))  # ids are fixed once written
    rare = found.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    n = F.coalesce(F.col("n"), F.lit(0))
    klass = (F.crc32(F.expr("substring(word, -3)")) % SUFFIXES + 1).cast("int")
    size = docs.sparkSession.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(sizes) if k], "class int, tokens double, kinds double")
    joined = rare.join(counts, "word", "left").withColumn("class", klass).join(F.broadcast(size), "class")  # SUFFIXES rows
    sums = joined.groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * (F.log10(n + 0.5) - bottom)).alias("base"),
        F.sum(F.col("times") * (F.log10(n + 0.5) - F.log10(F.col("tokens") + 0.5 * (F.col("kinds") + 1)))).alias("shares"),
    )
    added = lambda a, b, zero: (F.col(a) + F.coalesce(F.col(b), F.lit(zero))).alias(a)
    return found.join(sums, "row", "left").select("doc_id", "n_tokens", added("n_known", "known", 0), added("base_score", "base", 0.0), added("score", "shares", 0.0))


def score_documents(docs: DataFrame, *, learn: Column | None = None, id_column: str = "doc_id", text_column: str = "text", head: int = 200_000, own: int = 6000, **training) -> DataFrame:
    """Learn from the rows that `learn` selects (fold not 1 unless given) and score all rows of docs.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-half unigrams), score (the model's log10 probability). A null or empty
    text is the end alone; a very long one is one sequence, held whole by its task. Without training rows all counts are 0. Repeated rows give repeated rows, an empty table none; other columns are not read.
    """
    learn = fold(id_column) != 1 if learn is None else learn
    training_rows = docs.where(learn)
    counts = written(count_words(training_rows, text_column))
    ends = training_rows.count()
    vocab = vocabulary(counts, ends, head=head, own=own)
    model = train(training_rows, vocab, text_column=text_column, **training)
    found = score(docs, counts, vocab, model, id_column=id_column, text_column=text_column)
    return found.withColumn("train_tokens", F.lit(vocab.total).cast("long"))
