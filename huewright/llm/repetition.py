"""Quality rules on repetition, from a suffix array over each text's words.

The suffix array comes from prefix doubling over word ranks and the longest common prefixes of neighbours from comparing
ranks of powers of two. Every neighbouring pair with a common prefix of `least` words or more bounds an LCP interval; the two
places of each interval's prefix are repeats, and their union covers what is repeated. (A place is covered by a
maximal repeat exactly if it lies in the longest prefix that its suffix shares with a neighbour in the array.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, raw_texts, space_words

# Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(x for x in range(256) if x not in SYMBOLS)
_CONTINUES = bytes(range(0x80, 0xC0))


def longest_shared(words: list[bytes]) -> np.ndarray:
    """For each word position, the length in words of the longest prefix that its suffix shares with any other suffix."""
    n = len(words)
    if n < 2:
        return np.zeros(n, np.int64)
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    levels = [rank]
    order = np.argsort(rank)
    step, most = 1, len(ids)
    while most < n and step < n:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key)
        ordered = key[order]
        new = np.zeros(n, np.int64)
        np.cumsum(ordered[1:] != ordered[:-1], out=new[1:])
        rank = np.empty(n, np.int64)
        rank[order] = new
        levels.append(rank)
        most = int(new[-1]) + 1
        step *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        # A rank of level k stands for 2**k words, cut at the text's end: equal ranks within the text are equal words.
        width, level = 1 << k, levels[k]
        fits = (a + width <= n) & (b + width <= n)
        same = np.zeros(n - 1, bool)
        same[fits] = level[a[fits]] == level[b[fits]]
        shared[same] += width
        a[same] += width
        b[same] += width
    out = np.zeros(n, np.int64)
    out[order[:-1]] = shared
    out[order[1:]] = np.maximum(out[order[1:]], shared)
    return out


def covered(shared: np.ndarray, least: int) -> np.ndarray:
    """Whether each word lies in a repeat of `least` words or more."""
    n = len(shared)
    edges = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(shared >= least)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + shared[starts], -1)
    return np.cumsum(edges[:n]) > 0


def _lengths(words: list[bytes]) -> np.ndarray:
    return np.fromiter((len(w) if w.isascii() else len(w.translate(None, _CONTINUES)) for w in words), np.int64, len(words))


def _measure(raw: bytes | None, least: int, window: int) -> tuple[int, int, int, int, int, int, float]:
    raw = raw or b""
    words = space_words(raw)
    n = len(words)
    if not n:
        return 0, 0, len(raw.translate(None, _NOT_SYMBOLS)), 0, 0, 0, 0.0
    lines = [x for x in raw.split(b"\n") if x.split()]
    lengths = _lengths(words)
    chars = int(lengths.sum())
    shared = longest_shared(words)
    spans = covered(shared, least)
    return n, chars, len(raw.translate(None, _NOT_SYMBOLS)), len(lines) - len(set(lines)), int(covered(shared, window).sum()), int(shared.max()), float(lengths[spans].sum() / chars)


def repetition(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", least: int = 5, window: int = 8, max_fraction: float = 0.5, max_longest: int = 400, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, longest_repeat (words),
    repeat_fraction (of characters, in repeats of `least` words or more), base_failed, kept.

    A text fails the base rules with fewer than min_words words or more than max_repeat_percent of its words in repeats of `window`
    words; the method rejects it when maximal repeats cover more than max_fraction or the longest has more than max_longest
    words. Null and empty texts have zeros and fail. Repeated rows give repeated rows, an empty table none; other columns are not read.
    """
    ident = docs.schema[id_column].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "repeat_fraction")
        out: dict[str, list] = {k: [] for k in names}
        for raw in raw_texts(batch, "text"):
            for k, x in zip(names, _measure(raw, least, window), strict=True):
                out[k].append(x)
        return {"doc_id": batch.column(0)} | out

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    found = map_rows(rows, run, f"doc_id {ident}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, repeat_fraction double")
    found = found.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("repeat_fraction") <= max_fraction) & (F.col("longest_repeat") <= max_longest))
