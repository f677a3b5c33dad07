"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's words, one scan of every text.

A window is `window` consecutive words of an item (a shorter item is one window). Every window of w words holds
a whole piece of p = (w + 1) // 2 words that starts at a multiple of p, so the automaton holds these aligned pieces
only (as large as the benchmark, not w times that). Each piece found is widened to the longest run of
words that text and item share there; a run of w words or more is a run of windows. The result is the same as with a
pattern per window.

The automaton is built from a benchmark block of at most `max_block_bytes`, a checked bound. A larger benchmark has several blocks, which are sent one
by one; each batch of texts is read once and matched against all of them where it stands.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, code_points, map_rows, raw_texts, slices, union_spans

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SCHEMA = "doc_id {id}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>, items array<string>"


class _Matcher:
    """The automaton of a block of items, made once in each Python worker."""

    _made: dict[str, _Matcher] = {}
    #: Automata that a worker keeps; others are made again for each batch.
    kept = 4

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.items, self.window, self.piece = items, window, (window + 1) // 2
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int, int]]] = {}
        for k, (_, words) in enumerate(items):
            long = len(words) >= window
            length = self.piece if long else len(words)
            for at in range(0, len(words) - length + 1, length) if length else ():
                places.setdefault(_line(words[at : at + length]), []).append((k, at, length))
        for key, found in places.items():
            self.automaton.add_word(key, found)
        if places:
            self.automaton.make_automaton()

    @classmethod
    def of(cls, key: str, items: list[tuple[str, list[bytes]]], window: int) -> _Matcher:
        if key not in cls._made:
            while len(cls._made) >= cls.kept:
                cls._made.pop(next(iter(cls._made)))
            cls._made[key] = cls(items, window)
        return cls._made[key]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words and the ids of items that occur."""
        spans: list[tuple[int, int]] = []
        ids: set[str] = set()
        if not len(self.automaton) or not words:
            return spans, ids
        line, at, index = _line(words), 0, 0
        reached: dict[tuple[int, int], int] = {}  # (item, shift): end of the last run
        for last, places in self.automaton.iter(line):
            index += line.count(" ", at, last)  # words that end before the closing space
            at = last
            for k, begin, length in places:
                item = self.items[k][1]
                first = index - length
                if len(item) < self.window:
                    spans.append((first, index))
                    ids.add(self.items[k][0])
                    continue
                shift = first - begin
                if reached.get((k, shift), -1) >= index:
                    continue
                start, end = first, index
                while start > 0 and start - shift > 0 and words[start - 1] == item[start - 1 - shift]:
                    start -= 1
                while end < len(words) and end - shift < len(item) and words[end] == item[end - shift]:
                    end += 1
                reached[k, shift] = end
                if end - start >= self.window:
                    spans.append((start, end))
                    ids.add(self.items[k][0])
        return union_spans(spans), ids


def _line(words: list[bytes]) -> str:
    return " " + b" ".join(words).decode("latin-1") + " "


def _original(raw: bytes, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Code point offsets in the original text of spans of words."""
    if not spans:
        return []
    places = [m.span() for m in _WORD.finditer(raw)]
    found = [(places[a][0], places[b - 1][1]) for a, b in spans]
    at = code_points(raw, (x for span in found for x in span))
    return [{"start": at[a], "end": at[b]} for a, b in found]


def _row(raw: bytes | None, n: int, spans: list[tuple[int, int]], ids: set[str]) -> dict:
    hit = sum(b - a for a, b in spans)
    items = sorted(ids)
    return {"n_words": n, "n_hit": hit, "n_items": len(items), "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest(), "contaminated": hit > 0 and 20 * hit >= n, "spans": _original(raw or b"", spans), "items": items}


def _blocks(benchmark: DataFrame, item_column: str, text_column: str, max_block_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Blocks of the benchmark's items as words, each of a checked size."""
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(text_column).cast("string").alias("text")).where("item is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-size // max_block_bytes) or 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, alnum_words(r.text.encode())) for r in part.distinct().collect()]


def _finder(docs: DataFrame, benchmark: DataFrame, item_column: str, text_column: str, window: int, max_block_bytes: int):
    """A function from texts to (number of words, spans of hit words, ids of items that occur) of each, and how many texts it takes at a time."""
    context = docs.sparkSession.sparkContext
    blocks = [(hashlib.sha256(repr((window, block)).encode()).hexdigest(), context.broadcast(block)) for block in _blocks(benchmark, item_column, text_column, max_block_bytes)]

    def find(raws: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        found: list[tuple[int, list[tuple[int, int]], set[str]]] = [(0, [], set()) for _ in raws]
        for key, block in blocks:
            matcher = _Matcher.of(key, block.value, window)
            for k, raw in enumerate(raws):
                words = alnum_words(raw)
                spans, ids = matcher.hits(words)
                found[k] = (len(words), found[k][1] + spans, found[k][2] | ids)
        return [(n, union_spans(spans), ids) for n, spans, ids in found]

    # Few texts at a time are enough for the automata that a worker keeps; others are made anew for each batch.
    return find, 1000 if len(blocks) <= _Matcher.kept else 1 << 20


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", window: int = 13, max_block_bytes: int = 2_000_000) -> DataFrame:
    """One row for each row of docs: how many of its words lie in a window of a benchmark item, and where.

    doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and 20 n_hit >= n_words), spans (code point offsets in
    the original text), items. Null and empty texts have no words and are clean. Items without words or id never occur. Repeated rows give
    repeated rows, an empty table gives none, and other columns are not read.
    """
    schema = SCHEMA.format(id=docs.schema[id_column].dataType.simpleString())
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    (find, at_once), columns = _finder(docs, benchmark, item_column, item_text_column, window, max_block_bytes), [*_row(b"", 0, [], set())]

    def scan(batch: pa.RecordBatch) -> dict:
        raws = raw_texts(batch, "text")
        out = [_row(raw, *found) for raw, found in zip(raws, find(raws), strict=True)]
        return {"doc_id": batch.column(0)} | {c: [x[c] for x in out] for c in columns}

    return map_rows(rows, scan, schema, at_once)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", window: int = 13, max_block_bytes: int = 2_000_000) -> DataFrame:
    """The rows of docs, whole and in place, that decontaminate() doesn't find contaminated; other columns, whatever their names, stay as they are."""
    find, at_once = _finder(docs, benchmark, item_column, item_text_column, window, max_block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at_once):
            hits = [(n, sum(b - a for a, b in spans)) for n, spans, _ in find(raw_texts(batch, text_column))]
            yield batch.filter(pa.array([not (hit > 0 and 20 * hit >= n) for n, hit in hits], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
