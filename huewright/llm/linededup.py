"""Substring deduplication by hashing lines or paragraphs.

Units (lines, or paragraphs between blank lines) are normalised to their words, hashed to 128 bits and grouped over all documents. The
earliest ranked occurrence of a unit stays (smallest doc_id, then text, then place) and all others are removed, with
their offsets in the original text kept.

Hashing the units happens once, into a written table of digests. The first occurrence of a digest is an aggregate with partial sums in each task, so a line that
stands in a third of all documents costs one row for each task; the join back needs that one row for each digest and Spark splits its hot keys.

Runs of words (`runs`, 50 say) are units too where asked for, wherever they begin and whatever lines they stand in. Lines of so many words are hashed first, and only their first copies go on. Every window of so many words
has a least shingle of half as many (its mark), and equal windows have equal marks. Marks that occur once in the corpus rule out their windows, so the digests of
windows are sent only where a mark repeats; no repeated run is lost by this. Marks and digests travel packed, many to a row, dealt by ranges of their
values; a batch sends one entry for each, so a passage that stands in a third of all documents costs one entry for each batch. Texts that are whole
copies of another are known by their digest and take no part in this.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, alnum_words, code_points, few, map_rows, raw_texts, slices, union_spans, written

_PARAGRAPH = re.compile(rb"\n(?:[ \t\r]*\n)+")
_WORD = re.compile(rb"[^ ]+")
# Odd multipliers of the rolling digests and of the order of marks.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def units(raw: bytes, unit: str = "line") -> list[tuple[int, int]]:
    """Byte spans of the units of a text, in order; they and the breaks between them make up the text."""
    spans, at = [], 0
    for m in re.finditer(rb"\n", raw) if unit == "line" else _PARAGRAPH.finditer(raw):
        spans.append((at, m.start()))
        at = m.end()
    return [*spans, (at, len(raw))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _rolling(values: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomial digest modulo 2^64 of each k values in a row."""
    n = len(values)
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * np.multiply.accumulate(up), dtype=np.uint64)])
    return (sums[k:] - sums[:-k]) * np.multiply.accumulate(down)[: n - k + 1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


class _Digests(dict):
    """Words to their 64-bit digests; at most 100,000 words are remembered."""

    def __missing__(self, word: bytes) -> int:
        x = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = x
        return x


def _values(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit digests of the words."""
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def run_marks(values: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, value) of the mark of each window of `runs` words: its least shingle of half as many, the first of equal ones."""
    half = (runs + 1) // 2
    shingles = _mixed(_rolling(values, half, _BASES[0]))
    least = np.lib.stride_tricks.sliding_window_view(shingles, runs - half + 1).argmin(1)
    at = least + np.arange(len(least))
    return at, shingles[at].view(np.int64)


def _dealt(bucket: np.ndarray, columns: dict[str, np.ndarray], parts: dict[int, dict[str, bytes]]) -> None:
    """Adds to parts the columns' values of each bucket, in the order in which they stand."""
    by = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.diff(bucket[by], prepend=-1))
    for k, end in zip(starts.tolist(), [*starts[1:].tolist(), len(by)][: len(starts)], strict=True):
        row = parts.setdefault(int(bucket[by[k]]), {})
        for c, x in columns.items():
            row[c] = x[by[k:end]].tobytes()


def _packed_rows(parts: dict[int, dict[str, bytes]], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array(list(parts), pa.int64())} | {c: pa.array([row.get(c, b"") for row in parts.values()], pa.binary()) for c in names})


def _column(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return new


def _of_content(content: np.ndarray, values: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """One row for each content: its values, packed; values: by column, the contents and what they have."""
    sorted_ = {c: (of[o], x[o]) for c, (of, x) in values.items() for o in [np.argsort(of, kind="stable")]}
    cut = {c: (np.searchsorted(of, content), np.searchsorted(of, content, side="right")) for c, (of, _) in sorted_.items()}
    return pa.table({"content": pa.array(content, pa.int64())} | {c: pa.array([x[i:j].tobytes() for i, j in zip(*(e.tolist() for e in cut[c]), strict=True)], pa.binary()) for c, (_, x) in sorted_.items()})


def _outside(lines: bytes, runs: int, n: int) -> np.ndarray:
    """Which of n windows don't stand whole in one of the lines (packed start and end of their words)."""
    change = np.zeros(n + 1, np.int64)
    for start, end in np.frombuffer(lines, np.int32).reshape(-1, 2).tolist():
        change[start] += 1
        change[end - runs + 1] -= 1
    return np.cumsum(change[:n]) == 0


_MARKS = ("mark", "owner", "self", "known_mark", "known_owner")


def _repeated_marks(rows: DataFrame, runs: int, buckets: int) -> DataFrame:
    """(content, marks, n): for each text the packed marks that stand twice or more in all, n of them."""

    def deal(marks: list, owners: list, selfs: list) -> pa.RecordBatch:
        mark, of, own = np.concatenate(marks), np.repeat(np.array(owners, np.int64), [len(m) for m in marks]), np.concatenate(selfs)
        order = np.argsort(mark, kind="stable")
        mark, of, own = mark[order], of[order], own[order]
        starts = np.flatnonzero(_heads(mark))
        counts = np.diff(np.append(starts, len(mark)))
        flag = (counts > 1) | np.logical_or.reduceat(own, starts)
        parts: dict[int, dict[str, bytes]] = {}
        first, shared = starts[np.argsort(of[starts], kind="stable")], np.repeat(counts > 1, counts)
        flags = np.repeat(flag, counts)
        _dealt(_bucket(mark[first], buckets), {"mark": mark[first], "owner": of[first], "self": flags[first]}, parts)
        _dealt(_bucket(_mixed(of[shared].view(np.uint64)), buckets), {"known_mark": mark[shared], "known_owner": of[shared]}, parts)
        return _packed_rows(parts, _MARKS)

    def run(batches):
        known, seen = _Digests(), set()
        marks, owners, selfs, total = [], [], [], 0
        for batch in slices(batches):
            for content, raw, lines in zip(batch.column(0).to_pylist(), raw_texts(batch, "text"), batch.column(2).to_pylist(), strict=True):
                words = [] if content in seen else alnum_words(raw)
                seen.add(content)
                if len(words) >= runs:
                    at, value = run_marks(_values(words, known), runs)
                    if lines:
                        rest = _outside(lines, runs, len(at))
                        at, value = at[rest], value[rest]
                    found, n = np.unique(value[np.unique(at, return_index=True)[1]].view(np.uint64), return_counts=True)
                    marks.append(found)
                    owners.append(content)
                    selfs.append(n > 1)
                    total += len(found)
                if total >= 500_000:
                    yield deal(marks, owners, selfs)
                    marks, owners, selfs, total = [], [], [], 0
        if marks:
            yield deal(marks, owners, selfs)

    def gather(table: pa.Table) -> pa.Table:
        mark, of, own = _column(table, "mark", np.uint64), _column(table, "owner", np.int64), _column(table, "self", bool)
        order = np.argsort(mark)
        mark, of, own = mark[order], of[order], own[order]
        if len(mark):
            starts = np.flatnonzero(_heads(mark))
            again = (np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts)) | np.logical_or.reduceat(own, starts)
            again = np.repeat(again, np.diff(np.append(starts, len(mark))))
            mark, of = mark[again], of[again]
        mark, of = np.concatenate([mark, _column(table, "known_mark", np.uint64)]), np.concatenate([of, _column(table, "known_owner", np.int64)])
        return _of_content(np.unique(of), {"marks": (of, mark)})

    dealt = rows.select("content", "text", "lines").where("text is not null").mapInArrow(run, "bucket long, " + ", ".join(f"{c} binary" for c in _MARKS))
    found = dealt.groupBy("bucket").applyInArrow(gather, "content long, marks binary")
    return found.groupBy("content").agg(F.collect_list("marks").alias("marks"), F.sum(F.octet_length("marks") / 8).cast("long").alias("n"))


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


_WINDOWS = ("high", "low", "rank", "content", "place", "again", "gone_content", "gone_place")


def _repeated_runs(marked: DataFrame, runs: int, buckets: int) -> DataFrame:
    """(content, gone, held): packed (start, end) of the words in windows that an earlier place holds, and of those whose first place this is.

    marked: (content, rank, text, marks, lines). Places are ranked by rank, content and place.
    """

    def deal(found: list[tuple]) -> pa.RecordBatch:
        high, low, rank, content, place, mark = (np.concatenate([x[k] for x in found]) for k in range(6))
        order = np.lexsort((place, content, rank, low, high))
        head = _heads(high[order], low[order])
        counts = np.diff(np.append(np.flatnonzero(head), len(order)))
        first, rest, again = order[head], order[~head], counts > 1
        tidy = np.lexsort((place[first], content[first]))
        first, again = first[tidy], again[tidy]
        parts: dict[int, dict[str, bytes]] = {}
        _dealt(_bucket(mark[first], buckets), {"high": high[first], "low": low[first], "rank": rank[first], "content": content[first], "place": place[first], "again": again}, parts)
        _dealt(_bucket(_mixed(content[rest].view(np.uint64)), buckets), {"gone_content": content[rest], "gone_place": place[rest]}, parts)
        return _packed_rows(parts, _WINDOWS)

    def run(batches):
        known, seen = _Digests(), set()
        found, total = [], 0
        for batch in slices(batches):
            for content, rank, raw, marks, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch, "text"), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if content in seen:
                    continue
                seen.add(content)
                values = _values(alnum_words(raw), known)
                mark = run_marks(values, runs)[1].view(np.uint64)
                here = np.isin(mark, np.frombuffer(b"".join(marks), np.uint64))
                at = np.flatnonzero(here & _outside(lines, runs, len(mark)) if lines else here)
                found.append((_rolling(values, runs, _BASES[0])[at], _rolling(_mixed(values), runs, _BASES[1])[at], np.full(len(at), rank, np.int64), np.full(len(at), content, np.int64), at.astype(np.int32), mark[at]))
                total += len(at)
                if total >= 500_000:
                    yield deal(found)
                    found, total = [], 0
        if found:
            yield deal(found)

    def spans(content: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(content, (start, end)) of the words of windows, those of places in a row as one."""
        order = np.lexsort((place, content))
        content, place = content[order], place[order]
        head = _heads(content, place - np.arange(len(place), dtype=np.int32))
        ends = np.append(np.flatnonzero(head)[1:], len(place)) - 1 if len(place) else np.zeros(0, np.int64)
        return content[head], np.stack([place[head], place[ends] + np.int32(runs)], 1)

    def gather(table: pa.Table) -> pa.Table:
        high, low, rank, content, place, again = (_column(table, c, t) for c, t in zip(_WINDOWS, (np.uint64, np.uint64, np.int64, np.int64, np.int32, bool), strict=False))
        order = np.lexsort((place, content, rank, low, high))
        high, low, content, place, again = high[order], low[order], content[order], place[order], again[order]
        new = _heads(high, low, content, place)  # a row that two tasks hold is one
        head = _heads(high, low)
        starts = np.flatnonzero(head)
        sizes = np.diff(np.append(starts, len(head)))
        many = np.repeat((np.add.reduceat(new.astype(np.int64), starts) > 1) | np.logical_or.reduceat(again, starts), sizes) if len(head) else head
        gone, held = new & ~head & many, head & many
        x = spans(np.concatenate([content[gone], _column(table, "gone_content", np.int64)]), np.concatenate([place[gone], _column(table, "gone_place", np.int32)]))
        y = spans(content[held], place[held])
        return _of_content(np.unique(np.concatenate([x[0], y[0]])), {"gone": x, "held": y})

    dealt = marked.select("content", "rank", "text", "marks", "lines").mapInArrow(run, "bucket long, " + ", ".join(f"{c} binary" for c in _WINDOWS))
    return dealt.groupBy("bucket").applyInArrow(gather, "content long, gone binary, held binary").groupBy("content").agg(F.collect_list("gone").alias("gone"), F.collect_list("held").alias("held"))


def _rank(column: Column, kind: T.DataType) -> Column:
    """Ids in order as numbers; ids that aren't numbers by a digest. Null ranks first."""
    number = column.cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(column)
    return F.coalesce(number, F.lit(-(1 << 63)))


def _long_units(rows: DataFrame, kind: T.DataType, unit: str, min_words: int, broadcast_limit: int) -> DataFrame:
    """(content, gone, held): packed (start, end) of the words of each text's units of min_words or more that an earlier place holds, and of those whose first place this is."""

    def hashes(batch: pa.RecordBatch) -> dict:
        row, start, end, high, low = [], [], [], [], []
        for k, raw in enumerate(raw_texts(batch, "text")):
            at = 0
            for a, b in units(raw, unit) if raw else ():
                words = alnum_words(raw[a:b])
                if len(words) >= min_words:
                    x = xxhash.xxh3_128_intdigest(b" ".join(words))
                    row.append(k)
                    start.append(at)
                    end.append(at + len(words))
                    high.append(_signed(x >> 64))
                    low.append(_signed(x & ((1 << 64) - 1)))
                at += len(words)
        of = pa.array(row, pa.int64())
        return {"content": batch.column(0).take(of), "rank": batch.column(1).take(of), "start": start, "end": end, "high": high, "low": low}

    texts = rows.select("content", _rank(F.col("doc_id"), kind).alias("rank"), "text")
    digests = map_rows(texts, hashes, "content long, rank long, start int, end int, high long, low long", 1000)
    digests = written(digests.groupBy("content", "start", "end", "high", "low").agg(F.min("rank").alias("rank")))  # whole copies are one text
    place = F.struct("rank", "content", "start")
    first = written(digests.groupBy("high", "low").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").drop("last"))
    found = digests.join(few(first, broadcast_limit // 5), ["high", "low"]).select("content", F.struct("start", "end").alias("span"), (place != F.col("first")).alias("again"))
    sums = found.groupBy("content").agg(*(F.sort_array(F.collect_list(F.when(c, F.col("span")))).alias(n) for n, c in (("gone", F.col("again")), ("held", ~F.col("again")))))

    def pack(batch: pa.RecordBatch) -> dict:
        spans = lambda x: np.array([(s["start"], s["end"]) for s in x], np.int32).tobytes()
        return {"content": batch.column(0)} | {n: [spans(x) for x in batch.column(k).to_pylist()] for k, n in ((1, "gone"), (2, "held"))}

    return written(map_rows(sums, pack, "content long, gone binary, held binary"))


def _runs(rows: DataFrame, kind: T.DataType, runs: int, broadcast_limit: int, bucket_words: int, unit: str | None) -> DataFrame:
    """(content, first, copies, gone, held) of the texts that hold a repeated run or have copies.

    Where there is a unit, units of `runs` words or more are hashed first; the windows inside those that go are known and looked up no more. The first copies of
    these units stay in the index, so other runs are found against them.
    """
    lines = _long_units(rows, kind, unit, runs, broadcast_limit) if unit else None
    if unit:
        size = F.lit(2) + (F.octet_length("gone") + F.octet_length("held")) / 8
        rows = rows.join(few(lines, broadcast_limit, size).select("content", F.col("gone").alias("lines")), "content", "left").select(*rows.columns, "lines")
    else:
        rows = rows.withColumn("lines", F.lit(None).cast("binary"))
    words = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(words // 6 // bucket_words + 1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), words // 60_000 + 1))
    contents = written(rows.where("text is not null").groupBy("content").agg(F.min(F.struct("doc_id"))["doc_id"].alias("first"), F.count_distinct("doc_id", F.lit(0)).alias("ids"), F.max(F.col("doc_id").isNull()).alias("loose")))
    marked = written(_repeated_marks(rows, runs, buckets).join(contents.select("content", "first"), "content"))
    texts = rows.join(few(marked, broadcast_limit, F.col("n")), "content").where(F.col("doc_id").eqNullSafe(F.col("first")))
    found = _repeated_runs(texts.withColumn("rank", _rank(F.col("doc_id"), kind)), runs, buckets)
    copies = contents.where("ids + cast(loose as int) > 1").select("content", "first", F.lit(True).alias("copies"))
    if unit:
        both = lambda c: F.concat(F.coalesce(c, F.array().cast("array<binary>")), F.array_compact(F.array(f"line_{c}"))).alias(c)
        found = found.join(lines.select("content", *(F.col(c).alias(f"line_{c}") for c in ("gone", "held"))), "content", "full").select("content", both("gone"), both("held"))
    return found.join(copies, "content", "full")


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.col(text_column).cast("string")
    return docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("content"), text.alias("text"))


def _lines(rows: DataFrame, ident: str, unit: str, min_words: int) -> DataFrame:
    """(doc_id, content, places): the units of each document that an earlier place holds."""

    def hashes(batch: pa.RecordBatch) -> dict:
        row, place, high, low = [], [], [], []
        for k, raw in enumerate(raw_texts(batch, "text")):
            for n, (a, b) in enumerate(units(raw, unit) if raw else ()):
                words = alnum_words(raw[a:b])
                if len(words) >= min_words:
                    x = xxhash.xxh3_128_intdigest(b" ".join(words))
                    row.append(k)
                    place.append(n)
                    high.append(_signed(x >> 64))
                    low.append(_signed(x & ((1 << 64) - 1)))
        of = pa.array(row, pa.int64())
        return {"doc_id": batch.column(0).take(of), "content": batch.column(1).take(of), "place": place, "high": high, "low": low}

    digests = written(map_rows(rows, hashes, f"doc_id {ident}, content long, place long, high long, low long"))
    rank = F.struct("doc_id", "content", "place")
    # Written, so that Spark can split the hot digests of the join that follows.
    first = written(digests.groupBy("high", "low").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first != last").drop("last"))
    repeats = digests.join(first, ["high", "low"]).where(~rank.eqNullSafe(F.col("first")))
    return repeats.groupBy("doc_id", "content").agg(F.sort_array(F.collect_set("place")).alias("places"))


def remove_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", unit: str | None = "line", min_words: int = 5, runs: int | None = None, broadcast_limit: int = 4_000_000, bucket_words: int = 10_000_000) -> DataFrame:
    """One row for each row of docs: doc_id, text (what stays), n_units, n_removed, removed (code point spans in the original text), n_repeated.

    Units of fewer than min_words words are never removed; unit None has none. Kept units are joined by the breaks that stood before them. With `runs`, every word goes as well that
    stands in a run of so many words (or more) which an earlier place holds, in any lines; what stands between the first and last word of a run goes with it. Units of min_words >= runs are
    such runs: they are hashed first and go as their words, and runs add what begins or ends elsewhere (n_units is 0 then). removed is
    then the union of units and runs, and n_removed its number of spans. A removed word always has an earlier copy that stays. n_repeated is the number of words in
    runs that stand elsewhere too, whether they go or are the first of their kind. Rows equal in id and text
    count as one document and get equal results; a null id ranks first, an id that is no number by a digest (for runs); a null text stays null. An empty table gives no rows; other
    columns are not read. What is found is sent to the tasks where it is no more than broadcast_limit numbers, else the texts are joined to it.
    """
    ident = docs.schema[id_column].dataType.simpleString()
    rows = _keyed(docs, id_column, text_column)
    joined = rows
    long_units = unit if runs and min_words >= runs else None
    unit = None if long_units else unit
    if unit:
        places = written(_lines(rows, ident, unit, min_words))
        of = few(places, broadcast_limit, F.size("places")).alias("p")
        joined = joined.alias("r").join(of, F.col("r.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("r.content") == F.col("p.content")), "left").select("r.*", "places")
    else:
        joined = joined.withColumn("places", F.lit(None).cast("array<long>"))
    if runs:
        found = written(_runs(rows, docs.schema[id_column].dataType, runs, broadcast_limit, bucket_words, long_units))
        size = F.lit(4) + F.coalesce(F.size("gone"), F.lit(0)) + F.coalesce(F.size("held"), F.lit(0))
        joined = joined.join(few(found, broadcast_limit, size), "content", "left")
        joined = joined.withColumn("copy", F.coalesce("copies", F.lit(False)) & ~F.col("doc_id").eqNullSafe(F.col("first")))
    else:
        joined = joined.select("*", *(F.lit(None).cast("array<binary>").alias(c) for c in ("gone", "held")), *(F.lit(False).alias(c) for c in ("copies", "copy")))

    def spans_of(parts: list[bytes] | None) -> list[tuple[int, int]]:
        return union_spans(map(tuple, np.frombuffer(b"".join(parts or ()), np.int32).reshape(-1, 2).tolist()))

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"text": [], "n_units": [], "n_removed": [], "removed": [], "n_repeated": []}
        for raw, places, gone, held, copies, copy in zip(raw_texts(batch, "text"), *(batch.column(k).to_pylist() for k in range(2, 7)), strict=True):
            spans = units(raw, unit) if raw is not None and unit else []
            lines = set(places or ())
            ends = [0, *(b for _, b in spans)]
            lost = [spans[k] for k in sorted(lines)]
            # A unit goes with the break before it; the first that stays loses its break.
            first_kept = next((k for k in range(len(spans)) if k not in lines), 0)
            cuts = [(ends[k], spans[k][1]) for k in lines] + ([(ends[first_kept], spans[first_kept][0])] if first_kept else [])
            repeated = 0
            if raw and (gone or held or copies):
                words = [m.span() for m in _WORD.finditer(raw.translate(ALNUM))]
                whole = [(0, len(words))] if copies and len(words) >= runs else []
                covered = whole if copy else spans_of(gone)
                lost += (more := [(words[p][0], words[q - 1][1]) for p, q in covered])
                cuts += more
                repeated = sum(q - p for p, q in whole or union_spans(spans_of(gone) + spans_of(held)))
            lost, text, at = union_spans(lost), b"", 0
            for x, y in union_spans(cuts):
                text, at = text + raw[at:x], y
            text = None if raw is None else text + raw[at:]
            points = code_points(raw or b"", (x for span in lost for x in span))
            out["text"].append(None if raw is None else text.decode("utf-8", "replace"))
            out["n_units"].append(len(spans))
            out["n_removed"].append(len(lost))
            out["removed"].append([{"start": points[x], "end": points[y]} for x, y in lost])
            out["n_repeated"].append(repeated)
        return {"doc_id": batch.column(0)} | out

    return map_rows(joined.select("doc_id", "text", "places", "gone", "held", "copies", "copy"), cut, f"doc_id {ident}, text string, n_units long, n_removed long, removed array<struct<start:long,end:long>>, n_repeated long", 1000)
