"""Exact Jaccard join of documents on word n-grams, by partitions of the universe of shingles.

Sets of similarity p or more differ in at most H = (a + b)(1 - p) / (1 + p) shingles. A hash splits the universe into m segments; two sets that
differ in at most H shingles agree in a segment where m > H, since H differences can't reach all of them. Sizes are grouped in bands, so wide that
partners are in the same or the next band, and m is fixed for a band and the next one.

1. Every set puts the hash of each of its segments, but for empty ones, on the index (a few more than H + 1 of them, so few sets have too many
   empty ones). Entries travel packed, many to a row, dealt by ranges of hashes. Sets that share a hash with up to `small` - 1 others are candidates with
   them. A set is "hot" if fewer than H + 1 of its segments are neither empty nor that frequent: it goes to step 3. A set that isn't hot agrees
   with each of its partners in one of the others, so a pair that no small bucket shows is a pair of hot sets.
2. A candidate is kept if parity sketches (512 bits, each toggled by the shingles that hash to it) don't show more than H differences. Each set is
   verified with its nearest candidate, and each hot set with the most central set of its most frequent segment; the links found are joined to
   components. Hot sets then go on to meet one set of another component for each of some of their segments, as long as that joins components, so a
   large group is one component before its sets are compared. Only candidates in different components are verified after that: links inside a
   component can't change it.
3. Hot sets are indexed by whole segments and by their one-deletion neighbourhoods, of which only those count that sets of different components
   share. Each set allots its H + 1 units to segments: 0 skips a segment, 1 looks for equal ones, 2 looks for those that differ in up to one shingle.
   The units are chosen at the least cost, the number of index entries that they would meet. So a set whose own passages fill enough segments
   never meets the thousands of others that share the rest. Of two sets only the one of the smaller component looks for the other (of equal ones,
   the one of the lower cost), so the largest component only stands in the index, and there only at the entries that others look up.

Exact copies are one set throughout: a set is named by a 64-bit hash of its shingles, and shingles by 64-bit hashes of their words. For n
distinct sets two share a name with probability of about n**2 / 2**65. Verification compares whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import LOWER, few, map_rows, raw_texts, slices, space_words, unused, written

#: 64-bit words of the parity sketch.
SKETCH = 8
SKETCHES = [f"s{k}" for k in range(SKETCH)]
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Words to their hashes; at most 100,000 words are remembered."""

    def __missing__(self, word: bytes) -> int:
        x = xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = x
        return x


#: Words that are hashed together.
CHUNK = 200_000


def shingle_sets(raws: list[bytes | None], n: int, known: dict[bytes, int] | None = None) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-grams of words, A-Z in lower case; of the whole sequence if it has fewer words."""
    known = _Hashes() if known is None else known
    waiting, total = [], 0
    for raw in raws:
        waiting.append(space_words(raw.translate(LOWER) if raw else None))
        total += len(waiting[-1])
        if total >= CHUNK:
            yield from _chunk_sets(waiting, total, n, known)
            waiting, total = [], 0
    yield from _chunk_sets(waiting, total, n, known)


def _chunk_sets(lists: list[list[bytes]], total: int, n: int, known: dict[bytes, int]) -> Iterator[np.ndarray]:
    h = np.fromiter(map(known.__getitem__, chain.from_iterable(lists)), np.uint64, total)
    x = _mix(h[: max(total - n + 1, 0)])
    for k in range(1, n):
        x = _mix(x * _ODD[0] + h[k : len(x) + k] + np.uint64(k))
    at = 0
    for words in lists:
        if len(words) >= n:
            yield np.unique(x[at : at + len(words) - n + 1])
        else:
            yield np.array([xxh3_64_intdigest(b" ".join(words), len(words))] if words else [], np.uint64)
        at += len(words)


def shingles(raw: bytes | None, n: int) -> np.ndarray:
    """shingle_sets of one text."""
    return next(shingle_sets([raw], n))


def set_name(s: np.ndarray) -> int:
    """A set's signed 64-bit name."""
    x = _mix(s.sum(dtype=np.uint64, keepdims=True) * _ODD[4] + np.uint64(len(s))) ^ np.bitwise_xor.reduce(_mix(s * _ODD[3]), keepdims=True)
    return int(x.astype(np.int64)[0])


def sketch(s: np.ndarray) -> np.ndarray:
    bits = np.bincount((_mix(s ^ _ODD[4]) & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


class Bands:
    """Bands of sizes for a threshold in percent: scheme i serves band i and the next one."""

    def __init__(self, percent: int):
        self.percent = percent
        self.lows, self.most = [1], []

    def differences(self, a: int, b: int) -> int:
        """Most shingles in which linked sets of these sizes differ."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def of(self, size: int) -> list[tuple[int, int]]:
        """(scheme, most differences) of the schemes of a set; schemes where only equal sets link are left out."""
        while self.lows[-1] <= size:
            high = self.lows[len(self.most)] * 100 // self.percent
            self.most.append(self.differences(high, high * 100 // self.percent))
            self.lows.append(high + 1)
        band = int(np.searchsorted(self.lows, size, side="right")) - 1
        return [(k, self.most[k]) for k in (band - 1, band) if k >= 0 and self.most[k] > 0]


def _segments(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, start) of the segments that are not empty, in the sorted set."""
    number = (((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    return number[starts], starts


def _key(scheme: int, m: int, number: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Signed key of a segment's content (the sum of its mixed shingles, 0 if empty)."""
    of = np.uint64((scheme * 2 + 1) * int(_ODD[3]) + m & (1 << 64) - 1)
    place = _mix(number.astype(np.uint64) * _ODD[4] + of)
    return _mix(content ^ place).astype(np.int64)


def _spare(most: int) -> int:
    """Segments beyond H + 1: a segment is empty about once in 20 to 40 times, so one set in a hundred has more empty ones at 80 %, and next to none at 85 %."""
    return 2 + most // 12


def _index_rows(bands: Bands, s: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Keys of the set's segments in each scheme, and how many more of them than H + 1 there are."""
    keys, slack = [], []
    mixed = _mix(s + _ODD[0])
    for scheme, most in bands.of(len(s)):
        m = most + 1 + _spare(most)
        number, starts = _segments(s, m)
        slack.append(len(number) - most - 1)
        keys.append(_key(scheme, m, number, np.add.reduceat(mixed, starts)))
    return keys, slack


def _names(docs: DataFrame, n: int, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, n, name, sketch) of every row; a set without shingles has no name."""
    ident = docs.schema[id_column].dataType.simpleString()

    known = _Hashes()

    def run(batch: pa.RecordBatch) -> dict:
        made = [(len(s), set_name(s) if len(s) else None, sketch(s)) for s in shingle_sets(raw_texts(batch, "text"), n, known)]
        bits = np.stack([x[2] for x in made]) if made else np.zeros((0, SKETCH), np.int64)
        return {"doc_id": batch.column(0), "n": [x[0] for x in made], "name": [x[1] for x in made]} | {c: bits[:, k].tolist() for k, c in enumerate(SKETCHES)}

    return map_rows(_texts(docs, id_column, text_column), run, f"doc_id {ident}, n int, name long, " + ", ".join(f"{c} long" for c in SKETCHES), 1000)


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal values in a sorted array."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(x)))


def _packed(keys: np.ndarray) -> bytes:
    """The low five bytes of each key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view("<u8").ravel()


_ENTRIES = ("keys", "names", "slots", "frequent", "hot", "hot_slots", "hot_counts")


def _index(docs: DataFrame, n: int, percent: int, small: int, text_column: str, buckets: int) -> DataFrame:
    """(bucket, keys, names, slots, frequent, hot, hot_slots, hot_counts): the segments of all sets, packed by ranges of their keys.

    A key is left five bytes beside its bucket; keys that coincide by chance only make a candidate more. A slot is a set's scheme (0 or 1) and its slack,
    doubled: the segments that it can spare there. A segment that more than `small` sets of a batch share is frequent: one
    entry stands for all of them, so no bucket gets many entries of one segment, and its sets are counted at once (hot_counts by set and slot).
    """
    schema = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in _ENTRIES)])

    def rows(names: list, keys: list, slots: list, counted: list, known: set) -> pa.RecordBatch:
        sizes = [len(k) for k in keys]
        key, name, slot = np.concatenate(keys).view(np.uint64), np.repeat(np.array(names, np.int64), sizes), np.repeat(np.array(slots, np.int32), sizes)
        order = np.argsort(key)
        starts, counts = _runs(key[order])
        much = counts > small
        new = key[order][starts[much]]
        known.update(new.tolist())
        gone = np.zeros(len(key), bool)
        gone[order[np.repeat(much, counts)]] = True
        bucket = lambda k: ((k >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        parts: dict[int, list[bytes]] = {}

        def deal(at: int, of: np.ndarray, values: np.ndarray, pack) -> None:
            by = np.argsort(of, kind="stable")
            starts, counts = _runs(of[by])
            for b, x, c in zip(of[by][starts].tolist(), starts.tolist(), counts.tolist(), strict=True):
                parts.setdefault(b, [b""] * len(_ENTRIES))[at] = pack(values[by[x : x + c]])

        whole, raw = np.flatnonzero(~gone), np.ndarray.tobytes
        deal(0, bucket(key[whole]), key[whole], _packed)
        deal(1, bucket(key[whole]), name[whole], raw)
        deal(2, bucket(key[whole]), slot[whole], raw)
        deal(3, bucket(new), new, _packed)
        hot = _counted(np.concatenate([name[gone], np.array([x[0] for x in counted], np.int64)]), np.concatenate([slot[gone], np.array([x[1] for x in counted], np.int32)]), np.concatenate([np.ones(gone.sum(), np.int32), np.array([x[2] for x in counted], np.int32)]))
        for at, x in zip((4, 5, 6), hot, strict=True):
            deal(at, hot[0] % buckets, x, raw)
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), *(pa.array([v[k] for v in parts.values()], pa.binary()) for k in range(len(_ENTRIES)))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, known, seen, hashes = Bands(percent), set(), set(), _Hashes()
        names, keys, slots, counted, total = [], [], [], [], 0
        for batch in slices(batches):
            for s in shingle_sets(raw_texts(batch, "text"), n, hashes):
                if len(s) == 0 or (name := set_name(s)) in seen:
                    continue
                seen.add(name)
                for k, (key, slack) in enumerate(zip(*_index_rows(bands, s), strict=True)):
                    slot = 2 * slack + k
                    gone = np.array([x in known for x in key.view(np.uint64).tolist()], bool) if known else np.zeros(len(key), bool)
                    # A set with too many empty segments is hot without any frequent one.
                    if slack < 0 or gone.any():
                        counted.append((name, slot, int(gone.sum())))
                    names.append(name)
                    slots.append(slot)
                    keys.append(key[~gone])
                    total += len(keys[-1])
            if total >= 400_000:
                yield rows(names, keys, slots, counted, known)
                names, keys, slots, counted, total = [], [], [], [], 0
        if names:
            yield rows(names, keys, slots, counted, known)

    return docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(run, "bucket long, " + ", ".join(f"{c} binary" for c in _ENTRIES))


def _counted(names: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, slots, counts), one for each name and slot."""
    order = np.lexsort((slots, names))
    names, slots, counts = names[order], slots[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (slots[1:] != slots[:-1])])) if len(names) else np.zeros(0, np.int64)
    return names[starts], slots[starts], np.add.reduceat(counts, starts).astype(np.int32) if len(names) else counts


def _buckets(index: DataFrame, small: int) -> DataFrame:
    """(members, slot, count): the members of each segment of 2 to small distinct sets, by name; and sets alone with their numbers of more frequent segments in a slot.

    A list may come from several tasks, and so may the counts of a set.
    """

    def gather(table: pa.Table) -> pa.Table:
        column = lambda c: [x for x in table.column(c).to_pylist() if x]
        numbers = lambda c, kind: np.frombuffer(b"".join(column(c)), kind)
        keys, names, slots = _unpacked(column("keys")), numbers("names", np.int64), numbers("slots", np.int32)
        frequent = np.unique(_unpacked(column("frequent")))
        order = np.argsort(keys)
        k = keys[order]
        same = np.concatenate([[False], k[1:] == k[:-1], [False]]) if len(k) else np.zeros(1, bool)
        again = same[1:] | same[:-1] | np.isin(k, frequent)
        k, v, w = k[again], names[order[again]], slots[order[again]]
        order = np.lexsort((v, k))
        k, v, w = k[order], v[order], w[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])]) if len(k) else np.zeros(0, bool)
        k, v, w = k[new], v[new], w[new]
        starts, counts = _runs(k)
        much = (counts > small) | np.isin(k[starts], frequent)
        each = np.repeat(much, counts)
        hot = _counted(np.concatenate([v[each], numbers("hot", np.int64)]), np.concatenate([w[each], numbers("hot_slots", np.int32)]), np.concatenate([np.ones(each.sum(), np.int32), numbers("hot_counts", np.int32)]))
        lists = [hot[0].reshape(-1, 1)]
        for c in np.unique(counts[~much & (counts > 1)]).tolist():
            lists.append(np.unique(v[starts[~much & (counts == c)][:, None] + np.arange(c)], axis=0))
        ends = np.cumsum(np.concatenate([[0], *(np.full(len(x), x.shape[1]) for x in lists)]))
        rest = np.zeros(len(ends) - 1 - len(hot[0]), np.int32)
        members = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([x.ravel() for x in lists]), pa.int64()))
        return pa.table({"members": members, "slot": pa.array(np.concatenate([hot[1].astype(np.int32), rest])), "count": pa.array(np.concatenate([hot[2], rest]))})

    return index.groupBy("bucket").applyInArrow(gather, "members array<long>, slot int, count int")


def _pairs(members: str) -> Column:
    """All pairs of a small bucket's members (a before b by name)."""
    m = F.col(members)
    rest = lambda x, i: F.transform(F.slice(m, i + 2, F.size(m)), lambda y: F.struct(x.alias("a"), y.alias("b")))
    return F.flatten(F.transform(m, rest))


def _size_fits(percent: int, na: Column, nb: Column) -> Column:
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def _difference(x: str, y: str) -> Column:
    """Differences that the sketches of two sets show; there are at least as many."""
    total = F.bit_count(F.col(f"{x}.{SKETCHES[0]}").bitwiseXOR(F.col(f"{y}.{SKETCHES[0]}")))
    for c in SKETCHES[1:]:
        total = total + F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")))
    return total


def _may_link(percent: int, na: Column, nb: Column, difference: Column) -> Column:
    return (100 + percent) * difference <= (100 - percent) * (na + nb)


def _sketched(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, d) of the pairs whose sizes and sketches allow a link; d is the difference that the sketches show."""
    x, y = (classes.select(F.col("name").alias(c), "n", *SKETCHES).alias(k) for c, k in (("a", "x"), ("b", "y")))
    joined = pairs.select("a", "b").join(x, "a").join(y, "b").withColumn("d", _difference("x", "y"))
    return joined.where(_size_fits(percent, F.col("x.n"), F.col("y.n")) & _may_link(percent, F.col("x.n"), F.col("y.n"), F.col("d"))).select("a", "b", "d")


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, repeated: bool, n: int, id_column: str, text_column: str, broadcast_limit: int) -> DataFrame:
    """(name, hot, shingles) of the wanted (name, hot), each from the row of its smallest id, read from the texts again.

    Their ids are sent to the tasks where there are no more than broadcast_limit, else the texts are joined to them. Where rows are repeated, sets are made distinct.
    """
    chosen = written(wanted.groupBy("name").agg(F.max("hot").alias("hot")).join(classes, "name").select(F.col("first").alias("doc_id"), "name", "hot"))
    rows = _texts(docs, id_column, text_column).join(few(chosen, broadcast_limit), "doc_id").select("name", "hot", "text")

    def run(batch: pa.RecordBatch) -> dict:
        names, hot = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        sets = list(shingle_sets(raw_texts(batch, "text"), n))
        same = [k for k, s in enumerate(sets) if len(s) and set_name(s) == names[k]]  # rows of equal ids may hold other texts
        return {"name": [names[k] for k in same], "hot": [hot[k] for k in same], "shingles": [sets[k].tobytes() for k in same]}

    found = map_rows(rows, run, "name long, hot boolean, shingles binary", 500)
    return found.dropDuplicates(["name"]) if repeated else found


def _wide(sets: DataFrame) -> DataFrame:
    """(name, n, bits): parity sketches of at least two bits for each shingle, so that they tell long sets apart as well; a power of two of bits."""

    def run(batch: pa.RecordBatch) -> dict:
        sizes, bits = [], []
        for raw in batch.column(1).to_pylist():
            s = np.frombuffer(raw, np.uint64)
            size = max(64 * SKETCH, 1 << (2 * len(s)).bit_length())
            found = np.bincount((_mix(s ^ _ODD[2]) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
            sizes.append(len(s))
            bits.append(np.packbits(found.astype(np.uint8)).tobytes())
        return {"name": batch.column(0), "n": sizes, "bits": bits}

    return map_rows(sets.select("name", "shingles"), run, "name long, n int, bits binary", 500)


def _shown(x: bytes, y: bytes) -> int:
    """Differences that two wide sketches show; the longer one is folded to the shorter one's size."""
    x, y = sorted((x, y), key=len)
    folded = np.bitwise_xor.reduce(np.frombuffer(y, np.uint8).reshape(-1, len(x)))
    return int.from_bytes((folded ^ np.frombuffer(x, np.uint8)).tobytes()).bit_count()


def _closer(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """The pairs whose wide sketches allow a link."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"a": [], "b": []}
        for a, b, na, nb, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (100 + percent) * _shown(x, y) <= (100 - percent) * (na + nb):
                out["a"].append(a)
                out["b"].append(b)
        return out

    x, y = (wide.select(F.col("name").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    return map_rows(pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "na", "nb", "bits_a", "bits_b"), run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, wide: DataFrame, percent: int, broadcast_limit: int) -> DataFrame:
    """(a, b) of the pairs that are linked, from their whole sets. A pair's first set travels to its second one."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"a": [], "b": []}
        for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                out["a"].append(a)
                out["b"].append(b)
        return out

    pairs = few(written(_closer(pairs, wide, percent)), broadcast_limit)
    x = sets.select(F.col("name").alias("a"), F.col("shingles").alias("set_a")).join(pairs, "a")
    y = sets.select(F.col("name").alias("b"), F.col("shingles").alias("set_b")).join(pairs.select("b").distinct(), "b", "left_semi")
    return map_rows(x.join(y, "b").select("a", "b", "set_a", "set_b"), run, "a long, b long", 500)


def components(links: DataFrame) -> DataFrame:
    """(name, label): the smallest name reachable by the links (a, b), for each name in them.

    Labels spread along links and then jump to their labels' labels, so the number of rounds grows with the logarithm of the longest path; each round is written.
    """
    both = written(links.union(links.select("b", "a")).distinct())
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "name"))
    while True:
        near = both.join(labels.withColumnRenamed("name", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "name")
        spread = labels.join(near, "name").select("name", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("name").alias("label"), F.col("label").alias("far"))
        new = written(spread.join(far, "label", "left").select("name", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        labels = new.select("name", "label")
        if new.where("old != label").isEmpty():
            return labels


def _united(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links (a, b): only the components that these touch are joined anew."""
    ends = _labelled(_labelled(links, labels, "a", "la"), labels, "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a != b")
    over = components(ends)
    new = over.select(F.col("name").alias("label"), F.col("label").alias("over"))
    old = labels.join(new, "label", "left").select("name", F.coalesce("over", "label").alias("label"))
    return written(old.union(over.join(labels, "name", "left_anti").select("name", "label")))


def _labelled(rows: DataFrame, labels: DataFrame, column: str, to: str) -> DataFrame:
    """rows with the label of a name; a name without links is its own."""
    found = labels.select(F.col("name").alias(column), F.col("label").alias(to))
    return rows.join(found, column, "left").withColumn(to, F.coalesce(to, column))


def _wholes(hot_sets: DataFrame, percent: int) -> DataFrame:
    """(key, name): some whole segments of hot sets, about eight of each scheme by a hash of their keys: enough to find a central set to try."""

    def run(batch: pa.RecordBatch) -> dict:
        bands = Bands(percent)
        keys, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = np.frombuffer(raw, np.uint64)
            mixed = _mix(s + _ODD[0])
            for scheme, most in bands.of(len(s)):
                number, starts = _segments(s, most + 1)
                key = _key(scheme, most + 1, number, np.add.reduceat(mixed, starts))
                keys.append(key[key % max(1, most // 8) == 0])
                names.append(np.full(len(keys[-1]), name))
        return {"key": np.concatenate(keys), "name": np.concatenate(names)}

    return map_rows(hot_sets.select("name", "shingles"), run, "key long, name long")


def _ranked(hot_sets: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """Hot sets with label and rank, the number of hot sets in their component; the largest component's rank, which no other has."""
    rows = _labelled(hot_sets, labels, "name", "label")
    counts = written(rows.groupBy("label").agg(F.count(F.lit(1)).alias("rank")))
    top = counts.agg(F.max(F.struct("rank", "label")).alias("top")).select("top.rank", "top.label").first()
    most = (top.rank or 0) + 1
    return rows.join(counts, "label").withColumn("rank", F.when(F.col("label") == top.label, F.lit(most)).otherwise(F.col("rank"))), most


def _neighbourhoods(hot_sets: DataFrame, percent: int, sketched: bool = False) -> DataFrame:
    """(key, name, label, rank, n, scheme, segment, whole, units): the whole segments of hot sets and those without one shingle; their sets' sketches too where asked for."""
    further = SKETCHES if sketched else []

    def run(batch: pa.RecordBatch) -> dict:
        bands = Bands(percent)
        parts: list[tuple] = []
        for name, raw, label, rank in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            s = np.frombuffer(raw, np.uint64)
            mixed = _mix(s + _ODD[0])
            for scheme, most in bands.of(len(s)):
                m = most + 1
                number, starts = _segments(s, m)
                content = np.zeros(m, np.uint64)
                content[number] = np.add.reduceat(mixed, starts)
                of = np.repeat(number, np.diff(np.append(starts, len(s))))  # segment of each shingle
                segment = np.concatenate([np.arange(m), of])
                key = _key(scheme, m, segment, np.concatenate([content, content[of] - mixed]))
                same = lambda x, kind=np.int64: np.full(len(key), x, kind)  # noqa: B023, E731
                bits = [same(x) for x in sketch(s)] if sketched else []
                parts.append((key, same(name), same(label), same(rank), same(len(s), np.int32), same(scheme, np.int32), segment.astype(np.int32), np.arange(len(key)) < m, same(m, np.int32), *bits))
        names = ("key", "name", "label", "rank", "n", "scheme", "segment", "whole", "units", *further)
        return {c: pa.array(np.concatenate([p[k] for p in parts])) if parts else [] for k, c in enumerate(names)}

    return map_rows(hot_sets.select("name", "shingles", "label", "rank"), run, "key long, name long, label long, rank long, n int, scheme int, segment int, whole boolean, units int" + "".join(f", {c} long" for c in further), 500)


def _crossing(hot_sets: DataFrame, most: int, percent: int, broadcast_limit: int) -> DataFrame:
    """The neighbourhood rows of the sets that look for others, at keys that sets of different components share: with `full` and `less`, the numbers of whole and one-deletion entries there.

    A segment without one shingle is kept only where a whole one of another component is equal to it, as two of them prove nothing.
    """
    whole = F.when(F.col("whole"), F.col("label"))
    counts = _neighbourhoods(hot_sets, percent).groupBy("key").agg(
        F.sum(F.col("whole").cast("int")).alias("full"), F.sum((~F.col("whole")).cast("int")).alias("less"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(whole).alias("first"), F.max(whole).alias("last")
    )
    crossing = few(written(counts.where("full > 0 and lo < hi").select(F.col("key").alias("at"), "full", "less", "first", "last")), broadcast_limit)
    useful = F.col("whole") | (F.col("first") != F.col("label")) | (F.col("last") != F.col("label"))
    return _neighbourhoods(hot_sets.where(F.col("rank") < most), percent).join(crossing, (F.col("key") == F.col("at")) & useful).drop("at", "first", "last")


def _allotted(rows: DataFrame) -> DataFrame:
    """(name, scheme, segment, units of the segment: 1 or 2) of the segments that aren't skipped and cost anything, with the set's total cost.

    A segment's first unit costs the other whole entries equal to it, the second one the further entries that one deletion on either side
    meets. Where the second is cheaper than the first, both count at their mean, so that a first unit never stands behind its second.
    Segments that meet no set of another component are free and taken first: they are the units that these rows don't show.
    """
    whole = F.col("whole")
    per = rows.groupBy("name", "scheme", "segment", "units").agg(
        F.coalesce(F.sum(F.when(whole, F.col("full") - 1)), F.lit(0)).alias("c0"),
        F.coalesce(F.sum(F.when(whole, F.col("less")).otherwise(F.col("full"))), F.lit(0)).alias("more"),
    )
    mean = (F.col("c0") + F.col("more")) / 2
    first, second = F.when(F.col("more") < F.col("c0"), mean).otherwise(F.col("c0")), F.when(F.col("more") < F.col("c0"), mean).otherwise(F.col("more"))
    units = per.select("name", "scheme", "segment", F.col("units").alias("needed"), "c0", "more", F.explode(F.array(F.struct(first.cast("double").alias("cost"), F.lit(1).alias("unit")), F.struct(second.cast("double").alias("cost"), F.lit(2).alias("unit")))).alias("u"))
    # Segments that the rows don't show have both units for nothing.
    of_set = Window.partitionBy("name", "scheme")
    shown = F.size(F.collect_set("segment").over(of_set))
    order = of_set.orderBy("u.cost", "segment", "u.unit")
    taken = units.withColumn("free", 2 * (F.col("needed") - shown)).withColumn("nth", F.row_number().over(order)).where("free + nth <= needed")
    each = taken.groupBy("name", "scheme", "segment").agg(F.max("u.unit").alias("unit"), F.max(F.when(F.col("u.unit") == 2, F.col("c0") + F.col("more")).otherwise(F.col("c0"))).alias("cost"))
    return each.withColumn("total", F.sum("cost").over(Window.partitionBy("name", "scheme")))


def _across(hot_sets: DataFrame, rows: DataFrame, allotted: DataFrame, classes: DataFrame, percent: int, broadcast_limit: int) -> DataFrame:
    """(a, b) of hot sets in different components that an allotment shows and whose sketches allow a link."""
    columns = ("key", "name", "label", "rank", "n", "whole", "total")
    probes = rows.join(allotted.select("name", "scheme", "segment", "unit", "total"), ["name", "scheme", "segment"]).where("whole or unit = 2")
    probes = written(probes.select(*columns, "unit").join(classes.select("name", *SKETCHES), "name"))
    # A segment without one shingle answers only whole ones that are looked up so.
    asked = few(written(probes.groupBy("key").agg(F.max(F.col("whole") & (F.col("unit") == 2)).alias("deep"))), broadcast_limit)
    totals = allotted.select("name", "scheme", "total").distinct()
    index = _neighbourhoods(hot_sets, percent, True).withColumnRenamed("key", "at").join(asked, (F.col("at") == F.col("key")) & (F.col("whole") | F.col("deep"))).join(totals, ["name", "scheme"], "left")
    index = index.withColumn("total", F.coalesce("total", F.lit(0.0))).select(*columns, *SKETCHES)
    x, y = probes.alias("x"), index.alias("y")
    order = lambda c: F.struct(F.col(f"{c}.rank"), F.col(f"{c}.total").cast("double"), F.col(f"{c}.name"))
    found = x.join(
        y,
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.whole") | F.col("y.whole"))
        & (F.col("y.whole") | (F.col("x.unit") == 2))
        & (F.col("x.label") != F.col("y.label"))
        & (order("x") < order("y"))
        & _size_fits(percent, F.col("x.n"), F.col("y.n"))
        & _may_link(percent, F.col("x.n"), F.col("y.n"), _difference("x", "y")),
    )
    a, b = F.least("x.name", "y.name"), F.greatest("x.name", "y.name")
    return found.select(a.alias("a"), b.alias("b")).distinct()


def _shared(wholes: DataFrame) -> DataFrame:
    """(key, name, full, popularity) of the whole segments that several hot sets share: full sets have the segment; a set's popularity is the sum of its segments' numbers."""
    whole = written(wholes.join(wholes.groupBy("key").agg(F.count(F.lit(1)).alias("full")).where("full > 1"), "key"))
    return written(whole.join(whole.groupBy("name").agg(F.sum("full").alias("popularity")), "name").select("key", "name", "full", "popularity"))


def _central(shared: DataFrame) -> DataFrame:
    """(a, b): each hot set and the most central set of its most frequent segment, that is the one whose segments are shared most."""
    top = shared.groupBy("name").agg(F.max(F.struct("full", "key")).alias("top")).select("name", F.col("top.key").alias("key"))
    centre = shared.groupBy("key").agg(F.max(F.struct("popularity", "name")).alias("centre"))
    pairs = top.join(centre, "key").select("name", F.col("centre.name").alias("other")).where("name != other")
    return _ordered(pairs, F.col("other"))


def _ordered(rows: DataFrame, other: Column) -> DataFrame:
    """(a, b) of name and the other one, each pair once."""
    return rows.select(F.least("name", other).alias("a"), F.greatest("name", other).alias("b")).distinct()


def _meetings(shared: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """(a, b): each hot set, for each of its shared segments, with one set there of another component: the most central one of all at turn 0, then one drawn by a hash, unless
    that is of its own component: then one of the components that a hash puts first and last.

    A segment names three sets of two components or more, by aggregates alone, so these are no more pairs than there are shared segments.
    """
    rows = _labelled(shared, labels, "name", "label")
    rank = F.col("popularity") if turn == 0 else F.xxhash64("key", "name", F.lit(turn))
    end = F.struct(F.xxhash64("label", F.lit(turn)).alias("h"), "label", "name")
    ends = rows.groupBy("key").agg(F.max(F.struct(rank.alias("rank"), "name", "label")).alias("top"), F.min(end).alias("lo"), F.max(end).alias("hi")).where("lo.label != hi.label")
    other = lambda c: F.when(F.col("label") != F.col(f"{c}.label"), F.col(f"{c}.name"))
    return _ordered(rows.join(ends, "key"), F.coalesce(other("top"), other("lo"), other("hi")))


def _nearest(near: DataFrame) -> DataFrame:
    """(a, b): each set's nearest candidate of the (a, b, d)."""
    ends = near.select("a", "b", "d", F.explode(F.array("a", "b")).alias("of"))
    return ends.groupBy("of").agg(F.min(F.struct("d", "a", "b")).alias("p")).select("p.a", "p.b").distinct()


def link(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", n: int = 5, percent: int = 80, small: int = 40, broadcast_limit: int = 2_000_000, bucket_keys: int = 1_000_000) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, the smallest doc_id reachable by links (itself included).

    Two documents link when their sets' Jaccard similarity is percent / 100 or more. Null and empty texts have empty sets and link with
    nothing, as do rows without id, whose component_id is null. Copies and repeated rows share a set. An empty table gives no rows;
    other columns are not read. The number of buckets follows the number of keys, about bucket_keys in each.
    """
    names = written(_names(docs, n, id_column, text_column))
    classes = written(names.where("name is not null and doc_id is not null").groupBy("name").agg(F.min(F.struct("doc_id", "n", *SKETCHES)).alias("r")).select("name", F.col("r.doc_id").alias("first"), "r.n", *(f"r.{c}" for c in SKETCHES)))
    rows = docs.where(F.col(id_column).isNotNull())

    # A set has about 5 (1 - p) / (1 + p) keys for each shingle in its two schemes.
    keys = (names.agg(F.sum("n")).first()[0] or 0) * 5 * (100 - percent) // (100 + percent) + 1
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(keys // bucket_keys + 1, min(parts, keys // 20_000 + 1))
    buckets = written(_buckets(_index(rows, n, percent, small, text_column, n_buckets), small))
    alone = buckets.where("size(members) = 1").groupBy(F.col("members")[0].alias("name"), "slot").agg(F.sum("count").alias("count"))
    hot = alone.where(F.col("count") > F.floor(F.col("slot") / 2)).select("name").distinct()
    pairs = buckets.where("size(members) > 1").select("members").distinct().select(F.explode(_pairs("members")).alias("p")).select("p.a", "p.b").distinct()
    near = written(_sketched(pairs, classes, percent))
    wanted = near.select(F.explode(F.array("a", "b")).alias("name"), F.lit(False).alias("hot")).union(hot.select("name", F.lit(True)))
    repeated = not names.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 and doc_id is not null and name is not null").isEmpty()
    sets = written(_sets(rows, classes, wanted, repeated, n, id_column, text_column, broadcast_limit))
    hot_sets, wide = sets.where("hot"), written(_wide(sets))

    shared = _shared(_wholes(hot_sets, percent))
    centres = _sketched(_central(shared), classes, percent).select("a", "b")
    labels = components(written(_verified(_nearest(near).union(centres).distinct(), sets, wide, percent, broadcast_limit)))
    n_hot = joined = hot_sets.count()
    turn = 0
    while joined and 50 * joined >= n_hot:  # ends where a turn joins few sets: the rest is step 3's
        met = _sketched(_meetings(shared, labels, turn), classes, percent)
        links = written(_verified(_nearest(met), sets, wide, percent, broadcast_limit))
        turn, joined = turn + 1, links.count()
        labels = _united(labels, links) if joined else labels

    rest = _labelled(_labelled(near.select("a", "b"), labels, "a", "la"), labels, "b", "lb").where("la != lb").select("a", "b")
    hot_sets, most = _ranked(hot_sets, labels)
    around = written(_crossing(hot_sets, most, percent, broadcast_limit))
    allotted = written(_allotted(around))
    across = _across(hot_sets, around, allotted, classes, percent, broadcast_limit)
    more = written(_verified(rest.union(across).distinct(), sets, wide, percent, broadcast_limit))
    if not more.isEmpty():
        labels = _united(labels, more)
    label = _labelled(classes.select("name", "first"), labels, "name", "label")
    firsts = label.groupBy("label").agg(F.min("first").alias("component"))
    of_name = label.join(firsts, "label").select("name", "component")
    return names.join(of_name, "name", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, id_column: str = "doc_id", broadcast_limit: int = 2_000_000, **parameters) -> DataFrame:
    """The rows of docs that are the smallest id of their component; rows without id stay, and so do all rows of a kept id.

    The ids that go are sent to the tasks where there are no more than broadcast_limit, else the rows are joined to them.
    """
    names, ident = docs.columns, unused(docs, "id")
    found = link(docs, id_column=id_column, broadcast_limit=broadcast_limit, **parameters)
    dropped = written(found.where("doc_id != component_id").select(F.col("doc_id").alias(ident)).distinct())
    return docs.join(few(dropped, broadcast_limit), F.col(id_column) == F.col(ident), "left_anti").select(*names)
