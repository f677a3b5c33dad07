"""Collocations by suffix-sigma: phrases of up to max_n words that are more frequent than their parts lead one to expect.

1. Words are counted by language, and pairs of neighbours by the hash of language and pair. A pair below min_count is in no candidate, so a bitmap of the hashes that reach
   it, of fixed size, tells the tasks of the next step where a suffix can end: it may let some rare pairs through, but stops no other.
2. Every place where a piece of text goes on with pairs of the bitmap gives one suffix of max_n words at most. Equal ones are counted together in each task. Suffixes are packed
   and dealt by language and their first two words, so that a frequent first word is split among tasks, and sorted in reverse order. One stack then counts all prefixes of two
   words or more: what leaves it won't come again. Suffixes that begin with two of the most frequent words (a hundredth of all words each) are dealt by all their words instead; what
   their prefixes count in several tasks is added up afterwards.
3. Candidates are cut after each word, and the counts of the parts are joined. Parts that hold a thousandth of all words (a few thousand of them at most) are sent
   to all tasks, so no hot part gathers in one. Longer candidates tell the phrases inside them, by a grouped maximum, that they are covered.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import LOWER, looked_up, raw_texts, slices, written

# The bytes that end a piece. Commas and full stops don't occur in words, so they stand for ends of pieces and for a word's NUL bytes; NUL parts words.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(0x2E if x == 0 else 0x2C if x in _ENDS else 0x20 if x == 9 else LOWER[x] for x in range(256))

#: Bits of the hashes of pairs and of their blocks' places; distinct words, or suffixes, and pairs that a task counts before it passes them on.
BITS, PLACES = 28, 16
HELD, HELD_PAIRS = 400_000, 4_000_000
#: Parts with 1 / HOT of all words are sent to all tasks: at most HOT of each length.
HOT = 1000
#: Words that hold 1 / HOT_WORDS of all are most frequent: at most HOT_WORDS of them.
HOT_WORDS = 100
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def tokens(raw: bytes) -> list[bytes]:
    """The words of a text, A-Z in lower case, with a comma for each end of a piece; a word's NULs are full stops."""
    return raw.translate(_TABLE).replace(b",", b" , ").split()


class _Hashes(dict):
    """Words to odd hashes, ends of pieces to 0; at most 200,000 words are remembered."""

    def __missing__(self, word: bytes) -> int:
        x = 0 if word == b"," else xxh3_64_intdigest(word) | 1
        if len(self) < 200_000:
            self[word] = x
        return x


def pair_hashes(words: list[bytes], lang: str, known: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word and the next one, whether both are of one piece), one entry less than there are words."""
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    x = (h[:-1] * _ODD[0] + np.uint64(xxh3_64_intdigest(lang.encode()))) ^ h[1:]
    x = (x ^ (x >> np.uint64(31))) * _ODD[1]
    return (x >> np.uint64(64 - BITS)).astype(np.int64), (h[:-1] != 0) & (h[1:] != 0)


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, tokens) of texts: those of one language in a slice of a batch together, ends of pieces between them."""
    for part in slices(batches, 200):
        found: dict[str, list[bytes]] = {}
        for lang, raw in zip(part.column(0).to_pylist(), raw_texts(part, "text"), strict=True):
            if raw:
                found.setdefault(lang, []).append(raw)
        for lang, raws in found.items():
            yield lang, tokens(b",".join(raws))


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n): occurrences of each word of the (lang, text); tasks count up to HELD words together."""

    def batch(lang: str, counter: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(counter)), "word": pa.array(list(counter), pa.binary()), "n": pa.array(list(counter.values()), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for lang, words in _by_lang(batches):
            counter = held.setdefault(lang, Counter())
            counter.update(words)
            counter.pop(b",", None)
            if sum(map(len, held.values())) >= HELD:
                yield from (batch(k, c) for k, c in held.items() if c)
                held = {}
        yield from (batch(k, c) for k, c in held.items() if c)

    return rows.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def frequent_pairs(rows: DataFrame, min_count: int) -> np.ndarray:
    """The bitmap of the hashes that min_count pairs or more have: 2^BITS bits, however many pairs there are.

    A task passes on its counts by blocks of hashes, no more than min_count of each; blocks are summed as they come, so a task holds the counts of one block.
    """
    kind, most = (np.uint8, 255) if min_count <= 255 else (np.uint32, min_count)
    schema = "block int, places binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        held: list[np.ndarray] = []

        def ready() -> pa.RecordBatch:
            x, n = np.unique(np.concatenate(held), return_counts=True)
            block = x >> PLACES
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            places, counts = (x & (1 << PLACES) - 1).astype(np.uint16), np.minimum(n, most).astype(kind)
            ends = [*starts[1:].tolist(), len(x)]
            parts = [(places[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(starts.tolist(), ends, strict=True)]
            return pa.RecordBatch.from_pydict({"block": pa.array(block[starts], pa.int32()), "places": pa.array([p for p, _ in parts], pa.binary()), "counts": pa.array([c for _, c in parts], pa.binary())})

        for lang, words in _by_lang(batches):
            if len(words) > 1:
                x, same = pair_hashes(words, lang, known)
                held.append(x[same])
            if sum(map(len, held)) >= HELD_PAIRS:
                yield ready()
                held.clear()
        if any(map(len, held)):
            yield ready()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums = None, np.zeros(1 << PLACES, np.int64)
        ready = lambda: pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "bits": pa.array([np.packbits(sums >= min_count, bitorder="little").tobytes()], pa.binary())})
        for batch in batches:
            for b, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block and block is not None:
                    yield ready()
                    sums[:] = 0
                block = b
                sums[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, kind)
        if block is not None:
            yield ready()

    blocks = rows.mapInArrow(run, schema).repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, bits binary")
    out = np.zeros((1 << BITS - PLACES, 1 << PLACES - 3), np.uint8)
    for row in blocks.toLocalIterator():
        out[row.block] = np.frombuffer(row.bits, np.uint8)
    return out.ravel()


def suffixes(rows: DataFrame, bits: np.ndarray, hot: set[tuple[str, bytes]], max_n: int, buckets: int) -> DataFrame:
    """(bucket, lang, suffixes, counts): sorted suffixes of 2 to max_n words, cut before the first pair that isn't in the bitmap, packed by bucket; a suffix may come from several tasks.

    All suffixes with the same first two words are in one bucket, but for those that begin with two hot words.
    """
    sent = rows.sparkSession.sparkContext.broadcast(bits)  # 2^BITS bits
    known = _Hashes()
    schema = "bucket int, lang string, suffixes binary, counts binary"

    def add(counter: Counter, lang: str, words: list[bytes]) -> None:
        x, same = pair_hashes(words, lang, known)
        on = same & (sent.value[x >> 3] >> (x & 7).astype(np.uint8) & 1 == 1)
        # Pairs that follow each other from a place on, max_n - 1 at most: a suffix has one word more.
        length = on.astype(np.int64)
        for k in range(1, max_n - 1):
            length[:-k] += on[k:] & (length[:-k] == k)
        first = np.flatnonzero(length)
        last = first + length[first]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        text = b"\0".join(words)
        found = [text[a:b] for a, b in zip(begins[first].tolist(), ends[last].tolist(), strict=True)]
        bucket = x[first] * buckets >> BITS
        mine = {w for of, w in hot if of == lang}
        if mine:
            is_hot = np.fromiter((w in mine for w in words), bool, len(words))
            for k in np.flatnonzero(is_hot[first] & is_hot[first + 1]).tolist():
                bucket[k] = xxh3_64_intdigest(found[k]) % buckets
        counter.update([b.to_bytes(4) + s for b, s in zip(bucket.tolist(), found, strict=True)])

    def packed(lang: str, counter: Counter) -> pa.RecordBatch:
        keys = sorted(counter)
        numbers = np.fromiter(map(counter.__getitem__, keys), np.uint32, len(keys))
        bucket = np.frombuffer(b"".join(k[:4] for k in keys), ">u4").astype(np.int32)
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        parts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True))
        blobs = [zlib.compress(b"\n".join([k[4:] for k in keys[a:b]]), 1) for a, b in parts]
        return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[starts]), "lang": pa.array([lang] * len(parts)), "suffixes": pa.array(blobs, pa.binary()), "counts": pa.array([numbers[a:b].tobytes() for a, b in parts], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for lang, words in _by_lang(batches):
            if len(words) > 1:
                add(held.setdefault(lang, Counter()), lang, words)
            if sum(map(len, held.values())) >= HELD:
                yield from (packed(k, c) for k, c in held.items() if c)
                held = {}
        yield from (packed(k, c) for k, c in held.items() if c)

    return rows.mapInArrow(run, schema)


class PrefixStack:
    """Counts all prefixes of two words or more of suffixes in reverse order: each prefix leaves the stack once, with its count."""

    def __init__(self, min_count: int, hot: frozenset[bytes] = frozenset()):
        self.min_count, self.hot = min_count, hot
        self.words: list[bytes] = []
        self.counts: list[int] = []
        self.out: list[tuple[bytes, int]] = []

    def _leave(self, depth: int) -> None:
        words, counts = self.words, self.counts
        while len(words) > depth:
            n = counts.pop()
            # What begins with two hot words is counted in other tasks too.
            if len(words) > 1 and (n >= self.min_count or words[0] in self.hot and words[1] in self.hot):
                self.out.append((b" ".join(words), n))
            if counts:
                counts[-1] += n
            words.pop()

    def push(self, suffix: bytes, n: int) -> None:
        words, new, depth = self.words, suffix.split(b"\0"), 0
        for a, b in zip(words, new, strict=False):
            if a != b:
                break
            depth += 1
        if depth < len(words):
            self._leave(depth)
        if depth < len(new):
            words += new[depth:]
            self.counts += [0] * (len(new) - depth)
        self.counts[-1] += n

    def close(self) -> None:
        self._leave(0)


def phrase_counts(found: DataFrame, hot: set[tuple[str, bytes]], min_count: int) -> DataFrame:
    """(lang, phrase, f): the phrases of two words or more that the packed suffixes hold min_count times or more, their words parted by spaces. A task holds one bucket at a time."""
    hot_of: dict[str, set[bytes]] = {}
    for lang, word in hot:
        hot_of.setdefault(lang, set()).add(word)

    def counted(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counter in held.items():
            stack = PrefixStack(min_count, frozenset(hot_of.get(lang, ())))
            for suffix in sorted(counter, reverse=True):
                stack.push(suffix, counter[suffix])
            stack.close()
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(stack.out), pa.string()), "phrase": pa.array([p for p, _ in stack.out], pa.binary()), "f": pa.array([n for _, n in stack.out], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for bucket, lang, blob, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from counted(held)
                    now, held = bucket, {}
                counter = held.setdefault(lang, Counter())
                for suffix, n in zip(zlib.decompress(blob).split(b"\n"), np.frombuffer(counts, np.uint32).tolist(), strict=True):
                    counter[suffix] += n
        yield from counted(held)

    parts = found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "lang string, phrase binary, f long")
    return parts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count).select("lang", _text("phrase"), "f")


def _text(column: str) -> Column:
    """A phrase as text again: full stops stood for NULs."""
    return F.replace(F.col(column).cast("string"), F.lit("."), F.lit("\0")).alias(column)


def _scored(candidates: DataFrame, counts: DataFrame, totals: DataFrame, words: int, max_n: int) -> DataFrame:
    """(lang, phrase, a, n, score, k, l, r) of the candidates' lowest-scoring cuts."""
    size = F.size(F.split("phrase", " "))
    ends = lambda k: (F.substring_index("phrase", " ", k), F.substring("phrase", F.length(F.substring_index("phrase", " ", k)) + 2, F.length("phrase")))
    parts_at = lambda k: F.array(*(F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), part.alias("part")) for side, part in enumerate(ends(k))))
    cuts = F.flatten(F.array_compact(F.array(*(F.when(size > k, parts_at(k)) for k in range(1, max_n)))))
    asked = written(candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*"))
    parts = counts.select("lang", F.col("phrase").alias("part"), "f")
    found = looked_up(asked, parts, ["lang", "part"], HOT * F.col("f") >= words)
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f")))
    wide = found.groupBy("lang", "phrase", "a").agg(*(of(k, s).alias(f"f{k}_{s}") for k in range(1, max_n) for s in (0, 1)))
    wide = looked_up(written(wide), totals, ["lang"], HOT * F.col("n") >= words)
    score = lambda k: F.expr(f"(1000 * (cast(a as decimal(17,0)) * cast(n as decimal(17,0)))) div (cast(f{k}_0 as decimal(19,0)) * cast(f{k}_1 as decimal(19,0)))")
    each = [F.when(F.col(f"f{k}_0").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"f{k}_0").alias("l"), F.col(f"f{k}_1").alias("r"))) for k in range(1, max_n)]
    return wide.select("lang", "phrase", "a", "n", (F.least(*each) if len(each) > 1 else each[0]).alias("c")).select("lang", "phrase", "a", "n", "c.*")


def _covering(candidates: DataFrame, max_n: int) -> DataFrame:
    """(lang, phrase, over): the largest count of the longer candidates that a phrase lies in."""
    words = F.split("phrase", " ")
    inside = lambda start, size: F.when((F.size(words) >= start + size) & (F.size(words) > size), F.array_join(F.slice(words, start + 1, size), " "))
    inner = F.array_distinct(F.array_compact(F.array(*(inside(start, size) for size in range(2, max_n) for start in range(max_n - size + 1)))))
    longer = candidates.where(F.size(words) > 2)
    return longer.select("lang", F.col("f"), F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("over"))


def collocations(docs: DataFrame, *, text_column: str = "text", lang_column: str = "lang", max_n: int = 5, min_count: int = 100, cover_percent: int = 100, top: int = 2000, buckets: int = 64, bucket_words: int = 1_000_000) -> DataFrame:
    """The `top` phrases of 2 to max_n words of each language: lang, rank, phrase, a, l, r, n, score, by score and a (both descending), then by the phrase's bytes.

    n counts a language's words, a the phrase's occurrences within pieces of text (overlaps included), l and r those of the parts of its lowest-scoring cut (the first
    of equal ones); score is floor(1000 a n / (l r)). Phrases of a below min_count, and those inside a longer candidate with cover_percent % of their occurrences
    or more, are left out. Null languages are `und`; null and empty texts have no words; repeated rows count as often as they stand; an empty table gives no
    rows. Very long texts are read whole, at most 200 texts at a time, and a task passes its counts on whenever it holds HELD of them; the number of
    suffix buckets follows the number of words, about bucket_words in each. Other columns are not read.
    Counts are exact up to 10^17 words.
    """
    if not 2 <= max_n <= 20 or min_count < 1:
        raise ValueError("max_n must be 2 to 20, min_count 1 or more")
    rows = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.col(text_column).cast("string").alias("text"))
    words = written(word_counts(rows))
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n")))
    total = totals.agg(F.sum("n")).first()[0] or 0
    frequent = words.where(F.col("n") >= min_count)
    hot = {(r.lang, bytes(r.word)) for r in words.where(HOT_WORDS * F.col("n") >= total).select("lang", "word").collect()}  # HOT_WORDS at most
    n_buckets = max(total // bucket_words + 1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 20_000 + 1))
    found = suffixes(rows, frequent_pairs(rows, min_count), hot, max_n, n_buckets)
    candidates = written(phrase_counts(found, hot, min_count))
    counts = candidates.union(frequent.select("lang", _text("word"), "n"))
    scored = _scored(candidates, counts, totals, total, max_n)
    left = scored.join(_covering(candidates, max_n), ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * F.col("over") < cover_percent * F.col("a")))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # The best of each bucket first, so no task ranks a whole language.
    best = left.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets))).withColumn("nth", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("nth") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
