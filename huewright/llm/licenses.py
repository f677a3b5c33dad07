"""License scans with a positional index of rare words.

Each licence is a set of passages, each a list of words with a mandatory key phrase. The index holds, for each passage, the places of its rarest words (highest IDF): two more than a
passage may lack. Each occurrence at file position p of a word at passage position q is a vote for the alignment (passage, p - q); votes are intersected by
relative position, and where two or more agree, up to SLACK words apart, the passage is compared there. Its score is the share of its words that stand within SLACK words of
where the alignment puts them, so a word more or less in the file costs that word alone. The licence is reported if the score reaches `least` and the
key phrase, in one of its wordings, stands within SLACK words of its place.

A passage of score `least` has at least two of those words in place, whichever words are the rarest: so IDF, from document frequencies over all documents, decides which
words are looked up, never what is found.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, map_rows, raw_texts
from .license_texts import PASSAGES

# Phrases whose places are counted, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Words by which a passage's word may stand beside its place.
SLACK = 2
_NEAR = sorted(range(-SLACK, SLACK + 1), key=abs)


def key_phrase(text: str) -> list[tuple[frozenset[bytes], bool]]:
    """(wordings, may be missing) of each word of a key phrase."""
    return [(frozenset(x.rstrip("?").encode().split(b"|")), x.endswith("?")) for x in text.split(" ")]


def stands(key: list[tuple[frozenset[bytes], bool]], words: list[bytes], at: int) -> bool:
    """Whether a key phrase begins at a place of the words; a missing word is passed over."""
    for wordings, optional in key:
        if 0 <= at < len(words) and words[at] in wordings:
            at += 1
        elif not optional:
            return False
    return True


class Passage:
    """A licence's passage: its words and the places of its key phrase."""

    def __init__(self, licence: str, text: str, key: str):
        self.licence, self.words, self.key = licence, alnum_words(text.encode()), key_phrase(key)
        self.places = [q for q in range(len(self.words)) if stands(self.key, self.words, q)]
        if not self.places:
            raise ValueError(f"a passage of {licence} doesn't hold its key phrase")

    def least_words(self, least: float) -> int:
        return math.ceil(least * len(self.words) - 1e-9)

    def verified(self, words: list[bytes], shift: int) -> bool:
        return any(0 <= shift + q + d and stands(self.key, words, shift + q + d) for q in self.places for d in _NEAR)


class Index:
    """The passages and their vocabulary; `least` is the share of a passage's words that must be in place."""

    def __init__(self, passages: dict[str, tuple[tuple[str, str], ...]] = PASSAGES, least: float = 0.6):
        self.passages = [Passage(name, text, key) for name, parts in passages.items() for text, key in parts]
        self.least = least
        self.vocabulary = frozenset(w for p in self.passages for w in p.words)
        self.number = {w: k for k, w in enumerate(sorted(self.vocabulary), 1)}

    def postings(self, idf: dict[bytes, float]) -> dict[int, list[tuple[int, int]]]:
        """(passage, position) of the rarest words, by their numbers: as many that a passage of score `least` lacks all but two of them at most."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, p in enumerate(self.passages):
            n = len(p.words) - p.least_words(self.least) + 2
            for q in sorted(range(len(p.words)), key=lambda q: (-idf.get(p.words[q], math.inf), p.words[q], q))[:n]:
                out[self.number[p.words[q]]].append((t, q))
        return dict(out)

    def in_place(self, ids: np.ndarray, passage: Passage, shifts: np.ndarray) -> np.ndarray:
        """For each alignment the words of the passage that stand within SLACK words of their places, in the numbered words of a file."""
        margin = len(passage.words) + SLACK
        padded = np.pad(ids, margin)
        found = np.zeros(len(shifts), np.int32)
        for q, word in enumerate(passage.words):
            at = shifts + (margin + q)
            here = np.zeros(len(shifts), bool)
            for d in range(-SLACK, SLACK + 1):
                here |= padded[at + d] == self.number[word]
            found += here
        return found

    def scan(self, words: list[bytes], postings: dict[int, list[tuple[int, int]]]) -> dict[str, float]:
        """Score of each licence found, that of its best alignment."""
        ids = np.fromiter(map(self.number.get, words, repeat(0)), np.int32, len(words))
        hits = np.flatnonzero(ids)
        hits = hits[np.argsort(ids[hits], kind="stable")]
        starts = np.flatnonzero(np.diff(ids[hits], prepend=0))
        votes: dict[int, list[np.ndarray]] = defaultdict(list)
        for word, places in zip(ids[hits[starts]].tolist(), np.split(hits, starts[1:]), strict=False):
            for t, q in postings.get(word, ()):
                votes[t].append(places - q)
        found: dict[str, float] = {}
        for t, lists in votes.items():
            passage = self.passages[t]
            size = len(passage.words)
            enough = min(2, size)
            if sum(map(len, lists)) < enough:
                continue
            # Votes by relative position; those up to SLACK words apart count together.
            low = -size - 2 * SLACK
            dense = np.bincount(np.concatenate(lists) - low, minlength=len(words) - low + SLACK)
            near = np.convolve(dense, np.ones(2 * SLACK + 1, np.int64), "same")
            shifts = np.flatnonzero(near >= enough) + low
            shifts = shifts[(shifts > -size) & (shifts < len(words))]
            for at in range(0, len(shifts), 100_000):
                some = shifts[at : at + 100_000]
                n = self.in_place(ids, passage, some)
                good = np.flatnonzero((n >= passage.least_words(self.least)) & (n > found.get(passage.licence, 0.0) * size))
                for k in good[np.argsort(-n[good], kind="stable")].tolist():
                    if passage.verified(words, int(some[k])):
                        found[passage.licence] = float(n[k]) / size
                        break
        return found


def inverse_frequencies(docs: DataFrame, index: Index, *, text_column: str = "text") -> dict[bytes, float]:
    """IDF of the templates' words over all documents; at most one number for each word of the templates reaches the driver."""

    def count(batch: pa.RecordBatch) -> dict:
        seen: Counter[bytes] = Counter()
        texts = raw_texts(batch, "text")
        for raw in texts:
            seen.update(index.vocabulary.intersection(alnum_words(raw)))
        seen[b""] = len(texts)
        return {"word": [w.decode() for w in seen], "n": list(seen.values())}

    counts = map_rows(docs.select(F.col(text_column).cast("string").alias("text")), count, "word string, n long")
    found = {r.word.encode(): r.n for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = found.pop(b"", 0)
    return {w: math.log((1 + total) / (1 + found.get(w, 0))) for w in index.vocabulary}


def _places(words: list[bytes]) -> dict[str, list[int]]:
    """Start words of each phrase, found in one pass."""
    line = b" " + b" ".join(words) + b" "
    out = {}
    if b" license " in line:
        for phrase in PHRASES:
            key, found, at, before = b" " + phrase.encode() + b" ", [], -1, 0
            while (new := line.find(key, at + 1)) >= 0:
                before += line.count(b" ", max(at, 0), new)
                at = new
                found.append(before)
            if found:
                out[phrase] = found
    return out


def scan_licenses(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", passages: dict = PASSAGES, least: float = 0.6) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, licenses (name to score), labels, score.

    labels are the base labels and the licences found, distinct, sorted and comma-joined; score is the best alignment's, 1 for a
    base phrase, 0 without either. Null and empty texts have no words, places or labels; very long ones are read whole, in time that grows with their words. Repeated rows give repeated rows, an
    empty table gives none, and other columns are not read.
    """
    ident = docs.schema[id_column].dataType.simpleString()
    index = Index(passages, least)
    postings = index.postings(inverse_frequencies(docs, index, text_column=text_column))

    def scan(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "licenses", "labels", "score")}
        for raw in raw_texts(batch, "text"):
            words = alnum_words(raw)
            places = _places(words)
            starts = [x for found in places.values() for x in found]
            base = {PHRASES[p] for p in places}
            found = index.scan(words, postings)
            row = (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), sorted(found.items()), ",".join(sorted(base | set(found))), 1.0 if base else max(found.values(), default=0.0))
            for k, x in zip(out, row, strict=True):
                out[k].append(x)
        return {"doc_id": batch.column(0)} | out

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_rows(rows, scan, f"doc_id {ident}, n_words long, n_base long, first_word long, last_word long, base_labels string, licenses map<string,double>, labels string, score double", 1000)
