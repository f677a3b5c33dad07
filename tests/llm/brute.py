"""Slow, plain versions of the operators' contracts, written from their definitions."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def space(text):
    return SPACE.findall(text or "")


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def jaccard(docs, n, percent):
    """docs: [(id, text)]; {id: (set size, component)} by comparing all pairs."""
    sets = {}
    for i, text in docs:
        w = space((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def contamination(text, items, window=13):
    words = alnum(text)
    hit, found = set(), set()
    for item, t in items:
        w = alnum(t)
        if not w or item is None:
            continue
        n = min(window, len(w))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for p in range(len(words) - n + 1):
            if tuple(words[p : p + n]) in grams:
                hit.update(range(p, p + n))
                found.add(str(item))
    return len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(words)


def base_secrets(text):
    text = text or ""
    found = [("assign", *m.span()) for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ["assign", "access", "hex"]
    found.sort(key=lambda f: (f[1], order.index(f[0])))
    return Counter(f[0] for f in found), [f"{k}:{a}:{b}" for k, a, b in found]


def licenses(text):
    words = alnum(text)
    places = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        places += [(k, label) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def license_scores(passages, words, least):
    """{licence: score} of its best alignment of all, by the definition."""
    found = {}
    at = lambda k: words[k] if 0 <= k < len(words) else None
    for name, parts in passages.items():
        for text, key in parts:
            passage = [w.encode() for w in alnum(text)]
            key = [([x.encode() for x in k.rstrip("?").split("|")], k.endswith("?")) for k in key.split(" ")]

            def holds(k, get, key=key):
                for wordings, optional in key:
                    if get(k) in wordings:
                        k += 1
                    elif not optional:
                        return False
                return True

            starts = [q for q in range(len(passage)) if holds(q, lambda k, passage=passage: passage[k] if k < len(passage) else None)]
            for shift in range(-len(passage), len(words)):
                n = sum(any(at(shift + q + d) == w for d in range(-2, 3)) for q, w in enumerate(passage))
                if n >= least * len(passage) - 1e-9 and any(shift + q + d >= 0 and holds(shift + q + d, at) for q in starts for d in range(-2, 3)):
                    found[name] = max(found.get(name, 0), n / len(passage))
    return found


def repetition(text, window=8):
    words = space(text)
    lines = [x for x in (text or "").split("\n") if space(x)]
    grams = Counter(tuple(words[k : k + window]) for k in range(len(words) - window + 1))
    spots = {q for k in range(len(words) - window + 1) if grams[tuple(words[k : k + window])] > 1 for q in range(k, k + window)}
    n, r = len(words), len(spots)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def unigram(docs):
    """{id: (tokens, known, N, base score)} with counts of the training rows (fold not 1)."""
    tokens = {i: [*space((t or "").translate(LOWER)), None] for i, t in docs}
    counts = Counter(w for i in tokens if fold(i) != 1 for w in tokens[i])
    total, kinds = sum(counts.values()), len(counts)
    return {i: (len(w), sum(counts[x] > 0 for x in w), total, sum(log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w)) for i, w in tokens.items()}
