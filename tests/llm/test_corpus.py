"""Operators that relate documents to each other or to the corpus."""

import itertools
import re
from math import isclose, log10

import numpy as np
import pytest
from pyspark.sql import types as T

from huewright.llm import hmm, linededup, surrogates

from . import brute
from .test_scans import COLUMNS, ODD


@pytest.fixture(scope="module")
def docs(spark, small):
    rows = [(r.doc_id, r.text, "e", "w", "k", r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    return spark.createDataFrame([*rows, *((i, t, "e", "w", "k", None) for i, t in ODD)], COLUMNS)


def test_remove_repeats(spark, docs):
    rows = {(r.doc_id, r.text): r.text for r in docs.collect()}
    first: dict[str, tuple] = {}
    order = sorted(rows, key=lambda k: (k[0] is not None, k[0] or 0))
    want = {}
    for key in order:
        text = rows[key]
        kept, gone, at = [], [], 0
        for line in text.split("\n") if text else []:
            words = " ".join(brute.alnum(line))
            if len(words.split(" ")) >= 5 and first.setdefault(words, (key, at)) != (key, at):
                gone.append((at, at + len(line)))
            else:
                kept.append(line)
            at += len(line) + 1
        want[key] = ("\n".join(kept) if text else text, gone)
    got = linededup.remove_repeats(docs).collect()
    assert len(got) == docs.count()
    assert sum(r.n_removed for r in got) > 20
    texts = {}
    for r in got:
        texts.setdefault(r.doc_id, set()).add((r.text, tuple((s.start, s.end) for s in r.removed)))
    wanted = {}
    for (i, _), (text, gone) in want.items():
        wanted.setdefault(i, set()).add((text, tuple(gone)))
    assert texts == wanted
    assert linededup.remove_repeats(docs.limit(0)).count() == 0


def test_remove_paragraphs(spark):
    p = "one two three four five six"
    docs = spark.createDataFrame([(1, f"{p}\n\nother words stand here now"), (2, f"new words to begin it\n \n{p.upper()}!\n\nlast"), (3, p)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.remove_repeats(docs, unit="paragraph").collect()}
    assert got == {1: f"{p}\n\nother words stand here now", 2: "new words to begin it\n\nlast", 3: ""}


@pytest.mark.parametrize("parameters", [{}, {"broadcast_limit": 0, "bucket_words": 500}])
def test_remove_runs(spark, docs, parameters):
    """Runs of 12 words or more, inside lines and over short lines, against all windows of all documents."""
    run = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    extra = [(2001, f"it begins so {run} and goes on here"), (2002, "other ç words " + run.replace(" ", "\n").upper() + "\nend of it all"), (2003, "q r " * 30)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows, n = sorted({(r.doc_id, r.text) for r in docs.collect() if r.text}, key=lambda k: (k[0] is not None, k[0] or 0)), 12
    seen, lines, gone = set(), set(), {}
    for key in rows:
        words = [(m.start(), m.end(), m[0]) for m in brute.ALNUM.finditer(key[1].translate(brute.LOWER))]
        mark, hit = [False] * len(key[1]), [False] * len(words)
        for p in range(len(words) - n + 1):
            window = tuple(w for _, _, w in words[p : p + n])
            if window in seen:
                hit[p : p + n] = [True] * n
            seen.add(window)
        for k in (k for k, h in enumerate(hit) if h):
            start = words[k - 1][1] if k and hit[k - 1] else words[k][0]
            mark[start : words[k][1]] = [True] * (words[k][1] - start)
        at = 0
        for line in key[1].split("\n"):
            w = tuple(brute.alnum(line))
            if len(w) >= 5:
                if w in lines:
                    mark[at : at + len(line)] = [True] * len(line)
                lines.add(w)
            at += len(line) + 1
        gone.setdefault(key[0], set()).add(tuple(mark))
    got: dict = {}
    for r in linededup.remove_repeats(docs, runs=n, **parameters).collect():
        if n_chars := sum(s.end - s.start for s in r.removed):
            got.setdefault(r.doc_id, set()).add(n_chars)
        assert r.n_removed == len(r.removed)
        if r.doc_id == 2002:
            assert r.text == "other ç words \nend of it all" and [(s.start, s.end) for s in r.removed] == [(14, 14 + len(run))]
    assert got == {i: {sum(m) for m in x if any(m)} for i, x in gone.items() if any(any(m) for m in x)}
    assert not any(s.removed for s in linededup.remove_repeats(docs).collect() if s.doc_id == 2002)


@pytest.mark.parametrize("limit", [0, 4_000_000])
def test_long_lines_are_hashed(spark, docs, limit):
    """Lines of 12 words or more are found by their hashes; with runs of 12 words, what goes is what runs alone would take."""
    line = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    extra = [(3001, f"a b\n{line}\nc d"), (3002, f"e f g\n{line.lower()}!\n{line}"), (3003, f"h {line} i"), (3003, f"h {line} i"), (3004, None)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    columns = ["doc_id", "text", "n_removed", "removed", "n_repeated"]
    got, want = (linededup.remove_repeats(docs, runs=12, min_words=12, unit=u, broadcast_limit=limit).select(columns).collect() for u in ("line", None))
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(r.n_removed for r in got)
    rows = linededup._keyed(spark.createDataFrame(extra, "doc_id long, text string"), "doc_id", "text")
    found = linededup._long_units(rows, T.LongType(), "line", 12, limit).join(rows, "content").select("doc_id", "gone", "held").distinct().collect()
    spans = {r.doc_id: [np.frombuffer(x, np.int32).tolist() for x in (r.gone, r.held)] for r in found}
    assert spans == {3001: [[], [2, 15]], 3002: [[3, 16, 16, 29], []]}


PRIVATE = [
    (1, "Write to Jane.Doe99@mail.example.com or call +1 (743) 555-3824."),
    (2, "jane.doe99@mail.example.com and bob@mail.example.com, +1 743 555 3824, 38.104.246.38."),
    (3, "Card 4111 1111 1111 1111 or 4111111111111111; SSN 123-45-6789. Mr. Smith met Frau Anna Schmidt; Mr Smith left."),
    (4, None),
    (5, ""),
    (6, "nothing to see"),
    (6, "nothing to see"),
    (None, "Госпожа Петрова, 38.104.246.38"),
]


def test_surrogates(spark):
    docs = spark.createDataFrame(PRIVATE, "doc_id long, text string")
    rows = surrogates.pseudonymise(docs).collect()
    assert len(rows) == len(PRIVATE)
    got = {r.doc_id: r for r in rows}
    assert got[4].text is None and got[5].text == "" and got[6].text == "nothing to see" and got[6].n_entities == 0
    one = re.fullmatch(r"Write to ([A-Z][a-z]{3}\.[A-Z][a-z]{2}\d\d@[a-z]{4}\.[a-z]{7}\.com) or call (\+1 \(\d{3}\) \d{3}-\d{4})\.", got[1].text)
    two = re.fullmatch(r"(\S+) and (\S+), (\+1 \d{3} \d{3} \d{4}), (\d+\.\d+\.\d+\.\d+)\.", got[2].text)
    assert one and two, (got[1].text, got[2].text)
    assert one[1].lower() == two[1] and re.sub(r"\D", "", one[2]) == re.sub(r"\D", "", two[3])
    assert two[1].split("@")[1] == two[2].split("@")[1] and two[1] != two[2]
    three = re.fullmatch(r"Card (\d{4} \d{4} \d{4} \d{4}) or (\d{16}); SSN (\d{3}-\d{2}-\d{4})\. Mr\. (\w+) met Frau (\w+) (\w+); Mr (\w+) left\.", got[3].text)
    assert three and three[1].replace(" ", "") == three[2] and three[4] == three[7]
    digits = [int(c) for c in reversed(three[2])]
    assert sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0
    assert three[5] in surrogates.FIRST_NAMES["f", "latin"]
    assert re.fullmatch(r"Госпожа [А-Я][а-я]+, " + re.escape(two[4]), got[None].text)
    for secret in ("doe99", "bob@", "38.104", "4111", "6789", "Smith", "Schmidt", "Петрова", "3824"):
        assert not any(secret.lower() in (r.text or "").lower() for r in rows)
    assert {r.text for r in surrogates.pseudonymise(docs).collect()} == {r.text for r in rows}
    assert {r.text for r in surrogates.pseudonymise(docs, key="other").collect()} != {r.text for r in rows}


def test_surrogates_prefilter(spark):
    """One example of every alternative of ENTITY: the prefilter passes what the pattern matches."""
    found = ["a@b.co", "1.2.3.4", "+45 12 34 56 78", "+32-12-34-56-78", "+1 (12) 34 56", "(743) 555-3824", "743-555-3824", "4111 1111 1111 1111", "3411 111111 11111", "123-45-6789", "Mr. Smith", "Señora Ana Paz", "Госпожа Петрова"]
    docs = spark.createDataFrame([(k, f"call {x} now") for k, x in enumerate(found)], "doc_id long, text string")
    from pyspark.sql import functions as F

    rows = docs.select("text", F.col("text").rlike(surrogates.ENTITY).alias("entity"), surrogates.may_hold(F.col("text")).alias("maybe")).collect()
    assert all(r.entity and r.maybe for r in rows), rows
    for r in surrogates.pseudonymise(docs).collect():
        assert r.n_entities == 1 and found[r.doc_id] not in r.text


PHONES = {"+45 ": "12 34 56 78", "+33 ": "6 12 34 56 78", "+1 ": "(743) 555-3824", "+7 ": "495 123-45-67", "+49-": "30-1234-5678", "+44 ": "20 7946 0958", "+353 ": "1 234 5678", "+420 ": "601 123 456", "+81.": "3.1234.5678", "+1": " 22 22222"}


def test_phones_keep_country_and_format(spark):
    texts = [f"ring {a}{b} today" for a, b in PHONES.items()]
    docs = spark.createDataFrame(list(enumerate([*texts, "ring +4512345678 now", "ring +45-1234-5678 now"])), "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.pseudonymise(docs).collect()}
    for k, (a, b) in enumerate(PHONES.items()):
        assert got[k].n_phone == 1 and got[k].text.startswith(f"ring {a}") and got[k].text != texts[k], got[k]
        assert re.sub("[0-9]", "0", got[k].text) == re.sub("[0-9]", "0", texts[k])
    same = {re.sub(r"[^0-9+]", "", got[k].text) for k in (0, 10, 11)}
    assert len(same) == 1 and same.pop().startswith("+45")
    assert len({r.text for r in got.values()}) == len(got)


def test_short_addresses_stay_distinct(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    docs = spark.createDataFrame([(k, f"{c}@mail.example.org") for k, c in enumerate(letters)], "doc_id long, text string")
    for key in ("one", "two"):
        texts = {r.text for r in surrogates.pseudonymise(docs, key=key).collect()}
        assert len(texts) == 26 and len({x.split("@")[1] for x in texts}) == 1 and all(re.fullmatch(r"[a-z]+@[a-z]{4}\.[a-z]{7}\.org", x) for x in texts)


def test_surnames_stay_distinct(spark):
    """As many people as four Cyrillic syllables have values, written with title and surname alone."""
    letters = "абвгдежзик"
    names = [f"Господин А{a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in letters[:5]]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(names)], "doc_id long, text string")
    rows = surrogates.pseudonymise(docs).collect()
    written = {r.text for r in rows}
    assert len(names) == 5000 and len(written) == 5000 and not written & set(names) and all(r.n_name == 1 for r in rows)
    assert all(re.fullmatch(r"Господин [А-Я][а-я]+", x) for x in written)


def test_surrogates_collide_and_stay_distinct(spark):
    forms = spark.createDataFrame([("ssn", f"{k:02d}") for k in range(30)], "kind string, form string")
    rows = surrogates.assign(forms, "k").collect()
    assert len({r.surrogate for r in rows}) == 30 and not {r.surrogate for r in rows} & {r.form for r in rows}
    # Nine forms of ten values, of which none may be used: the values grow.
    few = surrogates.assign(spark.createDataFrame([("ssn", str(k)) for k in range(9)], "kind string, form string"), "k").collect()
    assert len({r.surrogate for r in few}) == 9 and not {r.surrogate for r in few} & set("012345678")


def shown(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(surrogates.pseudonymise(docs).collect(), key=lambda r: r.doc_id)]


def test_names_of_all_forms(spark):
    """Apostrophes, hyphens, particles, second titles, initials and capitals; what mentions share stays shared."""
    word = r"[A-Z][a-z]+"
    cases = {
        "Mr. O'Neil left": rf"Mr\. O'({word}) left",
        "Mrs Smith-Jones and Mr Jones": rf"Mrs ({word})-({word}) and Mr ({word})",
        "Herr Dr. Müller kam": rf"Herr Dr\. ({word}) kam",
        "Herr Prof. Dr. Müller kam": rf"Herr Prof\. Dr\. ({word}) kam",
        "Mr John Smith met Mr Smith and Mrs Smith": rf"Mr ({word}) ({word}) met Mr ({word}) and Mrs ({word})",
        "Mr Smith's car, MR SMITH, Mr SMITH": rf"Mr ({word})'s car, MR SMITH, Mr ([A-Z]+)",
        "Frau van der Berg, Herr Berg": rf"Frau van der ({word}), Herr ({word})",
        "Mr J. R. Tolkien wrote, Mr John R. Tolkien too": rf"Mr ([A-Z])\. ([A-Z])\. ({word}) wrote, Mr ({word}) ([A-Z])\. ({word}) too",
        "Señora Ana María-José de la Paz": None,
        "Госпожа Анна-Мария Петрова и Господин Петрова": r"Госпожа ([А-Я][а-я]+)-([А-Я][а-я]+) ([А-Я][а-я]+) и Господин ([А-Я][а-я]+)",
        "add +1 10 20 and +1 10 202020": r"add \+1 10 20 and \+1 \d\d \d{6}",
    }
    texts = shown(spark, *cases)
    found = [re.fullmatch(p, t) if p else None for p, t in zip(cases.values(), texts, strict=True)]
    assert all(m or not p for m, p in zip(found, cases.values(), strict=True)), texts
    for text, new in zip(cases, texts, strict=True):
        for name in ("Neil", "Smith-", "Jones", "Müller", " Smith", "Berg", "Tolkien", "John", "Петров", "Анна"):
            assert name not in new.replace("MR SMITH", "") or name not in text
    assert found[1][2] == found[1][3] and found[1][1] == found[4][2] == found[4][3] == found[4][4] == found[5][1] == found[5][2].capitalize()
    assert found[2][1] == found[3][1] and found[6][1] == found[6][2] and found[7][3] == found[7][6] and found[7][2] == found[7][5] != "R"
    assert found[9][3] == found[9][4]


def test_surrogates_against_a_plain_version(spark):
    """10,000 distinct people, addresses and numbers, each mentioned twice and in two forms: the surrogates are one to one, and the rest of the texts stays."""
    rng = np.random.default_rng(8)
    draw = lambda n, letters="abcdefghijklmnopqrstuvwxyz": "".join(letters[k] for k in rng.integers(0, len(letters), n))
    families = sorted({draw(int(rng.integers(2, 7))).capitalize() for _ in range(4000)})
    given = {g: sorted({draw(int(rng.integers(2, 6))).capitalize() for _ in range(700)}) for g in "mf"}
    titles = {"m": ("Mr", "Herr", "Monsieur"), "f": ("Mrs", "Frau", "Madame")}
    rows, facts = [], []
    for k in range(10_000):
        kind = k % 5
        if kind < 3:
            g = "mf"[k % 2]
            title, first, last = titles[g][k % 3], given[g][k * 7 % len(given[g])], families[k % len(families)]
            rows.append(f"w{k}, {title} {first} {last}; {title}. {last}, {title} {last.upper()} end {k % 9}")
            facts.append(("name", g, first, last))
        elif kind == 3:
            local, host = draw(int(rng.integers(1, 4))) + str(k % 50), draw(3)
            rows.append(f"w{k} <{local}@{host}.org> or {local.upper()}@{host}.org end")
            facts.append(("email", local, host))
        else:
            digits = f"{rng.integers(0, 10**6):06d}"
            rows.append(f"w{k} (+1 {digits[:3]} {digits[3:]}) and +1-{digits[:3]}-{digits[3:]} end")
            facts.append(("phone", digits))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(8)
    found = surrogates.pseudonymise(docs)
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    new = {r.doc_id: r.text for r in found.collect()}
    maps: dict[str, dict] = {}
    for k, fact in enumerate(facts):
        if fact[0] == "name":
            _, g, first, last = fact
            title = re.match(r"w\d+, (\w+) ", rows[k])[1]
            m = re.fullmatch(rf"w{k}, {title} ([A-Z][a-z]+) ([A-Z][a-z]+); {title}\. ([A-Z][a-z]+), {title} ([A-Z]+) end {k % 9}", new[k])
            assert m and m[2] == m[3] == m[4].capitalize(), (rows[k], new[k])
            pairs = [(f"given {g}", first, m[1]), ("surname", last, m[2])]
        elif fact[0] == "email":
            m = re.fullmatch(rf"w{k} <([a-z]+\d*[a-z]*)@([a-z]+)\.org> or ([A-Z]+\d*[A-Za-z]*)@([a-z]+)\.org end", new[k])
            assert m and m[1] == m[3].lower() and m[2] == m[4], (rows[k], new[k])
            pairs = [("email", fact[1:], (m[1], m[2])), ("host", fact[2], m[2])]
        else:
            m = re.fullmatch(rf"w{k} \(\+1 (\d{{3}}) (\d{{3,}})\) and \+1-(\d{{3}})-(\d{{3,}}) end", new[k])
            assert m and m[1] + m[2] == m[3] + m[4], (rows[k], new[k])
            pairs = [("phone", fact[1], m[1] + m[2])]
        for kind, old, to in pairs:
            assert maps.setdefault(kind, {}).setdefault(old, to) == to
    for kind, table in maps.items():
        if kind != "host":
            assert len(set(table.values())) == len(table) and not set(table.values()) & set(table), kind


def test_surrogates_leave_nothing(docs):
    rows = {r.doc_id: r for r in surrogates.pseudonymise(docs).collect()}
    emails = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+", re.A)
    originals = {m for r in docs.collect() for m in emails.findall(r.text or "")}
    assert originals and not any(m in (r.text or "") for r in rows.values() for m in originals)
    assert len(rows) == len({r.doc_id for r in docs.collect()})


def some_model(k=3, c=5):
    rng = np.random.default_rng(0)
    return hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k).T)


def test_recursions():
    m, rng = some_model(), np.random.default_rng(1)
    sequences = [rng.integers(0, 5, n).astype(np.int32) for n in (4, 1, 6, 3, 6)]
    starts, moves, emits, logs = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), []
    for s in sequences:
        total, a, b, c = 0.0, np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
        for path in itertools.product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            total += p
            a[path[0]] += p
            for t in range(len(s)):
                c[s[t], path[t]] += p
                if t:
                    b[path[t - 1], path[t]] += p
        logs.append(log10(total))
        starts, moves, emits = starts + a / total, moves + b / total, emits + c / total
    assert np.allclose(hmm.log_likelihoods(sequences, m), logs)
    for x, y in zip(hmm.expected_counts(sequences, m), (starts, moves, emits), strict=True):
        assert np.allclose(x, y)


@pytest.mark.parametrize("head", [0, 50, 100_000])
def test_scores(spark, small, head):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [(1001, None), (1002, ""), (1003, "zzzunknownzzz The a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in hmm.score_documents(docs, head=head, own=40, slices=3, passes=1).collect()}
    want = brute.unigram(rows)
    for i, (n, known, total, base) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    if head:
        assert sum(got[i].score for i in want) > sum(got[i].base_score for i in want)


def test_scores_are_a_distribution(spark):
    """Shares of each class's words, with its unseen word, add up to one, and so do the classes in each state."""
    docs = spark.createDataFrame([(k, f"a b c{k % 7} dd{k % 3} a") for k in range(40)], "doc_id long, text string")
    counts = hmm.count_words(docs)
    vocab = hmm.vocabulary(counts, 40, head=100, own=2)
    sizes = hmm.class_sizes(counts, vocab)
    shares = {}
    for word, n in vocab.counts.items():
        if word not in vocab.classes:
            k = hmm.suffix_class(word)
            shares[k] = shares.get(k, 0) + (n + 0.5) / (sizes[k][0] + 0.5 * (sizes[k][1] + 1))
    for k, x in shares.items():
        assert isclose(x + 0.5 / (sizes[k][0] + 0.5 * (sizes[k][1] + 1)), 1)
    model = hmm.train(docs, vocab)
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1) and isclose(model.start.sum(), 1)


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    from pyspark.sql import functions as F

    r = hmm.score_documents(docs, learn=F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and isclose(r.base_score, 0.0, abs_tol=1e-9)
    assert hmm.score_documents(docs.limit(0)).count() == 0


def test_scores_of_odd_rows(spark):
    """Repeated rows, clashing column names and a very long text: each row is scored by its text alone."""
    rows = [(k, f"some words {k % 5} here", 1, "x", 2) for k in range(30)] + [(3, "some words 3 here", 1, "x", 2), (None, None, 0, "", 0), (40, "long text " * 200_000, 0, "", 0), (41, "long text " * 200_000, 0, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, classes string, slice int").repartition(3)
    got = hmm.score_documents(docs, slices=2, passes=1, own=5).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_tokens, round(r.score, 6)))
    assert len(by[3]) == 2 and len(set(by[3])) == 1 and by[8] == by[3][:1] and by[40] == by[41] and by[40][0][0] == 400_001 and by[None][0][0] == 1


def test_places_of_words():
    """One lookup gives a frequent word's place or the suffix class of another; what is remembered changes nothing."""
    places = hmm._Places({b"the": 9, b"of": 4})
    for _ in range(2):
        assert [places[w] for w in (b"the", b"of", b"zebra", b"")] == [0, 1, 2 + hmm.suffix_class(b"zebra"), 2 + hmm.suffix_class(b"")]
