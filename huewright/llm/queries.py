"""The registered queries: each applies one operator, with production parameters, to its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytecnn, collocations, decontaminate, filter_audit, hmm, jaccard, licenses, linededup, mixing, repetition, secrets, surrogates, toxicity
from .common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"), n=4, percent=85)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *secrets.digest_columns())


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("licenses")


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(table(spark, sf_dir, "documents"))


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 50 or more words are hashed and repeats go; runs of 50 words find what begins or ends elsewhere. n_repeated counts the words of first places too."""
    found = linededup.remove_repeats(table(spark, sf_dir, "documents"), unit="line", min_words=50, runs=50)
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "text", "n_repeated", "n_removed", spans.alias("removed"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"))


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"))


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hmm.score_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_bytecnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bytecnn.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_jaccard, op2_decontaminate, op3_secrets, op4_mix, op5_licenses, op6_surrogates, op7_linededup, op8_toxicity, op9_repetition, op10_hmm, op11_filters, op12_bytecnn, op13_collocations)
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_jaccard"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""

ORACLE_SQL["op2_decontaminate"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)
),
n AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, n WHERE len(w) >= n)
),
hits AS (SELECT r, p, n, item FROM grams JOIN win USING (n, g)),
places AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""

# Pieces are words and what stands between them; a place is a word's number in its text.
ORACLE_SQL["op7_linededup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS pieces,
    """ + _WORDS + r""" AS w
  FROM documents
),
win AS (SELECT r, doc_id, p, array_to_string(w[p : p + 49], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
again AS (SELECT r, p, n > 1 AS gone FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, r, p) AS n, count(*) OVER (PARTITION BY g) AS total FROM win) WHERE total > 1),
covered AS (SELECT r, q, bool_or(gone) AS gone FROM (SELECT r, gone, unnest(range(p, p + 50)) AS q FROM again) GROUP BY r, q),
piece AS (SELECT r, k, piece, regexp_matches(piece, '^[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]') AS word FROM (SELECT r, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS k FROM d)),
place AS (
  SELECT r, k, piece, word, sum(CAST(word AS INT)) OVER o AS q, CAST(coalesce(sum(length(piece)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM piece WINDOW o AS (PARTITION BY r ORDER BY k)
),
cut AS (
  SELECT p.*, coalesce(CASE WHEN word THEN a.gone ELSE a.gone AND b.gone END, false) AS gone, CASE WHEN word THEN a.q IS NOT NULL ELSE false END AS repeated
  FROM place p LEFT JOIN covered a ON a.r = p.r AND a.q = p.q LEFT JOIN covered b ON b.r = p.r AND b.q = p.q + 1
),
run AS (SELECT *, sum(CAST(gone AND NOT before AS INT)) OVER (PARTITION BY r ORDER BY k) AS run FROM (SELECT *, coalesce(lag(gone) OVER (PARTITION BY r ORDER BY k), false) AS before FROM cut)),
span AS (SELECT r, run, min(start) AS a, max(start + length(piece)) AS b FROM run WHERE gone GROUP BY r, run),
removed AS (SELECT r, count(*) AS n, string_agg(a || ':' || b, ',' ORDER BY a) AS list FROM span GROUP BY r),
kept AS (SELECT r, string_agg(piece, '' ORDER BY k) FILTER (WHERE NOT gone) AS text, CAST(sum(CAST(repeated AS INT)) AS BIGINT) AS n FROM cut GROUP BY r)
SELECT doc_id, CASE WHEN kept.r IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text, coalesce(kept.n, 0) AS n_repeated, coalesce(removed.n, 0) AS n_removed, coalesce(list, '') AS removed
FROM d LEFT JOIN kept USING (r) LEFT JOIN removed USING (r)
"""

ORACLE_SQL["op4_mix"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
),
s AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS most,
    CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)
),
k AS (
  SELECT *, row_number() OVER o AS nth,
    (sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM s WINDOW o AS (ORDER BY most / weight, source NULLS LAST)
),
f AS (SELECT arg_min(level, nth) AS level FROM k WHERE level * weight <= most),
t AS (SELECT source, source_size, CASE WHEN f.level IS NULL THEN most ELSE least(most, f.level * weight) END AS target FROM k LEFT JOIN f ON true),
r AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS expected,
    row_number() OVER (PARTITION BY d.source ORDER BY floor(sqrt(size)), doc_id NULLS FIRST, size) AS n,
    CAST('0x' || substr(md5('mix:' || coalesce(d.source, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST((floor(expected * n + u) - floor(expected * (n - 1) + u)) * size AS BIGINT) AS taken FROM r
"""

# A mask has one bit for each filter that a document fails, A first; "before" are the filters ahead of a step.
ORACLE_SQL["op11_filters"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask
  FROM d LEFT JOIN l USING (doc_id)
),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (
  SELECT o, k, substr(o, k, 1) AS f, 1 << (ascii(substr(o, k, 1)) - 65) AS bit, coalesce(list_sum(list_transform(range(1, k), lambda i: 1 << (ascii(substr(o, i, 1)) - 65))), 0) AS before
  FROM (SELECT o, unnest(range(1, 6)) AS k FROM o)
),
r AS (
  SELECT part, o, k, f, sum(CASE WHEN (mask & (before | bit)) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN (mask & before) <> 0 AND (mask & bit) <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM s, c GROUP BY part, o, k, f
)
SELECT part, o AS filter_order, CAST(k AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
"""

# All phrases of up to five words, cut out of pieces of text; their parts are looked up among them.
ORACLE_SQL["op13_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p WHERE len(w) > 0),
f AS (
  SELECT lang, phrase, m, count(*) AS f
  FROM (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS m FROM s))
  GROUP BY lang, phrase, m HAVING count(*) >= 100
),
c AS (SELECT lang, phrase, f AS a, m, string_split(phrase, ' ') AS w FROM f WHERE m >= 2),
k AS (SELECT lang, phrase, a, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 : m], ' ') AS rest, k FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
x AS (
  SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, n, CAST((1000 * CAST(a AS HUGEINT) * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.first JOIN f y ON y.lang = k.lang AND y.phrase = k.rest JOIN n ON n.lang = k.lang
),
best AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, a, array_to_string(w[i : i + j - 1], ' ') AS phrase
  FROM (SELECT lang, a, w, m, j, unnest(range(1, m - j + 2)) AS i FROM (SELECT lang, a, w, m, unnest(range(2, m)) AS j FROM c WHERE m > 2))
),
over AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY lang, phrase),
left_ AS (SELECT best.* FROM best LEFT JOIN over USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM left_)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
