"""DuckDB SQL for the queries, written from the operators' definitions."""

from __future__ import annotations

from ..operators.kernels import KERNELS, Kernel

TILE = 16

_EVENTS = """px AS (
  SELECT CAST(event_id // 256 AS BIGINT) AS image_id, CAST(event_id % 256 // 16 AS INTEGER) AS y, CAST(event_id % 16 AS INTEGER) AS x,
    CAST(user_id * 37 % 256 AS INTEGER) AS r, CAST(CAST(round(value * 100) AS BIGINT) % 256 AS INTEGER) AS g, CAST(event_id * 101 % 256 AS INTEGER) AS b
  FROM events
  UNION ALL SELECT k // 256, CAST(k % 256 // 16 AS INTEGER), CAST(k % 16 AS INTEGER), 0, 0, 0 FROM (SELECT unnest(range(max(event_id) + 1, (max(event_id) // 256 + 1) * 256)) AS k FROM events)
)"""
_ORDERS = """px AS (
  SELECT CAST(o_orderkey // 256 AS BIGINT) AS image_id, CAST(o_orderkey % 256 // 16 AS INTEGER) AS y, CAST(o_orderkey % 16 AS INTEGER) AS x,
    CAST(o_custkey * 37 % 256 AS INTEGER) AS r, CAST(CAST(round(o_totalprice) AS BIGINT) % 256 AS INTEGER) AS g, CAST(o_orderkey * 101 % 256 AS INTEGER) AS b
  FROM orders
  UNION ALL SELECT k // 256, CAST(k % 256 // 16 AS INTEGER), CAST(k % 16 AS INTEGER), 0, 0, 0 FROM (SELECT unnest(range(max(o_orderkey) + 1, (max(o_orderkey) // 256 + 1) * 256)) AS k FROM orders)
)"""
_PARTS = """px AS (
  SELECT CAST(p_partkey // 16 AS INTEGER) AS y, CAST(p_partkey % 16 AS INTEGER) AS x,
    CAST(p_partkey * 37 % 256 AS INTEGER) AS r, CAST(CAST(round(p_retailprice * 10) AS BIGINT) % 256 AS INTEGER) AS g, CAST(p_size * 101 % 256 AS INTEGER) AS b
  FROM part
  UNION ALL SELECT CAST(k // 16 AS INTEGER), CAST(k % 16 AS INTEGER), 0, 0, 0 FROM (SELECT unnest(range(max(p_partkey) + 1, (max(p_partkey) // 256 + 1) * 256)) AS k FROM part)
)"""
_LINES = """px AS (
  SELECT CAST(1 AS BIGINT) AS image_id, CAST(l_orderkey * 37 % 256 AS INTEGER) AS r, CAST(l_partkey * 101 % 256 AS INTEGER) AS g, CAST(l_suppkey * 53 % 256 AS INTEGER) AS b FROM lineitem
)"""
_PALETTE = """pal AS (
  SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS idx, CAST(n_nationkey * 53 % 256 AS INTEGER) AS pr,
    CAST(n_nationkey * 97 % 256 AS INTEGER) AS pg, CAST(n_nationkey * 193 % 256 AS INTEGER) AS pb FROM nation
)"""
_KEY = "((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)) * 1000 + idx"
_BEST = f"best AS (SELECT r, g, b, CAST(min({_KEY}) % 1000 AS INTEGER) AS idx FROM (SELECT DISTINCT r, g, b FROM px), pal GROUP BY r, g, b)"
_NEAREST = f"WITH {{source}}, {_PALETTE}, {_BEST}"

ORACLE_SQL: dict[str, str] = {}
for _name in ("nearest_index", "nearest_index_unrolled", "nearest_index_array", "dither_none"):
    ORACLE_SQL[_name] = _NEAREST.format(source=_EVENTS) + " SELECT image_id, y, x, idx FROM px JOIN best USING (r, g, b)"
ORACLE_SQL["palette_usage"] = _NEAREST.format(source=_LINES) + """
SELECT idx, count(*) AS n, CAST(sum((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)) AS BIGINT) AS sse
FROM px JOIN best USING (r, g, b) JOIN pal USING (idx) GROUP BY idx"""
for _name, _source in (("recolour_none", _EVENTS), ("recolour_orders", _ORDERS)):
    ORACLE_SQL[_name] = _NEAREST.format(source=_source) + " SELECT image_id, y, x, pr AS r, pg AS g, pb AS b, 255 AS a FROM px JOIN best USING (r, g, b) JOIN pal USING (idx)"
ORACLE_SQL["image_error"] = _NEAREST.format(source=_ORDERS) + """
SELECT image_id, n_pixels, sse, CASE WHEN sse > 0 THEN round(10 * log10(255.0::DOUBLE * 255.0 * 3 * n_pixels / sse), 6) END AS psnr
FROM (SELECT image_id, count(*) AS n_pixels, CAST(sum((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)) AS BIGINT) AS sse
  FROM px JOIN best USING (r, g, b) JOIN pal USING (idx) GROUP BY image_id)"""

_MANY = ", ".join(f"CAST(p_partkey * 7919 // {256**i} % 256 AS INTEGER) AS p{c}" for i, c in enumerate("rgb"))
ORACLE_SQL["nearest_of_parts"] = f"""WITH {_EVENTS}, pal AS (SELECT min(CAST(p_partkey AS INTEGER)) AS idx, pr, pg, pb FROM (SELECT p_partkey, {_MANY} FROM part) GROUP BY pr, pg, pb),
box AS (SELECT DISTINCT r // 16 * 16 AS lr, g // 16 * 16 AS lg, b // 16 * 16 AS lb FROM px),
dist AS (
  SELECT lr, lg, lb, idx, {" + ".join(f"pow(greatest(l{c} - p{c}, p{c} - l{c} - 15, 0), 2)" for c in "rgb")} AS least, {" + ".join(f"pow(greatest(abs(p{c} - l{c}), abs(p{c} - l{c} - 15)), 2)" for c in "rgb")} AS most FROM box, pal
),
lists AS (SELECT lr, lg, lb, CAST(count(*) AS INTEGER) AS n_candidates FROM (SELECT *, min(most) OVER (PARTITION BY lr, lg, lb) AS bound FROM dist) WHERE least <= bound GROUP BY lr, lg, lb),
best AS (SELECT r, g, b, CAST(min(((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)) * 1000000 + idx) % 1000000 AS INTEGER) AS idx FROM (SELECT DISTINCT CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b FROM px), pal GROUP BY r, g, b)
SELECT image_id, y, x, idx, n_candidates FROM px JOIN best USING (r, g, b) JOIN lists ON lr = r // 16 * 16 AND lg = g // 16 * 16 AND lb = b // 16 * 16"""
_FRAME = "ROWS BETWEEN 7 PRECEDING AND CURRENT ROW"
ORACLE_SQL["ssim_recoloured"] = _NEAREST.format(source=_ORDERS) + f""",
n AS (SELECT (max(image_id) + 1) // 4 * 16 AS whole FROM px),
g AS (
  SELECT CAST(image_id // 4 * 16 + y AS INTEGER) AS y, CAST(image_id % 4 * 16 + x AS INTEGER) AS x, (299 * r + 587 * g + 114 * b) // 1000 AS a, (299 * pr + 587 * pg + 114 * pb) // 1000 AS b
  FROM px JOIN best USING (r, g, b) JOIN pal USING (idx)
),
i AS (SELECT CASE WHEN y >= whole THEN 1 ELSE 0 END AS image_id, CASE WHEN y >= whole THEN y - whole ELSE y END AS y, x, a, b, a * a AS aa, b * b AS bb, a * b AS ab FROM g, n),
h AS (SELECT image_id, y, x, {", ".join(f"sum({c}) OVER w AS {c}" for c in ("a", "b", "aa", "bb", "ab"))} FROM i WINDOW w AS (PARTITION BY image_id, y ORDER BY x {_FRAME})),
v AS (SELECT image_id, y, x, {", ".join(f"sum({c}) OVER w AS {c}" for c in ("a", "b", "aa", "bb", "ab"))} FROM h WINDOW w AS (PARTITION BY image_id, x ORDER BY y {_FRAME})),
m AS (SELECT *, a / 64 AS ma, b / 64 AS mb FROM v WHERE x >= 7 AND y >= 7)
SELECT CAST(image_id AS BIGINT) AS image_id, count(*) AS n_windows, {", ".join(f"CAST(sum({c}) AS BIGINT) AS sum_{c}" for c in ("a", "b", "aa", "bb", "ab"))},
  round(avg((2 * ma * mb + 6.5025::DOUBLE) * (2 * (ab / 64 - ma * mb) + 58.5225::DOUBLE) / ((ma * ma + mb * mb + 6.5025::DOUBLE) * ((aa + bb) / 64 - ma * ma - mb * mb + 58.5225::DOUBLE))), 6) AS ssim
FROM m GROUP BY image_id"""

_CELL = "((r >> (8 - level)) * 65536 + (g >> (8 - level)) * 256 + (b >> (8 - level)))"
_MORTON = "CAST((" + " + ".join(f"((r >> {k} & 1) << {3 * k + 2}) + ((g >> {k} & 1) << {3 * k + 1}) + ((b >> {k} & 1) << {3 * k})" for k in range(8)) + ") >> (24 - 3 * level) AS BIGINT)"
_LEVELS = f"lv AS (SELECT image_id, level, count(DISTINCT {_CELL}) AS n_cells FROM px, (SELECT CAST(unnest(range(0, 9)) AS INTEGER) AS level) GROUP BY image_id, level)"
ORACLE_SQL["octree_levels"] = f"WITH {_EVENTS}, {_LEVELS} SELECT * FROM lv"
_HISTOGRAM = f"WITH {{source}}, {_LEVELS}, ch AS (SELECT image_id, max(level) AS level FROM lv WHERE n_cells <= {{limit}} GROUP BY image_id), hist AS (SELECT image_id, level, {_MORTON} AS bin, count(*) AS n, CAST(sum(r) AS BIGINT) AS sum_r, CAST(sum(g) AS BIGINT) AS sum_g, CAST(sum(b) AS BIGINT) AS sum_b FROM px JOIN ch USING (image_id) GROUP BY ALL)"
ORACLE_SQL["octree_histogram"] = _HISTOGRAM.format(source=_EVENTS, limit=64) + " SELECT * FROM hist"
ORACLE_SQL["line_histogram"] = _HISTOGRAM.format(source=_LINES, limit=4096) + " SELECT * FROM hist"
_LINEAR = ", ".join(f"CASE WHEN sum_{c} / n / 255.0 <= 0.04045 THEN sum_{c} / n / 255.0 / 12.92 ELSE pow((sum_{c} / n / 255.0 + 0.055) / 1.055, 2.4) END AS {c}" for c in "rgb")
_LMS = f""", lin AS (SELECT image_id, bin, n, {_LINEAR} FROM (SELECT image_id, bin, CAST(n AS DOUBLE) AS n, sum_r, sum_g, sum_b FROM hist)),
lms AS (SELECT image_id, bin, n, cbrt(0.4122214708 * r + 0.5363325363 * g + 0.0514459929 * b) AS l, cbrt(0.2119034982 * r + 0.6806995451 * g + 0.1073969566 * b) AS m, cbrt(0.0883024619 * r + 0.2817188376 * g + 0.6299787005 * b) AS s FROM lin)"""
_LAB = {"l": "0.2104542553 * l + 0.7936177850 * m - 0.0040720468 * s", "a": "1.9779984951 * l - 2.4285922050 * m + 0.4505937099 * s", "b": "0.0259040371 * l + 0.7827717662 * m - 0.8086757660 * s"}
ORACLE_SQL["oklab_means"] = _HISTOGRAM.format(source=_EVENTS, limit=64) + _LMS + " SELECT image_id, bin, " + ", ".join(f"CAST(round(({e}) * 1e6) AS BIGINT) AS {c}" for c, e in _LAB.items()) + ", CAST(n AS BIGINT) AS w FROM lms"


def _extraction(k: int, source: str = _EVENTS) -> str:
    """CTEs ending in `found`: (image_id, idx, r, g, b). Each step splits one cluster of each image; eigenvalues by the cubic's cosine form, axes by a cross product of rows."""
    out = _HISTOGRAM.format(source=source, limit=1 << 18) + _LMS + ", c0 AS MATERIALIZED (SELECT image_id, bin, " + ", ".join(f"{e} AS {c}" for c, e in _LAB.items()) + ", n AS w, 0 AS c FROM lms)"
    for i in range(1, k):
        pairs = ", ".join(f"sum(t.w * (t.{x} - m{x}) * (t.{y} - m{y})) AS {x}{y}" for x, y in ("ll", "la", "lb", "aa", "ab", "bb"))
        crosses = ("la * ab - lb * (aa - v), lb * la - (ll - v) * ab, (ll - v) * (aa - v) - la * la", "la * (bb - v) - lb * ab, lb * lb - (ll - v) * (bb - v), (ll - v) * ab - la * lb", "(aa - v) * (bb - v) - ab * ab, ab * lb - la * (bb - v), la * ab - (aa - v) * lb")
        out += f""",
m{i} AS MATERIALIZED (SELECT image_id, c, count(*) AS n, sum(w) AS total, sum(w * l) / sum(w) AS ml, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb FROM c{i - 1} GROUP BY image_id, c),
s{i} AS (SELECT t.image_id, t.c, n, total, ml, ma, mb, {pairs} FROM c{i - 1} t JOIN m{i} m ON t.image_id = m.image_id AND t.c = m.c GROUP BY ALL),
q{i} AS (SELECT *, (ll + aa + bb) / 3 AS q FROM s{i} WHERE n > 1),
p{i} AS (SELECT *, sqrt((pow(ll - q, 2) + pow(aa - q, 2) + pow(bb - q, 2) + 2 * (la * la + lb * lb + ab * ab)) / 6) AS p FROM q{i}),
v{i} AS (SELECT *, q + 2 * p * cos(acos(greatest(-1.0, least(1.0, ((ll - q) * ((aa - q) * (bb - q) - ab * ab) - la * (la * (bb - q) - ab * lb) + lb * (la * ab - (aa - q) * lb)) / (2 * p * p * p)))) / 3) AS v FROM p{i} WHERE p > 0),
u{i} AS (SELECT image_id, c, ml, ma, mb, list_sort([{", ".join(f"{{'n': list_sum(list_transform([{x}], lambda z: z * z)), 'u': [{x}]}}" for x in crosses)}], 'DESC')[1].u AS u
  FROM v{i} WHERE v > 1e-14 * total QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY v DESC, c) = 1),
w{i} AS MATERIALIZED (SELECT image_id, c, ml, ma, mb, u, CASE WHEN list_max(u) >= -list_min(u) THEN 1 ELSE -1 END AS sign FROM u{i}),
c{i} AS MATERIALIZED (SELECT t.image_id, t.bin, t.l, t.a, t.b, t.w, CASE WHEN ((t.l - ml) * u[1] + (t.a - ma) * u[2] + (t.b - mb) * u[3]) * sign >= 0 THEN {i} ELSE t.c END AS c FROM c{i - 1} t LEFT JOIN w{i} p ON t.image_id = p.image_id AND t.c = p.c)"""
    linear = ("4.0767416621 * l - 3.3077115913 * m + 0.2309699292 * s", "-1.2684380046 * l + 2.6097574011 * m - 0.3413193965 * s", "-0.0041960863 * l - 0.7034186147 * m + 1.7076147010 * s")
    value = "CAST(greatest(0, least(255, floor(CASE WHEN {0} <= 0.0031308 THEN {0} * 12.92 ELSE 1.055 * pow({0}, 1 / 2.4::DOUBLE) - 0.055 END * 255.0 + 0.5))) AS INTEGER) AS {0}"
    return out + f""",
mean AS (SELECT image_id, c, sum(w * l) / sum(w) AS l, sum(w * a) / sum(w) AS a, sum(w * b) / sum(w) AS b FROM c{k - 1} GROUP BY image_id, c),
cone AS (SELECT image_id, c, pow(l + 0.3963377774 * a + 0.2158037573 * b, 3) AS l, pow(l - 0.1055613458 * a - 0.0638541728 * b, 3) AS m, pow(l - 0.0894841775 * a - 1.2914855480 * b, 3) AS s FROM mean),
light AS (SELECT image_id, c, {", ".join(f"{e} AS {c}" for e, c in zip(linear, "rgb", strict=True))} FROM cone),
found AS (SELECT image_id, CAST(c AS INTEGER) AS idx, {", ".join(value.format(c) for c in "rgb")} FROM light)"""


ORACLE_SQL["extract_palette_8"] = _extraction(8) + " SELECT * FROM found"
ORACLE_SQL["line_palette"] = _extraction(16, _LINES) + " SELECT * FROM found"
ORACLE_SQL["apply_extracted"] = _extraction(8) + " SELECT px.image_id, px.y, px.x, CAST(min(((px.r - f.r) * (px.r - f.r) + (px.g - f.g) * (px.g - f.g) + (px.b - f.b) * (px.b - f.b)) * 1000 + f.idx) % 1000 AS INTEGER) AS idx FROM px JOIN found f ON f.image_id = px.image_id GROUP BY px.image_id, px.y, px.x"
ORACLE_SQL["image_moments"] = f"WITH {_EVENTS} SELECT image_id, count(*) AS w, " + ", ".join(f"round(avg({c}), 3) AS mean_{c}" for c in "rgb") + ", " + ", ".join(f"round(sum({x} * {y}) - sum({x}) * sum({y}) / CAST(count(*) AS DOUBLE), 3) AS cov_{x}_{y}" for x, y in ("rr", "rg", "rb", "gg", "gb", "bb")) + " FROM px GROUP BY image_id"

ORACLE_SQL["upsample_2x"] = f"WITH {_EVENTS}, s AS (SELECT unnest([0, 1]) AS k) SELECT image_id, CAST(2 * y + j.k AS INTEGER) AS y, CAST(2 * x + i.k AS INTEGER) AS x, r, g, b, 255 AS a FROM px, s AS j, s AS i"


def _tap(c: str, window: str) -> str:
    after = f"coalesce(lead({c}) OVER {window}, {c})"
    return f"coalesce(lag({c}) OVER {window}, {c}) + 3 * {c} + 3 * {after} + coalesce(lead({c}, 2) OVER {window}, {after})"


def _tents(source: str, rows: str, out: str, channels: str) -> str:
    """Two CTEs: sums of rows, and the result."""
    across, down = (", ".join(f"{e} AS {c}" for c, e in ((c, f(c)) for c in channels)) for f in (lambda c: _tap(c, "w"), lambda c: f"CAST((({_tap(c, 'w')}) + 32) // 64 AS INTEGER)"))
    return f"""{rows} AS (SELECT image_id, y, CAST(x // 2 AS INTEGER) AS x, {", ".join(channels)} FROM (SELECT image_id, y, x, {across} FROM {source} WINDOW w AS (PARTITION BY image_id, y ORDER BY x)) WHERE x % 2 = 0),
{out} AS (SELECT image_id, CAST(y // 2 AS INTEGER) AS y, x, {", ".join(channels)} FROM (SELECT image_id, y, x, {down} FROM {rows} WINDOW w AS (PARTITION BY image_id, x ORDER BY y)) WHERE y % 2 = 0)"""


ORACLE_SQL["tent_rows"] = f"WITH {_ORDERS}, {_tents('px', 'h', 'v', 'rgb')} SELECT * FROM h"
ORACLE_SQL["tent_2x"] = f"WITH {_ORDERS}, {_tents('px', 'h', 'v', 'rgb')} SELECT * FROM v"


ORACLE_SQL["tent_tall_4x"] = f"WITH {_ORDERS}, tall AS (SELECT CAST(0 AS BIGINT) AS image_id, CAST(image_id * {TILE} + y AS INTEGER) AS y, x, r, g, b FROM px), {_tents('tall', 'h', 'v', 'rgb')}, {_tents('v', 'h2', 'v2', 'rgb')} SELECT * FROM v2"


def _large(scale: int) -> str:
    return f"none AS (SELECT image_id, y, x, pr AS r, pg AS g, pb AS b, 255 AS a FROM px JOIN best USING (r, g, b) JOIN pal USING (idx)), s AS (SELECT unnest(range(0, {scale})) AS k), large AS (SELECT image_id, CAST({scale} * y + j.k AS INTEGER) AS y, CAST({scale} * x + i.k AS INTEGER) AS x, r, g, b, a FROM none, s AS j, s AS i)"


ORACLE_SQL["multisample_2x_none"] = _NEAREST.format(source=_EVENTS) + f", {_large(2)}, {_tents('large', 'h', 'v', 'rgba')} SELECT * FROM v"
ORACLE_SQL["multisample_4x_none"] = _NEAREST.format(source=_EVENTS) + f", {_large(4)}, {_tents('large', 'h', 'v', 'rgba')}, {_tents('v', 'h2', 'v2', 'rgba')} SELECT * FROM v2"


def _diffusion(k: Kernel, scale: int) -> str:
    """CTEs ending in `idx`: (image_id, y, x, idx) by a recursion over the pixels in raster order."""
    size = TILE * scale
    taps = sorted(k.taps, key=lambda t: (-t[1], -t[0]))

    def value(c: str) -> str:
        terms = [f"CASE WHEN p % {size} - ({dx}) BETWEEN 0 AND {size - 1} AND p // {size} >= {dy} THEN e{c}[p + 1 - {dy * size} - ({dx})] * {w} // {k.divisor} ELSE 0 END" for dx, dy, w in taps]
        v = f"s{c}[p + 1]"
        if scale > 1:
            return f"greatest(0, least(255, {' + '.join([v, *terms])}))"
        for t in terms:
            v = f"greatest(0, least(255, {v} + {t}))"
        return v

    source = "px" if scale == 1 else f"(SELECT image_id, {scale} * y + j.k AS y, {scale} * x + i.k AS x, r, g, b FROM px, (SELECT unnest(range(0, {scale})) AS k) AS j, (SELECT unnest(range(0, {scale})) AS k) AS i)"
    lists = ", ".join(f"list({c} ORDER BY y, x) AS s{c}" for c in "rgb")
    return f"""WITH RECURSIVE {_EVENTS}, {_PALETTE},
pl AS (SELECT list({{'i': idx, 'r': pr, 'g': pg, 'b': pb}} ORDER BY idx) AS pal FROM pal),
src AS (SELECT image_id, {lists} FROM {source} GROUP BY image_id),
t AS (
  SELECT image_id, 0 AS p, CAST([] AS INTEGER[]) AS er, CAST([] AS INTEGER[]) AS eg, CAST([] AS INTEGER[]) AS eb, CAST([] AS INTEGER[]) AS found FROM src
  UNION ALL
  SELECT image_id, p + 1, list_append(er, vr - pal[k + 1].r), list_append(eg, vg - pal[k + 1].g), list_append(eb, vb - pal[k + 1].b), list_append(found, k)
  FROM (
    SELECT *, CAST(list_min(list_transform(pal, lambda c: ((vr - c.r) * (vr - c.r) + (vg - c.g) * (vg - c.g) + (vb - c.b) * (vb - c.b)) * 1000 + c.i)) % 1000 AS INTEGER) AS k
    FROM (SELECT t.image_id, p, er, eg, eb, found, pal, CAST({value("r")} AS INTEGER) AS vr, CAST({value("g")} AS INTEGER) AS vg, CAST({value("b")} AS INTEGER) AS vb FROM t JOIN src ON t.image_id = src.image_id, pl WHERE p < {size * size})
  )
),
idx AS (SELECT image_id, CAST(q // {size} AS INTEGER) AS y, CAST(q % {size} AS INTEGER) AS x, idx FROM (SELECT image_id, unnest(found) AS idx, unnest(range(0, {size * size})) AS q FROM t WHERE p = {size * size}))"""


def _tall_diffusion(k: Kernel) -> str:
    """One image of all parts: a recursion over its pixels that holds the errors of the last two rows."""
    taps = sorted(k.taps, key=lambda t: (-t[1], -t[0]))
    held = max(dy * TILE + dx for dx, dy, _ in taps)

    def value(c: str) -> str:
        v = f"s{c}[p + 2]"
        for dx, dy, w in taps:
            v = f"greatest(0, least(255, {v} + CASE WHEN (p + 1) % {TILE} - ({dx}) BETWEEN 0 AND {TILE - 1} AND (p + 1) // {TILE} >= {dy} THEN e{c}[{held + 1 - dy * TILE - dx}] * {w} // {k.divisor} ELSE 0 END))"
        return v

    lists = ", ".join(f"list({c} ORDER BY y, x) AS s{c}" for c in "rgb")
    start = ", ".join(f"CAST(list_transform(range(0, {held}), lambda z: 0) AS INTEGER[]) AS e{c}" for c in "rgb")
    return f"""WITH RECURSIVE {_PARTS}, {_PALETTE},
pl AS (SELECT list({{'i': idx, 'r': pr, 'g': pg, 'b': pb}} ORDER BY idx) AS pal FROM pal),
src AS (SELECT count(*) AS n, {lists} FROM px),
t AS (
  SELECT -1 AS p, {start}, -1 AS k
  UNION ALL
  SELECT p + 1, {", ".join(f"list_append(e{c}[2:], v{c} - pal[k + 1].{c})" for c in "rgb")}, k
  FROM (
    SELECT p, er, eg, eb, vr, vg, vb, pal, CAST(list_min(list_transform(pal, lambda c: ((vr - c.r) * (vr - c.r) + (vg - c.g) * (vg - c.g) + (vb - c.b) * (vb - c.b)) * 1000 + c.i)) % 1000 AS INTEGER) AS k
    FROM (SELECT p, er, eg, eb, pal, {", ".join(f"CAST({value(c)} AS INTEGER) AS v{c}" for c in "rgb")} FROM t, src, pl WHERE p + 1 < n)
  )
)
SELECT CAST(0 AS BIGINT) AS image_id, CAST(p // {TILE} AS INTEGER) AS y, CAST(p % {TILE} AS INTEGER) AS x, k AS idx FROM t WHERE p >= 0"""


ORACLE_SQL["dither_tall_jjn"] = _tall_diffusion(next(k for k in KERNELS if k.name == "jjn"))
for _kernel in KERNELS[1:]:
    ORACLE_SQL[f"dither_{_kernel.name}"] = _diffusion(_kernel, 1) + " SELECT image_id, y, x, idx FROM idx"
    ORACLE_SQL[f"multisample_2x_{_kernel.name}"] = _diffusion(_kernel, 2) + f", large AS (SELECT image_id, y, x, pr AS r, pg AS g, pb AS b, 255 AS a FROM idx JOIN pal USING (idx)), {_tents('large', 'h', 'v', 'rgba')} SELECT * FROM v"
    ORACLE_SQL[f"multisample_4x_{_kernel.name}"] = _diffusion(_kernel, 4) + f", large AS (SELECT image_id, y, x, pr AS r, pg AS g, pb AS b, 255 AS a FROM idx JOIN pal USING (idx)), {_tents('large', 'h', 'v', 'rgba')}, {_tents('v', 'h2', 'v2', 'rgba')} SELECT * FROM v2"

_HEX = "printf('%02x%02x%02x', n_nationkey * 53 % 256, n_nationkey * 97 % 256, n_nationkey * 193 % 256)"
ORACLE_SQL["hex_format"] = f"SELECT CAST(n_regionkey AS VARCHAR) AS palette_id, string_agg({_HEX}, ',' ORDER BY n_nationkey) AS s FROM nation GROUP BY n_regionkey"
ORACLE_SQL["hex_parse"] = "SELECT CAST(n_regionkey AS VARCHAR) AS palette_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS idx, CAST(n_nationkey * 53 % 256 AS INTEGER) AS r, CAST(n_nationkey * 97 % 256 AS INTEGER) AS g, CAST(n_nationkey * 193 % 256 AS INTEGER) AS b FROM nation"
_ODD = """code AS (SELECT p_partkey AS k, p_brand, printf('%06x', p_partkey * 7919 % 16777216) AS c FROM part),
odd AS (SELECT CAST(k AS VARCHAR) AS palette_id, CASE k % 7 WHEN 0 THEN c || ',' WHEN 1 THEN c || '0' WHEN 2 THEN ' ' || c WHEN 3 THEN substr(c, 1, 3) || 'g' || c
  WHEN 4 THEN array_to_string(list_transform(range(0, 250 + k % 13), lambda x: c), ',') WHEN 5 THEN p_brand ELSE c || ',' || upper(c) END AS s FROM code),
tok AS (SELECT palette_id, unnest(string_split(s, ',')) AS t, unnest(range(0, len(string_split(s, ',')))) AS i FROM odd),
bad AS (SELECT palette_id, i, t, len(regexp_extract(t, '^[0-9A-Fa-f]*')) AS ok FROM tok),
err AS (
  SELECT palette_id, i, CASE WHEN ok < len(t) AND ok <= 6 THEN 'bad_char' WHEN ok <> 6 OR len(t) <> 6 THEN 'wrong_digits' WHEN i = 256 THEN 'too_large' END AS kind,
    CASE WHEN NOT (ok = 6 AND len(t) = 6) THEN t END AS colour, CASE WHEN ok < len(t) AND ok <= 6 THEN CAST(ok AS INTEGER) END AS pos FROM bad
),
firsts AS (SELECT palette_id, arg_min({'kind': kind, 'colour': colour, 'pos': pos}, i) AS e FROM err WHERE kind IS NOT NULL GROUP BY palette_id)"""
ORACLE_SQL["hex_errors"] = f"WITH {_ODD} SELECT palette_id, e.kind AS kind, e.colour AS colour, e.pos AS pos FROM firsts"
_CHANNEL = "CAST(CAST('0x' || substr(t, {at}, 2) AS BIGINT) AS INTEGER)"
ORACLE_SQL["hex_sound"] = f"WITH {_ODD} SELECT palette_id, count(*) AS n, CAST(sum({_CHANNEL.format(at=1)} * (i + 1)) AS BIGINT) AS check_r, CAST(sum({_CHANNEL.format(at=5)} * (i + 1)) AS BIGINT) AS check_b FROM tok WHERE palette_id NOT IN (SELECT palette_id FROM firsts) GROUP BY palette_id"
ORACLE_SQL["line_import"] = f"WITH {_ODD} SELECT * FROM (SELECT palette_id, CAST(row_number() OVER (PARTITION BY palette_id ORDER BY i) - 1 AS INTEGER) AS idx, " + ", ".join(f"{_CHANNEL.format(at=a)} AS {c}" for a, c in ((1, "r"), (3, "g"), (5, "b"))) + " FROM bad WHERE ok = 6 AND len(t) = 6)"

ORACLE_SQL["sql_parse"] = f"WITH {_ODD} SELECT palette_id, CAST(i AS INTEGER) AS idx, " + ", ".join(f"{_CHANNEL.format(at=a)} AS {c}" for a, c in ((1, "r"), (3, "g"), (5, "b"))) + " FROM tok WHERE palette_id NOT IN (SELECT palette_id FROM firsts)"
ORACLE_SQL["sql_format"] = ORACLE_SQL["hex_format"]
ORACLE_SQL["sql_nearest"] = f"""WITH {_EVENTS}, pal AS (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k, n_nationkey * 53 % 256 AS pr, n_nationkey * 97 % 256 AS pg, n_nationkey * 193 % 256 AS pb FROM nation)
SELECT image_id, y, x, CAST(min(((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)) * 1000 + k) % 1000 AS INTEGER) AS idx FROM px JOIN pal ON n_regionkey = image_id % 5 GROUP BY image_id, y, x"""
_LISTED = """named AS (SELECT replace(lower(p_brand), '#', '-') || '-' || p_partkey // 1000 AS name, p_partkey AS k, printf('%06x', p_partkey * 7919 % 16777216) AS t FROM part),
p AS (SELECT name, CAST(min(k) OVER (PARTITION BY name) AS INTEGER) AS ord, CAST(row_number() OVER (PARTITION BY name ORDER BY k) - 1 AS INTEGER) AS idx, 'k' || k AS key, t FROM named)"""
_SHOWN = "array_to_string(list_transform(string_split(name, '-'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"
ORACLE_SQL["preset_colours"] = f"WITH {_LISTED} SELECT name, ord, idx, key, " + ", ".join(f"{_CHANNEL.format(at=a)} AS {c}" for a, c in ((1, "r"), (3, "g"), (5, "b"))) + " FROM p"
ORACLE_SQL["preset_catalogue"] = f"WITH {_LISTED} SELECT DISTINCT ord, name, {_SHOWN} AS display FROM p"
ORACLE_SQL["preset_totals"] = f"WITH {_LISTED} SELECT count(DISTINCT name) AS n_palettes, count(*) AS n_colours, CAST(min(len(name)) AS INTEGER) AS shortest, CAST(max(len(name)) AS INTEGER) AS longest FROM p"
ORACLE_SQL["preset_listed"] = """WITH c AS (SELECT CAST(p_partkey AS INTEGER) AS ord, lower(p_type) AS name, printf('%06x', p_partkey * 7919 % 16777216) AS t, p_partkey % 5 AS m FROM part),
e AS (
  SELECT ord, name, 0 AS idx, 'a' AS key, t AS v FROM c WHERE m = 0
  UNION ALL SELECT ord, name, 1, 'b', 'zz' FROM c WHERE m = 0
  UNION ALL SELECT ord, name, 0, 'c', t || '0' FROM c WHERE m = 2
  UNION ALL SELECT ord, name, 1, 'd', '=' || t FROM c WHERE m = 2
  UNION ALL SELECT ord, 'p', 0, t, '#' || t FROM c WHERE m = 4
)
SELECT ord, name, CAST(idx AS INTEGER) AS idx, key, '#' || v AS colour, """ + ", ".join(f"CASE WHEN key = 'a' THEN CAST(CAST('0x' || substr(v, {a}, 2) AS BIGINT) AS INTEGER) ELSE -1 END AS {c}" for a, c in ((1, "r"), (3, "g"), (5, "b"))) + " FROM e"
ORACLE_SQL["preset_applied"] = f"""WITH {_EVENTS}, {_LISTED},
pal AS (SELECT name, idx, """ + ", ".join(f"{_CHANNEL.format(at=a)} AS p{c}" for a, c in ((1, "r"), (3, "g"), (5, "b"))) + f""" FROM p WHERE name LIKE '%-0')
SELECT image_id, y, x, name, CAST(min(((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)) * 1000 + idx) % 1000 AS INTEGER) AS idx
FROM px JOIN pal ON pal.name = 'brand-' || (image_id % 25 + 1) || '-0' GROUP BY image_id, y, x, name"""
ORACLE_SQL["ditherer_catalogue"] = f"WITH {_EVENTS}, t AS (SELECT CAST(image_id % 7 AS INTEGER) AS ord, count(DISTINCT image_id) AS n_images FROM px GROUP BY 1) SELECT d.*, coalesce(n_images, 0) AS n_images FROM (VALUES ('none', 'No dithering', 1, 0, 0, 0), ('fs', 'Floyd-Steinberg', 16, 4, 16, 1), ('atkinson', 'Atkinson', 8, 6, 6, 2), ('jjn', 'Jarvis, Judice, and Ninke', 48, 12, 48, 3), ('burkes', 'Burkes', 32, 7, 32, 4), ('sierra32', 'Sierra', 32, 10, 32, 5), ('sierra4', 'Sierra Lite', 4, 3, 4, 6)) AS d(name, display, divisor, n_taps, weight, ord) LEFT JOIN t USING (ord)"
ORACLE_SQL["nibble_pack"] = f"WITH {_EVENTS}, pal AS (SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS idx, n_nationkey * 53 % 256 AS pr, n_nationkey * 97 % 256 AS pg, n_nationkey * 193 % 256 AS pb FROM nation) WHERE idx < 16), {_BEST} SELECT image_id, CAST(p // 15 AS INTEGER) AS y, CAST(p % 15 // 2 AS INTEGER) AS k, CAST(sum(CASE WHEN p % 15 % 2 = 0 THEN idx * 16 ELSE idx END) AS INTEGER) AS byte FROM (SELECT image_id, 16 * y + x AS p, idx FROM px JOIN best USING (r, g, b)) GROUP BY ALL"
ORACLE_SQL["png_rgb"] = f"WITH {_EVENTS} SELECT image_id, 16 AS width, 16 AS height, string_agg(printf('%02x%02x%02xff', r, g, b), '' ORDER BY y, x) AS pixels FROM px GROUP BY image_id"
ORACLE_SQL["png_indexed"] = _NEAREST.format(source=_EVENTS) + " SELECT image_id, 16 AS width, 16 AS height, string_agg(printf('%02x%02x%02xff', pr, pg, pb), '' ORDER BY y, x) AS pixels FROM px JOIN best USING (r, g, b) JOIN pal USING (idx) GROUP BY image_id"
