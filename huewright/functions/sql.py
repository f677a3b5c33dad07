"""Palette functions for SQL, written in SQL: Spark puts their bodies into the query's plan, so no Python runs.

    parse_palette(s)            table: idx, r, g, b of a sound palette text; no rows for others
    palette_of(s)               array<struct<r,g,b>> of a sound palette text, else null
    nearest_index(palette, r, g, b)   index of the nearest colour in an array<struct<r,g,b>>, the lowest on ties; null for an empty palette
    format_palette(palette)     rrggbb,rrggbb,... of an array<struct<r,g,b>>
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..model import MAX_COLOURS

_COLOURS = "array<struct<r:int,g:int,b:int>>"
_R, _G, _B = (f"cast(conv(substring(t, {at}, 2), 16, 10) as int)" for at in (1, 3, 5))
_SOUND = f"s rlike '^[0-9A-Fa-f]{{6}}(,[0-9A-Fa-f]{{6}})*$' and length(s) < {7 * MAX_COLOURS}"
FUNCTIONS = (
    f"""palette_of(s STRING) RETURNS {_COLOURS}
RETURN if({_SOUND}, transform(split(s, ','), t -> named_struct('r', {_R}, 'g', {_G}, 'b', {_B})), null)""",
    f"""parse_palette(s STRING) RETURNS TABLE (idx INT, r INT, g INT, b INT)
RETURN SELECT pos, {_R}, {_G}, {_B} FROM (SELECT posexplode(split(if({_SOUND}, s, null), ',')) AS (pos, t)) AS p""",
    f"""nearest_index(palette {_COLOURS}, r INT, g INT, b INT) RETURNS INT
RETURN array_min(transform(palette, (p, k) -> cast((r - p.r) * (r - p.r) + (g - p.g) * (g - p.g) + (b - p.b) * (b - p.b) as bigint) * {1 << 20} + k)) % {1 << 20}""",
    f"""format_palette(palette {_COLOURS}) RETURNS STRING
RETURN array_join(transform(palette, p -> format_string('%02x%02x%02x', p.r, p.g, p.b)), ',')""",
)


def register(spark: SparkSession) -> SparkSession:
    """Create the functions for this session, in place of any of the same names."""
    for f in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f}")
    return spark
