"""Palette text: comma-separated hex colours, strictly or leniently read, and written back.

Strict reading goes from left to right and the first offence counts. In a colour, a character that is no hex digit gives "bad_char" with its
place, a seventh digit or fewer than six gives "wrong_digits", and a 257th colour that is itself sound gives "too_large".
Nothing is trimmed, so an empty string and a comma at the end give "wrong_digits" with an empty colour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import MAX_COLOURS, Colours


class PaletteError(ValueError):
    """kind, colour (text of the offender) and pos (for bad_char)."""

    def __init__(self, kind: str, colour: str = "", pos: int | None = None):
        self.kind, self.colour, self.pos = kind, colour, pos
        super().__init__({"bad_char": f"bad character in {colour!r} at {pos}\n  {colour}\n  {' ' * (pos or 0)}^", "wrong_digits": f"{colour!r} doesn't have six digits", "too_large": f"a palette has at most {MAX_COLOURS} colours"}[kind])


def offence(token: Column) -> Column:
    """struct(kind, colour, pos) of a colour's first offence, or null."""
    bad = F.regexp_instr(token, F.lit("[^0-9A-Fa-f]")) - 1
    return (
        F.when((bad >= 0) & (bad <= 6), F.struct(F.lit("bad_char").alias("kind"), token.alias("colour"), bad.cast("int").alias("pos")))
        .when((F.length(token) != 6) | (bad >= 0), F.struct(F.lit("wrong_digits").alias("kind"), token.alias("colour"), F.lit(None).cast("int").alias("pos")))
    )


def palette_error(text: Column) -> Column:
    """struct(kind, colour, pos) of a palette text's first offence, or null."""
    found = F.filter(F.transform(F.slice(F.split(text, ",", -1), 1, MAX_COLOURS + 1), offence), lambda x: x.isNotNull())
    none = F.lit(None)
    large = F.when(F.size(F.split(text, ",", -1)) > MAX_COLOURS, F.struct(F.lit("too_large").alias("kind"), none.cast("string").alias("colour"), none.cast("int").alias("pos")))
    return F.when(F.size(found) > 0, found[0]).otherwise(large)


def _channel(token: Column, k: int) -> Column:
    return F.conv(F.substring(token, 2 * k + 1, 2), 16, 10).cast("int")


def parse_palettes(df: DataFrame, *, id_column: str = "palette_id", text_column: str = "s") -> DataFrame:
    """(palette_id, idx, r, g, b) of the sound palette texts; parse_errors() tells of the others. A null text is neither."""
    sound = df.where(F.col(text_column).isNotNull() & palette_error(F.col(text_column)).isNull())
    rows = sound.select(F.col(id_column).alias("palette_id"), F.posexplode(F.split(text_column, ",", -1)).alias("idx", "token"))
    return rows.select("palette_id", "idx", *(_channel(F.col("token"), k).alias(c) for k, c in enumerate("rgb")))


def parse_errors(df: DataFrame, *, id_column: str = "palette_id", text_column: str = "s") -> DataFrame:
    """(palette_id, kind, colour, pos) of the palette texts that aren't sound."""
    return df.select(F.col(id_column).alias("palette_id"), palette_error(F.col(text_column)).alias("e")).where("e is not null").select("palette_id", "e.kind", "e.colour", "e.pos")


def parse_lines(df: DataFrame, *, id_column: str = "palette_id", text_column: str = "s") -> DataFrame:
    """Lenient reading of one #rrggbb in a line: other lines are skipped. All colours are kept, however many; check_palette() refuses more than an operator can take."""
    lines = F.filter(F.split(F.col(text_column), "\r?\n"), lambda x: F.trim(x).rlike("^#[0-9A-Fa-f]{6}$"))
    rows = df.select(F.col(id_column).alias("palette_id"), F.posexplode(lines).alias("idx", "line"))
    return rows.select("palette_id", "idx", *(_channel(F.substring(F.trim("line"), 2, 6), k).alias(c) for k, c in enumerate("rgb")))


def format_palettes(palettes: DataFrame, *, prefix: str = "", separator: str = ",") -> DataFrame:
    """(palette_id, s): rrggbb in lower case, in the order of idx."""
    colour = F.format_string(f"{prefix}%02x%02x%02x", "r", "g", "b")
    rows = palettes.groupBy("palette_id").agg(F.sort_array(F.collect_list(F.struct("idx", colour.alias("c")))).alias("all"))
    return rows.select("palette_id", F.array_join("all.c", separator).alias("s"))


def parse(text: str) -> Colours:
    """The colours of a palette text, strictly read on the driver; PaletteError tells the first offence."""
    out: Colours = []
    for token in text.split(","):
        for pos, c in enumerate(token):
            if c not in "0123456789abcdefABCDEF":
                raise PaletteError("bad_char", token, pos)
            if pos == 6:
                raise PaletteError("wrong_digits", token)
        if len(token) < 6:
            raise PaletteError("wrong_digits", token)
        if len(out) == MAX_COLOURS:
            raise PaletteError("too_large")
        out.append((int(token[:2], 16), int(token[2:4], 16), int(token[4:], 16)))
    return out


def format_colours(colours: Colours) -> str:
    return ",".join("%02x%02x%02x" % tuple(c) for c in colours)


def from_colours(spark, colours: Colours, palette_id: str = "palette") -> DataFrame:
    """A palette given as a list, as rows; more than 256 colours raise an error."""
    if len(colours) > MAX_COLOURS:
        raise PaletteError("too_large")
    return spark.createDataFrame([(palette_id, k, *map(int, c)) for k, c in enumerate(colours)], "palette_id string, idx int, r int, g int, b int")


#: Black and white.
DEFAULT: Colours = [(0, 0, 0), (255, 255, 255)]
