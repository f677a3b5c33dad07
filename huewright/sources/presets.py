"""Named palettes from text: a line holds `name: key=rrggbb key=rrggbb ...`.

Strict reading wants names and keys over a-z, 0-9 and '-', six hex digits for each value and at most 256 colours, and fails on the first bad line.
Lenient reading skips lines without a colon, tokens without '=' and palettes without colours. Of lines with the same name the first counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import MAX_COLOURS, Colours

#: Palettes that come with the package, in the format of a preset file.
BUILT_IN = """\
mono: black=000000 white=ffffff
greys-4: a=000000 b=555555 c=aaaaaa d=ffffff
primaries: black=000000 red=ff0000 green=00ff00 blue=0000ff yellow=ffff00 magenta=ff00ff cyan=00ffff white=ffffff
dusk: night=1b1b3a plum=693668 rose=a74482 coral=f84aa7 sand=ffd9c0
reef: deep=03045e sea=0077b6 shoal=00b4d8 foam=90e0ef sand=f4e9cd kelp=386641
"""

_LINE = r"^[a-z0-9-]+: *([a-z0-9-]+=[0-9A-Fa-f]{6} *)*$"


def _lines(spark: SparkSession, path: str | None) -> DataFrame:
    """(ord, line) in file order."""
    if path is None:
        return spark.createDataFrame(list(enumerate(BUILT_IN.rstrip("\n").split("\n"))), "ord int, line string")
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("ord", "line"))


def presets(spark: SparkSession, path: str | None = None, *, strict: bool = True) -> DataFrame:
    """(name, ord, idx, key, r, g, b) of a preset file, or of the built-in palettes. A strict read of a bad file raises ValueError.

    A palette without colours is one row of nulls after ord where the read is strict, and left out where it is lenient.
    """
    if strict and path is not None and spark.read.text(path, wholetext=True).where(F.col("value").endswith("\n")).isEmpty():
        raise ValueError("a preset file isn't empty and ends in a newline")
    return preset_rows(_lines(spark, path), strict=strict)


def preset_rows(lines: DataFrame, *, strict: bool = True) -> DataFrame:
    """presets() of the lines (ord, line) of a preset file."""
    if strict:
        values = F.size(F.regexp_extract_all("line", F.lit(r"="), F.lit(0)))
        bad = lines.where(~F.col("line").rlike(_LINE) | (values > MAX_COLOURS)).orderBy("ord").first()
        if bad:
            raise ValueError(f"line {bad.ord + 1} of the presets: expected 'name: key=rrggbb ...' of up to {MAX_COLOURS} colours, not {bad.line[:60]!r}")
    named = lines.where(F.instr("line", ":") > 0).select("ord", F.substring_index("line", ":", 1).alias("name"), F.expr("substring(line, instr(line, ':') + 1)").alias("rest"))
    tokens = F.regexp_extract_all("rest", F.lit("[a-z0-9-]+=[0-9A-Fa-f]{6}"), F.lit(0)) if strict else F.filter(F.split("rest", r"\s+"), lambda t: t.rlike("=[0-9A-Fa-f]{6}$"))
    first = named.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("ord"))).where("nth = 1")
    rows = first.select("name", "ord", (F.posexplode_outer if strict else F.posexplode)(tokens).alias("idx", "token"))
    value = F.substring_index("token", "=", -1)
    channels = [F.conv(F.substring(value, 2 * k + 1, 2), 16, 10).cast("int").alias(c) for k, c in enumerate("rgb")]
    return rows.select("name", "ord", "idx", F.substring_index("token", "=", 1).alias("key"), *channels)


def listed(lines: DataFrame) -> DataFrame:
    """(ord, name, idx, key, colour, r, g, b) of all palettes in lines (ord, line), as a list to choose from shows them: palettes of equal names and values that aren't colours stay, the latter
    with null channels. Lines without a colon, tokens without '=' and palettes without tokens are left out."""
    named = lines.where(F.instr("line", ":") > 0).select("ord", F.substring_index("line", ":", 1).alias("name"), F.expr("substring(line, instr(line, ':') + 1)").alias("rest"))
    tokens = named.select("ord", "name", F.posexplode(F.filter(F.split("rest", r"\s+"), lambda t: t.contains("="))).alias("idx", "token"))
    value = F.expr("substring(token, instr(token, '=') + 1)")
    sound = value.rlike("^[0-9A-Fa-f]{6}$")
    channels = [F.when(sound, F.conv(F.substring(value, 2 * k + 1, 2), 16, 10).cast("int")).alias(c) for k, c in enumerate("rgb")]
    return tokens.select("ord", "name", "idx", F.substring_index("token", "=", 1).alias("key"), F.concat(F.lit("#"), value).alias("colour"), *channels)


def preset_faults(spark: SparkSession, path: str) -> DataFrame:
    """(name, ord, key, value): what a lenient read of a preset file leaves out for values that aren't six hex digits, of first and later lines of a name."""
    named = _lines(spark, path).where(F.instr("line", ":") > 0).select(F.substring_index("line", ":", 1).alias("name"), "ord", F.expr("substring(line, instr(line, ':') + 1)").alias("rest"))
    tokens = named.select("name", "ord", F.explode(F.split("rest", r"\s+")).alias("token")).where(F.col("token").contains("=") & ~F.col("token").rlike("=[0-9A-Fa-f]{6}$"))
    return tokens.select("name", "ord", F.substring_index("token", "=", 1).alias("key"), F.expr("substring(token, instr(token, '=') + 1)").alias("value"))


def preset_names(spark: SparkSession, path: str | None = None) -> list[str]:
    """Names in file order."""
    return [r.name for r in presets(spark, path).groupBy("name").agg(F.min("ord").alias("ord")).orderBy("ord").collect()]


def preset(spark: SparkSession, name: str, path: str | None = None) -> Colours:
    """The colours of a palette by its exact name; it may have none."""
    rows = presets(spark, path).where(F.col("name") == name).orderBy("idx").collect()
    if not rows:
        raise ValueError(f"unknown palette {name!r}; there are {', '.join(preset_names(spark, path))}")
    return [(r.r, r.g, r.b) for r in rows if r.idx is not None]


def display_name(name):
    """Words of a name with upper-case initials, the rest of each word as it is."""
    word = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))
    return F.array_join(F.transform(F.split(name, "-"), word), " ")


def preset_sizes(presets: DataFrame) -> DataFrame:
    """(n_palettes, n_colours, shortest, longest): totals and name lengths."""
    per = presets.groupBy("name").agg(F.count("idx").alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_palettes"), F.sum("n").alias("n_colours"), F.min(F.length("name")).alias("shortest"), F.max(F.length("name")).alias("longest"))
