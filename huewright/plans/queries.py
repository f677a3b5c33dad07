"""The registered queries of the palette operators, over images that are derived from the tables with integer arithmetic.

events and orders make tiles of 16 x 16 pixels, the last one filled up with black, lineitem colours without places, nation a palette of 25 colours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.palettes import format_palettes, parse_errors, parse_lines, parse_palettes
from ..functions.sql import register
from ..model import Colours, pack_pixels
from ..operators.dither import dither, dither_indices, dither_packed
from ..operators.extract import extract_palettes
from ..operators.histogram import colour_counts, histogram, level_counts, moments, oklab_bins
from ..operators.kernels import KERNELS, ditherers
from ..operators.nearest import lookup, nearest, nearest_many, nearest_of_array, nearest_unrolled, psnr, recolour, recolour_distinct, squared_error
from ..operators.resample import downsample, tent_horizontal, upsample
from ..operators.similarity import brightness, ssim
from ..sources.images import decode_files, encode_images, encode_indexed_images, pack_nibble_rows
from ..sources.presets import display_name, listed, preset_rows, preset_sizes
from ..storage import written
from . import oracle

TILE = oracle.TILE


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tiles(rows: DataFrame, key: str, r, g, b) -> DataFrame:
    """Pixels of all rows of a table with dense keys from 0, in tiles; the last tile is filled up with black."""
    last = rows.agg(F.max(key)).first()[0]
    at = F.col(key) % TILE**2
    place = (F.floor(F.col(key) / TILE**2).cast("long").alias("image_id"), F.floor(at / TILE).cast("int").alias("y"), (at % TILE).cast("int").alias("x"))
    found = rows.select(*place, *((c % 256).cast("int").alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"))), F.lit(255).alias("a"))
    if last is None:
        return found
    rest = rows.sparkSession.range(last + 1, (last // TILE**2 + 1) * TILE**2, numPartitions=1).withColumnRenamed("id", key)
    return found.union(rest.select(*place, *(F.lit(0).alias(c) for c in "rgb"), F.lit(255).alias("a")))


def event_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(_table(spark, sf_dir, "events"), "event_id", F.col("user_id") * 37, F.round(F.col("value") * 100).cast("long"), F.col("event_id") * 101)


def order_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(_table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_custkey") * 37, F.round(F.col("o_totalprice")).cast("long"), F.col("o_orderkey") * 101)


def line_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours without places."""
    parts = (("l_orderkey", 37), ("l_partkey", 101), ("l_suppkey", 53))
    return _table(spark, sf_dir, "lineitem").select(*((F.col(c) * k % 256).cast("int").alias(n) for (c, k), n in zip(parts, "rgb", strict=True)))


def nation_palette(spark: SparkSession, sf_dir: str) -> Colours:
    keys = sorted(r.n_nationkey for r in _table(spark, sf_dir, "nation").select("n_nationkey").collect())  # 25 rows
    return [(k * 53 % 256, k * 97 % 256, k * 193 % 256) for k in keys]


def nearest_index(spark, d):
    return nearest(event_pixels(spark, d), nation_palette(spark, d)).select("image_id", "y", "x", "idx")


def nearest_index_unrolled(spark, d):
    return event_pixels(spark, d).select("image_id", "y", "x", nearest_unrolled(nation_palette(spark, d)).alias("idx"))


def nearest_index_array(spark, d):
    palette = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(p, "rgb", strict=True))) for p in nation_palette(spark, d)))
    return event_pixels(spark, d).select("image_id", "y", "x", nearest_of_array(palette).alias("idx"))


def palette_usage(spark, d):
    found = lookup(nearest(line_colours(spark, d).withColumns({f"{c}0": F.col(c) for c in "rgb"}), p := nation_palette(spark, d)), p)
    error = sum((F.pow(F.col(c) - F.col(f"{c}0"), F.lit(2)) for c in "gb"), F.pow(F.col("r") - F.col("r0"), F.lit(2)))
    return found.groupBy("idx").agg(F.count(F.lit(1)).alias("n"), F.sum(error).cast("long").alias("sse"))


def nearest_of_parts(spark, d):
    """A palette of as many colours as there are parts."""
    k = F.col("p_partkey") * 7919
    palette = _table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("idx"), *((F.floor(k / 256**i) % 256).cast("int").alias(c) for i, c in enumerate("rgb")))
    return nearest_many(event_pixels(spark, d), palette).select("image_id", "y", "x", "idx", "n_candidates")


def ssim_recoloured(spark, d):
    """The tiles of the orders, side by side in rows of 64 pixels, against what recolouring makes of them."""
    rows = nearest(order_pixels(spark, d), nation_palette(spark, d))
    new = lookup(rows.withColumn("a", brightness(F.col("r"), F.col("g"), F.col("b"))), nation_palette(spark, d)).withColumn("b", brightness(F.col("r"), F.col("g"), F.col("b")))
    tile = F.col("image_id")
    placed = new.select(F.lit(0).cast("long").alias("image_id"), (F.floor(tile / 4) * TILE + F.col("y")).cast("int").alias("y"), (tile % 4 * TILE + F.col("x")).cast("int").alias("x"), "a", "b")
    whole = F.floor((F.lit(new.agg(F.max("image_id")).first()[0]) + 1) / 4) * TILE  # a last row of fewer tiles is an image of its own
    last = F.col("y") >= whole
    found = ssim(placed.select(F.when(last, 1).otherwise(0).cast("long").alias("image_id"), F.when(last, F.col("y") - whole).otherwise(F.col("y")).cast("int").alias("y"), "x", "a", "b"))
    return found.select("image_id", "n_windows", "sum_a", "sum_b", "sum_aa", "sum_bb", "sum_ab", F.round("ssim", 6).alias("ssim"))


def recolour_none(spark, d):
    return recolour(event_pixels(spark, d), nation_palette(spark, d))


def recolour_orders(spark, d):
    return recolour_distinct(order_pixels(spark, d), nation_palette(spark, d))


def image_error(spark, d):
    return psnr(squared_error(order_pixels(spark, d), nation_palette(spark, d))).select("image_id", "n_pixels", "sse", F.round("psnr", 6).alias("psnr"))


def octree_levels(spark, d):
    return level_counts(written(colour_counts(event_pixels(spark, d))))


def octree_histogram(spark, d):
    return histogram(event_pixels(spark, d), 64)


def line_histogram(spark, d):
    return histogram(line_colours(spark, d).withColumn("image_id", F.lit(1).cast("long")), 1 << 12)


def oklab_means(spark, d):
    rows = oklab_bins(histogram(event_pixels(spark, d), 64))
    return rows.select("image_id", "bin", *(F.round(F.col(c) * 1e6).cast("long").alias(c) for c in "lab"), F.col("w").cast("long").alias("w"))


def image_moments(spark, d):
    rows = moments(event_pixels(spark, d).withColumn("one", F.lit(1)), ["image_id"], "one", ("r", "g", "b"))
    return rows.select("image_id", "w", *(F.round(c, 3).alias(c) for c in rows.columns[2:]))


def upsample_2x(spark, d):
    return upsample(event_pixels(spark, d), 2)


def tent_rows(spark, d):
    return tent_horizontal(order_pixels(spark, d), ("r", "g", "b"))


def tent_2x(spark, d):
    return downsample(order_pixels(spark, d), ("r", "g", "b"))


def tent_tall_4x(spark, d):
    """All tiles of the orders as one image, to a quarter of its size."""
    rows = order_pixels(spark, d)
    tall = rows.withColumns({"y": (F.col("image_id") * TILE + F.col("y")).cast("int"), "image_id": F.lit(0).cast("long")})
    return downsample(tall, ("r", "g", "b"), 4)


def _dither(name):
    return lambda spark, d: dither_indices(event_pixels(spark, d), nation_palette(spark, d), name)


def _multisample(name, scale):
    return lambda spark, d: dither(event_pixels(spark, d), nation_palette(spark, d), name, scale=scale)


def _tall(spark, d):
    """All parts in tiles, one below the other: one image 16 pixels wide."""
    tiles = _tiles(_table(spark, d, "part"), "p_partkey", F.col("p_partkey") * 37, F.round(F.col("p_retailprice") * 10).cast("long"), F.col("p_size") * 101)
    return tiles.select(F.lit(0).cast("long").alias("image_id"), (F.col("image_id") * TILE + F.col("y")).cast("int").alias("y"), "x", "r", "g", "b", "a")


def dither_tall_jjn(spark, d):
    return dither_indices(_tall(spark, d), nation_palette(spark, d), "jjn")


def _palette_texts(spark, d):
    """One hex text for each region, of its nations' colours."""
    rows = _table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("palette_id"), F.col("n_nationkey").alias("idx"), *((F.col("n_nationkey") * k % 256).cast("int").alias(c) for k, c in ((53, "r"), (97, "g"), (193, "b"))))
    return format_palettes(rows)


def hex_format(spark, d):
    return _palette_texts(spark, d)


def hex_parse(spark, d):
    return parse_palettes(_palette_texts(spark, d))


def _odd_texts(spark, d):
    """Texts that are palettes or nearly so, with an offence of every kind."""
    k = F.col("p_partkey")
    code = F.lower(F.lpad(F.conv((k * 7919 % 16777216).cast("string"), 10, 16), 6, "0"))
    text = (
        F.when(k % 7 == 0, F.concat(code, F.lit(",")))
        .when(k % 7 == 1, F.concat(code, F.lit("0")))
        .when(k % 7 == 2, F.concat(F.lit(" "), code))
        .when(k % 7 == 3, F.concat(F.substring(code, 1, 3), F.lit("g"), code))
        .when(k % 7 == 4, F.array_join(F.array_repeat(code, (250 + k % 13).cast("int")), ","))
        .when(k % 7 == 5, F.col("p_brand"))
        .otherwise(F.concat(code, F.lit(","), F.upper(code)))
    )
    return _table(spark, d, "part").select(k.cast("string").alias("palette_id"), text.alias("s"))


def hex_errors(spark, d):
    return parse_errors(_odd_texts(spark, d))


def hex_sound(spark, d):
    return parse_palettes(_odd_texts(spark, d)).groupBy("palette_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("r").cast("long") * (F.col("idx") + 1)).alias("check_r"), F.sum(F.col("b").cast("long") * (F.col("idx") + 1)).alias("check_b"))


def line_import(spark, d):
    texts = _odd_texts(spark, d).select("palette_id", F.concat(F.lit("#"), F.regexp_replace("s", ",", "\n#")).alias("s"))
    return parse_lines(texts)


def _preset_lines(spark, d):
    """A preset file's lines (ord, line) made of the parts: a palette for each brand and thousand of keys."""
    part = _table(spark, d, "part")
    k = F.col("p_partkey")
    name = F.concat(F.lower(F.regexp_replace("p_brand", "#", "-")), F.lit("-"), F.floor(k / 1000).cast("string"))
    token = F.format_string("k%d=%06x", k, k * 7919 % 16777216)
    rows = part.groupBy(name.alias("name")).agg(F.min(k).alias("ord"), F.sort_array(F.collect_list(F.struct(k, token.alias("t")))).alias("all"))
    return rows.select(F.col("ord").cast("int").alias("ord"), F.concat("name", F.lit(": "), F.array_join("all.t", " ")).alias("line"))


def sql_parse(spark, d):
    _odd_texts(register(spark), d).createOrReplaceTempView("palette_texts")
    return spark.sql("SELECT t.palette_id, p.idx, p.r, p.g, p.b FROM palette_texts t, LATERAL parse_palette(t.s) p")


def sql_format(spark, d):
    _palette_texts(register(spark), d).createOrReplaceTempView("palette_texts")
    return spark.sql("SELECT palette_id, format_palette(palette_of(upper(s))) AS s FROM palette_texts")


def sql_nearest(spark, d):
    """Each tile in the colours of a region, the regions in turn."""
    _palette_texts(register(spark), d).createOrReplaceTempView("palette_texts")
    event_pixels(spark, d).createOrReplaceTempView("event_pixels")
    return spark.sql("SELECT image_id, y, x, nearest_index(palette_of(s), r, g, b) AS idx FROM event_pixels JOIN palette_texts ON palette_id = cast(image_id % 5 AS string)")


def preset_colours(spark, d):
    return preset_rows(_preset_lines(spark, d))


def preset_catalogue(spark, d):
    return preset_rows(_preset_lines(spark, d)).select("ord", "name", display_name(F.col("name")).alias("display")).distinct()


def preset_totals(spark, d):
    return preset_sizes(preset_rows(_preset_lines(spark, d)))


def preset_listed(spark, d):
    """Odd preset lines, a part each: equal names, values that are no colours, tokens without '=', lines without a colon."""
    k = F.col("p_partkey")
    code = F.lower(F.lpad(F.conv((k * 7919 % 16777216).cast("string"), 10, 16), 6, "0"))
    line = F.when(k % 5 == 0, F.concat(F.lower("p_type"), F.lit(": a="), code, F.lit("  b=zz"))).when(k % 5 == 1, F.concat(F.lower("p_type"), F.lit(" x="), code)).when(k % 5 == 2, F.concat(F.lower("p_type"), F.lit(":junk c="), code, F.lit("0 d=="), code)).when(k % 5 == 3, F.lit("none: a b")).otherwise(F.concat(F.lit("p:"), code, F.lit("=#"), code))
    found = listed(_table(spark, d, "part").select(k.cast("int").alias("ord"), line.alias("line")))
    return found.withColumns({c: F.coalesce(c, F.lit(-1)) for c in "rgb"})


def preset_applied(spark, d):
    """Every tile of the events in the preset that its number names, the brands in turn."""
    lines = _preset_lines(spark, d)
    named = preset_rows(lines).where("name rlike '-0$'").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("idx", "r", "g", "b"))).alias("palette"))
    pixels = event_pixels(spark, d).withColumn("name", F.concat(F.lit("brand-"), (F.col("image_id") % 25 + 1).cast("string"), F.lit("-0")))
    return pixels.join(named, "name").select("image_id", "y", "x", "name", nearest_of_array(F.col("palette")).alias("idx"))


def ditherer_catalogue(spark, d):
    """The ditherers in their order, with the tiles of the events that take turns at naming them."""
    tiles = event_pixels(spark, d).select((F.col("image_id") % len(KERNELS)).cast("int").alias("ord"), "image_id").groupBy("ord").agg(F.countDistinct("image_id").alias("n_images"))
    rows = ditherers(spark).select("ord", "name", "display", "divisor", F.size("taps").alias("n_taps"), F.aggregate("taps", F.lit(0), lambda a, t: a + t["weight"]).alias("weight"))
    return rows.join(tiles, "ord", "left").withColumn("n_images", F.coalesce("n_images", F.lit(0).cast("long")))


def nibble_pack(spark, d):
    """The tiles in rows of 15 pixels, an odd number, and one more, in the first 16 colours: a nibble holds no other index."""
    at = F.col("y") * TILE + F.col("x")
    found = nearest(event_pixels(spark, d), nation_palette(spark, d)[:16])
    return pack_nibble_rows(found.select("image_id", F.floor(at / (TILE - 1)).cast("int").alias("y"), (at % (TILE - 1)).alias("x"), "idx"))


def png_rgb(spark, d):
    files = encode_images(pack_pixels(event_pixels(spark, d))).select(F.col("image_id").cast("string").alias("path"), F.col("png").alias("content"))
    return decode_files(files).select(F.col("path").cast("long").alias("image_id"), "width", "height", F.lower(F.hex("pixels")).alias("pixels"))


def png_indexed(spark, d):
    palette = nation_palette(spark, d)
    packed = dither_packed(pack_pixels(event_pixels(spark, d)), palette, "none", indices=True)
    files = encode_indexed_images(packed, palette).select(F.col("image_id").cast("string").alias("path"), F.col("png").alias("content"))
    return decode_files(files).select(F.col("path").cast("long").alias("image_id"), "width", "height", F.lower(F.hex("pixels")).alias("pixels"))


def extract_palette_8(spark, d):
    return extract_palettes(event_pixels(spark, d), 8)


def line_palette(spark, d):
    """One palette of 16 colours for the whole table."""
    return extract_palettes(line_colours(spark, d).withColumn("image_id", F.lit(1).cast("long")), 16)


def apply_extracted(spark, d):
    """Every image in its own palette of 8 colours."""
    pixels = event_pixels(spark, d)
    palettes = extract_palettes(pixels, 8).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("idx", "r", "g", "b"))).alias("palette"))
    rows = pixels.join(palettes, "image_id")
    return rows.select("image_id", "y", "x", nearest_of_array(F.col("palette")).alias("idx"))


_PLAIN = (nearest_index, nearest_index_unrolled, nearest_index_array, palette_usage, recolour_none, recolour_orders, image_error, octree_levels, octree_histogram, line_histogram, oklab_means, image_moments, upsample_2x, tent_rows, tent_2x, hex_format, hex_parse, hex_errors, hex_sound, line_import, preset_colours, preset_catalogue, preset_totals, ditherer_catalogue, nibble_pack, png_rgb, png_indexed, extract_palette_8, apply_extracted, dither_tall_jjn, line_palette, tent_tall_4x, preset_listed, preset_applied, nearest_of_parts, ssim_recoloured, sql_parse, sql_format, sql_nearest)
QUERIES = {f.__name__: f for f in _PLAIN}
QUERIES |= {f"dither_{k.name}": _dither(k.name) for k in KERNELS}
QUERIES |= {f"multisample_2x_{k.name}": _multisample(k.name, 2) for k in KERNELS} | {f"multisample_4x_{k.name}": _multisample(k.name, 4) for k in KERNELS}
FLAGSHIP = QUERIES["dither_fs"]
ORACLE_SQL = oracle.ORACLE_SQL
