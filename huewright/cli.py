"""Command line: apply, extract, palette list and palette show."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .functions.palettes import DEFAULT, PaletteError, format_colours, parse
from .model import MAX_COLOURS, Colours, explode_pixels
from .operators.dither import dither_packed
from .operators.extract import extract_palette
from .operators.kernels import DEFAULT as DEFAULT_DITHERER
from .operators.kernels import KERNELS
from .session import ship
from .sources.images import FORMATS, apply_palette, encode_images, read_images
from .sources.presets import preset, preset_names

DEFAULT_K = 16


def _count(text: str) -> int:
    k = int(text)
    if not 1 <= k <= MAX_COLOURS:
        raise argparse.ArgumentTypeError(f"1 to {MAX_COLOURS}")
    return k


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="huewright", description="Recolour images to palettes.")
    commands = p.add_subparsers(dest="command", required=True)
    a = commands.add_parser("apply", help="recolour an image")
    a.add_argument("input")
    a.add_argument("output")
    source = a.add_mutually_exclusive_group()
    source.add_argument("-p", "--palette", help="name of a palette")
    source.add_argument("-c", "--colors", help="comma-separated rrggbb")
    a.add_argument("-k", "--extract", type=_count, help="take so many colours from an image")
    a.add_argument("--palette-from", help="the image to take them from; the input if left out")
    a.add_argument("-d", "--dither", default=DEFAULT_DITHERER, choices=[k.name for k in KERNELS])
    a.add_argument("-m", "--multisample", choices=["2x", "4x"])
    e = commands.add_parser("extract", help="print a palette of an image")
    e.add_argument("image")
    e.add_argument("-k", type=_count, default=DEFAULT_K)
    shown = commands.add_parser("palette", help="named palettes").add_subparsers(dest="what", required=True)
    shown.add_parser("list")
    shown.add_parser("show").add_argument("name")
    return p


def _image(spark: SparkSession, path: str):
    if not Path(path).is_file():
        raise ValueError(f"can't open {path}")
    images = read_images(spark, path)
    if images.isEmpty():
        raise ValueError(f"can't decode {path}")
    return images


def _palette(spark: SparkSession, args: argparse.Namespace, images) -> Colours:
    """--palette-from, then -k, -p, -c and black and white, in this order."""
    if args.palette_from:
        return extract_palette(explode_pixels(_image(spark, args.palette_from)), args.extract or DEFAULT_K)
    if args.extract:
        return extract_palette(explode_pixels(images), args.extract)
    if args.palette:
        return preset(spark, args.palette)
    return parse(args.colors) if args.colors is not None else DEFAULT


def run(spark: SparkSession, argv: list[str]) -> int:
    p = parser()
    args = p.parse_args(argv)
    if args.command == "apply" and (args.palette or args.colors is not None) and (args.extract or args.palette_from):
        p.error("-p and -c can't stand with -k or --palette-from")
    try:
        if args.command == "palette":
            print("\n".join(preset_names(spark)) if args.what == "list" else format_colours(preset(spark, args.name)))
        elif args.command == "extract":
            print(format_colours(extract_palette(explode_pixels(_image(spark, args.image)), args.k)))
        else:
            form = Path(args.output).suffix.lower()[1:]
            if form not in FORMATS:
                raise ValueError(f"the output must end in .{', .'.join(FORMATS)}")
            images = _image(spark, args.input)
            palette = _palette(spark, args, images)
            if args.multisample or form != "png":
                rows = encode_images(dither_packed(images, palette, args.dither, scale=int((args.multisample or "1")[0])), form)
            else:
                rows = apply_palette(images, palette, args.dither)
            Path(args.output).write_bytes(rows.first()[form])
    except (ValueError, PaletteError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


def main() -> int:
    spark = SparkSession.builder.appName("huewright").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return run(ship(spark), sys.argv[1:])
