"""Palette text, presets and the command line."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from huewright import cli
from huewright.functions import palettes as P
from huewright.sources import png, presets

CASES = {
    "ffffff": [(255, 255, 255)],
    "00Ff00,0a0B0c": [(0, 255, 0), (10, 11, 12)],
    "": ("wrong_digits", "", None),
    "ffffff,": ("wrong_digits", "", None),
    "00000": ("wrong_digits", "00000", None),
    "000": ("wrong_digits", "000", None),
    "0000000": ("wrong_digits", "0000000", None),
    "0000000x": ("wrong_digits", "0000000x", None),
    "0" * 65536: ("wrong_digits", "0" * 65536, None),
    "x00ff": ("bad_char", "x00ff", 0),
    "000000x": ("bad_char", "000000x", 6),
    " 000000": ("bad_char", " 000000", 0),
    "000000, 000000": ("bad_char", " 000000", 0),
    "#000000": ("bad_char", "#000000", 0),
    "12g456,zz": ("bad_char", "12g456", 2),
    ",".join(["0a0b0c"] * 256): [(10, 11, 12)] * 256,
    ",".join(["000000"] * 257): ("too_large", None, None),
    ",".join(["000000"] * 256 + ["00"]): ("wrong_digits", "00", None),
    ",".join(["000000"] * 65537): ("too_large", None, None),
    ",".join(["000000"] * 257 + ["x"]): ("too_large", None, None),
}


@pytest.mark.parametrize("text", CASES, ids=range(len(CASES)))
def test_parse(text):
    want = CASES[text]
    if isinstance(want, list):
        assert P.parse(text) == want
    else:
        with pytest.raises(P.PaletteError) as e:
            P.parse(text)
        assert (e.value.kind, e.value.pos) == (want[0], want[2]) and (e.value.colour or None) == (want[1] or None)


def test_parse_columns(spark):
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(CASES)] + [("null", None)], "palette_id string, s string")
    errors = {r.palette_id: (r.kind, r.colour, r.pos) for r in P.parse_errors(df).collect()}
    rows = {}
    for r in P.parse_palettes(df).orderBy("palette_id", "idx").collect():
        rows.setdefault(r.palette_id, []).append((r.r, r.g, r.b))
    for k, want in enumerate(CASES.values()):
        if isinstance(want, list):
            assert rows[str(k)] == want and str(k) not in errors
        else:
            assert errors[str(k)] == want and str(k) not in rows
    assert "null" not in errors and "null" not in rows


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 255)] * 3), min_size=1, max_size=256))
def test_round_trip(colours):
    assert P.parse(P.format_colours(colours)) == colours


def test_format_and_lines(spark):
    df = P.from_colours(spark, [(0, 10, 255), (1, 2, 3)], "p")
    assert P.format_palettes(df).first().s == "000aff,010203"
    text = P.format_palettes(df, prefix="#", separator="\n").first().s
    got = P.parse_lines(spark.createDataFrame([("p", f"junk\n{text}\n#12345\r\n #FFffFF\n#12345g")], "palette_id string, s string")).orderBy("idx").collect()
    assert [(r.r, r.g, r.b) for r in got] == [(0, 10, 255), (1, 2, 3), (255, 255, 255)]
    with pytest.raises(P.PaletteError):
        P.from_colours(spark, [(0, 0, 0)] * 257)


def test_presets(spark, tmp_path):
    assert presets.preset_names(spark) == ["mono", "greys-4", "primaries", "dusk", "reef"]
    assert presets.preset(spark, "mono") == [(0, 0, 0), (255, 255, 255)]
    for name in ("Mono", "none", ""):
        with pytest.raises(ValueError, match="unknown palette"):
            presets.preset(spark, name)
    f = tmp_path / "p.txt"
    f.write_text("b: x=000001\na: x=000002 y=000003  \nb: x=ffffff\nempty:\n")
    assert presets.preset(spark, "b", str(f)) == [(0, 0, 1)] and presets.preset_names(spark, str(f)) == ["b", "a", "empty"]
    assert presets.preset(spark, "empty", str(f)) == [] and presets.preset_sizes(presets.presets(spark, str(f))).first()[:2] == (3, 3)
    for bad in ("noline\n", "\n", "a: x=00000\n", "A: x=000000\n", "a: =000000\n", "a: x=00000g\n", "a:" + " x=000000" * 257 + "\n"):
        f.write_text("ok: x=000000\n" + bad)
        with pytest.raises(ValueError, match="line 2"):
            presets.presets(spark, str(f))
    for bad in ("", "a: x=000000"):
        f.write_text(bad)
        with pytest.raises(ValueError, match="newline"):
            presets.presets(spark, str(f))
    f.write_text("a: x=000001y=000002  z=000003\n")
    assert presets.preset(spark, "a", str(f)) == [(0, 0, 1), (0, 0, 2), (0, 0, 3)]
    f.write_text("no colon\nsome-Name here: x=000000 junk y=zz z=0000ff\n: \n")
    rows = presets.presets(spark, str(f), strict=False).orderBy("idx").collect()
    assert [(r.key, r.b) for r in rows] == [("x", 0), ("z", 255)]
    assert [tuple(r) for r in presets.preset_faults(spark, str(f)).collect()] == [("some-Name here", 1, "y", "zz")]
    shown = presets.presets(spark).select(presets.display_name(presets.F.col("name")).alias("d")).distinct().collect()
    assert "Greys 4" in {r.d for r in shown}


@pytest.fixture
def picture(tmp_path):
    import numpy as np

    rng = np.random.default_rng(3)
    path = tmp_path / "in.png"
    path.write_bytes(png.encode_rgb(rng.integers(0, 256, (9, 13, 3)).astype("uint8")))
    return path


def test_cli(spark, picture, tmp_path, capsys):
    out = tmp_path / "out.png"
    allowed = {(0, 0, 0), (255, 255, 255)}
    assert cli.run(spark, ["apply", str(picture), str(out)]) == 0
    assert {tuple(p) for p in png.decode(out.read_bytes())[..., :3].reshape(-1, 3).tolist()} <= allowed
    assert cli.run(spark, ["apply", str(picture), str(out), "-k", "5", "-d", "none"]) == 0
    assert len({tuple(p) for p in png.decode(out.read_bytes()).reshape(-1, 4).tolist()}) <= 5
    assert cli.run(spark, ["apply", str(picture), str(out), "-k", "3", "--palette-from", str(picture), "-m", "2x"]) == 0
    assert png.decode(out.read_bytes()).shape == (9, 13, 4)
    capsys.readouterr()
    assert cli.run(spark, ["extract", str(picture), "-k", "4"]) == 0
    assert len(P.parse(capsys.readouterr().out.strip())) == 4
    assert cli.run(spark, ["palette", "list"]) == 0 and cli.run(spark, ["palette", "show", "mono"]) == 0
    assert capsys.readouterr().out.strip().endswith("reef\n000000,ffffff")
    for bad in (["apply", "nowhere.png", str(out)], ["apply", str(picture), "out.xyz"], ["apply", str(picture), str(out), "-p", "nothing"], ["apply", str(picture), str(out), "-c", "00ff"], ["palette", "show", "nothing"], ["extract", __file__]):
        assert cli.run(spark, bad) == 1
        assert "error:" in capsys.readouterr().err
    for usage in (["apply", "a", "b", "-p", "x", "-c", "000000"], ["apply", "a", "b", "-p", "x", "-k", "3"], ["apply", "a", "b", "-k", "0"], ["apply", "a", "b", "-k", "257"], ["apply", "a", "b", "-d", "other"], []):
        with pytest.raises(SystemExit):
            cli.run(spark, usage)


def test_cli_formats(spark, picture, tmp_path):
    """The same pixels in every format; BMP by Spark's own reader."""
    from huewright.sources.images import read_images

    files = {form: tmp_path / f"out.{form}" for form in ("png", "bmp", "ppm")}
    for f in files.values():
        assert cli.run(spark, ["apply", str(picture), str(f), "-c", "102030,ff8000,00ffff"]) == 0
    want = png.decode(files["png"].read_bytes())
    assert len({tuple(p) for p in want.reshape(-1, 4).tolist()}) == 3
    assert files["ppm"].read_bytes() == b"P6\n13 9\n255\n" + want[..., :3].tobytes()
    row = read_images(spark, str(files["bmp"])).first()
    assert (row.width, row.height, row.pixels) == (13, 9, want.tobytes())


def test_sql_functions(spark):
    """The functions are SQL all the way: no Python in the plans, texts as strict reading takes them."""
    from huewright.functions.sql import register

    register(register(spark))
    texts = ["000000,ff00Aa", "zz", "", None, "0000001", "000000,", ",".join(["0a0b0c"] * 256), ",".join(["0a0b0c"] * 257), " 000000"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, s string").createOrReplaceTempView("some_texts")
    rows = spark.sql("SELECT k, p.* FROM some_texts, LATERAL parse_palette(s) p")
    got = {}
    for r in rows.collect():
        got.setdefault(r.k, []).append((r.idx, r.r, r.g, r.b))
    assert sorted(got) == [0, 6] and got[0] == [(0, 0, 0, 0), (1, 255, 0, 170)] and len(got[6]) == 256
    one = spark.sql("SELECT k, format_palette(palette_of(s)) AS f, nearest_index(palette_of(s), 250, 3, 160) AS i, nearest_index(array(), 1, 2, 3) AS none FROM some_texts")
    assert [(r.f, r.i, r.none) for r in one.orderBy("k").collect()][:2] == [("000000,ff00aa", 1, None), (None, None, None)]
    assert spark.sql("SELECT nearest_index(palette_of('010000,010000,ffffff'), 0, 0, 0)").first()[0] == 0
    for df in (rows, one):
        assert "EvalPython" not in df._jdf.queryExecution().toString()
