"""Nearest colours, dithering, resampling, histograms, extraction and codecs against plain versions."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from huewright import model
from huewright.functions import colour
from huewright.operators import dither, extract, histogram, kernels, nearest, resample, similarity
from huewright.sources import images, png
from huewright.streaming import apply_stream, read_image_stream

SIZES = [(1, 1), (2, 1), (1, 2), (1, 5), (5, 1), (3, 3), (7, 5), (16, 3), (24, 18)]
NAMES = [k.name for k in kernels.KERNELS]


def random_image(seed, width, height):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.integers(0, 256, (height, width, 3)), rng.integers(0, 256, (height, width, 1))], -1).astype(np.uint8)


def random_palette(seed, n):
    return [tuple(map(int, c)) for c in np.random.default_rng(seed).integers(0, 256, (n, 3))]


def packed(spark, arrays):
    return spark.createDataFrame([(k, a.shape[1], a.shape[0], bytearray(a.tobytes())) for k, a in enumerate(arrays)], model.IMAGES)


def arrays(df):
    return {r.image_id: np.frombuffer(bytes(r.pixels), np.uint8).reshape(r.height, r.width, len(r.pixels) // max(1, r.width * r.height) or 4) for r in df.collect()}


def slow_nearest(c, palette):
    return min(range(len(palette)), key=lambda k: (sum((int(x) - int(y)) ** 2 for x, y in zip(c, palette[k], strict=True)), k))


def slow_dither(image, palette, kernel, once):
    """Pushes each error on to its taps, in raster order."""
    h, w = image.shape[:2]
    value = image[..., :3].astype(int).tolist()
    acc = [[[0, 0, 0] for _ in range(w)] for _ in range(h)]
    out = np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            now = [max(0, min(255, v + a)) for v, a in zip(value[y][x], acc[y][x], strict=True)] if once else value[y][x]
            k = out[y, x] = slow_nearest(now, palette)
            for dx, dy, weight in kernel.taps:
                if 0 <= x + dx < w and y + dy < h:
                    for c in range(3):
                        e = int((now[c] - palette[k][c]) * weight / kernel.divisor)
                        if once:
                            acc[y + dy][x + dx][c] += e
                        else:
                            value[y + dy][x + dx][c] = max(0, min(255, value[y + dy][x + dx][c] + e))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 31, 200])
def test_nearest(n):
    colours, palette = random_image(1, 29, 17)[..., :3].reshape(-1, 3), random_palette(n, n)
    assert nearest.nearest_indices(colours, np.array(palette)).tolist() == [slow_nearest(c, palette) for c in colours]


def test_nearest_forms(spark):
    palette = [*random_palette(4, 11), (7, 7, 7), (7, 7, 7)]
    pixels = model.explode_pixels(packed(spark, [random_image(2, 23, 11), np.full((2, 2, 4), 7, np.uint8)]))
    table = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(p, "rgb", strict=True))) for p in palette))
    rows = nearest.nearest(pixels, palette).withColumns({"u": nearest.nearest_unrolled(palette), "t": nearest.nearest_of_array(table)}).collect()
    assert all(r.idx == r.u == r.t for r in rows) and max(r.idx for r in rows) <= 11
    assert nearest.nearest_unrolled([(1, 1, 1)]) is not None
    a, b = nearest.recolour(pixels, palette), nearest.recolour_distinct(pixels, palette)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    assert nearest.recolour(a, palette).exceptAll(a).count() == 0
    alphas = pixels.select("image_id", "y", "x", "a")
    assert a.select("image_id", "y", "x", "a").exceptAll(alphas).count() == 0
    for bad in ([], [(0, 0, 0)] * 257, [(0, 0, 256)]):
        with pytest.raises(ValueError):
            nearest.nearest(pixels, bad)
    with pytest.raises(ValueError):
        nearest.nearest(pixels, palette, column="a")


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("once", [False, True])
def test_diffuse(name, once):
    for seed, (w, h) in enumerate(SIZES):
        palette = random_palette(seed + 9, (2, 3, 13)[seed % 3])
        pair = np.stack([random_image(seed, w, h), random_image(seed + 50, w, h)])
        got = dither.diffuse(pair[..., :3], np.array(palette, np.int32), kernels.kernel(name), clamp_once=once)
        for k in range(2):
            assert got[k].tolist() == slow_dither(pair[k], palette, kernels.kernel(name), once).tolist()


def test_clamping_differs():
    image, palette = random_image(5, 40, 30)[None, ..., :3], np.array(random_palette(5, 4), np.int32)
    a, b = (dither.diffuse(image, palette, kernels.kernel("fs"), clamp_once=x) for x in (False, True))
    assert (a != b).any()


@pytest.mark.parametrize("name", ["none", "fs", "jjn"])
def test_packed_and_indices(spark, name):
    palette = random_palette(1, 12)
    pictures = [random_image(k, w, h) for k, (w, h) in enumerate(SIZES)] + [np.zeros((0, 0, 4), np.uint8)]
    df = packed(spark, pictures)
    rgba, index = arrays(dither.dither_packed(df, palette, name)), arrays(dither.dither_packed(df, palette, name, indices=True))
    for k, p in enumerate(pictures):
        assert rgba[k].shape[0] == p.shape[0]
        if p.size:
            assert (np.array(palette)[index[k][..., 0]] == rgba[k][..., :3]).all() and (rgba[k][..., 3] == p[..., 3]).all()
    again = arrays(dither.dither_packed(dither.dither_packed(df, palette, name), palette, name))
    assert all((again[k] == rgba[k]).all() for k in rgba)
    exploded = model.explode_pixels(df)
    one, many = (dither.dither_indices(exploded.repartition(n), palette, name) for n in (1, 7))
    assert one.exceptAll(many).count() == many.exceptAll(one).count() == 0 and one.count() == sum(p.shape[0] * p.shape[1] for p in pictures)


def slow_tent(a):
    h, w, c = a.shape
    out = np.zeros((h // 2, w // 2, c), int)
    for y in range(h // 2):
        for x in range(w // 2):
            s = sum(wj * wi * a[min(max(2 * y - 1 + j, 0), h - 1), min(max(2 * x - 1 + i, 0), w - 1)].astype(int) for j, wj in enumerate((1, 3, 3, 1)) for i, wi in enumerate((1, 3, 3, 1)))
            out[y, x] = (s + 32) // 64
    return out


@pytest.mark.parametrize("scale", [2, 4])
def test_multisample(spark, scale):
    palette = random_palette(2, 5)
    pictures = [random_image(k, w, h) for k, (w, h) in enumerate(SIZES[:8])] + [np.zeros((0, 3, 4), np.uint8)]
    for name in ("none", "fs", "sierra32"):
        got = arrays(dither.dither_packed(packed(spark, pictures), palette, name, scale=scale))
        for k, p in enumerate(pictures[:-1]):
            large = p.repeat(scale, 0).repeat(scale, 1).astype(int)
            large[..., :3] = np.array(palette)[slow_dither(large, palette, kernels.kernel(name), True)]
            for _ in range(scale // 2):
                large = slow_tent(large)
            assert (got[k] == large).all()
    grey = dither.multisample(np.full((1, 32, 32, 4), 128, np.uint8), np.array([(0, 0, 0), (255, 255, 255)], np.int32), kernels.kernel("fs"), scale)
    assert len(np.unique(grey[..., 0])) > 2
    with pytest.raises(ValueError):
        dither.dither_packed(packed(spark, pictures), palette, scale=3)
    with pytest.raises(ValueError, match="unknown ditherer"):
        dither.dither_packed(packed(spark, pictures), palette, "nothing")


def test_window_resampling(spark):
    pictures = [random_image(k, 2 * w, 2 * h) for k, (w, h) in enumerate(SIZES)]
    small = arrays(model.pack_pixels(resample.downsample(model.explode_pixels(packed(spark, pictures)))))
    assert all((small[k] == slow_tent(p)).all() for k, p in enumerate(pictures))
    up = arrays(model.pack_pixels(resample.upsample(model.explode_pixels(packed(spark, pictures)), 4)))
    assert all((up[k] == p.repeat(4, 0).repeat(4, 1)).all() for k, p in enumerate(pictures))


def test_pack_checks(spark):
    with pytest.raises(Exception, match="whole"):
        model.pack_pixels(model.explode_pixels(packed(spark, [random_image(1, 3, 3)])).where("x + y > 0")).collect()
    with pytest.raises(Exception, match="need"):
        model.explode_pixels(spark.createDataFrame([(1, 2, 2, bytearray(3))], model.IMAGES)).collect()


def strip(colours, n=4096):
    rows = [*colours] * (n // len(colours) + 1)
    return np.concatenate([np.array(rows[:n], np.uint8), np.full((n, 1), 255, np.uint8)], 1)[None]


@pytest.mark.parametrize("colours", [[(12, 200, 3)], [(0, 0, 0), (255, 255, 255)], [(255, 0, 0), (0, 255, 0), (0, 0, 255)], [(9, 9, 9), (10, 10, 10), (200, 3, 50), (1, 2, 3), (77, 200, 18)]])
def test_few_colours_come_back(spark, colours):
    got = extract.extract_palette(model.explode_pixels(packed(spark, [strip(colours)])), 16)
    assert sorted(got) == sorted(colours)


def test_extraction_properties(spark):
    grey = np.stack([np.arange(256)] * 3 + [np.full(256, 255)], -1).astype(np.uint8)[None]
    pixels = model.explode_pixels(packed(spark, [grey]))
    assert [len(extract.extract_palette(pixels, k)) for k in (0, 1, 7, 512)] == [1, 1, 7, 256]
    picture = random_image(4, 60, 60)
    twice = np.concatenate([picture] * 8, 0)
    a, b = (extract.extract_palette(model.explode_pixels(packed(spark, [x])), 16) for x in (picture, twice))
    assert a == b and len(a) == 16
    assert extract.extract_palettes(pixels.limit(0), 5).count() == 0
    both = extract.extract_palettes(model.explode_pixels(packed(spark, [picture, grey])), 4).groupBy("image_id").count().collect()
    assert {r["count"] for r in both} == {4}


def test_equal_histograms_give_equal_palettes(spark):
    """Cells of 4 x 4 x 4 colours hold their corners in one image and edges in the other: equal means at the level chosen."""
    cells = np.stack(np.meshgrid(*[np.arange(0, 256, 32)] * 3), -1).reshape(-1, 3)
    one = strip(np.concatenate([cells, cells + 3]).tolist(), 2 * len(cells))
    two = strip(np.concatenate([cells + 1, cells + 2]).tolist(), 2 * len(cells))
    a, b = (extract.extract_palette(model.explode_pixels(packed(spark, [x])), 32, 512) for x in (one, two))
    assert a == b


def test_level_cap_is_inclusive(spark):
    pixels = model.explode_pixels(packed(spark, [strip([(0, 0, 0), (255, 255, 255), (0, 255, 0)], 3)]))
    assert histogram.histogram(pixels, 3).select("level").distinct().first().level == 8
    assert histogram.histogram(pixels, 2).select("level", "n").collect() == [(0, 3)]


def test_colour_round_trip(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([tuple(map(int, c)) for c in rng.integers(0, 256, (2000, 3))] + [(0, 0, 0), (255, 255, 255)], "r int, g int, b int")
    lab = colour.rgb_to_oklab(*(F.col(c) for c in "rgb"))
    back = colour.oklab_to_rgb(*lab)
    assert rows.where(~((back[0] == F.col("r")) & (back[1] == F.col("g")) & (back[2] == F.col("b")))).count() == 0
    white = rows.where("r = 255 and g = 255 and b = 255").select(*lab).first()
    assert abs(white[0] - 1) < 1e-6 and abs(white[1]) < 1e-6 and abs(white[2]) < 1e-6


@pytest.mark.parametrize("n", [1, 2, 3, 15, 16, 17, 100, 255, 256])
def test_indexed_png(n):
    palette = np.array(random_palette(n, n), np.uint8)
    for w, h in [(32, 32), (32, 16), (16, 32), (1, 1), (3, 2), (7, 5), (31, 1)]:
        index = (np.arange(w * h) % n).reshape(h, w)
        data = png.encode_indexed(index, palette)
        assert data[24] == (4 if n <= 16 else 8)
        assert (png.decode(data)[..., :3] == palette[index]).all()
    with pytest.raises(ValueError):
        png.encode_indexed(np.array([[n]]), palette)


def test_rgb_png_and_damage():
    for w, h in SIZES:
        p = random_image(w, w, h)
        assert (png.decode(png.encode_rgb(p))[..., :3] == p[..., :3]).all()
    data = png.encode_rgb(random_image(1, 9, 9))
    for bad in (b"", b"GIF89a", data[:40], data[:30] + b"\x07" + data[31:60]):
        with pytest.raises(ValueError):
            png.decode(bad)
    with pytest.raises(ValueError):
        png.encode_rgb(np.zeros((0, 4, 3), np.uint8))


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_filters(kind):
    """Rows filtered by the definition come back."""
    p = random_image(kind, 6, 5)[..., :3].reshape(5, 18).astype(int)
    rows = np.zeros((5, 19), np.uint8)
    for y in range(5):
        rows[y, 0] = kind
        for x in range(18):
            a, b, c = (p[y, x - 3] if x > 2 else 0), (p[y - 1, x] if y else 0), (p[y - 1, x - 3] if y and x > 2 else 0)
            paeth = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            rows[y, x + 1] = (p[y, x] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256
    assert (png._unfiltered(rows.reshape(-1), 5, 18, 3) == p).all()


def test_files(spark, tmp_path):
    pictures = [random_image(k, 8 + k, 6) for k in range(4)]
    for k, p in enumerate(pictures):
        (tmp_path / f"{k}.dat").write_bytes(png.encode_rgb(p))
    (tmp_path / "bad.png").write_bytes(png.SIGNATURE + b"rest")
    (tmp_path / "text.jpg").write_bytes(b"no image")
    told = {r.path.rsplit("/", 1)[-1]: r for r in images.scan_images(spark, str(tmp_path)).where("error is not null").collect()}
    assert sorted(told) == ["bad.png", "text.jpg"] and all(r.pixels is None and r.width is None for r in told.values())
    rows = images.read_images(spark, str(tmp_path)).collect()
    assert sorted((r.width, r.height) for r in rows) == [(8 + k, 6) for k in range(4)]
    by_width = {r.width: np.frombuffer(bytes(r.pixels), np.uint8).reshape(6, r.width, 4) for r in rows}
    assert all((by_width[8 + k][..., :3] == p[..., :3]).all() and (by_width[8 + k][..., 3] == 255).all() for k, p in enumerate(pictures))


def test_stream(spark, tmp_path):
    palette = random_palette(3, 6)
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.png").write_bytes(png.encode_rgb(random_image(k, 9, 7)))
    stream = read_image_stream(spark, str(tmp_path / "in"))
    apply_stream(stream, palette, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 3
    allowed = set(palette)
    assert all({tuple(c) for c in png.decode(bytes(r.png))[..., :3].reshape(-1, 3).tolist()} <= allowed for r in got)


def test_catalogue(spark):
    rows = kernels.ditherers(spark).orderBy("ord").collect()
    assert [r.name for r in rows] == NAMES and NAMES[1] == kernels.DEFAULT
    assert {r.name: sum(t.weight for t in r.taps) for r in rows} == {"none": 0, "fs": 16, "atkinson": 6, "jjn": 48, "burkes": 32, "sierra32": 32, "sierra4": 4}


@pytest.mark.parametrize("name", [k.name for k in kernels.KERNELS])
@pytest.mark.parametrize("rows", [1, 2, 3, 7])
def test_bands_carry_errors(name, rows):
    """Bands of any height give what a whole image gives, at all scales."""
    rng = np.random.default_rng(rows)
    palette = rng.integers(0, 256, (7, 3)).astype(np.int32)
    k = kernels.kernel(name)
    for width, height in ((1, 9), (5, 8), (13, 11), (2, 1)):
        images = rng.integers(0, 256, (2, height, width, 4)).astype(np.uint8)
        assert (dither.diffuse(images[..., :3], palette, k, rows=rows) == dither.diffuse(images[..., :3], palette, k)).all()
        for scale in (2, 4):
            large = images.repeat(scale, 1).repeat(scale, 2)
            index = dither.diffuse(large[..., :3], palette, k, clamp_once=True)
            want = np.concatenate([palette[index], large[..., 3:]], -1)
            for _ in range(scale // 2):
                want = resample.tent(want)
            worker = dither.Multisampler(dither.Remembered(palette), palette, k, scale, rows=rows * scale, at_once=rows)
            assert (np.concatenate(list(worker.feed(images, True)), 1) == want).all()
            worker = dither.Multisampler(dither.Remembered(palette), palette, k, scale, rows=rows * scale, at_once=rows)
            fed = [x for top in range(height) for x in worker.feed(images[:, top : top + 1], top + 1 == height)]
            assert (np.concatenate(fed, 1) == want).all()


def test_multisampling_holds_bands():
    """An image four times as tall takes no more memory beyond its own pixels."""
    palette, peaks = np.array([(0, 0, 0), (200, 30, 60), (255, 255, 255)], np.int32), []
    search = dither.Remembered(palette)
    for height in (300, 1200):
        images = np.random.default_rng(1).integers(0, 256, (1, height, 400, 4)).astype(np.uint8)
        tracemalloc.start()
        dither.multisample(images, palette, kernels.kernel("fs"), 4, search=search, rows=64)
        peaks.append(tracemalloc.get_traced_memory()[1] - images.nbytes)
        tracemalloc.stop()
    assert max(peaks) < 1.2 * min(peaks) < 16 * 400 * 300 * 4


@pytest.mark.parametrize("scale", [1, 2])
def test_streamed_rows(spark, monkeypatch, scale):
    """Exploded images are dithered as whole ones are, whichever bands a task holds; small ones of one size go together."""
    pictures = [random_image(k, w, h) for k, (w, h) in enumerate([(3, 40), (16, 5), (16, 5), (1, 70), (50, 1), (9, 9), (9, 9), (200, 3)])]
    images = packed(spark, pictures)
    palette = [(0, 0, 0), (250, 10, 60), (20, 200, 90), (255, 255, 255)]
    want = {r.image_id: bytes(r.pixels) for r in dither.dither_packed(images, palette, "jjn", scale=scale).collect()}
    run = dither.image_rows
    for most in (1, 20, 1000):
        monkeypatch.setattr(dither, "image_rows", lambda batches, most=most: run(batches, most))
        assert run_stream(pictures, palette, scale) == want
    monkeypatch.setattr(dither, "image_rows", run)
    got = {r.image_id: bytes(r.pixels) for r in model.pack_pixels(dither.dither(model.explode_pixels(images).repartition(5), palette, "jjn", scale=scale)).collect()}
    assert got == want
    with pytest.raises(Exception, match="whole grid"):
        dither.dither(model.explode_pixels(images).where("not (image_id = 5 and x = 4 and y = 3)"), palette).collect()


def run_stream(pictures, palette, scale):
    """The streamed form over record batches of 33 pixels, in this process."""
    table = np.array(palette, np.int32)
    rows = [(k, y, x, *map(int, p[y, x])) for k, p in enumerate(pictures) for y in range(p.shape[0]) for x in range(p.shape[1])]
    columns = list(zip(*rows, strict=True))
    whole = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[1:])], names=["image_id", "y", "x", "r", "g", "b", "a"])
    out = {}
    for batch in dither.streamed((whole.slice(k, 33) for k in range(0, len(rows), 33)), table, kernels.kernel("jjn"), scale, False):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out.setdefault(row[0], []).append(row[1:])
    return {k: np.array([r[2:] for r in sorted(v)], np.uint8).tobytes() for k, v in out.items()}


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_levels_of_sorted_keys(spark, parts):
    """Cells of all levels, however the sorted colours are cut into ranges."""
    rng = np.random.default_rng(parts)
    pictures = [np.full((4, 4, 4), 7, np.uint8), random_image(2, 40, 30), (random_image(3, 30, 30) // 64), random_image(4, 1, 1), rng.integers(100, 104, (20, 20, 4)).astype(np.uint8)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        counts = histogram.colour_counts(model.explode_pixels(packed(spark, pictures)))
        got = {(r.image_id, r.level): r.n_cells for r in histogram.level_counts(counts.repartition(parts)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == {(i, k): len({tuple(c) for c in (p[..., :3].reshape(-1, 3) >> (8 - k)).tolist()}) for i, p in enumerate(pictures) for k in range(9)}
    assert histogram.level_counts(counts.limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 2, 5, 23])
def test_rounds_split_as_whole_images(spark, k):
    """Splitting many images in rounds gives each the clusters, and their order, of splitting it whole."""
    rng = np.random.default_rng(k)
    sizes = [1, 2, 3, 40, 300, 60]
    clouds = [np.column_stack([np.sort(rng.random(n)), rng.normal(0, 0.1, (n, 2)) * rng.random() + rng.integers(0, 3, (n, 2)) * 0.2, rng.integers(1, 50, n)]) for n in sizes]
    clouds.append(np.column_stack([np.full((5, 3), 0.25), np.ones(5)]))
    rows = [(i, b, *map(float, c)) for i, cloud in enumerate(clouds) for b, c in enumerate(cloud)]
    bins = spark.createDataFrame(rows, "image_id long, bin long, l double, a double, b double, w double").repartition(3)
    got = {}
    for r in extract.split_rounds(bins, k).collect():
        got.setdefault(r.image_id, {})[r.idx] = (r.l, r.a, r.b)
    for i, cloud in enumerate(clouds):
        want = extract.split_whole(cloud[:, :3], cloud[:, 3], k)
        assert sorted(got[i]) == list(range(len(want))) and np.allclose([got[i][j] for j in range(len(want))], want, atol=1e-9), i


@pytest.mark.parametrize("scale", [2, 4])
@pytest.mark.parametrize("rows", [1, 2, 5, 64])
def test_bands_with_edge_rows(spark, scale, rows):
    """Bands of any height give what the tents give on whole images."""
    pictures = [random_image(k, w * scale, h * scale) for k, (w, h) in enumerate([(1, 1), (3, 1), (2, 7), (4, 10), (1, 13)])]
    got = arrays(model.pack_pixels(resample.downsample(model.explode_pixels(packed(spark, pictures)), scale=scale, rows=rows)))
    assert len(got) == len(pictures)
    for k, picture in enumerate(pictures):
        want = picture[None]
        for _ in range(scale // 2):
            want = resample.tent(want)
        assert (got[k] == want[0]).all()
    with pytest.raises(Exception, match="whole grid"):
        resample.downsample(model.explode_pixels(packed(spark, [random_image(1, 6, 4)])).where("x != 3 or y != 2"), scale=2).collect()


def test_nearest_many(spark):
    """Thousands of colours, some equal, some far away in one corner: the index and ties are those of comparing all."""
    rng = np.random.default_rng(6)
    palette = np.concatenate([rng.integers(0, 256, (1500, 3)), rng.integers(250, 256, (300, 3)), rng.integers(0, 256, (5, 3)).repeat(3, 0)])
    colours = np.concatenate([rng.integers(0, 256, (3000, 3)), palette[::50], [[0, 0, 0], [255, 255, 255]]])
    pixels = spark.createDataFrame([(k, *map(int, c)) for k, c in enumerate(colours)], "k long, r int, g int, b int").repartition(3)
    rows = nearest.nearest_many(pixels, spark.createDataFrame([(k, *map(int, c)) for k, c in enumerate(palette)], "idx int, r int, g int, b int")).collect()
    distance = ((colours[:, None] - palette[None]) ** 2).sum(2)
    assert {r.k: r.idx for r in rows} == dict(enumerate(distance.argmin(1).tolist()))
    assert max(r.n_candidates for r in rows) < 400
    with pytest.raises(ValueError, match="1 to 10"):
        nearest.nearest_many(pixels, spark.range(11).selectExpr("cast(id as int) idx", "cast(id as int) r", "0 g", "0 b"), most=10)


@pytest.mark.parametrize("bits", [3, 4])
def test_nearest_many_of_70000(spark, bits):
    """More colours than two bytes can number, and a single one: indices and candidates are those of comparing all."""
    rng = np.random.default_rng(bits)
    key = rng.permutation(1 << 24)[:70_000]
    for palette in (np.stack([key >> 16, key >> 8 & 255, key & 255], 1), np.array([[9, 250, 3]])):
        table = spark.createDataFrame(pa.table({"idx": pa.array(np.arange(len(palette)), pa.int32())} | {c: pa.array(palette[:, k], pa.int32()) for k, c in enumerate("rgb")}).to_pandas())
        colours = rng.integers(0, 256, (40, 3))
        pixels = spark.createDataFrame([(k, *map(int, c)) for k, c in enumerate(colours)], "k long, r int, g int, b int")
        side = 256 >> bits
        low = colours // side * side
        want = {}
        for k, c in enumerate(colours):
            least = (np.maximum(np.maximum(low[k] - palette, palette - low[k] - side + 1), 0) ** 2).sum(1)
            most = (np.maximum(np.abs(palette - low[k]), np.abs(palette - low[k] - side + 1)) ** 2).sum(1)
            want[k] = (int(((palette - c) ** 2).sum(1).argmin()), int((least <= most.min()).sum()))
        assert {r.k: (r.idx, r.n_candidates) for r in nearest.nearest_many(pixels, table, bits=bits).collect()} == want


@pytest.mark.parametrize("scale", [2, 4])
def test_undithered_multisampling_moves_pixels_once(spark, small, scale):
    """The enlarged image is never rows: none is exploded before the shuffle, and the result is that of enlarging."""
    from huewright.plans import queries

    found = queries.QUERIES[f"multisample_{scale}x_none"](spark, small)
    assert "Generate" not in found._jdf.queryExecution().toString()
    large = resample.upsample(nearest.recolour(queries.event_pixels(spark, small), queries.nation_palette(spark, small)), scale)
    want = resample.downsample(large, scale=scale).select(found.columns)
    assert found.exceptAll(want).count() == want.exceptAll(found).count() == 0


@pytest.mark.parametrize("rows", [7, 9, 64])
def test_ssim(spark, rows):
    rng = np.random.default_rng(rows)
    pairs, want = [], {}
    for k, (h, w) in enumerate([(8, 8), (23, 11), (7, 30), (40, 8), (16, 16)]):
        a = rng.integers(0, 256, (h, w))
        b = a if k == 4 else np.clip(a + rng.integers(-40, 41, (h, w)), 0, 255)
        pairs += [(k, y, x, int(a[y, x]), int(b[y, x])) for y in range(h) for x in range(w)]
        found = []
        for y in range(h - 7):
            for x in range(w - 7):
                p, q = (v[y : y + 8, x : x + 8].astype(float) for v in (a, b))
                cov = ((p - p.mean()) * (q - q.mean())).mean()
                found.append((2 * p.mean() * q.mean() + similarity.C1) * (2 * cov + similarity.C2) / ((p.mean() ** 2 + q.mean() ** 2 + similarity.C1) * (p.var() + q.var() + similarity.C2)))
        if found:
            want[k] = (len(found), pytest.approx(np.mean(found), abs=1e-9))
    got = similarity.ssim(spark.createDataFrame(pairs, "image_id long, y int, x int, a int, b int").repartition(3), rows=rows).collect()
    assert {r.image_id: (r.n_windows, r.ssim) for r in got} == want and want[4][1] == 1


def test_png_of_16_bits():
    """Samples go to the nearest of 8 bits; the transparent colour is compared in full."""
    rng = np.random.default_rng(3)
    chunk = lambda kind, body: len(body).to_bytes(4) + kind + body + b"\0\0\0\0"
    for colour, samples in ((0, 1), (2, 3), (4, 2), (6, 4)):
        values = rng.integers(0, 65536, (5, 7, samples))
        values[0, 0], values[0, 1] = 0x1234, 0x1235
        rows = b"".join(b"\0" + r.astype(">u2").tobytes() for r in values)
        key = chunk(b"tRNS", b"\x12\x34" * samples) if colour in (0, 2) else b""
        data = png.SIGNATURE + chunk(b"IHDR", (7).to_bytes(4) + (5).to_bytes(4) + bytes([16, colour, 0, 0, 0])) + key + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
        got = png.decode(data)
        eight = np.rint(values / 257).astype(np.uint8)
        assert (got[..., :3] == eight[..., : 3 if samples > 2 else 1]).all()
        alpha = eight[..., -1] if colour in (4, 6) else np.where((values == 0x1234).all(-1), 0, 255)
        assert (got[..., 3] == alpha).all()
