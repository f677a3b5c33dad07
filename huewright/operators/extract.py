"""Palettes from images: histogram bins split along their principal axes in OKLab.

The cluster of the largest eigenvalue of its scatter is split by the sign of its bins' projections, until there are k clusters or none has any
spread. Images of WHOLE bins at most are split whole, each in one task. Larger ones are split all at once, in rounds: grouped sums give each new cluster's scatter, a closed form its largest eigenpair, and the bins of the clusters to be split move on to
one of two new ones. Their bins never come together in a task.

A part's scatter is never larger than the whole's, so the k - 1 clusters that are split in the end are those of the k - 1 largest eigenvalues of all. A round splits all of these that
aren't split yet; there are about as many rounds as the splits are deep. The order of the splits then numbers the colours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour
from ..model import MAX_COLOURS, Colours
from ..storage import written
from .histogram import THRESHOLD, histogram, oklab_bins

AXES = ("l", "a", "b")
#: Splits of a round that are sent to all tasks; more are joined (a key is one cluster, `threshold` bins at most).
SENT = 200_000
#: Bins that an image has at most where one task splits it.
WHOLE = 4096


def with_eigenpairs(rows: DataFrame) -> DataFrame:
    """rows with value and v0, v1, v2: the largest eigenvalue of the symmetric matrix in the columns ll, la, lb, aa, ab, bb, and its axis, whose largest component is positive (not normalised).

    Each step is a column, so that no expression is worked out, or planned, more than once.
    """
    at = [["ll", "la", "lb"], ["la", "aa", "ab"], ["lb", "ab", "bb"]]
    rows = rows.withColumn("q", F.expr("(ll + aa + bb) / 3"))
    rows = rows.withColumns({"dl": F.expr("ll - q"), "da": F.expr("aa - q"), "db": F.expr("bb - q")})
    rows = rows.withColumns({"p": F.expr("sqrt((dl * dl + da * da + db * db + 2 * (la * la + lb * lb + ab * ab)) / 6)"), "det": F.expr("dl * (da * db - ab * ab) - la * (la * db - ab * lb) + lb * (la * ab - da * lb)")})
    rows = rows.withColumn("value", F.expr("q + 2 * p * cos(acos(greatest(-1d, least(1d, if(p > 0, det / (2 * p * p * p), 1d)))) / 3)"))
    rows = rows.withColumns({f"d{i}": F.col(at[i][i]) - F.col("value") for i in range(3)})
    cell = lambda i, j: f"d{i}" if i == j else at[i][j]
    # The axis is normal to the rows of the matrix less the eigenvalue: the longest cross product of two of them.
    crosses = {f"c{i}{j}{k}": F.expr(f"{cell(i, (k + 1) % 3)} * {cell(j, (k + 2) % 3)} - {cell(i, (k + 2) % 3)} * {cell(j, (k + 1) % 3)}") for i, j in ((0, 1), (0, 2), (1, 2)) for k in range(3)}
    rows = rows.withColumns(crosses)
    longest = F.greatest(*(F.struct(F.expr(" + ".join(f"c{i}{j}{k} * c{i}{j}{k}" for k in range(3))).alias("n"), *(F.col(f"c{i}{j}{k}").alias(f"v{k}") for k in range(3))) for i, j in ((0, 1), (0, 2), (1, 2))))
    rows = rows.withColumn("best", longest)
    rows = rows.withColumn("sign", F.expr("if(greatest(best.v0, best.v1, best.v2) >= -least(best.v0, best.v1, best.v2), 1d, -1d)"))
    return rows.withColumns({f"v{k}": F.expr(f"best.v{k} * sign") for k in range(3)})


def _clusters(bins: DataFrame) -> DataFrame:
    """(image_id, node, n, w, l, a, b, value, v0, v1, v2) of each node's bins: number, weight, means, largest eigenvalue of the scatter (0 without spread) and its axis."""
    # Lightness is taken about a half, which keeps the sums small.
    x = {"l": F.col("l") - 0.5, "a": F.col("a"), "b": F.col("b")}
    pairs = [i + j for k, i in enumerate(AXES) for j in AXES[k:]]
    sums = bins.groupBy("image_id", "node").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), *(F.sum(F.col("w") * x[c]).alias(f"s{c}") for c in AXES), *(F.sum(F.col("w") * x[p[0]] * x[p[1]]).alias(p) for p in pairs))
    scatter = {p: F.col(p) - F.col(f"s{p[0]}") * F.col(f"s{p[1]}") / F.col("w") for p in pairs}
    rows = sums.select("image_id", "node", "n", "w", *((F.col(f"s{c}") / F.col("w") + (0.5 if c == "l" else 0.0)).alias(c) for c in AXES), *(scatter[p].alias(p) for p in pairs))
    spread = F.when((F.col("n") > 1) & (F.col("value") > 1e-14 * F.col("w")), F.col("value")).otherwise(0.0)
    return with_eigenpairs(rows).select("image_id", "node", "n", "w", *AXES, spread.alias("value"), "v0", "v1", "v2")


def _numbered(nodes: DataFrame, k: int) -> DataFrame:
    """(image_id, idx, l, a, b): the clusters after the k - 1 splits of the largest eigenvalues, numbered as they came to be. A group is an image's clusters, a few times k."""

    def run(table: pa.Table) -> pa.Table:
        rows = {r["node"]: r for r in table.to_pylist()}
        clusters = ["1"]
        while len(clusters) < k:
            c = max(range(len(clusters)), key=lambda i: (rows[clusters[i]]["value"] if clusters[i] + "0" in rows else 0.0, -i))
            node = clusters[c]
            if rows[node]["value"] <= 0 or node + "0" not in rows:
                break
            clusters[c] = node + "0"
            clusters.append(node + "1")
        found = [rows[n] for n in clusters]
        return pa.table({"image_id": pa.array([r["image_id"] for r in found], pa.int64()), "idx": pa.array(range(len(found)), pa.int32()), **{c: pa.array([r[c] for r in found], pa.float64()) for c in AXES}})

    return nodes.select("image_id", "node", "value", *AXES).groupBy("image_id").applyInArrow(run, "image_id long, idx int, l double, a double, b double")


def _spread(lab: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Largest eigenvalue of the scatter, its axis (largest component positive) and the weighted mean."""
    total = w.sum()
    mean = (w[:, None] * lab).sum(0) / total if total else np.zeros(3)
    d = lab - mean
    values, vectors = np.linalg.eigh((w[:, None] * d).T @ d)
    axis = vectors[:, -1]
    axis = axis if axis[np.argmax(np.abs(axis))] > 0 else -axis
    value = float(values[-1])
    return (value if len(lab) > 1 and value > 1e-14 * total else 0.0), axis, mean


def split_whole(lab: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """OKLab means of up to k clusters of one image's bins, in the order in which the clusters came to be."""
    if not len(lab):
        return np.zeros((0, 3))
    clusters = [np.arange(len(lab))]
    spreads = [_spread(lab, w)]
    while len(clusters) < k:
        c = max(range(len(clusters)), key=lambda i: (spreads[i][0], -i))
        value, axis, mean = spreads[c]
        if value <= 0:
            break
        members = clusters[c]
        left = (lab[members] - mean) @ axis < 0
        if left.all() or not left.any():
            spreads[c] = (0.0, axis, mean)
            continue
        clusters[c] = members[left]
        clusters.append(members[~left])
        spreads[c] = _spread(lab[clusters[c]], w[clusters[c]])
        spreads.append(_spread(lab[clusters[-1]], w[clusters[-1]]))
    return np.stack([s[2] for s in spreads])


def split(bins: DataFrame, k: int) -> DataFrame:
    """(image_id, idx, l, a, b): OKLab means of up to k clusters (1 to 256) of each image's bins (image_id, bin, l, a, b, w), numbered as they came to be."""
    k = min(max(k, 1), MAX_COLOURS)
    bins = written(bins.select("image_id", "bin", *AXES, "w"))
    large = written(bins.groupBy("image_id").agg(F.count(F.lit(1)).alias("bins")).where(F.col("bins") > WHOLE).select("image_id"))
    total = large.count()
    some = F.broadcast(large) if total <= SENT else large

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bin")
        means = split_whole(np.stack([table[c].to_numpy() for c in AXES], 1), table["w"].to_numpy(), k)
        return pa.table({"image_id": pa.array([table["image_id"][0].as_py()] * len(means), pa.int64()), "idx": pa.array(np.arange(len(means)), pa.int32()), **{c: means[:, i] for i, c in enumerate(AXES)}})

    small = bins.join(some, "image_id", "left_anti") if total else bins
    found = small.groupBy("image_id").applyInArrow(run, "image_id long, idx int, l double, a double, b double")
    return found.union(split_rounds(bins.join(some, "image_id", "left_semi"), k)) if total else found


def split_rounds(bins: DataFrame, k: int) -> DataFrame:
    """split() of all images together, in rounds."""
    above = F.expr("substring(node, 1, length(node) - 1)")
    bins = written(bins.select("image_id", *AXES, "w", F.lit("1").alias("node")))
    nodes = written(_clusters(bins))
    while True:
        # Leaves among the k - 1 largest eigenvalues; of equal ones the earlier node's.
        ranked = nodes.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("value"), "node"))).where(f"rank < {k} and value > 0")
        leaves = ranked.join(nodes.select("image_id", above.alias("node")).distinct(), ["image_id", "node"], "left_anti")
        chosen = written(leaves.select("image_id", "node", *(F.col(c).alias(f"m{c}") for c in AXES), "v0", "v1", "v2"))
        total = chosen.count()
        if not total:
            return _numbered(nodes, k)
        side = sum(((F.col(c) - F.col(f"m{c}")) * F.col(f"v{i}") for i, c in enumerate(AXES)), F.lit(0.0)) < 0
        moved = bins.join(F.broadcast(chosen) if total <= SENT else chosen, ["image_id", "node"], "left")
        split_now = F.col("v0").isNotNull()
        bins = written(moved.select("image_id", *AXES, "w", F.when(split_now, F.concat("node", F.when(side, "0").otherwise("1"))).otherwise(F.col("node")).alias("node"), split_now.alias("new")))
        new = _clusters(bins.where("new")).withColumn("parts", F.count(F.lit(1)).over(Window.partitionBy("image_id", above)))
        new = written(new)
        # A split that left all bins on one side is none: its node counts as without spread.
        failed = new.where("parts = 1").select("image_id", above.alias("node"), F.lit(True).alias("failed"))
        value = F.when(F.col("failed"), 0.0).otherwise(F.col("value")).alias("value")
        old = nodes.join(failed, ["image_id", "node"], "left").select(*(value if c == "value" else c for c in nodes.columns))
        nodes = written(old.union(new.where("parts > 1").select(*nodes.columns)))


def extract_palettes(pixels: DataFrame, k: int = 16, threshold: int = THRESHOLD) -> DataFrame:
    """(image_id, idx, r, g, b): up to k colours (1 to 256) of each image. Alpha is ignored; an image without pixels has no rows."""
    means = split(oklab_bins(histogram(pixels, threshold)), k)
    rgb = colour.oklab_to_rgb(F.col("l"), F.col("a"), F.col("b"))
    return means.select("image_id", "idx", *(x.alias(c) for x, c in zip(rgb, "rgb", strict=True)))


def extract_palette(pixels: DataFrame, k: int = 16, threshold: int = THRESHOLD) -> Colours:
    """The palette of all pixels together, as a list of at most 256 colours."""
    rows = extract_palettes(pixels.withColumn("image_id", F.lit(0).cast("long")), k, threshold)
    return [(r.r, r.g, r.b) for r in sorted(rows.collect(), key=lambda r: r.idx)]
