"""Mixing sources to target weights by systematic sampling.

Every source has a target number of words; a document's expected number of copies is its source's target over its source's size.
The expected copies are summed along the source's documents, one random offset (from the seed and the source's name) is added, and a
document is emitted once for each integer that the running sum crosses. Documents are taken in the order of a size class, then doc_id, so the taken words of a
source stay near its target.

The running sum needs a document's rank in its source. Word counts are written once and dealt by ranges of (source, size class, id, size, text digest), as a
parallel sort deals them: a range is a block, whatever the ids are. The blocks' counts are summed along the source, and ranks inside a block come from
a window over that block alone. So no task sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, unused, written

#: Rows in a block, about: bounds the rows that one window holds.
BLOCK = 1 << 18


def words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), ceiling: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sources by code point, null last, have the weights in turn and share the words of all. A target stops at ceiling times its source's size and the
    excess is shared again by weight, until none is above. That ends where target = min(ceiling * size, level * weight) for one level, which
    the sources sorted by ceiling * size / weight give directly: the first of them are held at their ceilings, the others share the rest.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source, not each document
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    rows = sizes.withColumn("weight", weight).withColumn("most", ceiling * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    by_level = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    rows = (
        rows.withColumn("held", F.coalesce(F.sum("most").over(by_level), F.lit(0.0)))
        .withColumn("free", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0)))
        .withColumn("nth", F.row_number().over(by_ratio))
        .withColumn("level", (F.sum("source_size").over(everything) - F.col("held")) / F.col("free"))
    )
    # The first source in this order that its level doesn't take above its ceiling sets the level of all after it.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("nth", "level"))).over(everything)["level"]
    return rows.withColumn("final", level).select("source", "source_size", F.when(F.col("final").isNull(), F.col("most")).otherwise(F.least("most", F.col("final") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = (5, 2, 1), ceiling: float = 3.0, seed: str = "mix", block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copies, taken (copies * size).

    Null texts have size 0; a null source is a source of its own, sorted last; null ids sort first. A source of size 0 has target 0 and no
    copies. Rows with equal ids are ranked by size, then by a digest of the text, and equal rows are interchangeable, so reruns agree. An empty table gives none.
    """
    return _mix(docs, id_column, text_column, source_column, weights, ceiling, seed, block).drop("digest")


def _mix(docs: DataFrame, id_column: str, text_column: str, source_column: str, weights: tuple[int, ...], ceiling: float, seed: str, block: int) -> DataFrame:
    """mix() with the digest of each text."""
    text = F.col(text_column).cast("string")
    rows = written(docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), words(text).alias("size"), F.xxhash64(text).alias("digest")))
    order = [F.floor(F.sqrt("size")), F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("digest")]
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // block + 1)
    dealt = written(rows.repartitionByRange(n, F.col("source"), *order).withColumn("block", F.spark_partition_id()))
    keys = ["source", "block"]
    blocks = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    targets = source_targets(blocks.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, ceiling=ceiling)
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select(*keys, "before")
    ranked = dealt.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).alias("r")
    same = lambda a, b, names: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names]
    joined = ranked.join(starts.alias("s"), same("r", "s", keys)).join(targets.alias("t"), same("r", "t", ["source"]))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("r.source"), F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    expected = F.when(F.col("t.source_size") > 0, F.col("t.target") / F.col("t.source_size")).otherwise(0.0)
    rank = F.col("s.before") + F.col("r.at")
    crossed = (F.floor(expected * rank + offset) - F.floor(expected * (rank - 1) + offset)).cast("long")
    return joined.select("r.doc_id", "r.source", "r.size", "t.source_size", "t.target", crossed.alias("copies"), "r.digest").withColumn("taken", F.col("copies") * F.col("size"))


def emit(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = (5, 2, 1), ceiling: float = 3.0, seed: str = "mix", block: int = BLOCK, broadcast_limit: int = 500_000) -> DataFrame:
    """The mix itself: each row of docs, all columns, as often as mix() takes it.

    Rows are found by id, source and a digest of the text. Rows equal in these share their copies evenly; ids may be null or repeated. The
    numbers of copies are sent to the tasks where they are no more than broadcast_limit rows, else the rows are joined to them. An empty table gives none.
    """
    names = docs.columns
    i, o, d, k, c, nth = (unused(docs, x) for x in ("id", "source", "digest", "rows", "copies", "nth"))
    mixed = _mix(docs, id_column, text_column, source_column, weights, ceiling, seed, block)
    shares = written(mixed.groupBy(F.col("doc_id").alias(i), F.col("source").alias(o), F.col("digest").alias(d)).agg(F.count(F.lit(1)).alias(k), F.sum("copies").alias(c)).where(F.col(c) > 0))
    same = F.col(id_column).eqNullSafe(F.col(i)) & F.col(source_column).eqNullSafe(F.col(o)) & (F.xxhash64(F.col(text_column).cast("string")) == F.col(d))
    some = docs.join(few(shares, broadcast_limit), same)
    alone = some.where(F.col(k) == 1).withColumn(nth, F.lit(1))
    # Only rows that are repeated need numbers of their own.
    again = some.where(F.col(k) > 1).withColumn(nth, F.row_number().over(Window.partitionBy(i, o, d).orderBy(d)))
    share = (F.floor(F.col(nth) * F.col(c) / F.col(k)) - F.floor((F.col(nth) - 1) * F.col(c) / F.col(k))).cast("int")
    return alone.unionByName(again).withColumn(nth, F.explode(F.array_repeat(F.lit(1), share))).select(*names)
