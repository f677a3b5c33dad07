"""How filters interact: what each one removes in every order in which they can be applied.

A document's failures of the five filters are a mask of five bits; all that any order removes depends only on how many documents of a part have each
mask. So the texts are read once and counted to at most 32 cells a part, and the 120 orders are visited by single swaps of neighbours: a swap of the
filters at steps i and i + 1 changes these two steps alone, whose counts are made anew from the cells. Shapley sums (a filter's removals
over all orders) accumulate along the walk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, raw_texts, slices, written

#: A: too few words; B: too few different words; C: too many capitals; D: markup characters; E: a copy of a document of smaller id.
FILTERS = "ABCDE"
_CAPITALS, _MARKUP = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: What is counted for each mask.
MEASURES = ("n", "good", "toxic")


def text_mask(raw: bytes | None, *, min_words: int = 200, distinct_percent: int = 50, capital_percent: int = 2) -> int:
    """The bits (A is 1, B is 2, C is 4, D is 8) of the filters that a text alone fails; a null text counts as an empty one."""
    raw = raw or b""
    words = raw.split()
    points = len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    few, alike = len(words) < min_words, 100 * len(set(words)) < distinct_percent * len(words)
    return few | alike << 1 | (100 * capitals > capital_percent * points) << 2 | (len(raw.translate(None, _MARKUP)) < len(raw)) << 3


def swaps(n: int) -> Iterator[int]:
    """Places i whose swaps with i + 1, one after the other, lead through all orders of n things (each thing runs through the order of those before it)."""
    if n < 2:
        return
    down = True
    for inner in (*swaps(n - 1), None):
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if inner is not None:
            # The last thing stands at the left end after a run to the left, so the others are one place further right.
            yield inner + down
        down = not down


def _step(cells: np.ndarray, before: int, f: int) -> np.ndarray:
    """Sums of the cells (..., masks) that fail filter f and none of the filters in the mask `before`."""
    masks = np.arange(cells.shape[-1])
    return cells[..., (masks >> f & 1 == 1) & (masks & before == 0)].sum(-1)


def walk(cells: np.ndarray, names: str = FILTERS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(orders, removed, shapley) for cells (measure, part, mask): removed is (order, step, measure, part), shapley (filter, part)."""
    n = len(names)
    order = list(range(n))
    now = np.stack([_step(cells, sum(1 << g for g in order[:k]), f) for k, f in enumerate(order)])
    shapley = np.zeros((n, cells.shape[1]), np.int64)
    orders, removed = [], []
    for i in (*swaps(n), None):
        orders.append("".join(names[f] for f in order))
        removed.append(now.copy())
        for k, f in enumerate(order):
            shapley[f] += now[k, 0]
        if i is not None:
            before = sum(1 << g for g in order[:i])
            order[i], order[i + 1] = order[i + 1], order[i]
            now[i] = _step(cells, before, order[i])
            now[i + 1] = _step(cells, before | 1 << order[i], order[i + 1])
    return orders, np.stack(removed), shapley


def masks(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """(doc_id, part, mask, rows): the rows of docs by id, part and mask of failures, each with the number of rows that it stands for.

    Texts are told apart by their SHA-256. E holds where a row of smaller id, in any part, has the same text; rows without id neither fail it nor make others fail.
    """
    ident = docs.schema[id_column].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        raws = raw_texts(batch, "text")
        return {"doc_id": batch.column(0), "part": batch.column(1), "mask": [text_mask(x) for x in raws], "digest": [hashlib.sha256(x or b"").digest() for x in raws]}

    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), F.col(text_column).cast("string").alias("text"))
    slim = written(map_rows(rows, run, f"doc_id {ident}, part string, mask int, digest binary", 1000))
    firsts = slim.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    # The key of the join is a text with an id, so a text that a third of all rows hold is no hot key; repeated rows are counted before.
    each = slim.groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("rows"))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return each.join(firsts, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"), "rows")


def cells(masked: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", quality_column: str = "quality", toxic_column: str = "toxic") -> DataFrame:
    """(part, cells): for each part its masks with the numbers of rows, of rows labelled good and of rows labelled toxic; 32 entries a part at most.

    An id is good (toxic) if any of its labels says 1.
    """
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    marks = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("doc_id")).agg(one(quality_column).alias("good"), one(toxic_column).alias("toxic")).where("good + toxic > 0")
    masked = written(masked)
    zero = F.lit(0).cast("long")
    plain = masked.groupBy("part", "mask").agg(F.sum("rows").alias("n"), zero.alias("good"), zero.alias("toxic"))
    marked = masked.where("doc_id is not null").join(marks, "doc_id").groupBy("part", "mask").agg(zero.alias("n"), F.sum(F.col("rows") * F.col("good")).alias("good"), F.sum(F.col("rows") * F.col("toxic")).alias("toxic"))
    counted = plain.union(marked).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in MEASURES))
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))


def orders(counted: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row for each part, order and step, from (part, cells): what the step's filter keeps, removes, would have removed, and its Shapley sum."""
    n = len(names)
    places = {f: k for k, f in enumerate(names)}

    def run(batch: pa.RecordBatch) -> dict:
        table = np.zeros((len(MEASURES), batch.num_rows, 1 << n), np.int64)
        for p, entries in enumerate(batch.column(1).to_pylist()):
            for e in entries:
                table[:, p, e["mask"]] += [e[c] for c in MEASURES]
        names_, removed, shapley = walk(table, names)
        total = table[0].sum(-1)  # (part)
        gone = removed[:, :, 0]  # (order, step, part)
        of = np.array([[places[f] for f in o] for o in names_])
        failing = np.stack([_step(table[0], 0, f) for f in range(n)])  # (filter, part)
        alone = np.stack([table[0][:, 1 << f] for f in range(n)])
        shape = gone.shape
        spread = lambda x: x.transpose(2, 0, 1).ravel()  # noqa: E731  (part, order, step)
        return {
            "part": batch.column(0).take(pa.array(np.repeat(np.arange(shape[2]), shape[0] * shape[1]))),
            "filter_order": np.tile(np.repeat(names_, n), shape[2]),
            "step": np.tile(np.arange(1, n + 1, dtype=np.int32), shape[0] * shape[2]),
            "kept": spread(total - gone.cumsum(1)),
            "removed": spread(gone),
            "redundant": spread(failing[of] - gone),
            "unique_fails": spread(alone[of]),
            "good_lost": spread(removed[:, :, 1]),
            "toxic_lost": spread(removed[:, :, 2]),
            "shapley": spread(shapley[of]),
        }

    counts = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return map_rows(counted.select("part", "cells"), run, f"part string, filter_order string, step int, {counts}", 100)


def audit(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """One row for each part of docs, order of the five filters and step: part, filter_order, step (1 to 5; its filter is that letter of the order),
    kept (rows left after it), removed (by it), redundant (that fail its filter, but went before), unique_fails (that fail no other filter), good_lost and
    toxic_lost (removed rows labelled so) and shapley (rows that its filter removes, summed over all 120 orders).

    Null parts and empty ones are one part; null texts count as empty ones, and very long texts are read whole, one at a time. Repeated rows count as often as they stand and
    aren't copies of each other; rows without id are counted, but have no labels. An empty table gives no rows; labels without rows count nowhere; other columns are not read.
    """
    return orders(cells(masks(docs, id_column=id_column, text_column=text_column, part_column=part_column), labels, id_column=id_column))
