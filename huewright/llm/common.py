"""Helpers that the corpus operators share: word tables, Arrow access, offsets and written tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import shared_folder as shared_folder
from ..storage import written as written

# ASCII white space, and the bytes that are no part of an alphanumeric word.
SPACES = b"\t\n\x0b\x0c\r "
_OTHER = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"

LOWER = bytes.maketrans(_UPPER, _LOWER)
ALNUM = bytes.maketrans(_UPPER + _OTHER, _LOWER + b" " * len(_OTHER))


def space_words(raw: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a UTF-8 text; a null text has none."""
    return raw.split() if raw else []


def alnum_words(raw: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case."""
    return raw.translate(ALNUM).split() if raw else []


def raw_texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def code_points(raw: bytes, offsets: Iterable[int]) -> dict[int, int]:
    """Code point offset of each byte offset (any order); the text is decoded once, piece by piece."""
    found, at, seen = {}, 0, 0
    for offset in sorted(set(offsets)):
        seen += len(raw[at:offset].decode("utf-8", "replace"))
        found[offset] = seen
        at = offset
    return found


def union_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint union of half-open spans; touching spans are merged."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows, so that a task holds few texts as Python objects at a time; memory that Arrow keeps is given back at the end."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    pa.default_memory_pool().release_unused()


def map_rows(df: DataFrame, function, schema: str, rows: int | None = None) -> DataFrame:
    """mapInArrow for a function from a batch (of so many rows at most, where given) to {column: list}; the lists become one batch of the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows) if rows else batches:
            columns = function(batch)
            yield pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, schema)


def fold(id_column: str) -> Column:
    """crc32 of the id as text, modulo 5; null ids count as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))), F.lit(5))


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name in taken:
        name = f"_{name}"
    return name


def few(df: DataFrame, limit: int, weight: Column | None = None) -> DataFrame:
    """df (a written table), to be sent to all tasks where its rows, or their weights, are no more than limit in all, else to be joined as it is."""
    n = df.count() if weight is None else df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if n <= limit else df


def looked_up(rows: DataFrame, values: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """rows (a written table) with the values of their keys; the hot keys, whose number has a bound, are sent to all tasks, so none of them gathers in one."""
    few_ = F.broadcast(values.where(hot))
    rest = rows.join(F.broadcast(values.where(hot).select(*keys)), keys, "left_anti")
    return rows.join(few_, keys).unionByName(rest.join(values.where(~hot), keys))
