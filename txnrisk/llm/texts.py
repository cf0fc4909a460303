"""Words, word windows and record batches, shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS_AT_ONCE = 256  # documents turned into Python objects at a time


def raw_text(column: str) -> Column:
    """UTF-8 bytes of a text column, null kept."""
    return F.col(column).cast("string").cast("binary")


def words_of(data: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; ``bytes.split`` breaks at exactly these six bytes."""
    return data.split() if data else []


def windows_of(words: list[bytes], size: int) -> list[bytes]:
    """Space-joined windows of ``size`` words, repeats included; fewer words: the whole sequence."""
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [joined]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[s:e] for s, e in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist())]


def code_points(data: bytes) -> int:
    """Characters in UTF-8 bytes."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short slices of record batches, so that few whole texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def map_texts(
    df: DataFrame, columns: list[Column], schema: str, rows: Callable[[list[list]], list[list]]
) -> DataFrame:
    """One output row per input row: ``rows`` turns lists of input columns into output columns."""
    source = df.select(*columns)
    types = StructType.fromDDL(schema)
    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches):
            made = rows([c.to_pylist() for c in piece.columns])
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(made, arrow)], schema=arrow
            )

    return source.mapInArrow(run, types)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish
