"""Rows in packs: what a task has for a block travels as one row of compressed columns.

A row of a shuffle takes eight bytes a field and more. The columns of a block's rows take a few bytes for a row together, and
as packs are few, nothing is sorted row by row on its way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that a task holds before it makes packs of them.
HELD = 1 << 20


def _dictionaries(part: pa.Table) -> pa.Table:
    """``part`` with dictionaries for numbers and texts that are often the same."""
    for k, field in enumerate(part.schema):
        if pa.types.is_floating(field.type) or pa.types.is_string(field.type):
            coded = part.column(k).combine_chunks().dictionary_encode()
            if 2 * len(coded.dictionary) < len(coded):
                part = part.set_column(k, field.name, coded)
    return part


def pack(part: pa.Table) -> bytes:
    part = _dictionaries(part)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(part)
    return sink.getvalue().to_pybytes()


def unpack(packs: pa.Array | pa.ChunkedArray) -> pa.Table:
    """The rows of some packs, in the order of these."""
    tables = [pa.ipc.open_stream(p.as_buffer()).read_all() for p in packs]
    plain = [t.cast(pa.schema([(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type) for f in t.schema])) for t in tables]
    return pa.concat_tables(plain).combine_chunks()


def held(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[pa.Table]:
    """``batches`` as tables of at least ``rows`` rows, but for the last."""
    some, n, rows = [], 0, rows or HELD
    for batch in batches:
        some.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(some)
            some, n = [], 0
    if n:
        yield pa.Table.from_batches(some)


def cuts(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """From where to where each key of sorted ``keys`` goes."""
    ends = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
    return ((lo, hi) for lo, hi in zip(ends, ends[1:]) if hi > lo)


def packed(rows: DataFrame, by: str) -> DataFrame:
    """(block, pack): ``rows`` (block int and others) in packs, within which they are in the order of ``by``."""

    def each(batches):
        for table in held(batches):
            of = table["block"].to_numpy()
            order = np.lexsort((table[by].to_numpy(), of))
            of, table = of[order], table.drop_columns(["block"]).take(order)
            for lo, hi in cuts(of):
                yield pa.RecordBatch.from_arrays([pa.array([of[lo]], pa.int32()), pa.array([pack(table.slice(lo, hi - lo))], pa.binary())], ["block", "pack"])

    return rows.mapInArrow(each, "block int, pack binary")


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of 8 bytes a value as differences, their first bytes together, then their second ones, and compressed; exact, whatever they hold."""
    planes = [np.diff(c.view(np.int64), prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    return pa.compress(b"".join(planes), "zstd", asbytes=True)


def stretch(data: pa.Buffer, **columns: tuple[type, int]) -> dict[str, np.ndarray]:
    """What ``squeeze`` was given, by the kind and number of each column's values."""
    whole = np.frombuffer(pa.decompress(data, 8 * sum(n for _, n in columns.values()), "zstd"), np.uint8)
    out, at = {}, 0
    for name, (kind, n) in columns.items():
        out[name] = np.cumsum(np.ascontiguousarray(whole[at : at + 8 * n].reshape(8, n).T).view(np.int64).ravel()).view(kind)
        at += 8 * n
    return out
