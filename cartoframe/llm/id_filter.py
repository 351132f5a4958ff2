"""A filter of fixed size over a set of ids: rows that are surely not in the set need no shuffle.

The filter has BITS bits however many ids there are, so it may be broadcast.  As
the set grows it rules out less and the exact join behind it takes over; what it
lets through is always joined exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cartoframe.llm import textkit as tk

BITS, CHUNKS = 1 << 23, 16


def _at(ids: np.ndarray) -> np.ndarray:
    return (tk.mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(BITS - 1)).astype(np.int64)


def build(ids: DataFrame) -> np.ndarray:
    """Packed bits of the ids in the only column."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(BITS, bool)
        for batch in batches:
            flags[_at(batch.column(0).drop_null().to_numpy())] = True
        parts = [(i, np.packbits(c).tobytes()) for i, c in enumerate(np.split(flags, CHUNKS)) if c.any()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], ["chunk", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, bits in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(bits.as_buffer(), np.uint8)
                total[chunk] = total[chunk] | own if chunk in total else own.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([b.tobytes() for b in total.values()], pa.binary())], ["chunk", "bits"])

    schema = "chunk int, bits binary"
    out = np.zeros((CHUNKS, BITS // CHUNKS // 8), np.uint8)
    for row in ids.mapInArrow(mark, schema).repartition(CHUNKS, "chunk").mapInArrow(merge, schema).collect():  # BITS bits in all
        out[row.chunk] |= np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def split(rows: DataFrame, id_col: str, bits: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(rows that may be in the set, rows that are not); rows without id are not."""
    sent = rows.sparkSession.sparkContext.broadcast(bits)
    at = rows.columns.index(id_col)

    def keep(batches: Iterator[pa.RecordBatch], inside: bool) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            ids = batch.column(at)
            maybe = flags[_at(ids.fill_null(0).to_numpy())] & ids.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(maybe if inside else ~maybe))

    return rows.mapInArrow(lambda b: keep(b, True), rows.schema), rows.mapInArrow(lambda b: keep(b, False), rows.schema)
