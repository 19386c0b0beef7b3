"""A bit table of fixed size that tells which rows cannot meet a set of 64-bit keys.

Rows that miss the table need no join with the set; the others, few if the set is small against the table, are
joined exactly. So long rows are not shuffled only to find out that they have no partner. The table has
2 ** bits bits whatever the size of the set; a set too large for it lets more rows through to the join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.llm import words as W

BITS = 23  # 1 MiB
_BLOCK = 1 << 11  # bytes of the table that are sent together


def _cells(keys: np.ndarray, bits: int) -> np.ndarray:
    return (W.mix(keys.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def bit_table(keys: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Packed bits of the cells that the keys of a long column fall on. Tasks send the blocks they touch;
    blocks are combined as they stream in."""
    size = 1 << bits

    def mark(batches):
        cells = np.zeros(size, bool)
        for batch in batches:
            cells[_cells(np.asarray(batch.column(0)), bits)] = True
        blocks = np.packbits(cells).reshape(-1, min(_BLOCK, size // 8))
        used = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([blocks[b].tobytes() for b in used], pa.binary())], names=["block", "bits"])

    def combine(batches):
        total = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(raw, np.uint8)
                total[block] = total[block] | part if block in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "bits"])

    schema = "block long, bits binary"
    found = (keys.filter(F.col(column).isNotNull()).select(F.col(column).cast("long")).mapInArrow(mark, schema)
             .repartition(16, "block").mapInArrow(combine, schema).toArrow())
    out = np.zeros((size // 8 // min(_BLOCK, size // 8), min(_BLOCK, size // 8)), np.uint8)
    for block, raw in zip(found["block"].to_pylist(), found["bits"].to_pylist()):
        out[block] = np.frombuffer(raw, np.uint8)
    return out.ravel()


def may_meet(rows: DataFrame, key: Column, table: np.ndarray) -> Column:
    """False for rows whose key is certainly not in the set; only the key goes to Python."""
    bits = len(table).bit_length() + 2
    shared = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def hit(keys: pd.Series) -> pd.Series:
        cells = _cells(keys.to_numpy(), bits)
        return pd.Series((shared.value[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1)

    return hit(key)
