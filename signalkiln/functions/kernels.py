"""Kernels that run as Arrow batches: 8x8 cosine transforms in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_K = np.arange(8)
#: Rows are the orthonormal cosine basis: C @ x transforms a column of 8 samples.
COSINE = np.sqrt(2 / 8) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K[:, None] == 0, np.sqrt(0.5), 1.0)


def fdct(blocks: np.ndarray) -> np.ndarray:
    """(n, 64) samples to (n, 64) coefficients."""
    x = blocks.reshape(-1, 8, 8)
    return (COSINE @ x @ COSINE.T).reshape(-1, 64)


def idct(blocks: np.ndarray) -> np.ndarray:
    x = blocks.reshape(-1, 8, 8)
    return (COSINE.T @ x @ COSINE).reshape(-1, 64)


def _blocks(column: str, out: str, kernel):
    def run(batches):
        for b in batches:
            a = b.column(column)
            n = np.asarray(a.values.slice(a.offset * 64, len(a) * 64) if pa.types.is_fixed_size_list(a.type) else a.flatten(), float).reshape(-1, 64)
            values = pa.array(list(kernel(n)), pa.list_(pa.float64())) if len(n) else pa.array([], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, values], [*b.schema.names, out])

    return run


def transform_blocks(blocks: DataFrame, column: str = "coeff", out: str = "dct", inverse: bool = False) -> DataFrame:
    """``blocks`` with a column of 64 doubles added; ``column`` holds arrays of 64 numbers, none null."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    schema = StructType([*blocks.schema.fields, StructField(out, ArrayType(DoubleType()))])
    return blocks.mapInArrow(_blocks(column, out, idct if inverse else fdct), schema)
