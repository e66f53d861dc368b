"""Columns of arrays as numpy arrays, a batch at a time, without an object for each element."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType


def struct_of(longs: list[str], doubles: list[str]) -> StructType:
    """A struct of arrays, those of longs first."""
    out = StructType()
    for name in [*longs, *doubles]:
        out.add(name, ArrayType(LongType() if name in longs else DoubleType()))
    return out


def apart(column: pa.Array) -> list[np.ndarray]:
    """The arrays of a column of arrays, as doubles; a null is NaN."""
    values, at = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_pylist()
    return [values[i:j] for i, j in zip(at, at[1:], strict=False)]


def together(rows: list[tuple[np.ndarray, ...]], kind: StructType) -> pa.Array:
    """The column whose rows are these arrays."""
    at = pa.array(np.cumsum([0, *(len(r[0]) for r in rows)]), pa.int32())
    of = lambda k, t: np.concatenate([np.zeros(0), *(r[k] for r in rows)]) if t == DoubleType() else np.concatenate([np.zeros(0, np.int64), *(r[k].astype(np.int64) for r in rows)])
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, pa.array(of(k, f.dataType.elementType))) for k, f in enumerate(kind.fields)], kind.names)
