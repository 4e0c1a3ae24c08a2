"""Vector columns: which rows count, and their numbers as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded


def clean(rows: DataFrame, zero: bool) -> DataFrame:
    """vec_id, label, dim and raw (the components as they came, floats or doubles, binary); raw is null where the vector is null or empty, or
    holds a null or a component that is not finite, or (unless ``zero``) is all zeros."""

    kind = "float" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    code = "<f4" if kind == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for x in batch.column("embedding"):
                values = x.values if x.is_valid else None
                if values is None or not len(values) or values.null_count:
                    raw.append(None)
                    continue
                v = values.to_numpy(zero_copy_only=False)
                raw.append(v.astype(code).tobytes() if np.isfinite(v).all() and (zero or v.any()) else None)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "dim": pa.array([None if r is None else len(r) // int(code[2]) for r in raw], pa.int32()), "raw": pa.array(raw, pa.binary())})

    label = F.col("label").cast("string") if "label" in rows.columns else F.lit(None).cast("string")
    own = bounded(rows).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    return own.mapInArrow(run, "vec_id long, label string, dim int, raw binary")


def matrix(raw: list[bytes], dim: int) -> np.ndarray:
    """Vectors of one dimension as doubles."""
    code = "<f4" if len(raw[0]) == 4 * dim else "<f8"
    return np.frombuffer(b"".join(raw), dtype=code).reshape(len(raw), dim).astype(float)
