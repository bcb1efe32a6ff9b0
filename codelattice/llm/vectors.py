"""Embeddings as rows of bytes, and the vectors that take part in a search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.llm.common import ship


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the vectors that are neither null nor zero and hold finite numbers only."""
    v = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & F.exists("embedding", lambda x: x != 0))


def folded(vectors: DataFrame, smallest: int = 0) -> DataFrame:
    """One row per distinct vector: vec_id (the smallest), copies, embedding, and, where asked for, ids: the
    ``smallest`` first vec_ids. Both are found with a limit or a partial sum on each task before the shuffle."""
    classes = vectors.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    if not smallest:
        return classes.select("vec_id", "copies", "embedding")
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    first = vectors.withColumn("r", rank).where(F.col("r") <= smallest).groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return first.select(F.element_at("ids", 1).alias("vec_id"), "ids", "embedding")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [n for n in batch.schema.names if n != "embedding"]
        lists = batch.column("embedding")
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8")
        ends = np.cumsum([0, *lists.value_lengths().to_numpy(zero_copy_only=False)])
        data = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(data, pa.binary())], [*keep, "data"])


def as_rows(vectors: DataFrame) -> DataFrame:
    """The column embedding as ``data``: bytes of doubles."""
    ship(vectors.sparkSession)
    keep = [f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name != "embedding"]
    return vectors.mapInArrow(_rows, ", ".join([*keep, "data binary"]))


def matrix(column: pa.Array | list[bytes]) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    data = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)
