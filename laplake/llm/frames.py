"""Small DataFrame helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from laplake.llm.text import give_back
from laplake.session import new_folder


def staged(df: DataFrame, purpose: str, compression: str = "zstd") -> DataFrame:
    """Write to the shared folder and read back: later steps see fixed rows and a short lineage."""
    spark = df.sparkSession
    path = new_folder(spark, purpose)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach(df: DataFrame, fields: Iterable[StructField], compute: Callable) -> DataFrame:
    """Append columns that ``compute(batch)`` gives as Arrow arrays.

    An input column with the name of a new one is replaced.
    """
    fields = list(fields)
    names = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    keep = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            arrays = compute(batch)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), *arrays], names=[*keep, *(f.name for f in fields)])
            give_back()

    return df.mapInArrow(run, StructType([*kept, *fields]))


BROADCAST_IDS = 1_000_000


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join with a column of numeric ids.

    The ids go to all tasks only while a count shows that they are few; beyond
    that both sides are shuffled.
    """
    ids = ids.distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, how)


def remainder(column: Column | str, of: int) -> Column:
    """crc32 of a value as text, modulo ``of``: the split of rows into folds."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % of


def binary_array(values, sizes) -> pa.Array:
    """Consecutive runs of a numpy array as binary values; ``sizes`` counts elements."""
    import numpy as np

    at = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(np.asarray(sizes, dtype=np.int64) * values.dtype.itemsize, out=at[1:])
    data = pa.py_buffer(np.ascontiguousarray(values))
    if at[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int32)), data])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), data])
