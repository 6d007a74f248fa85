"""Helpers shared by the operators: reading, Arrow mapping, cutting lineage."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows handed to a row function at once, and their bytes (of more than one row): bounds a worker's memory.
SLICE_ROWS = 256
SLICE_BYTES = 4_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``id`` and ``text``: other columns, whatever their names, never clash."""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def kind_of(df: DataFrame, name: str) -> str:
    """A column's type, for use in a schema."""
    return df.schema[name].dataType.simpleString()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def map_columns(df: DataFrame, fn: Callable[..., dict], schema: str | T.StructType, state: Callable[[], object] | None = None) -> DataFrame:
    """Map slices of rows: ``fn(state, columns)`` gets lists by column name, returns lists or Arrow arrays.

    ``state`` is built once in each task.  Row order within a partition is kept.
    """
    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = state() if state else None
        for batch in batches:
            for piece in _slices(batch):
                out = fn(own, {name: _lists(piece.column(i)) for i, name in enumerate(piece.schema.names)})
                yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in arrow], schema=arrow)
        _give_back()

    return df.mapInArrow(run, struct)


def column_function(fn: Callable[..., list], kind: str, state: Callable[[], object]) -> Callable[..., object]:
    """A function of columns for use in ``select``: ``fn(state, *lists)`` gives the results as a list or Arrow array.

    It counts as nondeterministic, so that a filter on its result doesn't make it run twice.
    """
    arrow = to_arrow_schema(T._parse_datatype_string(f"x {kind}"))[0].type

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        own = state()
        for batch in batches:
            columns = list(batch) if isinstance(batch, tuple) else [batch]
            rows = pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))])
            parts = [_array(fn(own, *map(_lists, piece.columns)), arrow) for piece in _slices(rows)]
            yield pa.concat_arrays(parts) if parts else pa.array([], type=arrow)
        _give_back()

    return run.asNondeterministic()


def _give_back() -> None:
    """Return freed memory to the system at a task's end: idle workers stay beside those of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of SLICE_ROWS rows and SLICE_BYTES bytes at most; a row that is larger is a slice of its own."""
    start = 0
    while start < batch.num_rows:
        n = SLICE_ROWS
        while (piece := batch.slice(start, n)).nbytes > SLICE_BYTES and n > 1:
            n //= 2
        yield piece
        start += n


def int_lists(parts: list[np.ndarray]) -> pa.Array:
    """An Arrow list of int32 for each of ``parts``, without a Python number for each value."""
    ends = np.cumsum([0, *map(len, parts)])
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()), type=pa.list_(pa.field("element", pa.int32())))


def _array(values: list | pa.Array, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, type=kind)


def _lists(column: pa.Array) -> list:
    """``to_pylist``, faster for lists of numbers without nulls."""
    if pa.types.is_list(column.type) and pa.types.is_primitive(column.type.value_type) and not column.null_count and not column.values.null_count:
        ends, values = column.offsets.to_numpy(), column.values.to_numpy()
        return [values[a:b].tolist() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return column.to_pylist()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` where the session has it; else, on a master of one
    machine (tests), a temporary folder of this process is set and used.  Any other
    master without it raises, as its executors share no folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="checkpoint-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts lineage with a compact columnar copy that outlives lost executors.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a ``written`` table that is needed no more."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
