"""Shared pieces of the text operators: table access, written intermediates, Arrow row helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: An output batch is closed once its variable-length values pass this many bytes.
OUT_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="veritide-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Folders written by ``saved`` and not yet dropped.
_WRITTEN: list[str] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later reads do not recompute it,
    and losing an executor loses none of it. The files go when ``dropping`` or the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, files = _at(spark, path)
    files.deleteOnExit(target)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextmanager
def dropping(spark: SparkSession) -> Iterator[None]:
    """What ``saved`` writes inside is deleted at the end: results that rest on it must be written by then."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        for path in _WRITTEN[before:]:
            target, files = _at(spark, path)
            files.delete(target, True)
        del _WRITTEN[before:]


_KEPT: dict[str, Any] = {}


def worker_memo(key: str, make: Callable[[], Any]) -> Any:
    """What a worker keeps between its tasks: one object, that of the query it works for. An earlier one goes first."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drop what an earlier query left in this worker, and give memory that is not in use back."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores before it until no column has it (case does not count)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def id_types(docs: DataFrame, id_col: str) -> tuple[pa.DataType, str]:
    """The Arrow type and the SQL type of an id column, which goes through an operator as it is."""
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType
    return to_arrow_type(kind), kind.simpleString()


def held_out(doc_id: str = "doc_id"):
    """True for the documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def emit(rows: Iterator[tuple], schema: pa.Schema, sized: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Pack rows into record batches of bounded size."""
    kept, held = [], 0
    for row in rows:
        kept.append(row)
        held += sized(row)
        if held >= OUT_BYTES or len(kept) >= 10_000:
            yield _batch(kept, schema)
            kept, held = [], 0
    if kept:
        yield _batch(kept, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, type=field.type) for column, field in zip(zip(*rows), schema, strict=True)], schema=schema
    )
