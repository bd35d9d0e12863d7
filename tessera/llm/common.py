"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: DuckDB's words for the crc32 of a text of ASCII characters, bit by bit.
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

_LOCAL_ROOT: list[str] = []
#: Paths of written tables that no one has released yet, with the session that wrote them.
_LEFT: dict[str, SparkSession] = {}
#: Paths written by the step that runs, where someone collects them.
_STEP: ContextVar[list[str] | None] = ContextVar("step", default=None)


def work_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only where that setting is missing and the master is local (tests on one machine) a
    temporary folder is used; on a cluster each executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="tessera-"))
    return _LOCAL_ROOT[0]


def written(df: DataFrame, label: str, *, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared work folder and read it back.

    Cuts the lineage: what was written survives the loss of any executor.  The table
    stays until it is released or the program ends.  Tables with whole texts are smaller with ``zstd``.
    """
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def shared_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared work folder for files that tasks write; it goes like a written table."""
    path = f"{work_root(spark)}/tessera-work/{label}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    if (step := _STEP.get()) is not None:
        step.append(path)
    return path


def settled(make: Callable[[], DataFrame], label: str, *done: DataFrame) -> DataFrame:
    """What ``make`` returns, written; tables that it wrote on its way and those in ``done`` are deleted."""
    mine: list[str] = []
    mark = _STEP.set(mine)
    try:
        out = make()
    finally:
        _STEP.reset(mark)
    out = written(out, label, compression="zstd")
    for path in mine:
        _delete(path)
    released(*done)
    return out


def released(*tables: DataFrame | str) -> None:
    """Delete written tables, or folders by their names, that nothing reads any more."""
    for table in tables:
        _delete(table if isinstance(table, str) else getattr(table, "written_at", None))


def _delete(path: str | None) -> None:
    spark = _LEFT.pop(path, None) if path else None
    if spark is not None:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@atexit.register
def _clear() -> None:
    """What a job has left behind, where the session can still be reached."""
    for path in list(_LEFT):
        with contextlib.suppress(Exception):
            _delete(path)
    for root in _LOCAL_ROOT:
        shutil.rmtree(root, ignore_errors=True)


def id_crc(doc_id: str | Column) -> Column:
    """crc32 of the id written as decimal text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary"))


def map_rows(
    df: DataFrame,
    columns: list[str],
    fn: Callable[..., Iterable[tuple]],
    schema: str,
    names: list[str],
    types: list[pa.DataType],
) -> DataFrame:
    """Arrow batches of ``columns`` as Python lists to ``fn``, its rows back.

    ``fn(*lists)`` yields tuples in the order of ``names``.  Output batches
    hold 4,096 rows at most, so memory follows the input batch alone.
    """
    arrow = pa.schema(list(zip(names, types, strict=True)))

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces:
            rows = list(fn(*(c.to_pylist() for c in piece.columns)))
            if rows:
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.select(*columns).mapInArrow(lambda batches: run(sliced(batches, 4096)), schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows; at the task's end Arrow gives back what it holds, as workers live on."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
