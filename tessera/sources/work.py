"""Intermediate tables of the engine: written once where several later steps read them, or dealt out where one split holds too much work."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame

_LOCAL: list[str] = []
TASKS_A_CORE = 3  # of rows that are dealt out anew


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in ``spark.checkpoint.dir``: later steps read it instead of its plan, and it survives lost executors.

    Only a local master without that setting uses a temporary folder; a cluster is refused, as its executors don't share one.
    """
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")) and not _LOCAL:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _LOCAL.append(tempfile.mkdtemp(prefix="tessera-engine-"))
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or _LOCAL[0]
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out over all cores by its keys: narrow rows fit into one split of a file, however much work each of them makes."""
    return df.repartition(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism, *keys)


@atexit.register
def _clear() -> None:
    for root in _LOCAL:
        shutil.rmtree(root, ignore_errors=True)
