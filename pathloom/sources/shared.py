"""Tables in the folder that driver and executors share: cut lineage, tables that are written once, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ConfigurationError

#: Rows (an id and a few numbers) up to which one side of a join is broadcast; more are joined by a shuffle.
MOST_BROADCAST = 200_000
#: The same where rows are ids alone: some 100 MB.
MOST_IDS = 1_000_000
_KEPT: dict[tuple, object] = {}
T = TypeVar("T")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where none is named a local session gets its own; a cluster raises."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ConfigurationError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="pathloom-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, each file in order of ``by``, so that a filter on that reads few pages."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    (df if by is None else df.repartition(by).sortWithinPartitions(by)).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def kept(spark: SparkSession, key: tuple, build: Callable[[], T]) -> T:
    """What ``build`` makes and writes, from the first call of this session. ``key`` must name the inputs, which stay as they are."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _KEPT:
        _KEPT[key] = build()
    return _KEPT[key]


def forget() -> None:
    """Write kept tables anew when they are next asked for."""
    _KEPT.clear()


def checked_broadcast(df: DataFrame, rows: int = MOST_BROADCAST) -> DataFrame:
    """Hint a broadcast if ``df`` (short rows, its lineage cut) is counted to be small; else the planner's joins."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
