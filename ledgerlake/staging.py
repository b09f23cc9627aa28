"""Written intermediate tables.

A result that several later jobs read is written once as Parquet in the shared
folder named by ``spark.checkpoint.dir`` and read back. That cuts lineage,
survives the loss of executors, and gives the planner true table sizes, so a
join is broadcast only when the measured size is under
``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Rows of a table that may be broadcast; compressed files say little about the memory that their rows take.
MOST_BROADCAST = 1 << 19

_local_dirs: dict[str, str] = {}
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediates, taken from the session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="ledgerlake-")
    return _local_dirs[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage_at(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to ``path``, which must be new, and return the table read back."""
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a fresh path and return the table read back."""
    path = new_path(df.sparkSession, label)
    if (held := _scratch.get()) is not None:
        held.append(path)
    return stage_at(df, path, "zstd")


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` as it is if it only selects from a table, else written.

    Such a plan gives the same rows each time, and a filter that is moved below
    its columns meets no row that another filter was to keep from them.
    """
    plan = df._jdf.queryExecution().analyzed()
    node, whole = plan, plan.deterministic()
    while node.getClass().getSimpleName() in ("Project", "SubqueryAlias"):
        node = node.children().apply(0)
    return df if whole and node.children().isEmpty() else stage(df, label)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is removed in the end, and shuffle files of finished steps with it.

    What is to stay must be written to a path of its own inside, as by
    ``stage_at``. Spark removes shuffle files when the driver's garbage
    collection finds that nothing refers to them, which may be long after.
    """
    held: list[str] = []
    before = _scratch.set(held)
    try:
        yield
    finally:
        _scratch.reset(before)
        hadoop = spark._jsparkSession.sessionState().newHadoopConf()
        for path in (spark._jvm.org.apache.hadoop.fs.Path(p) for p in held):
            path.getFileSystem(hadoop).delete(path, True)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def join_side(table: DataFrame) -> DataFrame:
    """A written table as a side of joins: shuffled, never broadcast, if it has more than ``MOST_BROADCAST`` rows.

    Spark knows the size of its files only. Seven million short rows take less
    than the usual threshold of 10 MB there, but some 100 bytes each in the
    driver and in every executor once they are a hash table.
    """
    return table.hint("shuffle_hash") if table.count() > MOST_BROADCAST else table


def together(spark: SparkSession, *jobs: Callable) -> list:
    """What independent jobs return, submitted at the same time, so that one's last tasks do not hold up the next."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [done.result() for done in [pool.submit(copy_context().run, inheritable_thread_target(spark)(job)) for job in jobs]]
