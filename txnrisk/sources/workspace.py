"""Where intermediate tables go: the shared folder the cluster names, never a worker's disk."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# folders of the runs that drop their own intermediates, per thread or task of the driver
_owner: ContextVar[tuple[str, ...]] = ContextVar("txnrisk_owner", default=())


def _on_store(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else (with a local master only) a folder beside the
    session's warehouse.

    On a cluster the folder must be one that the driver and every executor see, so without
    ``spark.checkpoint.dir`` a warehouse on a machine's own disk (``file:``) is refused with an error
    that names the setting.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
        _refuse_private(spark, named, spark.sparkContext.master or "")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _refuse_private(spark: SparkSession, folder: str, master: str) -> None:
    """An error if ``folder`` lies on one machine's disk while the master is not local."""
    store, path = _on_store(spark, folder)
    private = str(store.makeQualified(path).toUri().getScheme() or "file") == "file"
    if private and not master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that the driver and all executors share: "
            f"{folder} lies on one machine's disk"
        )


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder name; nothing is ever overwritten.

    It lies in the folder of the enclosing ``run_folder``, else in the application's, which the
    file system drops when the application ends (results that are still lazy may need it till then).
    """
    owners = _owner.get()
    if owners:
        return f"{owners[-1]}/{label}-{uuid.uuid4().hex[:12]}"
    folder = f"{shared_folder(spark)}/txnrisk/{spark.sparkContext.applicationId}"
    store, path = _on_store(spark, folder)
    if store.mkdirs(path):
        store.deleteOnExit(path)
    return f"{folder}/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Owner of one run's intermediates: all of them are dropped when the block ends.

    For jobs that write their results inside the block. Lazy frames made inside it must not be used
    after it.
    """
    app = spark.sparkContext.applicationId
    folder = f"{shared_folder(spark)}/txnrisk/{app}/run-{uuid.uuid4().hex[:12]}"
    token = _owner.set((*_owner.get(), folder))
    try:
        yield folder
    finally:
        _owner.reset(token)
        store, path = _on_store(spark, folder)
        store.delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    Cuts lineage like a checkpoint and survives lost executors; unlike one it is columnar, so later
    steps read only the columns they need, and its size is known to the optimizer.
    """
    path = fresh_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, *jobs: Callable[[], object]) -> None:
    """Run independent steps at the same time, so that one uses the cores another leaves idle.

    Returns when all have ended; the first error is raised. Steps keep the caller's run folder.
    """
    with ThreadPoolExecutor(len(jobs)) as pool:
        calls = [pool.submit(copy_context().run, inheritable_thread_target(spark)(job)) for job in jobs]
    for call in calls:
        call.result()
