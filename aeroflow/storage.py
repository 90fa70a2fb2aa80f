"""Tables written to the folder that every executor shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where the setting is absent and the master is local (tests), one temporary folder is made
    for the process. On a cluster without the setting this raises, as no local folder would be
    seen by the other machines.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
        if not _LOCAL_ROOT:
            _LOCAL_ROOT.append("file://" + tempfile.mkdtemp(prefix="spark-aeroflow-"))
        root = _LOCAL_ROOT[0]
    return f"{root.rstrip('/')}/aeroflow-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`new_path`."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _drop_all(spark: SparkSession, root: str) -> None:
    try:
        drop_path(spark, root)
    except Exception:  # the session may have ended
        pass


_SEEN: set[str] = set()
#: Paths written inside the innermost ``scratch`` block of this context.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def materialise(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, in folders by a column's values if asked for, and return the written table.

    This cuts the lineage: a lost executor costs no recomputation of what is above, and what
    follows is planned with the table's real size.
    """
    spark = df.sparkSession
    root = shared_dir(spark)
    if root not in _SEEN:
        _SEEN.add(root)
        atexit.register(_drop_all, spark, root)
    path = new_path(spark, label)
    df.write.parquet(path, partitionBy=by)
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def read_batches(files: list[str], columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a written table, whose files are ``files`` (``inputFiles``), in equal order for every task that reads them."""
    from pyarrow import fs, parquet

    for file in sorted(files):
        store, path = fs.FileSystem.from_uri(file)
        with store.open_input_file(path) as opened:
            yield from parquet.ParquetFile(opened).iter_batches(rows, columns=columns)


def release(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialise` that nothing will read any more."""
    for table in tables:
        path = getattr(table, "_written_path", None)
        if path:
            drop_path(table.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables materialised inside the block are deleted at its end, but for those passed to what it gives.

    What is returned from the block must read kept tables and its inputs only; it can then be read
    as often as wanted, beside any other run of the same code.
    """
    written: list[str] = []
    token = _SCOPE.set(written)

    def keep(table: DataFrame) -> DataFrame:
        written.remove(table._written_path)
        return table

    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        for path in written:
            drop_path(spark, path)
