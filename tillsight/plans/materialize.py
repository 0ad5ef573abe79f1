"""Fix a DataFrame's rows in reliable storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: What has been stored, for every ``only_kept`` that is open: path and session.
_open: list[dict[str, SparkSession]] = []


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, below the session's checkpoint folder.

    Only a local session that names none gets a folder of its own. On a cluster
    that is an error, since executors cannot read each other's local folders.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        if context.applicationId not in _local_folders:
            made = tempfile.mkdtemp(prefix="tillsight-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            _local_folders[context.applicationId] = made
        folder = _local_folders[context.applicationId]
    return f"{folder.rstrip('/')}/tillsight-{context.applicationId}"


def new_path(spark: SparkSession) -> str:
    """An unused path in this application's folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return the stored rows.

    The copy cuts the lineage, survives the loss of executors, is read by column
    and has a known size, so Spark can choose joins by it. It stays until
    ``drop_materialized``, since the returned rows are read lazily.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _paths[stored] = path
    for stored_here in _open:
        stored_here[path] = spark
    return stored


@contextmanager
def only_kept() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables that are materialized inside, but for those passed to the function it yields.

        with only_kept() as keep:
            result = keep(materialize(...))
    """
    stored_here: dict[str, SparkSession] = {}
    kept: set[str] = set()

    def keep(stored: DataFrame) -> DataFrame:
        kept.add(_paths[stored])
        return stored

    _open.append(stored_here)
    try:
        yield keep
    finally:
        _open.remove(stored_here)
        for path, spark in stored_here.items():
            if path not in kept:
                _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def drop(stored: DataFrame) -> None:
    """Delete the table behind a frame that ``materialize`` returned, and no other."""
    path = _paths.pop(stored, None)
    if path is not None:
        _delete(stored.sparkSession, path)


def drop_materialized(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once its results have been read."""
    _delete(spark, shared_folder(spark))
