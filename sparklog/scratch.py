"""Small helper tables that must outlive a lost executor.

They are written as Parquet under ``spark.checkpoint.dir``, the folder all nodes share.
"""

import os
import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# A helper table is broadcast only when its counted rows stay below this number. The rows
# are a path and a few numbers, about 200 bytes, so this bounds a broadcast near 200 MB.
MAX_BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by the cluster; a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    root = os.path.join(tempfile.gettempdir(), "sparklog-" + spark.sparkContext.applicationId)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back from there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    if getattr(_scope, "tables", None) is not None:
        _scope.tables.append(table)
    return table


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there, through the file system that Spark writes with."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def drop_table(table: DataFrame) -> None:
    """Delete what ``write_table`` wrote, once nothing will read ``table`` again."""
    remove_folder(table.sparkSession, table.scratch_path)


_CHECKPOINT_FILES = "spark.sql.streaming.checkpointFileManagerClass"


@contextmanager
def checkpoint_files(spark: SparkSession, path: str):
    """A stream started inside writes its progress below ``path`` through the older of Hadoop's interfaces if that
    folder is local, where the newer one starts several commands per file. The folder is renamed into alike."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    local = folder.getFileSystem(context._jsc.hadoopConfiguration()).getUri().getScheme() == "file"
    if not local or spark.conf.get(_CHECKPOINT_FILES, None) is not None:
        yield
        return
    spark.conf.set(_CHECKPOINT_FILES,
                   "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager")
    try:
        yield
    finally:
        spark.conf.unset(_CHECKPOINT_FILES)


_scope = threading.local()


@contextmanager
def passing():
    """Tables that this thread writes by ``write_table`` inside of the block go at its end. For work that writes
    all its results inside, such as a micro-batch."""
    outer, _scope.tables = getattr(_scope, "tables", None), []
    try:
        yield
    finally:
        written, _scope.tables = _scope.tables, outer
        for table in written:
            drop_table(table)
