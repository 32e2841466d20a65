"""The folder that driver and executors share, and tables and files kept there.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and the
master is local (tests) a temporary folder is made and set as the checkpoint folder; a cluster without it is refused.
"""

from __future__ import annotations

import posixpath
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder, without a slash at its end."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="voxloom-shared-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the shared one. Nothing is created yet."""
    return f"{shared_root(spark)}/voxloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again.

    This cuts the lineage: a lost executor costs only the tasks of the step
    that reads the table.
    """
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, uri: str) -> None:
    """Delete a folder that no later step reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(df: DataFrame) -> None:
    """Delete the table that :func:`written` returned as `df`."""
    folders = {posixpath.dirname(f) for f in df.inputFiles()}
    for folder in folders:
        drop_folder(df.sparkSession, folder)


def put_file(uri: str, name: str, data: bytes) -> None:
    """Write one file from a task: first under another name, then moved.

    A task that runs again, or twice at once, writes the same bytes to the same
    name, so readers see a whole file or none.
    """
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    try:
        store.move(part, f"{path}/{name}")
    except OSError:  # some stores don't move onto a file that is there already
        if store.get_file_info(f"{path}/{name}").size != len(data):
            raise
        store.delete_file(part)


def release_arrow() -> None:
    """Give the system back what Arrow's pool has kept of freed memory: a Python worker lives on after its task, beside those of later steps."""
    pa.default_memory_pool().release_unused()


def quoted(column: str) -> str:
    """A column's name, whatever its signs, as a reference to it."""
    return "`" + column.replace("`", "``") + "`"


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column's name begins with it, so that names made from it clash with none."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def input_parts(df: DataFrame) -> int:
    """Partitions that the scan below `df` has: a measure of its size that needs no job."""
    return max(1, df.rdd.getNumPartitions())
