"""Files that tasks write: the folder that driver and executors share, whole-file writes, JSON sidecars and backups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators import library, store


def work_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder below the one that `spark.checkpoint.dir` names; only a local master may do without that setting."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="voxloom-shared-")
    return f"{root.rstrip('/')}/voxloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, read again: worked out once, however often it is used, and of known size."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def _placed(place, path: str, name: str) -> Iterator:
    """A stream under another name that is moved at its end; a task that runs twice finds the same file there already."""
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with place.open_output_stream(part) as out:
        yield out
        size = out.tell()
    try:
        place.move(part, f"{path}/{name}")
    except OSError:
        if place.get_file_info(f"{path}/{name}").size != size:
            raise
        place.delete_file(part)


def _folder(folder: str) -> tuple:
    """File system and path of a folder, which is there afterwards."""
    from pyarrow import fs

    place, path = fs.FileSystem.from_uri(folder)
    place.create_dir(path, recursive=True)
    return place, path


def write_files(files: DataFrame, folder: str) -> int:
    """Write rows (name, body: binary or text) as files of `folder`; returns how many."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, path = _folder(folder)
        for batch in batches:
            for name, body in zip(batch["name"], batch["body"], strict=True):
                with _placed(place, path, name) as out:
                    out.write(body.encode() if isinstance(body, str) else bytes(body))
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("name", "body").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_parts(parts: DataFrame, folder: str) -> int:
    """Write files of `folder` from rows (name, body), which are parts of a file in their order, those of one file one after the other; returns how many files.

    A task holds one batch of parts, however long a file is.
    """
    return _by_parts(parts, folder).count()


def parts_written(parts: DataFrame, folder: str) -> DataFrame:
    """As :func:`write_parts`, but returns the files' paths, as a table that is written with them.

    Who reads the files needs no listing of the folder then, which the driver would hold and deal to a task for every few dozen files.
    """
    return written(_by_parts(parts, folder), "paths")


#: Paths that leave Python at once.
_PATHS = 10_000


def _by_parts(parts: DataFrame, folder: str) -> DataFrame:
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, path = _folder(folder)
        rows = (r for batch in batches for r in zip(batch["name"], batch["body"], strict=True))
        done = []
        for name, file in groupby(rows, key=lambda r: r[0]):
            with _placed(place, path, name) as out:
                for _, body in file:
                    out.write(bytes(body))
            done.append(f"{folder}/{name}")
            if len(done) >= _PATHS:
                yield pd.DataFrame({"path": done})
                done = []
        yield pd.DataFrame({"path": done}, dtype="object")

    return parts.select("name", "body").mapInPandas(write, "path string")


def is_there(folder: str):
    """A column function of (name, bytes): whether `folder` has a file of that name and size.

    Tasks ask for their own files. A listing of the folder would be held by the driver, and grows with all that is there.
    """

    @F.pandas_udf("boolean")
    def there(name: pd.Series, size: pd.Series) -> pd.Series:
        from pyarrow import fs

        place, path = fs.FileSystem.from_uri(folder)
        found = place.get_file_info([f"{path}/{x}" for x in name])
        return pd.Series([x.type == fs.FileType.File and x.size == n for x, n in zip(found, size, strict=True)], dtype="bool")

    return there.asNondeterministic()


def backup(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Copy `files` (name, kind, body) to `folder`; outcome and n: transcripts are always written, others skipped if a file of that name and size is there."""
    here = is_there(folder)(F.col("name"), F.octet_length("body").cast("long"))
    rows = files.withColumn("_here", here).withColumn("outcome", store.backup_outcome(F.col("kind"), F.col("_here"))).drop("_here")
    outcomes = [tuple(r) for r in rows.groupBy("outcome").agg(F.count("*").alias("n")).collect()]  # three at most
    write_files(rows.where("outcome <> 'skipped'"), folder)
    return spark.createDataFrame(outcomes, "outcome string, n long")


def speakers_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """stem, speaker, name of the sidecars `<stem>.speakers.json`; one that cannot be read names nobody."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.speakers.json").select(F.col("_metadata.file_name").alias("file"), "value")
    rows = files.select(F.regexp_replace(F.url_decode("file"), r"\.speakers\.json$", "").alias("stem"), F.explode(library.json_store(F.col("value"))).alias("speaker", "name"))
    return rows.where("name is not null")


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
