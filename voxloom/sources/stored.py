"""Tables in a shared folder that change by commits: a change of one or several tables is seen as a whole or not at all.

A table is dealt to parts by a hash of its key. A change reads and writes only the parts in which its keys lie; the new parts go to
folders of their own, and one small file, the commit mark, then says which folder stands for each part of each table. A change
that fails before its mark leaves the old tables; of two at once the later mark is refused. Rows themselves never
pass the driver, only numbers of parts and names of folders.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxloom.operators import store

#: Parts of a table, unless it is made with another number.
PARTS = 64
_MARKS = "_commits"


class Conflict(RuntimeError):
    """Another change came first."""


class Tables:
    """The tables of a folder; those that are made get `parts` parts."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS):
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, place: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{place}")

    def _list(self, pattern: str) -> list[str]:
        path = self._path(pattern)
        return sorted(x.getPath().getName() for x in path.getFileSystem(self._conf).globStatus(path) or [])

    def state(self) -> tuple[int, dict]:
        """The number of the last commit (0: none yet), and for each table its key, parts, schema and the folder of each part that has rows."""
        marks = self._list(f"{_MARKS}/*.json")
        if not marks:
            return 0, {}
        text = self.spark.read.text(f"{self.folder}/{_MARKS}/{marks[-1]}", wholetext=True).first()[0]
        return int(marks[-1].split(".")[0]), json.loads(text)

    def _mark(self, number: int, tables: dict) -> None:
        """Put the mark in its place, which must be free."""
        new = self._path(f"{_MARKS}/.{uuid.uuid4().hex}")
        out = new.getFileSystem(self._conf).create(new)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else self._jvm.java.net.URI("file:///"), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        from py4j.protocol import Py4JJavaError

        try:
            context.rename(new, self._path(f"{_MARKS}/{number:010d}.json"), self.spark.sparkContext._gateway.new_array(rename, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"commit {number} is there already") from e
            raise

    def _write(self, name: str, rows: DataFrame, table: dict, touched: list[int] | None) -> dict:
        """`table` as it is once `rows` stand for its parts `touched` (None: all)."""
        place = f"{name}/{uuid.uuid4().hex}"
        # hot keys are split over several files, small parts share a task
        rows.withColumn("_part", _part(table["key"], table["parts"])).hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{self.folder}/{place}")
        kept = {} if touched is None else {k: v for k, v in table["at"].items() if int(k) not in touched}
        return table | {"at": kept | {x.removeprefix("_part="): f"{place}/{x}" for x in self._list(f"{place}/_part=*")}}

    def create(self, **made: tuple[DataFrame, list[str]]) -> None:
        """New tables, each of rows and a key, in one commit."""
        number, tables = self.state()
        for name, (rows, key) in made.items():
            tables[name] = self._write(name, rows, {"key": key, "parts": self.parts, "schema": rows.schema.json(), "at": {}}, None)
        self._mark(number + 1, tables)

    def read(self, name: str, parts: list[int] | None = None) -> DataFrame:
        """The rows of a table, or those of some of its parts."""
        return self._rows(self.state()[1][name], parts)

    def _rows(self, table: dict, parts: list[int] | None) -> DataFrame:
        schema = StructType.fromJson(json.loads(table["schema"]))
        places = [f"{self.folder}/{v}" for k, v in table["at"].items() if parts is None or int(k) in parts]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def change(self, **steps) -> None:
        """Change several tables in one commit.

        A step is (keys, f): `keys` holds key columns of the rows that are touched (None: all may be), f makes new rows of the old ones
        that lie in the same parts.
        """
        number, tables = self.state()
        for name, (keys, f) in steps.items():
            table = tables[name]
            touched = None if keys is None else [r[0] for r in keys.select(_part(table["key"], table["parts"])).distinct().collect()]  # at most as many as parts
            if touched != []:
                tables[name] = self._write(name, f(self._rows(table, touched)).select(*StructType.fromJson(json.loads(table["schema"])).names), table, touched)
        self._mark(number + 1, tables)

    def upsert(self, name: str, new: DataFrame, key: list[str]) -> None:
        self.change(**{name: (new, lambda old: store.upsert(old, new, key))})

    def insert_ignore(self, name: str, new: DataFrame, key: list[str]) -> None:
        self.change(**{name: (new, lambda old: store.insert_ignore(old, new, key))})

    def update(self, name: str, new: DataFrame, key: list[str], columns: list[str]) -> None:
        self.change(**{name: (new, lambda old: store.update(old, new, key, columns))})

    def delete(self, name: str, where: Column) -> None:
        self.change(**{name: (None, lambda old: store.delete(old, where))})

    def replace(self, name: str, new: DataFrame, key: list[str], keys: DataFrame | None = None) -> None:
        self.change(**{name: (new if keys is None else keys, lambda old: store.replace_set(old, new, key, keys))})

    def delete_with(self, parent: str, gone: DataFrame, key: str, **children: str) -> None:
        """Delete the rows of `parent` whose `key` is in `gone`, and those of each child table whose column (its key) points at them."""
        ids = gone.select(key).distinct()
        step = lambda column: (ids.withColumnRenamed(key, column), lambda old: store.cascade(old, column, ids, key))
        self.change(**{parent: step(key)}, **{name: step(column) for name, column in children.items()})

    def drop_unused(self) -> None:
        """Delete folders that the last commit does not name: those of earlier and of failed changes. Nobody may read an older state then."""
        _, tables = self.state()
        for name, table in tables.items():
            used = {v.split("/")[1] for v in table["at"].values()}
            for place in set(self._list(f"{name}/*")) - used:
                path = self._path(f"{name}/{place}")
                path.getFileSystem(self._conf).delete(path, True)


def _part(key: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in key]), F.lit(parts)).cast("int")
