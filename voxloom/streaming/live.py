"""Live transcription as streams: windows of sound, utterances with end rules, partial texts.

Event time is the recorder's clock, which only rises; the watermark is an addition that lets
Spark drop state.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: An utterance ends after this silence if it has words, after that if it has none, or when it is this long.
SILENCE_S, WORDLESS_S, LONGEST_S = 1.4, 2.4, 20.0
#: Characters of an utterance that the next one gets as context.
CONTEXT = 200
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds added to a clock where it becomes event time: the first watermark is 0, and what is before it would get lost. Dates of pandas end at 2262.
ORIGIN_S = 1 << 32
UTTERANCE = "user_id long, start_s double, end_s double, n long, text string"
_STATE = "start_s double, end_s double, n long, text string"
_NAMES = [x.split()[0] for x in UTTERANCE.split(", ")]


def windows(frames: DataFrame, size: str = "5 seconds", slide: str | None = None) -> DataFrame:
    """Count and mean level by window, tumbling or sliding, of frames (ts, user_id, value)."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return frames.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("level")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "level")


def count_windows(frames: DataFrame, size: int, key: str, *order: str) -> DataFrame:
    """key, window, n, level: every `size` frames of a key in order; an incomplete last window is not given out."""
    nr = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    rows = frames.withColumn("_w", F.floor(nr / size).cast("long"))
    return rows.groupBy(key, F.col("_w").alias("window")).agg(F.count("*").alias("n"), F.avg("value").alias("level")).where(F.col("n") == size)


def fold_utterances(events: list[tuple[float, str | None]], open_: tuple | None, silence_s: float = SILENCE_S, longest_s: float = LONGEST_S, wordless_s: float = WORDLESS_S) -> tuple[list[tuple], tuple | None]:
    """Utterances (start, end, n, text) that these events (second, text), in order, end; and the one still open.

    An empty text is a frame without words: it opens an utterance but is no part of its end. A null text is a
    stop: it ends what is open at once. An utterance without words is never given out.
    """
    done = []

    def close() -> None:
        if open_ and open_[3]:
            done.append(open_)

    for at, text in events:
        if open_ and (text is None or at - open_[1] >= (silence_s if open_[3] else wordless_s) or at - open_[0] >= longest_s):
            close()
            open_ = None
        if text is None:
            continue
        if open_ is None:
            open_ = (at, at, int(text != ""), text)
        elif text:
            open_ = (open_[0], at, open_[2] + 1, f"{open_[3]} {text}".strip())
    return done, open_


def _ordered(rows: pd.DataFrame) -> list[tuple[float, str | None]]:
    """Events in order of time, at one time words before a stop."""
    return sorted(zip(rows["at"], [None if x is None or x != x else x for x in rows["text"]], strict=True), key=lambda e: (e[0], e[1] is None, e[1] or ""))


class _Utterances(StatefulProcessor):
    """One user's open utterance and the end of the one before it; a timer ends the open one when the watermark passes its silence."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open, self.context = handle.getValueState("open", _STATE), handle.getValueState("context", "text string")

    def _out(self, user_id: int, done: list[tuple]) -> pd.DataFrame:
        rows, before = [], self.context.get()[0] if self.context.exists() else None
        for utterance in done:
            rows.append((user_id, *utterance, before))
            before = utterance[3][-CONTEXT:]
        if done:
            self.context.update((before,))
        return pd.DataFrame(rows, columns=[*_NAMES, "context"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        open_ = tuple(self.open.get()) if self.open.exists() else None
        done, open_ = fold_utterances(_ordered(pd.concat(list(rows))), open_)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if open_:
            self.open.update(open_)
            over = math.ceil((open_[1] + (SILENCE_S if open_[3] else WORDLESS_S)) * 1000) + ORIGIN_S * 1000
            self.handle.registerTimer(max(over, timerValues.getCurrentWatermarkInMs() + 1))
        else:
            self.open.clear()
        yield self._out(key[0], done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = [tuple(self.open.get())] if self.open.exists() else []
        self.open.clear()
        yield self._out(key[0], [x for x in done if x[3]])


def utterances(stream: DataFrame, late: str = "1 minute") -> DataFrame:
    """Utterances, with the end of the one before as context, of a stream (user_id, at in seconds or ts, text).

    A null text is a stop, which ends what is open at once. One that is still open ends when the watermark passes its silence. A user's
    clock rises from batch to batch; within a batch rows may come in any order. The state is an utterance and a context for each user.
    """
    if "at" not in stream.columns:
        stream = stream.withColumn("at", F.col("ts").cast("timestamp").cast("double"))
    rows = stream.select("user_id", "at", "text", F.timestamp_micros(F.floor(F.col("at") * 1_000_000).cast("long") + ORIGIN_S * 1_000_000).alias("ts")).withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(_Utterances(), f"{UTTERANCE}, context string", "Append", "EventTime")


@contextmanager
def stateful(spark: SparkSession, parts: int | None = None) -> Iterator[None]:
    """Settings for streams with state and timers: the store that they need, and as many parts of state as there are cores. A query keeps those with which its checkpoint began."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": _STORE, "spark.sql.shuffle.partitions": str(parts or spark.sparkContext.defaultParallelism)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def streamed_utterances(stream: DataFrame, checkpoint: str, folder: str, late: str = "1 minute") -> DataFrame:
    """Run the stream over what is there now, from its checkpoint on, and return all utterances that have ended so far, with their context.

    Batches are tables by number below `folder`, so one that is run again after a failure takes the place of its first try.
    """
    with stateful(stream.sparkSession):
        each_batch(utterances(stream, late), checkpoint, lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}"))
    return stream.sparkSession.read.schema(f"{UTTERANCE}, context string").parquet(f"{folder}/batch=*")


def batch_utterances(rows: DataFrame) -> DataFrame:
    """The same utterances of a whole table (user_id, text, and at in seconds or ts), the last one of each user included.

    Rows are sorted within partitions of users and folded as they stream by, so a task holds one open utterance, however long a user speaks.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, open_ = None, None
        for batch in batches:
            out = []
            for user_id, part in batch.groupby("user_id", sort=False, dropna=False):
                if user_id != user:
                    out += [(user, *open_)] if open_ and open_[3] else []
                    user, open_ = user_id, None
                done, open_ = fold_utterances(_ordered(part), open_)
                out += [(user_id, *u) for u in done]
            yield pd.DataFrame(out, columns=_NAMES)
        yield pd.DataFrame([(user, *open_)] if open_ and open_[3] else [], columns=_NAMES)

    if "at" not in rows.columns:
        rows = rows.withColumn("at", F.col("ts").cast("timestamp").cast("double"))
    return rows.select("user_id", "at", "text").repartition("user_id").sortWithinPartitions("user_id", "at", F.col("text").isNull(), "text").mapInPandas(fold, UTTERANCE)


def partials(stream: DataFrame) -> DataFrame:
    """user_id, n, last_ts, latest: the newest text of each user; in update mode a row is given out when it changes."""
    return stream.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), F.max_by("text", F.struct("ts", "event_id")).alias("latest"))


def replay(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return its rows (tests and bounded replays)."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    q = writer.start()
    q.awaitTermination()
    return spark.table(name)


def each_batch(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run `step` (rows, batch number) on every batch that is there now. A batch that failed is run again with its number, so steps put their output in the place of an earlier one."""
    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(step).start().awaitTermination()


def observed(stream: DataFrame, checkpoint: str, query: Callable[[], DataFrame], folder: str) -> DataFrame:
    """Run the whole `query` again whenever `stream` brings changes of its table, and return what it said last."""
    last: dict[str, str] = {}

    def again(_: DataFrame, batch: int) -> None:
        place = f"{folder}/answer-{batch}"
        query().write.mode("overwrite").parquet(place)
        last["place"] = place

    each_batch(stream, checkpoint, again)
    return stream.sparkSession.read.parquet(last["place"])


def latest_of(stream: DataFrame, key: str, order: str, checkpoint: str, folder: str) -> DataFrame:
    """Rows of an update-mode stream, for each key the last: batches are kept as tables by their number, later ones supersede."""

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    each_batch(stream, checkpoint, keep, "update")
    rows = stream.sparkSession.read.parquet(folder)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "batch")]), F.struct(order, "batch")).alias("r")).select(key, "r.*")


def isolated(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], returns: str) -> DataFrame:
    """`work` on batches of `rows`, with two more columns: a row that makes it crash comes back as json in `aside` with its `error`, the others as if it were not there.

    A batch that crashes is halved until the rows that do it stand alone. If the first half of one that crashes does not, the
    second is halved without a try. What is found of a batch leaves Python as one table.
    """
    names = [*rows.columns]
    columns = [x.split()[0] for x in returns.split(", ")]

    def tried(batch: pd.DataFrame) -> tuple[list[pd.DataFrame], list[tuple[int, str]]]:
        """What `work` makes of the rows, and the places of those that crash it, with the error."""
        done, failed, todo = [], [], [(0, len(batch), False)]
        while todo:
            a, b, crashes = todo.pop()
            if not crashes or b - a == 1:
                try:
                    done.append(work(batch.iloc[a:b]))
                    continue
                except Exception as e:  # whatever a row does to `work` is what this is about
                    if b - a == 1:
                        failed.append((a, f"{type(e).__name__}: {e}"))
                        continue
                    crashes = True
            middle = (a + b) // 2
            try:
                done.append(work(batch.iloc[a:middle]))
                todo.append((middle, b, True))
            except Exception as e:
                todo.append((middle, b, False))
                if middle - a == 1:
                    failed.append((a, f"{type(e).__name__}: {e}"))
                else:
                    todo.append((a, middle, True))
        return done, failed

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                done, failed = tried(batch[names])
                if done:
                    yield pd.concat(done, ignore_index=True).assign(aside=None, error=None)
                if failed:
                    places, errors = zip(*failed, strict=True)
                    yield pd.DataFrame({"aside": batch["_row"].iloc[list(places)].array, "error": errors}).reindex(columns=[*columns, "aside", "error"])

    return rows.withColumn("_row", F.to_json(F.struct(*names))).mapInPandas(each, f"{returns}, aside string, error string")


def worked(stream: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], returns: str, checkpoint: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Rows that `work` makes of a stream, with `attempt`, and those given up (aside, error): a row that crashes is set aside, the stream goes on, and the row is tried once more with the next batch or at the end.

    `work` gets a column `attempt`. What a batch did is a table by its number, so a batch that is run again takes the place of its first try.
    """
    spark, schema = stream.sparkSession, stream.schema
    place = lambda batch: f"{folder}/batch={batch}"

    def again(batch: int) -> DataFrame:
        """Rows that the batch set aside at their first attempt."""
        failed = spark.read.parquet(place(batch)).where("aside is not null and attempt = 0")
        return failed.select(F.from_json("aside", schema).alias("r")).select("r.*", F.lit(1).alias("attempt"))

    def step(rows: DataFrame, batch: int) -> None:
        rows = rows.withColumn("attempt", F.lit(0))
        if batch > 0:
            rows = rows.unionByName(again(batch - 1))
        found = [isolated(rows.where(f"attempt = {k}"), work, returns).withColumn("attempt", F.lit(k)) for k in (0, 1)]
        found[0].unionByName(found[1]).write.mode("overwrite").parquet(place(batch))

    each_batch(stream, checkpoint, step)
    done = spark.read.option("basePath", folder).parquet(place("*"))
    last = done.agg(F.max("batch")).first()[0]
    # what the last batch set aside waits for no other one
    isolated(again(last), work, returns).withColumn("attempt", F.lit(1)).write.mode("overwrite").parquet(f"{folder}/rest={last}")
    done = done.drop("batch").unionByName(spark.read.parquet(f"{folder}/rest={last}"))
    return done.where("aside is null").drop("aside", "error"), done.where("aside is not null and attempt = 1").select("aside", "error")


def _steps(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the steps below `folder` that were written to their end."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(f"{folder}/step=*/_SUCCESS")
    status = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found)
    return sorted(int(x.getPath().getParent().getName().removeprefix("step=")) for x in status or [])


def drained(tasks: DataFrame, charging: bool, checkpoint: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Done (with the step and the place in it) and parked tasks of a stream (recording_id, queued_at, wait_for_charger).

    Each batch is a step that takes the backlog of the step before and what is new; tasks that wait for a charger are parked unless it is
    there, and are the next step's backlog. When the charger comes and nothing new does, the backlog is a step of its own. Steps are
    tables by number, and a batch that is run again finds its step by its own number, so no task is lost or done twice.
    """
    spark = tasks.sparkSession

    def take(rows: DataFrame | None, step: int, batch: int) -> None:
        earlier = [k for k in _steps(spark, folder) if k < step]
        backlog = spark.read.parquet(f"{folder}/step={earlier[-1]}").where("parked").select(*tasks.columns) if earlier else None
        due = backlog if rows is None else rows.unionByName(backlog) if backlog is not None else rows
        found = due.withColumn("parked", F.lit(False) if charging else F.col("wait_for_charger")).withColumn("from_batch", F.lit(batch))
        # a range of the queue in each part, so that parts follow one another
        found.repartitionByRange("parked", "queued_at", "recording_id").sortWithinPartitions("parked", "queued_at", "recording_id").withColumn("at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{folder}/step={step}")

    def work(rows: DataFrame, batch: int) -> None:
        steps = _steps(spark, folder)
        again = steps and spark.read.parquet(f"{folder}/step={steps[-1]}").where(f"from_batch = {batch}").head(1)
        take(rows, steps[-1] if again else (steps or [-1])[-1] + 1, batch)

    each_batch(tasks, checkpoint, work)
    steps = _steps(spark, folder)
    if charging and steps and spark.read.parquet(f"{folder}/step={steps[-1]}").where("parked").head(1):
        take(None, steps[-1] + 1, -1)
    steps = _steps(spark, folder)
    all_ = spark.read.option("basePath", folder).parquet(*[f"{folder}/step={k}" for k in steps])
    return in_order(all_.where("not parked")), all_.where(f"parked and step = {steps[-1]}").select(*tasks.columns)


def in_order(done: DataFrame) -> DataFrame:
    """Column place: the order in which the tasks of a step were worked off, the oldest first.

    Tasks lie in parts by ranges, with `at`, their part and number in it; the parts' sizes give where each begins.
    """
    part = F.shiftright("at", 33)
    first = Window.partitionBy("step").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = done.groupBy("step", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("least"))
    parts = parts.select("step", "part", "least", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("before"))
    found = done.withColumn("part", part).join(parts, ["step", "part"])
    return found.withColumn("place", F.col("before") + F.col("at") - F.col("least") + 1).drop("part", "least", "before", "at", "from_batch", "parked")
