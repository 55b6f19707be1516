"""Running tasks that fall silent wait again: keyed state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from zonalspark.operators.control import first_rows

#: Milliseconds of silence after which a running task waits again, what tells a running one and a waiting one.
SILENCE, RUNNING, WAITING = 30 * 60 * 1000, -1, 0


class Heartbeats(StatefulProcessor):
    """Keeps of each group of running tasks when each was heard of last, as two columns of numbers that are read and written at
    once, and one timer, for the one that falls silent first. What a group holds is bounded by the tasks that run in it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heard = handle.getValueState("heard", "tasks binary, ats binary")
        self.timer = handle.getValueState("timer", "at long")

    def running(self) -> tuple[np.ndarray, np.ndarray]:
        """Running tasks, ascending, and when they were heard of last."""
        found = self.heard.get() if self.heard.exists() else (b"", b"")
        return np.frombuffer(found[0], np.int64), np.frombuffer(found[1], np.int64)

    def keep(self, tasks: np.ndarray, ats: np.ndarray) -> None:
        if len(tasks):
            self.heard.update((tasks.tobytes(), ats.tobytes()))
        elif self.heard.exists():
            self.heard.clear()
        first = int(ats.min()) + SILENCE + 1 if len(ats) else None
        before = self.timer.get()[0] if self.timer.exists() else None
        if before != first:
            if before is not None:
                self.handle.deleteTimer(before)
                self.timer.clear()
            if first is not None:
                self.handle.registerTimer(first)
                self.timer.update((first,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own, heard = self.running()
        tasks, ats, states, new = own, heard, np.full(len(own), RUNNING), np.zeros(len(own), np.int64)
        for part in rows:
            if not len(part):
                continue
            more = [part[c].to_numpy(np.int64) for c in ("task_id", "ms", "status")]
            tasks, ats, states = (np.concatenate(pair) for pair in zip((tasks, ats, states), more, strict=True))
            new = np.concatenate([new, np.ones(len(part), np.int64)])
            # of each task the last heartbeat stays, of equal times one of this batch, and of these the greatest status
            order = np.lexsort((states, new, ats, tasks))
            last = order[np.append(tasks[order][1:] != tasks[order][:-1], True)]
            tasks, ats, states, new = tasks[last], ats[last], states[last], new[last]
        run = states == RUNNING
        self.keep(tasks[run], ats[run])
        yield pd.DataFrame({"task_id": pd.Series([], dtype="int64"), "status": pd.Series([], dtype="int32")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        tasks, ats = self.running()
        silent = ats + SILENCE < clock
        self.timer.clear()  # this one is spent
        self.keep(tasks[~silent], ats[~silent])
        yield pd.DataFrame({"task_id": tasks[silent], "status": np.full(int(silent.sum()), WAITING, np.int32)})

    def close(self) -> None:
        pass


def released(beats: DataFrame, groups: int = 64) -> DataFrame:
    """task_id, status: of a stream of heartbeats (task_id, status, at), tasks that run and are not heard of for longer than
    SILENCE of event time wait again. The watermark is the clock; task ids are dealt into groups, each with a state and a
    timer of its own. Rows without a task or a time tell nothing; a null status is none of a running task."""
    timed = beats.where("task_id is not null and at is not null").withWatermark("at", "0 seconds").withColumns({"status": F.coalesce("status", F.lit(WAITING)), "ms": F.unix_millis("at"), "grp": F.pmod(F.xxhash64("task_id"), F.lit(groups)).cast("int")})
    return timed.groupBy("grp").transformWithStateInPandas(Heartbeats(), "task_id long, status int", "Update", "EventTime")


def release_run(spark: SparkSession, source: str, target: str, groups: int = 64, files: int | None = 1) -> DataFrame:
    """task_id of all tasks that a folder of heartbeat files (Parquet, read `files` a batch, in the order of their times of
    change; None: all at once, whatever their order) shows to be
    silent. Needs the state store on RocksDB, which is set for this run."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/rows/{number:08d}")

    try:
        schema = spark.read.option("recursiveFileLookup", True).parquet(source).schema
        reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
        stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
        run = released(stream, groups).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    found = spark.read.option("recursiveFileLookup", True).schema("task_id long, status int").parquet(f"{target}/rows")
    return first_rows(found, ["task_id"], [F.asc("status")])
