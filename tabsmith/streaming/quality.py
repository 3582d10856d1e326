"""Quality monitoring on streams. Each job gives the rows of its batch twin on the same input."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tabsmith.session import scratch_path


def read_files(spark: SparkSession, folder: str, glob: str, schema, per_trigger: int | None = None) -> DataFrame:
    """Stream over the Parquet files of a folder."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(folder)


def run_to_end(stream: DataFrame, mode: str, sink: Callable | None = None, folder: str | None = None) -> DataFrame:
    """Process everything available into Parquet and read the result back.

    `_batch` tells the micro-batch, so that the newest version of an updated row can be kept. With the `folder`
    of an earlier run, which holds its results and its checkpoint, the stream goes on where that run ended.
    """
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, "stream")
    out, state = f"{folder}/out", f"{folder}/state"

    def write(batch: DataFrame, batch_id: int) -> None:
        (sink(batch) if sink else batch).withColumn("_batch", F.lit(batch_id)).write.mode(
            "overwrite"
        ).parquet(f"{out}/part={batch_id}")

    q = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.parquet(out).drop("part")


def newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last version per key of an update-mode result."""
    rest = [c for c in updates.columns if c not in keys and c != "_batch"]
    row = F.max_by(F.struct(*rest), "_batch")
    return updates.groupBy(*keys).agg(row.alias("_r")).select(*keys, "_r.*")


def limits(batch: DataFrame, key: str, value: str, k: float = 3.0) -> DataFrame:
    """Process mean and control limits per characteristic from a batch table."""
    return batch.groupBy(F.col(key).alias("_key")).agg(
        F.avg(value).alias("centre"),
        (F.avg(value) - k * F.stddev_samp(value)).alias("lower"),
        (F.avg(value) + k * F.stddev_samp(value)).alias("upper"),
    )


def ledger(rows: DataFrame, process: DataFrame, key: str, value: str) -> DataFrame:
    """Measurements with their deviation and an out-of-limit flag; same code for batch and stream.

    The limit table has one row per characteristic; the stream side is never shuffled for it when
    Spark broadcasts it by size.
    """
    j = rows.join(process, F.col(key) == F.col("_key")).drop("_key")
    return j.withColumns(
        {
            "deviation": F.col(value) - F.col("centre"),
            "out_of_limits": (F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper")),
        }
    ).drop("centre", "lower", "upper")


def ledger_counts(flagged: DataFrame, ts: str, key: str, width: str, delay: str | None) -> DataFrame:
    src = flagged.withWatermark(ts, delay) if delay else flagged
    return (
        src.groupBy(F.window(ts, width), key)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("out_of_limits").alias("out"))
        .select(F.col("window.start").alias("start"), key, "n", "out")
    )


def windowed_capability(
    rows: DataFrame, ts: str, key: str, value: str, lsl: float, usl: float, width: str, slide: str,
    delay: str | None,
) -> DataFrame:
    """Mean, deviation and Ppk per sliding window and characteristic."""
    src = rows.withWatermark(ts, delay) if delay else rows
    g = src.groupBy(F.window(ts, width, slide), key).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    ppk = F.least(
        F.try_divide(F.lit(usl) - F.col("mean"), 3 * F.col("sd")),
        F.try_divide(F.col("mean") - F.lit(lsl), 3 * F.col("sd")),
    )
    return g.select(F.col("window.start").alias("start"), key, "n", "mean", "sd", ppk.alias("ppk"))


def score(stream: DataFrame, model: PipelineModel) -> DataFrame:
    return model.transform(stream)


MR_OUT = "key string, ts timestamp, id long, value double, mr double, late long"
MR_KEPT = "last double, passed long, late long, earliest array<long>"
MR_ROW = "at long, id long, value double"
#: Lists of pending rows a key; a slot of time goes to list `slot % RING`.
RING = 16
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class MovingRange(StatefulProcessor):
    """Holds rows until the watermark passes them, then emits them in order of time and id.

    Pending rows lie in RING lists by slot of time. Arrivals are appended to their list; a release reads the
    lists of the slots that have come due and writes back what is younger than the watermark, so one slot's rows
    a batch. Beside the lists a key keeps its last value, the time up to which it was released, the count of late
    rows and the earliest time in each list, for which a timer stands.
    """

    def __init__(self, width: int):
        self.width = width  # microseconds of a slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", MR_KEPT)
        self.lists = [handle.getListState(f"slot{i}", MR_ROW) for i in range(RING)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, passed, late, earliest = self._load()
        for pdf in rows:
            at = pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            fresh = np.ones(len(at), bool) if passed is None else at > passed
            late += int((~fresh).sum())
            at, pdf = at[fresh], pdf[fresh]
            place = at // self.width % RING
            for i in np.unique(place).tolist():
                here = place == i
                cells = zip(at[here].tolist(), pdf["id"][here], pdf["value"][here])
                self.lists[i].appendList([(t, _or_none(n, int), _or_none(v, float)) for t, n, v in cells])
                first = int(at[here].min())
                earliest[i] = first if earliest[i] is None else min(first, earliest[i])
        yield from self._release(key, timerValues, (last, passed, late, earliest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, timerValues, self._load())

    def _load(self) -> tuple:
        if not self.kept.exists():
            return None, None, 0, [None] * RING
        last, passed, late, earliest = self.kept.get()
        return last, passed, late, list(earliest)

    def _release(self, key, timer_values, kept: tuple) -> Iterator[pd.DataFrame]:
        last, passed, late, earliest = kept
        mark = timer_values.getCurrentWatermarkInMs() * 1000
        ready: list[np.ndarray] = []
        for i in range(RING):
            if earliest[i] is None or earliest[i] > mark:
                continue
            rest, due = [], []
            for rows in _packed(self.lists[i].get()):  # a few numbers a row, never a list of all
                due.append(rows[rows["at"] <= mark])
                rest.append(rows[rows["at"] > mark])
            ready += due
            young = [r for r in rest if len(r)]
            self.lists[i].clear()
            for rows in young:
                self.lists[i].appendList(_plain(rows))
            earliest[i] = min((int(r["at"].min()) for r in young), default=None)
        rows = np.concatenate(ready) if ready else np.empty(0, PACKED)
        del ready
        if len(rows) or passed is not None:
            passed = mark if passed is None else max(passed, mark)
        rows = rows[np.lexsort((rows["value"], rows["has_value"], rows["id"], rows["has_id"], rows["at"]))]
        begun, last = last, _last(rows, last)
        self.kept.update((last, passed, late, earliest))
        pending = [t for t in earliest if t is not None]
        if pending:
            self.handle.registerTimer(-(-min(pending) // 1000))
        for i in range(0, len(rows), RELEASED):
            part = rows[i : i + RELEASED]
            before = _last(rows[:i][-1:], begun)
            value = np.where(part["has_value"], part["value"], np.nan)
            mr = np.abs(value - np.concatenate([[np.nan if before is None else before], value[:-1]]))
            # NaN stands for NULL, as rows with NaN are stored without a value
            yield pd.DataFrame(
                {
                    "key": key[0], "ts": part["at"].astype("datetime64[us]"), "id": pd.arrays.IntegerArray(part["id"].copy(), ~part["has_id"]),
                    "value": pd.arrays.FloatingArray(value, ~part["has_value"]), "mr": pd.arrays.FloatingArray(mr, np.isnan(mr)), "late": np.int64(late),
                }
            )


#: A pending row in memory, and rows that are read, written or given out at a time.
PACKED = np.dtype([("at", "i8"), ("id", "i8"), ("value", "f8"), ("has_id", "?"), ("has_value", "?")])
RELEASED = 10_000


def _packed(rows: Iterator[tuple]) -> Iterator[np.ndarray]:
    while some := list(islice(rows, RELEASED)):
        yield np.array([(at, i or 0, v or 0.0, i is not None, v is not None) for at, i, v in some], PACKED)


def _plain(rows: np.ndarray) -> list[tuple]:
    return [(at, i if has_id else None, v if has_value else None) for at, i, v, has_id, has_value in rows.tolist()]


def _last(rows: np.ndarray, before: float | None) -> float | None:
    """The value of the last row, or what was before the first."""
    if not len(rows):
        return before
    return float(rows["value"][-1]) if rows["has_value"][-1] else None


def _or_none(x, kind: type):
    return None if pd.isna(x) else kind(x)


def moving_range(stream: DataFrame, key: str, ts: str, row_id: str, value: str, delay: str) -> DataFrame:
    """Point-to-point moving range per key on out-of-order input, released as the watermark passes.

    A row that comes after its key was released beyond its time is dropped and counted in `late`; so is, by
    Spark, one behind the watermark of the batch before. Rows without a time never come due and are left out.
    A NULL (or NaN) value gives a NULL range for its row and the next, as `lag` does; rows of equal time go by
    id, then value. State lies in RocksDB, which this sets for the session's streams started from now on: it
    grows with the rows younger than the watermark only, and no batch rewrites more than the slot the watermark
    stands in. A slot is an eighth of `delay`.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    span = spark.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00 UTC' + interval {delay}) AS n").first()["n"]
    src = stream.select(
        F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"),
        F.col(row_id).cast("long").alias("id"), F.col(value).cast("double").alias("value"),
    ).where("ts IS NOT NULL").withWatermark("ts", delay)
    return src.groupBy("key").transformWithStateInPandas(
        MovingRange(max(span // 8, 1000)), MR_OUT, "append", "eventTime"
    )
