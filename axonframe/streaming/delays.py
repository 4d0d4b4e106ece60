"""The axonal delay queue and the spike buffer as streams: event-time timers, and offsets that are read once.

Time is event time: a spike of ``t_ms`` is stamped that long after ORIGIN, since what lies at the epoch itself is late from the start. Results are written by batch into folders named
by the batch's number, and a batch that is run again after a failure replaces its folder, so each row counts once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import packs
from ..operators import blocks
from .windows import _folder

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ORIGIN = 86_400_000


def stamp(t_ms: Column) -> Column:
    """The event time of a moment in ms."""
    return F.timestamp_millis(F.floor(t_ms).cast("long") + ORIGIN)


_HELD = {"ids": np.int64, "ts": np.float64, "since": np.float64}
#: Spikes in a pack that is let go.
_PACK = 1 << 16
_PACKS = "block int, before long, part int, n int, pack binary"
#: Partitions of the state, at most.
_STATES = 16


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (neuron_id, t_ms, at) as packs in the order of time, ``at`` being that of a pack's last spike."""
    for table in packs.held(batches):
        table = table.drop_null().sort_by("t_ms").combine_chunks()
        ids, ts, at = table["neuron_id"].to_numpy(), table["t_ms"].to_numpy(), table["at"].combine_chunks()
        for k in range(0, len(ids), blocks.PACK):
            end = min(k + blocks.PACK, len(ids))
            data = packs.squeeze(ids[k:end], ts[k:end])
            yield pa.RecordBatch.from_arrays([pa.array([pc.max(at.slice(k, end - k)).as_py()], at.type), pa.array([end - k], pa.int32()), pa.array([data], pa.binary())], ["at", "n", "pack"])


def _joined(rows: Iterable, **kinds: type) -> list[np.ndarray]:
    """The columns of packs (n, pack), one after the other."""
    each = [packs.stretch(pa.py_buffer(bytes(data)), **{c: (kind, n) for c, kind in kinds.items()}) for n, data in rows]
    return [np.concatenate([e[c] for e in each]) if each else np.empty(0, kind) for c, kind in kinds.items()]


class _Queue(StatefulProcessor):
    """Spikes on their way to a block of targets; those that arrive in frames of steps that are over are let go by a timer at their end.

    A spike is held once, whatever it reaches, until the block's longest delay is over. ``since`` is the first step of a spike
    that no timer has let go, ``clock`` the watermark at the last call: what is behind it came too late.
    """

    def __init__(self, frame: int):
        self.frame = frame

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.longest, self.clock = handle.getValueState("longest", "ms double"), handle.getValueState("clock", "ms long")
        self.held = handle.getListState("held", "n int, pack binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.longest.update((float(initialState["longest"].iloc[0]),))

    def _end_of_frame(self, step: int) -> int:
        return (step // self.frame + 1) * self.frame + ORIGIN

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.longest.exists():  # no wire ends here
            return iter(())
        now, late = timerValues.getCurrentWatermarkInMs(), self.clock.get()[0] if self.clock.exists() else 0
        soonest = math.inf
        for new in rows:
            ids, ts = _joined(zip(new["n"], new["pack"]), ids=np.int64, ts=np.float64)
            known = np.floor(ts) + ORIGIN >= late
            ids, ts = ids[known], ts[known]
            if len(ids):
                self.held.appendValue((len(ids), packs.squeeze(ids, ts, np.full(len(ts), -np.inf))))
                soonest = min(soonest, math.floor(ts.min()) + 1)
        self.clock.update((now,))
        self.handle.registerTimer(now + 1)  # the next watermark is seen, whatever arrives by then
        if soonest < math.inf:
            # A timer in the past, for a spike that came late but within the delay allowed, is run at once.
            self.handle.registerTimer(self._end_of_frame(soonest))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.clock.update((now,))
        before = (now - ORIGIN) // self.frame * self.frame
        ids, ts, since = _joined(self.held.get(), **_HELD)
        if not len(ids):
            return
        order = np.argsort(ts, kind="stable")
        ids, ts, since = ids[order], ts[order], since[order]
        due = np.maximum(since, np.floor(ts) + 1) < before
        if due.any():
            gone = [x[due] for x in (ids, ts, since)]
            starts = range(0, len(gone[0]), _PACK)
            parts = [[x[k : k + _PACK] for x in gone] for k in starts]
            yield pd.DataFrame({"block": np.int32(key[0]), "before": before, "part": np.arange(len(parts), dtype=np.int32), "n": np.array([len(p[0]) for p in parts], np.int32), "pack": [packs.squeeze(*p) for p in parts]})
        left = np.maximum(np.floor(ts) + 1, np.ceil(ts + self.longest.get()[0])) >= before
        if left.any():
            ids, ts, since = ids[left], ts[left], np.maximum(since[left], before)
            self.held.put([(len(ids), packs.squeeze(ids, ts, since))])
            self.handle.registerTimer(self._end_of_frame(max(before, math.floor(ts.min()) + 1)))
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def _known(wires: DataFrame) -> DataFrame:
    ends = [F.col(c).cast("long").alias(c) for c in ("src_id", "tgt_id")]
    known = wires.select(*ends, F.coalesce("delay_ms", F.lit(0.0)).alias("delay_ms"), F.coalesce("strength", F.lit(0.0)).alias("strength"))
    return known.dropna(subset=["src_id", "tgt_id"]).filter(F.abs("delay_ms") < math.inf)


def hold_until_arrival(spikes: DataFrame, wires: DataFrame, late: str = "0 seconds", frame: int = 20) -> DataFrame:
    """(block, before, part, n, pack) of streamed ``spikes`` (neuron_id, t_ms, at): the spikes that timers let go as they arrive at a block of targets.

    ``blocks.due_arrivals`` makes of these what arrives at a target in each step of 1 ms. Spikes go in packs, once to each block
    of the targets of ``wires`` (src_id, tgt_id, delay_ms, strength), whose longest delay the state takes in with the first
    batch. They are held there until the watermark has passed the end of frames of ``frame`` ms; spikes behind the watermark are
    dropped, so ``late`` is how much disorder is allowed, and no spike comes after the frame of its arrival was let go. So each
    step of a target is let go once. A wire whose delay is no finite number brings nothing.
    """
    longest = _known(wires).groupBy(blocks.block_of("tgt_id").alias("block")).agg(F.max("delay_ms").alias("longest"))
    at = f"at {spikes.schema['at'].dataType.simpleString()}"
    sent = spikes.select("neuron_id", "t_ms", "at").mapInArrow(_pack, f"{at}, n int, pack binary").withWatermark("at", late)
    sent = sent.select(F.explode(F.sequence(F.lit(0), F.lit(blocks.BLOCKS - 1))).alias("block"), "at", "n", "pack")
    return sent.groupBy("block").transformWithStateInPandas(_Queue(frame), _PACKS, "Append", "EventTime", longest.groupBy("block"))


def _run(rows: DataFrame, home: str, fail_after: int | None = None) -> list[int]:
    """Writes what is there into ``home`` by batch, from where the last run stopped, and returns the batches' numbers.

    ``fail_after`` stops the run after that many batches were written and before the last of them counts as done.
    """
    numbers: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/rows/batch={number}")
        numbers.append(number)
        if fail_after is not None and len(numbers) == fail_after:
            raise RuntimeError("stopped between batches")

    query = rows.writeStream.outputMode("append").option("checkpointLocation", f"{home}/offsets").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return numbers


def _written(spark: SparkSession, home: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("basePath", f"{home}/rows").parquet(f"{home}/rows")


def spike_source(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """The spikes (neuron_id, t_ms) under ``path`` as a stream with their event time ``at``, so many files a batch."""
    read = spark.readStream.schema("neuron_id long, t_ms double").option("maxFilesPerTrigger", files).parquet(path)
    return read.withColumn("at", stamp(F.col("t_ms")))


def _first_wires(spark: SparkSession, wires: DataFrame, home: str) -> DataFrame:
    """The wires that the queue of ``home`` began with; they count as kept when the mark beside them is written."""
    try:
        spark.read.schema("kept boolean").parquet(f"{home}/kept")
    except AnalysisException:
        wires = _known(wires)
        wires.write.mode("overwrite").parquet(f"{home}/wires")
        spark.range(1).select(F.lit(True).alias("kept")).coalesce(1).write.mode("overwrite").parquet(f"{home}/kept")
    return spark.read.schema("src_id long, tgt_id long, delay_ms double, strength double").parquet(f"{home}/wires")


def delayed_arrivals(spark: SparkSession, path: str, wires: DataFrame, home: str, late: str = "0 seconds", frame: int = 20, fail_after: int | None = None) -> DataFrame:
    """(tgt_id, step, n, kick): all that has arrived by now, over all runs with this ``home``; spikes still on their way stay in the state.

    A queue keeps the wires that it began with. What is written is the spikes that were let go; they meet the wires when it is read.
    """
    wires = _first_wires(spark, wires, home)
    confs = {"spark.sql.streaming.stateStore.providerClass": _ROCKS}  # the provider that timers need
    confs["spark.sql.shuffle.partitions"] = str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), _STATES))  # an empty state costs a task each batch
    before = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        _run(hold_until_arrival(spike_source(spark, path), wires, late, frame), home, fail_after)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return blocks.due_arrivals(_written(spark, home, f"{_PACKS}, batch long"), wires)


def drain(spark: SparkSession, path: str, home: str, files: int = 1, fail_after: int | None = None) -> DataFrame:
    """(neuron_id, t_ms, batch): the spikes that no earlier run with this ``home`` has given.

    The offsets are the buffer's mark: what is read is cleared. All rows that were ever given are in ``home``/rows.
    """
    numbers = _run(spike_source(spark, path, files).select("neuron_id", "t_ms"), home, fail_after)
    rows = _written(spark, home, "neuron_id long, t_ms double, batch long") if numbers else spark.createDataFrame([], "neuron_id long, t_ms double, batch long")
    return rows.filter(F.col("batch").isin(numbers)) if numbers else rows


def feed(spark: SparkSession, spikes: DataFrame, path: str, parts: int, closing: bool = False) -> Iterator[int]:
    """Appends ``spikes`` to the folder ``path`` in ``parts`` stretches of time, yielding after each; ``closing`` adds a clock row of the neuron -1, which has no synapse, a day later: it lets all timers run."""
    first, last = spikes.select(F.min("t_ms")).scalar(), spikes.select(F.max("t_ms")).scalar()
    stretch = F.least(F.floor(F.coalesce(F.try_divide(F.col("t_ms") - first, last - first), F.lit(0.0)) * parts), F.lit(parts - 1))
    rows = spikes.select("neuron_id", "t_ms")
    for k in range(parts):
        rows.filter(stretch == k).coalesce(1).write.mode("append").parquet(path)
        yield k
    if closing:
        end = spikes.agg((F.coalesce(F.max("t_ms"), F.lit(0.0)) + 86_400_000.0).alias("t_ms"))
        end.select(F.lit(-1).cast("long").alias("neuron_id"), "t_ms").write.mode("append").parquet(path)


def delayed_run(spark: SparkSession, spikes: DataFrame, wires: DataFrame, parts: int = 3, frame: int = 100) -> DataFrame:
    """``delayed_arrivals`` of ``spikes`` fed as a stream in ``parts`` stretches, a run after each of them."""
    path, home = _folder(spark, "fed"), _folder(spark, "queue")
    for _ in feed(spark, spikes, path, parts, closing=True):
        delayed_arrivals(spark, path, wires, home, frame=frame)
    return delayed_arrivals(spark, path, wires, home, frame=frame)


def drained_runs(spark: SparkSession, spikes: DataFrame, parts: int = 3) -> DataFrame:
    """(neuron_id, t_ms, run): ``spikes`` as ``parts`` readers of the growing buffer get them, each what is new to it."""
    path, home, out = _folder(spark, "buffer"), _folder(spark, "drained"), None
    for k in feed(spark, spikes, path, parts):
        got = drain(spark, path, home).select("neuron_id", "t_ms", F.lit(k).cast("long").alias("run"))
        out = got if out is None else out.unionByName(got)
    return out
