"""Streams that keep results: an updated roll-up in a keyed store, early stops in order of steps, two logs merged."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from .logs import STOP, decide_all

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STRAND, PIECE, BLOCK = 1 << 20, 1 << 15, 128  # rows (24 bytes each) of a strand, of its pieces, and of a block on the way to the state
FRESH = 0, None, None, None, None, 0, 0  # the state of a run of which nothing was seen


# ---- a keyed store in update mode ---------------------------------------------------------------

def upsert(changes: DataFrame, store: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start writing changes (a streamed aggregate, update mode: each batch has the keys it touched, with their totals so
    far) to the store. Batch i goes to a folder of its own (2 i; odd numbers are folds), over whatever an attempt at i has
    left there, so a batch that is played again after a crash changes nothing."""

    def put(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={2 * i}")

    return changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stored(spark: SparkSession, store: str, keys: list[str], schema) -> DataFrame:
    """One row for each key, of the last batch that touched it."""
    from pyspark.sql.types import LongType, StructType

    whole = StructType(list(schema.fields)).add("batch", LongType())
    rest = [c for c in schema.names if c not in keys]
    rows = spark.read.schema(whole).parquet(store)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_x")).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def fold(spark: SparkSession, store: str, keys: list[str], schema) -> None:
    """Bring the store down to one folder with every key's row, for times when no batch is being written. The fold of the
    batches up to i is written beside the store and moved in as 2 i + 1, between them and the next one; only then do they
    go. Whatever is left after a crash half way gives the same rows."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(store).getFileSystem(conf)
    batches = sorted(int(x.getPath().getName()[6:]) for x in fs.listStatus(path(store)) if x.getPath().getName().startswith("batch="))
    if len(batches) < 2:
        return
    if batches[-1] % 2 == 0:
        beside = f"{store}-fold-{batches[-1]}"
        stored(spark, store, keys, schema).write.mode("overwrite").parquet(beside)
        if not fs.rename(path(beside), path(f"{store}/batch={batches[-1] + 1}")):
            raise OSError(f"can't move {beside} into {store}")
        batches.append(batches[-1] + 1)
    for i in batches[:-1]:
        fs.delete(path(f"{store}/batch={i}"), True)


# ---- early stop in order of steps -----------------------------------------------------------------

def blocks(batches: Iterator) -> Iterator:
    """Arrow batches of run, ts, minute, step, metric as blocks of up to BLOCK rows of one run that are near in time: run,
    the latest ts, the earliest minute, and the rows' bytes (step, metric, minute). An end of a run is a block of no bytes."""
    import numpy as np
    import pyarrow as pa

    for b in (x for x in batches if x.num_rows):
        if b["minute"].null_count or b["step"].null_count:
            raise ValueError("an evaluation without a time or a step has no place in its run")
        over = b["metric"].is_null()
        runs = b["run"].dictionary_encode("encode").indices.to_numpy()
        minute, end = b["minute"].to_numpy(), over.to_numpy(zero_copy_only=False)
        by = np.lexsort((b["ts"].cast("int64").to_numpy(), end, runs))
        by_run, by_end = runs[by], end[by]
        place = np.arange(len(by))
        new = np.concatenate(([True], (by_run[1:] != by_run[:-1]) | (by_end[1:] != by_end[:-1])))
        starts = np.flatnonzero(new | by_end | ((place - np.maximum.accumulate(np.where(new, place, 0))) % BLOCK == 0))
        rows = np.column_stack((b["step"].to_numpy(), b["metric"].fill_null(0.0).to_numpy().view("int64"), minute))[by][~by_end]
        offsets = np.append((place - np.cumsum(by_end) + by_end)[starts], len(rows)).astype("int32") * 24
        packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])
        last = by[np.append(starts[1:], len(by)) - 1]
        yield pa.RecordBatch.from_arrays([b["run"].take(pa.array(last)), b["ts"].take(pa.array(last)), pa.array(minute[by[starts]]), packed], names=["run", "ts", "minute", "rows"])


class InOrder(StatefulProcessor):
    """Holds a run's evaluations until the watermark has passed their minute, then takes them in order of step (then
    metric), however they arrived. A row without a metric ends the run: once its time has passed, the state goes.

    Evaluations come in blocks and are held in strands: some STRAND rows of a batch, sorted, in pieces of up to PIECE rows
    that are each one value of the state. Those that are due are merged piece by piece, so calls to the state store go by
    pieces, and neither a batch's nor a run's rows are in memory at once. A run has one timer, for the earliest minute
    that it holds."""

    def __init__(self, threshold: float, patience: int, warmup: int):
        self.rule = threshold, patience, warmup

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "strand long, piece int", "rows binary")
        self.firsts = handle.getMapState("firsts", "strand long, piece int", "minute long")  # the earliest minute of a piece
        # The next strand; the minutes of the timer, of the run's end, and before which all is taken; the state of decide.
        self.state = handle.getValueState("state", "strand long, timer long, ends long, taken long, best double, streak int, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        strand, timer, ends, taken, *seen = self.state.get() or FRESH
        new, size, minutes = [], 0, []
        for frame in rows:
            for minute, block in zip(frame["minute"], frame["rows"], strict=True):
                if block:
                    new.append(block)
                    size += len(block)
                else:
                    ends = int(minute)
                    minutes.append(ends)
                if size >= STRAND * 24:
                    minutes += self.hold(strand, new, taken)
                    strand, new, size = strand + 1, [], 0
        if new:
            minutes += self.hold(strand, new, taken)
            strand += 1
        if minutes and (timer is None or min(minutes) < timer):
            if timer is not None:
                self.handle.deleteTimer((timer + 1) * 60_000)
            timer = min(minutes)
            self.handle.registerTimer((timer + 1) * 60_000)
        self.state.update((strand, timer, ends, taken, *seen))
        yield from ()

    def hold(self, strand: int, new: list, taken: int | None) -> list[int]:
        """Keep the blocks' rows as a strand, those of minutes that are taken apart; gives the earliest minutes."""
        import numpy as np

        rows = np.frombuffer(b"".join(new), "int64").reshape(-1, 3).T
        if taken is not None:
            rows = rows[:, rows[2] >= taken]
        rows = rows[:, np.lexsort((rows[1].copy().view("float64"), rows[0]))]
        return [self.keep((strand, i), rows[:, at : at + PIECE]) for i, at in enumerate(range(0, rows.shape[1], PIECE))]

    def keep(self, at: tuple, rows) -> int:
        first = int(rows[2].min())
        self.held.updateValue(at, (rows.tobytes(),))
        self.firsts.updateValue(at, (first,))
        return first

    def due(self, passed: int, at: tuple, firsts: dict):
        """Rows of a piece whose minute has passed; the others are kept in its place. firsts: the pieces and their earliest
        minutes, as they come to be."""
        import numpy as np

        rows = np.frombuffer(self.held.getValue(at)[0], "int64").reshape(3, -1)
        old = rows[2] < passed
        if old.all():
            self.held.removeKey(at)
            self.firsts.removeKey(at)
            del firsts[at]
        else:
            firsts[at] = self.keep(at, rows[:, ~old])
        return rows[0, old], rows[1, old].view("float64")

    def merged(self, passed: int, firsts: dict) -> Iterator:
        """Steps and metrics that are due, in order: of each strand a piece is at hand, and what isn't above the last row
        of any piece that has another after it goes."""
        import numpy as np

        left: dict = {}
        for at in sorted((at for at, first in firsts.items() if first < passed), reverse=True):
            left.setdefault(at[0], []).append(at)
        hand = {s: self.due(passed, pieces.pop(), firsts) for s, pieces in left.items()}
        while hand:
            lasts = [(int(hand[s][0][-1]), bool(np.isnan(hand[s][1][-1])), float(hand[s][1][-1])) for s in hand if left[s]]
            step, nan, metric = min(lasts, default=(None, True, 0.0))
            take = []
            for s, (steps, metrics) in list(hand.items()):
                goes = len(steps) if step is None else int(np.count_nonzero((steps < step) | ((steps == step) & (nan | (metrics <= metric)))))
                take.append((steps[:goes], metrics[:goes]))
                if goes < len(steps):
                    hand[s] = steps[goes:], metrics[goes:]
                elif left[s]:
                    hand[s] = self.due(passed, left[s].pop(), firsts)
                else:
                    del hand[s]
            steps, metrics = (np.concatenate(x) for x in zip(*take, strict=True))
            by = np.lexsort((metrics, steps))
            yield steps[by], metrics[by]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        passed = timerValues.getCurrentWatermarkInMs() // 60_000
        strand, _, ends, _, best, streak, n = self.state.get()
        names = [x.split()[0] for x in STOP.split(", ")]
        firsts = {tuple(k): v[0] for k, v in self.firsts.iterator()}
        for steps, metrics in self.merged(passed, firsts):
            state = decide_all(best, streak, n, metrics, *self.rule)
            best, streak, n = float(state[0][-1]), int(state[1][-1]), n + len(metrics)
            yield pd.DataFrame(dict(zip(names, (key[0], steps, metrics, *state), strict=True)))
        over = ends is not None and ends < passed
        if over:
            ends, best, streak, n = None, None, 0, 0
        timer = min([*firsts.values(), *([] if ends is None else [ends])], default=None)
        if timer is not None:
            self.handle.registerTimer((timer + 1) * 60_000)
        if over and timer is None:
            self.state.clear()
        else:
            self.state.update((strand, timer, ends, passed, best, streak, n))

    def close(self) -> None:
        pass


def ordered_early_stop(log: DataFrame, late: str = "1 hour", threshold: float = 0.01, patience: int = 2, warmup: int = 3) -> DataFrame:
    """Early-stop state of each run (log: run, step, ts, metric), one row for each evaluation, once the watermark has passed
    it. Evaluations may come in any order within `late`; the rows are those of the batch operator, as long as a run's
    later steps have later times. What comes later than that is dropped once its minute was taken, and may be before; a row
    with a null metric ends its run and frees its state. Rows of the last `late` wait until a later time is seen. Sets the
    session's state store to RocksDB."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = log.select("run", "ts", F.floor(F.unix_seconds("ts") / 60).alias("minute"), F.col("step").cast("long").alias("step"), F.col("metric").cast("double").alias("metric"))
    packed = rows.mapInArrow(blocks, "run string, ts timestamp, minute long, rows binary").withWatermark("ts", late)
    out = packed.groupBy("run").transformWithStateInPandas(InOrder(threshold, patience, warmup), STOP, "append", "eventTime")
    return out.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in ("metric", "best")})  # pandas has NaN for null


# ---- two logs -------------------------------------------------------------------------------------

def merge_logs(left: DataFrame, right: DataFrame, late: str = "1 hour", apart: str = "1 hour") -> DataFrame:
    """Two streamed logs (epoch, step, ts and other columns) merged on (epoch, step) like the tables of merge_steps: where a
    row matches, right's values stand for left's, nulls too; a row of left without a match comes once, with nulls. Matching
    rows lie at most `apart` from each other in time; with rows coming at most `late`, that bounds the state of both sides.
    right has one row for each key (several would each give a row); right's ts isn't kept."""
    rest = [c for c in right.columns if c not in ("epoch", "step", "ts")]
    own = [c for c in left.columns if c not in ("epoch", "step", "ts")]
    r = right.select(F.col("epoch").alias("r_epoch"), F.col("step").alias("r_step"), F.col("ts").alias("r_ts"), *[F.col(c).alias(f"r_{c}") for c in rest]).withWatermark("r_ts", late)
    near = F.expr(f"epoch = r_epoch and step = r_step and r_ts between ts - interval {apart} and ts + interval {apart}")
    out = left.withWatermark("ts", late).join(r, near, "leftOuter")
    hit = F.col("r_ts").isNotNull()
    both = [F.when(hit, F.col(f"r_{c}")).otherwise(F.col(c)).alias(c) if c in rest else F.col(c) for c in own]
    return out.select("epoch", "step", "ts", *both, *[F.col(f"r_{c}").alias(c) for c in rest if c not in own])
