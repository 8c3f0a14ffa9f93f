"""Keyed stores under replay, evaluations out of order, two streamed logs."""

import json
import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.operators import logs
from rankloom.streaming import logs as stream
from rankloom.streaming import stores

START = datetime(2024, 1, 1)
LOG = "run string, epoch int, step int, ts timestamp, metric double"


def put_file(spark, rows, path, schema=LOG):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)


def roll(spark, path):
    return stream.step_rollup(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(path))


def plain(df):
    return sorted((r["epoch"], r["step"], round(r["metric_mean"], 9), r["metric_max"], r["n"]) for r in df.collect())


def test_rollup_in_update_mode_survives_a_restart(spark, tmp_path):
    log, store, c = str(tmp_path / "log"), str(tmp_path / "store"), str(tmp_path / "c")
    row = lambda e, s, m: ("r", e, s, START, m)
    put_file(spark, [row(1, 1, 1.0), row(1, 2, 5.0)], log)
    put_file(spark, [row(1, 1, 4.0)], log)  # two batches touch (1, 1)

    def start(fail_at=None):
        real, calls = roll(spark, log), []
        if fail_at is None:
            stores.upsert(real, store, c).awaitTermination()
            return

        def put(batch, i):
            batch.write.mode("overwrite").parquet(f"{store}/batch={2 * i}")
            calls.append(i)
            if i == fail_at:
                raise RuntimeError("killed after the write, before the batch is committed")

        with pytest.raises(Exception, match="killed"):
            real.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", c).trigger(availableNow=True).start().awaitTermination()

    start(fail_at=1)
    put_file(spark, [row(2, 1, 7.0), row(1, 2, 1.0)], log)
    start()
    schema = roll(spark, log).schema
    want = plain(stream.step_rollup(spark.read.schema(LOG).json(log)))
    assert plain(stores.stored(spark, store, ["epoch", "step"], schema)) == want
    stores.fold(spark, store, ["epoch", "step"], schema)
    assert plain(stores.stored(spark, store, ["epoch", "step"], schema)) == want
    put_file(spark, [row(1, 1, 100.0)], log)
    start()
    assert plain(stores.stored(spark, store, ["epoch", "step"], schema)) == plain(stream.step_rollup(spark.read.schema(LOG).json(log)))


def test_evaluations_in_any_order_give_the_batch_rows(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(run, 1, s, START + timedelta(minutes=10 * s), round(rnd.random() * 10, 3)) for run in ("a", "b") for s in range(40)]
    rows.append(rows[5])  # a repeated row
    log = str(tmp_path / "log")
    for k in range(0, 40, 8):  # within a file any order; files overlap by less than the watermark
        some = [r for r in rows if k - 3 <= r[2] < k + 5 or (k == 32 and r[2] >= 37)]
        rnd.shuffle(some)
        put_file(spark, some, log)
        rows = [r for r in rows if r not in some]
    put_file(spark, [(run, 1, 99, START + timedelta(days=2), None) for run in ("a", "b")], log)
    every = spark.read.schema(LOG).json(log)
    out, c = str(tmp_path / "out"), str(tmp_path / "c")
    source = lambda: spark.readStream.schema(LOG).option("maxFilesPerTrigger", 2).json(log)
    stop = stores.ordered_early_stop(source(), "3 hours", threshold=2.0)
    stop.writeStream.format("parquet").option("path", out).option("checkpointLocation", c).trigger(availableNow=True).start().awaitTermination()
    cols = ["run", "step", "metric", "best", "streak", "should_stop", "reason"]
    got = sorted(map(tuple, spark.read.schema(stop.schema).parquet(out).select(cols).collect()))
    want = sorted(map(tuple, logs.early_stop(every, "run", "step", "metric", 2.0).select(cols).collect()))
    assert len(want) == 81 and got == want


STATES = ["run", "step", "metric", "best", "streak", "should_stop", "reason"]


def stopped(spark, tmp_path, log, late="1 hour", **rule):
    """Rows of the stream and of the batch operator over the files of log, one file a batch, and the query's progress."""
    out = str(tmp_path / "out")
    stop = stores.ordered_early_stop(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(log), late, **rule)
    q = stop.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c").trigger(availableNow=True).start()
    q.awaitTermination()
    plain = lambda df: sorted(map(tuple, df.select(STATES).collect()), key=str)
    want = logs.early_stop(spark.read.schema(LOG).json(log), "run", "step", "metric", *rule.values())
    return plain(spark.read.schema(stop.schema).parquet(out)), plain(want), [json.loads(p.json) for p in q.recentProgress]


def test_evaluations_are_held_in_few_values_and_timers(spark, tmp_path):
    rnd, log = random.Random(3), str(tmp_path / "log")
    rows = [(run, 1, s, START + timedelta(minutes=s), round(rnd.random() * 10, 3)) for run in ("a", "b") for s in range(3000)]
    rnd.shuffle(rows)
    put_file(spark, rows, log)
    put_file(spark, [(run, 1, 9999, START + timedelta(days=9), None) for run in ("a", "b")], log)
    got, want, progress = stopped(spark, tmp_path, log, threshold=2.0)
    assert len(want) == 6000 and got == want
    custom = [op["customMetrics"] for p in progress for op in p["stateOperators"]]
    assert 1 <= sum(m["numRegisteredTimers"] for m in custom) <= 8
    assert sum(m["rocksdbPutCount"] for m in custom) < 200


def test_time_zones_do_not_move_the_watermark(spark, tmp_path):
    zone, log = spark.conf.get("spark.sql.session.timeZone"), str(tmp_path / "log")
    row = lambda s: ("r", 1, s, START + timedelta(minutes=10 * s), float(s * 7 % 11))
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        for some in ([0, 1, 2, 3, 5, 6, 8], [4, 7, 9, 10], [1000]):  # 4 and 7 come after 8, within 3 hours
            put_file(spark, [row(s) for s in some], log)
        got, want, _ = stopped(spark, tmp_path, log, "3 hours", threshold=2.0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert len(want) == 12 and got == [r for r in want if r[1] < 1000]


def test_values_that_are_no_numbers_count_as_greatest(spark, tmp_path):
    log = str(tmp_path / "log")
    values = {"a": [3.0, 1.0, float("nan"), 2.0, float("nan"), 9.0, 8.0], "b": [5.0, 5.0, 1.0, 1.0, 1.0, 7.0, -1.0], None: [1.0, 2.0]}
    put_file(spark, [(run, 1, s, START + timedelta(minutes=s), v) for run, some in values.items() for s, v in enumerate(some)], log)
    put_file(spark, [("z", 1, 0, START + timedelta(days=2), 0.0)], log)
    got, want, _ = stopped(spark, tmp_path, log, threshold=2.0)
    assert len(want) == 17 and [str(r) for r in got] == [str(r) for r in want if r[0] != "z"]


class Store(dict):
    """A state variable in memory."""

    def get(self, key=()):
        return dict.get(self, key)

    def update(self, value):
        self[()] = value

    def getValue(self, key):
        return self[key]

    updateValue, removeKey, iterator = dict.__setitem__, dict.__delitem__, dict.items


class Handle:
    def __init__(self):
        self.timers, self.states = set(), {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Store())

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


@pytest.mark.parametrize("seed", range(6))
def test_strands_and_pieces_merge_in_order(monkeypatch, seed):
    """Batches in any order within ten minutes, in strands of 40 rows and pieces of 7, equal decide row by row."""
    rnd = random.Random(seed)
    for name, size in (("STRAND", 40), ("PIECE", 7), ("BLOCK", 5)):
        monkeypatch.setattr(stores, name, size)
    rows = [(t // 3 * 4, float(rnd.randrange(8)), t // 3) for t in range(900)]  # step, metric, minute; three of a step
    rows.sort(key=lambda r: r[2] + rnd.random() * 10)
    rule = (2.0, 2, 3)
    it, handle, got, wm = stores.InOrder(*rule), Handle(), [], 0
    it.init(handle)

    def passes(to):
        while due := [t for t in handle.timers if t <= to]:
            assert len(handle.timers) == 1
            for frame in it.handleExpiredTimer(("r",), SimpleNamespace(getCurrentWatermarkInMs=lambda: to), None):
                got.extend(map(tuple, frame.values.tolist()))
            handle.timers -= set(due)

    at = 0
    while at < len(rows):
        some = rows[at : at + rnd.choice([1, 3, 30, 200])]
        at += len(some)
        arrow = pa.RecordBatch.from_pydict(
            {"run": ["r"] * len(some), "ts": [START + timedelta(minutes=r[2]) for r in some], "minute": [r[2] for r in some], "step": [r[0] for r in some], "metric": [r[1] for r in some]})
        frames = [b.to_pandas() for b in stores.blocks(iter([arrow]))]
        list(it.handleInputRows(("r",), iter(frames), None))
        wm = max(wm, max(r[2] for r in some) - 10)
        passes(wm * 60_000)
    ends = [b.to_pandas() for b in stores.blocks(iter([pa.RecordBatch.from_arrays([pa.array(["r"]), pa.array([START]), pa.array([5000]), pa.array([0]), pa.array([None], "double")], ["run", "ts", "minute", "step", "metric"])]))]
    list(it.handleInputRows(("r",), iter(ends), None))
    passes(6000 * 60_000)
    want, best, streak = [], None, 0
    for n, (step, metric, _) in enumerate(sorted(rows), 1):
        best, streak, stop, reason = stream.decide(best, streak, n, metric, *rule)
        want.append(("r", step, metric, best, streak, stop, reason))
    assert got == want
    assert not handle.timers and not any(handle.states.values())  # an ended run leaves nothing


def test_two_streamed_logs_merge_like_tables(spark, tmp_path):
    left_schema, right_schema = "epoch int, step int, ts timestamp, loss double, kept double", "epoch int, step int, ts timestamp, loss double, gap double"
    at = lambda s: START + timedelta(minutes=s)
    left = [(1, s, at(s), float(s), 1.0) for s in range(30)]
    right = [(1, s, at(s + 5), None if s % 4 == 0 else s * 10.0, s / 2) for s in range(0, 30, 2)]
    end = START + timedelta(days=3)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for k in range(2):
        put_file(spark, left[k::2], a, left_schema)
        put_file(spark, right[1 - k :: 2], b, right_schema)
    put_file(spark, [(-1, 0, end, None, None)], a, left_schema)
    put_file(spark, [(-2, 0, end, None, None)], b, right_schema)
    read = lambda p, s: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).json(p)
    merged = stores.merge_logs(read(a, left_schema), read(b, right_schema))
    out = str(tmp_path / "out")
    merged.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c").trigger(availableNow=True).start().awaitTermination()
    cols = ["epoch", "step", "loss", "kept", "gap"]
    got = sorted(map(tuple, spark.read.schema(merged.schema).parquet(out).where("epoch > 0").select(cols).collect()), key=str)
    want = logs.merge_steps(spark.createDataFrame(left, left_schema).drop("ts"), spark.createDataFrame(right, right_schema).drop("ts"))
    assert got == sorted(map(tuple, want.select(cols).collect()), key=str) and len(got) == 30
