"""Training logs as streams: ingest, step roll-up, windows, joins and a stateful early stop."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "run string, epoch int, step int, ts timestamp, metric double"
STOP = "run string, step long, metric double, best double, streak int, should_stop boolean, reason string"


def read_log(spark: SparkSession, path: str, schema: str = LOG) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def step_rollup(log: DataFrame) -> DataFrame:
    return log.groupBy("epoch", "step").agg(F.avg("metric").alias("metric_mean"), F.max("metric").alias("metric_max"), F.count(F.lit(1)).alias("n"))


def windows(log: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling (or sliding) means by event time; rows later than `late` are dropped."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width, slide or width)).agg(F.avg("metric").alias("metric_mean"), F.count(F.lit(1)).alias("n"))


def sessions(log: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    return log.withWatermark("ts", late).groupBy("run", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.max("metric").alias("metric_max"))


def join_steps(log: DataFrame, steps: DataFrame) -> DataFrame:
    """A streamed log with a static table of steps on (epoch, step)."""
    return log.join(steps, ["epoch", "step"], "left")


def decide(best: float | None, streak: int, n: int, metric: float, threshold: float, patience: int, warmup: int) -> tuple[float, int, bool, str]:
    """State and verdict after evaluation number n."""
    if best is None or metric > best:
        return metric, 0, False, "new_best"
    if metric == best:
        return best, 0, False, "matched_best"
    if n <= warmup:
        return best, 0, False, "warmup_baseline"
    if best - metric >= threshold:
        stop = streak + 1 >= patience
        return best, streak + 1, stop, "significant_drop_stop" if stop else "significant_drop"
    return best, 0, False, "within_tolerance"


def decide_all(best: float | None, streak: int, n: int, metric, threshold: float, patience: int, warmup: int) -> tuple:
    """Arrays of best, streak, stop and reason after each of the metrics (an array), taken in order by decide's rule after n
    evaluations. NaN is above all numbers, as in SQL, and a fall from it counts as a drop."""
    import numpy as np

    before = np.concatenate(([metric[0] if best is None else best], metric))
    before = np.maximum.accumulate(before)[:-1]
    after, nan = np.maximum(before, metric), np.isnan(before)
    new, same = (metric > before) | (np.isnan(metric) & ~nan), (metric == before) | (np.isnan(metric) & nan)
    if best is None:
        new[0] = True
    i = np.arange(len(metric))
    warm = n + 1 + i <= warmup
    fell = ~new & ~same & ~warm & ((before - metric >= threshold) | nan)
    calm = np.maximum.accumulate(np.where(fell, -1 - streak, i))
    streaks = np.where(fell, i - calm, 0).astype("int32")
    stop = fell & (streaks >= patience)
    reasons = np.array(["within_tolerance", "significant_drop", "significant_drop_stop", "warmup_baseline", "matched_best", "new_best"], dtype=object)
    return after, streaks, stop, reasons[np.select([new, same, warm, stop, fell], [5, 4, 3, 2, 1], 0)]


def early_stop(log: DataFrame, threshold: float = 0.01, patience: int = 2, warmup: int = 3) -> DataFrame:
    """Early-stop state of each run as its evaluations arrive. Within a batch they are taken by step; a row whose step
    isn't above the last one seen of its run comes too late and is left out."""
    import pandas as pd

    def update(key: tuple, frames: Iterator, state) -> Iterator:
        best, streak, n, last = state.get if state.exists else (None, 0, 0, -1)
        out = []
        for step, metric in sorted((int(s), float(m)) for f in frames for s, m in zip(f["step"], f["metric"], strict=True)):
            if step <= last:
                continue
            n, last = n + 1, step
            best, streak, stop, reason = decide(best, streak, n, metric, threshold, patience, warmup)
            out.append((key[0], step, metric, best, streak, stop, reason))
        state.update((best, streak, n, last))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in STOP.split(", ")])

    return log.groupBy("run").applyInPandasWithState(update, STOP, "best double, streak int, n int, last long", "append", "NoTimeout")
