"""Reward parts and other scalar scores, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RewardConfig:
    mrr_weight: float = 0.52
    recall_weight: float = 0.22
    recall_aux_weight: float = 0.16
    rank_bonus_weight: float = 0.10
    anchor: float = 0.05
    bad_format_weight: float = 0.18
    unsafe_copy_weight: float = 0.14
    overedit_weight: float = 0.08
    keyword_floor: float = 0.45
    recall_drop: float = 0.80
    mrr_k: int = 20
    recall_k: int = 20
    recall_aux_k: int = 50


def rank_bonus(rank: Column) -> Column:
    return F.when(rank.isNull(), 0.0).when(rank <= 1, 1.0).when(rank <= 3, 0.8).when(rank <= 5, 0.5).when(rank <= 10, 0.3).when(rank <= 20, 0.15).when(rank <= 50, 0.05).otherwise(0.0)


def overedit_penalty(kept: Column, floor: float) -> Column:
    return F.greatest(F.lit(0.0), floor - kept)


def recall_drop_penalty(before: Column, after: Column, factor: float) -> Column:
    return factor * F.greatest(F.lit(0.0), before - after)


def anchor_bonus(mrr: Column, recall: Column, mrr0: Column, recall0: Column, value: float, eps: float = 1e-12) -> Column:
    no_worse = (mrr >= mrr0 - eps) & (recall >= recall0 - eps)
    better = (mrr > mrr0 + eps) | (recall > recall0 + eps)
    return F.when(no_worse & better & (F.greatest(mrr, recall, mrr0, recall0) > eps), value).otherwise(0.0)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b; null if either is null or b is 0."""
    return F.try_divide(a, b)


def maybe_float(t: Column) -> Column:
    """A number, or null for what isn't one."""
    return t.try_cast("double")


def clean_format(penalty: Column) -> Column:
    return F.when(penalty == 0, 1.0).otherwise(0.0)


def clipped_objective(new: Column, old: Column, advantage: Column, eps: float = 0.2) -> Column:
    return F.zip_with(new, old, lambda n, o: F.least(F.exp(n - o) * advantage, F.least(F.greatest(F.exp(n - o), F.lit(1 - eps)), F.lit(1 + eps)) * advantage))


def sampling_schedule(n: Column, temperature: float, top_p: float, dt: float = 0.05, dp: float = 0.01) -> Column:
    """Temperature and top_p of each of n samples (at least 1): both rise by their strides up to 1.35 and 0.995. Without
    sampling (temperature 0 or below), for one sample, or where a stride isn't above 0, they stay as given."""
    one = lambda i, base, step, most: F.round(F.least(F.lit(most), base + step * i), 6) if temperature > 0 and step > 0 else F.lit(float(base))
    rising = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(one(i, temperature, dt, 1.35).alias("temperature"), one(i, top_p, dp, 0.995).alias("top_p")))
    alone = F.array(F.struct(F.lit(float(temperature)).alias("temperature"), F.lit(float(top_p)).alias("top_p")))
    return F.when(n <= 1, alone).otherwise(rising)


def retry_temperature(base: Column, step: float, turn: Column, most: float = 1.35) -> Column:
    return F.round(F.least(F.lit(most), base + step * turn), 6)


def epochs_for(max_steps: Column, rows: Column, batch: Column, least: Column) -> Column:
    """Epochs that max_steps (0: no limit) take with this many rows in batches, but no fewer than asked for."""
    a_epoch = F.greatest(F.lit(1), F.ceil(F.try_divide(rows, batch)))
    return F.when(max_steps > 0, F.greatest(least, F.ceil(max_steps / a_epoch))).otherwise(least).cast("long")


def phase_metric(phase: Column, recall: Column, mrr: Column, fallback: Column) -> Column:
    """What a phase is judged by: recall in phase1, reciprocal rank in phase2; the fallback where that is null."""
    known = F.when(phase == "phase1", recall).when(phase == "phase2", mrr)
    return F.when(phase.isin("phase1", "phase2"), F.coalesce(known, fallback)).otherwise(F.raise_error(F.concat(F.lit("unknown phase "), F.coalesce(phase, F.lit("null")))).cast("double"))


def mean_of(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def sample_loss(new: Column, old: Column, ref: Column, advantage: Column, beta: float, eps: float = 0.2) -> Column:
    """struct(loss, loss_pg, loss_kl) over the common length; null if that is 0 or the loss isn't finite."""
    n = F.least(F.size(new), F.size(old), F.size(ref))
    cut = lambda v: F.slice(v, F.lit(1), n)
    pg = -mean_of(clipped_objective(cut(new), cut(old), advantage, eps))
    kl = beta * mean_of(F.zip_with(cut(new), cut(ref), lambda a, b: a - b))
    finite = (n > 0) & ~F.isnan(pg + kl) & (F.abs(pg + kl) < float("inf"))
    return F.when(finite, F.struct((pg + kl).alias("loss"), pg.alias("loss_pg"), kl.alias("loss_kl")))
