"""Repairs and checks of run settings, for a table of settings (one row a run) as for one set."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Lowest allowed values (fixed values); what lies below is raised to them. A null of the last three means no limit and stays.
LEAST = {
    "num_epochs": 1, "batch_size": 1, "eval_every_steps": 1, "max_new_tokens": 1, "mrr_k": 1, "recall_k": 1, "recall_dense_k": 1, "group_size": 2, "actor_chunk_size": 1, "projection_chunk_size": 1,
    "reward_gap_threshold": 0.0, "gap_sampling_temperature_delta": 0.0, "group_temperature_stride": 0.0, "group_top_p_stride": 0.0, "min_unique_final_queries": 1, "max_regen_rounds": 0,
    "bad_format_cap": 0.0, "recall_drop_lambda": 0.0, "anchor_bonus_value": 0.0, "early_stop_patience": 1, "early_stop_degrade_patience": 1, "early_stop_warmup_evals": 0,
    "early_stop_degrade_threshold": 0.0, "max_train_queries": 0, "max_val_queries": 0, "max_steps": 1,
}
PHASES = ("phase1", "phase2")


def clamp(runs: DataFrame) -> DataFrame:
    """runs with each setting of LEAST that it has raised to its least value, max_group_size to group_size, and the names
    of those raised in `repaired`. A train_ratio outside (0, 1) or an unknown curriculum_phase is an error."""
    has = [c for c in LEAST if c in runs.columns]
    low = {c: F.col(c) < LEAST[c] for c in has}
    new = {c: F.when(low[c], F.lit(LEAST[c]).cast(runs.schema[c].dataType)).otherwise(F.col(c)) for c in has}
    if {"group_size", "max_group_size"} <= set(runs.columns):
        low["max_group_size"] = F.col("max_group_size") < new["group_size"]
        new["max_group_size"] = F.greatest("max_group_size", new["group_size"])
    if "train_ratio" in runs.columns:
        new["train_ratio"] = F.when((F.col("train_ratio") > 0) & (F.col("train_ratio") < 1), F.col("train_ratio")).otherwise(F.raise_error(F.concat(F.lit("train_ratio must be in (0, 1), got "), F.coalesce(F.col("train_ratio").cast("string"), F.lit("null")))).cast("double"))
    if "curriculum_phase" in runs.columns:
        new["curriculum_phase"] = F.when(F.col("curriculum_phase").isin(*PHASES), F.col("curriculum_phase")).otherwise(F.raise_error(F.concat(F.lit("unknown curriculum_phase "), F.coalesce("curriculum_phase", F.lit("null")))))
    repaired = F.array_compact(F.array(*[F.when(x, F.lit(c)) for c, x in low.items()]))
    return runs.select(*[new.get(c, F.col(c)).alias(c) for c in runs.columns], repaired.alias("repaired"))


def override(settings, given: dict):
    """A dataclass of settings with the values given; a null overrides nothing."""
    return replace(settings, **{k: v for k, v in given.items() if v is not None})


def first_given(*choices: Column) -> Column:
    """The override where there is one, else the next, down to the default."""
    return F.coalesce(*choices)


def upgraded(prompt_id: Column, old: str, new: str) -> Column:
    """The prompt's id, where an old default stands for the new one."""
    return F.when(prompt_id == old, new).otherwise(prompt_id)


def utc_now() -> Column:
    """The time of the query as an ISO text in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def read_text(spark: SparkSession, path: str) -> str:
    """One small file in any store that Spark reads; an error if there is none."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise FileNotFoundError(f"{path} isn't one file")
    return rows[0][0]


def check_adapter(spark: SparkSession, folder: str, name: str = "adapter_config.json") -> dict:
    """The settings of an adapter's folder; an error if the folder lacks the file or the file isn't a JSON object."""
    from pyspark.errors import AnalysisException

    try:
        found = json.loads(read_text(spark, f"{folder}/{name}"))
    except AnalysisException as e:
        raise FileNotFoundError(f"{folder} has no {name}") from e
    if not isinstance(found, dict):
        raise ValueError(f"{name} isn't an object")
    return found


def report_paths(out: str | None, run: str, folder: str = "artifacts") -> tuple[str, str]:
    """(report, history): the report's path as given, or by the run's name; the history beside it."""
    report = out or f"{folder}/{run}/report.json"
    return report, f"{report.rpartition('/')[0] or '.'}/history"
