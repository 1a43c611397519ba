"""Run reports: metric curves, return curves, run comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.quantiles import group_quantiles
from stepweave.functions.ranking import ordered_index, trailing_mean
from stepweave.operators.baselines import episode_returns
from stepweave.session import cut_lineage


def metric_summary(
    log: DataFrame, by: Sequence[str] = ("name",), seq: str = "step", epochs: bool = False
) -> DataFrame:
    """Count, range, mean, exact median and first/last value per metric, with
    ``epochs`` also its first and last epoch.

    ``seq`` orders the points of a curve and is unique within it.
    """
    by = list(by)
    # a non-finite value is no observation
    finite = log.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    stats = finite.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.max_by("value", seq).alias("final"),
        F.min(seq).alias("first_step"),
        F.max(seq).alias("last_step"),
        *([F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch")] if epochs else []),
    )
    medians = group_quantiles(finite, by, "value", [0.5]).select(*by, F.col("q0").alias("median"))
    return stats.join(medians, by)


def epoch_summary(log: DataFrame, by: Sequence[str] = ("name", "epoch")) -> DataFrame:
    return log.groupBy(*by).agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def best_epoch(log: DataFrame, by: Sequence[str] = ("name",)) -> DataFrame:
    """Epoch with the lowest mean value per metric, the earliest on ties.

    Epochs are first reduced to one row each.
    """
    epochs = epoch_summary(log, [*by, "epoch"])
    best = epochs.groupBy(*by).agg(F.min(F.struct("mean", "epoch")).alias("_best"))
    return best.select(*by, F.col("_best.mean").alias("best_value"), F.col("_best.epoch").alias("best_epoch"))


def episode_return_curve(transitions: DataFrame, key: str = "stay_id") -> DataFrame:
    """Return per episode with its 1-based position in key order."""
    # read twice: for the edges of the rank buckets, and to rank
    returns = cut_lineage(episode_returns(transitions, key=key).select(key, "episode_return"))
    return ordered_index(returns, key, "episode_index")


def rolling_return(transitions: DataFrame, width: int = 50, key: str = "stay_id") -> DataFrame:
    """Mean return of the last ``width`` episodes, fewer at the start."""
    curve = episode_return_curve(transitions, key)
    return trailing_mean(curve, "episode_index", "episode_return", width, "rolling_return")


def final_metrics(log: DataFrame, by: Sequence[str] = ("run", "name"), seq: str = "step") -> DataFrame:
    """Last logged value of each metric of each run."""
    return log.groupBy(*by).agg(F.max_by("value", seq).alias("final_value"))


def compare_runs(
    metas: DataFrame, log: DataFrame, contract: Sequence[str], run: str = "run", seq: str = "step"
) -> DataFrame:
    """One row per run and metric with its final value and whether all runs share
    one dataset contract.
    """
    signature = metas.select(run, F.to_json(F.struct(*contract)).alias("contract"))
    runs = Window.partitionBy(F.lit(0))  # one row per run
    signature = signature.withColumn(
        "contract_consistent", F.min("contract").over(runs) == F.max("contract").over(runs)
    )
    return signature.join(final_metrics(log, [run, "name"], seq), run, "left")
