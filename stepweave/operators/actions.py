"""Treatment levels per step and their discrete action grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions.quantiles import column_quantiles
from stepweave.functions.scalars import action_label, bin_of, encode_action, number
from stepweave.operators.features import Placed
from stepweave.operators.grid import GridConfig, events_in_steps, intervals_in_steps


def standardise_rate(
    infusions: DataFrame,
    agents: Mapping[object, str],
    factors: Mapping[str, float],
    item: str = "itemid",
    rate: str = "rate",
    name: str = "standard_rate",
) -> DataFrame:
    """Keep the listed drugs and bring their rates to one unit.

    ``agents`` maps item to agent and ``factors`` agent to its factor. Both are
    fixed dictionaries and become literals, not a join.
    """
    agent, factor = F.lit(None).cast("string"), F.lit(0.0)
    by_agent: dict[str, list] = {}
    for key, label in agents.items():
        by_agent.setdefault(label, []).append(key)
    for label, keys in by_agent.items():
        agent = F.when(F.col(item).isin(keys), F.lit(label)).otherwise(agent)
        factor = F.when(F.col(item).isin(keys), F.lit(float(factors.get(label, 0.0)))).otherwise(factor)
    return (
        infusions.where(F.col(item).isin(list(agents)))
        .withColumn("agent", agent)
        .withColumn(name, F.coalesce(F.col(rate).cast("double"), F.lit(0.0)) * factor)
    )


def _given_intervals(
    intervals: DataFrame, episodes: DataFrame, rate: str, start: str, end: str, key: str, cfg: GridConfig
) -> DataFrame:
    rows = intervals.select(*dict.fromkeys([key, start, end, rate]))
    cut = intervals_in_steps(rows, episodes, key, start, end, cfg)
    return cut.select("stay_id", "step_index", F.col(rate).alias("value"), F.col("overlap_hours").alias("weight"))


def _given_points(
    events: DataFrame,
    episodes: DataFrame,
    amount: str,
    time: str,
    key: str,
    items: Sequence | None,
    item: str,
    cfg: GridConfig,
) -> DataFrame:
    rows = events if items is None else events.where(F.col(item).isin(list(items)))
    placed = events_in_steps(rows.select(*dict.fromkeys([key, time, amount])), episodes, key, time, cfg)
    return placed.select("stay_id", "step_index", F.col(amount).alias("value"))


def _per_step(steps: DataFrame, given: DataFrame, name: str, level: Column) -> DataFrame:
    """Aggregate rows per step. The steps are stacked onto them, so a step
    without treatment needs no join back.
    """
    stacked = steps.select("stay_id", "step_index").unionByName(given, allowMissingColumns=True)
    return stacked.groupBy("stay_id", "step_index").agg(F.coalesce(level, F.lit(0.0)).alias(name))


def interval_weighted_mean(
    intervals: DataFrame,
    episodes: DataFrame,
    steps: DataFrame,
    rate: str = "standard_rate",
    start: str = "starttime",
    end: str = "endtime",
    key: str = "stay_id",
    name: str = "vaso_dose_4h",
    cfg: GridConfig = GridConfig(),
) -> DataFrame:
    """Overlap-weighted mean rate per step: ``sum(rate·h) / sum(h)``, 0 without any.

    Concurrent intervals are averaged and idle time does not count.
    """
    given = _given_intervals(intervals, episodes, rate, start, end, key, cfg)
    mean = F.try_divide(F.sum(F.col("value") * F.col("weight")), F.sum("weight"))
    return _per_step(steps, given, name, mean)


def point_sum(
    events: DataFrame,
    episodes: DataFrame,
    steps: DataFrame,
    amount: str = "amount",
    time: str = "starttime",
    key: str = "stay_id",
    items: Sequence | None = None,
    item: str = "itemid",
    name: str = "fluid_volume_4h",
    cfg: GridConfig = GridConfig(),
) -> DataFrame:
    """Sum of the amounts that start within each step, 0 without any."""
    given = _given_points(events, episodes, amount, time, key, items, item, cfg)
    return _per_step(steps, given, name, F.sum("value"))


def treatments(
    intervals: DataFrame,
    points: DataFrame,
    episodes: DataFrame,
    items: Sequence | None = None,
    rate: str = "standard_rate",
    amount: str = "amount",
    first: str = "vaso_dose_4h",
    second: str = "fluid_volume_4h",
    cfg: GridConfig = GridConfig(),
) -> list[Placed]:
    """Both treatments as rows in steps, to be aggregated together with the events of the state."""
    rates = _given_intervals(intervals, episodes, rate, "starttime", "endtime", "stay_id", cfg)
    amounts = _given_points(points, episodes, amount, "starttime", "stay_id", items, "itemid", cfg)
    return [Placed(first, "weighted_mean", rates, 0.0), Placed(second, "sum", amounts, 0.0)]


@dataclass(frozen=True)
class ActionBins:
    """Fitted edges. ``n_bins`` counts the zero bin."""

    first_edges: tuple[float, ...]
    second_edges: tuple[float, ...]
    n_bins: int = 5
    seed: int | None = None
    n_first: int = 0
    n_second: int = 0


def fit_bins(
    train: DataFrame,
    first: str = "vaso_dose_4h",
    second: str = "fluid_volume_4h",
    n_bins: int = 5,
    seed: int | None = None,
) -> ActionBins:
    """Edges at equal shares of the positive train doses, by nearest rank.

    Equal neighbouring edges are moved apart by 1e-9.
    """
    cuts = n_bins - 1
    positive = train.select(
        *[F.when(number(F.col(c)) > 0, F.col(c).cast("double")).alias(c) for c in (first, second)]
    )
    found = column_quantiles(positive, [first, second], [i / cuts for i in range(1, cuts)], "nearest")
    edges = {}
    for column, (n, values) in found.items():
        if n < cuts:
            raise ValueError(f"{column}: {cuts} positive doses needed to fit bins, got {n}")
        apart: list[float] = []
        for value in values:
            apart.append(value if not apart or value > apart[-1] else apart[-1] + 1e-9)
        edges[column] = tuple(apart)
    return ActionBins(edges[first], edges[second], n_bins, seed, found[first][0], found[second][0])


def assign_bins(
    doses: DataFrame, bins: ActionBins, first: str = "vaso_dose_4h", second: str = "fluid_volume_4h"
) -> DataFrame:
    """Add ``vaso_bin``, ``fluid_bin`` and ``action_id``; a pure projection."""
    return doses.withColumns(
        {"vaso_bin": bin_of(F.col(first), bins.first_edges), "fluid_bin": bin_of(F.col(second), bins.second_edges)}
    ).withColumn("action_id", encode_action(F.col("vaso_bin"), F.col("fluid_bin"), bins.n_bins))


def label_actions(rows: DataFrame, action: str = "action_id", n_bins: int = 5) -> DataFrame:
    return rows.withColumn("action_label", action_label(F.col(action), n_bins))


def action_histogram(rows: DataFrame, action: str = "action_id") -> DataFrame:
    return rows.groupBy(action).agg(F.count(F.lit(1)).alias("count"))


def bins_frame(spark, bins: ActionBins) -> DataFrame:
    """The artifact as one row, ready for a JSON sink."""
    row = (list(bins.first_edges), list(bins.second_edges), bins.n_bins, bins.seed, bins.n_first, bins.n_second)
    schema = (
        "vaso_edges array<double>, fluid_edges array<double>, n_bins int, manifest_seed long, "
        "n_train_vaso_nonzero long, n_train_fluid_nonzero long"
    )
    return spark.createDataFrame([row], schema)


def bins_from(frame: DataFrame) -> ActionBins:
    row = frame.first()
    return ActionBins(
        tuple(row["vaso_edges"]), tuple(row["fluid_edges"]), row["n_bins"], row["manifest_seed"],
        row["n_train_vaso_nonzero"], row["n_train_fluid_nonzero"],
    )
