"""Transition tables: (state, action, reward, next state, done)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.scalars import number
from stepweave.functions.skew import skew_join


def build_transitions(
    merged: DataFrame, features: Sequence[str], action: str = "action_id", reward: str = "reward_total"
) -> DataFrame:
    """One row per step with array states.

    A missing or NaN feature becomes 0, the last step is its own successor, and
    a missing action fails the job.
    """
    steps = Window.partitionBy("stay_id").orderBy("step_index")
    state = F.array(*[F.coalesce(number(F.col(c)), F.lit(0.0)) for c in features])
    checked = F.coalesce(
        F.col(action).cast("int"), F.raise_error(F.lit("transition without an action")).cast("int")
    )
    keep = [c for c in ("split",) if c in merged.columns]
    rows = merged.select(
        *keep, "stay_id", "step_index", state.alias("state"), checked.alias("action"),
        F.coalesce(number(F.col(reward)), F.lit(0.0)).alias("reward"),
    )
    after = F.lead("state").over(steps)
    return rows.select(
        *keep, "stay_id", "step_index", "state", "action", "reward",
        F.coalesce(after, F.col("state")).alias("next_state"),
        after.isNull().alias("done"),
    )


def flatten(transitions: DataFrame, features: Sequence[str]) -> DataFrame:
    """Array states to ``s_*`` and ``ns_*`` columns in feature order."""
    keep = [c for c in ("split",) if c in transitions.columns]
    return transitions.select(
        *keep, "stay_id", "step_index", "action", "reward", "done",
        *[F.col("state")[i].alias(f"s_{c}") for i, c in enumerate(features)],
        *[F.col("next_state")[i].alias(f"ns_{c}") for i, c in enumerate(features)],
    )


def unflatten(flat: DataFrame, features: Sequence[str]) -> DataFrame:
    """Inverse of :func:`flatten`; the feature order is explicit, never inferred."""
    need = {"action", "reward", "done"} | {f"{p}_{c}" for c in features for p in ("s", "ns")}
    missing = sorted(need - set(flat.columns))
    if missing:
        raise ValueError(f"replay table lacks columns: {missing}")
    keep = [c for c in ("split", "stay_id", "step_index") if c in flat.columns]
    return flat.select(
        *keep,
        F.array(*[F.col(f"s_{c}") for c in features]).alias("state"), "action", "reward",
        F.array(*[F.col(f"ns_{c}") for c in features]).alias("next_state"), "done",
    )


def replay_features(flat: DataFrame) -> list[str]:
    """Feature names found in a flat replay table, alphabetically; every state
    column needs its successor column, and there must be one.
    """
    now = {c[2:] for c in flat.columns if c.startswith("s_")}
    after = {c[3:] for c in flat.columns if c.startswith("ns_")}
    if now != after or not now:
        raise ValueError(f"replay table with unpaired or no state columns: {sorted(now ^ after)}")
    return sorted(now)


def dataset_meta(
    transitions: DataFrame,
    n_actions: int = 25,
    by: Sequence[str] = (),
    description: Mapping[str, object] | None = None,
) -> DataFrame:
    """Episode and transition counts and dimensions, optionally per group.

    ``description`` adds what the rows don't show: specification versions, the
    seed of the manifest, the ordered feature columns (joined by commas), the
    split label.
    """
    per_episode = transitions.groupBy(*by, "stay_id").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.size("state")).alias("dim")
    )
    return per_episode.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_episodes"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_transitions"),
        F.max("dim").alias("state_dim"),
        F.lit(n_actions).alias("n_actions"),
        *[F.lit(value).alias(name) for name, value in (description or {}).items()],
    )


def validate_transitions(transitions: DataFrame, state_dim: int, n_actions: int = 25) -> DataFrame:
    """Violations, one row each: ``stay_id, step_index, violation``."""
    last = F.col("step_index") == F.col("_last")
    action = F.col("action")
    broken = F.array(
        F.when(last & ~F.col("done"), F.lit("last_not_done")),
        F.when(~last & F.col("done"), F.lit("early_done")),
        F.when(F.col("_dim") != state_dim, F.lit("state_dim")),
        F.when(F.col("_ndim") != state_dim, F.lit("next_state_dim")),
        F.when(action.isNull() | (action < 0) | (action >= n_actions), F.lit("action_range")),
    )
    slim = transitions.select(
        "stay_id", "step_index", "action", "done", F.size("state").alias("_dim"), F.size("next_state").alias("_ndim")
    )
    ends = slim.groupBy("stay_id").agg(F.max("step_index").alias("_last"))
    marked = skew_join(slim, ends, "stay_id").select("stay_id", "step_index", F.array_compact(broken).alias("_v"))
    return marked.select("stay_id", "step_index", F.explode("_v").alias("violation"))


def replay_layout(transitions: DataFrame) -> DataFrame:
    """Whole episodes per partition, in step order, for a parquet sink."""
    return transitions.repartition("stay_id").sortWithinPartitions("stay_id", "step_index")


def nested_episodes(transitions: DataFrame) -> DataFrame:
    """One row per episode with its ordered steps; bounded by the grid length."""
    step = F.struct("step_index", "state", "action", "reward", "next_state", "done")
    return transitions.groupBy("stay_id").agg(F.array_sort(F.collect_list(step)).alias("transitions"))
