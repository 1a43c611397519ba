"""Step rewards: terminal outcome plus optional shaping terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.scalars import number

# Reward variants
SPARSE, SOFA_SHAPED, FULL_SHAPED = "sparse", "sofa_shaped", "full_shaped"


@dataclass(frozen=True)
class RewardConfig:
    """Fixed default values: ±15 at the end, −0.025 per score point, floor 65."""

    variant: str = SOFA_SHAPED
    survived: float = 15.0
    died: float = -15.0
    sofa_weight: float = -0.025
    lactate_weight: float = 0.0
    map_weight: float = 0.0
    map_threshold: float = 65.0

    def __post_init__(self):
        if self.variant not in (SPARSE, SOFA_SHAPED, FULL_SHAPED):
            raise ValueError(f"unknown reward variant {self.variant!r}")


TERMS = ("terminal", "sofa_shaping", "lactate_shaping", "map_shaping")


def with_rewards(
    state: DataFrame,
    cfg: RewardConfig = RewardConfig(),
    sofa: str = "sofa_score",
    lactate: str = "lactate",
    pressure: str = "map",
    outcome: str = "mortality_90d",
) -> DataFrame:
    """Add the reward terms, their total and the terminal mark to state rows.

    An episode holds at most one row per grid step, so its window is bounded.
    Missing or NaN inputs switch their term off; an unknown outcome gives 0.
    """
    steps = Window.partitionBy("stay_id").orderBy("step_index")
    rows = state.withColumns(
        {"_sofa": number(F.col(sofa)), "_lact": number(F.col(lactate)), "_map": number(F.col(pressure))}
    ).withColumns(
        {
            "_died": F.first(outcome).over(steps),
            "_sofa0": F.lag("_sofa").over(steps),
            "_lact0": F.lag("_lact").over(steps),
            "is_terminal": F.lead("step_index").over(steps).isNull(),
        }
    )

    def gated(on: bool, term: Column) -> Column:
        return F.coalesce(term, F.lit(0.0)) if on else F.lit(0.0)

    shaped = cfg.variant in (SOFA_SHAPED, FULL_SHAPED)
    full = cfg.variant == FULL_SHAPED
    ends = F.col("is_terminal") & F.col("_died").isNotNull()
    clearance = (F.col("_lact0") - F.col("_lact")) / F.col("_lact0")
    terms = {
        "terminal": F.when(ends, F.when(F.col("_died") == 0, cfg.survived).otherwise(cfg.died)).otherwise(0.0),
        "sofa_shaping": gated(shaped, F.lit(cfg.sofa_weight) * (F.col("_sofa") - F.col("_sofa0"))),
        "lactate_shaping": gated(full, F.when(F.col("_lact0") > 0, cfg.lactate_weight * clearance)),
        "map_shaping": gated(
            full,
            F.when(F.col("_map") < cfg.map_threshold, -cfg.map_weight * (cfg.map_threshold - F.col("_map"))),
        ),
    }
    rows = rows.withColumns(terms)
    total = F.col("terminal") + F.col("sofa_shaping") + F.col("lactate_shaping") + F.col("map_shaping")
    return rows.withColumn("reward_total", total).drop("_sofa", "_lact", "_map", "_died", "_sofa0", "_lact0")


def step_rewards(state: DataFrame, cfg: RewardConfig = RewardConfig(), **columns: str) -> DataFrame:
    """Reward terms and total per step, without the state."""
    return with_rewards(state, cfg, **columns).select("stay_id", "step_index", *TERMS, "reward_total", "is_terminal")


def reward_summary(rewards: DataFrame) -> DataFrame:
    """One row: episode outcomes and the spread of the reward and its terms."""
    return rewards.agg(
        # every episode has exactly one terminal row
        F.count_if("is_terminal").alias("n_episodes"),
        F.count(F.lit(1)).alias("n_transitions"),
        F.count_if(F.col("is_terminal") & (F.col("terminal") > 0)).alias("n_survived"),
        F.count_if(F.col("is_terminal") & (F.col("terminal") < 0)).alias("n_died"),
        F.coalesce(F.avg("reward_total"), F.lit(0.0)).alias("mean_total"),
        F.coalesce(F.stddev_pop("reward_total"), F.lit(0.0)).alias("std_total"),
        F.coalesce(F.avg("sofa_shaping"), F.lit(0.0)).alias("mean_sofa_shaping"),
        F.coalesce(F.avg("terminal"), F.lit(0.0)).alias("mean_terminal"),
    )
