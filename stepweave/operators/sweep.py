"""Controlled parameter sweeps: one factor varied, all variants in one table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.operators.rewards import FULL_SHAPED, SOFA_SHAPED, SPARSE


@dataclass(frozen=True)
class Variant:
    variant_id: str
    dimension: str
    value: object


@dataclass(frozen=True)
class Setup:
    """The settings a variant may change."""

    step_hours: int = 4
    n_bins: int = 5
    flags: bool = True
    features: tuple[str, ...] | None = None
    reward: str = SOFA_SHAPED


# The five factors and their variants, baseline first
DIMENSIONS = ("reward_shaping", "action_granularity", "timestep_choice", "missingness_flags", "feature_subset")
VARIANTS = (
    Variant("reward_sofa_shaped", "reward_shaping", SOFA_SHAPED),
    Variant("reward_sparse", "reward_shaping", SPARSE),
    Variant("reward_full_shaped", "reward_shaping", FULL_SHAPED),
    Variant("action_5x5_bins", "action_granularity", 5),
    Variant("action_3x3_bins", "action_granularity", 3),
    Variant("action_7x7_bins", "action_granularity", 7),
    Variant("timestep_4h", "timestep_choice", 4),
    Variant("timestep_2h", "timestep_choice", 2),
    Variant("timestep_6h", "timestep_choice", 6),
    Variant("missingness_flags_on", "missingness_flags", True),
    Variant("missingness_flags_off", "missingness_flags", False),
    Variant("feature_subset_full_state", "feature_subset", "full_state"),
    Variant("feature_subset_clinical_core", "feature_subset", "clinical_core"),
    Variant("feature_subset_hemodynamic_core", "feature_subset", "hemodynamic_core"),
)


@dataclass(frozen=True)
class SweepPlan:
    """Variants plus the meaning of the named feature subsets."""

    base: Setup = Setup()
    variants: tuple[Variant, ...] = VARIANTS
    subsets: Mapping[str, tuple[str, ...] | None] = field(default_factory=lambda: {"full_state": None})

    def of(self, dimension: str) -> list[Variant]:
        found = [v for v in self.variants if v.dimension == dimension]
        if not found:
            raise ValueError(f"no variants for {dimension!r}")
        return found

    def setup(self, variant: Variant) -> Setup:
        """The base settings with this variant's factor changed."""
        value = variant.value
        if variant.dimension == "reward_shaping":
            return replace(self.base, reward=str(value))
        if variant.dimension == "action_granularity":
            return replace(self.base, n_bins=int(value))
        if variant.dimension == "timestep_choice":
            if int(value) <= 0:
                raise ValueError("step length must be positive")
            return replace(self.base, step_hours=int(value))
        if variant.dimension == "missingness_flags":
            if not isinstance(value, bool):
                raise TypeError("flag variants are true or false")
            return replace(self.base, flags=value)
        if variant.dimension == "feature_subset":
            return replace(self.base, features=self.subsets[str(value)])
        raise ValueError(f"unknown dimension {variant.dimension!r}")


def run_sweep(
    plan: SweepPlan,
    dimension: str,
    measure: Callable[[Setup], DataFrame],
    metrics: Sequence[str],
) -> DataFrame:
    """``variant_id, is_baseline`` and the metrics, one row per variant.

    ``measure`` maps settings to a one-row DataFrame. A variant that lacks one
    of the metrics is an error.
    """
    parts = []
    for position, variant in enumerate(plan.of(dimension)):
        measured = measure(plan.setup(variant))
        missing = [m for m in metrics if m not in measured.columns]
        if missing:
            raise ValueError(f"{variant.variant_id} lacks metrics: {missing}")
        parts.append(
            measured.select(
                F.lit(variant.variant_id).alias("variant_id"), F.lit(position == 0).alias("is_baseline"), *metrics
            )
        )
    return reduce(DataFrame.unionByName, parts)
