"""Train-only imputation medians and z-scores."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.functions.quantiles import column_quantiles
from stepweave.functions.scalars import clip
from stepweave.operators.features import Registry

ARTIFACT_SCHEMA = "feature string, median double, mean double, scale double, clip_low double, clip_high double"


@dataclass(frozen=True)
class FeatureTransform:
    feature: str
    median: float
    mean: float
    scale: float
    clip_low: float | None
    clip_high: float | None


def _require(df: DataFrame, registry: Mapping) -> None:
    missing = [n for n in registry if n not in df.columns]
    if missing:
        raise ValueError(f"state table lacks feature columns: {missing}")


def train_rows(state: DataFrame) -> DataFrame:
    return state.where(F.col("split") == "train")


def fit_medians(train: DataFrame, registry: Registry) -> dict[str, float]:
    """Exact median per feature; a feature never seen gets its normal value or 0."""
    _require(train, registry)
    found = column_quantiles(train, list(registry), [0.5])
    return {
        name: values[0] if n else float(registry[name].normal or 0.0) for name, (n, values) in found.items()
    }


def fit_scaler(train: DataFrame, registry: Registry, medians: Mapping[str, float]) -> list[FeatureTransform]:
    """Population mean and deviation of the filled and clipped train values.

    One global aggregate for all features; a constant feature gets scale 1.
    """
    _require(train, registry)
    aggs = []
    for name, spec in registry.items():
        value = clip(F.coalesce(F.col(name), F.lit(float(medians[name]))), *spec.clip)
        aggs += [F.avg(value).alias(f"{name}__mean"), F.stddev_pop(value).alias(f"{name}__std")]
    row = train.agg(*aggs).first()
    fitted = []
    for name, spec in registry.items():
        mean, std = row[f"{name}__mean"], row[f"{name}__std"] or 0.0
        fitted.append(
            FeatureTransform(
                name,
                float(medians[name]),
                float(medians[name]) if mean is None else mean,
                1.0 if abs(std) <= 1e-12 else std,
                *(None if bound is None else float(bound) for bound in spec.clip),
            )
        )
    return fitted


def apply_scaler(state: DataFrame, fitted: list[FeatureTransform]) -> DataFrame:
    """Fill, clip and z-score the fitted features; every other column is untouched."""
    _require(state, [t.feature for t in fitted])
    scaled = {
        t.feature: (clip(F.coalesce(F.col(t.feature), F.lit(t.median)), t.clip_low, t.clip_high) - t.mean) / t.scale
        for t in fitted
    }
    return state.withColumns(scaled)


def artifact_frame(spark, fitted: list[FeatureTransform]) -> DataFrame:
    """The artifact as a table, one row per feature, ready for a JSON sink."""
    return spark.createDataFrame([tuple(asdict(t).values()) for t in fitted], ARTIFACT_SCHEMA)


def artifact_from(frame: DataFrame) -> list[FeatureTransform]:
    """Read back a stored artifact; it has one row per feature."""
    return [FeatureTransform(**row.asDict()) for row in frame.select(*FeatureTransform.__dataclass_fields__).collect()]
