"""Patient-level splits, manifests and the leakage check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.functions.ranking import spread_rank
from stepweave.functions.skew import skew_join

# Split labels
TRAIN, VALIDATION, TEST = "train", "validation", "test"


def _check_fractions(train: float, val: float) -> None:
    if not 0 < train < 1 or not 0 < val < 1:
        raise ValueError(f"split fractions must lie in (0, 1), got {train} and {val}")
    if train + val >= 1:
        raise ValueError(f"train and validation fractions must leave a test share, got {train + val}")


def group_split(
    episodes: DataFrame, key: str = "subject_id", seed: int = 42, train: float = 0.70, val: float = 0.15
) -> DataFrame:
    """``key, split`` with every key in exactly one split.

    Keys are ordered by a seeded hash and cut at ``round(n * fraction)``, so
    the sizes are exact and a rerun gives the same assignment.
    """
    _check_fractions(train, val)
    if key not in episodes.columns:
        raise ValueError(f"episodes lack the split key {key!r}")
    ids = episodes.select(key).where(F.col(key).isNotNull()).distinct()
    n = ids.count()
    n_train, n_val = round(n * train), round(n * val)
    label = (
        F.when(F.col("rank") <= n_train, F.lit(TRAIN))
        .when(F.col("rank") <= n_train + n_val, F.lit(VALIDATION))
        .otherwise(F.lit(TEST))
    )
    return spread_rank(ids, key, seed).select(key, label.alias("split"))


def split_manifest(episodes: DataFrame, splits: DataFrame, key: str = "subject_id") -> DataFrame:
    """``key, split, stay_id, n_episodes``: one row per stay, with the key's whole count.

    The stored form has this shape whatever the size of a key.
    """
    stays = episodes.select(key, "stay_id").distinct()
    sizes = stays.groupBy(key).agg(F.count(F.lit(1)).alias("n_episodes"))
    sized = skew_join(stays, sizes.join(splits.select(key, "split"), key), key)
    return sized.select(key, "split", "stay_id", "n_episodes")


def manifest_arrays(manifest: DataFrame, key: str = "subject_id") -> DataFrame:
    """View of a manifest with one row per key: ``key, split, episode_keys, n_episodes``."""
    return manifest.groupBy(key, "split", "n_episodes").agg(
        F.array_sort(F.collect_list("stay_id")).alias("episode_keys")
    )


def split_stats(
    episodes: DataFrame, splits: DataFrame, key: str = "subject_id", outcome: str | None = None
) -> DataFrame:
    """Keys, episodes and (if given) mean outcome over keys, per split."""
    aggs = [F.count_distinct("stay_id").alias("n_episodes")]
    if outcome:
        aggs.append(F.min(outcome).cast("double").alias("_outcome"))
    per_key = episodes.groupBy(key).agg(*aggs)
    out = [
        F.count(F.lit(1)).alias("n_patients"),
        F.sum("n_episodes").alias("n_episodes"),
    ]
    if outcome:
        out.append(F.round(F.avg("_outcome"), 4).alias("mortality_rate"))
    return per_key.join(splits.select(key, "split"), key).groupBy("split").agg(*out)


def leakage_check(splits: DataFrame, key: str = "subject_id") -> DataFrame:
    """Keys found in more than one split; empty for a valid split."""
    seen = splits.groupBy(key).agg(F.count_distinct("split").alias("n_splits"))
    return seen.where(F.col("n_splits") > 1)


def attach_split(rows: DataFrame, splits: DataFrame, key: str = "subject_id") -> DataFrame:
    """Add the split label; a key without one fails the job when it is read."""
    joined = skew_join(rows, splits.select(key, "split"), key, "left")
    unknown = F.raise_error(F.concat(F.lit(f"no split for {key} "), F.col(key).cast("string"))).cast("string")
    return joined.withColumn("split", F.coalesce("split", unknown))
