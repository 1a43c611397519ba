"""Anchor events: paired orders, threshold scores and onset assignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.scalars import hours, micros_between, order_key
from stepweave.functions.shares import with_share
from stepweave.functions.skew import skew_join

# Reasons for an unusable stay
NO_ANCHOR = "no_suspected_infection_time"
NO_SCORE = "no_sofa_increase_within_window"
OUTSIDE_STAY = "onset_outside_icu_stay"

EPOCH = "2000-01-01 00:00:00"


@dataclass(frozen=True)
class OnsetConfig:
    lookback_hours: float = 24
    lookahead_hours: float = 24
    min_score: int = 2
    grace_hours: float = 6


def suspected_anchor(
    orders_a: DataFrame, orders_b: DataFrame, key: str, time: str, max_gap_hours: float = 72
) -> DataFrame:
    """Earliest ``least(a, b)`` over all pairs of one key at most ``max_gap`` apart.

    The pairs are never formed. Time is cut into cells of the gap's width:

    * a cell holding both kinds always has a valid pair that starts at its
      earliest order, because any two of its orders are closer than the gap;
    * in a cell holding one kind, an order starts a pair exactly when it is
      within the gap of the next cell's first order of the other kind.

    Both cases need only per-cell minima, which combine map-side.
    """
    width = int(max_gap_hours * 3600 * 1_000_000)
    epoch = F.lit(EPOCH).cast("timestamp_ntz")
    cell = F.floor(micros_between(epoch, F.col("t")) / width)
    orders = (
        orders_a.select(F.col(key).alias("k"), F.col(time).alias("t"), F.lit(True).alias("is_a"))
        .unionByName(orders_b.select(F.col(key).alias("k"), F.col(time).alias("t"), F.lit(False).alias("is_a")))
        .where(F.col("k").isNotNull() & F.col("t").isNotNull())
        .withColumn("cell", cell)
    )
    cells = orders.groupBy("k", "cell").agg(
        F.min(F.when(F.col("is_a"), F.col("t"))).alias("min_a"),
        F.min(F.when(~F.col("is_a"), F.col("t"))).alias("min_b"),
    )
    # one row per cell: a key has as many as its time span holds gaps
    timeline = Window.partitionBy("k").orderBy("cell")
    both = F.col("min_a").isNotNull() & F.col("min_b").isNotNull()
    other = F.when(F.col("min_a").isNotNull(), F.lead("min_b").over(timeline)).otherwise(
        F.lead("min_a").over(timeline)
    )
    adjacent = F.lead("cell").over(timeline) == F.col("cell") + 1
    cells = cells.select(
        "k",
        "cell",
        F.when(both, F.least("min_a", "min_b")).alias("t"),
        F.when(~both & adjacent, other - hours(max_gap_hours)).alias("from_time"),
        F.min(F.when(both, F.col("cell"))).over(Window.partitionBy("k")).alias("first_both"),
    )
    inside = cells.where(F.col("cell") == F.col("first_both")).select("k", "t")
    # a later cell cannot beat the first one that holds both kinds
    earlier = F.col("first_both").isNull() | (F.col("cell") < F.col("first_both"))
    reach = cells.where(F.col("from_time").isNotNull() & earlier).select("k", "cell", "from_time")
    across = (
        skew_join(orders.select("k", "cell", "t"), reach, ["k", "cell"])
        .where(F.col("t") >= F.col("from_time"))
        .select("k", "t")
    )
    return (
        inside.unionByName(across)
        .groupBy(F.col("k").alias(key))
        .agg(F.min("t").alias("anchor_time"))
    )


def dysfunction_score(
    events: DataFrame,
    components: Mapping[str, tuple[Sequence, float]],
    keys: Sequence[str] = ("subject_id", "hadm_id", "stay_id"),
    time: str = "charttime",
    item: str = "itemid",
    value: str = "valuenum",
) -> DataFrame:
    """One point per component whose lowest value at a time is below its threshold.

    ``components`` maps a name to ``(items, threshold)``.
    """
    wanted = sorted({i for items, _ in components.values() for i in items}, key=str)
    minima = [
        F.min(F.when(F.col(item).isin(list(items)), F.col(value))).alias(f"_{name}")
        for name, (items, _) in components.items()
    ]
    points: list[Column] = [
        F.coalesce((F.col(f"_{name}") < F.lit(float(limit))).cast("int"), F.lit(0))
        for name, (_, limit) in components.items()
    ]
    rows = events.where(F.col(item).isin(wanted) & F.col(value).isNotNull())
    grouped = rows.groupBy(*keys, F.col(time).alias("charttime")).agg(*minima)
    return grouped.select(*keys, "charttime", sum(points[1:], points[0]).alias("sofa_score"))


def attach_anchor(stays: DataFrame, anchors: DataFrame, key: str = "hadm_id") -> DataFrame:
    """Stay boundaries plus the anchor of their admission (null when it has none)."""
    bounds = stays.select("stay_id", "subject_id", "hadm_id", "intime", "outtime")
    return skew_join(bounds, anchors, key, "left")


def onset_candidates_raw(stays: DataFrame, scores: DataFrame, cfg: OnsetConfig) -> DataFrame:
    """Score rows of sufficient height inside the search window around the anchor."""
    bounds = stays.where(F.col("anchor_time").isNotNull()).select("stay_id", "anchor_time")
    high = scores.where(F.col("sofa_score") >= cfg.min_score).select("stay_id", "charttime", "sofa_score")
    return skew_join(high, bounds, "stay_id").where(
        (F.col("charttime") >= F.col("anchor_time") - hours(cfg.lookback_hours))
        & (F.col("charttime") <= F.col("anchor_time") + hours(cfg.lookahead_hours))
    )


def classify_onset(stays: DataFrame, scores: DataFrame, cfg: OnsetConfig = OnsetConfig()) -> DataFrame:
    """One row per stay with its onset or the reason it has none.

    ``stays`` comes from :func:`attach_anchor`. The earliest candidate decides;
    its score breaks ties at equal times towards the lower score.
    """
    earliest = onset_candidates_raw(stays, scores, cfg).groupBy("stay_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_candidates"),
        F.min("charttime").alias("_time"),
        F.min_by("sofa_score", order_key(F.col("charttime"), F.col("sofa_score"))).alias("_score"),
    )
    onset = F.least("anchor_time", "_time")
    slack = hours(cfg.grace_hours)
    reason = (
        F.when(F.col("anchor_time").isNull(), F.lit(NO_ANCHOR))
        .when(F.col("_time").isNull(), F.lit(NO_SCORE))
        .when((onset < F.col("intime") - slack) | (onset > F.col("outtime")), F.lit(OUTSIDE_STAY))
    )
    return stays.join(earliest, "stay_id", "left").select(
        "stay_id",
        "subject_id",
        "hadm_id",
        "intime",
        "outtime",
        "anchor_time",
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        reason.alias("unusable_reason"),
        F.when(reason.isNull(), onset).alias("onset_time"),
        F.when(reason.isNull(), F.col("_score")).alias("sofa_score_at_onset"),
        F.when(reason.isNull(), F.col("_time")).alias("selected_time"),
    )


def onset_usable(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("unusable_reason").isNull()).select(
        "stay_id", "subject_id", "hadm_id", "onset_time", "sofa_score_at_onset", "n_candidates"
    )


def onset_unusable(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("unusable_reason").isNotNull()).select(
        "stay_id", "subject_id", "hadm_id", "unusable_reason", "n_candidates"
    )


def onset_candidates(
    stays: DataFrame, scores: DataFrame, classified: DataFrame, cfg: OnsetConfig = OnsetConfig()
) -> DataFrame:
    """All candidates; ``selected`` marks the one that set a usable onset."""
    chosen = classified.select("stay_id", "selected_time", F.col("sofa_score_at_onset").alias("_score"))
    rows = skew_join(onset_candidates_raw(stays, scores, cfg), chosen, "stay_id", "left")
    return rows.select(
        "stay_id",
        "anchor_time",
        F.col("charttime").alias("sofa_time"),
        "sofa_score",
        F.least("anchor_time", "charttime").alias("onset_time"),
        F.coalesce(
            (F.col("charttime") == F.col("selected_time")) & (F.col("sofa_score") == F.col("_score")), F.lit(False)
        ).alias("selected"),
    )


def onset_audit(classified: DataFrame) -> DataFrame:
    """Count and share per outcome; ``usable`` stands for a missing reason."""
    counts = classified.groupBy(F.coalesce("unusable_reason", F.lit("usable")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("episodes")
    )
    return with_share(counts, "episodes")

