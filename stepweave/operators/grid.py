"""Fixed-step episode grids anchored on an onset time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions.scalars import hours, micros_between
from stepweave.functions.shares import with_share
from stepweave.functions.skew import skew_join

# Truncation reason codes
NOT_TRUNCATED = "not_truncated"
DISCHARGE = "icu_discharge"
DEATH = "death"
NEAR_START = "onset_near_icu_start"


@dataclass(frozen=True)
class GridConfig:
    step_hours: int = 4
    start_hours: int = -24
    end_hours: int = 48

    @property
    def max_steps(self) -> int:
        return (self.end_hours - self.start_hours) // self.step_hours

    @property
    def step_micros(self) -> int:
        return self.step_hours * 3600 * 1_000_000


def grid_episodes(
    onsets: DataFrame, stays: DataFrame, deaths: DataFrame | None = None, cfg: GridConfig = GridConfig()
) -> DataFrame:
    """One row per episode with its window, realised step range and truncation.

    ``first_step``/``last_step`` bound the realised step indices; both are null
    for an episode without steps, which is kept.
    """
    rows = onsets.select("stay_id", "subject_id", "hadm_id", "onset_time").join(
        stays.select("stay_id", "intime", "outtime"), "stay_id"
    )
    if deaths is None:
        rows = rows.withColumn("deathtime", F.lit(None).cast("timestamp_ntz"))
    else:
        known = deaths.where(F.col("deathtime").isNotNull()).select("hadm_id", "deathtime")
        rows = skew_join(rows, known, "hadm_id", "left")
    window_start = F.col("onset_time") + hours(cfg.start_hours)
    window_end = F.col("onset_time") + hours(cfg.end_hours)
    rows = rows.withColumn("window_start", window_start).withColumn("window_end", window_end)
    rows = rows.withColumn("actual_end", F.least("window_end", "deathtime", "outtime"))

    n = cfg.max_steps
    # a step is kept when it ends after the effective start and starts before the effective end
    skipped = F.floor(micros_between(F.col("window_start"), F.col("intime")) / cfg.step_micros)
    first = F.greatest(skipped, F.lit(0))
    last = F.least(F.ceil(micros_between(F.col("window_start"), F.col("actual_end")) / cfg.step_micros) - 1, F.lit(n - 1))
    rows = rows.withColumn("_first", first.cast("int")).withColumn("_last", last.cast("int"))
    n_steps = F.greatest(F.col("_last") - F.col("_first") + 1, F.lit(0))
    rows = rows.withColumn("n_steps", n_steps.cast("int"))

    truncated = F.col("n_steps") < n
    reason = (
        F.when(~truncated, F.lit(NOT_TRUNCATED))
        .when(F.col("deathtime") < F.col("window_end"), F.lit(DEATH))
        .when(F.col("outtime") < F.col("window_end"), F.lit(DISCHARGE))
        .when(F.col("intime") > F.col("window_start"), F.lit(NEAR_START))
        .otherwise(F.lit(NOT_TRUNCATED))
    )
    has_steps = F.col("n_steps") > 0
    return rows.select(
        "stay_id",
        "subject_id",
        "hadm_id",
        "onset_time",
        "window_start",
        "window_end",
        "actual_end",
        "n_steps",
        truncated.alias("is_truncated"),
        reason.alias("truncation_reason"),
        F.when(truncated & has_steps, F.col("_last")).alias("truncation_step"),
        F.when(has_steps, F.col("_first")).alias("first_step"),
        F.when(has_steps, F.col("_last")).alias("last_step"),
    )


def grid_steps(episodes: DataFrame, cfg: GridConfig = GridConfig()) -> DataFrame:
    """One row per realised step; a map-side expansion of at most ``max_steps`` rows."""
    start = F.col("window_start") + step_offset(F.col("step_index"), cfg)
    rows = episodes.where(F.col("n_steps") > 0).select(
        "stay_id",
        "onset_time",
        "window_start",
        "actual_end",
        F.explode(F.sequence("first_step", "last_step")).alias("step_index"),
    )
    rows = rows.withColumn("step_start", start)
    return rows.select(
        "stay_id",
        "step_index",
        "step_start",
        F.least(F.col("step_start") + hours(cfg.step_hours), F.col("actual_end")).alias("step_end"),
        (F.lit(cfg.start_hours) + F.col("step_index") * cfg.step_hours).alias("hours_relative"),
        (F.col("step_start") < F.col("onset_time")).alias("is_pre_onset"),
    )


def step_offset(index: Column, cfg: GridConfig) -> Column:
    return F.make_dt_interval(F.lit(0), index * cfg.step_hours)


def grid_audit(episodes: DataFrame) -> DataFrame:
    """One row: full and truncated counts and the spread of step counts."""
    truncated = F.count_if("is_truncated")
    return episodes.agg(
        F.count(F.lit(1)).alias("total_episodes"),
        F.count_if(~F.col("is_truncated")).alias("full_length"),
        truncated.alias("truncated"),
        F.coalesce(F.round(F.try_divide(truncated, F.count(F.lit(1))) * 100, 2), F.lit(0.0)).alias("truncated_pct"),
        F.coalesce(F.round(F.avg("n_steps"), 2), F.lit(0.0)).alias("avg_steps"),
        F.coalesce(F.min("n_steps"), F.lit(0)).alias("min_steps"),
        F.coalesce(F.max("n_steps"), F.lit(0)).alias("max_steps"),
    )


def truncation_reasons(episodes: DataFrame) -> DataFrame:
    counts = (
        episodes.where("is_truncated")
        .groupBy("truncation_reason")
        .agg(F.count(F.lit(1)).alias("episodes"))
    )
    return with_share(counts, "episodes")


def events_in_steps(
    events: DataFrame,
    episodes: DataFrame,
    key: str,
    time: str,
    cfg: GridConfig = GridConfig(),
    from_window_start: bool = False,
) -> DataFrame:
    """Point events with the ``stay_id`` and ``step_index`` they fall into.

    The step is computed from the offset to the window start instead of joined
    by range. ``from_window_start`` keeps events before the first realised step,
    as running totals need them, and adds ``first_step`` to tell them apart and
    ``window_offset``, the microseconds from the window start.
    """
    bounds = episodes.where(F.col("n_steps") > 0).select(
        *dict.fromkeys([key, "stay_id"]), "window_start", "actual_end", "first_step"
    )
    rows = skew_join(events.where(F.col(time).isNotNull()), bounds, key).where(
        (F.col(time) >= F.col("window_start")) & (F.col(time) < F.col("actual_end"))
    )
    offset = micros_between(F.col("window_start"), F.col(time))
    rows = rows.withColumn("window_offset", offset).drop("window_start", "actual_end")
    rows = rows.withColumn("step_index", F.floor(F.col("window_offset") / cfg.step_micros).cast("int"))
    if from_window_start:
        return rows
    return rows.where(F.col("step_index") >= F.col("first_step")).drop("first_step", "window_offset")


def intervals_in_steps(
    intervals: DataFrame,
    episodes: DataFrame,
    key: str,
    start: str,
    end: str,
    cfg: GridConfig = GridConfig(),
) -> DataFrame:
    """Intervals cut at step borders: one row per overlapped realised step with
    the overlap in hours. An interval yields at most ``max_steps`` rows.
    """
    bounds = episodes.where(F.col("n_steps") > 0).select(
        *dict.fromkeys([key, "stay_id"]), "window_start", "actual_end", "first_step", "last_step"
    )
    rows = skew_join(intervals, bounds, key).where(
        (F.col(start) < F.col("actual_end")) & (F.col(end) > F.col("window_start"))
    )
    low = F.floor(micros_between(F.col("window_start"), F.col(start)) / cfg.step_micros)
    high = F.ceil(micros_between(F.col("window_start"), F.col(end)) / cfg.step_micros) - 1
    low = F.greatest(low, F.col("first_step")).cast("int")
    high = F.least(high, F.col("last_step")).cast("int")
    rows = rows.withColumn("_low", low).withColumn("_high", high).where(F.col("_low") <= F.col("_high"))
    rows = rows.withColumn("step_index", F.explode(F.sequence("_low", "_high")))
    step_start = F.col("window_start") + step_offset(F.col("step_index"), cfg)
    step_end = F.least(step_start + hours(cfg.step_hours), F.col("actual_end"))
    overlap = micros_between(F.greatest(step_start, F.col(start)), F.least(step_end, F.col(end))) / 3.6e9
    return (
        rows.withColumn("overlap_hours", overlap)
        .where(F.col("overlap_hours") > 0)
        .drop("window_start", "actual_end", "first_step", "last_step", "_low", "_high")
    )
