"""Safety review: support, agreement with the observed actions, review cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.functions.scalars import action_label, decode_action
from stepweave.functions.skew import skew_join

# Default support thresholds
MIN_PROB, MIN_COUNT = 0.05, 10


def safety_rows(
    steps: DataFrame, support: DataFrame, state_bin: Column, subgroup: Column | None = None, key: str = "episode_id"
) -> DataFrame:
    """One review row per step with the behaviour support of the policy's action.

    An action never seen in the state's bin has support 0.
    """
    rows = steps.select(
        key,
        "step_index",
        F.col("action").alias("clinician_action"),
        "policy_action",
        state_bin.alias("state_bin"),
        (F.lit("all") if subgroup is None else subgroup).alias("subgroup"),
    )
    table = support.select("state_bin", F.col("action").alias("policy_action"), "support_prob", "support_count")
    joined = skew_join(rows, table, ["state_bin", "policy_action"], "left")
    prob = F.coalesce("support_prob", F.lit(0.0))
    checked = F.when((prob >= 0) & (prob <= 1), prob).otherwise(
        F.raise_error(F.lit("support probability outside [0, 1]")).cast("double")
    )
    return joined.select(
        key, "step_index", "clinician_action", "policy_action", "subgroup",
        checked.alias("support_prob"), F.coalesce("support_count", F.lit(0)).alias("support_count"),
    )


def _agrees() -> Column:
    return F.col("clinician_action") == F.col("policy_action")


def _low(min_prob: float, min_count: int) -> Column:
    return (F.col("support_prob") < min_prob) | (F.col("support_count") < min_count)


def _share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def agreement_summary(rows: DataFrame, min_prob: float = MIN_PROB, min_count: int = MIN_COUNT) -> DataFrame:
    low = _low(min_prob, min_count)
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        _share(_agrees()).alias("agreement_rate"),
        _share(low).alias("low_support_fraction"),
        _share(low & ~_agrees()).alias("low_support_override_fraction"),
    )


def _cells(spark, n_bins: int) -> DataFrame:
    ids = spark.range(n_bins * n_bins).select(F.col("id").cast("int").alias("action"))
    first, second = decode_action(F.col("action"), n_bins)
    return ids.select("action", first.alias("vaso_bin"), second.alias("fluid_bin"))


def _in_grid(action: Column, n_bins: int) -> Column:
    """The action id; one outside the grid, or none, fails the job."""
    wrong = F.raise_error(F.concat(F.lit("no cell for action "), F.coalesce(action.cast("string"), F.lit("null"))))
    return F.when((action >= 0) & (action < n_bins * n_bins), action).otherwise(wrong.cast("int"))


def heatmap(rows: DataFrame, action: str, n_bins: int = 5) -> DataFrame:
    """Count and share for every cell of the action grid, empty cells included."""
    counts = rows.groupBy(_in_grid(F.col(action), n_bins).alias("action")).agg(F.count(F.lit(1)).alias("_n"))
    cells = _cells(rows.sparkSession, n_bins).join(counts, "action", "left")
    cells = cells.select("vaso_bin", "fluid_bin", F.coalesce("_n", F.lit(0)).alias("count"))
    return _normalised(cells, F.col("count"))


def _normalised(cells: DataFrame, size: Column) -> DataFrame:
    everything = F.sum(size).over(Window.partitionBy(F.lit(0)))  # n_bins² rows
    return cells.withColumn("normalized", F.when(everything > 0, size / everything).otherwise(0.0))


def heatmap_matrix(cells: DataFrame, n_bins: int = 5) -> DataFrame:
    """The counts as one row per first bin and one column per second bin."""
    wide = cells.groupBy("vaso_bin").pivot("fluid_bin", list(range(n_bins))).agg(F.sum("count"))
    return wide.select("vaso_bin", *[F.col(str(i)).alias(f"fluid_{i}") for i in range(n_bins)])


def delta_heatmap(rows: DataFrame, n_bins: int = 5) -> DataFrame:
    """Policy minus observed counts per cell, scaled by the sum of absolute deltas."""
    both = rows.select(
        F.inline(
            F.array(
                F.struct(F.col("policy_action").alias("action"), F.lit(1).alias("d")),
                F.struct(F.col("clinician_action").alias("action"), F.lit(-1).alias("d")),
            )
        )
    )
    counts = both.groupBy(_in_grid(F.col("action"), n_bins).alias("action")).agg(F.sum("d").alias("_n"))
    cells = _cells(rows.sparkSession, n_bins).join(counts, "action", "left")
    cells = cells.select("vaso_bin", "fluid_bin", F.coalesce("_n", F.lit(0)).alias("delta"))
    return _normalised(cells, F.abs("delta"))


def sanity_cases(
    rows: DataFrame,
    limit: int = 10,
    min_prob: float = MIN_PROB,
    min_count: int = MIN_COUNT,
    n_bins: int = 5,
    key: str = "episode_id",
) -> DataFrame:
    """The rows most worth a manual review: disagreement first, then low support,
    then the least supported. Per-task heaps, no global sort.
    """
    ranked = rows.withColumn("low_support", _low(min_prob, min_count)).orderBy(
        _agrees(), ~F.col("low_support"), "support_prob", "support_count", key, "step_index"
    )
    return ranked.limit(limit).select(
        key,
        "step_index",
        "subgroup",
        action_label(F.col("clinician_action"), n_bins).alias("clinician_action_label"),
        action_label(F.col("policy_action"), n_bins).alias("policy_action_label"),
        "support_prob",
        "support_count",
        "low_support",
    )


def subgroup_summary(
    rows: DataFrame, min_prob: float = MIN_PROB, min_count: int = MIN_COUNT, key: str = "episode_id"
) -> DataFrame:
    """Rates, mean support and the most frequent policy action per subgroup.

    Rows are first summed per (subgroup, action), so a large subgroup is one
    partial row per task. Equal action counts go to the smaller action id.
    """
    low = _low(min_prob, min_count)
    per_action = rows.groupBy("subgroup", "policy_action").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(_agrees()).alias("agree"),
        F.count_if(low).alias("low"),
        F.sum("support_prob").alias("prob"),
        F.sum("support_count").alias("cnt"),
    )
    n = F.sum("n")
    return per_action.groupBy("subgroup").agg(
        n.alias("n_rows"),
        (F.sum("agree") / n).alias("agreement_rate"),
        (F.sum("low") / n).alias("low_support_fraction"),
        (F.sum("prob") / n).alias("mean_support_prob"),
        (F.sum("cnt") / n).alias("mean_support_count"),
        F.max_by("policy_action", F.col("n").cast("decimal(20,0)") * 100000 - F.col("policy_action")).alias(
            "dominant_policy_action"
        ),
    )


def support_warnings(
    rows: DataFrame,
    min_prob: float = MIN_PROB,
    min_count: int = MIN_COUNT,
    n_bins: int = 5,
    key: str = "episode_id",
) -> DataFrame:
    """One warning per step whose policy action is poorly supported."""
    severe = (F.col("support_prob") < min_prob / 2) | (F.col("support_count") < max(1, min_count // 2))
    label = action_label(F.col("policy_action"), n_bins)
    return rows.where(_low(min_prob, min_count)).select(
        F.when(severe, "high").otherwise("medium").alias("severity"),
        key,
        "step_index",
        "subgroup",
        label.alias("policy_action_label"),
        "support_prob",
        "support_count",
        F.format_string(
            "%s is rarely taken in such states: share %.3f, seen %d times",
            label, F.col("support_prob"), F.col("support_count"),
        ).alias("message"),
    )


def safety_review(
    rows: DataFrame, min_prob: float = MIN_PROB, min_count: int = MIN_COUNT, limit: int = 10, n_bins: int = 5,
    key: str = "episode_id",
) -> dict[str, DataFrame]:
    """All review tables, lazily, by name."""
    return {
        "agreement": agreement_summary(rows, min_prob, min_count),
        "clinician_heatmap": heatmap(rows, "clinician_action", n_bins),
        "policy_heatmap": heatmap(rows, "policy_action", n_bins),
        "delta_heatmap": delta_heatmap(rows, n_bins),
        "subgroups": subgroup_summary(rows, min_prob, min_count, key),
        "sanity_cases": sanity_cases(rows, limit, min_prob, min_count, n_bins, key),
        "warnings": support_warnings(rows, min_prob, min_count, n_bins, key),
    }
