"""Cohort funnel: ordered exclusion rules with one audited reason per stay."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions.scalars import order_key
from stepweave.functions.shares import with_share
from stepweave.functions.skew import skew_join

# Exclusion reason codes
AGE_BELOW_MIN = "age_below_minimum"
AGE_ABOVE_MAX = "age_above_maximum"
LOS_TOO_SHORT = "los_below_minimum_hours"
MISSING_DEMOGRAPHICS = "missing_demographics"
READMISSION = "readmission_not_first_stay"

OUTPUT_COLUMNS = (
    "subject_id", "hadm_id", "stay_id", "intime", "outtime", "los_hours",
    "anchor_age", "gender", "deathtime", "hospital_expire_flag",
)


@dataclass(frozen=True)
class CohortRules:
    """Thresholds of the funnel. ``null_policy`` decides what a null age or
    length means: ``missing`` excludes the stay (as missing demographics or too
    short), ``drop`` lets it vanish from both outputs, as a three-valued filter
    pair would.
    """

    min_age: float | None = 18
    max_age: float | None = None
    min_los_hours: float = 4
    require_demographics: bool = True
    first_stay_only: bool = True
    null_policy: str = "missing"


def merge_base(stays: DataFrame, patients: DataFrame, admissions: DataFrame) -> DataFrame:
    """Stay ⟕ patient (by subject) ⟕ admission (by admission)."""
    people = patients.select("subject_id", "anchor_age", "gender")
    admitted = admissions.select("hadm_id", "deathtime", "hospital_expire_flag")
    return skew_join(skew_join(stays, people, "subject_id", "left"), admitted, "hadm_id", "left")


def _rule_chain(rules: CohortRules) -> list[tuple[Column, str]]:
    chain: list[tuple[Column, str]] = []
    if rules.min_age:
        chain.append((F.col("anchor_age") < rules.min_age, AGE_BELOW_MIN))
    if rules.max_age is not None:
        chain.append((F.col("anchor_age") > rules.max_age, AGE_ABOVE_MAX))
    if rules.min_los_hours > 0:
        chain.append((~F.coalesce(F.col("los_hours") >= rules.min_los_hours, F.lit(False)), LOS_TOO_SHORT))
    if rules.require_demographics:
        absent = F.col("anchor_age").isNull() | F.col("gender").isNull()
        chain.append((absent, MISSING_DEMOGRAPHICS))
    return chain


def label_exclusions(base: DataFrame, rules: CohortRules = CohortRules()) -> DataFrame:
    """``base`` plus ``exclusion_reason``: the first failing rule, null if kept."""
    if rules.null_policy not in ("missing", "drop"):
        raise ValueError(f"unknown null_policy {rules.null_policy!r}")
    rows = base
    if rules.null_policy == "drop":
        age, young = F.col("anchor_age"), F.lit(False)
        if rules.min_age:
            rows, young = rows.where(age.isNotNull()), age < rules.min_age
        if rules.max_age is not None:
            rows, young = rows.where(age.isNotNull()), young | (age > rules.max_age)
        if rules.min_los_hours > 0:
            rows = rows.where(F.col("los_hours").isNotNull() | young)
    reason = F.lit(None).cast("string")
    for failed, code in reversed(_rule_chain(rules)):
        reason = F.when(failed, F.lit(code)).otherwise(reason)
    labelled = rows.withColumn("exclusion_reason", reason)
    if not rules.first_stay_only:
        return labelled

    # One surviving row per subject by map-side combined min, joined back on the
    # unique stay id: no window over a subject that owns very many stays.
    first = (
        labelled.where(F.col("exclusion_reason").isNull())
        .groupBy("subject_id")
        .agg(F.min_by("stay_id", order_key(F.col("intime"), F.col("stay_id"))).alias("stay_id"))
        .select("stay_id", F.lit(True).alias("_is_first"))
    )
    later = F.col("exclusion_reason").isNull() & F.col("_is_first").isNull()
    return (
        labelled.join(first, "stay_id", "left")
        .withColumn("exclusion_reason", F.when(later, F.lit(READMISSION)).otherwise(F.col("exclusion_reason")))
        .drop("_is_first")
    )


def cohort_funnel(base: DataFrame, rules: CohortRules = CohortRules()) -> tuple[DataFrame, DataFrame]:
    """``(included, excluded)``; only the excluded rows carry a reason."""
    labelled = label_exclusions(base, rules)
    wanted = [c for c in OUTPUT_COLUMNS if c in labelled.columns]
    included = labelled.where(F.col("exclusion_reason").isNull()).select(*wanted)
    excluded = labelled.where(F.col("exclusion_reason").isNotNull()).select(*wanted, "exclusion_reason")
    return included, excluded


def cohort_audit(labelled: DataFrame) -> DataFrame:
    """One row: totals, inclusion rate and unique included patients."""
    kept = F.col("exclusion_reason").isNull()
    # distinct subjects by two combined aggregations instead of one global set
    per_subject = labelled.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(kept).alias("kept")
    )
    return per_subject.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_stays"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("included"),
        F.coalesce(F.sum(F.col("rows") - F.col("kept")), F.lit(0)).alias("excluded"),
        F.coalesce(F.round(F.try_divide(F.sum("kept"), F.sum("rows")) * 100, 2), F.lit(0.0)).alias("inclusion_rate_pct"),
        F.count_if(F.col("kept") > 0).alias("unique_patients"),
    )


def exclusion_summary(excluded: DataFrame) -> DataFrame:
    """Count and share per reason, most frequent first."""
    counts = excluded.groupBy("exclusion_reason").agg(F.count(F.lit(1)).alias("count"))
    return with_share(counts, "count").orderBy(F.desc("count"), "exclusion_reason")


def funnel_completeness(included: DataFrame, excluded: DataFrame, total: DataFrame) -> DataFrame:
    """Violations of the funnel contract, one row each; empty when it holds."""
    missing = {"subject_id", "hadm_id", "stay_id"} - set(included.columns)
    if missing or "exclusion_reason" not in excluded.columns:
        raise ValueError(f"funnel outputs lack columns: {sorted(missing) or ['exclusion_reason']}")
    tagged = (
        total.select("stay_id", F.lit("t").alias("side"), F.lit("").alias("exclusion_reason"))
        .unionByName(included.select("stay_id", F.lit("i").alias("side"), F.lit("").alias("exclusion_reason")))
        .unionByName(excluded.select("stay_id", F.lit("e").alias("side"), "exclusion_reason"))
    )
    per_stay = tagged.groupBy("stay_id").agg(
        F.count_if(F.col("side") == "t").alias("t"),
        F.count_if(F.col("side") == "i").alias("i"),
        F.count_if(F.col("side") == "e").alias("e"),
        F.count_if(F.col("exclusion_reason").isNull()).alias("no_reason"),
    )
    sums = per_stay.agg(
        F.sum("t").alias("t"), F.sum("i").alias("i"), F.sum("e").alias("e"),
        F.sum("no_reason").alias("no_reason"), F.sum(F.greatest(F.col("i") - 1, F.lit(0))).alias("repeats"),
    )
    checks = F.array(
        F.struct(F.lit("count_mismatch").alias("violation"), (F.col("i") + F.col("e") - F.col("t")).alias("rows")),
        F.struct(F.lit("null_exclusion_reason").alias("violation"), F.col("no_reason").alias("rows")),
        F.struct(F.lit("duplicate_included_stay").alias("violation"), F.col("repeats").alias("rows")),
    )
    return sums.select(F.inline(checks)).where(F.col("rows") != 0)
