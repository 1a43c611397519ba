"""Table-level diagnostics of action-value policies.

Inputs carry ``q array<double>`` (and ``q_next``, ``logits``, ``value`` where
named) next to the transition columns; all work is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.functions.vectors import argmax, entropy, log_softmax, logsumexp, pick, softmax, total


def td_error(rows: DataFrame, gamma: float = 0.99) -> DataFrame:
    """Bootstrapped target and squared error: ``r + γ(1−done)·max q'``."""
    target = F.col("reward") + F.when(F.col("done"), 0.0).otherwise(gamma * F.array_max("q_next"))
    rows = rows.withColumn("td_target", target)
    return rows.withColumn("td_error", F.pow(pick(F.col("q"), F.col("action")) - F.col("td_target"), 2))


def conservative_gap(rows: DataFrame) -> DataFrame:
    """``logsumexp(q) − q[a]`` with the mean and maximum action value."""
    return rows.withColumns(
        {
            "cql_gap": logsumexp(F.col("q")) - pick(F.col("q"), F.col("action")),
            "mean_q": total(F.col("q")) / F.size("q"),
            "max_q": F.array_max("q"),
        }
    )


def _masked(q: Column, keep: Column) -> Column:
    return F.zip_with(q, keep, lambda value, ok: F.when(ok, value).otherwise(F.lit(float("-inf"))))


def masked_argmax(rows: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Best action among those with ``p ≥ τ·max p``; all actions if none is left."""
    tau = min(max(threshold, 0.0), 1.0)
    rows = rows.withColumn("behavior_probs", softmax(F.col("logits")))
    limit = F.array_max("behavior_probs") * tau
    rows = rows.withColumn("_keep", F.transform("behavior_probs", lambda p: p >= limit))
    rows = rows.withColumn("_masked", _masked(F.col("q"), F.col("_keep")))
    usable = F.array_max("_masked") > F.lit(float("-inf"))
    return rows.withColumns(
        {
            "policy_action": F.when(usable, argmax(F.col("_masked"))).otherwise(argmax(F.col("q"))),
            "n_supported": F.size(F.filter("_keep", lambda ok: ok)),
            "support_rate": F.size(F.filter("_keep", lambda ok: ok)) / F.size("_keep"),
            "behavior_entropy": entropy(F.col("behavior_probs")),
        }
    ).drop("_keep", "_masked")


def expectile(
    rows: DataFrame, expectile_level: float = 0.7, temperature: float = 3.0, max_weight: float = 100.0
) -> DataFrame:
    """Asymmetric value loss and clipped advantage weights of ``q[a] − value``."""
    advantage = pick(F.col("q"), F.col("action")) - F.col("value")
    rows = rows.withColumn("advantage", advantage)
    side = F.when(F.col("advantage") >= 0, expectile_level).otherwise(1.0 - expectile_level)
    return rows.withColumns(
        {
            "value_loss": side * F.col("advantage") * F.col("advantage"),
            "adv_weight": F.least(F.exp(temperature * F.col("advantage")), F.lit(float(max_weight))),
        }
    )


def actor_loss(rows: DataFrame) -> DataFrame:
    """Advantage-weighted negative log likelihood of the logged action."""
    log_prob = pick(log_softmax(F.col("logits")), F.col("action"))
    return rows.withColumn("actor_loss", -F.col("adv_weight") * log_prob)


def imitation_loss(rows: DataFrame) -> DataFrame:
    """Cross entropy of the behaviour logits at the logged action."""
    return rows.withColumn("imitation_loss", -pick(log_softmax(F.col("logits")), F.col("action")))


def greedy_action(rows: DataFrame) -> DataFrame:
    """First best action and its value for every row."""
    return rows.withColumns({"policy_action": argmax(F.col("q")), "policy_q": F.array_max("q")})
