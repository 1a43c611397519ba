"""Exact quantiles without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepweave.session import cut_lineage

BUCKETS = 1024


def edges_below(edges: Column, value: Column) -> Column:
    """How many of at most ``BUCKETS - 1`` ascending edges lie below the value, by bisection."""
    halves = F.array(*(F.lit(1 << k) for k in reversed(range((BUCKETS - 1).bit_length()))))
    # beyond the last edge there is null, which is not below anything
    return F.aggregate(
        halves, F.lit(0), lambda found, half: F.when(F.get(edges, found + half - 1) < value, found + half).otherwise(found)
    )


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], method: str = "linear"
) -> DataFrame:
    """Exact quantiles of ``value`` per group: ``keys…, n, q0, q1, …``.

    Values are first collapsed to ``(keys, value, count)`` and cut into buckets
    at approximate quantiles of each group. The edges are stored once, so every
    reader sees the same; the bucket totals give each bucket its rank offset, so
    every task ranks one bucket and the result is exact. A group of any size
    takes this path. For many groups of bounded size, Spark's ``percentile`` is
    cheaper.

    ``method``: ``linear`` interpolates between the neighbouring ranks,
    ``nearest`` takes rank ``floor((n-1)*p + 0.5)``.
    """
    if method not in ("linear", "nearest"):
        raise ValueError(f"unknown quantile method {method!r}")
    keys = list(keys)

    counts = cut_lineage(
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    cuts = [i / BUCKETS for i in range(1, BUCKETS)]
    edges = cut_lineage(
        counts.groupBy(*keys).agg(
            F.array_distinct(F.percentile_approx("_v", cuts, F.lit(100 * BUCKETS))).alias("_edges")
        )
    )
    bucketed = counts.join(edges, keys).select(
        *keys, "_v", "_c", edges_below(F.col("_edges"), F.col("_v")).alias("_b")
    )

    per_bucket = bucketed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bn"))
    over_buckets = Window.partitionBy(*keys).orderBy("_b")
    offsets = per_bucket.select(
        *keys,
        "_b",
        (F.sum("_bn").over(over_buckets) - F.col("_bn")).alias("_before"),
        F.sum("_bn").over(Window.partitionBy(*keys)).alias("n"),
    )
    in_bucket = Window.partitionBy(*keys, "_b").orderBy("_v")
    ranked = bucketed.join(offsets, keys + ["_b"]).select(
        *keys,
        "n",
        "_v",
        (F.col("_before") + F.sum("_c").over(in_bucket)).alias("_upto"),
        "_c",
    )

    picks, outs = [], []
    for i, p in enumerate(probs):
        position = (F.col("n") - 1) * F.lit(float(p))
        if method == "nearest":
            low = high = F.floor(position + 0.5)
        else:
            low, high = F.floor(position), F.ceil(position)
        for tag, rank in (("lo", low), ("hi", high)):
            covers = (F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto"))
            picks.append(F.max(F.when(covers, F.col("_v"))).alias(f"_{tag}{i}"))
        frac = position - F.floor(position) if method == "linear" else F.lit(0.0)
        outs.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac).alias(f"q{i}"))
    return ranked.groupBy(*keys, "n").agg(*picks).select(*keys, "n", *outs)


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], method: str = "linear"
) -> dict[str, tuple[int, list[float]]]:
    """Exact quantiles of whole columns as a fitted artifact.

    Returns ``{column: (non-null count, quantiles)}``; only one row per column
    reaches the driver.
    """
    pairs = [
        F.struct(F.lit(i).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(columns)
    ]
    rows = group_quantiles(df.select(F.inline(F.array(*pairs))), ["name"], "value", probs, method).collect()
    found = {r["name"]: (r["n"], [r[f"q{i}"] for i in range(len(probs))]) for r in rows}
    return {c: found.get(i, (0, [None] * len(probs))) for i, c in enumerate(columns)}
