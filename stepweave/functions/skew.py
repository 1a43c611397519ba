"""Equi-joins that survive a key holding a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from stepweave.session import configure


def skew_join(facts: DataFrame, dim: DataFrame, on: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """Join a large fact side to a side that has few rows per key.

    A ``dim`` under the broadcast threshold is broadcast by Spark, statically or
    after its size is known. Beyond that both sides are shuffled, and AQE splits
    every oversized partition of ``facts`` by map output and repeats only the
    matching ``dim`` partition; an even key distribution pays nothing for it.
    Rows with a null key in a left join are split the same way.

    The split needs the fact side on the left and a join type that keeps or
    drops each left row on its own.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a hot key cannot be split in a {how!r} join")
    configure(facts.sparkSession)
    return facts.join(dim, on, how)
