"""Exact global ranks without a single-partition sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_PREFIX = 4


def _rank_in_buckets(df: DataFrame, bucket: Column, order: Sequence[Column], name: str) -> DataFrame:
    """1-based rank: rows in earlier buckets plus the position inside the bucket.

    The table of bucket totals has one row per bucket, a fixed number.
    """
    marked = df.withColumn("_bucket", bucket)
    totals = marked.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_in_bucket"))
    offsets = totals.select(
        "_bucket",
        (F.sum("_in_bucket").over(Window.orderBy("_bucket")) - F.col("_in_bucket")).alias("_before"),
    )
    inside = Window.partitionBy("_bucket").orderBy(*order)
    return (
        marked.withColumn("_pos", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_pos") + F.col("_before"))
        .drop("_bucket", "_pos", "_before")
    )


def spread_rank(ids: DataFrame, key: str, seed: int, name: str = "rank") -> DataFrame:
    """Rank of unique ids in the order of a seeded hash (a stable shuffle)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    hashed = ids.withColumn("_digest", digest)
    ranked = _rank_in_buckets(
        hashed, F.substring("_digest", 1, HASH_PREFIX), [F.col("_digest"), F.col(key)], name
    )
    return ranked.drop("_digest")


def ordered_index(
    df: DataFrame, order: str, name: str = "seq", buckets: int = 1024
) -> DataFrame:
    """1-based position of each row in the order of a unique numeric column."""
    edges = df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))
    if edges:
        cut = F.array(*[F.lit(float(e)) for e in sorted(set(edges))])
        bucket = F.size(F.filter(cut, lambda e: e < F.col(order)))
    else:
        bucket = F.lit(0)
    return _rank_in_buckets(df, bucket, [F.col(order)], name)


def trailing_mean(
    df: DataFrame, seq: str, value: str, width: int, name: str, chunk: int = 100_000
) -> DataFrame:
    """Mean of the last ``width`` rows in ``seq`` order (fewer at the start).

    ``seq`` is a dense 1-based index. Rows are cut into chunks of consecutive
    positions and the tail of each chunk is repeated in the next one, so each
    window is computed inside one bounded chunk.
    """
    chunk = max(chunk, width)
    home = F.floor((F.col(seq) - 1) / chunk)
    spill = F.pmod(F.col(seq) - 1, F.lit(chunk)) >= chunk - (width - 1)
    placed = df.withColumn("_home", home).withColumn(
        "_chunk", F.explode(F.when(spill, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    window = Window.partitionBy("_chunk").orderBy(seq).rowsBetween(-(width - 1), 0)
    return (
        placed.withColumn(name, F.avg(value).over(window))
        .where(F.col("_home") == F.col("_chunk"))
        .drop("_home", "_chunk")
    )
