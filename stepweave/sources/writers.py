"""Sinks. Tables go to parquet, fitted artifacts to JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.operators.split import leakage_check
from stepweave.operators.transitions import flatten, replay_layout
from stepweave.sources import artifacts
from stepweave.sources.schemas import MANIFEST


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def land_events(events: DataFrame, path: str, item: str = "itemid", key: str = "stay_id") -> None:
    """Raw events as parquet, sorted by item inside each file so that item
    filters skip row groups. The input partitioning is kept: no shuffle.
    """
    order = [c for c in (item, key) if c in events.columns]
    events.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def land_bucketed(events: DataFrame, table: str, buckets: int, key: str = "stay_id", item: str = "itemid") -> None:
    """Raw events as a bucketed table: later joins on ``key`` need no exchange."""
    events.write.mode("overwrite").bucketBy(buckets, key).sortBy(item).saveAsTable(table)


def write_replay(transitions: DataFrame, path: str, features: Sequence[str]) -> None:
    """Flat replay rows, whole episodes per file, one folder per split."""
    flat = flatten(replay_layout(transitions), features)
    write_table(flat, path, ("split",) if "split" in flat.columns else ())


def write_manifest(
    manifest: DataFrame, root: str, seed: int, spec_version: str, key: str = "subject_id"
) -> dict:
    """A manifest as a table with one folder per split, and its summary record beside it.

    The summary is taken from the table as written.
    """
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    rows = manifest.withColumn("key", F.col(key).cast("long")).select(*names)
    write_table(rows, f"{root}/manifest", ("split",))
    stored = manifest.sparkSession.read.schema(MANIFEST).parquet(f"{root}/manifest")
    per_key = stored.groupBy("split", "key").agg(F.count(F.lit(1)).alias("n"))
    counts = per_key.groupBy("split").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("episodes")).collect()
    summary = {
        "seed": seed,
        "spec_version": spec_version,
        "keys": key,
        "n_keys": {r["split"]: r["keys"] for r in counts},
        "n_episodes": {r["split"]: r["episodes"] for r in counts},
        "leakage_free": leakage_check(stored, "key").isEmpty(),
    }
    artifacts.save(manifest.sparkSession, root, "split_summary", summary)
    return summary


def write_text(df: DataFrame, path: str) -> None:
    """A table as gzip CSV with a header, nulls as empty fields."""
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def write_stage(tables: dict[str, DataFrame], root: str) -> dict[str, str]:
    """Several result tables under one folder; returns their paths."""
    paths = {name: f"{root}/{name}" for name in tables}
    for name, df in tables.items():
        write_table(df, paths[name])
    return paths
