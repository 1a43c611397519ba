"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import string
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER_TO_LOWER = {ord(a): ord(b) for a, b in zip(string.ascii_uppercase, string.ascii_lowercase)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` does that by itself on pure ASCII and is much faster there than
    ``translate``, which looks every character up.
    """
    return F.when(
        text.rlike(r"[^\x00-\x7F]"), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    ).otherwise(F.lower(text))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks_for(rows: int, per_block: int) -> int:
    """Number of blocks so that one holds about ``per_block`` rows."""
    return max(1, -(-rows // per_block))


def join_spread(rows: DataFrame, values: DataFrame, key: str, share: int = 1_000) -> DataFrame:
    """``rows`` with the columns of their key's row in ``values``, but for ``n``, the number of rows of the key.

    Keys that hold more than one in ``share`` of all rows are fewer than
    ``share``, so they are broadcast, and no key's rows gather in one task.
    """
    total = values.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * share > total
    often = values.where(hot).drop("n")
    spread = rows.join(F.broadcast(often), key)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(values.where(~hot).drop("n"), key)
    return spread.unionByName(rest)


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, whatever their working directory."""
    context = spark.sparkContext
    if getattr(context, "_stepweave_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if package.endswith(".zip") or ".zip" in package:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="stepweave-"), "stepweave.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("stepweave", os.path.relpath(full, package)))
    context.addPyFile(archive)
    context._stepweave_shipped = True
