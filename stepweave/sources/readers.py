"""Sources. Raw tables come as (gzip) CSV or as parquet landed from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.functions.scalars import lenient_timestamp
from stepweave.functions.skew import skew_join
from stepweave.operators.transitions import replay_features, unflatten
from stepweave.session import cut_lineage
from stepweave.sources import artifacts
from stepweave.sources.schemas import MANIFEST, METRIC_LOG, RAW_COLUMNS, RAW_TYPES

# Policies for rows that do not fit the file's columns
KEEP, DROP, FAIL = "keep", "drop", "fail"


def _typed(name: str, strict: Sequence[str]) -> Column:
    kind = RAW_TYPES.get(name, "string")
    col = F.col(name)
    if kind == "timestamp":
        col = F.to_timestamp_ntz(col, F.lit("yyyy-MM-dd HH:mm:ss")) if name in strict else lenient_timestamp(col)
    elif kind == "date":
        # a plain date counts as its midnight
        col = F.coalesce(lenient_timestamp(col), lenient_timestamp(col, "yyyy-MM-dd"))
    elif kind != "string":
        col = col.try_cast(kind)
    return col.alias(name)


def _text_columns(spark: SparkSession, path: str, malformed: str) -> DataFrame:
    """A CSV table with all its columns as text and, but for ``fail``, the rows that do not fit as ``malformed``."""
    # without inference the header row alone names the columns
    names = spark.read.option("header", True).csv(path).columns
    fields = [f"`{n}` string" for n in names]
    if malformed == FAIL:
        read = spark.read.option("mode", "FAILFAST")
    else:
        read = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed")
        fields.append("malformed string")
    # rows are judged whole, whatever columns are asked for
    read = read.option("header", True).option("columnPruning", False).option("enforceSchema", False)
    return read.schema(", ".join(fields)).csv(path)


def malformed_rows(spark: SparkSession, path: str) -> DataFrame:
    """The raw text of CSV rows with more or fewer fields than the header, set aside in the shared folder."""
    # written whole, as Spark reads no text for its malformed records alone
    return cut_lineage(_text_columns(spark, path, KEEP).where(F.col("malformed").isNotNull())).select("malformed")


def raw_table(
    spark: SparkSession,
    path: str,
    table: str,
    fmt: str = "csv",
    strict: Sequence[str] = (),
    malformed: str | None = None,
    required: Sequence[str] = (),
) -> DataFrame:
    """A raw table with typed columns; values that do not parse become null, or fail the job if ``strict`` names them.

    CSV columns are matched by header name, so extra columns in the file are
    skipped by the scan; ``required`` ones must be there. Rows with more or fewer
    fields than the header are kept, dropped or fail the job, as ``malformed``
    says; without it the scan reads the columns it needs and does not look.
    Gzip files cannot be split: land them once as parquet
    with :func:`stepweave.sources.writers.land_events` and pass
    ``fmt="parquet"``, which also pushes item and time filters to the scan.
    """
    wanted = RAW_COLUMNS[table]
    if fmt == "parquet":
        frame = spark.read.parquet(path)
        _require(frame, required, table)
        return frame.select(*[c for c in wanted if c in frame.columns])
    if fmt != "csv":
        raise ValueError(f"unsupported format {fmt!r}")
    if malformed is None:
        frame = spark.read.option("header", True).csv(path)
    elif malformed in (KEEP, DROP, FAIL):
        frame = _text_columns(spark, path, malformed)
    else:
        raise ValueError(f"unknown policy {malformed!r} for malformed rows")
    _require(frame, required, table)
    if malformed == DROP:
        frame = frame.where(F.col("malformed").isNull())
    return frame.select(*[_typed(c, strict) for c in wanted if c in frame.columns])


def _require(frame: DataFrame, required: Sequence[str], table: str) -> None:
    absent = [c for c in required if c not in frame.columns]
    if absent:
        raise ValueError(f"table {table!r} lacks columns: {absent}")


def read_stays(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Stays with strict boundaries and their length in hours."""
    needed = ("subject_id", "hadm_id", "stay_id", "intime", "outtime", "los")
    stays = raw_table(spark, path, "stays", fmt, strict=("intime", "outtime"), required=needed)
    return stays.withColumn("los_hours", F.col("los") * 24)


def read_cultures(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Culture orders; the order time falls back to midnight of its date."""
    rows = raw_table(spark, path, "cultures", fmt)
    return rows.withColumn("culture_time", F.coalesce("charttime", "chartdate")).where(
        F.col("culture_time").isNotNull()
    )


def read_orders_matching(
    spark: SparkSession, path: str, keywords: Sequence[str], fmt: str = "csv"
) -> DataFrame:
    """Drug orders whose name contains one of the keywords and that have a start."""
    return orders_matching(raw_table(spark, path, "prescriptions", fmt), keywords)


def orders_matching(
    orders: DataFrame, keywords: Sequence[str], name: str = "drug", time: str = "starttime"
) -> DataFrame:
    """Orders whose name contains one of the keywords, in any case, and that have a time."""
    return orders.where(F.upper(name).rlike("|".join(k.upper() for k in keywords)) & F.col(time).isNotNull())


def scan_points(
    events: DataFrame,
    items: Sequence,
    start: object | None = None,
    end: object | None = None,
    owners: DataFrame | None = None,
    key: str = "stay_id",
    time: str = "charttime",
    item: str = "itemid",
) -> DataFrame:
    """Point events of some items with ``start ≤ time < end``, optionally only of
    the owners in a table. Items and bounds are literals, so parquet skips row
    groups; the owners come in as a semi join.
    """
    rows = events.where(F.col(item).isin(list(items)) & F.col(time).isNotNull())
    if start is not None:
        rows = rows.where(F.col(time) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.where(F.col(time) < F.lit(end).cast("timestamp_ntz"))
    return rows if owners is None else skew_join(rows, owners.select(key).distinct(), key, "left_semi")


def scan_intervals(
    events: DataFrame,
    items: Sequence,
    start: object | None = None,
    end: object | None = None,
    owners: DataFrame | None = None,
    key: str = "stay_id",
    item: str = "itemid",
) -> DataFrame:
    """Interval events that touch ``[start, end)``; an open end counts as the start."""
    rows = events.where(F.col(item).isin(list(items)) & F.col("starttime").isNotNull())
    if end is not None:
        rows = rows.where(F.col("starttime") < F.lit(end).cast("timestamp_ntz"))
    if start is not None:
        rows = rows.where(F.col("endtime").isNull() | (F.col("endtime") >= F.lit(start).cast("timestamp_ntz")))
    rows = rows.withColumn("endtime", F.coalesce("endtime", "starttime"))
    return rows if owners is None else skew_join(rows, owners.select(key).distinct(), key, "left_semi")


def scan_scores(events: DataFrame, items: Sequence) -> DataFrame:
    """Score measurements: listed items with a numeric value."""
    return events.where(F.col("itemid").isin(list(items)) & F.col("valuenum").isNotNull()).select(
        "subject_id", "hadm_id", "stay_id", "charttime", "itemid", "valuenum"
    )


def read_manifest(
    spark: SparkSession, root: str, split: str | None = None, spec_version: str | None = None
) -> tuple[DataFrame, dict]:
    """A stored manifest and its summary record; ``split`` reads one folder of the table only.

    A summary of another specification version or of a split that leaks, and a
    table that does not have the episodes the summary counts, are errors.
    """
    summary = artifacts.load(spark, root, "split_summary")
    if spec_version is not None and summary["spec_version"] != spec_version:
        raise artifacts.ArtifactError(f"manifest of version {summary['spec_version']!r}, expected {spec_version!r}")
    if not summary["leakage_free"]:
        raise artifacts.ArtifactError("the stored split has keys in several splits")
    if split is not None and split not in summary["n_episodes"]:
        raise ValueError(f"the manifest has no split {split!r}")
    # the partition column is declared, so no folder is listed to infer it
    rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    rows = rows if split is None else rows.where(F.col("split") == split)
    wanted = {s: n for s, n in summary["n_episodes"].items() if split in (None, s)}
    # one row per split
    found = {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()}
    if found != wanted:
        raise artifacts.ArtifactError(f"the manifest holds {found} episodes, its summary counts {wanted}")
    return rows.withColumnRenamed("key", summary["keys"]), summary


def _judged_log(spark: SparkSession, path: str) -> DataFrame:
    """All lines of a metric log with ``malformed``: the text of a line that is no record of a metric."""
    read = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed")
    rows = read.schema(METRIC_LOG + ", malformed string").json(path)
    nameless = F.to_json(F.struct("step", "epoch", "value", "timestamp"))
    return rows.withColumn("malformed", F.coalesce("malformed", F.when(F.col("name").isNull(), nameless)))


def read_metric_log(spark: SparkSession, path: str, malformed: str = DROP) -> DataFrame:
    """Metric log in JSON lines; blank lines are skipped.

    Lines that are no JSON, have a value of another type or no name are dropped,
    kept with their text as ``malformed``, or fail the job.
    """
    rows = _judged_log(spark, path)
    if malformed == KEEP:
        return rows
    if malformed == FAIL:
        text = F.concat(F.lit("malformed line in the metric log: "), F.col("malformed"))
        bad = F.when(F.col("malformed").isNotNull(), F.raise_error(text).cast("string"))
        return rows.withColumn("name", F.coalesce(bad, F.col("name"))).drop("malformed")
    if malformed != DROP:
        raise ValueError(f"unknown policy {malformed!r} for malformed lines")
    return rows.where(F.col("malformed").isNull()).drop("malformed")


def read_replay(
    spark: SparkSession, path: str, features: Sequence[str] | None = None, split: str | None = None
) -> DataFrame:
    """Flat replay table as array states; ``split`` reads one folder only.

    Pass ``features`` in the order of the stored description; without it the
    columns are taken alphabetically. Columns must have the types they are
    written with.
    """
    flat = spark.read.parquet(path)
    names = list(features) if features is not None else replay_features(flat)
    kinds = {"action": "int", "reward": "double", "done": "boolean"}
    kinds |= {f"{p}_{c}": "double" for c in names for p in ("s", "ns")}
    wrong = sorted(f"{n} {t}" for n, t in flat.dtypes if kinds.get(n, t) != t)
    if wrong:
        raise ValueError(f"replay table with columns of another type: {wrong}")
    if split is not None:
        flat = flat.where(F.col("split") == split)
    return unflatten(flat, names)


def first_stays(episodes: DataFrame, n: int) -> DataFrame:
    """The ``n`` episodes with the smallest stay ids (a top-k, no global sort)."""
    return episodes.orderBy("stay_id").limit(n)
