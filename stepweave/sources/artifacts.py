"""Fitted artifacts and descriptions as versioned JSON records.

A record is one JSON line ``{kind, version, body}``; the body is nested JSON of
the kind's schema, written by ``to_json`` and read by ``from_json``. Loading
checks kind and version, that every field is there, and that the body parses as
the schema says, so a record of another shape never passes for defaults.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds of records, their version and schema
KINDS: dict[str, tuple[int, str]] = {
    "medians": (1, "values map<string,double>"),
    "scaler": (
        1,
        "features array<struct<feature:string,median:double,mean:double,scale:double,"
        "clip_low:double,clip_high:double>>",
    ),
    "action_bins": (
        1,
        "first_edges array<double>, second_edges array<double>, n_bins int, seed bigint, "
        "n_first bigint, n_second bigint",
    ),
    "state_cuts": (1, "cuts array<struct<component:string,at:int,edges:array<double>>>"),
    "reward_config": (
        1,
        "variant string, survived double, died double, sofa_weight double, lactate_weight double, "
        "map_weight double, map_threshold double",
    ),
    "split_summary": (
        1,
        "seed bigint, spec_version string, keys string, n_keys map<string,bigint>, "
        "n_episodes map<string,bigint>, leakage_free boolean",
    ),
    "dataset_meta": (
        1,
        "spec_version string, action_spec_version string, reward_spec_version string, manifest_seed bigint, "
        "feature_columns array<string>, n_actions int, "
        "splits array<struct<split:string,n_episodes:bigint,n_transitions:bigint,state_dim:int>>",
    ),
}
ENVELOPE = "kind string, version int, body string"


class ArtifactError(ValueError):
    """A stored record is missing, of another kind or version, or malformed."""


def schema_of(kind: str) -> T.StructType:
    if kind not in KINDS:
        raise ValueError(f"unknown kind of artifact {kind!r}")
    return T.StructType.fromDDL(KINDS[kind][1])


def record_frame(spark: SparkSession, kind: str, record: Mapping[str, Any]) -> DataFrame:
    """The record in its envelope, one row."""
    schema = schema_of(kind)
    unknown, absent = sorted(set(record) - set(schema.names)), sorted(set(schema.names) - set(record))
    if unknown or absent:
        raise ValueError(f"record of kind {kind!r} with fields unknown {unknown} or absent {absent}")
    row = spark.createDataFrame([tuple(record[n] for n in schema.names)], schema)
    body = F.to_json(F.struct(*schema.names), {"ignoreNullFields": "false"})
    return row.select(F.lit(kind).alias("kind"), F.lit(KINDS[kind][0]).alias("version"), body.alias("body"))


def save(spark: SparkSession, root: str, kind: str, record: Mapping[str, Any]) -> str:
    path = f"{root}/{kind}"
    record_frame(spark, kind, record).coalesce(1).write.mode("overwrite").json(path)
    return path


def load(spark: SparkSession, root: str, kind: str) -> dict[str, Any]:
    """The record of one kind as nested dicts and lists."""
    schema, version = schema_of(kind), KINDS[kind][0]
    read = spark.read.schema(ENVELOPE).json(f"{root}/{kind}")
    parsed = F.from_json("body", schema, {"mode": "FAILFAST"}).alias("record")
    envelopes = read.select("kind", "version", F.json_object_keys("body").alias("fields"), "body").limit(2).collect()
    if len(envelopes) != 1:
        raise ArtifactError(f"{'no' if not envelopes else 'more than one'} record of kind {kind!r}")
    found = envelopes[0]
    if (found["kind"], found["version"]) != (kind, version):
        raise ArtifactError(f"expected {kind!r} version {version}, found {found['kind']!r} version {found['version']}")
    absent = sorted(set(schema.names) - set(found["fields"] or ()))
    if absent:
        raise ArtifactError(f"record of kind {kind!r} lacks fields: {absent}")
    try:
        record = read.select(parsed).first()["record"]
    except Exception as error:
        raise ArtifactError(f"record of kind {kind!r} does not parse: {error}") from error
    return record.asDict(recursive=True)


def dataclass_record(value: Any) -> dict[str, Any]:
    """Fields of a dataclass, tuples as lists."""

    def plain(x: Any) -> Any:
        if isinstance(x, (list, tuple)):
            return [plain(y) for y in x]
        return {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else x

    return plain(asdict(value))
