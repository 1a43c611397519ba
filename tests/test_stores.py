"""Artifacts, manifests, logs, replay tables and raw text: what is written is read back, and damage is found."""

import json
import os

import pytest
from conftest import at, rows_of
from pyspark.sql import functions as F

from stepweave.operators import actions, scaling
from stepweave.operators import transitions as tr
from stepweave.operators.rewards import RewardConfig
from stepweave.sources import artifacts, readers, writers

RECORDS = {
    "medians": {"values": {"a": 1.5, "b": None}},
    "scaler": {"features": [artifacts.dataclass_record(scaling.FeatureTransform("a", 1.0, 2.0, 0.1 + 0.2, None, 9.0))]},
    "action_bins": artifacts.dataclass_record(actions.ActionBins((1.0, 2.5), (0.1,), 5, 42, 7, 8)),
    "state_cuts": {"cuts": [{"component": "a", "at": 0, "edges": [0.1, 1e-300, 1e300]}]},
    "reward_config": artifacts.dataclass_record(RewardConfig()),
    "split_summary": {
        "seed": 42, "spec_version": "1", "keys": "subject_id", "n_keys": {"train": 2}, "n_episodes": {"train": 3},
        "leakage_free": True,
    },
    "dataset_meta": {
        "spec_version": "1", "action_spec_version": "1", "reward_spec_version": "1", "manifest_seed": 42,
        "feature_columns": ["b", "a"], "n_actions": 25,
        "splits": [{"split": "train", "n_episodes": 1, "n_transitions": 2, "state_dim": 2}],
    },
}


@pytest.mark.parametrize("kind", sorted(artifacts.KINDS))
def test_artifact_round_trip(spark, tmp_path, kind):
    artifacts.save(spark, str(tmp_path), kind, RECORDS[kind])
    assert artifacts.load(spark, str(tmp_path), kind) == RECORDS[kind]
    # a second save replaces the first
    artifacts.save(spark, str(tmp_path), kind, RECORDS[kind])
    assert artifacts.load(spark, str(tmp_path), kind) == RECORDS[kind]


def test_records_of_another_shape_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown kind"):
        artifacts.save(spark, str(tmp_path), "nothing", {})
    with pytest.raises(ValueError, match="absent"):
        artifacts.save(spark, str(tmp_path), "medians", {})
    with pytest.raises(ValueError, match="unknown"):
        artifacts.save(spark, str(tmp_path), "medians", {"values": {}, "more": 1})


def put(folder, kind, *records):
    os.makedirs(f"{folder}/{kind}")
    with open(f"{folder}/{kind}/part.json", "w") as f:
        f.write("\n".join(json.dumps(r) for r in records))


@pytest.mark.parametrize(
    "records, message",
    [
        ([], "no record"),
        ([{"kind": "medians", "version": 1, "body": '{"values":{}}'}] * 2, "more than one"),
        ([{"kind": "scaler", "version": 1, "body": '{"values":{}}'}], "expected"),
        ([{"kind": "medians", "version": 2, "body": '{"values":{}}'}], "version 2"),
        ([{"kind": "medians", "version": 1, "body": "{}"}], "lacks fields"),
        ([{"kind": "medians", "version": 1, "body": '{"values":{"a":"high"}}'}], "does not parse"),
        ([{"kind": "medians", "version": 1, "body": "broken"}], "lacks fields"),
    ],
)
def test_damaged_artifacts(spark, tmp_path, records, message):
    put(tmp_path, "medians", *records)
    with pytest.raises(artifacts.ArtifactError, match=message):
        artifacts.load(spark, str(tmp_path), "medians")


MANIFEST_ROWS = [(1, "train", 10, 2), (1, "train", 11, 2), (2, "test", 20, 1), (3, "validation", 30, 1)]
MANIFEST = "subject_id long, split string, stay_id long, n_episodes long"


def test_manifest_round_trip_reads_one_folder(spark, tmp_path):
    frame = spark.createDataFrame(MANIFEST_ROWS, MANIFEST)
    summary = writers.write_manifest(frame, str(tmp_path), 42, "7")
    assert summary["n_keys"] == {"train": 1, "test": 1, "validation": 1} and summary["n_episodes"]["train"] == 2
    rows, stored = readers.read_manifest(spark, str(tmp_path), spec_version="7")
    assert stored == summary and rows_of(rows.select(*frame.columns)) == rows_of(frame)
    train = readers.read_manifest(spark, str(tmp_path), "train")[0]
    assert {r.stay_id for r in train.collect()} == {10, 11}
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "InMemoryFileIndex" in plan
    with pytest.raises(artifacts.ArtifactError, match="version"):
        readers.read_manifest(spark, str(tmp_path), spec_version="8")
    with pytest.raises(ValueError, match="no split"):
        readers.read_manifest(spark, str(tmp_path), "holdout")


def test_manifest_that_leaks_or_lost_rows(spark, tmp_path):
    leaking = spark.createDataFrame([*MANIFEST_ROWS, (1, "test", 12, 1)], MANIFEST)
    assert not writers.write_manifest(leaking, f"{tmp_path}/a", 42, "1")["leakage_free"]
    with pytest.raises(artifacts.ArtifactError, match="several splits"):
        readers.read_manifest(spark, f"{tmp_path}/a")
    frame = spark.createDataFrame(MANIFEST_ROWS, MANIFEST)
    writers.write_manifest(frame, f"{tmp_path}/b", 42, "1")
    fewer = frame.where("stay_id <> 11").withColumnRenamed("subject_id", "key")
    writers.write_table(fewer, f"{tmp_path}/b/manifest", ("split",))
    assert readers.read_manifest(spark, f"{tmp_path}/b", "test")[0].count() == 1
    with pytest.raises(artifacts.ArtifactError, match="its summary counts"):
        readers.read_manifest(spark, f"{tmp_path}/b", "train")


def test_metric_log_policies(spark, tmp_path):
    good = {"step": 1, "epoch": 1, "name": "loss", "value": 0.5, "timestamp": 0.0}
    lines = [
        json.dumps(good), "", "{broken", json.dumps({**good, "name": None}), json.dumps({**good, "value": "high"}),
        json.dumps({**good, "step": 2, "extra": [1]}),
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "log.jsonl")
    assert [r.step for r in readers.read_metric_log(spark, path).orderBy("step").collect()] == [1, 2]
    kept = readers.read_metric_log(spark, path, readers.KEEP).collect()
    assert len(kept) == 5 and sum(r.malformed is not None for r in kept) == 3
    assert "{broken" in {r.malformed for r in kept}
    with pytest.raises(Exception, match="malformed line"):
        readers.read_metric_log(spark, path, readers.FAIL).collect()
    with pytest.raises(ValueError, match="unknown policy"):
        readers.read_metric_log(spark, path, "guess")


def test_replay_contract(spark, tmp_path):
    steps = spark.createDataFrame(
        [("train", 1, 0, 3, 1.0, 5.0), ("train", 1, 1, 4, 2.0, 6.0), ("test", 2, 0, 0, 0.0, 7.0)],
        "split string, stay_id long, step_index int, action_id int, reward_total double, f double",
    )
    rows = tr.build_transitions(steps, ["f"])
    writers.write_replay(rows, f"{tmp_path}/r", ["f"])
    back = readers.read_replay(spark, f"{tmp_path}/r", ["f"])
    assert rows_of(back.select(*rows.columns)) == rows_of(rows)
    one = readers.read_replay(spark, f"{tmp_path}/r", split="test")
    assert one.count() == 1 and "PartitionFilters: [isnotnull(split" in one._jdf.queryExecution().executedPlan().toString()
    flat = spark.read.parquet(f"{tmp_path}/r")
    flat.withColumn("reward", F.col("reward").cast("string")).write.parquet(f"{tmp_path}/s")
    with pytest.raises(ValueError, match="reward string"):
        readers.read_replay(spark, f"{tmp_path}/s")


def test_ragged_rows(spark, tmp_path):
    head = "subject_id,hadm_id,starttime,stoptime,drug,route"
    stamp = at(0).strftime("%Y-%m-%d %H:%M:%S")
    rows = [f"1,2,{stamp},,DRUG,IV", f"1,3,{stamp},,DRUG,IV,more", "1,4,", f'1,5,{stamp},,"A, B",IV', "x,6,bad,,DRUG,IV"]
    (tmp_path / "orders.csv").write_text("\n".join([head, *rows]) + "\n")
    path = str(tmp_path / "orders.csv")

    def ids(policy):
        return sorted(r.hadm_id for r in readers.raw_table(spark, path, "prescriptions", malformed=policy).collect())

    assert ids(None) == ids(readers.KEEP) == [2, 3, 4, 5, 6] and ids(readers.DROP) == [2, 5, 6]
    assert {r.malformed for r in readers.malformed_rows(spark, path).collect()} == {rows[1], rows[2]}
    drugs = {r.hadm_id: r for r in readers.raw_table(spark, path, "prescriptions").collect()}
    assert drugs[5].drug == "A, B" and drugs[6].subject_id is None and drugs[6].starttime is None
    with pytest.raises(Exception):
        readers.raw_table(spark, path, "prescriptions", malformed=readers.FAIL).collect()
    with pytest.raises(ValueError, match="unknown policy"):
        readers.raw_table(spark, path, "prescriptions", malformed="guess")
    with pytest.raises(ValueError, match="lacks columns"):
        readers.raw_table(spark, path, "stays", required=("stay_id",))
