import gzip
import json

import pytest
from conftest import at, rows_of
from pyspark.sql import functions as F

from stepweave.operators.features import feature_columns
from stepweave.operators.transitions import validate_transitions
from stepweave.plans.pipeline import PipelineConfig, run
from stepweave.presets import clinical
from stepweave.sources import artifacts, readers, writers


def stamp(hours):
    return at(hours).strftime("%Y-%m-%d %H:%M:%S")


def put(folder, name, header, rows):
    path = f"{folder}/{name}.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write(",".join(header) + "\n")
        for row in rows:
            f.write(",".join("" if v is None else str(v) for v in row) + "\n")
    return path


# One stay is followed by hand: admitted 40 h before, order at hour 1, so the window is hour -23 to 49
# and step s covers the hours 4s - 23 to 4s - 19. The others only give the fits something to fit.
HAND = 9021
OTHERS = {22: (70, None), 23: (10, None), 24: (70, 21), 25: (70, None), 26: (70, None), 27: (70, None), 28: (70, None)}
LATE = 25
MINOR = 29


def stays_of():
    return [(21, 70, None)] + [(i, out, died) for i, (out, died) in OTHERS.items()] + [(MINOR, 70, None)]


@pytest.fixture(scope="module")
def workspace(spark, tmp_path_factory):
    """Nine subjects with one stay each, as gzip CSV."""
    folder = tmp_path_factory.mktemp("raw")
    people = stays_of()
    paths = {
        "stays": put(
            folder, "stays", ["stay_id", "hadm_id", "subject_id", "intime", "outtime", "los", "ward"],
            [
                (9000 + i, 300 + i, i, stamp(-6 if i == LATE else -40), stamp(out), (out + 40) / 24, "W")
                for i, out, _ in people
            ],
        ),
        "patients": put(
            folder, "patients", ["subject_id", "anchor_age", "gender"],
            [(i, 17 if i == MINOR else 30 + i, "F") for i, _, _ in people],
        ),
        "admissions": put(
            folder, "admissions", ["hadm_id", "subject_id", "hospital_expire_flag", "deathtime"],
            [(300 + i, i, int(died is not None), stamp(died) if died else "soon") for i, _, died in people],
        ),
        "cultures": put(
            folder, "cultures", ["hadm_id", "subject_id", "charttime", "chartdate", "spec_type_desc"],
            [(300 + i, i, stamp(5) if i % 2 else None, at(5).strftime("%Y-%m-%d"), "URINE") for i, _, _ in people],
        ),
        "prescriptions": put(
            folder, "prescriptions", ["hadm_id", "subject_id", "drug", "route", "starttime", "stoptime"],
            [(300 + i, i, "inj. cefepime 2 g", "IV", stamp(1), stamp(80)) for i, _, _ in people]
            + [(321, 21, "Paracetamol", "PO", stamp(-30), None), (321, 21, "Meropenem", "IV", None, None)],
        ),
    }
    # hand-followed stay: hour, item, value
    hand = [
        (-22, 220052, 82), (-20.5, 220181, 77), (1, 220052, 60), (2, 220052, 66), (2, 52, 64), (30, 220052, 9999),
        (1, 220277, 90), (1.5, 220277, 96), (40, 220277, 97),
        (-10, 223901, 12), (1, 223901, 15), (-22.5, 220045, 101), (-22.5, 220045, "n/a"), (-3, 220179, 50.5),
    ]
    chart = [(21, 321, HAND, stamp(t), item, v) for t, item, v in hand]
    for i in [*OTHERS, MINOR]:
        chart += [(i, 300 + i, 9000 + i, stamp(1), 220052, 40 + i), (i, 300 + i, 9000 + i, stamp(1), 220277, 89)]
    paths["chartevents"] = put(
        folder, "chartevents", ["subject_id", "hadm_id", "stay_id", "charttime", "itemid", "valuenum"], chart
    )
    paths["labevents"] = put(
        folder, "labevents", ["hadm_id", "itemid", "charttime", "valuenum"],
        [(321, 50813, stamp(-23), 2.5), (321, 50813, stamp(-22.9), 1.5), (321, 50813, stamp(9), 31), (321, 50821, stamp(0), 80)]
        + [(300 + i, 50813, stamp(3), i / 10) for i in OTHERS],
    )
    drips = [
        (HAND, 221906, stamp(0), stamp(3), 4, 0.2, 61), (HAND, 222315, stamp(2), stamp(4), 8, 0.4, 63),
        (HAND, 220949, stamp(0.5), None, 250, None, 65), (HAND, 220952, stamp(6), stamp(7), 500, None, None),
        # before the window, after it, and of an item nobody listed
        (HAND, 221906, stamp(-60), stamp(-50), 100, 9, 200), (HAND, 220949, stamp(60), None, 7777, None, 300),
        (HAND, 999999, stamp(1), stamp(2), 1, 1, 500),
    ]
    for i in OTHERS:
        for s in range(4):
            drips.append((9000 + i, 221906, stamp(4 * s), stamp(4 * s + 2), 1, (i - 20) * (s + 1) / 100, 50 + i))
            drips.append((9000 + i, 220949, stamp(4 * s + 1.5), None, 10 * i + s, None, 50 + i))
    paths["inputevents"] = put(
        folder, "inputevents", ["stay_id", "itemid", "starttime", "endtime", "amount", "rate", "patientweight"], drips
    )
    paths["outputevents"] = put(
        folder, "outputevents", ["stay_id", "itemid", "charttime", "value"],
        [(HAND, 226559, stamp(-1), 120), (HAND, 226560, stamp(0), 30), (HAND, 226559, stamp(10), -5)],
    )
    return paths


def load(spark, paths):
    raw = {t: readers.raw_table(spark, p, t) for t, p in paths.items() if t not in ("stays", "cultures", "prescriptions")}
    raw["stays"] = readers.read_stays(spark, paths["stays"])
    raw["cultures"] = readers.read_cultures(spark, paths["cultures"])
    raw["prescriptions"] = readers.read_orders_matching(spark, paths["prescriptions"], clinical.ANTIBIOTIC_KEYWORDS)
    return raw


def test_lenient_readers(spark, workspace):
    raw = load(spark, workspace)
    assert {r.subject_id: r.los_hours for r in raw["stays"].collect()}[23] == pytest.approx(50)
    assert dict(raw["stays"].dtypes)["intime"] == "timestamp_ntz"
    assert raw["admissions"].where("deathtime is not null").count() == 1
    assert raw["chartevents"].where("itemid = 220045 and valuenum is null").count() == 1
    times = {r.subject_id: r.culture_time for r in raw["cultures"].collect()}
    assert times[21] == at(5) and times[22] == at(-12)
    assert raw["prescriptions"].count() == 9


def test_strict_boundaries_fail(spark, tmp_path):
    path = put(tmp_path, "stays", ["subject_id", "hadm_id", "stay_id", "intime", "outtime", "los"], [(1, 1, 1, "bad", stamp(0), 1)])
    with pytest.raises(Exception):
        readers.read_stays(spark, path).collect()


def test_filtered_scans(spark, workspace):
    raw = load(spark, workspace)
    owners = spark.createDataFrame([(HAND,), (9022,)], "stay_id long")
    rows = readers.scan_points(raw["chartevents"], (220052,), at(-20), at(2), owners)
    assert rows_of(rows.select("stay_id", "charttime")) == [(HAND, at(1)), (9022, at(1))]
    got = readers.scan_intervals(raw["inputevents"], (220949, 221906), at(-55), at(0.5), owners)
    # touches the bounds: the drip that ends at -50, the ones from 0 on; an open end counts as the start
    assert rows_of(got.where(f"stay_id = {HAND}").select("starttime", "endtime")) == [(at(-60), at(-50)), (at(0), at(3))]
    later = readers.scan_intervals(raw["inputevents"], (220949,), at(0.5), at(1), owners).where(f"stay_id = {HAND}")
    assert rows_of(later.select("starttime", "endtime")) == [(at(0.5), at(0.5))]


def test_pushed_filters_on_landed_events(spark, workspace, tmp_path):
    writers.land_events(load(spark, workspace)["chartevents"], f"{tmp_path}/chart")
    chart = readers.raw_table(spark, f"{tmp_path}/chart", "chartevents", "parquet")
    plan = readers.scan_points(chart, (220052,), at(0), at(9)).select("stay_id", "valuenum")._jdf.queryExecution().toString()
    assert "In(itemid" in plan or "EqualTo(itemid" in plan
    assert "GreaterThanOrEqual(charttime" in plan
    assert "ReadSchema: struct<stay_id:bigint,charttime:timestamp_ntz,itemid:bigint,valuenum:double>" in plan


@pytest.fixture(scope="module")
def finished(spark, workspace, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("out"))
    return run(spark, load(spark, workspace), root)


def test_cohort_onset_and_grid_by_hand(spark, finished):
    assert {r.stay_id for r in spark.read.parquet(finished["cohort"]).collect()} == {9000 + i for i in range(21, 29)}
    excluded = spark.read.parquet(finished["cohort_excluded"]).collect()
    assert [(r.stay_id, r.exclusion_reason) for r in excluded] == [(9029, "age_below_minimum")]
    # even subjects have a culture date only, midnight 13 hours before the order
    onset = {r.stay_id: r.onset_time for r in spark.read.parquet(finished["onset"]).collect()}
    assert onset == {9000 + i: at(1 if i % 2 else -12) for i in range(21, 29)}
    got = {r.stay_id: (r.n_steps, r.truncation_reason) for r in spark.read.parquet(finished["episodes"]).collect()}
    # windows: -36 to 36 for even subjects, -23 to 49 for odd ones
    assert got[HAND] == (18, "not_truncated") and got[9023] == (9, "icu_discharge")
    assert got[9024] == (15, "death") and got[9025] == (14, "onset_near_icu_start") and got[9022][0] == 18


def test_state_of_one_stay_by_hand(spark, finished):
    rows = spark.read.parquet(finished["state_raw"]).where(f"stay_id = {HAND}").orderBy("step_index").collect()
    assert [r.step_index for r in rows] == list(range(18))

    def values(name):
        return [r[name] for r in rows]

    # two readings at hour 2: the item listed later in the dictionary does not win, the later one of (220052, 52) does
    assert values("map") == [77.0] * 6 + [64.0] * 12
    assert [i for i, m in enumerate(values("map_missing")) if not m] == [0, 6]
    # the lower of 90 and 96, then 97; before, the train median or the normal value
    assert values("spo2")[6:] == [90.0] * 9 + [97.0] * 3 and values("spo2_missing")[:7] == [1] * 6 + [0]
    assert values("gcs_total")[3:] == [12.0] * 3 + [15.0] * 12
    assert values("heart_rate") == [101.0] * 18
    # 31 is out of range
    assert values("lactate")[:9] == [2.5] * 9 and values("lactate_missing") == [0] + [1] * 17
    assert values("cum_iv_fluid_ml") == [0.0] * 5 + [250.0] * 2 + [750.0] * 11
    assert values("cum_vasopressor_dose_nor_equiv") == [0.0] * 5 + [4.0] + [12.0] * 12
    assert values("urine_output_4h") == [0.0] * 5 + [150.0, 0.0, 0.0] + [0.0] * 10
    # hour 10: an amount below the valid range is summed, but not seen
    assert [i for i, m in enumerate(values("urine_output_4h_missing")) if not m] == [5]
    # 61, 63, 65: neither the foreign item nor what lies outside the episodes' time counts
    assert {r.weight_kg for r in rows} == {63.0} and {r.age_years for r in rows} == {51.0}
    assert values("pf_ratio_missing") == [1] * 18 and values("shock_index")[5] == pytest.approx(101 / 50.5)
    # points: map below 70, spo2 below 94, coma scale below 15
    assert values("sofa_score")[6:] == [2] * 9 + [1] * 3
    assert {r.mortality_90d for r in rows} == {0}


def test_doses_actions_and_rewards_by_hand(spark, finished):
    where = f"stay_id = {HAND}"
    rows = spark.read.parquet(finished["actions"]).where(where).orderBy("step_index").collect()
    doses = [0.0] * 18
    # hour 0 to 3 at 0.2; hour 2 to 4 at 0.4 of a drug that counts a tenth
    doses[5], doses[6] = 0.2, (0.2 * 2 + 0.04 * 2) / 4
    assert [r.vaso_dose_4h for r in rows] == pytest.approx(doses)
    assert [r.fluid_volume_4h for r in rows] == [0.0] * 5 + [250.0, 0.0, 500.0] + [0.0] * 10
    bins = artifacts.load(spark, finished["artifacts"], "action_bins")
    for r in rows:
        vaso = 0 if r.vaso_dose_4h <= 0 else 1 + sum(r.vaso_dose_4h > e for e in bins["first_edges"])
        fluid = 0 if r.fluid_volume_4h <= 0 else 1 + sum(r.fluid_volume_4h > e for e in bins["second_edges"])
        assert r.action_id == 5 * vaso + fluid
    got = spark.read.parquet(finished["rewards"]).where(where).orderBy("step_index").collect()
    assert [r.terminal for r in got] == [0.0] * 17 + [15.0] and [r.is_terminal for r in got] == [False] * 17 + [True]
    # the score falls by one when 97 comes in
    assert [r.sofa_shaping for r in got][7:] == [0.0] * 8 + [0.025] + [0.0] * 2
    last = spark.read.parquet(finished["rewards"]).where("stay_id = 9024 and is_terminal").first()
    assert last.terminal == -15.0


def test_stored_records_and_replay(spark, finished):
    columns = feature_columns(clinical.clinical_registry())
    assert len(columns) == 62
    replay = readers.read_replay(spark, finished["replay"], columns)
    assert validate_transitions(replay, 62).count() == 0
    meta = artifacts.load(spark, finished["artifacts"], "dataset_meta")
    sizes = {r["split"]: r["n_episodes"] for r in meta["splits"]}
    assert sizes == {"train": 6, "validation": 1, "test": 1} and meta["n_actions"] == 25
    assert meta["feature_columns"] == columns and {r["state_dim"] for r in meta["splits"]} == {62}
    manifest, summary = readers.read_manifest(spark, finished["split"], spec_version="1")
    assert summary["n_keys"] == sizes and summary["seed"] == 42 and manifest.count() == 8
    assert spark.read.parquet(finished["leakage"]).count() == 0
    # the stored medians and scaler give the stored states again
    medians = artifacts.load(spark, finished["artifacts"], "medians")["values"]
    scaler = artifacts.load(spark, finished["artifacts"], "scaler")["features"]
    by_name = {t["feature"]: t for t in scaler}
    assert set(medians) == set(by_name) == set(clinical.clinical_registry())
    raw = spark.read.parquet(finished["state_raw"]).where(f"stay_id = {HAND}").orderBy("step_index").collect()
    scaled = spark.read.parquet(finished["state"]).where(f"stay_id = {HAND}").orderBy("step_index").collect()
    for name in ("map", "lactate", "weight_kg", "hours_since_onset"):
        t = by_name[name]
        want = [(r[name] - t["mean"]) / t["scale"] for r in raw]
        assert [r[name] for r in scaled] == pytest.approx(want)
    with pytest.raises(ValueError):
        readers.read_replay(spark, finished["replay"], ["nothing"])


def test_pipeline_row_limit_and_observed_medians(spark, workspace, tmp_path):
    cfg = PipelineConfig(limit_stays=7, fit_on="observed", n_bins=3)
    paths = run(spark, load(spark, workspace), str(tmp_path), cfg)
    assert spark.read.parquet(paths["state"]).select("stay_id").distinct().count() == 7
    assert spark.read.parquet(paths["actions"]).agg(F.max("action_id")).first()[0] <= 8


def test_metric_log(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    lines = [json.dumps({"step": i, "epoch": 1, "name": "loss", "value": 1.0 / i, "timestamp": 0.0}) for i in (1, 2)]
    log.write_text(lines[0] + "\n\n" + lines[1] + "\n")
    assert readers.read_metric_log(spark, str(log)).count() == 2
