import pytest
from conftest import at, rows_of
from pyspark.sql import functions as F

from stepweave.operators import grid, split


def episodes(spark, inn=-36, out=108, death=None, cfg=grid.GridConfig()):
    onsets = spark.createDataFrame(
        [(1, 2, 3, at(0))], "stay_id long, subject_id long, hadm_id long, onset_time timestamp_ntz"
    )
    stays = spark.createDataFrame([(1, at(inn), at(out))], "stay_id long, intime timestamp_ntz, outtime timestamp_ntz")
    deaths = spark.createDataFrame([(3, None if death is None else at(death))], "hadm_id long, deathtime timestamp_ntz")
    return grid.grid_episodes(onsets, stays, deaths, cfg)


def test_full_grid(spark):
    eps = episodes(spark)
    e = eps.first()
    assert (e.n_steps, e.is_truncated, e.truncation_reason, e.truncation_step) == (18, False, grid.NOT_TRUNCATED, None)
    steps = grid.grid_steps(eps).orderBy("step_index").collect()
    assert [s.step_index for s in steps] == list(range(18))
    assert all(a.step_end == b.step_start for a, b in zip(steps, steps[1:]))
    assert steps[0].step_start == at(-24) and steps[-1].step_end == at(48)
    assert [s.is_pre_onset for s in steps] == [True] * 6 + [False] * 12
    assert [s.hours_relative for s in steps][:2] == [-24, -20]


@pytest.mark.parametrize(
    "kw, n, reason, last, end",
    [
        ({"out": 12}, 9, grid.DISCHARGE, 8, 12),
        ({"death": 20}, 11, grid.DEATH, 10, 20),
        ({"death": 21}, 12, grid.DEATH, 11, 21),
        ({"death": 100}, 18, grid.NOT_TRUNCATED, None, 48),
        ({"inn": -4}, 13, grid.NEAR_START, 17, 48),
        ({"inn": -3}, 13, grid.NEAR_START, 17, 48),
        ({"out": 12, "death": 20}, 9, grid.DEATH, 8, 12),
        ({"out": -30}, 0, grid.DISCHARGE, None, -30),
    ],
)
def test_truncation(spark, kw, n, reason, last, end):
    eps = episodes(spark, **kw)
    e = eps.first()
    assert (e.n_steps, e.truncation_reason, e.truncation_step, e.actual_end) == (n, reason, last, at(end))
    steps = grid.grid_steps(eps).orderBy("step_index").collect()
    assert len(steps) == n
    if n:
        assert steps[-1].step_end == at(end)


def test_late_start_keeps_the_original_step_start(spark):
    first = grid.grid_steps(episodes(spark, inn=-3)).orderBy("step_index").first()
    assert first.step_index == 5 and first.step_start == at(-4)


def test_other_step_lengths(spark):
    for hours, n in ((2, 36), (6, 12)):
        cfg = grid.GridConfig(step_hours=hours)
        eps = episodes(spark, cfg=cfg)
        assert eps.first().n_steps == n and grid.grid_steps(eps, cfg).count() == n


def test_point_events_respect_borders(spark):
    eps = episodes(spark, inn=-3, out=13)
    times = [-24, -4.5, -4, -0.001, 0, 4, 12.5, 13]
    events = spark.createDataFrame([(1, at(t), float(t)) for t in times], "stay_id long, t timestamp_ntz, v double")
    got = {r.v: r.step_index for r in grid.events_in_steps(events, eps, "stay_id", "t").collect()}
    assert got == {-4.0: 5, -0.001: 5, 0.0: 6, 4.0: 7, 12.5: 9}
    early = grid.events_in_steps(events, eps, "stay_id", "t", from_window_start=True)
    assert {r.v for r in early.collect()} == {-24.0, -4.5, -4.0, -0.001, 0.0, 4.0, 12.5}


def test_intervals_are_cut_at_borders(spark):
    eps = episodes(spark, inn=-3, out=13)
    spans = [(1, -30.0, -2.0), (2, 3.0, 9.0), (3, 12.0, 40.0), (4, 5.0, 5.0), (5, 13.0, 14.0)]
    rows = spark.createDataFrame(
        [(1, i, at(a), at(b)) for i, a, b in spans], "stay_id long, i int, s timestamp_ntz, e timestamp_ntz"
    )
    cut = grid.intervals_in_steps(rows, eps, "stay_id", "s", "e").select("i", "step_index", "overlap_hours")
    assert rows_of(cut, "i", "step_index") == [(1, 5, 2.0), (2, 6, 1.0), (2, 7, 4.0), (2, 8, 1.0), (3, 9, 1.0)]


def test_grid_audit(spark):
    eps = episodes(spark).union(episodes(spark, out=12))
    a = grid.grid_audit(eps).first()
    assert (a.total_episodes, a.full_length, a.truncated_pct, a.avg_steps, a.min_steps) == (2, 1, 50.0, 13.5, 9)
    assert grid.grid_audit(eps.limit(0)).first().avg_steps == 0


def patients(spark, n, per=1):
    return spark.range(n * per).select((F.col("id") % n).alias("subject_id"), F.col("id").alias("stay_id"))


@pytest.mark.parametrize("n, sizes", [(100, (70, 15, 15)), (15, (10, 2, 3)), (45, (31, 7, 7))])
def test_split_sizes_round_half_even(spark, n, sizes):
    got = split.group_split(patients(spark, n, 2)).groupBy("split").count().collect()
    counts = {r.split: r["count"] for r in got}
    assert (counts["train"], counts["validation"], counts["test"]) == sizes


def test_split_is_stable_and_seeded(spark):
    a = rows_of(split.group_split(patients(spark, 60), seed=1))
    assert a == rows_of(split.group_split(patients(spark, 60).repartition(7), seed=1))
    assert a != rows_of(split.group_split(patients(spark, 60), seed=2))


@pytest.mark.parametrize("train, val", [(0, 0.1), (1.0, 0.1), (0.5, 0), (0.8, 0.2), (0.9, 0.5)])
def test_bad_fractions(spark, train, val):
    with pytest.raises(ValueError):
        split.group_split(patients(spark, 5), train=train, val=val)


def test_manifest_round_trip_and_stats(spark):
    eps = patients(spark, 10, 3)
    splits = split.group_split(eps)
    manifest = split.split_manifest(eps, splits)
    arrays = split.manifest_arrays(manifest).collect()
    assert all(r.episode_keys == [r.subject_id, r.subject_id + 10, r.subject_id + 20] for r in arrays)
    assert manifest.count() == 30 and {r.n_episodes for r in arrays} == {3}
    stats = {r.split: r for r in split.split_stats(eps.withColumn("died", F.lit(1)), splits, outcome="died").collect()}
    assert stats["train"].n_patients == 7 and stats["train"].n_episodes == 21 and stats["train"].mortality_rate == 1.0


def test_manifest_of_a_hot_subject_has_the_same_shape(spark):
    eps = spark.range(500).select(F.lit(1).cast("long").alias("subject_id"), F.col("id").alias("stay_id"))
    splits = spark.createDataFrame([(1, "train")], "subject_id long, split string")
    rows = split.split_manifest(eps, splits).collect()
    assert sorted(r.stay_id for r in rows) == list(range(500)) and {r.n_episodes for r in rows} == {500}


def test_leakage(spark):
    good = spark.createDataFrame([(1, "train"), (2, "test")], "subject_id long, split string")
    assert split.leakage_check(good).count() == 0
    assert split.leakage_check(good.union(spark.createDataFrame([(1, "test")], good.schema))).count() == 1


def test_unknown_subject_fails(spark):
    splits = spark.createDataFrame([(1, "train")], "subject_id long, split string")
    rows = spark.createDataFrame([(1,), (2,)], "subject_id long")
    with pytest.raises(Exception, match="no split"):
        split.attach_split(rows, splits).collect()
