"""Every catalogue query against its SQL oracle, and rules for all plans."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from stepweave.plans.catalog import CATALOG
from stepweave.plans.study import Study

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
ORACLE = entry_module.oracle_sql()
ROWS_ONLY: set[str] = set()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="bundled tables not present")


@pytest.fixture(scope="module")
def study(spark):
    return Study(spark, SF)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in sorted(os.listdir(SF)):
        name = file.removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6f}"
    return str(value)


def test_every_query_has_an_oracle():
    assert set(CATALOG) - set(ORACLE) == ROWS_ONLY
    assert set(ORACLE) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(name, study, duck):
    df = CATALOG[name](study)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert banned not in plan
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in ROWS_ONLY:
        assert got
        return
    result = duck.sql(ORACLE[name])
    assert sorted(result.columns) == cols
    at = [result.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "view_last_missing" in df.columns


def test_ragged_orders_are_written_by_many_tasks(spark, study, monkeypatch):
    whole = Study.table
    monkeypatch.setattr(Study, "table", lambda s, name: whole(s, name).repartition(3))
    path = Study(spark, SF).ragged_orders.removeprefix("file:")
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(files) == 3
    lines = [open(f"{path}/{f}").read().splitlines() for f in files]
    assert {x[0] for x in lines} == {"subject_id,hadm_id,starttime,stoptime,drug,route"}
    assert sorted(y for x in lines for y in x[1:]) == sorted(r[0] for r in spark.read.csv(path, sep="\x01", header=True).collect())
    assert sum(len(x) - 1 for x in lines) == whole(study, "orders").count()


def test_raw_tables_are_parsed_once(study):
    for rows in study.from_text.raw.values():
        assert rows.inputFiles() and all(f.endswith(".parquet") for f in rows.inputFiles())
