"""Queries with SQL against DuckDB over whole tables, and what the registry promises."""

import glob
import os

import duckdb
import pytest

pytest.importorskip("gridstone.llm")
from gridstone.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    text = lambda r: tuple(str(x) for x in r)
    assert sorted(text(r) for r in got.select(*columns).collect()) == sorted(text(r) for r in want.fetchall())


def test_every_operator_is_registered():
    names = queries.queries()
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)} | {"pipeline"} and set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op1_pii", "op5_chat_formatting", "op8_quality_rules", "op10_mixing", "op12_decontamination"])
def test_native_plans_hold_no_python(spark, name):
    plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))
