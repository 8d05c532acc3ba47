"""The driver contract: entry() runs; every query with a SQL twin matches DuckDB; no plan of any job emits pairs."""

import glob
import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from conftest import EVENTS  # noqa: E402
from oracle_harness import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"

#: Rows that a query without a twin must have; those of the text operators are in tests/llm.
ROWS = {"synth_copula": "lineitem", "pca_scores": "lineitem", "pca_variance": 2}

#: Operators of a plan that grow with the product of their sides.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "mean_preservation" in df.columns


def test_every_oracle_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert {n for n in E.queries() if n not in E.oracle_sql() and not n.startswith("op") and n != "pipeline"} == set(ROWS)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, name):
    con = duck(SF)
    spark.sparkContext.setJobDescription(f"query {name}")
    try:
        r = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SF)
    finally:
        spark.sparkContext.setJobDescription(None)
    assert r["ok"] is not False, r
    if name in ROWS:
        want = ROWS[name]
        assert r["rows"] == (want if isinstance(want, int) else con.sql(f"SELECT count(*) FROM {want}").fetchall()[0][0])
    elif r["ok"] is None:
        assert r["rows"] > 0


def test_no_job_of_a_query_emits_pairs():
    """The plans of all jobs the queries above have run, those of written stages and adaptive changes included."""
    whose, bad, seen = {}, [], set()
    for path in glob.glob(f"{EVENTS}/*"):
        with open(path) as log:
            for line in log:
                if '"org.apache.spark.sql.execution.ui.SparkListenerSQL' not in line:
                    continue
                try:
                    e = json.loads(line)
                except ValueError:      # the line being written
                    continue
                if e["Event"].endswith("ExecutionStart"):
                    whose[e["executionId"]] = e.get("description", "")
                name = whose.get(e.get("executionId"), "")
                if name.startswith("query "):
                    seen.add(name)
                    bad += [(name, k) for k in FORBIDDEN if k in e.get("physicalPlanDescription", "")]
    assert len(seen) >= len(E.queries()) - 2 and not bad, sorted(set(bad))
