"""Every registered query against its SQL, and what its plan must not contain."""

import compare
import pytest

import __spark_entry__ as contract
from logfold.catalog.oracles import ORACLES
from logfold.catalog.queries import QUERIES

WITHOUT_SQL = {"compact", "storage_stats"}


@pytest.fixture(scope="module")
def con(small):
    return compare.connect(small)


def test_all_queries_have_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, small, con, name):
    assert compare.differences(contract.queries()[name](spark, small), con, contract.oracle_sql()[name]) == []


def test_queries_about_files(spark, small):
    compacted = contract.queries()["compact"](spark, small).first()
    assert compacted.settled and compacted.superseded == 0 and compacted.docs > 0
    sizes = {r.pipeline: r.bytes for r in contract.queries()["storage_stats"](spark, small).collect()}
    assert sizes["A"] > sizes["B"] > 0 and sizes["A"] > sizes["C"] > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0


PLAIN = ["normalize_lines", "signature_counts", "last_record_per_signature", "edge_stored_counts", "strategy_runs",
         "merge_json", "field_lookup", "upsert_snapshot", "recommend_strategy", "comparison_table"]


@pytest.mark.parametrize("name", PLAIN)
def test_plans_have_no_python_and_no_cross_join(spark, small, name):
    plan = contract.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in plan, plan
