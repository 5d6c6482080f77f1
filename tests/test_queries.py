"""Every registered query against its oracle, on the smallest tables."""

import pytest

from ledgerlake.plans import registry
from ledgerlake.sources import crosswalk
from tests.oracle import SF, connect, same

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_theta_join_became_hash_joins(spark):
    plan = QUERIES["transfer_candidates"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_is_pruned_and_filtered(spark):
    plan = QUERIES["rolling_month_window"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan


def test_locf_carries_every_account(spark, con):
    n = con.execute(ORACLES["account_balance_monthly"].replace("select * from balances", "select count(distinct account_id) from balances")).fetchone()[0]
    assert QUERIES["locf_last_value"](spark, SF).select("account_id").distinct().count() == n > 0


def test_inequality_meets_every_order(spark, con):
    n = con.execute("select count(*) from orders").fetchone()[0]
    assert QUERIES["inequality_after_equi"](spark, SF).select("order_id").distinct().count() == n > 0


def test_recurrence_has_every_series(spark, con):
    n = con.execute("with" + crosswalk.MONTHLY_SPEND + " select count(*) from (select distinct user_id, category from monthly_spend)").fetchone()[0]
    assert QUERIES["recurrence_features"](spark, SF).select("user_id", "category").distinct().count() == n > 0


def test_evaluate_builds_each_model_once_and_rejects_cycles(spark):
    built = []
    models = {
        "a": (("src",), lambda s: built.append("a") or s),
        "b": (("a",), lambda a: built.append("b") or a),
        "c": (("a", "b"), lambda a, b: a.unionByName(b)),
        "x": (("y",), lambda y: y),
        "y": (("x",), lambda x: x),
    }
    assert registry.evaluate(models, {"src": spark.range(2)}, "c").count() == 4
    assert built == ["a", "b"]
    with pytest.raises(ValueError, match="cycle"):
        registry.evaluate(models, {}, "x")
