"""The plan, ingestion checks and static tables on small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import ingest as I
from ledgerlake.operators import planning as N
from ledgerlake.sources import seeds
from ledgerlake.sources.schemas import SCHEMAS

OLD = "bank string, description string, currency string, kind string, expected long, proposed_kind string, typical long, note string"
NEW = "bank string, description string, currency string, proposed_kind string, typical long, note string"


@pytest.mark.parametrize(
    "old,new,want",
    [
        ([], [("fixed", 10, "n")], ("fixed", 10, "fixed", 10, "n")),
        ([("fixed", 5, "fixed", 5, "o")], [("variable", 10, "n")], ("variable", 10, "variable", 10, "n")),
        ([("ignore", 5, "fixed", 5, "o")], [("variable", 10, "n")], ("ignore", 5, "variable", 10, "n")),
        ([("fixed", 6, "fixed", 5, "o")], [("variable", 10, "n")], ("fixed", 6, "variable", 10, "n")),
        ([("fixed", 5, "fixed", 5, "o")], [], ("fixed", 5, "fixed", 5, N.NOT_DETECTED)),
        ([("fixed", 5, "", 4, "o")], [("variable", 10, "n")], ("fixed", 5, "", 4, "o")),
    ],
)
def test_merge_plan(spark, old, new, want):
    previous = spark.createDataFrame([("b", "d", "PEN", *r) for r in old], OLD)
    proposals = spark.createDataFrame([("b", "d", "PEN", *r) for r in new], NEW)
    (r,) = N.merge_plan(previous, proposals).collect()
    assert (r.kind, r.expected, r.proposed_kind, r.typical, r.note) == want


def test_goal_problems(spark):
    goals = [("ok", 1.0, 3.5, 6, "all", "a", dt.date(2030, 1, 1)), ("bad", 0.0, None, 25, "some", "x", dt.date(2020, 1, 1)), ("null", None, 1.0, None, None, None, None)]
    goal = spark.createDataFrame(goals, "user_id string, goal_amount double, usd_to_pen double, emergency_months int, emergency_basis string, emergency_account string, target_date date")
    accounts = spark.createDataFrame([("ok", "a"), ("ok", "a"), ("bad", "a")], "user_id string, account string")
    found = N.goal_problems(goal, accounts, "2026-01-01").groupBy("user_id").count().collect()
    assert {r.user_id: r["count"] for r in found} == {"bad": 6, "null": 4}


@pytest.mark.parametrize(
    "statement,moves,checks",
    [
        ((0, 50, None, None), [-50, 100], set()),
        ((0, 51, None, None), [-50, 100], {"closing balance"}),
        ((0, 50, 50, 100), [-50, 100], set()),
        ((0, 50, 49, 101), [-50, 100], {"charges total", "credits total"}),
        ((7, 7, 0, None), [], set()),
    ],
)
def test_reconcile(spark, statement, moves, checks):
    s = spark.createDataFrame([("s", *statement)], "id string, opening long, closing long, declared_charges long, declared_credits long")
    m = spark.createDataFrame([("s", c) for c in moves], "id string, cents long")
    assert {r.check for r in I.reconcile(s, m, ["id"]).collect()} == checks


def test_refused_events_do_not_count(spark):
    e = spark.createDataFrame([("a", 0.0, 3), ("a", 10.0, 2), ("a", 20.0, 1), ("a", 100.0, 4), ("b", 0.0, 5)], "who string, at double, count long")
    got = {(r.who, r.at): r.allowed for r in I.rate_limited(e, "who", limit=4, window_seconds=100).collect()}
    assert got == {("a", 0.0): True, ("a", 10.0): False, ("a", 20.0): True, ("a", 100.0): False, ("b", 0.0): False}


def test_experiment_verdict():
    assert I.experiment_verdict([0.4, 0.5, 0.6], {"x": 0.5}, 0.7, {"x": 0.5}, ["x"])[0]
    assert not I.experiment_verdict([0.4, 0.5, 0.6], {"x": 0.5}, 0.7, {"x": 0.4}, ["x"])[0]
    assert not I.experiment_verdict([0.4, 0.5, 0.6], {}, 0.55, {}, [])[0]


def test_static_tables(spark):
    assert seeds.category_dimension(spark).select("category").distinct().count() == 15
    demo = seeds.demo_movements(spark, "2024-05-20", months=8)
    assert demo.count() == 48 and demo.agg(F.max("date")).first()[0] < dt.date(2024, 5, 1)
    assert all(SCHEMAS[t]["user_id"].dataType.simpleString() == "string" for t in SCHEMAS)
