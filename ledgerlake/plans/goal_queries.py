"""Queries of the goal projection over customers' plans and order flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import goal as G
from ledgerlake.plans.registry import query
from ledgerlake.sources import crosswalk as X
from ledgerlake.sources.scratch import staged

#: A plan per region; income and spending are its monthly order totals in hundreds of cents.
_BASE = (
    "with"
    + X.MONTHLY_SPEND
    + """, plan as (
    select cast(r_regionkey as bigint) as user_id, cast(2000000 + 700000 * r_regionkey as double) as goal_amount, cast(3.5 + 0.125 * r_regionkey as double) as usd_to_pen, cast(3 + r_regionkey as double) as emergency_months,
        case when r_regionkey = 2 then 'fixed_only' else 'all' end as emergency_basis, case when r_regionkey <> 4 then cast(date '2003-07-01' + to_months(cast(r_regionkey * 6 as integer)) as date) end as target_date, date '2001-07-01' as run_month
    from region
), spend as (select user_id, case when category like '%1-URGENT' then 'USD' else 'PEN' end as currency, month, cast(sum(cents) as double) / 10000 as amount from monthly_spend where category not like 'MACHINERY%' group by 1, 2, 3),
earned as (select user_id, case when category like '%1-URGENT' then 'USD' else 'PEN' end as currency, month, cast(sum(cents) as double) / 2500 as amount from monthly_spend where category like 'MACHINERY%' group by 1, 2, 3),
fixed as (select user_id, 'PEN' as currency, cast(500 + 10 * user_id as double) as fixed from plan),
grid as (select user_id, currency, cast(unnest(generate_series(cast(a as timestamp), timestamp '2001-07-01', interval 1 month)) as date) as month from (select user_id, currency, min(month) as a from earned group by 1, 2)),
history as (select g.user_id, g.currency, g.month, coalesce(e.amount, 0) as amount from grid g left join earned e on e.user_id = g.user_id and e.currency = g.currency and e.month = g.month),
last12 as (select * from (select *, row_number() over (partition by user_id, currency order by month desc) as r from history) where r <= 12),
scen as (select unnest(['base', 'cautious', 'optimistic']) as scenario),
income as (select user_id, currency, scenario, case scenario when 'base' then quantile_cont(amount, 0.5) when 'cautious' then quantile_cont(amount, 0.25) else quantile_cont(amount, 0.75) end as income from last12, scen group by 1, 2, 3),
last6 as (select * from (select *, row_number() over (partition by user_id, currency order by month desc) as r from spend) where r <= 6),
mid as (select user_id, currency, median(amount) as m from last6 group by 1, 2),
future as (select user_id, currency, h as horizon, m as p50, case when h <= 6 then m * (1 - h / 100.0) end as p10, case when h <= 8 then m * (1 + h / 50.0) end as p90 from mid, (select unnest(generate_series(1, 36)) as h)),
spending as (
    select user_id, currency, scenario, i as month_index, p50 + case scenario when 'base' then 0.0 when 'cautious' then -p50 + p90x else -p50 + p10x end as variable from (
        select f.user_id, f.currency, i, f.p50, g.p10 as p10x, k.p90 as p90x from (select unnest(generate_series(1, 120)) as i) join future f on f.horizon = least(i, 36)
        join future g on g.user_id = f.user_id and g.currency = f.currency and g.horizon = least(i, 6) join future k on k.user_id = f.user_id and k.currency = f.currency and k.horizon = least(i, 8)
    ), scen
), names as (select user_id, currency, scenario from income union select user_id, currency, scenario from fixed, scen union select user_id, currency, scenario from spending),
flows as (
    select n.user_id, n.scenario, i as month_index, cast(date '2001-07-01' + to_months(cast(i as integer)) as date) as month, n.currency, coalesce(c.income, 0) as income, coalesce(f.fixed, 0) as fixed, coalesce(s.variable, 0) as variable
    from names n join (select unnest(generate_series(1, 120)) as i) on true left join income c on c.user_id = n.user_id and c.currency = n.currency and c.scenario = n.scenario
    left join fixed f on f.user_id = n.user_id and f.currency = n.currency left join spending s on s.user_id = n.user_id and s.currency = n.currency and s.scenario = n.scenario and s.month_index = i
), essential as (
    select user_id, currency, sum(amount) as amount from (select user_id, currency, fixed as amount from fixed union all select m.user_id, m.currency, m.m from mid m join plan p on p.user_id = m.user_id and p.emergency_basis <> 'fixed_only') group by 1, 2
), balances as (
    select user_id, 'essential' as bucket, currency, amount from essential union all select user_id, 'emergency', 'USD', 1000.0 * (user_id + 1) from plan
    union all select user_id, 'other_liquid', 'PEN', 9000.0 from plan union all select user_id, 'risk', 'USD', 5000.0 from plan
)"""
)


def plan(spark, sf_dir):
    k = F.col("r_regionkey")
    target = F.when(k != 4, F.add_months(F.lit("2003-07-01").cast("date"), (k * 6).cast("int")))
    return X.table(spark, sf_dir, "region").select(
        k.cast("long").alias("user_id"), (2000000 + 700000 * k).cast("double").alias("goal_amount"), (3.5 + 0.125 * k).alias("usd_to_pen"), (3 + k).cast("double").alias("emergency_months"),
        F.when(k == 2, "fixed_only").otherwise("all").alias("emergency_basis"), target.alias("target_date"), F.lit("2001-07-01").cast("date").alias("run_month"),
    )


def inputs(spark, sf_dir):
    s = X.monthly_spend(spark, sf_dir).withColumn("currency", F.when(F.col("category").endswith("1-URGENT"), "USD").otherwise("PEN"))
    by = lambda rows, unit: rows.groupBy("user_id", "currency", "month").agg((F.sum("cents").cast("double") / unit).alias("amount"))
    machinery = F.col("category").startswith("MACHINERY")
    spend, earned = by(s.where(~machinery), 10000), by(s.where(machinery), 2500)
    p = plan(spark, sf_dir)
    fixed = p.select("user_id", F.lit("PEN").alias("currency"), (500 + 10 * F.col("user_id")).cast("double").alias("fixed"))
    return p, spend, earned, fixed


def built(spark, sf_dir):
    p, spend, earned, fixed = inputs(spark, sf_dir)
    none = spark.createDataFrame([], "user_id long, currency string, override double")
    income = G.scenario_income(G.income_history(earned, F.lit(X.AS_OF_ORDERS).cast("date")), none)
    mid = G.essential(p, fixed.limit(0), spend)
    every = p.withColumn("emergency_basis", F.lit("all"))
    middle = G.essential(every, fixed.limit(0), spend).withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(36))))
    h, m = F.col("horizon"), F.col("amount")
    future = middle.select("user_id", "currency", "horizon", m.alias("p50"), F.when(h <= 6, m * (1 - h / 100.0)).alias("p10"), F.when(h <= 8, m * (1 + h / 50.0)).alias("p90"))
    flows = G.cashflow(p, income, fixed, G.scenario_spending(future))
    need = G.essential(p, fixed, spend).select("user_id", F.lit("essential").alias("bucket"), "currency", "amount")
    row = lambda bucket, currency, amount: p.select("user_id", F.lit(bucket).alias("bucket"), F.lit(currency).alias("currency"), amount.alias("amount"))
    balances = need.unionByName(row("emergency", "USD", 1000.0 * (F.col("user_id") + 1))).unionByName(row("other_liquid", "PEN", F.lit(9000.0))).unionByName(row("risk", "USD", F.lit(5000.0)))
    return p, balances, staged(flows), mid


@query(_BASE + " select user_id, scenario, cast(month_index as bigint) as month_index, month, currency, round(income, 2) as income, round(fixed, 2) as fixed, round(variable, 2) as variable from flows")
def goal_cashflow(spark, sf_dir):
    f = built(spark, sf_dir)[2]
    return f.select("user_id", "scenario", F.col("month_index").cast("long").alias("month_index"), "month", "currency", *(F.round(c, 2).alias(c) for c in ("income", "fixed", "variable")))


@query(_BASE + " select user_id, bucket, currency, round(amount, 2) as amount from balances")
def goal_balances(spark, sf_dir):
    return built(spark, sf_dir)[1].select("user_id", "bucket", "currency", F.round("amount", 2).alias("amount"))


def _dynamic(goal: str = "p.goal_amount", rate: str = "p.usd_to_pen", months: str = "p.emergency_months") -> str:
    return (
        _BASE
        + f""", params as (select p.user_id, p.target_date, p.run_month, {goal} as goal, {rate} as rate, {months} as em from plan p),
held as (select b.user_id, bucket, case currency when 'USD' then amount when 'PEN' then amount / rate end as usd from balances b join params p on p.user_id = b.user_id),
start as (select user_id, coalesce(sum(usd) filter (where bucket = 'emergency'), 0) as emergency_now, coalesce(sum(usd) filter (where bucket = 'other_liquid'), 0) as other_liquid,
    coalesce(sum(usd) filter (where bucket = 'risk'), 0) as risk, coalesce(sum(usd) filter (where bucket = 'essential'), 0) as essential from held group by 1),
sized as (select s.*, p.target_date, p.run_month, p.goal, p.em * s.essential as target from start s join params p on p.user_id = s.user_id),
monthly as (select f.user_id, scenario, month_index, month, sum(case currency when 'USD' then income else income / rate end) as income,
    sum(case currency when 'USD' then income - fixed - variable else (income - fixed - variable) / rate end) as saving from flows f join params p on p.user_id = f.user_id group by 1, 2, 3, 4),
scenarios as (select user_id, scenario, avg(saving) filter (where month_index <= 3) as projected, max(income) filter (where month_index = 1) as income from monthly group by 1, 2),
cumulative as (select user_id, scenario, month_index, month, sum(saving) over (partition by user_id, scenario order by month_index) as saved from monthly
    union all select c.user_id, scenario, 0, run_month, 0.0 from scenarios c join sized s on s.user_id = c.user_id),
path as (select c.user_id, scenario, line, month_index, month, emergency_now + saved - target as spare, least(greatest(emergency_now + saved, 0), target) as emergency, goal,
    case line when 'liquid' then other_liquid else other_liquid + risk end + greatest(0, emergency_now + saved - target) as progress, case line when 'liquid' then other_liquid else other_liquid + risk end as counted
    from cumulative c join sized s on s.user_id = c.user_id, (select unnest(['liquid', 'with_risk']) as line)),
reached as (select *, min(month_index) filter (where progress >= goal - 0.000000001) over w as months_to_goal, min(month) filter (where progress >= goal - 0.000000001) over w as reached_month,
    min(month_index) filter (where spare >= -0.000000001) over w as months_to_fill from path window w as (partition by user_id, scenario, line)),
answer as (select r.*, c.projected, c.income, s.target, s.emergency_now, s.essential,
    year(s.target_date) * 12 + month(s.target_date) - year(s.run_month) * 12 - month(s.run_month) as months_left
    from reached r join sized s on s.user_id = r.user_id join scenarios c on c.user_id = r.user_id and c.scenario = r.scenario)"""
    )


_SHOWN = """ select user_id, scenario, line, cast(month_index as bigint) as month_index, month, round(emergency, 2) as emergency, round(progress, 2) as goal_progress, cast(months_to_goal as bigint) as months_to_goal, reached_month,
    cast(months_to_fill as bigint) as months_to_fill, round(projected, 2) as projected_monthly_saving,
    round(case when months_left is null or months_left < 1 then null when goal - counted <= 0 then 0.0 else greatest(0, (target + goal - counted - emergency_now) / months_left) end, 2) as required_monthly_saving from answer"""


def _shown(path):
    return path.select(
        "user_id", "scenario", "line", F.col("month_index").cast("long").alias("month_index"), "month", F.round("emergency", 2).alias("emergency"), F.round("goal_progress", 2).alias("goal_progress"), F.col("months_to_goal").cast("long").alias("months_to_goal"), "reached_month",
        F.col("months_to_fill").cast("long").alias("months_to_fill"), F.round("projected_monthly_saving", 2).alias("projected_monthly_saving"), F.round("required_monthly_saving", 2).alias("required_monthly_saving"),
    )


@query(_dynamic() + _SHOWN)
def goal_projection(spark, sf_dir):
    p, balances, flows, _ = built(spark, sf_dir)
    return _shown(G.dynamic_goal(G.parameters(p), balances, flows))


@query(_dynamic("1500000.0", "4.0", "6.0") + _SHOWN)
def goal_dynamic(spark, sf_dir):
    p, balances, flows, _ = built(spark, sf_dir)
    typed = G.parameters(p, G.typed_number("1,500,000"), G.typed_number("4"), G.typed_number("6"))
    return _shown(G.dynamic_goal(typed, balances, flows))


@query(_dynamic() + """ select distinct user_id, scenario, round(target, 2) as emergency_target, round(emergency_now, 2) as emergency_now, round(greatest(0, target - emergency_now), 2) as gap, round(case when essential > 0 then emergency_now / essential end, 6) as months_covered,
    round(case when income > 0 then target / income end, 6) as months_of_income, round(case when income > 0 then projected / income end, 6) as savings_rate, essential > income as essential_over_income, target > 24 * income as target_over_two_years_income from answer""")
def emergency_fund(spark, sf_dir):
    p, balances, flows, _ = built(spark, sf_dir)
    d = G.dynamic_goal(G.parameters(p), balances, flows)
    return d.where("month_index = 0 and line = 'liquid'").select(
        "user_id", "scenario", *(F.round(c, 2).alias(n) for c, n in (("emergency_target", "emergency_target"), ("emergency_now", "emergency_now"), ("emergency_gap", "gap"))),
        *(F.round(c, 6).alias(c) for c in ("months_covered", "months_of_income", "savings_rate")), "essential_over_income", "target_over_two_years_income",
    )


_ROOMS = """, cats as (select user_id, category, case when category like '%1-URGENT' then 'USD' else 'PEN' end as currency, cents / 10000.0 as v, row_number() over (partition by user_id, category order by month desc) as r from monthly_spend),
rooms as (select c.user_id, category, currency, (case currency when 'USD' then 1.0 else 1 / p.usd_to_pen end) * max(v) filter (where r = 1) as forecast, (case currency when 'USD' then 1.0 else 1 / p.usd_to_pen end) * quantile_cont(v, 0.25) as reference
    from cats c join plan p on p.user_id = c.user_id where r <= 12 group by c.user_id, category, currency, p.usd_to_pen),
room as (select *, greatest(0, forecast - reference) as headroom from rooms)"""


def rooms(spark, sf_dir):
    p = plan(spark, sf_dir)
    s = X.monthly_spend(spark, sf_dir).withColumn("currency", F.when(F.col("category").endswith("1-URGENT"), "USD").otherwise("PEN"))
    order = F.reverse(F.sort_array(F.collect_list(F.struct("month", (F.col("cents") / 10000.0).alias("v")))))
    last = s.groupBy("user_id", "category", "currency").agg(F.transform(F.slice(order, 1, 12), lambda x: x["v"]).alias("last12")).withColumn("forecast", F.get("last12", F.lit(0)))
    return G.headroom(last, p.select("user_id", "usd_to_pen"))


@query(_BASE + _ROOMS + " select user_id, category, currency, round(forecast, 2) as forecast, round(reference, 2) as reference, round(headroom, 2) as headroom, round(headroom / sum(headroom) over (partition by user_id), 6) as share from room")
def headroom(spark, sf_dir):
    return rooms(spark, sf_dir).select("user_id", "category", "currency", *(F.round(c, 2).alias(c) for c in ("forecast", "reference", "headroom")), F.round("share", 6).alias("share"))


@query(
    _dynamic()
    + _ROOMS
    + """, need as (select distinct user_id, scenario, line, months_to_goal, reached_month, projected, case when months_left is null or months_left < 1 then null when goal - counted <= 0 then 0.0 else greatest(0, (target + goal - counted - emergency_now) / months_left) end as required from answer),
total as (select user_id, sum(headroom) as t from room group by 1)
select n.user_id, scenario, line, cast(months_to_goal as bigint) as months_to_goal, reached_month, round(required, 2) as required_monthly_saving, round(projected, 2) as projected_monthly_saving,
    round(case when required is not null then greatest(0, required - projected) end, 2) as gap, round(t / nullif(case when required is not null then greatest(0, required - projected) end, 0), 6) as headroom_share_of_gap from need n join total t on t.user_id = n.user_id"""
)
def goal_summary(spark, sf_dir):
    p, balances, flows, _ = built(spark, sf_dir)
    g = G.goal_summary(G.dynamic_goal(G.parameters(p), balances, flows), rooms(spark, sf_dir))
    return g.select("user_id", "scenario", "line", F.col("months_to_goal").cast("long").alias("months_to_goal"), "reached_month", *(F.round(c, 2).alias(c) for c in ("required_monthly_saving", "projected_monthly_saving", "gap")), F.round("headroom_share_of_gap", 6).alias("headroom_share_of_gap"))


@query(
    _BASE
    + """, f as (select e.user_id, e.month, e.amount as income, s.amount as spending, sum(e.amount - s.amount * case when month(e.month) = 3 then 3 else 1 end) over (partition by e.user_id order by e.month) as liquid
    from earned e join spend s on s.user_id = e.user_id and s.currency = e.currency and s.month = e.month where e.currency = 'USD'),
recent as (select * from (select *, row_number() over (partition by user_id order by month desc) as r from f) where r <= 7),
pairs as (select *, liquid - lag(liquid) over (partition by user_id order by month) as change, income - spending as net from recent)
select user_id, count(*) filter (where abs(net - change) > 0.25 * spending) as mismatch_months, count(*) as months_checked, round(avg(net), 2) as avg_net_flow, round(avg(change), 2) as avg_balance_change,
    count(*) filter (where abs(net - change) > 0.25 * spending) * 2 > count(*) as balance_mismatch from pairs where change is not null group by 1"""
)
def balance_cross_check(spark, sf_dir):
    from pyspark.sql import Window

    _, spend, earned, _ = inputs(spark, sf_dir)
    both = earned.where("currency = 'USD'").withColumnRenamed("amount", "income").join(spend.withColumnRenamed("amount", "spending"), ["user_id", "currency", "month"])
    w = Window.partitionBy("user_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    flows = both.withColumn("liquid", F.sum(F.col("income") - F.col("spending") * F.when(F.month("month") == 3, 3).otherwise(1)).over(w))
    c = G.cross_check(flows)
    return c.select("user_id", "mismatch_months", "months_checked", F.round("avg_net_flow", 2).alias("avg_net_flow"), F.round("avg_balance_change", 2).alias("avg_balance_change"), "balance_mismatch")
