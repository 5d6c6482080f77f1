"""Queries of single join and window shapes that the reports build on."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlake.functions import scalars as S
from ledgerlake.operators import balances as B
from ledgerlake.operators import movements as M
from ledgerlake.operators.calendar import date_dimension, months_from
from ledgerlake.plans.balance_queries import _BALANCES
from ledgerlake.plans.goal_queries import _BASE, plan
from ledgerlake.plans.registry import query
from ledgerlake.plans.report_queries import _FACT, fact
from ledgerlake.plans.scalar_queries import _MERCHANTS, _RULES
from ledgerlake.sources import crosswalk as X


@query("with" + X.MONTHLY_SPEND + """, months as (select distinct month from monthly_spend), firsts as (select user_id, category, min(month) as a from monthly_spend group by 1, 2)
select f.user_id, f.category, m.month from firsts f join months m on f.a <= m.month""")
def scaffold_range_join(spark, sf_dir):
    """Every month from a series' first to the last of all: a sequence, in place of a join by <=."""
    s = X.monthly_spend(spark, sf_dir)
    last = s.agg(F.max("month").alias("b"))
    return s.groupBy("user_id", "category").agg(F.min("month").alias("a")).join(F.broadcast(last)).select("user_id", "category", F.explode(months_from(F.col("a"), F.col("b"))).alias("month"))


@query(_BALANCES + """, span as (select account_id, min(month_start) as a, date '2001-07-01' as b from balances group by 1),
every as (select account_id, cast(unnest(generate_series(cast(a as timestamp), cast(b as timestamp), interval 1 month)) as date) as month_start from span)
select e.account_id, e.month_start, last_value(b.closing ignore nulls) over (partition by e.account_id order by e.month_start) as closing from every e left join balances b on b.account_id = e.account_id and b.month_start = e.month_start""")
def locf_last_value(spark, sf_dir):
    """Each account's last known balance in every month from its first on."""
    b = B.month_end_balances(X.statements(spark, sf_dir))
    span = b.groupBy("account_id").agg(F.min("month_start").alias("a"))
    every = span.select("account_id", F.explode(months_from(F.col("a"), F.lit("2001-07-01").cast("date"))).alias("month_start"))
    w = Window.partitionBy("account_id").orderBy("month_start").rowsBetween(Window.unboundedPreceding, 0)
    return every.join(b.select("account_id", "month_start", "closing"), ["account_id", "month_start"], "left").withColumn("closing", F.last("closing", ignorenulls=True).over(w))


@query(_BALANCES + " select account_id, month_start, dense_rank() over (order by month_start desc) as month_recency from balances")
def global_dense_rank(spark, sf_dir):
    return B.recency(B.month_end_balances(X.statements(spark, sf_dir)).select("account_id", "month_start"))


@query("with" + X.LEDGER + """ select order_id, min(date) filter (where cents < 0) over (partition by account_id) as first_outflow, max(cents) filter (where cents < 0) over (partition by account_id) as smallest_outflow from ledger""")
def window_min_filtered(spark, sf_dir):
    w = Window.partitionBy("account_id")
    out = lambda c: F.when(F.col("cents") < 0, F.col(c))
    return X.ledger(spark, sf_dir).select("order_id", F.min(out("date")).over(w).alias("first_outflow"), F.max(out("cents")).over(w).alias("smallest_outflow"))


@query("with" + X.STATEMENTS + """ select account_id, month_start, lag(closing) over w as previous_closing, cast(year(month_start) * 12 + month(month_start) - lag(year(month_start) * 12 + month(month_start)) over w as bigint) as months_since
from statements window w as (partition by account_id order by month_start)""")
def lag_continuity(spark, sf_dir):
    w = Window.partitionBy("account_id").orderBy("month_start")
    i = S.month_index(F.col("month_start"))
    return X.statements(spark, sf_dir).select("account_id", "month_start", F.lag("closing").over(w).alias("previous_closing"), (i - F.lag(i).over(w)).alias("months_since"))


@query("with" + X.STATEMENTS + """, f as (select account_id, min_by(opening, month_start) as opening, max_by(closing, month_start) as closing, min(month_start) as first_month, max(month_start) as last_month from statements group by 1)
select account_id, opening, closing, first_month, last_month from f""")
def first_and_last_statement(spark, sf_dir):
    s = X.statements(spark, sf_dir).groupBy("account_id")
    return s.agg(F.min_by("opening", "month_start").alias("opening"), F.max_by("closing", "month_start").alias("closing"), F.min("month_start").alias("first_month"), F.max("month_start").alias("last_month"))


@query("with" + X.LEDGER + """, m as (select account_id, cents, order_id from ledger), s as (select account_id, max(date) as closing_date from ledger group by 1)
select m.order_id, s.closing_date, count(l.order_id) as n_before, cast(coalesce(sum(l.cents), 0) as bigint) as cents_before from m join s using (account_id) left join ledger l on l.account_id = m.account_id and l.date < s.closing_date and l.order_id < m.order_id group by 1, 2""")
def inequality_after_equi(spark, sf_dir):
    """What an equi-join on the account with inequalities gives, by one running window instead of the join."""
    account = Window.partitionBy("account_id")
    led = X.ledger(spark, sf_dir).select("account_id", "order_id", "date", "cents").withColumn("closing_date", F.max("date").over(account))
    w, before = account.orderBy("order_id").rangeBetween(Window.unboundedPreceding, -1), F.col("date") < F.col("closing_date")
    return led.select("order_id", "closing_date", F.count(F.when(before, 1)).over(w).alias("n_before"), F.coalesce(F.sum(F.when(before, F.col("cents"))).over(w), F.lit(0)).alias("cents_before"))


@query(_FACT + f""" select order_id, flow_type, signed_cents, cast(year(date) as bigint) as calendar_year, cast(quarter(date) as bigint) as calendar_quarter, cast(month(date) as bigint) as calendar_month,
    strftime(date, '%B') as calendar_month_name, strftime(date, '%A') as calendar_day_name from fact where date < date '{X.AS_OF_ORDERS}'""")
def movements_with_calendar(spark, sf_dir):
    f = fact(spark, sf_dir).where(S.closed_month(F.col("date"), X.AS_OF_ORDERS))
    days = date_dimension(f.select("date")).select("date", F.col("year_number").alias("calendar_year"), F.col("quarter_number").alias("calendar_quarter"), F.col("month_number").alias("calendar_month"), F.col("month_name").alias("calendar_month_name"), F.col("day_name").alias("calendar_day_name"))
    return f.select("order_id", "date", "flow_type", "signed_cents").join(F.broadcast(days), "date").drop("date")


@query(_BASE + " select user_id, goal_amount, usd_to_pen, emergency_months, emergency_basis, target_date, cast(36 as bigint) as horizon_months from plan")
def goal_plan(spark, sf_dir):
    return plan(spark, sf_dir).select("user_id", "goal_amount", "usd_to_pen", "emergency_months", "emergency_basis", "target_date", F.lit(36).cast("long").alias("horizon_months"))


@query(f"""with t as (select p_partkey % 5 as user_id, p_partkey, upper((array{list(_MERCHANTS)})[cast(p_partkey % 12 + 1 as int)]) as d from part),
labels as (select distinct user_id, d from t where p_partkey % 60 = 0)
select distinct user_id, d as description, {_RULES} as category from t where not exists (select 1 from labels l where l.user_id = t.user_id and l.d = t.d)""")
def categorize_unlabelled(spark, sf_dir):
    """Batch categorisation: distinct descriptions without a label, by the rules."""
    k = F.col("p_partkey")
    t = X.table(spark, sf_dir, "part").select((k % 5).alias("user_id"), k, F.lit("b").alias("bank"), F.upper(F.element_at(F.array(*map(F.lit, _MERCHANTS)), (k % 12 + 1).cast("int"))).alias("description"))
    labels = t.where(k % 60 == 0).select("user_id", "bank", "description").distinct()
    return M.unlabelled(t, labels).select("user_id", "description", S.rule_category(F.col("description")).alias("category"))
