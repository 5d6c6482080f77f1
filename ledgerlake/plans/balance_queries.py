"""Queries over statements, funds and capital."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import balances as B
from ledgerlake.plans.registry import query
from ledgerlake.sources import crosswalk as X

_BALANCES = (
    "with"
    + X.STATEMENTS
    + """, ranked as (
    select *, row_number() over (partition by account_id, currency, date_trunc('month', period_end) order by period_end desc, period_start desc) as r from statements
), balances as (
    select user_id, account_id, account_kind, currency, month_start, period_end as closing_date, opening, closing,
        case when account_kind = 'liability' then -closing else closing end as signed_closing,
        case when account_kind = 'liability' then -opening else opening end as signed_opening
    from ranked where r = 1
)"""
)


@query(_BALANCES + " select * from balances")
def account_balance_monthly(spark, sf_dir):
    return B.month_end_balances(X.statements(spark, sf_dir))


@query(
    "with"
    + X.STATEMENTS
    + """, linked as (
    select account_id, month_start, opening, lag(closing) over w as previous_closing,
        cast(year(period_end) * 12 + month(period_end) as bigint) as i, lag(year(period_end) * 12 + month(period_end)) over w as previous_i
    from statements window w as (partition by account_id, currency order by period_end, period_start))
select account_id, month_start, i <> previous_i + 1 as month_gap, opening <> previous_closing as balance_gap from linked
where previous_closing is not null and (i <> previous_i + 1 or opening <> previous_closing)"""
)
def dq_statement_continuity(spark, sf_dir):
    return B.continuity_breaks(X.statements(spark, sf_dir)).select("account_id", "month_start", "month_gap", "balance_gap")


@query("with" + X.STATEMENTS + " select account_id, month_start, opening + declared - closing as difference from statements where opening + declared <> closing")
def dq_balance_reconciliation(spark, sf_dir):
    return B.statement_reconciliation(X.statements(spark, sf_dir)).select("account_id", "month_start", "difference")


@query(
    _BALANCES
    + """, span as (
    select user_id, account_id, account_kind, currency, min(month_start) as first_month, max(month_start) as last_month, max(closing_date) as closing_date,
        min_by(signed_opening, month_start) as opening, max_by(signed_closing, month_start) as closing from balances group by 1, 2, 3, 4
)
select s.user_id, s.account_id, s.account_kind, s.currency, s.first_month, s.last_month, s.opening, s.closing,
    cast(coalesce(sum(case when s.account_kind = 'liability' then -l.cents else l.cents end), 0) as bigint) as net_movements,
    cast(s.closing - s.opening - coalesce(sum(case when s.account_kind = 'liability' then -l.cents else l.cents end), 0) as bigint) as difference
from span s left join ledger l on l.account_id = s.account_id and l.currency = s.currency and s.closing_date >= l.date
group by s.user_id, s.account_id, s.account_kind, s.currency, s.first_month, s.last_month, s.opening, s.closing"""
)
def reconciliation(spark, sf_dir):
    led = X.ledger(spark, sf_dir)
    signed = led.withColumn("signed_cents", F.when(F.col("account_kind") == "liability", -F.col("cents")).otherwise(F.col("cents")))
    return B.account_reconciliation(B.month_end_balances(X.statements(spark, sf_dir)), signed)


_DIETZ = (
    "with"
    + X.ENTRIES
    + """, numbered as (
    select *, row_number() over (partition by place, month_start order by entry_date desc, sheet_row desc) as e,
        row_number() over (partition by place, month_start order by entry_date, sheet_row) as s,
        case kind when 'aporte' then amount when 'retiro' then -amount else 0 end as flow, day(last_day(month_start)) as dm
    from entries
), monthly as (
    select place, month_start, cast(coalesce(sum(amount) filter (where kind = 'aporte'), 0) as bigint) as contributions,
        cast(coalesce(sum(amount) filter (where kind = 'retiro'), 0) as bigint) as withdrawals,
        coalesce(bool_or(kind = 'valorizacion' and e = 1), false) as has_valuation, max(kind) filter (where s = 1) as first_kind,
        max(balance) filter (where e = 1) as closing, max(balance - flow) filter (where s = 1) as before_first,
        sum(flow * (dm - day(entry_date))) / max(dm) as weighted_flow
    from numbered group by place, month_start
), linked as (
    select *, lag(closing) over w as previous,
        cast(year(month_start) * 12 + month(month_start) - lag(year(month_start) * 12 + month(month_start)) over w as bigint) as months_since_previous,
        first_value(before_first) over w as initial, cast(sum(contributions - withdrawals) over w as bigint) as net
    from monthly window w as (partition by place order by month_start)
), measured as (select *, coalesce(previous, before_first) as opening from linked),
returns as (select *, closing - opening - contributions + withdrawals as gain, opening + weighted_flow as capital from measured),
reliable as (select *, capital > 0 and coalesce(months_since_previous = 1, first_kind in ('aporte', 'retiro')) as ok from returns)
"""
)


@query(
    _DIETZ
    + """select place, month_start, has_valuation, months_since_previous, ok as is_return_reliable, opening, contributions, withdrawals, closing, gain,
    case when has_valuation then 'valuation' else 'last_movement' end as closing_basis, round(case when ok then gain / capital end, 6) as return_pct,
    initial + net as cumulative_net_contributed, closing - initial - net as cumulative_gain from reliable"""
)
def investment_dietz(spark, sf_dir):
    return B.fund_returns(X.investment_entries(spark, sf_dir), ["place"]).withColumn("return_pct", F.round("return_pct", 6))


@query(_DIETZ + "select place, round(max(case when ok then gain / capital end), 6) as best_return, count(*) filter (where ok) as reliable_months from reliable group by place")
def fund_best_return(spark, sf_dir):
    r = B.fund_returns(X.investment_entries(spark, sf_dir), ["place"])
    return r.groupBy("place").agg(F.round(F.max("return_pct"), 6).alias("best_return"), F.count_if("is_return_reliable").alias("reliable_months"))


_CAPITAL = (
    _BALANCES
    + """, holdings as (
    select user_id, currency, 'a' || cast(account_id as varchar) as holding, case when account_id % 7 = 0 then 'investments' when account_kind = 'liability' then 'debt' else 'savings' end as bucket,
        month_start, closing as value from balances
), firsts as (
    select user_id, currency, holding, bucket, min(month_start) as a from holdings group by 1, 2, 3, 4
), months as (
    select cast(m as date) as month_start from (select unnest(generate_series(cast((select min(month_start) from holdings) as timestamp), cast((select max(month_start) from holdings) as timestamp), interval 1 month)) as m)
), scaffold as (
    select f.user_id, f.currency, f.holding, f.bucket, m.month_start from firsts f join months m on f.a <= m.month_start
), filled as (
    select s.user_id, s.currency, s.bucket, s.month_start, last_value(h.value ignore nulls) over (partition by s.user_id, s.currency, s.holding, s.bucket order by s.month_start) as value
    from scaffold s left join holdings h using (user_id, currency, holding, bucket, month_start)
), totals as (
    select user_id, currency, month_start, cast(coalesce(sum(value) filter (where bucket = 'savings'), 0) as bigint) as savings,
        cast(coalesce(sum(value) filter (where bucket = 'investments'), 0) as bigint) as investments, cast(coalesce(sum(value) filter (where bucket = 'debt'), 0) as bigint) as debt
    from filled group by 1, 2, 3
), capital as (
    select *, savings + investments as total_capital, savings + investments - debt as net_position, dense_rank() over (order by month_start desc) as month_recency from totals
)"""
)


def _holdings(spark, sf_dir):
    b = B.month_end_balances(X.statements(spark, sf_dir))
    bucket = F.when(F.col("account_id") % 7 == 0, "investments").when(F.col("account_kind") == "liability", "debt").otherwise("savings")
    return b.select("user_id", "currency", F.concat(F.lit("a"), F.col("account_id").cast("string")).alias("holding"), bucket.alias("bucket"), "month_start", F.col("closing").alias("value"))


@query(_CAPITAL + " select * from capital")
def capital_net_position(spark, sf_dir):
    return B.capital(_holdings(spark, sf_dir))


@query(_CAPITAL + """ select currency, cast(sum(total_capital) filter (where month_recency = 1) as bigint) as now, cast(sum(total_capital) filter (where month_recency = 2) as bigint) as before,
    cast(sum(debt) filter (where month_recency = 1) as bigint) as debt_now from capital group by currency""")
def capital_kpi_recency(spark, sf_dir):
    c = B.capital(_holdings(spark, sf_dir))
    at = lambda col, k: F.sum(F.when(F.col("month_recency") == k, F.col(col)))
    return c.groupBy("currency").agg(at("total_capital", 1).alias("now"), at("total_capital", 2).alias("before"), at("debt", 1).alias("debt_now"))


@query(_BALANCES + """ select month_start, cast(sum(signed_closing) as bigint) as debt from balances where account_kind = 'liability' group by 1 order by month_start desc limit 1""")
def debt_latest_topk(spark, sf_dir):
    b = B.month_end_balances(X.statements(spark, sf_dir)).where("account_kind = 'liability'")
    return b.groupBy("month_start").agg(F.sum("signed_closing").alias("debt")).orderBy(F.desc("month_start")).limit(1)


@query(_BALANCES + """ select account_id, currency, max(month_start) as as_of_month, max_by(closing, month_start) as closing from balances where month_start <= date '1998-06-01' group by 1, 2""")
def asof_latest_balance(spark, sf_dir):
    b = B.month_end_balances(X.statements(spark, sf_dir))
    return B.latest_as_of(b, ["account_id", "currency"], F.col("month_start"), "closing", F.lit("1998-06-01").cast("date"))


@query("with" + X.STATEMENTS + """, span as (select account_id, min(month_start) as a, max(month_start) as b from statements group by 1),
every as (select account_id, cast(unnest(generate_series(cast(a as timestamp), cast(b as timestamp), interval 1 month)) as date) as month_start from span)
select account_id, month_start from every e where not exists (select 1 from statements s where s.account_id = e.account_id and s.month_start = e.month_start)""")
def missing_months(spark, sf_dir):
    return B.missing_months(X.statements(spark, sf_dir), ["account_id"])


_SHEET = (
    "with"
    + X.LEDGER
    + """, sheet as (
    select account_id, date, order_id as position, cast(case when order_id % 2 = 0 then abs(cents) else cents end as bigint) as amount,
        cast(sum(cents) over (partition by account_id order by order_id rows between unbounded preceding and current row) as bigint) + case when order_id % 50 = 0 then 1 else 0 end as balance
    from ledger
), prev as (select *, lag(balance) over (partition by account_id order by position) as p from sheet),
followed as (
    select *, case when p is null or p + amount = balance then amount when amount > 0 and p - amount = balance then -amount end as repaired,
        not (p is null or p + amount = balance or (amount > 0 and p - amount = balance)) as problem from prev
)"""
)


def _sheet(spark, sf_dir):
    from pyspark.sql import Window

    led = X.ledger(spark, sf_dir)
    run = F.sum("cents").over(Window.partitionBy("account_id").orderBy("order_id").rowsBetween(Window.unboundedPreceding, 0))
    return led.select(
        "account_id", "date", F.col("order_id").alias("position"), F.when(F.col("order_id") % 2 == 0, F.abs("cents")).otherwise(F.col("cents")).alias("amount"),
        (run + F.when(F.col("order_id") % 50 == 0, 1).otherwise(0)).alias("balance"),
    )


@query(_SHEET + " select account_id, position, repaired, problem from followed")
def savings_sheet_signs(spark, sf_dir):
    return B.savings_followed(_sheet(spark, sf_dir), ["account_id"]).select("account_id", "position", "repaired", "problem")


@query(_SHEET + """ select account_id, cast(date_trunc('month', date) as date) as month_start, min(date) as period_start, max(date) as period_end,
    min_by(balance - repaired, position) as opening, max_by(balance, position) as closing, cast(sum(repaired) as bigint) as net from followed where not problem group by 1, 2""")
def month_statement_builder(spark, sf_dir):
    rows = B.savings_followed(_sheet(spark, sf_dir), ["account_id"]).where("not problem")
    return B.month_statements(rows, ["account_id"])
