"""Queries over reports and BI cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import reports as R
from ledgerlake.operators.movements import flow_type, signed_amount
from ledgerlake.plans.registry import query
from ledgerlake.sources import crosswalk as X

AS_OF = X.AS_OF_ORDERS

_FACT = (
    "with"
    + X.LEDGER
    + """, fact as (
    select *, case when account_kind = 'asset' and cents > 0 then 'ingreso' when account_kind = 'asset' and cents < 0 then 'egreso'
        when account_kind = 'liability' and cents > 0 then 'egreso' when account_kind = 'liability' and cents < 0 then 'pago' end as flow_type,
        case when account_kind = 'liability' then -cents else cents end as signed_cents
    from ledger
)"""
)


def fact(spark, sf_dir):
    led = X.ledger(spark, sf_dir)
    kind, cents = F.col("account_kind"), F.col("cents")
    return led.withColumns({"flow_type": flow_type(kind, cents), "signed_cents": signed_amount(kind, cents)})


_PLAN = """
plan as (select user_id, currency, description, 'fixed' as kind, cast(sum(abs(cents)) // count(*) as bigint) as expected from ledger where description like '%1-URGENT' or description like 'AUTO%' group by 1, 2, 3)"""


def plan(spark, sf_dir):
    led = X.ledger(spark, sf_dir).where("description like '%1-URGENT' or description like 'AUTO%'")
    return led.groupBy("user_id", "currency", "description").agg(F.expr("sum(abs(cents)) div count(*)").alias("expected")).withColumn("kind", F.lit("fixed"))


@query(
    _FACT
    + ","
    + _PLAN
    + f""", spent as (
    select user_id, currency, description, cast(date_trunc('month', date) as date) as month_start, cast(sum(-signed_cents) as bigint) as amount from fact
    where flow_type = 'egreso' and not is_internal_transfer and date < date '{AS_OF}' and date >= date '2001-02-01' group by 1, 2, 3, 4
), seen as (select user_id, currency, description, count(*) as n, max(month_start) as last_observed_month, arg_max(amount, month_start) as last_observed from spent group by 1, 2, 3),
compared as (
    select p.user_id, p.currency, p.description, p.expected, s.last_observed_month, s.last_observed, coalesce(s.n, 0) as months_seen_last_6,
        round((s.last_observed - p.expected) * 100.0 / p.expected, 1) as deviation_pct
    from plan p left join seen s on p.user_id = s.user_id and p.currency = s.currency and p.description = s.description
) select user_id, currency, description, expected, last_observed_month, last_observed, months_seen_last_6, cast(deviation_pct as double) as deviation_pct,
    case when deviation_pct is null then 'not_seen' when abs(deviation_pct) > 10 then 'deviating' else 'as_expected' end as status from compared"""
)
def fixed_expense_monitor(spark, sf_dir):
    return R.fixed_expense_monitor(plan(spark, sf_dir), fact(spark, sf_dir), ["user_id", "currency", "description"], AS_OF)


_FORECASTS = (
    "with"
    + X.MONTHLY_SPEND
    + """, runs as (select unnest([date '2001-05-01', date '2001-06-01', date '2001-07-01']) as run_month),
lagged as (select user_id, category, month, cents, lag(cents) over (partition by user_id, category order by month) as p50 from monthly_spend),
forecasts as (
    select user_id, run_month, 'backtest' as kind, category, 'PEN' as currency, month as target_month, 1 as horizon, 'naive_last' as model_name,
        case when category not like '%5-LOW' then p50 * 8 // 10 end as p10, p50, case when category not like '%5-LOW' then p50 * 12 // 10 end as p90, cents as actual
    from lagged, runs where month <= run_month and month > cast(run_month - interval 12 month as date) and p50 is not null
    union all
    select user_id, run_month, 'forecast', category, 'PEN', cast(month + to_months(h) as date), h, 'naive_last',
        case when category not like '%5-LOW' then cents * 8 // 10 end, cents, case when category not like '%5-LOW' then cents * 12 // 10 end, null
    from monthly_spend join runs on month = run_month, (select unnest([1, 2, 3]) as h)
)"""
)


def forecasts(spark, sf_dir):
    """Three runs over the monthly spending: twelve months of backtest and three months ahead."""
    from pyspark.sql import Window

    spend = X.monthly_spend(spark, sf_dir)
    runs = spark.createDataFrame([("2001-05-01",), ("2001-06-01",), ("2001-07-01",)], "r string").select(F.col("r").cast("date").alias("run_month"))
    lagged = spend.withColumn("p50", F.lag("cents").over(Window.partitionBy("user_id", "category").orderBy("month")))
    wide = ~F.col("category").endswith("5-LOW")
    end = lambda base, tenths: F.when(wide, F.expr(f"({base} * {tenths}) div 10"))
    fixed = {"category": F.col("category"), "currency": F.lit("PEN")}
    past = lagged.join(F.broadcast(runs), (F.col("month") <= F.col("run_month")) & (F.col("month") > F.add_months("run_month", -12))).where("p50 is not null")
    past = past.select("user_id", "run_month", F.lit("backtest").alias("kind"), *(v.alias(k) for k, v in fixed.items()), F.col("month").alias("target_month"), F.lit(1).alias("horizon"), F.lit("naive_last").alias("model_name"), end("p50", 8).alias("p10"), "p50", end("p50", 12).alias("p90"), F.col("cents").alias("actual"))
    ahead = spend.join(F.broadcast(runs), F.col("month") == F.col("run_month")).withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(3))))
    ahead = ahead.select("user_id", "run_month", F.lit("forecast").alias("kind"), *(v.alias(k) for k, v in fixed.items()), F.add_months("month", F.col("horizon")).alias("target_month"), "horizon", F.lit("naive_last").alias("model_name"), end("cents", 8).alias("p10"), F.col("cents").alias("p50"), end("cents", 12).alias("p90"), F.lit(None).cast("long").alias("actual"))
    return past.unionByName(ahead)


_STATUS = "case when p10 is null or p90 is null then 'no_interval' when actual > p90 then 'above' when actual < p10 then 'below' else 'within' end as status"


@query(
    _FORECASTS
    + f""", back as (select f.* from forecasts f join (select user_id, max(run_month) as run_month from forecasts group by 1) l using (user_id, run_month) where kind = 'backtest'),
recent as (select user_id, category, currency, count(*) filter (where actual > p90) as months_above_last_6 from back where target_month > cast(run_month - interval 6 month as date) group by 1, 2, 3)
select b.user_id, b.category, b.currency, run_month, target_month, model_name, actual, p10, p50, p90, months_above_last_6, actual - p50 as difference, {_STATUS}
from back b join recent r on b.user_id = r.user_id and b.category = r.category and b.currency = r.currency where target_month = run_month"""
)
def category_variance(spark, sf_dir):
    return R.category_variance(forecasts(spark, sf_dir))


@query(
    _FORECASTS
    + f""", closed as (select *, row_number() over (partition by user_id, category, currency, target_month order by run_month desc) as r from forecasts where kind = 'backtest' and actual is not null),
miss as (select user_id, run_month, category, currency, avg(abs(actual - p50)) as mae from forecasts where kind = 'backtest' and actual is not null group by 1, 2, 3, 4),
together as (
    select f.user_id, f.run_month, f.category, f.currency, f.target_month, f.horizon, f.p10, f.p50, f.p90, c.actual, m.mae, abs(c.actual - f.p50) as realized_error,
        case when f.horizon = 1 then abs(c.actual - f.p50) / nullif(m.mae, 0) end as error_ratio, 'realized' as source
    from forecasts f join closed c on f.user_id = c.user_id and f.category = c.category and f.currency = c.currency and f.target_month = c.target_month and c.r = 1
    left join miss m on f.user_id = m.user_id and f.run_month = m.run_month and f.category = m.category and f.currency = m.currency where f.kind = 'forecast'
    union all
    select f.user_id, f.run_month, f.category, f.currency, f.target_month, f.horizon, f.p10, f.p50, f.p90, f.actual, null, abs(f.actual - f.p50), null, 'backtest'
    from forecasts f join closed c on f.user_id = c.user_id and f.run_month = c.run_month and f.category = c.category and f.currency = c.currency and f.target_month = c.target_month and c.r = 1 where f.kind = 'backtest'
) select user_id, run_month, category, target_month, cast(horizon as bigint) as horizon, actual, round(mae, 3) as backtest_mae, realized_error, round(error_ratio, 6) as error_ratio, source, {_STATUS} from together"""
)
def forecast_realized(spark, sf_dir):
    r = R.forecast_realized(forecasts(spark, sf_dir))
    return r.select("user_id", "run_month", "category", "target_month", F.col("horizon").cast("long").alias("horizon"), "actual", F.round("backtest_mae", 3).alias("backtest_mae"), "realized_error", F.round("error_ratio", 6).alias("error_ratio"), "source", "status")


@query(
    _FORECASTS
    + """, quality as (select distinct user_id, run_month, category, currency, cast(length(category) as bigint) as n_months from forecasts where category not like 'AUTO%')
select f.user_id, f.run_month, f.category, f.currency, f.target_month, cast(f.horizon as bigint) as horizon, f.p50, f.p10 is not null and f.p90 is not null as has_interval, q.n_months
from forecasts f join (select user_id, max(run_month) as run_month from forecasts group by 1) l using (user_id, run_month)
left join quality q on q.user_id = f.user_id and q.run_month = f.run_month and q.category = f.category and q.currency = f.currency where f.kind = 'forecast'"""
)
def latest_forecast_quality(spark, sf_dir):
    f = forecasts(spark, sf_dir)
    quality = f.where("category not like 'AUTO%'").select("user_id", "run_month", "category", "currency", F.length("category").cast("long").alias("n_months")).distinct()
    return R.category_forecast(f, quality).select("user_id", "run_month", "category", "currency", "target_month", F.col("horizon").cast("long").alias("horizon"), "p50", "has_interval", "n_months")


_STATEMENT = (
    _FACT
    + ","
    + _PLAN
    + """, moves as (select *, case when order_id % 13 = 0 then 'Ingresos' else category end as cat from fact),
base as (select user_id, currency, category, cast(sum(abs(cents)) // 100 as bigint) as p50 from ledger where category <> 'FURNITURE' group by 1, 2, 3),
months as (select cast(m as date) as month from (select unnest(generate_series(timestamp '2001-01-01', timestamp '2001-10-01', interval 1 month)) as m)),
fc as (
    select user_id, currency, category, month, p50 from base, months
    union all select user_id, currency, 'Total', month, cast(sum(p50) as bigint) + 500 as p50 from base, months group by 1, 2, 4
), inc as (select distinct user_id, currency, month, cast(1000000 as bigint) as income from base, months where month <> date '2001-10-01'),
fixed_total as (select user_id, currency, cast(sum(expected) as bigint) as expected_fixed from plan group by 1, 2),
moved as (
    select m.user_id, m.currency, m.flow_type, m.signed_cents, cast(date_trunc('month', m.date) as date) as month, p.description is not null as is_fixed,
        case when m.cat = 'Ingresos' then 'Sin categorizar' else m.cat end as category
    from moves m left join plan p on m.user_id = p.user_id and m.currency = p.currency and m.description = p.description
    where not is_internal_transfer and flow_type in ('ingreso', 'egreso') and date >= date '2000-08-01' and date < date '2001-08-01'
), total as (select * from fc where category = 'Total'), ahead as (select * from fc where category <> 'Total' and month >= date '2001-08-01'),
actual as (
    select user_id, currency, month, 'actual' as kind, coalesce(sum(signed_cents) filter (where flow_type = 'ingreso'), 0) as income,
        coalesce(sum(-signed_cents) filter (where flow_type = 'egreso' and is_fixed), 0) as fixed, coalesce(sum(-signed_cents) filter (where flow_type = 'egreso' and not is_fixed), 0) as variable
    from moved group by 1, 2, 3
), every as (
    select * from actual union all
    select t.user_id, t.currency, t.month, 'forecast', i.income, coalesce(f.expected_fixed, 0), t.p50 from total t left join inc i on t.user_id = i.user_id and t.currency = i.currency and t.month = i.month
    left join fixed_total f on t.user_id = f.user_id and t.currency = f.currency where t.month >= date '2001-08-01'
), e as (
    select m.*, coalesce(f.expected_fixed, 0) + t.p50 as expected from every m left join fixed_total f on m.user_id = f.user_id and m.currency = f.currency
    left join total t on m.user_id = t.user_id and m.currency = t.currency and m.month = t.month
), split as (select user_id, currency, month, sum(p50) as p50 from ahead group by 1, 2, 3),
lines as (
    select user_id, currency, month, kind, '1 · Income' as line, income as amount from e where income is not null
    union all select user_id, currency, month, kind, '2 · Fixed expenses', fixed from e where fixed <> 0
    union all select user_id, currency, month, 'actual', '3 · ' || category, sum(-signed_cents) from moved where flow_type = 'egreso' and not is_fixed group by user_id, currency, category, month
    union all select user_id, currency, month, 'forecast', '3 · ' || category, p50 from ahead
    union all select t.user_id, t.currency, t.month, 'forecast', '3 · ~ Not split by category', t.p50 - coalesce(s.p50, 0) from total t left join split s on t.user_id = s.user_id and t.currency = s.currency and t.month = s.month
        where t.month >= date '2001-08-01' and t.p50 - coalesce(s.p50, 0) <> 0
    union all select user_id, currency, month, kind, '4 · Total expenses', fixed + variable from e
    union all select user_id, currency, month, kind, '5 · Monthly saving', income - fixed - variable from e where income is not null
    union all select user_id, currency, month, 'plan', '6 · Expected expenses', expected from e where expected is not null
    union all select user_id, currency, month, 'plan', '7 · Planned saving', income - expected from e where income is not null and expected is not null
    union all select user_id, currency, month, 'actual', '8 · Saving vs plan', expected - fixed - variable from e where kind = 'actual' and income is not null and expected is not null
)"""
)


def statement_inputs(spark, sf_dir):
    f = fact(spark, sf_dir)
    moves = f.withColumn("category", F.when(F.col("order_id") % 13 == 0, "Ingresos").otherwise(F.col("category"))).withColumn("item", F.col("description"))
    base = X.ledger(spark, sf_dir).where("category <> 'FURNITURE'").groupBy("user_id", "currency", "category").agg(F.expr("sum(abs(cents)) div 100").alias("p50"))
    month = F.explode(F.sequence(F.lit("2001-01-01").cast("date"), F.lit("2001-10-01").cast("date"), F.expr("interval 1 month"))).alias("month")
    each = base.select("user_id", "currency", "category", "p50", month)
    total = each.groupBy("user_id", "currency", "month").agg((F.sum("p50") + 500).alias("p50")).withColumn("category", F.lit("Total"))
    income = each.select("user_id", "currency", "month").distinct().where("month <> date '2001-10-01'").withColumn("income", F.lit(1000000).cast("long"))
    items = plan(spark, sf_dir).select("user_id", "currency", F.col("description").alias("item"), "expected")
    return moves, items, each.unionByName(total), income


@query(
    _STATEMENT
    + """ select user_id, currency, month, strftime(month, '%Y-%m') || case when month >= date '2001-08-01' then ' (forecast)' else '' end as month_label,
    cast(year(month) * 12 + month(month) - (2001 * 12 + 8) as bigint) as months_ahead, kind, line, cast(amount as bigint) as cents from lines"""
)
def income_statement(spark, sf_dir):
    return R.income_statement(*statement_inputs(spark, sf_dir), AS_OF)


@query(_STATEMENT + """ select currency, line, cast(sum(amount) filter (where month = date '2001-06-01') as bigint) as "2001-06", cast(sum(amount) filter (where month = date '2001-07-01') as bigint) as "2001-07" from lines group by 1, 2""")
def income_pivot(spark, sf_dir):
    s = R.income_statement(*statement_inputs(spark, sf_dir), AS_OF)
    return s.groupBy("currency", "line").pivot("month_label", ["2001-06", "2001-07"]).sum("cents")


@query(
    _FACT
    + """ select money_in, money_out, money_in - money_out as net, round((money_in - money_out) / cast(money_in as double), 6) as savings_rate, first_day, last_day, months from (
    select cast(sum(signed_cents) filter (where flow_type = 'ingreso') as bigint) as money_in, cast(sum(-signed_cents) filter (where flow_type = 'egreso') as bigint) as money_out,
        min(date) as first_day, max(date) as last_day, count(distinct date_trunc('month', date)) as months
    from fact where not is_internal_transfer and currency = 'PEN' and date >= date '1995-01-01' and date <= date '2000-12-31')"""
)
def cash_flow_kpi(spark, sf_dir):
    rows = R.filter_movements(fact(spark, sf_dir), currency="PEN", date_from="1995-01-01", date_to="2000-12-31")
    card = R.cash_flow_card(rows)
    return card.select("money_in", "money_out", "net", F.round("savings_rate", 6).alias("savings_rate"), "first_day", "last_day", "months")


_SHOWN = "case when order_id % 13 = 0 then 'Sin categorizar' else category end"


@query(_FACT + f" select {_SHOWN} as category, cast(sum(-signed_cents) as bigint) as cents, count(*) as n from fact where flow_type = 'egreso' and not is_internal_transfer group by 1")
def spend_by_category(spark, sf_dir):
    return R.spend_by_category(statement_inputs(spark, sf_dir)[0])


@query(_FACT + """ select case when order_id % 10 = 0 then 'confirmed' else 'predicted' end as label_source, cast(date_trunc('quarter', date) as date) as quarter, count(*) as n,
    cast(sum(-signed_cents) as bigint) as cents from fact where flow_type = 'egreso' group by 1, 2""")
def label_source_share(spark, sf_dir):
    f = fact(spark, sf_dir).where("flow_type = 'egreso'")
    source = F.when(F.col("order_id") % 10 == 0, "confirmed").otherwise("predicted").alias("label_source")
    return f.groupBy(source, F.trunc("date", "quarter").alias("quarter")).agg(F.count("*").alias("n"), F.sum(-F.col("signed_cents")).alias("cents"))


@query("with" + X.MONTHLY_SPEND + """, t as (select category, cast(sum(cents) as bigint) as cents from monthly_spend group by 1)
select category, cents, round(cents / cast(sum(cents) over () as double), 9) as share from t""")
def share_of_total(spark, sf_dir):
    t = X.monthly_spend(spark, sf_dir).groupBy("category").agg(F.sum("cents").alias("cents"))
    return R.share_of_total(t, "cents").select("category", "cents", F.round("share", 9).alias("share"))


@query("with" + X.MONTHLY_SPEND + """, m as (select user_id, category, median(cast(cents as double)) as mid from monthly_spend group by 1, 2)
select s.user_id, s.category, count(*) as n, round(max(mid), 3) as mid, round(median(abs(cents - mid)) / max(mid), 9) as spread from monthly_spend s join m using (user_id, category) group by 1, 2""")
def mad_spread(spark, sf_dir):
    s = X.monthly_spend(spark, sf_dir)
    m = s.groupBy("user_id", "category").agg(F.median("cents").alias("mid"))
    out = s.join(m, ["user_id", "category"]).groupBy("user_id", "category")
    return out.agg(F.count("*").alias("n"), F.round(F.max("mid"), 3).alias("mid"), F.round(F.median(F.abs(F.col("cents") - F.col("mid"))) / F.max("mid"), 9).alias("spread"))


@query("with" + X.MONTHLY_SPEND + """ select user_id, round(quantile_cont(cast(cents as double), 0.25), 3) as p25, round(quantile_cont(cast(cents as double), 0.75), 3) as p75, round(avg(cents), 3) as mean from monthly_spend group by 1""")
def percentile_linear(spark, sf_dir):
    c = F.col("cents").cast("double")
    s = X.monthly_spend(spark, sf_dir).groupBy("user_id")
    return s.agg(F.round(F.percentile(c, F.lit(0.25)), 3).alias("p25"), F.round(F.percentile(c, F.lit(0.75)), 3).alias("p75"), F.round(F.avg("cents"), 3).alias("mean"))


@query(
    "with"
    + X.MONTHLY_SPEND
    + """, rows as (select user_id, category, month, cents, cast(year(month) * 12 + month(month) as bigint) as i from monthly_spend),
first as (select min(i) as f from rows),
pairs as (select a.user_id, a.category, a.month, a.i, b.cents as total from rows a left join rows b on a.user_id = b.user_id and a.category = b.category and b.i >= a.i - 12 and b.i < a.i),
mids as (select user_id, category, month, i, count(total) as n, median(cast(total as double)) as mid from pairs group by 1, 2, 3, 4),
mads as (select p.user_id, p.category, p.month, median(abs(total - mid)) as mad from pairs p join mids m on p.user_id = m.user_id and p.category = m.category and p.month = m.month group by 1, 2, 3)
select m.user_id, m.category, m.month, n as months_seen, round(case when least(12, i - f) > 0 then n / cast(least(12, i - f) as double) end, 6) as rate, round(mad / nullif(mid, 0), 6) as amount_spread
from mids m join mads d on m.user_id = d.user_id and m.category = d.category and m.month = d.month, first"""
)
def recurrence_features(spark, sf_dir):
    """Over every series of monthly_spend, counted from its first month."""
    s = X.monthly_spend(spark, sf_dir).select(F.concat_ws("/", "user_id", "category", "month").alias("id"), "user_id", "category", "month", F.col("cents").alias("amount"))
    r = R.point_in_time_recurrence(s, ["user_id", "category"])
    return r.select("user_id", "category", "month", "months_seen", F.round("rate", 6).alias("rate"), F.round("amount_spread", 6).alias("amount_spread"))


@query(
    _FACT
    + """, w as (select category, date > (select max(date) from fact) - 90 as recent from fact),
r as (select category, count(*) / cast((select count(*) from w where not recent) as double) as r from w where not recent group by 1),
c as (select category, count(*) / cast((select count(*) from w where recent) as double) as c from w where recent group by 1),
b as (select greatest(coalesce(r, 0), 0.0001) as r, greatest(coalesce(c, 0), 0.0001) as c from r full join c using (category))
select round(sum((c - r) * ln(c / r)), 9) as psi, count(*) as n_values from b"""
)
def drift_psi(spark, sf_dir):
    reference, current = R.split_windows(fact(spark, sf_dir))
    return R.psi(reference, current, "category").select(F.round("psi", 9).alias("psi"), "n_values")


_FEATURES = """, f as (select date, account_kind as bank, currency, coalesce(flow_type, 'none') as flow_type, category, case when is_internal_transfer then 'confirmed' else 'predicted' end as label_source,
    cast(length(description) as double) as description_length, length(regexp_replace(description, '\\D', '', 'g')) / cast(greatest(length(description), 1) as double) as digit_share, ln(1 + abs(cents)) as log_abs_amount from fact),
w as (select *, date > (select max(date) from f) - 90 as recent from f)"""
_BINNED = " union all ".join(
    f"select '{c}' as \"column\", recent, '' || ({' + '.join(f'case when {c} > q[{k}] then 1 else 0 end' for k in range(1, 10))}) as value from w, (select quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as q from w where not recent)"
    for c in R.DRIFT_NUMBERS
)


@query(_FACT + _FEATURES + ", v as (" + " union all ".join(f"select '{c}' as \"column\", recent, {c} as value from w" for c in R.DRIFT_CATEGORIES) + " union all " + _BINNED + """),
n as (select "column", value, count(*) filter (where not recent) / cast((select count(*) from w where not recent) as double) as r, count(*) filter (where recent) / cast((select count(*) from w where recent) as double) as c from v group by 1, 2),
p as (select "column", sum((greatest(c, 0.0001) - greatest(r, 0.0001)) * ln(greatest(c, 0.0001) / greatest(r, 0.0001))) as psi from n group by 1)
select "column", round(psi, 6) as psi, psi > 0.2 as drifted from p""")
def drift_report(spark, sf_dir):
    """Eight columns, five of categories and three of numbers, each with its distance and verdict."""
    f = fact(spark, sf_dir).select(
        "date", F.col("account_kind").alias("bank"), "currency", F.coalesce("flow_type", F.lit("none")).alias("flow_type"), "category",
        F.when(F.col("is_internal_transfer"), "confirmed").otherwise("predicted").alias("label_source"), "description", (F.col("cents") * 1.0).alias("amount"),
    )
    return R.drift_report(R.drift_features(f)).select("column", F.round("psi", 6).alias("psi"), "drifted")


@query(_FACT + f""" select cast(date_trunc('quarter', date) as date) as period, count(*) as n, cast(sum(signed_cents) as bigint) as cents from fact
where year(date) in (1996, 1997, 1998) and quarter(date) in (1, 3) and month(date) in (1, 2, 8) and category in ('BUILDING', 'MACHINERY') and currency = 'PEN' group by 1""")
def filter_bar(spark, sf_dir):
    """All of the filter bar's fields at once, at the grain of quarters."""
    rows = R.filter_movements(fact(spark, sf_dir).withColumn("place", F.col("category")), currency="PEN", years=[1996, 1997, 1998], quarters=[1, 3], months=[1, 2, 8], funds=["BUILDING", "MACHINERY"])
    return rows.groupBy(R.period(F.col("date"), "quarter").alias("period")).agg(F.count("*").alias("n"), F.sum("signed_cents").alias("cents"))
