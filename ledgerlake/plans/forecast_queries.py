"""Queries over series, forecasters, backtests and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import forecast as P
from ledgerlake.plans.registry import query
from ledgerlake.sources import crosswalk as X
from ledgerlake.sources.scratch import staged

KEYS = ["user_id", "category"]

_SERIES = (
    "with recursive"
    + X.MONTHLY_SPEND
    + """, kept as (select * from monthly_spend where category not like 'AUTO%5-LOW'),
span as (select user_id, min(month) as a from monthly_spend group by 1),
grid as (select user_id, cast(unnest(generate_series(cast(a as timestamp), timestamp '2001-07-01', interval 1 month)) as date) as month from span),
names as (select distinct user_id, category from kept),
dense as (
    select n.user_id, n.category, g.month, coalesce(cast(k.cents as double), 0) as y from names n join grid g on n.user_id = g.user_id left join kept k on k.user_id = n.user_id and k.category = n.category and k.month = g.month
    union all select g.user_id, 'Total', g.month, coalesce(sum(cast(k.cents as double)), 0) from grid g left join kept k on k.user_id = g.user_id and k.month = g.month group by 1, 2, 3
),
series as (select *, row_number() over (partition by user_id, category order by month) as i, count(*) over (partition by user_id, category) as n from dense)"""
)

#: Forecasts at every origin: o values known, the level of each flat model.
_LEVELS = (
    _SERIES
    + """, ses(user_id, category, i, level) as (
    select user_id, category, i, y from series where i = 1
    union all select s.user_id, s.category, s.i, 0.3 * s.y + 0.7 * p.level from ses p join series s on s.user_id = p.user_id and s.category = p.category and s.i = p.i + 1
), stats as (
    select user_id, category, i as o, n, y as naive_last, avg(y) over w3 as mean_3, median(y) over w6 as median_6, avg(y) over w12 as level
    from series window w3 as (partition by user_id, category order by i rows between 2 preceding and current row),
        w6 as (partition by user_id, category order by i rows between 5 preceding and current row), w12 as (partition by user_id, category order by i rows between 11 preceding and current row)
), flat as (
    select user_id, category, o, n, level, 'naive_last' as model, naive_last as v from stats union all select user_id, category, o, n, level, 'mean_3', mean_3 from stats
    union all select user_id, category, o, n, level, 'median_6', median_6 from stats
    union all select t.user_id, t.category, o, n, t.level, 'ses', e.level from stats t join ses e on e.user_id = t.user_id and e.category = t.category and e.i = t.o
), horizons as (select unnest(generate_series(1, 36)) as h),
points as (
    select user_id, category, o, n, level, model, h, v as point from flat, horizons
    union all select t.user_id, t.category, t.o, t.n, t.level, 'seasonal_naive_12', h, s.y from stats t, horizons join series s on s.user_id = t.user_id and s.category = t.category and s.i = t.o - 12 + ((h - 1) % 12) + 1 where t.o >= 12
)"""
)

_ROLLED = (
    _LEVELS
    + """, rolled as (
    select p.user_id, p.category, p.o as origin, p.model, p.h as horizon, p.point, s.y as actual, p.level from points p join series s on s.user_id = p.user_id and s.category = p.category and s.i = p.o + p.h
    where p.o >= 9 and p.o < p.n and p.h <= 12
), one as (select user_id, category, origin, model, abs(actual - point) as e from rolled where horizon = 1),
scored as (
    select a.user_id, a.category, a.model, avg(a.e) as mae, avg(b.e) as mae_base, avg(case when a.e < b.e then 1.0 else 0.0 end) as wins
    from one a join one b on a.user_id = b.user_id and a.category = b.category and a.origin = b.origin and b.model = 'median_6' where a.model <> 'median_6' group by 1, 2, 3
), ranked as (
    select *, mae / mae_base as ratio, row_number() over (partition by user_id, category order by mae / mae_base, case model when 'naive_last' then 1 when 'mean_3' then 2 when 'ses' then 4 else 5 end) as r from scored where mae_base > 0
), chosen as (
    select s.user_id, s.category, case when not low and ratio <= 0.95 and wins >= 0.6 then model else 'median_6' end as model, case when not low and ratio <= 0.95 and wins >= 0.6 then ratio else 1.0 end as mae_ratio, low as low_history, n
    from (select user_id, category, max(n) as n, max(n) < 9 or count(*) filter (where y <> 0) < 3 as low from series group by 1, 2) s left join ranked k on k.user_id = s.user_id and k.category = s.category and k.r = 1
), own as (
    select r.*, r.actual - r.point as error from rolled r join chosen c on c.user_id = r.user_id and c.category = r.category and c.model = r.model
), mine as (select user_id, category, horizon, count(*) as n, quantile_cont(error, 0.1) as low, quantile_cont(error, 0.9) as high from own group by 1, 2, 3),
pool as (select user_id, horizon, count(*) as n, quantile_cont(error / level, 0.1) as low, quantile_cont(error / level, 0.9) as high from own where category <> 'Total' and level > 0 group by 1, 2),
last_level as (select user_id, category, level from stats where o = n),
offsets as (
    select * from (
        select l.user_id, l.category, h as horizon, case when m.n >= 12 then m.low when p.n >= 12 and l.level > 0 then p.low * l.level end as low, case when m.n >= 12 then m.high when p.n >= 12 and l.level > 0 then p.high * l.level end as high
        from last_level l join horizons on h <= 12 left join mine m on m.user_id = l.user_id and m.category = l.category and m.horizon = h left join pool p on p.user_id = l.user_id and p.horizon = h
    ) where low is not null
)"""
)


def series(spark, sf_dir):
    """125 series by region, segment and priority, one of them excluded, and a total per region."""
    rows = X.monthly_spend(spark, sf_dir).withColumnRenamed("cents", "amount")
    return P.build_series(rows, ["user_id"], F.lit(X.AS_OF_ORDERS).cast("date"), F.col("category").like("AUTO%5-LOW"))


def fitted(spark, sf_dir):
    s = staged(series(spark, sf_dir))
    r = staged(P.rolling(s, KEYS))
    c = staged(P.select_models(s, r, KEYS))
    return s, r, c, P.error_offsets(s, r, c, KEYS, ["user_id"])


@query(_SERIES + " select user_id, category, month, cast(y as bigint) as cents from series")
def series_zero_filled(spark, sf_dir):
    s = series(spark, sf_dir)
    return s.select("user_id", "category", F.posexplode("values").alias("i", "y"), "first_month").select("user_id", "category", F.add_months("first_month", F.col("i")).alias("month"), F.col("y").cast("long").alias("cents"))


def _register(model: str) -> None:
    sql = _LEVELS + f" select user_id, category, h as horizon, cast(date '2001-07-01' + to_months(cast(h as integer)) as date) as target_month, round(point, 2) as point from points where o = n and model = '{model}'"

    @query(sql, name=f"forecast_{model}")
    def run(spark, sf_dir):
        f = P.forecasts(series(spark, sf_dir), KEYS, (model,))
        return f.select(*KEYS, F.col("horizon").cast("long").alias("horizon"), "target_month", F.round("point", 2).alias("point"))


for _model in P.CANDIDATES:
    _register(_model)


@query(_ROLLED + " select user_id, category, model, horizon, count(*) as n, round(avg(abs(actual - point)), 2) as mae from rolled group by 1, 2, 3, 4")
def rolling_backtest_mae(spark, sf_dir):
    r = P.rolling(series(spark, sf_dir), KEYS)
    return r.groupBy(*KEYS, "model", F.col("horizon").cast("long").alias("horizon")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("actual") - F.col("point"))), 2).alias("mae"))


@query(_ROLLED + " select user_id, category, model, round(mae_ratio, 6) as mae_ratio, low_history from chosen")
def model_selection(spark, sf_dir):
    c = fitted(spark, sf_dir)[2]
    return c.select(*KEYS, "model", F.round("mae_ratio", 6).alias("mae_ratio"), "low_history")


@query(_ROLLED + " select user_id, category, horizon, round(low, 2) as low, round(high, 2) as high from offsets")
def empirical_intervals(spark, sf_dir):
    o = fitted(spark, sf_dir)[3]
    return o.select(*KEYS, F.col("horizon").cast("long").alias("horizon"), F.round("low", 2).alias("low"), F.round("high", 2).alias("high"))


@query(_ROLLED + """ select p.user_id, p.category, p.model, h as horizon, round(case when low is not null then greatest(0, point + low) end, 2) as p10, round(point, 2) as p50, round(case when high is not null then greatest(0, point + high) end, 2) as p90
from points p join chosen c on c.user_id = p.user_id and c.category = p.category and c.model = p.model left join offsets f on f.user_id = p.user_id and f.category = p.category and f.horizon = p.h where p.o = p.n""")
def spend_forecasts(spark, sf_dir):
    s, _, c, o = fitted(spark, sf_dir)
    f = P.interval_forecasts(s, c, o, KEYS)
    return f.select(*KEYS, "model", F.col("horizon").cast("long").alias("horizon"), *(F.round(x, 2).alias(x) for x in ("p10", "p50", "p90")))


_METRICS = (
    _ROLLED
    + """, covered as (select w.user_id, w.category, avg(case when w.error >= f.low and w.error <= f.high then 1.0 else 0.0 end) as coverage
    from own w join offsets f on f.user_id = w.user_id and f.category = w.category and f.horizon = 1 where w.horizon = 1 group by 1, 2),
metrics as (select c.user_id, c.category, c.model, c.mae_ratio, c.low_history, cast(c.n as bigint) as n_months, greatest(0, c.n - 9) as n_origins, v.coverage, c.model = 'median_6' as baseline_used
    from chosen c left join covered v on v.user_id = c.user_id and v.category = c.category)"""
)


@query(_METRICS + " select user_id, category, model, round(mae_ratio, 6) as mae_ratio, low_history, n_months, cast(n_origins as bigint) as n_origins, round(coverage, 6) as coverage, baseline_used from metrics")
def backtest_coverage(spark, sf_dir):
    s, r, c, o = fitted(spark, sf_dir)
    m = P.series_metrics(s, r, c, o, KEYS)
    return m.select(*KEYS, "model", F.round("mae_ratio", 6).alias("mae_ratio"), "low_history", "n_months", "n_origins", F.round("coverage", 6).alias("coverage"), "baseline_used")


@query(_METRICS + """ select count(*) as series, count(*) filter (where baseline_used) as baseline_used, count(*) filter (where low_history) as low_history, round(avg(mae_ratio), 6) as mae_rel_mean,
    round(sum(mae_ratio * n_months) / sum(n_months), 6) as mae_rel_weighted, round(coalesce(avg(coverage), 0), 6) as coverage_mean from metrics""")
def forecast_summary(spark, sf_dir):
    s, r, c, o = fitted(spark, sf_dir)
    m = P.weighted_summary(P.series_metrics(s, r, c, o, KEYS), "n_months")
    return m.select("series", "baseline_used", "low_history", *(F.round(x, 6).alias(x) for x in ("mae_rel_mean", "mae_rel_weighted", "coverage_mean")))


@query(
    "with"
    + X.MONTHLY_SPEND
    + """, monthly as (select user_id, category, month, cast(sum(cents) as double) as amount from monthly_spend where month > cast((select max(month) from monthly_spend) - interval 6 month as date) group by 1, 2, 3 having sum(cents) > 0),
typical as (select user_id, category, count(*) as months_seen, median(amount) as typical from monthly group by 1, 2 having count(*) >= 4)
select t.user_id, t.category, max(months_seen) as months_seen, round(max(typical), 2) as typical, round(median(abs(amount - typical)) / max(typical), 6) as spread,
    case when median(abs(amount - typical)) / max(typical) <= 0.1 then 'fixed' else 'variable' end as kind
from typical t join monthly m on m.user_id = t.user_id and m.category = t.category group by 1, 2"""
)
def fixed_expense_detection(spark, sf_dir):
    rows = X.monthly_spend(spark, sf_dir).withColumnRenamed("cents", "amount")
    c = P.fixed_expense_candidates(rows, KEYS)
    return c.select(*KEYS, "months_seen", F.round("typical", 2).alias("typical"), F.round("spread", 6).alias("spread"), "kind")


@query("with" + X.LEDGER + """, spend as (select user_id as bank, description, currency, category, cast(date_trunc('month', date) as date) as month, cast(abs(cents) as double) / 100 as amount from ledger),
spend2 as (select bank, description, case when amount > 150000 then 'USD' else 'PEN' end as currency, category, month, amount from spend),
recent as (select * from spend2 where month > cast((select max(month) from spend2) - interval 6 month as date)),
monthly as (select bank, description, currency, month, sum(amount) as amount from recent group by 1, 2, 3, 4 having sum(amount) > 0),
typical as (select bank, description, currency, count(*) as months_seen, median(amount) as typical from monthly group by 1, 2, 3 having count(*) >= 4),
spreads as (select t.bank, t.description, t.currency, max(months_seen) as months_seen, max(typical) as typical, median(abs(amount - typical)) / max(typical) as spread from typical t join monthly m using (bank, description, currency) group by 1, 2, 3),
last as (select bank, description, currency, max_by(category, month) as category from recent group by 1, 2, 3)
select s.bank, s.description, s.currency, l.category, months_seen, round(typical, 2) as typical, case when spread <= 0.4 then 'fixed' else 'variable' end as kind,
    coalesce((select 'also seen in ' || string_agg(o.currency, ', ' order by o.currency) from typical o where o.bank = s.bank and o.description = s.description and o.currency <> s.currency), '') as note,
    row_number() over (order by case when spread <= 0.4 then 0 else 1 end, round(typical, 2) desc, s.bank, s.description, s.currency) as place
from spreads s join last l using (bank, description, currency)""")
def fixed_expense_notes(spark, sf_dir):
    """Proposed recurring charges with category, note of other currencies, rounding and order."""
    from pyspark.sql import Window

    led = X.ledger(spark, sf_dir).select(F.col("user_id").alias("bank"), "description", "category", F.trunc("date", "MM").alias("month"), (F.abs("cents").cast("double") / 100).alias("amount"))
    keys = ["bank", "description", "currency"]
    c = P.fixed_expense_candidates(led.withColumn("currency", F.when(F.col("amount") > 150000, "USD").otherwise("PEN")), keys, max_spread=0.4)
    place = F.row_number().over(Window.orderBy(F.col("kind") != "fixed", F.desc("typical"), *keys)).cast("long")
    return P.fixed_expense_proposal(c, keys).select(*keys, "category", "months_seen", "typical", "kind", "note").withColumn("place", place)
