"""Reports over movements and forecasts. as_of is a date in text; months before its own are closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.scalars import UNCATEGORIZED, month_index

INTERVAL_STATES = ("no_interval", "above", "below", "within")
INCOME_LABEL = "Ingresos"


def first_of(as_of: str) -> Column:
    return F.trunc(F.lit(as_of).cast("date"), "MM")


def interval_status(actual: Column, p10: Column, p90: Column) -> Column:
    missing, above, below, within = INTERVAL_STATES
    return F.when(p10.isNull() | p90.isNull(), missing).when(actual > p90, above).when(actual < p10, below).otherwise(within)


def spending(movements: DataFrame, as_of: str, months: int) -> DataFrame:
    """Outflows that are no internal transfer, in the closed months of the window."""
    first = first_of(as_of)
    inside = (F.col("date") < first) & (F.col("date") >= F.add_months(first, -months))
    return movements.where((F.col("flow_type") == "egreso") & ~F.col("is_internal_transfer") & inside)


def fixed_expense_monitor(plan: DataFrame, movements: DataFrame, keys: list[str], as_of: str, window: int = 6, threshold_pct: float = 10) -> DataFrame:
    """Each fixed item of the plan with what was last seen of it, its deviation in per cent and a status."""
    spent = spending(movements, as_of, window).groupBy(*keys, F.trunc("date", "MM").alias("month_start")).agg(F.sum(-F.col("signed_cents")).alias("amount"))
    seen = spent.groupBy(*keys).agg(F.count("*").alias("n"), F.max("month_start").alias("last_observed_month"), F.max_by("amount", "month_start").alias("last_observed"))
    items = plan.where("kind = 'fixed'").join(seen, keys, "left")
    off = F.round((F.col("last_observed") - F.col("expected")) * F.lit(100.0) / F.nullif(F.col("expected").cast("double"), F.lit(0.0)), 1)
    status = F.when(F.col("deviation_pct").isNull(), "not_seen").when(F.abs("deviation_pct") > threshold_pct, "deviating").otherwise("as_expected")
    return items.select(*keys, "expected", "last_observed_month", "last_observed", F.coalesce("n", F.lit(0)).alias("months_seen_last_6"), off.alias("deviation_pct")).withColumn("status", status)


def category_variance(forecast: DataFrame, user: str = "user_id", recent_months: int = 6) -> DataFrame:
    """The latest run's backtest of its own month against its interval, and how many recent months exceeded theirs."""
    last = forecast.groupBy(user).agg(F.max("run_month").alias("run_month"))
    backtest = forecast.join(last, [user, "run_month"]).where("kind = 'backtest'")
    keys = [user, "category", "currency"]
    recent = backtest.where(F.col("target_month") > F.add_months("run_month", -recent_months)).groupBy(*keys).agg(F.count_if(F.col("actual") > F.col("p90")).alias("months_above_last_6"))
    rows = backtest.where("target_month = run_month").join(recent, keys)
    return rows.select(*keys, "run_month", "target_month", "model_name", "actual", "p10", "p50", "p90", "months_above_last_6", (F.col("actual") - F.col("p50")).alias("difference"), interval_status(F.col("actual"), F.col("p10"), F.col("p90")).alias("status"))


def forecast_realized(forecast: DataFrame, user: str = "user_id") -> DataFrame:
    """Forecasts whose month has closed, against the latest run's actual, and those backtests."""
    keys = [user, "category", "currency", "target_month"]
    tested = forecast.where("kind = 'backtest' and actual is not null")
    newest = tested.groupBy(*keys).agg(F.max_by(F.struct("run_month", "actual"), "run_month").alias("x")).select(*keys, F.col("x.run_month").alias("newest_run"), F.col("x.actual").alias("closed"))
    miss = tested.groupBy(user, "run_month", "category", "currency").agg(F.avg(F.abs(F.col("actual") - F.col("p50"))).alias("backtest_mae"))
    made = forecast.where("kind = 'forecast'").drop("actual").join(newest, keys).join(miss, [user, "run_month", "category", "currency"], "left")
    error = F.abs(F.col("closed") - F.col("p50"))
    ratio = F.when(F.col("horizon") == 1, error / F.nullif(F.col("backtest_mae"), F.lit(0.0)))
    columns = [user, "run_month", "category", "currency", "target_month", "horizon", "model_name", "p10", "p50", "p90"]
    realized = made.select(*columns, F.col("closed").alias("actual"), "backtest_mae", error.alias("realized_error"), ratio.alias("error_ratio"), F.lit("realized").alias("source"))
    back = forecast.where("kind = 'backtest'").join(newest, keys).where("run_month = newest_run")
    none = F.lit(None).cast("double")
    backtested = back.select(*columns, "actual", none.alias("backtest_mae"), F.abs(F.col("actual") - F.col("p50")).alias("realized_error"), none.alias("error_ratio"), F.lit("backtest").alias("source"))
    return realized.unionByName(backtested).withColumn("status", interval_status(F.col("actual"), F.col("p10"), F.col("p90")))


def category_forecast(forecast: DataFrame, quality: DataFrame, user: str = "user_id") -> DataFrame:
    """The latest run's forecasts with the quality of their series."""
    last = forecast.groupBy(user).agg(F.max("run_month").alias("run_month"))
    rows = forecast.where("kind = 'forecast'").join(last, [user, "run_month"])
    return rows.join(quality, [user, "run_month", "category", "currency"], "left").withColumn("has_interval", F.col("p10").isNotNull() & F.col("p90").isNotNull())


def income_statement(movements: DataFrame, plan: DataFrame, forecast: DataFrame, base_income: DataFrame, as_of: str, past_months: int = 12) -> DataFrame:
    """Long income statement (user_id, currency, month, month_label, months_ahead, kind, line, cents).

    movements: user_id, currency, date, flow_type, category, item, is_internal_transfer, signed_cents.
    plan: user_id, currency, item, expected. forecast (latest run): user_id, currency, category,
    month, p50. base_income: user_id, currency, month, income. All amounts in cents."""
    first = first_of(as_of)
    since = F.add_months(first, -past_months)
    key = ["user_id", "currency"]
    fixed_total = plan.groupBy(*key).agg(F.sum("expected").alias("expected_fixed"))
    recent = forecast.where(F.col("month") >= since)
    total = recent.where("category = 'Total'").select(*key, "month", "p50")
    ahead = recent.where((F.col("category") != "Total") & (F.col("month") >= first))
    shown = F.when(F.col("category") == INCOME_LABEL, UNCATEGORIZED).otherwise(F.col("category"))
    moved = movements.where(~F.col("is_internal_transfer") & F.col("flow_type").isin("ingreso", "egreso") & (F.col("date") >= since) & (F.col("date") < first))
    moved = moved.join(plan.select(*key, "item").withColumn("is_fixed", F.lit(True)), [*key, "item"], "left").select(*key, F.trunc("date", "MM").alias("month"), "flow_type", "signed_cents", F.coalesce("is_fixed", F.lit(False)).alias("is_fixed"), shown.alias("category"))
    when = lambda cond, x: F.coalesce(F.sum(F.when(cond, x)), F.lit(0))
    out, cents = F.col("flow_type") == "egreso", F.col("signed_cents")
    actual = moved.groupBy(*key, "month").agg(when(~out, cents).alias("income"), when(out & F.col("is_fixed"), -cents).alias("fixed"), when(out & ~F.col("is_fixed"), -cents).alias("variable")).withColumn("kind", F.lit("actual"))
    coming = total.where(F.col("month") >= first).join(base_income, [*key, "month"], "left").join(fixed_total, key, "left")
    coming = coming.select(*key, "month", "income", F.coalesce("expected_fixed", F.lit(0)).alias("fixed"), F.col("p50").alias("variable"), F.lit("forecast").alias("kind"))
    months = actual.unionByName(coming).join(fixed_total, key, "left").join(total, [*key, "month"], "left")
    expected = months.withColumn("expected", F.coalesce("expected_fixed", F.lit(0)) + F.col("p50"))

    income, spent, plan_cost = F.col("income"), F.col("fixed") + F.col("variable"), F.col("expected")
    line = lambda name, kind, amount, keep: F.struct(F.lit(name).alias("line"), kind.alias("kind"), F.when(keep, amount).cast("long").alias("cents"))
    own, planned, known = F.col("kind"), F.lit("plan"), income.isNotNull()
    summary = F.array(
        line("1 · Income", own, income, known),
        line("2 · Fixed expenses", own, F.col("fixed"), F.col("fixed") != 0),
        line("4 · Total expenses", own, spent, F.lit(True)),
        line("5 · Monthly saving", own, income - spent, known),
        line("6 · Expected expenses", planned, plan_cost, plan_cost.isNotNull()),
        line("7 · Planned saving", planned, income - plan_cost, known & plan_cost.isNotNull()),
        line("8 · Saving vs plan", F.lit("actual"), plan_cost - spent, (own == "actual") & known & plan_cost.isNotNull()),
    )
    rows = expected.select(*key, "month", F.explode(summary).alias("x")).select(*key, "month", "x.kind", "x.line", "x.cents").where("cents is not null")
    third = F.concat(F.lit("3 · "), F.col("category"))
    spent_on = moved.where(out & ~F.col("is_fixed")).groupBy(*key, "category", "month").agg(F.sum(-cents).alias("cents")).select(*key, "month", F.lit("actual").alias("kind"), third.alias("line"), "cents")
    going_to = ahead.select(*key, "month", F.lit("forecast").alias("kind"), third.alias("line"), F.col("p50").alias("cents"))
    split = ahead.groupBy(*key, "month").agg(F.sum("p50").alias("split"))
    rest = total.where(F.col("month") >= first).join(split, [*key, "month"], "left").withColumn("cents", F.col("p50") - F.coalesce("split", F.lit(0))).where("cents <> 0")
    rest = rest.select(*key, "month", F.lit("forecast").alias("kind"), F.lit("3 · ~ Not split by category").alias("line"), "cents")
    label = F.concat(F.date_format("month", "yyyy-MM"), F.when(F.col("month") >= first, " (forecast)").otherwise(""))
    every = rows.unionByName(spent_on).unionByName(going_to).unionByName(rest)
    return every.select(*key, "month", label.alias("month_label"), (month_index(F.col("month")) - month_index(first)).alias("months_ahead"), "kind", "line", "cents")


def period(date: Column, grain: str) -> Column:
    """The first day of the date's day, week, month, quarter or year."""
    if grain not in ("day", "week", "month", "quarter", "year"):
        raise ValueError(grain)
    return F.to_date(F.date_trunc(grain, date))


def filter_movements(
    df: DataFrame, currency: str | None = None, date_from: str | None = None, date_to: str | None = None, accounts: list | None = None, flow_types: list[str] | None = None, transfers: bool | None = None, user_id: str | None = None,
    years: list[int] | None = None, quarters: list[int] | None = None, months: list[int] | None = None, banks: list[str] | None = None, funds: list[str] | None = None,
) -> DataFrame:
    """The report filters, each typed and none spliced into SQL; user_id is the row-level security predicate."""
    conditions = [
        (user_id, lambda v: F.col("user_id") == v),
        (currency, lambda v: F.col("currency") == v),
        (date_from, lambda v: F.col("date") >= F.lit(v).cast("date")),
        (date_to, lambda v: F.col("date") <= F.lit(v).cast("date")),
        (accounts, lambda v: F.col("account_id").isin(v)),
        (flow_types, lambda v: F.col("flow_type").isin(v)),
        (transfers, lambda v: F.col("is_internal_transfer") == v),
        (years, lambda v: F.year("date").isin(v)),
        (quarters, lambda v: F.quarter("date").isin(v)),
        (months, lambda v: F.month("date").isin(v)),
        (banks, lambda v: F.col("bank").isin(v)),
        (funds, lambda v: F.col("place").isin(v)),
    ]
    for value, condition in conditions:
        if value is not None:
            df = df.where(condition(value))
    return df


def cash_flow_card(df: DataFrame) -> DataFrame:
    """One row: money in and out, net, savings rate, first and last day, months."""
    inflow = F.coalesce(F.sum(F.when(F.col("flow_type") == "ingreso", F.col("signed_cents"))), F.lit(0))
    outflow = F.coalesce(F.sum(F.when(F.col("flow_type") == "egreso", -F.col("signed_cents"))), F.lit(0))
    card = df.where(~F.col("is_internal_transfer")).agg(inflow.alias("money_in"), outflow.alias("money_out"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.countDistinct(F.trunc("date", "MM")).alias("months"))
    net = F.col("money_in") - F.col("money_out")
    return card.withColumn("net", net).withColumn("savings_rate", F.when(F.col("money_in") > 0, net / F.nullif(F.col("money_in").cast("double"), F.lit(0.0))))


def spend_by_category(df: DataFrame) -> DataFrame:
    shown = F.when(F.col("category") == INCOME_LABEL, UNCATEGORIZED).otherwise(F.col("category"))
    return df.where("flow_type = 'egreso' and not is_internal_transfer").groupBy(shown.alias("category")).agg(F.sum(-F.col("signed_cents")).alias("cents"), F.count("*").alias("n"))


def share_of_total(df: DataFrame, value: str) -> DataFrame:
    """share of the whole table's sum; null if that is not above zero. One global sum, broadcast."""
    total = df.agg(F.sum(value).alias("__total"))
    return df.join(F.broadcast(total)).withColumn("share", F.when(F.col("__total") > 0, F.col(value) / F.nullif(F.col("__total").cast("double"), F.lit(0.0)))).drop("__total")


def point_in_time_recurrence(rows: DataFrame, merchant: list[str], window: int = 12) -> DataFrame:
    """Each row (id, merchant..., month, amount) with months_seen and rate over the months strictly
    before its own, and the spread (MAD over median) of their totals."""
    first = rows.agg(F.min(month_index(F.col("month"))).alias("first_index"))
    here = rows.withColumn("i", month_index(F.col("month")))
    totals = here.groupBy(*merchant, "i").agg(F.sum(F.abs("amount")).alias("total"))
    history = totals.groupBy(*merchant).agg(F.sort_array(F.collect_list(F.struct("i", "total"))).alias("history"))
    joined = here.join(history, merchant).join(F.broadcast(first))
    prior = F.transform(F.filter("history", lambda h: (h["i"] >= F.col("i") - window) & (h["i"] < F.col("i"))), lambda h: h["total"].cast("double"))
    out = joined.withColumn("prior", prior).withColumn("available", F.least(F.lit(window), F.col("i") - F.col("first_index")))

    def median(a: Column) -> Column:
        s, n = F.sort_array(a), F.size(a)
        return (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2

    out = out.withColumn("mid", median(F.col("prior")))
    spread = median(F.transform("prior", lambda x: F.abs(x - F.col("mid")))) / F.nullif(F.col("mid"), F.lit(0.0))
    return out.select("id", *merchant, "month", F.size("prior").cast("long").alias("months_seen"), F.when(F.col("available") > 0, F.size("prior") / F.col("available")).alias("rate"), spread.alias("amount_spread"))


def psi(reference: DataFrame, current: DataFrame, column: str, epsilon: float = 1e-4) -> DataFrame:
    """Population stability index of a categorical column: one row (psi, n_values). The reference
    leaves the test to a library; this distance is our own choice."""
    share = lambda df, name: df.groupBy(column).agg(F.count("*").alias(name)).join(F.broadcast(df.agg(F.count("*").alias(f"{name}_all")))).select(column, (F.col(name) / F.col(f"{name}_all")).alias(name))
    both = share(reference, "r").join(share(current, "c"), column, "full")
    r, c = F.greatest(F.coalesce("r", F.lit(0.0)), F.lit(epsilon)), F.greatest(F.coalesce("c", F.lit(0.0)), F.lit(epsilon))
    return both.agg(F.sum((c - r) * F.ln(c / r)).alias("psi"), F.count("*").alias("n_values"))


def split_windows(df: DataFrame, current_days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(reference, current) by the date's distance to the latest date."""
    last = F.broadcast(df.agg(F.max("date").alias("__last")))
    dated = df.join(last)
    recent = F.col("date") > F.date_sub("__last", current_days)
    return dated.where(~recent).drop("__last"), dated.where(recent).drop("__last")


DRIFT_NUMBERS = ("description_length", "digit_share", "log_abs_amount")
DRIFT_CATEGORIES = ("bank", "currency", "flow_type", "category", "label_source")


class TooFewMovements(ValueError):
    """A window has fewer rows than a comparison needs."""


def drift_features(movements: DataFrame) -> DataFrame:
    """date and the eight compared columns of movements (date, bank, currency, flow_type, category,
    label_source, description, amount); the description itself goes."""
    n, digits = F.length("description"), F.regexp_count("description", F.lit(r"\d"))
    return movements.select("date", *DRIFT_CATEGORIES, n.cast("double").alias("description_length"), (digits / F.greatest(n, F.lit(1))).alias("digit_share"), F.log1p(F.abs("amount")).alias("log_abs_amount"))


def drift_report(features: DataFrame, current_days: int = 90, min_rows: int = 30, threshold: float = 0.2, epsilon: float = 1e-4) -> DataFrame:
    """(column, psi, drifted): the population stability index of each column between the days before and
    the last current_days; numbers are compared by the reference's deciles. Windows with fewer than
    min_rows are refused. One aggregation for all columns."""
    reference, current = split_windows(features, current_days)
    sizes = {"reference": reference.count(), "current": current.count()}
    for name, n in sizes.items():
        if n < min_rows:
            raise TooFewMovements(f"the {name} window has {n} movements, {min_rows} are needed")
    tenths = F.array(*(F.lit(k / 10) for k in range(1, 10)))
    cuts = reference.agg(*(F.percentile(c, tenths).alias(f"cuts_{c}") for c in DRIFT_NUMBERS))
    both = reference.withColumn("recent", F.lit(0)).unionByName(current.withColumn("recent", F.lit(1))).join(F.broadcast(cuts))
    bin_of = lambda c: F.size(F.filter(f"cuts_{c}", lambda q: F.col(c) > q)).cast("string")
    values = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in DRIFT_CATEGORIES] + [F.struct(F.lit(c).alias("column"), bin_of(c).alias("value")) for c in DRIFT_NUMBERS]
    counted = both.select("recent", F.explode(F.array(*values)).alias("x")).groupBy("x.column", "x.value").agg(F.sum(1 - F.col("recent")).alias("r"), F.sum("recent").alias("c"))
    r, c = F.greatest(F.col("r") / sizes["reference"], F.lit(epsilon)), F.greatest(F.col("c") / sizes["current"], F.lit(epsilon))
    return counted.groupBy("column").agg(F.sum((c - r) * F.ln(c / r)).alias("psi")).withColumn("drifted", F.col("psi") > threshold)
