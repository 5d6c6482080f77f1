"""The savings-goal projection: scenarios, emergency fund first, then the goal.

Tables, one row per user unless said otherwise:
plan      user_id, goal_amount, usd_to_pen, emergency_months, emergency_basis, target_date, run_month
balances  user_id, bucket (emergency, other_liquid, risk, essential), currency, amount
cashflow  user_id, scenario, month_index 1..120, month, currency, income, fixed, variable
Amounts are doubles; only here are currencies converted, all to USD by the plan's rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.scalars import month_index

HORIZON_MONTHS, FORECAST_MONTHS = 120, 36
MIN_INCOME_MONTHS, INCOME_MONTHS, VARIABLE_MONTHS, CHECK_MONTHS = 6, 12, 6, 6
MISMATCH_SHARE, LONG_TARGET_MONTHS, REFERENCE_PERCENTILE = 0.25, 24, 25
EPSILON = 1e-9
#: scenario: end of the spending interval, income percentile
SCENARIOS = {"base": ("p50", 0.50), "cautious": ("p90", 0.25), "optimistic": ("p10", 0.75)}
LINES = ("liquid", "with_risk")


def to_usd(currency: Column, amount: Column, rate: Column) -> Column:
    """Null for a currency that is neither."""
    return F.when(currency == "USD", amount).when(currency == "PEN", amount / rate)


def refusals(plan: DataFrame, income: DataFrame) -> DataFrame:
    """(user_id, reason) of plans that cannot be projected: no rate, or no currency with enough
    closed months of income and no override. income: user_id, currency, months, override."""
    longest = income.groupBy("user_id").agg(F.max("months").alias("months"), F.bool_or(F.col("override").isNotNull()).alias("given"))
    joined = plan.join(longest, "user_id", "left")
    reason = F.when(F.col("usd_to_pen").isNull() | ~(F.col("usd_to_pen") > 0), "no exchange rate").when(
        ~F.coalesce("given", F.lit(False)) & (F.coalesce("months", F.lit(0)) < MIN_INCOME_MONTHS), "not enough months of income"
    )
    return joined.select("user_id", reason.alias("reason")).where("reason is not null")


def income_history(income: DataFrame, first_open_month: Column) -> DataFrame:
    """Monthly income (user_id, currency, month, amount) zero-filled from its first month to the last closed one."""
    closed = income.where(F.col("month") < first_open_month)
    last = F.add_months(first_open_month, -1)
    span = closed.groupBy("user_id", "currency").agg(F.min("month").alias("a")).withColumn("month", F.explode(F.sequence("a", last, F.expr("interval 1 month")))).drop("a")
    return span.join(closed.groupBy("user_id", "currency", "month").agg(F.sum("amount").alias("amount")), ["user_id", "currency", "month"], "left").withColumn("amount", F.coalesce("amount", F.lit(0.0)))


def scenario_income(history: DataFrame, overrides: DataFrame) -> DataFrame:
    """(user_id, currency, scenario, income): percentiles of the last months, or the plan's override."""
    newest = Window.partitionBy("user_id", "currency").orderBy(F.desc("month"))
    last = history.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= INCOME_MONTHS)
    columns = [F.percentile("amount", F.lit(p)).alias(s) for s, (_, p) in SCENARIOS.items()]
    wide = last.groupBy("user_id", "currency").agg(*columns).join(overrides, ["user_id", "currency"], "full")
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("scenario"), F.coalesce("override", s, F.lit(0.0)).alias("income")) for s in SCENARIOS)))
    return wide.select("user_id", "currency", each.alias("x")).select("user_id", "currency", "x.*")


def scenario_spending(future: DataFrame) -> DataFrame:
    """(user_id, currency, scenario, month_index 1..120, variable) from forecasts (user_id, currency,
    horizon, p10, p50, p90): the last measured spread is held where none was measured, and the last
    forecast month is held to the end."""
    ends = F.explode(F.array(*(F.struct(F.lit(s).alias("scenario"), (F.col(end) - F.col("p50")).alias("spread")) for s, (end, _) in SCENARIOS.items())))
    rows = future.where(F.col("horizon") <= FORECAST_MONTHS).select("user_id", "currency", "horizon", "p50", ends.alias("x")).select("user_id", "currency", "horizon", "p50", "x.*")
    keys = ["user_id", "currency", "scenario"]
    w = Window.partitionBy(*keys).orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("variable", F.col("p50") + F.coalesce(F.last("spread", ignorenulls=True).over(w), F.lit(0.0)))
    values = held.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("horizon", "variable"))), lambda x: x["variable"]).alias("v"))
    long = values.withColumn("month_index", F.explode(F.sequence(F.lit(1), F.lit(HORIZON_MONTHS))))
    return long.select(*keys, "month_index", F.get("v", F.least(F.col("month_index"), F.size("v")) - 1).alias("variable"))


def cashflow(plan: DataFrame, income: DataFrame, fixed: DataFrame, spending: DataFrame) -> DataFrame:
    """The monthly pieces of every scenario and currency that earns or spends; absent pieces are 0."""
    keys = ["user_id", "currency", "scenario"]
    scenario = F.explode(F.array(*map(F.lit, SCENARIOS))).alias("scenario")
    names = income.select(*keys).unionByName(fixed.select("user_id", "currency", scenario)).unionByName(spending.select(*keys)).distinct()
    months = names.withColumn("month_index", F.explode(F.sequence(F.lit(1), F.lit(HORIZON_MONTHS))))
    joined = months.join(plan.select("user_id", "run_month"), "user_id").join(income, keys, "left").join(fixed, ["user_id", "currency"], "left").join(spending, [*keys, "month_index"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return joined.select("user_id", "scenario", "month_index", F.add_months("run_month", F.col("month_index")).alias("month"), "currency", zero("income"), zero("fixed"), zero("variable"))


def essential(plan: DataFrame, fixed: DataFrame, spend: DataFrame) -> DataFrame:
    """(user_id, currency, amount): monthly essential spending, fixed items and, unless the plan
    says fixed_only, the median of the last variable months. spend: user_id, currency, month, amount."""
    newest = Window.partitionBy("user_id", "currency").orderBy(F.desc("month"))
    last = spend.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= VARIABLE_MONTHS)
    median = last.groupBy("user_id", "currency").agg(F.median("amount").alias("amount"))
    median = median.join(plan.where("emergency_basis <> 'fixed_only'").select("user_id"), "user_id", "left_semi")
    return fixed.select("user_id", "currency", F.col("fixed").alias("amount")).unionByName(median).groupBy("user_id", "currency").agg(F.sum("amount").alias("amount"))


def parameters(plan: DataFrame, goal_amount_usd: float | None = None, usd_to_pen: float | None = None, emergency_months: float | None = None, horizon_months: float | None = None) -> DataFrame:
    """The plan under typed free values; None, and a rate of 0, fall back to the plan."""
    pick = lambda value, c: F.coalesce(F.lit(None if value is None else float(value)).cast("double"), F.col(c).cast("double"))
    return plan.select(
        "user_id", "target_date", "run_month",
        pick(goal_amount_usd, "goal_amount").alias("goal_amount_usd"), pick(usd_to_pen or None, "usd_to_pen").alias("usd_to_pen"),
        pick(emergency_months, "emergency_months").alias("emergency_months"), F.lit(float(HORIZON_MONTHS if horizon_months is None else horizon_months)).alias("horizon_months"),
    )


def typed_number(text: str | None) -> float | None:
    """A filter's free text as a number: commas dropped, digits with one dot at most, up to 1e12; else None."""
    text = (text or "").replace(",", "").strip()
    plain = text.isascii() and text.replace(".", "", 1).isdigit() and len(text) <= 15
    return float(text) if plain and float(text) <= 1e12 else None


def sized(params: DataFrame, balances: DataFrame) -> DataFrame:
    """What each bucket holds in USD, and the emergency target."""
    joined = balances.join(params, "user_id").withColumn("usd", to_usd(F.col("currency"), F.col("amount"), F.col("usd_to_pen")))
    of = lambda b: F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("usd"))), F.lit(0.0))
    held = joined.groupBy("user_id").agg(of("emergency").alias("emergency_now"), of("other_liquid").alias("other_liquid"), of("risk").alias("risk"), of("essential").alias("essential"))
    return held.join(params, "user_id").withColumn("emergency_target", F.col("emergency_months") * F.col("essential"))


def dynamic_goal(params: DataFrame, balances: DataFrame, flows: DataFrame) -> DataFrame:
    """One row per user, scenario, line and month 0..120: emergency, goal_progress, months_to_goal,
    reached_month, months_to_fill and the summary figures of the scenario."""
    size = sized(params, balances)
    rate = params.select("user_id", "usd_to_pen")
    converted = flows.join(rate, "user_id")
    usd = lambda x: to_usd(F.col("currency"), x, F.col("usd_to_pen"))
    monthly = converted.groupBy("user_id", "scenario", "month_index", "month").agg(F.sum(usd(F.col("income"))).alias("income"), F.sum(usd(F.col("income") - F.col("fixed") - F.col("variable"))).alias("saving"))
    scenarios = monthly.groupBy("user_id", "scenario").agg(F.avg(F.when(F.col("month_index") <= 3, F.col("saving"))).alias("projected_monthly_saving"), F.max(F.when(F.col("month_index") == 1, F.col("income"))).alias("income"))
    run = Window.partitionBy("user_id", "scenario").orderBy("month_index").rowsBetween(Window.unboundedPreceding, 0)
    saved = monthly.select("user_id", "scenario", "month_index", "month", F.sum("saving").over(run).alias("saved"))
    start = scenarios.join(params.select("user_id", "run_month"), "user_id").select("user_id", "scenario", F.lit(0).alias("month_index"), F.col("run_month").alias("month"), F.lit(0.0).alias("saved"))
    path = saved.unionByName(start).join(size, "user_id").withColumn("line", F.explode(F.array(*map(F.lit, LINES))))
    counted = F.when(F.col("line") == "liquid", F.col("other_liquid")).otherwise(F.col("other_liquid") + F.col("risk"))
    fund = F.col("emergency_now") + F.col("saved")
    path = path.withColumns(
        {
            "counted": counted,
            "spare": fund - F.col("emergency_target"),
            "emergency": F.least(F.greatest(fund, F.lit(0.0)), F.col("emergency_target")),
            "goal_progress": counted + F.greatest(F.lit(0.0), fund - F.col("emergency_target")),
        }
    )
    whole = Window.partitionBy("user_id", "scenario", "line")
    hit = F.col("goal_progress") >= F.col("goal_amount_usd") - EPSILON
    first = lambda cond, c: F.min(F.when(cond, F.col(c))).over(whole)
    left = month_index(F.col("target_date")) - month_index(F.col("run_month"))
    need = F.col("goal_amount_usd") - F.col("counted")
    required = F.when(left >= 1, F.when(need <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (F.col("emergency_target") + need - F.col("emergency_now")) / F.nullif(left, F.lit(0)))))
    out = path.withColumns({"months_to_goal": first(hit, "month_index"), "reached_month": first(hit, "month"), "months_to_fill": first(F.col("spare") >= -EPSILON, "month_index"), "required_monthly_saving": required})
    joined = out.join(scenarios, ["user_id", "scenario"])
    positive = lambda top, bottom: F.when(F.col(bottom) > 0, F.col(top) / F.nullif(F.col(bottom), F.lit(0.0)))
    return joined.select(
        "user_id", "scenario", "line", "month_index", "month", "emergency", "goal_progress", "months_to_goal", "reached_month", "projected_monthly_saving", "required_monthly_saving",
        "emergency_target", "emergency_now", F.greatest(F.lit(0.0), F.col("emergency_target") - F.col("emergency_now")).alias("emergency_gap"), "months_to_fill",
        positive("emergency_now", "essential").alias("months_covered"), positive("emergency_target", "income").alias("months_of_income"),
        positive("projected_monthly_saving", "income").alias("savings_rate"), (F.col("essential") > F.col("income")).alias("essential_over_income"),
        (F.col("emergency_target") > LONG_TARGET_MONTHS * F.col("income")).alias("target_over_two_years_income"),
        "goal_amount_usd", "usd_to_pen", "emergency_months", "horizon_months",
    )


def headroom(categories: DataFrame, rate: DataFrame) -> DataFrame:
    """(user_id, category, currency, forecast, reference, headroom, share) in USD from (user_id,
    category, currency, forecast, last12 array): forecast above the reference percentile of last year."""
    each = categories.select("user_id", "category", "currency", "forecast", F.explode("last12").alias("v"))
    low = each.groupBy("user_id", "category", "currency", "forecast").agg(F.percentile("v", F.lit(REFERENCE_PERCENTILE / 100)).alias("reference")).join(rate, "user_id")
    usd = low.select("user_id", "category", "currency", to_usd(F.col("currency"), F.col("forecast"), F.col("usd_to_pen")).alias("forecast"), to_usd(F.col("currency"), F.col("reference"), F.col("usd_to_pen")).alias("reference"))
    room = usd.withColumn("headroom", F.greatest(F.lit(0.0), F.col("forecast") - F.col("reference")))
    total = F.sum("headroom").over(Window.partitionBy("user_id"))
    return room.withColumn("share", F.when(total > 0, F.col("headroom") / F.nullif(total, F.lit(0.0))))


def goal_summary(path: DataFrame, rooms: DataFrame) -> DataFrame:
    """(user_id, scenario, line, months_to_goal, reached_month, required, projected, gap, share of the gap that headroom covers)."""
    total = rooms.groupBy("user_id").agg(F.sum("headroom").alias("total_headroom"))
    one = path.where("month_index = 0").join(total, "user_id", "left").withColumn("gap", F.greatest(F.lit(0.0), F.col("required_monthly_saving") - F.col("projected_monthly_saving")))
    gap = F.when(F.col("required_monthly_saving").isNotNull(), F.col("gap"))
    return one.select("user_id", "scenario", "line", "months_to_goal", "reached_month", "required_monthly_saving", "projected_monthly_saving", gap.alias("gap"), (F.coalesce("total_headroom", F.lit(0.0)) / F.nullif(gap, F.lit(0.0))).alias("headroom_share_of_gap"))


def cross_check(flows: DataFrame) -> DataFrame:
    """Per user: do income less spending and the change of liquid balances agree over the last
    months? flows: user_id, month, income, spending, liquid in USD."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("month"))
    recent = flows.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= CHECK_MONTHS + 1)
    change = F.col("liquid") - F.lag("liquid").over(Window.partitionBy("user_id").orderBy("month"))
    pairs = recent.withColumn("change", change).where("change is not null").withColumn("net", F.col("income") - F.col("spending"))
    off = F.count_if(F.abs(F.col("net") - F.col("change")) > MISMATCH_SHARE * F.col("spending"))
    return pairs.groupBy("user_id").agg(off.alias("mismatch_months"), F.count("*").alias("months_checked"), F.avg("net").alias("avg_net_flow"), F.avg("change").alias("avg_balance_change")).withColumn("balance_mismatch", F.col("mismatch_months") * 2 > F.col("months_checked"))
