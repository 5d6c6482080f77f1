"""Spending forecasts: dense series, five forecasters, rolling backtest, selection, intervals.

A series is one row (keys..., values array<double>, first month, last month), oldest value
first. Backtests explode origins and horizons of single rows; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.calendar import months_from

TOTAL = "Total"
BASELINE = "median_6"
#: In order: of equally good candidates the first one wins.
CANDIDATES = ("naive_last", "mean_3", BASELINE, "ses", "seasonal_naive_12")
SES_ALPHA, SEASON = 0.3, 12
MIN_TRAIN, HORIZONS, INTERVAL_HORIZONS = 9, 36, 12
MIN_IMPROVEMENT, MIN_WIN_RATE = 0.05, 0.60
MIN_ERRORS, MIN_NONZERO_MONTHS, LEVEL_MONTHS = 12, 3, 12
LOW_QUANTILE, HIGH_QUANTILE = 0.10, 0.90


def build_series(rows: DataFrame, group: list[str], first_open_month: Column, excluded: Column | None = None) -> DataFrame:
    """Zero-filled series (group..., category, values, first_month, last_month) and a Total per group.

    rows: group..., category, month, amount. A group starts at its own first month, excluded
    rows included, and ends at the last closed month; a category all of whose rows are excluded
    has no series, but the Total always has one."""
    closed = rows.where(F.col("month") < first_open_month)
    span = closed.groupBy(*group).agg(F.min("month").alias("first_month")).withColumn("last_month", F.add_months(first_open_month, -1))
    kept = closed if excluded is None else closed.where(~excluded)
    by_month = kept.groupBy(*group, "category", "month").agg(F.sum("amount").cast("double").alias("amount"))
    scaffold = span.withColumn("month", F.explode(months_from(F.col("first_month"), F.col("last_month"))))
    names = by_month.select(*group, "category").distinct()
    dense = scaffold.join(names, group).join(by_month, [*group, "category", "month"], "left").withColumn("amount", F.coalesce("amount", F.lit(0.0)))
    sums = by_month.groupBy(*group, "month").agg(F.sum("amount").alias("amount"))
    total = scaffold.join(sums, [*group, "month"], "left").withColumns({"category": F.lit(TOTAL), "amount": F.coalesce("amount", F.lit(0.0))})
    both = dense.unionByName(total)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("month", "amount"))), lambda x: x["amount"])
    return both.groupBy(*group, "category", "first_month", "last_month").agg(ordered.alias("values"))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _median(a: Column) -> Column:
    s = F.sort_array(a)
    n = F.size(a)
    return (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2


def _last(a: Column, n: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n))


def flat_level(model: str, history: Column) -> Column:
    """What a flat model repeats; history is not empty."""
    if model == "naive_last":
        return F.element_at(history, -1)
    if model == "mean_3":
        return _mean(_last(history, 3))
    if model == BASELINE:
        return _median(_last(history, 6))
    if model == "ses":
        return F.aggregate(F.slice(history, F.lit(2), F.size(history)), F.element_at(history, 1), lambda level, y: F.lit(SES_ALPHA) * y + F.lit(1 - SES_ALPHA) * level)
    raise ValueError(model)


def point(model: Column, history: Column, horizon: Column) -> Column:
    """The forecast of a model, by name, so many months ahead; null where it lacks history."""
    seasonal = F.when(F.size(history) >= SEASON, F.get(history, (F.size(history) - SEASON + (horizon - 1) % SEASON).cast("int")))
    out = F.when(model == "seasonal_naive_12", seasonal)
    for m in CANDIDATES[:-1]:
        out = out.when(model == m, flat_level(m, history))
    return F.when(F.size(history) > 0, out)


def forecasts(series: DataFrame, keys: list[str], models=CANDIDATES, horizons: int = HORIZONS) -> DataFrame:
    """(keys, model, horizon, target_month, point)."""
    rows = series.withColumn("model", F.explode(F.array(*map(F.lit, models)))).withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizons))))
    return rows.select(*keys, "model", "horizon", F.add_months("last_month", F.col("horizon")).alias("target_month"), point(F.col("model"), F.col("values"), F.col("horizon")).alias("point")).where("point is not null")


def rolling(series: DataFrame, keys: list[str], horizons: int = INTERVAL_HORIZONS) -> DataFrame:
    """(keys, origin, model, horizon, point, actual, level): forecasts from the first origin values
    only, for all origins with MIN_TRAIN or more; level is the mean of the last months before."""
    n = F.size("values")
    origins = series.where(n > MIN_TRAIN).withColumn("origin", F.explode(F.sequence(F.lit(MIN_TRAIN), n - 1)))
    history = F.slice("values", F.lit(1), F.col("origin"))
    each = origins.withColumn("history", history).withColumn("level", _mean(_last(F.col("history"), LEVEL_MONTHS)))
    flat = each.select(*keys, "origin", "level", "values", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), flat_level(m, F.col("history")).alias("flat")) for m in CANDIDATES[:-1]), F.struct(F.lit(CANDIDATES[-1]).alias("model"), F.lit(None).cast("double").alias("flat")))).alias("x"))
    ahead = flat.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.least(F.lit(horizons), F.size("values") - F.col("origin")))))
    seasonal = F.when(F.col("origin") >= SEASON, F.get("values", (F.col("origin") - SEASON + (F.col("horizon") - 1) % SEASON).cast("int")))
    value = F.coalesce("x.flat", seasonal)
    out = ahead.select(*keys, "origin", F.col("x.model").alias("model"), "horizon", value.alias("point"), F.get("values", F.col("origin") + F.col("horizon") - 1).alias("actual"), "level")
    return out.where("point is not null")


def low_history(values: Column) -> Column:
    return (F.size(values) < MIN_TRAIN) | (F.size(F.filter(values, lambda x: x != 0)) < MIN_NONZERO_MONTHS)


def select_models(series: DataFrame, rolled: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model, mae_ratio, low_history): the candidate with the smallest error ratio to the
    baseline at horizon 1 on common origins, adopted if it is 5 % better and wins 60 % of them."""
    one = rolled.where("horizon = 1").select(*keys, "origin", "model", F.abs(F.col("actual") - F.col("point")).alias("error"))
    base = one.where(F.col("model") == BASELINE).select(*keys, "origin", F.col("error").alias("base"))
    rank = F.array_position(F.array(*map(F.lit, CANDIDATES)), F.col("model"))
    scored = one.where(F.col("model") != BASELINE).join(base, [*keys, "origin"]).groupBy(*keys, "model").agg(
        F.avg("error").alias("mae"), F.avg("base").alias("mae_base"), F.avg((F.col("error") < F.col("base")).cast("double")).alias("wins")
    )
    ratio = scored.where("mae_base > 0").withColumn("ratio", F.col("mae") / F.col("mae_base")).withColumn("rank", rank)
    best = ratio.groupBy(*keys).agg(F.min_by(F.struct("model", "ratio", "wins"), F.struct("ratio", "rank")).alias("b"))
    joined = series.select(*keys, low_history(F.col("values")).alias("low_history")).join(best, keys, "left")
    adopt = ~F.col("low_history") & F.col("b").isNotNull() & (F.col("b.ratio") <= 1 - MIN_IMPROVEMENT) & (F.col("b.wins") >= MIN_WIN_RATE)
    adopt = F.coalesce(adopt, F.lit(False))
    return joined.select(*keys, F.when(adopt, F.col("b.model")).otherwise(BASELINE).alias("model"), F.when(adopt, F.col("b.ratio")).otherwise(1.0).alias("mae_ratio"), "low_history")


def error_offsets(series: DataFrame, rolled: DataFrame, chosen: DataFrame, keys: list[str], pool: list[str]) -> DataFrame:
    """(keys, horizon, low, high): error quantiles of the chosen model by horizon. With fewer than
    MIN_ERRORS errors of its own a series takes the pool's relative errors times its level; the
    Total takes from the pool but does not give. No row where neither is enough."""
    own = rolled.join(chosen.select(*keys, "model"), [*keys, "model"]).withColumn("error", F.col("actual") - F.col("point"))
    quantiles = lambda c: (F.percentile(c, F.lit(LOW_QUANTILE)), F.percentile(c, F.lit(HIGH_QUANTILE)))
    low, high = quantiles("error")
    mine = own.groupBy(*keys, "horizon").agg(F.count("*").alias("n"), low.alias("own_low"), high.alias("own_high"))
    relative = own.where((F.col("category") != TOTAL) & (F.col("level") > 0)).withColumn("share", F.col("error") / F.col("level"))
    low, high = quantiles("share")
    lent = relative.groupBy(*pool, "horizon").agg(F.count("*").alias("pool_n"), low.alias("pool_low"), high.alias("pool_high"))
    grid = series.select(*keys, _mean(_last(F.col("values"), LEVEL_MONTHS)).alias("last_level"), F.explode(F.sequence(F.lit(1), F.lit(INTERVAL_HORIZONS))).alias("horizon"))
    both = grid.join(mine, [*keys, "horizon"], "left").join(lent, [*pool, "horizon"], "left")
    enough = F.coalesce(F.col("n") >= MIN_ERRORS, F.lit(False))
    borrow = F.coalesce((F.col("pool_n") >= MIN_ERRORS) & (F.col("last_level") > 0), F.lit(False))
    pick = lambda side: F.when(enough, F.col(f"own_{side}")).when(borrow, F.col(f"pool_{side}") * F.col("last_level"))
    return both.select(*keys, "horizon", pick("low").alias("low"), pick("high").alias("high")).where("low is not null")


def interval_forecasts(series: DataFrame, chosen: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model, horizon, target_month, p10, p50, p90); ends are at least 0, null where nothing was measured."""
    rows = series.join(chosen.select(*keys, "model"), keys).withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(HORIZONS))))
    p50 = rows.select(*keys, "model", "horizon", F.add_months("last_month", F.col("horizon")).alias("target_month"), point(F.col("model"), F.col("values"), F.col("horizon")).alias("p50"))
    end = lambda side: F.when(F.col(side).isNotNull(), F.greatest(F.lit(0.0), F.col("p50") + F.col(side)))
    return p50.join(offsets, [*keys, "horizon"], "left").select(*keys, "model", "horizon", "target_month", end("low").alias("p10"), "p50", end("high").alias("p90"))


def series_metrics(series: DataFrame, rolled: DataFrame, chosen: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model, baseline_used, low_history, n_months, n_origins, mae_ratio, coverage)."""
    errors = rolled.where("horizon = 1").join(chosen.select(*keys, "model"), [*keys, "model"]).withColumn("error", F.col("actual") - F.col("point"))
    covered = errors.join(offsets.where("horizon = 1").drop("horizon"), keys).groupBy(*keys).agg(F.avg(F.col("error").between(F.col("low"), F.col("high")).cast("double")).alias("coverage"))
    n = F.size("values")
    return chosen.join(series.select(*keys, n.cast("long").alias("n_months"), F.greatest(F.lit(0), n - MIN_TRAIN).cast("long").alias("n_origins")), keys).join(covered, keys, "left").withColumn("baseline_used", F.col("model") == BASELINE)


def fixed_expense_candidates(spend: DataFrame, keys: list[str], window: int = 6, min_months: int = 4, max_spread: float = 0.10) -> DataFrame:
    """Recurring charges of the last months in the data: (keys, months_seen, typical, spread, kind), and
    where spend has them, category (that of the key's last month) and, for keys with a currency, note.

    spend: keys..., month, amount. Months whose total is above zero count; spread is the median
    absolute deviation over the median. A charge in several currencies is listed once for each, and
    its note names the others."""
    last = spend.agg(F.max("month").alias("last_month"))
    recent = spend.join(F.broadcast(last)).where(F.col("month") > F.add_months("last_month", -window))
    monthly = recent.groupBy(*keys, "month").agg(F.sum("amount").cast("double").alias("amount")).where("amount > 0")
    typical = monthly.groupBy(*keys).agg(F.count("*").alias("months_seen"), F.median("amount").alias("typical")).where(F.col("months_seen") >= min_months)
    spread = monthly.join(typical, keys).groupBy(*keys, "months_seen", "typical").agg((F.median(F.abs(F.col("amount") - F.col("typical"))) / F.first("typical")).alias("spread"))
    out = spread.withColumn("kind", F.when(F.col("spread") <= max_spread, "fixed").otherwise("variable"))
    if "category" in spend.columns and "category" not in keys:
        out = out.join(recent.groupBy(*keys).agg(F.max_by("category", F.struct("month", "category")).alias("category")), keys)
    if "currency" in keys:
        same = [k for k in keys if k != "currency"]
        seen = out.groupBy(*same).agg(F.sort_array(F.collect_set("currency")).alias("__seen"))
        others = F.array_remove("__seen", F.col("currency"))
        out = out.join(seen, same).withColumn("note", F.when(F.size(others) > 0, F.concat(F.lit("also seen in "), F.array_join(others, ", "))).otherwise("")).drop("__seen")
    return out


def fixed_expense_proposal(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The candidates as they are shown: typical amounts at two decimals, fixed ones first, then the dearest, then by key."""
    shown = candidates.withColumn("typical", F.round("typical", 2))
    return shown.orderBy(F.col("kind") != "fixed", F.desc("typical"), *keys)


def weighted_summary(metrics: DataFrame, weight: str) -> DataFrame:
    """One row of counts and ratios over all series."""
    total = F.sum(weight)
    return metrics.agg(
        F.count("*").alias("series"), F.count_if("baseline_used").alias("baseline_used"), F.count_if("low_history").alias("low_history"), F.avg("mae_ratio").alias("mae_rel_mean"),
        F.when(total > 0, F.sum(F.col("mae_ratio") * F.col(weight)) / F.when(total > 0, total)).otherwise(F.avg("mae_ratio")).alias("mae_rel_weighted"), F.coalesce(F.avg("coverage"), F.lit(0.0)).alias("coverage_mean"),
    )
