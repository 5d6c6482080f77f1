"""Balances, returns, capital and their checks. Amounts are integer cents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.scalars import month_index
from ledgerlake.operators.calendar import months_from
from ledgerlake.sources.scratch import staged


def month_end_balances(statements: DataFrame) -> DataFrame:
    """The last statement of each (account_id, currency, month of period_end), liabilities negative."""
    keys = ["user_id", "account_id", "account_kind", "currency", F.trunc("period_end", "MM").alias("month_start")]
    last = F.max_by(F.struct("period_end", "opening", "closing"), F.struct("period_end", "period_start")).alias("x")
    sign = F.when(F.col("account_kind") == "liability", -1).otherwise(1)
    rows = statements.groupBy(*keys).agg(last)
    return rows.select(
        "user_id", "account_id", "account_kind", "currency", "month_start",
        F.col("x.period_end").alias("closing_date"), F.col("x.opening").alias("opening"), F.col("x.closing").alias("closing"),
        (sign * F.col("x.closing")).alias("signed_closing"), (sign * F.col("x.opening")).alias("signed_opening"),
    )


def continuity_breaks(statements: DataFrame) -> DataFrame:
    """Statements that do not follow the one before of their account and currency: another opening
    balance than its closing one, or a month that is not the next."""
    w = Window.partitionBy("account_id", "currency").orderBy("period_end", "period_start")
    linked = statements.withColumn("previous_closing", F.lag("closing").over(w)).withColumn("previous_month", F.lag(month_index(F.col("period_end"))).over(w))
    gap = month_index(F.col("period_end")) != F.col("previous_month") + 1
    broken = F.col("opening") != F.col("previous_closing")
    return linked.where(F.col("previous_closing").isNotNull() & (gap | broken)).withColumns({"month_gap": gap, "balance_gap": broken})


def statement_reconciliation(statements: DataFrame) -> DataFrame:
    """Statements whose opening balance and movements do not give the closing balance."""
    off = F.col("opening") + F.coalesce("declared", F.lit(0)) - F.col("closing")
    return statements.withColumn("difference", off).where("difference <> 0")


def account_reconciliation(balances: DataFrame, movements: DataFrame) -> DataFrame:
    """Per account and currency: first opening, last closing, the signed movements up to the last
    closing date, and what is left unexplained. balances as of month_end_balances."""
    span = balances.groupBy("user_id", "account_id", "account_kind", "currency").agg(
        F.min("month_start").alias("first_month"), F.max("month_start").alias("last_month"), F.max("closing_date").alias("closing_date"),
        F.min_by("signed_opening", "month_start").alias("opening"), F.max_by("signed_closing", "month_start").alias("closing"),
    )
    m = movements.select(F.col("account_id").alias("a"), F.col("currency").alias("c"), F.col("date").alias("d"), "signed_cents")
    joined = span.join(m, (F.col("account_id") == F.col("a")) & (F.col("currency") == F.col("c")) & (F.col("closing_date") >= F.col("d")), "left")
    keys = ["user_id", "account_id", "account_kind", "currency", "first_month", "last_month", "opening", "closing"]
    total = joined.groupBy(*keys).agg(F.coalesce(F.sum("signed_cents"), F.lit(0)).alias("net_movements"))
    return total.withColumn("difference", F.col("closing") - F.col("opening") - F.col("net_movements"))


def fund_returns(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Monthly Modified Dietz returns from entries (keys, month_start, entry_date, sheet_row, kind,
    amount, balance).

    The return is gain over time-weighted capital, and only where that capital is positive and
    the month follows the one before, or is the first and begins with a flow."""
    flow = F.when(F.col("kind") == "aporte", F.col("amount")).when(F.col("kind") == "retiro", -F.col("amount")).otherwise(0)
    days = F.day(F.last_day("month_start"))
    at = F.struct("entry_date", "sheet_row")
    monthly = entries.withColumn("flow", flow).groupBy(*keys, "month_start").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "aporte", F.col("amount"))), F.lit(0)).alias("contributions"),
        F.coalesce(F.sum(F.when(F.col("kind") == "retiro", F.col("amount"))), F.lit(0)).alias("withdrawals"),
        (F.max_by("kind", at) == "valorizacion").alias("has_valuation"),
        F.min_by("kind", at).alias("first_kind"),
        F.max_by("balance", at).alias("closing"),
        F.min_by(F.col("balance") - F.col("flow"), at).alias("before_first"),
        (F.sum(F.col("flow") * (days - F.day("entry_date"))) / F.max(days)).alias("weighted_flow"),
    )
    w = Window.partitionBy(*keys).orderBy("month_start")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    linked = monthly.withColumns(
        {
            "previous": F.lag("closing").over(w),
            "months_since_previous": month_index(F.col("month_start")) - F.lag(month_index(F.col("month_start"))).over(w),
            "initial": F.first("before_first").over(run),
            "net": F.sum(F.col("contributions") - F.col("withdrawals")).over(run),
        }
    )
    measured = linked.withColumn("opening", F.coalesce("previous", "before_first")).withColumn("gain", F.col("closing") - F.col("opening") - F.col("contributions") + F.col("withdrawals"))
    capital = F.col("opening") + F.col("weighted_flow")
    reliable = (capital > 0) & F.coalesce(F.col("months_since_previous") == 1, F.col("first_kind").isin("aporte", "retiro"))
    return measured.select(
        *keys, "month_start", "has_valuation", "months_since_previous", reliable.alias("is_return_reliable"), "opening", "contributions", "withdrawals", "closing", "gain",
        F.when(F.col("has_valuation"), "valuation").otherwise("last_movement").alias("closing_basis"),
        F.when(reliable, F.col("gain") / F.when(capital > 0, capital)).alias("return_pct"),
        (F.col("initial") + F.col("net")).alias("cumulative_net_contributed"),
        (F.col("closing") - F.col("initial") - F.col("net")).alias("cumulative_gain"),
    )


def recency(df: DataFrame, month: str = "month_start") -> DataFrame:
    """month_recency: 1 for the latest month of the whole table. Ranks the distinct months, which are
    few, and joins them back, in place of one window over all rows."""
    months = df.select(month).distinct()
    ranked = months.withColumn("month_recency", F.dense_rank().over(Window.orderBy(F.desc(month))).cast("long"))
    return df.join(F.broadcast(ranked), month)


def capital(holdings: DataFrame) -> DataFrame:
    """(user_id, currency, month_start, savings, investments, total_capital, debt, net_position,
    month_recency) from holdings (user_id, currency, holding, bucket, month_start, value) with
    buckets savings, investments, debt.

    Each holding stands in every month from its first to the last month of the whole table, with
    its latest value carried forward. Debt is not part of capital."""
    last = holdings.agg(F.max("month_start").alias("last_month"))
    first = holdings.groupBy("user_id", "currency", "holding", "bucket").agg(F.min("month_start").alias("first_month"))
    scaffold = first.join(F.broadcast(last)).select("user_id", "currency", "holding", "bucket", F.explode(months_from(F.col("first_month"), F.col("last_month"))).alias("month_start"))
    keys = ["user_id", "currency", "holding", "bucket"]
    w = Window.partitionBy(*keys).orderBy("month_start").rowsBetween(Window.unboundedPreceding, 0)
    filled = scaffold.join(holdings, [*keys, "month_start"], "left").withColumn("value", F.last("value", ignorenulls=True).over(w))
    of = lambda bucket: F.coalesce(F.sum(F.when(F.col("bucket") == bucket, F.col("value"))), F.lit(0))
    months = filled.groupBy("user_id", "currency", "month_start").agg(of("savings").alias("savings"), of("investments").alias("investments"), of("debt").alias("debt"))
    total = months.withColumn("total_capital", F.col("savings") + F.col("investments")).withColumn("net_position", F.col("total_capital") - F.col("debt"))
    return recency(staged(total))


def latest_as_of(df: DataFrame, keys: list[str], month: Column, value: str, as_of: Column) -> DataFrame:
    """The value of the last month that is not after as_of."""
    return df.where(month <= as_of).groupBy(*keys).agg(F.max(month).alias("as_of_month"), F.max_by(value, month).alias(value))


def savings_followed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, position, amount, balance) of a manual savings sheet with the amount's sign
    repaired where the balance says so: previous balance + amount, or, for an unsigned amount,
    previous balance - amount. problem holds where neither gives the balance."""
    previous = F.lag("balance").over(Window.partitionBy(*keys).orderBy("position"))
    linked = rows.withColumn("previous", previous)
    plus = F.col("previous").isNull() | (F.col("previous") + F.col("amount") == F.col("balance"))
    minus = (F.col("amount") > 0) & (F.col("previous") - F.col("amount") == F.col("balance"))
    return linked.withColumn("repaired", F.when(plus, F.col("amount")).when(minus, -F.col("amount"))).withColumn("problem", ~(plus | minus)).drop("previous")


def month_statements(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Month statements from repaired savings rows: opening is the first balance less its amount."""
    at = F.col("position")
    month = F.trunc("date", "MM").alias("month_start")
    return rows.groupBy(*keys, month).agg(
        F.min("date").alias("period_start"), F.max("date").alias("period_end"),
        F.min_by(F.col("balance") - F.col("repaired"), at).alias("opening"), F.max_by("balance", at).alias("closing"), F.sum("repaired").alias("net"),
    )


def missing_months(df: DataFrame, keys: list[str], month: str = "month_start") -> DataFrame:
    """Months between a key's first and last one that it has no row for."""
    span = df.groupBy(*keys).agg(F.min(month).alias("a"), F.max(month).alias("b"))
    every = span.select(*keys, F.explode(months_from(F.col("a"), F.col("b"))).alias(month))
    return every.join(df.select(*keys, month).distinct(), [*keys, month], "left_anti")
