"""The owner's plan: merging fresh proposals into it, and every problem it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["bank", "description", "currency"]
CURRENCIES = ["PEN", "USD"]
KINDS = ["fixed", "variable", "ignore"]
BASES = ["all", "fixed_only"]
EMERGENCY_MONTHS = (1, 24)
NOT_DETECTED = "no longer detected"


def merge_plan(previous: DataFrame, proposals: DataFrame) -> DataFrame:
    """The next plan (KEY, kind, expected, proposed_kind, typical, note).

    An owner's own row (no proposed_kind) stays as it is; a row that is not proposed any more
    stays with a note; one that the owner edited takes the fresh proposal but keeps kind and
    expected; untouched rows and new keys are the proposal."""
    fresh = proposals.select(*KEY, F.col("proposed_kind").alias("f_kind"), F.col("typical").alias("f_typical"), F.col("note").alias("f_note"), F.lit(True).alias("seen"))
    old = previous.withColumn("had", F.lit(True))
    both = old.join(fresh, KEY, "full")
    own = F.col("had").isNotNull() & (F.coalesce("proposed_kind", F.lit("")) == "")
    gone = F.col("seen").isNull()
    edited = F.col("had").isNotNull() & (~F.col("kind").eqNullSafe(F.col("proposed_kind")) | ~F.col("expected").eqNullSafe(F.col("typical")))
    keep = own | gone
    pick = lambda mine, theirs: F.when(keep, F.col(mine)).otherwise(F.col(theirs))
    return both.select(
        *KEY,
        F.when(keep | edited, F.col("kind")).otherwise(F.col("f_kind")).alias("kind"),
        F.when(keep | edited, F.col("expected")).otherwise(F.col("f_typical")).alias("expected"),
        pick("proposed_kind", "f_kind").alias("proposed_kind"),
        pick("typical", "f_typical").alias("typical"),
        F.when(own, F.col("note")).when(gone, NOT_DETECTED).otherwise(F.col("f_note")).alias("note"),
    )


def _problems(conditions: list[tuple[Column, str]]) -> Column:
    """The texts whose condition holds, one row each."""
    texts = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(t)) for c, t in conditions)), lambda x: x.isNotNull())
    return F.explode(texts).alias("problem")


def plan_problems(items: DataFrame) -> DataFrame:
    """(row, problem) for items (row, KEY, kind, expected). A row can have several."""
    first = F.min("row").over(Window.partitionBy(*KEY))
    amount = F.col("expected")
    needed = amount.isNotNull() | F.coalesce(F.col("kind") == "fixed", F.lit(False))
    return items.withColumn("first", first).select(
        "row",
        _problems(
            [
                (F.col("bank").isNull() | (F.trim("bank") == ""), "bank is empty"),
                (~F.col("currency").isin(CURRENCIES), "currency must be PEN or USD"),
                (~F.col("kind").isin(KINDS), "kind must be fixed, variable or ignore"),
                (needed & ~F.coalesce(amount > 0, F.lit(False)), "expected must be a positive number"),
                (F.col("row") != F.col("first"), "repeats an earlier row"),
            ]
        ),
    )


def goal_problems(goal: DataFrame, asset_accounts: DataFrame, today: str) -> DataFrame:
    """(user_id, problem) for goals (user_id, goal_amount, usd_to_pen, emergency_months,
    emergency_basis, emergency_account, target_date); asset_accounts: user_id, account."""
    known = asset_accounts.select("user_id", F.col("account").alias("emergency_account"), F.lit(True).alias("known")).distinct()
    joined = goal.join(known, ["user_id", "emergency_account"], "left")
    positive = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    low, high = EMERGENCY_MONTHS
    return joined.select(
        "user_id",
        _problems(
            [
                (~positive("goal_amount"), "goal_amount must be a positive number"),
                (~positive("usd_to_pen"), "usd_to_pen must be a positive number"),
                (~F.coalesce(F.col("emergency_months").between(low, high), F.lit(False)), f"emergency_months must be a whole number from {low} to {high}"),
                (~F.col("emergency_basis").isin(BASES), "emergency_basis must be all or fixed_only"),
                (F.col("known").isNull(), "emergency_account does not match an asset account"),
                (F.col("target_date").isNotNull() & (F.col("target_date") <= F.lit(today).cast("date")), "target_date must be a date after today"),
            ]
        ),
    )
