"""Movements: flow types, occurrence numbers, internal transfers, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.scalars import UNCATEGORIZED
from ledgerlake.sources.scratch import staged


def flow_type(kind: Column, amount: Column) -> Column:
    """Asset: money in is ingreso, out is egreso. Liability: a charge is egreso, a payment pago.
    Anything else is null on purpose, so that a not-null check reports it."""
    return (
        F.when((kind == "asset") & (amount > 0), "ingreso")
        .when((kind == "asset") & (amount < 0), "egreso")
        .when((kind == "liability") & (amount > 0), "egreso")
        .when((kind == "liability") & (amount < 0), "pago")
    )


def signed_amount(kind: Column, amount: Column) -> Column:
    return F.when(kind == "liability", -amount).otherwise(amount)


def with_occurrence_number(df: DataFrame, keys: list[str]) -> DataFrame:
    """k for the k-th of the rows that agree in all keys. Which of them is which does not matter."""
    return df.withColumn("occurrence_number", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))).cast("long"))


def transfer_candidates(df: DataFrame, window_days: int = 3, tolerance: int = 0) -> DataFrame:
    """Pairs (id, partner, amount_diff, day_diff, same_currency, user_id) of movements of one user on
    two accounts, at most window_days apart, with opposite amounts on accounts of one kind, or both
    going out and equal on accounts of two kinds; amounts may be off by the tolerance in cents.

    Needs id, user_id, account_id, account_kind, date, cents, currency. Both arms are equi-joins
    on user, an amount bucket and a day bucket, each as wide as what it allows; the probe side
    looks at the neighbouring buckets too. A null account_kind is never a candidate."""
    base = df.where("account_kind is not null").select("id", "user_id", "account_id", "account_kind", "date", "cents", "currency")
    day = F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / (window_days + 1))
    level = lambda cents: F.floor(cents / (tolerance + 1)) if tolerance else cents
    around = lambda x: F.explode(F.array(x - 1, x, x + 1))
    right = base.select(*(F.col(c).alias(f"p_{c}") for c in base.columns), day.alias("p_day"), level(F.col("cents")).alias("p_level"))
    left = base.withColumn("day", around(day))

    def met(rows: DataFrame, wanted: Column, kinds: Column) -> DataFrame:
        rows = rows.withColumn("wanted", wanted)
        rows = rows.withColumn("level", around(level(F.col("wanted"))) if tolerance else F.col("wanted"))
        equal = (F.col("user_id") == F.col("p_user_id")) & (F.col("level") == F.col("p_level")) & (F.col("day") == F.col("p_day"))
        off = F.abs(F.col("wanted") - F.col("p_cents"))
        apart = F.abs(F.datediff("date", "p_date"))
        other = (F.col("account_id") != F.col("p_account_id")) & (F.col("id") != F.col("p_id"))
        return rows.join(right, equal & kinds & other & (apart <= window_days) & (off <= tolerance)).select(
            "id", F.col("p_id").alias("partner"), off.alias("amount_diff"), apart.cast("long").alias("day_diff"), (F.col("currency") == F.col("p_currency")).alias("same_currency"), "user_id"
        )

    alike = F.col("account_kind") == F.col("p_account_kind")
    out = ~alike & (F.col("p_cents") < 0)
    return met(left, -F.col("cents"), alike).unionByName(met(left.where("cents < 0"), F.col("cents"), out))


def mutual_matches(candidates: DataFrame) -> DataFrame:
    """(id, partner, amount_diff, day_diff, user_id) of pairs in which each is the other's nearest
    candidate of its currency (by amount, then days, then id), once from each side."""
    nearest = Window.partitionBy("id").orderBy("amount_diff", "day_diff", "partner")
    best = candidates.where("same_currency").withColumn("rank", F.row_number().over(nearest)).where("rank = 1").drop("rank", "same_currency")
    back = best.select(F.col("id").alias("partner"), F.col("partner").alias("id"))
    return best.join(back, ["id", "partner"])


def transfer_matches(df: DataFrame, window_days: int = 3, tolerance: int = 0) -> DataFrame:
    """Every movement with matched_id, day_diff, is_transfer_candidate and is_internal_transfer."""
    candidates = staged(transfer_candidates(df, window_days, tolerance))
    matches = mutual_matches(candidates).select("id", F.col("partner").alias("matched_id"), "day_diff")
    some = candidates.select("id").distinct().withColumn("is_transfer_candidate", F.lit(True))
    joined = df.join(matches, "id", "left").join(some, "id", "left")
    return joined.withColumn("is_transfer_candidate", F.coalesce("is_transfer_candidate", F.lit(False))).withColumn("is_internal_transfer", F.col("matched_id").isNotNull())


def transfer_pairs(matches: DataFrame) -> DataFrame:
    """One row per matched pair, the smaller id first."""
    legs = ["id", "bank", "account_id", "date", "cents", "account_kind"]
    first = matches.where("is_internal_transfer and id < matched_id").select("user_id", "currency", "day_diff", "matched_id", *(F.col(c).alias(f"first_{c}") for c in legs))
    second = matches.where("is_internal_transfer").select(*(F.col(c).alias(f"second_{c}") for c in legs))
    return first.join(second, F.col("matched_id") == F.col("second_id")).drop("matched_id")


def unmatched_transfers(matches: DataFrame) -> DataFrame:
    return matches.where("is_transfer_candidate and not is_internal_transfer")


def with_category(movements: DataFrame, labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """category by label, else prediction, else the default; category_confirmed if labelled. Both
    lookups have one row per (user_id, bank, description)."""
    keys = ["user_id", "bank", "description"]
    joined = movements.join(labels.select(*keys, F.col("category").alias("label")), keys, "left").join(predictions.select(*keys, F.col("category").alias("guess")), keys, "left")
    return joined.withColumn("category", F.coalesce("label", "guess", F.lit(UNCATEGORIZED))).withColumn("category_confirmed", F.col("label").isNotNull()).drop("label", "guess")


def unlabelled(movements: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct (user_id, bank, description) that no label covers."""
    keys = ["user_id", "bank", "description"]
    return movements.select(*keys).distinct().join(labels, keys, "left_anti")
