"""Checks and lookups around ingestion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(statements: DataFrame, movements: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, check, declared, actual) of what does not add up: the closing balance always, charges
    and credits only where the statement declares them. statements: keys, opening, closing,
    declared_charges, declared_credits; movements: keys, cents."""
    c = F.col("cents")
    sums = movements.groupBy(*keys).agg(F.sum(c).alias("net"), F.sum(F.when(c < 0, -c).otherwise(0)).alias("charges"), F.sum(F.when(c > 0, c).otherwise(0)).alias("credits"))
    joined = statements.join(sums, keys, "left").na.fill(0, ["net", "charges", "credits"])
    checks = F.array(
        F.struct(F.lit("closing balance").alias("check"), F.col("closing").alias("declared"), (F.col("opening") + F.col("net")).alias("actual")),
        F.struct(F.lit("charges total").alias("check"), F.col("declared_charges").alias("declared"), F.col("charges").alias("actual")),
        F.struct(F.lit("credits total").alias("check"), F.col("declared_credits").alias("declared"), F.col("credits").alias("actual")),
    )
    return joined.select(*keys, F.explode(checks).alias("x")).select(*keys, "x.*").where("declared <> actual")


def trusted_labels(rows: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """rows with trusted_category: the label's category where it is trusted, else null."""
    trusted = labels.select(*keys, F.when(F.col("is_trusted"), F.col("category")).alias("trusted_category"))
    return rows.join(trusted, keys, "left")


def outside_period(rows: DataFrame, statement: list[str], date: str = "date") -> DataFrame:
    """Statements with rows that have no date inside their period (see dated_inside), and how many: to be refused."""
    return rows.where(F.col(date).isNull()).groupBy(*statement).agg(F.count("*").alias("rows_outside"))


def label_problems(sheet: DataFrame, categories: list[str], header: tuple[str, ...] = ("bank", "description", "movements", "suggested_category", "category")) -> DataFrame:
    """(sheet_row, problem) of a completed label sheet (sheet_row and the header's columns); rows without
    any value are passed over. Columns other than the header's are refused as a whole."""
    if tuple(sheet.columns) != ("sheet_row", *header):
        raise ValueError("the columns are not the template's")
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    named, filled = empty("bank") | empty("description"), ~(empty("bank") & empty("description") & empty("movements") & empty("suggested_category") & empty("category"))
    problem = F.when(named, "bank or description is empty").when(~F.coalesce(F.col("category").isin(categories), F.lit(False)), "category is not one of the list")
    return sheet.where(filled).select("sheet_row", problem.alias("problem")).where("problem is not null")


def read_labels(sheet: DataFrame, categories: list[str], unknown: str) -> DataFrame:
    """(bank, description, category, is_trusted) of a completed sheet, none if any row has a problem. A
    category is trusted where the owner changed the suggestion or there was none."""
    bad = label_problems(sheet, categories).agg((F.count("*") > 0).alias("bad"))
    trusted = (F.col("category") != F.col("suggested_category")) | (F.col("suggested_category") == unknown) | F.col("suggested_category").isNull()
    filled = sheet.where("bank is not null and description is not null")
    return filled.join(F.broadcast(bad)).where("not bad").select("bank", "description", "category", trusted.alias("is_trusted"))


def account_dimension(movements: DataFrame) -> DataFrame:
    """One row per account; a maximum guards against attributes that differ."""
    return movements.groupBy("account_id").agg(F.max("bank").alias("bank"), F.max("account_kind").alias("account_kind"))


def rate_limited(events: DataFrame, who: str, limit: int = 40, window_seconds: int = 3600) -> DataFrame:
    """events (who, at seconds, count) with allowed. An event is refused if it and those allowed in
    the trailing window would pass the limit; refused ones do not count later. The verdict feeds
    back into the state, so each key is replayed in order; its state is one window."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema) + ", allowed boolean"

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", kind="stable")
        recent: list[tuple[float, int]] = []
        verdicts = []
        for at, count in zip(rows["at"], rows["count"]):
            recent = [(t, n) for t, n in recent if at - t < window_seconds]
            ok = sum(n for _, n in recent) + count <= limit
            if ok:
                recent.append((at, count))
            verdicts.append(ok)
        return rows.assign(allowed=verdicts)

    return events.groupBy(who).applyInPandas(replay, schema)


def experiment_verdict(base: list[float], base_precision: dict[str, float], mean: float, precision: dict[str, float], weak: list[str]) -> tuple[bool, float, list[str]]:
    """(adopt, margin, dropped): a feature set is adopted if its mean score is ahead by more than
    one standard deviation of the base's folds and no weak category's precision falls."""
    middle = sum(base) / len(base)
    spread = (sum((x - middle) ** 2 for x in base) / max(1, len(base) - 1)) ** 0.5
    dropped = [c for c in weak if c in base_precision and c in precision and precision[c] < base_precision[c]]
    margin = mean - middle
    return margin > spread and not dropped, margin, dropped
