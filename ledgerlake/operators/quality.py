"""Data-quality checks. Each gives the violating rows or one row per check; none is a failure by itself."""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, violations) in one pass."""
    row = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("violations")) for c in columns))).alias("x")).select("x.*")


def not_accepted(df: DataFrame, column: str, values: list) -> DataFrame:
    """Non-null values outside the accepted ones, with their counts."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(values)).groupBy(column).agg(F.count("*").alias("violations"))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key combinations with more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    keys = parent.select(F.col(parent_column).alias(column)).distinct()
    return df.where(F.col(column).isNotNull()).join(keys, column, "left_anti")


def not_one_to_one(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """Ids that take part in more than one pair, on either side."""
    legs = pairs.select(F.explode(F.array(first, second)).alias("id"))
    return legs.groupBy("id").agg(F.count("*").alias("pairs")).where("pairs > 1")


def volume_anomalies(df: DataFrame, day: Column, as_of: str, trailing: int = 14, min_days: int = 5, sensitivity: float = 3.0) -> DataFrame:
    """Days whose row count is more than sensitivity standard deviations from the mean of the days
    before (trailing at most, min_days at least). The day of as_of itself is not judged."""
    daily = df.groupBy(day.alias("day")).agg(F.count("*").alias("n")).where(F.col("day") < F.lit(as_of).cast("date"))
    first = daily.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null")
    every = first.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day")).join(daily, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    before = Window.orderBy("day").rowsBetween(-trailing, -1)
    judged = every.withColumns({"days": F.count("*").over(before), "mean": F.avg("n").over(before), "sd": F.stddev_samp("n").over(before)})
    score = (F.col("n") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    return judged.where(F.col("days") >= min_days).withColumn("score", score).withColumn("is_anomaly", F.coalesce(F.abs("score") > sensitivity, F.col("n") != F.col("mean")))


def schema_difference(a: DataFrame, b: DataFrame) -> list[tuple[str, str | None, str | None]]:
    """(column, type in a, type in b) where they differ, by name."""
    left, right = dict(a.dtypes), dict(b.dtypes)
    return [(c, left.get(c), right.get(c)) for c in sorted(left.keys() | right.keys()) if left.get(c) != right.get(c)]


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of either table that the other lacks, with side 'left' or 'right'. Columns in the order of a."""
    b = b.select(*a.columns)
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def store_difference(left: Mapping[str, DataFrame], right: Mapping[str, DataFrame]) -> DataFrame:
    """One row for each table of two stores: (name, left_rows, right_rows, added, removed, retyped,
    only_left, only_right). Rows are null on a side that lacks the table; columns are listed by name,
    retyped as 'name: type -> type'; only_* count the distinct rows, over the common columns, that the other lacks."""
    spark = next(iter({**left, **right}.values())).sparkSession
    out = []
    for name in sorted(left.keys() | right.keys()):
        a, b = left.get(name), right.get(name)
        line = [F.lit(name).alias("name"), *(F.lit(None if t is None else t.count()).cast("long").alias(c) for t, c in ((a, "left_rows"), (b, "right_rows")))]
        changes, counts = {"added": [], "removed": [], "retyped": []}, spark.range(1).select(*(F.lit(None).cast("long").alias(c) for c in ("only_left", "only_right")))
        if a is not None and b is not None:
            for column, was, now in schema_difference(a, b):
                changes["added" if was is None else "removed" if now is None else "retyped"].append(column if was is None or now is None else f"{column}: {was} -> {now}")
            if common := [c for c in a.columns if c in b.columns]:
                sides = table_difference(a.select(*common), b.select(*common))
                counts = sides.agg(F.count_if(F.col("side") == "left").alias("only_left"), F.count_if(F.col("side") == "right").alias("only_right"))
        out.append(counts.select(*line, *(F.lit(", ".join(v)).alias(k) for k, v in changes.items()), "only_left", "only_right"))
    return functools.reduce(DataFrame.unionByName, out)


def difference_sample(a: DataFrame, b: DataFrame, limit: int = 5) -> DataFrame:
    """At most limit rows of either side, over the common columns, that the other lacks: a report for reading."""
    common = [c for c in a.columns if c in b.columns]
    sides = table_difference(a.select(*common), b.select(*common))
    return sides.where("side = 'left'").orderBy(*common).limit(limit).unionByName(sides.where("side = 'right'").orderBy(*common).limit(limit))


def same_movements(a: DataFrame, b: DataFrame) -> bool:
    """Whether two files have the same multiset of rows, whatever their order."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


#: Spark's types as a catalog names them.
CATALOG_TYPES = {"string": "STRING", "bigint": "BIGINT", "int": "INT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}


def catalog_columns(df: DataFrame) -> DataFrame:
    """(position, name, type, nullable) of a table, as a catalog lists it; decimals keep their precision, other types their Spark name."""
    kinds = [(i, f.name, CATALOG_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString().upper()), f.nullable) for i, f in enumerate(df.schema, 1)]
    return df.sparkSession.createDataFrame(kinds, "position int, name string, type string, nullable boolean")


def anomalous_charges(charges: DataFrame, keys: list[str], threshold: float = 3.5, min_rows: int = 5) -> DataFrame:
    """An extension: robust scores 1/1.4826 |x - median| / MAD above the threshold, for keys with
    enough rows and a spread."""
    typical = charges.groupBy(*keys).agg(F.median("amount").alias("mid"), F.count("*").alias("n")).where(F.col("n") >= min_rows)
    joined = charges.join(typical, keys).withColumn("off", F.abs(F.col("amount") - F.col("mid")))
    spread = joined.groupBy(*keys).agg(F.median("off").alias("mad")).where("mad > 0")
    return joined.join(spread, keys).withColumn("score", F.col("off") / (F.lit(1.4826) * F.col("mad"))).where(F.col("score") > threshold)


def duplicate_charges(charges: DataFrame, keys: list[str], days: int = 3) -> DataFrame:
    """An extension: charges (id, keys..., date, amount) that repeat one of the same keys and amount from at
    most so many days before, with that date. Of charges of one day the one with the smaller id is the first."""
    same = Window.partitionBy(*keys, "amount").orderBy("date", "id")
    return charges.withColumn("previous_date", F.lag("date").over(same)).where(F.datediff("date", "previous_date") <= days)


def first_merchant_charges(charges: DataFrame, who: list[str], merchant: str, after: int = 0) -> DataFrame:
    """An extension: the charges (id, who..., merchant, date) that are the first of their merchant, if the
    one who pays had so many charges at least before; of charges of one day the smaller id is the first."""
    own, there = Window.partitionBy(*who).orderBy("date", "id"), Window.partitionBy(*who, merchant).orderBy("date", "id")
    ranked = charges.withColumns({"charges_before": (F.row_number().over(own) - 1).cast("long"), "__r": F.row_number().over(there)})
    return ranked.where((F.col("__r") == 1) & (F.col("charges_before") >= after)).drop("__r")


def backfill_verdict(before: DataFrame, after: DataFrame, document: list[str]) -> DataFrame:
    """(document..., same, only_before, only_after): whether each document's rows are the same multiset in both,
    whatever their order, and how many either side has beyond the other. Columns in the order of before."""
    columns = before.columns
    side = lambda df, sign: df.select(*columns).groupBy(*columns).agg((sign * F.count("*")).alias("n"))
    off = side(before, 1).unionByName(side(after, -1)).groupBy(*columns).agg(F.sum("n").alias("n"))
    each = off.groupBy(*document).agg(F.sum(F.greatest("n", F.lit(0))).alias("only_before"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("only_after"))
    return each.withColumn("same", (F.col("only_before") == 0) & (F.col("only_after") == 0))
