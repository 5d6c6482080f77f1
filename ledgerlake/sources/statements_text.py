"""Statement words to rows. Reading a PDF needs a library that is not here; what follows its
words, (page, text, top, x0), is ordinary data work."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.scalars import normalize_description, parse_money

LINE_TOLERANCE, COLUMN_SLACK = 3.0, 5.0


def group_lines(words: DataFrame, document: list[str], tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """Words (document..., top, x0, text) with the number of their line on their page. A line
    starts where a word is more than the tolerance below the line's first word, so each boundary
    depends on the last one and a page is walked in order. Pages are dealt whole and sorted by
    Spark; a worker walks all pages of its partition and holds one batch of them."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema) + ", line long"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, head, line = None, 0.0, 0
        for batch in batches:
            lines = []
            for *key, top in zip(*(batch[c].where(batch[c].notna(), None) for c in document), batch["top"]):
                if key != page:
                    page, head, line = key, top, 0
                elif top - head > tolerance:
                    head, line = top, line + 1
                lines.append(line)
            yield batch.assign(line=lines)

    return words.repartition(*document).sortWithinPartitions(*document, "top", "x0").mapInPandas(walk, schema)


def assign_columns(words: DataFrame, headers: DataFrame, document: list[str], slack: float = COLUMN_SLACK) -> DataFrame:
    """Each word's column: the last header (document..., column, header_x) that starts at most slack
    to the right of the word; null left of all headers. A document's headers are one sorted array,
    looked up by row, so words are neither multiplied nor merged."""
    lists = headers.groupBy(*document).agg(F.sort_array(F.collect_list(F.struct("header_x", "column"))).alias("__headers"))
    left = F.filter("__headers", lambda h: F.col("x0") >= h["header_x"] - slack)
    return words.join(lists, [*document], "left").withColumn("column", F.try_element_at(left, F.lit(-1))["column"]).drop("__headers")


def nearest_column(words: DataFrame, headers: DataFrame, document: list[str]) -> DataFrame:
    """Each amount's column where amounts are right-aligned: the header (document..., column, edge)
    whose right edge is nearest to the word's x1; of two as near the one further left."""
    lists = headers.groupBy(*document).agg(F.sort_array(F.collect_list(F.struct("edge", "column"))).alias("__headers"))
    near = F.array_min(F.transform("__headers", lambda h: F.struct(F.abs(h["edge"] - F.col("x1")).alias("d"), h["edge"].alias("e"), h["column"].alias("column"))))
    return words.join(lists, [*document], "left").withColumn("column", near["column"]).drop("__headers")


#: A row prints its day and month, as 05/01 or 05ENE.
ROW_DATE = r"^(\d{1,2})(?:/(\d{1,2})|([A-ZÑ]{3}))$"
MONTHS = ("ENE", "FEB", "MAR", "ABR", "MAY", "JUN", "JUL", "AGO", "SET", "OCT", "NOV", "DIC")


def printed_day(text: Column) -> tuple[Column, Column]:
    """Day and month of a row's date, null if it is none."""
    day, number, name = (F.regexp_extract(text, ROW_DATE, i) for i in (1, 2, 3))
    by_name = F.array_position(F.array(*map(F.lit, MONTHS)), F.when(name == "SEP", "SET").otherwise(name))
    month = F.when(number != "", number.try_cast("int")).when(by_name > 0, by_name.cast("int"))
    return F.when(month.between(1, 12), day.try_cast("int")), F.when(month.between(1, 12), month)


def movement_rows(words: DataFrame, document: list[str], date: str, description: str, amounts: dict[str, tuple[str | None, int]]) -> DataFrame:
    """(document..., line, day, month, description, currency, amount, problem) of the lines that are movements.

    words: document..., line, x0, text, column. A line is a movement if the first word of its date column
    is a day and month and an amount column holds an amount; header and balance lines are not. What
    follows the date in its column belongs to the description. amounts gives an amount column's currency (None if
    the statement has one only) and the sign of its amounts; a trailing minus turns it. A line with
    amounts in several columns has a problem in place of an amount: the statement is to be refused."""
    line = words.groupBy(*document, "line").agg(F.sort_array(F.collect_list(F.struct("x0", "text", "column"))).alias("w"))
    texts = lambda c: F.transform(F.filter("w", lambda x: x["column"] == c), lambda x: x["text"])
    dates = texts(date)
    day, month = printed_day(F.coalesce(F.try_element_at(dates, F.lit(1)), F.lit("")))
    found = []
    for column, (currency, sign) in amounts.items():
        figure = F.try_element_at(F.filter(texts(column), lambda t: t.rlike(r"^[\d,]*\.?\d+-?$")), F.lit(1))
        found.append(F.struct(F.lit(currency).alias("currency"), (parse_money(figure) * sign).cast("decimal(18,2)").alias("amount")))
    there = F.filter(F.array(*found), lambda x: x["amount"].isNotNull())
    told = normalize_description(F.array_join(F.concat(F.slice(dates, F.lit(2), F.greatest(F.size(dates) - 1, F.lit(0))), texts(description)), " "))
    rows = line.withColumns({"day": day, "month": month, "found": there, "description": told}).where("day is not null and size(found) > 0")
    one = F.when(F.size("found") == 1, F.get("found", F.lit(0)))
    return rows.select(*document, "line", "day", "month", "description", one["currency"].alias("currency"), one["amount"].alias("amount"), F.when(F.size("found") > 1, "amounts in several columns").alias("problem"))


def detect_format(content):
    """By the first bytes: pdf, xlsx or unknown."""
    return F.when(F.substring(content, 1, 4) == F.lit(b"%PDF"), "pdf").when(F.substring(content, 1, 2) == F.lit(b"PK"), "xlsx").otherwise("unknown")


def dispatch(files: DataFrame, parsers: list[tuple[str, str | None]]) -> DataFrame:
    """files (content, hint, opens: the parsers whose password opens the file) with parser: the first in
    the order of parsers (name, marker) whose marker the text contains; else the hinted one, if it is a
    parser; else the first of those without a marker whose password opens the file; else null, and the file is refused."""
    content, names = F.col("text"), [n for n, _ in parsers]
    seen = [F.when(F.contains(content, F.lit(m)), n) for n, m in parsers if m is not None]
    opened = [F.when(F.array_contains("opens", n), n) for n, m in parsers if m is None]
    return files.withColumn("parser", F.coalesce(*seen, F.when(F.col("hint").isin(names), F.col("hint")), *opened, F.lit(None).cast("string")))


def column_lineage(edges: DataFrame, roots: DataFrame, max_depth: int = 20) -> DataFrame:
    """All paths (path array, leaf) from roots (node) along edges (upstream, downstream); a node
    is visited once per path, so cycles end."""
    level = roots.select(F.array("node").alias("path"), F.col("node").alias("leaf"))
    every = level
    for _ in range(max_depth):
        level = level.join(edges, F.col("leaf") == F.col("upstream")).where(~F.array_contains("path", F.col("downstream"))).select(F.concat("path", F.array("downstream")).alias("path"), F.col("downstream").alias("leaf"))
        if level.isEmpty():
            break
        every = every.unionByName(level)
    return every
