"""Queries whose result is the state of a lake table after its maintenance operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from ledgerlake.plans.registry import query
from ledgerlake.sources import crosswalk as X
from ledgerlake.sources import statements_text as W
from ledgerlake.sources.scratch import folder
from ledgerlake.sources.tables import Lake

_ROWS = StructType([StructField("user_id", StringType()), StructField("event_id", LongType()), StructField("source_file", StringType()), StructField("date", DateType()), StructField("cents", LongType())])
_RUNS = StructType([StructField("user_id", StringType()), StructField("event_id", LongType()), StructField("run_month", DateType()), StructField("cents", LongType())])
_FILES = StructType([StructField("user_id", StringType()), StructField("file_sha256", StringType()), StructField("ingested_at", DateType())])
_M = "with" + X.MOVEMENTS + ", m as (select user_id, event_id, source_file, date, cents from movements)"


def lake(spark) -> Lake:
    return Lake(spark, folder(spark, "lake"), {"rows": _ROWS, "other": _ROWS, "runs": _RUNS, "ingested_files": _FILES})


def rows(spark, sf_dir):
    return X.movements(spark, sf_dir).select(*_ROWS.names)


@query(_M + " select * from m where user_id = 'u7'")
def lake_append_and_prune(spark, sf_dir):
    """Two appends, then one user's partition with its columns."""
    t, m = lake(spark), rows(spark, sf_dir)
    t.append("rows", m.where("event_id % 2 = 0"))
    t.append("rows", m.where("event_id % 2 = 1"))
    return t.read("rows", "u7")


@query(_M + " select * from m where event_id % 5 <> 1 or user_id = 'u2'")
def lake_delete(spark, sf_dir):
    t = lake(spark)
    t.append("rows", rows(spark, sf_dir))
    t.delete("rows", (F.col("event_id") % 5 == 1) & (F.col("user_id") != "u2"))
    return t.read("rows")


@query(_M + """, new as (select user_id, event_id, source_file, date, cents + 1 as cents from m where event_id % 14 = 3)
select * from m where not exists (select 1 from new where new.user_id = m.user_id and new.source_file = m.source_file) union all select * from new""")
def lake_replace_by_file(spark, sf_dir):
    t, m = lake(spark), rows(spark, sf_dir)
    t.append("rows", m)
    t.replace_by_key("rows", m.where("event_id % 14 = 3").withColumn("cents", F.col("cents") + 1), ["source_file"])
    return t.read("rows")


@query(_M + " select * from m where user_id not in ('u1', 'u2', 'u3') union all select user_id, event_id, source_file, date, cents from m where user_id = 'u1' and event_id % 2 = 0")
def lake_replace_users(spark, sf_dir):
    """u1 is replaced; u2 and u3 have no new rows and are cleared, in both tables of the group."""
    t, m = lake(spark), rows(spark, sf_dir)
    t.append("rows", m)
    t.append("other", m.where("user_id = 'u3'"))
    t.replace_group({"rows": m.where("user_id = 'u1' and event_id % 2 = 0"), "other": m.limit(0)}, ["u1", "u2", "u3"])
    return t.read("rows").unionByName(t.read("other"))


@query(_M + """, new as (select user_id, event_id, source_file, date, cents + 7 as cents from m where event_id % 30 = 4)
select * from m where not exists (select 1 from new where new.user_id = m.user_id and date_trunc('month', new.date) = date_trunc('month', m.date) and new.date = m.date) union all select * from new""")
def lake_replace_by_day(spark, sf_dir):
    """By a key of dates: a user's rows of the days that come again are replaced, others stay."""
    t, m = lake(spark), rows(spark, sf_dir)
    t.append("rows", m)
    t.replace_by_key("rows", m.where("event_id % 30 = 4").withColumn("cents", F.col("cents") + 7), ["date"])
    return t.read("rows")


_RUN_M = "with" + X.MOVEMENTS + ", m as (select user_id, event_id, cast(date_trunc('month', date) as date) as run_month, cents from movements)"


def _runs(spark, sf_dir):
    return X.movements(spark, sf_dir).select("user_id", "event_id", F.trunc("date", "MM").alias("run_month"), "cents")


@query(_RUN_M + """, new as (select user_id, event_id, run_month, -cents as cents from m where event_id % 40 = 9)
select * from m where not exists (select 1 from new where new.user_id = m.user_id and new.run_month = m.run_month) union all select * from new""")
def lake_replace_by_run(spark, sf_dir):
    t, m = lake(spark), _runs(spark, sf_dir)
    t.append("runs", m)
    t.replace_by_key("runs", m.where("event_id % 40 = 9").withColumn("cents", -F.col("cents")), ["run_month"])
    return t.read("runs")


@query(_RUN_M + " select * from m where not (user_id = 'u3' and run_month = (select min(run_month) from m)) and user_id <> 'u5'")
def lake_delete_run(spark, sf_dir):
    """A user's run, then all runs of another user."""
    t, m = lake(spark), _runs(spark, sf_dir)
    t.append("runs", m)
    first = m.agg(F.min("run_month")).first()[0]
    t.delete("runs", (F.col("user_id") == "u3") & (F.col("run_month") == F.lit(first)))
    t.delete("runs", F.col("user_id") == "u5")
    return t.read("runs")


@query(_M + " select * from m where event_id % 3 = 1")
def lake_rebuild(spark, sf_dir):
    """The whole table anew: users who have no rows any more are gone."""
    t, m = lake(spark), rows(spark, sf_dir)
    t.append("rows", m)
    t.rebuild("rows", m.where("event_id % 3 = 1"))
    return t.read("rows")


@query(_M + " select user_id, source_file as file_sha256, min(date) as ingested_at from m group by 1, 2")
def lake_register_files(spark, sf_dir):
    """Files are registered once, whatever comes again."""
    t = lake(spark)
    first = rows(spark, sf_dir).groupBy("user_id", F.col("source_file").alias("file_sha256")).agg(F.min("date").alias("ingested_at"))
    t.register_files(first.where("file_sha256 like '%-1'"))
    t.register_files(first.withColumn("ingested_at", F.when(F.col("file_sha256").endswith("-1"), F.lit("1970-01-01").cast("date")).otherwise(F.col("ingested_at"))))
    return t.read("ingested_files")


@query("select cast(0 as bigint) as n_rows, cast(5 as bigint) as n_columns")
def lake_missing_table(spark, sf_dir):
    """A table that is not there is empty and typed."""
    empty = lake(spark).read("rows")
    return empty.agg(F.count("*").alias("n_rows"), F.lit(len(empty.columns)).cast("long").alias("n_columns"))


_HEADERS = (("date", 1.0), ("description", 12.0), ("amount", 34.0))


@query("""with h as (select * from (values ('date', 1.0), ('description', 12.0), ('amount', 34.0)) t(name, x)),
w as (select l_orderkey, l_linenumber, l_quantity - 6 as x0 from lineitem)
select l_orderkey, l_linenumber, x0, (select max_by(name, x) from h where x0 >= x - 5) as "column" from w""")
def statement_columns(spark, sf_dir):
    """Words to the last header that starts at most the slack to their right; words that are alike stay as many."""
    words = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 6).alias("x0"), F.lit("d").alias("document"))
    headers = spark.createDataFrame([("d", *h) for h in _HEADERS], "document string, column string, header_x double")
    return W.assign_columns(words, headers, ["document"]).drop("document")


@query()
def statement_lines(spark, sf_dir):
    """Each boundary depends on the line before; tests have the cases. A page is an order, so pages stay small as tables grow."""
    words = X.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_extendedprice") % 800).alias("top"), F.col("l_quantity").alias("x0"), F.col("l_linenumber").cast("string").alias("text"))
    return W.group_lines(words, ["page"]).groupBy("page").agg((F.max("line") + 1).alias("lines"), F.count("*").alias("n_words"))


@query("""with t as (select l_orderkey, l_linenumber, count(*) as copies, min(cast(l_shipdate as date)) as d, min(l_shipmode) as mode, min(l_quantity) as q, min(l_returnflag) as flag from (select *, l_returnflag as l_shipmode from lineitem) group by 1, 2)
select l_orderkey, l_linenumber as line, cast(day(d) as bigint) as day, cast(month(d) as bigint) as month, case when l_linenumber % 4 = 0 then 'POS ' else '' end || 'SHOP ' || mode as description,
    case when l_linenumber % 7 <> 5 then case when flag = 'R' then 'USD' else 'PEN' end end as currency,
    case when l_linenumber % 7 <> 5 then cast(case when l_linenumber % 3 = 0 then -1 else 1 end * q * 100 as bigint) end as cents, case when l_linenumber % 7 = 5 then 'amounts in several columns' end as problem
from t where l_linenumber % 6 <> 1 and copies = 1""")
def statement_movements(spark, sf_dir):
    """Words in columns to movements: dates with stray words, trailing minus, a currency a column, lines that are none."""
    t = X.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("line")).agg(F.count("*").alias("copies"), F.min(F.to_date("l_shipdate")).alias("d"), F.min("l_returnflag").alias("flag"), F.min("l_quantity").alias("q"))
    t = t.where("copies = 1")
    n = F.col("line")
    months = F.array(*map(F.lit, W.MONTHS))
    date = F.when(n % 6 == 1, "SALDO").when(n % 2 == 0, F.date_format("d", "dd/MM")).otherwise(F.concat(F.date_format("d", "dd"), F.element_at(months, F.month("d"))))
    figure = F.concat(F.format_string("%.2f", F.col("q")), F.when(n % 3 == 0, "-").otherwise(""))
    word = lambda x0, text, column: F.struct(F.lit(x0).alias("x0"), text.alias("text"), F.lit(column).alias("column"))
    both = n % 7 == 5
    cells = F.array(
        word(1.0, date, "date"), word(2.0, F.when(n % 4 == 0, "pos"), "date"), word(10.0, F.lit("shop..--"), "description"), word(11.0, F.col("flag"), "description"),
        word(20.0, F.when((F.col("flag") != "R") | both, figure), "soles"), word(30.0, F.when((F.col("flag") == "R") | both, figure), "dollars"),
    )
    words = t.select("l_orderkey", "line", F.explode(cells).alias("c")).select("l_orderkey", "line", "c.*").where("text is not null")
    rows = W.movement_rows(words, ["l_orderkey"], "date", "description", {"soles": ("PEN", 1), "dollars": ("USD", 1)})
    return rows.select("l_orderkey", "line", F.col("day").cast("long").alias("day"), F.col("month").cast("long").alias("month"), "description", "currency", (F.col("amount") * 100).cast("long").alias("cents"), "problem")


@query("select o_orderkey, cast(round(o_totalprice * 1000) as bigint) % 10 <> 0 as has_excess from (select o_orderkey, o_totalprice + case when o_orderkey % 4 = 0 then 0.003 else 0 end as o_totalprice from orders)")
def excess_decimals(spark, sf_dir):
    from ledgerlake.functions.scalars import excess_decimals as excess

    price = F.col("o_totalprice") + F.when(F.col("o_orderkey") % 4 == 0, 0.003).otherwise(0.0)
    return X.table(spark, sf_dir, "orders").select("o_orderkey", excess(price).alias("has_excess"))


@query(_M + """ select 'other' as name, (select count(*) from m where user_id = 'u1') as left_rows, cast(null as bigint) as right_rows, cast(null as bigint) as only_left, cast(null as bigint) as only_right
union all select 'rows', (select count(*) from m), (select count(*) from m where event_id % 4 <> 0), (select count(*) from (select * from m except select * from m where event_id % 4 <> 0)), (select count(*) from (select * from m where event_id % 4 <> 0 except select * from m))""")
def two_stores(spark, sf_dir):
    """Two lakes read side by side, table by table."""
    from ledgerlake.operators.quality import store_difference

    left, right, m = lake(spark), lake(spark), rows(spark, sf_dir)
    left.append("rows", m)
    left.append("other", m.where("user_id = 'u1'"))
    right.append("rows", m.where("event_id % 4 <> 0"))
    return store_difference(left.tables(), right.tables()).select("name", "left_rows", "right_rows", "only_left", "only_right")
