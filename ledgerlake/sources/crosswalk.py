"""Ledger tables derived from the driver's tables, in Spark and, word for word, in SQL.

Amounts are integer cents, so sums agree in any order. Dates are real dates; as-of days are
parameters, never the clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AS_OF_EVENTS = "2024-02-01"
AS_OF_ORDERS = "2001-08-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c) -> F.col:
    return F.round(c * 100).cast("long")


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bank movements of 20 households with 150 accounts."""
    u = F.col("user_id")
    sign = F.when(F.col("event_type").isin("purchase", "error", "view"), -1).otherwise(1)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("u"), (u % 20).cast("string")).alias("user_id"),
        F.when(u % 2 == 0, "bank_a").otherwise("bank_b").alias("bank"),
        F.concat(F.lit("acc"), u.cast("string")).alias("account_id"),
        F.to_date("ts").alias("date"),
        F.upper("event_type").alias("description"),
        (sign * _cents(F.col("value"))).alias("cents"),
        F.when(F.floor(u / 20) % 4 == 0, "USD").otherwise("PEN").alias("currency"),
        F.when(u % 3 == 0, "liability").otherwise("asset").alias("account_kind"),
        F.concat(F.lit("file"), (u % 20).cast("string"), F.lit("-"), (F.col("event_id") % 7).cast("string")).alias("source_file"),
    )


MOVEMENTS = """
movements as (
    select event_id, 'u' || cast(user_id % 20 as varchar) as user_id,
        case when user_id % 2 = 0 then 'bank_a' else 'bank_b' end as bank,
        'acc' || cast(user_id as varchar) as account_id,
        cast(ts as date) as date, upper(event_type) as description,
        case when event_type in ('purchase', 'error', 'view') then -1 else 1 end * cast(round(value * 100) as bigint) as cents,
        case when (user_id // 20) % 4 = 0 then 'USD' else 'PEN' end as currency,
        case when user_id % 3 = 0 then 'liability' else 'asset' end as account_kind,
        'file' || cast(user_id % 20 as varchar) || '-' || cast(event_id % 7 as varchar) as source_file
    from events
)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as movements: 25 users by nation, an account per customer."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    joined = o.join(c, o.o_custkey == c.c_custkey)
    return joined.select(
        F.col("o_orderkey").alias("order_id"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("user_id"),
        F.col("o_custkey").alias("account_id"),
        F.when(F.col("o_custkey") % 3 == 0, "liability").otherwise("asset").alias("account_kind"),
        F.to_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderstatus") == "F", -_cents(F.col("o_totalprice"))).otherwise(_cents(F.col("o_totalprice"))).alias("cents"),
        F.concat(F.col("c_mktsegment"), F.lit(" "), F.col("o_orderpriority")).alias("description"),
        F.col("c_mktsegment").alias("category"),
        F.when(F.col("c_nationkey") % 5 == 0, "USD").otherwise("PEN").alias("currency"),
        (F.col("o_orderkey") % 11 == 0).alias("is_internal_transfer"),
    )


LEDGER = """
ledger as (
    select o_orderkey as order_id, 'n' || cast(c_nationkey as varchar) as user_id, o_custkey as account_id,
        case when o_custkey % 3 = 0 then 'liability' else 'asset' end as account_kind,
        cast(o_orderdate as date) as date,
        case when o_orderstatus = 'F' then -1 else 1 end * cast(round(o_totalprice * 100) as bigint) as cents,
        c_mktsegment || ' ' || o_orderpriority as description, c_mktsegment as category,
        case when c_nationkey % 5 = 0 then 'USD' else 'PEN' end as currency,
        o_orderkey % 11 = 0 as is_internal_transfer
    from orders join customer on o_custkey = c_custkey
)"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement per account and active month, with chained balances in cents. Orders whose
    key is a multiple of 97 count in the movements but not in the balances: a planted break."""
    led = ledger(spark, sf_dir)
    kept = F.when(F.col("order_id") % 97 != 0, F.col("cents")).otherwise(0)
    monthly = led.groupBy("user_id", "account_id", "account_kind", "currency", F.trunc("date", "MM").alias("month_start")).agg(
        F.sum(kept).alias("moved"), F.sum("cents").alias("declared"), F.max("date").alias("period_end"), F.min("date").alias("period_start")
    )
    run = Window.partitionBy("account_id").orderBy("month_start").rowsBetween(Window.unboundedPreceding, 0)
    return monthly.withColumn("closing", F.sum("moved").over(run)).withColumn("opening", F.col("closing") - F.col("moved"))


STATEMENTS = (
    LEDGER
    + """,
monthly_moves as (
    select user_id, account_id, account_kind, currency, cast(date_trunc('month', date) as date) as month_start,
        cast(sum(case when order_id % 97 <> 0 then cents else 0 end) as bigint) as moved, cast(sum(cents) as bigint) as declared,
        max(date) as period_end, min(date) as period_start
    from ledger group by 1, 2, 3, 4, 5
),
statements as (
    select *, cast(sum(moved) over w as bigint) as closing, cast(sum(moved) over w as bigint) - moved as opening
    from monthly_moves window w as (partition by account_id order by month_start rows between unbounded preceding and current row)
)"""
)


def monthly_spend(spark: SparkSession, sf_dir: str, as_of: str = AS_OF_ORDERS) -> DataFrame:
    """(user_id, category, month, cents): closed months of spending by region and segment/priority."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    closed = joined.where(F.to_date("o_orderdate") < F.trunc(F.lit(as_of).cast("date"), "MM"))
    return closed.groupBy(
        F.col("n_regionkey").cast("long").alias("user_id"),
        F.concat("c_mktsegment", F.lit("/"), "o_orderpriority").alias("category"),
        F.trunc(F.to_date("o_orderdate"), "MM").alias("month"),
    ).agg(F.sum(_cents(F.col("o_totalprice"))).alias("cents"))


MONTHLY_SPEND = f"""
monthly_spend as (
    select cast(n_regionkey as bigint) as user_id, c_mktsegment || '/' || o_orderpriority as category,
        cast(date_trunc('month', o_orderdate) as date) as month, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    where cast(o_orderdate as date) < date '{AS_OF_ORDERS}'
    group by 1, 2, 3
)"""


def investment_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as entries of a fund per supplier, with a running balance in cents."""
    rows = table(spark, sf_dir, "lineitem")
    c = _cents(F.col("l_extendedprice"))
    kind = F.when(F.col("l_returnflag") == "A", "aporte").when(F.col("l_returnflag") == "R", "retiro").otherwise("valorizacion")
    amount = F.when(F.col("l_returnflag") == "A", c).when(F.col("l_returnflag") == "R", F.floor(c / 4)).otherwise(0).cast("long")
    moved = F.when(F.col("l_returnflag") == "A", c).when(F.col("l_returnflag") == "R", -F.floor(c / 4)).otherwise(F.floor(c / 50)).cast("long")
    order = Window.partitionBy("l_suppkey").orderBy(F.to_date("l_shipdate"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    sheet = rows.withColumns({"kind": kind, "amount": amount, "moved": moved, "sheet_row": F.row_number().over(order).cast("long")})
    run = Window.partitionBy("l_suppkey").orderBy("sheet_row").rowsBetween(Window.unboundedPreceding, 0)
    return sheet.select(
        F.col("l_suppkey").alias("place"),
        F.to_date("l_shipdate").alias("entry_date"),
        F.trunc(F.to_date("l_shipdate"), "MM").alias("month_start"),
        "kind",
        "amount",
        "sheet_row",
        F.sum("moved").over(run).alias("balance"),
    )


ENTRIES = """
sheet as (
    select *, case l_returnflag when 'A' then 'aporte' when 'R' then 'retiro' else 'valorizacion' end as kind,
        cast(round(l_extendedprice * 100) as bigint) as c,
        row_number() over (partition by l_suppkey order by cast(l_shipdate as date), l_orderkey, l_linenumber, l_partkey, l_quantity,
            l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) as sheet_row
    from lineitem
),
entries as (
    select l_suppkey as place, cast(l_shipdate as date) as entry_date, cast(date_trunc('month', l_shipdate) as date) as month_start, kind,
        cast(case l_returnflag when 'A' then c when 'R' then c // 4 else 0 end as bigint) as amount, sheet_row,
        cast(sum(case l_returnflag when 'A' then c when 'R' then -(c // 4) else c // 50 end)
            over (partition by l_suppkey order by sheet_row rows between unbounded preceding and current row) as bigint) as balance
    from sheet
)"""
