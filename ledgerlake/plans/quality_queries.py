"""Queries of data-quality checks, set operations and table differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import movements as M
from ledgerlake.operators import quality as Q
from ledgerlake.plans.movement_queries import _PAIRS
from ledgerlake.plans.registry import query
from ledgerlake.sources import crosswalk as X


@query("""select 'o_orderkey' as "column", count(*) filter (where o_orderkey is null) as violations from orders union all select 'o_custkey', count(*) filter (where o_custkey is null) from orders
union all select 'o_orderdate', count(*) filter (where o_orderdate is null) from orders""")
def dq_not_null(spark, sf_dir):
    return Q.null_counts(X.table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderdate"])


@query("select o_orderpriority, count(*) as violations from orders where o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM') group by 1")
def dq_accepted_values(spark, sf_dir):
    return Q.not_accepted(X.table(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("select l_orderkey, l_linenumber, count(*) as copies from lineitem group by 1, 2 having count(*) > 1")
def dq_unique_combination(spark, sf_dir):
    return Q.repeated(X.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select o_orderkey, o_custkey from orders o where o_custkey is not null and not exists (select 1 from customer where c_custkey = o_custkey and c_nationkey <> 3)")
def dq_relationships(spark, sf_dir):
    parent = X.table(spark, sf_dir, "customer").where("c_nationkey <> 3")
    return Q.orphans(X.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", parent, "c_custkey").select("o_orderkey", "o_custkey")


@query(_PAIRS + " select count(*) as violations from (select id from (select id from matched where id < partner union all select partner from matched where id < partner) group by id having count(*) > 1)")
def dq_transfers_one_to_one(spark, sf_dir):
    pairs = M.transfer_pairs(M.transfer_matches(X.movements(spark, sf_dir).withColumnRenamed("event_id", "id")))
    return Q.not_one_to_one(pairs, "first_id", "second_id").agg(F.count("*").alias("violations"))


@query("with" + X.LEDGER + " select (select count(*) from ledger) as silver_rows, (select count(*) from orders) as fact_rows")
def dq_row_counts(spark, sf_dir):
    a = X.ledger(spark, sf_dir).agg(F.count("*").alias("silver_rows"))
    return a.crossJoin(X.table(spark, sf_dir, "orders").agg(F.count("*").alias("fact_rows")))


@query(
    """with daily as (select cast(ts as date) as day, count(*) as n from events where event_id % 3 <> 0 or cast(ts as date) <> date '2024-01-20' group by 1),
every as (select cast(d as date) as day, coalesce(n, 0) as n from (select unnest(generate_series(cast((select min(day) from daily) as timestamp), timestamp '2024-01-30', interval 1 day)) as d) left join daily on day = cast(d as date)),
judged as (select *, count(*) over w as days, avg(n) over w as mean, stddev_samp(n) over w as sd from every window w as (order by day rows between 14 preceding and 1 preceding))
select day, n, round(mean, 6) as mean, coalesce(abs((n - mean) / nullif(sd, 0)) > 3, n <> mean) as is_anomaly from judged where days >= 5 and day < date '2024-01-31'"""
)
def volume_anomaly(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").where((F.col("event_id") % 3 != 0) | (F.to_date("ts") != F.lit("2024-01-20").cast("date")))
    v = Q.volume_anomalies(e, F.to_date("ts"), "2024-01-31")
    return v.select("day", "n", F.round("mean", 6).alias("mean"), "is_anomaly")


_SIDES = "a as (select o_custkey, o_orderpriority from orders where o_orderkey % 2 = 0), b as (select o_custkey, o_orderpriority from orders where o_orderkey % 3 = 0)"


@query(f"with {_SIDES} select *, 'left' as side from (select * from a except select * from b) union all select *, 'right' from (select * from b except select * from a)")
def table_diff_except(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    columns = ["o_custkey", "o_orderpriority"]
    return Q.table_difference(o.where("o_orderkey % 2 = 0").select(*columns), o.where("o_orderkey % 3 = 0").select(*columns))


@query("""with c as (select c_mktsegment, cast(round(c_acctbal * 100) as bigint) as amount from customer),
t as (select c_mktsegment, median(cast(amount as double)) as mid from c group by 1 having count(*) >= 5), o as (select c.c_mktsegment, amount, abs(amount - mid) as off from c join t using (c_mktsegment)),
m as (select c_mktsegment, median(off) as mad from o group by 1) select c_mktsegment, amount, round(off / (1.4826 * mad), 6) as score from o join m using (c_mktsegment) where mad > 0 and off / (1.4826 * mad) > 1.3""")
def anomalous_charges(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer").select("c_mktsegment", F.round(F.col("c_acctbal") * 100).cast("long").alias("amount"))
    return Q.anomalous_charges(c, ["c_mktsegment"], 1.3).select("c_mktsegment", "amount", F.round("score", 6).alias("score"))


@query("""select n_name, r_name from nation join region on n_regionkey = r_regionkey where n_name not in (select n_name from nation where n_regionkey in (1, 2))""")
def not_in_subquery(spark, sf_dir):
    n, r = X.table(spark, sf_dir, "nation"), X.table(spark, sf_dir, "region")
    some = n.where(F.col("n_regionkey").isin(1, 2)).select("n_name")
    return n.join(some, "n_name", "left_anti").join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_name", "r_name")


@query("""with a as (select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders), b as (select o_orderkey, case when o_orderkey % 50 = 0 then o_custkey + 1 else o_custkey end as o_custkey, o_orderpriority from orders where o_orderkey % 9 <> 0)
select 'customer' as name, (select count(*) from customer) as left_rows, cast(null as bigint) as right_rows, '' as added, '' as removed, '' as retyped, cast(null as bigint) as only_left, cast(null as bigint) as only_right
union all select 'orders', (select count(*) from a), (select count(*) from b), 'o_new', 'o_orderstatus', 'o_orderpriority: string -> int',
    (select count(*) from (select o_orderkey, o_custkey from a except select o_orderkey, o_custkey from b)), (select count(*) from (select o_orderkey, o_custkey from b except select o_orderkey, o_custkey from a))""")
def store_diff(spark, sf_dir):
    """Two stores: a table that one lacks, and one with columns added, removed and retyped and with other rows."""
    o, k = X.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    a = o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    b = o.where(k % 9 != 0).select("o_orderkey", F.when(k % 50 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"), F.lit(1).alias("o_new"), F.lit(1).alias("o_orderpriority"))
    out = Q.store_difference({"orders": a.drop("o_orderpriority"), "customer": X.table(spark, sf_dir, "customer")}, {"orders": b.drop("o_orderpriority")})
    retyped = dict((c, f"{c}: {was} -> {now}") for c, was, now in Q.schema_difference(a, b) if was and now)
    return out.withColumn("retyped", F.when(F.col("name") == "orders", retyped["o_orderpriority"]).otherwise(""))


@query("with" + X.LEDGER + """, c as (select order_id, account_id, category, date, -cents as amount from ledger where cents < 0)
select order_id, (select max(o.date) from c o where o.account_id = c.account_id and o.amount // 100000 = c.amount // 100000 and (o.date, o.order_id) < (c.date, c.order_id)) as previous_date from c
where date_diff('day', (select max(o.date) from c o where o.account_id = c.account_id and o.amount // 100000 = c.amount // 100000 and (o.date, o.order_id) < (c.date, c.order_id)), date) <= 400""")
def duplicate_charges(spark, sf_dir):
    """Charges of an account that repeat an amount, here in thousands, within the days."""
    c = X.ledger(spark, sf_dir).where("cents < 0").select(F.col("order_id").alias("id"), "account_id", "date", F.floor(-F.col("cents") / 100000).alias("amount"))
    return Q.duplicate_charges(c, ["account_id"], 400).select(F.col("id").alias("order_id"), "previous_date")


@query("with" + X.LEDGER + """, c as (select order_id, user_id, description, date, row_number() over (partition by user_id order by date, order_id) - 1 as charges_before from ledger where cents < 0)
select order_id, charges_before from c where charges_before >= 5 and not exists (select 1 from c o where o.user_id = c.user_id and o.description = c.description and o.charges_before < c.charges_before)""")
def first_merchant_charges(spark, sf_dir):
    c = X.ledger(spark, sf_dir).where("cents < 0").withColumnRenamed("order_id", "id")
    return Q.first_merchant_charges(c, ["user_id"], "description", 5).select(F.col("id").alias("order_id"), "charges_before")


@query("with" + X.MOVEMENTS + """, b as (select source_file, date, description, cents from movements), a as (select source_file, date, description, cents + case when event_id % 97 = 5 then 1 else 0 end as cents from movements where event_id % 301 <> 7),
x as (select source_file, count(*) as n from (select * from b except all select * from a) group by 1), y as (select source_file, count(*) as n from (select * from a except all select * from b) group by 1)
select f.source_file, coalesce(x.n, 0) as only_before, coalesce(y.n, 0) as only_after, coalesce(x.n, 0) = 0 and coalesce(y.n, 0) = 0 as same from (select distinct source_file from b) f left join x using (source_file) left join y using (source_file)""")
def backfill_verdict(spark, sf_dir):
    """Files parsed anew: the same rows in any order, or what differs."""
    m = X.movements(spark, sf_dir)
    columns = ["source_file", "date", "description", "cents"]
    after = m.where("event_id % 301 <> 7").withColumn("cents", F.col("cents") + F.when(F.col("event_id") % 97 == 5, 1).otherwise(0))
    return Q.backfill_verdict(m.select(*columns), after.select(*columns), ["source_file"])
