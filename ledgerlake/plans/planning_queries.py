"""Queries of the plan, the dimensions, ingestion checks and the remaining charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.operators import balances as B
from ledgerlake.operators import ingest as I
from ledgerlake.operators import planning as N
from ledgerlake.plans.balance_queries import _BALANCES, _CAPITAL, _DIETZ
from ledgerlake.plans.registry import query
from ledgerlake.plans.report_queries import _FACT, fact
from ledgerlake.sources import crosswalk as X
from ledgerlake.sources import seeds
from ledgerlake.sources.statements_text import column_lineage as lineage

_PLANS = """with s as (select p_partkey as k, case when p_partkey % 2 = 0 then 'bank_a' else 'bank_b' end as bank, p_name || cast(p_partkey as varchar) as description, case when p_partkey % 3 = 0 then 'USD' else 'PEN' end as currency from part),
previous as (select bank, description, currency, case when k % 5 = 0 then 'ignore' else 'fixed' end as kind, case when k % 7 = 0 then k * 3 else k * 2 end as expected, case when k % 11 = 0 then '' else 'fixed' end as proposed_kind, k * 2 as typical, 'old' as note from s where k % 4 <> 0),
fresh as (select bank, description, currency, case when k % 6 = 0 then 'variable' else 'fixed' end as proposed_kind, k * 2 + 1 as typical, 'new' as note from s where k % 4 <> 1)"""


def _plans(spark, sf_dir):
    k = F.col("p_partkey")
    s = X.table(spark, sf_dir, "part").select(k.alias("k"), F.when(k % 2 == 0, "bank_a").otherwise("bank_b").alias("bank"), F.concat("p_name", k.cast("string")).alias("description"), F.when(k % 3 == 0, "USD").otherwise("PEN").alias("currency"))
    k = F.col("k")
    previous = s.where(k % 4 != 0).select(*N.KEY, F.when(k % 5 == 0, "ignore").otherwise("fixed").alias("kind"), F.when(k % 7 == 0, k * 3).otherwise(k * 2).alias("expected"), F.when(k % 11 == 0, "").otherwise("fixed").alias("proposed_kind"), (k * 2).alias("typical"), F.lit("old").alias("note"))
    fresh = s.where(k % 4 != 1).select(*N.KEY, F.when(k % 6 == 0, "variable").otherwise("fixed").alias("proposed_kind"), (k * 2 + 1).alias("typical"), F.lit("new").alias("note"))
    return previous, fresh


@query(
    _PLANS
    + """ select bank, description, currency, kind, expected, proposed_kind, typical, note from previous where proposed_kind = ''
union all select bank, description, currency, kind, expected, proposed_kind, typical, 'no longer detected' from previous p where proposed_kind <> '' and not exists (select 1 from fresh f where f.bank = p.bank and f.description = p.description and f.currency = p.currency)
union all select p.bank, p.description, p.currency, case when p.kind <> p.proposed_kind or p.expected <> p.typical then p.kind else f.proposed_kind end, case when p.kind <> p.proposed_kind or p.expected <> p.typical then p.expected else f.typical end,
    f.proposed_kind, f.typical, f.note from previous p join fresh f on f.bank = p.bank and f.description = p.description and f.currency = p.currency where p.proposed_kind <> ''
union all select bank, description, currency, proposed_kind, typical, proposed_kind, typical, note from fresh f where not exists (select 1 from previous p where f.bank = p.bank and f.description = p.description and f.currency = p.currency)"""
)
def plan_merge(spark, sf_dir):
    return N.merge_plan(*_plans(spark, sf_dir))


@query(
    """with items as (select p_partkey as "row", case when p_partkey % 9 = 0 then '' else 'b' end as bank, p_type as description, case when p_partkey % 8 = 0 then 'EUR' else 'PEN' end as currency,
    case when p_partkey % 10 = 0 then 'other' when p_partkey % 3 = 0 then 'variable' else 'fixed' end as kind, case when p_partkey % 4 = 0 then null else p_partkey - 50 end as expected from part),
f as (select *, min("row") over (partition by bank, description, currency) as first from items)
select "row", 'bank is empty' as problem from f where bank = '' union all select "row", 'currency must be PEN or USD' from f where currency not in ('PEN', 'USD')
union all select "row", 'kind must be fixed, variable or ignore' from f where kind not in ('fixed', 'variable', 'ignore')
union all select "row", 'expected must be a positive number' from f where (expected is not null or kind = 'fixed') and coalesce(expected, 0) <= 0
union all select "row", 'repeats an earlier row' from f where "row" <> first"""
)
def plan_problems(spark, sf_dir):
    k = F.col("p_partkey")
    items = X.table(spark, sf_dir, "part").select(
        k.alias("row"), F.when(k % 9 == 0, "").otherwise("b").alias("bank"), F.col("p_type").alias("description"), F.when(k % 8 == 0, "EUR").otherwise("PEN").alias("currency"),
        F.when(k % 10 == 0, "other").when(k % 3 == 0, "variable").otherwise("fixed").alias("kind"), F.when(k % 4 != 0, k - 50).alias("expected"),
    )
    return N.plan_problems(items)


@query(
    _BALANCES
    + """, sums as (select account_id, cast(date_trunc('month', date) as date) as month_start, sum(cents) as net, sum(case when cents < 0 then -cents else 0 end) as charges, sum(case when cents > 0 then cents else 0 end) as credits from ledger group by 1, 2),
declared as (select s.account_id, s.month_start, opening, closing, charges + case when s.account_id % 10 = 0 then 1 else 0 end as dc, case when s.account_id % 4 <> 0 then credits end as dr, net, charges, credits from statements s join sums m on m.account_id = s.account_id and m.month_start = s.month_start)
select account_id, month_start, 'closing balance' as "check", cast(closing as bigint) as declared, cast(opening + net as bigint) as actual from declared where closing <> opening + net
union all select account_id, month_start, 'charges total', cast(dc as bigint), cast(charges as bigint) from declared where dc <> charges union all select account_id, month_start, 'credits total', cast(dr as bigint), cast(credits as bigint) from declared where dr <> credits"""
)
def statement_totals(spark, sf_dir):
    led = X.ledger(spark, sf_dir).withColumn("month_start", F.trunc("date", "MM"))
    c = F.col("cents")
    sums = led.groupBy("account_id", "month_start").agg(F.sum(F.when(c < 0, -c).otherwise(0)).alias("charges"), F.sum(F.when(c > 0, c).otherwise(0)).alias("credits"))
    s = X.statements(spark, sf_dir).join(sums, ["account_id", "month_start"]).select(
        "account_id", "month_start", "opening", "closing", (F.col("charges") + F.when(F.col("account_id") % 10 == 0, 1).otherwise(0)).alias("declared_charges"), F.when(F.col("account_id") % 4 != 0, F.col("credits")).alias("declared_credits")
    )
    return I.reconcile(s, led, ["account_id", "month_start"])


@query("with" + X.MOVEMENTS + " select account_id, max(bank) as bank, max(account_kind) as account_kind from movements group by 1")
def dim_account(spark, sf_dir):
    return I.account_dimension(X.movements(spark, sf_dir))


@query("with" + X.MOVEMENTS + " select distinct bank from movements")
def dim_bank(spark, sf_dir):
    return X.movements(spark, sf_dir).select("bank").distinct()


@query("with" + X.MOVEMENTS + " select distinct user_id from movements")
def dim_user(spark, sf_dir):
    return X.movements(spark, sf_dir).select("user_id").distinct()


@query("select * from (values " + ", ".join("('{}', '{}')".format(c, d.replace("'", "''")) for c, d in seeds.CATEGORIES) + ") t(category, description)")
def dim_category(spark, sf_dir):
    return seeds.category_dimension(spark)


@query("with" + X.MOVEMENTS + """, labels as (select bank, description, 'l ' || description as category, description <> 'VIEW' as is_trusted from movements where event_id % 3 = 0 group by 1, 2)
select event_id, case when is_trusted then category end as trusted_category from movements left join labels using (bank, description)""")
def trusted_labels(spark, sf_dir):
    m = X.movements(spark, sf_dir)
    labels = m.where("event_id % 3 = 0").select("bank", "description").distinct().withColumns({"category": F.concat(F.lit("l "), "description"), "is_trusted": F.col("description") != "VIEW"})
    return I.trusted_labels(m, labels, ["bank", "description"]).select("event_id", "trusted_category")


@query()
def upload_rate_limit(spark, sf_dir):
    """A verdict that feeds back into the state; tests replay it by hand."""
    e = X.table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_timestamp("ts").cast("double").alias("at"), (F.col("event_id") % 5 + 1).alias("count"))
    return I.rate_limited(e, "user_id", limit=6, window_seconds=6 * 3600).select("event_id", "user_id", "allowed")


@query("""with recursive edges as (select 'r' || cast(r_regionkey as varchar) as upstream, 'n' || cast(n_nationkey as varchar) as downstream from nation join region on n_regionkey = r_regionkey
union all select 'n' || cast(s_nationkey as varchar), 's' || cast(s_suppkey as varchar) from supplier union all select 'n0', 'r0'),
paths(path, leaf, depth) as (select 'r' || cast(r_regionkey as varchar), 'r' || cast(r_regionkey as varchar), 0 from region
    union all select path || '>' || downstream, downstream, depth + 1 from paths join edges on leaf = upstream where position('>' || downstream || '>' in '>' || path || '>') = 0 and depth < 20)
select path, leaf from paths""")
def lineage_paths(spark, sf_dir):
    node = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    n, s = X.table(spark, sf_dir, "nation"), X.table(spark, sf_dir, "supplier")
    edges = n.select(node("r", "n_regionkey").alias("upstream"), node("n", "n_nationkey").alias("downstream")).unionByName(s.select(node("n", "s_nationkey").alias("upstream"), node("s", "s_suppkey").alias("downstream")))
    edges = edges.unionByName(spark.createDataFrame([("n0", "r0")], "upstream string, downstream string"))
    roots = X.table(spark, sf_dir, "region").select(node("r", "r_regionkey").alias("node"))
    return lineage(edges, roots).select(F.array_join("path", ">").alias("path"), "leaf")


@query("""with g as (select unnest(generate_series(0, 2)) as u, k from (select unnest(generate_series(1, 8)) as k)), m as (select 'demo' || cast(u as varchar) as user_id, k, cast(date '2024-05-01' - to_months(cast(k as integer)) as date) as month from g)
select user_id, month as date, 'checking' as account_id, 'asset' as account_kind, 'PEN' as currency, 'PLANILLA' as description, cast(500000 as bigint) as cents from m
union all select user_id, month + 1, 'checking', 'asset', 'PEN', 'ALQUILER', -150000 from m union all select user_id, month + 4, 'card', 'liability', 'PEN', 'SUPERMERCADO', 20000 + 1000 * k from m
union all select user_id, month + 19, 'card', 'liability', 'PEN', 'PAGO TARJETA', -(20000 + 1000 * k) from m union all select user_id, month + 19, 'checking', 'asset', 'PEN', 'PAGO TARJETA', -(20000 + 1000 * k) from m
union all select user_id, month + 14, 'dollars', 'asset', 'USD', 'HONORARIOS', 30000 + 500 * k from m""")
def demo_generator(spark, sf_dir):
    return seeds.demo_movements(spark, "2024-05-20", users=3)


@query(_FACT + """ select cast(date_trunc('month', date) as date) as month, case when signed_cents > 0 then 'in' else 'out' end as direction, cast(sum(signed_cents) as bigint) as cents from fact where not is_internal_transfer and currency = 'PEN' group by 1, 2""")
def chart_cash_flow_lines(spark, sf_dir):
    f = fact(spark, sf_dir).where("not is_internal_transfer and currency = 'PEN'")
    return f.groupBy(F.trunc("date", "MM").alias("month"), F.when(F.col("signed_cents") > 0, "in").otherwise("out").alias("direction")).agg(F.sum("signed_cents").alias("cents"))


@query(_BALANCES + """ select month_start, account_kind, currency, cast(sum(signed_closing) as bigint) as closing from balances group by 1, 2, 3""")
def chart_balance_lines(spark, sf_dir):
    return B.month_end_balances(X.statements(spark, sf_dir)).groupBy("month_start", "account_kind", "currency").agg(F.sum("signed_closing").alias("closing"))


@query(_CAPITAL + """ select currency, cast(max(month_start) as date) as month, cast(sum(net_position) filter (where month_recency = 1) as bigint) as net_now, cast(sum(net_position) filter (where month_recency = 1) - sum(net_position) filter (where month_recency = 2) as bigint) as change from capital group by 1""")
def chart_net_position(spark, sf_dir):
    from ledgerlake.plans.balance_queries import _holdings

    c = B.capital(_holdings(spark, sf_dir))
    at = lambda k: F.sum(F.when(F.col("month_recency") == k, F.col("net_position")))
    return c.groupBy("currency").agg(F.max("month_start").alias("month"), at(1).alias("net_now"), (at(1) - at(2)).alias("change"))


@query(_DIETZ + """select place, month_start, closing, gain, round(case when ok then gain / capital end, 6) as return_pct from reliable where month_start >= date '1998-01-01' order by month_start desc, place limit 200""")
def chart_investments(spark, sf_dir):
    r = B.fund_returns(X.investment_entries(spark, sf_dir), ["place"]).where("month_start >= date '1998-01-01'")
    return r.select("place", "month_start", "closing", "gain", F.round("return_pct", 6).alias("return_pct")).orderBy(F.desc("month_start"), "place").limit(200)


@query(_FACT + """ select category, description, count(*) as n, cast(sum(-signed_cents) as bigint) as cents from fact where flow_type = 'egreso' and not is_internal_transfer and order_id % 10 <> 0 group by 1, 2 order by cents desc, category, description limit 20""")
def chart_review_list(spark, sf_dir):
    f = fact(spark, sf_dir).where("flow_type = 'egreso' and not is_internal_transfer and order_id % 10 <> 0")
    return f.groupBy("category", "description").agg(F.count("*").alias("n"), F.sum(-F.col("signed_cents")).alias("cents")).orderBy(F.desc("cents"), "category", "description").limit(20)


@query("with" + X.MOVEMENTS + " select user_id, count(distinct source_file) as files, count(*) as n_rows, min(date) as first_day, max(date) as last_day from movements group by 1")
def chart_uploads(spark, sf_dir):
    return X.movements(spark, sf_dir).groupBy("user_id").agg(F.countDistinct("source_file").alias("files"), F.count("*").alias("n_rows"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
