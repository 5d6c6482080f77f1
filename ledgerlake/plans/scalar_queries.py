"""Queries over column functions, projections, filters and the calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlake.functions import scalars as S
from ledgerlake.operators.calendar import date_dimension
from ledgerlake.operators.movements import flow_type, signed_amount
from ledgerlake.plans.registry import query
from ledgerlake.sources import crosswalk as X


@query(
    "with"
    + X.LEDGER
    + f"""
select cast(date_trunc('month', date) as date) as month, account_kind,
    case when account_kind = 'asset' and cents > 0 then 'ingreso' when account_kind = 'asset' and cents < 0 then 'egreso'
        when account_kind = 'liability' and cents > 0 then 'egreso' when account_kind = 'liability' and cents < 0 then 'pago' end as flow_type,
    count(*) as n_movements, cast(sum(case when account_kind = 'liability' then -cents else cents end) as bigint) as signed_cents
from ledger where date < date '{X.AS_OF_ORDERS}' group by 1, 2, 3"""
)
def cash_flow_by_month(spark, sf_dir):
    led = X.ledger(spark, sf_dir).where(S.closed_month(F.col("date"), X.AS_OF_ORDERS))
    kind, cents = F.col("account_kind"), F.col("cents")
    return led.groupBy(S.month_start(F.col("date")).alias("month"), "account_kind", flow_type(kind, cents).alias("flow_type")).agg(
        F.count("*").alias("n_movements"), F.sum(signed_amount(kind, cents)).alias("signed_cents")
    )


@query(
    "with"
    + X.LEDGER
    + """
select order_id, case when account_kind = 'asset' and cents > 0 then 'ingreso' when account_kind = 'asset' and cents < 0 then 'egreso'
    when account_kind = 'liability' and cents > 0 then 'egreso' when account_kind = 'liability' and cents < 0 then 'pago' end as flow_type from ledger"""
)
def flow_type_case(spark, sf_dir):
    return X.ledger(spark, sf_dir).select("order_id", flow_type(F.col("account_kind"), F.col("cents")).alias("flow_type"))


@query("with" + X.LEDGER + " select order_id, case when account_kind = 'liability' then -cents else cents end as signed_cents from ledger")
def signed_amounts(spark, sf_dir):
    return X.ledger(spark, sf_dir).select("order_id", signed_amount(F.col("account_kind"), F.col("cents")).alias("signed_cents"))


_NOISY = "p_name || '..--' || p_type || '  *#' || cast(p_partkey as varchar)"


@query(f"""select p_partkey, upper(trim(regexp_replace(regexp_replace({_NOISY}, '[.\\-_*#]{{2,}}', ' ', 'g'), '\\s+', ' ', 'g'))) as description from part""")
def normalize_description(spark, sf_dir):
    noisy = F.concat("p_name", F.lit("..--"), "p_type", F.lit("  *#"), F.col("p_partkey").cast("string"))
    return X.table(spark, sf_dir, "part").select("p_partkey", S.normalize_description(noisy).alias("description"))


@query(
    "with"
    + X.MOVEMENTS
    + """, numbered as (
    select *, row_number() over (partition by user_id, account_id, date, cents, currency, description, source_file order by event_id) as k from movements)
select event_id, md5(concat_ws('|', user_id, account_id, date, cents, currency, description, source_file, k)) as movement_id from numbered"""
)
def movement_id_md5(spark, sf_dir):
    from pyspark.sql import Window

    keys = ["user_id", "account_id", "date", "cents", "currency", "description", "source_file"]
    m = X.movements(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("event_id")))
    return m.select("event_id", S.movement_id(*(F.col(c) for c in [*keys, "k"])).alias("movement_id"))


@query("""select p_partkey, regexp_replace(p_name || ' ' || cast(p_partkey as varchar) || '/' || cast(p_partkey * 7 as varchar), '\\d+', '#', 'g') as merchant from part""")
def digit_collapse(spark, sf_dir):
    text = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit("/"), (F.col("p_partkey") * 7).cast("string"))
    return X.table(spark, sf_dir, "part").select("p_partkey", S.digit_collapse(text).alias("merchant"))


_RULES = "case " + " ".join(f"when regexp_matches(d, '{p}') then '{c}'" for p, c in S.CATEGORY_RULES) + f" else '{S.UNCATEGORIZED}' end"
_MERCHANTS = ("UBER TRIP", "CHIFA WOK", "PLAZA  VEA", "SKY AIRLINE", "PADEL CLUB", "NETFLIX", "CLINICA SUR", "UDEMY", "PLANILLA", "TRANSF. A TERCEROS", "HARDWARE", "METRO TAXI")


@query(f"""with t as (select p_partkey, (array{list(_MERCHANTS)})[cast(p_partkey % 12 + 1 as int)] || ' ' || upper(p_name) as d from part)
select p_partkey, {_RULES} as category from t""")
def rules_category(spark, sf_dir):
    merchant = F.element_at(F.array(*map(F.lit, _MERCHANTS)), (F.col("p_partkey") % 12 + 1).cast("int"))
    return X.table(spark, sf_dir, "part").select("p_partkey", S.rule_category(F.concat(merchant, F.lit(" "), F.upper("p_name"))).alias("category"))


@query(f"select o_orderkey, cast(o_orderdate as date) as d from orders where cast(o_orderdate as date) < date_trunc('month', date '{X.AS_OF_ORDERS}')")
def closed_month_filter(spark, sf_dir):
    return X.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d")).where(S.closed_month(F.col("d"), X.AS_OF_ORDERS))


@query("""select o_orderkey from orders where cast(o_orderdate as date) >= date '2001-02-01' and cast(o_orderdate as date) < date '2001-08-01'""")
def rolling_month_window(spark, sf_dir):
    first = F.trunc(F.lit(X.AS_OF_ORDERS).cast("date"), "MM")
    d = F.to_date("o_orderdate")
    return X.table(spark, sf_dir, "orders").where((d >= F.add_months(first, -6)) & (d < first)).select("o_orderkey")


_MONEY = "case when o_orderkey % 3 = 0 then t || '-' when o_orderkey % 17 = 0 then 'n/a' else t end"


@query(f"""with t as (select o_orderkey, cast(o_orderkey % 9 + 1 as varchar) || ',' || lpad(cast(o_orderkey % 1000 as varchar), 3, '0') || '.' || lpad(cast(o_orderkey % 100 as varchar), 2, '0') as t from orders),
m as (select o_orderkey, {_MONEY} as money from t)
select o_orderkey, cast(round(case when money = 'n/a' then null when money like '%-' then -cast(replace(replace(money, ',', ''), '-', '') as decimal(18, 2)) else cast(replace(money, ',', '') as decimal(18, 2)) end * 100) as bigint) as cents from m""")
def parse_money(spark, sf_dir):
    k = F.col("o_orderkey")
    t = F.concat((k % 9 + 1).cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("."), F.lpad((k % 100).cast("string"), 2, "0"))
    money = F.when(k % 3 == 0, F.concat(t, F.lit("-"))).when(k % 17 == 0, "n/a").otherwise(t)
    return X.table(spark, sf_dir, "orders").select("o_orderkey", (S.parse_money(money) * 100).cast("long").alias("cents"))


@query("""select o_orderkey, cast(case when r > 500 or (r = 500 and q % 2 = 1) then q + 1 else q end as bigint) as cents
from (select o_orderkey, o_orderkey * 12345 // 1000 as q, o_orderkey * 12345 % 1000 as r from orders)""")
def quantize_half_even(spark, sf_dir):
    mils = (F.col("o_orderkey") * 12345).cast("decimal(20,0)") / F.lit(100000).cast("decimal(6,0)")
    return X.table(spark, sf_dir, "orders").select("o_orderkey", (S.quantize_money(mils) * 100).cast("long").alias("cents"))


@query("""select c_custkey, right(regexp_replace(c_name || '-99' || cast(c_custkey as varchar), '\\D', '', 'g'), 4) as account_last4,
    sha256(concat_ws('|', c_name, c_nationkey)) as identity from customer""")
def account_identity(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer")
    return c.select("c_custkey", S.last4(F.concat("c_name", F.lit("-99"), F.col("c_custkey").cast("string"))).alias("account_last4"), S.identity_key(F.col("c_name"), F.col("c_nationkey")).alias("identity"))


_KEY = b"test key"
_PADS = ["".join(f"\\x{x ^ pad:02X}" for x in _KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query(f"""select c_custkey, sha256('{_PADS[1]}'::blob || unhex(sha256('{_PADS[0]}'::blob || encode('bank_a') || '\\x00'::blob || encode(c_name)))) as account_id from customer""")
def account_hmac(spark, sf_dir):
    """Keyed identity, by the definition of HMAC."""
    return X.table(spark, sf_dir, "customer").select("c_custkey", S.account_id(_KEY, F.lit("bank_a"), F.col("c_name")).alias("account_id"))


_MONEDAS = ("CUENTA EN DÓLARES", "Soles", "S/ 10.00", "US$ 5", "saldo consolidado", "opening balance", "otra moneda", "usd pen", "Pen", "INSOLES", "SÓLES ahorro", "dólar")


@query(f"""with t as (select c_custkey, (array{list(_MONEDAS)})[cast(c_custkey % 12 + 1 as int)] as w from customer),
words as (select c_custkey, strip_accents(w) as plain, string_split_regex(upper(strip_accents(w)), '\\s+') as words from t)
select c_custkey, plain, case when len(list_filter(words, lambda x: starts_with(x, 'DOLAR') or starts_with(x, 'USD') or starts_with(x, 'US$'))) > 0 then 'USD'
    when len(list_filter(words, lambda x: starts_with(x, 'SOL') or starts_with(x, 'PEN') or starts_with(x, 'S/'))) > 0 then 'PEN' end as currency from words""")
def currency_words(spark, sf_dir):
    """By the beginnings of words: CONSOLIDADO and OPENING name no currency."""
    w = F.element_at(F.array(*map(F.lit, _MONEDAS)), (F.col("c_custkey") % 12 + 1).cast("int"))
    return X.table(spark, sf_dir, "customer").select("c_custkey", S.fold_accents(w).alias("plain"), S.currency_word(w).alias("currency"))


@query("""with t as (select o_orderkey, cast(o_orderdate as date) as a, cast(o_orderdate as date) + cast(20 + o_orderkey % 50 as integer) as b,
    cast(o_orderdate as date) + cast(case when o_orderkey % 13 = 0 then 150 else o_orderkey % (21 + o_orderkey % 50) end as integer) as real from orders),
days as (select o_orderkey, cast(unnest(generate_series(cast(a as timestamp), cast(b as timestamp), interval 1 day)) as date) as day, month(real) as m, day(real) as d from t),
inside as (select o_orderkey, min(day) as found from days where month(day) = m and day(day) = d group by 1)
select t.o_orderkey, inside.found as row_date, cast(case when month(real) >= month(a) then year(a) else year(b) end as bigint) as year_by_start
from t left join inside using (o_orderkey)""")
def statement_year_inference(spark, sf_dir):
    """Rows that print day and month, in periods of 20 to 69 days, many across new year; those of residue 13 lie outside."""
    k, a = F.col("o_orderkey"), F.to_date("o_orderdate")
    length = (20 + k % 50).cast("int")
    real = F.date_add(a, F.when(k % 13 == 0, 150).otherwise(k % (length + 1)).cast("int"))
    t = X.table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), F.date_add(a, length).alias("b"), F.day(real).alias("d"), F.month(real).alias("m"))
    # the day's place does not matter to the year, and a 29th of February may not be in the year found
    by_start = S.dated_by_start(F.least(F.col("d"), F.lit(28)), F.col("m"), F.col("a"), F.col("b"))
    return t.select("o_orderkey", S.dated_inside(F.col("d"), F.col("m"), F.col("a"), F.col("b")).alias("row_date"), F.year(by_start).cast("long").alias("year_by_start"))


@query("""with bounds as (select cast(date_trunc('month', min(o_orderdate)) as date) as a, cast(last_day(max(o_orderdate)) as date) as b from orders)
select cast(d as date) as date, cast(date_trunc('month', d) as date) as month_start, cast(year(d) as bigint) as year_number, cast(quarter(d) as bigint) as quarter_number,
    cast(month(d) as bigint) as month_number, strftime(d, '%B') as month_name, cast(day(d) as bigint) as day_number, strftime(d, '%A') as day_name,
    strftime(d, '%Y-%m') as month_label, dayofweek(d) in (0, 6) as is_weekend, cast(year(d) as varchar) || '-Q' || cast(quarter(d) as varchar) as year_quarter
from (select unnest(generate_series(cast(a as timestamp), cast(b as timestamp), interval 1 day)) as d from bounds)""")
def dim_date_calendar(spark, sf_dir):
    return date_dimension(X.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")))


@query("""select o_orderkey, cast(year(o_orderdate) * 12 + month(o_orderdate) - (year(date '1992-03-31') * 12 + 3) as bigint) as months_since,
    cast(day(last_day(o_orderdate)) as bigint) as days_in_month, cast(quarter(o_orderdate) as bigint) as quarter from orders""")
def month_parts(spark, sf_dir):
    d = F.to_date("o_orderdate")
    base = F.lit("1992-03-31").cast("date")
    return X.table(spark, sf_dir, "orders").select("o_orderkey", S.months_between_boundaries(base, d).alias("months_since"), F.day(F.last_day(d)).cast("long").alias("days_in_month"), F.quarter(d).cast("long").alias("quarter"))


@query("""select c_custkey, cast(length(c_name) as bigint) as n_chars, cast(length(regexp_replace(c_name, '\\D', '', 'g')) as bigint) as n_digits,
    round(length(regexp_replace(c_name, '\\D', '', 'g')) / cast(length(c_name) as double), 6) as digit_share, round(ln(1 + abs(c_acctbal)), 6) as log_amount from customer""")
def drift_features(spark, sf_dir):
    n, digits = F.length("c_name"), F.regexp_count("c_name", F.lit(r"\d"))
    return X.table(spark, sf_dir, "customer").select(
        "c_custkey", n.cast("long").alias("n_chars"), digits.cast("long").alias("n_digits"), F.round(digits / n, 6).alias("digit_share"), F.round(F.log1p(F.abs("c_acctbal")), 6).alias("log_amount")
    )


@query("""select p_partkey, split_part('3 · ' || p_type, ' · ', 2) as label, strftime(date '2024-03-05' + cast(p_partkey % 60 as integer), '%b %Y') as shown from part""")
def label_formatting(spark, sf_dir):
    shown = F.date_format(F.date_add(F.lit("2024-03-05").cast("date"), (F.col("p_partkey") % 60).cast("int")), "MMM yyyy")
    return X.table(spark, sf_dir, "part").select("p_partkey", F.split_part(F.concat(F.lit("3 · "), "p_type"), F.lit(" · "), F.lit(2)).alias("label"), shown.alias("shown"))
