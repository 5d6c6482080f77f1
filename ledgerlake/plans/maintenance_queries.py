"""Queries whose result is the final state of a maintained table, and classifiers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlake.operators import categorize as C
from ledgerlake.plans.registry import query
from ledgerlake.sources import crosswalk as X
from ledgerlake.sources import tables as T

_KEY = ["account_id", "date", "cents", "description", "occurrence_number"]

_BRONZE = (
    "with"
    + X.MOVEMENTS
    + """, bronze as (
    select account_id, date, cents, description, row_number() over (partition by account_id, date, cents, description, source_file order by event_id) as occurrence_number, source_file,
        case when event_id % 7 = 3 then 2 else 1 end as version from movements where event_id % 7 <> 5
), silver as (
    select account_id, date, cents, description, row_number() over (partition by account_id, date, cents, description, source_file order by event_id) as occurrence_number, source_file, 1 as version
    from movements where event_id % 7 in (0, 1, 3, 5)
)"""
)


def states(spark, sf_dir):
    """(silver, bronze): files of residue 5 are gone, those of 3 came again, those of 2, 4, 6 are new."""
    w = Window.partitionBy("account_id", "date", "cents", "description", "source_file").orderBy("event_id")
    m = X.movements(spark, sf_dir)
    number = lambda df: df.withColumn("occurrence_number", F.row_number().over(w).cast("long"))
    columns = [*_KEY, "source_file", "version"]
    r = F.col("event_id") % 7
    bronze = number(m.where(r != 5)).withColumn("version", F.when(r == 3, 2).otherwise(1)).select(*columns)
    silver = number(m.where(r.isin(0, 1, 3, 5))).withColumn("version", F.lit(1)).select(*columns)
    return silver, bronze


@query(
    _BRONZE
    + """, new as (select * from bronze b where not exists (select 1 from silver s where s.source_file = b.source_file and s.version = b.version)),
kept as (select * from silver where source_file not in (select source_file from new) and source_file in (select source_file from bronze)),
ranked as (select *, row_number() over (partition by account_id, date, cents, description, occurrence_number order by version desc, source_file) as r from (select * from kept union all select * from new))
select account_id, date, cents, description, cast(occurrence_number as bigint) as occurrence_number, source_file, cast(version as bigint) as version from ranked where r = 1"""
)
def incremental_merge(spark, sf_dir):
    out = T.merge_movements(*states(spark, sf_dir), _KEY, version="version")
    return out.withColumn("version", F.col("version").cast("long"))


@query(_BRONZE + """ select source_file, count(*) as n from silver s where not exists (select 1 from bronze b where b.source_file = s.source_file)
or exists (select 1 from bronze b where b.source_file = s.source_file and b.version not in (select version from silver t where t.source_file = b.source_file)) group by 1""")
def purge_reprocessed(spark, sf_dir):
    silver, bronze = states(spark, sf_dir)
    new = bronze.join(silver.select("source_file", "version").distinct(), ["source_file", "version"], "left_anti").select("source_file").distinct()
    gone = silver.join(new, "source_file", "left_semi").unionByName(silver.join(bronze, "source_file", "left_anti"))
    return gone.groupBy("source_file").agg(F.count("*").alias("n"))


@query(_BRONZE + " select distinct source_file from bronze where source_file not in (select source_file from silver)")
def registry_anti(spark, sf_dir):
    silver, bronze = states(spark, sf_dir)
    return T.new_files(silver.distinct(), bronze.select("source_file").distinct(), "source_file")


@query(
    """with files as (select o_orderkey as id, 'f' || cast(o_custkey % 40 as varchar) as name, 'sha' || cast(o_orderkey % 700 as varchar) as file_sha256, 'c' || cast(o_orderkey % 350 as varchar) as content_key, o_orderkey as arrived from orders),
ranked as (select *, row_number() over (partition by file_sha256 order by arrived) as same, row_number() over (partition by content_key order by arrived) as twin from files),
versions as (select *, sum(case when same = 1 and twin = 1 then 1 else 0 end) over (partition by name order by arrived rows between unbounded preceding and current row) as v from ranked)
select id, case when same > 1 then 'duplicate' when twin > 1 then 'same_content' when v > 1 then 'version' else 'new' end as verdict, cast(case when same = 1 and twin = 1 then v end as bigint) as version from versions"""
)
def file_versions(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    key = lambda prefix, c, n: F.concat(F.lit(prefix), (F.col(c) % n).cast("string"))
    files = o.select(F.col("o_orderkey").alias("id"), key("f", "o_custkey", 40).alias("name"), key("sha", "o_orderkey", 700).alias("file_sha256"), key("c", "o_orderkey", 350).alias("content_key"), F.col("o_orderkey").alias("arrived"))
    return T.file_versions(files).select("id", "verdict", F.col("version").cast("long").alias("version"))


@query()
def category_classifier(spark, sf_dir):
    """Character n-gram logistic regression over part names; a trained model is not in SQL."""
    p = X.table(spark, sf_dir, "part").select(F.concat("p_type", F.lit(" "), "p_name").alias("text"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("category"))
    train, test = p.where(F.pmod(F.xxhash64("text"), F.lit(4)) != 0), p.where(F.pmod(F.xxhash64("text"), F.lit(4)) == 0)
    model = C.train(train)
    return C.macro_f1(C.predict(model, test)).select(F.round("macro_f1", 4).alias("macro_f1"), "n")


@query("""with t as (select o_orderkey, case when o_totalprice > 100000 then 'a' else 'b' end as category, case when o_orderpriority < '3' then 'a' else 'b' end as prediction from orders),
c as (select unnest(['a', 'b']) as k), s as (select k, count(*) filter (where category = k and prediction = k) as tp, count(*) filter (where category <> k and prediction = k) as fp, count(*) filter (where category = k and prediction <> k) as fn from t, c group by k)
select round(avg(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0 end), 6) as macro_f1, (select count(*) from t) as n from s""")
def macro_f1(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders").select(F.when(F.col("o_totalprice") > 100000, "a").otherwise("b").alias("category"), F.when(F.col("o_orderpriority") < "3", "a").otherwise("b").alias("prediction"))
    return C.macro_f1(o).select(F.round("macro_f1", 6).alias("macro_f1"), "n")


_SCORED = """with scored as (select o_orderkey, case when o_totalprice > 200000 then 'a' when o_totalprice > 100000 then 'b' else 'c' end as category,
    case when o_orderkey % 7 < 4 then case when o_totalprice > 200000 then 'a' when o_totalprice > 100000 then 'b' else 'c' end else 'a' end as prediction,
    (case when o_orderkey % 7 < 4 then 40 else 0 end + o_orderkey % 61) / 100.0 as confidence, case when o_custkey % 3 = 0 then 'a' when o_custkey % 3 = 1 then 'b' else 'c' end as rule from orders)"""


@query(_SCORED + """, t as (select distinct confidence as threshold from scored union all select max(confidence) + 1e-9 from scored),
guessed as (select threshold, category, case when confidence >= threshold then prediction else rule end as guess from scored, t),
k as (select distinct category as c from scored),
f as (select threshold, c, 2.0 * count(*) filter (where category = c and guess = c) / (count(*) filter (where guess = c) + count(*) filter (where category = c)) as f1 from guessed, k group by 1, 2)
select round(threshold, 6) as threshold, round(avg(f1), 6) as macro_f1 from f group by threshold""")
def confidence_thresholds(spark, sf_dir):
    """Macro-F1 of the model's guess above and the rules' below each observed confidence."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    category = F.when(price > 200000, "a").when(price > 100000, "b").otherwise("c")
    r = F.col("o_custkey") % 3
    scored = X.table(spark, sf_dir, "orders").select(category.alias("category"), F.when(k % 7 < 4, category).otherwise("a").alias("prediction"), ((F.when(k % 7 < 4, 40).otherwise(0) + k % 61) / 100.0).alias("confidence"), F.when(r == 0, "a").when(r == 1, "b").otherwise("c").alias("rule"))
    return C.threshold_scores(scored).select(F.round("threshold", 6).alias("threshold"), F.round("macro_f1", 6).alias("macro_f1"))


@query("""select cast(cast('0x' || substr(md5(regexp_replace(p_type || ' ' || cast(p_partkey as varchar), '\\d+', '#', 'g')), 1, 8) as bigint) % 5 as bigint) as fold, count(*) as n, count(distinct p_type) as merchants from part group by 1""")
def merchant_fold_sizes(spark, sf_dir):
    """Folds by merchant: descriptions that differ in digits only stay together."""
    p = X.table(spark, sf_dir, "part").select(F.concat("p_type", F.lit(" "), F.col("p_partkey").cast("string")).alias("text"), "p_type")
    return C.merchant_folds(p, 5).groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("merchants"))


@query()
def category_cross_validation(spark, sf_dir):
    """Out-of-fold scores of the model and the rules, grouped by merchant, and the threshold they choose; a trained model is not in SQL."""
    p = X.table(spark, sf_dir, "part").select(F.concat("p_type", F.lit(" "), F.col("p_partkey").cast("string")).alias("text"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("category"))
    scored = C.cross_validated(p).cache()
    best = C.best_threshold(scored)
    rules = C.macro_f1(scored.drop("prediction").withColumnRenamed("rule", "prediction")).select(F.lit("rules").alias("guesser"), "macro_f1", "n")
    return C.macro_f1(scored).select(F.lit("model").alias("guesser"), "macro_f1", "n").unionByName(rules).withColumn("threshold", F.lit(best))
