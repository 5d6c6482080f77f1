"""Category classifier: TF-IDF over characters of words, balanced logistic regression, fallback to rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.scalars import digit_collapse, rule_category
from ledgerlake.operators.movements import unlabelled

MIN_EXAMPLES, MIN_PER_CLASS, MAX_FOLDS = 10, 2, 5
NGRAMS = (2, 4)


class TooFewExamples(ValueError):
    """There are not enough labelled examples for a model."""


@dataclass(frozen=True)
class Model:
    pipeline: PipelineModel
    threshold: float = 0.0


def char_ngrams(text: Column, shortest: int = NGRAMS[0], longest: int = NGRAMS[1]) -> Column:
    """Character n-grams inside words, each word led and followed by a space."""

    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        runs = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i, n=n: F.substring(padded, i, F.lit(n))) for n in range(shortest, longest + 1)]
        return F.concat(*runs)

    return F.flatten(F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), of))


def train(examples: DataFrame, features: int = 1 << 14) -> Model:
    """examples: text, category. Classes with fewer than MIN_PER_CLASS examples are left out; fewer
    than MIN_EXAMPLES examples in all are refused."""
    sizes = examples.groupBy("category").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PER_CLASS)
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if total[0] < MIN_EXAMPLES:
        raise TooFewExamples(f"{total[0]} examples, {MIN_EXAMPLES} are needed")
    weighted = examples.join(F.broadcast(sizes), "category").withColumn("weight", F.lit(float(total[0])) / (F.lit(float(total[1])) * F.col("n"))).withColumn("grams", char_ngrams(F.col("text")))
    index = StringIndexer(inputCol="category", outputCol="label", stringOrderType="alphabetAsc").fit(weighted)
    stages = [HashingTF(inputCol="grams", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="features"), LogisticRegression(weightCol="weight", regParam=0.01, maxIter=40)]
    fitted = Pipeline(stages=stages).fit(index.transform(weighted))
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)
    return Model(PipelineModel([*fitted.stages, names]))


def predict(model: Model, rows: DataFrame) -> DataFrame:
    """rows with prediction: the model's class where its probability reaches the threshold, else the rules'."""
    scored = model.pipeline.transform(rows.withColumn("grams", char_ngrams(F.col("text"))))
    sure = F.array_max(vector_to_array("probability")) >= model.threshold
    return scored.select(*rows.columns, F.when(sure, F.col("predicted")).otherwise(rule_category(F.upper("text"))).alias("prediction"), F.array_max(vector_to_array("probability")).alias("confidence"))


def merchant_folds(rows: DataFrame, folds: int) -> DataFrame:
    """fold: rows of one merchant, digits collapsed, share a fold."""
    digest = F.conv(F.substring(F.md5(digit_collapse(F.col("text"))), 1, 8), 16, 10).cast("long")
    return rows.withColumn("fold", (digest % folds).cast("int"))


def fold_count(rows: DataFrame) -> int:
    """Folds for (text, category): as many as the smallest class has rows and as there are merchants, 2 to MAX_FOLDS."""
    least, total = rows.groupBy("category").agg(F.count("*").alias("n")).agg(F.min("n"), F.sum("n")).first()
    merchants = rows.select(digit_collapse(F.col("text"))).distinct().count()
    if (total or 0) < MIN_EXAMPLES or merchants < 2:
        raise TooFewExamples(f"{total or 0} examples of {merchants} merchants")
    return max(2, min(MAX_FOLDS, least, merchants))


def cross_validated(rows: DataFrame, folds: int | None = None) -> DataFrame:
    """Out-of-fold guesses of all rows (text, category): the model's prediction with its confidence, and the rules' (rule)."""
    dealt, out = merchant_folds(rows.select("text", "category"), folds or fold_count(rows)), None
    for k in range(folds or fold_count(rows)):
        held = dealt.where(F.col("fold") == k)
        if held.isEmpty():
            continue
        part = predict(train(dealt.where(F.col("fold") != k).select("text", "category")), held)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("rule", rule_category(F.upper("text")))


def class_scores(scored: DataFrame) -> DataFrame:
    """(category, precision, recall, f1, n) of rows (category, prediction)."""
    hits = scored.withColumn("hit", (F.col("category") == F.col("prediction")).cast("long"))
    true = hits.groupBy("category").agg(F.sum("hit").alias("tp"), F.count("*").alias("n"))
    said = hits.groupBy(F.col("prediction").alias("category")).agg(F.count("*").alias("said"))
    both = true.join(said, "category", "full").select("category", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("said", F.lit(0)).alias("said"))
    ratio = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)
    return both.select("category", ratio(F.col("tp"), F.col("said")).alias("precision"), ratio(F.col("tp"), F.col("n")).alias("recall"), ratio(2 * F.col("tp"), F.col("n") + F.col("said")).alias("f1"), "n")


def macro_f1(scored: DataFrame) -> DataFrame:
    return class_scores(scored).agg(F.avg("f1").alias("macro_f1"), F.sum("n").alias("n"))


def threshold_scores(scored: DataFrame) -> DataFrame:
    """(threshold, macro_f1) of the combined guess for every observed confidence and one above all: the
    model's prediction where its confidence reaches the threshold, else the rules'. scored: category,
    prediction, confidence, rule.

    A class's hits and guesses at a threshold are running sums over the confidences, so rows and
    thresholds are never paired; classes are those of the rows."""
    step = F.col("confidence")
    classes = scored.select("category").distinct()
    points = scored.select(step.alias("threshold")).unionByName(scored.agg((F.max("confidence") + 1e-9).alias("threshold"))).where("threshold is not null").distinct()
    # what a row adds to class by class: as the model has it up to its confidence, as the rules above it
    one = lambda c, sign: F.struct(F.col(c).alias("category"), F.when(F.col(c) == F.col("category"), sign).otherwise(0).alias("tp"), F.lit(sign).alias("said"), step.alias("above"))
    model_always = scored.groupBy(F.col("prediction").alias("category")).agg(F.sum((F.col("prediction") == F.col("category")).cast("long")).alias("tp0"), F.count("*").alias("said0"))
    each = scored.select(F.explode(F.array(one("prediction", -1), one("rule", 1))).alias("x")).select("x.*")
    moved = each.groupBy("category", "above").agg(F.sum("tp").alias("tp"), F.sum("said").alias("said"))
    grid = points.join(F.broadcast(classes))
    run = Window.partitionBy("category").orderBy("threshold").rowsBetween(Window.unboundedPreceding, -1)
    at = grid.join(moved.withColumnRenamed("above", "threshold"), ["category", "threshold"], "left").na.fill(0, ["tp", "said"])
    at = at.withColumns({"dtp": F.coalesce(F.sum("tp").over(run), F.lit(0)), "dsaid": F.coalesce(F.sum("said").over(run), F.lit(0))})
    n = scored.groupBy("category").agg(F.count("*").alias("n"))
    full = at.join(F.broadcast(n), "category").join(F.broadcast(model_always), "category", "left").na.fill(0, ["tp0", "said0"])
    tp, said = F.col("tp0") + F.col("dtp"), F.col("said0") + F.col("dsaid")
    return full.groupBy("threshold").agg(F.avg(2.0 * tp / (said + F.col("n"))).alias("macro_f1"))


def best_threshold(scored: DataFrame) -> float:
    """The smallest threshold at which the combined guess scores best; 0 without rows. The score itself is
    not given: it is the best of many on the rows that chose it."""
    row = threshold_scores(scored).orderBy(F.desc("macro_f1"), "threshold").first()
    return 0.0 if row is None else float(row["threshold"])


def trained(rows: DataFrame) -> Model:
    """The model of all rows (text, category), with the threshold that cross-validation finds."""
    model = train(rows.select("text", "category"))
    return Model(model.pipeline, best_threshold(cross_validated(rows)))


def batch_predictions(movements: DataFrame, labels: DataFrame, model: Model | None) -> DataFrame:
    """(user_id, bank, description, category) of all descriptions without a label, by the model above its threshold
    and the rules below; none without a model, so that replacing a user's predictions by these clears old ones."""
    rows = unlabelled(movements, labels.select("user_id", "bank", "description")).withColumn("text", F.concat_ws(" ", "bank", "description"))
    if model is None:
        return rows.limit(0).select("user_id", "bank", "description", F.lit(None).cast("string").alias("category"))
    return predict(model, rows).select("user_id", "bank", "description", F.col("prediction").alias("category"))
