"""Toxicity: logistic regression trained by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are its distinct words, pairs of neighbours and pairs with one word left
out between them, hashed into DIMENSIONS. Training sees a bounded, stratified sample of the
labelled rows (MAX_PER_LABEL of each label, chosen by a hash of the id; below that bound all
of them); the sample's features are made by all tasks and one task walks over them in several passes with
per-coordinate rates; the rarer label weighs more, by the square root of the ratio. Where the bound
has changed the ratio of the labels, the bias is moved back by what that has shifted the log-odds, so
score and threshold mean the same at every size. L1 leaves few weights other than zero, and those alone are
broadcast, as sorted arrays. Scoring reads every whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import TEXTS, chunks, documents, fold, map_arrow, materialize, mix, read_table, word_hashes

DIMENSIONS = 1 << 22
ALPHA, BETA, L1, L2 = 2.0, 1.0, 5.0, 1.0
#: Passes over the sample: about STEPS steps in all, within these bounds.
STEPS, EPOCHS = 24_000, (4, 40)
#: A feature must occur in so many texts of the sample.
MIN_TEXTS = 5
#: Bound on training rows of each label.
MAX_PER_LABEL = 3000

SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
_P = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.uint64(DIMENSIONS - 1)


def features(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) for all features of all texts, with repetitions, from the word hashes of all
    texts and where each text's begin."""
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    text, found = [of], [mix(h + np.uint64(1))]
    for gap, salt in ((1, np.uint64(2)), (2, np.uint64(3))):
        inside = of[:-gap] == of[gap:]
        text.append(of[:-gap][inside])
        found.append(mix(h[:-gap][inside] * _P + h[gap:][inside] + salt))
    return np.concatenate(text), (np.concatenate(found) & _MASK).astype(np.uint32)


def feature_sets(column: pa.Array) -> list[np.ndarray]:
    text, found = features(*word_hashes(column))
    order = np.argsort(text, kind="stable")
    return [np.unique(x) for x in np.split(found[order], np.searchsorted(text[order], np.arange(1, len(column))))] if len(column) else []


class Ftrl:
    """Presence features only, so a step moves all active coordinates by the same gradient."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.z, self.n = np.zeros(dimensions + 1), np.zeros(dimensions + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, features: np.ndarray, label: int, weight: float = 1.0) -> None:
        at = np.append(features, len(self.z) - 1)
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        w = self.weights(np.arange(len(self.z)))
        at = np.flatnonzero(w[:-1])
        return at.astype(np.uint32), w[at], float(w[-1])


class Model:
    """Sorted feature ids, their weights and the bias."""

    def __init__(self, at: np.ndarray, weights: np.ndarray, bias: float):
        self.at, self.weights, self.bias = at, weights, bias

    def lookup(self) -> np.ndarray:
        dense = np.zeros(DIMENSIONS, np.float32)
        dense[self.at] = self.weights
        return dense


def stratified(labelled: DataFrame, per_label: int, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """About per_label rows of each label at most, by a hash of the id; all rows if there are fewer.
    share is the part of the row's label that was taken."""
    sizes = {r[0]: r[1] for r in labelled.groupBy(label_col).count().collect() if r[0] is not None}
    share = F.lit(0.0)
    for label, n in sorted(sizes.items()):
        share = F.when(F.col(label_col) == label, min(1.0, per_label / n)).otherwise(share)
    return labelled.withColumn("share", share).where(F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1 << 30)) < F.col("share") * (1 << 30))


def prior_shift(shares: dict[int, float]) -> float:
    """What the bias owes to sampling. Taking shares s1, s0 of the labels raises the log-odds by
    log(s1 / s0), and the rarer label's weight, the root of the sample's ratio, takes half of it back."""
    return 0.5 * float(np.log(shares[0] / shares[1])) if shares.keys() == {0, 1} else 0.0


def fit(sample: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id") -> Model:
    """From a bounded sample of rows with id, text and a 0/1 label, and the share of their label
    that was sampled if there is such a column. Rows without a label are left out; without any
    labelled row the model is empty and scores 0.5."""

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, TEXTS):
            made = [x.astype("<u4").tobytes() for x in feature_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), batch.column(2), batch.column(3)], names=["turn", "features", "label", "share"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, shares = [], {}
        for b in batches:
            rows += [(np.frombuffer(f, "<u4"), y) for f, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            shares |= zip(b.column(2).to_pylist(), b.column(3).to_pylist())
        texts = np.zeros(DIMENSIONS, np.int32)
        for features, _ in rows:
            texts[features] += 1
        rows = [(features[texts[features] >= MIN_TEXTS], y) for features, y in rows]
        ones = sum(y for _, y in rows)
        heavy = (max(ones, len(rows) - ones) / max(1, min(ones, len(rows) - ones))) ** 0.5
        rare = int(2 * ones < len(rows))
        model, order = Ftrl(), np.random.default_rng(7)
        for _ in range(min(max(STEPS // len(rows), EPOCHS[0]), EPOCHS[1]) if rows else 0):
            for i in order.permutation(len(rows)):
                model.learn(*rows[i], heavy if rows[i][1] == rare else 1.0)
        at, w, bias = model.sparse()
        bias += prior_shift(shares)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at.astype(np.int64), -1)), pa.array(np.append(w, bias))], names=["at", "weight"])

    share = F.col("share") if "share" in sample.columns else F.lit(1.0)
    chosen = sample.where(F.col(label_col).isNotNull()).select(F.xxhash64(F.col(id_col), F.lit("turn")).alias("turn"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"), share.alias("share"))
    features = materialize(map_arrow(chosen, featurize, "turn long, features binary, label int, share double"), "features")
    one = features.repartition(1).sortWithinPartitions("turn", "label", "features")
    found = map_arrow(one, train, "at long, weight double").toArrow()
    at, w = found.column("at").to_numpy(), found.column("weight").to_numpy()
    return Model(at[at >= 0], w[at >= 0], float(w[at < 0].sum()))


class Scorer:
    def __init__(self, model: Model):
        self.weights, self.bias = model.lookup(), model.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        """By text: the logistic of the bias and the weights of its distinct features."""
        text, found = features(*word_hashes(column))
        hit = np.flatnonzero(self.weights[found])
        pairs = np.unique(text[hit].astype(np.int64) << 32 | found[hit])
        total = self.bias + np.bincount(pairs >> 32, self.weights[pairs & 0xFFFFFFFF].astype(float), len(column))
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score_toxicity(df: DataFrame, model: Model, held_out=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted. Null and empty texts get the bias's score; null and
    repeated ids are kept, other columns ignored."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in chunks(batches, TEXTS):
            s = scorer.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], schema=SCORED)

    chosen = df.select(F.col(id_col).cast("long").alias("doc_id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), F.col(text_col).alias("text"))
    return map_arrow(chosen, score, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(df: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose score is below the threshold, with all their columns, without a shuffle."""
    shared, schema = df.sparkSession.sparkContext.broadcast(model), df.schema
    place = df.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in chunks(batches, TEXTS):
            yield batch.filter(pa.array(scorer.scores(batch.column(place)) < threshold))

    return map_arrow(df, keep, schema)


def training_sample(spark: SparkSession, docs: DataFrame, sf_dir: str, per_label: int = MAX_PER_LABEL) -> DataFrame:
    """Labelled documents outside the held-out fold. The labels are sampled before the join,
    so what is broadcast has about 2 * per_label rows at most."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").where((fold("doc_id", 5) != 0) & F.col("toxic").isNotNull())
    return docs.select("doc_id", "text").join(F.broadcast(stratified(labels, per_label)), "doc_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_toxicity(docs, fit(training_sample(spark, docs, sf_dir)), fold("doc_id", 5) == 0)


QUERIES = {"op6_toxicity": op6_toxicity}
