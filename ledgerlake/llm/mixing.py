"""Mixing sources to target weights by iterative proportional fitting (raking).

Token weights are summed by cell (source, language, topic); the cells' weights are scaled in
turn until their source, language and topic marginals agree with the targets. A cell cannot give
more than it has, so what is kept of the cells is raked once more with that bound: a full cell
stays full and the others make up for it. Where a target cannot be met with KEEP of all tokens,
less is kept, so that the marginals of the sample still agree. A document of a
cell then stays with the probability that gives the cell its calibrated weight, drawn by a
hash of its id and text, so a repeated task draws alike.

Cells are few where sources are; up to MAX_CELLS of them are fitted on the driver, more by the
same steps, with the same scale and the same rule to stop, as DataFrame aggregations. Factors go
back to the documents by a join on the cell, broadcast only below that bound. All aggregation is
partial before it shuffles, so a source that holds a third of all rows is one row per task.

A table without topics gets them from its words: every word of a text counts, hashed into
BUCKETS. A bucket speaks for one of TOPICS, the one that its number gives, by how rare its words are
in the text's language, which is counted over all texts; a text's topic is the one that its words
speak for most, beyond what usual words of the language would. (Languages whose hashes agree in
their last four bits are counted together.) So a topic is a class of texts with rare words in common,
spread over all languages; topics that were the languages once more, as frequent words
make them, could not be weighted apart from these. Pass topic_col to use real ones.

Targets can still contradict each other. Then raking ends at its last step, and its marginals, which
are as near to the targets as it comes, are those that the sample meets."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerlake.llm.common import TEXTS, chunks, discard, documents, hashed, map_arrow, materialize, numbered_words, unused

DIMENSIONS = ("source", "lang", "topic")
TOPICS, BUCKETS, SLOTS = 8, 1 << 13, 16
MAX_CELLS = 20_000
STEPS, TOLERANCE = 50, 1e-9
#: With the bound: marginals agree to a ten-thousandth of each; if STEPS do not get there, keep shrinks so.
BOUND_TOLERANCE, SHRINK = 1e-4, 0.95
#: A cell this near to full is full, so that rounding does not decide it.
FULL = 1 - 1e-8
#: Without targets these are the marginal shares to this power, rescaled: below 1 it lifts the rare ones.
FLATTEN = {"source": 0.7, "lang": 0.7, "topic": 0.9}
#: Tokens to keep, as a share of all tokens, where the targets allow it; no probability exceeds 1.
KEEP = 0.8
SEED = 20240601

Targets = Mapping[str, Mapping[str | None, float]]


def _draw(id_col: Column, text_col: Column) -> Column:
    return (F.pmod(F.xxhash64(id_col, text_col, F.lit(SEED)), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _key(value: Column) -> Column:
    """A text for each value, null included, that no other value has."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def _slot(lang: Column) -> Column:
    return F.pmod(F.xxhash64(_key(lang)), F.lit(SLOTS)).cast("int")


def _value(key: Column) -> Column:
    return F.when(key != "", F.substring(key, F.lit(2), F.length(key)))


# --- topics


def word_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word of all texts, and where each text's words begin, one more for the end."""
    distinct, number, bounds = numbered_words(column)
    return (hashed(distinct) >> np.uint64(20)).astype(np.int64)[number] % BUCKETS, bounds


def topic_weights(counts: np.ndarray) -> np.ndarray:
    """By language and bucket, from counts by language and bucket: a bucket's rarity; and by language and
    topic, what a usual word of the language gives the topic."""
    share = (counts + 1.0) / (counts + 1.0).sum(1, keepdims=True)
    rarity = -np.log(share)
    usual = (rarity * share).reshape(SLOTS, BUCKETS // TOPICS, TOPICS).sum(1)
    return np.concatenate([rarity, usual], axis=1)


def best_topics(weights: np.ndarray, slots: np.ndarray, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The topic of each text, the first of equal ones, -1 for texts without words."""
    n = np.diff(bounds)
    rarity = weights[:, :BUCKETS].reshape(-1)[np.repeat(slots * BUCKETS, n) + buckets]
    scores = np.bincount(np.repeat(np.arange(len(n)) * TOPICS, n) + buckets % TOPICS, rarity, len(n) * TOPICS).reshape(len(n), TOPICS)
    return np.where(n > 0, (scores - n[:, None] * weights[slots, BUCKETS:]).argmax(1), -1) if len(n) else np.zeros(0, np.int64)


def _coded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a batch of coded texts, its last column."""
    column = batch.column(batch.num_columns - 1)
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
    found = np.frombuffer(data, "<u2")[at[0] : at[-1]] if data is not None else np.zeros(0, "<u2")
    return found.astype(np.int64), at - at[0]


def learn_topics(coded: DataFrame) -> np.ndarray:
    """topic_weights of all rows (slot, buckets)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS * BUCKETS, np.int64)
        for batch in chunks(batches, TEXTS):
            slots, (buckets, bounds) = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _coded(batch)
            counts += np.bincount(np.repeat(slots * BUCKETS, np.diff(bounds)) + buckets, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["place", "n"])

    found = map_arrow(coded.select("slot", "buckets"), count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS * BUCKETS)
    counts[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return topic_weights(counts.reshape(SLOTS, BUCKETS))


# --- cells


def describe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None, source_col: str = "source", lang_col: str = "lang") -> tuple[DataFrame, np.ndarray | None]:
    """doc_id, source, lang, topic (keys), n_tokens, draw of every row, written; and the topics' weights, None if a column has the topics."""
    topic = _key(F.col(topic_col)) if topic_col else F.lit("")
    chosen = df.select(F.col(id_col).cast("long").alias("doc_id"), _key(F.col(source_col)).alias("source"), _key(F.col(lang_col)).alias("lang"), topic.alias("topic"), _draw(F.col(id_col), F.col(text_col)).alias("draw"), _slot(F.col(lang_col)).alias("slot"), F.col(text_col).alias("text"))
    schema = "doc_id long, source string, lang string, topic string, draw double, n_tokens long"
    names = [x.split()[0] for x in schema.split(", ")]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, TEXTS):
            buckets, bounds = word_buckets(batch.column(6))
            coded = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(buckets.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.diff(bounds)), batch.column(5), coded], names=[*names, "slot", "buckets"])

    coded = materialize(map_arrow(chosen, code, f"{schema}, slot int, buckets binary"), "coded")
    if topic_col:
        return coded.drop("slot", "buckets"), None
    weights = learn_topics(coded)
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, TEXTS):
            topics = best_topics(shared.value, batch.column(6).to_numpy(zero_copy_only=False).astype(np.int64), *_coded(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _topic_keys(topics), *batch.columns[4:6]], names=names)

    placed = materialize(map_arrow(coded, place, schema), "described")
    discard(coded)
    return placed, weights


def _topic_keys(topics: np.ndarray) -> pa.Array:
    return pa.array([f"={t}" if t >= 0 else "" for t in topics.tolist()], pa.string())


def rake(has: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """Cell weights, scaled to each marginal in turn, until no factor is further than TOLERANCE from 1."""
    w = has.astype(float)
    for _ in range(STEPS):
        worst = 0.0
        for code, target in zip(codes, targets):
            now = np.bincount(code, w, len(target))
            factor = np.divide(target, now, out=np.ones(len(target)), where=now > 0)
            worst = max(worst, float(np.abs(factor - 1).max(initial=0)))
            w *= factor[code]
        if worst < TOLERANCE:
            break
    return w


def rake_bounded(has: np.ndarray, fitted: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], keep: float) -> np.ndarray:
    """The share of each cell to keep. All are shares of one total; no cell gives more than it has,
    and the marginals agree with the targets times keep, or times the most that they allow."""
    marginals = [(np.bincount(code, has, len(t)), t) for code, t in zip(codes, targets)]
    keep = min(keep, *(float((own[t > 0] / t[t > 0]).min(initial=1.0)) for own, t in marginals))
    while True:
        u = fitted * keep
        for _ in range(STEPS):
            worst = 0.0
            for code, target in zip(codes, targets):
                goal, n = target * keep, len(target)
                now = np.bincount(code, np.minimum(u, has), n)
                free = np.bincount(code, np.where(u < FULL * has, u, 0.0), n)
                off = np.divide(now, goal, out=np.ones(n), where=goal > 0) - 1
                worst = max(worst, float(np.abs(off).max(initial=0)))
                # Newton's step for the free cells; where it has no hold, in proportion, downward only
                step = 1 + np.divide(goal - now, free, out=np.zeros(n), where=free > 0)
                less = np.minimum(1.0, np.divide(goal, now, out=np.ones(n), where=now > 0))
                u = u * np.where((free > 0) & (step > 0.5), np.minimum(step, 1e3), less)[code]
            if worst < BOUND_TOLERANCE:
                return np.minimum(u, has)
        keep *= SHRINK


def _rescaled(goal: np.ndarray, dimension: str) -> np.ndarray:
    if not goal.sum() > 0:
        raise ValueError(f"no {dimension} that has tokens has a target")
    return goal / goal.sum()


def _named(targets: Targets | None, dimension: str) -> dict[str, float] | None:
    """Targets by key, None if the dimension has none of its own."""
    own = (targets or {}).get(dimension)
    return None if own is None else {"" if k is None else f"={k}": float(v) for k, v in own.items()}


def _probabilities_local(cells: DataFrame, keep: float, targets: Targets | None) -> DataFrame:
    rows = cells.orderBy(*DIMENSIONS).collect()
    tokens = np.array([float(r["tokens"]) for r in rows])
    total, codes, goals = tokens.sum(), [], []
    has = tokens / max(total, 1.0)
    for d in DIMENSIONS if total else ():
        values, code = np.unique([r[d] for r in rows], return_inverse=True)
        share, named = np.bincount(code, has), _named(targets, d)
        wanted = np.where(share > 0, share, 0.0) ** FLATTEN[d] if named is None else np.array([named.get(str(v), 0.0) for v in values])
        codes.append(code)
        goals.append(_rescaled(wanted * (share > 0), d))
    fitted = rake(has, codes, goals) if total else has
    goals = [np.bincount(code, fitted, len(goal)) for code, goal in zip(codes, goals)]  # the targets, or as near as they can be met
    kept = rake_bounded(has, fitted, codes, goals, keep) if total else has
    p = np.minimum(1.0, np.divide(kept, has, out=np.ones(len(rows)), where=has > 0))
    out = [(*(r[d] for d in DIMENSIONS), float(f), float(x)) for r, f, x in zip(rows, fitted, p)]
    return F.broadcast(cells.sparkSession.createDataFrame(out, "source string, lang string, topic string, weight double, probability double"))


def _probabilities_distributed(cells: DataFrame, keep: float, targets: Targets | None) -> DataFrame:
    """The same fit for any number of cells; each step is one aggregation and one join by value."""
    spark, total, goals = cells.sparkSession, float(cells.agg(F.sum("tokens")).first()[0] or 0), {}
    state = materialize(cells.withColumn("has", F.col("tokens") / F.lit(max(total, 1.0))).withColumn("weight", F.col("has")), "cells")
    if not total:
        return state.select(*DIMENSIONS, "weight", F.lit(1.0).alias("probability"))
    for d in DIMENSIONS:
        share, named = state.groupBy(d).agg(F.sum("has").alias("share")).where("share > 0"), _named(targets, d)
        if named is None:
            wanted = share.withColumn("goal", F.pow("share", F.lit(FLATTEN[d])))
        else:
            wanted = share.join(spark.createDataFrame(list(named.items()), f"{d} string, goal double"), d, "left").na.fill(0.0, ["goal"])
        norm = float(wanted.agg(F.sum("goal")).first()[0] or 0)
        _rescaled(np.array([norm]), d)
        goals[d] = materialize(wanted.select(d, "share", (F.col("goal") / norm).alias("goal")), "goal")
    for _ in range(STEPS):
        before, worst, steps = state, 0.0, []
        for d in DIMENSIONS:
            now = state.groupBy(d).agg(F.sum("weight").alias("now")).where("now > 0")
            steps.append(materialize(now.join(goals[d].drop("share"), d).select(d, (F.col("goal") / F.col("now")).alias("factor")), "factor"))
            worst = max(worst, steps[-1].agg(F.max(F.abs(F.col("factor") - 1))).first()[0] or 0.0)
            state = state.join(steps[-1], d, "left").withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(1.0))).drop("factor")
        state = materialize(state, "cells")
        discard(before, *steps)
        if worst < TOLERANCE:
            break
    met = {d: materialize(state.groupBy(d).agg(F.sum("has").alias("share"), F.sum("weight").alias("goal")).where("share > 0"), "goal") for d in DIMENSIONS}
    kept = _bounded_distributed(state, met, keep)
    p = F.when(F.col("has") > 0, F.least(F.lit(1.0), F.col("u") / F.col("has"))).otherwise(1.0)
    return kept.select(*DIMENSIONS, "weight", p.alias("probability"))


def _bounded_distributed(fitted: DataFrame, goals: dict[str, DataFrame], keep: float) -> DataFrame:
    """rake_bounded over cells (has, weight): the cells with u, of which least(u, has) is kept."""
    reach = [goals[d].where("goal > 0").agg(F.min(F.col("share") / F.col("goal"))).first()[0] for d in DIMENSIONS]
    keep = min(keep, *(1.0 if x is None else x for x in reach))
    u, has, now, free, goal = (F.col(c) for c in ("u", "has", "now", "free", "goal"))
    step = 1 + (goal - now) / F.nullif(free, F.lit(0.0))
    factor = F.when(step > 0.5, F.least(step, F.lit(1e3))).when(now > 0, F.least(F.lit(1.0), goal / now)).otherwise(1.0)
    while True:
        state = materialize(fitted.withColumn("u", F.col("weight") * keep), "bounded")
        for _ in range(STEPS):
            before, worst, steps = state, 0.0, []
            for d in DIMENSIONS:
                sums = state.groupBy(d).agg(F.sum(F.least(u, has)).alias("now"), F.sum(F.when(u < FULL * has, u).otherwise(0.0)).alias("free"))
                aimed = sums.join(goals[d].select(d, (goal * keep).alias("goal")), d)
                steps.append(materialize(aimed.select(d, factor.alias("factor"), F.when(goal > 0, F.abs(now / F.nullif(goal, F.lit(0.0)) - 1)).otherwise(0.0).alias("off")), "factor"))
                worst = max(worst, steps[-1].agg(F.max("off")).first()[0] or 0.0)
                state = state.join(steps[-1].drop("off"), d, "left").withColumn("u", u * F.coalesce("factor", F.lit(1.0))).drop("factor")
            state = materialize(state, "bounded")
            discard(before, *steps)
            if worst < BOUND_TOLERANCE:
                return state
        discard(state)
        keep *= SHRINK


def probabilities(described: DataFrame, keep: float = KEEP, targets: Targets | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """(source, lang, topic, weight, probability) of all cells, by key; weight is the cell's share
    after raking, probability what a document of the cell stays with."""
    cells = materialize(described.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    return (_probabilities_local if cells.count() <= max_cells else _probabilities_distributed)(cells, keep, targets)


def mix(df: DataFrame, keep: float = KEEP, targets: Targets | None = None, max_cells: int = MAX_CELLS, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None, source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, source, lang, topic, n_tokens, weight (the cell's share
    after raking), probability, selected.

    targets: by dimension (source, lang, topic) the shares of tokens wanted of its values, None for
    null; they are rescaled over the values that have tokens, and a value without a target is wanted
    not at all. Dimensions that are not named get their own shares, flattened. Null source, language
    and topic are a value of their own; a text without words has a null topic unless a column tells
    it, and probability 1 if its cell has no tokens. Repeated rows draw alike; null ids are drawn by
    their text; other columns are ignored; an empty table gives no row."""
    described, _ = describe(df, id_col, text_col, topic_col, source_col, lang_col)
    mixed = described.join(probabilities(described, keep, targets, max_cells), list(DIMENSIONS))
    return mixed.select("doc_id", *(_value(F.col(d)).alias(d) for d in DIMENSIONS), "n_tokens", "weight", "probability", (F.col("draw") < F.col("probability")).alias("selected"))


def marginals(mixed: DataFrame) -> DataFrame:
    """(dimension, value, available, expected, sampled): the shares of tokens that each value has before,
    that it should have after by the probabilities, and that it has in the sample drawn."""
    tokens = F.col("n_tokens").cast("double")
    sums = [F.sum(tokens).alias("available"), F.sum(tokens * F.col("probability")).alias("expected"), F.sum(F.when(F.col("selected"), tokens).otherwise(0.0)).alias("sampled")]
    each = mixed.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in DIMENSIONS))).alias("x"), "n_tokens", "probability", "selected")
    by_value = materialize(each.groupBy("x.dimension", "x.value").agg(*sums), "marginals")
    whole = by_value.groupBy("dimension").agg(*(F.sum(c).alias(f"{c}_all") for c in ("available", "expected", "sampled")))
    share = lambda c: (F.col(c) / F.nullif(F.col(f"{c}_all"), F.lit(0.0))).alias(c)
    return by_value.join(F.broadcast(whole), "dimension").select("dimension", "value", share("available"), share("expected"), share("sampled"))


def sample_documents(df: DataFrame, keep: float = KEEP, targets: Targets | None = None, max_cells: int = MAX_CELLS, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None, source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The selected rows of mix with all their columns, whatever they are called, without a shuffle of
    texts: the cell and the draw are functions of the row, and the probabilities are joined by cell."""
    described, weights = describe(df, id_col, text_col, topic_col, source_col, lang_col)
    found = probabilities(described, keep, targets, max_cells)
    topic = unused(df, "topic")
    if topic_col:
        work = df.withColumn(topic, _key(F.col(topic_col)))
    else:
        shared, place, slot = df.sparkSession.sparkContext.broadcast(weights), df.columns.index(text_col), unused(df, "slot")

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, TEXTS):
                slots = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
                topics = best_topics(shared.value, slots, *word_buckets(batch.column(place)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _topic_keys(topics)], names=[*batch.schema.names[:-1], topic])

        work = map_arrow(df.withColumn(slot, _slot(F.col(lang_col))), assign, StructType([*df.schema.fields, StructField(topic, StringType())]))
    work, found = work.alias("docs"), found.alias("cells")
    own = lambda c: F.col(f"docs.`{c}`")
    same = (_key(own(source_col)) == F.col("cells.source")) & (_key(own(lang_col)) == F.col("cells.lang")) & (own(topic) == F.col("cells.topic"))
    drawn = work.join(found, same).where(_draw(own(id_col), own(text_col)) < F.col("cells.probability"))
    return drawn.select(*(own(c) for c in df.columns))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


QUERIES = {"op5_mixing": op5_mixing}
