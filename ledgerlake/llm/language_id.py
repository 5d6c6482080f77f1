"""Language id: multinomial naive Bayes over hashed character n-grams.

N-grams of 1 to 4 characters are taken inside words, with a mark at both word ends, and
hashed into BUCKETS. Each task counts the words of its training texts by language and turns
distinct words with their counts into a sparse count vector per language; the vectors are
summed by (language, bucket). The log-probability matrix is broadcast in blocks of LANGUAGES
labels at most, so its size is bounded; with more labels than that, texts are scored block by
block, and what each block finds best is carried to the next, with the same result.

To score a batch of texts, what stands between white space is numbered; the log-likelihoods of
the distinct ones are summed from the matrix, languages x distinct, and summed again by text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import TEXTS, chunks, discard, documents, fold, map_arrow, materialize, mix, numbered_words

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.1
#: Labels whose matrix is broadcast at once: 16 MB.
LANGUAGES = 128
#: Evidence is divided by 1 + words / TEMPER before it becomes a probability: n-grams of one
#: text are far from independent, and the plain posterior would be 0 or 1.
TEMPER = 20.0
UNDETERMINED = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    """Words of a text in lower case; what is no letter only separates them."""
    return [w for w in _LETTERS.findall(text.lower()) if w.isalpha()]


def words_of(distinct: list[bytes]) -> tuple[list[str], np.ndarray]:
    """The words in all pieces of text that stand between white space, and the piece of each."""
    found = [tokens(x.decode()) for x in distinct]
    return list(chain.from_iterable(found)), np.repeat(np.arange(len(found)), np.fromiter(map(len, found), np.int64, len(found)))


_P = np.uint64(0x9E3779B97F4A7C15)


def ngrams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the word, hash bucket) of all n-grams of the words, one order at a time. Words
    stand in one array of code points, each between two marks; an n-gram lies inside one word."""
    points = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    place = np.cumsum(points == 2) - 1
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        size = len(points) - n + 1
        h = h[:size] * _P + points[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            inside = place[:size] == place[n - 1 :]
            yield place[:size][inside], (mix(h[inside]) % np.uint64(BUCKETS)).astype(np.int64)


def count_ngrams(df: DataFrame) -> DataFrame:
    """(lang, bucket, n) over training rows (lang, text); bucket -1 has the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for batch in chunks(batches, TEXTS):
            distinct, number, bounds = numbered_words(batch.column(1))
            labels = batch.column(0).dictionary_encode()
            names, of = labels.dictionary.to_pylist(), labels.indices.to_numpy(zero_copy_only=False)
            pairs, times = np.unique(np.repeat(of, np.diff(bounds)).astype(np.int64) * max(1, len(distinct)) + number, return_counts=True)
            at = np.searchsorted(pairs, np.arange(len(names) + 1) * max(1, len(distinct)))
            texts = np.bincount(of, minlength=len(names))
            for k, lang in enumerate(names):
                vector = grams.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                vector[BUCKETS] += texts[k]
                own = pairs[at[k] : at[k + 1]] - k * max(1, len(distinct))
                words, owner = words_of([distinct[i] for i in own])
                many = times[at[k] : at[k + 1]][owner]
                for place, bucket in ngrams(words):
                    vector[:BUCKETS] += np.bincount(bucket, many[place], BUCKETS).astype(np.int64)
            if len(grams) >= LANGUAGES:
                yield from handed_on(grams)
        yield from handed_on(grams)

    def handed_on(grams: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, vector in grams.items():
            some = np.flatnonzero(vector)
            names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(some), np.int32)), pa.array([lang])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(np.where(some == BUCKETS, -1, some).astype(np.int32)), pa.array(vector[some])], names=["lang", "bucket", "n"])
        grams.clear()

    return map_arrow(df, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Block:
    """Labels in order, their log-probabilities (BUCKETS x labels) and prior."""

    def __init__(self, languages: list[str], log_p: np.ndarray, prior: np.ndarray):
        self.languages, self.log_p, self.prior = languages, log_p, prior


class Model:
    """All labels in order, and their counts (k, bucket, n) as a written table, k a label's place.
    The driver holds the matrix of one block at a time."""

    def __init__(self, languages: list[str], counted: DataFrame, texts: int, size: int):
        self.languages, self.counted, self.texts, self.size = languages, counted, texts, size

    def blocks(self) -> Iterator[Block]:
        for first in range(0, len(self.languages), self.size):
            own = self.languages[first : first + self.size]
            counts, docs = np.zeros((BUCKETS, len(own))), np.ones(len(own))
            for batch in self.counted.where(F.col("k").between(first, first + len(own) - 1)).toArrow().to_batches():
                k, at, n = (batch.column(c).to_numpy() for c in ("k", "bucket", "n"))
                real = at >= 0
                counts[at[real], k[real] - first] = n[real]
                docs[k[~real] - first] += n[~real]
            log_p = np.log((counts + SMOOTHING) / (counts.sum(0, keepdims=True) + SMOOTHING * BUCKETS))
            yield Block(own, log_p.astype(np.float32), np.log(docs / (self.texts + len(self.languages))))


def fit(df: DataFrame, size: int = LANGUAGES) -> Model:
    """From training rows (lang, text), lang not null. All of them are read."""
    counted = materialize(count_ngrams(df.select("lang", "text")), "ngrams")
    languages = sorted(x[0] for x in counted.where("bucket = -1").select("lang").collect())
    texts = counted.where("bucket = -1").agg(F.sum("n")).first()[0] or 0
    order = df.sparkSession.createDataFrame([(x, k) for k, x in enumerate(languages)], "lang string, k int")
    return Model(languages, materialize(counted.join(order, "lang").select("k", "bucket", "n"), "ngrams"), texts, size)


def evidence(block: Block, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text, and texts x labels: the log-likelihood of its n-grams."""
    distinct, number, bounds = numbered_words(column)
    words, owner = words_of(distinct)
    of, n, labels = np.repeat(np.arange(len(column)), np.diff(bounds)), len(column), len(block.languages)
    grams = [(owner[place], bucket) for place, bucket in ngrams(words)] if words else []
    out = np.zeros((n, labels))
    for k in range(labels):
        row = np.zeros(len(distinct))
        for place, bucket in grams:
            row += np.bincount(place, block.log_p[bucket, k], len(distinct))
        out[:, k] = np.bincount(of, row[number], n)
    return np.bincount(of, np.bincount(owner, minlength=len(distinct))[number], n), out


BEST = "best double, lang_pred string, logit double, top double, mass double"


def _with_block(df: DataFrame, block: Block, last: bool) -> DataFrame:
    """Rows (doc_id, held_out, text, and what the blocks before found) with this block's labels: the
    evidence and the tempered logit of the best one, and over all the greatest logit and the sum of
    exp(logit - greatest). Equal evidence goes to the label that comes first."""
    shared = df.sparkSession.sparkContext.broadcast(block)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in chunks(batches, TEXTS):
            words, found = evidence(b, batch.column(2))
            best, logit, top, mass = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5, 6, 7))
            whole, tempered = found + b.prior, b.prior + found / (1 + words / TEMPER)[:, None]
            at, each = whole.argmax(1), np.arange(batch.num_rows)
            better = (words > 0) & (np.isnan(best) | (whole[each, at] > best))
            names = pa.array(b.languages).take(pa.array(at))
            highest = np.fmax(top, tempered.max(1))
            sums = np.exp(tempered - highest[:, None]).sum(1) + np.where(np.isnan(top), 0.0, mass * np.exp(np.where(np.isnan(top), 0.0, top) - highest))
            columns = [
                pa.array(np.where(better, whole[each, at], best)), pc.if_else(pa.array(better), names, batch.column(4)),
                pa.array(np.where(better, tempered[each, at], logit)), pa.array(highest), pa.array(sums),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: 2 if last else 3], *columns], names=["doc_id", "held_out", *(() if last else ("text",)), "best", "lang_pred", "logit", "top", "mass"])

    return map_arrow(df, score, f"doc_id long, held_out boolean, {'' if last else 'text string, '}{BEST}")


def identify(df: DataFrame, model: Model, held_out=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score: the best language and its tempered posterior.

    A text that is null or has no letter is 'und' with score 0; equal evidence goes to the
    first label in order. Null and repeated ids are kept, other columns ignored. A model
    without labels calls all texts 'und'."""
    none = [F.lit(float("nan")).alias("best"), F.lit(None).cast("string").alias("lang_pred"), *(F.lit(float("nan")).alias(c) for c in ("logit", "top", "mass"))]
    state = df.select(F.col(id_col).cast("long").alias("doc_id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), F.col(text_col).alias("text"), *none)
    blocks, before = -(-len(model.languages) // model.size), None
    for i, block in enumerate(model.blocks()):
        state = _with_block(state, block, i + 1 == blocks)
        if i + 1 < blocks:  # written, so that one block's matrix is held at a time
            state = materialize(state, "languages")
            discard(*([before] if before else []))
            before = state
    known = F.col("lang_pred").isNotNull()
    score = F.when(known, F.exp(F.col("logit") - F.col("top")) / F.col("mass")).otherwise(0.0)
    return state.select("doc_id", "held_out", F.coalesce("lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"), score.alias("score"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold("doc_id", 3) == 1
    model = fit(docs.where(~held_out & F.col("lang").isNotNull()))
    return identify(docs, model, held_out)


QUERIES = {"op9_language_id": op9_language_id}
