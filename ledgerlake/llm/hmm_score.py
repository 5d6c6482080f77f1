"""Language-model scoring by a hidden Markov model.

Training tokens are counted over the whole training part of the corpus (partial counts per
task, one sum by word). Up to SYMBOLS of the most frequent words are symbols of their own, so
their number grows with the vocabulary until the model, SYMBOLS x STATES numbers, is as large
as may be broadcast; all other words share the RARE symbol and are told apart inside it by
their smoothed counts, with one share for all words never seen, so the model is a proper
distribution over words.

Baum-Welch: texts are coded once as symbol sequences and written to the shared folder. In each
of ITERATIONS rounds every task runs scaled forward and backward recursions over its training
texts, each from its first token to its last, many side by side, and emits expected emission
and transition counts, which are summed by symbol across partitions; their sums are
re-estimated on the driver, whose share is fixed: SYMBOLS x STATES. A text too long to be held
is gone through in pieces: the forward message is kept at the pieces' borders, and going
backward each piece is computed again from it and hands its backward message to the one before.
The start point is fitted by the same recursions on a sample of about START_TOKENS tokens and
then trained on everything.

Scoring runs the scaled forward recursion over each whole document, from end to end, which
gives the exact likelihood of its symbols under the model.

Counts of words: about COUNTED of the most frequent are broadcast (bounded); tokens outside them go by
(document, word) through a join with the full count table, so the base score is exact for any
vocabulary. Words are known by a 64-bit hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import TEXTS, chunks, documents, fold, hashed, map_arrow, materialize, numbered_words

STATES = 12
#: Symbols are stored in 16 bits.
SYMBOLS = 1 << 16
COUNTED = 1 << 19
ITERATIONS = 4
START_TOKENS, START_ROUNDS = 400_000, 8
#: Words that a task counts before it sums them, and distinct ones, twice over, before it hands them on.
FLUSH = 1_000_000
SMOOTHING = 0.5
END, RARE = 0, 1
#: The hash of the end of a text: any 64-bit number that no word is likely to hash to.
END_HASH = 0x454E445F4F465F54
#: Tokens whose messages are held at once.
BATCH_TOKENS = 1 << 18
#: Steps between scalings; a step takes at most about 1e-12, so nothing underflows.
RESCALE = 8
SEED = 11


def summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and the sum of each one's counts."""
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(h) else c


def count_words(texts: DataFrame, flush: int = FLUSH) -> DataFrame:
    """(word, c) over rows (text): counts by word hash, one end for each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flushed() -> pa.RecordBatch:
            h, c = summed(*map(np.concatenate, zip(*held)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["word", "c"])

        for batch in chunks(batches, TEXTS):
            distinct, number, _ = numbered_words(batch.column(0))
            held.append((np.append(hashed(distinct), np.uint64(END_HASH)), np.append(np.bincount(number, minlength=len(distinct)), batch.num_rows)))
            size += len(distinct) + 1
            if size > flush:
                held[:] = [summed(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size > flush // 2:
                    yield flushed()
                    size = 0
        if held:
            yield flushed()

    return map_arrow(texts, count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """About `most` of the most frequent words: a histogram of at most 4096 logarithmic steps finds
    how far down they reach, so no task sorts or gathers the vocabulary; of the step that would
    exceed the number a share is taken, by hash."""
    step = F.floor(F.log2(F.col("c") + F.lit(0.0)) * 64).cast("int")
    steps = counts.where("c > 0").groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    lowest, taken, share = 1 << 30, 0, 0.0
    for row in steps:
        if taken + row["n"] > most:
            lowest, share = row["step"], (most - taken) / row["n"]
            break
        lowest, share, taken = row["step"], 1.0, taken + row["n"]
    some = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < share * (1 << 30)
    return counts.where((F.col("c") > 0) & ((step > lowest) | ((step == lowest) & some)))


class Lexicon:
    """Sorted hashes of the most frequent words with their counts and symbols."""

    def __init__(self, h: np.ndarray, c: np.ndarray, total: int, distinct: int, symbols: int = SYMBOLS):
        by_count = np.lexsort((h, -c))
        h, c = h[by_count], c[by_count]
        symbol = np.full(len(h), RARE, np.uint16)
        ranked = np.flatnonzero(h != END_HASH)[: symbols - 2]
        symbol[ranked] = np.arange(2, 2 + len(ranked))
        symbol[h == END_HASH] = END
        order = np.argsort(h)
        self.hashes, self.counts, self.symbols = h[order], c[order], symbol[order]
        self.total, self.distinct, self.n_symbols = total, distinct, 2 + len(ranked)
        own = self.symbols != RARE
        self.rare_total = total - int(self.counts[own].sum())
        self.rare_distinct = distinct - int(own.sum())

    @property
    def base_norm(self) -> float:
        return self.total + SMOOTHING * (self.distinct + 1)

    @property
    def rare_norm(self) -> float:
        return self.rare_total + SMOOTHING * (self.rare_distinct + 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it has none."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


class Coder:
    """Texts as symbols."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, logs = lexicon, np.log10(lexicon.counts + SMOOTHING)
        # the last entry serves place -1: words whose count is not in the lexicon
        self.logs, self.known, self.symbols = np.append(logs, 0.0), np.append(lexicon.counts > 0, False), np.append(lexicon.symbols, np.uint16(RARE))
        self.rare_logs = np.append(np.where(lexicon.symbols == RARE, logs, 0.0), 0.0)
        self.base_norm, self.rare_norm = np.log10(lexicon.base_norm), np.log10(lexicon.rare_norm)
        self.end = lexicon.find(np.array([END_HASH]))

    def code(self, texts: pa.Array) -> dict[str, pa.Array]:
        distinct, number, bounds = numbered_words(texts)
        hashes = hashed(distinct).view(np.int64)
        # each text's words and its end
        n, last = np.diff(bounds) + 1, bounds[1:] + np.arange(len(texts))
        starts, ours = np.append(0, last + 1), np.ones(bounds[-1] + len(texts), bool)
        ours[last] = False
        at, word = np.empty(len(ours), np.int64), np.zeros(len(ours), np.int64)
        at[ours], at[last], word[ours] = self.lexicon.find(hashes)[number], self.end, hashes[number]
        word[last] = END_HASH
        symbols, over = self.symbols[at], lambda x: np.add.reduceat(x, starts[:-1], dtype=np.float64)
        far = np.flatnonzero(at < 0)
        text_of, word = np.searchsorted(starts, far, "right") - 1, word[far]
        order = np.lexsort((word, text_of))
        text_of, word = text_of[order], word[order]
        first = np.flatnonzero(np.append(True, (text_of[1:] != text_of[:-1]) | (word[1:] != word[:-1]))) if len(far) else far
        far_n, offsets = np.diff(np.append(first, len(far))), np.searchsorted(text_of[first], np.arange(len(texts) + 1)).astype(np.int32)
        data = pa.py_buffer(symbols.astype("<u2").tobytes())
        return {
            "n_tokens": pa.array(n),
            "symbols": pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((2 * starts).astype(np.int32).tobytes()), data]),
            "n_known": pa.array(over(self.known[at]).astype(np.int64)),
            "base": pa.array(over(self.logs[at]) - n * self.base_norm),
            "rare": pa.array(over(self.rare_logs[at]) - over(symbols == RARE) * self.rare_norm),
            "far": pa.ListArray.from_arrays(pa.array(offsets), pa.array(word[first])),
            "far_n": pa.ListArray.from_arrays(pa.array(offsets), pa.array(far_n.astype(np.int32))),
        }


CODED = "row long, doc_id long, held_out boolean, n_tokens long, symbols binary, n_known long, base double, rare double, far array<long>, far_n array<int>"


def code(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Rows (doc_id, held_out, text) as symbol sequences with what the broadcast counts say of
    them: known tokens, their base score, and the rare ones' share inside the RARE symbol (both
    log10). far, far_n: words outside the broadcast counts, whose part is to be added. row is
    unique in the written table."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, row = Coder(shared.value), TaskContext.get().partitionId() << 40
        for batch in chunks(batches, TEXTS):
            if batch.num_rows:
                coded = coder.code(batch.column(2))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + batch.num_rows)), batch.column(0), batch.column(1), *coded.values()], names=["row", "doc_id", "held_out", *coded])
                row += batch.num_rows

    return map_arrow(df, run, CODED)


class Hmm:
    """start (K), move (K x K) and emit (S x K, the probability of a symbol in a state)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, n_symbols: int, states: int, frequency: np.ndarray) -> Hmm:
        rng = np.random.default_rng(SEED)
        emit = (frequency[:, None] + 1e-9) * rng.uniform(0.5, 1.5, (n_symbols, states))
        move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    @classmethod
    def estimated(cls, counts: Counts, frequency: np.ndarray) -> Hmm:
        """From expected counts, each row smoothed: moves by one count, emissions toward the corpus
        frequency by the weight of SMOOTHING tokens for every symbol."""
        emit = counts.emit + SMOOTHING * len(frequency) * frequency[:, None] + 1e-9
        move, start = counts.move + 1.0, counts.start + 1.0
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


class Counts:
    """Expected counts, and the log-likelihood they were taken at."""

    def __init__(self, states: int, n_symbols: int):
        self.start, self.move, self.emit, self.likelihood = np.zeros(states), np.zeros((states, states)), np.zeros((n_symbols, states)), 0.0


class Sequences:
    """Sequences side by side, the longest first. Tokens lie in order of time: those of time t are
    at[t] to at[t + 1], one for each sequence that has not ended, in the sequences' order."""

    def __init__(self, sequences: list[np.ndarray]):
        n = np.fromiter(map(len, sequences), np.int64, len(sequences))
        self.order = np.argsort(-n, kind="stable")
        self.lengths = n[self.order]
        self.at = np.append(0, np.cumsum(np.searchsorted(-self.lengths, -np.arange(self.lengths[0]), side="left")))
        which = np.repeat(np.arange(len(n)), self.lengths)
        time = np.arange(len(which)) - np.repeat(np.append(0, np.cumsum(self.lengths)[:-1]), self.lengths)
        self.symbols = np.empty(len(which), np.int64)
        self.symbols[self.at[time] + which] = np.concatenate([sequences[i] for i in self.order])

    def pieces(self, tokens: int) -> list[tuple[int, int]]:
        """Spans of time with so many tokens at most, or of one step."""
        cuts = [0]
        while cuts[-1] < self.lengths[0]:
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(self.at, self.at[cuts[-1]] + tokens, "right")) - 1))
        return list(zip(cuts, cuts[1:]))

    def ends(self, a: int, b: int) -> np.ndarray:
        """Sequences whose last token lies in a span of time."""
        return np.flatnonzero((self.lengths > a) & (self.lengths <= b))


def forward(model: Hmm, s: Sequences, a: int, b: int, before: np.ndarray | None, logs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forward messages and emission probabilities of the times a to b - 1; before is the message
    at a - 1. What scaling takes out is added to logs, by sequence."""
    base = s.at[a]
    likely = model.emit[s.symbols[base : s.at[b]]]
    alpha = np.empty_like(likely)
    bounds = (s.at[a : b + 1] - base).tolist()
    for t, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        now = alpha[lo:hi]
        if before is None:
            np.multiply(model.start, likely[lo:hi], out=now)
        else:
            np.matmul(before[: hi - lo], model.move, out=now)
            now *= likely[lo:hi]
        if t % RESCALE == RESCALE - 1 or hi == bounds[-1]:
            scale = now.sum(1)
            now /= scale[:, None]
            if logs is not None:
                logs[: hi - lo] += np.log(scale)
        before = now
    return alpha, likely


def likelihoods(model: Hmm, s: Sequences, tokens: int = BATCH_TOKENS) -> tuple[np.ndarray, list[np.ndarray | None], tuple]:
    """Natural log-likelihood of each sequence, the message that enters each piece, and the last piece's messages."""
    logs, before, entering, alpha, likely = np.zeros(len(s.order)), None, [], None, None
    for a, b in s.pieces(tokens):
        entering.append(before)
        alpha, likely = forward(model, s, a, b, before, logs)
        ended = s.ends(a, b)
        logs[ended] += np.log(alpha[s.at[s.lengths[ended] - 1] - s.at[a] + ended].sum(1))
        before = alpha[s.at[b - 1] - s.at[a] :]
    return logs, entering, (alpha, likely)


def expected_counts(model: Hmm, sequences: list[np.ndarray], counts: Counts, tokens: int = BATCH_TOKENS) -> None:
    """Add the expected counts of whole sequences."""
    s = Sequences(sequences)
    logs, entering, last = likelihoods(model, s, tokens)
    counts.likelihood += float(logs.sum())
    ahead_of_end, pair = np.empty((0, len(model.start))), np.zeros_like(model.move)
    back = np.ascontiguousarray(model.move.T)
    for a, b in reversed(s.pieces(tokens)):
        before = entering.pop()
        alpha, likely = last or forward(model, s, a, b, before)
        last = None
        bounds, ahead, nxt = (s.at[a : b + 1] - s.at[a]).tolist(), np.zeros_like(alpha), ahead_of_end
        beta = np.empty((bounds[1], len(model.start)))
        for t in range(b - a - 1, -1, -1):
            lo, hi = bounds[t], bounds[t + 1]
            m, now = len(nxt), beta[: hi - lo]
            ahead[lo : lo + m] = nxt
            np.matmul(nxt, back, out=now[:m])
            now[m:] = 1.0
            if t % RESCALE == 0:
                now /= now.max(1, keepdims=True)
            nxt = likely[lo:hi] * now
        # per token the same messages again, at any scale: the state's share, and that of each move to the next token
        shares = ahead @ back
        ended = s.ends(a, b)
        shares[s.at[s.lengths[ended] - 1] - s.at[a] + ended] = 1.0
        shares *= alpha
        whole = shares.sum(1, keepdims=True)
        shares /= whole
        ahead /= whole
        pair += alpha.T @ ahead
        symbols = s.symbols[s.at[a] : s.at[b]]
        for k in range(len(model.start)):
            counts.emit[:, k] += np.bincount(symbols, shares[:, k], len(counts.emit))
        if a == 0:
            counts.start += shares[: bounds[1]].sum(0)
        ahead_of_end = nxt
    counts.move += pair * model.move


def batched(sequences: list[np.ndarray], tokens: int = BATCH_TOKENS) -> Iterator[list[int]]:
    """Places of sequences that run side by side: of similar length, about so many tokens together."""
    held, size = [], 0
    for i in sorted(range(len(sequences)), key=lambda i: -len(sequences[i])):
        if held and size + len(sequences[i]) > tokens:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(sequences[i])
    if held:
        yield held


def symbol_sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2") for x in column]


def baum_welch_step(coded: DataFrame, model: Hmm, frequency: np.ndarray) -> tuple[Hmm, float]:
    """One round over all rows of coded; the new model and the log-likelihood under the old one."""
    spark, states, n = coded.sparkSession, len(model.start), len(model.emit)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, counts = shared.value, Counts(states, n)
        for batch in batches:
            found = symbol_sequences(batch.column(0))
            for together in batched(found):
                expected_counts(m, [found[i] for i in together], counts)
        some = np.flatnonzero(counts.emit.sum(1))
        # symbols from 0; moves out of state k as -1-k; starts at -1-states; the likelihood below that
        at = np.concatenate([some, -1 - np.arange(states), [-1 - states, -2 - states]])
        values = np.concatenate([counts.emit[some], counts.move, counts.start[None], np.full((1, states), counts.likelihood)]).astype(np.float32)
        columns = [pa.array(at.astype(np.int32)), *(pa.array(values[:, k].copy()) for k in range(states))]
        yield pa.RecordBatch.from_arrays(columns, names=["symbol", *(f"c{k}" for k in range(states))])

    columns = [f"c{k}" for k in range(states)]
    counted = map_arrow(coded.select("symbols"), run, "symbol int, " + ", ".join(f"{c} float" for c in columns))
    rows = counted.groupBy("symbol").agg(*(F.sum(F.col(c).cast("double")).alias(c) for c in columns)).toArrow()
    shared.unpersist()
    at = rows.column("symbol").to_numpy()
    values = np.stack([rows.column(c).to_numpy() for c in columns], 1) if len(at) else np.zeros((0, states))
    counts = Counts(states, n)
    counts.emit[at[at >= 0]] = values[at >= 0]
    special = {int(a): values[i] for i, a in enumerate(at) if a < 0}
    zero = np.zeros(states)
    counts.move = np.stack([special.get(-1 - k, zero) for k in range(states)])
    counts.start, counts.likelihood = special.get(-1 - states, zero), float(special.get(-2 - states, zero)[0])
    return Hmm.estimated(counts, frequency), counts.likelihood


def start_model(sample: list[np.ndarray], frequency: np.ndarray, states: int) -> Hmm:
    model = Hmm.initial(len(frequency), states, frequency)
    for _ in range(START_ROUNDS if sample else 0):
        counts = Counts(states, len(frequency))
        for together in batched(sample):
            expected_counts(model, [sample[i] for i in together], counts)
        model = Hmm.estimated(counts, frequency)
    return model


def log10_likelihoods(model: Hmm, sequences: list[np.ndarray], tokens: int = BATCH_TOKENS) -> np.ndarray:
    """Of whole sequences, side by side; they leave as they end."""
    out = np.zeros(len(sequences))
    for together in batched(sequences, tokens):
        s = Sequences([sequences[i] for i in together])
        out[np.array(together)[s.order]] = likelihoods(model, s, tokens)[0] / np.log(10)
    return out


def score_documents(coded: DataFrame, model: Hmm) -> DataFrame:
    """row, and chain: the log10 likelihood of its symbols."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            chain_ = log10_likelihoods(m, symbol_sequences(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(chain_)], names=[*batch.schema.names[1:], "chain"])

    passed = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, rare double"
    return map_arrow(coded.select("symbols", "row", "doc_id", "held_out", "n_tokens", "n_known", "base", "rare"), run, f"{passed}, chain double")


def model_of(docs: DataFrame, states: int, iterations: int, symbols: int, counted: int) -> tuple[Lexicon, Hmm, DataFrame, DataFrame]:
    """The lexicon, the trained model, the coded texts and the counts of all training words, for rows (doc_id, held_out, text)."""
    counts = materialize(count_words(docs.where("not held_out").select("text")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts, counted).toArrow()
    lexicon = Lexicon(top.column("word").to_numpy(), top.column("c").to_numpy(), int(total), int(distinct), symbols)
    coded = materialize(code(docs, lexicon), "coded")

    frequency = np.zeros(lexicon.n_symbols)
    np.add.at(frequency, lexicon.symbols, lexicon.counts)
    frequency[RARE] = max(lexicon.rare_total, SMOOTHING)
    frequency = (frequency + SMOOTHING) / (frequency + SMOOTHING).sum()
    training = coded.where("not held_out")
    share = min(1.0, START_TOKENS / max(1, total))
    sample = training.where(F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(1 << 30)) < share * (1 << 30)).select("symbols").toArrow()
    model = start_model(symbol_sequences(sample.column(0)), frequency, states)
    for _ in range(iterations):
        model, _ = baum_welch_step(training, model, frequency)
    return lexicon, model, coded, counts


def hmm_scores(df: DataFrame, held_out, states: int = STATES, iterations: int = ITERATIONS, symbols: int = SYMBOLS, counted: int = COUNTED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are their end token alone. Null ids are kept; rows that repeat an id
    are scored each by its own text. Without a training row all words are unknown and the model
    is uniform over its two symbols. Other columns are ignored."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    lexicon, model, coded, counts = model_of(docs, states, iterations, symbols, counted)
    far = coded.where(F.size("far") > 0).select("row", F.explode(F.arrays_zip("far", "far_n")).alias("x")).select("row", F.col("x.far").alias("word"), F.col("x.far_n").alias("n"))
    log = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTHING))
    told = far.join(counts, "word", "left").groupBy("row").agg(F.sum(log).alias("far_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("far_known"))
    zero = F.coalesce("far_log", F.lit(0.0))
    return score_documents(coded, model).join(told, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero).alias("base_score"),
        (F.col("chain") + F.col("rare") + zero).alias("score"),
    )


def op8_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(documents(spark, sf_dir), fold("doc_id", 5) == 1)


QUERIES = {"op8_hmm_score": op8_hmm_score}
