"""Token counts by a unigram model, with the dynamic programme shared along a trie.

A text is cut into pre-tokens: runs of bytes outside 0x20 and 0x09-0x0D, as all operators here cut
words, each led by the word mark. Distinct
pre-tokens of a task are inserted in a trie of their characters. A node stands for a prefix
and holds the forward score of the prefix's best segmentation into vocabulary pieces and the
number of its tokens; both depend on the prefix alone, so pre-tokens with a common prefix
compute them once. The node where a pre-token ends has its terminal count.

Pieces come from a public vocabulary file. That vocabulary has ranks, not probabilities, so a
piece of rank r gets the Zipf log-probability -ln(r + 1) - ln(H), H the harmonic number of the
vocabulary's size. A character that no piece covers costs its UTF-8 bytes, one byte token
each, at the score of the last rank and a PENALTY. Of equally good segmentations the one
whose last piece is longest counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import TEXTS, chunks, documents, kept, map_arrow, numbered_words, table_batch

MARK = "▁"
PENALTY = 10.0
#: Nodes of a worker's trie, and distinct pre-tokens kept; at either bound both start anew.
MAX_NODES, MAX_WORDS = 1_500_000, 500_000
#: A pre-token longer than this is scored by itself and leaves no nodes behind.
LONG_WORD = 48

COUNTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_pretokens", pa.int64()), ("n_chars", pa.int64()), ("score", pa.float64())])


class Vocabulary:
    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.floor = min(scores.values(), default=0.0) - PENALTY
        #: piece reversed, as a tree of dicts: all pieces that end at a place are found in one walk back
        self.tree: dict = {}
        for piece, score in scores.items():
            at = self.tree
            for c in reversed(piece):
                at = at.setdefault(c, {})
            at[None] = score

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        norm = math.log(math.fsum(1 / (r + 1) for r in range(size)))
        plain = (i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
        return cls({model.id_to_piece(i): -math.log(i + 1) - norm for i in plain})


class Trie:
    """Nodes are numbers; child has a node's child by a character, best and tokens the score and
    the length of the best segmentation of a node's prefix. Node 0 is the empty prefix."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.reset()

    def reset(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]
        #: by pre-token: the terminal count and score
        self.count_of: dict[str, int] = {}
        self.score_of: dict[str, float] = {}

    def insert(self, word: str) -> None:
        """Walk a pre-token down the trie, scoring the prefixes that no other one had."""
        child, best, tokens, tree, floor = self.child, self.best, self.tokens, self.vocabulary.tree, self.vocabulary.floor
        text, path, node, size = MARK + word, [0], 0, len(best)
        for end, c in enumerate(text):
            key = node << 21 | ord(c)
            found = child.get(key)
            if found is None:
                width = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
                top, n, k, at = best[node] + floor * width, tokens[node] + width, end, tree
                while k >= 0 and (at := at.get(text[k])) is not None:
                    score = at.get(None)
                    if score is not None:
                        before = path[k]
                        total = best[before] + score
                        if total >= top:
                            top, n = total, tokens[before] + 1
                    k -= 1
                found = child[key] = len(best)
                best.append(top)
                tokens.append(n)
            path.append(found)
            node = found
        self.count_of[word], self.score_of[word] = tokens[node], best[node]
        if len(word) > LONG_WORD:  # take the nodes of a long pre-token away again
            for end, c in enumerate(text):
                if path[end + 1] >= size:
                    del child[path[end] << 21 | ord(c)]
            del best[size:], tokens[size:]

    def learn(self, words: set[str]) -> None:
        """Give all these pre-tokens a terminal; those of earlier calls may go."""
        if len(self.best) >= MAX_NODES or len(self.count_of) >= MAX_WORDS:
            self.reset()
        for word in sorted([w for w in words if w not in self.count_of]):
            self.insert(word)

    def count(self, word: str) -> tuple[int, float]:
        """Tokens and score of a pre-token."""
        self.learn({word})
        return self.count_of[word], self.score_of[word]


OWNER = "trie"


def trie(path: str) -> Trie:
    """One per worker; what it has scored serves all tasks of the operator."""
    return kept(OWNER, path, lambda: Trie(Vocabulary.from_file(path)))


def count_tokens(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_pretokens, n_chars, score (natural log of the best segmentation).

    One row per input row, null and repeated ids included; null and empty texts, and texts of
    white space alone, have no token and score 0. Other columns are ignored."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = trie(model)
        for batch in chunks(batches, TEXTS, OWNER):
            distinct, number, bounds = numbered_words(batch.column(1), lower=False)
            words, n = [x.decode() for x in distinct], np.diff(bounds)
            shared.learn(set(words))
            of = np.repeat(np.arange(len(n)), n)
            tokens, scores = np.array([shared.count_of[x] for x in words], float), np.array([shared.score_of[x] for x in words], float)
            sums = [np.bincount(of, x[number], len(n)) for x in (tokens, scores)]
            chars = pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64())
            yield table_batch(COUNTS, doc_id=batch.column(0), n_tokens=sums[0].astype(np.int64), n_pretokens=n, n_chars=chars, score=sums[1])

    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), score, "doc_id long, n_tokens long, n_pretokens long, n_chars long, score double")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op10_token_counts": op10_token_counts}
