"""Exact dedup by two passes over a Bloom filter; DataFrame functions only.

A text's hash names one 64-bit word of the filter and two bits in it. Pass 1 counts, by word,
how often each pair of bits was hit and keeps the bits that more than one row hit: what
shuffles for it is a word and its bits, once for each distinct hash of a task, and neither
ids nor texts. Pass 2 tests each hash against those bits: one that has a bit which no other row hit
is unique, and its row passes straight through. Only the rest, the repeated ones and a few
false alarms, shuffle, and they are settled by their full SHA-256.

The filter has BITS_PER_ROW bits for every row at least, so about one unique row in fifty is a
false alarm whatever the number of rows (false_alarms). It is dealt into ranges of the hash with
RANGE_BITS bits at most: only one range's filter, an array in a scalar subquery, is sent to the
tasks at a time, and pass 2 goes over the narrow hashes once for each range.

Counts are pre-aggregated on the map side, so a group of copies that holds a third of all
rows arrives as one row per task; the join that hands its verdict back is an equi-join of
narrow rows, which adaptive execution splits where a key is hot. Texts are joined by id and hash
together, so a group of copies is no hot key there."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ledgerlake.llm.common import discard, documents, few, materialize, scratch_path, unused

BITS_PER_ROW = 16
#: Bits of one range's filter: 16 MB.
MIN_BITS, RANGE_BITS = 1 << 16, 1 << 27


def normalized(text: Column) -> Column:
    """Each run of space, tab, line feed, vertical tab, form feed and return as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_hash(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def filter_shape(rows: int, most: int = RANGE_BITS) -> tuple[int, int]:
    """(ranges, 64-bit words of each) of the filter for so many rows."""
    bits = MIN_BITS
    while bits < min(rows * BITS_PER_ROW, most):
        bits *= 2
    return max(1, math.ceil(rows * BITS_PER_ROW / bits)), bits >> 6


def false_alarms(rows: int, shape: tuple[int, int]) -> float:
    """The expected share of unique rows that do not pass straight through: each of the other rows of
    a word, in number about Poisson's, has set two of its 64 bits."""
    mean, out, p = rows / (shape[0] * shape[1]), 0.0, 0.0
    for k in range(int(mean + 12 * math.sqrt(mean) + 40)):
        p = math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) if mean else float(k == 0)
        hit = 1 - (1 - 1 / 64) ** (2 * k)
        out += p * hit * hit
    return out


def _place(digest: Column, shape: tuple[int, int]) -> tuple[Column, Column, Column]:
    """The range, the word in it and the bits of a hash, from separate parts of 64 bits."""
    h = F.xxhash64(digest)
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int"))
    part = F.pmod(F.shiftrightunsigned(h, 24).bitwiseAND(F.lit((1 << 28) - 1)), F.lit(shape[0])).cast("int")
    return part, F.pmod(h, F.lit(shape[1])).cast("int"), bit(52).bitwiseOR(bit(58))


def repeated_filter(hashes: DataFrame, shape: tuple[int, int], digest: str = "text_sha256") -> DataFrame:
    """(part, word, bits): the bits that more than one row hit, of the words that have any."""
    part, word, bits = _place(F.col(digest), shape)
    hits = hashes.select(part.alias("part"), word.alias("word"), bits.alias("bits")).groupBy("part", "word", "bits").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    # a word has at most 64 * 65 / 2 different pairs of bits
    seen = F.aggregate(
        F.collect_list(F.struct("bits", "n")),
        F.struct(zero.alias("once"), zero.alias("more")),
        lambda a, x: F.struct(a["once"].bitwiseOR(x["bits"]).alias("once"), a["more"].bitwiseOR(a["once"].bitwiseAND(x["bits"])).bitwiseOR(F.when(x["n"] > 1, x["bits"]).otherwise(zero)).alias("more")),
        lambda a: a["more"],
    )
    return hits.groupBy("part", "word").agg(seen.alias("bits")).where("bits <> 0")


def range_filter(words: DataFrame, part: int, shape: tuple[int, int]) -> DataFrame:
    """One row, one column: the words of one range as an array."""
    empty = words.sparkSession.range(shape[1]).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    every = words.where(F.col("part") == part).select("word", "bits").unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))


def maybe_repeated(hashes: DataFrame, digest: str = "text_sha256", shape: tuple[int, int] | None = None) -> DataFrame:
    """The rows with maybe: false if no other row has their hash. Written, range by range."""
    shape = shape or filter_shape(hashes.count())
    words, path = materialize(repeated_filter(hashes, shape, digest), "filter"), scratch_path(hashes.sparkSession, "marked")
    part, word, bits = _place(F.col(digest), shape)
    for i in range(shape[0]):
        own = materialize(range_filter(words, i, shape), "range")
        maybe = F.get(own.scalar(), word).bitwiseAND(bits) == bits
        hashes.where(part == i).withColumn("maybe", maybe).write.mode("append").parquet(path)
        discard(own)
    discard(words)
    out = hashes.sparkSession.read.schema(StructType([*hashes.schema.fields, StructField("maybe", BooleanType())])).parquet(path)
    out._scratch = path
    return out


def hash_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return materialize(df.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_sha256")), "hashes")


def find_copies(hashes: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, text_sha256) -> one row per input row with keep_id, group_size and kept.

    keep_id is the smallest non-null id of the group (null if it has none); a null id is kept
    only where all of its group are null. Rows that repeat a kept id are all marked kept and
    counted in group_size; drop_copies then leaves one of them. Empty texts are one group."""
    marked = maybe_repeated(hashes, shape=shape)
    alone = marked.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    some = marked.where("maybe").drop("maybe")
    # written, so that the join shuffles both sides itself and can split a hot group's rows
    groups = materialize(some.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    settled = some.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionByName(settled)


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: tuple[int, int] | None = None) -> DataFrame:
    """The rows that stay, all their columns: of equal texts the one with the smallest id (a null id
    stays only if all are null), and one of those that repeat that id. Whatever the columns are called.

    The documents that go are known by id and hash, and joined away by both; if they are few, texts do
    not shuffle. Only rows that repeat id and text, should there be any, are grouped with their texts."""
    hashes = hash_texts(df, id_col, text_col)
    marked = maybe_repeated(hashes, shape=shape)
    digest = F.unhex("text_sha256").alias("digest")
    pairs = materialize(marked.where("maybe").groupBy(F.col("doc_id").alias("id"), digest).agg(F.count("*").alias("n")), "pairs")
    keep = materialize(pairs.groupBy("digest").agg(F.min("id").alias("keep")), "keep")
    judged = pairs.join(keep, "digest").select("id", "digest", "n", F.col("id").eqNullSafe(F.col("keep")).alias("stays"))
    judged = materialize(judged, "judged")
    gone, twins = judged.where("not stays").select("id", "digest"), judged.where("stays and n > 1").select("id", "digest")
    discard(hashes, marked, pairs, keep)
    sha = unused(df, "sha")
    work = df.withColumn(sha, F.unhex(text_hash(F.col(text_col))))

    def without(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        there = (F.broadcast(ids) if few(ids) else ids).alias("ids")
        return rows.join(there, rows[id_col].eqNullSafe(F.col("ids.id")) & (rows[sha] == F.col("ids.digest")), how)

    left = without(work, gone, "left_anti")
    if not twins.isEmpty():
        one = without(left, twins, "left_semi").dropDuplicates([sha])
        left = without(left, twins, "left_anti").unionByName(one)
    return left.select(*(F.col(f"`{c}`") for c in df.columns))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(hash_texts(documents(spark, sf_dir)))


ORACLE = r"""
with h as (
    select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
), g as (
    select text_sha256, min(doc_id) as keep_id, count(*) as group_size from h group by text_sha256
)
select h.doc_id, g.keep_id, g.group_size, h.doc_id = g.keep_id as kept, h.text_sha256
from h join g using (text_sha256)
"""

QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLES = {"op2_exact_dedup": ORACLE}
