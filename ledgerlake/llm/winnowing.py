"""Document fingerprints by winnowing; DataFrame functions only.

A text's tokens are its runs of non-white-space of at most TOKEN characters; of longer runs, as
text without spaces has them, each code point is a token, so grams stand at every offset. The hashes
of GRAM consecutive tokens are a cyclic polynomial's: each token's hash, rotated by how many tokens
follow it in the gram, all of them xor-ed. It rolls over the text in whole arrays: hashes of two
tokens come from those of one, those of four from those of two, those of five by one token more, so
no gram is hashed afresh. Of each
WINDOW consecutive hashes the smallest is chosen, the rightmost where several are equal, and
its position is kept. Two texts that share GRAM + WINDOW - 1 consecutive tokens share a whole
window of hashes, so they share a chosen hash, whatever surrounds the passage; positions say
where it stands in each. Texts with fewer tokens than a gram have one hash over all of them,
those with fewer hashes than a window choose once, and a text without tokens has none.

A hash keeps HASH_BITS bits and is packed above the complement of its position, so that the
minimum of plain integers is the smallest hash with the rightmost position. The window
minimum doubles its reach in log2(WINDOW) steps over whole arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import discard, documents, materialize

TOKEN, GRAM, WINDOW = 16, 5, 16
HASH_BITS, PLACE_BITS = 39, 24
_LAST = (1 << PLACE_BITS) - 1
#: Documents that stand together while each looks up the next one, if that makes MOST_PLACES places at most.
NEIGHBOURS, MOST_PLACES = 256, 1 << 18


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value evaluated once per row."""
    return F.transform(F.array(value), f).getItem(0)


def tokens(text: Column) -> Column:
    ink = r"[^\x20\x09-\x0D]"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?<!{ink}){ink}{{1,{TOKEN}}}+(?!{ink})|{ink}"), F.lit(0))


def _packed(h: Column, at: Column) -> Column:
    """Hash above position; the position of a text beyond 2**24 tokens wraps, its hash does not."""
    place = F.lit(_LAST) - (at.cast("long").bitwiseAND(F.lit(_LAST)))
    return F.shiftleft(F.shiftrightunsigned(h, 64 - HASH_BITS), PLACE_BITS).bitwiseOR(place)


def _rotated(h: Column, n: int) -> Column:
    return F.shiftleft(h, n).bitwiseOR(F.shiftrightunsigned(h, 64 - n))


def _rolled(h: Column, size: int = GRAM) -> Column:
    """Cyclic polynomial hashes of size consecutive elements of an array that has so many at least."""

    def beside(left: Column, right: Column, before: int, after: int) -> Column:
        """Of before + after elements, from hashes of the first and of the others."""
        n = F.size(right) - before
        return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(before + 1), n), lambda a, b: _rotated(a, after).bitwiseXOR(b))

    def grown(g: Column, reach: int) -> Column:
        if reach == size:
            return g
        if 2 * reach <= size:
            return let(beside(g, g, reach, reach), lambda x: grown(x, 2 * reach))
        return let(beside(g, h, reach, 1), lambda x: grown(x, reach + 1))

    return grown(h, 1)


def _grams(words: Column) -> Column:
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        short = F.array(_packed(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")), F.lit(0)))
        whole = F.transform(_rolled(h), _packed)
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < GRAM, short).otherwise(whole)

    return let(hashed, of)


def _window_minima(grams: Column) -> Column:
    def widen(m: Column, step: int) -> Column:
        return F.zip_with(F.slice(m, F.lit(1), F.greatest(F.size(m) - step, F.lit(0))), F.slice(m, F.lit(step + 1), F.greatest(F.size(m) - step, F.lit(0))), lambda a, b: F.least(a, b))

    def over(m: Column, reach: int = 1) -> Column:
        return m if reach == WINDOW else let(widen(m, reach), lambda x: over(x, 2 * reach))

    def choose(g: Column) -> Column:
        few = F.when(F.size(g) == 0, g).otherwise(F.array(F.array_min(g)))
        return F.when(F.size(g) <= WINDOW, few).otherwise(F.array_distinct(over(g)))

    return let(grams, choose)


def fingerprint(text: Column) -> Column:
    """Chosen (hash, position) pairs, packed, in text order."""
    return _window_minima(_grams(tokens(text)))


def hashes(packed: Column) -> Column:
    return F.array_distinct(F.transform(packed, lambda x: F.shiftrightunsigned(x, PLACE_BITS)))


def readable(packed: Column) -> Column:
    """'hash@position' in text order."""
    one = lambda x: F.concat(F.lower(F.hex(F.shiftrightunsigned(x, PLACE_BITS))), F.lit("@"), (F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST))).cast("string"))
    return F.array_join(F.transform(packed, one), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def neighbourhoods(keys: DataFrame, size: int = NEIGHBOURS) -> tuple[Callable[[DataFrame], DataFrame], int]:
    """What adds the place of its key (struct of doc_id, text_hash) to each row, places being in the
    order of keys, and the number of places; a place has size distinct keys, more where there would be over MOST_PLACES. The keys, and no texts,
    are sorted for it, so the places are even however the ids lie; the first keys of the places,
    16 bytes each, are looked up in two steps."""
    distinct = keys.select("key").distinct()
    ordered = materialize(distinct.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "keys")
    n = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()}
    size, before, start = max(size, -(-sum(n.values()) // MOST_PLACES)), 0, []
    for part in sorted(n):
        start.append((part, before))
        before += n[part]
    starts = F.broadcast(ordered.sparkSession.createDataFrame(start, "part int, before long"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    firsts = ordered.join(starts, "part").select("key", rank.alias("rank")).where((F.col("rank") > 0) & (F.col("rank") % size == 0))
    places = -(-before // size)
    wide = max(1, int(places**0.5))
    groups = firsts.groupBy(F.floor((F.col("rank") / size - 1) / wide).alias("g")).agg(F.sort_array(F.collect_list("key")).alias("keys"))
    index = materialize(groups.agg(F.transform(F.sort_array(F.collect_list(F.struct("g", "keys"))), lambda x: x["keys"]).alias("groups")), "places")
    discard(ordered)

    def placed(df: DataFrame) -> DataFrame:
        found, key = F.col("__groups"), F.col("key")
        group = F.coalesce(F.size(F.filter(found, lambda g: F.get(g, F.lit(0)) <= key)), F.lit(0)) - 1
        place = F.when(group < 0, 0).otherwise(group * wide + F.size(F.filter(F.get(found, F.greatest(group, F.lit(0))), lambda b: b <= key)))
        return df.withColumn("__groups", index.scalar()).withColumn("place", place.cast("int")).drop("__groups")

    return placed, places


def with_next(df: DataFrame, columns: list[str], make: Callable[[DataFrame], DataFrame] = lambda x: x, size: int = NEIGHBOURS) -> DataFrame:
    """make(df) with next_<column> of the row that follows by doc_id; the last is followed by the first.
    Rows without an id come first, rows that repeat one in the order of a hash of their texts; rows that
    repeat both stand in one place, however many they are.

    Rows are dealt by neighbourhoods of ids, so texts shuffle once, and make, which adds columns by row,
    is evaluated once a row: the rows that begin a neighbourhood are found before, and the last row of
    each takes the first one of the next, which a join by place brings."""
    key = F.struct("doc_id", F.xxhash64("text").alias("text_hash"))
    placed, places = neighbourhoods(df.select(key.alias("key")), size)
    at = F.row_number().over(Window.partitionBy("place").orderBy("key"))
    keyed = placed(df.withColumn("key", key))
    heads = keyed.withColumn("at", at).where("at = 1").select("place", *df.columns)
    firsts = materialize(make(heads).select(F.pmod(F.col("place") - 1, F.lit(max(1, places))).cast("int").alias("place"), *(F.col(c).alias(f"first_{c}") for c in columns)), "firsts")
    near = Window.partitionBy("place").orderBy("key")
    made = make(keyed)
    marked = made.withColumns({f"next_{c}": F.lead(c).over(near) for c in columns} | {"is_last": F.lead(F.lit(True)).over(near).isNull()})
    # rows lie by place already, so the join moves nothing but the few first ones
    after = {f"next_{c}": F.when(F.col("is_last"), F.col(f"first_{c}")).otherwise(F.col(f"next_{c}")) for c in columns}
    return marked.join(firsts, "place", "left").withColumns(after).drop("key", "place", "is_last", *(f"first_{c}" for c in columns))


def edited(text: Column, follower: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the follower."""
    n = F.length(text)
    tail = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - tail), F.substring(follower, F.lit(1), tail))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (packed pairs) of every row; null text is empty."""
    return df.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fingerprint"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(docs, ["text", "chosen"], lambda x: x.withColumn("chosen", fingerprint(F.col("text")))).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    both = both.withColumn("edited_chosen", fingerprint(F.col("edited")))
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        readable(F.col("chosen")).alias("fingerprint"),
        readable(F.col("edited_chosen")).alias("edited_fingerprint"),
        likeness(hashes(F.col("chosen")), hashes(F.col("edited_chosen"))).alias("near_edited"),
        likeness(hashes(F.col("chosen")), hashes(F.col("next_chosen"))).alias("near_next"),
    )


QUERIES = {"op7_winnowing": op7_winnowing}
