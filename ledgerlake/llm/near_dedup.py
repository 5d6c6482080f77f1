"""Near duplicates by minhash with tensored banding, every link verified on full shingle sets.

A document's set is its distinct 5-word shingles. Two collections of COLLECTION partial keys
are computed, each partial key a concatenation of WIDTH minhashes; a table key is one partial
key of the first collection with one of the second. COLLECTION**2 tables cost 2 * COLLECTION *
WIDTH minhashes in place of COLLECTION**2 * 2 * WIDTH. Two sets of similarity s meet in a table
with probability (1 - (1 - s**WIDTH)**COLLECTION)**2: 0.9997 at 0.75, 0.99997 at 0.8.

Partial keys that no other class has cannot make a common table key, so they are dropped
before keys are paired; documents without near copies then form no table key at all.

1. Documents with equal sets form a class, by a 128-bit hash of the set. A class has a short name
   (rep), the hash's first 60 bits; classes that would share a name get numbers below 0 in its
   place, so names are unique. Copies never meet as pairs.
2. Star rounds: in each table, the members are compared with one of them, first the smallest
   rep, then the first by a hash that changes with the round. A large group of near copies
   links up in a few comparisons per member.
3. For tables that still hold several components, each member's shingles that other such
   members have are counted. A link needs PERCENT of a set shared, and no two sets have more in
   common than the lesser of their counts of frequent shingles and the rare ones that both have.
   This rules out members and pairs exactly: a heavily edited copy is not compared with the
   thousands that it resembles too little.
4. What is left in a table is its crowd, the component with the most members, and the others. Only
   the others meet all members, cut into blocks of BLOCK by a hash; members of the crowd do not meet
   each other, so a table costs its others times its members, not the square of its members. Of the
   pairs, those of different components that can be linked are kept, each in the first table that it
   shares, and compared in PORTIONS; a pair whose components have become one meanwhile is left out.
   So every candidate pair is settled: by a comparison, by a bound, or by being in one component.
The rows of tables are written once with their bounds; components that merge later are renamed where
rows are read, so rows are not written again for each round.
Comparisons are joins of narrow pairs with the sets of the documents that have candidates;
links are contracted to components by repeated minimum-label hooking. All joins are
equi-joins on hashed keys, and all intermediate tables are written to the shared folder. What a
late round brings is little: its pairs, merged components and the tables with several components are
broadcast where they are counted and few, so that sets and rows do not shuffle for them; beyond that
the same joins shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import TEXTS, chunks, discard, documents, few, map_arrow, materialize, mix, word_hashes

SHINGLE = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
COLLECTION, WIDTH = 16, 3
BLOCK = 64
#: Shingles that so many open members have at most are compared one by one, if a member has so many at most.
RARE, MOST_RARE = 16, 256
#: Star rounds after the first.
STARS = 3
#: Sixteenths of the pairs that are left after them, by a hash: from and below.
PORTIONS = ((0, 1), (1, 4), (4, 16))

_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(h: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, from the word hashes of all and where each
    text's begin. Fewer words than size are one shingle; no words, none."""

    def of(width: int, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            out = out * _P + h[i : len(h) - width + 1 + i]
            out ^= out >> np.uint64(29)
        return mix(out)

    every = of(size, h) if len(h) >= size else h
    ends = bounds.tolist()
    return [np.unique(every[a : b - size + 1]) if b - a >= size else of(b - a, h[a:b]) if b > a else h[:0] for a, b in zip(ends, ends[1:])]


def hash_family(n: int = 2 * COLLECTION * WIDTH) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240517)
    return (rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1))[:, None], rng.integers(0, 1 << 32, n, np.uint32)[:, None]


def partial_keys(s: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The 2 * COLLECTION partial keys of a set as signed 64-bit integers."""
    a, b = family
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        low = np.minimum(low, (x[at : at + 1024] * a + b).min(axis=1))
    key = np.arange(2 * COLLECTION, dtype=np.uint64)
    for column in low.reshape(2 * COLLECTION, WIDTH).T.astype(np.uint64):
        key = mix(key * _P + column + np.uint64(1))
    return key.view(np.int64)


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hash (null for empty sets), keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = hash_family()
        for batch in chunks(batches, TEXTS):
            size, digest, keys = [], [], []
            for s in shingle_sets(*word_hashes(batch.column(2))):
                size.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(partial_keys(s, family) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n_shingles", "set_hash", "keys"])

    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")), sign, "doc_id long, text_hash long, n_shingles long, set_hash binary, keys array<long>")


def full_sets(df: DataFrame) -> DataFrame:
    """(rep, shingles) for rows (rep, set_hash, text); rows whose text has another set go."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, TEXTS):
            made = shingle_sets(*word_hashes(batch.column(2)))
            right = [xxhash.xxh3_128_digest(s.tobytes()) == x for s, x in zip(made, batch.column(1).to_pylist())]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in made], pa.list_(pa.int64()))], names=["rep", "shingles"])
            yield out.filter(pa.array(right, pa.bool_()))

    return map_arrow(df, sets, "rep long, shingles array<long>")


def table_keys(reps: DataFrame) -> DataFrame:
    """(key, place, rep, n, members) of all tables with at least two members, from (rep, n, keys);
    place is COLLECTION * i + j for the i-th partial key of one collection and the j-th of the other."""
    partial = reps.select("rep", "n", F.posexplode("keys").alias("at", "part"))
    shared = partial.groupBy("part").agg(F.count("*").alias("c")).where("c > 1").select("part")
    live = partial.join(shared, "part", "left_semi")
    side = lambda first: F.collect_list(F.when(F.col("at") < COLLECTION if first else F.col("at") >= COLLECTION, F.struct("at", "part")))
    sides = live.groupBy("rep", "n").agg(side(True).alias("u"), side(False).alias("v")).where("size(u) > 0 and size(v) > 0")
    each = sides.select("rep", "n", "v", F.explode("u").alias("p")).select("rep", "n", "p", F.explode("v").alias("q"))
    place = (F.col("p.at") * COLLECTION + F.col("q.at") - COLLECTION).cast("short")
    keyed = materialize(each.select("rep", "n", F.xxhash64("p.part", "q.part").alias("key"), place.alias("place")), "keys")
    full = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    out = materialize(keyed.join(full, "key").select("key", "place", "rep", "n", "members"), "tables")
    discard(keyed)
    return out


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked. If they are few, only their members' sets shuffle."""
    if few(pairs):
        members = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
        sets = sets.join(F.broadcast(members), "rep", "left_semi")
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb")).alias("t"))
    return both.where(F.col("c") * 100 >= (F.col("t") - F.col("c")) * PERCENT).select("a", "b")


def contract(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rep, comp) after joining components along the links (a, b), comp being the smallest member;
    and the components (comp, to) that have gone into others, None if there are none.

    Each step hooks every component to its smallest neighbour and relabels what is left of the
    links, so a star of any size takes one step and the rest shrinks like a forest."""
    first, owned = labels, False
    while not links.isEmpty():
        la = labels.select(F.col("rep").alias("a"), F.col("comp").alias("ca"))
        lb = labels.select(F.col("rep").alias("b"), F.col("comp").alias("cb"))
        edges = materialize(links.join(la, "a").join(lb, "b").where("ca <> cb").select(F.greatest("ca", "cb").alias("hi"), F.least("ca", "cb").alias("lo")).distinct(), "edges")
        if edges.isEmpty():
            discard(edges)
            break
        hook = materialize(edges.groupBy("hi").agg(F.min("lo").alias("to")), "hook")
        for _ in range(2):
            onward, short = hook.select(F.col("hi").alias("to"), F.col("to").alias("further")), hook
            hook = materialize(hook.join(onward, "to", "left").select("hi", F.coalesce("further", "to").alias("to")), "hook")
            discard(short)
        before, labels = labels, materialize(labels.join(hook.withColumnRenamed("hi", "comp"), "comp", "left").select("rep", F.coalesce("to", "comp").alias("comp")), "labels")
        discard(edges, hook, *([before] if owned else []))
        owned = True
    if not owned:
        return labels, None
    moved = first.join(labels.withColumnRenamed("comp", "to"), "rep").where("comp <> to").select("comp", "to").distinct()
    moved = materialize(moved, "moved")
    discard(first)
    return labels, moved


def open_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of tables that hold several components, with comp and the table's member count.
    Components only grow, so a table that is closed stays closed."""
    current = rows.drop("comp", "members").join(labels, "rep")
    mixed = current.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count("*").alias("members")).where("least <> most").select("key", "members")
    return materialize(current.join(mixed, "key"), "open")


def renamed(rows: DataFrame, moves: DataFrame | None) -> DataFrame:
    """rows with the components that theirs have gone into."""
    if moves is None:
        return rows
    return rows.join(F.broadcast(moves) if few(moves) else moves, "comp", "left").withColumn("comp", F.coalesce("to", "comp")).drop("to")


def moved_on(moves: DataFrame | None, moved: DataFrame | None) -> DataFrame | None:
    """The moves (comp, to) of two rounds in one."""
    if moves is None or moved is None:
        return moves or moved
    further = moved.select(F.col("comp").alias("to"), F.col("to").alias("further"))
    both = materialize(moves.join(further, "to", "left").select("comp", F.coalesce("further", "to").alias("to")).unionByName(moved), "moved")
    discard(moves, moved)
    return both


def with_bounds(rows: DataFrame, sets: DataFrame, reps: DataFrame) -> DataFrame:
    """rows with what bounds an intersection: shared, the number of a member's shingles that any
    other member of an open table has; for members of wide tables also common, the number of those
    that more than RARE members have, and rare, the others. Two sets have at most the lesser common
    and the rare ones that both have in common. sig: the member's partial keys in short.

    A link needs PERCENT of a set shared, so rows with fewer go; what is left is counted again."""
    for last in (False, True):
        members = rows.groupBy("rep").agg((F.max("members") > BLOCK).alias("wide"))
        each = sets.join(members, "rep").select("rep", "wide", F.explode("shingles").alias("shingle"))
        counts = each.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1")
        counted = each.join(counts, "shingle")
        if last:
            few = F.col("c") <= RARE
            found = counted.groupBy("rep").agg(F.count("*").alias("shared"), F.count_if(~few).alias("common"), F.first("wide").alias("wide"), F.collect_list(F.when(F.col("wide") & few, F.col("shingle"))).alias("rare"))
            found = found.withColumn("rare", F.when(F.col("wide") & (F.size("rare") <= MOST_RARE), F.col("rare"))).drop("wide")
            found = found.join(reps.select("rep", F.transform("keys", lambda k: F.shiftright(k, 32).cast("int")).alias("sig")), "rep")
        else:
            found = counted.groupBy("rep").agg(F.count("*").alias("shared"))
        before, rows = rows, materialize(rows.join(found, "rep").where(F.col("shared") * 100 >= F.col("n") * PERCENT), "open")
        discard(before)
        if not last:
            rows = rows.drop("shared")
    return rows


def _possible(a: str, b: str, refined: bool = True):
    """Whether two sets of known sizes can be linked, by the most that they can have in common."""
    most = F.least(f"s{a}", f"s{b}")
    if refined:
        both = F.least(f"m{a}", f"m{b}") + F.size(F.array_intersect(f"r{a}", f"r{b}"))
        most = F.when(F.col(f"r{a}").isNotNull() & F.col(f"r{b}").isNotNull(), F.least(most, both)).otherwise(most)
    return most * 100 >= (F.col(f"n{a}") + F.col(f"n{b}") - most) * PERCENT


def _first_common(a: str, b: str, place: str):
    """Whether a table is the first, in both collections, of those that two members share."""
    def first(start: int):
        half = lambda c: F.slice(c, start + 1, COLLECTION)
        return F.array_position(F.zip_with(half(a), half(b), lambda x, y: x == y), True) - 1

    return (first(0) == F.floor(F.col(place) / COLLECTION)) & (first(COLLECTION) == F.col(place) % COLLECTION)


def _star(rows: DataFrame, priority) -> DataFrame:
    """Pairs (a, b), a < b, of each table's first member by priority with its other components' members."""
    first = rows.groupBy("key").agg(F.min_by(F.struct("rep", "n", "comp", "shared"), priority).alias("f")).select("key", F.col("f.rep").alias("r"), F.col("f.n").alias("na"), F.col("f.comp").alias("ca"), F.col("f.shared").alias("sa"))
    met = rows.withColumnsRenamed({"n": "nb", "comp": "cb", "shared": "sb"}).join(first, "key")
    return met.where((F.col("cb") != F.col("ca")) & _possible("a", "b", False)).select(F.least("r", "rep").alias("a"), F.greatest("r", "rep").alias("b")).distinct()


def _crowds(rows: DataFrame) -> DataFrame:
    """(key, crowd, members) of the tables with several components, crowd being the one with the most members."""
    each = rows.groupBy("key", "comp").agg(F.count("*").alias("c"))
    found = each.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("crowd"), F.sum("c").alias("members"), F.count("*").alias("comps"))
    return materialize(found.where("comps > 1").select("key", "crowd", "members"), "crowds")


def _apart(rows: DataFrame, crowds: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of members of different components of a table that can be linked."""
    wide = F.ceil(F.col("members") / BLOCK)
    dealt = rows.drop("members").join(F.broadcast(crowds) if few(crowds) else crowds, "key").withColumn("blocks", wide)
    named = lambda x: [F.col(c).alias(f"{n}{x}") for c, n in (("n", "n"), ("comp", "c"), ("shared", "s"), ("common", "m"), ("rare", "r"), ("sig", "g"))]
    left = dealt.where("comp <> crowd").select("key", "place", F.col("rep").alias("l"), *named("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    right = dealt.select("key", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), F.col("rep").alias("r"), *named("b"), (F.col("comp") == F.col("crowd")).alias("of_crowd"))
    met = left.join(right, ["key", "block"]).where((F.col("ca") != F.col("cb")) & (F.col("of_crowd") | (F.col("l") < F.col("r"))) & _possible("a", "b") & _first_common("ga", "gb", "place"))
    return met.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b")).distinct()


def _not_one(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose members are in different components."""
    la = labels.select(F.col("rep").alias("a"), F.col("comp").alias("ca"))
    lb = labels.select(F.col("rep").alias("b"), F.col("comp").alias("cb"))
    return pairs.join(la, "a").join(lb, "b").where("ca <> cb").select("a", "b")


def settle(pairs: DataFrame, sets: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """contract along those of the pairs that are linked."""
    links = materialize(verify(pairs, sets), "links")
    out = contract(labels, links)
    discard(links)
    return out


def link_classes(tables: DataFrame, sets: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, comp) for all members of the tables."""
    labels = materialize(tables.select("rep").distinct().withColumn("comp", F.col("rep")), "labels")
    rows = tables.withColumns({"comp": F.col("rep"), "shared": F.col("n")})
    done = [materialize(_star(rows, F.col("rep")), "pairs")]
    labels, moved = settle(done[0], sets, labels)
    discard(*([moved] if moved else []))
    rows, moves = open_rows(tables, labels), None
    if rows.isEmpty():
        discard(rows, *done)
        return labels
    rows = with_bounds(rows, sets, reps)

    def fresh(met: DataFrame) -> DataFrame:
        before = met.sparkSession.read.schema(done[0].schema).parquet(*(x._scratch for x in done))
        done.append(materialize(met.join(before, ["a", "b"], "left_anti"), "pairs"))
        return done[-1]

    for i in range(STARS):
        pairs = fresh(_star(renamed(rows, moves), F.xxhash64("rep", F.lit(i))))
        if not pairs.isEmpty():
            labels, moved = settle(pairs, sets, labels)
            moves = moved_on(moves, moved)
    now = renamed(rows, moves)
    crowds = _crowds(now)
    pairs = fresh(_apart(now, crowds))
    for low, high in PORTIONS:
        portion = F.pmod(F.xxhash64("a", "b"), F.lit(16))
        part = materialize(_not_one(pairs.where((portion >= low) & (portion < high)), labels), "portion")
        if not part.isEmpty():
            labels, moved = settle(part, sets, labels)
            discard(*([moved] if moved else []))
        discard(part)
    discard(rows, crowds, *done, *([moves] if moves else []))
    return labels


#: Stands in for a null id inside the operator.
_NO_ID = -(1 << 63)


def class_names(classes: DataFrame) -> DataFrame:
    """rep, unique, for rows with a unique set_hash."""
    short = F.conv(F.substring(F.hex("set_hash"), 1, 15), 16, 10).cast("long")
    named = classes.withColumn("rep", short)
    clash = materialize(named.groupBy("rep").agg(F.count("*").alias("c")).where("c > 1").select("rep"), "clash")
    if not clash.isEmpty():  # about 40 of 10**10 classes
        number = F.row_number().over(Window.orderBy("set_hash")).cast("long")
        other = materialize(named.join(clash, "rep").select("set_hash", (-number).alias("other")), "other")
        named = named.join(other, "set_hash", "left").withColumn("rep", F.coalesce("other", "rep")).drop("other")
    return named


def placed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, comp (the component's name, null for empty sets) and component_id of every row."""
    signed = materialize(signatures(df, id_col, text_col), "signatures")
    full = signed.where("set_hash is not null").withColumn("id", F.coalesce("doc_id", F.lit(_NO_ID)))
    grouped = materialize(full.groupBy("set_hash").agg(F.min("doc_id").alias("first"), F.max("id").alias("some_id")), "grouped")
    classes = materialize(class_names(grouped), "classes")
    one = classes.select("set_hash", "rep", F.col("some_id").alias("id"))
    chosen = full.join(one, ["set_hash", "id"]).dropDuplicates(["rep"]).select("rep", F.col("n_shingles").alias("n"), "keys")
    chosen = materialize(chosen, "chosen")
    tables = table_keys(chosen)
    wanted = materialize(one.join(tables.select("rep").distinct(), "rep"), "wanted")
    texts = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_col).alias("text"))
    met = texts.join(F.broadcast(wanted) if few(wanted) else wanted, "id")
    sets = materialize(full_sets(met.select("rep", "set_hash", "text")), "sets")
    if not sets.groupBy("rep").count().where("count > 1").isEmpty():
        before, sets = sets, materialize(sets.dropDuplicates(["rep"]), "sets")
        discard(before)
    labels = link_classes(tables, sets, chosen)
    placed = materialize(classes.join(labels, "rep", "left").select("set_hash", "first", F.coalesce("comp", "rep").alias("comp")), "placed")
    smallest = placed.groupBy("comp").agg(F.min("first").alias("component_id"))
    of_class = materialize(placed.join(smallest, "comp").select("set_hash", "comp", "component_id"), "placed")
    discard(grouped, classes, chosen, tables, wanted, sets, labels, placed)
    some = full.join(of_class, "set_hash").select("doc_id", "text_hash", "n_shingles", "comp", "component_id")
    none = signed.where("set_hash is null").select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("long").alias("comp"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Empty sets are components of their own, whatever else the row holds. Rows that repeat an id
    are placed by their own texts; component_id is the smallest id of the component's rows, null
    if none has one, and kept holds where doc_id equals it. Other columns are ignored; an empty
    table gives no row."""
    return placed_rows(df, id_col, text_col).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one of the smallest id, all its columns; texts without
    a set all stay. Of documents that share that id, or of a component without ids, the one with
    the smallest text hash stays; rows that repeat both id and text are one document and stay or
    go together. The documents to go are joined away; if they are few the texts do not shuffle."""
    document = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    placed = materialize(placed_rows(df, id_col, text_col).where("comp is not null").select("comp", document.alias("document")), "documents")
    winner = placed.groupBy("comp").agg(F.min("document").alias("winner"))
    gone = placed.join(winner, "comp").where("document <> winner").select("document.doc_id", "document.text_hash").distinct()
    gone = materialize(gone, "gone")
    discard(placed)
    there = F.broadcast(gone) if few(gone) else gone
    same = F.col(f"left.{id_col}").cast("long").eqNullSafe(F.col("gone.doc_id")) & (F.xxhash64(f"left.{text_col}") == F.col("gone.text_hash"))
    return df.alias("left").join(there.alias("gone"), same, "left_anti")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


#: From the definition: all pairs that share a shingle, then the closure of the links.
ORACLE = r"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, cast(len(w) - 3 as bigint)), lambda i: array_to_string(w[i:i + 4], ' ')) end) as shingle from w
), n as (select doc_id, count(*) as n from s group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from documents union select doc_id, b from reach join both_ways on other = a)
select d.doc_id, coalesce(max(n.n), 0) as n_shingles, min(other) as component_id, d.doc_id = min(other) as kept
from documents d join reach r on r.doc_id = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id
"""

QUERIES = {"op4_near_dedup": op4_near_dedup}
ORACLES = {"op4_near_dedup": ORACLE}
