"""Packing: minimum bin slack over remaining lengths.

A document's ids are cut into whole windows of the capacity, which have no slack, and one
remainder. Remainders wait in a bounded pool; for each window the longest one is taken and a
subset-sum over bitsets finds, among the multiset of the other lengths, the one that comes
closest to the capacity, with its counts traced back. A window that the pool cannot fill
exactly is topped up with the head of another remainder, whose tail goes back to the pool.
Only the last window of an input partition can therefore have slack."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import TEXTS, chunks, documents, map_arrow, table_batch
from ledgerlake.llm.encode import CACHE_ENTRIES, ENCODED_BYTES, OWNER, encoder

CAPACITY = 1024
#: Remainders in the pool at which packing starts, and those it leaves for later windows.
POOL_HIGH, POOL_LOW = 4096, 2048
#: Words that the query's workers keep; nothing else runs in them.
QUERY_CACHE = 1_500_000
#: Sequence ids of one partition lie below 2**SEQUENCE_BITS.
SEQUENCE_BITS = 36

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("padded_length", pa.int64())])


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within the given counts, whose sum is nearest to the capacity
    from below: bit s of the reach is set if the sum s can be had. Ties: the first found,
    lengths taken in descending order."""
    full, goal, reach, layers = (2 << capacity) - 1, 1 << capacity, 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        for _ in range(min(counts[length], capacity // length)):
            more = (reach | reach << length) & full
            if more == reach:
                break
            layers.append((length, reach))
            reach = more
        if reach & goal:
            break
    rest, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        if not before >> rest & 1:
            chosen[length] = chosen.get(length, 0) + 1
            rest -= length
    return chosen


def padded(used: int, capacity: int) -> int:
    """A sequence whose length is a power of two needs no padding."""
    return used if used & (used - 1) == 0 else capacity


class Packer:
    """Pieces are (doc_id, start, ids, doc_tokens); sequences come out as lists of pieces."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.pool, self.size = capacity, defaultdict(list), 0

    def put(self, piece: tuple) -> None:
        self.pool[len(piece[2]) // 4].append(piece)
        self.size += 1

    def _take(self, length: int) -> tuple:
        pieces = self.pool[length]
        piece = pieces.pop()
        if not pieces:
            del self.pool[length]
        self.size -= 1
        return piece

    def sequence(self) -> list[tuple]:
        longest = max(self.pool)
        out, room = [self._take(longest)], self.capacity - longest
        if room:
            for length, n in closest_fill({k: len(v) for k, v in self.pool.items()}, room).items():
                out += [self._take(length) for _ in range(n)]
                room -= length * n
        if room and self.pool:
            doc_id, start, ids, total = self._take(min(x for x in self.pool))
            out.append((doc_id, start, ids[: 4 * room], total))
            self.put((doc_id, start + room, ids[4 * room :], total))
        return out

    def add(self, doc_id, ids: bytes) -> Iterator[list[tuple]]:
        n, step = len(ids) // 4, self.capacity
        for at in range(0, n - n % step, step):
            yield [(doc_id, at, ids[4 * at : 4 * (at + step)], n)]
        if n % step:
            self.put((doc_id, n - n % step, ids[4 * (n - n % step) :], n))
        if self.size >= POOL_HIGH:
            yield from self.drain(POOL_LOW)

    def drain(self, leave: int = 0) -> Iterator[list[tuple]]:
        while self.size > leave:
            yield self.sequence()


def pack_documents(df: DataFrame, tokenizer: str, mode: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cache_entries: int = CACHE_ENTRIES, text_bytes: int = ENCODED_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    padded_length, and with_ids also ids (binary, little-endian unsigned 32-bit).

    Null and empty texts are their end id alone; null and repeated ids are kept, other columns
    ignored; an empty table gives no piece. Partitions are packed where they are read, without
    a shuffle; each has at most one sequence with padding."""
    schema = PIECES.append(pa.field("ids", pa.binary())) if with_ids else PIECES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence, packer, rows = TaskContext.get().partitionId() << SEQUENCE_BITS, Packer(capacity), []
        encode = encoder(tokenizer, mode, cache_entries).encode

        def emit(pieces: list[tuple]) -> None:
            nonlocal sequence
            used, at = sum(len(x[2]) for x in pieces) // 4, 0
            for doc_id, start, ids, total in pieces:
                n = len(ids) // 4
                rows.append((doc_id, start, n, zlib.crc32(ids), total, sequence, at, padded(used, capacity), *([ids] if with_ids else [])))
                at += n
            sequence += 1

        def flushed() -> pa.RecordBatch:
            out = table_batch(schema, **dict(zip(schema.names, zip(*rows))))
            rows.clear()
            return out

        for batch in chunks(batches, TEXTS, OWNER, text_bytes):
            ids, at = encode(batch.column(1), end_id)
            data, at = ids.astype("<u4").tobytes(), (at * 4).tolist()
            for doc_id, a, b in zip(batch.column(0).to_pylist(), at, at[1:]):
                for pieces in packer.add(doc_id, data[a:b]):
                    emit(pieces)
            if len(rows) >= 4096:
                yield flushed()
        for pieces in packer.drain():
            emit(pieces)
        if rows:
            yield flushed()

    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"
    return map_arrow(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), pack, columns + ", ids binary" * with_ids)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), "leading", 0, cache_entries=QUERY_CACHE)


QUERIES = {"op3_packing": op3_packing}
