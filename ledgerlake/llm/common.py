"""What the training-data operators share: scratch tables, text batches, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.sources.scratch import folder as scratch_path

#: Rows of a batch that are held as Python objects at once.
CHUNK = 256
#: Texts whose words are numbered together, and their bytes, unless one text alone has more.
TEXTS, TEXT_BYTES = 2048, 1 << 20
#: Slices after which a worker gives free memory back.
TRIM = 32
#: Rows of a batch between the JVM and a worker, and its bytes, where the session leaves Spark's defaults:
#: both sides hold several batches for every task.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2048"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16m")}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


#: Narrow tables that are broadcast have so many rows at most.
FEW = 200_000


def few(df: DataFrame) -> bool:
    return df.count() <= FEW


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: str, n: int):
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n


#: What a Python worker keeps from task to task, by the operator that made it.
_kept: dict[str, dict] = {}


def kept(owner: str, key, make: Callable):
    """make() once per worker and key, for as long as the worker serves this operator."""
    own = _kept.setdefault(owner, {})
    if key not in own:
        own[key] = make()
    return own[key]


def release(owner: str | None) -> None:
    """Drop what other operators keep in this worker, and give the memory back: a pipeline runs
    several operators in the same workers."""
    if others := [k for k in _kept if k != owner]:
        for k in others:
            del _kept[k]
        gc.collect()
        trim()


def trim() -> None:
    """Give free memory back to the system: a worker waits between tasks, and others need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK, owner: str | None = None, text_bytes: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, and so many bytes of their largest column, at most."""
    release(owner)
    n = 0
    for batch in batches:
        at, ends = 0, _ends(batch)
        while at < batch.num_rows:
            until = min(at + size, max(at + 1, int(np.searchsorted(ends, ends[at] + text_bytes, "right")) - 1))
            yield batch.slice(at, until - at)
            at, n = until, n + 1
            if n % TRIM == 0:
                trim()
    trim()


def _ends(batch: pa.RecordBatch) -> np.ndarray:
    """Where each row's part of the batch's largest column of texts begins, one more for the end of the last."""
    texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
    if not texts:
        return np.zeros(batch.num_rows + 1, np.int64)
    column = max(texts, key=lambda c: c.nbytes)
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + batch.num_rows + 1].astype(np.int64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, and where each text begins, one more for the end; null is empty."""
    column = pc.fill_null(column.cast(pa.binary()), b"")
    _, bounds, buffer = column.buffers()
    if not len(column) or buffer is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(bounds, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


_BLANK = np.isin(np.arange(256), [*range(9, 14), 32])


def number_pieces(data: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct spans of data between starts, and by span the number of its own."""
    spans = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)])
    numbered = spans.dictionary_encode()
    return numbered.dictionary.to_pylist(), numbered.indices.to_numpy()


def numbered_words(column: pa.Array, lower: bool = True) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of all texts, runs of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased unless told
    otherwise: the distinct ones, by word its number among them, and where each text's words begin, one
    more for the end of the last."""
    data, offsets = text_buffer(column)
    if not len(data):
        return [], np.zeros(0, np.int32), offsets
    ink = ~_BLANK[data]
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    heads = offsets[:-1][offsets[1:] > offsets[:-1]]
    start[heads] = ink[heads]
    data = (data + (((data >= 65) & (data <= 90)).view(np.uint8) << 5) if lower else data)[ink]
    if not len(data):
        return [], np.zeros(0, np.int32), np.zeros_like(offsets)
    return *number_pieces(data, np.flatnonzero(start[ink])), np.searchsorted(np.flatnonzero(start), offsets)


def hashed(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's begin, one more for the end."""
    distinct, number, bounds = numbered_words(column)
    return hashed(distinct)[number], bounds


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: spreads what a polynomial has added up."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def map_arrow(df: DataFrame, f: Callable, schema) -> DataFrame:
    conf = df.sparkSession.conf
    for key, (default, ours) in BATCH.items():
        if conf.get(key) == default:
            conf.set(key, ours)
    return df.mapInArrow(f, schema)


def table_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[x.name], x.type) for x in schema], schema=schema)
