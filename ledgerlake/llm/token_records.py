"""Token-id output: length-delimited binary records with masked checksums and an offset index.

A record file holds frames, one for each sequence:
    length    8 bytes, little-endian, bytes of the payload
    check     4 bytes, masked CRC-32 of those 8 bytes
    payload   8 bytes doc_id, 1 byte (1: doc_id is null), 1 byte width, then the ids at that width
    check     4 bytes, masked CRC-32 of the payload
A checksum c is stored as ((c >> 15 | c << 17) + 0xA282EAD8) mod 2**32, so that a checksum
over data that holds checksums stays sound. Beside each file lies an index of 24-byte entries
(offset, payload length, doc_id), by which single records can be read in any order.

A file is written under a name of its own attempt and moved into place when it is whole, so a
repeated task leaves one whole file. Files lie below spark.checkpoint.dir and are opened with
pyarrow.fs, which serves local, HDFS and object-store addresses."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import TEXTS, chunks, documents, map_arrow, materialize, scratch_path, table_batch
from ledgerlake.llm.encode import ENCODED_BYTES, OWNER, encoder

MASK_DELTA = 0xA282EAD8
INDEX = "<QQq"
HEAD = "<qBB"
#: A file is closed after so many bytes, so that no reader task gets more than about that.
FILE_BYTES = 64 << 20


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """ids: little-endian, of that width."""
    return struct.pack(HEAD, 0 if doc_id is None else doc_id, doc_id is None, width) + ids


def read_frame(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the frame at an offset, and the next frame's offset. Raises if a checksum fails."""
    (n,) = struct.unpack_from("<Q", data, at)
    if struct.unpack_from("<I", data, at + 8)[0] != masked(data[at : at + 8]):
        raise ValueError(f"length checksum at {at}")
    body = data[at + 12 : at + 12 + n]
    if len(body) != n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(body):
        raise ValueError(f"payload checksum at {at}")
    return body, at + 16 + n


def unpack(body: memoryview) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = struct.unpack_from(HEAD, body)
    return None if null else doc_id, np.frombuffer(body[struct.calcsize(HEAD) :], f"<u{width}").astype("<u4")


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


MANIFEST = pa.schema([("file", pa.string()), ("ordinal", pa.int32()), ("task", pa.int32()), ("n_records", pa.int64()), ("n_tokens", pa.int64())])
RECORDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file", pa.string()), ("record_offset", pa.int64())])


class _File:
    def __init__(self, fs, folder: str, name: str):
        self.fs, self.folder, self.name, self.at, self.n, self.tokens, self.index = fs, folder, name, 0, 0, 0, []
        self.part = f"{folder}/_{name}.{uuid.uuid4().hex}"
        self.stream = fs.open_output_stream(self.part)

    def add(self, doc_id, ids: bytes, width: int) -> None:
        body = payload(doc_id, ids, width)
        self.index.append(struct.pack(INDEX, self.at, len(body), 0 if doc_id is None else doc_id))
        data = frame(body)
        self.stream.write(data)
        self.at, self.n, self.tokens = self.at + len(data), self.n + 1, self.tokens + len(ids) // width

    def close(self) -> None:
        self.stream.close()
        with self.fs.open_output_stream(f"{self.part}.idx") as out:
            out.write(b"".join(self.index))
        self.fs.move(f"{self.part}.idx", f"{self.folder}/{self.name}.idx")
        self.fs.move(self.part, f"{self.folder}/{self.name}.rec")


def write_token_records(df: DataFrame, folder: str, tokenizer: str, mode: str, end_id: int, vocab: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode whole texts and write them as records in ascending id order; gives the manifest
    (file, ordinal, task, n_records, n_tokens), one row per file, (task, ordinal) in id order.

    Null text is empty and has the end id alone. Null ids come first; rows that repeat an id
    are kept, in the order of a hash of their texts. Other columns are ignored. An empty table gives no file."""
    width = 2 if vocab <= 65536 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        encode, out, ordinal, rows = encoder(tokenizer, mode).encode, None, 0, []

        def closed():
            nonlocal out, ordinal
            out.close()
            rows.append((f"{folder}/{out.name}.rec", ordinal, task, out.n, out.tokens))
            out, ordinal = None, ordinal + 1

        for batch in chunks(batches, TEXTS, OWNER, ENCODED_BYTES):
            ids, at = encode(batch.column(1), end_id)
            data, at = ids.astype(f"<u{width}").tobytes(), (at * width).tolist()
            for doc_id, a, b in zip(batch.column(0).to_pylist(), at, at[1:]):
                out = out or _File(fs, root, f"part-{task:06d}-{ordinal:04d}")
                out.add(doc_id, data[a:b], width)
                if out.at >= file_bytes:
                    closed()
        if out:
            closed()
        if rows:
            yield table_batch(MANIFEST, **dict(zip(MANIFEST.names, zip(*rows))))

    rows_ = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    # by hash too, so that rows of one id, or without any, are not one task's; what is sampled for the ranges has no text
    ordered = rows_.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "text")
    return materialize(map_arrow(ordered.drop("text_hash"), write, "file string, ordinal int, task int, n_records long, n_tokens long"), "manifest")


def read_token_records(manifest: DataFrame) -> DataFrame:
    """One row per record, every checksum and index entry verified, with the ids before it in all files.

    The running sum is over files, not documents: a file holds FILE_BYTES or a task's share."""
    before = Window.orderBy("task", "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = _filesystem(row["file"])
                with fs.open_input_stream(path) as f:
                    data = memoryview(f.read())
                with fs.open_input_stream(f"{path.removesuffix('.rec')}.idx") as f:
                    index = f.read()
                at, start, out = 0, row["base"], []
                for i, (offset, length, _) in enumerate(struct.iter_unpack(INDEX, index)):
                    if offset != at:
                        raise ValueError(f"{path}: entry {i} of the index is at {offset}, the record at {at}")
                    body, at = read_frame(data, at)
                    doc_id, ids = unpack(body)
                    if len(body) != length:
                        raise ValueError(f"{path}: length of record {i}")
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), row["file"], offset))
                    start += len(ids)
                if at != len(data) or len(out) != row["n_records"]:
                    raise ValueError(f"{path}: {at} of {len(data)} bytes, {len(out)} of {row['n_records']} records")
                if out:
                    yield table_batch(RECORDS, **dict(zip(RECORDS.names, zip(*out))))

    spread = files.repartition(max(files.sparkSession.sparkContext.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file")
    return map_arrow(spread.select("file", "base", "n_records"), read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, record_offset long")


class RecordFile:
    """One file's records in any order: the index says where each lies, and only its bytes are read."""

    def __init__(self, file: str):
        self.fs, self.path = _filesystem(file)
        with self.fs.open_input_stream(f"{self.path.removesuffix('.rec')}.idx") as f:
            self.index = np.frombuffer(f.read(), [("offset", "<u8"), ("length", "<u8"), ("doc_id", "<i8")])
        self.file = self.fs.open_input_file(self.path)

    def __len__(self) -> int:
        return len(self.index)

    def __getitem__(self, k: int) -> tuple[int | None, np.ndarray]:
        """(doc_id, ids) of record k, its checksums and its index entry verified."""
        offset, length, indexed = (int(x) for x in self.index[k])
        frame_ = self.file.read_at(length + 16, offset)
        body, end = read_frame(memoryview(frame_), 0)
        doc_id, ids = unpack(body)
        if end != length + 16 or (doc_id or 0) != indexed:
            raise ValueError(f"{self.path}: record {k} is not what the index says")
        return doc_id, ids

    def close(self) -> None:
        self.file.close()


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """(position, doc_id, ids): all records in an order that the seed decides. The positions are dealt
    to tasks by range and each task fetches its records through the index, a file's together."""
    files = manifest.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_records") - 1)).alias("k"))
    order = F.xxhash64("file", "k", F.lit(seed))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, RecordFile] = {}
        for batch in chunks(batches):
            got = [None] * batch.num_rows
            for i, (file, k) in sorted(enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), key=lambda x: x[1]):
                if file not in opened:
                    for other in opened.values():
                        other.close()
                    opened = {file: RecordFile(file)}
                got[i] = opened[file][k]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1].astype(np.int64) for x in got], pa.list_(pa.int64()))], names=["position", "doc_id", "ids"])
        for other in opened.values():
            other.close()

    dealt = files.withColumn("position", order).repartitionByRange("position", "file", "k").sortWithinPartitions("position", "file", "k")
    return map_arrow(dealt.select("file", "k", "position"), fetch, "position long, doc_id long, ids array<long>")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(spark, "records")
    manifest = write_token_records(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"), "dropped", 1, 49408)
    return read_token_records(manifest)


QUERIES = {"op1_token_records": op1_token_records}
