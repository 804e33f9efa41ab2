"""Length-delimited binary records of token ids, with an index of offsets beside each file for shuffled reads.

A file of records is a run of frames; a frame is
  length      u64    bytes of the payload
  check       u32    masked CRC-32 of the eight bytes of the length
  payload     bytes  u8 bytes an id (2 or 4), u8 1 if doc_id is null, i64 doc_id, then the ids
  check       u32    masked CRC-32 of the payload
all little-endian. A check is masked by turning it 15 bits right and adding 0xA282EAD8, so that checks over data that hold checks
stay useful. `name.idx` is the u64 offsets of all frames, then one frame of the same kind whose payload is their count.

Every attempt of a task writes files of its own name, which are never renamed; the names of those that count come to the driver and are
written as a table beside them, so a task may run twice and a half-written file is never read.
Defined cases: a null or empty text is the end id alone; a null doc_id comes last; repeated rows are
written each; an empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstline.llm.common import buffers, new_folder, order_key, partitions, qualified
from burstline.llm.tokens import encoder

_HEAD = struct.Struct("<BBq")
_FILES = "shard long, name string, records long, ids long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def read_frame(file) -> bytes | None:
    """The next payload; None at the end. Raises ValueError for a damaged frame."""
    head = file.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("damaged length of a record")
    n = struct.unpack("<Q", head[:8])[0]
    body = file.read(n + 4)
    if len(body) < n + 4 or masked(body[:n]) != struct.unpack("<I", body[n:])[0]:
        raise ValueError("damaged record")
    return body[:n]


def pack_ids(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return _HEAD.pack(width, doc_id is None, doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def unpack_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    width, null, doc_id = _HEAD.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=_HEAD.size).astype("<u4")


def filesystem(uri: str):
    """(file system, path) of a qualified folder."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2) -> list:
    """Write all documents in ascending doc_id as files of records; returns a row (shard, name, records, ids) a file, in order.

    The rows are also the table `files` of the folder, which files() reads.
    """
    spark, folder = docs.sparkSession, qualified(docs.sparkSession, folder)

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        shard, disk, out, ids_total = TaskContext.get().partitionId(), None, None, 0
        encode, offsets, at = encoder(tokenizer_path).encode, [], 0
        end = np.asarray([end_id], np.uint32)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, ids, to in encode(*buffers(batch.column(1))):
                for k in range(len(to) - 1):
                    if out is None:
                        disk, path = filesystem(folder)
                        disk.create_dir(path, recursive=True)
                        name = f"{shard:06d}-{uuid.uuid4().hex}"
                        out = disk.open_output_stream(f"{path}/{name}.rec")
                    data = frame(pack_ids(names[first + k], np.append(ids[to[k] : to[k + 1]], end)))
                    out.write(data)
                    offsets.append(at)
                    at += len(data)
                    ids_total += int(to[k + 1] - to[k]) + 1
        if out is not None:
            out.close()
            with disk.open_output_stream(f"{path}/{name}.idx") as index:
                index.write(np.asarray(offsets, "<u8").tobytes() + frame(struct.pack("<Q", len(offsets))))
            numbers = [pa.array([x], pa.int64()) for x in (shard, len(offsets), ids_total)]
            yield pa.RecordBatch.from_arrays([numbers[0], pa.array([name]), *numbers[1:]], names=["shard", "name", "records", "ids"])

    n = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), order_key().alias("__k"), F.substr(F.col("text").cast("string"), F.lit(1), F.lit(32)).alias("__p"))
    # By the beginning of the text too, so that null doc_ids are several files.
    dealt = rows.repartitionByRange(n, "__k", "__p").sortWithinPartitions("__k", "text").select("doc_id", "text")
    # One row a file comes to the driver.
    made = sorted(dealt.mapInArrow(write, _FILES).collect(), key=lambda r: r.shard)
    spark.createDataFrame(made, _FILES).coalesce(1).write.parquet(f"{folder}/files")
    return made


def files(spark: SparkSession, folder: str) -> list:
    """The rows that write_records() returned."""
    return sorted(spark.read.schema(_FILES).parquet(f"{qualified(spark, folder)}/files").collect(), key=lambda r: r.shard)


def read_records(spark: SparkSession, folder: str, shards: list | None = None) -> DataFrame:
    """Every record of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32, shard, place."""
    shards, folder = files(spark, folder) if shards is None else shards, qualified(spark, folder)
    starts = np.cumsum([0, *(r.ids for r in shards)]).tolist()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, place long"

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        disk, path = filesystem(folder)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                rows, start, place = [], starts[i], 0
                with disk.open_input_stream(f"{path}/{shards[i].name}.rec") as file:
                    while (payload := read_frame(file)) is not None:
                        doc_id, ids = unpack_ids(payload)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), shards[i].shard, place))
                        start, place = start + len(ids), place + 1
                        if len(rows) == 10_000:
                            yield _batch(pa, rows)
                            rows = []
                if rows:
                    yield _batch(pa, rows)

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(read, schema)


def _batch(pa, rows):
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "place"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def read_at(folder: str, name: str, places: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records at the given places of one file (of a qualified folder), in that order, by its index alone: for shuffled reads."""
    disk, path = filesystem(folder)
    with disk.open_input_file(f"{path}/{name}.idx") as index, disk.open_input_file(f"{path}/{name}.rec") as file:
        out = []
        for place in places:
            index.seek(8 * place)
            file.seek(struct.unpack("<Q", index.read(8))[0])
            out.append(unpack_ids(read_frame(file)))
    return out


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write all documents to a new folder of the shared one and read them back."""
    folder = new_folder(docs.sparkSession, "records")
    return read_records(docs.sparkSession, folder, write_records(docs, folder, tokenizer_path, end_id))
