"""Token ids in files of fixed-width packed bits.

A file is, in little-endian order::

    magic "LBP1" | bits u32 | block_ids u32 | n_docs u64 | n_ids u64 | n_blocks u64
    doc_id i64 x n_docs | null flag u8 x n_docs | first id u64 x (n_docs + 1)
    block offset u64 x (n_blocks + 1), from the start of the packed part
    packed part: blocks of block_ids ids, the last one filled up with id 0

Id i of a block lies in its bits i*bits to (i+1)*bits-1, lowest bit first. 64 ids fill
``bits`` 64-bit words, so a block is unpacked by 64 numpy column operations, and any
range of ids by the blocks that it touches.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import mapped, offsets, saved
from lodestar.llm.tokens import encoder

MAGIC = b"LBP1"
HEAD = struct.Struct("<4sIIQQQ")
BLOCK_IDS = 4096
#: A file is closed once it holds this many ids.
FILE_IDS = 1 << 20


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` (a multiple of 64) at ``bits`` bits each."""
    lanes = np.ascontiguousarray(ids.reshape(-1, 64).T)  # 64 rows: each step runs over memory in order
    words = np.zeros((bits, lanes.shape[1]), dtype="<u8")
    for j, lane in enumerate(lanes):
        word, shift = divmod(j * bits, 64)
        lane = lane.astype(np.uint64)
        words[word] |= lane << np.uint64(shift)
        if shift + bits > 64:
            words[word + 1] |= lane >> np.uint64(64 - shift)
    return words.T.tobytes()


def unpack(data: bytes | memoryview, bits: int) -> np.ndarray:
    """The inverse of ``pack``."""
    words = np.ascontiguousarray(np.frombuffer(data, dtype="<u8").reshape(-1, bits).T)
    lanes = np.empty((64, words.shape[1]), dtype="<u4")
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        v = words[word] >> np.uint64(shift)
        if shift + bits > 64:
            v |= words[word + 1] << np.uint64(64 - shift)
        lanes[j] = v & mask
    return lanes.T.reshape(-1)


def write_file(doc_ids: list[int | None], docs: list[bytes], bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """The file of ``docs`` (packed little-endian uint32 ids each)."""
    ids = np.frombuffer(b"".join(docs), dtype="<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit in {bits} bits")
    n_blocks = -(-len(ids) // block_ids)
    full = np.zeros(n_blocks * block_ids, dtype="<u4")
    full[: len(ids)] = ids
    first = np.concatenate([[0], np.cumsum([len(d) // 4 for d in docs])]).astype("<u8")
    block = block_ids * bits // 8
    return b"".join([
        HEAD.pack(MAGIC, bits, block_ids, len(docs), len(ids), n_blocks),
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is None for d in doc_ids], dtype="u1").tobytes(),
        first.tobytes(),
        (np.arange(n_blocks + 1, dtype="<u8") * np.uint64(block)).tobytes(),
        pack(full, bits),
    ])


class PackedFile:
    """Random access to the ids of one file."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block_ids, n_docs, self.n_ids, n_blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a packed id file")
        at = HEAD.size
        nulls = np.frombuffer(data, "u1", n_docs, at + 8 * n_docs)
        self.doc_ids = [None if n else d for d, n in zip(np.frombuffer(data, "<i8", n_docs, at).tolist(), nulls.tolist())]
        at += 9 * n_docs
        self.first = np.frombuffer(data, "<u8", n_docs + 1, at).astype(np.int64)
        at += 8 * (n_docs + 1)
        self.blocks = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
        self.packed = memoryview(data)[at + 8 * (n_blocks + 1):]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end-1, from the blocks that hold them."""
        if end <= start:
            return np.empty(0, dtype="<u4")
        a, b = start // self.block_ids, (end - 1) // self.block_ids + 1
        some = unpack(self.packed[self.blocks[a]: self.blocks[b]], self.bits)
        return some[start - a * self.block_ids: end - a * self.block_ids]

    def doc(self, k: int) -> np.ndarray:
        return self.ids(int(self.first[k]), int(self.first[k + 1]))


FILES = "range_no int, file_no int, n_ids long, n_docs long, data binary"


def write_files(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, path: str | None = None,
                file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes every text, appends ``end_id``, and writes the ids in doc_id order.

    Returns the written files, one row each: their range, number in it, counts and
    bytes. They are kept in a Parquet table in the shared folder: Spark's committer
    makes a lost executor's files appear once or not at all, in any store.

    Null texts count as empty; rows with equal doc_id are ordered by text; a null doc_id
    comes first. A document is never divided, so a file is as large as ``file_ids`` ids
    or its longest document. No rows: no files.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranged = rows.repartitionByRange("doc_id", F.crc32(F.col("text").cast("binary")))
    ranged = ranged.withColumn("range_no", F.spark_partition_id()).sortWithinPartitions("doc_id", "text")

    def files(batches):
        encode = encoder(vocabulary, path)
        bits = bits_for(encode.tokenizer.get_vocab_size())
        end = struct.pack("<I", end_id)
        names: list[int | None] = []
        held: list[bytes] = []
        n = count = part = 0

        def file():
            return pa.RecordBatch.from_pydict({
                "range_no": pa.array([part], pa.int32()), "file_no": pa.array([count], pa.int32()),
                "n_ids": pa.array([n], pa.int64()), "n_docs": pa.array([len(held)], pa.int64()),
                "data": pa.array([write_file(names, held, bits)], pa.binary()),
            })

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch["range_no"][0].as_py()
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode.encode(batch["text"])):
                names.append(doc_id)
                held.append(ids + end)
                n += len(ids) // 4 + 1
                if n >= file_ids:
                    yield file()
                    names, held, n, count = [], [], 0, count + 1
        if held:
            yield file()

    # packed ids hardly compress
    return saved(mapped(ranged, files, FILES), "uncompressed")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, all from the files.

    ``start`` counts the ids of all documents before it in the order of doc_id, a null one
    first. Files are read one at a time. No files: no rows.
    """
    totals = files.groupBy("range_no").agg(F.sum("n_ids").alias("ids"))  # one row per range partition
    before = Window.partitionBy("range_no").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        files.select("range_no", "file_no", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("in_range"))
        .join(F.broadcast(offsets(totals, "range_no", ["ids"])), "range_no")
        .select("range_no", "file_no", (F.col("in_range") + F.col("before_ids")).alias("file_start"))
    )

    def documents(batches):
        for batch in batches:
            for part, no, data in zip(batch["range_no"].to_pylist(), batch["file_no"].to_pylist(), batch["data"]):
                file = PackedFile(data.as_buffer().to_pybytes())
                every = file.ids(0, file.n_ids)
                first = file.first.tolist()
                yield pa.RecordBatch.from_pydict({
                    "range_no": pa.array([part] * len(file.doc_ids), pa.int32()),
                    "file_no": pa.array([no] * len(file.doc_ids), pa.int32()),
                    "doc_id": pa.array(file.doc_ids, pa.int64()),
                    "first": pa.array(first[:-1], pa.int64()),
                    "n_tokens": pa.array(np.diff(file.first), pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(every[a:b]) for a, b in zip(first, first[1:])], pa.int64()),
                })

    read = mapped(
        files.select("range_no", "file_no", "data"), documents, "range_no int, file_no int, doc_id long, first long, n_tokens long, ids_crc32 long"
    )
    return read.join(starts, ["range_no", "file_no"]).select(
        "doc_id", (F.col("first") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def packed_token_ids(docs: DataFrame) -> DataFrame:
    """Writes every document's ids (null text: only the end id) and reads them back."""
    return read_files(write_files(docs))
