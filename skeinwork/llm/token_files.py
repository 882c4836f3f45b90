"""Token ids in fixed-width bit-packed files.

Each id takes the fewest bits that hold every id of the vocabulary.  A file is a
row of images; an image is::

    8 bytes   b"SKTOKEN1"
    u32       bits per id
    u32       ids per block
    u64       partition, image number within it   (two values)
    u64       documents, ids, blocks               (three values)
    u64 x (blocks + 1)     byte offset of each block in the payload
    i64 x documents        document ids (the least value marks a null id)
    u64 x (documents + 1)  first id of each document in the image
    payload: blocks of packed ids, least significant bit first, each block
             starting at a byte; then one line feed (the text writer's row end)

Any id is found from its block's offset, so a reader unpacks whole images with
vectorised numpy or single documents without the rest (``read_document``).

Spark's own text writer commits the files (an image is one row, its bytes are not
changed), so they work on any Hadoop file system and a task can be repeated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.llm import tokenizing
from skeinwork.llm.common import materialize, slices, work_dir

MAGIC = b"SKTOKEN1"
NULL_ID = -(1 << 63)
#: Ids in a block, and the ids after which an image ends at the next document.
BLOCK_IDS, IMAGE_IDS = 1 << 14, 1 << 21


def bits_for(vocabulary: int) -> int:
    """Least width that holds ids 0 .. vocabulary - 1."""
    if vocabulary < 1:
        raise ValueError("a vocabulary has one id at least")
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids, each in ``bits`` bits, least significant first, padded to a byte."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id doesn't fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(planes.reshape(-1), bitorder="little").tobytes()


def unpack(raw: bytes | memoryview, n: int, bits: int, first: int = 0) -> np.ndarray:
    """n ids of a block, from its id number ``first`` on, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n, first * bits // 8).astype("<u4")
    data = np.concatenate([np.frombuffer(raw, np.uint8), np.zeros(8, np.uint8)])
    at = (np.arange(first, first + n, dtype=np.int64)) * bits
    byte, shift = at >> 3, (at & 7).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        word |= data[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> shift) & np.uint64((1 << bits) - 1)).astype("<u4")


def image(part: int, number: int, doc_ids: list[int], counts: list[int], ids: np.ndarray, bits: int, block: int = BLOCK_IDS) -> bytes:
    blocks = [pack(ids[k : k + block], bits) for k in range(0, len(ids), block)]
    head = np.array([bits, block], "<u4").tobytes() + np.array([part, number, len(doc_ids), len(ids), len(blocks)], "<u8").tobytes()
    at = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8").tobytes()
    starts = np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes()
    return b"".join([MAGIC, head, at, np.array(doc_ids, "<i8").tobytes(), starts, *blocks])


class Image:
    """A view of one image in ``raw`` that begins at ``at``; ``end`` is where the next one begins."""

    def __init__(self, raw: bytes | memoryview, at: int = 0):
        self.raw = memoryview(raw)
        if bytes(self.raw[at : at + 8]) != MAGIC:
            raise ValueError("not a token image")
        self.bits, self.block = (int(x) for x in np.frombuffer(raw, "<u4", 2, at + 8))
        self.part, self.number, self.n_docs, self.n_ids, n_blocks = (int(x) for x in np.frombuffer(raw, "<u8", 5, at + 16))
        at += 56
        self.offsets = np.frombuffer(raw, "<u8", n_blocks + 1, at).astype(np.int64)
        self.doc_ids = np.frombuffer(raw, "<i8", self.n_docs, at := at + 8 * (n_blocks + 1))
        self.starts = np.frombuffer(raw, "<u8", self.n_docs + 1, at := at + 8 * self.n_docs).astype(np.int64)
        self.payload = at + 8 * (self.n_docs + 1)
        self.end = self.payload + int(self.offsets[-1]) + 1

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n of the image; reads only the blocks that hold them."""
        out = []
        while n > 0:
            b, inside = divmod(start, self.block)
            take = min(n, self.block - inside)
            raw = self.raw[self.payload + int(self.offsets[b]) : self.payload + int(self.offsets[b + 1])]
            out.append(unpack(raw, take, self.bits, inside))
            start, n = start + take, n - take
        return np.concatenate(out) if out else np.zeros(0, "<u4")

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k]))


def images(content: bytes | memoryview) -> Iterator[Image]:
    at = 0
    while at < len(content):
        x = Image(content, at)
        yield x
        at = x.end


def write(docs: DataFrame, path: str, vocabulary: str, *, end_id: int = 1, image_ids: int = IMAGE_IDS) -> None:
    """Encode ``docs`` (doc_id, text; other columns are not read) and write the files, ascending by doc_id.

    A null or empty text is the end id alone.  Null doc_ids come first.  Repeated
    rows are kept as often as they occur.  An empty table writes no image.
    """
    bits = bits_for(max(tokenizing.vocabulary_size(vocabulary), end_id + 1))
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizing.encoder(vocabulary)
        part, number = TaskContext.get().partitionId(), 0
        doc_ids: list[int] = []
        raws: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            row = image(part, number, doc_ids, [len(r) // 4 for r in raws], np.frombuffer(b"".join(raws), "<u4"), bits)
            doc_ids.clear(), raws.clear()
            number, held = number + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], ["image"])

        for b in batches:
            for part_ in slices(b, "text"):
                for doc, raw in zip(part_.column(0).to_pylist(), encoder.encode_all(part_.column(1).to_pylist()), strict=True):
                    raws.append(raw + end)
                    doc_ids.append(NULL_ID if doc is None else doc)
                    held += len(raws[-1]) // 4
                    if held >= image_ids:
                        yield flush()
        if doc_ids:
            yield flush()

    # the second key spreads repeated ids and settles their order
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows.mapInArrow(encode, "image binary").select(F.col("image").cast("string").alias("value")).write.text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, in file order by ``start``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                for x in images(content.as_buffer()):
                    all_ids = x.ids(0, x.n_ids)
                    crc = [zlib.crc32(all_ids[s:e]) for s, e in zip(x.starts[:-1].tolist(), x.starts[1:].tolist(), strict=True)]
                    ids = pa.array(x.doc_ids, pa.int64(), mask=x.doc_ids == NULL_ID)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(x.n_docs, x.part)), pa.array(np.full(x.n_docs, x.number)), ids, pa.array(x.starts[:-1]), pa.array(np.diff(x.starts)), pa.array(crc, pa.int64())],
                        ["part", "number", "doc_id", "within", "n_tokens", "ids_crc32"],
                    )

    rows = spark.read.format("binaryFile").load(path).select("content")
    rows = materialize(rows.mapInArrow(parse, "part long, number long, doc_id long, within long, n_tokens long, ids_crc32 long"), "token-index")
    # one row for each image: a running sum over the list of images, not over documents
    sums = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.orderBy("part", "number")) - F.col("n")).drop("n")
    return rows.join(before, ["part", "number"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str, *, end_id: int = 1) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    path = work_dir(docs.sparkSession, "tokens")
    write(docs, path, vocabulary, end_id=end_id)
    return read(docs.sparkSession, path)
