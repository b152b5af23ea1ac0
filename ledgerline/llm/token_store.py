"""Token-id files with Elias-Fano document boundaries.

A table of texts becomes a folder of segment files.  A segment holds the ids of
consecutive documents (ascending by key) as one array of 16- or 32-bit integers;
where each document starts, and the documents' keys, are monotone sequences in
Elias-Fano code: about ``2 + log2(universe / n)`` bits an entry instead of 64.
Sampled select structures (the bit position of every 256th one) give the k-th
entry without decoding the others, so one document is read in constant time.

Segments are rows of Parquet files (uncompressed, a binary column), written by
Spark's committed writer and read by its reader, so any Hadoop file system will
do, a lost executor's task is written anew and no byte depends on a text codec.
Beside a segment stand its file's number, its own number there, its documents and
ids and its smallest and largest key, by which a reader prunes.  Segment layout,
little-endian::

    magic "LLTS0001" | u64 documents | u64 null keys | i64 smallest key
    | u64 ids | u64 bytes an id | boundaries | keys | ids

where boundaries and keys are Elias-Fano blocks ``u64 n | u64 low bits | u64
bytes of low part | u64 bytes of high part | u64 samples | low | high | samples``.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerline.llm.texts import bpe_encoder, crc32_of_ids, small_batches
from ledgerline.session import scratch_path

MAGIC = b"LLTS0001"
SAMPLE = 256
#: Ids of a segment: a file of about 8 MB.
SEGMENT_IDS = 4 << 20
#: A list of up to so many segments (20 bytes each) is sent to every executor.
BROADCAST_SEGMENTS = 500_000
#: Arrow rows at once.
BATCH_ROWS = 500


class EliasFano:
    """A non-decreasing sequence of non-negative integers, with select."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        ups = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ups[-1]) + 1 if n else 0, np.uint8)
        bits[ups] = 1
        if width:
            shifts = np.arange(width, dtype=np.uint64)
            low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        return cls(n, width, low, np.packbits(bits, bitorder="little"), ups[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = struct.pack("<5Q", self.n, self.width, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, blob: memoryview, at: int) -> tuple[EliasFano, int]:
        n, width, nlow, nhigh, count = struct.unpack_from("<5Q", blob, at)
        at += 40
        low = np.frombuffer(blob, np.uint8, nlow, at)
        high = np.frombuffer(blob, np.uint8, nhigh, at + nlow)
        samples = np.frombuffer(blob, "<u4", count, at + nlow + nhigh)
        return cls(n, width, low, high, samples), at + nlow + nhigh + 4 * count

    def _lows(self, first: int, count: int) -> np.ndarray:
        if not self.width:
            return np.zeros(count, np.uint64)
        a, b = first * self.width, (first + count) * self.width
        bits = np.unpackbits(self.low[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 :][: b - a]
        powers = np.uint64(1) << np.arange(self.width, dtype=np.uint64)
        return (bits.reshape(count, self.width) * powers).sum(1, dtype=np.uint64)

    def select(self, k: int) -> int:
        """The k-th value, from the sample before it."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        at = int(self.samples[k // SAMPLE])
        skip = k % SAMPLE
        byte = at >> 3
        bits = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
        bits[: at & 7] = 0
        while True:
            ones = np.flatnonzero(bits)
            if len(ones) > skip:
                up = byte * 8 + int(ones[skip]) - k
                return (up << self.width) | int(self._lows(k, 1)[0])
            skip -= len(ones)
            byte += len(bits) >> 3
            bits = np.unpackbits(self.high[byte : byte + 64], bitorder="little")

    def block(self, number: int) -> np.ndarray:
        """Entries ``SAMPLE * number`` and on, ``SAMPLE`` at most, by selecting from one sample."""
        first = number * SAMPLE
        count = min(SAMPLE, self.n - first)
        at = int(self.samples[number])
        byte, stop = at >> 3, len(self.high) if number + 1 == len(self.samples) else (int(self.samples[number + 1]) >> 3) + 1
        bits = np.unpackbits(self.high[byte:stop], bitorder="little")
        bits[: at & 7] = 0
        ups = byte * 8 + np.flatnonzero(bits)[:count] - np.arange(first, first + count)
        return (ups.astype(np.uint64) << np.uint64(self.width)) | self._lows(first, count)


def pack_segment(keys: list[int | None], ids: list[np.ndarray], wide: bool = False) -> bytes:
    """One segment; null keys come first, the others ascend."""
    nulls = sum(k is None for k in keys)
    some = np.array(keys[nulls:], np.int64)
    least = int(some[0]) if len(some) else 0
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    starts = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    kind = "<u4" if wide else "<u2"
    head = MAGIC + struct.pack("<QQqQQ", len(keys), nulls, least, total, 4 if wide else 2)
    body = np.concatenate(ids).astype(kind).tobytes() if ids else b""
    return b"".join([head, EliasFano.encode(starts).to_bytes(), EliasFano.encode((some - least).astype(np.uint64)).to_bytes(), body])


class Segment:
    """A segment read in place: ``document(k)`` decodes only what it needs."""

    def __init__(self, blob: memoryview):
        if bytes(blob[:8]) != MAGIC:
            raise ValueError("not a token segment")
        self.n, self.nulls, self.least, self.total, wide = struct.unpack_from("<QQqQQ", blob, 8)
        self.starts, at = EliasFano.from_bytes(blob, 48)
        self.keys, at = EliasFano.from_bytes(blob, at)
        self.ids = np.frombuffer(blob, "<u4" if wide == 4 else "<u2", self.total, at)

    def document(self, k: int) -> tuple[int | None, int, np.ndarray]:
        """Key, start and ids of the k-th document, through select."""
        start = self.starts.select(k)
        end = self.starts.select(k + 1) if k + 1 < self.n else self.total
        key = None if k < self.nulls else self.keys.select(k - self.nulls) + self.least
        return key, start, self.ids[start:end]

    def find(self, key: int | None) -> Iterator[int]:
        """Numbers of the documents with this key, by bisection through select."""
        if key is None:
            yield from range(self.nulls)
            return
        low, high = 0, self.keys.n
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.keys.select(middle) + self.least < key else (low, middle)
        while low < self.keys.n and self.keys.select(low) + self.least == key:
            yield self.nulls + low
            low += 1

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """All documents in order; boundaries are selected a sample's entries at a time, never as one table."""
        keys = itertools.chain(itertools.repeat(None, self.nulls), self._entries(self.keys, self.least))
        for key, (a, b) in zip(keys, itertools.pairwise(itertools.chain(self._entries(self.starts, 0), [self.total])), strict=True):
            yield key, a, self.ids[a:b]

    @staticmethod
    def _entries(code: EliasFano, more: int) -> Iterator[int]:
        for number in range(len(code.samples)):
            yield from (code.block(number).astype(np.int64) + more).tolist()


SEGMENTS = "file int, number int, documents long, ids long, low long, high long, segment binary"


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int = 0,
    key: str = "doc_id",
    text: str = "text",
    rows_per_file: int = 20_000,
    bytes_per_file: int = 64 << 20,
) -> None:
    """Encode every whole text, append ``end_id``, and write segment files.

    Files follow each other in ascending key order by number.  Null texts are
    empty (their ids are the end id alone), null keys come first, rows with
    equal keys follow each other in any order, other columns are ignored and an
    empty table writes files without documents.  A file holds one range of keys,
    of about as many rows or text bytes as given; its segments bound a writer's
    and a reader's memory, whatever the texts' lengths.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe_encoder(vocabulary)
        end = np.array([end_id], np.uint16)
        file, number = TaskContext.get().partitionId(), itertools.count()
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        size = 0

        def segment() -> pa.RecordBatch:
            some = [k for k in keys if k is not None] or [None]
            row = (file, next(number), len(keys), sum(map(len, ids)), some[0], some[-1], pack_segment(keys, ids))
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in SEGMENTS.split(", ")])

        for batch in small_batches(batches, "t", 4 << 20):
            keys += batch.column(0).to_pylist()
            for got in encode([t or "" for t in batch.column(1).to_pylist()]):
                ids.append(np.concatenate([got, end]))
                size += len(got) + 1
            if size >= SEGMENT_IDS:
                yield segment()
                keys, ids, size = [], [], 0
        if keys:
            yield segment()

    picked = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    rows, size = picked.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    files = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_file), -(-(size or 0) // bytes_per_file))
    dealt = picked.repartitionByRange(files, F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first())
    dealt.mapInArrow(scan, SEGMENTS).write.option("compression", "uncompressed").parquet(path)


def read_tokens(
    spark: SparkSession, path: str, digest: Callable[[np.ndarray], int] = crc32_of_ids
) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in a folder of files.

    Where a segment starts comes from the counts beside it: files are summed,
    and segments within their file, so no window holds more than a file's
    segments or one row a file.
    """
    stored = spark.read.schema(SEGMENTS).parquet(path)
    counts = stored.select("file", "number", "ids")
    totals = counts.groupBy("file").agg(F.sum("ids").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = totals.select(F.col("file").alias("_f"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_before", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(files, F.col("file") == F.col("_f"))
    placed = placed.select(F.col("file").alias("_f"), F.col("number").alias("_s"), (F.col("_base") + F.col("_before")).alias("base"))
    # One row a segment of some megabytes, a few bytes each: sent to all if that is little.
    if placed.count() <= BROADCAST_SEGMENTS:
        placed = F.broadcast(placed)
    whole = stored.join(placed, (F.col("file") == F.col("_f")) & (F.col("number") == F.col("_s"))).select("base", "segment")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(k, base + a, len(ids), digest(ids)) for k, a, ids in Segment(memoryview(content.as_buffer())).documents()]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return whole.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(doc_id, token_ids) of the documents with these keys: only segments whose range holds one are read, only through select."""
    wanted = sorted(set(keys))
    held = None
    for k in wanted:
        inside = F.col("low").isNotNull() & (F.col("low") <= k) & (F.col("high") >= k)
        held = inside if held is None else held | inside
    stored = spark.read.schema(SEGMENTS).parquet(path).filter(F.lit(False) if held is None else held).select("segment")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                segment = Segment(memoryview(content.as_buffer()))
                rows = [segment.document(i) for k in wanted for i in segment.find(k)]
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2].tolist() for r in rows], pa.list_(pa.int32()))], names=["doc_id", "token_ids"])

    return stored.mapInArrow(pick, "doc_id long, token_ids array<int>")


def token_store(docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the token files of ``docs`` and read them back, one row a document."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, end_id)
    return read_tokens(docs.sparkSession, path)
