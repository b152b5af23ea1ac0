"""Best-fit packing of token sequences under several capacities.

Every document becomes pieces of at most ``tokens`` ids; only longer documents
are cut, and only their first piece may be shorter.  Full pieces are sequences
of their own.  The rest is packed by vector best-fit: a piece takes part of
three capacities of a bin (tokens, documents, attention cost, the sum of squared
lengths), and goes to the bin with the best score among those where it fits
under every constraint: the largest weighted dot product of demand and residual
capacity, or the smallest norm of what would be left.

Pieces are dealt to packing tasks by their place in the written table, so that
no task holds more than a bounded share, whatever ids repeat or are missing; a
task leaves a few bins partly empty at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerline.llm.texts import bpe_encoder, crc32_of_ids, small_batches
from ledgerline.session import cut

#: Pieces of one packing task; more make fewer partly filled bins.
TASK_PIECES = 50_000
BATCH_ROWS = 500


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most; None leaves a dimension unbounded."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)
    score: str = "norm"


#: What the queries pack to: a sequence of 2048 one-token documents, or one document
#: of 2048 tokens, is the most that its tokens allow, so neither bound costs sequences.
PRODUCTION = Capacity(2048, 2048, 2048 * 2048)

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, vocabulary: str, tokens: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document: ids of its whole text, then ``end_id``."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe_encoder(vocabulary)
        end = np.array([end_id], np.uint16)
        for batch in small_batches(batches, "t"):
            rows = []
            keys = batch.column(0).to_pylist()
            for name, got in zip(keys, encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = np.concatenate([got, end]).astype("<u4")
                first = len(ids) % tokens or tokens
                edges = [0, *range(first, len(ids) + 1, tokens)]
                rows += [(name, i, a, b - a, crc32_of_ids(ids[a:b])) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _PIECES.split(", ")])

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(scan, _PIECES)


def pack_lengths(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of every piece, and the number of bins.

    Longest pieces first.  Every piece is scored against the residual capacities
    of all open bins where it fits at once.  A piece longer than ``tokens`` or
    beyond another capacity on its own is an error, never dropped.
    """
    full = capacity.tokens
    most_docs = capacity.documents or 1 << 62
    most_cost = capacity.attention or 1 << 62
    if len(lengths) and (int(lengths.max()) > full or int(lengths.max()) ** 2 > most_cost or most_docs < 1):
        raise ValueError("a piece exceeds the capacity of an empty sequence")
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    w = capacity.weights
    # Open bins: what is left of tokens, documents and attention cost, and the bin's number.
    left, docs, cost, number = (np.zeros(1024, np.int64) for _ in range(4))
    used = count = 0
    for i in order.tolist():
        size = int(lengths[i])
        square = size * size
        fits = np.flatnonzero((left[:used] >= size) & (docs[:used] >= 1) & (cost[:used] >= square))
        if len(fits):
            have = (left[fits], docs[fits], cost[fits])
            if capacity.score == "norm":
                rest = ((have[0] - size) / full, (have[1] - 1) / most_docs, (have[2] - square) / most_cost)
                value = w[0] * rest[0] ** 2 + w[1] * rest[1] ** 2 + w[2] * rest[2] ** 2
            else:
                value = -(w[0] * size / full * (have[0] / full) + w[1] / most_docs * (have[1] / most_docs) + w[2] * square / most_cost * (have[2] / most_cost))
            at = int(fits[np.argmin(value)])
        else:
            if used == len(left):
                left, docs, cost, number = (np.concatenate([x, np.zeros_like(x)]) for x in (left, docs, cost, number))
            at, used = used, used + 1
            left[at], docs[at], cost[at], number[at] = full, most_docs, most_cost, count
            count += 1
        bins[i], offsets[i] = number[at], full - left[at]
        left[at] -= size
        docs[at] -= 1
        cost[at] -= square
        if not (left[at] and docs[at] and cost[at]):  # closed: the last open bin takes its place
            used -= 1
            for x in (left, docs, cost, number):
                x[at] = x[used]
    return bins, offsets, count


def best_fit(pieces: DataFrame, capacity: Capacity = Capacity(), task_pieces: int = TASK_PIECES) -> DataFrame:
    """``pieces`` (with a length column) and their sequence_id and offset.

    Sequences are numbered without gaps within a task, and tasks' numbers do not
    meet.  Other columns pass through.  Null or non-positive lengths are errors;
    no pieces give no rows.
    """
    kept = cut(pieces, "pieces")
    rows = kept.filter(F.col("length") < capacity.tokens).count()
    tasks = max(1, -(-rows // task_pieces))
    schema = T.StructType(list(kept.schema.fields)).add("sequence_id", "long").add("offset", "long")
    names = schema.fieldNames()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = None
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
        if not held:
            return
        table = pa.Table.from_batches(held)
        number = table.column("_task").to_numpy()
        parts = table.drop(["_task"])
        for task in np.unique(number):
            rows = parts.take(np.flatnonzero(number == task))
            bins, offsets, _ = pack_lengths(rows.column("length").to_numpy(), capacity)
            out = rows.append_column("sequence_id", pa.array(bins * 2 * tasks + 2 * int(task))).append_column("offset", pa.array(offsets))
            yield from out.select(names).to_batches()

    alone = kept.filter(F.col("length") >= capacity.tokens)
    alone = alone.withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    task = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(tasks)).cast("int")
    dealt = kept.filter(F.col("length") < capacity.tokens).withColumn("_task", task).repartition(tasks, "_task")
    return alone.unionByName(dealt.mapInArrow(scan, schema))


def pack(docs: DataFrame, vocabulary: str, capacity: Capacity = Capacity(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack every row of ``docs``: one row per piece.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset.
    Null texts are empty (one piece: the end id); a null key stays null and
    repeated rows are packed each; other columns are ignored; an empty table
    gives an empty result.
    """
    return best_fit(cut_pieces(docs, vocabulary, capacity.tokens, key=key, text=text), capacity)
