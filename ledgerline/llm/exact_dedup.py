"""Exact dedup by a log-structured merge index of text digests.

Scan tasks fill bounded memtables with (digest, smallest id, rows) and flush
each as sorted digest runs, one per digest range ("shard"), together with a
Bloom filter.  Compaction merges the runs of a shard level by level, a few at a
time: a digest that no other filter of its batch may hold passes without a merge;
the others are merged keeping the smallest identifier and the summed rows.  A memtable holds a
digest once, so a text that is copied millions of times reaches compaction as
one entry per flush.  Hits (digests of two rows or more) then receive byte
verification: members are compared with the text that stays, and the members of
a digest under which bytes differ are grouped anew by their full SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerline.llm.texts import string_bytes
from ledgerline.session import cut, task_count

#: Entries of one memtable (48 bytes each) and bits a key in a run's filter.
MEMTABLE = 500_000
FILTER_BITS = 10
#: Rows of a digest range, and rows of one text that share a task.
SHARD_ROWS = 400_000
HOT = 512
#: A list of up to so many ids (8 bytes each) is sent to every executor.
BROADCAST_IDS = 1_000_000
#: Up to so many hot texts (50 bytes each) are sent to every executor; beyond, rows
#: are dealt by text and one of so many salts.
HOT_TEXTS, SALTS = 100_000, 16
#: Arrow rows at once, so that a batch of long texts fits in memory.
BATCH_ROWS = 1000

_SPACES = b" \t\n\x0b\x0c\r"


def normalised(text: bytes) -> bytes:
    """The text with every run of ASCII white space as one space."""
    out = b" ".join(text.split())
    if not out:
        return b" " if text else b""
    return (b" " if text[0] in _SPACES else b"") + out + (b" " if text[-1] in _SPACES else b"")


def _normalised_column(column: pa.Array) -> list[bytes]:
    data, offsets = string_bytes(column)
    raw = data.tobytes()
    return [normalised(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", digest_bits: int = 256, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, sha, digest) of every row, and the columns to carry; the digest is the SHA-256's first bits."""
    size = digest_bits // 8
    picked = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"), *carry)
    schema = T.StructType().add("id", "long").add("sha", "string").add("digest", "binary")
    for name in carry:
        schema = schema.add(picked.schema[name])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = [hashlib.sha256(t).digest() for t in _normalised_column(batch.column(1))]
            yield pa.record_batch(
                [batch.column(0), pa.array([d.hex() for d in full]), pa.array([d[:size] for d in full], pa.binary()), *batch.columns[2:]],
                names=["id", "sha", "digest", *carry],
            )

    return picked.mapInArrow(scan, schema)


def _lanes(blob: bytes | np.ndarray, n: int, size: int) -> np.ndarray:
    """Digests as big-endian numbers, zero-padded to 32 bytes: shape (n, 4)."""
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :size] = np.frombuffer(blob, np.uint8).reshape(n, size)
    return wide.view(">u8").astype(np.uint64)


def _merge(lanes: np.ndarray, low: np.ndarray, rows: np.ndarray, ties: np.ndarray):
    """Equal digests as one entry: smallest id, rows, rows that have that id."""
    order = np.lexsort((low, lanes[:, 3], lanes[:, 2], lanes[:, 1], lanes[:, 0]))
    lanes, low, rows, ties = lanes[order], low[order], rows[order], ties[order]
    if not len(lanes):
        return lanes, low, rows, ties
    start = np.flatnonzero(np.concatenate([[True], (lanes[1:] != lanes[:-1]).any(1)]))
    size = np.diff(np.append(start, len(lanes)))
    least = low[start]
    return (
        lanes[start],
        least,
        np.add.reduceat(rows, start),
        np.add.reduceat(np.where(low == np.repeat(least, size), ties, 0), start),
    )


def _filter_bits(lanes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Double hashing with two lanes of the digest: seven positions a key."""
    a, b = lanes[:, 0] ^ lanes[:, 2], (lanes[:, 1] ^ lanes[:, 3]) | np.uint64(1)
    a = a * np.uint64(0x9E3779B97F4A7C15) ^ (a >> np.uint64(29))
    for i in range(7):
        yield (a + np.uint64(i) * b) % np.uint64(bits)


def bloom(lanes: np.ndarray) -> bytes:
    bits = max(64, len(lanes) * FILTER_BITS)
    out = np.zeros(-(-bits // 8), np.uint8)
    for at in _filter_bits(lanes, bits):
        np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return bits.to_bytes(8, "little") + out.tobytes()


def may_hold(blob: bytes, lanes: np.ndarray) -> np.ndarray:
    bits = int.from_bytes(blob[:8], "little")
    table = np.frombuffer(blob, np.uint8, offset=8)
    found = np.ones(len(lanes), bool)
    for at in _filter_bits(lanes, bits):
        found &= (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found


_RUN = "shard int, entries int, digests binary, low binary, n binary, ties binary, filter binary"
_NO_ID = np.iinfo(np.int64).max  # a null id sorts last


def _flush(parts: list, shards: int) -> Iterator[pa.RecordBatch]:
    lanes, low, rows, ties = _merge(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    # The digest's leading 32 bits cut the key space into even ranges.
    shard = ((lanes[:, 0] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out.append(
            (int(shard[a]), int(b - a), lanes[a:b].tobytes(), low[a:b].tobytes(), rows[a:b].tobytes(), ties[a:b].tobytes(), bloom(lanes[a:b]))
        )
    names = [x.split()[0] for x in _RUN.split(", ")]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    for i in range(0, len(out), 256):
        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out[i : i + 256], strict=True), kinds, strict=True)], names=names)


def flush_runs(keyed: DataFrame, shards: int, memtable: int = MEMTABLE) -> DataFrame:
    """Sorted digest runs of (id, digest) rows, with filters."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            flat = batch.column(1).to_pylist()
            one = np.ones(len(ids), np.int64)
            held.append((_lanes(b"".join(flat), len(flat), len(flat[0])), ids, one, one))
            n += len(ids)
            if n >= memtable:
                yield from _flush(held, shards)
                held, n = [], 0
        if held:
            yield from _flush(held, shards)

    return keyed.select("id", "digest").mapInArrow(scan, _RUN)


def _level(batch: list[tuple], last: bool) -> tuple:
    """One run, and its filter unless it is the ``last``, of a batch of (columns, filter)."""
    if len(batch) == 1:
        return batch[0]
    shared, rest = [], []
    for i, (run, _) in enumerate(batch):
        met = np.zeros(len(run[0]), bool)
        for j, (_, other) in enumerate(batch):
            if i != j and not met.all():
                open_ = np.flatnonzero(~met)
                met[open_] = may_hold(other, run[0][open_])
        shared.append(tuple(x[met] for x in run))
        rest.append(tuple(x[~met] for x in run))
    merged = _merge(*(np.concatenate(x) for x in zip(*shared, strict=True)))
    out = tuple(np.concatenate(x) for x in zip(merged, *rest, strict=True))
    return out, None if last else bloom(out[0])


def compact(runs: DataFrame, size: int, fan_in: int = 16) -> DataFrame:
    """Hits of the index: (digest, keep_id, group_size, ties), two rows or more.

    ``fan_in`` runs of a shard are merged at a time, the result is a run of the
    next level, so work is in proportion to entries and levels, not to pairs of
    runs.  Entries that no other filter of a batch may hold skip its merge.
    """

    def shard(rows: list[dict]) -> Iterator[tuple]:
        level = [
            ((np.frombuffer(r["digests"], np.uint64).reshape(-1, 4), *(np.frombuffer(r[k], np.int64) for k in ("low", "n", "ties"))), r["filter"])
            for r in rows
        ]
        while len(level) > 1:
            level = [_level(level[i : i + fan_in], len(level) <= fan_in) for i in range(0, len(level), fan_in)]
        lanes, low, n, ties = level[0][0]
        more = np.flatnonzero(n > 1)
        wide = lanes[more].astype(">u8").tobytes()
        yield from (
            (wide[32 * i : 32 * i + size], None if low[j] == _NO_ID else int(low[j]), int(n[j]), int(ties[j])) for i, j in enumerate(more)
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        out: list[tuple] = []

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            return pa.record_batch(
                [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["digest", "keep_id", "group_size", "ties"]
            )

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["shard"] != row["shard"]:
                    out += shard(held)
                    held = []
                held.append(row)
            if len(out) > 50_000:
                yield batch_of(out)
                out = []
        if held:
            out += shard(held)
        yield batch_of(out)

    dealt = runs.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(scan, "digest binary, keep_id long, group_size long, ties long")


def exact_dedup(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    digest_bits: int = 256,
    memtable: int = MEMTABLE,
    broadcast_ids: int = BROADCAST_IDS,
    hot_texts: int = HOT_TEXTS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: which row of its text stays, with the columns to ``carry``.

    Returns key, keep_id, group_size, kept and text_sha256 (of the normalised
    text).  Null texts count as empty.  Of equal texts the smallest key stays;
    exactly one row of a group is kept, also if several rows have that key.  A
    null key comes after all others: it stays only where every row of the text
    has a null key (keep_id is null then).  Other columns are ignored, whatever
    their names; an empty table gives an empty result.  ``digest_bits`` under
    256 is for tests of the byte verification.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    keyed = cut(digests(docs, key, text, digest_bits, carry), "digests")
    rows = keyed.count()
    shards = max(16, -(-rows // SHARD_ROWS))
    runs = cut(flush_runs(keyed, shards, memtable), "runs")
    index = cut(compact(runs, digest_bits // 8), "hits")

    # A text of more than HOT rows is in few hits; they are dealt with apart.
    named = index.select(F.col("digest").alias("_d"), "keep_id", "group_size", "ties")
    hot = F.col("group_size") > HOT
    salts = F.when(hot, F.ceil(F.col("group_size") / HOT)).otherwise(1).cast("int")
    hot_rows = named.filter(hot)
    hot_count = hot_rows.count()
    if hot_count <= hot_texts:
        marked = keyed.join(F.broadcast(hot_rows), F.col("digest") == F.col("_d"), "left").drop("_d")
        on_hot = marked.filter(F.col("group_size").isNotNull())
        rest = marked.filter(F.col("group_size").isNull()).select("id", "sha", "digest", *carry)
        rest = rest.join(named.filter(~hot), F.col("digest") == F.col("_d"), "left").drop("_d")
        joined = rest.unionByName(on_hot)
    else:  # too many to send: every hit is there once a salt, and a row meets the one of its own
        spread = named.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = keyed.withColumn("_salt", F.pmod(F.xxhash64("id", "sha", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
        joined = salted.join(spread, (F.col("digest") == F.col("_d")) & (F.col("_salt") == F.col("_s")), "left").drop("_d", "_s", "_salt")
    joined = cut(joined, "resolved")
    single = joined.filter(F.col("group_size").isNull()).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", *carry
    )
    members = joined.filter(F.col("group_size").isNotNull())
    bad = cut(_mismatches(docs, members, key, text, salts, broadcast_ids, digest_bits // 8), "mismatches")
    if bad.isEmpty():
        return _named(single.unionByName(_kept(members, carry)), key, carry)
    # Digests that two texts share: their members are grouped by whole texts.
    wrong = bad.select("digest").distinct()
    good = members.join(wrong, "digest", "left_anti")
    split = members.join(wrong, "digest", "left_semi").select("id", "sha", *carry)
    groups = split.groupBy("sha").agg(
        F.min("id").alias("keep_id"), F.count("*").alias("group_size"), F.min(F.coalesce("id", F.lit(_NO_ID))).alias("_low")
    )
    split = split.join(groups, "sha")
    ties = split.groupBy("sha").agg(F.sum((F.coalesce("id", F.lit(_NO_ID)) == F.col("_low")).cast("long")).alias("ties"))
    return _named(single.unionByName(_kept(good, carry)).unionByName(_kept(split.drop("_low").join(ties, "sha"), carry)), key, carry)


def _kept(members: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Marks one row of each group; rows with the smallest key are numbered only where they tie."""
    at = F.col("id").eqNullSafe(F.col("keep_id"))
    names = ["id", "keep_id", "group_size", "kept", "sha", *carry]
    plain = members.filter(~at | (F.col("ties") == 1)).withColumn("kept", at).select(*names)
    # Tied rows are equal in id and text: any one of them may stay.
    tied = members.filter(at & (F.col("ties") > 1)).withColumn("_n", F.monotonically_increasing_id())
    tied = cut(tied, "tied")
    if tied.isEmpty():
        return plain
    first = tied.groupBy("sha").agg(F.min("_n").alias("_first"))
    tied = tied.join(first, "sha").withColumn("kept", F.col("_n") == F.col("_first"))
    return plain.unionByName(tied.select(*names))


def _named(rows: DataFrame, key: str, carry: tuple[str, ...]) -> DataFrame:
    return rows.select(F.col("id").alias(key), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"), *carry)


def _mismatches(
    docs: DataFrame, members: DataFrame, key: str, text: str, salts, broadcast_ids: int, size: int
) -> DataFrame:
    """Members whose normalised bytes differ from those of the row that stays.

    The texts of members alone are read again and dealt by (digest, salt), so
    that a hot text is compared in many tasks, each of which has the kept text.
    """
    ids = members.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("_id"), "digest", "keep_id", salts.alias("_salts")
    ).distinct()
    wanted = ids.count()
    side = F.broadcast(ids) if wanted <= broadcast_ids // 8 else ids
    source = docs.select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    read = source.join(side, "_id")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(_normalised_column(batch.column(batch.num_columns - 1)), pa.large_binary())],
                names=["_id", "digest", "keep_id", "_salts", "_bytes"],
            )

    texts = read.select("_id", "digest", "keep_id", "_salts", "_t").mapInArrow(
        squeeze, "_id long, digest binary, keep_id long, _salts int, _bytes binary"
    )
    members_ = texts.filter(F.col("_id") != F.col("keep_id")).select(
        "_id", "digest", F.pmod("_id", "_salts").cast("int").alias("_salt"), "_bytes"
    )
    stays = texts.filter(F.col("_id") == F.col("keep_id")).select("digest", "_salts", "_bytes")
    bare = cut(members.filter(F.col("id").isNull()).select("digest", "keep_id", salts.alias("_salts")).distinct(), "bare")
    if not bare.isEmpty():  # rows without an id are named by their digest, which is made again

        def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = _normalised_column(batch.column(0))
                marks = [hashlib.sha256(t).digest()[:size] for t in texts]
                yield pa.record_batch([pa.array(marks, pa.binary()), pa.array(texts, pa.large_binary())], names=["digest", "_bytes"])

        again = source.filter(F.col("_id").isNull()).select("_t").mapInArrow(digested, "digest binary, _bytes binary")
        again = again.join(F.broadcast(bare) if bare.count() <= broadcast_ids // 8 else bare, "digest")
        salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_salts")).cast("int").alias("_salt")
        members_ = members_.unionByName(again.select(F.lit(None).cast("long").alias("_id"), "digest", salt, "_bytes"))
        # Where no row has an id, the smallest text of the digest is what the others are compared with.
        alone = again.filter(F.col("keep_id").isNull()).groupBy("digest").agg(F.max("_salts").alias("_salts"), F.min("_bytes").alias("_bytes"))
        stays = stays.unionByName(alone)
    stays = stays.select(
        F.col("digest").alias("_d"), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_k"), F.col("_bytes").alias("_kept")
    ).dropDuplicates(["_d", "_k"])
    return (
        members_.join(stays, (F.col("digest") == F.col("_d")) & (F.col("_salt") == F.col("_k")))
        .filter(F.col("_bytes") != F.col("_kept"))
        .select(F.col("_id").alias("id"), "digest")
    )
