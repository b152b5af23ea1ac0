"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Bands and rows are chosen for a target recall at the threshold.  Texts with
equal n-gram sets are one node, by 128 bits of two independent hashes of the set
(under 64 bits of which nodes are named; rows that agree in the first hash alone
are told apart).  Nodes that share a band's hash become the star
of that bucket's smallest node, never all its pairs.  The stars' components are
candidates, and every pair of nodes within one is verified on the nodes' whole
n-gram sets, in blocks (see ``blocks``).  A node's set is read again from the row
with its smallest key, or, where no row has a key, from any of its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ledgerline.llm.blocks import linked
from ledgerline.llm.texts import mix64, small_batches, string_bytes, word_hashes
from ledgerline.operators.graph import connected_components
from ledgerline.session import cut

NGRAM, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.999, 160
BLOCK = 256
#: A list of up to so many keys (24 bytes each) is sent to every executor.
BROADCAST_ROWS = 500_000
BATCH_ROWS = 500


def choose_bands(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band such that pairs at ``threshold`` meet.

    A pair of similarity s meets with probability ``1 - (1 - s**rows)**bands``.
    More rows mean fewer candidates below the threshold.
    """
    best = None
    for rows in range(1, hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))))
        if bands * rows > hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError("too few hashes for that recall")
    return best


def ngrams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every text's word n-grams, in order, and offsets.

    A text of fewer words has one n-gram of all its words; one without any has
    none.
    """
    words, at = word_hashes(data, offsets)
    count = np.diff(at)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    cuts = np.zeros(len(grams) + 1, np.int64)
    np.cumsum(grams, out=cuts[1:])
    owner = np.repeat(np.arange(len(grams)), grams)
    start = at[owner] + np.arange(len(owner)) - cuts[owner]
    out = np.zeros(len(start), np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    short = count[owner] < n
    for k in range(n):
        part = padded[start + k]
        if short.any():
            part = np.where(short & (k >= count[owner]), np.uint64(0), part)
        out = out * np.uint64(0xD6E8FEB86659FD93) + part
    return mix64(out + np.minimum(count[owner], n).astype(np.uint64)), cuts


def _permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, count, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, np.uint32)


def band_hashes(grams: np.ndarray, cuts: np.ndarray, bands: int, rows: int, seed: int = 2) -> np.ndarray:
    """(texts with n-grams, bands): one 64-bit hash of each band's minima."""
    some = np.diff(cuts) > 0
    starts = cuts[:-1][some]
    x = (grams >> np.uint64(32)).astype(np.uint32)
    a, b = _permutations(bands * rows, seed)
    out = np.empty((int(some.sum()), bands), np.uint64)
    if not len(starts):
        return out
    y = np.empty_like(x)
    for band in range(bands):
        mixed = np.full(len(starts), band + 1, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            np.multiply(x, a[k], out=y)
            np.add(y, b[k], out=y)
            mixed = mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(y, starts))
        out[:, band] = mixed
    return out


def _sets(grams: np.ndarray, cuts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each text's distinct n-grams, sorted, and two hashes of that set."""
    sets = [np.unique(grams[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    some = sizes > 0
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    starts = (np.cumsum(sizes) - sizes)[some]
    out = np.zeros((2, len(sets)), np.uint64)
    for k, salt in enumerate((0, 0xA24BAED4963EE407)):
        if len(starts):
            out[k, some] = mix64(np.add.reduceat(mix64(flat ^ np.uint64(salt)), starts) + sizes[some].astype(np.uint64))
    return sets, out[0], out[1]


def jaccard_links(threshold: float):
    """links() of two lists of n-gram sets (bytes of sorted 64-bit numbers)."""

    def links(left: list[bytes], right: list[bytes]) -> np.ndarray:
        sets = [np.frombuffer(s, np.uint64) for s in (*left, *right)]
        sizes = np.array([len(s) for s in sets])
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        # Only n-grams of both sides can be common ones.
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        column = np.cumsum(new) - 1
        on_left = owner < len(left)
        counts = [np.bincount(column, side, int(column[-1]) + 1 if len(column) else 0) for side in (on_left, ~on_left)]
        both = (counts[0] > 0) & (counts[1] > 0) if len(column) else np.zeros(0, bool)
        keep = both[column] if len(column) else np.zeros(0, bool)
        owner, column = owner[keep], (np.cumsum(both) - 1)[column[keep]] if len(column) else column
        common = np.zeros((len(left), len(right)), np.float32)
        step = 8192
        cuts = np.searchsorted(column, np.arange(0, (int(column[-1]) + 1 if len(column) else 0) + step, step))
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if a == b:
                continue
            part = np.zeros((len(sets), step), np.float32)
            part[owner[a:b], column[a:b] - i * step] = 1
            common += part[: len(left)] @ part[len(left) :].T
        common = common.astype(np.float64)
        union = sizes[: len(left), None] + sizes[None, len(left) :] - common
        return common / np.maximum(union, 1) >= threshold

    return links


def similarity_classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    n: int = NGRAM,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    block: int = BLOCK,
    broadcast_rows: int = BROADCAST_ROWS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: key, class_id, n_links and kept, with the columns to ``carry``.

    Two rows are linked if their sets of word n-grams have a Jaccard similarity
    of ``threshold`` or more; ``n_links`` counts the rows that a row is linked
    with, and ``class_id`` is the smallest key reachable by links, its own
    included.  One row of each class is kept: the one with that key, and one of
    them if several have it.  Texts of fewer than ``n`` words are one n-gram; a
    text without words (null too) is linked with nothing, its class is itself
    and it is kept.  Rows with a null key are linked like all others, but come
    last: a class of null keys alone has class_id null and one of its rows is
    kept.  Other columns are ignored, whatever their names; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    bands, rows = choose_bands(threshold, recall, HASHES)
    picked = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"), *carry)
    signature = T.StructType().add("id", "long").add("node", "long").add("check", "long").add("bands", T.ArrayType(T.LongType()))
    for name in carry:
        signature = signature.add(source.schema[name])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "t"):
            grams, cuts = ngrams(*string_bytes(batch.column(1)), n)
            _, keys, others = _sets(grams, cuts)
            empty = np.diff(cuts) == 0
            hashes = band_hashes(grams, cuts, bands, rows).view(np.int64)
            ends = np.zeros(len(keys) + 1, np.int32)
            np.cumsum(~empty * bands, out=ends[1:])
            yield pa.record_batch(
                [batch.column(0), pa.array(keys.view(np.int64), mask=empty), pa.array(others.view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(hashes.ravel())), *batch.columns[2:]],
                names=["id", "node", "check", "bands", *carry],
            )

    signed = cut(source.mapInArrow(sign, signature), "signed")

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.filter("node is not null").groupBy("node").agg(
            F.min("id").alias("low"), F.count("*").alias("size"), F.first("bands").alias("bands"), F.min("check").alias("check"), F.max("check").alias("_last")
        )

    classes = cut(grouped(signed), "classes")
    if not (split := classes.filter("check <> _last").select(F.col("node").alias("_s"))).isEmpty():
        # Different sets under one hash: these rows are named by both hashes.
        named = signed.join(split, F.col("node") == F.col("_s"), "left")
        signed = cut(named.withColumn("node", F.when(F.col("_s").isNull(), F.col("node")).otherwise(F.xxhash64("node", "check"))).drop("_s"), "signed")
        classes = cut(grouped(signed), "classes")
    # A bucket's star: each node with the bucket's smallest.
    buckets = classes.select("node", F.explode("bands").alias("band"))
    stars = buckets.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot <> last")
    edges = buckets.join(stars.select(F.col("band").alias("_b"), "pivot"), F.col("band") == F.col("_b")).select("node", "pivot")
    candidates = connected_components(edges, "node", "pivot")

    chosen = classes.select("node", "low", "size", "check").join(candidates, F.col("node") == F.col("id")).drop("id")
    chosen = cut(chosen, "candidates")

    def sent(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= broadcast_rows else rows

    keyed = chosen.filter("low is not null")
    read = picked.join(sent(keyed), F.col("id") == F.col("low")).select("component", "node", "size", "check", "t")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "t"):
            sets, _, others = _sets(*ngrams(*string_bytes(batch.column(4)), n))
            # A key that occurs twice may bring another row's text.
            same = others.view(np.int64) == batch.column(3).to_numpy()
            payload = pa.array([s.tobytes() for s in sets], pa.large_binary())
            yield pa.record_batch([*batch.columns[:3], payload], names=["component", "node", "weight", "payload"]).filter(pa.array(same))

    schema = "component long, node long, weight long, payload binary"
    members = read.mapInArrow(collect, schema)
    unnamed = cut(chosen.filter("low is null"), "unnamed")
    if not unnamed.isEmpty():  # sets that only rows without a key have

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, "t"):
                sets, _, others = _sets(*ngrams(*string_bytes(batch.column(0)), n))
                yield pa.record_batch([pa.array(others.view(np.int64)), pa.array([s.tobytes() for s in sets], pa.large_binary())], names=["_check", "payload"])

        texts = picked.filter("id is null").select("t").mapInArrow(again, "_check long, payload binary")
        met = texts.join(sent(unnamed), F.col("_check") == F.col("check")).dropDuplicates(["node"])
        members = members.unionByName(met.select("component", "node", F.col("size").alias("weight"), "payload"))
    totals, components = linked(members, jaccard_links(threshold), block)
    named = (
        classes.select("node", "low", "size")
        .join(totals.withColumnRenamed("node", "_t"), F.col("node") == F.col("_t"), "left")
        .join(components, F.col("node") == F.col("id"), "left")
        .select("node", "low", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    named = cut(named, "named")
    lowest = named.groupBy("component").agg(F.min("low").alias("class_id")).withColumnRenamed("component", "_c")
    named = named.join(lowest, F.col("component") == F.col("_c")).select(F.col("node").alias("_n"), "n_links", "class_id", "component")
    whole = signed.select("id", "node", *carry).join(named, F.col("node") == F.col("_n"), "left")
    whole = whole.select(
        "id",
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "component",
        *carry,
    )
    first = F.col("component").isNotNull() & F.col("id").eqNullSafe(F.col("class_id"))
    # Usually one row a class, so the window below is over single rows.
    place = F.row_number().over(Window.partitionBy("component").orderBy(F.lit(0)))
    stays = whole.filter(first).withColumn("kept", place == 1)
    others = whole.filter(~first).withColumn("kept", F.col("component").isNull())
    return stays.unionByName(others).select(F.col("id").alias(key), "class_id", "n_links", "kept", *carry)
