"""Embedding near-duplicates from a neighbour graph refined by NN-descent.

Vectors of one label start with the best neighbours inside bounded blocks, which
seeded hyperplane codes sort near each other.  Each round joins every vector's
neighbours (both ways) with each other and keeps the best, until few lists
change.  A list whose every entry reaches the threshold is saturated: more links
may lie beyond its end, in its own component or in another.  Saturated lists are
enlarged, and their neighbourhoods joined again, twice over; a list can't hold
the links of a group of thousands, though, so vectors still saturated then are
gathered around pivots, and cells of one label are joined wherever angles
between pivots and the cells' radii leave room for a link.  Members of the
components that this makes are compared in blocks with exact cosines.  An audit compares a sample of queries
from small and from large components with all rows in blocks; a mean recall below
the target in either starts over with longer lists and more codes, and after the
last attempt all vectors of a label are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm.blocks import linked
from ledgerline.llm.texts import group_starts, mix64, whole_groups
from ledgerline.operators.graph import connected_components
from ledgerline.session import cut

THRESHOLD, MARGIN = 0.98, 0.01
#: Entries of a list, of those the ones joined in a round, codes, and their bits.
NEIGHBOURS, JOINED, CODES, BITS = 12, 8, 3, 14
BLOCK, ROUNDS, SETTLED = 256, 4, 0.01
#: How often saturated lists double.
GROWTHS = 2
AUDIT, RECALL, ATTEMPTS = 512, 0.98, 3
#: Most that a cosine of half-precision vectors is off.
ROUNDING = 0.002
BATCH_ROWS = 2000


def _vectors(column: pa.Array) -> tuple[list[bytes | None], np.ndarray]:
    """Vectors as bytes of doubles (None unless valid), and a hash of each."""
    out: list[bytes | None] = []
    keys = np.zeros(len(column), np.uint64)
    offsets = column.offsets.to_numpy()
    flat = column.values
    gaps = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    bad = gaps | ~np.isfinite(values)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        v = values[a:b] + 0.0  # no negative zeros
        if not valid[i] or a == b or bad[a:b].any() or not v.any():
            out.append(None)
            continue
        out.append(v.tobytes())
        place = np.arange(1, b - a + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keys[i] = mix64(mix64(v.view(np.uint64) + place).sum(dtype=np.uint64, keepdims=True))[0]
    return out, keys


def _unit(blobs: list[bytes], dim: int | None = None) -> np.ndarray:
    """Unit rows of like dimension; a vector is scaled first, so none overflows."""
    dim = dim or max(len(b) // 8 for b in blobs)
    x = np.zeros((len(blobs), dim))
    for i, b in enumerate(blobs):
        v = np.frombuffer(b, np.float64)
        x[i, : min(dim, len(v))] = v[:dim]
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine_links(threshold: float):
    def links(left: list[bytes], right: list[bytes]) -> np.ndarray:
        sizes = np.array([len(b) for b in (*left, *right)])
        if (sizes == sizes[0]).all():
            x = _unit([*left, *right])
            return x[: len(left)] @ x[len(left) :].T >= threshold
        out = np.zeros((len(left), len(right)), bool)  # unlike dimensions link with nothing
        for size in np.unique(sizes):
            a, b = np.flatnonzero(sizes[: len(left)] == size), np.flatnonzero(sizes[len(left) :] == size)
            if len(a) and len(b):
                out[np.ix_(a, b)] = _unit([left[i] for i in a]) @ _unit([right[i] for i in b]).T >= threshold
        return out

    return links


_LISTS = "node long, ids array<long>, sims array<float>"


def _lists(nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.record_batch(
        [pa.array(nodes), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(sims.astype(np.float32)))],
        names=["node", "ids", "sims"],
    )


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest entries of each row (or block of rows)."""
    k = min(k, sims.shape[-1])
    return np.argpartition(-sims, k - 1, axis=-1)[..., :k]


def _start(vectors: DataFrame, codes: int, k: int, seed: int, dim: int) -> DataFrame:
    """Best neighbours inside blocks of rows that a code sorts near each other."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        planes = rng.normal(size=(codes, dim, BITS + 1)).astype(np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(2).to_pylist(), dim).astype(np.float32)
            for table in range(codes):
                y = x @ planes[table]
                number = ((y[:, :BITS] > 0) * (1 << np.arange(BITS)[::-1])).sum(1)
                columns = [batch.column(0), batch.column(1), pa.array(np.full(len(x), table, np.int32)), pa.array(number + 0.49 * np.tanh(y[:, BITS]))]
                yield pa.record_batch([*columns, pa.array([v.tobytes() for v in x.astype(np.float16)])], names=["node", "label", "table", "code", "v"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["label", "table"], 4 << 20):
            starts = np.append(group_starts(table, ["label", "table"]), table.num_rows)
            nodes = table.column("node").to_numpy()
            x = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float16).reshape(-1, dim).astype(np.float32)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                for low in range(a, b, BLOCK // 2):  # blocks overlap by half
                    part = slice(low, min(b, low + BLOCK))
                    n = part.stop - part.start
                    if n < 2 or (low > a and n <= BLOCK // 2):
                        break
                    s = x[part] @ x[part].T
                    np.fill_diagonal(s, -2)
                    best = _best(s, min(k, n - 1))
                    width = best.shape[1]
                    yield _lists(nodes[part], nodes[part][best].ravel(), np.take_along_axis(s, best, 1).ravel(), np.arange(width, n * width + 1, width))

    coded = vectors.select("node", "label", "vector").mapInArrow(code, "node long, label long, table int, code double, v binary")
    dealt = coded.repartitionByRange("label", "table", "code").sortWithinPartitions("label", "table", "code")
    return dealt.mapInArrow(block, _LISTS)


def _merge(lists: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of all lists of a node; ``fresh`` counts entries no list with old=true had."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["node"]):
            sizes = table.column("ids").combine_chunks()
            lengths = np.diff(sizes.offsets.to_numpy()) if sizes.offset == 0 else np.array([len(x) for x in sizes])
            node = np.repeat(table.column("node").to_numpy(), lengths)
            old = np.repeat(table.column("old").to_numpy(zero_copy_only=False), lengths)
            ids = sizes.flatten().to_numpy()
            sims = table.column("sims").combine_chunks().flatten().to_numpy()
            order = np.lexsort((~old, ids, node))
            node, ids, sims, old = node[order], ids[order], sims[order], old[order]
            first = np.ones(len(node), bool)
            first[1:] = (node[1:] != node[:-1]) | (ids[1:] != ids[:-1])
            node, ids, sims, old = node[first], ids[first], sims[first], old[first]
            order = np.lexsort((ids, -sims, node))
            node, ids, sims, old = node[order], ids[order], sims[order], old[order]
            start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, int)
            rank = np.arange(len(node)) - np.repeat(start, np.diff(np.append(start, len(node))))
            keep = rank < k
            node, ids, sims, old = node[keep], ids[keep], sims[keep], old[keep]
            start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, int)
            batch = _lists(node[start], ids, sims, np.append(start[1:], len(node)) if len(node) else np.zeros(0, int))
            fresh = np.add.reduceat((~old).astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
            yield batch.append_column("fresh", pa.array(fresh))

    dealt = lists.repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(scan, _LISTS + ", fresh long")


def _descend(lists: DataFrame, vectors: DataFrame, dim: int, seed: int, joined: int = JOINED) -> DataFrame:
    """One round: neighbours of a vector, in both directions, meet each other."""
    ahead = lists.select("node", F.posexplode(F.slice("ids", 1, joined)).alias("place", "v"))
    back = ahead.select(F.col("v").alias("m"), F.col("node").alias("v"))
    # A vector that many have as a neighbour meets about ``joined`` of them a round.
    many = back.groupBy("m").agg(F.count("*").alias("n")).filter(F.col("n") > joined).withColumnRenamed("m", "_m")
    back = back.join(many, F.col("m") == F.col("_m"), "left").filter(
        F.col("n").isNull() | (F.pmod(F.xxhash64("m", "v", F.lit(seed)), F.col("n")) < joined)
    )
    met = ahead.select(F.col("node").alias("m"), "v").union(back.select("m", "v"))
    pairs = met.union(met.select("m", F.col("m").alias("v"))).distinct()

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch.column(1).to_pylist(), dim).astype(np.float16)
                yield pa.record_batch([batch.column(0), pa.array([v.tobytes() for v in x])], names=["_v", "x"])

    halves = vectors.select("node", "vector").mapInArrow(small, "_v long, x binary")
    whole = pairs.join(halves, F.col("v") == F.col("_v")).select("m", "v", "x")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["m"], 4 << 20):
            starts = group_starts(table, ["m"])
            sizes = np.diff(np.append(starts, table.num_rows))
            nodes = table.column("v").to_numpy()
            x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float16).reshape(-1, dim).astype(np.float32)
            for size in np.unique(sizes):
                if size < 2:
                    continue
                mine = starts[sizes == size]
                for low in range(0, len(mine), 512):
                    at = mine[low : low + 512, None] + np.arange(size)
                    y = x[at]
                    s = np.matmul(y, y.transpose(0, 2, 1))
                    s[:, np.arange(size), np.arange(size)] = -2
                    best = _best(s, min(joined, size - 1))
                    width = best.shape[2]
                    n = at.size
                    ids = np.take_along_axis(np.broadcast_to(nodes[at][:, None, :], s.shape), best, 2)
                    yield _lists(nodes[at].ravel(), ids.ravel(), np.take_along_axis(s, best, 2).ravel(), np.arange(width, n * width + 1, width))

    return whole.repartition("m").sortWithinPartitions("m").mapInArrow(meet, _LISTS)


def _graph(vectors: DataFrame, total: int, k: int, codes: int, seed: int, dim: int) -> DataFrame:
    never = F.lit(False).alias("old")
    lists = cut(_merge(_start(vectors, codes, k, seed, dim).select("*", never), k), "neighbours")
    for number in range(ROUNDS):
        found = _descend(lists, vectors, dim, seed + number)
        both = lists.select("node", "ids", "sims", F.lit(True).alias("old")).union(found.select("*", never))
        lists = cut(_merge(both, k), "neighbours")
        fresh = lists.agg(F.sum("fresh")).first()[0] or 0
        if fresh <= SETTLED * total * k:
            break
    return lists


def _enlarged(lists: DataFrame, vectors: DataFrame, k: int, threshold: float, seed: int, dim: int) -> DataFrame:
    """``lists`` with the saturated ones grown to two and four times ``k`` where more neighbours reach the threshold.

    Only neighbourhoods of saturated lists meet again, with all of their entries.
    """
    for number in range(GROWTHS):
        full = cut(lists.filter((F.size("ids") >= k) & (F.array_min("sims") >= threshold - MARGIN)), "saturated")
        if full.isEmpty():
            break
        k *= 2
        found = _descend(full, vectors, dim, seed + number, k)
        both = lists.select("node", "ids", "sims", F.lit(True).alias("old")).union(found.select("*", F.lit(False).alias("old")))
        lists = cut(_merge(both, k), "enlarged")
    return lists


def _bridges(lists: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(id, component) that join cells of saturated vectors which may hold links across.

    A saturated vector belongs to one pivot, the entry of its list (or itself)
    that a hash puts first.  Two cells have a link only if the angle between
    their pivots is at most that of the threshold and both radii together, so no
    link of two saturated vectors is outside the components returned.
    """
    full = lists.filter(F.array_min("sims") >= threshold - MARGIN)
    entry = F.explode(F.concat(F.array(F.struct(F.col("node").alias("ids"), F.lit(1.0).cast("float").alias("sims"))), F.arrays_zip("ids", "sims")))
    entries = full.select("node", entry.alias("e")).select("node", "e.ids", "e.sims")
    cells = entries.groupBy("node").agg(F.min_by(F.struct("ids", "sims"), F.struct(F.xxhash64("ids", F.lit(5)), "ids")).alias("e"))
    pivots = cells.groupBy(F.col("e.ids").alias("pivot")).agg(F.min("e.sims").alias("least"))
    placed = pivots.join(vectors, F.col("pivot") == F.col("node")).select("label", "node", "vector", F.col("least").cast("double").alias("least"))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = batch.column(3).to_numpy()
            radius = np.arccos(np.clip(least - ROUNDING, -1, 1))
            payload = [v + r.tobytes() for v, r in zip(batch.column(2).to_pylist(), radius, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.ones(len(payload), np.int64)), pa.array(payload, pa.binary())], names=["component", "node", "weight", "payload"])

    members = placed.mapInArrow(reach, "component long, node long, weight long, payload binary")
    joined = linked(members, _reach_links(threshold), 4 * BLOCK)[1]
    own = cells.select(F.col("node").alias("id"), F.col("e.ids").alias("component"))
    return own.union(joined.select("id", "component"))


def _reach_links(threshold: float):
    """Pivots (a vector, then its cell's radius) whose cells may hold a link."""
    angle = np.arccos(threshold)

    def links(left: list[bytes], right: list[bytes]) -> np.ndarray:
        out = np.zeros((len(left), len(right)), bool)
        sizes = [np.array([len(b) for b in side]) for side in (left, right)]
        for size in np.intersect1d(*sizes):
            a, b = (np.flatnonzero(s == size) for s in sizes)
            x, y = _unit([left[i][:-8] for i in a]), _unit([right[i][:-8] for i in b])
            r, t = (np.array([np.frombuffer(side[i][-8:], np.float64)[0] for i in at]) for side, at in ((left, a), (right, b)))
            out[np.ix_(a, b)] = x @ y.T >= np.cos(np.minimum(np.pi, angle + r[:, None] + t[None, :])) - 1e-9
        return out

    return links


def _audit(vectors: DataFrame, named: DataFrame, threshold: float, size: int, small: int) -> float:
    """The lower of two mean recalls a query, against all rows in blocks.

    ``size`` queries at most, half from components of up to ``small`` nodes and
    half from larger ones.  Only links to other nodes count (equal vectors need
    no search), and only queries that have any.
    """
    sizes = named.groupBy("component").agg(F.count("*").alias("members")).withColumnRenamed("component", "_c")
    strata = named.join(sizes, F.col("component") == F.col("_c")).select(F.col("node").alias("_n"), "n_links", (F.col("members") > small).alias("large"))
    counts = {r["large"]: r["n"] for r in strata.groupBy("large").agg(F.count("*").alias("n")).collect()}
    queries = []
    for large, n in counts.items():
        share = int(min(1.0, size / 2 / n) * 1_000_000) + 1
        picked = strata.filter((F.col("large") == large) & (F.pmod(F.xxhash64("_n", F.lit(9)), F.lit(1_000_000)) < share))
        queries += picked.join(vectors, F.col("_n") == F.col("node")).select("label", "vector", "size", "n_links", "large").limit(2 * size).collect()
    if not queries:
        return 1.0
    labels = np.array([q["label"] for q in queries])
    blobs = [q["vector"] for q in queries]
    shared = vectors.sparkSession.sparkContext.broadcast((labels, blobs))
    links = cosine_links(threshold)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, blobs = shared.value
        total = np.zeros(len(blobs), np.int64)
        for batch in batches:
            if batch.num_rows:
                own, others = batch.column(0).to_numpy(), batch.column(1).to_pylist()
                hit = links(blobs, others) & (labels[:, None] == own[None, :])
                at = {key: i for i, key in enumerate(zip(own.tolist(), others, strict=True))}
                for i, key in enumerate(zip(labels.tolist(), blobs, strict=True)):  # not itself; a vector is one node of a label
                    if (j := at.get(key)) is not None:
                        hit[i, j] = False
                total += hit @ batch.column(2).to_numpy()
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], names=["q", "n"])

    true = vectors.select("label", "vector", "size").mapInArrow(scan, "q long, n long").groupBy("q").agg(F.sum("n").alias("n")).collect()
    recalls: dict[bool, list[float]] = {}
    for r in true:
        if r["n"]:
            query = queries[r["q"]]
            recalls.setdefault(query["large"], []).append(min(1.0, (query["n_links"] - query["size"] + 1) / r["n"]))
    return min((float(np.mean(of)) for of in recalls.values()), default=1.0)


def embedding_links(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    neighbours: int = NEIGHBOURS,
    codes: int = CODES,
    seed: int = 9,
) -> DataFrame:
    """One row per row: key, n_links, component_id and kept.

    Rows are linked if their labels are equal and not null and their cosine in
    double precision is ``threshold`` or more.  ``component_id`` is the smallest
    key reachable by links, its own included; ``kept`` says that it is the own
    key.  Vectors that are null, empty, zero, or hold a null or non-finite
    component link with nothing, and neither do vectors of unlike dimensions.
    Equal vectors of a label are one node that counts as often as it occurs.
    Null keys come after all others: they are linked and counted, and a
    component of null keys alone has component_id null and is kept.  Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            column = pa.ListArray.from_arrays(column.offsets, column.values, mask=column.is_null()) if column.offset == 0 else pa.array(column.to_pylist(), column.type)
            blobs, hashes = _vectors(column)
            labels = batch.column(1)
            ok = np.array([b is not None for b in blobs], bool) & labels.is_valid().to_numpy(zero_copy_only=False)
            number = labels.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            nodes = mix64(hashes ^ mix64(number + np.uint64(7))).view(np.int64)
            yield pa.record_batch(
                [batch.column(0), pa.array(nodes, mask=~ok), labels, pa.array([b if k else None for b, k in zip(blobs, ok, strict=True)], pa.binary())],
                names=["id", "node", "label", "vector"],
            )

    picked = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = cut(picked.mapInArrow(prepare, "id long, node long, label long, vector binary"), "vectors")
    classes = rows.filter("node is not null").groupBy("node").agg(
        F.min("id").alias("low"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("vector").alias("vector")
    )
    classes = cut(classes, "nodes")
    total, longest = classes.agg(F.count("*"), F.max(F.length("vector"))).first()
    dim = (longest or 8) // 8

    def compared(candidates: DataFrame) -> DataFrame:
        members = candidates.join(classes, F.col("id") == F.col("node")).select("component", "node", F.col("size").alias("weight"), F.col("vector").alias("payload"))
        totals, components = linked(members, cosine_links(threshold), 2 * BLOCK)
        named = (
            classes.select("node", "low", "size")
            .join(totals.withColumnRenamed("node", "_t"), F.col("node") == F.col("_t"), "left")
            .join(components, F.col("node") == F.col("id"), "left")
            .select("node", "low", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
        )
        return cut(named, "named")

    for attempt in range(ATTEMPTS):
        k, tables = neighbours << attempt, codes << attempt
        lists = _graph(classes, total, k, tables, seed + 100 * attempt, dim)
        lists = _enlarged(lists, classes, k, threshold, seed + 100 * attempt + 50, dim)
        near = lists.select("node", F.explode(F.arrays_zip("ids", "sims")).alias("e"))
        near = near.select("node", F.col("e.ids").alias("other"), F.col("e.sims").alias("sim")).filter(F.col("sim") >= threshold - MARGIN)
        bridges = _bridges(lists, classes, threshold).toDF("node", "other")
        named = compared(connected_components(near.select("node", "other").union(bridges), "node", "other"))
        if _audit(classes, named, threshold, AUDIT, neighbours) >= RECALL:
            break
    else:  # no graph was good enough: every pair of a label in blocks
        named = compared(classes.select(F.col("node").alias("id"), F.col("label").alias("component")))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id")).withColumnRenamed("component", "_c")
    named = named.join(lowest, F.col("component") == F.col("_c")).select(F.col("node").alias("_n"), "n_links", "component_id")
    whole = rows.select("id", "node").join(named, F.col("node") == F.col("_n"), "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return whole.select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
