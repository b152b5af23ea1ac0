"""Exact links inside candidate components, in blocks.

A cheap search proposes which rows may be linked; its stars make candidate
components.  Every link lies within one.  Here the members of a component are
dealt to blocks of bounded size, and each pair of blocks is compared as a matrix
in one task, so no pair of rows is ever a row of a table: what leaves a task is
one row per member, with its number of links and its root within the pair of
blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerline.llm.texts import group_starts, whole_groups
from ledgerline.operators.graph import connected_components
from ledgerline.session import cut

#: A list of up to so many large components (16 bytes each) is sent to every executor.
BROADCAST_COMPONENTS = 500_000

#: links(left, right) of two lists of payloads: a boolean matrix.
Links = Callable[[list[bytes], list[bytes]], np.ndarray]


def _roots(matrix: np.ndarray) -> np.ndarray:
    """The smallest number each row of a symmetric boolean matrix reaches."""
    root = np.arange(len(matrix))
    wide = matrix | np.eye(len(matrix), dtype=bool)
    while True:
        new = np.where(wide, root[None, :], len(root)).min(1)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(group: pa.Table, links: Links) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, root) of one pair of blocks (or a block with itself)."""
    nodes, first = np.unique(group.column("node").to_numpy(), return_index=True)
    rows = group.take(pa.array(first))
    own = rows.column("own").to_numpy()
    weight = rows.column("weight").to_numpy()
    payload = [p.as_py() for p in rows.column("payload")]
    p, q = int(group.column("p")[0].as_py()), int(group.column("q")[0].as_py())
    matrix = np.zeros((len(nodes), len(nodes)), bool)
    left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
    if len(left) and len(right):
        part = links([payload[i] for i in left], [payload[i] for i in right])
        matrix[np.ix_(left, right)] = part
        matrix[np.ix_(right, left)] = part.T
    np.fill_diagonal(matrix, False)
    return nodes, matrix @ weight, nodes[_roots(matrix)]


def linked(members: DataFrame, links: Links, block: int) -> tuple[DataFrame, DataFrame]:
    """Links and true components of ``(component, node, weight, payload)`` rows.

    Returns ``(node, n)``, the summed weights of the nodes that each is linked
    with, and ``(id, component)`` of those linked with any, by smallest node.  A
    node may come twice with equal payloads.  Rows never leave as pairs.

    A component of n nodes has n / block blocks, and its members are sent to as
    many pairs of blocks: that is the blocked product that counting all links of
    n different members takes.  Only components of several blocks are named to
    all tasks, by a list of at most nodes / block rows, so no join is dealt by
    component.
    """
    sizes = members.groupBy(F.col("component").alias("_c")).agg(F.ceil(F.approx_count_distinct("node") / block).cast("int").alias("blocks"))
    sizes = cut(sizes.filter("blocks > 1"), "large")
    if sizes.count() <= BROADCAST_COMPONENTS:
        sizes = F.broadcast(sizes)
    dealt = members.join(sizes, F.col("component") == F.col("_c"), "left").drop("_c").fillna(1, ["blocks"])
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "component", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "weight", "payload"
    )
    key = ["component", "p", "q"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, key):
            starts = np.append(group_starts(table, key), table.num_rows)
            out = [_compare(table.slice(a, b - a), links) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["node", "n", "root"])

    compared = dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(scan, "node long, n long, root long")
    compared = cut(compared, "compared")
    totals = compared.groupBy("node").agg(F.sum("n").alias("n"))
    return totals, connected_components(compared.filter("node <> root"), "node", "root")
