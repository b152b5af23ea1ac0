"""Trees stored as pre-order rows: building, checking, pruning and grouping."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ledgerline.functions.membership import LORDS_HOUSE

NODES = (
    "member_id long, category_position int, category_id int, category_name string, sort_order int, node_position int, parent_position int, "
    "sibling_position int, source_id long, text string, created_when string, last_amended_when string, deleted_when string, is_correction boolean"
)
_COLUMNS = [c.split()[0] for c in NODES.split(", ")]


def register_rows(document: dict) -> list[dict]:
    """Pre-order rows of one member's register; collections may be null."""
    member = document["member"]
    if not member["nameDisplayAs"].strip():
        raise ValueError("missing display name")
    if member["latestHouseMembership"]["house"] != LORDS_HOUSE:
        raise ValueError("a register of another house")
    rows = []
    for place, category in enumerate(document.get("interestCategories") or []):
        base = {"member_id": member["id"], "category_position": place, "category_id": category["id"], "category_name": category.get("name"), "sort_order": category["sortOrder"]}
        # An explicit stack: trees may be deeper than the interpreter's own.
        stack = [(None, i, node) for i, node in reversed(list(enumerate(category.get("interests") or [])))]
        number = 0
        while stack:
            parent, sibling, node = stack.pop()
            rows.append(base | {
                "node_position": number, "parent_position": parent, "sibling_position": sibling, "source_id": node["id"], "text": node.get("interest"),
                "created_when": node.get("createdWhen"), "last_amended_when": node.get("lastAmendedWhen"), "deleted_when": node.get("deletedWhen"), "is_correction": node["isCorrection"],
            })
            stack += [(number, i, child) for i, child in reversed(list(enumerate(node.get("childInterests") or [])))]
            number += 1
    return rows


def decode_registers(documents: DataFrame) -> DataFrame:
    """Node rows of registers, one JSON text per row."""

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [row for text in part["source_json"] for row in register_rows(json.loads(text))]
            yield pd.DataFrame(rows, columns=_COLUMNS, dtype=object)

    return documents.select("source_json").mapInPandas(batch, NODES)


def broken_trees(nodes: DataFrame, tree: list[str]) -> DataFrame:
    """Trees whose rows are no pre-order numbering: what ``tree`` names, and why.

    Positions must run from 0 without gaps, a parent must come before its child,
    and siblings must be numbered without gaps in order of their rows.
    """
    by_tree = nodes.groupBy(*tree).agg(F.count("*").alias("n"), F.countDistinct("node_position").alias("d"), F.min("node_position").alias("a"), F.max("node_position").alias("b"))
    gaps = by_tree.filter((F.col("d") != F.col("n")) | (F.col("a") != 0) | (F.col("b") != F.col("n") - 1)).select(*tree, F.lit("positions").alias("why"))
    late = nodes.filter(F.col("parent_position") >= F.col("node_position")).select(*tree, F.lit("parent after child").alias("why"))
    among = Window.partitionBy(*tree, "parent_position").orderBy("node_position")
    siblings = nodes.withColumn("_n", F.row_number().over(among) - 1).filter(F.col("_n") != F.col("sibling_position")).select(*tree, F.lit("siblings").alias("why"))
    return gaps.unionByName(late).unionByName(siblings).distinct()


def live_nodes(nodes: DataFrame, tree: list[str], max_rounds: int = 64) -> DataFrame:
    """Nodes that are not deleted, under their nearest ancestor that isn't either.

    Deleted parents are skipped by doubling: each round sends a node past all
    the deleted ancestors that its deleted parent has itself skipped.
    """
    slim = nodes.select(*tree, "node_position", "parent_position", F.col("deleted_when").isNotNull().alias("gone"))
    dead = slim.filter("gone").select(*[F.col(c).alias(f"_{c}") for c in tree], F.col("node_position").alias("_p"), F.col("parent_position").alias("_up"))
    now = nodes.filter("deleted_when is null").withColumn("live_parent", F.col("parent_position"))
    for _ in range(max_rounds):
        on = F.col("live_parent") == F.col("_p")
        again = F.col("_next") == F.col("_p")
        for c in tree:
            on = on & (F.col(c) == F.col(f"_{c}"))
            again = again & (F.col(f"t_{c}") == F.col(f"_{c}"))
        now = now.join(dead, on, "left").withColumn("live_parent", F.when(F.col("_p").isNotNull(), F.col("_up")).otherwise(F.col("live_parent"))).drop("_p", "_up", *[f"_{c}" for c in tree])
        ahead = dead.select(*[F.col(f"_{c}").alias(f"t_{c}") for c in tree], F.col("_p").alias("t_p"), F.col("_up").alias("_next"))
        linked = ahead.join(dead, again, "left")
        if linked.filter(F.col("_p").isNotNull()).isEmpty():
            break
        dead = linked.select(*[F.col(f"t_{c}").alias(f"_{c}") for c in tree], F.col("t_p").alias("_p"), F.when(F.col("_p").isNotNull(), F.col("_up")).otherwise(F.col("_next")).alias("_up"))
    return now


def merged_categories(nodes: DataFrame) -> DataFrame:
    """Categories of one source id and name as one: smallest order, all nodes."""
    return nodes.groupBy("member_id", "category_id", "category_name").agg(
        F.min("sort_order").alias("sort_order"), F.min("category_position").alias("category_position"), F.count("*").alias("nodes")
    )


def merged_category_nodes(nodes: DataFrame) -> DataFrame:
    """All nodes, each in the merged category of its source id and name.

    ``category_position`` and ``sort_order`` become the smallest of the merged
    ones; ``place`` numbers a merged category's nodes in source order.
    """
    key = ["member_id", "category_id", "category_name"]
    same = Window.partitionBy(*key)
    order = same.orderBy("category_position", "node_position")
    out = nodes.withColumn("place", F.row_number().over(order).cast("long") - 1)
    return out.withColumn("sort_order", F.min("sort_order").over(same)).withColumn("category_position", F.min("category_position").over(same))


def nested(rows: DataFrame, parent: str, order: str, columns: list[str]) -> DataFrame:
    """One row per parent with its ordered children as a list of structs."""
    children = F.array_sort(F.collect_list(F.struct(order, *columns)))
    return rows.groupBy(parent).agg(children.alias("children"), F.count("*").alias("n"))
