"""Mixing sources to target weights, in DataFrame operations only.

Targets come from capped water-filling: source ``s`` asks for a share of
``budget`` times all words in proportion to its weight, is clamped at
``max_epochs`` times its own words, and what is clamped away is shared anew by
weight among the others until nobody is above.  That fixed point has a closed
form: clamped are exactly the sources with the smallest capacity-to-weight
ratios, so one running sum over the sources in that order finds it.

Each document is then taken whole ``floor(target / words)`` times, and the
fractional repetition goes to the documents that come first in a seeded order,
until the words of the source's target are reached.  No source is ordered as a
whole: words are summed per (source, bucket of the seeded order) first, and only
the one bucket in which a target ends is ordered document by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.llm.texts import WORD
from ledgerline.session import cut

#: Rows follow each other by an MD5 digest of seed and key.  Its first hex digits
#: are the bucket; the bucket in which a target ends is refined row by row.
BUCKET_DIGITS = 4


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _rank_weight(weights: tuple[int, ...]) -> Column:
    return F.element_at(
        F.array(*(F.lit(w) for w in weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")
    ).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: tuple[int, int] = (3, 2), max_epochs: int = 2
) -> DataFrame:
    """Capped water-filling over ``(source, words)`` rows, one per source.

    Sources rank by code point, null last, and weigh ``weights`` in turn.  They
    share ``budget[0] / budget[1]`` of all words.  Returns source, words, weight
    and target; a source without words has target 0.  All sums are exact
    integers (decimals), so the target is one correctly rounded division.  The
    windows run over one row per source.
    """
    up, down = budget
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", _rank_weight(weights)).drop("_rank")
    order = Window.orderBy((F.col("words") / F.col("weight")), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    d = "decimal(38,0)"
    ranked = (
        ranked.withColumn("_all", F.sum(F.col("words").cast(d)).over(every))
        .withColumn("_w", F.sum(F.col("weight").cast(d)).over(every))
        .withColumn("_before", F.sum(F.col("words").cast(d)).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_wbefore", F.sum(F.col("weight").cast(d)).over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .fillna({"_before": 0, "_wbefore": 0})
        # What is left for this source and the later ones, times ``down``.
        .withColumn("_left", (F.col("_all") * up - F.col("_before") * (max_epochs * down)).cast(d))
        .withColumn("_wleft", (F.col("_w") - F.col("_wbefore")).cast(d))
        .withColumn(
            "_free",
            F.col("weight") * F.col("_left") <= F.col("words") * F.col("_wleft") * (max_epochs * down),
        )
    )
    # From the first source on that is not clamped, all get the same per weight.
    first = F.min(F.when(F.col("_free"), F.struct("_before", "_left", "_wleft"))).over(every)
    ranked = ranked.withColumn("_at", first)
    share = (F.col("weight") * F.col("_at._left")).cast("double") / (F.col("_at._wleft") * down).cast("double")
    target = F.when(F.col("_at").isNull() | (F.col("_before") < F.col("_at._before")), F.col("words") * max_epochs)
    return ranked.select(
        "source", "words", "weight", F.when(F.col("words") == 0, 0.0).otherwise(target.otherwise(share)).cast("double").alias("target")
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    budget: tuple[int, int] = (3, 2),
    max_epochs: int = 2,
    seed: int = 20,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How often the mix takes each row of ``docs``, with the columns to ``carry``.

    Returns key, source, size (words of the text), source_size, target (of the
    row's source), repeats and taken (``size * repeats``), one row per row of
    ``docs``.  The words taken of a source differ from its target by less than
    its longest document; no row is taken more than ``max_epochs`` times.  Null
    texts have size 0; a null source is a source of its own, the last; rows with
    equal keys are told apart by their size only, and rows equal in all of that
    (null keys too) follow in any order, which no total depends on.  Rows without
    words are taken ``floor(target / words)`` times as well.  Rows with a null key
    are ordered by their text, so that they fall in all buckets.  An empty table
    gives an empty result; other columns are ignored.
    """
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text "), F.coalesce(F.col(text), F.lit(""))))
    order = F.md5(F.concat_ws("-", F.lit(str(seed)), name))
    base = docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), order.alias("_order"), *carry)
    base = cut(
        base.withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS)),
        "mix-sizes",
    )
    buckets = cut(base.groupBy("source", "_bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    plan = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("words")), weights, budget, max_epochs)
    plan = plan.select(
        F.col("source").alias("_s"),
        F.col("words").alias("source_size"),
        "target",
        F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("int").alias("_whole"),
    ).withColumn("_part", F.col("target") - F.col("_whole") * F.col("source_size"))
    plan = cut(plan, "mix-plan")
    # The bucket in which the fractional repetition of a source ends.
    running = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        buckets.join(plan, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("_done", F.coalesce(F.sum("words").over(running), F.lit(0)))
        .filter((F.col("_done") <= F.col("_part")) & (F.col("_done") + F.col("words") > F.col("_part")))
        .select(F.col("_s").alias("_e"), F.col("_bucket").alias("_end"), "_done")
    )
    plan = cut(
        plan.join(ends, F.col("_s").eqNullSafe(F.col("_e")), "left").drop("_e").fillna({"_end": "", "_done": 0}),
        "mix-ends",
    )
    rows = base.join(plan, base["source"].eqNullSafe(F.col("_s"))).drop("_s")
    inside = Window.partitionBy("source").orderBy("_order", "_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.filter(F.col("_bucket") == F.col("_end"))
    last = last.withColumn("_before", F.col("_done") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # The document that straddles the target is taken if that comes closer.
    last = last.withColumn("_more", (F.col("_before") + F.col("size") / 2 <= F.col("_part")) & (F.col("_part") > 0))
    rest = rows.filter(F.col("_bucket") != F.col("_end")).withColumn("_before", F.lit(0))
    rest = rest.withColumn("_more", (F.col("_bucket") < F.col("_end")) & (F.col("_part") > 0))
    done = rest.unionByName(last).withColumn(
        "repeats", F.least(F.col("_whole") + F.col("_more").cast("int"), F.lit(max_epochs))
    )
    return done.select(
        F.col("_key").alias(key),
        F.col("source").alias(source),
        "size",
        "source_size",
        "target",
        "repeats",
        (F.col("size") * F.col("repeats")).alias("taken"),
        *carry,
    )


def repeat_rows(docs: DataFrame, mixed: DataFrame, on: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs`` with every row as often as ``mixed`` takes it; ``on`` names a row in both, null equals null.

    Columns stay as they are.
    """
    counts = mixed.filter("repeats > 0").select(*[F.col(c).alias(f"_on_{c}") for c in on], F.col("repeats").alias("_repeats"))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return docs.join(counts, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_repeats")))).select(*docs.columns)
