"""Boards, updates, details and timelines over a register of interests.

Rows come from ``joined``: one per entry of a declaration, and one with null
entry columns for a declaration without entries.  Dimension tables (members,
funders, groups, names) are left to the planner, which broadcasts them when
their measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline.functions.money import breakdown_by, totals_by
from ledgerline.functions.periods import RegistrationWindow
from ledgerline.operators.graph import connected_components
from ledgerline.session import cut


def canonical_funders(funders: DataFrame, groups: DataFrame, names: DataFrame) -> DataFrame:
    """funder_id, canonical_id, canonical_name and the canonical funder's kind.

    The canonical id is the group's (itself a funder) or the funder's own; the
    name is the group's preferred one or the canonical funder's.
    """
    own = funders.select("funder_id").join(groups.select("funder_id", "group_id"), "funder_id", "left")
    own = own.withColumn("canonical_id", F.coalesce("group_id", "funder_id"))
    labels = funders.select(F.col("funder_id").alias("canonical_id"), "funder_name", "funder_kind")
    preferred = names.select(F.col("group_id").alias("canonical_id"), "preferred_name")
    out = own.join(labels, "canonical_id", "left").join(preferred, "canonical_id", "left")
    return out.select(
        "funder_id", "canonical_id", F.coalesce("preferred_name", "funder_name").alias("canonical_name"), F.coalesce("funder_kind", F.lit("Not Specified")).alias("canonical_kind")
    )


def alias_groups(aliases: DataFrame) -> DataFrame:
    """(funder_id, group_id) of funders that share a normalised name.

    Each name links its funders as a star to its smallest funder, so a name with
    many funders makes as many links, not their square.
    """
    named = aliases.filter(F.col("alias").isNotNull() & F.col("funder_id").isNotNull())
    named = named.select("funder_id", normal_name(F.col("alias")).alias("name")).filter(F.col("name") != "").distinct()
    low = named.groupBy("name").agg(F.min("funder_id").alias("low"))
    edges = named.join(low, "name").filter(F.col("funder_id") != F.col("low")).select("funder_id", "low").distinct()
    return connected_components(edges, "funder_id", "low").select(F.col("id").alias("funder_id"), F.col("component").alias("group_id"))


def normal_name(name: Column) -> Column:
    """White space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def joined(declarations: DataFrame, members: DataFrame, entries: DataFrame, canonical: DataFrame, window: RegistrationWindow) -> DataFrame:
    """Declarations in the window, with member, entries and canonical funder."""
    base = declarations.filter(window.holds(F.col("registered"))).join(members, "member_id")
    return base.join(entries, "declaration_id", "left").join(canonical, "funder_id", "left")


def positions(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with their position in a total order, from 1, without one task that has them all.

    Rows are written, so that what bounds the ranges is not computed twice, dealt
    to ranges of the order and written again; a window numbers each range, and the
    sizes of the ranges before it (a row a range) are added.
    """
    dealt = cut(cut(rows, "unplaced").repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(sizes.select(F.col("_range").alias("_r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    out = dealt.withColumn("position", inside).join(starts, F.col("_range") == F.col("_r"))
    return out.withColumn("position", (F.col("position") + F.col("_start")).cast("long")).drop("_range", "_r", "_start")


def board(totals: DataFrame, key: str) -> DataFrame:
    """Ranks by total, largest first and unknown last, then by key, null first."""
    return positions(totals, [F.col("total").desc_nulls_last(), F.col(key).asc_nulls_first()])


def member_board(rows: DataFrame) -> DataFrame:
    return board(totals_by(rows, ["member_id"], ["member_name"]), "member_id")


def party_board(rows: DataFrame) -> DataFrame:
    """Parties by id, labelled with the smallest of their names."""
    return board(totals_by(rows, ["party_id"], ["party_name"]), "party_id")


def funder_board(rows: DataFrame, individuals: bool) -> DataFrame:
    """Canonical funders that are individuals, or all others."""
    known = rows.filter(F.col("canonical_id").isNotNull())
    person = F.col("canonical_kind") == "Individual"
    known = known.filter(person if individuals else ~person)
    totals = totals_by(known, ["canonical_id", "canonical_name"])
    return board(totals, "canonical_id")


def month_updates(rows: DataFrame) -> DataFrame:
    """Per funder other than individuals: declarations and latest registration.

    ``rows`` are those of one month; order is latest first, then name and id.
    """
    known = rows.filter(F.col("canonical_id").isNotNull() & (F.col("canonical_kind") != "Individual"))
    one = known.groupBy("canonical_id", "canonical_name", "declaration_id").agg(F.max("registered").alias("registered"))
    out = one.groupBy("canonical_id", "canonical_name").agg(F.count("*").alias("declarations"), F.max("registered").alias("latest"))
    return positions(out, [F.col("latest").desc_nulls_last(), F.col("canonical_name").asc(), F.col("canonical_id").asc()])


def headlines(rows: DataFrame, windows: dict[str, RegistrationWindow]) -> DataFrame:
    """Per member, one pass: total, declarations and completeness per window."""
    has, gbp = F.col("entry_id").isNotNull(), F.coalesce(F.col("currency") == "GBP", F.lit(False))
    unknown = has & (F.col("currency").isNull() | (gbp & F.col("amount").isNull()))
    one = rows.groupBy("member_id", "declaration_id").agg(
        F.max("registered").alias("registered"),
        F.sum(F.when(has & gbp, F.col("amount"))).alias("total"),
        F.max(unknown).alias("unknown"),
    )
    columns = []
    for name, window in windows.items():
        inside = window.holds(F.col("registered"))
        columns += [
            F.sum(F.when(inside, F.col("total"))).alias(f"{name}_total"),
            F.sum(inside.cast("long")).alias(f"{name}_declarations"),
            F.coalesce(F.max(F.when(inside, F.col("unknown"))), F.lit(False)).alias(f"{name}_incomplete"),
        ]
    return one.groupBy("member_id").agg(
        *columns, F.min("registered").alias("first"), F.max("registered").alias("last"), F.sum(F.col("registered").isNull().cast("long")).alias("undated")
    )


def recipients(rows: DataFrame, limit: int = 10) -> DataFrame:
    """Per canonical funder and currency, the members that got most."""
    known = rows.filter(F.col("canonical_id").isNotNull())
    out = breakdown_by(known, ["canonical_id", "member_id", "member_name"])
    order = Window.partitionBy("canonical_id", "currency").orderBy(F.col("amount").desc_nulls_last(), "member_id", "member_name")
    return out.withColumn("position", F.row_number().over(order).cast("long")).filter(F.col("position") <= limit)


def party_shares(rows: DataFrame) -> DataFrame:
    """Per canonical funder and currency: the parties, from members' allocations."""
    known = rows.filter(F.col("canonical_id").isNotNull())
    allocations = breakdown_by(known, ["canonical_id", "party_id", "party_name", "member_id"])
    out = allocations.groupBy("canonical_id", "currency", "party_id", "party_name").agg(
        F.sum("amount").alias("amount"), F.sum("entries").cast("long").alias("entries"), F.sum("unknown_amounts").cast("long").alias("unknown_amounts")
    )
    order = Window.partitionBy("canonical_id", "currency").orderBy(F.col("amount").desc_nulls_last(), "party_name", "party_id")
    return out.withColumn("position", F.row_number().over(order).cast("long"))


def history(rows: DataFrame, page: int, size: int = 10) -> DataFrame:
    """One page of a member's entries: newest first, undated last."""
    order = [F.col("registered").desc_nulls_last(), F.col("declaration_id").desc(), F.col("entry_id").asc_nulls_first()]
    return rows.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def sources_of(rows: DataFrame, member: int) -> DataFrame:
    """A member's money by funder (unknown funders are one), with what is missing."""
    mine = rows.filter((F.col("member_id") == member) & F.col("entry_id").isNotNull())
    gbp = F.coalesce(F.col("currency") == "GBP", F.lit(False))
    return mine.groupBy("funder_id").agg(
        F.sum(F.when(gbp, F.col("amount"))).alias("amount"),
        F.count("*").alias("entries"),
        F.sum((gbp & F.col("amount").isNull()).cast("long")).alias("missing"),
        F.sum(F.col("currency").isNull().cast("long")).alias("unknown_currency"),
        F.sum((F.col("currency").isNotNull() & ~gbp).cast("long")).alias("foreign_currency"),
    )


def timeline(rows: DataFrame) -> DataFrame:
    """GBP by month, months between without any filled in with 0.

    Undated entries are one row with a null month.  Entries in other known
    currencies do not take part; an unknown amount or currency makes a month
    incomplete.
    """
    gbp = F.coalesce(F.col("currency") == "GBP", F.lit(False))
    part = rows.filter(F.col("entry_id").isNotNull() & (gbp | F.col("currency").isNull()))
    month = F.date_trunc("month", F.col("registered")).cast("timestamp_ntz")
    by_month = part.groupBy(month.alias("month")).agg(
        F.sum(F.when(gbp, F.col("amount"))).alias("amount"), F.max(F.col("currency").isNull() | F.col("amount").isNull()).alias("incomplete")
    )
    span = by_month.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    months = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    filled = months.join(by_month, F.col("m") == F.col("month"), "left").select(F.col("m").alias("month"), "amount", "incomplete")
    whole = filled.unionByName(by_month.filter("month is null"))
    return whole.select("month", F.coalesce("amount", F.lit(0)).alias("amount"), F.coalesce("incomplete", F.lit(False)).alias("incomplete"))


def share_bars(totals: DataFrame, merged: dict[str, str]) -> DataFrame:
    """Party totals as shares: labels merged, negatives as 0, cut to a millionth."""
    label = F.col("party_name")
    for old, new in merged.items():
        label = F.when(F.col("party_name") == old, new).otherwise(label)
    out = totals.withColumn("label", label).groupBy("label").agg(F.sum("amount").alias("amount"))
    out = out.withColumn("amount", F.greatest("amount", F.lit(0).cast("decimal(38,2)")))
    whole = F.sum("amount").over(Window.partitionBy())
    share = F.floor(F.col("amount").cast("double") * 1_000_000 / whole.cast("double")) / 1_000_000
    return out.withColumn("share", F.when(whole > 0, share).otherwise(0.0))


def sole_company(rows: DataFrame, key: str, company: str) -> DataFrame:
    """The one company number of a group, or null where it has none or several."""
    return rows.groupBy(key).agg(F.when(F.min(company) == F.max(company), F.min(company)).alias(company))


def usual_name(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The most frequent name; then one without a bracket, then the smallest."""
    counted = rows.filter(F.col(name).isNotNull()).groupBy(key, name).agg(F.count("*").alias("n"))
    top = counted.groupBy(key).agg(F.max(F.struct("n", (~F.col(name).contains("(")).alias("plain"))).alias("top"))
    matched = counted.join(top, key).filter((F.col("n") == F.col("top.n")) & (~F.col(name).contains("(") == F.col("top.plain")))
    return matched.groupBy(key).agg(F.min(name).alias(name), F.max("n").alias("n"))


def eligible(members: DataFrame, declarations: DataFrame, sitting: Column) -> DataFrame:
    """Members who sit, or who declared anything: one semi join for the others."""
    declared = declarations.select("member_id").distinct()
    rest = members.filter(~F.coalesce(sitting, F.lit(False))).join(declared, "member_id", "left_semi")
    return members.filter(sitting).unionByName(rest)
