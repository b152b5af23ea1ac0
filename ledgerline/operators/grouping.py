"""Funder groups: equal names and reviewed families, with their evidence and details.

A group is a connected component of funders that share a normalised name or a
reviewed family; its smallest funder names it.  Names and families link their
funders as stars, so a name with many funders makes as many edges, not their
square; pairs of funders are only made as evidence of the groups asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.operators.graph import connected_components
from ledgerline.operators.registers import normal_name, sole_company, usual_name

# Reviewed families, their preferred names and the spellings that belong to them.
FAMILIES = {
    "bbc": ("BBC", ["BBC", "BBC Contributor Payments", "BBC Home Services", "BBC Studios", "BBC Studios Ltd", "BBC Wales Cymru"]),
    "gb_news": ("GB News", ["GB News", "GB News Limited", "GB News Ltd"]),
    "premier_league": (
        "Premier League",
        ["Premier League", "FA Premier League Ltd", "The FA Premier League Ltd", "The Premier League", "Premier League International Holdings Ltd"],
    ),
}


class GroupingError(ValueError):
    """Funders that cannot be grouped: repeated ids, or several families in one group."""


@dataclass(frozen=True)
class Groups:
    """What ``funder_groups`` returns."""

    memberships: DataFrame  # funder_id, group_id of every funder
    names: DataFrame  # group_id, preferred_name, family_key of groups with a family
    spellings: DataFrame  # funder_id, name, spelling: normalised names and how they are written
    families: DataFrame  # funder_id, family_key, name of reviewed funders


def family_names(spark: SparkSession) -> DataFrame:
    """(family_key, preferred_name, name): the reviewed spellings, normalised."""
    rows = [(key, preferred, " ".join(n.split()).lower()) for key, (preferred, names) in FAMILIES.items() for n in names]
    return spark.createDataFrame(rows, "family_key string, preferred_name string, name string")


def _stars(rows: DataFrame, key: str) -> DataFrame:
    low = rows.groupBy(key).agg(F.min("funder_id").alias("low"))
    return rows.join(low, key).filter(F.col("funder_id") != F.col("low")).select("funder_id", "low")


def funder_groups(funders: DataFrame, aliases: DataFrame) -> Groups:
    """Groups of ``funders`` (funder_id, funder_name) with ``aliases`` (funder_id, alias).

    Blank names link nothing; a family looks at the funder's name, not at its
    aliases.  A repeated funder_id, or two families in one group, is an error.
    """
    repeated = funders.groupBy("funder_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    if repeated:
        raise GroupingError(f"duplicate funder {repeated[0]['funder_id']}")
    every = funders.select("funder_id", F.col("funder_name").alias("spelling"))
    every = every.unionByName(aliases.join(funders.select("funder_id"), "funder_id", "left_semi").select("funder_id", F.col("alias").alias("spelling")))
    spellings = every.withColumn("name", normal_name(F.col("spelling"))).filter("name <> ''").distinct()
    reviewed = F.broadcast(family_names(funders.sparkSession))  # as many rows as FAMILIES
    own = funders.select("funder_id", F.col("funder_name").alias("spelling"), normal_name(F.col("funder_name")).alias("name"))
    families = own.join(reviewed, "name").select("funder_id", "family_key", F.col("spelling").alias("name"))
    edges = _stars(spellings.select("funder_id", "name").distinct(), "name").union(_stars(families, "family_key"))
    components = connected_components(edges, "funder_id", "low").select(F.col("id").alias("funder_id"), F.col("component").alias("group_id"))
    memberships = funders.select("funder_id").join(components, "funder_id", "left").withColumn("group_id", F.coalesce("group_id", "funder_id"))
    named = families.join(memberships, "funder_id").select("group_id", "family_key").distinct()
    mixed = named.groupBy("group_id").agg(F.array_sort(F.collect_set("family_key")).alias("keys")).filter(F.size("keys") > 1).limit(1).collect()
    if mixed:
        raise GroupingError(f"group {mixed[0]['group_id']} has the families {', '.join(mixed[0]['keys'])}")
    preferred = F.broadcast(family_names(funders.sparkSession).select("family_key", "preferred_name").distinct())
    return Groups(memberships, named.join(preferred, "family_key").select("group_id", "preferred_name", "family_key"), spellings, families)


def group_members(funders: DataFrame, memberships: DataFrame, requested: DataFrame) -> DataFrame:
    """(requested, group_id, funder_id): all funders of the groups of ``requested`` (funder_id).

    The group's own funder is always one; an id that no funder has gives none.
    """
    asked = requested.join(funders.select("funder_id"), "funder_id", "left_semi").select(F.col("funder_id").alias("requested")).distinct()
    owner = memberships.select(F.col("funder_id").alias("requested"), "group_id")
    asked = asked.join(owner, "requested", "left").withColumn("group_id", F.coalesce("group_id", "requested"))
    listed = asked.join(memberships.select("funder_id", "group_id"), "group_id").select("requested", "group_id", "funder_id")
    return listed.unionByName(asked.select("requested", "group_id", F.col("group_id").alias("funder_id"))).distinct()


def group_profile(funders: DataFrame, names: DataFrame, members: DataFrame) -> DataFrame:
    """(requested, group_id, funder_name, funder_kind, company_number) of ``group_members``' rows.

    Name and kind are the group's; the company number is that of all members, if
    they have one and no other.
    """
    numbers = sole_company(members.join(funders.select("funder_id", "company_number"), "funder_id"), "requested", "company_number")
    label = funders.select(F.col("funder_id").alias("group_id"), "funder_name", "funder_kind").join(names.select("group_id", "preferred_name"), "group_id", "left")
    label = label.select("group_id", F.coalesce("preferred_name", "funder_name").alias("funder_name"), F.coalesce("funder_kind", F.lit("Not Specified")).alias("funder_kind"))
    return members.select("requested", "group_id").distinct().join(label, "group_id").join(numbers, "requested").select(
        "requested", "group_id", "funder_name", "funder_kind", "company_number"
    )


def group_aliases(funders: DataFrame, aliases: DataFrame, members: DataFrame) -> DataFrame:
    """(requested, alias, place): all spellings of a group's funders, once each, in order of code points.

    Place by a join with smaller spellings would be quadratic; it is the index
    of the group's own sorted set, which a detail page shows as a whole.
    """
    spelled = aliases.select("funder_id", "alias").unionByName(funders.select("funder_id", F.col("funder_name").alias("alias"))).filter("alias is not null")
    sets = members.join(spelled, "funder_id").groupBy("requested").agg(F.array_sort(F.collect_set("alias")).alias("all"))
    return sets.select("requested", F.posexplode("all").alias("place", "alias")).withColumn("place", F.col("place").cast("long"))


def alias_links(spellings: DataFrame, members: DataFrame) -> DataFrame:
    """Evidence of the groups in ``members``: pairs of funders (left below right) and how each writes the shared name."""
    some = spellings.join(members.select("funder_id").distinct(), "funder_id", "left_semi")
    left = some.select("name", F.col("funder_id").alias("left_funder_id"), F.col("spelling").alias("left_alias"))
    right = some.select("name", F.col("funder_id").alias("right_funder_id"), F.col("spelling").alias("right_alias"))
    out = left.join(right, "name").filter("left_funder_id < right_funder_id").withColumnRenamed("name", "normalized_alias")
    return out.select("left_funder_id", "right_funder_id", "normalized_alias", "left_alias", "right_alias")


def family_links(families: DataFrame, members: DataFrame) -> DataFrame:
    """Evidence of reviewed families among ``members``: pairs of funders and their names."""
    some = families.join(members.select("funder_id").distinct(), "funder_id", "left_semi")
    left = some.select("family_key", F.col("funder_id").alias("left_funder_id"), F.col("name").alias("left_name"))
    right = some.select("family_key", F.col("funder_id").alias("right_funder_id"), F.col("name").alias("right_name"))
    out = left.join(right, "family_key").filter("left_funder_id < right_funder_id")
    return out.select("left_funder_id", "right_funder_id", "family_key", "left_name", "right_name")


EVIDENCE_ORDER = ["left_funder_id", "right_funder_id", "normalized_alias", "left_alias", "right_alias"]
FAMILY_ORDER = ["family_key", "left_funder_id", "right_funder_id"]


def funder_history(entries: DataFrame, declarations: DataFrame, members: DataFrame, kinds: DataFrame, asked: DataFrame) -> DataFrame:
    """Entries of the funders in ``asked`` (requested, funder_id) with declaration, member and kind of membership: inner joins all."""
    some = entries.join(asked.select("requested", "funder_id"), "funder_id")
    return some.join(declarations, "declaration_id").join(members, "member_id").join(F.broadcast(kinds), "membership_kind")


def rollup(identities: DataFrame, observations: DataFrame, selected: DataFrame) -> DataFrame:
    """One funder per identity in ``selected`` (identity): name, kind, company number and aliases.

    ``observations`` has obs_id, name_raw, donor_kind and company_number.  The
    number is that of the first observation of kind Company with one; with it the
    kind is Company, otherwise the first that is known.  The name is the usual
    one; without any it is made from the number.
    """
    rows = identities.join(selected.select("identity").distinct(), "identity", "left_semi").join(observations, "obs_id")
    named = F.when(F.trim(F.regexp_replace("name_raw", r"\s+", " ")) != "", F.col("name_raw"))
    rows = rows.withColumn("name", named)
    company = (F.col("donor_kind") == "Company") & F.col("company_number").isNotNull()
    facts = rows.groupBy("identity").agg(
        F.min_by("company_number", F.when(company, F.col("obs_id"))).alias("company_number"),
        F.min_by("donor_kind", F.when(F.col("donor_kind").isNotNull(), F.col("obs_id"))).alias("first_kind"),
        F.array_sort(F.collect_set("name")).alias("aliases"),
    )
    usual = usual_name(rows, "identity", "name").select("identity", "name")
    number = F.col("company_number")
    made = F.when(number.isNotNull(), F.concat(F.lit("Companies House "), number)).otherwise("Unnamed resolved funder")
    return facts.join(usual, "identity", "left").select(
        "identity", F.coalesce("name", made).alias("funder_name"), F.when(number.isNotNull(), "Company").otherwise(F.col("first_kind")).alias("funder_kind"), "company_number", "aliases"
    )
