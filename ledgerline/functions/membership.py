"""Chambers, kinds of membership, funder kinds, categories: mappings and predicates.

Each mapping is a literal chain of conditions, so it folds into the scan's stage;
values that no rule knows are errors, as they would be on entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Kinds of membership by chamber, and the source's subtype ids of the Lords.
COMMONS_KINDS = ["Elected MP"]
LORDS_KINDS = ["Life peer", "Hereditary peer", "Excepted hereditary peer", "Hereditary peer given life peerage", "Bishop", "Judicial peer"]
COMMONS_HOUSE, LORDS_HOUSE = 1, 2
LORDS_SUBTYPES = {
    2: "Hereditary peer", 3: "Hereditary peer", 4: "Life peer", 5: "Bishop", 6: "Judicial peer", 9: "Hereditary peer given life peerage", 10: "Excepted hereditary peer",
}
FUNDER_KINDS = [
    "Company", "Individual", "Trust", "Trade Union", "Other", "Not Specified", "Building society", "Limited Liability Partnership",
    "Unincorporated association", "Friendly society", "Registered Party",
]
DONATION_CATEGORY = 3
SHAREHOLDING_CATEGORIES = [4, 12, 31, 1002, 1003, 1004, 1005]


def _unknown(what: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"unsupported {what} "), F.coalesce(value.cast("string"), F.lit("null"))))


def membership_kind(house: Column, subtype: Column) -> Column:
    """The kind that the source's house and subtype stand for; an unsupported one stops the job."""
    lords = None
    for number, name in LORDS_SUBTYPES.items():
        lords = F.when(subtype == number, name) if lords is None else lords.when(subtype == number, name)
    lords = lords.otherwise(_unknown("Lords membership kind", subtype))
    return F.when(house == COMMONS_HOUSE, COMMONS_KINDS[0]).when(house == LORDS_HOUSE, lords).otherwise(_unknown("Parliament house", house))


def membership_kinds(spark: SparkSession) -> DataFrame:
    """(membership_kind, chamber): a table of as many rows as there are kinds."""
    rows = [(k, "Commons") for k in COMMONS_KINDS] + [(k, "Lords") for k in LORDS_KINDS]
    return spark.createDataFrame(rows, "membership_kind string, chamber string")


def chamber(kind: Column) -> Column:
    """"Commons" or "Lords"; an unknown kind stops the job."""
    return F.when(kind.isin(COMMONS_KINDS), "Commons").when(kind.isin(LORDS_KINDS), "Lords").otherwise(_unknown("membership kind", kind))


def in_chamber(members: DataFrame, name: str, kind: str = "membership_kind") -> DataFrame:
    """Members of one chamber: a filter on their kind that reaches the scan."""
    if name not in ("Commons", "Lords"):
        raise ValueError(f"unknown chamber: {name!r}")
    return members.filter(F.col(kind).isin(COMMONS_KINDS if name == "Commons" else LORDS_KINDS))


def current_commons(kind: Column, end: Column) -> Column:
    """Whether a member sits in the Commons: a kind of that chamber without an end."""
    return (chamber(kind) == "Commons") & end.isNull()


def funder_kind(kind: Column) -> Column:
    """The kind as stored, "Not Specified" for null; any other spelling stops the job."""
    return F.when(kind.isNull(), "Not Specified").when(kind.isin(FUNDER_KINDS), kind).otherwise(_unknown("funder kind", kind))


def is_individual(kind: Column) -> Column:
    return funder_kind(kind) == "Individual"


def category(category_id: Column) -> Column:
    """"donation_or_support" for its category, "other" for all others; ids are positive."""
    return F.when(category_id == DONATION_CATEGORY, "donation_or_support").when(category_id > 0, "other").otherwise(_unknown("category", category_id))


def category_order(category_id: Column) -> list[Column]:
    """Sort keys of categories: donations before all others, these by id."""
    return [(category_id != DONATION_CATEGORY).asc(), category_id.asc()]


def placement(category_id: Column) -> Column:
    """Where the Lords' page shows a category: "shareholdings" or "other"."""
    return F.when(category_id.isin(SHAREHOLDING_CATEGORIES), "shareholdings").otherwise("other")


def among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is one of ``ids``: a semi join, which the planner broadcasts if they are few."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")
