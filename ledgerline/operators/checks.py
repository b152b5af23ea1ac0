"""Coherence of staged and loaded tables: each check is a table of the rows at fault.

Nothing is repaired: ``require`` stops the job at the first fault.  All checks are
aggregates and anti joins on the tables' own keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.names import address_quality
from ledgerline.sources.declarations import is_root

# Fixed value: which role each basis of attribution selects.
BASIS_ROLES = {"explicit_ultimate_payer": "ultimate_payer", "parent_payer": "payer", "payer": "payer", "donor": "donor"}


class CheckFailed(ValueError):
    """Tables that do not agree."""


def _faults(rows: DataFrame, bad: Column, why: str, key: str) -> DataFrame:
    return rows.filter(F.coalesce(bad, F.lit(True))).select(F.lit(why).alias("why"), F.col(key).cast("string").alias("key"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def require(faults: DataFrame) -> None:
    """Raise for the first fault of (why, key) rows."""
    found = faults.limit(1).collect()
    if found:
        raise CheckFailed(f"{found[0]['why']}: {found[0]['key']}")


def repeated(rows: DataFrame, key: str, why: str) -> DataFrame:
    many = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    return many.select(F.lit(why).alias("why"), F.col(key).cast("string").alias("key"))


def dangling(rows: DataFrame, key: str, known: DataFrame, known_key: str, why: str) -> DataFrame:
    """Non-null keys that ``known`` lacks."""
    asked = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"))
    return asked.join(known.select(F.col(known_key).alias("_k")), "_k", "left_anti").distinct().select(F.lit(why).alias("why"), F.col("_k").cast("string").alias("key"))


def missing_from(left: DataFrame, right: DataFrame, columns: list[str], why: str) -> DataFrame:
    """Rows of either side that the other lacks, as multisets."""
    a, b = left.select(*columns), right.select(*columns)
    both = a.exceptAll(b).unionByName(b.exceptAll(a))
    return both.select(F.lit(why).alias("why"), F.to_json(F.struct(*columns)).alias("key"))


def declarations_disagree(rows: DataFrame) -> DataFrame:
    """Declarations whose register or parent differ between their rows."""
    facts = F.struct("register_id", "parent_id")
    one = rows.groupBy("member_id", "declaration_id").agg(F.min(facts).alias("a"), F.max(facts).alias("b")).filter(~F.col("a").eqNullSafe(F.col("b")))
    return one.select(F.lit("declaration metadata disagrees between occurrences").alias("why"), F.concat_ws("/", "member_id", "declaration_id").alias("key"))


def resolution_input(payments: DataFrame, observations: DataFrame) -> DataFrame:
    """Faults of cleaned payments and observations before they are resolved.

    ``payments``: payment_id, member_id, declaration_id, register_id, parent_id,
    ordinal, donor, payer, ultimate_payer.  ``observations``: obs_id, payment_id,
    member_id, declaration_id, register_id, ordinal, role, source_scope, pointer,
    donor_kind, company_number, name_normalized, person_name, address_normalized,
    address_quality.
    """
    scope = F.concat_ws("/", F.col("member_id").cast("string"), F.col("declaration_id").cast("string"), F.col("register_id").cast("string"))
    due = F.concat(scope, F.lit("/funding/"), F.col("ordinal").cast("string"))
    own = F.concat(F.coalesce(F.col("payment_id"), F.concat(scope, F.lit("/declaration"))), F.lit("/"), F.col("role"))
    blank = reduce(lambda a, b: a | b, (F.coalesce(F.trim(c) == "", F.lit(False)) for c in ("name_normalized", "person_name", "address_normalized")))
    whole = F.col("pointer").rlike("^/versions/[0-9]+/fields(/[0-9]+/values/[0-9]+)*$")
    declared = (F.col("source_scope") == "declaration") & F.col("payment_id").isNull() & F.col("ordinal").isNull() & is_root(F.col("pointer"))
    funded = (F.col("source_scope") == "funding_entry") & F.col("payment_id").isNotNull() & F.col("ordinal").isNotNull()
    roles = payments.select("payment_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("donor", "payer", "ultimate_payer"))), F.array("donor", "payer", "ultimate_payer"))).alias("role", "obs"))
    roles = roles.filter("obs is not null")
    back = observations.select("obs_id", F.col("role").alias("_role"), F.col("payment_id").alias("_payment"))
    met = roles.join(back, F.col("obs") == F.col("obs_id"), "left")
    kept = payments.select(F.col("payment_id").alias("_p"), *[F.col(c).alias(f"_{c}") for c in ("member_id", "declaration_id", "register_id", "ordinal")])
    scoped = observations.filter("payment_id is not null").join(kept, F.col("payment_id") == F.col("_p"), "left")
    agrees = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_{c}") for c in ("member_id", "declaration_id", "register_id", "ordinal")))
    named = observations.filter("payment_id is not null").join(roles.select(F.col("obs").alias("_o")), F.col("obs_id") == F.col("_o"), "left_anti")
    quality = address_quality(F.col("address_normalized"))
    donors_only = (F.col("role") != "donor") & (F.col("donor_kind").isNotNull() | F.col("company_number").isNotNull())
    both = payments.select("member_id", "declaration_id", "register_id", "parent_id")
    registers = observations.select("member_id", "declaration_id", "register_id").join(both.select("member_id", "declaration_id", F.col("register_id").alias("_r")).distinct(), ["member_id", "declaration_id"])
    return _union([
        _faults(payments, F.col("register_id") == 0, "zero register", "payment_id"),
        _faults(payments, F.col("payment_id") != due, "funding occurrence id disagrees with its source identity", "payment_id"),
        repeated(payments, "payment_id", "duplicate funding occurrence"),
        declarations_disagree(both),
        _faults(observations, F.col("register_id") == 0, "zero register", "obs_id"),
        _faults(observations, ~whole, "malformed source pointer", "obs_id"),
        _faults(observations, ~(declared | funded), "invalid observation scope", "obs_id"),
        _faults(scoped, ~agrees, "observation scope disagrees with funding occurrence", "obs_id"),
        _faults(observations, donors_only, "payer role carries donor metadata", "obs_id"),
        _faults(observations, F.col("address_quality") != quality, "address quality disagrees with its address", "obs_id"),
        _faults(observations, blank, "empty normalised evidence", "obs_id"),
        _faults(observations, F.col("obs_id") != own, "observation id disagrees with scope and role", "obs_id"),
        _faults(registers, F.col("register_id") != F.col("_r"), "observation declaration register mismatch", "declaration_id"),
        repeated(observations, "obs_id", "duplicate observation"),
        _faults(met, (F.col("_role") != F.col("role")) | ~F.col("_payment").eqNullSafe(F.col("payment_id")), "payment role points to an unrelated observation", "obs"),
        _faults(named, F.lit(True), "unreferenced funding role observation", "obs_id"),
    ])


def _odd_probability() -> Column:
    p = F.col("probability")
    return p.isNull() | F.isnan(p) | ~p.between(0.0, 1.0)


def scores(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Faults of scored pairs: order, repeats, unknown profiles, values out of range."""
    pair = F.concat_ws(" ", F.col("left").cast("string"), F.col("right").cast("string"))
    rows = pairs.withColumn("pair", pair)
    odd_levels = ~F.col("name_level").between(-1, 2) | ~F.col("address_level").between(-1, 1)
    return _union([
        _faults(rows, F.col("left") > F.col("right"), "unordered pair", "pair"),
        repeated(rows, "pair", "duplicate pair"),
        _faults(rows, _odd_probability(), "invalid probability", "pair"),
        _faults(rows, odd_levels, "invalid comparison level", "pair"),
        dangling(rows, "left", profiles, "profile_id", "unknown profile"),
        dangling(rows, "right", profiles, "profile_id", "unknown profile"),
    ])


def pair_decisions(pairs: DataFrame, observations: DataFrame) -> DataFrame:
    """Faults of resolved pair decisions."""
    rows = pairs.withColumn("pair", F.concat_ws(" ", F.col("left").cast("string"), F.col("right").cast("string")))
    return _union([
        _faults(rows, F.col("left") >= F.col("right"), "unordered pair decision", "pair"),
        repeated(rows, "pair", "duplicate pair decision"),
        _faults(rows, _odd_probability(), "invalid probability", "pair"),
        dangling(rows, "left", observations, "obs_id", "unknown observation"),
        dangling(rows, "right", observations, "obs_id", "unknown observation"),
    ])


def staged_tables(raw: DataFrame, cleaned: DataFrame, observations: DataFrame, identities: DataFrame, attributions: DataFrame, metadata: list[str]) -> DataFrame:
    """Faults between raw, cleaned and resolved tables.

    ``raw`` and ``cleaned`` have payment_id, declaration_id and ``metadata``,
    which must agree; each cleaned payment has one attribution, each observation
    one identity, and an attribution that selects one must select of its own
    payment, or of its parent declaration, in the role that its basis names.
    """
    facts = F.struct(*metadata)
    agree = cleaned.select("payment_id", facts.alias("_c")).join(raw.select("payment_id", facts.alias("_r")), "payment_id")
    chosen = attributions.filter("selected is not null").join(cleaned.select("payment_id", "member_id", "declaration_id", "parent_id"), "payment_id")
    seen = observations.select(
        F.col("obs_id").alias("selected"), F.col("member_id").alias("_m"), F.col("declaration_id").alias("_d"), F.col("role").alias("_role"), F.col("payment_id").alias("_p")
    )
    met = chosen.join(seen, "selected", "left").join(identities.select(F.col("obs_id").alias("selected"), "identity_id"), "selected", "left")
    role = None
    for basis, name in BASIS_ROLES.items():
        role = F.when(F.col("basis") == basis, name) if role is None else role.when(F.col("basis") == basis, name)
    due = F.coalesce("parent", "declaration_id")
    parent_ok = F.col("parent").isNull() | (F.col("parent").eqNullSafe(F.col("parent_id")) & (F.col("_role") == "payer"))
    own_ok = F.col("parent").isNotNull() | F.col("_p").isNull() | (F.col("_p") == F.col("payment_id"))
    right = (F.col("_m") == F.col("member_id")) & (F.col("_d") == due) & (F.col("_role") == role) & parent_ok & own_ok
    return _union([
        missing_from(raw, cleaned, ["payment_id"], "cleaned occurrences do not cover the raw capture"),
        _faults(agree, ~F.col("_c").eqNullSafe(F.col("_r")), "cleaned row disagrees with raw metadata", "payment_id"),
        repeated(cleaned, "payment_id", "duplicate funding occurrence"),
        repeated(attributions, "payment_id", "duplicate attribution"),
        dangling(cleaned, "payment_id", attributions, "payment_id", "payment without attribution"),
        dangling(attributions, "payment_id", cleaned, "payment_id", "attribution without payment"),
        dangling(observations, "obs_id", identities, "obs_id", "observation without identity"),
        dangling(identities, "obs_id", observations, "obs_id", "identity without observation"),
        _faults(met, ~right, "selected observation is not of this payment or its parent", "payment_id"),
        _faults(met, F.col("identity_id").isNull(), "selected observation has no identity", "payment_id"),
    ])


def load_rows(declarations: DataFrame, funders: DataFrame, entries: DataFrame) -> DataFrame:
    """Faults of what a load would write.

    ``declarations``: declaration_id, category_id, category_name, register_id;
    ``funders``: identity, funder_name, company_number, aliases; ``entries``:
    source_id, declaration_id, identity, selected, basis, reason, parent.
    """
    blank = F.trim("category_name") == ""
    unnamed = (F.trim("funder_name") == "") & (F.coalesce("company_number", F.lit("")) == "")
    selected = F.col("selected").isNotNull()
    incoherent = (
        (F.col("source_id") == "") | F.coalesce(F.col("selected") == "", F.lit(False)) | (F.col("identity").isNotNull() != selected)
        | (F.col("basis").isNotNull() != selected) | (F.col("reason").isNotNull() == selected)
        | (F.col("parent").isNotNull() != F.coalesce(F.col("basis") == "parent_payer", F.lit(False)))
    )
    return _union([
        repeated(declarations, "declaration_id", "duplicate declaration"),
        _faults(declarations, (F.col("category_id") == 0) | blank | (F.col("register_id") == 0), "invalid declaration", "declaration_id"),
        repeated(funders, "identity", "duplicate identity"),
        _faults(funders, (F.col("identity") == "") | unnamed | F.exists("aliases", lambda a: F.trim(a) == ""), "invalid identity", "identity"),
        repeated(entries, "source_id", "duplicate funding occurrence"),
        _faults(entries, incoherent, "incoherent attribution", "source_id"),
        dangling(entries, "declaration_id", declarations, "declaration_id", "entry of an unknown declaration"),
        dangling(entries, "identity", funders, "identity", "entry of an unknown identity"),
    ])
