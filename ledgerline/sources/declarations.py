"""Interests as JSON documents: latest version, funding entries, observations.

Values nest without bound and amounts keep their number's text, which neither
``from_json`` nor the variant type can do; documents are decoded batch by batch
in Python and leave as flat rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

ROLES = ("donor", "payer", "ultimate_payer")
_ADDRESS_FIELDS = {"PayerPublicAddress": "payer", "UltimatePayerAddress": "ultimate_payer"}


class SourceError(ValueError):
    """A document that does not follow the source's format."""


def latest_version(document: dict) -> tuple[int, dict]:
    """The version last published, by date, register id and place."""
    versions = document.get("versions") or []
    if not versions:
        raise SourceError("declaration has no published version")
    place = max(range(len(versions)), key=lambda i: (versions[i]["register"]["publishedDate"], int(versions[i]["register"]["id"]), i))
    return place, versions[place]


def _nested(fields: list[dict], pointer: str) -> Iterator[tuple[dict, list[dict], str]]:
    for i, field in enumerate(fields):
        for j, group in enumerate(field.get("values") or []):
            yield field, group, f"{pointer}/{i}/values/{j}"


def entry_of(fields: list[dict], donor_group: bool = False) -> dict:
    """One funding entry: of repeated fields the last counts, of currencies the first."""
    value = {f["name"]: f.get("value") for f in fields}
    currency = next(((f.get("typeInfo") or {}).get("currencyCode") for f in fields if f["name"] == "Value"), None)
    amount = value.get("Value")
    if amount is not None and not isinstance(amount, str):
        raise SourceError("an amount must be a number or text")
    return {
        "donor": value.get("Name") if donor_group and value.get("DonorName") is None else value.get("DonorName"),
        "payer": value.get("PayerName"), "ultimate_payer": value.get("UltimatePayerName"), "amount": amount, "currency": currency,
        "payment_type": value.get("PaymentType"), "donor_kind": value.get("DonorStatus"), "company_number": value.get("DonorCompanyIdentifier"),
        "different": value.get("IsUltimatePayerDifferent"),
    }


def _anchored(fields: list[dict]) -> bool:
    return any(f["name"] in ("Value", "PaymentType") for f in fields)


def funding(fields: list[dict], pointer: str) -> Iterator[tuple[str, dict]]:
    """Entries depth first: anchored groups, and every group of donors."""
    if _anchored(fields):
        yield pointer, entry_of(fields)
    for field, group, at in _nested(fields, pointer):
        if field["name"] == "Donors":
            yield at, entry_of(group, True)
        else:
            yield from funding(group, at)


def addresses(fields: list[dict], pointer: str, donor_group: bool = False) -> Iterator[tuple[str, dict[str, str]]]:
    """Each scope's public addresses by role; two for one role are an error."""
    found: dict[str, str] = {}
    for f in fields:
        role = "donor" if f["name"] == ("PublicAddress" if donor_group else "DonorPublicAddress") else _ADDRESS_FIELDS.get(f["name"])
        if role and f.get("value") is not None:
            if not isinstance(f["value"], str):
                raise SourceError(f"{f['name']} must contain a public-address string")
            if role in found:
                raise SourceError(f"duplicate {f['name']}")
            found[role] = f["value"]
    yield pointer, found
    for field, group, at in _nested(fields, pointer):
        yield from addresses(group, at, field["name"] == "Donors")


def decode(text: str) -> list[dict]:
    """Rows of one document: its scopes, each with an entry, roles and addresses.

    A declaration whose top fields are no entry has a scope of its own (ordinal
    null), for the roles that they name.
    """
    document = json.loads(text, parse_float=str, parse_int=str)
    place, version = latest_version(document)
    fields, pointer = version.get("fields") or [], f"/versions/{place}/fields"
    places = dict(addresses(fields, pointer))
    parent = document.get("parentInterestId")
    head = {
        "declaration_id": int(document["id"]), "parent_id": None if parent is None else int(parent), "category_id": int(document["category"]["id"]),
        "category_name": document["category"]["name"], "register_id": int(version["register"]["id"]),
        "published": version["register"]["publishedDate"], "registered": version.get("registrationDate"),
    }
    scopes = [(n, at, entry) for n, (at, entry) in enumerate(funding(fields, pointer))]
    if not _anchored(fields):
        scopes.append((None, pointer, entry_of(fields)))
    rows = []
    for ordinal, at, entry in scopes:
        where = places.get(at, {})
        rows.append(head | entry | {"ordinal": ordinal, "pointer": at} | {f"{r}_address": where.get(r) for r in ROLES})
    return rows


SCOPES = (
    "member_id long, declaration_id long, parent_id long, category_id int, category_name string, register_id long, published string, registered string, "
    "ordinal int, pointer string, donor string, payer string, ultimate_payer string, amount string, currency string, payment_type string, donor_kind string, "
    "company_number string, different boolean, donor_address string, payer_address string, ultimate_payer_address string"
)
_COLUMNS = [c.split()[0] for c in SCOPES.split(", ")]


def decode_captures(captures: DataFrame) -> DataFrame:
    """Scopes of (member_id, source_json) rows; a document that fails stops the job."""

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [row | {"member_id": member} for member, text in zip(part["member_id"], part["source_json"], strict=True) for row in decode(text)]
            yield pd.DataFrame(rows, columns=_COLUMNS, dtype=object)

    return captures.select("member_id", "source_json").mapInPandas(batch, SCOPES)


def scope_id() -> Column:
    """member/declaration/register, then the entry's ordinal or "declaration"."""
    base = F.concat_ws("/", F.col("member_id").cast("string"), F.col("declaration_id").cast("string"), F.col("register_id").cast("string"))
    return F.when(F.col("ordinal").isNull(), F.concat(base, F.lit("/declaration"))).otherwise(F.concat(base, F.lit("/funding/"), F.col("ordinal").cast("string")))


def observations(scopes: DataFrame) -> DataFrame:
    """Up to three observations of a scope: donor, payer, ultimate payer.

    One is there if it has a name, or, for donors, a kind or a company number.
    """
    def role(name: str, kind: Column, company: Column) -> Column:
        return F.struct(
            F.lit(name).alias("role"), F.col(name).alias("name"), F.col(f"{name}_address").alias("address"), kind.alias("donor_kind"), company.alias("company_number")
        )

    none = F.lit(None).cast("string")
    each = F.array(role("donor", F.col("donor_kind"), F.col("company_number")), role("payer", none, none), role("ultimate_payer", none, none))
    keys = ["member_id", "declaration_id", "register_id", "pointer"]
    out = scopes.withColumn("scope_id", scope_id()).select(*keys, "scope_id", F.explode(each).alias("o")).select(*keys, "scope_id", "o.*")
    out = out.filter(F.coalesce("name", "donor_kind", "company_number").isNotNull())
    return out.withColumn("obs_id", F.concat_ws("/", "scope_id", "role")).withColumn("is_root", is_root(F.col("pointer")))


def is_root(pointer: Column) -> Column:
    """Whether a pointer names the version's own fields."""
    return pointer.rlike("^/versions/[0-9]+/fields$")


def replay_differences(entries: DataFrame, replayed: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of either side that the other lacks, as multisets."""
    a, b = entries.select(*columns), replayed.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("stored")).unionByName(b.exceptAll(a).withColumn("side", F.lit("replayed")))
