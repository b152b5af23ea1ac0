"""Captured pages and staged files as tables: scans, their checks, and settings.

The source's services are pages of JSON; here their captures are files, one page
each, read by Spark's binary file source, so pages are decoded where they lie and
a failed page stops the job.  What joins pages (totals, gaps, repeated members)
is checked on one row per page or member.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ledgerline.functions.membership import membership_kind
from ledgerline.operators.trees import NODES, register_rows
from ledgerline.sources.declarations import SourceError

# Staged columns of members and raw declarations, and the manifest of a Lords capture.
MEMBERS = (
    "parliament_member_id long, name string, party_id long, party_name string, constituency string, membership_kind string, "
    "membership_start_date string, membership_end_date string, membership_status string"
)
RAW = (
    "parliament_member_id long, declaration_id long, parent_declaration_id long, category_id long, category_name string, register_id long, "
    "register_published_date date, registration_date date, ultimate_payer_name string, donor_name string, payer_name string, amount string, currency string, "
    "payment_type string, funder_kind string, company_number string, is_ultimate_payer_different boolean, fetched_at timestamp, source_json string"
)
LORDS_SOURCE, LORDS_FORMAT = "https://members-api.parliament.uk/api/LordsInterests/Register", 1
FETCHES_AT_ONCE, CANDIDATE_BUDGET = 10, 1_000_000


class CaptureError(SourceError):
    """Pages or files that are no complete capture."""


def _fail_if_any(rows: DataFrame, message: str) -> None:
    found = rows.limit(1).collect()
    if found:
        raise CaptureError(f"{message}: {found[0].asDict()}")


def read_pages(spark: SparkSession, folder: str, pattern: str = "*.json", at_once: int = FETCHES_AT_ONCE) -> DataFrame:
    """(path, page, content, length, sha256) of the page files below a folder.

    ``page`` is the last number in a file's name.  ``at_once`` pages are decoded
    together by what follows; no file at all is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    page = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"([0-9]+)[^0-9]*$", 1)
    out = files.select("path", F.when(page != "", page.cast("int")).alias("page"), "content", "length", F.sha2("content", 256).alias("sha256"))
    if out.select("path").isEmpty():
        raise CaptureError(f"no page in {folder}")
    return out.repartition(at_once, "path")


def _decoded(pages: DataFrame, rows_of, schema: str) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [row for path, number, content in zip(part["path"], part["page"], part["content"], strict=True) for row in rows_of(path, number, bytes(content))]
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return pages.select("path", "page", "content").mapInPandas(batch, schema)


def member_pages(pages: DataFrame) -> DataFrame:
    """Members of captured search pages, in the columns of ``MEMBERS``.

    Pages follow each other until their items make up the reported total; a
    total that is never reached, or that changes, is an error, and so is a house
    or subtype that no kind of membership has.
    """

    def rows_of(path: str, number: int, content: bytes) -> list[tuple]:
        page = json.loads(content)
        total, items = page["totalResults"], page["items"]
        out = []
        for item in items or [None]:
            value = (item or {}).get("value")
            latest = (value or {}).get("latestHouseMembership") or {}
            party = (value or {}).get("latestParty") or {}
            out.append((
                number, total, len(items), value and value["id"], value and value["nameDisplayAs"], party.get("id"), party.get("name"), latest.get("membershipFrom"), latest.get("house"),
                latest.get("membershipFromId"), latest.get("membershipStartDate"), latest.get("membershipEndDate"), (latest.get("membershipStatus") or {}).get("statusDescription"),
            ))
        return out

    schema = (
        "page int, total long, items long, parliament_member_id long, name string, party_id long, party_name string, constituency string, house int, subtype int, "
        "membership_start_date string, membership_end_date string, membership_status string"
    )
    rows = _decoded(pages, rows_of, schema)
    per_page = rows.groupBy("page").agg(F.max("total").alias("total"), F.max("items").alias("items"))
    sums = per_page.agg(F.sum("items").alias("got"), F.min("total").alias("low"), F.max("total").alias("high"))
    _fail_if_any(sums.filter("got <> high or low <> high"), "incomplete member pages")
    named = rows.filter("parliament_member_id is not null").withColumn("membership_kind", membership_kind(F.col("house"), F.col("subtype")))
    return named.select(*[c.split()[0] for c in MEMBERS.split(", ")])


def interest_pages(pages: DataFrame, member: Column) -> DataFrame:
    """(member_id, declaration_id, source_json, page) of captured interest pages.

    ``member`` gives a page's member from its path.  A page without items ends
    its member's pages; earlier pages must add up to the total then known.
    """

    def rows_of(path: str, number: int, content: bytes) -> list[tuple]:
        page = json.loads(content, parse_float=_Verbatim, parse_int=_Verbatim)
        return [(path, number, int(page["totalResults"]), len(page["items"]), int(item["id"]), _dumps(item)) for item in page["items"]]

    rows = _decoded(pages, rows_of, "path string, page int, total long, items long, declaration_id long, source_json string")
    rows = rows.withColumn("member_id", member)
    per_page = rows.groupBy("member_id", "page").agg(F.max("total").alias("total"), F.max("items").alias("items"))
    sums = per_page.groupBy("member_id").agg(F.sum("items").alias("got"), F.max("total").alias("total"))
    _fail_if_any(sums.filter("got < total"), "incomplete interest pages")
    return rows.select("member_id", "declaration_id", "source_json", "page")


class _Verbatim(float):
    """A number that is written as it was read."""

    def __new__(cls, text: str):
        out = super().__new__(cls, text)
        out.text = text
        return out

    def __repr__(self) -> str:
        return self.text


def _dumps(value) -> str:
    """JSON with numbers as they were written."""
    if isinstance(value, _Verbatim):
        return value.text
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dumps(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_dumps, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def check_cohort(members: DataFrame, captured: DataFrame) -> None:
    """Every stored member must be captured, and there must be one: an empty cohort is an error."""
    if members.isEmpty():
        raise CaptureError("no stored members: load members first")
    _fail_if_any(members.select("member_id").join(captured.select("member_id").distinct(), "member_id", "left_anti"), "a member was not captured")


def lords_pages(pages: DataFrame) -> DataFrame:
    """Node rows of Lords register pages (see ``trees.NODES``), after ``page_faults`` found none.

    A page is {"items": [{"value": register}, ...], "skip", "take", "totalResults"}; a member
    on two pages, or twice on one, is an error.
    """

    def shape(path: str, number: int, content: bytes) -> list[tuple]:
        page = json.loads(content)
        return [(number, page["skip"], page["take"], page["totalResults"], len(page["items"]), [r["value"]["member"]["id"] for r in page["items"]])]

    shapes = _decoded(pages, shape, "page int, skip long, take long, total long, items long, members array<long>")
    _fail_if_any(page_faults(shapes), "incomplete or inconsistent pages")
    members = shapes.select(F.explode("members").alias("member_id")).groupBy("member_id").agg(F.count("*").alias("n"))
    _fail_if_any(members.filter("n > 1"), "duplicate member")

    def nodes(path: str, number: int, content: bytes) -> list[dict]:
        return [row for item in json.loads(content)["items"] for row in register_rows(item["value"])]

    return _decoded(pages, nodes, NODES)


def page_faults(pages: DataFrame) -> DataFrame:
    """Pages (skip, take, total, items) that do not follow each other to the end.

    One row a page: of pages that overlap, leave a gap, disagree about the total,
    pass it, are short before the end, or take nothing.  The last page is at
    fault if the total is not reached.
    """
    # As many rows as a capture has pages, which one window orders.
    order = Window.orderBy("skip")
    out = pages.withColumn("_due", F.coalesce(F.lag(F.col("skip") + F.col("items")).over(order), F.lit(0)))
    out = out.withColumn("_total", F.first("total").over(order)).withColumn("_next", F.lead("skip").over(order))
    end = F.col("skip") + F.col("items")
    short = (F.col("items") < F.col("take")) & (end < F.col("total"))
    empty = (F.col("items") == 0) & (F.col("total") != 0)
    over = (F.col("items") > F.col("take")) | (end > F.col("total")) | (F.col("take") == 0)
    unfinished = F.col("_next").isNull() & (end < F.col("total"))
    return out.filter((F.col("skip") != F.col("_due")) | (F.col("total") != F.col("_total")) | short | empty | over | unfinished).drop("_due", "_total", "_next")


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """Staged members; files of the first five columns alone are read too, as elected members."""
    rows = spark.read.schema(MEMBERS).parquet(path)
    return rows.withColumn("membership_kind", F.coalesce("membership_kind", F.lit("Elected MP")))


def read_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Raw declarations of a folder with one file (or folder) per member, named by the member's number.

    Rows that name another member than their file, a file that is not so named,
    columns that lack or have another type, and the old column ``member_id`` are
    errors.
    """
    found = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    if "member_id" in found.columns:
        raise CaptureError("unsupported raw format: capture a new run")
    for field in T._parse_datatype_string(RAW).fields:
        if field.name not in found.columns or found.schema[field.name].dataType != field.dataType:
            raise CaptureError(f"raw column {field.name} is missing or has another type")
    rows = found.select(*[c.split()[0] for c in RAW.split(", ")], F.regexp_extract(F.input_file_name(), r"/([^/]+)\.parquet(?:/[^/]*)?$", 1).alias("_file"))
    _fail_if_any(rows.filter("_file <> cast(parliament_member_id as string)").select("_file", "parliament_member_id"), "a file's rows are of another member")
    return rows.drop("_file")


def read_typed(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """A staged table of exactly these types (more columns are fine), and (path, sha256) of its files' bytes."""
    found = spark.read.parquet(path)
    for field in schema.fields:
        if field.name not in found.columns or found.schema[field.name].dataType != field.dataType:
            raise CaptureError(f"column {field.name} of {path} is missing or has another type")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return found.select(*schema.fieldNames()), files.select("path", F.sha2("content", 256).alias("sha256"))


def lords_manifest(pages: DataFrame, key: str, captured_at: str, members: int) -> dict:
    """The manifest of a capture: its pages' lengths and digests, one entry a page."""
    listed = [{"page": r["page"], "bytes": r["length"], "sha256": r["sha256"]} for r in pages.select("page", "length", "sha256").orderBy("page").collect()]
    return {
        "format_version": LORDS_FORMAT, "ingestion_key": key, "captured_at": captured_at, "source": LORDS_SOURCE, "include_deleted": True, "members": members, "pages": listed,
    }


def read_lords(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """Node rows of a published capture, after its manifest and every page's digest hold."""
    text = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/manifest.json").select("content").first()
    manifest = json.loads(bytes(text[0]))
    good = (manifest["format_version"], manifest["ingestion_key"], manifest["source"], manifest["include_deleted"]) == (LORDS_FORMAT, key, LORDS_SOURCE, True)
    if not good or not manifest["pages"]:
        raise CaptureError("unsupported or mismatched manifest")
    if [p["page"] for p in manifest["pages"]] != list(range(1, len(manifest["pages"]) + 1)):
        raise CaptureError("non-contiguous manifest pages")
    pages = read_pages(spark, folder, "page-*.json")
    listed = spark.createDataFrame([(p["page"], p["bytes"], p["sha256"]) for p in manifest["pages"]], "page int, bytes long, digest string")
    both = pages.select("page", "length", "sha256").join(listed, "page", "full")
    wrong = ~(F.col("length").eqNullSafe(F.col("bytes")) & F.col("sha256").eqNullSafe(F.col("digest")))
    _fail_if_any(both.filter(wrong).select("page", "length", "bytes"), "page digest mismatch")
    nodes = lords_pages(pages)
    shapes = pages.select(F.from_json(F.col("content").cast("string"), "items array<struct<value:struct<member:struct<id:long>>>>").alias("j"))
    found = shapes.agg(F.sum(F.size("j.items"))).first()[0]
    if found != manifest["members"]:
        raise CaptureError(f"the manifest counts {manifest['members']} members, its pages {found}")
    return nodes


@dataclass(frozen=True)
class ResolverSettings:
    """Settings of a resolution: where its run is, and the most pairs it may make."""

    data_dir: str
    candidate_budget: int = CANDIDATE_BUDGET

    @classmethod
    def read(cls, path: str) -> ResolverSettings:
        """Settings of a file of ``name: value`` lines; errors name the file."""
        known = {"data_dir": str, "candidate_budget": int}
        found: dict = {}
        try:
            with open(path, encoding="utf-8") as lines:
                for number, line in enumerate(lines, 1):
                    text = line.split(" #")[0].strip()
                    if not text or text[0] == "#" or text == "---":
                        continue
                    name, colon, value = text.partition(":")
                    if not colon or name.strip() not in known:
                        raise ValueError(f"line {number}: {text!r}")
                    found[name.strip()] = known[name.strip()](value.strip().strip("\"'"))
            if not found.get("data_dir"):
                raise ValueError("data_dir is missing")
        except (OSError, ValueError) as error:
            raise ValueError(f"configuration {path}: {error}") from error
        if found.get("candidate_budget", 1) <= 0:
            raise ValueError(f"configuration {path}: candidate_budget must be positive")
        return cls(**found)


def interest_view(text: str, kind: str | None = None) -> dict:
    """One interest as its latest version's fields by name; ``kind`` is the donor's kind that it must have."""
    document = json.loads(text)
    versions = document.get("versions") or []
    if not versions:
        raise SourceError("no version")
    version = max(versions, key=lambda v: v["register"]["publishedDate"])
    fields = {f["name"]: f.get("value") for f in version.get("fields") or []}
    if kind is not None and fields.get("DonorStatus") != kind:
        raise SourceError(f"the donor's status is {fields.get('DonorStatus')!r}, not {kind!r}")
    currency = next(((f.get("typeInfo") or {}).get("currencyCode") for f in version.get("fields") or [] if f["name"] == "Value"), None)
    return {
        "id": document["id"], "category": document["category"]["name"], "registration_date": version.get("registrationDate"),
        "register_published_date": version["register"]["publishedDate"], "donor": fields.get("DonorName"), "donor_status": fields.get("DonorStatus"),
        "company_number": fields.get("DonorCompanyIdentifier"), "amount": fields.get("Value"), "currency": currency, "payment_type": fields.get("PaymentType"),
    }


