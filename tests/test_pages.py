import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from ledgerline.functions import labels, membership
from ledgerline.operators import checks, grouping, loading, search
from ledgerline.sources import captures


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")


def seen(frame, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in frame.select(*columns).collect()]


# -------------------------------------------------------------- mappings


def test_memberships(spark):
    rows = spark.createDataFrame([(1, 99), (2, 4), (2, 10)], "house int, subtype int")
    kinds = rows.select(membership.membership_kind(F.col("house"), F.col("subtype")).alias("k"))
    assert {r["k"] for r in kinds.collect()} == {"Elected MP", "Life peer", "Excepted hereditary peer"}
    for bad in ((2, 7), (3, 1), (2, None)):
        frame = spark.createDataFrame([bad], "house int, subtype int")
        with pytest.raises(PySparkException, match="unsupported"):
            frame.select(membership.membership_kind(F.col("house"), F.col("subtype"))).collect()
    with pytest.raises(PySparkException):
        column(spark, ["Nobody"]).select(membership.chamber(F.col("v"))).collect()
    with pytest.raises(ValueError):
        membership.in_chamber(rows, "Senate")
    assert membership.membership_kinds(spark).count() == 7


def test_funder_kinds_and_categories(spark):
    assert seen(column(spark, [None, "Trust"]), membership.funder_kind(F.col("v"))) == ["Not Specified", "Trust"]
    assert seen(column(spark, ["Individual", None]), membership.is_individual(F.col("v"))) == [True, False]
    with pytest.raises(PySparkException):
        column(spark, ["trust"]).select(membership.funder_kind(F.col("v"))).collect()
    ids = column(spark, [3, 4, 1005, 9], "int")
    assert seen(ids, membership.category(F.col("v")), membership.placement(F.col("v"))) == [("donation_or_support", "other"), ("other", "shareholdings"), ("other", "shareholdings"), ("other", "other")]
    assert seen(ids.orderBy(*membership.category_order(F.col("v"))), F.col("v")) == [3, 4, 9, 1005]
    assert seen(membership.among(ids, ids.filter("v = 9"), "v"), F.col("v")) == [9]


# ------------------------------------------------------------------ pages


def test_amounts_and_dates(spark):
    rows = column(spark, ["1234567.5", "-1000", "12", None, "-0.25"])
    assert seen(rows, labels.shown_amount(F.col("v")), labels.shown_pounds(F.col("v"))) == [
        ("1,234,567.5", "£1,234,567.50"), ("−1,000", "−£1,000.00"), ("12", "£12.00"), ("Amount unavailable", "Amount unavailable"), ("−0.25", "−£0.25"),
    ]
    stamps = column(spark, ["2024-07-09T10:00:00", "2024-07-09T10:00:00.123Z", "2024-07-09", "2024-02-30T00:00:00", "x", None])
    assert seen(stamps, labels.is_source_timestamp(F.col("v"))) == [True, True, False, False, False, False]
    assert seen(stamps.limit(2), labels.source_timestamp_label(F.col("v"))) == ["9 Jul 2024, 10:00:00", "9 Jul 2024, 10:00:00.123Z"]


def test_bars(spark):
    rows = spark.createDataFrame([("a", "2"), ("a", "-1"), ("a", None), ("b", "0")], "g string, x string").withColumn("x", F.col("x").cast("decimal(38,18)"))
    total = {(r["g"], r["x"] and float(r["x"])): (r["width"], r["negative"]) for r in labels.bar_widths(rows, "x", ["g"], "total").collect()}
    assert total == {("a", 2.0): (66.66666666, False), ("a", -1.0): (33.33333333, True), ("a", None): (0.0, False), ("b", 0): (0.0, False)}
    assert sorted(r["width"] for r in labels.bar_widths(rows, "x", ["g"], "maximum").collect()) == [0.0, 0.0, 50.0, 100.0]


def test_orders(spark):
    rows = column(spark, ["Zed", "eel", "alpha", "Élan"])
    assert seen(rows.orderBy(*labels.update_order(F.lit("2024"), F.col("v"), F.col("i"))), F.col("v")) == ["alpha", "eel", "Élan", "Zed"]
    assert seen(labels.batch_of(rows, [F.col("i").desc()], 1, 2), F.col("i")) == [3, 2]
    assert [labels.page_of(21, p) for p in (-1, 1, 3, 9)] == [1, 1, 3, 3] and labels.page_of(0, 5) == 1
    with pytest.raises(ValueError):
        labels.period_total("never", F.lit(1), F.lit(2), F.lit(3))


def test_highlights(spark):
    assert labels.highlights("John McJohn", "john") == [("John", True), (" Mc", False), ("John", True)]
    assert labels.highlights("Ann (A+)", "a+ ann") == [("Ann", True), (" (", False), ("A+", True), (")", False)]
    assert labels.highlights("Ann", "  ") == [("Ann", False)]
    assert seen(column(spark, ["Jo", None]), labels.highlighted(F.col("v"), "j")) == [[("J", True), ("o", False)], None]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Acme Holdings Ltd", ("labels", "Acme Holdings Ltd")),
        ("Acme plc (mining), and Beta & Co LLP; Gamma (UK) Limited.", ("labels", "Acme plc; Beta & Co LLP; Gamma (UK) Limited")),
        ("50 per cent holding in Acme Ltd", ("labels", "Acme Ltd")),
        ("shares in a small firm", ("source-preview", "shares in a small firm")),
        ("Acme (open Ltd", ("source-preview", "Acme (open Ltd")),
        ("   ", ("missing", "Interest text unavailable")),
        (None, ("missing", "Interest text unavailable")),
        ("word " * 40, ("source-preview", " ".join(["word"] * 22) + "…")),
    ],
)
def test_shareholdings(text, want):
    assert labels.shareholding(text) == want


def test_shareholdings_in_a_table(spark):
    got = column(spark, ["Acme Ltd", None]).select("i", labels.shareholding_summary(F.col("v")).alias("s")).orderBy("i").collect()
    assert [(r["s"]["kind"], r["s"]["text"]) for r in got] == [("labels", "Acme Ltd"), ("missing", "Interest text unavailable")]


# ----------------------------------------------------------------- groups


def funders(spark, rows):
    return spark.createDataFrame(rows, "funder_id long, funder_name string")


def aliases(spark, rows=()):
    return spark.createDataFrame(list(rows), "funder_id long, alias string")


def test_groups_by_names_and_families(spark):
    made = funders(spark, [(1, "Alpha"), (2, "beta"), (3, " ALPHA "), (4, "Other"), (5, "BBC Studios"), (6, "bbc wales cymru"), (7, "Gamma")])
    groups = grouping.funder_groups(made, aliases(spark, [(2, "alpha"), (7, "bbc"), (9, "alpha")]))
    assert {tuple(r) for r in groups.memberships.select("funder_id", "group_id").collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (7, 7)}
    assert [tuple(r) for r in groups.names.collect()] == [(5, "BBC", "bbc")]
    assert grouping.alias_links(groups.spellings, groups.memberships).count() == 3
    assert [tuple(r)[:3] for r in grouping.family_links(groups.families, groups.memberships).collect()] == [(5, 6, "bbc")]


def test_groups_refuse_repeats_and_rival_families(spark):
    with pytest.raises(grouping.GroupingError, match="duplicate"):
        grouping.funder_groups(funders(spark, [(1, "a"), (1, "b")]), aliases(spark))
    with pytest.raises(grouping.GroupingError, match="bbc, gb_news"):
        grouping.funder_groups(funders(spark, [(1, "BBC"), (2, "GB News")]), aliases(spark, [(1, "x"), (2, "X")]))


# ----------------------------------------------------------------- search


def entities(spark, members=(), lords=(), people=(), also=()):
    def named(rows):
        return spark.createDataFrame([(i, n) for i, n in enumerate(rows, 1)], "id long, name string")

    made = spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(people, 1)], "id long, name string, kind string")
    return {
        "members": named(members), "lords": named(lords), "funders": made, "aliases": aliases(spark, also),
        "groups": spark.createDataFrame([], "funder_id long, group_id long"), "group_names": spark.createDataFrame([], "group_id long, preferred_name string"),
    }


def found(tables, term, limit=10):
    return [(r["label"], r["matched_alias"]) for r in search.search_entities(**tables, term=term, max_entries=limit).orderBy("position").collect()]


def test_sounds_follow_texts(spark):
    tables = entities(spark, ["John McDonnell", "John Humphries"], people=[("Jahn Foundation", "Company")])
    assert [n for n, _ in found(tables, "jahn")] == ["Jahn Foundation", "John McDonnell", "John Humphries"]


def test_people_suppress_sounds_even_beyond_the_limit(spark):
    tables = entities(spark, ["John McDonnell"], people=[("Jahn", "Company"), ("Jahn Person", "Individual")])
    assert [n for n, _ in found(tables, "jahn", 1)] == ["Jahn"]
    assert [n for n, _ in found(tables, "jahn")] == ["Jahn", "Jahn Person"]


def test_sounds_share_the_cap_and_name_the_alias(spark):
    people = [("Unrelated Identity", "Individual"), ("Jahn Foundation", "Company"), ("John Brown", "Individual"), ("John Company", "Company")]
    tables = entities(spark, people=people, also=[(1, "John"), (1, "JOHN"), (1, "John Smith")])
    assert found(tables, "jahn", 2) == [("Jahn Foundation", None), ("Unrelated Identity", "JOHN")]


def test_text_matches_name_groups_and_aliases(spark):
    tables = entities(spark, people=[("Alpha", "Company"), ("Beta", "Company"), ("Gamma", "Company")], also=[(2, "Zeta House")])
    tables["groups"] = spark.createDataFrame([(1, 1), (3, 1)], "funder_id long, group_id long")
    assert found(tables, "gamma") == [("Alpha", "Gamma")]
    assert found(tables, "zeta house") == [("Beta", "Zeta House")]
    tables["group_names"] = spark.createDataFrame([(1, "Greek Letters")], "group_id long, preferred_name string")
    assert found(tables, "greek letters") == [("Greek Letters", None)] and found(tables, "alpha") == [("Greek Letters", "Alpha")]


def test_bound_never_drops_a_match(spark):
    names = ["John Smith", "Jon Smyth-Jones", "smith, john", "Élan Vital", "x", "", "A1 b2", "o'neil", "Smith"]
    rows = column(spark, names)
    for term in ("john smith", "o'neil", "élan", "a1"):
        for least in (0.0, 0.3, 0.5, 0.8, 1.0):
            want = {n for n in names if search.word_similarity_of(term, n) >= least}
            assert {r["v"] for r in search.similar(rows, term, least, "v").collect()} == want, (term, least)


def test_full_lists(spark):
    rows = spark.createDataFrame([(0,)] * 9 + [(1,)] * 3, "kind int")
    assert not search.at_limit(rows).first()[0] and search.at_limit(rows.union(rows)).first()[0] and not search.at_limit(rows.limit(0)).first()[0]


# ---------------------------------------------------------------- captures


def page(folder, name, content):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(content if isinstance(content, str) else json.dumps(content))


def member(number, house=1, subtype=0):
    latest = {"house": house, "membershipFromId": subtype, "membershipFrom": "Place", "membershipStartDate": "2024-07-04T00:00:00", "membershipEndDate": None, "membershipStatus": {"statusDescription": "Current"}}
    return {"value": {"id": number, "nameDisplayAs": f"M{number}", "latestParty": {"id": 15, "name": "Party"}, "latestHouseMembership": latest}}


def test_member_pages(spark, tmp_path):
    folder = tmp_path / "members"
    page(folder, "page-1.json", {"items": [member(1), member(2)], "totalResults": 3})
    with pytest.raises(captures.CaptureError):
        captures.member_pages(captures.read_pages(spark, str(folder)))
    page(folder, "page-2.json", {"items": [member(3, 2, 4)], "totalResults": 3})
    rows = captures.member_pages(captures.read_pages(spark, str(folder)))
    assert {(r["parliament_member_id"], r["membership_kind"]) for r in rows.collect()} == {(1, "Elected MP"), (2, "Elected MP"), (3, "Life peer")}
    with pytest.raises(captures.CaptureError):
        captures.read_pages(spark, str(tmp_path), "none-*.json")
    target = f"file://{tmp_path}/members.parquet"
    loading.write_table(rows, target, T._parse_datatype_string(captures.MEMBERS))
    assert captures.read_members(spark, target).count() == 3
    with pytest.raises(PySparkException):
        loading.write_table(rows, target)
    old = f"file://{tmp_path}/old.parquet"
    rows.select("parliament_member_id", "name", "party_id", "party_name", "constituency").write.parquet(old)
    assert {r["membership_kind"] for r in captures.read_members(spark, old).collect()} == {"Elected MP"}


def test_interest_pages(spark, tmp_path):
    folder = tmp_path / "7"
    page(folder, "page-1.json", '{"items": [{"id": 5, "amount": 1.10, "name": "é"}], "totalResults": 2}')
    number = F.regexp_extract("path", r"/([0-9]+)/[^/]*$", 1).cast("long")
    with pytest.raises(captures.CaptureError):
        captures.interest_pages(captures.read_pages(spark, str(tmp_path)), number)
    page(folder, "page-2.json", '{"items": [], "totalResults": 1}')
    page(folder, "page-1.json", '{"items": [{"id": 5, "amount": 1.10, "name": "é"}], "totalResults": 1}')
    rows = captures.interest_pages(captures.read_pages(spark, str(tmp_path)), number)
    assert [tuple(r) for r in rows.select("member_id", "declaration_id", "source_json").collect()] == [(7, 5, '{"id":5,"amount":1.10,"name":"é"}')]
    cohort = spark.createDataFrame([(7,)], "member_id long")
    captures.check_cohort(cohort, rows)
    for bad in (cohort.limit(0), spark.createDataFrame([(7,), (8,)], "member_id long")):
        with pytest.raises(captures.CaptureError):
            captures.check_cohort(bad, rows)


def register(number):
    node = {"id": 1, "interest": "text", "deletedWhen": None, "isCorrection": False, "childInterests": None}
    return {"value": {"member": {"id": number, "nameDisplayAs": f"Lord {number}", "latestHouseMembership": {"house": 2}}, "interestCategories": [{"id": 4, "name": "A", "sortOrder": 1, "interests": [node]}]}}


def test_lords_captures(spark, tmp_path):
    pages = [json.dumps({"items": [register(n) for n in ids], "skip": skip, "take": 2, "totalResults": 3}).encode() for skip, ids in ((0, [1, 2]), (2, [3]))]
    manifest = {
        "format_version": 1, "ingestion_key": "k", "captured_at": "now", "source": captures.LORDS_SOURCE, "include_deleted": True, "members": 3,
        "pages": [{"page": i, "bytes": len(p), "sha256": hashlib.sha256(p).hexdigest()} for i, p in enumerate(pages, 1)],
    }
    folder = f"file://{tmp_path}/lords"
    loading.publish_pages(spark, pages, folder, manifest)
    assert captures.read_lords(spark, folder, "k").count() == 3
    assert captures.lords_manifest(captures.read_pages(spark, folder, "page-*.json"), "k", "now", 3) == manifest
    with pytest.raises(loading.LoadError):
        loading.publish_pages(spark, pages, folder, manifest)
    with pytest.raises(captures.CaptureError):
        captures.read_lords(spark, folder, "other")
    for name, change in (("digest", {"pages": [manifest["pages"][0], manifest["pages"][1] | {"sha256": "0"}]}), ("count", {"members": 4}), ("gap", {"pages": manifest["pages"][1:]})):
        loading.publish_pages(spark, pages, f"{folder}-{name}", manifest | change)
        with pytest.raises(captures.CaptureError):
            captures.read_lords(spark, f"{folder}-{name}", "k")
    twice = [json.dumps({"items": [register(1), register(1)], "skip": 0, "take": 2, "totalResults": 2}).encode()]
    loading.publish_pages(spark, twice, f"{folder}-twice", {})
    with pytest.raises(captures.CaptureError, match="duplicate"):
        captures.lords_pages(captures.read_pages(spark, f"{folder}-twice", "page-*.json"))


def raw_frame(spark):
    names = [c.split()[0] for c in captures.RAW.split(", ")]
    row = {"parliament_member_id": 4, "declaration_id": 1, "category_id": 3, "category_name": "Gifts", "register_id": 1, "source_json": "{}"}
    return spark.createDataFrame([tuple(row.get(n) for n in names), tuple((row | {"parliament_member_id": 5}).get(n) for n in names)], captures.RAW)


def test_raw_partitions(spark, tmp_path):
    rows = raw_frame(spark)
    folder = f"file://{tmp_path}/declarations"
    loading.write_raw(rows, folder)
    assert sorted(p.name for p in (tmp_path / "declarations").iterdir() if p.suffix == ".parquet") == ["4.parquet", "5.parquet"]
    assert captures.read_raw(spark, folder).count() == 2
    with pytest.raises(loading.LoadError):
        loading.write_raw(rows, folder)
    (tmp_path / "declarations" / "5.parquet").rename(tmp_path / "declarations" / "6.parquet")
    with pytest.raises(captures.CaptureError):
        captures.read_raw(spark, folder)
    rows.withColumn("member_id", F.lit(1)).write.parquet(f"file://{tmp_path}/old/4.parquet")
    with pytest.raises(captures.CaptureError, match="unsupported"):
        captures.read_raw(spark, f"file://{tmp_path}/old")


def test_typed_reads(spark, tmp_path):
    path = f"file://{tmp_path}/t.parquet"
    spark.createDataFrame([(1, "x", True)], "a long, b string, more boolean").coalesce(1).write.parquet(path)
    rows, digests = captures.read_typed(spark, path, T._parse_datatype_string("a long, b string"))
    files = {hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / "t.parquet").glob("*.parquet")}
    assert rows.columns == ["a", "b"] and {r["sha256"] for r in digests.collect()} == files
    with pytest.raises(captures.CaptureError):
        captures.read_typed(spark, path, T._parse_datatype_string("a int"))


def test_settings(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("# a comment\ndata_dir: ./data\n")
    assert captures.ResolverSettings.read(str(path)) == captures.ResolverSettings("./data", 1_000_000)
    for text in ("data_dir: x\ncandidate_budget: 0\n", "candidate_budget: 5\n", "data_dir: x\nother: 1\n", "data_dir: x\ncandidate_budget: many\n"):
        path.write_text(text)
        with pytest.raises(ValueError, match="c.yaml"):
            captures.ResolverSettings.read(str(path))
    with pytest.raises(ValueError, match="none.yaml"):
        captures.ResolverSettings.read(str(tmp_path / "none.yaml"))


def test_single_interests():
    fields = [{"name": "DonorStatus", "value": "Individual"}, {"name": "Value", "value": "5", "typeInfo": {"currencyCode": "GBP"}}]
    text = json.dumps({"id": 1, "category": {"name": "Gifts"}, "versions": [{"register": {"publishedDate": "2024-01-01"}, "fields": []}, {"register": {"publishedDate": "2025-01-01"}, "fields": fields}]})
    view = captures.interest_view(text, "Individual")
    assert (view["amount"], view["currency"], view["register_published_date"]) == ("5", "GBP", "2025-01-01")
    with pytest.raises(captures.SourceError):
        captures.interest_view(text, "Company")


# -------------------------------------------------------------------- loads


def test_writers_exclude_each_other(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    with loading.writer_lock(spark, folder):
        with pytest.raises(loading.LoadError):
            loading.publish(spark, {}, folder)
    loading.publish(spark, {"t": spark.range(3)}, folder, {"a": 1})
    assert json.loads((tmp_path / "run" / "manifest.json").read_text()) == {"a": 1}
    assert not [p.name for p in tmp_path.iterdir() if p.name.startswith(".run") and not p.name.endswith(".crc")]


def test_raw_copies(spark, tmp_path):
    root, old, new = f"file://{tmp_path}", "018f0000-0000-7000-8000-000000000001", "018f0000-0000-7000-8000-000000000002"
    assert loading.copy_latest_raw(spark, root, new) is None
    (tmp_path / old / "raw" / "deep").mkdir(parents=True)
    (tmp_path / old / "raw" / "deep" / "a.json").write_text("x")
    assert loading.copy_latest_raw(spark, root, new) == old
    assert (tmp_path / new / "raw" / "deep" / "a.json").read_text() == "x"
    (tmp_path / new / "raw" / "link").symlink_to(tmp_path / old)
    with pytest.raises(loading.LoadError):
        loading.copy_latest_raw(spark, root, "018f0000-0000-7000-8000-000000000003")


def test_entries_of_unknown_identities_stop_the_job(spark):
    entries = spark.createDataFrame([(1, "a"), (2, None)], "entry_id long, identity string")
    known = spark.createDataFrame([(9, "a")], "funder_id long, identity string")
    assert {tuple(r) for r in loading.insert_entries(entries, known).select("entry_id", "funder_id").collect()} == {(1, 9), (2, None)}
    with pytest.raises(PySparkException, match="was not inserted"):
        loading.insert_entries(entries, known.limit(0)).collect()


def test_loads_run_once(spark):
    runs = spark.createDataFrame([("k", "m")], "ingestion_key string, fingerprint string")
    calls = []
    args = (lambda: calls.append("write"), lambda: calls.append("refresh"))
    assert loading.load(spark, runs, "k", "m", *args) == "already_loaded" and loading.load(spark, runs, "n", "m", *args) == "loaded"
    assert calls == ["refresh", "write", "refresh"]
    with pytest.raises(loading.LoadError):
        loading.load(spark, runs, "k", "other", *args)


def test_trees_are_replaced_by_member(spark):
    stored = spark.createDataFrame([(1, "old"), (2, "old")], "member_id long, text string")
    got = loading.replace_trees(stored, spark.createDataFrame([(1, "a"), (1, "b")], stored.schema))
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (1, "b"), (2, "old")]


# ------------------------------------------------------------------- checks

PAYMENTS = "payment_id string, member_id long, declaration_id long, register_id long, parent_id long, ordinal int, donor string, payer string, ultimate_payer string"
SEEN = (
    "obs_id string, payment_id string, member_id long, declaration_id long, register_id long, ordinal int, role string, source_scope string, pointer string, donor_kind string, "
    "company_number string, name_normalized string, person_name string, address_normalized string, address_quality string"
)
PAYMENT = ("1/2/3/funding/0", 1, 2, 3, None, 0, "1/2/3/funding/0/donor", None, None)
DONOR = ("1/2/3/funding/0/donor", "1/2/3/funding/0", 1, 2, 3, 0, "donor", "funding_entry", "/versions/0/fields/1/values/0", "Individual", None, "jo", None, None, "unavailable")
PAYER = ("1/2/3/declaration/payer", None, 1, 2, 3, None, "payer", "declaration", "/versions/0/fields", None, None, "al", None, "1 high street", "numbered_street")


def changed(row, schema, **values):
    names = [c.split()[0] for c in schema.split(", ")]
    return tuple(values.get(n, v) for n, v in zip(names, row, strict=True))


@pytest.mark.parametrize(
    ("payment", "donor", "payer", "why"),
    [
        ({}, {}, {}, None),
        ({"register_id": 0}, {}, {}, "zero register"),
        ({"payment_id": "x"}, {}, {}, "funding occurrence id disagrees with its source identity"),
        ({}, {"pointer": "/versions/0/fields/1"}, {}, "malformed source pointer"),
        ({}, {"ordinal": 4}, {}, "observation scope disagrees with funding occurrence"),
        ({}, {}, {"donor_kind": "Company"}, "payer role carries donor metadata"),
        ({}, {}, {"address_quality": "partial"}, "address quality disagrees with its address"),
        ({}, {"name_normalized": " "}, {}, "empty normalised evidence"),
        ({}, {"obs_id": "x"}, {}, "observation id disagrees with scope and role"),
        ({"donor": None}, {}, {}, "unreferenced funding role observation"),
        ({"payer": "1/2/3/funding/0/donor"}, {}, {}, "payment role points to an unrelated observation"),
        ({}, {}, {"register_id": 4}, "observation declaration register mismatch"),
        ({}, {}, {"pointer": "/versions/0/fields/1/values/0"}, "invalid observation scope"),
    ],
)
def test_resolution_input(spark, payment, donor, payer, why):
    payments = spark.createDataFrame([changed(PAYMENT, PAYMENTS, **payment)], PAYMENTS)
    observed = spark.createDataFrame([changed(DONOR, SEEN, **donor), changed(PAYER, SEEN, **payer)], SEEN)
    found = {r["why"] for r in checks.resolution_input(payments, observed).collect()}
    assert (why in found) if why else not found
    if why:
        with pytest.raises(checks.CheckFailed):
            checks.require(checks.resolution_input(payments, observed))


def test_scores_and_decisions(spark):
    profiles = spark.createDataFrame([(1,), (2,)], "profile_id long")
    schema = "left long, right long, probability double, name_level int, address_level int"
    good = (1, 2, 0.5, 2, -1)
    for rows, why in (
        ([good], None), ([(2, 1, 0.5, 2, -1)], "unordered pair"), ([good, good], "duplicate pair"), ([(1, 3, 0.5, 2, -1)], "unknown profile"), ([(1, 2, float("nan"), 2, -1)], "invalid probability"),
        ([(1, 2, 1.5, 2, -1)], "invalid probability"), ([(1, 2, 0.5, 3, -1)], "invalid comparison level"),
    ):
        pairs = spark.createDataFrame(rows, schema)
        assert {r["why"] for r in checks.scores(pairs, profiles).collect()} == ({why} if why else set())
    assert checks.pair_decisions(spark.createDataFrame([good], schema), profiles.withColumnRenamed("profile_id", "obs_id")).count() == 0
    assert checks.pair_decisions(spark.createDataFrame([(1, 1, 0.5, 2, -1)], schema), profiles.withColumnRenamed("profile_id", "obs_id")).count() == 1


def test_staged_tables(spark):
    facts = "payment_id string, member_id long, declaration_id long, parent_id long, category_id int"
    raw = spark.createDataFrame([("p", 1, 2, 9, 3)], facts)
    observed = spark.createDataFrame([("o", 1, 2, "donor", "p"), ("q", 1, 9, "payer", None)], "obs_id string, member_id long, declaration_id long, role string, payment_id string")
    named = spark.createDataFrame([("o", "i"), ("q", "j")], "obs_id string, identity_id string")
    schema = "payment_id string, selected string, basis string, parent long"

    def whys(clean=raw, attributions=(("p", "o", "donor", None),), identities=named):
        rows = spark.createDataFrame(list(attributions), schema)
        return {r["why"] for r in checks.staged_tables(raw, clean, observed, identities, rows, ["member_id", "parent_id", "category_id"]).collect()}

    assert not whys() and not whys(attributions=[("p", "q", "parent_payer", 9)])
    assert whys(raw.withColumn("category_id", F.lit(4))) == {"cleaned row disagrees with raw metadata"}
    assert whys(attributions=[("p", "o", "payer", None)]) == {"selected observation is not of this payment or its parent"}
    assert whys(attributions=[("p", "q", "parent_payer", 8)]) == {"selected observation is not of this payment or its parent"}
    assert whys(attributions=[("x", None, None, None)]) == {"payment without attribution", "attribution without payment"}
    assert "selected observation has no identity" in whys(identities=named.withColumn("identity_id", F.lit(None).cast("string")))
    assert "observation without identity" in whys(identities=named.filter("obs_id = 'o'"))


def test_scratch_is_never_local_to_a_machine():
    from types import SimpleNamespace

    from ledgerline import session

    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    with pytest.raises(ValueError, match="share"):
        session.scratch_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert session.scratch_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[4]"))).startswith("file://")
