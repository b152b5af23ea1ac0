"""Queries of groups, details, pages and loads over the standard tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.functions import labels, membership
from ledgerline.functions.names import name_features
from ledgerline.operators import checks, grouping, loading, registers, search
from ledgerline.plans.model import CTES, model
from ledgerline.plans.queries import NOW, TERM, _TERM, _classes, query, whole
from ledgerline.functions.periods import period_window
from ledgerline.operators.linkage import attribute, class_decision_counts, resolve_classes
from ledgerline.operators.trees import merged_category_nodes


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ------------------------------------------------------------------- groups

_FUNDERS = """SELECT s_suppkey AS funder_id, CASE s_suppkey % 9 WHEN 1 THEN 'BBC Studios' WHEN 2 THEN ' bbc  Wales CYMRU' WHEN 3 THEN 'GB News' WHEN 4 THEN 'The Premier League' ELSE s_name END AS funder_name,
  CASE s_suppkey % 3 WHEN 0 THEN 'Individual' WHEN 1 THEN 'Company' END AS funder_kind, CASE WHEN s_suppkey % 3 = 1 THEN concat('0000', CAST(1000 + s_nationkey AS VARCHAR(20))) END AS company_number FROM {supplier}"""
_ALIASES = "SELECT s_suppkey AS funder_id, concat('  Shared ', CAST(s_nationkey AS VARCHAR(20))) AS alias FROM {supplier} WHERE s_suppkey % 9 > 5"
_GROUPS = f"""WITH f AS ({_FUNDERS.format(supplier="supplier")}), a AS ({_ALIASES.format(supplier="supplier")}),
k AS (SELECT f.*, CASE f.funder_id % 9 WHEN 1 THEN 'bbc' WHEN 2 THEN 'bbc' WHEN 3 THEN 'gb_news' WHEN 4 THEN 'premier_league' END AS family,
  coalesce(family, a.alias, 'own ' || f.funder_id) AS key FROM f LEFT JOIN a ON a.funder_id = f.funder_id),
g AS (SELECT *, min(funder_id) OVER (PARTITION BY key) AS group_id FROM k),
n AS (SELECT DISTINCT group_id, family, CASE family WHEN 'bbc' THEN 'BBC' WHEN 'gb_news' THEN 'GB News' ELSE 'Premier League' END AS preferred_name FROM g WHERE family IS NOT NULL)"""


def _grouped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, grouping.Groups]:
    supplier = table(spark, d, "supplier")
    funders, aliases = spark.sql(_FUNDERS, supplier=supplier), spark.sql(_ALIASES, supplier=supplier)
    return funders, aliases, grouping.funder_groups(funders, aliases)


@query(f"{_GROUPS} SELECT g.funder_id, g.group_id, n.preferred_name, n.family AS family_key FROM g LEFT JOIN n ON n.group_id = g.group_id")
def funder_groups(spark: SparkSession, d: str) -> DataFrame:
    """Components of equal names and reviewed families."""
    groups = _grouped(spark, d)[2]
    return groups.memberships.join(groups.names, "group_id", "left").select("funder_id", "group_id", "preferred_name", "family_key")


@query(f"{_GROUPS} SELECT x.funder_id AS requested, x.group_id, y.funder_id FROM g x JOIN g y ON y.group_id = x.group_id")
def group_expansion(spark: SparkSession, d: str) -> DataFrame:
    """All funders of the group of each funder that is asked for."""
    funders, _, groups = _grouped(spark, d)
    return grouping.group_members(funders, groups.memberships, funders.select("funder_id"))


@query(
    f"""{_GROUPS}, c AS (SELECT group_id, CASE WHEN min(company_number) = max(company_number) THEN min(company_number) END AS company_number FROM g GROUP BY group_id)
SELECT x.funder_id AS requested, x.group_id, coalesce(n.preferred_name, r.funder_name) AS funder_name, coalesce(r.funder_kind, 'Not Specified') AS funder_kind, c.company_number
FROM g x JOIN g r ON r.funder_id = x.group_id LEFT JOIN n ON n.group_id = x.group_id JOIN c ON c.group_id = x.group_id"""
)
def group_profiles(spark: SparkSession, d: str) -> DataFrame:
    funders, _, groups = _grouped(spark, d)
    return grouping.group_profile(funders, groups.names, grouping.group_members(funders, groups.memberships, funders.select("funder_id")))


@query(
    f"""{_GROUPS}, s AS (SELECT g.group_id, g.funder_name AS alias FROM g UNION SELECT g.group_id, a.alias FROM a JOIN g ON g.funder_id = a.funder_id)
SELECT g.funder_id AS requested, s.alias, row_number() OVER (PARTITION BY g.funder_id ORDER BY s.alias) - 1 AS place FROM g JOIN s ON s.group_id = g.group_id"""
)
def group_spellings(spark: SparkSession, d: str) -> DataFrame:
    funders, aliases, groups = _grouped(spark, d)
    return grouping.group_aliases(funders, aliases, grouping.group_members(funders, groups.memberships, funders.select("funder_id")))


@query(
    f"""{_GROUPS} SELECT x.funder_id AS left_funder_id, y.funder_id AS right_funder_id, x.family AS family_key, x.funder_name AS left_name, y.funder_name AS right_name
FROM g x JOIN g y ON y.family = x.family AND x.funder_id < y.funder_id"""
)
def family_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Links of reviewed families, for all groups."""
    groups = _grouped(spark, d)[2]
    return grouping.family_links(groups.families, groups.memberships)


@query(
    f"""{_GROUPS}, s AS (SELECT funder_id, funder_name AS spelling FROM g UNION SELECT funder_id, alias FROM a), l AS (SELECT *, lower(trim(regexp_replace(spelling, '\\s+', ' ', 'g'))) AS name FROM s)
SELECT x.funder_id AS left_funder_id, y.funder_id AS right_funder_id, x.name AS normalized_alias, x.spelling AS left_alias, y.spelling AS right_alias
FROM l x JOIN l y ON y.name = x.name AND x.funder_id < y.funder_id"""
)
def alias_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Links of equal names, for all groups."""
    groups = _grouped(spark, d)[2]
    return grouping.alias_links(groups.spellings, groups.memberships)


_SUBTYPE = "CASE c_custkey % 10 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 9 WHEN 5 THEN 10 WHEN 6 THEN 6 ELSE 3 END"
_MEMBERS = f"SELECT c_custkey AS member_id, c_name AS member_name, CASE WHEN c_custkey % 10 IN (0, 7, 8, 9) THEN 1 ELSE 2 END AS house, {_SUBTYPE} AS subtype, CASE WHEN c_custkey % 4 = 0 THEN '2024-05-30T00:00:00' END AS ended FROM {{customer}}"
_KIND = """CASE WHEN house = 1 THEN 'Elected MP' ELSE CASE subtype WHEN 2 THEN 'Hereditary peer' WHEN 3 THEN 'Hereditary peer' WHEN 4 THEN 'Life peer' WHEN 5 THEN 'Bishop'
  WHEN 6 THEN 'Judicial peer' WHEN 9 THEN 'Hereditary peer given life peerage' ELSE 'Excepted hereditary peer' END END"""


def _members(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(_MEMBERS, customer=table(spark, d, "customer"))
    return rows.withColumn("membership_kind", membership.membership_kind(F.col("house"), F.col("subtype")))


@query(
    f"""WITH m AS (SELECT *, {_KIND} AS membership_kind FROM ({_MEMBERS.format(customer="customer")}))
SELECT member_id, membership_kind, CASE WHEN house = 1 THEN 'Commons' ELSE 'Lords' END AS chamber, house = 1 AND ended IS NULL AS is_current_commons FROM m"""
)
def memberships(spark: SparkSession, d: str) -> DataFrame:
    rows = _members(spark, d)
    kind = F.col("membership_kind")
    return rows.select("member_id", "membership_kind", membership.chamber(kind).alias("chamber"), membership.current_commons(kind, F.col("ended")).alias("is_current_commons"))


@query(f"WITH m AS ({_MEMBERS.format(customer='customer')}) SELECT member_id, member_name FROM m WHERE house = 2")
def lords_members(spark: SparkSession, d: str) -> DataFrame:
    return membership.in_chamber(_members(spark, d), "Lords").select("member_id", "member_name")


@query(
    f"""{CTES}, k AS (SELECT member_id, {_KIND} AS membership_kind FROM ({_MEMBERS.format(customer="customer")}))
SELECT c.canonical_id, e.entry_id, d.declaration_id, m.member_id, m.member_name, k.membership_kind, d.registered
FROM entries e JOIN declarations d ON d.declaration_id = e.declaration_id JOIN members m ON m.member_id = d.member_id JOIN k ON k.member_id = m.member_id
JOIN canon c ON c.funder_id = e.funder_id"""
)
def funder_history(spark: SparkSession, d: str) -> DataFrame:
    """Every group's entries with declaration, member and kind of membership."""
    canon = registers.canonical_funders(model(spark, d, "funders"), model(spark, d, "groups"), model(spark, d, "names"))
    asked = canon.select(F.col("canonical_id").alias("requested"), "funder_id")
    people = model(spark, d, "members").join(_members(spark, d).select("member_id", "membership_kind"), "member_id")
    rows = grouping.funder_history(model(spark, d, "entries"), model(spark, d, "declarations"), people, membership.membership_kinds(spark), asked)
    return rows.select(F.col("requested").alias("canonical_id"), "entry_id", "declaration_id", "member_id", "member_name", "membership_kind", "registered")


_FACTS = """SELECT DISTINCT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS obs_id, l_suppkey AS identity, CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN concat('Name ', CAST(l_suppkey AS VARCHAR(20)))
  ELSE concat('Name (', CAST(l_partkey % 5 AS VARCHAR(20)), ')') END AS name_raw,
  CASE WHEN l_suppkey % 5 = 0 THEN NULL WHEN l_linenumber = 3 THEN 'Company' WHEN l_linenumber > 3 THEN 'Trust' END AS donor_kind,
  CASE WHEN l_partkey % 7 = 0 THEN concat('0000', CAST(1000 + l_partkey % 1000 AS VARCHAR(20))) END AS company_number FROM {lineitem}"""


@query(
    f"""WITH o AS ({_FACTS.format(lineitem="lineitem")}), u AS (SELECT DISTINCT l_suppkey AS identity FROM lineitem WHERE l_suppkey % 10 <> 1),
c AS (SELECT identity, name_raw, count(*) AS n FROM o WHERE trim(name_raw) <> '' GROUP BY ALL),
b AS (SELECT identity, name_raw FROM c QUALIFY row_number() OVER (PARTITION BY identity ORDER BY n DESC, contains(name_raw, '('), name_raw) = 1),
r AS (SELECT identity, arg_min(company_number, obs_id) FILTER (WHERE donor_kind = 'Company' AND company_number IS NOT NULL) AS company_number,
  arg_min(donor_kind, obs_id) FILTER (WHERE donor_kind IS NOT NULL) AS kind, count(DISTINCT name_raw) FILTER (WHERE trim(name_raw) <> '') AS aliases FROM o GROUP BY identity)
SELECT r.identity, coalesce(b.name_raw, CASE WHEN company_number IS NOT NULL THEN 'Companies House ' || company_number ELSE 'Unnamed resolved funder' END) AS funder_name,
  CASE WHEN company_number IS NOT NULL THEN 'Company' ELSE kind END AS funder_kind, company_number, aliases FROM r JOIN u ON u.identity = r.identity LEFT JOIN b ON b.identity = r.identity"""
)
def funder_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Funders of the identities that payments select (those of every tenth are not selected)."""
    rows = spark.sql(_FACTS, lineitem=table(spark, d, "lineitem"))
    selected = table(spark, d, "lineitem").select(F.when(F.col("l_suppkey") % 10 != 1, F.col("l_suppkey")).alias("identity")).filter("identity is not null")
    out = grouping.rollup(rows.select("obs_id", "identity"), rows.drop("identity"), selected)
    return out.withColumn("aliases", F.size("aliases").cast("long"))


# -------------------------------------------------------------------- pages


@query(
    f"""{CTES} SELECT member_id, member_name, row_number() OVER (ORDER BY member_id) AS position FROM members m
WHERE member_id % 5 = 0 OR EXISTS (SELECT 1 FROM declarations d WHERE d.member_id = m.member_id AND {_TERM})"""
)
def member_cohort(spark: SparkSession, d: str) -> DataFrame:
    """Eligible members in order of their ids."""
    declared = model(spark, d, "declarations").filter(period_window(None, NOW, TERM).holds(F.col("registered")))
    found = registers.eligible(model(spark, d, "members"), declared, F.col("member_id") % 5 == 0).select("member_id", "member_name")
    return registers.positions(found, [F.col("member_id").asc()])


@query(
    """WITH k AS (SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN ' COMPANY ' WHEN 2 THEN 'not specified' WHEN 3 THEN 'trade union' WHEN 4 THEN 'individual' ELSE ' Trust ' END AS kind FROM supplier)
SELECT s_suppkey, CASE s_suppkey % 6 WHEN 1 THEN 'Company' WHEN 3 THEN 'Trade union' WHEN 4 THEN 'Individual' WHEN 5 THEN 'Trust' ELSE 'Unclassified' END AS label,
  CASE s_suppkey % 6 WHEN 1 THEN 'building' WHEN 3 THEN 'group' WHEN 4 THEN 'person' WHEN 5 THEN 'tag' ELSE 'question' END AS icon FROM k"""
)
def kind_labels(spark: SparkSession, d: str) -> DataFrame:
    kinds = [None, " COMPANY ", "not specified", "trade union", "individual", " Trust "]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", labels.kind_label(kind).alias("label"), labels.kind_icon(kind).alias("icon"))


@query(
    f"""{CTES}, c AS (SELECT currency, category_id, sum(amount)::DECIMAL(38, 2) AS amount FROM whole WHERE currency IS NOT NULL GROUP BY ALL),
u AS (SELECT *, CASE WHEN category_id = 2 THEN -amount ELSE amount END AS signed FROM c), w AS (SELECT *, (coalesce(abs(signed), 0) * 100)::HUGEINT AS size FROM u)
SELECT currency, category_id, signed AS amount, (size * 10000000000 // sum(size) OVER (PARTITION BY currency))::DOUBLE / 100000000 AS of_total,
  (size * 10000 // max(size) OVER (PARTITION BY currency))::DOUBLE / 100 AS of_maximum, signed < 0 AS negative FROM w"""
)
def category_bars(spark: SparkSession, d: str) -> DataFrame:
    """Widths of categories' bars, as shares of the total and of the largest; one category is shown as a refund."""
    rows = whole(spark, d).filter("currency is not null").groupBy("currency", "category_id").agg(F.sum("amount").alias("amount"))
    rows = rows.withColumn("amount", F.when(F.col("category_id") == 2, -F.col("amount")).otherwise(F.col("amount")).cast("decimal(38,2)"))
    total = labels.bar_widths(rows, "amount", ["currency"], "total").withColumnRenamed("width", "of_total").drop("negative")
    return labels.bar_widths(total, "amount", ["currency"], "maximum").withColumnRenamed("width", "of_maximum")


@query(
    f"""{CTES}, t AS (SELECT canonical_id, CASE WHEN canonical_id % 2 = 0 THEN upper(canonical_name) ELSE canonical_name END AS name, max(registered) AS latest
  FROM whole WHERE canonical_id IS NOT NULL GROUP BY ALL)
SELECT canonical_id, name, row_number() OVER (ORDER BY latest DESC NULLS LAST, lower(name), name, canonical_id) AS newest,
  row_number() OVER (ORDER BY latest ASC NULLS LAST, lower(name), name, canonical_id) AS oldest FROM t"""
)
def sorted_updates(spark: SparkSession, d: str) -> DataFrame:
    """Updates newest and oldest first, then by name without case."""
    rows = whole(spark, d).filter("canonical_id is not null")
    name = F.when(F.col("canonical_id") % 2 == 0, F.upper("canonical_name")).otherwise(F.col("canonical_name"))
    rows = rows.withColumn("name", name).groupBy("canonical_id", "name").agg(F.max("registered").alias("latest"))
    order = [labels.update_order(F.col("latest"), F.col("name"), F.col("canonical_id"), newest) for newest in (True, False)]
    out = registers.positions(rows, order[0]).withColumnRenamed("position", "newest")
    return registers.positions(out, order[1]).withColumnRenamed("position", "oldest").select("canonical_id", "name", "newest", "oldest")


@query(
    f"""{CTES}, t AS (SELECT member_id, funder_id, min(canonical_name) AS name, sum(CASE WHEN currency = 'GBP' THEN amount END)::DECIMAL(38, 2) AS amount FROM whole WHERE entry_id IS NOT NULL GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY amount DESC NULLS LAST, lower(coalesce(name, 'Source unavailable')), coalesce(funder_id::VARCHAR, '')) AS place FROM t QUALIFY place <= 5"""
)
def first_sources(spark: SparkSession, d: str) -> DataFrame:
    """The five largest money sources of every member, in the page's order."""
    rows = whole(spark, d).filter("entry_id is not null").groupBy("member_id", "funder_id").agg(
        F.min("canonical_name").alias("name"), F.sum(F.when(F.col("currency") == "GBP", F.col("amount"))).cast("decimal(38,2)").alias("amount")
    )
    return labels.placed(rows, labels.source_order(F.col("amount"), F.col("name"), F.col("funder_id")), ["member_id"], labels.SHOWN_RECIPIENTS)


@query(
    """WITH t AS (SELECT o_orderkey, o_orderdate, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%H:%M:%S') AS clock, o_orderkey % 6 AS k FROM orders)
SELECT o_orderkey, k < 4 AS valid, CASE WHEN k < 4 THEN strftime(o_orderdate, '%-d %b %Y') || ', ' || clock || CASE k WHEN 1 THEN 'Z' WHEN 2 THEN '.250+01:00' WHEN 3 THEN '.5' ELSE '' END END AS label FROM t"""
)
def source_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Timestamps as sources spell them: two in six are none (no time, or no such month)."""
    kind, at = F.col("o_orderkey") % 6, F.col("o_orderdate")
    clock = F.date_format(at, "HH:mm:ss")
    text = F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit("T"), clock)
    text = (
        F.when(kind == 0, text).when(kind == 1, F.concat(text, F.lit("Z"))).when(kind == 2, F.concat(text, F.lit(".250+01:00"))).when(kind == 3, F.concat(text, F.lit(".5")))
        .when(kind == 4, F.date_format(at, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(at, "yyyy"), F.lit("-13-01T"), clock))
    )
    rows = table(spark, d, "orders").select("o_orderkey", text.alias("text"))
    valid = labels.is_source_timestamp(F.col("text"))
    return rows.select("o_orderkey", valid.alias("valid"), F.when(valid, labels.source_timestamp_label(F.col("text"))).alias("label"))


@query(
    """WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS entry_id, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) * CASE WHEN l_linenumber = 2 THEN -1000 ELSE 1 END AS VARCHAR) AS v FROM lineitem),
s AS (SELECT *, ltrim(v, '-') AS u, CASE WHEN v[1] = '-' THEN '−' ELSE '' END AS sign FROM t)
SELECT entry_id, CASE WHEN l_linenumber = 7 THEN 'Amount unavailable' ELSE sign || format('{:,}', CAST(split_part(u, '.', 1) AS BIGINT)) || '.' || split_part(u, '.', 2) END AS amount,
  CASE WHEN l_linenumber = 7 THEN 'Amount unavailable' ELSE sign || '£' || format('{:,}', CAST(split_part(u, '.', 1) AS BIGINT)) || '.' || split_part(u, '.', 2) END AS pounds FROM s"""
)
def shown_amounts(spark: SparkSession, d: str) -> DataFrame:
    value = (F.col("l_extendedprice").cast("decimal(12,2)") * F.when(F.col("l_linenumber") == 2, -1000).otherwise(1)).cast("decimal(18,2)").cast("string")
    text = F.when(F.col("l_linenumber") != 7, value)
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entry_id"), labels.shown_amount(text).alias("amount"), labels.shown_pounds(text).alias("pounds")
    )


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 40 IN (4, 12, 31) THEN 'shareholdings' ELSE 'other' END AS placement,
  CASE WHEN o_orderkey % 40 = 3 THEN 'donation_or_support' ELSE 'other' END AS category FROM orders WHERE o_orderkey % 40 > 0 UNION ALL SELECT o_orderkey, 'shareholdings', 'other' FROM orders WHERE o_orderkey % 40 = 0"""
)
def placements(spark: SparkSession, d: str) -> DataFrame:
    """Where a category is shown, and whether it is a donation; every fortieth has the id 1002."""
    number = F.when(F.col("o_orderkey") % 40 == 0, 1002).otherwise((F.col("o_orderkey") % 40).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", membership.placement(number).alias("placement"), membership.category(number).alias("category"))


@query(
    """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 3, conv_id, turn, role, text) AS place FROM conversations"""
)
def card_order(spark: SparkSession, d: str) -> DataFrame:
    """Cards by their category's sort order, then in source order."""
    order = [(F.col("turn") % 3).asc(), F.col("conv_id").asc(), F.col("turn").asc(), F.col("role").asc(), F.col("text").asc()]
    return labels.placed(table(spark, d, "conversations"), order, ["conv_id"]).select("conv_id", "turn", "role", "place")


@query(
    """SELECT p_partkey, lower(p_name || ' Ltd (trading as ' || p_brand || ')') AS name_normalized, lower(p_name) || ' ltd trading as ' || lower(replace(p_brand, '#', ' ')) AS name_tokens,
  array_to_string(list_sort(string_split(lower(p_name) || ' ltd trading as ' || lower(replace(p_brand, '#', ' ')), ' ')), ' ') AS token_key, false AS has_and,
  lower(p_name) || ' ltd' AS primary_name, lower(p_name) AS organisation_core, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: w[1]), '') AS organisation_initials,
  p_brand AS aliases, lower(p_brand) AS alias_normalized, 'trading as ' || p_brand AS brackets, 'present' AS name_status FROM part"""
)
def part_name_features(spark: SparkSession, d: str) -> DataFrame:
    """Name features of company names that trade under a brand."""
    rows = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" Ltd (trading as "), "p_brand", F.lit(")")).alias("name"))
    found = name_features(rows)
    lists = [F.array_join(c, "|").alias(c) for c in ("aliases", "alias_normalized", "brackets")]
    return found.select(
        "p_partkey", "name_normalized", "name_tokens", "token_key", "has_and", "primary_name", "organisation_core", "organisation_initials", *lists, "name_status"
    )


# ------------------------------------------------------------ search results


@query(
    """WITH k AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'Individual' WHEN 1 THEN 'Company' END AS kind FROM supplier)
SELECT coalesce(bool_or(kind = 'Individual'), false) AS has_individual FROM k"""
)
def any_individual(spark: SparkSession, d: str) -> DataFrame:
    return search.has_individual(model(spark, d, "funders").withColumnRenamed("funder_kind", "kind"))


@query("SELECT coalesce(max(n) >= 10, false) AS at_limit FROM (SELECT count(*) AS n FROM supplier GROUP BY s_nationkey)")
def any_at_limit(spark: SparkSession, d: str) -> DataFrame:
    return search.at_limit(table(spark, d, "supplier").withColumnRenamed("s_nationkey", "kind"))


def _search_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    part = table(spark, d, "part")
    funders = part.select(F.col("p_partkey").alias("id"), F.initcap("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "Individual").otherwise("Company").alias("kind"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return {
        "members": names, "lords": names.withColumn("name", F.concat(F.lit("Lord "), "name")), "funders": funders,
        "aliases": part.select(F.col("p_partkey").alias("funder_id"), F.col("p_type").alias("alias")),
        "groups": part.select(F.col("p_partkey").alias("funder_id"), (F.col("p_partkey") % 100).alias("group_id")),
        "group_names": part.filter("p_partkey = p_partkey % 100").select(F.col("p_partkey").alias("group_id"), F.concat(F.lit("Group of "), "p_name").alias("preferred_name")),
    }


@query()
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    """A whole search by text over members, Lords, funders, aliases and groups."""
    return search.search_entities(**_search_tables(spark, d), term="red widgit", strictness=0.5)


@query()
def sound_search(spark: SparkSession, d: str) -> DataFrame:
    """A whole search that finds no text and falls back to sounds."""
    return search.search_entities(**_search_tables(spark, d), term="rad wadget")


# -------------------------------------------------------------------- loads


@query(
    f"""{CTES} SELECT d.declaration_id, d.member_id, d.registered, e.entry_id, e.amount, e.currency_raw FROM declarations d LEFT JOIN entries e ON e.declaration_id = d.declaration_id"""
)
def raw_capture(spark: SparkSession, d: str) -> DataFrame:
    """Raw rows: one per entry, one with empty entry columns for a declaration without any."""
    rows = loading.raw_rows(model(spark, d, "declarations"), model(spark, d, "entries").select("declaration_id", "entry_id", "amount", "currency_raw"))
    return rows.select("declaration_id", "member_id", "registered", "entry_id", "amount", "currency_raw")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS c_name, c_nationkey,
  CASE WHEN c_custkey % 3 = 0 AND upper(c_name) <> c_name THEN TIMESTAMP '2026-01-02' ELSE TIMESTAMP '2026-01-01' END AS updated_at FROM customer"""
)
def touched_members(spark: SparkSession, d: str) -> DataFrame:
    """A load that names a third of the members in capitals and sends another third as it is: only changes are stamped."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    stored = rows.withColumn("updated_at", F.lit("2026-01-01").cast("timestamp_ntz"))
    sent = F.when(F.col("c_custkey") % 3 == 0, F.upper("c_name")).otherwise(F.col("c_name"))
    new = rows.withColumn("c_name", sent).filter("c_custkey % 3 <> 2")
    return loading.touched(stored, new, "c_custkey", F.lit("2026-01-02").cast("timestamp_ntz"))


@query(
    """SELECT s_suppkey AS funder_id, 'old ' || s_nationkey AS alias FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT s_suppkey, 'new ' || s_nationkey FROM supplier WHERE s_suppkey % 4 = 0"""
)
def replaced_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Aliases after a load of every fourth funder."""
    rows = table(spark, d, "supplier")
    nation = F.col("s_nationkey").cast("string")
    stored = rows.select(F.col("s_suppkey").alias("funder_id"), F.concat(F.lit("old "), nation).alias("alias"))
    fresh = F.concat(F.lit("new "), nation)
    loaded = rows.filter("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("funder_id"), F.col("s_name").alias("funder_name"), F.array(fresh, F.col("s_name"), fresh).alias("aliases"))
    return loading.replace_aliases(stored, loaded)


@query("SELECT l_orderkey * 10 + l_linenumber AS entry_id, CASE WHEN l_linenumber <> 4 THEN l_suppkey END AS funder_id FROM lineitem")
def inserted_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries with the funders of their identities; every fourth of an order has none."""
    identity = F.when(F.col("l_linenumber") != 4, F.concat(F.lit("run-local:run:"), F.col("l_suppkey").cast("string")))
    entries = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entry_id"), identity.alias("identity"))
    funders = table(spark, d, "supplier").select(F.col("s_suppkey").alias("funder_id"), F.concat(F.lit("run-local:run:"), F.col("s_suppkey").cast("string")).alias("identity"))
    return loading.insert_entries(entries, funders).select("entry_id", "funder_id")


@query(
    """WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS d, l_suppkey % 120 AS f, l_linenumber AS n FROM lineitem)
SELECT 'invalid declaration' AS why, o_orderkey::VARCHAR AS key FROM orders WHERE o_orderkey % 1000 = 0
UNION ALL SELECT 'duplicate identity', (s_suppkey % 90)::VARCHAR FROM supplier GROUP BY s_suppkey % 90 HAVING count(*) > 1
UNION ALL SELECT 'duplicate funding occurrence', id::VARCHAR FROM e GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'incoherent attribution', id::VARCHAR FROM e WHERE n = 7
UNION ALL SELECT DISTINCT 'entry of an unknown declaration', l_orderkey::VARCHAR FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT DISTINCT 'entry of an unknown identity', f::VARCHAR FROM e WHERE n < 7 AND f NOT IN (SELECT s_suppkey % 90 FROM supplier)"""
)
def load_faults(spark: SparkSession, d: str) -> DataFrame:
    """What a load would find wrong: every thousandth declaration has no category, identities repeat, some entries don't fit."""
    declarations = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("declaration_id"), F.when(F.col("o_orderkey") % 1000 != 0, 3).otherwise(0).alias("category_id"), F.lit("Gifts").alias("category_name"), F.lit(1).alias("register_id")
    )
    funders = table(spark, d, "supplier").select(
        (F.col("s_suppkey") % 90).cast("string").alias("identity"), F.col("s_name").alias("funder_name"), F.lit(None).cast("string").alias("company_number"), F.array("s_name").alias("aliases")
    )
    fits = F.col("l_linenumber") < 7
    entries = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("source_id"), F.col("l_orderkey").alias("declaration_id"),
        F.when(fits, (F.col("l_suppkey") % 120).cast("string")).alias("identity"), F.lit("obs").alias("selected"), F.lit("donor").alias("basis"),
        F.lit(None).cast("string").alias("reason"), F.lit(None).cast("long").alias("parent"),
    )
    return checks.load_rows(declarations, funders, entries)


@query(
    """SELECT to_json({'entry_id': (l_orderkey * 10 + l_linenumber)::VARCHAR, 'amount': CASE WHEN l_linenumber <> 7 THEN
  regexp_replace(regexp_replace(CAST(CAST(l_discount AS DECIMAL(12, 2)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') END, 'registered_at': strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ')})::VARCHAR AS json FROM lineitem"""
)
def wire_rows(spark: SparkSession, d: str) -> DataFrame:
    """Entries as the JSON that the service sends."""
    rows = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entry_id"), F.when(F.col("l_linenumber") != 7, F.col("l_discount").cast("decimal(12,2)")).alias("amount"), F.col("l_shipdate").alias("registered_at")
    )
    return loading.wire(rows, ["entry_id"], ["amount"], ["registered_at"])


@query()
def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pair decisions of a resolution: all, accepted, to review."""
    return class_decision_counts(resolve_classes(*_classes(spark, d))[0])


# --------------------------------------------------- attribution and labels

_PAYMENTS = """SELECT o_orderkey AS payment_id, CAST(floor(o_orderkey / 100) AS BIGINT) AS member_id, o_orderkey AS declaration_id,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 20 = 13 THEN o_orderkey + 1 ELSE o_orderkey - 1 END AS parent_id,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 10 + 1 END AS donor, CASE WHEN o_orderkey % 3 <> 1 THEN o_orderkey * 10 + 2 END AS payer,
  CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey * 10 + 3 END AS ultimate, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN false END AS different FROM {orders}"""
_ATTRIBUTED = f"""WITH p AS ({_PAYMENTS.format(orders="orders")}),
k AS (SELECT p.*, payment_id % 11 <> 0 AS ok, payment_id % 20 IN (13, 14) AS cycle, parent_id % 3 <> 1 AND parent_id % 4 <> 3 AND parent_id // 100 = member_id
  AND parent_id IN (SELECT o_orderkey FROM orders) AS root, parent_id % 11 <> 0 AS root_ok FROM p),
c AS (SELECT *, CASE WHEN ultimate IS NOT NULL THEN CASE WHEN ok THEN 'explicit_ultimate_payer' ELSE '!explicit_ultimate_payer_unavailable' END
  WHEN different THEN '!different_ultimate_payer_unnamed'
  WHEN NOT different THEN CASE WHEN cycle THEN '!parent_cycle' WHEN NOT coalesce(root, false) THEN '!parent_evidence_unavailable' WHEN root_ok THEN 'parent_payer' ELSE '!parent_payer_unavailable' END
  WHEN donor IS NOT NULL THEN CASE WHEN ok THEN 'donor' ELSE '!donor_unavailable' END
  WHEN payer IS NOT NULL THEN CASE WHEN ok THEN 'payer' ELSE '!payer_unavailable' END ELSE '!no_supported_attribution' END AS choice FROM k)
SELECT payment_id, CASE choice WHEN 'explicit_ultimate_payer' THEN ultimate WHEN 'parent_payer' THEN parent_id * 10 + 2 WHEN 'donor' THEN donor WHEN 'payer' THEN payer END AS selected,
  CASE WHEN choice[1] <> '!' THEN choice END AS basis, CASE WHEN choice[1] = '!' THEN choice[2:] END AS reason, CASE WHEN choice = 'parent_payer' THEN parent_id END AS parent,
  ultimate IS NOT NULL AND coalesce(NOT different, false) AS issue FROM c"""


@query(_ATTRIBUTED)
def attributed_payments(spark: SparkSession, d: str) -> DataFrame:
    """Who each payment is attributed to: named ultimate payers, parents' payers, donors, payers."""
    payments = spark.sql(_PAYMENTS, orders=table(spark, d, "orders"))
    sides = F.array(*(F.struct(F.lit(role).alias("role"), F.col(column).alias("obs_id")) for role, column in (("donor", "donor"), ("payer", "payer"), ("ultimate_payer", "ultimate"))))
    seen = payments.select("member_id", "declaration_id", F.explode(sides).alias("o")).select("member_id", "declaration_id", "o.*").filter("obs_id is not null")
    seen = seen.withColumn("name_normalized", F.when(F.col("declaration_id") % 11 != 0, "n")).withColumn("company", F.lit(None).cast("string"))
    return attribute(payments, seen.withColumn("is_root", F.col("declaration_id") % 4 != 3))


@query("SELECT p_partkey, regexp_replace(p_name, '(red|wid)', '[\\1]', 'g') AS marked FROM part")
def highlighted_names(spark: SparkSession, d: str) -> DataFrame:
    """Names with the words of a search marked."""
    pieces = labels.highlighted(F.col("p_name"), "red WID")
    marked = F.array_join(F.transform(pieces, lambda x: F.when(x["matched"], F.concat(F.lit("["), x["text"], F.lit("]"))).otherwise(x["text"])), "")
    return table(spark, d, "part").select("p_partkey", marked.alias("marked"))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 4 THEN 'missing' WHEN 3 THEN 'source-preview' ELSE 'labels' END AS kind, CASE p_partkey % 5 WHEN 0 THEN 'Acme ' || p_partkey || ' Ltd'
  WHEN 1 THEN 'Acme ' || p_partkey || ' plc; Beta & Co LLP' WHEN 2 THEN 'Gamma (UK) Limited' WHEN 3 THEN 'some ' || p_name || ' shares' ELSE 'Interest text unavailable' END AS text FROM part"""
)
def shareholding_labels(spark: SparkSession, d: str) -> DataFrame:
    """Shareholdings as the companies that they list, or as a preview."""
    kind, number = F.col("p_partkey") % 5, F.col("p_partkey").cast("string")
    text = (
        F.when(kind == 0, F.concat(F.lit("12.5 per cent holding in Acme "), number, F.lit(" Ltd")))
        .when(kind == 1, F.concat(F.lit("Acme "), number, F.lit(" plc (mining), and Beta & Co LLP.")))
        .when(kind == 2, F.lit("Gamma (UK) Limited")).when(kind == 3, F.concat(F.lit(" some "), F.col("p_name"), F.lit("  shares")))
    )
    return table(spark, d, "part").select("p_partkey", labels.shareholding_summary(text).alias("s")).select("p_partkey", "s.kind", "s.text")


_CARDS = """SELECT conv_id AS member_id, CAST(turn % 4 AS INT) AS category_position, CAST(turn % 2 AS INT) AS category_id, CASE WHEN turn % 2 = 0 THEN 'A' END AS category_name,
  CAST(10 - turn % 4 AS INT) AS sort_order, CAST(floor(turn / 4) AS INT) AS node_position FROM {conversations}"""


@query(
    f"""WITH n AS ({_CARDS.format(conversations="conversations")}) SELECT member_id, category_id, category_name, min(category_position) OVER w AS category_position, min(sort_order) OVER w AS sort_order,
  node_position, row_number() OVER (PARTITION BY member_id, category_id, category_name ORDER BY category_position, node_position) - 1 AS place FROM n
WINDOW w AS (PARTITION BY member_id, category_id, category_name)"""
)
def merged_cards(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of categories of one source id and name as those of one category."""
    return merged_category_nodes(spark.sql(_CARDS, conversations=table(spark, d, "conversations")))
