"""Queries of the register's operators over the standard tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.functions.money import breakdown_by, normal_currency, plain_amount, totals_by
from ledgerline.functions.periods import RegistrationWindow, day_range, month_window, period_window
from ledgerline.functions import names
from ledgerline.operators import linkage, loading, registers, search, trees
from ledgerline.plans.model import CTES, model
from ledgerline.session import cut

NOW = datetime(1999, 6, 15)
TERM = datetime(1998, 1, 1)
_TERM = "registered >= TIMESTAMP '1998-01-01'"


def canonical(spark: SparkSession, d: str) -> DataFrame:
    return registers.canonical_funders(model(spark, d, "funders"), model(spark, d, "groups"), model(spark, d, "names"))


def whole(spark: SparkSession, d: str, window: RegistrationWindow = RegistrationWindow()) -> DataFrame:
    """The joined model."""
    entries = model(spark, d, "entries").withColumn("currency", normal_currency(F.col("currency_raw"))).drop("currency_raw")
    return registers.joined(model(spark, d, "declarations"), model(spark, d, "members"), entries, canonical(spark, d), window)


def term(spark: SparkSession, d: str) -> DataFrame:
    return whole(spark, d, period_window("current-term", NOW, TERM))


def _money(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("decimal(38,2)") for n in names or ("total",)})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query and its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _totals_sql(keys: str, where: str, extra: str = "") -> str:
    return f"""SELECT {keys}, sum(CASE WHEN currency = 'GBP' THEN amount END)::DECIMAL(38, 2) AS total,
  count(DISTINCT declaration_id)::BIGINT AS declarations, count(entry_id)::BIGINT AS entries,
  coalesce(bool_or(entry_id IS NOT NULL AND (currency IS NULL OR (currency = 'GBP' AND amount IS NULL))), false) AS incomplete{extra}
FROM whole WHERE {where} GROUP BY {keys}"""


def _board_sql(keys: str, key: str, where: str) -> str:
    return f"""{CTES}, t AS ({_totals_sql(keys, where)})
SELECT *, row_number() OVER (ORDER BY total DESC NULLS LAST, {key} NULLS FIRST) AS position FROM t"""


@query(_board_sql("member_id, member_name", "member_id", _TERM))
def member_board(spark: SparkSession, d: str) -> DataFrame:
    return _money(registers.member_board(term(spark, d)))


@query(
    f"""{CTES}, t AS ({_totals_sql("party_id", _TERM, ", min(party_name) AS party_name")})
SELECT *, row_number() OVER (ORDER BY total DESC NULLS LAST, party_id NULLS FIRST) AS position FROM t""",
)
def party_board(spark: SparkSession, d: str) -> DataFrame:
    return _money(registers.party_board(term(spark, d)))


@query(_board_sql("canonical_id, canonical_name", "canonical_id", f"{_TERM} AND canonical_kind = 'Individual'"))
def individual_board(spark: SparkSession, d: str) -> DataFrame:
    return _money(registers.funder_board(term(spark, d), True))


@query(_board_sql("canonical_id, canonical_name", "canonical_id", f"{_TERM} AND canonical_kind <> 'Individual'"))
def company_board(spark: SparkSession, d: str) -> DataFrame:
    return _money(registers.funder_board(term(spark, d), False))


@query(
    f"""{CTES} SELECT canonical_id, canonical_name, count(DISTINCT declaration_id)::BIGINT AS declarations, max(registered) AS latest,
  row_number() OVER (ORDER BY max(registered) DESC NULLS LAST, canonical_name, canonical_id) AS position
FROM whole WHERE registered >= TIMESTAMP '1999-06-01' AND registered < TIMESTAMP '1999-07-01' AND canonical_kind <> 'Individual'
GROUP BY canonical_id, canonical_name""",
)
def month_updates(spark: SparkSession, d: str) -> DataFrame:
    return registers.month_updates(whole(spark, d, month_window(1999, 6)))


def _window_sql(name: str, where: str) -> str:
    return f"""sum(CASE WHEN {where} THEN total END)::DECIMAL(38, 2) AS {name}_total, sum(CASE WHEN {where} THEN 1 ELSE 0 END)::BIGINT AS {name}_declarations,
  coalesce(bool_or(unknown) FILTER (WHERE {where}), false) AS {name}_incomplete"""


@query(
    f"""{CTES}, one AS (SELECT member_id, declaration_id, registered, sum(CASE WHEN currency = 'GBP' THEN amount END) AS total,
  bool_or(entry_id IS NOT NULL AND (currency IS NULL OR (currency = 'GBP' AND amount IS NULL))) AS unknown FROM whole GROUP BY ALL)
SELECT member_id, {_window_sql("all", "true")}, {_window_sql("term", _TERM)},
  {_window_sql("year", "registered >= TIMESTAMP '1999-01-01' AND registered < TIMESTAMP '2000-01-01'")},
  min(registered) AS first, max(registered) AS last, sum(CASE WHEN registered IS NULL THEN 1 ELSE 0 END)::BIGINT AS undated FROM one GROUP BY member_id""",
)
def member_headlines(spark: SparkSession, d: str) -> DataFrame:
    windows = {name: period_window(p, NOW, TERM) for name, p in (("all", "historical"), ("term", None), ("year", "current-year"))}
    return _money(registers.headlines(whole(spark, d), windows), "all_total", "term_total", "year_total")


@query(
    f"""{CTES} SELECT currency, category_id, category_name, sum(amount)::DECIMAL(38, 2) AS amount, count(*)::BIGINT AS entries,
  sum(CASE WHEN amount IS NULL THEN 1 ELSE 0 END)::BIGINT AS unknown_amounts, category_id = 3 AS donation
FROM whole WHERE entry_id IS NOT NULL AND currency IS NOT NULL GROUP BY ALL""",
)
def category_breakdown(spark: SparkSession, d: str) -> DataFrame:
    out = breakdown_by(whole(spark, d), ["category_id", "category_name"])
    return _money(out, "amount").withColumn("donation", F.col("category_id") == 3)


@query(
    f"""{CTES} SELECT canonical_id, member_id, member_name, currency, sum(amount)::DECIMAL(38, 2) AS amount, count(*)::BIGINT AS entries,
  sum(CASE WHEN amount IS NULL THEN 1 ELSE 0 END)::BIGINT AS unknown_amounts,
  row_number() OVER (PARTITION BY canonical_id, currency ORDER BY sum(amount) DESC NULLS LAST, member_id, member_name) AS position
FROM whole WHERE canonical_id IS NOT NULL AND currency IS NOT NULL GROUP BY canonical_id, member_id, member_name, currency QUALIFY position <= 10""",
)
def top_recipients(spark: SparkSession, d: str) -> DataFrame:
    return _money(registers.recipients(whole(spark, d)), "amount")


@query(
    f"""{CTES} SELECT canonical_id, party_id, party_name, currency, sum(amount)::DECIMAL(38, 2) AS amount, count(*)::BIGINT AS entries,
  sum(CASE WHEN amount IS NULL THEN 1 ELSE 0 END)::BIGINT AS unknown_amounts,
  row_number() OVER (PARTITION BY canonical_id, currency ORDER BY sum(amount) DESC NULLS LAST, party_name, party_id) AS position
FROM whole WHERE canonical_id IS NOT NULL AND currency IS NOT NULL GROUP BY canonical_id, party_id, party_name, currency""",
)
def funder_parties(spark: SparkSession, d: str) -> DataFrame:
    return _money(registers.party_shares(whole(spark, d)), "amount")


@query(
    f"""{CTES} SELECT funder_id, sum(CASE WHEN currency = 'GBP' THEN amount END)::DECIMAL(38, 2) AS amount, count(*)::BIGINT AS entries,
  sum(CASE WHEN currency = 'GBP' AND amount IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing,
  sum(CASE WHEN currency IS NULL THEN 1 ELSE 0 END)::BIGINT AS unknown_currency,
  sum(CASE WHEN currency <> 'GBP' THEN 1 ELSE 0 END)::BIGINT AS foreign_currency
FROM whole WHERE member_id = 7 AND entry_id IS NOT NULL GROUP BY funder_id""",
)
def member_sources(spark: SparkSession, d: str) -> DataFrame:
    return _money(registers.sources_of(whole(spark, d), 7), "amount")


@query(
    f"""{CTES}, part AS (SELECT date_trunc('month', registered)::TIMESTAMP AS month, CASE WHEN currency = 'GBP' THEN amount END AS amount,
    currency IS NULL OR amount IS NULL AS unknown FROM whole WHERE entry_id IS NOT NULL AND (currency = 'GBP' OR currency IS NULL)),
by_month AS (SELECT month, sum(amount) AS amount, bool_or(unknown) AS incomplete FROM part GROUP BY month),
months AS (SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::TIMESTAMP AS month FROM by_month)
SELECT m.month, coalesce(b.amount, 0)::DECIMAL(38, 2) AS amount, coalesce(b.incomplete, false) AS incomplete FROM months m LEFT JOIN by_month b ON b.month = m.month
UNION ALL SELECT month, coalesce(amount, 0)::DECIMAL(38, 2), incomplete FROM by_month WHERE month IS NULL""",
)
def monthly_timeline(spark: SparkSession, d: str) -> DataFrame:
    return _money(registers.timeline(whole(spark, d)), "amount")


@query(
    f"""{CTES}, t AS (SELECT CASE party_name WHEN 'NATION_1' THEN 'NATION_2' ELSE party_name END AS label, sum(amount) AS amount
  FROM whole WHERE currency = 'GBP' GROUP BY 1), u AS (SELECT label, greatest(amount, 0)::DECIMAL(38, 2) AS amount FROM t)
SELECT *, floor(amount::DOUBLE * 1000000 / (sum(amount) OVER ())::DOUBLE) / 1000000 AS share FROM u""",
)
def party_chart(spark: SparkSession, d: str) -> DataFrame:
    rows = whole(spark, d).filter("currency = 'GBP'").groupBy("party_name").agg(F.sum("amount").alias("amount"))
    return registers.share_bars(_money(rows, "amount"), {"NATION_1": "NATION_2"})


@query(
    f"""{CTES} SELECT declaration_id, entry_id, registered, row_number() OVER (ORDER BY registered DESC NULLS LAST, declaration_id DESC, entry_id NULLS FIRST) AS place
FROM whole WHERE member_id = 7 ORDER BY place LIMIT 10 OFFSET 10""",
)
def history_page(spark: SparkSession, d: str) -> DataFrame:
    rows = whole(spark, d).filter("member_id = 7").select("declaration_id", "entry_id", "registered")
    from pyspark.sql import Window

    page = registers.history(rows, 2)
    order = Window.orderBy(F.col("registered").desc_nulls_last(), F.col("declaration_id").desc(), F.col("entry_id").asc_nulls_first())
    return page.withColumn("place", F.row_number().over(order).cast("long") + 10)


@query(
    f"""{CTES} SELECT count(*)::BIGINT AS declarations FROM declarations
WHERE registered::DATE >= DATE '1998-03-01' AND registered::DATE <= DATE '1998-09-30'"""
)
def dated_declarations(spark: SparkSession, d: str) -> DataFrame:
    rows = model(spark, d, "declarations").filter(day_range(F.col("registered"), "1998-03-01", "1998-09-30"))
    return rows.agg(F.count("*").alias("declarations"))


@query(f"{CTES} SELECT * FROM canon")
def canonical_funders(spark: SparkSession, d: str) -> DataFrame:
    return canonical(spark, d)


@query(
    f"""{CTES} SELECT member_id, member_name FROM members m
WHERE member_id % 5 = 0 OR EXISTS (SELECT 1 FROM declarations d WHERE d.member_id = m.member_id AND {_TERM})"""
)
def eligible_members(spark: SparkSession, d: str) -> DataFrame:
    declared = model(spark, d, "declarations").filter(period_window(None, NOW, TERM).holds(F.col("registered")))
    return registers.eligible(model(spark, d, "members"), declared, F.col("member_id") % 5 == 0).select("member_id", "member_name")


@query(
    f"""{CTES}, c AS (SELECT canonical_id, member_name, count(*) AS n FROM whole WHERE canonical_id IS NOT NULL GROUP BY ALL)
SELECT canonical_id, member_name, n FROM c
QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY n DESC, contains(member_name, '('), member_name) = 1""",
)
def usual_names(spark: SparkSession, d: str) -> DataFrame:
    rows = whole(spark, d).filter(F.col("canonical_id").isNotNull())
    return registers.usual_name(rows, "canonical_id", "member_name")


@query(
    f"""{CTES} SELECT declaration_id, CASE WHEN min(canonical_name) = max(canonical_name) THEN min(canonical_name) END AS canonical_name
FROM whole WHERE canonical_id IS NOT NULL GROUP BY declaration_id"""
)
def sole_funders(spark: SparkSession, d: str) -> DataFrame:
    """The one funder of a declaration, or none."""
    return registers.sole_company(whole(spark, d).filter("canonical_id IS NOT NULL"), "declaration_id", "canonical_name")


@query(
    """SELECT l_orderkey * 10 + l_linenumber AS entry_id, CAST(l_discount AS DECIMAL(12, 2)) AS amount,
  regexp_replace(regexp_replace(CAST(CAST(l_discount AS DECIMAL(12, 2)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS wire FROM lineitem"""
)
def wire_amounts(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entry_id"), F.col("l_discount").cast("decimal(12,2)").alias("amount")
    )
    return rows.withColumn("wire", plain_amount(F.col("amount").cast("decimal(38,18)")))


@query(
    """WITH e AS (SELECT s_suppkey AS id, s_nationkey AS n FROM supplier)
SELECT id AS funder_id, min(id) OVER (PARTITION BY n) AS group_id FROM e QUALIFY count(*) OVER (PARTITION BY n) > 1"""
)
def alias_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(
        F.col("s_suppkey").alias("funder_id"), F.concat(F.lit(" Alias  of "), F.col("s_nationkey").cast("string")).alias("alias")
    )
    return registers.alias_groups(rows)


# ------------------------------------------------------------------ linkage

# Names repeat and some are one letter off; their words are letters of a digest, so that prefixes are many.
_WORD = "translate(md5(CAST(p_partkey % 1190 AS VARCHAR(20))), '0123456789', 'ghijklmnop')"
_OBS = f"""SELECT p_partkey AS obs_id, 'donor' AS role, name AS name_raw, name AS name_normalized,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat(CAST(p_partkey % 1190 % 400 + p_partkey % 2 AS VARCHAR(20)), ' ', lower(p_type), ' street') END AS address_normalized,
  CASE WHEN p_partkey % 4 = 0 THEN 'unavailable' ELSE 'numbered_street' END AS address_quality,
  CASE WHEN p_partkey % 50 = 0 THEN concat('0000', CAST(1000 + p_partkey % 7 AS VARCHAR(20))) END AS company,
  CASE WHEN p_partkey % 50 = 0 THEN 'Company' WHEN p_partkey % 1190 % 3 = 0 THEN 'Individual' WHEN p_partkey % 7 = 1 THEN 'Company' END AS donor_kind
FROM (SELECT *, concat(substr({_WORD}, 1, 5), ' ', substr({_WORD}, 6, 5), CASE WHEN p_partkey % 10 = 3 THEN 'x' ELSE '' END) AS name FROM {{part}}) AS named"""
_PAIRS = f"""WITH obs AS ({_OBS.format(part="part")}),
prof AS (SELECT name_normalized AS name, address_normalized AS address, min(obs_id) AS profile_id, bool_or(company IS NULL) AS needs, count(*) AS members FROM obs GROUP BY ALL),
keyed AS (
  SELECT profile_id, needs, 'n:' || name AS key, true AS ok FROM prof UNION ALL SELECT profile_id, needs, 'a:' || address, true FROM prof WHERE address IS NOT NULL
  UNION ALL SELECT profile_id, needs, 'p:' || name[1:3], true FROM prof
  UNION ALL SELECT profile_id, needs, 'i:' || name[1:1] || '|' || regexp_extract(name, '[a-z]*$')[1:2],
    regexp_extract(name, '[a-z]*$') NOT IN ('limited', 'ltd', 'plc', 'llp', 'company', 'inc', 'and') FROM prof),
pairs AS (SELECT DISTINCT a.profile_id AS l, b.profile_id AS r FROM keyed a JOIN keyed b ON a.key = b.key AND a.profile_id < b.profile_id AND a.ok AND (a.needs OR b.needs)
  UNION ALL SELECT profile_id, profile_id FROM prof WHERE needs AND members > 1),
scored AS (
  SELECT l, r, x.name AS ln, y.name AS rn, 0.0001::DOUBLE / 0.9999::DOUBLE
    * CASE WHEN x.name = y.name THEN 0.95::DOUBLE / 0.001::DOUBLE WHEN levenshtein(x.name, y.name) <= 2 THEN 0.04::DOUBLE / 0.009::DOUBLE ELSE 0.01::DOUBLE / 0.99::DOUBLE END
    * CASE WHEN x.address IS NULL OR y.address IS NULL THEN 1 WHEN x.address = y.address THEN 0.9::DOUBLE / 0.00001::DOUBLE ELSE 0.1::DOUBLE / 0.99999::DOUBLE END AS odds
  FROM pairs JOIN prof x ON x.profile_id = l JOIN prof y ON y.profile_id = r)
"""


def _observations(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_OBS, part=spark.read.parquet(f"{d}/part.parquet"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(linkage.profiles(_observations(spark, d)), "profiles")
    pairs = linkage.candidate_pairs(linkage.blocking_keys(rows), None)
    return linkage.scored_pairs(rows, pairs.union(linkage.twins(rows)))


@query(
    _PAIRS
    + """SELECT l AS "left", r AS "right", round(odds / (odds + 1), 12) AS probability, CASE WHEN ln = rn THEN 2 WHEN levenshtein(ln, rn) <= 2 THEN 1 ELSE 0 END::INTEGER AS name_level
FROM scored"""
)
def scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).withColumn("probability", F.round("probability", 12)).drop("address_level")


def _classes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classified pairs of classes of equal observations, the classes and their members."""
    classes, members = linkage.evidence_classes(_observations(spark, d))
    return cut(linkage.classify_classes(linkage.class_pairs(classes, _scored(spark, d)), classes), "classified"), classes, members


@query(
    _PAIRS
    + """, own AS (SELECT o.*, p.profile_id, CASE WHEN lower(donor_kind) = 'individual' THEN 'person' WHEN lower(donor_kind) = 'company' THEN 'organisation' ELSE 'unknown' END AS ekind
  FROM obs o JOIN prof p ON p.name = o.name_normalized AND p.address IS NOT DISTINCT FROM o.address_normalized),
ob AS (SELECT least(a.obs_id, b.obs_id) AS l, greatest(a.obs_id, b.obs_id) AS r, any_value(odds / (odds + 1)) AS p FROM scored s JOIN own a ON a.profile_id = s.l JOIN own b ON b.profile_id = s.r
  WHERE (a.company IS NULL OR b.company IS NULL) AND a.obs_id <> b.obs_id GROUP BY ALL)
SELECT ob.l AS "left", ob.r AS "right", CASE
  WHEN x.ekind <> 'unknown' AND y.ekind <> 'unknown' AND x.ekind <> y.ekind THEN 'person_organisation_conflict'
  WHEN x.name_normalized = y.name_normalized AND x.address_quality = 'numbered_street' AND y.address_quality = 'numbered_street'
    AND x.address_normalized = y.address_normalized AND p >= 0.999 THEN 'exact_name_full_address_threshold'
  WHEN x.name_normalized = y.name_normalized THEN 'exact_donor_name'
  WHEN x.address_quality = 'numbered_street' AND y.address_quality = 'numbered_street' AND x.address_normalized <> y.address_normalized THEN 'full_address_disagreement'
  ELSE 'review' END AS rule
FROM ob JOIN own x ON x.obs_id = ob.l JOIN own y ON y.obs_id = ob.r"""
)
def classified_pairs(spark: SparkSession, d: str) -> DataFrame:
    classified, _, members = _classes(spark, d)
    return linkage.expand_pairs(classified, members)


@query()
def resolved_identities(spark: SparkSession, d: str) -> DataFrame:
    """Every observation's identity and its basis."""
    _, accepted, cells, identities = linkage.resolve_classes(*_classes(spark, d))
    return linkage.class_outcomes(_observations(spark, d), identities, accepted, cells, "run")


@query(
    """WITH RECURSIVE links AS (SELECT o_custkey % 50 AS m, o_orderkey AS d, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN o_orderkey + 1
  WHEN o_orderkey % 10 = 2 AND o_orderkey % 4 = 2 THEN o_orderkey - 1 ELSE o_orderkey + 1 END AS t, o_custkey FROM orders),
walk(m, d, p, n) AS (SELECT m, d, t, 1 FROM links WHERE t IS NOT NULL UNION ALL
  SELECT w.m, w.d, l.t, n + 1 FROM walk w JOIN links l ON l.m = w.m AND l.d = w.p WHERE l.t IS NOT NULL AND n < 40)
SELECT DISTINCT m AS member_id, d AS declaration_id, true AS cycle FROM walk WHERE n = 40"""
)
def parent_cycles(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    up = F.when(key % 3 == 0, F.lit(None)).when(key % 10 == 1, key + 1).when((key % 10 == 2) & (key % 4 == 2), key - 1).otherwise(key + 1)
    rows = spark.read.parquet(f"{d}/orders.parquet").select(
        (F.col("o_custkey") % 50).alias("member_id"), key.alias("declaration_id"), up.cast("long").alias("parent_id"), key.alias("payment_id")
    )
    return linkage.parent_cycles(rows)


# ------------------------------------------------------------------- search


def _names(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/part.parquet")
    return rows.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 100).alias("group_id"), F.lit(True).alias("is_canonical"))


def _similarity_sql(terms: list[str]) -> str:
    """s(term, name, sim): trigram word similarity of every distinct name, by all runs of its trigrams."""
    values = ", ".join(f"('{t}')" for t in terms)
    trigrams = "flatten(list_transform(string_split({0}, ' '), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"
    return f"""n AS (SELECT DISTINCT p_name AS name FROM part), q AS (SELECT term, list_distinct({trigrams.format("term")}) AS own FROM (VALUES {values}) v(term)),
t AS (SELECT name, {trigrams.format("lower(name)")} AS line FROM n),
r AS (SELECT q.term, t.name, len(own) AS size, list_distinct(line[i:j]) AS run, own FROM q, t, unnest(range(1, len(line) + 1)) a(i), unnest(range(1, len(line) + 1)) b(j) WHERE i <= j),
c AS (SELECT term, name, size, len(run) AS long, len(list_intersect(run, own)) AS common FROM r),
s AS (SELECT term, name, max(common::DOUBLE / (size + long - common))::FLOAT AS sim FROM c GROUP BY ALL)"""


def _matches_sql(least: float) -> str:
    """m(term, group_id, id, name, sim, place): the best ten groups of each term."""
    return f"""b AS (SELECT s.term, p_partkey % 100 AS group_id, p_partkey AS id, p_name AS name, sim FROM part JOIN s ON s.name = p_name WHERE sim >= {least}::FLOAT
  QUALIFY row_number() OVER (PARTITION BY s.term, group_id ORDER BY sim DESC, id) = 1),
m AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY sim DESC, group_id) AS place FROM b QUALIFY place <= 10)"""


@query(f"WITH {_similarity_sql(['red widgit'])}, {_matches_sql(0.5)} SELECT id, name, group_id, true AS is_canonical, sim AS similarity FROM m")
def text_search(spark: SparkSession, d: str) -> DataFrame:
    term = search.check_request(" red widgit ", 10, 0.5)
    return search.text_matches(_names(spark, d), term, 0.5, 10)


_SOUND = """upper(w[1]) || rpad(substr(replace(array_to_string(list_transform(list_filter(range(2, len(w) + 1), lambda i: codes[i] <> codes[i - 1]), lambda i: codes[i]), ''), '0', ''), 1, 3), 3, '0')"""


@query(
    f"""WITH words AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part UNION SELECT unnest(['rad', 'wadget'])),
coded AS (SELECT w, string_split(translate(upper(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202'), '') AS codes FROM words),
sounds AS (SELECT w, {_SOUND} AS sound FROM coded),
asked AS (SELECT place, s.w, s.sound FROM (VALUES (0, 'rad'), (1, 'wadget')) v(place, w) JOIN sounds s ON s.w = v.w),
spelled AS (SELECT p_partkey AS id, p_name AS name, unnest(list_distinct(string_split(lower(p_name), ' '))) AS w FROM part),
best AS (SELECT id, name, place, min({{'d': levenshtein(s.w, a.w), 'w': s.w}}) AS m FROM spelled s JOIN sounds x ON x.w = s.w JOIN asked a ON a.sound = x.sound
  WHERE levenshtein(s.w, a.w) <= 1 GROUP BY ALL),
whole AS (SELECT id, name, sum(m.d)::INTEGER AS distance, string_agg(m.w, ' ' ORDER BY place) AS corrected FROM best GROUP BY ALL HAVING count(*) = 2)
SELECT id, name, id % 100 AS group_id, true AS is_canonical, corrected, distance, CASE WHEN corrected = lower(name) THEN 1 END::FLOAT AS similarity FROM whole
QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY distance, id, name) = 1"""
)
def phonetic_search(spark: SparkSession, d: str) -> DataFrame:
    """Names have two words, so the words found are the whole name, and as similar as can be."""
    return search.phonetic_matches(_names(spark, d), "rad wadget")


@query(
    f"""WITH {_similarity_sql(['red', 'blue', 'small'])}, {_matches_sql(0.3)},
k AS (SELECT id, name AS label, sim AS similarity, CASE term WHEN 'red' THEN 0 WHEN 'blue' THEN 1 ELSE 2 END::INTEGER AS kind FROM m),
u AS (SELECT *, row_number() OVER (PARTITION BY kind, similarity ORDER BY id) AS turn FROM k)
SELECT id, label, similarity, kind, row_number() OVER (ORDER BY similarity DESC, kind = 2, turn, kind, id) AS position FROM u"""
)
def merged_search(spark: SparkSession, d: str) -> DataFrame:
    def top(word: str) -> DataFrame:
        return search.text_matches(_names(spark, d), word, 0.3, 10).select("id", F.col("name").alias("label"), "similarity")

    return search.merge_ranked(top("red"), top("blue"), top("small"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'unavailable' WHEN p_partkey % 2 = 0 THEN 'numbered_street' ELSE 'partial' END AS quality,
  CASE WHEN p_partkey % 5 <> 0 THEN trim(regexp_replace(lower(concat(p_size, CASE WHEN p_partkey % 2 = 0 THEN ' High Street, ' ELSE ' High, ' END, p_brand)), '[^a-z0-9]+', ' ', 'g')) END AS key FROM part"""
)
def address_quality(spark: SparkSession, d: str) -> DataFrame:
    text = F.lower(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, " High Street, ").otherwise(" High, "), F.col("p_brand")))
    rows = spark.read.parquet(f"{d}/part.parquet").withColumn("a", F.when(F.col("p_partkey") % 5 != 0, text))
    return rows.select("p_partkey", names.address_quality(F.col("a")).alias("quality"), names.address_key(F.col("a")).alias("key"))


# ---------------------------------------------------------- trees and loads



@query(
    """WITH RECURSIVE n AS (SELECT conv_id AS m, turn AS p, CASE WHEN turn = 0 THEN NULL ELSE CAST(floor((turn - 1) / 2) AS BIGINT) END AS up, turn % 3 = 1 AS gone, conv_id, turn FROM conversations),
w(m, p, a) AS (SELECT m, p, up FROM n WHERE NOT gone UNION ALL SELECT w.m, w.p, n.up FROM w JOIN n ON n.m = w.m AND n.p = w.a WHERE n.gone)
SELECT DISTINCT w.m AS member_id, w.p AS node_position, w.a AS live_parent FROM w LEFT JOIN n ON n.m = w.m AND n.p = w.a WHERE n.p IS NULL OR NOT n.gone"""
)
def live_tree(spark: SparkSession, d: str) -> DataFrame:
    up = F.when(F.col("turn") != 0, F.floor((F.col("turn") - 1) / 2))
    nodes = spark.read.parquet(f"{d}/conversations.parquet").select(
        F.col("conv_id").alias("member_id"), F.col("turn").alias("node_position"), up.alias("parent_position"), F.when(F.col("turn") % 3 == 1, "then").alias("deleted_when")
    )
    return trees.live_nodes(nodes, ["member_id"]).select("member_id", "node_position", "live_parent").distinct()


@query("SELECT conv_id, count(*)::BIGINT AS n, string_agg(role, ',' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id")
def nested_turns(spark: SparkSession, d: str) -> DataFrame:
    rows = trees.nested(spark.read.parquet(f"{d}/conversations.parquet"), "conv_id", "turn", ["role"])
    return rows.select("conv_id", "n", F.array_join(F.transform("children", lambda c: c["role"]), ",").alias("roles"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN concat('new ', c_name) ELSE c_name END AS c_name, c_nationkey FROM customer
UNION ALL SELECT c_custkey + 1000000, concat('new ', c_name), c_nationkey FROM customer WHERE c_custkey % 7 = 0"""
)
def upserted_members(spark: SparkSession, d: str) -> DataFrame:
    stored = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_nationkey")
    renamed = stored.withColumn("c_name", F.concat(F.lit("new "), "c_name"))
    changed = renamed.filter("c_custkey % 3 = 0").unionByName(renamed.filter("c_custkey % 7 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000))
    return loading.upsert(stored, changed, "c_custkey")


@query("SELECT s_suppkey AS funder_id, s_name FROM supplier WHERE s_suppkey IN (SELECT CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey END FROM lineitem)")
def funders_in_use(spark: SparkSession, d: str) -> DataFrame:
    """Funders without orphans: entries of every 7th funder name none."""
    entries = spark.read.parquet(f"{d}/lineitem.parquet").select(F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("funder_id"))
    return loading.without_orphans(spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("funder_id"), "s_name"), entries)


@query(
    """WITH a AS (SELECT o_orderkey AS payment_id, count(*) AS payments FROM orders GROUP BY 1),
b AS (SELECT l_orderkey AS payment_id, count(*) AS attributions FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
SELECT coalesce(a.payment_id, b.payment_id) AS payment_id, coalesce(payments, 0)::BIGINT AS payments, coalesce(attributions, 0)::BIGINT AS attributions
FROM a FULL JOIN b ON a.payment_id = b.payment_id WHERE coalesce(payments, 0) <> 1 OR coalesce(attributions, 0) <> 1"""
)
def uncovered_payments(spark: SparkSession, d: str) -> DataFrame:
    payments = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("payment_id"))
    found = spark.read.parquet(f"{d}/lineitem.parquet").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("payment_id"))
    return loading.uncovered(payments, found)


@query(
    """WITH s AS (SELECT o_custkey % 200 AS id, o_custkey % 7 AS presentation, o_orderkey AS occ FROM orders),
a AS (SELECT id, min(presentation) AS presentation, list_sort(list(DISTINCT occ)) AS alls FROM s GROUP BY id),
b AS (SELECT id + 5000 AS identity, presentation, CASE WHEN id % 4 = 0 THEN list_append(alls, -1) ELSE alls END AS alls FROM a)
SELECT b.identity, a.id FROM a JOIN b ON list_sort(b.alls) = a.alls AND a.presentation = b.presentation""",
)
def kept_identities(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet").select(
        (F.col("o_custkey") % 200).alias("id"), (F.col("o_custkey") % 7).alias("presentation"), F.col("o_orderkey").alias("occurrence")
    )
    stored = rows.groupBy("id").agg(F.min("presentation").alias("presentation")).withColumn("identity", F.lit(-1).cast("long"))
    incoming = stored.select((F.col("id") + 5000).alias("identity"), "presentation")
    old = rows.select(F.col("id").alias("owner"), "occurrence")
    new = old.select((F.col("owner") + 5000).alias("owner"), "occurrence")
    extra = new.filter((F.col("owner") % 4) == 0).select("owner", F.lit(-1).cast("long").alias("occurrence"))
    return loading.continuity(stored, incoming, old, new.unionByName(extra))
