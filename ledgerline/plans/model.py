"""The register's tables derived from the standard test tables.

Each statement is one text for Spark and for DuckDB: table names in braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = {
    "members": "SELECT c_custkey AS member_id, c_name AS member_name, c_nationkey AS party_id, n_name AS party_name "
    "FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey",
    "declarations": "SELECT o_orderkey AS declaration_id, o_custkey AS member_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS category_id, "
    "substr(o_orderpriority, 3) AS category_name, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate END AS registered FROM {orders}",
    # Entries of every 11th order are the order's before it: declarations without entries, and no row less.
    "entries": "SELECT l_orderkey - CASE WHEN l_orderkey % 11 = 0 AND l_orderkey > 0 THEN 1 ELSE 0 END AS declaration_id, l_orderkey * 10 + l_linenumber AS entry_id, l_suppkey AS funder_id, "
    "CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(12, 2)) END AS amount, "
    "CASE l_returnflag WHEN 'N' THEN ' GBP' WHEN 'A' THEN 'EUR' ELSE '  ' END AS currency_raw FROM {lineitem}",
    "funders": "SELECT s_suppkey AS funder_id, s_name AS funder_name, "
    "CASE s_suppkey % 3 WHEN 0 THEN 'Individual' WHEN 1 THEN 'Company' END AS funder_kind FROM {supplier}",
    "groups": "SELECT s_suppkey AS funder_id, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS group_id FROM {supplier} WHERE s_nationkey % 2 = 0",
    "names": "SELECT DISTINCT min(s_suppkey) AS group_id, concat('Group ', CAST(min(s_suppkey) AS VARCHAR(20))) AS preferred_name "
    "FROM {supplier} WHERE s_nationkey % 4 = 0 GROUP BY s_nationkey",
}
TABLES = {
    "members": ["customer", "nation"], "declarations": ["orders"], "entries": ["lineitem"], "funders": ["supplier"], "groups": ["supplier"], "names": ["supplier"],
}


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    return spark.sql(BASE[name], **tables)


#: The same tables as common table expressions for DuckDB, and their join.
CTES = ",\n".join(f"{name} AS ({text.format(**{t: t for t in TABLES[name]})})" for name, text in BASE.items())
CTES = f"""WITH {CTES},
canon AS (
  SELECT f.funder_id, coalesce(g.group_id, f.funder_id) AS canonical_id, coalesce(n.preferred_name, c.funder_name) AS canonical_name,
         coalesce(c.funder_kind, 'Not Specified') AS canonical_kind
  FROM funders f LEFT JOIN groups g ON g.funder_id = f.funder_id
  LEFT JOIN funders c ON c.funder_id = coalesce(g.group_id, f.funder_id)
  LEFT JOIN names n ON n.group_id = coalesce(g.group_id, f.funder_id)),
whole AS (
  SELECT d.*, m.member_name, m.party_id, m.party_name, e.entry_id, e.funder_id, e.amount, nullif(trim(e.currency_raw), '') AS currency,
         c.canonical_id, c.canonical_name, c.canonical_kind
  FROM declarations d JOIN members m ON m.member_id = d.member_id
  LEFT JOIN entries e ON e.declaration_id = d.declaration_id LEFT JOIN canon c ON c.funder_id = e.funder_id)
"""
