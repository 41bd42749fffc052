"""Tables with the faults that profiling is for, derived from the clean test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lineitem with missing values, and a train/test split.
V1_SQL = """SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount,
  CASE WHEN l_partkey % 2 = 0 THEN NULL ELSE l_tax END AS l_tax,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
  l_linestatus, l_shipdate,
  CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'train' ELSE 'test' END AS split
FROM lineitem"""

#: Customer with blanks, codes for missing values, and a number kept as text.
V2_SQL = """SELECT c_custkey, c_name,
  CASE WHEN c_custkey % 11 = 0 THEN 999 ELSE c_nationkey END AS c_nationkey,
  c_acctbal, CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS VARCHAR(40)) AS balance_text,
  CASE c_custkey % 10 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN 'n/a' ELSE c_mktsegment END AS c_mktsegment
FROM customer"""

V3_SQL = "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_quantity AS qty_copy, l_extendedprice * 2 AS price2 FROM lineitem"

#: Orders with dates kept as text, some of them words.
V4_SQL = """SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) END AS day_text,
  CASE WHEN o_custkey % 10 < 3 THEN 'never' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) END AS vague_text, o_orderpriority FROM orders"""

V5_SQL = "SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


#: Customer with columns that have next to nothing in them.
V6_SQL = """SELECT c_custkey, c_name, CAST(NULL AS DOUBLE) AS empty, 1 AS one, CASE WHEN c_custkey % 97 = 0 THEN 'x' ELSE 'y' END AS nearly,
  CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_acctbal END AS half, CASE c_custkey % 10 WHEN 0 THEN ' ' ELSE c_mktsegment END AS c_mktsegment FROM customer"""

#: Lineitem, and a part of it again.
V7_SQL = "SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 9 = 0"

#: Orders as a CSV reader first sees them: everything is text, and one column holds whatever came.
V8_SQL = """SELECT CAST(o_orderkey AS VARCHAR(20)) AS key_text, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) AS day_text,
  CASE o_custkey % 7 WHEN 0 THEN CAST(o_custkey AS VARCHAR(20)) WHEN 1 THEN ' 1.5e3 ' WHEN 2 THEN 'TRUE' WHEN 3 THEN '2024-02-30' WHEN 4 THEN '2024-02-29' WHEN 5 THEN ' ' END AS odd_text, o_orderpriority FROM orders"""

#: Lineitem with missing values and with two columns that tell its status.
V9_SQL = """SELECT l_linestatus, l_quantity, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount,
  CASE WHEN l_partkey % 2 = 0 THEN NULL ELSE l_tax END AS tax_result, l_linenumber + CASE WHEN l_linestatus = 'O' THEN 100 ELSE 0 END AS hint FROM lineitem"""

#: Lineitem with a fault for each rule: a status that one column gives away and another misses with, equal, constant, shifted and
#: half empty columns, numbers and many names kept as texts.
V10_SQL = """SELECT l_orderkey, l_linestatus, l_quantity, l_quantity AS qty_copy, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount,
  CASE WHEN l_partkey % 2 = 0 THEN NULL ELSE l_tax END AS tax_result, l_linenumber + CASE WHEN l_linestatus = 'O' THEN 100 ELSE 0 END AS hint,
  CASE WHEN l_linestatus = 'O' AND l_orderkey % 3 > 0 THEN NULL ELSE l_extendedprice END AS price_seen,
  CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN l_tax ELSE l_tax + 0.02 END AS moved, 1 AS one, concat('P', l_partkey) AS part_text,
  CAST(l_linenumber AS VARCHAR(5)) AS line_text, CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'train' ELSE 'test' END AS split FROM lineitem"""

#: Orders with a skewed response that is kept as text, misses some values, and has some that are no numbers.
V11_SQL = """SELECT o_orderkey, CASE WHEN o_custkey % 50 = 0 THEN NULL WHEN o_custkey % 50 = 1 THEN 'soon' WHEN o_orderkey % 40 = 2 THEN CAST(o_custkey * 1000 AS VARCHAR(20))
  ELSE CAST(o_custkey AS VARCHAR(20)) END AS paid FROM orders"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs a view's SQL over the tables that it names."""
    names = [n for n in ("lineitem", "customer", "orders", "documents", "labels") if f" {n}" in sql]
    given = {n: table(spark, sf_dir, n) for n in names}
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(sql, **given)
