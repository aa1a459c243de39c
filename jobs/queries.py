"""The jobs as queries: each runs twice into one new folder and returns the output as it stands then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import common, set_relations, text_positions
from plyset.storage import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, config = _folder(spark, "job1"), common.config(None, text_positions.DEFAULT)
    for _ in range(2):  # the second run finds nothing new
        text_positions.run(spark, f"{sf_dir}/documents.parquet", f"{base}/out", f"{base}/checkpoint", config)
    return text_positions.state(spark, f"{base}/out", config).selectExpr(*(f"cast(c{i} as int) as c{i}" for i in range(len(config["slots"]))), "texts", "allowed")


def job2(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _folder(spark, "job2")
    for _ in range(2):  # the second run replaces each month by itself
        set_relations.run(spark, f"{sf_dir}/lineitem.parquet", f"{sf_dir}/orders.parquet", f"{base}/out")
    return set_relations.state(spark, f"{base}/out")


QUERIES = {"job1_text_positions": job1, "job2_set_relations": job2}

JOB1_SQL = r"""
WITH m AS (
  SELECT lang, t, length(t) AS chars, length(t) - length(translate(t, chr(10), '')) + 1 AS lines, length(t) - length(translate(t, '0123456789', '')) AS digits,
    length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS capitals, length(regexp_replace(t, '[A-Za-z0-9 ]', '', 'g')) AS other
  FROM (SELECT lang, coalesce(text, '') AS t FROM documents)),
s AS (
  SELECT *, CASE WHEN chars > 0 THEN digits * 1000 // chars ELSE 0 END AS d, CASE WHEN chars > 0 THEN capitals * 1000 // chars ELSE 0 END AS k,
    CASE WHEN chars > 0 THEN other * 1000 // chars ELSE 0 END AS o FROM m),
p AS (
  SELECT CAST(coalesce(list_position(['de', 'en', 'es', 'fr'], lang), 0) AS INT) AS c0,
    CAST(len(list_filter([1, 100, 300, 1000, 3000, 10000, 30000, 100000], lambda b: chars >= b)) AS INT) AS c1, CAST(len(list_filter([2, 5, 20, 100], lambda b: lines >= b)) AS INT) AS c2,
    CAST(len(list_filter([1, 10, 50, 200], lambda b: d >= b)) AS INT) AS c3, CAST(len(list_filter([5, 15, 30, 60, 150], lambda b: k >= b)) AS INT) AS c4,
    CAST(len(list_filter([10, 30, 60, 120, 300], lambda b: o >= b)) AS INT) AS c5
  FROM s)
SELECT c0, c1, c2, c3, c4, c5, count(*) AS texts, (c0 BETWEEN 1 AND 4 AND c1 BETWEEN 2 AND 7 AND c3 <= 2 AND c4 <= 3) OR (c1 = 8 AND c3 = 0) AS allowed
FROM p GROUP BY c0, c1, c2, c3, c4, c5
"""

JOB2_SQL = """
WITH p AS (
  SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS month, concat(o_orderpriority, '/', l_returnflag) AS g, l_partkey % 16 AS c0, l_suppkey % 16 AS c1, l_linenumber - 1 AS c2, CAST(l_quantity AS INT) - 1 AS c3
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT month, g, count(*) AS n FROM p GROUP BY month, g),
c AS (SELECT x.month, x.g AS a, y.g AS b, count(*) AS n FROM p x JOIN p y USING (month, c0, c1, c2, c3) WHERE x.g < y.g GROUP BY x.month, x.g, y.g)
SELECT a.month, a.g AS a, b.g AS b, a.n AS a_n, b.n AS b_n, coalesce(c.n, 0) AS both_n, a.n + b.n - coalesce(c.n, 0) AS either_n,
  coalesce(c.n, 0) = a.n AS subset, coalesce(c.n, 0) = b.n AS superset, coalesce(c.n, 0) = 0 AS disjoint
FROM n a JOIN n b ON a.month = b.month AND a.g < b.g LEFT JOIN c ON c.month = a.month AND c.a = a.g AND c.b = b.g
"""

ORACLE_SQL = {"job1_text_positions": JOB1_SQL, "job2_set_relations": JOB2_SQL}
