"""Review tables bound to the benchmark tables, as SQL that Spark and DuckDB read alike.

A study is a nation, an outcome an order priority; the two arms are the returned and the accepted lines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ARMS = """
SELECT outcome, ord, study_id, subgroup,
  max(CASE WHEN arm = 'R' THEN n END) AS n1, max(CASE WHEN arm = 'R' THEN mean END) AS mean1, max(CASE WHEN arm = 'R' THEN sd END) AS sd1,
  max(CASE WHEN arm = 'R' THEN events END) AS events1,
  max(CASE WHEN arm = 'A' THEN n END) AS n2, max(CASE WHEN arm = 'A' THEN mean END) AS mean2, max(CASE WHEN arm = 'A' THEN sd END) AS sd2,
  max(CASE WHEN arm = 'A' THEN events END) AS events2
FROM (
  SELECT o_orderpriority AS outcome, n_nationkey AS ord, n_name AS study_id, CAST(n_regionkey AS VARCHAR(9)) AS subgroup, l_returnflag AS arm,
    count(*) AS n, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS sd, CAST(sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS events
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
  WHERE l_returnflag IN ('R', 'A')
  GROUP BY o_orderpriority, n_nationkey, n_name, n_regionkey, l_returnflag) cells
GROUP BY outcome, ord, study_id, subgroup
"""


def run_sql(spark: SparkSession, sf_dir: str, text: str, **more: DataFrame) -> DataFrame:
    """SQL over the tables named in braces; no view is left behind."""
    names = set(re.findall(r"\{(\w+)\}", text)) - set(more)
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}, **more)


def plain(text: str) -> str:
    """The same SQL with plain table names."""
    return re.sub(r"\{(\w+)\}", r"\1", text)


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, ARMS)
