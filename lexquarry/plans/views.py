"""Views that give the driver's tables the shapes the operators work on.

Each is one SQL text that Spark and DuckDB both accept, with {table}
placeholders, so an oracle sees the same input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.plans.storage import spread

MONTH_CASE = "CASE month(o_orderdate) " + " ".join(
    f"WHEN {i} THEN '{m}'" for i, m in enumerate("January February March April May June July August September October November December".split(), 1)
) + " END"

VIEWS = {
    "queries": "SELECT item_id AS query_id, text FROM {benchmark}",
    "sections": """SELECT p_partkey AS section_id, CAST(p_size AS STRING) AS section_number, p_name AS title, p_brand AS act,
        CAST(1950 + p_partkey % 75 AS INT) AS year, concat(p_name, ' ', p_type) AS text FROM {part}""",
    "case_section": "SELECT DISTINCT l_orderkey AS case_id, l_partkey AS section_id FROM {lineitem}",
    "cases": """SELECT o_orderkey AS case_id, o_custkey AS user_id, n_name AS court, o_orderstatus AS status, o_orderdate AS created_at,
        c_mktsegment AS case_type, o_totalprice AS amount, c_name AS title, o_orderpriority AS priority
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "edges": """SELECT DISTINCT a.section_id AS src, b.section_id AS dst,
        CASE (a.section_id + b.section_id) % 3 WHEN 0 THEN 'RELATED_TO' WHEN 1 THEN 'CROSS_CODE' ELSE 'SUCCESSOR_OF' END AS type
        FROM (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS section_id FROM {lineitem}) a
        JOIN (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS section_id FROM {lineitem}) b
        ON a.case_id = b.case_id AND a.section_id < b.section_id""",
    "agent_confidence": """SELECT event_id, user_id AS case_id, event_type AS agent, ts,
        CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE value / (SELECT max(value) FROM {events}) END AS confidence FROM {events}""",
    "judgments": f"""SELECT o_orderkey AS doc_id, concat(
        c_name, ' vs State of ', n_name, ' on ', CAST(day(o_orderdate) AS STRING), ' ', {MONTH_CASE}, ', ', CAST(year(o_orderdate) AS STRING), '\n',
        CASE o_orderkey % 4 WHEN 0 THEN concat('AIR ', CAST(year(o_orderdate) AS STRING), ' SC ', CAST(o_orderkey % 900 + 1 AS STRING))
            WHEN 1 THEN concat('(', CAST(year(o_orderdate) AS STRING), ') ', CAST(o_orderkey % 9 + 1 AS STRING), ' BOMLR ', CAST(o_orderkey % 800 + 1 AS STRING))
            WHEN 2 THEN concat(CAST(year(o_orderdate) AS STRING), ' CriLJ ', CAST(o_orderkey % 700 + 1 AS STRING)) ELSE 'Unreported' END, '\n',
        CASE o_orderkey % 3 WHEN 0 THEN 'IN THE SUPREME COURT OF INDIA' WHEN 1 THEN concat('HIGH COURT OF ', n_name) ELSE 'Before the bench' END, '\n',
        'Criminal Appeal No. ', CAST(o_orderkey AS STRING), ' of ', CAST(year(o_orderdate) AS STRING), '\n',
        'Bench: A. Rao, B. Sen\nJUDGMENT\n',
        '1. The accused relies on Section ', CAST(o_orderkey % 50 + 1 AS STRING), ' of the Indian Evidence Act and Article ', CAST(o_orderkey % 20 + 12 AS STRING), ' before the court.\n',
        '2. The police arrested the accused on ', CAST(day(o_orderdate) AS STRING), '-', CAST(month(o_orderdate) AS STRING), '-', CAST(year(o_orderdate) AS STRING), ' after the bank account audit.\n',
        '3. Reliance is placed on Ram Lal v. Shyam Das, where Section ', CAST(o_orderkey % 90 + 1 AS STRING), ' of the Insurance Act was read. Whether the policy was valid on that date?\n',
        CASE o_orderstatus WHEN 'F' THEN 'The appeal is dismissed.' WHEN 'O' THEN 'The bail application is allowed.' ELSE 'The petition is partly allowed.' END
        ) AS text
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or one of the driver's tables as it is."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in ("case_section", "edges"):
        return _wide(spark, sf_dir, name)
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    if name == "judgments":  # orders are few bytes of input and much text: one small file would be one task
        tables["orders"] = spread(tables["orders"].select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"), "o_orderkey")
    return spark.sql(sql, **tables)


def _wide(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The two views of pairs, the same rows as their SQL, in as many partitions as the lines call for."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("section_id"))
    links = spread(lines, "case_id").distinct()
    if name == "case_section":
        return links
    a, b = links.alias("a"), links.alias("b")
    pairs = a.join(b, F.col("a.case_id") == F.col("b.case_id")).filter("a.section_id < b.section_id").select(F.col("a.section_id").alias("src"), F.col("b.section_id").alias("dst"))
    kind = F.expr("CASE (src + dst) % 3 WHEN 0 THEN 'RELATED_TO' WHEN 1 THEN 'CROSS_CODE' ELSE 'SUCCESSOR_OF' END")
    return spread(pairs, "src", "dst", source=lines).distinct().select("src", "dst", kind.alias("type"))


def oracle(sql: str) -> str:
    """``sql`` with the views it names as common table expressions, for DuckDB."""
    plain = {n: re.sub(r"\{(\w+)\}", r"\1", v) for n, v in VIEWS.items()}
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    with_ = ", ".join(f"{n} AS ({plain[n]})" for n in used)
    body = sql.strip()
    return f"WITH {with_}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {with_} {body}"
