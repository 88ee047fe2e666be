"""The driver's tables reshaped into the frames the operators read, in Spark and in SQL.

customer  people: an entity with claims about being human (P31) and about its nation (P21)
nation    the categories those claims point to; those of region 0 lack an English label
orders    links from people to pages; status is the wiki, priority the snapshot or page kind
lineitem  the history of those pages
"""

from __future__ import annotations

import tempfile
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.sources import Staging, staging_folder

SQL_TIME = "'%Y-%m-%d %H:%M:%S'"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def own_folder() -> str:
    return tempfile.mkdtemp(prefix="lacuna-")


def place(spark: SparkSession) -> Staging:
    """Where a query writes files to read them again: the folder the session names. On one machine a
    folder of that machine takes its place where none is named."""
    named = staging_folder(spark)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return Staging(spark, folder=named or own_folder())


CLAIMS_TYPE = "array<struct<mainSnak: struct<property: string, datavalue: struct<value: string>>>>"


def entity_json(prefix: str, key: str) -> str:
    """The JSON text of a claim that points to an entity, as a SQL expression."""
    return f"""concat('{{"entity-type":"item","id":"{prefix}', {key}, '"}}')"""


def claim(prop: str, value: str) -> str:
    return f"named_struct('mainSnak', named_struct('property', '{prop}', 'datavalue', named_struct('value', {value})))"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    human = claim("P31", entity_json("Q", "if(c_mktsegment <> 'FURNITURE', '5', '50')"))
    nation = claim("P21", f"if(c_acctbal >= 0, {entity_json('N', 'c_nationkey')}, NULL)")
    second = claim("P21", entity_json("N", "24 - c_nationkey"))
    claims = f"if(c_mktsegment = 'BUILDING', array({human}, {nation}, {second}), array({human}, {nation}))"
    return load(spark, sf_dir, "customer").selectExpr(
        "concat('C', c_custkey) AS id",
        "'item' AS typ",
        "'2021-08-02' AS snapshot",
        f"CAST({claims} AS {CLAIMS_TYPE}) AS claims",
        "map('en', c_name) AS labels",
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = """concat('"', n_name, '"')"""
    return load(spark, sf_dir, "nation").selectExpr(
        "concat('N', n_nationkey) AS id",
        "'item' AS typ",
        "'2021-08-02' AS snapshot",
        f"CAST(array() AS {CLAIMS_TYPE}) AS claims",
        f"if(n_regionkey = 0, map('fr', {quoted}), map('fr', {quoted}, 'en', {quoted})) AS labels",
    )


def entity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).unionByName(categories(spark, sf_dir))


def wiki(status: str) -> Column:
    return F.concat(F.lower(status), F.lit("wiki"))


def link_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").selectExpr(
        "concat('C', o_custkey) AS item_id",
        "concat(lower(o_orderstatus), 'wiki') AS wiki_db",
        "o_orderkey AS page_id",
        "concat_ws('-', o_orderpriority, o_custkey) AS page_title",
        "o_orderpriority AS snapshot",
    )


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").selectExpr(
        "concat(lower(o_orderstatus), 'wiki') AS wiki_db",
        "o_orderkey AS page_id",
        "o_orderpriority AS page_title",
        "if(o_orderpriority = '5-LOW', 1, 0) AS page_namespace",
        "if(o_orderpriority = '4-NOT SPECIFIED', 1, 0) AS page_is_redirect",
        "'2021-07' AS snapshot",
    )


def time_text(c: str) -> Column:
    return F.substring(F.col(c).cast("string"), 1, 19)


def history_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS page_id", "concat(lower(o_orderstatus), 'wiki') AS wiki_db"
    )
    lines = load(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS page_id",
        "if(l_returnflag <> 'N', substring(CAST(l_shipdate AS STRING), 1, 19), NULL) AS page_first_edit_timestamp",
    )
    return lines.join(orders, "page_id").selectExpr(
        "wiki_db", "page_id", "page_first_edit_timestamp", "'2021-07' AS snapshot"
    )


def property_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as claims: the kind of event is the property, its ``k`` the entity pointed to."""
    return load(spark, sf_dir, "events").selectExpr(
        "user_id AS qitem_id",
        "event_type AS property",
        f"{entity_json('K', "get_json_object(props, '$.k')")} AS value",
    )


def nation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as labels of the entities that events point to; most of those have none."""
    return load(spark, sf_dir, "nation").selectExpr("concat('K', n_nationkey) AS id", "n_name AS label")


# The same frames for the SQL side.

CLAIM = """claim AS (
  SELECT 'C' || c_custkey AS id, 'P31' AS property,
         '{"entity-type":"item","id":"Q' || CASE WHEN c_mktsegment <> 'FURNITURE' THEN '5' ELSE '50' END || '"}' AS value
  FROM customer
  UNION ALL
  SELECT 'C' || c_custkey, 'P21',
         CASE WHEN c_acctbal >= 0 THEN '{"entity-type":"item","id":"N' || c_nationkey || '"}' END
  FROM customer
  UNION ALL
  SELECT 'C' || c_custkey, 'P21', '{"entity-type":"item","id":"N' || (24 - c_nationkey) || '"}'
  FROM customer WHERE c_mktsegment = 'BUILDING')"""

PIVOT = """pivoted AS (
  SELECT id AS qid,
         max(CASE WHEN property = 'P31' THEN true ELSE false END) AS is_human,
         json_extract_string(max(CASE WHEN property = 'P21' THEN value END), '$.id') AS gender
  FROM claim
  WHERE (property = 'P31' AND value LIKE '%"id":"Q5"%') OR property = 'P21'
  GROUP BY id)"""

LABEL = """label AS (
  SELECT 'N' || n_nationkey AS id, '"' || n_name || '"' AS label FROM nation WHERE n_regionkey <> 0)"""

LINK = """link AS (
  SELECT 'C' || o_custkey AS item_id, lower(o_orderstatus) || 'wiki' AS wiki_db, o_orderkey AS page_id,
         o_orderpriority || '-' || o_custkey AS page_title, o_orderpriority AS snapshot
  FROM orders)"""

PAGE = """page AS (
  SELECT lower(o_orderstatus) || 'wiki' AS wiki_db, o_orderkey AS page_id
  FROM orders WHERE o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED'))"""

HISTORY = f"""history AS (
  SELECT lower(o_orderstatus) || 'wiki' AS wiki_db, l_orderkey AS page_id,
         CASE WHEN l_returnflag <> 'N' THEN strftime(l_shipdate, {SQL_TIME}) END AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

ITEM = f"""{CLAIM},
{PIVOT},
{LABEL},
{LINK},
item AS (
  SELECT qid, is_human, gender, label AS gender_label,
         NOT EXISTS (SELECT 1 FROM link WHERE item_id = qid AND snapshot = '1-URGENT') AS zero_ill
  FROM pivoted JOIN label ON gender = id)"""

ARTICLE = f"""{ITEM},
{PAGE},
{HISTORY},
linked AS (
  SELECT item.*, wiki_db, page_id, page_title
  FROM item JOIN link ON qid = item_id JOIN page USING (wiki_db, page_id)),
article AS (
  SELECT l.page_id, l.wiki_db, qid, is_human, gender, gender_label, zero_ill, page_title,
         ts AS page_first_edit_timestamp
  FROM linked l JOIN (SELECT wiki_db, page_id, max(ts) AS ts FROM history GROUP BY ALL) h USING (wiki_db, page_id)
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT wiki_db, page_title FROM linked GROUP BY ALL HAVING count(*) > 1) d
                    WHERE d.wiki_db = l.wiki_db AND d.page_title = l.page_title)
    AND NOT EXISTS (SELECT 1 FROM (SELECT wiki_db, page_id FROM linked GROUP BY ALL HAVING count(*) > 1) d
                    WHERE d.wiki_db = l.wiki_db AND d.page_id = l.page_id))"""

# Articles per wiki and month from distinct first-edit times.
TOTAL = """dated AS (
  SELECT DISTINCT wiki_db, page_id, ts FROM history SEMI JOIN page USING (wiki_db, page_id) WHERE ts IS NOT NULL),
total AS (
  SELECT wiki_db, year, month, count(*) AS article_count,
         CAST(sum(count(*)) OVER (PARTITION BY wiki_db ORDER BY year, month) AS BIGINT) AS cumsum
  FROM (SELECT wiki_db, ts[1:4] AS year, ts[6:7] AS month FROM dated) GROUP BY wiki_db, year, month)"""

PROPERTY = """prop AS (
  SELECT user_id AS qitem_id, event_type AS property,
         '{"entity-type":"item","id":"K' || json_extract_string(props, '$.k') || '"}' AS value
  FROM events)"""

NATION_LABEL = "nation_label AS (SELECT 'K' || n_nationkey AS id, n_name AS label FROM nation)"
