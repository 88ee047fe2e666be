"""One registered query per operator, with its oracle."""

from __future__ import annotations

import sys
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna import functions as fn
from lacuna import operators as op
from lacuna import plans, sources
from lacuna.lookups import (
    CLASSIFIER_FEATURES,
    GENDER_CATEGORIES,
    TIME_PROPERTIES,
    gender_categories,
    lookup_frame,
    time_properties,
)
from lacuna.operators.logs import SELECTION_BLOCK
from lacuna.session import tune

from .frames import (
    ARTICLE,
    CLAIM,
    HISTORY,
    ITEM,
    LABEL,
    LINK,
    NATION_LABEL,
    PAGE,
    PIVOT,
    PROPERTY,
    SQL_TIME,
    TOTAL,
    categories,
    entity_table,
    history_table,
    link_table,
    load,
    nation_labels,
    page_table,
    people,
    place,
    property_frame,
    time_text,
    wiki,
)

# The small models below travel to the workers whole: this module need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERIES = {}
ORACLES = {}


def query(sql: str):
    """Register a function of (spark, sf_dir) under its name, with the SQL of the same result."""

    def register(run):
        def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(tune(spark), sf_dir)

        QUERIES[run.__name__] = tuned
        ORACLES[run.__name__] = sql
        return run

    return register


def base_of(spark, sf_dir):
    tables = (table(spark, sf_dir) for table in (entity_table, link_table, page_table, history_table))
    return plans.Snapshots(spark, *tables)


# --- scans ---------------------------------------------------------------------------------


def items_of(spark, sf_dir):
    entities = sources.entities(spark, entity_table(spark, sf_dir), "2021-08-02")
    links = sources.links(spark, link_table(spark, sf_dir), "1-URGENT")
    return plans.item_features(entities, links, stage=sources.staged)


def articles_of(spark, sf_dir, items=None, history=None):
    items = items or items_of(spark, sf_dir)
    links = sources.links(spark, link_table(spark, sf_dir))
    folded = history is not None
    history = history if folded else edits(spark, sf_dir)
    return plans.page_features(items, links, live_pages(spark, sf_dir), history, stage=sources.staged, folded=folded)


def live_pages(spark, sf_dir, wikis=None):
    return sources.pages(spark, page_table(spark, sf_dir), "2021-07", wikis)


def edits(spark, sf_dir, wikis=None):
    return sources.history(spark, history_table(spark, sf_dir), "2021-07", wikis)


@query(
    """SELECT 'C' || c_custkey AS id, c_name AS label FROM customer
    UNION ALL SELECT 'N' || n_nationkey, '"' || n_name || '"' FROM nation"""
)
def scan_entities(spark, sf_dir):
    found = sources.entities(spark, entity_table(spark, sf_dir), "2021-08-02")
    name = F.coalesce(F.try_element_at("labels", F.lit("en")), F.try_element_at("labels", F.lit("fr")))
    return found.select("id", name.alias("label"))


@query(f"WITH {LINK} SELECT * FROM link WHERE snapshot = '1-URGENT' AND wiki_db IN ('fwiki', 'owiki')")
def scan_links(spark, sf_dir):
    return sources.links(spark, link_table(spark, sf_dir), "1-URGENT", "fwiki owiki")


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def stored_features(spark, sf_dir):
    """Written to a path, then over again, and read from it."""
    path = place(spark).new_path()
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    sources.write_parquet(customers.limit(1), path)
    sources.write_parquet(customers, path)
    return sources.read_features(spark, path)


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def external_table(spark, sf_dir):
    """Saved through the catalog with a folder per status and files of even size, read back by name."""
    stage, name = place(spark), f"orders_{uuid.uuid4().hex}"
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    sources.save_external(orders, name, stage.new_path(), partition_by=["o_orderstatus"], rebalance=True)
    return spark.table(name)


@query("SELECT CAST(3 AS BIGINT) AS files, count(*) AS rows, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem")
def external_files(spark, sf_dir):
    """Saved as so many files; what they hold together."""
    stage, name = place(spark), f"lines_{uuid.uuid4().hex}"
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    sources.save_external(lines, name, stage.new_path(), files=3)
    return spark.table(name).agg(
        F.count_distinct("_metadata.file_path").alias("files"),
        F.count("*").alias("rows"),
        F.sum("l_orderkey").alias("keys"),
    )


@query(
    """WITH line AS (SELECT *, c_mktsegment = 'MACHINERY' AS bad FROM customer)
    SELECT n_name, count(*) AS customers, sum(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS even
    FROM line JOIN nation ON c_nationkey = n_nationkey WHERE NOT bad GROUP BY n_name
    UNION ALL SELECT 'bad lines', count(*), count(*) FILTER (c_custkey % 2 = 0) FROM line WHERE bad"""
)
def lookup_file(spark, sf_dir):
    """A tab-separated file with lines that do not fit: good rows meet a table, bad lines are counted."""
    path = place(spark).new_path()
    nation = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_nationkey").cast("string")).otherwise("n/a")
    customers = load(spark, sf_dir, "customer").select("c_custkey", nation.alias("c_nationkey"), "c_name")
    customers.write.csv(path, sep="\t", header=True)
    good, bad = sources.split_lookup(sources.read_lookup(spark, path, "c_custkey bigint, c_nationkey int, c_name string"))
    even = F.count_if(F.col("c_custkey") % 2 == 0).alias("even")
    nations = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    counted = good.join(nations, "c_nationkey").groupBy("n_name").agg(F.count("*").alias("customers"), even)
    key = F.substring_index(sources.files.BAD_LINE, "\t", 1).cast("bigint").alias("c_custkey")
    return counted.unionByName(bad.select(key).agg(F.lit("bad lines").alias("n_name"), F.count("*").alias("customers"), even))


@query(f"WITH {LINK} SELECT item_id, wiki_db, page_id, page_title FROM link")
def staged_links(spark, sf_dir):
    """Written to the checkpoint folder and read back, where the session has one."""
    return sources.staged(link_table(spark, sf_dir)).drop("snapshot")


@query(
    """SELECT lower(o_orderstatus) || 'wiki' AS wiki_db, o_orderkey AS page_id, o_orderpriority AS page_title
    FROM orders WHERE o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED') AND o_orderstatus IN ('F', 'P')"""
)
def scan_pages(spark, sf_dir):
    return live_pages(spark, sf_dir, "fwiki pwiki")


@query(f"WITH {HISTORY} SELECT wiki_db, page_id, ts AS page_first_edit_timestamp FROM history WHERE wiki_db = 'pwiki'")
def scan_history(spark, sf_dir):
    return edits(spark, sf_dir, "pwiki")


# --- items ---------------------------------------------------------------------------------


@query(f"WITH {CLAIM} SELECT id, property, value FROM claim")
def explode_claims(spark, sf_dir):
    return op.explode_claims(sources.entities(spark, entity_table(spark, sf_dir), "2021-08-02"))


@query(f"WITH {CLAIM}, {PIVOT} SELECT qid AS id, is_human, gender FROM pivoted")
def claim_features(spark, sf_dir):
    return op.pivot_claims(
        op.explode_claims(sources.entities(spark, entity_table(spark, sf_dir), "2021-08-02")),
        flags={"is_human": ("P31", "Q5")},
        values={"gender": "P21"},
    )


@query(
    f"""WITH {PROPERTY}
    SELECT qitem_id, max(CASE WHEN property = 'signup' THEN true ELSE false END) AS is_member,
           json_extract_string(max(CASE WHEN property = 'purchase' THEN value END), '$.id') AS bought
    FROM prop
    WHERE (property = 'signup' AND value LIKE '%"id":"K5"%') OR property = 'purchase'
    GROUP BY qitem_id"""
)
def claims_pivot(spark, sf_dir):
    return op.pivot_claims(
        property_frame(spark, sf_dir),
        flags={"is_member": ("signup", "K5")},
        values={"bought": "purchase"},
        key="qitem_id",
    )


@query(
    f"""WITH {PROPERTY}
    SELECT qitem_id, max(CASE WHEN property = 'signup' THEN true ELSE false END) AS is_member,
           json_extract_string(max(CASE WHEN property = 'purchase' THEN value END), '$.id') AS bought
    FROM prop
    WHERE (property = 'signup' AND json_extract_string(value, '$.id') = 'K5') OR property = 'purchase'
    GROUP BY qitem_id"""
)
def claims_pivot_strict(spark, sf_dir):
    """The same where the JSON is spelled with blanks, which only reading it understands."""
    spaced = property_frame(spark, sf_dir).withColumn("value", F.replace("value", F.lit(":"), F.lit(" : ")))
    return op.pivot_claims(
        spaced, flags={"is_member": ("signup", "K5")}, values={"bought": "purchase"}, key="qitem_id", strict=True
    )


@query(f"WITH {LABEL} SELECT id, label FROM label")
def labels_in(spark, sf_dir):
    return op.labels_in(categories(spark, sf_dir))


@query(
    """SELECT c_custkey, 'N' || c_nationkey AS nation, '"' || n_name || '"' AS nation_label
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE c_mktsegment <> 'BUILDING' AND n_regionkey <> 0"""
)
def label_lookup(spark, sf_dir):
    nation = F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("N"), "c_nationkey"))
    customers = load(spark, sf_dir, "customer").select("c_custkey", nation.alias("nation"))
    return op.add_label(customers, "nation", op.labels_in(categories(spark, sf_dir)), "nation_label")


@query(
    """SELECT doc_id, lang, NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS zero_ill
    FROM documents d"""
)
def missing_flag(spark, sf_dir):
    documents = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return op.add_missing_flag(documents, load(spark, sf_dir, "labels"), "doc_id", "doc_id")


@query(f"WITH {ITEM} SELECT * FROM item")
def item_features(spark, sf_dir):
    return items_of(spark, sf_dir)


@query(
    f"""WITH {PROPERTY}, item AS (SELECT DISTINCT qitem_id FROM prop)
    SELECT qitem_id,
           coalesce(bool_or(property = 'signup' AND value LIKE '%"id":"K5"%'), false) AS is_member,
           json_extract_string(max(CASE WHEN property = 'purchase' THEN value END), '$.id') AS bought,
           json_extract_string(max(CASE WHEN property = 'refund' THEN value END), '$.id') AS refunded
    FROM item JOIN prop USING (qitem_id) GROUP BY qitem_id"""
)
def append_features(spark, sf_dir):
    props = property_frame(spark, sf_dir)
    items = props.select("qitem_id").distinct()
    return op.append_features(
        items, props, flags={"is_member": ("signup", "K5")}, values={"bought": "purchase", "refunded": "refund"}
    )


@query(
    f"""WITH {PROPERTY}
    SELECT qitem_id, property, value, CASE property WHEN 'click' THEN 'a click, a tap' ELSE 'a view' END AS property_label
    FROM prop WHERE property IN ('click', 'view')"""
)
def time_claims(spark, sf_dir):
    lookup = lookup_frame(spark, [("click", "a click, a tap"), ("view", "a view")], ("Property", "Label"))
    return op.time_claims(property_frame(spark, sf_dir), lookup)


@query(
    """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"""
)
def in_category(spark, sf_dir):
    lookup = lookup_frame(spark, [("building", "BUILDING"), ("machinery", "MACHINERY")], ("Label", "QID"))
    return op.in_category(load(spark, sf_dir, "customer"), "c_mktsegment", lookup)


# The stored lists, as rows of SQL.
TIME_ROWS = ", ".join(f"({i}, '{p}', '{n}')" for i, (p, n) in enumerate(TIME_PROPERTIES))
GENDER_ROWS = ", ".join("({}, '{}')".format(i, q) for i, (_, q) in enumerate(GENDER_CATEGORIES))


@query(
    f"""WITH listed(i, property, label) AS (VALUES {TIME_ROWS})
    SELECT l_orderkey, l_linenumber, property, label AS property_label
    FROM lineitem JOIN listed ON l_linenumber % 7 * 3 = i"""
)
def stored_time_claims(spark, sf_dir):
    """Lines of orders as claims about the stored time properties; some are about none of them."""
    names = F.array(*[F.lit(p) for p, _ in TIME_PROPERTIES])
    claims = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.coalesce(F.get(names, F.col("l_linenumber") % 7 * 3), F.lit("P1")).alias("property")
    )
    return op.time_claims(claims, time_properties(spark))


@query(
    f"""WITH listed(i, qid) AS (VALUES {GENDER_ROWS})
    SELECT c_custkey, qid AS gender FROM customer JOIN listed ON c_custkey % 50 = i"""
)
def stored_genders(spark, sf_dir):
    """Customers with an item of the stored gender list; every fifth has one that is not in it."""
    known = F.array(*[F.lit(q) for _, q in GENDER_CATEGORIES])
    gender = F.coalesce(F.get(known, (F.col("c_custkey") % 50).cast("int")), F.lit("Q0"))
    customers = load(spark, sf_dir, "customer").select("c_custkey", gender.alias("gender"))
    return op.in_category(customers, "gender", gender_categories(spark))


# --- pages ---------------------------------------------------------------------------------


@query(
    f"""WITH {LINK}
    SELECT 'C' || c_custkey AS qid, wiki_db, page_id, page_title
    FROM customer JOIN link ON 'C' || c_custkey = item_id
    WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND wiki_db IN ('fwiki', 'owiki')"""
)
def item_pages(spark, sf_dir):
    items = load(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    items = items.select(F.concat(F.lit("C"), "c_custkey").alias("qid"), "c_acctbal")
    return op.pages_of_items(items, link_table(spark, sf_dir), "fwiki owiki")


@query(
    """WITH d AS (SELECT doc_id, lang, sha256(text) AS title FROM documents)
    SELECT doc_id, lang, title FROM d
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT lang, title FROM d GROUP BY ALL HAVING count(*) > 1) x
                      WHERE x.lang = d.lang AND x.title = d.title)
      AND NOT EXISTS (SELECT 1 FROM (SELECT lang, doc_id FROM d GROUP BY ALL HAVING count(*) > 1) x
                      WHERE x.lang = d.lang AND x.doc_id = d.doc_id)"""
)
def drop_ambiguous(spark, sf_dir):
    # Whole texts are titles here; their digests are what is shuffled.
    documents = load(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("title"))
    return op.drop_ambiguous(documents, [("title", "lang"), ("doc_id", "lang")])


@query(
    """SELECT p_partkey, p_name, p_brand, p_size FROM part p
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT p_brand, p_name, p_size FROM part GROUP BY ALL HAVING count(*) > 1) x
                      WHERE x.p_brand = p.p_brand AND x.p_name = p.p_name AND x.p_size = p.p_size)"""
)
def drop_ambiguous_parts(spark, sf_dir):
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return op.drop_ambiguous(parts, [("p_size", "p_name", "p_brand"), ("p_partkey", "p_brand")])


@query(
    f"""WITH {LINK}, {HISTORY}, linked AS (
      SELECT wiki_db, page_id, min(item_id) AS item_id, min(page_title) AS page_title FROM link GROUP BY ALL)
    SELECT page_id, wiki_db, item_id, page_title, ts AS page_first_edit_timestamp
    FROM linked JOIN (SELECT wiki_db, page_id, max(ts) AS ts FROM history GROUP BY ALL) h USING (wiki_db, page_id)"""
)
def first_edit(spark, sf_dir):
    pages = link_table(spark, sf_dir).drop("snapshot")
    return op.add_first_edit(pages, history_table(spark, sf_dir))


@query(
    f"""WITH {LINK}, {HISTORY}
    SELECT wiki_db, page_id, max(ts) AS page_first_edit_timestamp
    FROM history SEMI JOIN link USING (wiki_db, page_id) GROUP BY ALL"""
)
def first_edit_narrow(spark, sf_dir):
    return op.first_edit_of(link_table(spark, sf_dir), history_table(spark, sf_dir))


@query(f"WITH {ARTICLE} SELECT * FROM article")
def page_features(spark, sf_dir):
    return articles_of(spark, sf_dir)


@query(f"WITH {ARTICLE} SELECT * FROM article")
def page_features_filtered(spark, sf_dir):
    """The same frame, with bitmaps of hashes before the exchanges."""
    base, stage = base_of(spark, sf_dir), place(spark)
    return base.page_frame(items_of(spark, sf_dir), None, "2021-07", stage=stage, candidates=True)


@query(f"WITH {PAGE}, {HISTORY}, {TOTAL} SELECT * FROM total")
def wiki_totals_distinct(spark, sf_dir):
    return plans.number_of_pages(live_pages(spark, sf_dir), edits(spark, sf_dir))


MIN_TOTAL = """SELECT wiki_db, ts[1:4] AS year, ts[6:7] AS month, CAST(count(*) AS BIGINT) AS article_count,
         CAST(sum(count(*)) OVER (PARTITION BY wiki_db ORDER BY ts[1:4] NULLS FIRST, ts[6:7] NULLS FIRST) AS BIGINT) AS cumsum
  FROM earliest GROUP BY wiki_db, ts[1:4], ts[6:7]"""


@query(
    f"""WITH {PAGE}, {HISTORY},
    earliest AS (SELECT wiki_db, page_id, min(ts) AS ts FROM page JOIN history USING (wiki_db, page_id) GROUP BY ALL)
    {MIN_TOTAL}"""
)
def wiki_totals_min(spark, sf_dir):
    return op.wiki_totals(live_pages(spark, sf_dir), edits(spark, sf_dir), mode="min")


@query(
    f"""WITH page AS (SELECT DISTINCT l_linestatus || 'wiki' AS wiki_db, l_orderkey AS page_id FROM lineitem),
    history AS (SELECT l_orderkey AS page_id, min(strftime(l_shipdate, {SQL_TIME})) AS ts FROM lineitem GROUP BY ALL),
    earliest AS (SELECT wiki_db, page_id, min(ts) AS ts FROM page JOIN history USING (page_id) GROUP BY ALL)
    {MIN_TOTAL}"""
)
def wiki_totals_loose(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select(
        F.concat("l_linestatus", F.lit("wiki")).alias("wiki_db"),
        F.col("l_orderkey").alias("page_id"),
        time_text("l_shipdate").alias("page_first_edit_timestamp"),
    )
    return op.wiki_totals(lines, lines, mode="min", match_wiki=False)


# --- metrics -------------------------------------------------------------------------------


@query(
    """SELECT c_mktsegment, count(*) AS gender_count, (SELECT count(*) FROM customer) AS people_count,
           count(*) / (SELECT count(*) FROM customer) * 100 AS gender_ratio
    FROM customer GROUP BY c_mktsegment"""
)
def share_of_total(spark, sf_dir):
    customers = load(spark, sf_dir, "customer")
    return op.share_of_total(customers, ["c_mktsegment"], "gender_count", "people_count", "gender_ratio")


@query(
    f"""WITH {ITEM}
    SELECT gender, gender_label, count(*) AS gender_count,
           CAST(sum(count(*)) OVER () AS BIGINT) AS people_count, count(*) / sum(count(*)) OVER () * 100 AS gender_ratio
    FROM item WHERE is_human GROUP BY gender, gender_label"""
)
def gender_item(spark, sf_dir):
    return plans.number_of_gender_item(items_of(spark, sf_dir))


@query(
    """SELECT o_orderstatus, c_mktsegment, article_count, gender_count, article_count / gender_count * 100 AS article_ratio
    FROM (SELECT o_orderstatus, c_mktsegment, count(*) AS article_count
          FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    JOIN (SELECT c_mktsegment, count(*) AS gender_count FROM customer GROUP BY ALL) USING (c_mktsegment)"""
)
def coverage_ratio(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    ordered = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return op.coverage_ratio(ordered, customers, ["o_orderstatus"], "c_mktsegment")


@query(
    f"""WITH {ARTICLE}
    SELECT wiki_db, a.gender, a.gender_label, article_count, gender_count,
           article_count / gender_count * 100 AS article_ratio
    FROM (SELECT wiki_db, gender, gender_label, count(*) AS article_count FROM article WHERE is_human GROUP BY ALL) a
    JOIN (SELECT gender, gender_label, count(*) AS gender_count FROM item WHERE is_human GROUP BY ALL) i
      ON a.gender = i.gender"""
)
def gender_article_overall(spark, sf_dir):
    items = items_of(spark, sf_dir)
    return plans.number_of_gender_article_overall(articles_of(spark, sf_dir, items), items)


@query(
    f"""WITH {ARTICLE}, {TOTAL},
    series AS (
      SELECT wiki_db, t[1:4] AS year, t[6:7] AS month, gender, gender_label, count(*) AS article_count,
             CAST(sum(count(*)) OVER (PARTITION BY wiki_db, gender, gender_label ORDER BY t[1:4], t[6:7]) AS BIGINT) AS cumsum
      FROM (SELECT *, page_first_edit_timestamp AS t FROM article)
      WHERE is_human AND t IS NOT NULL GROUP BY wiki_db, t[1:4], t[6:7], gender, gender_label)
    SELECT wiki_db, year, month, gender_label, s.article_count,
           s.article_count / t.article_count * 100 AS monthly_article_ratio, s.cumsum,
           s.cumsum / t.cumsum * 100 AS article_ratio
    FROM series s FULL JOIN total t USING (wiki_db, year, month)"""
)
def gender_article_by_month(spark, sf_dir):
    pages = live_pages(spark, sf_dir)
    history = sources.Staging(spark).bucketed(op.fold_history(edits(spark, sf_dir)), ["page_id", "wiki_db"])
    return plans.number_of_gender_article_by_month(articles_of(spark, sf_dir, history=history), pages, history)


@query(
    """WITH flagged AS (
      SELECT lang, NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS zero_ill FROM documents d)
    SELECT lang, count(*) FILTER (zero_ill) AS zero_ill_count, count(*) AS gender_count,
           count(*) FILTER (zero_ill) / count(*) * 100 AS zero_ill_ratio
    FROM flagged GROUP BY lang HAVING count(*) FILTER (zero_ill) > 0"""
)
def flag_ratio(spark, sf_dir):
    return op.flag_ratio(missing_flag(spark, sf_dir), "zero_ill", "lang")


@query(
    f"""WITH {ITEM}
    SELECT gender, gender_label, count(*) FILTER (zero_ill) AS zero_ill_count, count(*) AS gender_count,
           count(*) FILTER (zero_ill) / count(*) * 100 AS zero_ill_ratio
    FROM item WHERE is_human GROUP BY gender, gender_label HAVING count(*) FILTER (zero_ill) > 0"""
)
def gender_zero_ill(spark, sf_dir):
    return plans.number_of_gender_zero_ill(items_of(spark, sf_dir))


def dated_orders(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(
        wiki("o_orderstatus").alias("wiki_db"),
        F.col("o_orderpriority").alias("gender_label"),
        time_text("o_orderdate").alias("date_created"),
    )


SERIES = """series AS (
  SELECT lower(o_orderstatus) || 'wiki' AS wiki_db, strftime(o_orderdate, '%Y') AS year,
         strftime(o_orderdate, '%m') AS month, o_orderpriority AS gender_label, count(*) AS article_count,
         CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus, o_orderpriority
              ORDER BY strftime(o_orderdate, '%Y'), strftime(o_orderdate, '%m')) AS BIGINT) AS cumsum
  FROM orders GROUP BY o_orderstatus, strftime(o_orderdate, '%Y'), strftime(o_orderdate, '%m'), o_orderpriority)"""


@query(f"WITH {SERIES} SELECT * FROM series")
def monthly_cumulative(spark, sf_dir):
    return plans.number_of_gender_article(dated_orders(spark, sf_dir))


@query(f"WITH {SERIES} SELECT * FROM series WHERE wiki_db = 'fwiki' AND year = '1997' AND gender_label = '2-HIGH'")
def slice_metric(spark, sf_dir):
    return op.slice_metric(
        monthly_cumulative(spark, sf_dir), wiki_db="fwiki", year="1997", gender_label="2-HIGH"
    ).orderBy("month")


@query(
    """WITH sub AS (
      SELECT o_custkey, o_orderstatus, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS m FROM orders),
    whole AS (
      SELECT c_nationkey, y, m, count(*) AS c,
             sum(count(*)) OVER (PARTITION BY c_nationkey ORDER BY y, m) AS s
      FROM sub JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, y, m),
    part AS (
      SELECT c_nationkey, y, m, o_orderstatus, count(*) AS c,
             sum(count(*)) OVER (PARTITION BY c_nationkey, o_orderstatus ORDER BY y, m) AS s
      FROM sub JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'
      GROUP BY c_nationkey, y, m, o_orderstatus)
    SELECT CAST(c_nationkey AS VARCHAR) AS wiki_db, y AS year, m AS month, o_orderstatus AS gender_label,
           CAST(p.c AS BIGINT) AS article_count, p.c / w.c * 100 AS monthly_article_ratio,
           CAST(p.s AS BIGINT) AS cumsum, p.s / w.s * 100 AS article_ratio
    FROM part p FULL JOIN whole w USING (c_nationkey, y, m)"""
)
def monthly_share(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    placed = (
        load(spark, sf_dir, "orders")
        .select("o_custkey", "o_orderstatus", "o_orderdate")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("c_nationkey").cast("string").alias("wiki_db"),
            F.col("o_orderstatus").alias("gender_label"),
            time_text("o_orderdate").alias("ts"),
            "c_mktsegment",
        )
    )
    totals = op.monthly_cumulative(placed, "ts", ["wiki_db"], "wp_count", "wp_cumsum")
    subset = placed.where(F.col("c_mktsegment") == "BUILDING")
    return op.monthly_share(subset, totals, "ts", ["gender_label"])


@query(
    f"""WITH {SERIES}, total AS (
      SELECT wiki_db, year, month, CAST(sum(article_count) AS BIGINT) AS wp_count,
             CAST(sum(sum(article_count)) OVER (PARTITION BY wiki_db ORDER BY year, month) AS BIGINT) AS wp_cumsum
      FROM series GROUP BY wiki_db, year, month)
    SELECT *, round(article_count / wp_count * 100, 3) AS monthly_pct, round(cumsum / wp_cumsum * 100, 3) AS accumulated_pct
    FROM series JOIN total USING (wiki_db, year, month)"""
)
def monthly_pct(spark, sf_dir):
    orders = dated_orders(spark, sf_dir)
    return op.monthly_pct(op.monthly_cumulative(orders), op.monthly_cumulative(orders, keys=["wiki_db"]))


# --- categories ----------------------------------------------------------------------------


@query(
    f"""WITH {CLAIM}, {PIVOT}, {LABEL}
    SELECT gender, count(*) AS count, label FROM pivoted JOIN label ON gender = id WHERE is_human GROUP BY gender, label"""
)
def category_counts(spark, sf_dir):
    entities = entity_table(spark, sf_dir)
    items = op.append_features(
        people(spark, sf_dir).select(F.col("id").alias("qitem_id")),
        op.explode_claims(entities).withColumnRenamed("id", "qitem_id"),
        flags={"is_human": ("P31", "Q5")},
        values={"gender": "P21"},
    )
    return op.category_counts(op.biographies(items), "gender", op.labels_in(entities), stage=sources.staged)


@query(
    f"""WITH {CLAIM}, item AS (
      SELECT 'C' || c_custkey AS id FROM customer UNION ALL SELECT 'N' || n_nationkey FROM nation)
    SELECT id AS qitem_id, coalesce(bool_or(property = 'P31' AND value LIKE '%"id":"Q5"%'), false) AS is_human,
           json_extract_string(max(CASE WHEN property = 'P21' THEN value END), '$.id') AS gender,
           json_extract_string(max(CASE WHEN property = 'P91' THEN value END), '$.id') AS sexual_orientation
    FROM item LEFT JOIN claim USING (id) GROUP BY id"""
)
def described_items(spark, sf_dir):
    return base_of(spark, sf_dir).described_items("2021-08-02")


@query(
    f"""WITH {CLAIM}, {LABEL},
    valued AS (SELECT id AS qitem_id, json_extract_string(value, '$.id') AS value FROM claim WHERE property = 'P21'),
    several AS (SELECT qitem_id, count(value) AS count FROM valued GROUP BY qitem_id HAVING count(value) > 1)
    SELECT qitem_id, count, value, label, count(*) AS times
    FROM valued JOIN several USING (qitem_id) LEFT JOIN label ON value = id
    WHERE value IS NOT NULL GROUP BY ALL"""
)
def several_genders(spark, sf_dir):
    base = base_of(spark, sf_dir)
    return op.multi_valued(base.properties("2021-08-02"), "P21", base.labels("2021-08-02"))


VALUES = f"""{PROPERTY}, {NATION_LABEL},
valued AS (
  SELECT qitem_id, json_extract_string(value, '$.id') AS value FROM prop WHERE property = 'purchase'),
several AS (SELECT qitem_id, count(value) AS count FROM valued GROUP BY qitem_id HAVING count(value) > 1)"""


@query(
    f"""WITH {VALUES}
    SELECT qitem_id, count, value, label, count(*) AS times
    FROM valued JOIN several USING (qitem_id) LEFT JOIN nation_label ON value = id GROUP BY ALL"""
)
def multi_valued(spark, sf_dir):
    return purchases(spark, sf_dir)


def purchases(spark, sf_dir, ordered=True):
    return op.multi_valued(
        property_frame(spark, sf_dir), "purchase", nation_labels(spark, sf_dir), stage=sources.staged, ordered=ordered
    )


@query(
    f"""WITH {VALUES}, per_value AS (
      SELECT qitem_id, count, value, coalesce(label, '?') AS label, count(*) AS times
      FROM valued JOIN several USING (qitem_id) LEFT JOIN nation_label ON value = id GROUP BY ALL)
    SELECT qitem_id, count, string_agg(value, ',' ORDER BY value) AS ids, string_agg(label, ',' ORDER BY value) AS names,
           string_agg(CAST(times AS VARCHAR), ',' ORDER BY value) AS times
    FROM per_value GROUP BY qitem_id, count"""
)
def value_lists(spark, sf_dir):
    lists = op.value_lists(purchases(spark, sf_dir, ordered=False))
    names = F.transform("label_list", lambda x: F.coalesce(x, F.lit("?")))
    return lists.select(
        "qitem_id",
        "count",
        F.array_join("value_list", ",").alias("ids"),
        F.array_join(names, ",").alias("names"),
        F.array_join(F.col("times_list").cast("array<string>"), ",").alias("times"),
    )


@query(
    f"""WITH {VALUES}
    SELECT qitem_id, count, string_agg(value, ',' ORDER BY value) AS ids,
           string_agg(coalesce(label, '?'), ',' ORDER BY value) AS names
    FROM valued JOIN several USING (qitem_id) LEFT JOIN nation_label ON value = id
    WHERE value IS NOT NULL GROUP BY qitem_id, count"""
)
def value_lists_spelled(spark, sf_dir):
    """Every value as often as the item has it."""
    lists = op.value_lists(purchases(spark, sf_dir, ordered=False))
    names = F.transform("label_list", lambda x: F.coalesce(x, F.lit("?")))
    return lists.select(
        "qitem_id",
        "count",
        F.array_join(fn.spelled_out("value_list", "times_list"), ",").alias("ids"),
        F.array_join(fn.spelled_out(names, "times_list"), ",").alias("names"),
    )


@query(
    f"""WITH {NATION_LABEL}
    SELECT vec_id, CASE WHEN vec_id % 5 <> 0 THEN coalesce(names, '') END AS names
    FROM embeddings LEFT JOIN (
      SELECT vec_id, string_agg(coalesce(n.label, '?'), ',' ORDER BY pos) AS names
      FROM (SELECT vec_id, unnest(['K' || label, 'K' || (label + 20), 'K' || label]) AS id, unnest([1, 2, 3]) AS pos
            FROM embeddings) e
      LEFT JOIN nation_label n USING (id) WHERE pos < vec_id % 5 GROUP BY vec_id) USING (vec_id)"""
)
def label_list(spark, sf_dir):
    ids = F.array(*[F.concat(F.lit("K"), c) for c in (F.col("label"), F.col("label") + 20, F.col("label"))])
    some = F.when(F.col("vec_id") % 5 != 0, F.slice(ids, 1, (F.col("vec_id") % 5 - 1).cast("int")))  # null, empty, 1 to 3
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", some.alias("ids"))
    listed = op.label_list(vectors, "ids", nation_labels(spark, sf_dir))
    names = F.transform("labels", lambda x: F.coalesce(x, F.lit("?")))
    return listed.select("vec_id", F.array_join(names, ",").alias("names"))


@query(
    """SELECT c_nationkey, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey
    GROUP BY c_nationkey ORDER BY orders DESC, c_nationkey LIMIT 10"""
)
def top_k(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = load(spark, sf_dir, "orders").select("o_custkey")
    counted = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(F.count("*").alias("orders"))
    )
    return op.top_k(counted, "orders", 10, ["c_nationkey"])


@query(
    """SELECT count(*) AS rows, count(*) FILTER (quality IS NULL) AS quality_nulls,
           count(*) FILTER (toxic IS NULL) AS toxic_nulls,
           count(DISTINCT lang) AS lang_distinct,
           count(DISTINCT quality) + max(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) AS quality_distinct,
           count(*) FILTER (good) AS good_true, count(*) FILTER (NOT good) AS good_false
    FROM (SELECT *, quality = 1 AS good FROM documents LEFT JOIN labels USING (doc_id))"""
)
def profile(spark, sf_dir):
    documents = load(spark, sf_dir, "documents").select("doc_id", "lang")
    joined = documents.join(load(spark, sf_dir, "labels"), "doc_id", "left").withColumn("good", F.col("quality") == 1)
    return op.profile(joined, ["quality", "toxic"], ["lang", "quality"], ["good"])


STATS = """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS "25%",
  round(quantile_cont({c}, 0.5), 6) AS "50%", round(quantile_cont({c}, 0.75), 6) AS "75%", max({c}) AS max
  FROM lineitem"""
STATS_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount")


@query("\nUNION ALL\n".join(STATS.format(c=c) for c in STATS_COLUMNS))
def summary_stats(spark, sf_dir):
    stats = op.summary_stats(load(spark, sf_dir, "lineitem"), STATS_COLUMNS)
    rounded = ["mean", "std", "25%", "50%", "75%"]
    return stats.withColumns({c: F.round(F.col(f"`{c}`"), 6) for c in rounded})


# --- logs ----------------------------------------------------------------------------------


@query(
    """SELECT lower(o_orderstatus) || 'wiki' AS wiki, o_orderkey AS total_article,
           CASE WHEN o_orderstatus <> 'O' THEN o_custkey END AS ccc_groundtruth,
           CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS ccc_groundtruth_p,
           o_custkey AS test_article, o_orderkey AS predict_positive, CAST(15.5 AS DOUBLE) AS predict_positive_p,
           o_totalprice AS ccc_final_p
    FROM orders WHERE o_orderpriority <> '5-LOW'"""
)
def log_counts(spark, sf_dir):
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    truth = F.concat(F.lit("\nThere were already "), "o_custkey", F.lit(" articles ("), price, F.lit("%)"))
    lines = [
        F.concat(wiki("o_orderstatus"), F.lit(" has "), "o_orderkey", F.lit(" articles")),
        F.when(F.col("o_orderstatus") != "O", truth).otherwise(""),
        F.concat(F.lit("\nThis algorithm CLASSIFIED "), "o_orderkey", F.lit(" of 50 from "), "o_custkey"),
        F.lit(" (15.5%)\na line of noise"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("\nWith this: "), price)).otherwise(""),
    ]
    return op.parse_selection_log(load(spark, sf_dir, "orders").select(F.concat(*lines).alias("block")))


@query(
    """SELECT lower(o_orderstatus) || 'wiki' AS wiki, o_orderkey + block AS total_article, o_custkey AS ccc_groundtruth,
           CAST(2.5 AS DOUBLE) AS ccc_groundtruth_p, CAST(7 AS BIGINT) AS test_article, o_custkey AS predict_positive,
           CAST(15.5 AS DOUBLE) AS predict_positive_p, CAST(9.25 AS DOUBLE) AS ccc_final_p
    FROM orders, (VALUES (0), (1), (2)) blocks(block)"""
)
def log_blocks(spark, sf_dir):
    """One log of three blocks per order, taken apart: lines that only begin like the marker part no block."""

    def block(k):
        return [
            F.lit("\nThis Wikipedia "), wiki("o_orderstatus"), F.lit(" has "), F.col("o_orderkey") + k, F.lit(" articles"),
            F.lit("\nThis Wikipedias list is long\nThis Wikipedia: no\nThere were already "), "o_custkey", F.lit(" (2.5%)"),
            F.lit("\nThis Wikipedi\nThis algorithm CLASSIFIED "), "o_custkey", F.lit(" of 50 from 7 (15.5%)"),
            F.lit("\nnoise\nWith this: 9.25"),
        ]

    lines = [F.lit("With no block\nThis Wikipedian"), *block(0), *block(1), *block(2)]
    logs = load(spark, sf_dir, "orders").select(F.concat(*lines).alias("log"))
    return op.parse_selection_log(op.split_blocks(logs, "log", SELECTION_BLOCK))


@query(
    """SELECT lower(o_orderstatus) || 'wiki' AS wiki, o_orderkey AS total_article, o_custkey AS ccc_groundtruth,
           CAST(2.5 AS DOUBLE) AS ccc_groundtruth_p, CAST(7 AS BIGINT) AS test_article, o_custkey AS predict_positive,
           CAST(15.5 AS DOUBLE) AS predict_positive_p, o_totalprice AS ccc_final_p
    FROM orders"""
)
def log_files(spark, sf_dir):
    """Logs as text files, read block by block; what stands before the first block is no block."""
    path = place(spark).new_path()
    lines = [
        F.lit("This Wikipedia "), wiki("o_orderstatus"), F.lit(" has "), "o_orderkey", F.lit(" articles"),
        F.lit("\nThis Wikipedias list is long\nThere were already "), "o_custkey", F.lit(" (2.5%)"),
        F.lit("\nThis algorithm CLASSIFIED "), "o_custkey", F.lit(" of 50 from 7 (15.5%)\nWith this: "),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
    ]
    load(spark, sf_dir, "orders").select(F.concat(*lines)).write.text(f"{path}/blocks")
    load(spark, sf_dir, "region").select(F.concat(F.lit("no block: "), "r_name")).write.text(f"{path}/rest")
    return op.parse_selection_log(sources.read_log_blocks(spark, f"{path}/*", SELECTION_BLOCK))


@query(
    "SELECT 'l' || label || 'wiki' AS wiki, CAST(label + 0.25 AS DOUBLE) AS fit_score, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate(CLASSIFIER_FEATURES))
    + " FROM embeddings"
)
def log_weights(spark, sf_dir):
    block = F.concat(
        F.lit("l"),
        "label",
        F.lit("-x\na line of noise\nThe fit has a score of: "),
        "label",
        F.lit(".25\n"),
        F.to_json(F.col("embedding").cast("array<double>")),
        F.lit("\nmore noise"),
    )
    return op.parse_fit_log(load(spark, sf_dir, "embeddings").select(block.alias("block")))


# --- inference -----------------------------------------------------------------------------


@query(
    """WITH box AS (
      SELECT o_orderkey, l_extendedprice / o_totalprice AS share FROM orders JOIN lineitem ON o_orderkey = l_orderkey
      WHERE l_returnflag = 'R')
    SELECT o_orderkey, CAST(count(*) AS INTEGER) AS count, max(share) AS max, round(sum(share), 6) AS sum
    FROM box GROUP BY o_orderkey"""
)
def detect_json(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_returnflag")
    share = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice") / F.col("o_totalprice"))
    faces = (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_orderkey")
        .agg(F.count(share).alias("count"), F.max(share).alias("max"), F.sum(share).alias("sum"))
        .select("o_orderkey", F.when(F.col("count") > 0, F.to_json(F.struct("count", "max", "sum"))).alias("faces"))
    )
    found = op.explode_json(faces, "faces", "array<struct<count:int,max:double,sum:double>>")
    return found.select("o_orderkey", "data.count", "data.max", F.round("data.sum", 6).alias("sum"))


def base64_of(c):
    """Base64 of a text, on one line."""
    return F.replace(F.base64(F.encode(c, "UTF-8")), F.lit("\r\n"), F.lit(""))


def text_images(spark, sf_dir):
    """Documents as base64 images; those in French cannot be decoded."""
    encoded = base64_of("text")
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("i"),
        F.concat("source", F.lit("-"), "doc_id").alias("image_file_name"),
        F.when(F.col("lang") == "fr", F.concat(F.lit("*"), encoded)).otherwise(encoded).alias("b64"),
        F.concat(F.lit("https://example.org/"), "doc_id").alias("image_url"),
    )


def as_strip(content):
    return np.frombuffer(content, dtype=np.uint8).reshape(1, -1)


def make_line_detector():
    def long_lines(strip):
        """A box for every line of more than 200 bytes."""
        breaks = np.flatnonzero(strip[0] == 10)
        starts = np.concatenate([[0], breaks + 1])
        ends = np.concatenate([breaks, [strip.shape[1]]])
        return [
            {"x1": float(a), "x2": float(b), "y1": 0.0, "y2": 1.0} for a, b in zip(starts, ends) if b - a > 200
        ]

    return long_lines


DETECTED = """detected AS (
  SELECT *, CASE WHEN lang = 'fr' THEN -1 ELSE len(lens) END AS c,
         CASE WHEN lang = 'fr' THEN -1.0 ELSE list_max(lens) / n END AS m,
         CASE WHEN lang = 'fr' THEN -1.0 ELSE list_sum(lens) / n END AS s
  FROM (SELECT *, octet_length(encode(text)) AS n,
               list_filter(list_transform(string_split(text, chr(10)), lambda x: octet_length(encode(x))),
                           lambda x: x > 200) AS lens
        FROM documents)
  WHERE lang = 'fr' OR len(lens) > 0)"""


@query(
    f"""WITH {DETECTED}
    SELECT doc_id AS i, source || '-' || doc_id AS image_file_name, CAST(c AS INTEGER) AS count,
           round(m, 6) AS max, round(s, 6) AS sum, 'https://example.org/' || doc_id AS image_url FROM detected"""
)
def detect_summary(spark, sf_dir):
    found = plans.detection_job(text_images(spark, sf_dir), as_strip, make_line_detector, "b64")
    return found.withColumns({c: F.round(c, 6) for c in ("max", "sum")})


@query(
    f"""WITH {DETECTED}
    SELECT source || '-' || doc_id AS image_file_name, CAST(c AS INTEGER) AS count, round(m, 6) AS max,
           round(s, 6) AS sum, '<img src="data:image/png;base64,' || CASE WHEN lang = 'fr' THEN '*' ELSE '' END
           || to_base64(encode(text)) || '">' AS thumbnail FROM detected"""
)
def thumbnail_job(spark, sf_dir):
    found = plans.with_thumbnail(text_images(spark, sf_dir), as_strip, make_line_detector, "b64")
    return found.withColumns({c: F.round(c, 6) for c in ("max", "sum")})


@query("""SELECT page_id, '<img src="data:image/png;base64,' || to_base64(encode(url)) || '">' AS thumbnail FROM pages""")
def thumbnail(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", fn.html_image(base64_of("url")).alias("thumbnail"))


def byte_counts(content, size):
    """Bytes, blanks and line breaks of a text, in the first cell of an otherwise empty image."""
    image = np.zeros((size, size, 3), dtype=np.float32)
    image[0, 0] = len(content), content.count(b" "), content.count(b"\n")
    return image


def make_max_pool():
    return lambda images: images.max(axis=(1, 2))


@query(
    """SELECT doc_id AS i, source || '-' || doc_id AS image_file_name, 'https://example.org/' || doc_id AS image_url,
           CASE WHEN lang = 'fr' THEN 0 ELSE octet_length(encode(text)) END AS bytes,
           CASE WHEN lang = 'fr' THEN 0 ELSE length(text) - length(replace(text, ' ', '')) END AS blanks,
           CASE WHEN lang = 'fr' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) END AS breaks
    FROM documents"""
)
def extract_features(spark, sf_dir):
    features = plans.feature_job(
        text_images(spark, sf_dir), byte_counts, make_max_pool, size=2, image="b64"
    )
    named = fn.named_elements("features", ["bytes", "blanks", "breaks"])
    return features.select("i", "image_file_name", "image_url", *named).withColumns(
        {c: F.col(c).cast("bigint") for c in ("bytes", "blanks", "breaks")}
    )


@query(
    """SELECT doc_id AS i, octet_length(encode(text)) AS bytes,
           CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS blanks,
           CAST(length(text) - length(replace(text, chr(10), '')) AS DOUBLE) AS breaks, 9 AS empty, 12 AS cells
    FROM documents"""
)
def decode_images(spark, sf_dir):
    contents = load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("i"), F.encode("text", "UTF-8").alias("content")
    )
    decoded = op.decode_images(contents, "content", byte_counts, 2)
    return decoded.select(
        "i",
        fn.element("image_arr", 0).cast("bigint").alias("bytes"),
        fn.element("image_arr", 1).cast("double").alias("blanks"),
        fn.element("image_arr", 2).cast("double").alias("breaks"),
        F.size(F.filter(F.slice("image_arr", 4, 99), lambda x: x == 0)).alias("empty"),
        F.size("image_arr").alias("cells"),
    )


def tag_brightness(content, size):
    """An even image, the brighter the more tags a page has."""
    return np.full((size, size, 3), min(content.count(b"<"), 255), dtype=np.float32)


def make_mean():
    return lambda images: images.mean(axis=(1, 2, 3))[:, None]


@query(
    """SELECT url AS image_file_name,
           CASE WHEN least(length(html) - length(replace(html, '<', '')), 255) * 2 / 255 - 1 > -0.55
                THEN 'Quality' ELSE 'Random' END AS pred_label
    FROM pages"""
)
def classify_images(spark, sf_dir):
    images = load(spark, sf_dir, "pages").select(
        F.col("url").alias("image_file_name"), F.encode("html", "UTF-8").alias("image_bytes")
    )
    return plans.classify_images(
        images, tag_brightness, make_mean, size=2, threshold=-0.55, keep=["image_file_name"]
    )


@query(
    """SELECT source || '-' || doc_id AS image_file_name, CAST(doc_id % 2 AS INTEGER) AS label,
           octet_length(encode(text)) AS bytes, md5(text) AS digest
    FROM documents"""
)
def image_records(spark, sf_dir):
    """Images written as records with checksums and read in ranges of files, with their schema."""
    path = place(spark).new_path()
    images = load(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("-"), "doc_id").alias("image_file_name"),
        F.encode("text", "UTF-8").alias("image_bytes"),
        (F.col("doc_id") % 2).cast("int").alias("label"),
    )
    sources.write_images(images, path, "tfrecord")
    read = sources.read_images(spark, path, "tfrecord", sources.files.LABELLED_IMAGE, splitBytes=str(1 << 20))
    size = F.octet_length("image_bytes").cast("bigint").alias("bytes")
    return read.select("image_file_name", "label", size, F.md5("image_bytes").alias("digest"))


def must_be_even(content):
    if len(content) % 2:
        raise ValueError("an odd number of bytes")
    return np.frombuffer(content, np.uint8)


@query(
    """WITH file AS (
      SELECT lang, doc_id % 50 AS part, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS bytes
      FROM documents GROUP BY ALL)
    SELECT CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS label, bytes % 2 = 0 AS readable,
           count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes
    FROM file GROUP BY lang, bytes % 2 = 0"""
)
def ingested_images(spark, sf_dir):
    """Folders of files, one folder a label; those that cannot be decoded are counted."""
    path = place(spark).new_path()
    documents = load(spark, sf_dir, "documents").select(
        F.coalesce("text", F.lit("")).alias("text"), "lang", (F.col("doc_id") % 50).alias("part")
    )
    documents.repartition("lang", "part").write.partitionBy("lang", "part").text(path)
    langs = [r["lang"] for r in documents.select("lang").distinct().orderBy("lang").collect()]
    folders = {f"{path}/lang={lang}": label for label, lang in enumerate(langs)}
    images = sources.ingest_images(spark, folders, must_be_even, pattern="*.txt", keep_unreadable=True)
    size = F.octet_length("image_bytes")
    return images.groupBy("label", "readable").agg(F.count("*").alias("files"), F.sum(size).cast("bigint").alias("bytes"))


def make_linear():
    weights = (np.arange(64) % 7 - 3) / 10.0
    return lambda batch: (batch.astype(np.float64) @ weights)[:, None]


@query(
    """SELECT vec_id, CASE WHEN list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * (((i - 1) % 7) - 3) / 10.0)) > 0
           THEN 'Quality' ELSE 'Random' END AS pred_label
    FROM embeddings"""
)
def batch_predict(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    predicted = op.predict(vectors, "embedding", make_linear, [64])
    label = fn.threshold_label("prediction", 0.0, "Quality", "Random")
    return predicted.select("vec_id", label.alias("pred_label"))


@query(
    """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 2 / 255 - 1)), 6) AS total
    FROM embeddings"""
)
def normalize_pixels(spark, sf_dir):
    pixels = fn.normalize_pixels("embedding")
    total = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x)
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(total, 6).alias("total"))
