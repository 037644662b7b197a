"""The test tables seen as sales, order lines, products and labelled records.

Every view covers its whole table. Defects (missing prices, unknown sites, returns) and product states are
planted by arithmetic on keys so that both engines see the same ones; no row is left out for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import scaled
from ..operators.baskets import DISCONTINUED_CATEGORY, LineColumns
from ..sources.files import read_table

LINES = LineColumns()

SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}

SALES = """sales as (
  select l_partkey as article_id,
    case when l_orderkey % 71 = 0 then -1 else l_suppkey end as site_id,
    case when l_orderkey % 71 = 0 then 99 else s_nationkey end as zone_id,
    cast(l_shipdate as date) as day,
    case when l_returnflag = 'R' and l_linenumber = 1 then -l_quantity else l_quantity end as quantity,
    case when l_orderkey % 97 = 0 then null
         else cast(floor(l_extendedprice / l_quantity * 100 + 0.5) as bigint) end as price,
    case when l_orderkey % 89 = 0 then null
         else cast(floor(p_retailprice * (1 + l_tax) * 100 + 0.5) as bigint) end as cost_price
  from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey)"""

MONTHLY = SALES + """, monthly as (
  select article_id, site_id, zone_id, cast(date_trunc('month', day) as date) as day, quantity, price, cost_price
  from sales)"""

SITES = """sites as (select s_suppkey as site_id, s_nationkey as site_zone_id, s_name as site_name from supplier)"""

ORDER_LINES = """order_lines as (
  select o_custkey as customer_id, o_orderkey as order_id, cast(o_orderdate as date) as day,
    l_partkey as product_id, cast(l_quantity as bigint) as amount
  from lineitem join orders on o_orderkey = l_orderkey)"""

PRODUCTS = """products as (
  select p_partkey as product_id,
    case when p_partkey % 53 = 0 or p_partkey % 37 = 0 then null
         else cast(case p_type when 'ECONOMY' then 1 when 'LARGE' then 2 when 'MEDIUM' then 3
                               when 'PROMO' then 4 when 'SMALL' then 5 else 6 end as bigint) end as category_id,
    case when p_partkey % 53 = 0 or p_partkey % 37 = 0 then null else p_name end as name,
    case when p_partkey % 53 = 0 then 'error' when p_partkey % 37 = 0 then 'not_found' else 'ok' end as status
  from part)"""

CATEGORISED = ORDER_LINES + ", " + PRODUCTS + f""", lines as (
  select order_lines.*, case when status = 'not_found' then {DISCONTINUED_CATEGORY} else category_id end as category_id
  from order_lines left join products using (product_id)
  where status is distinct from 'error')"""

BASKET = CATEGORISED + """, basket as (
  select customer_id, order_id, category_id, cast(sum(amount) as bigint) as amount
  from lines where category_id is not null group by all)"""

SEQUENCE = BASKET + """, sequence as (
  select customer_id, order_id, day, row_number() over (partition by customer_id order by day, order_id) as seq,
    count(*) over (partition by customer_id) as n
  from (select customer_id, order_id, min(day) as day from lines group by all))"""

RECORDS = """records as (
  select doc_id as record_id, lang, source, text, case when doc_id % 11 = 0 then null else n_chars end as n_chars,
    quality, toxic, cast(doc_id * 7919 % 1000 as double) / 1000.0 as score
  from documents left join labels using (doc_id)),
  train as (select * from records where quality is not null),
  unlabelled as (select * from records where quality is null)"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, folder, name, SCHEMAS[name])


def sales(spark: SparkSession, folder: str, lineitem: DataFrame | None = None) -> DataFrame:
    lost = F.col("l_orderkey") % 71 == 0
    returned = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)
    cents = scaled(F.col("l_extendedprice") / F.col("l_quantity"), 2)
    cost = scaled(F.col("p_retailprice") * (1 + F.col("l_tax")), 2)
    lineitem = table(spark, folder, "lineitem") if lineitem is None else lineitem
    return (
        lineitem.join(table(spark, folder, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
        .join(table(spark, folder, "part"), F.col("p_partkey") == F.col("l_partkey"))
        .select(
            F.col("l_partkey").alias("article_id"),
            F.when(lost, F.lit(-1).cast("bigint")).otherwise(F.col("l_suppkey")).alias("site_id"),
            F.when(lost, 99).otherwise(F.col("s_nationkey")).alias("zone_id"),
            F.to_date("l_shipdate").alias("day"),
            F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"),
            F.when(F.col("l_orderkey") % 97 != 0, cents).alias("price"),
            F.when(F.col("l_orderkey") % 89 != 0, cost).alias("cost_price"),
        )
    )


def monthly(spark: SparkSession, folder: str) -> DataFrame:
    """Sales with the day cut to its month, where keys repeat often."""
    return sales(spark, folder).withColumn("day", F.trunc("day", "month"))


def sites(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("site_id"), F.col("s_nationkey").alias("site_zone_id"), F.col("s_name").alias("site_name")
    )


def articles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("article_id"), F.col("p_name").alias("article_name"))


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
        .select(
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderkey").alias("order_id"),
            F.to_date("o_orderdate").alias("day"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("bigint").alias("amount"),
        )
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    error = F.col("p_partkey") % 53 == 0
    gone = F.col("p_partkey") % 37 == 0
    kinds = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"]
    category = F.lit(6)
    for number, kind in reversed(list(enumerate(kinds, 1))):
        category = F.when(F.col("p_type") == kind, number).otherwise(category)
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.when(~(error | gone), category.cast("bigint")).alias("category_id"),
        F.when(~(error | gone), F.col("p_name")).alias("name"),
        F.when(error, "error").when(gone, "not_found").otherwise("ok").alias("status"),
    )


def records(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("record_id"),
        "lang",
        "source",
        "text",
        F.when(F.col("doc_id") % 11 != 0, F.col("n_chars")).alias("n_chars"),
        "quality",
        "toxic",
        ((F.col("doc_id") * 7919 % 1000).cast("double") / 1000.0).alias("score"),
    )


def train(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).where(F.col("quality").isNotNull())


def unlabelled(spark: SparkSession, folder: str) -> DataFrame:
    return records(spark, folder).where(F.col("quality").isNull())
