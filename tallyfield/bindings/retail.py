"""Sales checks and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins as J
from ..operators import profiles as P
from ..operators import quality as Q
from ..operators.ordering import number_rows
from ..plans.audit import audit_report
from .registry import query
from .tables import MONTHLY, SALES, SITES, articles, monthly, sales, sites, table

KEYS = ["article_id", "site_id", "zone_id", "day"]


def m6(x: str) -> str:
    return f"cast(floor(({x}) * 1e6 + 0.5) as bigint)"


# --- scalar functions -------------------------------------------------------------------------------


@query("select_present_columns", "select l_orderkey, l_partkey, l_quantity from lineitem")
def _(spark, d):
    return S.select_present(table(spark, d, "lineitem"), ["l_orderkey", "no_such_column", "l_partkey", "l_quantity"])


@query(
    "filter_rows",
    f"with {SALES} select article_id, site_id, quantity from sales where quantity > 10 and price is not null and site_id = 5",
)
def _(spark, d):
    rows = sales(spark, d).where((F.col("quantity") > 10) & F.col("price").isNotNull() & (F.col("site_id") == 5))
    return rows.select("article_id", "site_id", "quantity")


@query(
    "parse_dates",
    """with raw as (select case when event_id % 7 = 0 then 'junk' when event_id % 5 = 0 then '2019-02-30'
                               else strftime(ts, '%Y-%m-%d') end as t from events)
       select count(*) as rows, count(try_cast(t as date)) as parsed,
         count(case when try_cast(t as date) is null then 1 end) as failed,
         min(t) as first_text, max(t) as last_text, min(try_cast(t as date)) as first_day, max(try_cast(t as date)) as last_day
       from raw""",
)
def _(spark, d):
    e = table(spark, d, "events")
    text = (
        F.when(F.col("event_id") % 7 == 0, "junk").when(F.col("event_id") % 5 == 0, "2019-02-30")
        .otherwise(F.date_format("ts", "yyyy-MM-dd"))
    )
    return e.select(text.alias("t")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(S.parse_day("t")).alias("parsed"),
        F.count_if(S.is_unparsed_day("t")).alias("failed"),
        F.min("t").alias("first_text"),
        F.max("t").alias("last_text"),
        F.min(S.parse_day("t")).alias("first_day"),
        F.max(S.parse_day("t")).alias("last_day"),
    )


@query(
    "utc_order_days",
    """select event_id, case when event_id % 10 = 0 then null
         else cast(date_trunc('second', ts) - interval 1 hour as date) end as day from events""",
)
def _(spark, d):
    e = table(spark, d, "events")
    offset = F.when(F.col("event_id") % 10 == 0, "").when(F.col("event_id") % 2 == 0, "+0100").otherwise("+01:00")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250"), offset)
    return e.select("event_id", S.order_day(text).alias("day"))


@query(
    "fractional_values",
    """select coalesce(v % 1 <> 0, true) as fractional, count(*) as "count"
       from (select case when event_id % 9 = 0 then null when event_id % 4 = 0 then floor(value) else value end as v from events)
       group by 1""",
)
def _(spark, d):
    v = F.when(F.col("event_id") % 4 == 0, F.floor("value").cast("double")).otherwise(F.col("value"))
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 9 != 0, v).alias("v"))
    return e.groupBy(S.is_fractional("v").alias("fractional")).agg(F.count(F.lit(1)).alias("count"))


@query("integer_quantities", f'with {SALES} select quantity % 1 = 0 as is_integer, count(*) as "count" from sales group by 1')
def _(spark, d):
    return Q.integer_share(sales(spark, d), "quantity")


@query(
    "text_format",
    """select 'p_partkey' as "column", count(case when contains(cast(p_partkey as varchar), ' ') then 1 end) as with_space,
         count(case when contains(cast(p_partkey as varchar), '"') then 1 end) as with_quote from part
       union all select 'p_name', count(case when contains(p_name, ' ') then 1 end),
         count(case when contains(p_name, '"') then 1 end) from part""",
)
def _(spark, d):
    return Q.text_format(table(spark, d, "part"), ["p_partkey", "p_name"])


@query("margins", f"with {SALES} select article_id, day, price - cost_price as margin from sales")
def _(spark, d):
    return sales(spark, d).select("article_id", "day", S.difference("price", "cost_price").alias("margin"))


@query("family_sizes", "select l_orderkey, l_linenumber + cast(l_quantity as int) + 1 as family_size from lineitem")
def _(spark, d):
    size = S.family_size("l_linenumber", F.col("l_quantity").cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", size.alias("family_size"))


@query(
    "floor_bins",
    'select cast(floor(l_quantity / 15) * 15 as bigint) as bin, count(*) as "count" from lineitem group by 1',
)
def _(spark, d):
    rows = table(spark, d, "lineitem").select(S.floor_to("l_quantity", 15).cast("bigint").alias("bin"))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))


@query(
    "first_letters",
    """select coalesce(nullif(substr(v, 1, 1), ''), 'U') as letter, count(*) as "count"
       from (select case when c_custkey % 5 = 0 then null when c_custkey % 7 = 0 then '' else c_mktsegment end as v from customer)
       group by 1""",
)
def _(spark, d):
    v = F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_mktsegment"))
    c = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 5 != 0, v).alias("v"))
    return c.groupBy(S.first_letter("v").alias("letter")).agg(F.count(F.lit(1)).alias("count"))


@query(
    "title_words",
    r"select doc_id, nullif(regexp_extract(text, '([A-Za-z]+)\.', 1), '') as title from documents",
)
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", S.extract_first("text").alias("title"))


def listed(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query(
    "title_classes",
    rf"""with t as (select case when doc_id % 9 = 0 then 'Heron, Countess. Ida' when doc_id % 7 = 0 then 'Heron, Mlle. Ida'
                              when doc_id % 5 = 0 then 'Heron, Mrs. Ida' else text end as name from documents)
       select coalesce(case when w in {listed(S.RARE_TITLES)} then 'Rare'
                   when w in {listed(S.MISS_TITLES)} then 'Miss' else w end, 'none') as title, count(*) as "count"
       from (select nullif(regexp_extract(name, '([A-Za-z]+)\.', 1), '') as w from t) group by 1""",
)
def _(spark, d):
    i = F.col("doc_id")
    name = (
        F.when(i % 9 == 0, "Heron, Countess. Ida").when(i % 7 == 0, "Heron, Mlle. Ida")
        .when(i % 5 == 0, "Heron, Mrs. Ida").otherwise(F.col("text"))
    )
    titles = table(spark, d, "documents").select(S.fill(S.title_class(name), "none").alias("title"))
    return titles.groupBy("title").agg(F.count(F.lit(1)).alias("count"))


@query("fill_missing", f"with {SALES} select article_id, day, coalesce(price, 0) as price from sales")
def _(spark, d):
    return sales(spark, d).select("article_id", "day", S.fill("price", 0).alias("price"))


@query(
    "calendar_parts",
    """select o_orderkey, cast(month(o_orderdate) as int) as month, cast(isodow(o_orderdate) - 1 as int) as day_of_week from orders""",
)
def _(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", S.month_of(day).alias("month"), S.weekday_of(day).alias("day_of_week")
    )


@query("whole_amounts", f"with {SALES} select article_id, cast(sum(coalesce(trunc(price / 100.0), 0)) as bigint) as units from sales group by 1")
def _(spark, d):
    units = S.whole(F.col("price") / 100.0)
    return sales(spark, d).select("article_id", units.alias("u")).groupBy("article_id").agg(F.sum("u").alias("units"))


@query(
    "type_audit",
    f"""with {SALES}, s as (select *, strftime(day, '%Y-%m-%d') as day_text, price / 100.0 as price_units from sales)
       select 'quantity' as "column", 'double' as stored, 'bigint' as would_fit, count(quantity) as "values",
         count(case when quantity % 1 = 0 then 1 end) as fitting, true as flagged from s
       union all select 'price_units', 'double', 'bigint', count(price_units), count(case when price_units % 1 = 0 then 1 end), false from s
       union all select 'day_text', 'string', 'date', count(day_text), count(try_cast(day_text as date)), true from s""",
)
def _(spark, d):
    s = sales(spark, d).withColumn("day_text", F.date_format("day", "yyyy-MM-dd"))
    return P.type_audit(s.withColumn("price_units", F.col("price") / 100.0))


@query(
    "display_labels",
    "select p_partkey, p_name || ' [' || p_partkey || ']' as label from part",
)
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", S.product_label("p_name", "p_partkey").alias("label"))


@query(
    "share_of_table",
    f"""with {SALES} select count(case when quantity <= 0 then 1 end) as violations,
      {m6("count(case when quantity <= 0 then 1 end) * 100.0 / count(*)")} as pct_e6,
      min(case when quantity <= 0 then day end) as first_day, max(case when quantity <= 0 then day end) as last_day from sales""",
)
def _(spark, d):
    f = Q.finding(sales(spark, d), F.col("quantity") <= 0, "day")
    return f.select("violations", S.scaled(F.col("pct")).alias("pct_e6"), "first_day", "last_day")


# --- joins ------------------------------------------------------------------------------------------


@query(
    "lookup_names",
    f"""with {SALES} select article_id, p_name as article_name, site_id, s_name as site_name, quantity
       from sales left join part on p_partkey = article_id left join supplier on s_suppkey = site_id""",
)
def _(spark, d):
    s = J.lookup(sales(spark, d), articles(spark, d), "article_id", "article_id", {"article_name": "article_name"})
    s = J.lookup(s, sites(spark, d), "site_id", "site_id", {"site_name": "site_name"})
    return s.select("article_id", "article_name", "site_id", "site_name", "quantity")


@query("orphan_rows", f"with {SALES} select article_id, site_id, zone_id, day from sales where site_id not in (select s_suppkey from supplier)")
def _(spark, d):
    return Q.orphan_sites(sales(spark, d), sites(spark, d)).select("article_id", "site_id", "zone_id", "day")


@query("unsold_articles", "select p_partkey as article_id, p_name as article_name from part where p_partkey not in (select l_partkey from lineitem)")
def _(spark, d):
    return J.orphans(articles(spark, d), table(spark, d, "lineitem"), "article_id", "l_partkey")


@query("orders_without_lines", "select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return J.orphans(o, table(spark, d, "lineitem"), "o_orderkey", "l_orderkey")


@query(
    "map_values",
    f"with {SALES} select article_id, site_id, s_nationkey as home_zone from sales left join supplier on s_suppkey = site_id",
)
def _(spark, d):
    out = J.map_values(sales(spark, d), sites(spark, d), "site_id", "site_id", "site_zone_id", "home_zone")
    return out.select("article_id", "site_id", "home_zone")


@query(
    "zone_mismatches",
    f"""with {SALES} select article_id, site_id, zone_id, s_nationkey as expected from sales
       left join supplier on s_suppkey = site_id where zone_id is distinct from s_nationkey""",
)
def _(spark, d):
    return Q.zone_mismatches(sales(spark, d), sites(spark, d)).select("article_id", "site_id", "zone_id", "expected")


@query(
    "union_by_name",
    """select s_suppkey as id, s_name as name, s_acctbal as balance, cast(null as varchar) as segment from supplier
       union all select c_custkey, c_name, c_acctbal, c_mktsegment from customer""",
)
def _(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")
    )
    return J.union_all(s, c)


@query(
    "key_difference",
    """select distinct c_custkey as customer_id, c_nationkey as nation_id from customer
       where (c_custkey, c_nationkey) not in (select s_suppkey, s_nationkey from supplier)""",
)
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("nation_id"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("customer_id"), F.col("s_nationkey").alias("nation_id"))
    return J.key_difference(c, s, ["customer_id", "nation_id"])


@query(
    "first_row_per_key",
    """select o_custkey, o_orderkey, o_totalprice from (
         select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as r from orders) where r = 1""",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return J.first_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "upsert_dimension",
    """select p_partkey as id, case when l_partkey is null then p_name else 'sold ' || p_name end as name from part
       left join (select distinct l_partkey from lineitem) on l_partkey = p_partkey""",
)
def _(spark, d):
    old = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    sold = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id")).distinct()
    new = old.join(sold, "id", "left_semi").withColumn("name", F.concat(F.lit("sold "), F.col("name")))
    return J.upsert(old, new, ["id"])


# --- aggregations -----------------------------------------------------------------------------------


@query(
    "price_stats",
    f"""with {SALES}, g as (
         select article_id, min(price) as "min", max(price) as "max", avg(price) as m, stddev_samp(price) as s, count(price) as "count"
         from sales group by 1)
       select article_id, p_name as article_name, "min", "max", {m6("m / 1e4")} as mean_e2,
         cast(floor(s + 0.5) as bigint) as std, "count",
         row_number() over (order by "max" desc, article_id) as place
       from g left join part on p_partkey = article_id""",
)
def _(spark, d):
    g = P.group_stats(sales(spark, d), ["article_id"], "price")
    g = J.lookup(g, articles(spark, d), "article_id", "article_id", {"article_name": "article_name"})
    g = number_rows(g, [], [F.desc("max"), F.col("article_id")], "place", None)
    return g.select(
        "article_id", "article_name", "min", "max", S.scaled(F.col("mean") / 1e4).alias("mean_e2"),
        S.scaled(F.col("std"), 0).alias("std"), "count", "place",
    )


DESCRIBED = ["quantity", "price", "cost_price"]


@query(
    "describe_columns",
    f"with {SALES} "
    + " union all ".join(
        f"""select '{c}' as "column", count({c}) as "count", {m6(f"avg({c}) / 1e4")} as mean, {m6(f"stddev_samp({c}) / 1e4")} as std,
        cast(min({c}) as double) as "min", cast(quantile_cont({c}, 0.25) as double) as p25, cast(quantile_cont({c}, 0.5) as double) as p50,
        cast(quantile_cont({c}, 0.75) as double) as p75, cast(max({c}) as double) as "max" from sales"""
        for c in DESCRIBED
    ),
)
def _(spark, d):
    out = P.describe(sales(spark, d), DESCRIBED)
    return out.withColumns({k: S.scaled(F.col(k) / 1e4) for k in ("mean", "std")})


@query("value_counts", 'select l_returnflag, count(*) as "count" from lineitem group by 1')
def _(spark, d):
    return P.value_counts(table(spark, d, "lineitem"), "l_returnflag")


@query(
    "group_centers",
    f"""with {SALES} select zone_id, {m6("quantile_cont(price, 0.5) / 1e2")} as median, {m6("avg(price) / 1e2")} as mean from sales group by 1""",
)
def _(spark, d):
    out = P.group_center(sales(spark, d), ["zone_id"], "price")
    return out.select("zone_id", *[S.scaled(F.col(k) / 1e2).alias(k) for k in ("median", "mean")])


@query(
    "conflicting_costs",
    f"""with {MONTHLY} select article_id, site_id, zone_id, day, count(distinct cost_price) as n_values from monthly
       group by 1, 2, 3, 4 having count(distinct cost_price) > 1""",
)
def _(spark, d):
    return Q.conflicting_keys(monthly(spark, d), KEYS, "cost_price")


@query(
    "conflicting_prices",
    f"""with {MONTHLY} select article_id, site_id, zone_id, day, count(distinct price) as n_values from monthly
       group by 1, 2, 3, 4 having count(distinct price) > 1""",
)
def _(spark, d):
    return Q.conflicting_keys(monthly(spark, d), KEYS, "price")


@query(
    "zone_price_rule",
    f"""with {MONTHLY} select article_id, day, zone_id, count(distinct price) as n_values from monthly
       group by 1, 2, 3 having count(distinct price) > 1""",
)
def _(spark, d):
    return Q.conflicting_keys(monthly(spark, d), ["article_id", "day", "zone_id"], "price")


@query(
    "conflicting_cost_rows",
    f"""with {MONTHLY} select article_id, site_id, zone_id, day, cost_price, quantity from (
         select *, min(cost_price) over k as lo, max(cost_price) over k as hi from monthly
         window k as (partition by article_id, site_id, zone_id, day)) where lo < hi""",
)
def _(spark, d):
    return Q.conflicting_rows(monthly(spark, d), KEYS, "cost_price").select(*KEYS, "cost_price", "quantity")


@query(
    "prices_per_store_day",
    f"""with {SALES}, g as (select count(distinct price) as n from sales group by article_id, site_id, day)
       select count(n) as "count", {m6("avg(n)")} as mean, {m6("stddev_samp(n)")} as std, cast(min(n) as double) as "min",
         cast(quantile_cont(n, 0.25) as double) as p25, cast(quantile_cont(n, 0.5) as double) as p50,
         cast(quantile_cont(n, 0.75) as double) as p75, cast(max(n) as double) as "max" from g""",
)
def _(spark, d):
    g = Q.values_per_key(sales(spark, d), ["article_id", "site_id", "day"], "price")
    out = P.describe(g, ["n_values"]).drop("column")
    return out.withColumns({k: S.scaled(F.col(k)) for k in ("mean", "std")})


@query(
    "later_copies",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from (
         select *, row_number() over (partition by l_orderkey, l_linenumber
           order by l_partkey, l_suppkey, l_shipdate, l_extendedprice) as r from lineitem) where r > 1""",
)
def _(spark, d):
    l = table(spark, d, "lineitem")
    out = Q.later_copies(l, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query(
    "duplicate_rows",
    f"""with {MONTHLY} select article_id, site_id, zone_id, day, quantity, price from (
         select *, count(*) over (partition by article_id, site_id, zone_id, day) as c from monthly) where c > 1""",
)
def _(spark, d):
    return Q.duplicates(monthly(spark, d), KEYS).select(*KEYS, "quantity", "price")


FENCES = f"""with {SALES}, q as (select quantile_cont(quantity, 0.25) as q1, quantile_cont(quantity, 0.5) as q2,
  quantile_cont(quantity, 0.75) as q3 from sales)"""


@query(
    "tukey_fences",
    FENCES + """ select q1, q2, q3, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lower, q3 + 1.5 * (q3 - q1) as upper from q""",
)
def _(spark, d):
    return Q.tukey_fences(sales(spark, d), "quantity")


@query(
    "outlier_rows",
    FENCES + """ select article_id, site_id, day, quantity from sales, q
      where quantity < q1 - 1.5 * (q3 - q1) or quantity > q3 + 1.5 * (q3 - q1)""",
)
def _(spark, d):
    return Q.outliers(sales(spark, d), "quantity").select("article_id", "site_id", "day", "quantity")


@query("rows_above_cutoff", f"with {SALES} select article_id, site_id, day, quantity from sales where quantity > 40")
def _(spark, d):
    return Q.outliers(sales(spark, d), "quantity", cutoff=40).select("article_id", "site_id", "day", "quantity")


@query(
    "violation_period",
    f"""with {SALES} select site_id, count(*) as violations, min(day) as first_day, max(day) as last_day,
       cast(max(day) - min(day) as int) as days from sales where price is null group by 1""",
)
def _(spark, d):
    return Q.period(sales(spark, d).where(F.col("price").isNull()), "day", ["site_id"])


@query("daily_totals", f"with {SALES} select day, cast(sum(quantity) as double) as total from sales group by 1")
def _(spark, d):
    return P.daily_totals(sales(spark, d), "day", "quantity")


@query(
    "peak_days",
    f"""with {SALES}, t as (select day, sum(quantity) as total from sales group by 1)
       select day, total from t where total = (select max(total) from t)""",
)
def _(spark, d):
    return P.peak_days(P.daily_totals(sales(spark, d), "day", "quantity"))


@query(
    "null_profile",
    f"with {SALES} "
    + " union all ".join(
        f"""select '{c}' as "column", '{t}' as type, count({c}) as non_null, count(*) - count({c}) as nulls, count(*) as rows from sales"""
        for c, t in [("article_id", "bigint"), ("site_id", "bigint"), ("zone_id", "int"), ("day", "date"), ("quantity", "double"), ("price", "bigint"), ("cost_price", "bigint")]
    ),
)
def _(spark, d):
    return P.null_profile(sales(spark, d))


@query(
    "crosstab_counts",
    """select l_returnflag, l_linestatus, l_partkey, count(*) as "count" from lineitem group by 1, 2, 3""",
)
def _(spark, d):
    return P.crosstab(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_partkey")


@query(
    "histogram_bins",
    f"""with {SALES}, r as (select cast(min(price) as double) as lo, cast(max(price) as double) as hi from sales),
       b as (select least(cast(floor((price - lo) / (hi - lo) * 50) as int), 49) as bin from sales, r where price is not null)
       select cast(i.bin as int) as bin, {m6("(lo + i.bin * (hi - lo) / 50) / 1e2")} as lower, count(b.bin) as "count"
       from range(50) as i(bin) join r on true left join b on b.bin = i.bin group by i.bin, lo, hi""",
)
def _(spark, d):
    h = P.histogram(sales(spark, d), "price", 50)
    return h.select("bin", S.scaled(F.col("lower") / 1e2).alias("lower"), "count")


@query(
    "histogram_by_group",
    """with v as (select l_returnflag, l_linestatus, l_extendedprice as x from lineitem),
       r as (select l_returnflag, l_linestatus, min(x) as lo, max(x) as hi from v group by 1, 2),
       b as (select v.l_returnflag, v.l_linestatus, least(cast(floor((x - lo) / (hi - lo) * 30) as int), 29) as bin
             from v join r using (l_returnflag, l_linestatus))
       select r.l_returnflag, r.l_linestatus, cast(i.bin as int) as bin, count(b.bin) as "count"
       from r join range(30) as i(bin) on true
       left join b on b.bin = i.bin and b.l_returnflag = r.l_returnflag and b.l_linestatus = r.l_linestatus group by 1, 2, 3""",
)
def _(spark, d):
    h = P.histogram(table(spark, d, "lineitem"), "l_extendedprice", 30, ["l_returnflag", "l_linestatus"])
    return h.drop("lower")


@query(
    "most_frequent_values",
    """select o_custkey, o_orderpriority from (
         select o_custkey, o_orderpriority, row_number() over (partition by o_custkey order by count(*) desc, o_orderpriority) as r
         from orders group by 1, 2) where r = 1""",
)
def _(spark, d):
    return P.most_frequent(table(spark, d, "orders"), "o_orderpriority", ["o_custkey"])


# --- sort and limit ---------------------------------------------------------------------------------


@query("sort_rows", f"""with {SALES} select article_id, site_id, day, price, row_number() over (order by price desc nulls last, article_id, site_id, day, quantity) as place from sales""")
def _(spark, d):
    order = [F.desc_nulls_last("price"), "article_id", "site_id", "day", "quantity"]
    out = number_rows(sales(spark, d), [], order, "place", None)
    return out.select("article_id", "site_id", "day", "price", "place")


@query("head_rows", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


# --- composed checks --------------------------------------------------------------------------------


def finding_sql(where: str) -> str:
    hit = f"case when {where} then 1 end"
    return f"""with {SALES}, {SITES}, s as (select sales.*, site_zone_id from sales left join sites using (site_id))
      select count({hit}) as violations, {m6(f"count({hit}) * 100.0 / count(*)")} as pct_e6,
        min(case when {where} then day end) as first_day, max(case when {where} then day end) as last_day from s"""


def _finding(df, where):
    f = Q.finding(df, where, "day")
    return f.select("violations", S.scaled(F.col("pct")).alias("pct_e6"), "first_day", "last_day")


@query("check_orphan_sites", finding_sql("site_zone_id is null"))
def _(spark, d):
    s = J.lookup(sales(spark, d), sites(spark, d), "site_id", "site_id", {"site_zone_id": "site_zone_id"})
    return _finding(s, F.col("site_zone_id").isNull())


@query("check_zone_mismatch", finding_sql("zone_id is distinct from site_zone_id"))
def _(spark, d):
    s = J.lookup(sales(spark, d), sites(spark, d), "site_id", "site_id", {"site_zone_id": "site_zone_id"})
    return _finding(s, S.zone_differs("zone_id", "site_zone_id"))


@query(
    "check_missing_by_site",
    f"""with {SALES} select site_id, count(*) - count(price) as missing_price, count(*) - count(cost_price) as missing_cost,
       min(case when price is null or cost_price is null then day end) as first_day,
       max(case when price is null or cost_price is null then day end) as last_day from sales group by 1""",
)
def _(spark, d):
    hit = F.col("price").isNull() | F.col("cost_price").isNull()
    return sales(spark, d).groupBy("site_id").agg(
        F.count_if(F.col("price").isNull()).alias("missing_price"),
        F.count_if(F.col("cost_price").isNull()).alias("missing_cost"),
        F.min(F.when(hit, F.col("day"))).alias("first_day"),
        F.max(F.when(hit, F.col("day"))).alias("last_day"),
    )


@query("check_negative_margin", finding_sql("price - cost_price < 0"))
def _(spark, d):
    return _finding(sales(spark, d), S.difference("price", "cost_price") < 0)


@query("check_non_positive_quantity", finding_sql("quantity <= 0"))
def _(spark, d):
    return _finding(sales(spark, d), F.col("quantity") <= 0)


@query(
    "nulls_by_period",
    f"""with {SALES} select cast(date_trunc('month', day) as date) as period, count(*) - count(price) as nulls, count(*) as rows,
       {m6("(count(*) - count(price)) / count(*)")} as share_e6 from sales group by 1 having (count(*) - count(price)) / count(*) > 0.01""",
)
def _(spark, d):
    out = Q.nulls_by_period(sales(spark, d), "price", 0.01, "day")
    return out.select("period", "nulls", "rows", S.scaled(F.col("share")).alias("share_e6"))


@query(
    "returns_apart",
    f"""with {SALES} select day, case when quantity < 0 then 'return' when quantity = 0 then 'empty' else 'sale' end as kind,
       cast(sum(quantity) as double) as total from sales group by 1, 2""",
)
def _(spark, d):
    return Q.flag_returns(sales(spark, d), "quantity").groupBy("day", "kind").agg(F.sum("quantity").alias("total"))


@query(
    "repaired_prices",
    f"""with {SALES}, daily as (select article_id, site_id, zone_id, day, sum(price) as s, count(price) as c from sales group by all),
       m as (select *, sum(s) over w / nullif(sum(c) over w, 0) as mean from daily
         window w as (partition by article_id, site_id, zone_id order by day
                      range between interval 1 day following and interval 60 days following))
       select sales.article_id, sales.site_id, sales.day, sales.price, {m6("coalesce(cast(sales.price as double), mean) / 1e2")} as repaired
       from sales join m on m.article_id = sales.article_id and m.site_id = sales.site_id and m.zone_id = sales.zone_id and m.day = sales.day""",
)
def _(spark, d):
    out = Q.repair_price(sales(spark, d), ["article_id", "site_id", "zone_id"], "day", "price")
    return out.select("article_id", "site_id", "day", "price", S.scaled(F.col("repaired") / 1e2).alias("repaired"))


ROW_RULES = [
    ("orphan_site", "site_id", "site_zone_id is null"),
    ("unknown_article", "article_id", "p_partkey is null"),
    ("zone_mismatch", "zone_id", "zone_id is distinct from site_zone_id"),
    ("missing_cost", "cost_price", "cost_price is null"),
    ("missing_price", "price", "price is null"),
    ("negative_margin", "price", "price < cost_price"),
    ("non_positive_quantity", "quantity", "quantity <= 0"),
    ("fractional_quantity", "quantity", "coalesce(quantity % 1 <> 0, true)"),
    ("quantity_above_cutoff", "quantity", "quantity > 40"),
]
GROUP_RULES = [
    ("duplicate_key", "rows", "article_id, site_id, zone_id, day", "count(*) > 1", "count(*)"),
    ("cost_conflict", "groups", "article_id, site_id, zone_id, day", "count(distinct cost_price) > 1", "1"),
    ("price_conflict", "groups", "article_id, site_id, zone_id, day", "count(distinct price) > 1", "1"),
    ("zone_price_rule", "groups", "article_id, zone_id, day", "count(distinct price) > 1", "1"),
]


def audit_sql() -> str:
    rows = [
        f"""select '{name}' as "check", '{scope}' as scope, count(case when {rule} then 1 end) as violations,
          {m6(f"count(case when {rule} then 1 end) * 100.0 / count(*)")} as pct_e6,
          min(case when {rule} then day end) as first_day, max(case when {rule} then day end) as last_day from s"""
        for name, scope, rule in ROW_RULES
    ]
    groups = [
        f"""select '{name}', '{scope}', cast(coalesce(sum(v), 0) as bigint),
          {m6("coalesce(sum(v), 0) * 100.0 / (select count(*) from sales)")}, min(day), max(day)
          from (select {keys}, {value} as v from sales group by {keys} having {rule})"""
        for name, scope, keys, rule, value in GROUP_RULES
    ]
    return f"""with {SALES}, {SITES}, s as (select sales.*, site_zone_id, p_partkey from sales
      left join sites using (site_id) left join part on p_partkey = article_id) """ + " union all ".join(rows + groups)


@query("audit_report", audit_sql())
def audit(spark, d):
    out = audit_report(sales(spark, d), sites(spark, d), articles(spark, d), cutoff=40)
    return out.withColumn("pct", S.scaled(F.col("pct"))).withColumnRenamed("pct", "pct_e6")
