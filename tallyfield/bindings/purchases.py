"""Order flattening, categories, baskets, lags, splits and multi-label metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import baskets as B
from ..operators import cells as G
from ..operators import joins as J
from ..operators import metrics as V
from ..operators import splits as X
from ..plans import next_purchase as N
from ..plans.next_purchase import build_history
from ..session import cut_lineage, scratch_path
from ..sources import files, orders
from ..sources.arrays import write_json_arrays
from .registry import query
from .tables import BASKET, CATEGORISED, ORDER_LINES, PRODUCTS, SEQUENCE, order_lines, products, table

CATEGORIES = [1, 2, 3, 4, 5, 6, B.DISCONTINUED_CATEGORY]
CATEGORY_ROWS = f"cats as (select unnest({CATEGORIES}::bigint[]) as category_id)"
TODAY = dt.date(2001, 12, 24)


def m6(x: str) -> str:
    return f"cast(floor(({x}) * 1e6 + 0.5) as bigint)"


def categorised(spark, d, **kw):
    return B.apply_categories(order_lines(spark, d), products(spark, d), **kw)


def basket(spark, d):
    return B.basket_long(categorised(spark, d))


def sequence(spark, d, **kw):
    return B.sequence_orders(B.order_days(categorised(spark, d)), **kw)


def history(spark, d, **kw):
    return build_history(order_lines(spark, d), products(spark, d), categories=spark.createDataFrame([(k,) for k in CATEGORIES], "category_id bigint"), **kw)


# --- sources and sinks ------------------------------------------------------------------------------


ITEMS_SQL = """with o as (select l_orderkey, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '.000000+0100' as t, l_partkey, l_suppkey, l_quantity, l_returnflag from lineitem)
       select l_orderkey as order_id, cast(strptime(left(t, 19), '%Y-%m-%dT%H:%M:%S') - interval 1 hour as date) as date,
         t as "order_orderTime", l_partkey as id, 'part ' || l_partkey as name, cast(l_quantity as bigint) as amount from o where l_returnflag <> 'R'
       union all select l_orderkey, cast(strptime(left(t, 19), '%Y-%m-%dT%H:%M:%S') - interval 1 hour as date), t, l_suppkey, null, 1
         from o where l_returnflag <> 'R'"""


def order_documents(spark, d):
    """Orders with nested items; returned ones carry none."""
    line = table(spark, d, "lineitem")
    items = F.array(
        F.struct(
            F.col("l_partkey").alias("id"),
            F.concat(F.lit("part "), F.col("l_partkey")).alias("name"),
            F.col("l_quantity").cast("bigint").alias("amount"),
        ),
        F.struct(F.col("l_suppkey").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(1).cast("bigint").alias("amount")),
    )
    return line.select(
        F.col("l_orderkey").alias("id"),
        F.concat(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000000+0100")).alias("orderTime"),
        F.when(F.col("l_returnflag") != "R", items).alias("items"),
    )


@query("order_json_items", ITEMS_SQL)
def _(spark, d):
    path = scratch_path(spark, "orders-json")
    files.write_json(order_documents(spark, d), path)
    return orders.flatten_orders(orders.read_orders(spark, path))


@query("order_array_items", ITEMS_SQL)
def _(spark, d):
    path = scratch_path(spark, "orders-arrays")
    write_json_arrays(order_documents(spark, d), path)
    return orders.flatten_orders(orders.read_orders(spark, path, documents=True))


@query(
    "csv_round_trip",
    f"with {ORDER_LINES} select * from order_lines",
)
def _(spark, d):
    path = scratch_path(spark, "order-lines-csv")
    lines = order_lines(spark, d)
    files.write_csv(lines, path)
    return files.read_csv(spark, path, lines.schema)


@query("parquet_partitions", f"with {PRODUCTS} select status, count(*) as products, max(product_id) as last_product from products group by 1")
def _(spark, d):
    path = scratch_path(spark, "products")
    files.write_table(products(spark, d), path, ["status"])
    return spark.read.parquet(path).groupBy("status").agg(
        F.count(F.lit(1)).alias("products"), F.max("product_id").alias("last_product")
    )


@query(
    "json_dimension_append",
    f"""with {PRODUCTS} select product_id, category_id, case when s_suppkey is null then name else 'renamed' end as name, status
       from products left join supplier on s_suppkey = product_id""",
)
def _(spark, d):
    old = products(spark, d)
    listed = table(spark, d, "supplier").select(F.col("s_suppkey").alias("product_id"))
    new = old.join(listed, "product_id", "left_semi").withColumn("name", F.lit("renamed"))
    path = scratch_path(spark, "dimension-json")
    files.write_json(old, path)
    return files.append_json(spark, path, new, "product_id", scratch_path(spark, "dimension-json"))


# --- categories -------------------------------------------------------------------------------------


@query("categories_with_default", f"with {CATEGORISED} select order_id, product_id, amount, category_id from lines")
def _(spark, d):
    return categorised(spark, d).select("order_id", "product_id", "amount", "category_id")


@query(
    "categories_without_discontinued",
    f"""with {ORDER_LINES}, {PRODUCTS} select order_id, product_id, amount, category_id from order_lines
       left join products using (product_id) where status not in ('error', 'not_found')""",
)
def _(spark, d):
    return categorised(spark, d, delete_not_found=True).select("order_id", "product_id", "amount", "category_id")


@query(
    "rows_without_failed_products",
    f"with {ORDER_LINES}, {PRODUCTS} select * from order_lines where product_id not in (select product_id from products where status = 'error')",
)
def _(spark, d):
    return J.drop_keys(order_lines(spark, d), products(spark, d), "product_id", "product_id", F.col("status") == "error")


@query(
    "failed_products",
    f"""with {ORDER_LINES}, {PRODUCTS}, named as (select distinct product_id, p_name as name from order_lines join part on p_partkey = product_id)
       select products.product_id, status, named.name from products left join named on named.product_id = products.product_id where status <> 'ok'""",
)
def _(spark, d):
    names = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"))
    lines = order_lines(spark, d).join(names, "product_id")
    return B.status_report(lines, products(spark, d)).select("product_id", "status", "name")


EARLY = f"""{ORDER_LINES}, {PRODUCTS}, known as (
  select * from products where product_id in (select product_id from order_lines where day < date '1995-02-01'))"""


def _known(spark, d):
    early = order_lines(spark, d).where(F.col("day") < dt.date(1995, 2, 1)).select("product_id")
    return products(spark, d).join(early, "product_id", "left_semi")


@query("new_products", f"with {EARLY} select distinct product_id from order_lines where product_id not in (select product_id from known)")
def _(spark, d):
    return J.new_keys(order_lines(spark, d), _known(spark, d), "product_id", "product_id")


@query(
    "refreshed_dimension",
    f"""with {EARLY}, seen as (select distinct product_id from order_lines where product_id not in (select product_id from known)),
       fetched as (select * from products where status <> 'error')
       select * from known
       union all select seen.product_id, category_id, name, coalesce(status, 'error') from seen left join fetched using (product_id)""",
)
def _(spark, d):
    fetched = products(spark, d).where(F.col("status") != "error")
    return B.refresh_categories(order_lines(spark, d), _known(spark, d), fetched)


@query(
    "refresh_counts",
    f"""with {EARLY}, seen as (select distinct product_id from order_lines where product_id not in (select product_id from known))
       select count(case when status = 'ok' then 1 end) as ok, count(case when status <> 'ok' then 1 end) as failed
       from seen join products using (product_id)""",
)
def _(spark, d):
    return B.refresh_counts(order_lines(spark, d), _known(spark, d), products(spark, d))


# --- baskets ----------------------------------------------------------------------------------------


@query("basket_amounts", f"with {BASKET} select * from basket")
def _(spark, d):
    return basket(spark, d)


@query(
    "basket_matrix",
    f"with {BASKET} select customer_id, order_id, "
    + ", ".join(f"cast(sum(case when category_id = {k} then amount else 0 end) as bigint) as cat_{k}" for k in CATEGORIES)
    + " from basket group by 1, 2",
)
def _(spark, d):
    return B.basket_wide(basket(spark, d), CATEGORIES)


@query("order_days", f"with {CATEGORISED} select customer_id, order_id, min(day) as day from lines group by 1, 2")
def _(spark, d):
    return B.order_days(categorised(spark, d))


@query("order_sequence", f"with {SEQUENCE} select * from sequence")
def _(spark, d):
    return sequence(spark, d)


@query(
    "order_sequence_by_id",
    f"""with {SEQUENCE} select customer_id, order_id, day, row_number() over (partition by customer_id order by order_id) as seq, n from sequence""",
)
def _(spark, d):
    return sequence(spark, d, by_order_id=True)


@query(
    "order_calendar",
    f"""with {SEQUENCE} select customer_id, order_id, day, seq, n, cast(month(day) as int) as month, cast(isodow(day) - 1 as int) as day_of_week,
         cast(coalesce(day - lag(day) over (partition by customer_id order by seq), 0) as int) as days_since_last_order from sequence""",
)
def _(spark, d):
    return B.order_features(sequence(spark, d))


GRID = f"""{SEQUENCE}, {CATEGORY_ROWS}, grid as (
  select s.customer_id, s.order_id, s.seq, s.n, c.category_id, coalesce(b.amount, 0) as amount
  from sequence s join cats c on true left join basket b on b.order_id = s.order_id and b.customer_id = s.customer_id and b.category_id = c.category_id),
  lagged as (select *, coalesce(lag(amount, 1) over w, 0) as lag1, coalesce(lag(amount, 2) over w, 0) as lag2,
    cast(coalesce(lead(amount) over w > 0, false) as int) as target from grid
    window w as (partition by customer_id, category_id order by seq))"""


@query(
    "lag_amounts",
    f"with {GRID} select customer_id, seq, category_id, lag1, lag2, target from lagged where lag1 <> 0 or lag2 <> 0 or target <> 0",
)
def _(spark, d):
    return history(spark, d, trim=False).entries


@query(
    "lag_amounts_trimmed",
    f"""with {GRID} select customer_id, seq, category_id, lag1, lag2, target from lagged
       where seq between 3 and n - 1 and (lag1 <> 0 or lag2 <> 0 or target <> 0)""",
)
def _(spark, d):
    return history(spark, d).entries


@query(
    "lag_amounts_aligned",
    f"""with {GRID} select customer_id, seq, category_id, lag1, lag2, cast(amount > 0 as int) as target from lagged
       where seq between 3 and n and (lag1 <> 0 or lag2 <> 0 or amount <> 0)""",
)
def _(spark, d):
    return history(spark, d, target_offset=0).entries


def training(spark, d):
    h = history(spark, d)
    return B.training_long(h.features, h.entries, h.categories)


@query(
    "training_rows",
    f"""with {GRID} select customer_id, order_id, seq, category_id, lag1, lag2, target from lagged where seq between 3 and n - 1""",
)
def _(spark, d):
    return training(spark, d).select("customer_id", "order_id", "seq", "category_id", "lag1", "lag2", "target")


@query(
    "training_matrix",
    f"""with {GRID} select customer_id, order_id, string_agg(lag1, ',' order by category_id) as lag1,
         string_agg(lag2, ',' order by category_id) as lag2, string_agg(target, ',' order by category_id) as target
       from lagged where seq between 3 and n - 1 group by 1, 2""",
)
def _(spark, d):
    h = history(spark, d)
    wide = B.training_wide(h.features, h.entries, h.categories)
    return wide.select(
        "customer_id", "order_id", *[F.array_join(F.col(k).cast("array<string>"), ",").alias(k) for k in ("lag1", "lag2", "target")]
    )


@query(
    "serving_features",
    f"""with {GRID}, latest as (select customer_id, max(day) as last_day from sequence group by 1)
       select g.customer_id, last_day, 12 as month, 0 as day_of_week, cast(greatest(0, date '2001-12-24' - last_day) as int) as days_since_last_order,
         category_id, cast(sum(case when seq = n then amount else 0 end) as bigint) as lag1,
         cast(sum(case when seq = n - 1 then amount else 0 end) as bigint) as lag2
       from grid g join latest l on l.customer_id = g.customer_id group by all""",
)
def _(spark, d):
    h = history(spark, d)
    return B.serving_rows(h.basket, h.sequence, h.categories, TODAY)


WIDTH = f"""{SEQUENCE}, width as (select s.customer_id, count(b.category_id) / count(distinct s.order_id) as mean_width
  from sequence s left join basket b on b.order_id = s.order_id and b.amount > 0 group by 1)"""


@query(
    "basket_width",
    f"with {WIDTH} select customer_id, {m6('mean_width')} as width_e6, cast(round_even(mean_width, 0) as int) as n_to_show from width",
)
def _(spark, d):
    h = history(spark, d)
    w = B.basket_width(h.basket, h.sequence)
    return w.select("customer_id", S.scaled(F.col("mean_width")).alias("width_e6"), "n_to_show")


@query("distinct_days", "select o_custkey as customer_id, count(distinct cast(o_orderdate as date)) as n_days from orders group by 1")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("customer_id"), F.to_date("o_orderdate").alias("day"))
    return B.distinct_days(o)


@query(
    "top_categories",
    f"""with {GRID} select category_id, cast(sum(target) as bigint) as positives from lagged where seq between 3 and n - 1
       group by 1 order by positives desc, category_id limit 1""",
)
def _(spark, d):
    h = build_history(order_lines(spark, d), products(spark, d))
    return B.top_categories(h.entries, h.categories)


@query(
    "category_examples",
    f"with {PRODUCTS}, r as (select *, row_number() over (partition by category_id order by product_id) as p from products where category_id is not null) select category_id, "
    + ", ".join(f"max(case when p = {i} then name end) as example_{i}, max(case when p = {i} then product_id end) as id_product_{i}" for i in (1, 2, 3))
    + " from r group by 1",
)
def _(spark, d):
    return B.category_examples(products(spark, d))


@query(
    "aligned_blocks",
    """select o_orderkey, o_custkey, coalesce(lines, 0) as lines, coalesce(units, 0) as units from orders
       left join (select l_orderkey, count(*) as lines, cast(sum(l_quantity) as double) as units from lineitem group by 1) on l_orderkey = o_orderkey""",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    block = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("units")
    )
    return J.align(o, block, ["o_orderkey"], ["lines", "units"])


SUGGESTED = f"""{WIDTH}, {CATEGORY_ROWS}, scored as (
  select customer_id, category_id, cast((customer_id * 31 + category_id * 17) % 100 as double) / 100.0 as probability
  from (select distinct customer_id from sequence) join cats on true),
  ranked as (select *, row_number() over (partition by customer_id order by probability desc, category_id) as rank
    from scored where probability >= 0.3),
  suggested as (select customer_id, category_id, probability, rank, cast(round_even(mean_width, 0) as int) as n_to_show
    from ranked join width using (customer_id) where rank <= round_even(mean_width, 0))"""


def suggestions(spark, d):
    h = history(spark, d)
    serving = B.serving_rows(h.basket, h.sequence, h.categories, TODAY)
    p = ((F.col("customer_id") * 31 + F.col("category_id") * 17) % 100).cast("double") / 100.0
    scored = serving.select("customer_id", "category_id", p.alias("probability"))
    return B.rank_suggestions(scored, 0.3, B.basket_width(h.basket, h.sequence))


@query("ranked_suggestions", f"with {SUGGESTED} select customer_id, category_id, probability, cast(rank as int) as rank, n_to_show from suggested")
def _(spark, d):
    return suggestions(spark, d)


@query(
    "suggestion_report",
    f"""with {SUGGESTED}, r as (select *, row_number() over (partition by category_id order by product_id) as p from products where category_id is not null),
       e as (select category_id, string_agg(name || ' [' || product_id || ']', ' / ' order by product_id) as names from r where p <= 3 group by 1)
       select printf(' %.2f  %s', probability, coalesce(names, '')) as "value" from suggested left join e using (category_id)""",
)
def _(spark, d):
    lined = J.lookup(
        suggestions(spark, d).drop("n_to_show"),
        B.category_examples(products(spark, d)).withColumn(
            "labels",
            F.array(*[S.product_label(f"example_{i}", f"id_product_{i}") for i in (1, 2, 3)]),
        ),
        "category_id",
        "category_id",
        {"labels": "labels"},
    ).withColumn("line", S.suggestion_line("probability", "labels"))
    path = scratch_path(spark, "suggestions")
    files.write_lines(lined, path, "line", ["customer_id", "rank"])
    return spark.read.text(path)


# --- splits -----------------------------------------------------------------------------------------

PER_CUSTOMER = f"""{SEQUENCE}, valid as (select customer_id, order_id, day, seq, n, n - 3 as rows, seq - 2 as place,
    (select count(*) from (select distinct customer_id, day from sequence) x where x.customer_id = sequence.customer_id) as n_days
  from sequence where seq between 3 and n - 1)"""


def role_sql(days: str, rows: str, place: str, source: str, cols: str) -> str:
    return f"""select {cols}, case when {place} > {rows} - n_test then 'test'
        when {place} > {rows} - n_test - greatest(1, floor(({rows} - n_test) * cast(0.2 as double))) then 'val' else 'train' end as role
      from (select *, floor({days} * cast(0.1 as double)) as n_test from {source})"""


@query("split_by_customer", f"with {PER_CUSTOMER} " + role_sql("n_days", "rows", "place", "valid", "customer_id, order_id, seq"))
def _(spark, d):
    h = history(spark, d)
    return X.split_by_customer(h.features, h.sequence).select("customer_id", "order_id", "seq", "role")


TIMELINE = f"""{SEQUENCE}, placed as (select customer_id, order_id, row_number() over (order by day, customer_id, order_id) as place,
    count(*) over () as n_rows, (select count(distinct day) from sequence) as n_days from sequence where seq between 3 and n - 1)"""


def timeline(spark, d):
    h = history(spark, d)
    return X.split_by_time(h.features, h.sequence)


@query("split_by_time", f"with {TIMELINE} " + role_sql("n_days", "n_rows", "place", "placed", "customer_id, order_id, place"))
def _(spark, d):
    return timeline(spark, d).select("customer_id", "order_id", "place", "role")


FOLDED = f"""{TIMELINE}, folded as (select *, case when place - 1 < n_rows - 5 * (n_rows // 6) then -1
    else cast(floor((place - 1 - (n_rows - 5 * (n_rows // 6))) / (n_rows // 6)) as int) end as test_fold from placed)"""


@query("time_series_folds", f"with {FOLDED} select customer_id, order_id, test_fold from folded")
def _(spark, d):
    return X.time_series_folds(timeline(spark, d).drop("role")).select("customer_id", "order_id", "test_fold")


@query(
    "fold_sizes",
    f"""with {FOLDED} select cast(f.fold as int) as fold, case when test_fold = f.fold then 'test' else 'train' end as role, count(*) as "count"
       from folded join range(5) as f(fold) on test_fold <= f.fold group by 1, 2""",
)
def _(spark, d):
    roles = X.fold_roles(X.time_series_folds(timeline(spark, d).drop("role")))
    return roles.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("count"))


# --- multi-label metrics ----------------------------------------------------------------------------

SCORED = f"""{GRID}, scored as (select customer_id, order_id, category_id, target,
    cast((order_id * 31 + category_id * 17) % 100 as double) / 100.0 as probability,
    cast((order_id * 31 + category_id * 17) % 100 >= 50 as int) as prediction
  from lagged where seq between 3 and n - 1),
  hits as (select order_id, count(case when target = 1 and prediction = 1 then 1 end) as tp,
    count(case when target = 0 and prediction = 1 then 1 end) as fp, count(case when target = 1 and prediction = 0 then 1 end) as fn
    from scored group by 1)"""


def scored(spark, d):
    p = ((F.col("order_id") * 31 + F.col("category_id") * 17) % 100).cast("double") / 100.0
    return training(spark, d).withColumn("probability", p).withColumn(
        "prediction", (F.col("probability") >= 0.5).cast("int")
    )


def kept_scores(spark, d):
    """Scores written once, as a model's output would be; the threshold search reads them twice."""
    return cut_lineage(scored(spark, d).select("order_id", "target", "probability"), "scores")


@query(
    "weighted_f1",
    f"""with {SCORED}, c as (select category_id, count(case when target = 1 and prediction = 1 then 1 end) as tp,
         count(case when target <> prediction then 1 end) as miss, sum(target) as support from scored group by 1)
       select {m6("sum(support * case when 2 * tp + miss = 0 then 0.0 else 2.0 * tp / (2 * tp + miss) end) / sum(support)")} as f1_e6 from c""",
)
def _(spark, d):
    return V.weighted_f1(scored(spark, d), "category_id", "target", "prediction").select(S.scaled(F.col("f1")).alias("f1_e6"))


@query(
    "order_scores",
    f"""with {SCORED} select order_id, tp, fp, fn, {m6("case when 2*tp+fp+fn = 0 then 0.0 else 2.0*tp/(2*tp+fp+fn) end")} as f1_e6,
       {m6("case when tp+fp+fn = 0 then 1.0 else tp/(tp+fp+fn) end")} as jaccard_e6 from hits""",
)
def _(spark, d):
    out = V.per_unit(scored(spark, d), ["order_id"], "target", "prediction")
    return out.select("order_id", "tp", "fp", "fn", S.scaled(F.col("f1")).alias("f1_e6"), S.scaled(F.col("jaccard")).alias("jaccard_e6"))


@query(
    "basket_scores",
    f"""with {SCORED} select count(*) as orders, {m6("avg(case when 2*tp+fp+fn = 0 then 0.0 else 2.0*tp/(2*tp+fp+fn) end)")} as f1_samples,
       {m6("avg(case when tp+fp+fn = 0 then 1.0 else tp/(tp+fp+fn) end)")} as jaccard,
       {m6("avg(tp + fp)")} as predicted_width, {m6("avg(tp + fn)")} as actual_width from hits""",
)
def _(spark, d):
    out = V.basket_scores(scored(spark, d), ["order_id"], "target", "prediction")
    return out.withColumns({k: S.scaled(F.col(k)) for k in out.columns if k != "orders"})


CURVE = f"""{SCORED}, t as (select unnest([{", ".join(repr(x) for x in V.THRESHOLDS)}]::double[]) as threshold),
  base as (select count(distinct order_id) as orders, sum(target) as bought from scored),
  curve as (select threshold, count(case when probability >= threshold then 1 end) / any_value(orders) as predicted_width,
      any_value(bought) / any_value(orders) as actual_width
    from t join scored on true join base on true group by 1)"""


@query(
    "threshold_curve",
    f"with {CURVE} select threshold, {m6('predicted_width')} as predicted_width, {m6('actual_width')} as actual_width, {m6('abs(predicted_width - actual_width)')} as gap from curve",
)
def _(spark, d):
    curve = V.threshold_curve(kept_scores(spark, d), ["order_id"], "target", "probability")
    return curve.withColumns({k: S.scaled(F.col(k)) for k in ("predicted_width", "actual_width", "gap")})


@query(
    "best_threshold",
    f"""with {CURVE} select threshold, {m6("abs(predicted_width - actual_width)")} as gap from curve
       order by abs(predicted_width - actual_width), threshold limit 1""",
)
def _(spark, d):
    best = V.best_threshold(V.threshold_curve(kept_scores(spark, d), ["order_id"], "target", "probability"))
    return best.withColumn("gap", S.scaled(F.col("gap")))


# --- the grid without its rows ----------------------------------------------------------------------

CELLS = f"""{GRID}, calendar as (select customer_id, order_id, cast(month(day) as int) as month, cast(isodow(day) - 1 as int) as day_of_week,
    cast(coalesce(day - lag(day) over (partition by customer_id order by seq), 0) as int) as days_since_last_order from sequence),
  trained as (select l.*, month, day_of_week, days_since_last_order from lagged l join calendar using (customer_id, order_id) where seq between 3 and n - 1),
  shares as (select category_id, sum(target) / (select count(distinct order_id) from trained) as share from trained group by 1),
  levels as (select category_id, case when share >= 1e-9 then floor(share * pow(10.0, 1 - floor(log10(share))) + 0.5) / pow(10.0, 1 - floor(log10(share))) else 0.0 end as category_rate from shares),
  scored as (select t.*, cast(floor(category_rate * 1e10 + 0.5) as bigint) as rate_e10,
    cast((month * 31 + day_of_week * 17 + days_since_last_order * 7 + lag1 * 3 + lag2 * 5 + cast(floor(category_rate * 1e10 + 0.5) as bigint)) % 100 as double) / 100.0 as probability
    from trained t join levels using (category_id))"""


def rate_e10():
    return F.floor(F.col(G.LEVEL) * 1e10 + 0.5).cast("bigint")


def calendar_score(cells):
    """A score that any cell can be given: it depends on what a model sees of it."""
    code = sum((F.col(k) * w for k, w in zip((*G.CALENDAR, "lag1", "lag2"), (31, 17, 7, 3, 5))), rate_e10())
    return cells.withColumn("probability", (code % 100).cast("double") / 100.0)


def sparse(spark, d):
    return sparse_of(history(spark, d))


def sparse_of(h):
    """Trained orders, entries and rate levels, from which nothing has been filled in."""
    orders = cut_lineage(h.features.where(B.trained_positions()), "orders")
    entries = cut_lineage(h.entries, "entries")
    return orders, entries, cut_lineage(G.category_levels(h.categories, entries, orders), "rates")


@query(
    "training_cells",
    f"""with {CELLS} select month, day_of_week, days_since_last_order, lag1, lag2, target, rate_e10, count(*) as weight from scored group by all""",
)
def _(spark, d):
    return G.training_cells(*sparse(spark, d)).withColumn("rate_e10", rate_e10()).drop(G.LEVEL)


@query("category_levels", f"with {CELLS} select category_id, cast(floor(category_rate * 1e10 + 0.5) as bigint) as rate_e10 from levels")
def _(spark, d):
    return sparse(spark, d)[2].select("category_id", rate_e10().alias("rate_e10"))


HITS = "count(case when target = 1 and probability >= 0.5 then 1 end) as tp, count(case when target = 0 and probability >= 0.5 then 1 end) as fp, count(case when target = 1 and probability < 0.5 then 1 end) as fn"


@query("cell_unit_scores", f"with {CELLS} select customer_id, order_id, {HITS} from scored group by 1, 2")
def _(spark, d):
    return G.unit_scores(G.score_cells(*sparse(spark, d), calendar_score), 0.5).select("customer_id", "order_id", "tp", "fp", "fn")


@query(
    "cell_category_f1",
    f"""with {CELLS}, h as (select category_id, {HITS} from scored group by 1)
       select category_id, {m6("case when 2*tp+fp+fn = 0 then 0.0 else 2.0*tp/(2*tp+fp+fn) end")} as f1_e6, tp + fn as support from h""",
)
def _(spark, d):
    out = G.category_f1(G.score_cells(*sparse(spark, d), calendar_score), 0.5)
    return out.select("category_id", S.scaled(F.col("f1")).alias("f1_e6"), "support")


@query(
    "cell_threshold_curve",
    f"""with {CELLS}, t as (select unnest([{", ".join(repr(x) for x in V.THRESHOLDS)}]::double[]) as threshold),
       base as (select count(distinct order_id) as orders, sum(target) as bought from scored)
       select threshold, {m6("count(case when probability >= threshold then 1 end) / any_value(orders)")} as predicted_width, {m6("any_value(bought) / any_value(orders)")} as actual_width
       from t join scored on true join base on true group by 1""",
)
def _(spark, d):
    curve = G.threshold_curve_of(G.score_cells(*sparse(spark, d), calendar_score))
    return curve.select("threshold", *[S.scaled(F.col(k)).alias(k) for k in ("predicted_width", "actual_width")])


MERGED = f"""{CELLS}, {WIDTH.removeprefix(SEQUENCE + ", ")}, latest as (select customer_id, max(day) as last_day from sequence group by 1),
  served as (select g.customer_id, last_day, category_id, 12 as month, 0 as day_of_week, cast(greatest(0, date '2001-12-24' - last_day) as int) as days_since_last_order,
    cast(sum(case when seq = n then amount else 0 end) as bigint) as lag1, cast(sum(case when seq = n - 1 then amount else 0 end) as bigint) as lag2
    from grid g join latest l on l.customer_id = g.customer_id group by all),
  weighed as (select *, cast((month * 31 + day_of_week * 17 + days_since_last_order * 7 + lag1 * 3 + lag2 * 5 + cast(floor(category_rate * 1e10 + 0.5) as bigint)) % 100 as double) / 100.0 as probability
    from served join levels using (category_id)),
  placed as (select *, row_number() over (partition by customer_id order by probability desc, category_id) as rank from weighed where probability >= 0.3),
  merged as (select p.customer_id, p.last_day, p.days_since_last_order, p.category_id, p.probability, cast(rank as int) as rank, cast(round_even(mean_width, 0) as int) as n_to_show
    from placed p join width using (customer_id) where rank <= round_even(mean_width, 0))"""


def merged(spark, d):
    h = history(spark, d)
    _, _, rates = sparse_of(h)
    # written, since suggestions and counts both read them
    heads = cut_lineage(G.serving_heads(h.sequence, TODAY), "heads")
    served = N.Serving(heads, cut_lineage(G.serving_cells(h.basket, h.sequence), "own"), rates)
    return served, h, G.merged_suggestions(served.heads, served.own, rates, calendar_score, 0.3, B.basket_width(h.basket, h.sequence))


@query("merged_suggestions", f"with {MERGED} select customer_id, category_id, probability, rank, n_to_show from merged")
def _(spark, d):
    return merged(spark, d)[2].select("customer_id", "category_id", "probability", "rank", "n_to_show")


@query("predicted_counts", f"with {MERGED} select customer_id, count(case when probability >= 0.3 then 1 end) as n_predicted from weighed group by 1")
def _(spark, d):
    served, _, _ = merged(spark, d)
    return G.predicted_counts(served.heads, served.own, served.rates, calendar_score, 0.3)


NAMED = f"""{MERGED}, named as (select *, row_number() over (partition by category_id order by product_id) as p from products where category_id is not null),
  examples as (select category_id, string_agg(name || ' [' || product_id || ']', ' / ' order by product_id) as names,
    """ + ", ".join(f"max(case when p = {i} then name end) as example_{i}, max(case when p = {i} then product_id end) as id_product_{i}" for i in (1, 2, 3)) + """
    from named where p <= 3 group by 1)"""


def written(spark, d):
    """The suggestion table and the text report as files."""
    served, h, ranked = merged(spark, d)
    ranked = cut_lineage(ranked, "suggested")
    shown = N.with_examples(ranked.drop("n_to_show"), products(spark, d))
    counts = G.predicted_counts(served.heads, served.own, served.rates, calendar_score, 0.3)
    paths = scratch_path(spark, "suggestions-csv"), scratch_path(spark, "suggestions-text")
    N.write_suggestions(shown, N.report_lines(shown, served.heads, counts), *paths)
    return shown.schema, *paths


@query(
    "suggestion_file",
    f"""with {NAMED} select customer_id, category_id, probability, rank, example_1, example_2, example_3, id_product_1, id_product_2, id_product_3
       from merged left join examples using (category_id)""",
)
def _(spark, d):
    schema, path, _ = written(spark, d)
    return files.read_csv(spark, path, schema)


@query(
    "suggestion_text",
    f"""with {NAMED} select printf('Last order : %s  (%d days ago)', last_day::varchar, greatest(0, date '2001-12-24' - last_day)) as "value" from latest
       union all select printf('Showing top %d categories, out of %d predicted', (select count(*) from merged m where m.customer_id = w.customer_id), count(case when probability >= 0.3 then 1 end))
         from weighed w group by customer_id
       union all select printf(' %.2f  %s', probability, coalesce(names, '')) from merged left join examples using (category_id)""",
)
def _(spark, d):
    return spark.read.text(written(spark, d)[2])
