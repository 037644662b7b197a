"""Queries that fit models or run a stream; models have no SQL form and are checked by row counts and tests.

Candidate and tree counts here are parameters of these bindings, small enough for one machine; the
library's defaults are the full search sizes.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..learning.models import BUILDERS, score
from ..learning.search import FIRST_RANGES, PURCHASE_RANGES, hit_table, random_search, sample, score_table, second_ranges
from ..learning.transforms import fit_features
from ..operators import metrics as V
from ..operators import splits as X
from ..plans import category_models as C
from ..plans import next_purchase as N
from ..plans import records as R
from ..plans.audit import merge, summarise
from ..session import READ_BYTES, bytes_below, cut_lineage, scratch_path
from ..sources import files
from ..streaming.audits import combine, drain
from ..streaming.tiers import Tiers, tiered_stream
from .purchases import FOLDED, GRID, TODAY, role_sql
from .registry import query
from .retail import audit_sql
from .tables import RECORDS, SEQUENCE, articles, order_lines, products, sales, sites, table, train, unlabelled

NUMERIC, CATEGORICAL = ["n_chars", "score"], ["lang", "source"]

MEMBERS = {
    "linear": {"alpha": 0.01, "max_iter": 50},
    "logistic": {"C": 10.0, "max_iter": 50},
    "random_forest": {"n_estimators": 20, "max_depth": 4},
    "extra_trees": {"n_estimators": 20, "max_depth": 4},
    "boosting": {"n_estimators": 10, "max_depth": 3},
    "stopped_boosting": {"n_estimators": 10, "max_depth": 3, "colsample_bytree": 0.7},
}
REGULARISED = {"n_estimators": 8, "max_depth": 3, "colsample_bytree": 0.9, "reg_alpha": 0.1, "reg_lambda": 2.0}
PURCHASE = {"max_depth": 4, "learning_rate": 0.1, "subsample": 0.8, "colsample_bytree": 0.8, "min_child_weight": 2}


#: Labelled rows that `category_search` and `purchase_quality` fit on, about; all rows are scored.
FIT_ROWS = 20_000


# A label that a classifier has to find among the other features: whether the record is in English.
PLANTED = "case when lang = 'en' then 1 else 0 end"


def marked_vectors(spark, d):
    """Feature vectors of labelled (with stratified folds) and unlabelled records, and the row count; the planted
    label stands in place of the quality."""
    t = X.stratified_folds(
        train(spark, d).drop("text").fillna(0, ["n_chars"]).withColumn("quality", F.expr(PLANTED)), "quality", ["record_id"]
    )
    fitted = fit_features(t, NUMERIC, CATEGORICAL)
    known = cut_lineage(fitted.transform(t).select("record_id", "quality", "fold", "features"), "vectors")
    u = fitted.transform(unlabelled(spark, d).drop("text").fillna(0, ["n_chars"]))
    return known, u.select("record_id", "features"), known.count()


PLANTED_SQL = f"select doc_id as record_id, cast({PLANTED} as int) as prediction from documents where doc_id not in (select doc_id from labels)"


def _scores_of(name: str, params: dict):
    def run(spark, d):
        known, unknown, n = marked_vectors(spark, d)
        out = score(BUILDERS[name]("quality", n, **params).fit(known), unknown)
        return out.select("record_id", "prediction")

    return run


# trees see a share of the columns at a split, so they get some depth
PLANTED_MEMBERS = {
    **MEMBERS,
    "linear": {"alpha": 1e-5, "max_iter": 100},
    "random_forest": {"n_estimators": 20, "max_depth": 6},
    "extra_trees": {"n_estimators": 20, "max_depth": 6},
}
for _name in MEMBERS:
    query(f"{_name}_scores", PLANTED_SQL)(_scores_of(_name, PLANTED_MEMBERS[_name]))
query("regularised_boosting_scores", PLANTED_SQL)(_scores_of("regularised_boosting", REGULARISED))
query("capped_forest_scores", PLANTED_SQL)(_scores_of("random_forest", {"n_estimators": 20, "max_depth": 8, "max_leaf_nodes": 12}))


# The folds of the records by the planted label, and how many rows each tests.
TESTED = f"""{RECORDS}, marked as (select record_id, cast({PLANTED} as int) as planted from train),
  k as (select record_id, planted, row_number() over (partition by planted order by record_id) as r, min(record_id) over (partition by planted) as first_id from marked),
  dealt as (select planted, (row_number() over (order by first_id, record_id) - 1) % 5 as f from k),
  upto as (select planted, i, (select count(*) from dealt x where x.planted = q.planted and x.f <= i) as c from (select distinct planted from k) q, range(4) as n(i)),
  folded as (select record_id, k.planted, cast(count(case when r > c then 1 end) as int) as fold from k join upto on upto.planted = k.planted group by 1, 2),
  tested as (select fold, count(*) as tested from folded group by 1)"""


def best_hits(spark, model: str, best: dict, candidates: list, scores: list):
    """Rows tested and right of the winner, with the number of candidates that were scored on every fold."""
    hits = hit_table(spark, {model: scores})
    place = candidates.index(best)
    tried = hits.groupBy("candidate").agg(F.count_distinct("fold").alias("folds")).where("folds = 5").count()
    return hits.where(F.col("candidate") == place).select("model", "fold", "tested", "right", F.lit(tried).alias("candidates"))


@query("random_search", f"with {TESTED} select 'logistic' as model, cast(c as int) as candidate, fold, tested, tested as \"right\" from tested, range(200) a(c)")
def _(spark, d):
    known, _, n = marked_vectors(spark, d)
    return hit_table(spark, {"logistic": random_search(known, "logistic", "quality", n)[1]})


@query("two_stage_search", f"with {TESTED} select 'linear' as model, fold, tested, tested as \"right\", 200 as candidates from tested")
def _(spark, d):
    known, _, n = marked_vectors(spark, d)
    first, _ = random_search(known, "linear", "quality", n)
    best, scores = random_search(known, "linear", "quality", n, ranges=second_ranges("linear", first))
    return best_hits(spark, "linear", best, sample(second_ranges("linear", first), 200), scores)


@query("forest_search", f"with {TESTED} select 'extra_trees' as model, fold, tested, tested as \"right\", 40 as candidates from tested")
def _(spark, d):
    known, _, n = marked_vectors(spark, d)
    best, scores = random_search(known, "extra_trees", "quality", n, n_iter=40, fixed={"n_estimators": 64}, halving=4)
    candidates = [{**c, "n_estimators": 64} for c in sample(FIRST_RANGES["extra_trees"], 40)]
    return best_hits(spark, "extra_trees", best, candidates, scores)


COMPARED = ", ".join(f"('{m}')" for m in [*MEMBERS, "soft_vote", "hard_vote"])


@query("model_comparison", f"with {TESTED} select model, 0 as candidate, fold, tested, tested as \"right\" from tested, (values {COMPARED}) t(model)")
def _(spark, d):
    known, _, n = marked_vectors(spark, d)
    return hit_table(spark, R.compare_models(known, "quality", n, PLANTED_MEMBERS))


@query("vote_predictions", PLANTED_SQL)
def _(spark, d):
    known, unknown, n = marked_vectors(spark, d)
    voted = R.vote(R.fit_models(known, "quality", n, PLANTED_MEMBERS), unknown)
    return voted.select("record_id", "prediction")


@query("submission_file", PLANTED_SQL.replace("as prediction", "as quality"))
def _(spark, d):
    known, unknown, n = marked_vectors(spark, d)
    model = BUILDERS["logistic"]("quality", n, **MEMBERS["logistic"]).fit(known)
    out = R.submission(model, unknown, "record_id", "quality")
    path = scratch_path(spark, "submission")
    files.write_csv(out, path)
    return files.read_csv(spark, path, out.schema)


def history(spark, d, **kw):
    return N.build_history(order_lines(spark, d), products(spark, d), **kw)


# A rule that each category's model has to find: even ones are bought again after one order, odd ones after two.
RULE = "case when category_id % 2 = 0 then lag1 > 0 else lag2 > 0 end"


@query("category_search", "select 'top_categories' as model, cast(c as int) as candidate, cast(f as int) as fold, 10 as f1_e1, c = 0 as chosen from range(2) a(c), range(5) b(f)")
def _(spark, d):
    h = history(spark, d)
    # the rule of the category models, which every candidate has to find in every fold (amounts that the training
    # part of a small table lacks may fall on the wrong side of a cut)
    entries = cut_lineage(h.entries.withColumn("target", F.expr(RULE).cast("int")), "ruled")
    h = replace(h, entries=entries)
    best, scores = N.search_parameters(N.training_set(h), h, n_iter=2, trees=5, max_fit_rows=FIT_ROWS)
    table = score_table(spark, {"top_categories": scores})
    chosen = F.col("candidate") == sample(PURCHASE_RANGES, 2).index(best)
    return table.select("model", "candidate", "fold", S.scaled(F.col("score"), 1).cast("int").alias("f1_e1"), chosen.alias("chosen"))


@query("purchase_quality")
def _(spark, d):
    t = N.training_set(history(spark, d))
    return N.compare_thresholds(t, N.fit_pooled(t, PURCHASE, trees=40, max_fit_rows=FIT_ROWS))


RULED = f"""with {FOLDED}, roles as ({role_sql("n_days", "n_rows", "place", "placed", "customer_id, order_id, place")}),
  {GRID.removeprefix(SEQUENCE + ", ")}, ruled as (select l.*, role, cast({RULE} as int) as planted from lagged l join roles using (customer_id, order_id))"""


def ruled(spark, d):
    """Trained orders with their role, and the entries with the planted target."""
    h = history(spark, d)
    orders = cut_lineage(X.split_by_time(h.features, h.sequence), "orders")
    entries = cut_lineage(h.entries.withColumn("target", F.expr(RULE).cast("int")), "entries")
    return orders, entries, C.fit_category_models(orders.where("role = 'train'"), entries)


@query("category_models", f"{RULED} select customer_id, order_id, category_id, planted as prediction from ruled where role = 'val' and (lag1 <> 0 or lag2 <> 0 or target <> 0)")
def _(spark, d):
    orders, entries, models = ruled(spark, d)
    scored = C.score_categories(models, orders.where("role = 'val'"), entries).present
    return scored.select("customer_id", "order_id", "category_id", (F.col("probability") >= 0.5).cast("int").alias("prediction"))


@query(
    "category_model_quality",
    f"""{RULED} select category_id, case when sum(planted) > 0 then 1000000 else 0 end as f1_e6, cast(sum(planted) as bigint) as support
       from ruled where role = 'test' group by 1""",
)
def _(spark, d):
    orders, entries, models = ruled(spark, d)
    out = C.category_f1(C.score_categories(models, orders.where("role = 'test'"), entries), 0.5)
    return out.select("category_id", S.scaled(F.col("f1")).cast("int").alias("f1_e6"), "support")


@query("category_model_widths", f"""{RULED}, o as (select order_id, sum(planted) as bought from ruled where role = 'test' group by 1)
  select customer_id, order_id, cast(bought as bigint) as tp, cast(0 as bigint) as fp, cast(0 as bigint) as fn from o join roles using (order_id)""")
def _(spark, d):
    orders, entries, models = ruled(spark, d)
    out = C.unit_scores(C.score_categories(models, orders.where("role = 'test'"), entries), 0.5)
    return out.select("customer_id", "order_id", "tp", "fp", "fn")


@query("next_purchases")
def _(spark, d):
    out = N.next_purchases(order_lines(spark, d), products(spark, d), TODAY, n_iter=2, trees=40, search_trees=5)
    return out.withColumn("probability", S.scaled(F.col("probability"), 4)).withColumnRenamed("probability", "probability_e4")


@query(
    "planted_purchases",
    f"""with {GRID}, latest as (select customer_id, category_id, sum(case when seq = n then amount else 0 end) as lag1 from grid group by 1, 2)
       select customer_id, category_id, 1 as shown from latest where lag1 > 0""",
)
def _(spark, d):
    # every customer buys again what the last order held: the whole job has to find that, and nothing else
    h = history(spark, d, served=True)
    h = replace(h, entries=h.entries.withColumn("target", (F.col("lag1") > 0).cast("int")))
    known = products(spark, d).where(F.col("category_id").isNotNull())
    out = N.purchases_of(h, known, TODAY, trees=30, params=PURCHASE, n_to_show=7)
    return out.select("customer_id", "category_id", F.lit(1).alias("shown"))


# --- stream -----------------------------------------------------------------------------------------


#: Bytes of the table of lines for each file that arrives, about; a task summarises one file.
FILE_BYTES = READ_BYTES


def arriving_lines(spark, d, batches):
    """The lines as files that arrive in so many batches, the rows of a key spread over them. A batch is one file, or
    as many as keep a file bounded."""
    lines = table(spark, d, "lineitem")
    folder = scratch_path(spark, "arriving")
    each = max(1, -(-bytes_below(spark, f"{d}/lineitem.parquet") // (batches * FILE_BYTES)))
    lines.repartition(batches * each, F.xxhash64("l_orderkey", "l_linenumber", "l_extendedprice")).write.parquet(folder)
    return spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", each).parquet(folder)


@query("streamed_audit", audit_sql())
def _(spark, d):
    arriving = arriving_lines(spark, d, 4)
    filed = drain(spark, arriving, lambda batch: summarise(sales(spark, d, batch), cutoff=40))
    out = combine(filed, sites(spark, d), articles(spark, d))
    return out.withColumn("pct", S.scaled(F.col("pct"))).withColumnRenamed("pct", "pct_e6")


@query("tiered_audit", audit_sql())
def _(spark, d):
    # as above, with the summaries of five batches merged in tiers of two
    arriving = arriving_lines(spark, d, 5)
    tiers = Tiers(spark, scratch_path(spark, "tiers"), merge, fan=2)
    summary = lambda batch: summarise(sales(spark, d, batch), cutoff=40)
    tiered_stream(arriving, summary, tiers, scratch_path(spark, "tiers-progress")).awaitTermination()
    out = combine(tiers.read(), sites(spark, d), articles(spark, d))
    return out.withColumn("pct", S.scaled(F.col("pct"))).withColumnRenamed("pct", "pct_e6")
