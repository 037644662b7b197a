"""Labelled records: rates, crosstabs, imputation, folds, encoders and binary metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..learning.transforms import fit_features
from ..operators import imputation as I
from ..operators import metrics as V
from ..operators import profiles as P
from ..operators import splits as X
from ..plans import records as R
from .registry import query
from .tables import RECORDS, records, table, train, unlabelled


def m6(x: str) -> str:
    return f"cast(floor(({x}) * 1e6 + 0.5) as bigint)"


# --- profiles ---------------------------------------------------------------------------------------

DRIFT = ["record_id", "lang", "source", "text", "n_chars", "toxic", "score"]


@query(
    "profile_drift",
    f"with {RECORDS} "
    + " union all ".join(
        f"""select '{c}' as "column", 'both' as side, {m6(f"(select (count(*) - count({c})) / count(*) from train)")} as left_null_share,
          {m6(f"(select (count(*) - count({c})) / count(*) from unlabelled)")} as right_null_share"""
        for c in DRIFT
    )
    + " union all select 'quality', 'left', 0, null",
)
def _(spark, d):
    out = P.profile_drift(train(spark, d), unlabelled(spark, d).drop("quality"))
    return out.withColumns({k: S.scaled(F.col(k)) for k in ("left_null_share", "right_null_share")})


@query("label_rates", f"with {RECORDS} select lang, {m6('avg(quality)')} as rate_e6, count(quality) as \"count\" from train group by 1")
def _(spark, d):
    out = P.label_rate(train(spark, d), ["lang"], "quality")
    return out.select("lang", S.scaled(F.col("rate")).alias("rate_e6"), "count")


@query(
    "outcome_counts",
    f"""with {RECORDS} select source, count(case when quality = 1 then 1 end) as positive, count(case when quality <> 1 then 1 end) as negative
       from train group by 1""",
)
def _(spark, d):
    return P.outcome_counts(train(spark, d), ["source"], "quality")


def _share(keys: str, base: str) -> str:
    return f"""with {RECORDS}, c as (select {keys}, quality, count(*) as n from train group by all)
       select {keys}, quality, n as "count", {m6(f"n / sum(n) over (partition by {base})")} as share_e6 from c"""


def _shares(spark, d, rows, over):
    out = P.crosstab_share(train(spark, d), rows, "quality", over)
    return out.withColumn("share", S.scaled(F.col("share"))).withColumnRenamed("share", "share_e6")


@query("crosstab_by_row", _share("lang, source", "lang, source"))
def _(spark, d):
    return _shares(spark, d, ["lang", "source"], "index")


@query("crosstab_by_column", _share("lang, source", "quality"))
def _(spark, d):
    return _shares(spark, d, ["lang", "source"], "columns")


@query("crosstab_three_keys", _share("lang, source, toxic", "quality"))
def _(spark, d):
    return _shares(spark, d, ["lang", "source", "toxic"], "columns")


@query(
    "crosstab_age_bins",
    f"""with {RECORDS}, b as (select cast(floor(n_chars / 1500) * 1500 as bigint) as bin, lang, quality from train where n_chars is not null),
       c as (select bin, lang, count(case when quality = 0 then 1 end) as n0, count(case when quality = 1 then 1 end) as n1 from b group by 1, 2)
       select bin, lang, {m6("n0 / (select sum(n0) from c)")} as share_0, {m6("n1 / (select sum(n1) from c)")} as share_1 from c""",
)
def _(spark, d):
    t = train(spark, d).withColumn("bin", S.floor_to("n_chars", 1500).cast("bigint"))
    out = P.crosstab_wide(t, ["bin", "lang"], "quality", [0, 1], "columns")
    return out.withColumns({k: S.scaled(F.col(k)) for k in ("share_0", "share_1")})


# --- imputation -------------------------------------------------------------------------------------


@query(
    "filled_by_group_median",
    f"""with {RECORDS} select record_id, lang, coalesce(cast(n_chars as double), quantile_cont(n_chars, 0.5) over (partition by lang, source)) as n_chars from records""",
)
def _(spark, d):
    out = I.fill_group_median(records(spark, d), ["lang", "source"], "n_chars")
    return out.select("record_id", "lang", "n_chars")


@query(
    "filled_from_train_median",
    f"""with {RECORDS}, m as (select lang, cast(quantile_cont(n_chars, 0.5) as double) as med from train group by 1)
       select record_id, unlabelled.lang, coalesce(cast(n_chars as double), med) as n_chars from unlabelled left join m using (lang)""",
)
def _(spark, d):
    out = I.fill_group_median(unlabelled(spark, d), ["lang"], "n_chars", train(spark, d))
    return out.select("record_id", "lang", "n_chars")


@query("group_sizes", f"with {RECORDS} select record_id, source, count(*) over (partition by source) as group_size from records")
def _(spark, d):
    return I.group_size(records(spark, d), "source").select("record_id", "source", "group_size")


PASSENGERS = """crew as (select c_custkey as "PassengerId", cast(c_acctbal > 5000 as int) as "Survived", c_nationkey % 3 + 1 as "Pclass",
    'Heron, ' || case c_custkey % 5 when 0 then 'Mr' when 1 then 'Mlle' when 2 then 'Dr' when 3 then 'Miss' else 'Mrs' end || '. ' || c_name as "Name",
    case when c_custkey % 2 = 0 then 'male' else 'female' end as "Sex",
    case when c_custkey % 6 = 0 then null else floor(abs(c_acctbal) / 100) % 80 end as "Age",
    c_custkey % 4 as "SibSp", c_custkey % 3 as "Parch", c_mktsegment || ' ' || c_nationkey as "Ticket",
    case when c_custkey % 97 = 0 then null else c_acctbal end as "Fare",
    case when c_custkey % 3 = 0 then c_mktsegment || '7' end as "Cabin", substr(c_mktsegment, 1, 1) as "Embarked", c_nationkey as nation
  from customer),
  ready as (select "PassengerId", "Survived", "Pclass", "Sex",
    coalesce("Age", quantile_cont("Age", 0.5) over (partition by "Sex", "Pclass")) as "Age",
    "SibSp" + "Parch" + 1 as "FamilySize", count(*) over (partition by "Ticket") as "TicketGroupSize", "Fare",
    coalesce(substr("Cabin", 1, 1), 'U') as "Deck", "Embarked",
    case regexp_extract("Name", '([A-Za-z]+)\\.', 1) when 'Dr' then 'Rare' when 'Mlle' then 'Miss' else regexp_extract("Name", '([A-Za-z]+)\\.', 1) end as "Title"
    from crew)"""


def passengers(spark, d):
    k = F.col("c_custkey")
    title = F.element_at(F.array(*[F.lit(t) for t in ("Mr", "Mlle", "Dr", "Miss", "Mrs")]), (k % 5 + 1).cast("int"))
    return table(spark, d, "customer").select(
        k.alias("PassengerId"),
        (F.col("c_acctbal") > 5000).cast("int").alias("Survived"),
        (F.col("c_nationkey") % 3 + 1).alias("Pclass"),
        F.concat(F.lit("Heron, "), title, F.lit(". "), F.col("c_name")).alias("Name"),
        F.when(k % 2 == 0, "male").otherwise("female").alias("Sex"),
        F.when(k % 6 != 0, F.floor(F.abs("c_acctbal") / 100).cast("double") % 80).alias("Age"),
        (k % 4).alias("SibSp"),
        (k % 3).alias("Parch"),
        F.concat("c_mktsegment", F.lit(" "), F.col("c_nationkey")).alias("Ticket"),
        F.when(k % 97 != 0, F.col("c_acctbal")).alias("Fare"),
        F.when(k % 3 == 0, F.concat("c_mktsegment", F.lit("7"))).alias("Cabin"),
        F.substring("c_mktsegment", 1, 1).alias("Embarked"),
    )


@query(
    "passenger_features",
    f"""with {PASSENGERS}, fares as (select "Pclass", quantile_cont("Fare", 0.5) as middle from ready group by 1)
       select "PassengerId", "Survived", "Pclass", "Sex", "Age", "FamilySize", "TicketGroupSize",
         {m6('coalesce("Fare", middle)')} as fare_e6, "Deck", "Embarked", "Title" from ready join fares using ("Pclass")""",
)
def _(spark, d):
    listed = passengers(spark, d)
    out = R.fill_fare(R.passenger_features(listed), listed)
    return out.select(
        "PassengerId", "Survived", "Pclass", "Sex", "Age", "FamilySize", "TicketGroupSize",
        S.scaled(F.col("Fare")).alias("fare_e6"), "Deck", "Embarked", "Title",
    )


# --- folds and encoders -----------------------------------------------------------------------------


@query(
    "stratified_folds",
    f"""with {RECORDS}, k as (select record_id, quality, row_number() over (partition by quality order by record_id) as r,
           min(record_id) over (partition by quality) as first_id from train),
       dealt as (select quality, (row_number() over (order by first_id, record_id) - 1) % 5 as f from k),
       upto as (select quality, i, (select count(*) from dealt x where x.quality = q.quality and x.f <= i) as c
                from (select distinct quality from k) q, range(4) as n(i))
       select record_id, k.quality, cast(count(case when r > c then 1 end) as int) as fold from k join upto on upto.quality = k.quality group by 1, 2""",
)
def _(spark, d):
    return X.stratified_folds(train(spark, d), "quality", ["record_id"]).select("record_id", "quality", "fold")


@query(
    "scaled_columns",
    f"""with {RECORDS}, t as (select avg(n_chars) as m, stddev_pop(n_chars) as s, avg(score) as m2, stddev_pop(score) as s2 from train)
       select record_id, {m6("(n_chars - m) / s / 100")} as n_chars, {m6("(score - m2) / s2 / 100")} as score from unlabelled, t""",
)
def _(spark, d):
    cols = ["n_chars", "score"]
    out = I.scale(unlabelled(spark, d), I.scaling_table(train(spark, d), cols), cols)
    return out.select("record_id", *[S.scaled(F.col(c) / 100).alias(c) for c in cols])


GAPS = "case when record_id % 13 = 0 then null else lang end"


@query(
    "filled_with_mode",
    f"""with {RECORDS}, m as (select lang from (select {GAPS} as lang from train) where lang is not null group by 1 order by count(*) desc, lang limit 1)
       select record_id, coalesce({GAPS}, (select lang from m)) as lang from unlabelled""",
)
def _(spark, d):
    gaps = F.when(F.col("record_id") % 13 != 0, F.col("lang"))
    t, u = (x.select("record_id", gaps.alias("lang")) for x in (train(spark, d), unlabelled(spark, d)))
    return I.fill_most_frequent(u, t, ["lang"])


@query(
    "one_hot_cells",
    f"""with {RECORDS}, k as (select source as category, row_number() over (order by source) - 1 as category_index from (select distinct source from train))
       select record_id, category, category_index from unlabelled join k on category = source""",
)
def _(spark, d):
    return I.one_hot_long(unlabelled(spark, d), train(spark, d), "record_id", "source").select(
        "record_id", "category", "category_index"
    )


@query(
    "feature_vectors",
    f"""with {RECORDS}, t as (select * from records where quality is not null), u as (select * from records where quality is null),
      m as (select avg(coalesce(n_chars, 0)) as a, stddev_pop(coalesce(n_chars, 0)) as b, avg(score) as e, stddev_pop(score) as f from t),
      k as (select 'lang' as part, lang as v, row_number() over (order by lang) + 1 as place from (select distinct lang from t)
            union all select 'source', source, row_number() over (order by source) + 1 + (select count(distinct lang) from t) from (select distinct source from t)),
      cells as (select record_id, cast(0 as bigint) as place, (coalesce(n_chars, 0) - a) / b as x from u, m
                union all select record_id, 1, (score - e) / f from u, m
                union all select record_id, place, case when v = lang then 1.0 else 0.0 end from u, k where part = 'lang'
                union all select record_id, place, case when v = source then 1.0 else 0.0 end from u, k where part = 'source')
      select record_id, cast(place as int) as place, cast(floor(x * 1e4 + 0.5) as bigint) as cell_e4 from cells""",
)
def _(spark, d):
    from pyspark.ml.functions import vector_to_array

    fitted = fit_features(train(spark, d).fillna(0, ["n_chars"]), ["n_chars", "score"], ["lang", "source"])
    out = fitted.transform(unlabelled(spark, d).fillna(0, ["n_chars"]))
    cells = out.select("record_id", F.posexplode(vector_to_array("features")).alias("place", "x"))
    return cells.select("record_id", "place", S.scaled(F.col("x"), 4).alias("cell_e4"))


# --- votes and metrics ------------------------------------------------------------------------------

VOTED = f"""{RECORDS}, voted as (select record_id, quality, score as a, (record_id * 31 % 100) / 100.0 as b,
    (record_id * 17 % 10) / 10.0 as c from train)"""


def voted(spark, d):
    i = F.col("record_id")
    return train(spark, d).select(
        "record_id", "quality", F.col("score").alias("a"), (i * 31 % 100 / 100.0).alias("b"), (i * 17 % 10 / 10.0).alias("c")
    )


@query("soft_votes", f"with {VOTED} select record_id, {m6('(a + b + c) / 3')} as probability_e6, cast((a + b + c) / 3 > 0.5 as int) as prediction from voted")
def _(spark, d):
    out = I.soft_vote(voted(spark, d), ["a", "b", "c"])
    return out.select("record_id", S.scaled(F.col("probability")).alias("probability_e6"), "prediction")


@query(
    "hard_votes",
    f"with {VOTED} select record_id, cast(cast(a > 0.5 as int) + cast(b > 0.5 as int) + cast(c > 0.5 as int) >= 2 as int) as prediction from voted",
)
def _(spark, d):
    votes = voted(spark, d).select("record_id", *[(F.col(k) > 0.5).cast("int").alias(k) for k in "abc"])
    return I.hard_vote(votes, ["a", "b", "c"]).select("record_id", "prediction")


PREDICTED = f"""{RECORDS}, p as (select quality as label, cast(score > 0.4 as int) as prediction, score from train)"""


def predicted(spark, d):
    return train(spark, d).select(
        F.col("quality").alias("label"), (F.col("score") > 0.4).cast("int").alias("prediction"), "score"
    )


@query("accuracy", f"with {PREDICTED} select {m6('avg(cast(label = prediction as int))')} as accuracy_e6 from p")
def _(spark, d):
    return V.accuracy(predicted(spark, d), "label", "prediction").select(S.scaled(F.col("accuracy")).alias("accuracy_e6"))


@query(
    "confusion_matrix",
    f"""with {PREDICTED}, c as (select label, prediction, count(*) as n from p group by 1, 2)
       select label, prediction, n as "count", {m6("case when label = prediction then 0.0 else n / sum(n) over (partition by label) end")} as error_e6 from c""",
)
def _(spark, d):
    out = V.confusion(predicted(spark, d), "label", "prediction")
    return out.select("label", "prediction", "count", S.scaled(F.col("error_share")).alias("error_e6"))


@query(
    "classification_report",
    f"""with {PREDICTED}, k as (select unnest([0, 1]) as k),
       s as (select k, count(case when label = k and prediction = k then 1 end) as tp, count(case when prediction = k then 1 end) as pp,
               count(case when label = k then 1 end) as support from k join p on true group by 1),
       r as (select cast(k as varchar) as "class", tp / pp as pr, tp / support as re, 2 * tp / (pp + support) as f1, support from s)
       select "class", {m6('pr')} as "precision", {m6('re')} as recall, {m6('f1')} as f1, support from r
       union all select 'accuracy', a, a, a, n from (select {m6('avg(cast(label = prediction as int))')} as a, count(*) as n from p)
       union all select 'macro avg', {m6('avg(pr)')}, {m6('avg(re)')}, {m6('avg(f1)')}, cast(sum(support) as bigint) from r
       union all select 'weighted avg', {m6('sum(pr * support) / sum(support)')}, {m6('sum(re * support) / sum(support)')},
         {m6('sum(f1 * support) / sum(support)')}, cast(sum(support) as bigint) from r""",
)
def _(spark, d):
    out = V.classification_report(predicted(spark, d), "label", "prediction")
    return out.withColumns({k: S.scaled(F.col(k)) for k in ("precision", "recall", "f1")})


@query(
    "roc_auc",
    f"""with {PREDICTED}, r as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as mid from p)
       select count(case when label = 1 then 1 end) as positives, count(case when label = 0 then 1 end) as negatives,
         {m6("(sum(case when label = 1 then mid end) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label)))")} as auc_e6 from r""",
)
def _(spark, d):
    out = V.roc_auc(predicted(spark, d), "label", "score")
    return out.select("positives", "negatives", S.scaled(F.col("auc")).alias("auc_e6"))


@query(
    "fold_summary",
    """with s as (select l_returnflag as model, cast(l_suppkey % 7 as int) as candidate, cast(l_linenumber % 5 as int) as fold, avg(l_quantity) as score from lineitem group by 1, 2, 3),
       p as (select model, candidate, avg(score) as m, stddev_pop(score) as sd, count(*) as folds from s group by 1, 2),
       r as (select *, row_number() over (partition by model order by m desc, candidate) as k from p)
       select model, candidate, cast(floor(m * 1e4 + 0.5) as bigint) as mean_e4, cast(floor(sd * 1e4 + 0.5) as bigint) as std_e4, folds from r where k = 1""",
)
def _(spark, d):
    s = table(spark, d, "lineitem").groupBy(
        F.col("l_returnflag").alias("model"),
        (F.col("l_suppkey") % 7).cast("int").alias("candidate"),
        (F.col("l_linenumber") % 5).cast("int").alias("fold"),
    ).agg(F.avg("l_quantity").alias("score"))
    out = V.fold_summary(s)
    return out.select(
        "model", "candidate", S.scaled(F.col("mean"), 4).alias("mean_e4"), S.scaled(F.col("std"), 4).alias("std_e4"), "folds"
    )
