"""The audit report: every check of a sales table as one row of one table.

The table is read once into summaries, one row per (article, site, zone, day), with sums, least and greatest
values. Summaries of parts of a table merge into those of the whole, so batches can be filed and combined without
losing a repeat or a conflict across them. Dimensions are joined to the summaries, not to the sales rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_fractional, nan_to_null, percent, zone_differs
from ..operators.joins import unique_side
from ..operators.quality import SalesColumns

REPORT = ["check", "scope", "violations", "pct", "first_day", "last_day"]


def row_rules(c: SalesColumns, cutoff: float) -> dict[str, tuple[str, Column]]:
    """Checks a row can answer alone: scope and condition."""
    return {
        "missing_cost": (c.cost, F.col(c.cost).isNull()),
        "missing_price": (c.price, F.col(c.price).isNull()),
        "negative_margin": (c.price, F.col(c.price) < F.col(c.cost)),
        "non_positive_quantity": (c.quantity, F.col(c.quantity) <= 0),
        "fractional_quantity": (c.quantity, is_fractional(c.quantity)),
        "quantity_above_cutoff": (c.quantity, F.col(c.quantity) > cutoff),
    }


def summarise(sales: DataFrame, c: SalesColumns = SalesColumns(), cutoff: float = 50) -> DataFrame:
    """One row per (article, site, zone, day): rows, rows per broken rule, ranges of cost and price. NaN is null."""
    sums = [F.count_if(F.coalesce(rule, F.lit(False))).alias(f"n_{k}") for k, (_, rule) in row_rules(c, cutoff).items()]
    ranges = [f(v).alias(f"{name}_{v}") for v in (c.cost, c.price) for name, f in (("least", F.min), ("greatest", F.max))]
    return nan_to_null(sales).groupBy(*_keys(c)).agg(F.count(F.lit(1)).alias("copies"), *sums, *ranges)


def merge(summaries: DataFrame, c: SalesColumns = SalesColumns()) -> DataFrame:
    """Summaries of the whole from those of its parts."""
    sums = [F.sum(k).alias(k) for k in ["copies", *[f"n_{k}" for k in row_rules(c, 0)]]]
    ranges = [f(f"{name}_{v}").alias(f"{name}_{v}") for v in (c.cost, c.price) for name, f in (("least", F.min), ("greatest", F.max))]
    return summaries.groupBy(*_keys(c)).agg(*sums, *ranges)


def _keys(c: SalesColumns) -> list[str]:
    return [c.article, c.site, c.zone, c.day]


def report(summaries: DataFrame, sites: DataFrame, articles: DataFrame, c: SalesColumns = SalesColumns()) -> DataFrame:
    """Every check with its violations, their share of the sales rows in percent and their period.

    A site or article that its dimension lists twice is an error naming it. The zone rule rolls the summaries up to
    (article, zone, day), which all other checks join, so one aggregation answers all of them.
    """
    site = unique_side(sites, "site_id", {"_site_zone": "site_zone_id"}).withColumnRenamed("_dim_key", "_site")
    article = unique_side(articles, "article_id", {}).withColumnRenamed("_dim_key", "_article")
    met = summaries.join(site, F.col(c.site) == F.col("_site"), "left").join(
        article, F.col(c.article) == F.col("_article"), "left"
    )
    known = F.col(c.article).isNotNull() & F.col(c.site).isNotNull() & F.col(c.zone).isNotNull() & F.col(c.day).isNotNull()

    def counted(hit: Column, n: Column = F.col("copies")) -> Column:
        return F.sum(F.when(F.coalesce(hit, F.lit(False)), n).otherwise(0))

    def differs(v: str) -> Column:
        return F.col(f"least_{v}") < F.col(f"greatest_{v}")

    # name: (scope, number per (article, zone, day))
    checks = {
        "orphan_site": (c.site, counted(F.col("_site").isNull())),
        "unknown_article": (c.article, counted(F.col("_article").isNull())),
        "zone_mismatch": (c.zone, counted(zone_differs(c.zone, "_site_zone"))),
        **{k: (scope, F.sum(f"n_{k}")) for k, (scope, _) in row_rules(c, 0).items()},
        "duplicate_key": ("rows", counted(F.col("copies") > 1)),
        "cost_conflict": ("groups", counted(differs(c.cost) & known, F.lit(1))),
        "price_conflict": ("groups", counted(differs(c.price) & known, F.lit(1))),
    }
    zones = met.groupBy(c.article, c.zone, c.day).agg(
        F.sum("copies").alias("_rows"),
        *[n.alias(f"_n_{k}") for k, (_, n) in checks.items()],
        (F.min(f"least_{c.price}") < F.max(f"greatest_{c.price}")).alias("_rule"),
    )
    placed = F.col(c.article).isNotNull() & F.col(c.zone).isNotNull() & F.col(c.day).isNotNull()
    zones = zones.withColumn("_n_zone_price_rule", F.coalesce(F.col("_rule") & placed, F.lit(False)).cast("bigint"))
    scopes = {k: scope for k, (scope, _) in checks.items()} | {"zone_price_rule": "groups"}
    sums = [F.sum("_rows").alias("_rows")]
    for k in scopes:
        hit = F.col(f"_n_{k}") > 0
        sums += [
            F.sum(f"_n_{k}").alias(f"_s_{k}"),
            F.min(F.when(hit, F.col(c.day))).alias(f"_a_{k}"),
            F.max(F.when(hit, F.col(c.day))).alias(f"_z_{k}"),
        ]
    rows = F.coalesce("_rows", F.lit(0))
    cells = [
        F.struct(
            F.lit(k).alias("check"),
            F.lit(scope).alias("scope"),
            (n := F.coalesce(F.col(f"_s_{k}"), F.lit(0))).cast("bigint").alias("violations"),
            percent(n, rows).alias("pct"),
            F.col(f"_a_{k}").alias("first_day"),
            F.col(f"_z_{k}").alias("last_day"),
        )
        for k, scope in scopes.items()
    ]
    return zones.agg(*sums).select(F.inline(F.array(*cells))).select(*REPORT)


def audit_report(
    sales: DataFrame,
    sites: DataFrame,
    articles: DataFrame,
    columns: SalesColumns = SalesColumns(),
    cutoff: float = 50,
) -> DataFrame:
    """Every check with its violations, their share of the sales rows in percent and their period."""
    return report(summarise(sales, columns, cutoff), sites, articles, columns)
