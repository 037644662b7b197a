"""Exact positions, running totals and quantiles for groups of any size.

A plain window sorts each group in one task. A group holding a third of the table would then be one
task, so the rows are range-partitioned on group *and* order columns first: a large group spreads over
many slices, every slice is worked on alone, and only one summary row per (group, slice) is carried
over. Slices are checkpointed because two branches read them and must see the same boundaries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, written
from .keys import join_same, measured

SLICE = "_slice"
PLACE = "_place"
TIE = "_tie"
#: Bytes of a slice as written, about, and the least that is worth a slice of its own.
SLICE_BYTES, LEAST_BYTES = 64 << 20, 1 << 18


def slice_count(spark: SparkSession, size: int) -> int:
    """Slices for so many bytes: as many as SLICE_BYTES asks for, and for less than that no more than there are cores
    and LEAST_BYTES for each."""
    few = min(spark.sparkContext.defaultParallelism, -(-size // LEAST_BYTES))
    return max(1, few, -(-size // SLICE_BYTES))


def laid_out(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """The rows in order over slices whose number follows from the bytes written, not from a setting.

    Rows are written before they are laid out, so that finding the boundaries does not compute them again. Equal keys
    are told apart by a hash of the row and its place among the written ones: a slice may end anywhere among them.
    """
    whole, size = written(df, "unordered")
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    ties = {f"{TIE}_hash": F.xxhash64(*[F.col(f"`{c}`") for c in plain]), f"{TIE}_at": F.monotonically_increasing_id()}
    keys = [*order, *ties]
    return whole.withColumns(ties).repartitionByRange(slice_count(df.sparkSession, size), *keys).sortWithinPartitions(*keys).drop(*ties)


def range_slices(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Globally ordered slices with the slice number and the place of each row in the order."""
    laid = laid_out(df, [*by, *order]).withColumn(PLACE, F.monotonically_increasing_id())
    return cut_lineage(laid.withColumn(SLICE, F.shiftright(PLACE, 33)))


def number_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    seq: str = "seq",
    total: str | None = "n",
) -> DataFrame:
    """1-based position in the group under a total order, and optionally the group's row count."""
    laid = range_slices(df, by, order)
    spans = laid.groupBy(*by, SLICE).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(PLACE).alias("_first")
    )
    # one row per (group, slice): at most as many rows per group as there are slices
    group = Window.partitionBy(*by)
    ahead = group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        *by,
        SLICE,
        (F.coalesce(F.sum("_rows").over(ahead), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        F.sum("_rows").over(group).alias("_total"),
    )
    joined = join_same(laid, measured(spans), [*by, SLICE], "inner")
    out = [*df.columns, (F.col(PLACE) + F.col("_shift")).cast("bigint").alias(seq)]
    if total:
        out.append(F.col("_total").cast("bigint").alias(total))
    return joined.select(*out)


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    amount: str,
    before: str = "before",
    total: str = "total",
) -> DataFrame:
    """Sum of ``amount`` over all earlier rows of the group (exclusive) and over the whole group."""
    laid = range_slices(df, by, order)
    inside = (
        Window.partitionBy(*by, SLICE).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = laid.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    group = Window.partitionBy(*by)
    ahead = group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        laid.groupBy(*by, SLICE)
        .agg(F.sum(amount).alias("_rows"))
        .select(
            *by,
            SLICE,
            F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_ahead"),
            F.sum("_rows").over(group).alias("_total"),
        )
    )
    return join_same(local, measured(spans), [*by, SLICE], "inner").select(
        *df.columns,
        (F.col("_inside") + F.col("_ahead")).alias(before),
        F.col("_total").alias(total),
    )


# Ranks of the quantile sketch are off by at most rows / SKETCH; brackets leave ten times that room on both sides.
SKETCH = 10_000


def _brackets(values: DataFrame, probs: dict[str, float], by: Sequence[str], also: Sequence[Column]) -> DataFrame:
    """Per group: a value range around every wanted rank, and further aggregates."""
    room = 10.0 / SKETCH
    ends = []
    for p in probs.values():
        ends += [max(0.0, p - room), min(1.0, p + room)]
    return values.groupBy(*by).agg(F.percentile_approx("_v", F.array(*[F.lit(e) for e in ends]), SKETCH).alias("_ends"), *also)


def _near_ranks(values: DataFrame, brackets: DataFrame, wanted: int, by: Sequence[str]) -> DataFrame:
    """Counts per value near the wanted ranks; all values between two brackets fold into one row (first, last, count).

    What is shuffled is a few rows per group and task plus a few thousandths of the distinct values.
    """
    known = values.where(F.col("_v").isNotNull())
    if by:
        seen = join_same(known, brackets.select(*by, "_ends"), by, "inner")
    else:
        seen = known.withColumn("_ends", brackets.select("_ends").scalar())
    near, gap = F.lit(False), F.lit(0)
    for i in range(wanted):
        low, high = F.col("_ends")[2 * i], F.col("_ends")[2 * i + 1]
        near = near | F.col("_v").between(low, high)
        gap = gap + (F.col("_v") > high).cast("int")
    return (
        seen.groupBy(*by, gap.alias("_gap"), F.when(near, F.col("_v")).alias("_near"))
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_v"), F.max("_v").alias("_last"))
        .select(*by, "_v", "_last", "_c")
    )


def _at_ranks(counts: DataFrame, probs: dict[str, float], by: Sequence[str]) -> DataFrame:
    """Per group and wanted rank the row of the counts that holds it: its first and last value, rows up to its end
    and rows in it."""
    laid = range_slices(counts, by, ["_v"])
    group = Window.partitionBy(*by)
    ahead = group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        laid.groupBy(*by, SLICE)
        .agg(F.sum("_c").alias("_rows"))
        .select(
            *by,
            SLICE,
            "_rows",
            F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_ahead"),
            F.sum("_rows").over(group).alias("_n"),
        )
    )
    # only slices that hold a wanted rank are looked at row by row
    held = F.lit(False)
    for p in probs.values():
        place = F.lit(float(p)) * (F.col("_n") - 1)
        held = held | (
            (F.col("_ahead") <= F.ceil(place)) & (F.floor(place) < F.col("_ahead") + F.col("_rows"))
        )
    inside = (
        Window.partitionBy(*by, SLICE).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    )
    wanted = measured(spans.where(held).drop("_rows"))
    ranked = join_same(laid, wanted, [*by, SLICE], "inner").withColumn(
        "_upto", F.col("_ahead") + F.sum("_c").over(inside)
    )
    picks = [F.max("_n").alias("_n")]
    for name, p in probs.items():
        place = F.lit(float(p)) * (F.col("_n") - 1)
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            hit = F.min(F.when(F.col("_upto") > rank, F.struct("_v", "_last", "_upto", "_c")))
            picks.append(hit.alias(f"_{side}_{name}"))
    return ranked.groupBy(*by).agg(*picks)


def _settled(probs: dict[str, float]) -> tuple[list[Column], Column, list[Column]]:
    """From the rows that hold the wanted ranks: the quantiles, whether a rank lies too deep between brackets, and
    the brackets that would have held it."""
    settled, missed, ends = [], F.lit(False), []
    for i, (name, p) in enumerate(probs.items()):
        place = F.lit(float(p)) * (F.col("_n") - 1)
        both = []
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            row = F.col(f"_{side}_{name}")
            first, last = rank == row["_upto"] - row["_c"], rank == row["_upto"] - 1
            same = row["_v"] == row["_last"]
            missed = missed | ~(first | last | same)
            both.append(F.when(first | same, row["_v"]).otherwise(row["_last"]))
        settled.append((both[0] + (both[1] - both[0]) * (place - F.floor(place))).alias(name))
        ends += [
            F.least(F.col("_ends")[2 * i], F.col(f"_lo_{name}._v")),
            F.greatest(F.col("_ends")[2 * i + 1], F.col(f"_hi_{name}._last")),
        ]
    return settled, missed, ends


def quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: Sequence[str] = (),
    also: dict[str, Callable[[str], Column]] | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group; null and NaN values are ignored.

    Two passes over the rows, whatever the size of a group: a sketch finds where the wanted ranks lie, an exact
    count of what lies before and around them settles the values. The first and last value between brackets are
    known too. Should a rank lie deeper between brackets, the bracket is widened to what the exact counts say and
    the second pass repeated. ``also`` adds aggregates of the value to the first pass. A group without values has
    null quantiles.
    """
    values = df.select(*by, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("_v"))
    extra = [f("_v").alias(name) for name, f in (also or {}).items()]
    brackets = measured(_brackets(values, probs, by, extra))
    names = list(also or {})
    while True:
        found = cut_lineage(_at_ranks(_near_ranks(values, brackets, len(probs), by), probs, by), "ranks")
        settled, missed, ends = _settled(probs)
        if found.where(missed).isEmpty():
            break
        if by:
            beside = join_same(brackets, found, by, "left")
        else:
            beside = brackets.withColumns({k: found.select(k).scalar() for k in found.columns})
        brackets = measured(beside.select(*by, *names, F.array(*ends).alias("_ends")))
    if by:
        return join_same(brackets.select(*by, *names), found.select(*by, *settled), by, "left")
    return found.select(*settled).withColumns({n: brackets.select(n).scalar() for n in names})


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: dict[str, float], also: dict[str, Callable[[str], Column]] | None = None
) -> DataFrame:
    """As :func:`quantiles` for several columns at once, one row per column; rows are never laid out by column.

    One aggregate sketches all columns, a second counts what lies between the brackets of each, and only values
    inside brackets become rows of their own, counted per task before they are shuffled.
    """
    names, room = list(also or {}), 10.0 / SKETCH
    value = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in columns}
    values = df.select(*[v.alias(f"_v{i}") for i, v in enumerate(value.values())])
    wanted = F.array(*[F.lit(e) for p in probs.values() for e in (max(0.0, p - room), min(1.0, p + room))])
    sketched = []
    for i in range(len(columns)):
        extra = [f(f"_v{i}").alias(n) for n, f in (also or {}).items()]
        sketched.append(F.struct(F.percentile_approx(f"_v{i}", wanted, SKETCH).alias("_ends"), *extra).alias(f"c{i}"))
    row = values.agg(*sketched)
    tall = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), f"c{i}._ends", *[f"c{i}.{n}" for n in names]) for i, c in enumerate(columns)]))
    brackets = cut_lineage(row.select(tall), "brackets")
    while True:
        known = {r["column"]: r["_ends"] for r in brackets.collect()}  # a row per column
        counts = _column_counts(values, [known[c] for c in columns], columns)
        found = cut_lineage(_at_ranks(counts, probs, ["column"]), "ranks")
        settled, missed, ends = _settled(probs)
        if found.where(missed).isEmpty():
            break
        beside = join_same(brackets, found, ["column"], "left")
        brackets = cut_lineage(beside.select("column", *names, F.array(*ends).alias("_ends")), "brackets")
    return join_same(brackets.select("column", *names), found.select("column", *settled), ["column"], "left")


def _column_counts(values: DataFrame, ends: list[list[float] | None], columns: Sequence[str]) -> DataFrame:
    """(column, first, last, count): counts per value inside brackets, and of all values between two of them."""
    between, near = [], []
    for i, (c, own) in enumerate(zip(columns, ends)):
        if own is None:
            continue
        v = F.col(f"_v{i}")
        pairs = list(zip(own[::2], own[1::2]))
        inside = F.coalesce(reduce(lambda a, b: a | b, [v.between(F.lit(lo), F.lit(hi)) for lo, hi in pairs]), F.lit(False))
        gap = sum(((v > F.lit(hi)).cast("int") for _, hi in pairs), F.lit(0))
        for g in range(len(pairs) + 1):
            here = F.when(~inside & (gap == g), v)
            between.append(F.struct(F.lit(c).alias("column"), F.min(here).alias("_v"), F.max(here).alias("_last"), F.count(here).alias("_c")))
        near.append((inside, F.when(inside, F.struct(F.lit(c).alias("column"), v.alias("_v")))))
    if not near:
        return values.limit(0).select(F.lit("").alias("column"), *[F.lit(0.0).alias(k) for k in ("_v", "_last")], F.lit(0).cast("bigint").alias("_c"))
    folded = values.agg(*[b.alias(f"b{k}") for k, b in enumerate(between)])
    folded = folded.select(F.inline(F.array(*[f"b{k}" for k in range(len(between))]))).where("_c > 0")
    held = values.where(reduce(lambda a, b: a | b, [n[0] for n in near]))
    held = held.select(F.explode(F.array_compact(F.array(*[n[1] for n in near]))).alias("_p")).groupBy("_p.column", "_p._v").agg(F.count(F.lit(1)).alias("_c"))
    return folded.unionByName(held.withColumn("_last", F.col("_v")))
