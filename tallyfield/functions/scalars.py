"""Column expressions with the null rules of the jobs they serve. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Courtesy titles folded into one rare class, and spellings of "Miss".
RARE_TITLES = ["Lady", "Countess", "Capt", "Col", "Don", "Dr", "Major", "Rev", "Sir", "Jonkheer", "Dona"]
MISS_TITLES = ["Mlle", "Ms", "Mme"]
TITLE_PATTERN = r"([A-Za-z]+)\."
# ISO order times need a fraction and an offset, written +01:00, +0100 or Z.
ORDER_TIME_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXX"]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn stored NaN into NULL in every float column; Spark would count NaN as a value."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[F.nanvl(c, F.lit(None)).alias(c) if c in floats else F.col(c) for c in df.columns])


def select_present(df: DataFrame, names: list[str]) -> DataFrame:
    """Select in the given order, skipping names the table does not have."""
    return df.select(*[n for n in names if n in df.columns])


def parse_day(c: str | Column) -> Column:
    """Text to date; anything that is no date becomes null."""
    return F.try_to_date(_col(c))


def is_unparsed_day(c: str | Column) -> Column:
    return _col(c).isNotNull() & parse_day(c).isNull()


def order_day(c: str | Column) -> Column:
    """ISO time with fraction and offset, to its UTC day; other shapes become null.

    Works on the epoch, so the session time zone has no say.
    """
    instant = F.coalesce(*[F.try_to_timestamp(_col(c), F.lit(f)) for f in ORDER_TIME_FORMATS])
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / 86400).cast("int"))


def is_fractional(c: str | Column) -> Column:
    """True for values that are no whole number, null and NaN included."""
    x = _col(c)
    return F.coalesce((x % 1 != 0) | F.isnan(x.cast("double")), F.lit(True))


def has_space(c: str | Column) -> Column:
    return _col(c).cast("string").contains(" ")


def has_stray_quote(c: str | Column) -> Column:
    return _col(c).rlike('"')


def difference(a: str | Column, b: str | Column) -> Column:
    """a - b, null if either is null (margin = price - cost)."""
    return _col(a) - _col(b)


def family_size(siblings: str | Column, parents: str | Column) -> Column:
    return _col(siblings) + _col(parents) + 1


def floor_to(c: str | Column, width: float) -> Column:
    """Lower edge of the width-wide bin."""
    return F.floor(_col(c) / width) * width


def first_letter(c: str | Column, default: str = "U") -> Column:
    """First character; null and empty text give the default."""
    return F.coalesce(F.nullif(F.substring(_col(c), 1, 1), F.lit("")), F.lit(default))


def extract_first(c: str | Column, pattern: str = TITLE_PATTERN) -> Column:
    """First capture of the pattern; no match is null, not empty text."""
    return F.nullif(F.regexp_extract(_col(c), pattern, 1), F.lit(""))


def recode(c: str | Column, groups: dict[str, list[str]]) -> Column:
    """Replace every listed value by its group name, keep the others."""
    x = _col(c)
    out = None
    for name, members in groups.items():
        out = (F if out is None else out).when(x.isin(members), F.lit(name))
    return x if out is None else out.otherwise(x)


def title_class(name: str | Column) -> Column:
    return recode(extract_first(name), {"Rare": RARE_TITLES, "Miss": MISS_TITLES})


def fill(c: str | Column, value) -> Column:
    return F.coalesce(_col(c), F.lit(value))


def whole(c: str | Column) -> Column:
    """Fill null with 0 and narrow to bigint."""
    return F.coalesce(_col(c), F.lit(0)).cast("bigint")


def month_of(day: str | Column) -> Column:
    return F.month(_col(day))


def weekday_of(day: str | Column) -> Column:
    """Monday = 0."""
    return F.weekday(_col(day))


def zone_differs(a: str | Column, b: str | Column) -> Column:
    """a <> b where a missing side counts as different."""
    return F.coalesce(_col(a) != _col(b), F.lit(True))


def scaled(x: Column, digits: int = 6) -> Column:
    """Half-up fixed-point integer of a float, for results that must agree to the digit across engines."""
    return F.floor(x * float(10**digits) + 0.5).cast("bigint")


def percent(part: Column, base: Column) -> Column:
    """Share in percent, null for an empty base."""
    return part * 100.0 / F.nullif(base, F.lit(0))


def product_label(name: str | Column, ident: str | Column) -> Column:
    """``name [id]``; null when there is no name."""
    named = F.nullif(_col(name), F.lit(""))
    return F.when(
        named.isNotNull(),
        F.when(_col(ident).isNull(), named).otherwise(F.format_string("%s [%d]", named, _col(ident).cast("bigint"))),
    )


def suggestion_line(probability: str | Column, *labels: str | Column) -> Column:
    """`` 0.42  a / b / c`` with absent labels left out."""
    return F.concat(
        F.format_string(" %.2f  ", _col(probability)), F.concat_ws(" / ", *[_col(x) for x in labels])
    )
