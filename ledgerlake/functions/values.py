from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

MONEY = "decimal(12,2)"
RATE = "decimal(5,2)"


def money(value: Column) -> Column:
    return value.cast(MONEY)


def rate(value: Column) -> Column:
    return value.cast(RATE)


def whole(value: Column) -> Column:
    """Rounded to INT (a plain cast would cut off the fraction)."""
    return F.rint(value.cast("double")).cast("int")


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def python_commas(value: Column) -> Column:
    """Amount rounded to cents with thousands commas and no needless last zero: 1,234.5"""
    return F.regexp_replace(F.format_number(value, 2), "0$", "")


def customer_tier(score: Column) -> Column:
    return F.when(score >= 12, "Platinum").when(score >= 8, "Gold").otherwise("Standard")


def is_high_value(tier: Column) -> Column:
    return F.coalesce(tier.isin("Platinum", "Gold"), F.lit(False)).cast("int")


def period_label(year: Column, month: Column) -> Column:
    return F.format_string("%d-%02d", year, month)


def short_name(name: Column, width: int = 40) -> Column:
    return F.when(F.length(name) > width, F.concat(F.substring(name, 1, width), F.lit("..."))).otherwise(name)


def presentable(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, decimals as double."""

    def shown(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            # Fraction shown only when there is one, as ISO text usually is.
            seconds = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
            column = F.when(F.date_format(column, "SSSSSS") == "000000", seconds).otherwise(
                F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            )
        elif isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        return column.alias(field.name)

    return df.select(*[shown(f) for f in df.schema.fields])
