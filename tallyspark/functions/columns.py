"""Identity, bucket, threshold and quantile expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_id(key: Column) -> Column:
    """A key's 128-bit identity as 32 hex characters; hex order is byte order."""
    return F.md5(key.cast("binary"))


def bucket_of(key: Column, width: int) -> Column:
    """The bucket of a key in a table of `width`: leading 32 bits of its identity, modulo width."""
    return F.pmod(F.conv(F.substring(key_id(key), 1, 8), 16, 10).cast("long"), F.lit(width)).cast("int")


def strict_threshold(mass: Column, n: int) -> Column:
    """The least count above mass / n: floor(mass / n) + 1, in whole numbers."""
    return F.floor((mass - F.pmod(mass, F.lit(n))) / n).cast("long") + 1


def ratio(a: Column, b: Column, otherwise: float) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise))


def nearest_rank(df: DataFrame, by: list[str], value: str, alpha: float, name: str) -> DataFrame:
    """The value of rank ceil(alpha * n) in each group: least for alpha <= 0, largest for alpha >= 1."""
    order = Window.partitionBy(*by).orderBy(value)
    n = F.count("*").over(Window.partitionBy(*by))
    rank = F.greatest(F.lit(1), F.least(n, F.ceil(n * F.lit(alpha))))
    picked = df.filter(F.col(value).isNotNull()).select(*by, value, F.row_number().over(order).alias("_i"), rank.alias("_rank"))
    return picked.filter("_i = _rank").select(*by, F.col(value).alias(name))


def truncated_rank(df: DataFrame, by: list[str], value: str, fraction: float, name: str) -> DataFrame:
    """The value at place int(fraction * (n - 1)) from 0."""
    order = Window.partitionBy(*by).orderBy(value)
    n = F.count("*").over(Window.partitionBy(*by))
    picked = df.select(*by, value, (F.row_number().over(order) - 1).alias("_i"), F.floor((n - 1) * F.lit(fraction)).alias("_at"))
    return picked.filter("_i = _at").select(*by, F.col(value).alias(name))


def linear_quantile(value: str, fraction: float) -> Column:
    return F.expr(f"percentile(`{value}`, {fraction})")
