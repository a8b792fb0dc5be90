"""Complex numbers as struct<re:double,im:double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def complex_(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def minus(a: Column, b: Column) -> Column:
    return complex_(a["re"] - b["re"], a["im"] - b["im"])


def residual(data: Column, model: Column) -> Column:
    """Differences of two arrays of complex numbers."""
    return F.zip_with(data, model, minus)


def amplitude(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def missing(re: Column, im: Column) -> Column:
    """Zero in both parts, or no number in either."""
    return (F.isnan(re) | F.isnan(im) | ((re == 0) & (im == 0))) | re.isNull() | im.isNull()
