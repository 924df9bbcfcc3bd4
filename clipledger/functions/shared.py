"""Small expression helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INTEGER = r"^[0-9]{1,18}$"
_REAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$|^[+-]?(?:[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])$"


def whole_number(text: Column, kind: str = "bigint") -> Column:
    """Digits as a number, else null. The pattern keeps failing casts, which are slow, rare."""
    return F.when(text.rlike(_INTEGER), text.try_cast(kind))


def real_number(text: Column) -> Column:
    return F.when(text.rlike(_REAL), text.try_cast("double"))


def computed_once(df: DataFrame, name: str, value: Column, *keep: str) -> DataFrame:
    """``keep`` plus one computed column that later filters do not compute again.

    A filter on a plain column is pushed below its projection together with a copy of
    the expression; it is not pushed below a generator.
    """
    return df.select(*keep, F.explode_outer(F.array(value)).alias(name))
