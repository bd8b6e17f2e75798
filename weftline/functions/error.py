"""The complementary error function, which SQL lacks, over arrays: for the few rows of a table of genes."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def _erfc(x: pd.Series) -> pd.Series:
    return x.map(lambda row: [None if v is None or v != v else math.erfc(v) for v in row])


def erfc(x: Column) -> Column:
    """Of each element of an array; NULL where it is NULL or not a number."""
    return F.pandas_udf(_erfc, ArrayType(DoubleType()))(x)
