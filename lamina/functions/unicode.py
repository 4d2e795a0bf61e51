"""Unicode normalisation, for which Spark has no function: an Arrow-batched UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfkc(c: Column) -> Column:
    @F.pandas_udf("string")
    def normalize(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else x if x.isascii() else unicodedata.normalize("NFKC", x))

    return normalize(c)
