"""Scalar functions of plain numbers on columns: each different combination of arguments in a batch is worked out once."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def on_columns(f: Callable[..., float], *columns: Column | str) -> Column:
    """`f` of the columns, a double; null where one of them is null. `f` is a function of this library or of a module that tasks have."""

    @F.pandas_udf("double")
    def run(*arguments: pd.Series) -> pd.Series:
        rows = pd.concat([a.rename(i) for i, a in enumerate(arguments)], axis=1)
        known = rows.drop_duplicates().dropna()
        values = known.assign(value=[float(f(*row)) for row in known.itertuples(index=False, name=None)])
        return rows.merge(values, how="left", on=list(range(len(arguments))))["value"]

    return run(*columns)
