"""Names and versions: edit distance with transpositions, near-name caps, numeric version order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType


def osa(a: str, b: str) -> int:
    """Optimal string alignment distance: insert, delete, substitute, or swap two neighbours."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


@pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b)], dtype="Int32")


def near_cap(name: Column) -> Column:
    """Edits that still make a near name: 2 from five characters on, else 1."""
    return F.when(F.length(name) >= 5, 2).otherwise(1)


def version_key(version: Column, segments: int = 4) -> Column:
    """Numeric segments of a dotted version, missing ones 0, to be compared as an array."""
    parts = F.split(F.coalesce(version, F.lit("")), r"\.")
    return F.transform(F.sequence(F.lit(1), F.lit(segments)), lambda i: F.coalesce(F.try_element_at(parts, i).try_cast("long"), F.lit(0).cast("long")))
