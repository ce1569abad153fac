"""Small helpers shared by the plan modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import Tables

# Doubles are rounded to this many decimals in registered outputs, on both
# the Spark and the SQL side, so that summation order cannot change a value.
SCALE = 6


def tables(spark, sf_dir) -> Tables:
    return Tables(spark, sf_dir)


def rounded(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """Round every double/float column (top level) to ``scale`` decimals."""
    cols = []
    for name, typ in df.dtypes:
        if typ in ("double", "float"):
            cols.append(F.round(F.col(name).cast("double"), scale).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)
