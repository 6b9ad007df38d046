"""Operators beyond the listing system, marked ext_ in the catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the values of the newest right row at or before it.

    One exchange by key: both sides are stacked and the last right row is carried forward.
    """
    own = [c for c in left.columns if c not in (*keys, at)]
    a = left.select(*keys, at, F.lit(1).alias("_side"), F.struct(*own).alias("_l"), F.lit(None).cast(right.select(F.struct(*values).alias("r")).schema["r"].dataType).alias("_r"))
    b = right.select(*keys, at, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.struct(*values).alias("_r"))
    w = W.partitionBy(*keys).orderBy(F.col(at), "_side").rowsBetween(W.unboundedPreceding, 0)
    carried = a.unionByName(b).withColumn("_v", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    return carried.select(*keys, at, *(F.col(f"_l.{c}").alias(c) for c in own), *(F.col(f"_v.{v}").alias(v) for v in values))
