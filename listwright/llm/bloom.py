"""A Bloom filter of fixed size that spares rows the exchange before a selective join.

False positives only cost their exchange: the join behind the filter decides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the filter (8 MB), however many keys it holds.
BLOOM = 1 << 20


def bloom(keys: DataFrame, name: str) -> np.ndarray:
    """A filter of fixed size over a column of longs; however many keys, the driver sees at most BLOOM words."""
    h = [F.xxhash64(F.lit(i), F.col(name)) for i in range(3)]
    bits = keys.select(F.explode(F.array(*h)).alias("h")).select(F.pmod("h", F.lit(BLOOM)).cast("int").alias("w"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 58) AS INT))").alias("b"))
    out = np.zeros(BLOOM, np.int64)
    words = bits.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out


def maybe(df: DataFrame, name: str, words: np.ndarray) -> DataFrame:
    """Rows of ``df`` that the filter may hold; saves their exchange, the join after it decides."""
    sent = df.sparkSession.sparkContext.broadcast(words)
    h = [F.xxhash64(F.lit(i), F.col(name)) for i in range(3)]

    @F.pandas_udf("boolean")
    def held(a, b, c):
        import pandas as pd

        ok = np.ones(len(a), bool)
        for x in (a, b, c):
            v = x.to_numpy()
            ok &= (sent.value[v % BLOOM] >> (v.view(np.uint64) >> np.uint64(58)).astype(np.int64)) & 1 == 1
        return pd.Series(ok)

    return df.filter(held(*h))
