"""Mixing sources to target weights by Poisson replication.

Every source gets a mean repetition rate: target share x output size / source size.  A document's
count is the inverse of the Poisson distribution at a uniform number hashed from its id and the
seed, so a rerun gives the same counts and the order of rows has no part in it.  Documents are exploded by their
counts and shuffled globally by a hash of (id, copy, seed).

Only built-in expressions are used.  Source sizes come from one aggregate with map-side combine; the
table of rates and distributions has one row per source.  Each output row falls into a hash range, so a source with a
third of all rows spreads over all tasks.

Defined results: a null source is a source of its own; null texts are documents like others, as every row
counts one; sources without a target share get the rest in equal parts, or nothing if ``rest`` is false; an empty
table gives an empty table; rows that repeat a doc_id and source draw the same count.  The result has the input's
columns, copy_no and shuffle_key; input columns of these two names are replaced, all others pass whatever their name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, table

SEED = 17
#: Probabilities of all sources together (8 bytes each) that are sent to every task; beyond it the join is shuffled.
MOST_ENTRIES = 2_000_000


def uniform(*parts: Column, seed: int = SEED) -> Column:
    """52 hash bits of the parts' texts, as a number in (0, 1)."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def rates(docs: DataFrame, targets: dict[str, float] | None = None, size: float = 1.0, rest: bool = True) -> DataFrame:
    """source, rows, rate.  ``targets`` holds shares by source; ``size`` is the output's size over the input's."""
    own = docs.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("_rows"))
    share = F.lit(None).cast("double")
    for name, value in (targets or {}).items():
        share = F.when(F.col("_source") == name, F.lit(float(value))).otherwise(share)
    own = own.withColumn("_share", share)
    whole = own.agg(F.sum("_rows").alias("_all"), F.coalesce(F.sum("_share"), F.lit(0.0)).alias("_given"), F.count_if(F.col("_share").isNull()).alias("_open"))
    left = F.greatest(F.lit(0.0), 1 - F.col("_given")) / F.col("_open") if rest else F.lit(0.0)
    # ``whole`` is one row of three numbers.
    return own.crossJoin(F.broadcast(whole)).select("_source", "_rows", (F.coalesce("_share", left) * F.col("_all") * F.lit(float(size)) / F.col("_rows")).alias("_rate"))


def distributions(own: DataFrame) -> DataFrame:
    """_source, _first, _cdf: cumulative Poisson probabilities of the counts _first, _first + 1, ...

    Both ends lie where the tails are below any hashed number, so an array has some 24 root(rate) entries, also for
    a small source with a large rate.  Point probabilities are taken by logarithms, so large rates do not underflow.
    Sources with rate 0 have no row.
    """
    rate, k, n = F.col("_rate"), F.col("_k"), F.col("_first").cast("double")
    reach = 12 * F.sqrt(rate) + 24
    first = F.when(rate < 1000, F.lit(0)).otherwise(F.floor(rate - reach)).cast("long")
    points = own.filter(rate > 0).select("_source", "_rate", first.alias("_first"), F.explode(F.sequence(first, F.ceil(rate + reach).cast("long"))).alias("_k"))
    up = Window.partitionBy("_source").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    # The logarithm of _first! by Stirling's series (_first is 0 or some hundreds at least), then factor by factor.
    start = F.when(n > 0, n * F.log(n) - n + F.log(2 * math.pi * n) / 2 + 1 / (12 * n) - 1 / (360 * n * n * n)).otherwise(0.0)
    factors = F.sum(F.when(k > F.col("_first"), F.log(k.cast("double"))).otherwise(0.0)).over(up)
    summed = points.withColumn("_p", F.exp(k * F.log(rate) - rate - start - factors)).withColumn("_c", F.sum("_p").over(up))
    return summed.groupBy("_source", "_first").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_c"))), lambda x: x["_c"]).alias("_cdf"))


def mix(docs: DataFrame, targets: dict[str, float] | None = None, size: float = 1.0, seed: int = SEED, rest: bool = True) -> DataFrame:
    """Whole documents repeated by their sources' rates, with copy_no (from 0) and shuffle_key."""
    table_of_rates = keep(distributions(rates(docs, targets, size, rest)), "distributions")
    if table_of_rates.agg(F.coalesce(F.sum(F.size("_cdf")), F.lit(0))).first()[0] <= MOST_ENTRIES:
        table_of_rates = F.broadcast(table_of_rates)
    passed = [f"`{c}`" for c in docs.columns if c not in ("copy_no", "shuffle_key")]
    # The documents travel as one column, so that no name of theirs meets a name used here.
    rows = docs.select(F.struct(*passed).alias("_row"), F.col("source").alias("_own"), F.col("doc_id").alias("_id"))
    drawn = rows.join(table_of_rates, F.col("_own").eqNullSafe(F.col("_source"))).withColumn("_u", uniform(F.col("_id"), seed=seed))
    count = (F.col("_first") + F.size(F.filter("_cdf", lambda c: c < F.col("_u")))).cast("int")
    copies = drawn.select("_row", "_id", count.alias("_n")).filter("_n > 0").select("_row", "_id", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("copy_no"))
    return copies.select("_row.*", "copy_no", uniform(F.col("_id"), F.col("copy_no"), seed=seed + 1).alias("shuffle_key"))


def shuffled(mixed: DataFrame) -> DataFrame:
    """The global order: hash ranges over all tasks, sorted within each."""
    return mixed.repartitionByRange(F.col("shuffle_key")).sortWithinPartitions("shuffle_key", "doc_id", "copy_no")


#: The production mixture: shares of four sources; all other sources share the rest (0.55) in equal parts.
TARGETS = {"src0": 0.15, "src1": 0.12, "src2": 0.10, "src3": 0.08}


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Whole documents are repeated and shuffled; their texts' digests are taken behind the shuffle."""
    mixed = shuffled(mix(table(spark, sf_dir, "documents"), TARGETS))
    return mixed.select("doc_id", "source", "copy_no", "shuffle_key", F.octet_length("text").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


SHARES = " ".join(f"WHEN source = '{k}' THEN {v}" for k, v in TARGETS.items())
SQL = f"""
WITH s AS (SELECT source, count(*) AS n, CASE {SHARES} END AS share FROM documents GROUP BY source),
w AS (SELECT sum(n) AS total, coalesce(sum(share), 0) AS given, count(*) FILTER (WHERE share IS NULL) AS open FROM s),
r AS (SELECT source, coalesce(share, greatest(0, 1 - given) / open) * total / n AS rate FROM s, w),
k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 24) AS BIGINT) + 1)) AS k FROM r),
c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
u AS (SELECT doc_id, source, text, (CAST('0x' || substr(md5('{SEED}|' || doc_id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents),
m AS (SELECT doc_id, u.source, any_value(u.text) AS text, count(*) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf < u.u GROUP BY doc_id, u.source)
SELECT doc_id, source, CAST(copy_no AS INTEGER) AS copy_no, (CAST('0x' || substr(md5('{SEED + 1}|' || doc_id || '|' || copy_no), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS shuffle_key,
  octet_length(encode(text)) AS n_bytes, sha256(text) AS text_sha256
FROM (SELECT doc_id, source, text, unnest(range(0, n)) AS copy_no FROM m)
"""
