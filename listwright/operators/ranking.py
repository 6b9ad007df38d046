"""Ordered picks: latest, best by priority, renumbered, compared with the entry before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import topic_score
from ..model import PHOTO_CATEGORIES, lookup
from ..shared import fresh_folder


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of every key; give a total order for repeatable picks."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def latest_analysis(analyses: DataFrame, source: str | None = None, skip: str | None = "auto") -> DataFrame:
    own = analyses.filter(F.col("source") == source) if source else analyses.filter(F.col("source") != skip) if skip else analyses
    return top(own, ["listing_id"], [F.col("created_at").desc(), F.col("id").asc()])


def best_analysis(analyses: DataFrame) -> DataFrame:
    """Newest within the best class of source names (by what they contain)."""
    s = F.lower("source")
    rank = F.when(s.contains("mistral-tools"), 0).when(s.contains("mistral"), 1).when(s.contains("claude"), 2).otherwise(3)
    return top(analyses.withColumn("_p", rank), ["listing_id"], [F.col("_p"), F.col("created_at").desc(), F.col("id").asc()]).drop("_p")


def best_analysis_by_prefix(analyses: DataFrame) -> DataFrame:
    """The report script's order (by how names begin)."""
    s = F.coalesce("source", F.lit(""))
    rank = F.when(s.startswith("local:mistral-tools/"), 0).when(s.startswith("claude"), 1).when(s.startswith("local:claude/"), 2).otherwise(3)
    return top(analyses.withColumn("_p", rank), ["listing_id"], [F.col("_p"), F.col("created_at").desc(), F.col("id").asc()]).drop("_p")


def recent_snippets(analyses: DataFrame, n: int = 3, size: int = 600, default: str = "Analýza") -> DataFrame:
    """listing_id, snippets: ``[title]: text`` of the newest analyses."""
    own = top(analyses, ["listing_id"], [F.col("created_at").desc(), F.col("id").asc()], n, "_k")
    line = F.concat(F.lit("["), F.coalesce("title", F.lit(default)), F.lit("]: "), F.left("content", F.lit(size)))
    return own.groupBy("listing_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", line.alias("line")))), lambda x: x["line"]).alias("snippets"))


def price_deltas(history: DataFrame) -> DataFrame:
    """Each entry with its change against the entry before; null if either price is."""
    before = F.lag("price").over(W.partitionBy("listing_id").orderBy("recorded_at", "price"))
    return history.withColumn("delta", F.col("price") - before)


def price_log(observed: DataFrame) -> DataFrame:
    """Of (listing_id, price, recorded_at) observations, those a merge would log, with percent change."""
    w = W.partitionBy("listing_id").orderBy("recorded_at", "price")
    own = observed.filter("price IS NOT NULL").withColumn("old_price", F.lag("price").over(w)).filter("old_price IS NULL OR old_price <> price")
    return own.withColumn("change_pct", F.when(F.col("old_price") != 0, F.bround(((F.col("price") - F.col("old_price")) / F.col("old_price") * 100).cast("double"), 1)))


def photos_by_category(photos: DataFrame) -> DataFrame:
    """Classified photos renumbered from 1 by category priority, then old order."""
    rank = lookup(PHOTO_CATEGORIES, F.col("photo_category"), F.lit(99))
    w = W.partitionBy("listing_id").orderBy(rank, "order_index", "id")
    return photos.filter("photo_category IS NOT NULL").withColumn("new_order", F.row_number().over(w))


def numbered_after(new: DataFrame, existing: DataFrame, key: str, name: str, tasks: int | None = None) -> DataFrame:
    """Rows of ``new`` whose ``name`` the key does not hold yet, numbered on from its present count.

    ``tasks`` (:func:`shared.tasks_for`) is the number that joins and numbering are dealt to, else it is the session's.
    """
    by = lambda df, *keys: df if tasks is None else df.repartition(tasks, *keys)
    fresh = by(new.join(by(existing.select(key, name), key, name), [key, name], "left_anti"), key)
    have = by(existing.select(key), key).groupBy(key).agg(F.count("*").alias("_have"))
    return fresh.join(have, key, "left").withColumn("position", F.row_number().over(W.partitionBy(key).orderBy(name)) + F.coalesce("_have", F.lit(0))).drop("_have")


def deduplicated_first(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The first row of every key by position."""
    return top(df, keys, [F.col(position).asc()])


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Row numbers from 1 over the whole table: ranges of the order, numbered within, after the counts of the ranges before.

    The ranges are written once, so that counts and numbers come from the same cut.
    """
    cut = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    cut.write.parquet(path := f"{fresh_folder(df.sparkSession, 'kept')}/ranges")
    ranged = df.sparkSession.read.schema(cut.schema).parquet(path)
    # One row a range.
    sizes = sorted(ranged.groupBy("_range").count().collect())
    before = [(r, sum(n for _, n in sizes[:i])) for i, (r, _) in enumerate(sizes)]
    offsets = df.sparkSession.createDataFrame(before, "_range int, _before long")
    own = ranged.withColumn("_n", F.row_number().over(W.partitionBy("_range").orderBy(*order)))
    return own.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_n")).drop("_range", "_before", "_n")


def ranked_with_best(entries: DataFrame, score: str, tie: str) -> DataFrame:
    """Entries by score, with the best score beside every row (an aggregate of one row); no window holds the whole table."""
    best = entries.agg(F.max(score).alias("max_score"))
    return numbered(entries, [F.col(score).desc(), F.col(tie)], "position").crossJoin(F.broadcast(best))


def topic_ranking(answers: DataFrame) -> DataFrame:
    """Model answers (model, text) by topic coverage."""
    return ranked_with_best(answers.withColumn("score", topic_score(F.col("text"))), "score", "model")


def merged_descriptions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Photo descriptions, made now and before, in photo order; a missing category is ``other``."""
    return old.unionByName(new).withColumn("category", F.coalesce("category", F.lit("other"))).orderBy("listing_id", "order_index")
