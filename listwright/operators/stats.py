"""Counts, shares and summaries; each is one pass of conditional aggregates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent
from ..model import STATUS_LABELS, STATUSES


def active_by_source(listings: DataFrame) -> DataFrame:
    """Counts by source, and the grand total in the row without a source."""
    return listings.filter("is_active").rollup("source_code").agg(F.count("*").alias("n"), F.grouping("source_code").cast("int").alias("is_total")).orderBy(F.col("is_total").desc(), F.col("n").desc(), "source_code")


def coverage(df: DataFrame, **conditions: Column) -> DataFrame:
    """Rows, and rows that meet each condition (fill rates, geocoding, classification, model features)."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()))


def geocode_stats(listings: DataFrame) -> DataFrame:
    own = F.col("latitude").isNotNull()
    return coverage(listings.filter("is_active"), geocoded=own, missing=~own, by_scraper=own & (F.col("geocode_source") == "scraper"), by_service=own & (F.col("geocode_source") == "nominatim"))


def cadastre_stats(listings: DataFrame, cadastre: DataFrame) -> DataFrame:
    both = listings.filter("is_active").join(cadastre.select(F.col("listing_id").alias("_c"), "fetch_status"), F.col("id") == F.col("_c"), "left")
    return both.agg(F.count("*").alias("total"), F.count("_c").alias("with_row"), *(F.count(F.when(F.col("fetch_status") == s, 1)).alias(s) for s in ("found", "not_found", "error", "pending")))


def feature_coverage(listings: DataFrame) -> DataFrame:
    s = F.col("price_signal")
    return coverage(listings.filter("is_active"), tagged=F.col("smart_tags").isNotNull(), normalized=F.col("ai_normalized_data").isNotNull(), priced=s.isNotNull(), low=s == "low", fair=s == "fair", high=s == "high")


def share(df: DataFrame, part: Column) -> DataFrame:
    """total, part, percent (half-even, one digit, 0 for an empty table)."""
    n, k = F.count("*"), F.count_if(F.coalesce(part, F.lit(False)))
    return df.agg(n.alias("total"), k.alias("part"), percent(k, n).alias("pct"))


def source_health(sources: DataFrame, listings: DataFrame, now: datetime, stale_days: int = 3) -> DataFrame:
    """Active and inactive rows, last sighting, days since, dead/stale/ok; longest silence first."""
    own = listings.groupBy(F.col("source_code").alias("_s")).agg(F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("inactive"), F.max("last_seen_at").alias("last_seen_at"))
    out = sources.join(own, F.col("code") == F.col("_s"), "left")
    days = (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("last_seen_at")) / 86400
    out = out.select("code", F.coalesce("active", F.lit(0)).alias("active"), F.coalesce("inactive", F.lit(0)).alias("inactive"), "last_seen_at", F.bround(days, 1).alias("days_stale"), days.alias("_d"))
    status = F.when(F.col("_d").isNull() | (F.col("active") == 0), "dead").when(F.col("_d") > stale_days, "stale").otherwise("ok")
    return out.withColumn("status", status).drop("_d").orderBy(F.col("days_stale").desc_nulls_first(), "code")


def health_summary(health: DataFrame) -> DataFrame:
    bad = F.count_if(F.col("status") != "ok")
    return health.agg(F.when(bad == 0, "ok").otherwise("degraded").alias("overall"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "stale").alias("stale"))


def run_stats(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Scan runs by source; runs without an end do not enter the mean duration."""
    seconds = F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")
    own = runs.groupBy(F.col("source_id").alias("_s")).agg(
        F.count("*").alias("runs"), F.count_if(F.col("status") == "Succeeded").alias("succeeded"), F.count_if(F.col("status") == "Failed").alias("failed"),
        F.sum("total_seen").alias("seen"), F.sum("total_new").alias("added"), F.sum("total_updated").alias("updated"), F.max("started_at").alias("last_run"), F.avg(seconds).alias("avg_seconds"),
    )
    return sources.join(own, F.col("id") == F.col("_s"), "left").drop("_s")


def rag_status(analyses: DataFrame) -> DataFrame:
    return analyses.agg(F.count("*").alias("total"), F.count("embedding").alias("with_embedding"), (F.count("*") - F.count("embedding")).alias("without_embedding"), F.countDistinct("listing_id").alias("listings"))


def new_since(listings: DataFrame, now: datetime, days: int = 7) -> DataFrame:
    return listings.filter(F.col("first_seen_at") >= F.lit(now) - F.expr(f"interval {int(days)} days")).groupBy("source_code").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "source_code")


def my_listings(summaries: DataFrame) -> DataFrame:
    """Groups in a fixed order with label, count and the newest-first list of (last_updated, title, id)."""
    order = F.array_position(F.array(*(F.lit(s) for s in ("ToVisit", "Liked", "Visited", "Disliked", "New"))), F.col("status"))
    item = F.struct("last_updated", "title", "id")
    newest = F.array_sort(F.collect_list(item), lambda a, b: F.when(a["last_updated"] > b["last_updated"], -1).when(a["last_updated"] < b["last_updated"], 1).when(a["title"] < b["title"], -1).when(a["title"] > b["title"], 1).otherwise(0))
    from ..model import lookup

    return summaries.filter(F.col("status").isin(STATUSES)).groupBy("status").agg(F.count("*").alias("n"), newest.alias("items")).withColumns({"label": lookup(STATUS_LABELS, F.col("status"), F.lit("Nové")), "_o": order}).orderBy("_o").drop("_o")


def status_counts(groups: DataFrame) -> DataFrame:
    return groups.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("counts"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col(column).asc_nulls_last())


def price_trend(history: DataFrame) -> DataFrame:
    """Last less first price and its percentage; 0 with fewer than two entries or a base of 0 or null."""
    at = F.struct("recorded_at", "price")
    own = history.groupBy("listing_id").agg(F.count("*").alias("n"), F.min_by("price", at).alias("first"), F.max_by("price", at).alias("last"))
    ok = (F.col("n") >= 2) & F.col("first").isNotNull() & F.col("last").isNotNull()
    return own.select("listing_id", "n", F.when(ok, F.col("last") - F.col("first")).otherwise(0).alias("trend"), F.when(ok & (F.col("first") != 0), (F.col("last") - F.col("first")) / F.col("first") * 100).otherwise(0.0).alias("trend_pct"))


def scan_metrics(calls: DataFrame) -> DataFrame:
    """Success rate (0 without calls) and mean times of fetch, parse and save."""
    n = F.count("*")
    return calls.agg(n.alias("n"), F.when(n > 0, F.count_if("ok") / n).otherwise(0.0).alias("success_rate"), *(F.avg(c).alias(f"avg_{c}") for c in ("fetch", "parse", "save")))


def length_stats(df: DataFrame, column: str) -> DataFrame:
    size = F.length(column)
    return df.agg(F.count("*").alias("n"), F.min(size).alias("shortest"), F.floor(F.sum(size) / F.count("*")).alias("mean_floor"), F.max(size).alias("longest"))


def benchmark(runs: DataFrame) -> DataFrame:
    """Per test: success rate, mean and sample deviation of seconds, mean tokens per second of good runs."""
    good = lambda c: F.when(F.col("ok"), F.col(c))
    return runs.groupBy("test").agg((F.count_if("ok") / F.count("*")).alias("success_rate"), F.avg(good("seconds")).alias("mean_s"), F.stddev_samp(good("seconds")).alias("sd_s"), F.avg(good("tokens_per_s")).alias("tokens_per_s"))


def benchmark_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Totals leave failed pairs out; the mean of tokens divides by all tests."""
    both = a.select("test", *(F.col(c).alias(f"a_{c}") for c in a.columns if c != "test")).join(b.select("test", *(F.col(c).alias(f"b_{c}") for c in b.columns if c != "test")), "test")
    ok = (F.col("a_success_rate") > 0) & (F.col("b_success_rate") > 0)
    return both.agg(F.count("*").alias("tests"), F.sum(F.when(ok, F.col("a_mean_s"))).alias("a_total"), F.sum(F.when(ok, F.col("b_mean_s"))).alias("b_total"), (F.sum(F.when(ok, F.col("a_tokens_per_s"))) / F.count("*")).alias("a_tokens"), (F.sum(F.when(ok, F.col("b_tokens_per_s"))) / F.count("*")).alias("b_tokens"))


def job_summary(results: DataFrame) -> DataFrame:
    """``results``: source_code, found (null: failed)."""
    n = F.col("found")
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("source_code"))))
    return results.agg(names(n.isNull()).alias("failed"), names(n == 0).alias("empty"), names(n > 0).alias("ok"), F.coalesce(F.sum("found"), F.lit(0)).alias("total"))


def batch_summary(items: DataFrame, remaining: int) -> DataFrame:
    return items.agg(F.count("*").alias("processed"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.lit(remaining).alias("remaining"), F.avg("ms").alias("avg_ms"))


def counts_or_zero(sources: DataFrame, counts: DataFrame) -> DataFrame:
    return sources.join(counts.select(F.col("source_code").alias("code"), "n"), "code", "left").withColumn("n", F.coalesce("n", F.lit(0)))
