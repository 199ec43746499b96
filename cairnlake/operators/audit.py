"""Audit logs, activity rollups, latency metrics and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcome_counts(events: DataFrame, *group: str) -> DataFrame:
    """Events by outcome, with the first and last time."""
    n = lambda k: F.count_if(F.col("outcome") == k)
    return events.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), n("success").alias("success"), n("failure").alias("failed"), n("denied").alias("denied"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def last_n(events: DataFrame, n: int) -> DataFrame:
    """The n newest events (ties: id); a distributed top-n, no global sort."""
    return events.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def bucket(ts: Column, minutes: int) -> Column:
    """The start of the bucket of ``minutes`` that a time lies in."""
    return F.window(ts, f"{minutes} minutes")["start"]


def rollup(events: DataFrame, start: Column, *more: str) -> DataFrame:
    """Per bucket: events, errors, distinct users, sum of values."""
    return events.groupBy(start.alias("bucket"), *more).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "failure").alias("errors"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"))


def latency(events: DataFrame, start: Column) -> DataFrame:
    """Per bucket and type: requests, errors, percentiles 50, 95, 99, the greatest and the mean value."""
    pct = lambda p: F.round(F.percentile("value", p), 6)
    return events.groupBy(start.alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "failure").alias("errors"), pct(0.5).alias("p50"), pct(0.95).alias("p95"), pct(0.99).alias("p99"), F.max("value").alias("max"), F.round(F.avg("value"), 6).alias("mean"))


def sessions(events: DataFrame, gap_minutes: int) -> DataFrame:
    """(user_id, start, n): runs of a user's events with no gap longer than this."""
    out = events.groupBy("user_id", F.session_window("ts", f"{gap_minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def spikes(rolled: DataFrame, days: int, times: float) -> DataFrame:
    """Buckets (days) with more than ``times`` the mean of the ``days`` before."""
    before = Window.orderBy("bucket").rowsBetween(-days, -1)  # a row a day
    return rolled.select("bucket", "n", F.avg("n").over(before).alias("usual")).where(F.col("n") > times * F.col("usual"))


def moving(samples: DataFrame, by: str, n: int) -> DataFrame:
    """(by, id, mean): the mean of the last n values up to each sample, summed as whole thousandths."""
    w = Window.partitionBy(by).orderBy("ts", "id").rowsBetween(-(n - 1), 0)
    total = F.sum(F.round(F.col("value") * 1000).cast("long")).over(w)
    return samples.select(by, "id", (total / (F.lit(1000.0) * F.count(F.lit(1)).over(w))).alias("mean"))


def exponential(samples: DataFrame, by: str, alpha: float) -> DataFrame:
    """(by, ema): the exponential moving average over all samples of a key, in order: a sum in which each value has the weight
    that the number of later ones leaves it, the first one all that is left."""
    later = Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("id"))
    earlier = Window.partitionBy(by).orderBy("ts", "id")
    rows = samples.select(by, "value", (F.row_number().over(later) - 1).alias("after"), (F.lag("id").over(earlier).isNull()).alias("is_first"))
    weight = F.pow(F.lit(1 - alpha), F.col("after")) * F.when(F.col("is_first"), 1.0).otherwise(alpha)
    return rows.groupBy(by).agg(F.round(F.sum(weight * F.col("value")), 6).alias("ema"))


def sliding_rate(events: DataFrame, width: str, step: str) -> DataFrame:
    """(start, event_type, rate): events a second in windows of ``width`` that begin every ``step``."""
    out = events.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    seconds = F.unix_timestamp(F.col("w.end").cast("timestamp")) - F.unix_timestamp(F.col("w.start").cast("timestamp"))
    return out.select(F.col("w.start").alias("start"), "event_type", (F.col("n") / seconds).alias("rate"))


def retained(rolled: DataFrame, days: int) -> DataFrame:
    """The buckets of a rollup that are at most ``days`` older than its last one."""
    last = rolled.agg(F.max("bucket").alias("last"))
    return rolled.crossJoin(F.broadcast(last)).where(F.col("bucket") >= F.col("last") - F.expr(f"INTERVAL {days} DAYS")).drop("last")  # one row


def cumulative_rate(samples: DataFrame, by: str) -> DataFrame:
    """(by, id, rate): all so far divided by the seconds since the first (null at the first)."""
    w = Window.partitionBy(by).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    secs = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").over(w).cast("timestamp"))
    return samples.select(by, "id", F.round(F.try_divide(F.sum("value").over(w), secs), 6).alias("rate"))


def batches(events: DataFrame, size: int) -> DataFrame:
    """(user_id, batch, n): a sender that flushes after ``size`` events."""
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    return events.select("user_id", F.floor((F.row_number().over(w) - 1) / size).alias("batch")).groupBy("user_id", "batch").agg(F.count(F.lit(1)).alias("n"))
