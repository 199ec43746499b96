"""Storage tiers: access statistics, policies, cost, evictions.  Time is always a parameter, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tiers from hot to cold with their relative cost.
TIERS = {"hot": 1.0, "warm": 0.5, "cold": 0.17, "archive": 0.04}
#: Idle days after which a chunk goes one tier down.
PRESETS = {"default": (30, 180, 730), "aggressive": (7, 30, 90), "conservative": (90, 365, 1095)}


def days_between(start: Column, end: Column) -> Column:
    """Whole days, not below 0."""
    return F.floor(F.greatest(F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp")), F.lit(0)) / 86400)


def protected() -> Column:
    return F.col("is_proxy") | F.col("is_manifest")


def tier_map(values: dict) -> Column:
    """A value for the tier of the row (null for an unknown tier)."""
    out = F.lit(None)
    for name, v in values.items():
        out = F.when(F.col("tier") == name, F.lit(v)).otherwise(out)
    return out


def policy_rules(spark, name: str) -> DataFrame:
    """The rules of a preset: (priority, from_tier, to_tier, cond_type, cond_value, exclude_protected)."""
    names = list(TIERS)
    rows = [(k, names[k], names[k + 1], "inactive_days", d, True) for k, d in enumerate(PRESETS[name])]
    return spark.createDataFrame(rows, "priority int, from_tier string, to_tier string, cond_type string, cond_value long, exclude_protected boolean")


def evaluate(records: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """(hash, from_tier, to_tier, size): for each record the first rule, by priority, that fires."""
    r = records.withColumns({"idle": days_between(F.col("last_accessed"), as_of), "age": days_between(F.col("created_at"), as_of)})
    both = r.join(rules, r["tier"] == rules["from_tier"])
    fires = F.when(F.col("cond_type") == "inactive_days", F.col("idle") >= F.col("cond_value")).when(F.col("cond_type") == "age_days", F.col("age") >= F.col("cond_value")).when(F.col("cond_type") == "access_count_below", F.col("access_count") < F.col("cond_value")).otherwise(F.col("cond_type") == "always")
    hit = both.where(fires & ~(protected() & F.col("exclude_protected")))
    return hit.groupBy("hash", "from_tier", "size").agg(F.min_by("to_tier", "priority").alias("to_tier")).select("hash", "from_tier", "to_tier", "size")


def candidates(records: DataFrame, tier: str, days: int, as_of: Column) -> DataFrame:
    """Unprotected records of a tier that were idle for so many days."""
    return records.where((F.col("tier") == tier) & ~protected() & (days_between(F.col("last_accessed"), as_of) >= days))


def access_stats(records: DataFrame) -> DataFrame:
    """One row: count and bytes by tier, of proxies, and the number of manifests."""
    by = {}
    for t in TIERS:
        by[f"{t}_count"] = F.count_if(F.col("tier") == t)
        by[f"{t}_bytes"] = F.coalesce(F.sum(F.when(F.col("tier") == t, F.col("size"))), F.lit(0))
    more = {"proxy_count": F.count_if("is_proxy"), "proxy_bytes": F.coalesce(F.sum(F.when(F.col("is_proxy"), F.col("size"))), F.lit(0)), "manifest_count": F.count_if("is_manifest")}
    return records.agg(*[c.alias(n) for n, c in (by | more).items()])


def monthly_cost(records: DataFrame) -> DataFrame:
    """One row: bytes weighted by their tier's cost, in GiB."""
    return records.groupBy("tier").agg(F.sum("size").alias("b")).agg(F.sum(F.col("b") * tier_map(TIERS) / float(1 << 30)).alias("cost"))


def savings(transitions: DataFrame) -> DataFrame:
    """Per target tier: transitions, bytes and saved cost."""
    weight = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv]), F.col(c))
    rows = transitions.groupBy("from_tier", "to_tier").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    each = rows.withColumn("saved", (weight("from_tier") - weight("to_tier")) * F.col("bytes") / float(1 << 30))
    return each.groupBy("to_tier").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.sum("saved").alias("saved"))


def freeze(wanted: DataFrame, records: DataFrame, target: str) -> DataFrame:
    """(hash, outcome, size): not_found, already_frozen (at the target or colder), protected or frozen."""
    rank = {t: k for k, t in enumerate(TIERS)}
    rows = wanted.select("hash").distinct().join(records.withColumn("in_r", F.lit(True)), "hash", "left")
    outcome = F.when(F.col("in_r").isNull(), "not_found").when(tier_map(rank) >= rank[target], "already_frozen").when(protected(), "protected").otherwise("frozen")
    return rows.select("hash", outcome.alias("outcome"), F.when(outcome == "frozen", F.col("size")).otherwise(0).cast("long").alias("size"))


def eviction_order(records: DataFrame, policy: str, as_of: Column, decay: float = 0.5) -> list[Column]:
    """The order in which a cache gives up entries: lru, lfu, lrfu or size_lru (ties: hash)."""
    hours = F.floor((F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("last_accessed").cast("timestamp"))) / 3600)
    orders = {
        "lru": [F.col("last_accessed")],
        "lfu": [F.col("access_count"), F.col("last_accessed")],
        "lrfu": [F.log(F.col("access_count")) + F.log(F.lit(decay)) * hours],  # the logarithm of count * decay ** hours
        "size_lru": [F.col("last_accessed"), F.desc("size")],
    }
    return [*orders[policy], F.col("hash")]


def evict_until_fits(records: DataFrame, budget: int) -> DataFrame:
    """The least recently used records, in order, whose removal brings the total down to ``budget`` bytes.

    Running sums are taken by time slices: the totals of the earlier slices are added to the sums within a slice.
    """
    total = records.agg(F.sum("size").alias("total"))
    rows = records.withColumn("slice", F.to_date("last_accessed"))
    w = Window.partitionBy("slice").orderBy("last_accessed", "hash").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    days = rows.groupBy("slice").agg(F.sum("size").alias("s")).select("slice", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("b"))
    out = rows.withColumn("own", F.coalesce(F.sum("size").over(w), F.lit(0))).join(days, "slice").crossJoin(total)  # one row
    return out.where(F.col("own") + F.col("b") < F.col("total") - budget).select("hash", "size")


def active_locks(locks: DataFrame, as_of: Column) -> DataFrame:
    """Locks that have not expired."""
    return locks.where(as_of <= F.col("expires_at"))


def acquire(requests: DataFrame, locks: DataFrame, as_of: Column) -> DataFrame:
    """(path, owner, granted): a request is refused where a lock is alive, whoever holds it, unless it forces."""
    live = active_locks(locks, as_of).select("path", F.lit(True).alias("held")).distinct()
    return requests.join(live, "path", "left").select("path", "owner", (F.col("held").isNull() | F.col("force")).alias("granted"))
