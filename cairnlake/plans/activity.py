"""Queries on tiers, locks, audit events, timelines and dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.operators import audit as A
from cairnlake.operators import dependencies as D
from cairnlake.operators import lifecycle as L
from cairnlake.operators import timeline as T
from cairnlake.plans import relations as R
from cairnlake.plans.relations import sql
from cairnlake.sources.tables import table

_NOW = "2001-08-02"


def _now():
    return F.lit(_NOW).cast("timestamp_ntz")


def _policy(name):
    return lambda s, d: L.evaluate(R.access_records(s, d), L.policy_rules(s, name), _now())


def _evict(policy):
    return lambda s, d: R.access_records(s, d).orderBy(*L.eviction_order(R.access_records(s, d), policy, _now(), 0.999)).limit(20).select("hash")


def _locks(s, d):
    o = table(s, d, "orders")
    return o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("acquired_at"), F.max_by("o_orderpriority", "o_orderkey").alias("owner")).select(F.col("o_custkey").alias("path"), "owner", "acquired_at", (F.col("acquired_at") + F.expr("INTERVAL 2000 HOURS")).alias("expires_at"))


def _requests(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("path"), F.lit("1-URGENT").alias("owner"), (F.col("c_nationkey") % 5 == 0).alias("force"))


def _clips(s, d):
    e = table(s, d, "events")
    return e.select((F.col("user_id") % 20).alias("project"), F.col("user_id").alias("track"), F.col("event_id").alias("clip"), F.lit(0).cast("long").alias("in_point"), (F.floor(F.col("value") * 10) + 1).alias("out_point"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 10).alias("start"))


def _projects(s, d):
    return R.dependency_nodes(s, d).where("is_project").select(F.col("node").alias("start"))


def _points(s, d):
    return R.segments(s, d).groupBy("video").agg(F.sum("duration").alias("t")).select("video", F.explode(F.array(F.lit(0).cast("long"), F.expr("t div 3"), F.expr("t div 2"), F.col("t"))).alias("at"))


def _ev(s, d):
    return R.audit_events(s, d)


def _day():
    return F.date_trunc("day", "ts")


def _hour():
    return F.date_trunc("hour", "ts")


QUERIES = {
    "policy_default": _policy("default"),
    "policy_aggressive": _policy("aggressive"),
    "policy_conservative": _policy("conservative"),
    "transition_candidates": lambda s, d: L.candidates(R.access_records(s, d), "hot", 100, _now()).select("hash"),
    "access_by_tier": lambda s, d: R.access_records(s, d).where("tier = 'warm'").select("hash", "size"),
    "access_stats": lambda s, d: L.access_stats(R.access_records(s, d)),
    "monthly_cost": lambda s, d: L.monthly_cost(R.access_records(s, d)),
    "transition_savings": lambda s, d: L.savings(_policy("default")(s, d)),
    "freeze_result": lambda s, d: L.freeze(table(s, d, "customer").select(F.col("c_custkey").alias("hash")), R.access_records(s, d), "cold"),
    "freeze_all": lambda s, d: R.access_records(s, d).where("tier in ('hot', 'warm') and not is_proxy and not is_manifest").groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")),
    "evict_lru": _evict("lru"),
    "evict_lfu": _evict("lfu"),
    "evict_size_lru": _evict("size_lru"),
    "evict_lrfu": _evict("lrfu"),
    "evict_until_fits": lambda s, d: L.evict_until_fits(R.access_records(s, d), 500_000_000),
    "active_locks": lambda s, d: L.active_locks(_locks(s, d), _now()).select("path", "owner"),
    "locks_by_owner": lambda s, d: L.active_locks(_locks(s, d), _now()).groupBy("owner").agg(F.count(F.lit(1)).alias("n")),
    "expired_locks": lambda s, d: _locks(s, d).where(F.col("expires_at") < _now()).select("path"),
    "lock_acquire": lambda s, d: L.acquire(_requests(s, d), _locks(s, d), _now()),
    "audit_by_type": lambda s, d: _ev(s, d).where("event_type = 'purchase'").select("id", "ts"),
    "audit_by_resource": lambda s, d: _ev(s, d).where("resource = '3'").select("id"),
    "audit_by_time": lambda s, d: _ev(s, d).where("ts between timestamp_ntz'2024-01-10' and timestamp_ntz'2024-01-12'").select("id"),
    "audit_stats": lambda s, d: A.outcome_counts(_ev(s, d)),
    "audit_last_n": lambda s, d: A.last_n(_ev(s, d), 50).select("id", "ts"),
    "audit_show": lambda s, d: A.last_n(_ev(s, d).where("event_type = 'error'"), 20).select("id"),
    "audit_retention": lambda s, d: A.last_n(_ev(s, d), 1000).select("id"),
    "audit_user_report": lambda s, d: A.outcome_counts(_ev(s, d), "user_id"),
    "recent_accesses": lambda s, d: _ev(s, d).where("ts >= timestamp_ntz'2024-01-25' and outcome = 'failure'").select("user_id", "ts", "resource").distinct(),
    "repo_stats_daily": lambda s, d: A.rollup(_ev(s, d), _day()),
    "repo_stats_hourly": lambda s, d: A.rollup(_ev(s, d), _hour(), "event_type"),
    "tumbling_5min": lambda s, d: A.rollup(_ev(s, d), A.bucket(F.col("ts"), 5)),
    "user_activity": lambda s, d: A.rollup(_ev(s, d), _day(), "user_id").select("bucket", "user_id", "n", "errors", "total"),
    "api_metrics": lambda s, d: A.latency(_ev(s, d), A.bucket(F.col("ts"), 5)),
    "sliding_rate": lambda s, d: A.sliding_rate(_ev(s, d), "5 minutes", "1 minute"),
    "retention": lambda s, d: A.retained(A.rollup(_ev(s, d), _hour()), 7),
    "rollup_cube": lambda s, d: _ev(s, d).rollup("event_type", "outcome").agg(F.count(F.lit(1)).alias("n")),
    "sessions": lambda s, d: A.sessions(_ev(s, d), 600),
    "telemetry_flush": lambda s, d: A.batches(_ev(s, d), 10),
    "alert_error_rate": lambda s, d: A.rollup(_ev(s, d), _hour()).select("bucket", F.try_divide("errors", "n").alias("rate")).where("rate > 0.3"),
    "alert_spike": lambda s, d: A.spikes(A.rollup(_ev(s, d), _day()), 7, 1.02),
    "topk_slow": lambda s, d: _ev(s, d).orderBy(F.desc("value"), "id").limit(10).select("id", "value"),
    "last_n_samples": lambda s, d: A.moving(_ev(s, d), "user_id", 100),
    "ema_bandwidth": lambda s, d: A.exponential(_ev(s, d), "user_id", 0.1),
    "cumulative_bandwidth": lambda s, d: A.cumulative_rate(_ev(s, d), "user_id"),
    "transfer_stats": lambda s, d: _ev(s, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.sum("value"), 4).alias("bytes"), F.round(T.bandwidth_mbps(F.sum("value"), (F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))) * 1000), 12).alias("mbps")),
    "cache_hit_rates": lambda s, d: _ev(s, d).agg(F.try_divide(F.count_if(F.col("event_type") == "view"), F.count(F.lit(1))).alias("l1_rate"), F.try_divide(F.count_if(F.col("event_type").isin("view", "click", "purchase")), F.count(F.lit(1))).alias("overall_rate")),
    "segment_start_times": lambda s, d: T.start_times(R.segments(s, d)).select("video", "idx", "start"),
    "segment_at_time": lambda s, d: T.segments_at(R.segments(s, d), _points(s, d), 1000),
    "segment_diff": lambda s, d: T.segment_diff(R.segments(s, d), R.segments(s, d).where("idx > 0").withColumn("idx", F.col("idx") - F.when(F.col("video") % 2 == 0, 1).otherwise(0))),
    "track_duration": lambda s, d: T.track_durations(_clips(s, d)),
    "project_duration": lambda s, d: T.track_durations(_clips(s, d)).groupBy("project").agg(F.max("duration").alias("duration"), F.sum("n_clips").alias("n_clips")),
    "clip_order": lambda s, d: T.clip_order(_clips(s, d)),
    "clip_media_join": lambda s, d: _clips(s, d).join(R.dependency_nodes(s, d), F.col("clip") == F.col("node"), "left").select("project", "track", "clip", "is_tracked"),
    "dep_closure": lambda s, d: D.closure(_projects(s, d), R.dependency_nodes(s, d), R.dependency_edges(s, d)),
    "dep_validate": lambda s, d: D.validate(_projects(s, d), R.dependency_nodes(s, d), R.dependency_edges(s, d)),
    "dep_graph_stats": lambda s, d: D.graph_stats(R.dependency_nodes(s, d), R.dependency_edges(s, d)),
    "dep_neighbors": lambda s, d: D.dependents(R.dependency_nodes(s, d).where("not is_tracked").select("node"), R.dependency_edges(s, d)),
    "dep_untracked": lambda s, d: R.dependency_nodes(s, d).where("not is_tracked").select("node"),
    "dep_missing": lambda s, d: R.dependency_nodes(s, d).where("not exists_on_disk").select("node"),
    "dep_projects": lambda s, d: R.dependency_nodes(s, d).where("is_project").select("node"),
    "dep_media": lambda s, d: R.dependency_nodes(s, d).where("not is_project").select("node"),
    "graph_merge": lambda s, d: D.merge_graphs(R.dependency_nodes(s, d).where("node % 3 = 0"), R.dependency_nodes(s, d).withColumn("is_tracked", F.lit(False))),
}

_PROT = "(is_proxy OR is_manifest)"
_IDLE = f"floor(greatest(epoch(TIMESTAMP '{_NOW}') - epoch(last_accessed), 0) / 86400)"


def _policy_sql(name: str) -> str:
    a, b, c = L.PRESETS[name]
    return f"SELECT hash, tier AS from_tier, CASE tier WHEN 'hot' THEN 'warm' WHEN 'warm' THEN 'cold' ELSE 'archive' END AS to_tier, size FROM acc WHERE NOT {_PROT} AND {_IDLE} >= CASE tier WHEN 'hot' THEN {a} WHEN 'warm' THEN {b} WHEN 'cold' THEN {c} END"


_W = "CASE {} WHEN 'hot' THEN 1.0 WHEN 'warm' THEN 0.5 WHEN 'cold' THEN 0.17 ELSE 0.04 END::DOUBLE"
_LOCKS = "lk AS (SELECT o_custkey AS path, max_by(o_orderpriority, o_orderkey) AS owner, max(o_orderdate) AS acquired_at, max(o_orderdate) + INTERVAL 2000 HOURS AS expires_at FROM orders GROUP BY 1)"
_RU = "count(*) AS n, count(*) FILTER (outcome = 'failure') AS errors, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total"
_OC = "count(*) AS total, count(*) FILTER (outcome = 'success') AS success, count(*) FILTER (outcome = 'failure') AS failed, count(*) FILTER (outcome = 'denied') AS denied, min(ts) AS oldest, max(ts) AS newest"
_CLIPS = "cl AS (SELECT user_id % 20 AS project, user_id AS track, event_id AS clip, 0 AS in_point, floor(value * 10)::BIGINT + 1 AS out_point, epoch(ts)::BIGINT // 10 AS start FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM events))"
_ST = "st AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY video ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM seg)"
_CLO = "clo AS (SELECT node AS start, node FROM dn WHERE is_project UNION SELECT c.start, de.dst FROM clo c JOIN de ON de.src = c.node JOIN dn ON dn.node = c.node AND dn.is_project)"


def _also(names: str, cte: str, body: str, recursive: bool = False) -> str:
    return sql(names, "", recursive).rstrip() + ",\n" + cte + "\n" + body


_LK = f"WITH {_LOCKS} "

SQL = {
    **{f"policy_{n}": sql("acc", _policy_sql(n)) for n in L.PRESETS},
    "transition_candidates": sql("acc", f"SELECT hash FROM acc WHERE tier = 'hot' AND NOT {_PROT} AND {_IDLE} >= 100"),
    "access_by_tier": sql("acc", "SELECT hash, size FROM acc WHERE tier = 'warm'"),
    "access_stats": sql("acc", "SELECT " + ", ".join(f"count(*) FILTER (tier = '{t}') AS {t}_count, coalesce(sum(size) FILTER (tier = '{t}'), 0)::BIGINT AS {t}_bytes" for t in L.TIERS) + ", count(*) FILTER (is_proxy) AS proxy_count, coalesce(sum(size) FILTER (is_proxy), 0)::BIGINT AS proxy_bytes, count(*) FILTER (is_manifest) AS manifest_count FROM acc"),
    "monthly_cost": sql("acc", f"SELECT sum(b * {_W.format('tier')} / 1073741824.0::DOUBLE) AS cost FROM (SELECT tier, sum(size)::BIGINT AS b FROM acc GROUP BY 1)"),
    "transition_savings": sql("acc", f"SELECT to_tier, count(*) AS n, sum(size)::BIGINT AS bytes, sum(({_W.format('from_tier')} - {_W.format('to_tier')}) * size / 1073741824.0::DOUBLE) AS saved FROM ({_policy_sql('default')}) GROUP BY 1"),
    "freeze_result": sql("acc", f"SELECT c_custkey AS hash, o AS outcome, CASE o WHEN 'frozen' THEN size ELSE 0 END AS size FROM (SELECT c_custkey, size, CASE WHEN hash IS NULL THEN 'not_found' WHEN tier IN ('cold', 'archive') THEN 'already_frozen' WHEN {_PROT} THEN 'protected' ELSE 'frozen' END AS o FROM customer LEFT JOIN acc ON hash = c_custkey)"),
    "freeze_all": sql("acc", f"SELECT tier, count(*) AS n, sum(size)::BIGINT AS bytes FROM acc WHERE tier IN ('hot', 'warm') AND NOT {_PROT} GROUP BY 1"),
    "evict_lru": sql("acc", "SELECT hash FROM acc ORDER BY last_accessed, hash LIMIT 20"),
    "evict_lfu": sql("acc", "SELECT hash FROM acc ORDER BY access_count, last_accessed, hash LIMIT 20"),
    "evict_size_lru": sql("acc", "SELECT hash FROM acc ORDER BY last_accessed, size DESC, hash LIMIT 20"),
    "evict_lrfu": sql("acc", f"SELECT hash FROM acc ORDER BY ln(access_count) + ln(0.999::DOUBLE) * floor((epoch(TIMESTAMP '{_NOW}') - epoch(last_accessed)) / 3600), hash LIMIT 20"),
    "evict_until_fits": sql("acc", "SELECT hash, size FROM (SELECT hash, size, sum(size) OVER () AS t, coalesce(sum(size) OVER (ORDER BY last_accessed, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM acc) WHERE b < t - 500000000"),
    "active_locks": _LK + f"SELECT path, owner FROM lk WHERE expires_at >= TIMESTAMP '{_NOW}'",
    "locks_by_owner": _LK + f"SELECT owner, count(*) AS n FROM lk WHERE expires_at >= TIMESTAMP '{_NOW}' GROUP BY 1",
    "expired_locks": _LK + f"SELECT path FROM lk WHERE expires_at < TIMESTAMP '{_NOW}'",
    "lock_acquire": _LK + f"SELECT c_custkey AS path, '1-URGENT' AS owner, l.path IS NULL OR c_nationkey % 5 = 0 AS granted FROM customer LEFT JOIN (FROM lk WHERE expires_at >= TIMESTAMP '{_NOW}') l ON l.path = c_custkey",
    "audit_by_type": sql("ev", "SELECT id, ts FROM ev WHERE event_type = 'purchase'"),
    "audit_by_resource": sql("ev", "SELECT id FROM ev WHERE resource = '3'"),
    "audit_by_time": sql("ev", "SELECT id FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'"),
    "audit_stats": sql("ev", f"SELECT {_OC} FROM ev"),
    "audit_last_n": sql("ev", "SELECT id, ts FROM ev ORDER BY ts DESC, id DESC LIMIT 50"),
    "audit_show": sql("ev", "SELECT id FROM ev WHERE event_type = 'error' ORDER BY ts DESC, id DESC LIMIT 20"),
    "audit_retention": sql("ev", "SELECT id FROM ev ORDER BY ts DESC, id DESC LIMIT 1000"),
    "audit_user_report": sql("ev", f"SELECT user_id, {_OC} FROM ev GROUP BY 1"),
    "recent_accesses": sql("ev", "SELECT DISTINCT user_id, ts, resource FROM ev WHERE ts >= TIMESTAMP '2024-01-25' AND outcome = 'failure'"),
    "repo_stats_daily": sql("ev", f"SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, {_RU} FROM ev GROUP BY 1"),
    "repo_stats_hourly": sql("ev", f"SELECT date_trunc('hour', ts) AS bucket, event_type, {_RU} FROM ev GROUP BY 1, 2"),
    "tumbling_5min": sql("ev", f"SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS bucket, {_RU} FROM ev GROUP BY 1"),
    "user_activity": sql("ev", "SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, user_id, count(*) AS n, count(*) FILTER (outcome = 'failure') AS errors, round(sum(value), 2) AS total FROM ev GROUP BY 1, 2"),
    "sliding_rate": sql("ev", "SELECT time_bucket(INTERVAL 1 MINUTE, ts) - k * INTERVAL 1 MINUTE AS start, event_type, count(*) / 300 AS rate FROM ev, unnest(range(0, 5)) t(k) GROUP BY 1, 2"),
    "retention": sql("ev", f"SELECT * FROM (SELECT date_trunc('hour', ts) AS bucket, {_RU} FROM ev GROUP BY 1) WHERE bucket >= (SELECT date_trunc('hour', max(ts)) FROM ev) - INTERVAL 7 DAYS"),
    "api_metrics": sql("ev", "SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS bucket, event_type, count(*) AS n, count(*) FILTER (outcome = 'failure') AS errors, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max, round(avg(value), 6) AS mean FROM ev GROUP BY 1, 2"),
    "rollup_cube": sql("ev", "SELECT event_type, outcome, count(*) AS n FROM ev GROUP BY ROLLUP (event_type, outcome)"),
    "sessions": sql("ev", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN g THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, id) AS k FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, id) > INTERVAL 600 MINUTES AS g FROM ev)) GROUP BY user_id, k"),
    "telemetry_flush": sql("ev", "SELECT user_id, k // 10 AS batch, count(*) AS n FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) - 1 AS k FROM ev) GROUP BY 1, 2"),
    "alert_error_rate": sql("ev", "SELECT date_trunc('hour', ts) AS bucket, count(*) FILTER (outcome = 'failure') / count(*) AS rate FROM ev GROUP BY 1 HAVING rate > 0.3"),
    "alert_spike": sql("ev", "SELECT bucket, n, usual FROM (SELECT bucket, n, avg(n) OVER (ORDER BY bucket ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS usual FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, count(*) AS n FROM ev GROUP BY 1)) WHERE n > 1.02 * usual"),
    "topk_slow": sql("ev", "SELECT id, value FROM ev ORDER BY value DESC, id LIMIT 10"),
    "last_n_samples": sql("ev", "SELECT user_id, id, sum(round(value * 1000)::BIGINT) OVER w / (1000.0::DOUBLE * count(*) OVER w) AS mean FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"),
    "ema_bandwidth": sql("ev", "SELECT user_id, round(list_reduce(list(value ORDER BY ts, id), lambda s, x: s + 0.1::DOUBLE * (x - s)), 6) AS ema FROM ev GROUP BY 1"),
    "cumulative_bandwidth": sql("ev", "SELECT user_id, id, round(sum(value) OVER w / nullif(date_diff('second', min(date_trunc('second', ts)) OVER w, date_trunc('second', ts)), 0), 6) AS rate FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)"),
    "transfer_stats": sql("ev", "SELECT user_id, count(*) AS chunks, round(sum(value), 4) AS bytes, round(sum(value) * 8 / nullif(date_diff('second', min(date_trunc('second', ts)), max(date_trunc('second', ts))) * 1e6::DOUBLE, 0), 12) AS mbps FROM ev GROUP BY 1"),
    "cache_hit_rates": sql("ev", "SELECT count(*) FILTER (event_type = 'view') / count(*) AS l1_rate, count(*) FILTER (event_type IN ('view', 'click', 'purchase')) / count(*) AS overall_rate FROM ev"),
    "segment_start_times": _also("seg", _ST, "SELECT video, idx, start FROM st"),
    "segment_at_time": _also("seg", _ST + ", pt AS (SELECT video, unnest([0, t // 3, t // 2, t]) AS \"at\" FROM (SELECT video, sum(duration)::BIGINT AS t FROM seg GROUP BY 1))", "SELECT video, \"at\", idx FROM pt JOIN st USING (video) WHERE \"at\" >= start AND \"at\" < start + duration"),
    "segment_diff": sql("seg", "SELECT n.video, n.idx FROM (SELECT video, idx - CASE WHEN video % 2 = 0 THEN 1 ELSE 0 END AS idx, segment_id FROM seg WHERE idx > 0) n LEFT JOIN seg o USING (video, idx) WHERE n.segment_id IS DISTINCT FROM o.segment_id"),
    "track_duration": f"WITH {_CLIPS} SELECT project, track, max(start + out_point - in_point) AS duration, count(*) AS n_clips FROM cl GROUP BY 1, 2",
    "project_duration": f"WITH {_CLIPS} SELECT project, max(start + out_point - in_point) AS duration, count(*) AS n_clips FROM cl GROUP BY 1",
    "clip_order": f"WITH {_CLIPS} SELECT project, track, clip, row_number() OVER w AS nth, start - lag(start + out_point - in_point) OVER w AS gap FROM cl WINDOW w AS (PARTITION BY project, track ORDER BY start, clip)",
    "clip_media_join": _also("dn", _CLIPS, "SELECT project, track, clip, is_tracked FROM cl LEFT JOIN dn ON clip = node"),
    "dep_closure": _also("dn de", _CLO, "SELECT start, node FROM clo WHERE start != node", True),
    "dep_validate": _also("dn de", _CLO, "SELECT start, count(*) FILTER (is_tracked AND exists_on_disk) AS satisfied, count(*) FILTER (NOT is_tracked AND exists_on_disk) AS untracked, count(*) FILTER (NOT exists_on_disk) AS missing FROM clo JOIN dn USING (node) WHERE start != node GROUP BY 1", True),
    "dep_graph_stats": sql("dn de", "SELECT count(*) AS nodes, count(*) FILTER (is_project) AS projects, count(*) FILTER (NOT is_project) AS media, count(*) FILTER (NOT is_tracked) AS untracked, count(*) FILTER (NOT exists_on_disk) AS missing, (SELECT count(*) FROM de) AS edges, (SELECT count(*) FROM de WHERE edge_type = 'nested_project') AS nested FROM dn"),
    "dep_neighbors": sql("dn de", "SELECT DISTINCT dst AS node, src AS dependent FROM de JOIN dn ON node = dst WHERE NOT is_tracked"),
    "dep_untracked": sql("dn", "SELECT node FROM dn WHERE NOT is_tracked"),
    "dep_missing": sql("dn", "SELECT node FROM dn WHERE NOT exists_on_disk"),
    "dep_projects": sql("dn", "SELECT node FROM dn WHERE is_project"),
    "dep_media": sql("dn", "SELECT node FROM dn WHERE NOT is_project"),
    "graph_merge": sql("dn", "SELECT node, is_project, CASE WHEN node % 3 = 0 THEN is_tracked ELSE false END AS is_tracked, exists_on_disk FROM dn"),
}
