"""Request-log queries: windows, limiters, queues, retries, choices among runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catloom.functions import classify
from catloom.operators import metrics, requests
from catloom.plans.registry import query, table
from catloom.sources import fixtures

LOG = f"WITH l AS ({fixtures.ddb(fixtures.LOG_SQL)})"
ORDER = ["ts", "event_id"]
BLOCKS = f"""{LOG}, b AS (SELECT *, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS INT) AS block FROM l),
  g AS (SELECT user_id, block, count(*) AS requests, sum(CAST(error AS INT)) AS errors, sum(CAST(limited AS INT)) AS limited FROM b GROUP BY user_id, block HAVING count(*) = 10)"""


def log(spark, sf):
    return fixtures.request_log(spark, sf)


@query("requests_trailing_60s", f"{LOG} SELECT event_id, count(*) OVER (PARTITION BY user_id % 3 ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM l")
def requests_trailing_60s(spark, sf):
    return requests.trailing_count(log(spark, sf).withColumn("lane", F.col("user_id") % 3), ["lane"]).select("event_id", "in_window")


@query("limiter_blocks", f"{BLOCKS} SELECT * FROM g")
def limiter_blocks(spark, sf):
    return requests.blocks(log(spark, sf), ["user_id"], ORDER)


def _fold_sql(many, errors, calm):
    return f"""WITH RECURSIVE {BLOCKS.removeprefix("WITH ")}, t(user_id, block, rpm) AS (
      SELECT DISTINCT user_id, -1, 60 FROM g UNION ALL
      SELECT t.user_id, t.block + 1, CAST(CASE WHEN limited > {many[0]} THEN greatest({many[2]}, floor(rpm * {many[1]})) WHEN (errors + limited) / 10 > {errors[0]} THEN greatest({errors[2]}, floor(rpm * {errors[1]}))
        WHEN (errors + limited) / 10 < {calm[0]} AND limited = 0 THEN least(120, floor(rpm * {calm[1]})) ELSE rpm END AS INT) FROM t JOIN g ON g.user_id = t.user_id AND g.block = t.block + 1)
    SELECT user_id, block, rpm FROM t WHERE block >= 0"""


@query("limiter_fold", _fold_sql((2, 0.5, 20), (0.2, 0.7, 30), (0.05, 1.1)))
def limiter_fold(spark, sf):
    return requests.limiter_fold(log(spark, sf), ["user_id"], ORDER)


@query("limiter_fold_careful", _fold_sql((2, 0.3, 15), (0.2, 0.6, 20), (0.05, 1.05)))
def limiter_fold_careful(spark, sf):
    return requests.limiter_fold(log(spark, sf), ["user_id"], ORDER, rule="careful")


@query(
    "pace_fold",
    f"""WITH RECURSIVE {BLOCKS.removeprefix("WITH ")}, t(user_id, block, pps) AS (
      SELECT DISTINCT user_id, -1, CAST(1 AS DOUBLE) FROM g UNION ALL
      SELECT t.user_id, t.block + 1, least(greatest(CASE WHEN limited / 10 > 0.2 THEN pps * 0.5 WHEN (10 - errors - limited) / 10 < 0.85 THEN pps * 0.8 WHEN (10 - errors - limited) / 10 >= 0.95 AND limited = 0 THEN pps * 1.1 ELSE pps END, 0.3), 1.2)
      FROM t JOIN g ON g.user_id = t.user_id AND g.block = t.block + 1)
    SELECT user_id, block, round(pps, 9) AS pps FROM t WHERE block >= 0""",
)
def pace_fold(spark, sf):
    return requests.pace_fold(log(spark, sf), ["user_id"], ORDER).withColumn("pps", F.round("pps", 9))


def timed(spark, sf):
    return log(spark, sf).withColumn("at", F.col("event_id") * 0.3).select("user_id", "event_id", "at", "ok")


@query(
    "token_bucket",
    f"""WITH RECURSIVE {LOG.removeprefix("WITH ")}, r AS (SELECT user_id, event_id, event_id * CAST(0.3 AS DOUBLE) AS sent, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM l),
    t(user_id, n, event_id, tokens, seen, wait_s) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(2 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM r UNION ALL
      SELECT user_id, n, event_id, CASE WHEN have < 1 THEN 0 ELSE have - 1 END, sent + CASE WHEN have < 1 THEN (1 - have) / 2 ELSE 0 END, CASE WHEN have < 1 THEN (1 - have) / 2 ELSE 0 END
      FROM (SELECT r.user_id, r.n, r.event_id, r.sent, CASE WHEN seen IS NULL THEN CAST(2 AS DOUBLE) ELSE least(2, tokens + (r.sent - seen) * 2) END AS have FROM t JOIN r ON r.user_id = t.user_id AND r.n = t.n + 1))
    SELECT event_id, round(wait_s, 9) AS wait_s FROM t WHERE n > 0""",
)
def token_bucket(spark, sf):
    return requests.token_bucket(timed(spark, sf), ["user_id"], ["event_id"], "at", 2.0).select("event_id", F.round("wait_s", 9).alias("wait_s"))


@query("leaky_bucket")
def leaky_bucket(spark, sf):
    return requests.leaky_bucket(timed(spark, sf), ["user_id"], ["event_id"], "at", 0.5).select("event_id", F.round("slot_s", 9).alias("slot_s"))


@query("session_pool")
def session_pool(spark, sf):
    return requests.session_pool(timed(spark, sf), ["user_id"], ["event_id"], "ok").select("event_id", "session")


@query(
    "queue_order",
    """WITH f AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS priority, min(o_orderkey) AS seq FROM orders GROUP BY o_custkey)
    SELECT o_custkey, seq, CAST(row_number() OVER (ORDER BY CASE WHEN priority LIKE '1%' THEN 1 ELSE 0 END DESC, seq) AS INT) AS turn FROM f""",
)
def queue_order(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderpriority").startswith("1"), 1).otherwise(0).alias("priority"))
    return requests.queue_order(rows, "o_custkey", "priority", "seq").select("o_custkey", "seq", "turn")


@query(
    "retry_outcome",
    f"""{LOG}, a AS (SELECT user_id, ok, row_number() OVER w AS n, coalesce(sum(CAST(ok AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS good FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, count(*) AS attempts, arg_max(ok, n) AS succeeded, CAST(pow(2, count(*)) AS BIGINT) - 2 AS waited_s FROM a WHERE n <= 3 AND good = 0 GROUP BY user_id""",
)
def retry_outcome(spark, sf):
    return requests.retry_outcome(log(spark, sf), ["user_id"], ORDER, "ok")


@query("backoff", "SELECT event_id, pow(2, event_id % 6) AS doubling, least(8, pow(1.6, event_id % 6)) AS gentle, least(60, pow(2, event_id % 6)) AS capped, 0.5 AS flat FROM events")
def backoff(spark, sf):
    n = F.col("event_id") % 6
    return table(spark, sf, "events").select("event_id", *[requests.backoff(n, k).alias(a) for k, a in (("double", "doubling"), ("gentle", "gentle"), ("capped", "capped"), ("flat", "flat"))])


@query("retry_after", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 7.5 WHEN 1 THEN 90.0 END AS seconds FROM events")
def retry_after(spark, sf):
    k = F.col("event_id") % 3
    header = F.when(k == 0, "7.5").when(k == 1, "Wed, 21 Oct 2015 07:28:00 GMT").otherwise("soon")
    seen = F.to_timestamp(F.lit("2015-10-21 07:26:30"))
    return table(spark, sf, "events").select("event_id", requests.retry_after(header, seen).alias("seconds"))


@query(
    "watchdog_first_violation",
    f"""{LOG}, r AS (SELECT user_id, row_number() OVER w AS n, avg(seconds) OVER w AS mean_s FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT user_id, CAST(min(n) AS INT) AS at_request, round(arg_min(mean_s, n), 9) AS mean_s FROM r WHERE n >= 10 AND n % 5 = 0 AND mean_s > 0.5 GROUP BY user_id""",
)
def watchdog_first_violation(spark, sf):
    return requests.watchdog(log(spark, sf), ["user_id"], ORDER, "seconds", 0.5, every=5).withColumn("mean_s", F.round("mean_s", 9))


@query(
    "success_rate",
    f"""{LOG} SELECT user_id, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, round(100.0 * avg(CAST(ok AS INT)), 6) AS percent, round(avg(CASE WHEN ok THEN seconds END), 9) AS mean_s,
     round(coalesce(count(*) / nullif(sum(seconds), 0), 0), 9) AS per_second, round(sum(seconds) / count(*) * 800, 6) AS for_800 FROM l GROUP BY user_id""",
)
def success_rate(spark, sf):
    rows = log(spark, sf).groupBy("user_id").agg(
        F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.round(metrics.percent(F.col("ok")), 6).alias("percent"), F.round(F.avg(F.when(F.col("ok"), F.col("seconds"))), 9).alias("mean_s"), F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("s")
    )
    return rows.select("user_id", "succeeded", "failed", "percent", "mean_s", F.round(metrics.throughput(F.col("n"), F.col("s")), 9).alias("per_second"), F.round(metrics.extrapolated(F.col("s"), F.col("n")), 6).alias("for_800"))


RUNS = "r AS (SELECT user_id, avg(seconds) AS speed, 100.0 * avg(CAST(ok AS INT)) AS rate FROM l GROUP BY user_id)"


@query(
    "best_config",
    f"""{LOG}, {RUNS} SELECT coalesce(arg_max(user_id, CASE WHEN rate >= 70 THEN speed END), arg_max(user_id, rate)) AS best,
     coalesce(arg_min(user_id, CASE WHEN rate >= 100 THEN user_id END), arg_min(user_id, CASE WHEN rate >= 90 THEN user_id END), arg_min(user_id, CASE WHEN rate >= 70 THEN user_id END)) AS first FROM r""",
)
def best_config(spark, sf):
    runs = log(spark, sf).groupBy("user_id").agg(F.avg("seconds").alias("speed"), metrics.percent(F.col("ok")).alias("rate"))
    return metrics.best_config(runs, "user_id", "speed", "rate", 70.0).crossJoin(metrics.first_reaching(runs, "user_id", "user_id", "rate"))


@query("type_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, string_agg(DISTINCT CAST(user_id % 5 AS VARCHAR), ',' ORDER BY CAST(user_id % 5 AS VARCHAR)) AS lanes FROM events GROUP BY event_type")
def type_counts(spark, sf):
    lane = (F.col("user_id") % 5).cast("string")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.array_join(F.array_sort(F.collect_set(lane)), ",").alias("lanes"))


@query("status_labels", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'missing' WHEN 2 THEN 'failed' ELSE 'failed' END AS label FROM events")
def status_labels(spark, sf):
    k = F.col("event_id") % 4
    status = F.when(k == 0, 200).when(k == 1, 404).when(k == 2, 503)
    return table(spark, sf, "events").select("event_id", classify.status_label(status).alias("label"))


@query("running_progress", "SELECT event_id, count(*) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS done, round(100.0 * count(*) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) / count(*) OVER (), 6) AS percent FROM events WHERE user_id = 1")
def running_progress(spark, sf):
    from pyspark.sql import Window

    rows = table(spark, sf, "events").where("user_id = 1")
    done = F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("event_id", done.alias("done"), F.round(done * 100.0 / F.count(F.lit(1)).over(Window.partitionBy("user_id")), 6).alias("percent"))
