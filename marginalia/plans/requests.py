"""Registered jobs on request logs and task states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators import admission as A

from .domain import SQL_FMT, Domain, said, sql
from .registry import query

#: The given events are sparse, so windows and caps of these queries are wide; the operators' defaults are the real ones.
WINDOW_MS, MOST, LIMIT = 24 * 3_600_000, 2, 60_000

_RATED = f"""n AS (SELECT *, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY ip ORDER BY ts, event_id) AS i FROM requests),
    r AS (SELECT ip, i, event_id, ms, ms AS start, 1 AS hits FROM n WHERE i = 1 UNION ALL SELECT n.ip, n.i, n.event_id, n.ms, CASE WHEN n.ms - r.start > {WINDOW_MS} THEN n.ms ELSE r.start END, CASE WHEN n.ms - r.start > {WINDOW_MS} THEN 1 ELSE r.hits + 1 END
        FROM r JOIN n ON n.ip = r.ip AND n.i = r.i + 1)"""


@query(sql(f"SELECT event_id, hits <= {MOST} AS rate_ok, CASE WHEN hits > {MOST} THEN CAST(ceil((start + {WINDOW_MS} - ms) / 1000.0) AS BIGINT) ELSE -1 END AS retry_after FROM r", _RATED))
def rate_limit(d: Domain) -> DataFrame:
    return A.rate_limited(d.requests(), WINDOW_MS, MOST).select("event_id", "rate_ok", F.coalesce("retry_after", F.lit(-1)).alias("retry_after"))


_SPENT = "sum(tokens) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query(sql(f"SELECT event_id, CAST(used AS BIGINT) AS used, used <= {LIMIT} OR k = 1 AS budget_ok FROM (SELECT event_id, {_SPENT} AS used, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM requests)"))
def token_budget(d: Domain) -> DataFrame:
    return A.budgeted(d.requests(), LIMIT).select("event_id", "used", "budget_ok")


@query(sql(f"""SELECT q.event_id, CASE WHEN NOT rate_ok THEN 'rate' WHEN is_admin THEN 'admin' WHEN used <= {LIMIT} OR k = 1 THEN 'ok' ELSE 'budget' END AS reason, CASE WHEN NOT rate_ok THEN false WHEN is_admin THEN true ELSE used <= {LIMIT} OR k = 1 END AS allowed
    FROM (SELECT requests.*, hits <= {MOST} AS rate_ok FROM requests JOIN r USING (event_id)) q LEFT JOIN (SELECT event_id, {_SPENT} AS used, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS k
    FROM requests JOIN (SELECT event_id FROM r WHERE hits <= {MOST}) USING (event_id) WHERE NOT is_admin) b USING (event_id)""", _RATED))
def admission(d: Domain) -> DataFrame:
    return A.admitted(d.requests(), WINDOW_MS, MOST, LIMIT).select("event_id", "reason", "allowed")


_OVERLOAD = sql("""SELECT event_id, CAST(pending AS BIGINT) AS pending, delta > 0 AND pending >= 20 AS rejected FROM (SELECT event_id, delta, coalesce(sum(delta) OVER (PARTITION BY kind, CAST(updated_at AS DATE) ORDER BY updated_at, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pending FROM (SELECT *, CASE status WHEN 'queued' THEN 1 WHEN 'processing' THEN 1 ELSE -1 END AS delta FROM transitions))""")


@query(_OVERLOAD)
def queue_overload(d: Domain) -> DataFrame:
    changes = d.transitions().select(F.col("kind").alias("queue"), F.to_date("updated_at").alias("day"), F.col("updated_at").alias("ts"), "event_id", F.when(F.col("status").isin("queued", "processing"), 1).otherwise(-1).alias("delta"))
    return A.overloaded(changes, 20).select("event_id", F.col("pending").cast("long").alias("pending"), "rejected")


_LATEST = "c AS (SELECT * FROM transitions QUALIFY row_number() OVER (PARTITION BY task_id, kind ORDER BY updated_at DESC, event_id DESC) = 1)"


@query(sql(f"SELECT task_id, kind, status, strftime(updated_at, {SQL_FMT}) AS updated_at FROM c", _LATEST))
def task_latest(d: Domain) -> DataFrame:
    return A.current(d.transitions()).select("task_id", "kind", "status", said("updated_at").alias("updated_at"))


@query(sql("SELECT task_id, kind FROM c WHERE epoch_us((SELECT max(ts) FROM events)) // 1000 - epoch_us(updated_at) // 1000 > CASE kind WHEN 'paper' THEN 48 ELSE 24 END * 3600000", _LATEST))
def task_expired(d: Domain) -> DataFrame:
    as_of = d.transitions().agg(F.max("updated_at")).first()[0]
    return A.expired(A.current(d.transitions()), F.lit(as_of), {"paper": 48}, 24).select("task_id", "kind")


@query(sql("SELECT kind, status, count(*) AS n FROM c GROUP BY 1, 2", _LATEST))
def task_counts(d: Domain) -> DataFrame:
    return A.current(d.transitions()).groupBy("kind", "status").agg(F.count("*").alias("n"))


@query(sql("SELECT c.task_id, CASE WHEN c.status IN ('queued', 'processing') THEN CASE WHEN c.task_id % 4 = 0 THEN 'expired' ELSE 'done' END ELSE c.status END AS status FROM c", _LATEST))
def task_refresh(d: Domain) -> DataFrame:
    own = A.current(d.transitions())
    server = own.where("task_id % 4 <> 0").select("task_id", F.lit("done").alias("status"))
    return A.refreshed(own, server).select("task_id", "status")
