"""Catalog entries for time-ordered operators.

The fixture log spans 30 days with 150 users, so real rates (5 per second)
never trigger; the queries use hour-scale parameters (e.g. weight 10 per
2 h) over the same operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeline as TL
from ..sources.seeded import seeded, with_clause
from ..sources.tables import read_table
from . import duck as D
from .catalog import register

FL = with_clause("fetch_log")
RATE = (10, 2 * TL.HOUR_US)


@register("host_key", FL + f"""
SELECT event_id, {D.hostname('url')} AS host, 1 AS key_weight, CAST(weight * 20 AS BIGINT) AS item_weight FROM fetch_log""")
def q_host_key(spark, sf):
    """Host key (hostname, weight 1) and item weight x base 20."""
    f = seeded(spark, sf, "fetch_log")
    k = TL.host_key("url")
    return f.select("event_id", k["host"].alias("host"), k["weight"].alias("key_weight"),
                    TL.item_weight("weight").alias("item_weight"))


@register("rate_window", FL + f"""
SELECT event_id, host, CAST(sum(weight) OVER (PARTITION BY host ORDER BY epoch_us(ts)
  RANGE BETWEEN {RATE[1] - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS window_weight,
  sum(weight) OVER (PARTITION BY host ORDER BY epoch_us(ts) RANGE BETWEEN {RATE[1] - 1} PRECEDING AND CURRENT ROW) > {RATE[0]} AS violates
FROM fetch_log""")
def q_rate_window(spark, sf):
    """Weight per host in any 2-hour window; violations of 10."""
    f = seeded(spark, sf, "fetch_log").select("event_id", "host", "ts", "weight")
    v = TL.violations(f, "host", "ts", "weight", [RATE])
    return v.select("event_id", "host", F.col("window_weight_0").cast("bigint").alias("window_weight"), "violates")


# The fold as a recursive CTE: per host, row by row in (ts, event_id) order,
# carrying the admitted items still inside the interval as a list.
ADMISSION_SQL = FL.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
o AS (SELECT host, event_id, epoch_us(ts) AS t, weight AS w,
             row_number() OVER (PARTITION BY host ORDER BY ts, event_id) AS rn FROM fetch_log),
r AS (
  SELECT host, rn, event_id, w <= {RATE[0]} AS admitted,
         CASE WHEN w <= {RATE[0]} THEN [{{'t': t, 'w': w}}] ELSE [] END AS items
  FROM o WHERE rn = 1
  UNION ALL
  SELECT o.host, o.rn, o.event_id,
         coalesce(list_sum(list_transform(list_filter(r.items, lambda x: x.t > o.t - {RATE[1]}), lambda x: x.w)), 0) + o.w <= {RATE[0]},
         CASE WHEN coalesce(list_sum(list_transform(list_filter(r.items, lambda x: x.t > o.t - {RATE[1]}), lambda x: x.w)), 0) + o.w <= {RATE[0]}
              THEN list_append(list_filter(r.items, lambda x: x.t > o.t - {RATE[1]}), {{'t': o.t, 'w': o.w}})
              ELSE list_filter(r.items, lambda x: x.t > o.t - {RATE[1]}) END
  FROM r JOIN o ON o.host = r.host AND o.rn = r.rn + 1)
SELECT event_id, host, admitted FROM r"""


@register("admission", ADMISSION_SQL)
def q_admission(spark, sf):
    """Sequential admission per host (10 per 2 h); refused items take no
    room. The oracle states the same fold as a recursive CTE."""
    f = seeded(spark, sf, "fetch_log").select("event_id", "host", "ts", "weight")
    return TL.admission(f, "host", "ts", "event_id", "weight", [RATE])


SN = with_clause("snapshots")


@register("hash_stability", SN + """,
p AS (SELECT url_id, content, row_number() OVER (PARTITION BY url_id ORDER BY poll) AS rnk FROM snapshots),
p1 AS (SELECT * FROM p WHERE rnk <= 8),
p2 AS (SELECT *, CASE WHEN lag(content) OVER (PARTITION BY url_id ORDER BY rnk) = content THEN 0 ELSE 1 END AS chg FROM p1),
p3 AS (SELECT *, sum(chg) OVER (PARTITION BY url_id ORDER BY rnk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM p2),
p4 AS (SELECT *, row_number() OVER (PARTITION BY url_id, isl ORDER BY rnk) AS pos FROM p3)
SELECT url_id, CAST(min(CASE WHEN pos >= 4 THEN rnk END) AS BIGINT) AS stable_at, count(*) AS polls_seen,
  min(CASE WHEN pos >= 4 THEN rnk END) IS NOT NULL AS stable FROM p4 GROUP BY url_id""")
def q_hash_stability(spark, sf):
    """Content-hash stability (3 repeats in a row within 8 polls)."""
    s = seeded(spark, sf, "snapshots")
    return TL.hash_stability(s, "url_id", "poll", "content")


@register("length_stability", """
WITH p AS (SELECT user_id, CAST(length(props) AS BIGINT) AS l, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rnk FROM events),
p1 AS (SELECT * FROM p WHERE rnk <= 5),
p2 AS (SELECT *, l = lag(l, 1, 0) OVER (PARTITION BY user_id ORDER BY rnk) AS eq FROM p1),
p3 AS (SELECT *, sum(CASE WHEN eq THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY rnk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM p2),
p4 AS (SELECT *, sum(CASE WHEN eq THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isl ORDER BY rnk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM p3)
SELECT user_id, CAST(min(CASE WHEN run >= 2 THEN rnk END) AS BIGINT) AS stable_at, count(*) AS polls_seen,
  min(CASE WHEN run >= 2 THEN rnk END) IS NOT NULL AS stable FROM p4 GROUP BY user_id""")
def q_length_stability(spark, sf):
    """Length stability (2 equal lengths in a row, at most 5 polls);
    polls are each user's events in time order, length = props length."""
    e = read_table(spark, sf, "events").select(
        "user_id", F.struct("ts", "event_id").alias("poll"), F.length("props").alias("len"))
    return TL.length_stability(e, "user_id", "poll", "len")


QUIET = (2 * TL.HOUR_US, TL.DAY_US)


@register("quiet_period", f"""
WITH t AS (SELECT user_id, epoch_us(ts) AS t FROM events),
q AS (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nx FROM t),
g AS (SELECT user_id, min(t) AS start_us, min(CASE WHEN nx IS NULL OR nx - t >= {QUIET[0]} THEN t + {QUIET[0]} END) AS q FROM q GROUP BY user_id)
SELECT user_id, start_us, CASE WHEN q - start_us <= {QUIET[1]} THEN q END AS quiet_at_us, q - start_us > {QUIET[1]} AS timed_out FROM g""")
def q_quiet_period(spark, sf):
    """First quiet gap (2 h, capped at 1 day) in each user's event stream."""
    e = read_table(spark, sf, "events").select("user_id", "ts")
    return TL.quiet_period(e, "user_id", "ts", *QUIET)


SIG = dict(min_chars=50, needed=3, gap_us=3 * TL.HOUR_US, cap_us=15 * TL.HOUR_US)


@register("quiet_or_significant", f"""
WITH t AS (SELECT user_id, epoch_us(ts) AS t, value AS a FROM events),
s AS (SELECT *, sum(CASE WHEN a > {SIG['min_chars']} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sig,
             lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nx FROM t),
g AS (SELECT user_id, min(t) AS start_us, min(CASE WHEN sig >= {SIG['needed']} THEN t END) AS sig_us,
             min(CASE WHEN nx IS NULL OR nx - t >= {SIG['gap_us']} THEN t + {SIG['gap_us']} END) AS quiet_us FROM s GROUP BY user_id),
r AS (SELECT *, least(sig_us, quiet_us, start_us + {SIG['cap_us']}) AS res FROM g)
SELECT user_id, res - start_us AS resolved_after_us,
  CASE WHEN res = sig_us THEN 'significant' WHEN res = quiet_us THEN 'quiet' ELSE 'cap' END AS resolved_by FROM r""")
def q_quiet_or_significant(spark, sf):
    """Resolve at the 3rd significant addition, a 3 h quiet gap, or 15 h."""
    e = read_table(spark, sf, "events").select("user_id", "ts", "value")
    return TL.quiet_or_significant(e, "user_id", "ts", "value", **SIG)


@register("backoff", FL + """,
a AS (SELECT url, status, row_number() OVER (PARTITION BY url ORDER BY ts, event_id) AS n FROM fetch_log),
b AS (SELECT url, n, CASE WHEN status < 400 THEN 'success' WHEN status IN (500, 502, 503, 504, 408, 429) THEN 'retry' ELSE 'fatal' END AS kind FROM a WHERE n <= 4),
g AS (SELECT url, min(CASE WHEN kind <> 'retry' THEN n END) AS stop, arg_min(kind, CASE WHEN kind <> 'retry' THEN n END) AS stop_kind, max(n) AS last FROM b GROUP BY url),
h AS (SELECT url, coalesce(stop, last) AS used, coalesce(stop_kind, CASE WHEN last = 4 THEN 'exhausted' ELSE 'pending' END) AS outcome,
             CASE WHEN stop IS NOT NULL THEN coalesce(stop, last) - 1 ELSE least(coalesce(stop, last), 3) END AS retries FROM g)
SELECT url, CAST(used AS BIGINT) AS attempts_used, outcome,
  CASE WHEN retries > 0 THEN list_sum(list_transform(range(0, retries), lambda n: least(1.0 * pow(2.0, n), 60.0))) ELSE 0.0 END AS total_delay_s FROM h""")
def q_backoff(spark, sf):
    """Retry outcome and backoff delay per URL over the request log."""
    f = seeded(spark, sf, "fetch_log").select("url", F.struct("ts", "event_id").alias("ord"), "status")
    return TL.backoff_outcome(f, "url", "ord", "status")
