"""Time-ordered logic over request logs and DOM polls.

Windows are keyed by host or URL. A host can hold a third of all rows, so
the sliding-window sum (W4) is computed per (host, time chunk): every row
is also copied, as context only, into the next chunk when it lies within
one interval of that chunk's start. A hot host is then sorted in parallel
chunks instead of one task, and results stay exact.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicons as L
from ..functions.urls import hostname

SECOND_US = 1_000_000
MINUTE_US = 60 * SECOND_US
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US


def ts_us(ts, df: DataFrame | None = None) -> Column:
    """Event time as epoch microseconds. A ``timestamp_ntz`` column (given by
    name with its DataFrame) is read as UTC wall-clock time independent of
    the session time zone; instants use ``unix_micros``."""
    if df is not None and isinstance(ts, str) and isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def as_instant(ts: str, df: DataFrame) -> Column:
    """``ts`` as a TIMESTAMP instant; a ``timestamp_ntz`` column is read as
    UTC wall-clock time, independent of the session time zone."""
    return F.timestamp_micros(ts_us(ts, df))


def host_key(url) -> Column:
    """``(hostname or '', weight 1)``."""
    return F.struct(F.coalesce(hostname(url), F.lit("")).alias("host"), F.lit(1).alias("weight"))


def simple_rates(max_rate_per_second: int = L.DEFAULT_RATE_PER_SECOND) -> list[tuple[int, int]]:
    """``r`` per second and ``10 r`` per minute, as (limit, interval_us)."""
    return [(max_rate_per_second, SECOND_US), (10 * max_rate_per_second, MINUTE_US)]


def item_weight(weight, base_weight: int = L.DEFAULT_BASE_WEIGHT) -> Column:
    """Weight times the base weight."""
    w = F.col(weight) if isinstance(weight, str) else weight
    return (w * F.lit(base_weight)).cast("bigint")


#: A chunk of the timeline is so many times the longest interval.
CHUNK_INTERVALS = 4


def window_weights(log: DataFrame, key: str, ts: str, weight: str, intervals: dict[str, int],
                   chunk_us: int | None = None) -> DataFrame:
    """For each output name, the total weight per key within
    ``(t - interval, t]`` for every row (RANGE frames, ties on ``t`` included).

    Frames are computed per (key, time chunk). A row near the end of its chunk
    is emitted a second time, as context of the next chunk, so the log is
    scanned, dealt out and sorted once for any number of intervals. The chunk
    follows the longest interval, so a busy key is split finely."""
    longest = max(intervals.values())
    chunk = max(chunk_us or CHUNK_INTERVALS * longest, longest)
    t = log.withColumn("_t", ts_us(ts, log)).withColumn("_own", F.floor(F.col("_t") / chunk))
    late = F.col("_t") > (F.col("_own") + 1) * chunk - longest
    t = t.withColumn("_c", F.explode(F.when(late, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array(F.col("_own")))))
    for name, interval in intervals.items():
        t = t.withColumn(name, F.sum(weight).over(W.partitionBy(key, "_c").orderBy("_t").rangeBetween(-(interval - 1), 0)))
    return t.where(F.col("_c") == F.col("_own")).drop("_t", "_c", "_own")


def window_weight(log: DataFrame, key: str, ts: str, weight: str, interval_us: int,
                  chunk_us: int | None = None, out: str = "window_weight") -> DataFrame:
    """:func:`window_weights` for one interval."""
    return window_weights(log, key, ts, weight, {out: interval_us}, chunk_us)


def violations_by_rules(log: DataFrame, key: str, ts: str, weight: str, rules: DataFrame,
                        chunk_us: int = HOUR_US) -> DataFrame:
    """W4 with per-key rules ``(key, limit, interval_us)``, any number of them:
    ``violates`` is true if a row's window of any of its key's rules weighs
    more than the rule's limit; keys without rules never violate.

    A frame needs a constant interval, so windows are differences of one
    running sum: S(t) - S(t - interval). Both are read off a timeline that
    holds, per distinct (key, t), the weight at t and one empty point at
    t - interval per rule; the sum runs per (key, time chunk), corrected by
    the chunks before."""
    t = log.withColumn("_t", ts_us(ts, log))
    at = t.groupBy(key, "_t").agg(F.sum(weight).cast("long").alias("_w"))
    lim = rules.select(key, F.col("limit").cast("long").alias("_limit"), F.col("interval_us").cast("long").alias("_iv"))
    points = at.join(lim, key).select(key, F.col("_t").alias("_at"), (F.col("_t") - F.col("_iv")).alias("_p"), F.lit(0).cast("long").alias("_w"), "_limit")
    line = (at.select(key, F.col("_t").alias("_at"), F.col("_t").alias("_p"), "_w", F.lit(None).cast("long").alias("_limit"))
            .unionByName(points).withColumn("_c", F.floor(F.col("_p") / F.lit(chunk_us))))
    inside = W.partitionBy(key, "_c").orderBy("_p").rangeBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(key).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    chunks = line.groupBy(key, "_c").agg(F.sum("_w").alias("_w")).select(key, "_c", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_before"))
    sums = line.withColumn("_s", F.sum("_w").over(inside)).join(chunks, [key, "_c"]).withColumn("_s", F.col("_s") + F.col("_before"))
    # S(t) is the row without a limit; a rule is broken if S(t) - S(t - interval) > limit
    broken = sums.groupBy(key, "_at").agg((F.max(F.when(F.col("_limit").isNull(), F.col("_s")))
                                           > F.min(F.col("_s") + F.col("_limit"))).alias("violates"))
    broken = broken.select(key, F.col("_at").alias("_t"), "violates")
    return t.join(broken, [key, "_t"], "left").withColumn("violates", F.coalesce("violates", F.lit(False))).drop("_t")


def violations(log: DataFrame, key: str, ts: str, weight: str, rates, **kw) -> DataFrame:
    """W4 for a rate table: one ``window_weight_i`` per rate, and ``violates``."""
    out = window_weights(log, key, ts, weight, {f"window_weight_{i}": interval for i, (_, interval) in enumerate(rates)}, **kw)
    cond = F.lit(False)
    for i, (limit, _) in enumerate(rates):
        cond = cond | (F.col(f"window_weight_{i}") > limit)
    return out.withColumn("violates", cond)


# ---- Two-level (key, time chunk) helpers ----
# A per-key window sorts all rows of a key in one task; a key holding a third
# of all rows makes that task the whole job. These helpers compute the same
# values exactly per (key, chunk) and fix the chunk borders with chunk-level
# aggregates, which are tiny (one row per key and chunk).
def _chunked(df: DataFrame, chunk_us: int) -> DataFrame:
    return df.withColumn("_c", F.floor(F.col("_t") / F.lit(chunk_us)))


def with_prev_next(df: DataFrame, key: str, order: list[str], chunk_us: int = DAY_US) -> DataFrame:
    """Add ``_prev``/``_next``: the previous and next ``_t`` of the same key in
    ``order`` (which starts with ``_t``)."""
    d = _chunked(df, chunk_us)
    w = W.partitionBy(key, "_c").orderBy(*order)
    d = d.withColumn("_p0", F.lag("_t").over(w)).withColumn("_n0", F.lead("_t").over(w))
    ch = d.groupBy(key, "_c").agg(F.min("_t").alias("_cmin"), F.max("_t").alias("_cmax"))
    wc = W.partitionBy(key).orderBy("_c")
    ch = ch.select(key, "_c", F.lag("_cmax").over(wc).alias("_pmax"), F.lead("_cmin").over(wc).alias("_nmin"))
    return (d.join(ch, [key, "_c"])
            .withColumn("_prev", F.coalesce("_p0", "_pmax")).withColumn("_next", F.coalesce("_n0", "_nmin"))
            .drop("_p0", "_n0", "_pmax", "_nmin"))


def with_running_sum(df: DataFrame, key: str, order: list[str], value: str, out: str,
                     chunk_us: int = DAY_US) -> DataFrame:
    """Add ``out``: running sum of ``value`` per key in ``order`` (from ``_t``)."""
    d = df if "_c" in df.columns else _chunked(df, chunk_us)
    w = W.partitionBy(key, "_c").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumn("_rs0", F.sum(value).over(w))
    ch = d.groupBy(key, "_c").agg(F.sum(value).alias("_ctot"))
    wc = W.partitionBy(key).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    ch = ch.select(key, "_c", F.coalesce(F.sum("_ctot").over(wc), F.lit(0)).alias("_off"))
    return d.join(ch, [key, "_c"]).withColumn(out, F.col("_rs0") + F.col("_off")).drop("_rs0", "_off")


# ---- W5: admission decision (sequential per key) ----
def _rates_for(rates, host, row_rates=None):
    if row_rates is not None:
        return [(int(r["limit"]), int(r["interval_us"])) for r in row_rates]
    return rates(host) if callable(rates) else rates


def _admit_partition(rates, key, ts_col, id_col, weight, per_row: bool):
    def run(batches):
        state_key, buckets, host_rates = None, None, None
        for pdf in batches:
            admitted = []
            row_rates = pdf["_rates"].values if per_row else [None] * len(pdf)
            for k, h, t, w, rr in zip(pdf["_seg"].values, pdf[key].values, pdf["_t"].values, pdf[weight].values,
                                      row_rates):
                if k != state_key:
                    host_rates = _rates_for(rates, h, rr)
                    state_key, buckets = k, [deque() for _ in host_rates]
                ok = True
                for (limit, interval), q in zip(host_rates, buckets):
                    while q and q[0][0] <= t - interval:
                        q.popleft()
                    if sum(x[1] for x in q) + w > limit:
                        ok = False
                if ok:
                    for q in buckets:
                        q.append((t, w))
                admitted.append(ok)
            yield pd.DataFrame({id_col: pdf[id_col].values, key: pdf[key].values, "admitted": admitted})
    return run


def rates_table(rules: DataFrame, key: str = "host", limit: str = "limit",
                interval_us: str = "interval_us") -> DataFrame:
    """W2 as data: rules ``(key, limit, interval_us)``, several rows per key
    allowed, folded to one row per key with its rate list and longest
    interval (a per-key list, bounded by the number of rates per key)."""
    return rules.groupBy(key).agg(
        F.collect_list(F.struct(F.col(limit).cast("long").alias("limit"),
                                F.col(interval_us).cast("long").alias("interval_us"))).alias("_rates"),
        F.max(F.col(interval_us).cast("long")).alias("_longest"))


def admission(log: DataFrame, key: str, ts: str, id_col: str, weight: str, rates,
              partitions: int | None = None, max_interval_us: int | None = None,
              chunk_us: int = DAY_US, default_rates=None) -> DataFrame:
    """One bucket per key; an item that would push any rate's window
    total over its limit is refused and takes no room.

    ``rates`` is a list of ``(limit, interval_us)``; or, like the reference's
    rate strategy, a function from the key (host) to such a list, called
    when a bucket is created (then ``max_interval_us`` must bound every
    interval it returns); or a rules DataFrame ``(key, limit, interval_us)``
    (:func:`rates_table`), joined to the log with ``default_rates`` for keys without rules.

    The decision is a fold over time, so it runs sequentially per key. A
    key's timeline is cut into independent segments wherever the gap
    between items reaches the key's longest interval (the bucket is empty
    then). The gaps and segment numbers come from the two-level (key, time
    chunk) helpers, so even a hot key is sorted in parallel chunks;
    segments are hash-partitioned, sorted by Spark (external sort) and
    streamed through ``mapInPandas`` in Arrow batches, holding only the
    items still inside a window. Ties on ``ts`` are ordered by ``id_col``.
    """
    from ..session import ensure_shipped
    ensure_shipped(log.sparkSession)
    t = log.select(key, id_col, weight, ts_us(ts, log).alias("_t"))
    per_row = isinstance(rates, DataFrame)
    if per_row:
        if default_rates is None:
            raise ValueError("default_rates is required with a rules DataFrame")
        rules = rates_table(rates, key)
        dflt = F.array(*[F.struct(F.lit(lim).cast("long").alias("limit"), F.lit(iv).cast("long").alias("interval_us"))
                         for lim, iv in default_rates])
        t = (t.join(rules, key, "left")
             .withColumn("_rates", F.coalesce("_rates", dflt))
             .withColumn("_longest", F.coalesce("_longest", F.lit(max(i for _, i in default_rates)).cast("long"))))
        longest = F.col("_longest")
    else:
        lg = max_interval_us if callable(rates) else max(i for _, i in rates)
        if lg is None:
            raise ValueError("max_interval_us is required when rates is a function")
        longest = F.lit(lg)
    order = ["_t", id_col]
    t = with_prev_next(t, key, order, chunk_us)
    t = t.withColumn("_gap", F.coalesce(((F.col("_t") - F.col("_prev")) >= longest).cast("int"), F.lit(0)))
    seg = with_running_sum(t, key, order, "_gap", "_segno", chunk_us)
    seg = seg.withColumn("_seg", F.concat_ws("\u0001", F.col(key), F.col("_segno").cast("string")))
    n = partitions or log.sparkSession.sparkContext.defaultParallelism
    ordered = seg.repartition(n, "_seg").sortWithinPartitions("_seg", "_t", id_col)
    schema = f"{id_col} long, {key} string, admitted boolean"
    cols = ["_seg", "_t", id_col, key, weight] + (["_rates"] if per_row else [])
    return ordered.select(*cols).mapInPandas(
        _admit_partition(None if per_row else rates, key, "_t", id_col, weight, per_row), schema)


# ---- W6/W7: stability by repeats (gaps and islands) ----
def hash_stability(polls: DataFrame, key: str, poll: str, content: str,
                   repeats: int = L.HASH_STABLE_REPEATS, max_polls: int = L.HASH_MAX_POLLS) -> DataFrame:
    """Stable once the same content hash is seen ``repeats`` more times in
    a row within the first ``max_polls`` polls. ``stable_at`` is the poll
    number where that happens."""
    p = (polls.select(key, poll, F.xxhash64(content).alias("_h"))
         .withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(poll)))
         .where(F.col("_rank") <= max_polls))
    w = W.partitionBy(key).orderBy("_rank")
    p = (p.withColumn("_chg", F.when(F.lag("_h").over(w).eqNullSafe(F.col("_h")), 0).otherwise(1))
         .withColumn("_isl", F.sum("_chg").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
         .withColumn("_pos", F.row_number().over(W.partitionBy(key, "_isl").orderBy("_rank"))))
    return p.groupBy(key).agg(
        F.min(F.when(F.col("_pos") >= repeats + 1, F.col("_rank"))).cast("bigint").alias("stable_at"),
        F.count("*").alias("polls_seen")).withColumn("stable", F.col("stable_at").isNotNull())


def length_stability(polls: DataFrame, key: str, poll: str, length: str,
                     repeats: int = L.LENGTH_STABLE_REPEATS, max_polls: int = L.LENGTH_MAX_POLLS) -> DataFrame:
    """Stop after ``repeats`` equal lengths in a row (the previous length
    starts at 0), at most ``max_polls`` polls."""
    p = (polls.select(key, poll, F.col(length).cast("bigint").alias("_l"))
         .withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(poll)))
         .where(F.col("_rank") <= max_polls))
    w = W.partitionBy(key).orderBy("_rank")
    p = (p.withColumn("_eq", F.col("_l") == F.lag("_l", 1, 0).over(w))
         .withColumn("_isl", F.sum(F.when(F.col("_eq"), 0).otherwise(1)).over(
             w.rowsBetween(W.unboundedPreceding, W.currentRow)))
         .withColumn("_run", F.sum(F.when(F.col("_eq"), 1).otherwise(0)).over(
             W.partitionBy(key, "_isl").orderBy("_rank").rowsBetween(W.unboundedPreceding, W.currentRow))))
    return p.groupBy(key).agg(
        F.min(F.when(F.col("_run") >= repeats, F.col("_rank"))).cast("bigint").alias("stable_at"),
        F.count("*").alias("polls_seen")).withColumn("stable", F.col("stable_at").isNotNull())


# ---- W8/W9: quiet periods ----
def quiet_period(mutations: DataFrame, key: str, ts: str, gap_us: int = L.QUIET_MS * 1000,
                 cap_us: int = L.QUIET_CAP_MS * 1000, chunk_us: int = DAY_US) -> DataFrame:
    """Per key, the first time ``gap_us`` passes without a mutation after
    the first one; NULL (timed out) when that is later than ``cap_us`` after
    the first mutation. Next-event times come from the two-level helper;
    the final step is a partial aggregate."""
    t = mutations.select(key, ts_us(ts, mutations).alias("_t"))
    q = with_prev_next(t, key, ["_t"], chunk_us)
    q = q.withColumn("_quiet", F.when(F.col("_next").isNull() | (F.col("_next") - F.col("_t") >= gap_us),
                                      F.col("_t") + gap_us))
    g = q.groupBy(key).agg(F.min("_t").alias("start_us"), F.min("_quiet").alias("_q"))
    return g.select(key, "start_us", F.when(F.col("_q") - F.col("start_us") <= cap_us, F.col("_q")).alias("quiet_at_us"),
                    (F.col("_q") - F.col("start_us") > cap_us).alias("timed_out"))


def quiet_or_significant(mutations: DataFrame, key: str, ts: str, added: str,
                         min_chars: int = 50, needed: int = 3, gap_us: int = 3 * SECOND_US,
                         cap_us: int = 15 * SECOND_US, chunk_us: int = DAY_US) -> DataFrame:
    """Resolve at the ``needed``-th significant addition (over
    ``min_chars`` chars), or after ``gap_us`` of quiet, or at ``cap_us``,
    whichever comes first; ``resolved_by`` names the rule. Running counts
    and next-event times come from the two-level helpers."""
    t = mutations.select(key, ts_us(ts, mutations).alias("_t"),
                         F.when(F.col(added) > min_chars, 1).otherwise(0).alias("_s"))
    t = with_prev_next(t, key, ["_t"], chunk_us)
    t = with_running_sum(t, key, ["_t"], "_s", "_sig", chunk_us)
    g = t.groupBy(key).agg(
        F.min("_t").alias("start_us"),
        F.min(F.when(F.col("_sig") >= needed, F.col("_t"))).alias("sig_us"),
        F.min(F.when(F.col("_next").isNull() | (F.col("_next") - F.col("_t") >= gap_us), F.col("_t") + gap_us)).alias("quiet_us"))
    cap = F.col("start_us") + cap_us
    res = F.least(F.col("sig_us"), F.col("quiet_us"), cap)
    return g.select(key, (res - F.col("start_us")).alias("resolved_after_us"),
                    F.when(res == F.col("sig_us"), "significant").when(res == F.col("quiet_us"), "quiet")
                    .otherwise("cap").alias("resolved_by"))


# ---- W10: backoff schedule ----
def backoff_outcome(attempts: DataFrame, key: str, order: str, status: str,
                    max_retries: int = L.BACKOFF["max_retries"], base: float = L.BACKOFF["base_delay"],
                    factor: float = L.BACKOFF["factor"], max_delay: float = L.BACKOFF["max_delay"]) -> DataFrame:
    """Over an attempt log, the outcome of a retry loop: first success,
    first non-retryable failure ('fatal'), or 'exhausted' after
    ``max_retries`` retries; ``total_delay_s`` sums min(base*factor^n, max)
    over the retries taken."""
    from .classify import is_retryable
    a = (attempts.select(key, order, status)
         .withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order)))
         .where(F.col("_n") <= max_retries + 1)
         .withColumn("_kind", F.when(F.col(status) < 400, "success")
                     .when(is_retryable(status), "retry").otherwise("fatal")))
    g = a.groupBy(key).agg(
        F.min(F.when(F.col("_kind") != "retry", F.col("_n"))).alias("_stop"),
        F.min_by("_kind", F.when(F.col("_kind") != "retry", F.col("_n"))).alias("_stop_kind"),
        F.max("_n").alias("_last"))
    used = F.coalesce(F.col("_stop"), F.col("_last"))
    outcome = F.coalesce(F.col("_stop_kind"), F.when(F.col("_last") == max_retries + 1, "exhausted").otherwise("pending"))
    retries = F.when(F.col("_stop").isNotNull(), used - 1).otherwise(F.least(used, F.lit(max_retries)))
    delay = F.aggregate(F.sequence(F.lit(0), retries - 1), F.lit(0.0),
                        lambda acc, n: acc + F.least(F.lit(base) * F.pow(F.lit(factor), n), F.lit(max_delay)))
    return g.select(key, used.cast("bigint").alias("attempts_used"), outcome.alias("outcome"),
                    F.when(retries > 0, delay).otherwise(F.lit(0.0)).alias("total_delay_s"))
