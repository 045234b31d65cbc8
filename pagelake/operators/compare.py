"""Run comparison and roll-ups.

Two extraction runs of the same URLs (e.g. simple and browser mode) are
full-outer-joined on URL; parity rules and notes are column logic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mode_parity(simple: DataFrame, browser: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Inputs ``(url, success, text_length)``; parity when both succeed
    and browser length >= ratio x simple, when only browser succeeds, or
    when both fail. A URL that a run holds several times counts with its best
    fetch (successful, then longest)."""
    def once(run):
        return run.groupBy("url").agg(F.max(F.struct("success", "text_length")).alias("r")).select("url", "r.*")

    simple, browser = once(simple), once(browser)
    s = simple.select("url", F.col("success").alias("s_ok"), F.col("text_length").alias("s_len"))
    b = browser.select("url", F.col("success").alias("b_ok"), F.col("text_length").alias("b_len"))
    j = s.join(b, "url", "full_outer")
    s_ok, b_ok = F.coalesce("s_ok", F.lit(False)), F.coalesce("b_ok", F.lit(False))
    s_len, b_len = F.coalesce("s_len", F.lit(0)), F.coalesce("b_len", F.lit(0))
    good = b_len >= s_len * F.lit(ratio)
    lens = F.concat(F.lit("Browser "), b_len.cast("string"), F.lit(" vs Simple "), s_len.cast("string"))
    parity = (F.when(s_ok & b_ok, good).when(s_ok & ~b_ok, False).otherwise(True))
    notes = (F.when(s_ok & b_ok, F.concat(F.lit("Both modes successful|"),
                                          F.when(good, F.lit("Content parity good: ")).otherwise(F.lit("Content parity concern: ")), lens))
             .when(s_ok, F.lit("Browser mode failed while simple mode succeeded - PARITY ISSUE"))
             .when(b_ok, F.lit("Browser mode succeeded while simple mode failed - Browser advantage"))
             .otherwise(F.lit("Both modes failed")))
    return j.select("url", s_ok.alias("simple_success"), s_len.cast("bigint").alias("simple_length"),
                    b_ok.alias("browser_success"), b_len.cast("bigint").alias("browser_length"),
                    parity.alias("parity_achieved"), notes.alias("notes"))


def run_summary(parity: DataFrame) -> DataFrame:
    """Total, parity count and percentage (rounded half-even to 1)."""
    return parity.agg(F.count("*").alias("total"), F.count_if("parity_achieved").alias("parity")).select(
        "total", "parity", F.bround(F.col("parity") * 100.0 / F.col("total"), 1).alias("parity_pct"))


def success_rate(results: DataFrame) -> DataFrame:
    """Success rate per mode, ``results(mode, success)``."""
    return results.groupBy("mode").agg(F.count("*").alias("runs"), F.count_if("success").alias("successes")).select(
        "mode", "runs", "successes", F.bround(F.col("successes") / F.col("runs"), 4).alias("success_rate"))
