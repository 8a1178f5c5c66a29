"""Operators over time: rate limits, expiring caches, circuit breakers, pacing. Batch forms and their streaming twins."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE_ROW = "client string, event_id long, ts double, allowed boolean, retry_after int"


def _admit(t: float, start: float | None, count: int, most: int, window: float) -> tuple[float, int, bool, int]:
    """One hit on a window that opens with a client's first hit; refused hits count too."""
    if start is None or t - start >= window:
        start, count = t, 0
    count += 1
    return start, count, count <= most, 0 if count <= most else int(window - (t - start))


def rate_limit(hits: DataFrame, most: int, window_s: float) -> DataFrame:
    """(client, event_id, ts, allowed, retry_after) of (client, event_id, ts in seconds). Windows are each client's own."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, start, count, out = pdf.sort_values(["ts", "event_id"]), None, 0, []
        for t in pdf["ts"]:
            start, count, ok, wait = _admit(t, start, count, most, window_s)
            out.append((ok, wait))
        return pdf.assign(allowed=[o[0] for o in out], retry_after=[o[1] for o in out])

    return hits.select("client", "event_id", "ts").groupBy("client").applyInPandas(fold, RATE_ROW)


def rate_limit_stream(hits: DataFrame, most: int, window_s: float) -> DataFrame:
    """The same over a stream: the window's start and count are the state of a client, dropped when it has passed."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for t in rows["ts"]:
            start, count, ok, wait = _admit(t, start, count, most, window_s)
            out.append((ok, wait))
        state.update((start, count))
        state.setTimeoutDuration(int(window_s * 1000))
        yield rows.assign(allowed=[o[0] for o in out], retry_after=[o[1] for o in out])[["client", "event_id", "ts", "allowed", "retry_after"]]

    return hits.select("client", "event_id", "ts").groupBy("client").applyInPandasWithState(step, RATE_ROW, "start double, count int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def pacing(calls: DataFrame, keys: list[str], interval_s: float) -> DataFrame:
    """calls with `at`, the time at which each may go out: at its own, and interval_s after the one before.

    max(ts_i - i * d) over the calls so far, plus i * d: a window function in place of a loop.
    """
    order = Window.partitionBy(*keys).orderBy("ts", "event_id")
    df = calls.withColumn("_i", F.row_number().over(order))
    slack = F.max(F.col("ts") - F.col("_i") * interval_s).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("at", slack + F.col("_i") * interval_s).drop("_i")


def paced_slots(calls: DataFrame, keys: list[str], interval_s: float, slots: int = 2) -> DataFrame:
    """calls (keys, event_id, ts, took) with `at`: interval_s after the one before, and not before one of `slots` is free."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, last, ends, out = pdf.sort_values(["ts", "event_id"]), float("-inf"), [float("-inf")] * slots, []
        for t, took in zip(pdf["ts"], pdf["took"], strict=True):
            last = max(t, last + interval_s, heapq.heappop(ends))
            heapq.heappush(ends, last + took)
            out.append(last)
        return pdf.assign(at=out)

    schema = T.StructType([*calls.select(*keys, "event_id", "ts", "took").schema.fields, T.StructField("at", T.DoubleType())])
    return calls.select(*keys, "event_id", "ts", "took").groupBy(*keys).applyInPandas(fold, schema)


def breaker(calls: DataFrame, failures: int = 2, open_s: float = 120.0) -> DataFrame:
    """(service, event_id, ts, kind, rejected) of calls whose kind is ok, refused (no connection) or other.

    Refused calls in a row, `failures` of them, open the circuit for open_s; a rejected call changes nothing,
    a good one resets the count, and expiry does not: one more refusal opens it again. Others count for neither.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, until, run, out = pdf.sort_values(["ts", "event_id"]), float("-inf"), 0, []
        for t, kind in zip(pdf["ts"], pdf["kind"], strict=True):
            out.append(t < until)
            if t >= until:
                run = 0 if kind == "ok" else run + (kind == "refused")
                if kind == "refused" and run >= failures:
                    until = t + open_s
        return pdf.assign(rejected=out)

    return calls.select("service", "event_id", "ts", "kind").groupBy("service").applyInPandas(fold, "service string, event_id long, ts double, kind string, rejected boolean")


def ttl_cache(reads: DataFrame, ttl_s: float) -> DataFrame:
    """(key, event_id, ts, hit): a read hits if the last write of its key is younger than ttl_s, else it writes."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, written, out = pdf.sort_values(["ts", "event_id"]), float("-inf"), []
        for t in pdf["ts"]:
            out.append(t < written + ttl_s)
            written = written if out[-1] else t
        return pdf.assign(hit=out)

    return reads.select("key", "event_id", "ts").groupBy("key").applyInPandas(fold, "key string, event_id long, ts double, hit boolean")


def live_entries(cache: DataFrame, now: Column, ttl_s: float) -> DataFrame:
    """The entries of a written cache (key, t, response) that have not expired and hold something, the last of each key."""
    fresh = cache.where(now - F.col("t") < ttl_s).where(F.coalesce(F.col("response"), F.lit("")) != "")
    return fresh.groupBy("key").agg(F.max_by("response", "t").alias("response"), F.max("t").alias("t"))


def cache_key() -> Column:
    """Lower-cased identifiers, attribute and options of a request; its category is no part of it."""
    names = ("name", "brand", "article", "mpn", "ean13", "upc", "attr", "type", "unit")
    return F.xxhash64(*[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in names], F.transform(F.coalesce("allowed", F.array().cast("array<string>")), F.lower))


def backoff(attempt: Column, base_s: float, retry_after: Column | None = None, most_s: float = 30.0) -> Column:
    """Seconds to wait before the next attempt: doubled each time, or what the server asks for up to most_s."""
    doubled = F.lit(base_s) * F.pow(F.lit(2.0), attempt)
    return doubled if retry_after is None else F.coalesce(F.least(retry_after.try_cast("double"), F.lit(most_s)), doubled)


def specs_stream(pages: DataFrame) -> DataFrame:
    """Rows of specifications of streamed pages; stateless, so each page's rows come once."""
    from specloom.sources.html import ROWS, _extract

    return pages.select("page_id", "html").mapInPandas(_extract, ROWS)
