"""The stateful operators over streams: change detection and token buckets, keyed state that survives restarts in the checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def append_changes(stream: DataFrame, keys: list[str], fields: list[str], at: str = "scraped_at", tie: str = "id") -> DataFrame:
    """Rows of a stream that are the first of their key, the first of a UTC day, or a change; with ``reason``. Equal to ``operators.history.to_append`` if batches arrive in order.

    State a key: the last row's time and fields. A row that is older than the state is judged by the state it finds.
    """
    out = T.StructType([*stream.schema.fields, T.StructField("reason", T.StringType())])
    state = T.StructType([T.StructField("day", T.StringType()), *(stream.schema[f] for f in fields)])
    columns = out.names

    def run(_key: tuple, batches: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values([at, tie], kind="stable")
        last = s.get if s.exists else None
        keep = []
        for r in rows.to_dict("records"):
            day = str(r[at].date())
            now = tuple(None if pd.isna(r[f]) else r[f] for f in fields)
            reason = "first" if last is None else "new_day" if last[0] != day else "changed" if tuple(last[1:]) != now else None
            last = (day, *now)
            if reason:
                keep.append({**r, "reason": reason})
        s.update(last)
        yield pd.DataFrame(keep, columns=columns)

    return stream.groupBy(*keys).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def token_buckets(stream: DataFrame, rate: float, burst: float, host: str = "host", at: str = "at", cost: str = "cost") -> DataFrame:
    """Requests with ``granted``: a bucket a host, refilled by event time. Equal to ``operators.states.token_bucket`` if batches arrive in order."""
    out = T.StructType([*stream.schema.fields, T.StructField("granted", T.BooleanType())])
    columns = out.names

    def run(_key: tuple, batches: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values([at, "event_id"], kind="stable")
        tokens, last = s.get if s.exists else (burst, None)
        granted = []
        for t, c in zip(rows[at].astype("int64") / (1e9 if rows[at].dtype == "datetime64[ns]" else 1e6), rows[cost]):
            have = burst if last is None else min(burst, tokens + (t - last) * rate)
            granted.append(bool(have >= c))
            if granted[-1]:
                tokens, last = have - c, t
            elif last is None:
                tokens, last = burst, t
        s.update((tokens, last))
        yield rows.assign(granted=granted)[columns]

    return stream.groupBy(host).applyInPandasWithState(run, out, "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def watch(spark: SparkSession, folder: str, schema: T.StructType, kind: str = "json", files: int = 100) -> DataFrame:
    """A stream of the files that come into a folder, ``files`` a batch at most; with a trigger of some interval, polling."""
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files).load(folder)


def lease_timers(stream: DataFrame, late: str = "0 seconds", lease_minutes: int = 30, job: str = "id", at: str = "at") -> DataFrame:
    """(id, worker, lease_until, state) of a stream of signs (id, worker, kind, at): "held" when a worker claims a job, "finished" when it completes or releases it, "expired" once event time passes its lease.

    A heartbeat of the worker that holds a job extends its lease; one of another
    worker, or for a job that has expired, doesn't. State a job: who holds it
    and until when; the timer runs on the stream's watermark, ``late`` behind.
    """
    out = T.StructType([stream.schema[job], T.StructField("worker", T.StringType()), T.StructField("lease_until", T.TimestampType()), T.StructField("state", T.StringType())])
    names = out.names

    def run(key: tuple, batches: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        holder, until = s.get if s.exists else (None, 0)
        if s.hasTimedOut:
            rows.append((key[0], holder, pd.Timestamp(until, unit="ms", tz="UTC").tz_localize(None), "expired"))
            s.remove()
            yield pd.DataFrame(rows, columns=names)
            return
        for r in pd.concat(list(batches)).sort_values([at, "kind"], kind="stable").to_dict("records"):
            now = int(pd.Timestamp(r[at]).timestamp() * 1000)
            if holder is not None and now >= until:
                rows.append((key[0], holder, pd.Timestamp(until, unit="ms"), "expired"))
                holder = None
            if r["kind"] == "claim" and holder is None:
                holder, until = r["worker"], now + 60_000 * lease_minutes
                rows.append((key[0], holder, pd.Timestamp(until, unit="ms"), "held"))
            elif holder is not None and r["worker"] == holder:
                if r["kind"] == "heartbeat":
                    until = now + 60_000 * lease_minutes
                elif r["kind"] in ("complete", "release"):
                    rows.append((key[0], holder, pd.Timestamp(until, unit="ms"), "finished"))
                    holder = None
        if holder is None:
            if s.exists:
                s.remove()
        else:
            s.update((holder, until))
            s.setTimeoutTimestamp(max(until, s.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=names)

    return stream.withWatermark(at, late).groupBy(job).applyInPandasWithState(run, out, "worker string, until long", "append", GroupStateTimeout.EventTimeTimeout)
