"""Alert states, recovery and anomaly episodes on streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from opswatch.functions import from_micros, micros

SECOND = 1_000_000


def alert_transitions(
    df: DataFrame,
    condition: Column,
    series: str,
    ts: str = "ts",
    for_: float = 5.0,
    step: float = 5.0,
    cooldown_checks: int = 10,
    late: str = "30 seconds",
) -> DataFrame:
    """Changes of each series' alert: pending, firing, inactive, and recovered.

    ``df`` streams one row per series and evaluation instant, in any order within ``late`` of the
    newest instant. An instant is held until the watermark has passed it and is then evaluated in
    time order, so the changes do not depend on how rows came in batches. ``recovered`` follows after
    ``cooldown_checks`` consecutive evaluations without firing. State is four numbers per series and
    its instants that are still held.
    """
    held, width = round(for_ * SECOND), round(step * SECOND)
    out = T.StructType(
        [
            T.StructField("series", T.StringType()),
            T.StructField("at", T.LongType()),
            T.StructField("state", T.StringType()),
        ]
    )
    kept = T.StructType(
        [
            T.StructField("last", T.LongType()),
            T.StructField("since", T.LongType()),
            T.StructField("state", T.StringType()),
            T.StructField("quiet", T.LongType()),
            T.StructField("waiting", T.ArrayType(T.LongType())),
            T.StructField("waiting_on", T.ArrayType(T.BooleanType())),
        ]
    )

    def run(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        last, since, current, quiet = -1, -1, "inactive", -1
        at, on = [np.empty(0, np.int64)], [np.empty(0, bool)]
        if state.exists:
            last, since, current, quiet, waiting, waiting_on = state.get
            at.append(np.asarray(waiting, np.int64))
            on.append(np.asarray(waiting_on, bool))
        if not state.hasTimedOut:
            for rows in batches:
                at.append(rows["at"].to_numpy(np.int64))
                on.append(rows["on"].to_numpy(bool))
        at, on = np.concatenate(at), np.concatenate(on)
        order = np.argsort(at, kind="stable")
        at, on = at[order], on[order]
        passed = state.getCurrentWatermarkMs() * 1000
        ready = int(np.searchsorted(at, passed, side="left"))
        changes = []
        for instant, active in zip(at[:ready].tolist(), on[:ready].tolist(), strict=True):
            if instant <= last:
                continue
            if not active:
                since, new = -1, "inactive"
            else:
                if since < 0 or instant - last > width:
                    since = instant
                new = "firing" if instant - since >= held else "pending"
            if new != current:
                changes.append((instant, new))
            # quiet: evaluations since the last firing one, -1 when nothing is left to recover.
            if new == "firing":
                quiet = 0
            elif quiet >= 0:
                quiet += 1
                if quiet >= cooldown_checks:
                    changes.append((instant, "recovered"))
                    quiet = -1
            last, current = instant, new
        state.update((last, since, current, quiet, at[ready:].tolist(), on[ready:].tolist()))
        if ready < len(at):
            state.setTimeoutTimestamp(max(int(at[ready]) // 1000, passed // 1000) + 1)
        if changes:
            found = pd.DataFrame(changes, columns=["at", "state"])
            found.insert(0, "series", key[0])
            yield found

    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    rows = timed.select(
        F.col(series).cast("string").alias("series"),
        F.col(ts).alias("instant"),  # carries the watermark
        micros(F.col(ts)).alias("at"),
        F.coalesce(condition, F.lit(False)).alias("on"),
    )
    changes = rows.groupBy("series").applyInPandasWithState(
        run, out, kept, "append", GroupStateTimeout.EventTimeTimeout
    )
    return changes.select(
        F.col("series").alias(series), from_micros(F.col("at")).alias(ts), "state"
    )


def counter_growth(
    samples: DataFrame,
    series: Sequence[str],
    ts: str = "ts",
    value: str = "value",
    window: float = 30.0,
    step: float | None = 5.0,
    out: str = "increase",
    late: str = "30 seconds",
) -> DataFrame:
    """A stream of counter samples to the growth over the ``window`` seconds up to each evaluation instant.

    With ``step`` the rows are those of ``counter_on_grid``, without it those of ``counter_increase`` (one per sample), and they do
    not depend on how samples come in batches: a sample is held until the watermark has passed it, and an
    instant is evaluated once nothing at or before it can still come. State per series is the samples that a coming instant can
    still reach, a ring of ``window`` seconds; a timer on event time evaluates the instants after a series' last sample and
    then removes its state. ``series`` are text in the result.
    """
    span, width = round(window * SECOND), None if step is None else round(step * SECOND)
    names = list(series)
    out_schema = T.StructType(
        [T.StructField(n, T.StringType()) for n in names]
        + [T.StructField("at", T.LongType()), T.StructField("last", T.DoubleType()), T.StructField("grown", T.DoubleType())]
    )
    kept = T.StructType(
        [
            T.StructField("upto", T.LongType()),
            T.StructField("at", T.ArrayType(T.LongType())),
            T.StructField("value", T.ArrayType(T.DoubleType())),
        ]
    )

    def run(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        upto, at, values = None, [np.empty(0, np.int64)], [np.empty(0)]
        if state.exists:
            upto, old_at, old_values = state.get
            at.append(np.asarray(old_at, np.int64))
            values.append(np.asarray(old_values, float))
        if not state.hasTimedOut:
            for rows in batches:
                at.append(rows["at"].to_numpy(np.int64))
                values.append(rows["value"].to_numpy(float))
        at, values = _unique_samples(np.concatenate(at), np.concatenate(values))
        passed = state.getCurrentWatermarkMs() * 1000
        due = _due_instants(at, upto, passed, span, width)
        if len(due):
            upto = int(due[-1])
        found = _growth(at, values, due, span)
        # what a coming instant can reach: later than the range of the first one not yet evaluated
        following = passed if width is None else -(-passed // width) * width
        reachable = at > following - span
        at, values = at[reachable], values[reachable]
        if len(at):
            state.update((upto, at.tolist(), values.tolist()))
            coming = int(at[0]) if width is None else int(max(following, -(-int(at[0]) // width) * width))
            waiting = int(at[np.searchsorted(at, passed)]) if int(at[-1]) >= passed else int(at[-1]) + span
            timer = waiting if width is None else coming
            state.setTimeoutTimestamp(max(timer // 1000, passed // 1000) + 1)
        elif state.exists:
            state.remove()
        if len(found):
            for i, n in enumerate(names):
                found.insert(i, n, key[i])
            yield found

    timed = samples.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    rows = timed.select(
        *[F.col(n).cast("string").alias(n) for n in names],
        F.col(ts).alias("instant"),  # carries the watermark
        micros(F.col(ts)).alias("at"),
        F.col(value).cast("double").alias("value"),
    )
    grown = rows.groupBy(*names).applyInPandasWithState(
        run, out_schema, kept, "append", GroupStateTimeout.EventTimeTimeout
    )
    return grown.select(*names, from_micros(F.col("at")).alias(ts), F.col("last").alias(value), F.col("grown").alias(out))


def _unique_samples(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples in time order, of one time the largest."""
    order = np.lexsort((values, at))
    at, values = at[order], values[order]
    last = np.append(at[1:] != at[:-1], True) if len(at) else np.empty(0, bool)
    return at[last], values[last]


def _due_instants(at: np.ndarray, upto: int | None, passed: int, span: int, width: int | None) -> np.ndarray:
    """Instants after ``upto`` that the watermark has passed and whose range holds a sample."""
    if not len(at):
        return at
    if width is None:
        due = at[at < passed]
    else:
        first = -(-at // width)
        last = np.minimum((at + span - 1) // width, (passed - 1) // width)
        counts = np.maximum(last - first + 1, 0)
        ends = np.cumsum(counts)
        steps = np.arange(int(ends[-1])) - np.repeat(ends - counts, counts)
        due = np.unique((np.repeat(first, counts) + steps) * width)
    return due if upto is None else due[due > upto]


def _growth(at: np.ndarray, values: np.ndarray, due: np.ndarray, span: int) -> pd.DataFrame:
    """Last value and growth in the left-open range of ``span`` up to each instant."""
    drop = np.diff(values, prepend=values[:1]) if len(values) else values
    grown = np.cumsum(np.where(drop < 0, values, drop)) if len(values) else values
    first = np.searchsorted(at, due - span, side="right")
    last = np.searchsorted(at, due, side="right") - 1
    return pd.DataFrame({"at": due, "last": values[last], "grown": grown[last] - grown[first]})


def anomaly_sessions(
    anomalies: DataFrame,
    keys: Sequence[str] = (),
    ts: str = "ts",
    gap: float = 10.0,
    grace: float = 5.0,
    late: str = "30 seconds",
) -> DataFrame:
    """A stream's anomaly episodes, by the rules of ``anomaly_episodes``, each once the watermark is more than ``gap`` past it.

    Each task first reduces its anomalies to cells of length ``gap`` (members of a cell are always in one run). Only cells are shuffled
    and merged with their neighbours in state: without ``keys`` these meet in one place, at most one per task and
    ``gap`` of time, however many anomalies there are. State is the sessions that are still open.
    """
    width, names = round(gap * SECOND), list(keys)
    timed = anomalies.select(*names, micros(F.col(ts)).alias("__at")).where(F.col("__at").isNotNull())
    fields = [timed.schema[n] for n in names]
    longs = [T.StructField(n, T.LongType()) for n in ("__first", "__last", "__n")]

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            at = batch.column(len(names))
            cell = pa.array(np.asarray(at) // width)
            columns = [*(batch.column(i) for i in range(len(names))), cell, at, at, pa.array(np.ones(len(at), np.int64))]
            total = _summed(total, pa.table(columns, [*names, "__cell", "__first", "__last", "__n"]), [*names, "__cell"])
        if total is not None and total.num_rows:
            yield from total.select([*names, "__first", "__last", "__n"]).to_batches()

    cells = timed.mapInArrow(reduced, T.StructType([*fields, *longs]))
    cells = cells.withColumn("instant", F.timestamp_micros("__last")).withWatermark("instant", late)
    kept = T.StructType([T.StructField(n, T.ArrayType(T.LongType())) for n in ("__first", "__last", "__n")])

    def merge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [np.array(state.get, np.int64)] if state.exists else []
        if not state.hasTimedOut:
            parts += [rows[["__first", "__last", "__n"]].to_numpy(np.int64).T for rows in batches]
        sessions = _merged(np.concatenate(parts, axis=1), width)
        passed = state.getCurrentWatermarkMs() * 1000
        over = sessions[1] + width < passed
        still = sessions[:, ~over]
        if still.shape[1]:
            state.update(tuple(still.tolist()))
            state.setTimeoutTimestamp(max((int(still[1].min()) + width) // 1000, passed // 1000) + 1)
        elif state.exists:
            state.remove()
        if over.any():
            found = pd.DataFrame(sessions[:, over].T, columns=["__first", "__last", "__n"])
            for i, n in enumerate(names):
                found.insert(i, n, key[i])
            yield found

    # a stream's groups need a key
    grouped = cells.groupBy(*names) if names else cells.withColumn("all", F.lit(0)).groupBy("all")
    merged = grouped.applyInPandasWithState(
        merge, T.StructType([*fields, *longs]), kept, "append", GroupStateTimeout.EventTimeTimeout
    )
    recovered = F.greatest(F.col("__last") + width, F.col("__first") + round(grace * SECOND))
    return merged.select(
        *names,
        from_micros(F.col("__first")).alias("first_anomaly"),
        from_micros(F.col("__last")).alias("last_anomaly"),
        F.col("__n").alias("anomalies"),
        from_micros(recovered).alias("recovered_at"),
    )


def first_detections(
    anomalies: DataFrame,
    injections: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    injected: str = "injected_at",
    horizon: str = "1 hour",
    late: str = "30 seconds",
) -> DataFrame:
    """Streams of injections and anomalies to each injection with the earliest anomaly at or after it.

    The rows are those of ``first_detection``, but that an injection without an anomaly within ``horizon`` of it is given up and comes
    out with null. An injection comes out once the watermark has passed its first anomaly (or the horizon), so
    the result does not depend on how rows come in batches. State per key is the injections that still wait and the rows
    the watermark has not passed; anomalies that it has passed are forgotten.
    """
    names = list(keys)
    reach = F.expr(f"CAST(INTERVAL '{horizon.split()[0]}' {horizon.split()[1]} AS INTERVAL DAY TO SECOND)")
    asked = injections.select(*names, F.col(injected).cast("timestamp").alias("__instant"), F.lit(0).alias("__role"))
    seen = anomalies.select(*names, F.col(ts).cast("timestamp").alias("__instant"), F.lit(1).alias("__role"))
    rows = asked.unionByName(seen).withWatermark("__instant", late)
    # the horizon in microseconds goes along, so that intervals are Spark's to read
    at = micros(F.col("__instant"))
    rows = rows.select(*names, "__instant", at.alias("__at"), "__role", (micros(F.col("__instant") + reach) - at).alias("__reach"))
    fields = [rows.schema[n] for n in names]
    out = T.StructType([*fields, T.StructField("__injected", T.LongType()), T.StructField("__detected", T.LongType())])
    kept = T.StructType([T.StructField(n, T.ArrayType(T.LongType())) for n in ("__open", "__upto", "__waiting")])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, upto, waiting = map(np.array, state.get) if state.exists else ([], [], [])
        opened, upto, waiting = [opened], [upto], [waiting]
        if not state.hasTimedOut:
            for part in batches:
                role, times = part["__role"].to_numpy(), part["__at"].to_numpy(np.int64)
                opened.append(times[role == 0])
                upto.append((part["__at"] + part["__reach"]).to_numpy(np.int64)[role == 0])
                waiting.append(times[role == 1])
        opened, upto, waiting = (np.concatenate(x).astype(np.int64) for x in (opened, upto, waiting))
        passed, waiting = state.getCurrentWatermarkMs() * 1000, np.sort(waiting)
        ready = waiting[waiting < passed]
        place = np.searchsorted(ready, opened)
        first = np.append(ready, np.iinfo(np.int64).max)[place]
        found = (opened < passed) & (first <= upto)
        over = found | (upto < passed)
        still, later = opened[~over], waiting[waiting >= passed]
        if len(still) or len(later):
            state.update((still.tolist(), upto[~over].tolist(), later.tolist()))
            timers = [*later[:1].tolist(), *np.sort(upto[~over])[:1].tolist()]
            state.setTimeoutTimestamp(max(min(timers) // 1000, passed // 1000) + 1)
        elif state.exists:
            state.remove()
        if over.any():
            detected = pd.array(np.where(found, first, 0)[over], "Int64")
            detected[~found[over]] = pd.NA
            result = pd.DataFrame({"__injected": opened[over], "__detected": detected})
            for i, n in enumerate(names):
                result.insert(i, n, key[i])
            yield result

    merged = rows.groupBy(*names).applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.EventTimeTimeout)
    return merged.select(
        *names, from_micros(F.col("__injected")).alias(injected), from_micros(F.col("__detected")).alias("detected_at")
    )


def _summed(total: pa.Table | None, more: pa.Table, by: list[str]) -> pa.Table:
    """Cells of both tables, each once."""
    both = more if total is None else pa.concat_tables([total, more])
    found = both.group_by(by).aggregate([("__first", "min"), ("__last", "max"), ("__n", "sum")])
    return found.select([*by, "__first_min", "__last_max", "__n_sum"]).rename_columns([*by, "__first", "__last", "__n"])


def _merged(cells: np.ndarray, width: int) -> np.ndarray:
    """Rows first, last, n of cells or sessions, those no more than ``width`` apart as one."""
    first, last, n = cells[:, np.argsort(cells[0], kind="stable")]
    reach = np.maximum.accumulate(last)
    starts = np.flatnonzero(np.append(True, first[1:] - reach[:-1] > width))
    return np.array([first[starts], np.maximum.reduceat(last, starts), np.add.reduceat(n, starts)])
