"""Windows anchored at the first event of a key.

A window opens at an event, covers ``width`` microseconds, and the next window opens at the
first event after it ended. This is not a calendar window: where a window starts depends on the
whole history of the key, so each key is read in time order by one pass with a single number of
state. Keys of more than ``hot_rows`` events are cut into slabs, the ranges of one range
partitioning of their rows by key and time, and

1. per slab: for every event that could open its first window, which window is open when the
   slab ends (a small monotone table);
2. per key, over its slabs in time order: one lookup per slab gives the window open at its start;
3. the ordinary pass then runs per slab, starting from that window.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.operators.ordered import slab_running_sum
from corpusflow.session import staged

HOT_ROWS = 1_000_000
# Stands for "no window" in arrays of starts.
NO_WINDOW = -(1 << 63)


def chain_ends(times: np.ndarray, width: int) -> np.ndarray:
    """Index of the last window opened, for each event taken as the first opener.

    Openers are followed by doubling the number of windows jumped over: n log n, however short
    the windows are against the gaps.
    """
    n = len(times)
    following = np.searchsorted(times, times + width, side="left")
    # An opener without a next window leads to itself.
    jump = np.where(following < n, following, np.arange(n))
    while n:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    return jump


def slab_summary(times: np.ndarray, width: int):
    """Openers that may meet a window reaching into the slab, the window open at its end and its events."""
    # Earlier windows began at the slab's first time at the latest.
    reach = np.searchsorted(times, times[0] + width, side="left") + 1
    ends = times[chain_ends(times, width)][:reach]
    opens = times[: len(ends)]
    keep = np.append(ends[1:] != ends[:-1], True)
    inside = len(times) - np.searchsorted(times, ends[keep], side="left")
    return opens[keep], ends[keep], inside


def windows_of_run(times, able, first, entry, used, width: int):
    """Window start, whether it opened here, and openers so far, for rows of several groups.

    ``times`` ascend inside a group, ``first`` marks where groups begin, ``entry`` and ``used`` are, per group, the
    window open before its first row (or NO_WINDOW) and the openers that it already had.

    Gaps beyond a window say no more than a gap of one window, so all groups go on one axis with gaps of at most
    ``width`` and exactly ``width`` between groups: no window reaches from one to the next. A window that
    is already open is a row of its own before the group.
    """
    at = np.flatnonzero(first)
    has = np.flatnonzero(entry != NO_WINDOW)
    real = np.ones(len(times) + len(has), bool)
    real[at[has] + np.arange(len(has))] = False
    clock = np.empty(len(real), np.int64)
    clock[real], clock[~real] = times, entry[has]
    opener = np.ones(len(real), bool)
    opener[real] = able
    heads = np.zeros(len(real), bool)
    heads[real] = first
    carried = np.flatnonzero(~real)
    heads[carried], heads[carried + 1] = True, False
    gaps = np.minimum(np.diff(clock, prepend=clock[:1]), width)
    gaps[heads] = width
    axis = np.cumsum(gaps)

    openers = np.flatnonzero(opener)
    following = np.searchsorted(axis[openers], axis[openers] + width, side="left").tolist()
    chain, here = [], 0
    while here < len(following):
        chain.append(here)
        here = following[here]
    opened = np.zeros(len(real), bool)
    opened[openers[chain]] = True
    last = np.maximum.accumulate(np.where(opened, np.arange(len(real)), -1))
    inside = (last >= 0) & (axis - axis[last] < width)
    counted = opener & inside & real
    total = np.cumsum(counted)
    base = np.zeros(len(real), np.int64)
    base[carried] = used[has]
    ordinal = np.where(inside, base[last] + total - (total - counted)[last], 0)
    starts = np.where(inside, clock[last], NO_WINDOW)
    return starts[real], opened[real], ordinal[real]


def _hot_slabs(rows: DataFrame, keys: list[str], time: str, hot_rows: int) -> tuple[DataFrame | None, DataFrame]:
    """The rows of hot keys with their ``_slab``, written once (None without any), and all others.

    Slabs are the ranges of one range partitioning by key and time, so their number grows with the rows, a burst
    inside one window is spread like any other stretch, and equal times of a key stay together.
    """
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
    total = hot.agg(F.sum("_n")).first()[0]
    if total is None:
        return None, rows
    hot = staged(hot.select(*keys), "hot-keys")
    ranges = rows.join(hot, keys, "left_semi").repartitionByRange(math.ceil(total / hot_rows), *keys, time)
    cut = staged(ranges.withColumn("_slab", F.spark_partition_id().cast("bigint")), "hot-slabs")
    return cut, rows.join(hot, keys, "left_anti")


def _entries(hot_rows: DataFrame, keys: list[str], time: str, width: int) -> DataFrame:
    """Window open at the start of every slab of the hot keys."""
    group = [*keys, "_slab"]
    key_fields = [hot_rows.schema[k] for k in keys]
    slab_field = T.StructField("_slab", T.LongType())
    times = T.ArrayType(T.LongType())

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        opens, ends, inside = slab_summary(np.sort(pdf[time].to_numpy(dtype=np.int64)), width)
        head = pdf[group].iloc[:1].reset_index(drop=True)
        return head.assign(_opens=[opens.tolist()], _ends=[ends.tolist()], _inside=[inside.tolist()], _rows=len(pdf))

    summary = hot_rows.filter("can_open").select(*group, time).groupBy(*group).applyInPandas(
        summarise,
        T.StructType([
            *key_fields, slab_field, T.StructField("_opens", times), T.StructField("_ends", times),
            T.StructField("_inside", times), T.StructField("_rows", T.LongType()),
        ]),
    )

    def carry(batches):
        key, current, used = None, None, 0
        for pdf in batches:
            found, counts = [], []
            for row in pdf.itertuples(index=False):
                mine = tuple(row[: len(keys)])
                if mine != key:
                    key, current, used = mine, None, 0
                found.append(current)
                counts.append(used)
                opens, ends, inside, size = row[len(keys) + 1 :]
                if opens is None or not len(opens):
                    continue
                at = 0 if current is None else int(np.searchsorted(opens, current + width, side="left"))
                if at < len(opens):
                    current, used = int(ends[at]), int(inside[at])
                else:
                    used += int(size)
            yield pdf[group].assign(_entry=pd.array(found, dtype="Int64"), _used=counts)

    # Every slab with events gets a row, so that its entry is known even without openers.
    slabs = hot_rows.select(*group).distinct().join(summary, group, "left").select(
        *group, "_opens", "_ends", "_inside", "_rows"
    )
    ordered = slabs.repartition(*keys).sortWithinPartitions(*group)
    return ordered.mapInPandas(
        carry,
        T.StructType([*key_fields, slab_field, T.StructField("_entry", T.LongType()), T.StructField("_used", T.LongType())]),
    )


def anchored_windows(
    events: DataFrame, keys: list[str], time: str, width: int, tie: str = "request_id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``window_start`` (null outside any window), ``opened`` (this event opened it) and ``ordinal``
    (openers of the window so far) to narrow event rows.

    ``time`` is in microseconds; events of the same time are taken in the order of ``tie``. An
    optional boolean column ``can_open`` marks the events that may open a window; without it
    every event may.
    """
    rows = events if "can_open" in events.columns else events.withColumn("can_open", F.lit(True))
    cut, rest = _hot_slabs(rows, keys, time, hot_rows)
    none = {name: F.lit(None).cast("bigint") for name in ("_entry", "_used")}
    # Keys of one slab have no entry.
    rows = rest.withColumns({"_slab": F.lit(0).cast("bigint"), **none})
    if cut is not None:
        rows = rows.unionByName(cut.join(_entries(cut, keys, time, width), [*keys, "_slab"], "left"))

    group = [*keys, "_slab"]
    columns = events.columns

    def assign(batches):
        group_key, start, used = None, NO_WINDOW, 0
        for pdf in batches:
            if not len(pdf):
                continue
            first = np.zeros(len(pdf), bool)
            for name in group:
                column = pdf[name]
                before = column.shift()
                first |= ((column != before) & ~(column.isna() & before.isna())).to_numpy(dtype=bool)
            first[0] = True
            ends = pdf[group].iloc[[0, -1]].astype(object)
            ends = ends.where(ends.notna(), None)
            heads = np.flatnonzero(first)
            entries = pdf["_entry"].iloc[heads].astype("Int64").fillna(NO_WINDOW).to_numpy(dtype=np.int64)
            counts = pdf["_used"].iloc[heads].astype("Int64").fillna(0).to_numpy(dtype=np.int64)
            if tuple(ends.iloc[0]) == group_key:
                entries[0], counts[0] = start, used
            group_key = tuple(ends.iloc[-1])
            starts, opened, ordinals = windows_of_run(
                pdf[time].to_numpy(dtype=np.int64), pdf["can_open"].eq(True).to_numpy(dtype=bool), first, entries, counts, width
            )
            outside = starts == NO_WINDOW
            # A window that has ended opens nothing any more, so it needn't be carried on.
            start, used = int(starts[-1]), int(ordinals[-1])
            yield pdf[columns].assign(
                window_start=pd.arrays.IntegerArray(starts, outside), opened=opened,
                ordinal=pd.arrays.IntegerArray(ordinals, outside),
            )

    ordered = rows.select(*dict.fromkeys([*columns, "can_open", "_slab", "_entry", "_used"]))
    ordered = ordered.repartition(*group).sortWithinPartitions(*group, time, tie)
    added = [
        T.StructField("window_start", T.LongType()), T.StructField("opened", T.BooleanType()),
        T.StructField("ordinal", T.LongType()),
    ]
    return ordered.mapInPandas(assign, T.StructType([*events.schema.fields, *added]))


def fixed_window_limits(
    requests: DataFrame, points: int, window_seconds: int, keys: list[str] | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Rate limit decision per request; rejected requests count as well.

    ``requests``: keys, request_id, at (microseconds).
    """
    keys = keys or ["key"]
    width = window_seconds * 1_000_000
    windows = anchored_windows(requests, keys, "at", width, hot_rows=hot_rows)
    left = F.col("window_start") + width - F.col("at")
    seconds = F.floor((left + 500_000) / 1_000_000)
    return windows.drop("opened").withColumnRenamed("ordinal", "used").withColumns(
        {
            "allowed": F.col("used") <= points,
            "remaining": F.greatest(F.lit(points) - F.col("used"), F.lit(0)),
            "reset_seconds": F.when(seconds > 0, seconds).otherwise(F.lit(window_seconds)).cast("bigint"),
        }
    )


def _epochs(events: DataFrame, keys: list[str], starts: str, width: int, out: str) -> DataFrame:
    """Number of epoch-starting events up to and including each event, per key."""
    day = F.floor(F.col("at") / max(width, 86_400_000_000)).cast("bigint")
    return slab_running_sum(
        events, keys, day, [F.col("at"), F.col("request_id")], F.col(starts).cast("int"), out
    )


def ttl_cache_hits(
    requests: DataFrame, invalidations: DataFrame, ttl_seconds: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``hit`` per request of a cache filled by misses and cleared by the owner's changes.

    ``requests``: owner, key, request_id, at, storable (a miss without a storable result fills
    nothing). ``invalidations``: owner, request_id, at. The time to live counts from the fill.
    """
    width = ttl_seconds * 1_000_000
    marks = invalidations.select(
        "owner", F.lit(None).cast(requests.schema["key"].dataType).alias("key"), "request_id", "at",
        F.lit(False).alias("storable"), F.lit(True).alias("_clears"),
    )
    events = requests.select("owner", "key", "request_id", "at", "storable", F.lit(False).alias("_clears")).unionByName(marks)
    dated = staged(_epochs(events, ["owner"], "_clears", width, "_epoch").filter("not _clears").drop("_clears"), "cache-epochs")
    windows = anchored_windows(
        dated.withColumnRenamed("storable", "can_open"), ["owner", "key", "_epoch"], "at", width, hot_rows=hot_rows
    )
    # The event that opened a window is the miss that filled it.
    return windows.withColumn("hit", F.col("window_start").isNotNull() & ~F.col("opened")).select(
        "owner", "key", "request_id", "at", F.col("can_open").alias("storable"), "hit"
    )


def throttled_writes(events: DataFrame, interval_ms: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Progress events that are written: every stage change, and at most one counter per interval.

    ``events``: document_id, request_id, at, stage_change. A stage change restarts the clock.
    """
    width = interval_ms * 1000
    dated = staged(_epochs(events, ["document_id"], "stage_change", width, "_epoch"), "progress-epochs")
    windows = anchored_windows(dated, ["document_id", "_epoch"], "at", width, hot_rows=hot_rows)
    return windows.withColumnRenamed("opened", "written").drop("_epoch", "ordinal")
