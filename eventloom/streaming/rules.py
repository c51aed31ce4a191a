"""Detection rules: streaming, table-building and scheduled.

A detection has rule, time, values and linked events. Detections are appended to a Parquet table by batch: a batch that
runs again after a failure replaces its own folder, so detections are written once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.operators.state_tables import suppress_duplicates


def event_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_at_once: int = 1000) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_at_once).load(path)


LINKS = "array<struct<stream_id: bigint, event_id: bigint>>"


def detection(rule: str, time: str, values: Sequence[str], links: Sequence[str] = ()) -> list[Column]:
    """The columns of a detection: rule, time, values (name and text) and linked_events, by the columns (stream id,
    event id) of its event, or by one column with an array of such pairs; null without `links`."""
    pairs = F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("string").alias("value")) for v in values])
    if len(links) == 2:
        linked = F.array(F.struct(*[F.col(c).cast("bigint").alias(n) for c, n in zip(links, ("stream_id", "event_id"), strict=True)]))
    else:
        linked = F.col(links[0]) if links else F.lit(None)
    return [F.lit(rule).alias("rule"), F.col(time).alias("time"), pairs.alias("values"), linked.cast(LINKS).alias("linked_events")]


@dataclass(frozen=True)
class StreamingRule:
    """Every row that meets the condition is a detection; with unique_by, once for each combination within `memory`."""

    name: str
    condition: Column
    time: str
    values: Sequence[str]
    unique_by: Sequence[str] = ()
    memory: str = "1 day"
    links: Sequence[str] = ()

    def detections(self, events: DataFrame) -> DataFrame:
        hits = events.where(self.condition)
        if self.unique_by:
            if events.isStreaming:
                hits = hits.withWatermark(self.time, self.memory).dropDuplicatesWithinWatermark(list(self.unique_by))
            else:
                hits = suppress_duplicates(hits, list(self.unique_by))
        return hits.select(*detection(self.name, self.time, self.values, self.links))

    def start(self, events: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
        return start(self.detections(events), sink, checkpoint)


@dataclass(frozen=True)
class TableBuilderRule:
    """Group totals kept over all streams; groups that meet `having` are detections each time they change.

    The state holds one row a group. With retention, which needs a time window, groups older than that are dropped.
    settled() leaves out the rows of a batch that are younger than `wait`, so that late ones can still come."""

    name: str
    keys: Sequence[str]
    aggregates: dict[str, Column]
    having: Column
    time: str
    retention: str | None = None
    window: str | None = None
    wait: str | None = None

    def __post_init__(self) -> None:
        if self.retention and not self.window:
            raise ValueError("retention needs a window: without one the state of old groups is never freed")

    def settled(self, events: DataFrame, now: Column | None = None) -> DataFrame:
        """The rows that have waited long enough at `now`."""
        if self.wait is None:
            return events
        return events.where(F.col(self.time) <= (F.localtimestamp() if now is None else now) - F.expr(f"interval {self.wait}"))

    def table(self, events: DataFrame) -> DataFrame:
        if events.isStreaming and self.retention:
            events = events.withWatermark(self.time, self.retention)
        keys: list = list(self.keys)
        if self.window:
            keys.append(F.window(self.time, self.window).alias("window"))
        return events.groupBy(*keys).agg(*[a.alias(n) for n, a in self.aggregates.items()], F.max(self.time).alias("time"))

    def detections(self, events: DataFrame) -> DataFrame:
        return self.table(events).where(self.having).select(*detection(self.name, "time", [*self.keys, *self.aggregates]))

    def start(self, events: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
        return start(self.detections(events), sink, checkpoint, mode="update")


@dataclass(frozen=True)
class ScheduledRule:
    """A batch query over consecutive time windows: run() covers the window that ends at a time."""

    name: str
    query: Callable[[DataFrame], DataFrame]
    time: str
    values: Sequence[str]
    links: Sequence[str] = ()

    def run(self, events: DataFrame, start: datetime, end: datetime) -> DataFrame:
        own = events.where((F.col(self.time) >= F.lit(start).cast("timestamp_ntz")) & (F.col(self.time) < F.lit(end).cast("timestamp_ntz")))
        found = self.query(own)
        return found.withColumn("_end", F.lit(end).cast("timestamp_ntz")).select(*detection(self.name, "_end", self.values, self.links))


def start(detections: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs over all input that is there, then stops; a later call goes on from the checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return detections.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def cron_times(schedule: str, first: datetime, last: datetime) -> list[datetime]:
    """The times of a cron schedule after `first`, up to `last`: minute, hour, day of month, month and day of week
    (0 or 7: Sunday), with `*`, lists, ranges and steps; six fields begin with seconds, of which 0 alone is known here,
    and `?` is `*`. As usual, a time meets either of the two day fields if both are restricted."""
    fields = schedule.split()
    if len(fields) == 6 and fields[0] == "0":
        fields = fields[1:]
    if len(fields) != 5:
        raise ValueError(f"not a schedule: {schedule}")

    def members(field: str, low: int, high: int) -> set[int]:
        found: set[int] = set()
        for part in field.split(","):
            span, _, step = part.partition("/")
            a, _, b = span.partition("-")
            lo, hi = (low, high) if a in ("*", "?") else (int(a), int(b or (high if step else a)))
            if not low <= lo <= hi <= high:
                raise ValueError(f"not a schedule: {schedule}")
            found |= set(range(lo, hi + 1, int(step or 1)))
        return found

    minutes, hours, days, months = (members(f, lo, hi) for f, (lo, hi) in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12)), strict=False))
    weekdays = {d % 7 for d in members(fields[4], 0, 7)}
    by_day, by_weekday = (not f.startswith(("*", "?")) for f in (fields[2], fields[4]))
    found, at = [], first.replace(second=0, microsecond=0) + timedelta(minutes=1)
    while at <= last:
        in_days, in_weekdays = at.day in days, at.isoweekday() % 7 in weekdays
        if at.month not in months or not (in_days or in_weekdays if by_day and by_weekday else in_days and in_weekdays):
            at = at.replace(hour=0, minute=0) + timedelta(days=1)
        elif at.hour not in hours:
            at = at.replace(minute=0) + timedelta(hours=1)
        else:
            if at.minute in minutes:
                found.append(at)
            at += timedelta(minutes=1)
    return found


def cron_windows(schedule: str, first: datetime, last: datetime) -> list[tuple[datetime, datetime]]:
    """The contiguous (start, end) windows between the times of a cron schedule; the first one starts at `first`."""
    ends = cron_times(schedule, first, last)
    return list(zip([first, *ends[:-1]], ends, strict=True))


def windows(first: datetime, last: datetime, every) -> list[tuple[datetime, datetime]]:
    """The contiguous (start, end) windows of a schedule between two times."""
    found, at = [], first
    while at + every <= last:
        found.append((at, at + every))
        at += every
    return found
