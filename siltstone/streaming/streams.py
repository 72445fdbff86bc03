"""Structured Streaming: ingestion of a landing folder, quota windows over call logs, anchored segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from siltstone import schemas
from siltstone.functions import text as X
from siltstone.sources.files import extension

MINUTE, RESET_HOUR, MARGIN, WAIT = 60_000_000, 8, 0.2, 30.0
# How messages tell a reached quota and when to come again.
RETRY_DELAY = r"(?i)retry[_\-\s]*delay[\"':\s]+(?:\{[^}]*seconds[\"':\s]+)?(\d+)"
QUOTA = r"(?i)429|resource_exhausted|quota|rate limit"


def landing_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The files of a landing folder as a stream: path, name, ext, length, content."""
    files = spark.readStream.format("binaryFile").schema(schemas.FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select("path", name.alias("name"), extension(name).alias("ext"), "length", "content")


def ingest_stream(files: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each batch of files to `handle(batch, batch_id)` and drains what is there; a batch that was cut off comes again at restart."""
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def convert_batch(files: DataFrame) -> DataFrame:
    """name, markdown, status of a batch of text files: what can't be decoded or is empty has failed, and stops nothing."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    good = X.has_text(text)
    return files.select("name", F.when(good, text).alias("markdown"), F.when(good, "done").otherwise("failed").alias("status"))


def rpm_window(calls: DataFrame, limits: DataFrame) -> DataFrame:
    """calls (model, ts) with in_window (calls of the last 60 s, this one included) and wait: seconds until the oldest leaves, if rpm is reached.

    Calls are counted minute by minute, each with the minute before it, so a hot model spreads over its minutes. Calls without a time count each other.
    """
    us = F.unix_micros("ts")
    own = calls.withColumns({"us": us, "ahead": F.explode(F.when(us.isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))})
    w = Window.partitionBy("model", F.floor(F.col("us") / MINUTE) + F.col("ahead")).orderBy("us").rangeBetween(-MINUTE, 0)
    own = own.withColumns({"in_window": F.count("*").over(w), "oldest": F.min("us").over(w)}).where("ahead = 0").drop("ahead")
    own = own.join(F.broadcast(limits.select("model", "rpm")), "model", "left")
    wait = F.when((F.col("rpm") > 0) & (F.col("in_window") >= F.col("rpm")), 60 - (F.col("us") - F.col("oldest")) / 1e6 + MARGIN).otherwise(0.0)
    return own.withColumn("wait", wait).drop("us", "oldest", "rpm")


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The calls of the second minute of each window (model, start, times), with the calls of their last 60 s."""
    for batch in batches:
        out = []
        for model, start, times in batch.itertuples(index=False):
            times = np.sort(np.asarray(times, dtype=np.int64))
            us = times[times >= start + MINUTE]
            n = np.searchsorted(times, us, "right") - np.searchsorted(times, us - MINUTE, "left")
            out.append(pd.DataFrame({"model": model, "us": us, "in_window": n}))
        yield pd.concat(out) if out else pd.DataFrame({"model": [], "us": [], "in_window": []})


def rpm_stream(calls: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """The streaming form of rpm_window over calls (model, ts): model, us, in_window. Calls may come in any order.

    A minute goes out, and its state with it, when the watermark passes its end; calls later than `lateness` are dropped, as are calls
    without a time. State: two minutes of times for each model and open minute.
    """
    w = F.window("ts", "2 minutes", "1 minute")
    by = calls.withWatermark("ts", lateness).groupBy("model", w).agg(F.collect_list(F.unix_micros("ts")).alias("times"))
    by = by.select("model", F.unix_micros("window.start").alias("start"), "times")
    return by.mapInPandas(_counted, "model string, us bigint, in_window bigint")


def daily_quota(calls: DataFrame, limits: DataFrame) -> DataFrame:
    """model, day (begins at 08:00 UTC), calls, exhausted: the day's limit (rpd) is reached; limits of 0 or less never are. Batch or stream."""
    by = calls.groupBy("model", F.window("ts", "1 day", "1 day", f"{RESET_HOUR} hours").alias("w")).agg(F.count("*").alias("calls"))
    by = by.join(F.broadcast(limits.select("model", "rpd")), "model", "left")
    return by.select("model", F.col("w.start").alias("day"), "calls", ((F.coalesce("rpd", F.lit(0)) > 0) & (F.col("calls") >= F.col("rpd"))).alias("exhausted"))


def effective_limits(models: DataFrame, defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """model, rpm, rpd of each model: the override, else the default, else the default named `_default`."""
    names = ("rpm", "rpd")
    side = lambda df, tag: F.broadcast(df.select("model", *[F.col(n).alias(f"{n}_{tag}") for n in names]))
    rest = F.broadcast(defaults.where("model = '_default'").select(*[F.col(n).alias(f"{n}_r") for n in names]))
    out = models.join(side(overrides, "o"), "model", "left").join(side(defaults, "d"), "model", "left").crossJoin(rest)  # one row
    return out.select("model", *[F.coalesce(f"{n}_o", f"{n}_d", f"{n}_r").alias(n) for n in names])


def classify_errors(log: DataFrame) -> DataFrame:
    """log (message, attempt) with is_quota and retry_after in seconds: what the message says, else 30 s times the attempt; null for other errors."""
    quota = F.col("message").rlike(QUOTA)
    told = F.regexp_extract("message", RETRY_DELAY, 1).try_cast("double")
    return log.withColumn("is_quota", quota).withColumn("retry_after", F.when(quota, F.coalesce(told, WAIT * F.col("attempt"))))


class _Anchor(StatefulProcessor):
    """Holds a video's segments until the watermark has passed them, then takes them in order of time.

    What waits is kept in few pieces: the segments of a batch are one, as lists (ms, start, duration, text), so that the cost of the state doesn't grow with each segment.
    Keeps the open group (start, stop, text, number, time of its last segment in ms); it goes out when the next one begins or the video has been idle.
    """

    def __init__(self, seconds: float, idle: int):
        self.seconds, self.idle = seconds, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms array<bigint>, start array<double>, duration array<double>, text array<string>")
        self.open = handle.getValueState("open", "start double, stop double, text string, no int, ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        come = [r for batch in rows for r in zip(*(batch[c].tolist() for c in ("ms", "start", "duration", "text"))) if isinstance(r[3], str) and r[3].strip()]
        if come:
            self.waiting.appendValue(tuple(map(list, zip(*come))))
            self.handle.registerTimer(min(r[0] for r in come) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted(r for piece in self.waiting.get() for r in zip(*piece))
        ready = [r for r in held if r[0] < now]
        later = held[len(ready) :]
        was = self.open.get()
        group = None if was is None else list(was)
        out, words = [], [group[2]] if group else []

        def close() -> None:
            out.append((key[0], group[3], group[0], group[1], " ".join(words)))

        for ms, start, duration, text in ready:
            text = text.strip()
            idle = group is not None and ms - group[4] > self.idle
            if group and not idle and start - group[0] < self.seconds:
                group[1], group[4] = start + duration, ms
                words.append(text)
                continue
            if group:
                close()
            group = [start, start + duration, "", group[3] + 1 if group and not idle else 0, ms]
            words = [text]
        if group and group[4] + self.idle < now:
            close()
            group = None
        if later:
            self.waiting.put([tuple(map(list, zip(*later)))])
            self.handle.registerTimer(later[0][0] + 1)
        elif held:
            self.waiting.clear()
        if group:
            group[2] = " ".join(words)
            self.open.update(tuple(group))
            self.handle.registerTimer(group[4] + self.idle + 1)
        elif was is not None:
            self.open.clear()
        if out:
            yield pd.DataFrame(out, columns=["video_id", "group_no", "start", "end", "text"])

    def close(self) -> None:
        pass


def segment_stream(segments: DataFrame, seconds: float = 60.0, lateness: str = "10 minutes", idle: int = 86_400) -> DataFrame:
    """The streaming form of grouping segments (video_id, ts, start, duration, text), which may come in any order: closed groups.

    Segments are taken in order of ts (milliseconds), then start, once the watermark has passed them; later ones are dropped. A group is closed by the next
    one, or when nothing came for `idle` seconds: then the video's state goes, and what still comes begins at group 0. Segments without text or time are dropped.
    """
    kind = "video_id string, group_no int, start double, end double, text string"
    own = segments.where("ts IS NOT NULL").withWatermark("ts", lateness).select("video_id", "ts", F.unix_millis("ts").alias("ms"), F.col("start").cast("double").alias("start"), F.col("duration").cast("double").alias("duration"), "text")
    return own.groupBy("video_id").transformWithStateInPandas(_Anchor(seconds, idle * 1000), kind, "Append", "EventTime")
