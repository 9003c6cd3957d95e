"""Incremental processing of arriving segments with Structured Streaming."""
from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rallyframe import constants as K
from rallyframe.session import shared_folder
from rallyframe.streaming.commits import Batches, Log

FRAME_STREAM = "match_id BIGINT, segment_idx BIGINT, frame_idx BIGINT, ts TIMESTAMP, fps DOUBLE, cx DOUBLE, cy DOUBLE, speed DOUBLE, ball_px DOUBLE"


def segment_files(spark: SparkSession, path: str, schema: str = FRAME_STREAM, fmt: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    """New segment files, each read once (the checkpoint remembers them)."""
    r = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path)


def _latest_runs(d: DataFrame) -> DataFrame:
    """Of every segment the rows of its latest run."""
    latest = d.groupBy("match_id", "segment_idx").agg(F.max("run_version").alias("run_version"))
    return d.join(latest, ["match_id", "segment_idx", "run_version"]).select(*d.columns)


def merge_segments(stream: DataFrame, table: str, checkpoint: str, run_version: int, compact_every: int = 16):
    """Append every micro-batch under its (run version, batch) and commit it; readers see committed batches only.

    A batch that is repeated after a failure is skipped if it was committed and written anew if not. A segment may span any
    number of batches; a re-run is a higher ``run_version``. After ``compact_every`` batches the current state is folded into one
    folder and older ones go. Read with ``merged_segments``.
    """
    def put(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("run_version", F.lit(run_version))
        Batches(batch.sparkSession, table, _latest_runs, compact_every).append(rows, run_version, batch_id)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def merged_segments(spark: SparkSession, table: str, schema: str = FRAME_STREAM) -> DataFrame:
    """Current state of a merged table: of every segment the rows of its latest run."""
    return _latest_runs(Batches(spark, table).read(f"{schema}, run_version INT")).drop("run_version")


def route_late(stream: DataFrame, table: str, checkpoint: str, delay_seconds: float, ts: str = "ts"):
    """Split a stream by what a watermark of ``delay_seconds`` would drop: rows that lie further behind the newest row of all batches
    before theirs go to ``table``/late, the others to ``table``/on_time, one folder a batch.

    A query with that watermark over the on-time folders drops nothing; what it lacks is in the late ones, for the next merge. The
    horizon of a batch is logged before its rows are written, and a folder gets its name in one step, so a repeated batch changes nothing. Rows without a
    time are on time.
    """
    def put(batch: DataFrame, batch_id: int) -> None:
        log, name = Log(batch.sparkSession, table), f"batch-{batch_id:012d}"
        entries, at = log.entries(), F.unix_micros(F.col(ts))
        if name not in entries:
            newest = [e["newest"] for n, e in entries.items() if n < name and e["newest"] is not None]
            own = batch.agg(F.max(at)).first()[0]
            entries[name] = {"horizon": max(newest) - round(delay_seconds * 1e6) if newest else None, "newest": max([*newest, own] if own is not None else newest, default=None)}
            log.commit(name, entries[name])
        horizon = entries[name]["horizon"]
        late = F.coalesce(at < horizon, F.lit(False)) if horizon is not None else F.lit(False)
        log.publish(batch.filter(late), f"{table}/late/batch={batch_id}")
        log.publish(batch.filter(~late), f"{table}/on_time/batch={batch_id}")
        log.forget([n for n in entries if n < name][:-1])
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def late_rows(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The rows routed aside so far."""
    return spark.read.schema(schema).parquet(f"{table}/late")


def rally_session_stream(events: DataFrame, fps: float, gap_frames: int = K.INACTIVITY_GAP, delay: str = "10 seconds") -> DataFrame:
    """Rallies as session windows.

    A session closes when the next event is at least the gap away, a rally when it is more than
    ``gap_frames`` away: half a frame more than the gap separates the two on whole frames.
    """
    gap_ms = math.ceil((gap_frames + 0.5) * 1000 / fps)
    s = events.withWatermark("ts", delay).groupBy("match_id", F.session_window("ts", f"{gap_ms} milliseconds").alias("w"))
    return s.agg(F.min("frame_idx").alias("rally_start"), F.max("frame_idx").alias("rally_end"), F.count(F.lit(1)).alias("n")).drop("w")


def coverage_stream(frames: DataFrame, width: str = "10 seconds", delay: str = "10 seconds") -> DataFrame:
    """Share of frames with a ball per tumbling slice."""
    return coverage_of(coverage_counts(frames.withWatermark("ts", delay), width))


def coverage_counts(frames: DataFrame, width: str = "10 seconds") -> DataFrame:
    """Frames and frames with a ball per tumbling slice, of a stream or a table; counts of several parts of the frames add up."""
    g = frames.groupBy("match_id", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("frames"), F.count("ball_px").alias("seen"))
    return g.select("match_id", F.col("w.start").alias("slice_start"), "frames", "seen")


def coverage_of(counts: DataFrame) -> DataFrame:
    return counts.select("match_id", "slice_start", "frames", (F.col("seen") * 100 / F.col("frames")).alias("ball_pct"))


def with_late(counts: DataFrame, late: DataFrame, width: str = "10 seconds") -> DataFrame:
    """The merge that follows: slices counted on time, with the rows that came too late for them."""
    both = counts.unionByName(coverage_counts(late, width))
    return both.groupBy("match_id", "slice_start").agg(F.sum("frames").alias("frames"), F.sum("seen").alias("seen"))


def pace_stream(frames: DataFrame, width: str = "3 seconds", slide: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """Mean speed over a sliding window."""
    g = frames.filter("speed IS NOT NULL").withWatermark("ts", delay).groupBy("match_id", F.window("ts", width, slide).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg("speed").alias("avg_speed")).select("match_id", F.col("w.start").alias("window_start"), "n", "avg_speed")


def first_copies(frames: DataFrame, delay: str) -> DataFrame:
    """Repeats of a frame dropped inside the watermark. ``delay`` must cover how far apart in event time files may arrive: rows
    behind it are lost; re-runs of any age belong to ``merge_segments``."""
    return frames.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["match_id", "frame_idx"])


def status_stream(log: DataFrame) -> DataFrame:
    """Latest stage and status per job (update mode); an error wins. ``n`` counts the rows folded, for keyed merges."""
    g = log.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("stage", "status"), "seq").alias("l"),
                                  F.max_by("error_message", F.when(F.col("error_message").isNotNull(), F.col("seq"))).alias("error_message"))
    return g.select("job_id", "n", F.col("l.stage").alias("stage"), F.when(F.col("error_message").isNotNull(), "error").otherwise(F.col("l.status")).alias("status"), "error_message")


# --- contacts with state ------------------------------------------------------------------------------

CONTACT = "match_id BIGINT, frame_idx BIGINT, sx DOUBLE, sy DOUBLE, vx DOUBLE, vy DOUBLE, speed DOUBLE"
STATE = "last_frame BIGINT, sx DOUBLE, sy DOUBLE, vx DOUBLE, vy DOUBLE, stable BIGINT, last_contact BIGINT"


class ContactDetector(StatefulProcessor):
    """Smoothed position, last velocity, stability and last contact of a match, carried across batches.

    Frames may arrive in any order within the watermark's delay and start at any number: they wait in a map until the watermark has passed
    them, so that nothing can come before them, or until the frame before them has been folded. The map holds the frames of one delay at most.
    Frames that come again, or after their place has been folded, are ignored. A gap in the numbers ends the stability count. A
    contact needs the frame after it, so the newest folded frame waits as a pending contact.

    A match closes ``idle_ms`` after its newest frame: a timer folds what still waits and clears all that is held of it.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("track", STATE + ", pending BOOLEAN, pending_speed DOUBLE, newest BIGINT, closes BIGINT")
        self.waiting = handle.getMapState("waiting", "frame_idx BIGINT", "ts_ms BIGINT, cx DOUBLE, cy DOUBLE, speed DOUBLE")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.state.get()) if self.state.exists() else [*START, -1, -1]
        s, newest, closes = held[:9], held[9], held[10]
        for part in rows:
            stamps = part["ts"].astype("datetime64[ms]").astype("int64")
            for ts, frame, cx, cy, speed in zip(stamps, part["frame_idx"], part["cx"], part["cy"], part["speed"], strict=True):
                newest = max(newest, int(ts))
                if s[0] is None or frame > s[0]:
                    self.waiting.updateValue((int(frame),), (int(ts), *(None if pd.isna(x) else float(x) for x in (cx, cy, speed))))
        found: list[tuple] = []
        self._advance(s, timerValues.getCurrentWatermarkInMs(), found, key[0])
        if newest + self.idle_ms != closes:
            if closes >= 0:
                self.handle.deleteTimer(closes)
            closes = newest + self.idle_ms
            self.handle.registerTimer(closes)
        self.state.update((*s, newest, closes))
        if found:
            yield pd.DataFrame(found, columns=[c.split()[0] for c in CONTACT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found: list[tuple] = []
        if self.state.exists():
            s = list(self.state.get())[:9]
            self._advance(s, None, found, key[0])
            self.state.clear()
            self.waiting.clear()
        if found:
            yield pd.DataFrame(found, columns=[c.split()[0] for c in CONTACT.split(", ")])

    def _advance(self, s: list, watermark: int | None, found: list, match_id: int) -> None:
        """Fold the frames that the watermark has passed (all of them without one), then those that follow without a gap."""
        for frame in sorted(k[0] for k, v in self.waiting.iterator() if watermark is None or v[0] < watermark):
            self._take(s, frame, found, match_id)
        while s[0] is not None and self.waiting.containsKey((s[0] + 1,)):
            self._take(s, s[0] + 1, found, match_id)

    def _take(self, s: list, frame: int, found: list, match_id: int) -> None:
        _fold(s, frame, *self.waiting.getValue((frame,))[1:], found, match_id)
        self.waiting.removeKey((frame,))

    def close(self) -> None:
        pass


START = [None, None, None, None, None, 0, -10**9, False, None]


def _fold(s: list, frame: int, cx: float | None, cy: float | None, speed: float | None, found: list, match_id: int) -> None:
    """One frame into the state: last frame, smoothed x and y, velocity, stable frames, last contact, pending, its speed."""
    last, sx, sy, vx, vy, stable, contact, pending, pending_speed = s
    if pending:
        found.append((match_id, last, sx, sy, vx, vy, pending_speed))
    if last is None or frame != last + 1:
        stable = 0
    if cx is None:
        held = 0.0 if sx is not None else None
        s[:] = [frame, sx, sy, held, held, 0, contact, False, None]
        return
    nx = cx if sx is None else K.EMA_ALPHA * cx + (1 - K.EMA_ALPHA) * sx
    ny = cy if sy is None else K.EMA_ALPHA * cy + (1 - K.EMA_ALPHA) * sy
    wx, wy = (None, None) if sx is None else (nx - sx, ny - sy)
    stable += 1
    hit = vx is not None and stable >= K.STABLE_FRAMES and frame - contact >= K.COOLDOWN and _is_contact(vx, vy, wx, wy)
    s[:] = [frame, nx, ny, wx, wy, stable, frame if hit else contact, hit, speed if hit else None]


def _is_contact(ux: float, uy: float, vx: float, vy: float) -> bool:
    before, after = math.hypot(ux, uy), math.hypot(vx, vy)
    if not K.CONTACT_MIN_SPEED <= max(before, after) <= K.CONTACT_MAX_SPEED or before * after < 0.01:
        return False
    cos = max(-1.0, min(1.0, (ux * vx + uy * vy) / (before * after)))
    return math.degrees(math.acos(cos)) >= K.CONTACT_ANGLE


def contact_stream(frames: DataFrame, delay: str = "10 seconds", idle: float = 60.0) -> DataFrame:
    """Contacts of a stream of projected frames, after the cooldown. ``delay`` covers the disorder of the frames; a match closes ``idle`` seconds after its
    newest frame. Frames behind the watermark are dropped: put ``route_late`` in front to keep and count them."""
    return frames.withWatermark("ts", delay).groupBy("match_id").transformWithStateInPandas(
        statefulProcessor=ContactDetector(round(idle * 1000)), outputStructType=CONTACT, outputMode="Append", timeMode="EventTime")


# --- running a stream to its end ------------------------------------------------------------------------

def drain(stream: DataFrame, name: str, keys: tuple[str, ...] = (), version: str | None = None) -> DataFrame:
    """Process everything available now and return the result table.

    Append streams go through the file sink. With ``keys`` the stream runs in update mode: each batch appends the rows it changed,
    and of every key the row with the largest ``version`` counts.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    w = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if not keys:
        w.outputMode("append").format("parquet").option("path", f"{folder}/table").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/table")
    put = lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{folder}/table/batch={batch_id}")
    w.outputMode("update").foreachBatch(put).start().awaitTermination()
    d = spark.read.schema(stream.schema).parquet(f"{folder}/table")
    rest = [c for c in stream.columns if c not in keys]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, "_r.*")
