"""Readers of tracking result files of many runs at once."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rallyframe import schemas
from rallyframe.operators.state import replace_run


def run_of(level: int = 1) -> Column:
    """Run id: the name of the folder ``level`` steps above the file."""
    return F.element_at(F.split("_metadata.file_path", "/"), -1 - level)


def empty(spark: SparkSession, schema: str, *extra: str) -> DataFrame:
    return spark.createDataFrame([], ", ".join([schema, *extra]))


def frames(spark: SparkSession, path: str) -> DataFrame:
    """Per-frame JSON lines; lines that do not parse are skipped, missing parts are null."""
    try:
        d = spark.read.schema(schemas.FRAME).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return empty(spark, schemas.FRAME, "job_id STRING")
    return d.select("*", run_of().alias("job_id"))


def flat_frames(frames_df: DataFrame) -> DataFrame:
    """Frame records as flat columns for the statistics."""
    xy = lambda c: [F.get(c, 0), F.get(c, 1)]
    px, py = xy(F.col("ball.pixel_xy"))
    cx, cy = xy(F.col("ball.court_xy"))
    return frames_df.select(
        F.col("job_id").alias("match_id"), "frame_idx", F.col("timestamp_sec").alias("t_sec"), px.alias("ball_px"), py.alias("ball_py"), cx.alias("cx"), cy.alias("cy"),
        F.col("ball.speed_m_s").alias("speed"), F.col("ball.accel_m_s2").alias("accel"), F.col("homography.detected_keypoints").alias("detected"),
        F.col("homography.confidence").alias("confidence"), F.col("homography.reprojection_error_px").alias("error"),
        F.coalesce("homography.reliable", F.lit(False)).alias("reliable"), F.coalesce("homography.carried_forward", F.lit(False)).alias("carried"),
        F.col("players.player_a").isNotNull().alias("has_a"), F.col("players.player_b").isNotNull().alias("has_b"))


def documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON array (or object) documents of one kind; missing files give no rows, broken ones are skipped."""
    schema = schemas.DOCUMENTS[kind]
    try:
        d = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return empty(spark, schema, "job_id STRING")
    return d.select("*", run_of().alias("job_id"))


def rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table of ``sinks.write_rows``."""
    return spark.read.schema(schema).option("basePath", path).json(path)


def stored_runs(spark: SparkSession, root: str, current: DataFrame | None = None, files: str = "*/analytics.json") -> DataFrame:
    """Analytics documents of all runs with points; the current run replaces its stored copy."""
    d = documents(spark, f"{root}/{files}", "analytics").filter("total_points > 0")
    return d if current is None else replace_run(d, current)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Label text files: five tokens per line, the file stem is the frame."""
    t = F.split(F.trim("value"), r"\s+")
    d = spark.read.text(path).select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("frame"), t.alias("t")).filter(F.size("t") == 5)
    num = lambda i: F.col("t")[i].try_cast("double")
    return d.select("frame", F.col("t")[0].try_cast("int").alias("class_id"), num(1).alias("cx"), num(2).alias("cy"), num(3).alias("w"), num(4).alias("h"))
