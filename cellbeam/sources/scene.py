"""Scene folders: settings, cameras, poses and index files as DataFrames, read through Spark."""

from __future__ import annotations

import configparser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_ini(spark: SparkSession, path: str, defaults: dict[str, dict[str, str]] | None = None, overrides: dict[str, dict[str, str]] | None = None) -> dict[str, dict[str, str]]:
    """Sections of a small settings file over ``defaults``, under ``overrides`` (such as the command line's).

    The file is never rewritten. Numbers and lists stay text; see ``numbers``.
    """
    text = spark.read.text(path, wholetext=True).first()
    parser = configparser.ConfigParser(interpolation=None, strict=False, comment_prefixes=("#", ";"))
    parser.optionxform = str
    for layer in (defaults or {}, None, overrides or {}):
        if layer is None:
            parser.read_string(text[0] if text else "")
        else:
            parser.read_dict(layer)
    return {s: dict(parser[s]) for s in parser.sections()}


def numbers(value: str) -> list[float]:
    return [float(x) for x in value.split()]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, value`` of a text file; ``line`` counts from 0 over all lines, blank ones included.

    Files of this kind have a line per frame; each is read whole, so numbers need no shuffle.
    """
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("line", "value"))
    return rows.select(F.col("line").cast("long"), "value")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Whole numbers, one per line; blank lines are skipped."""
    return read_lines(spark, path).where("trim(value) <> ''").select(F.trim("value").cast("int").alias("id"))


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """``image_id, qx, qy, qz, qw, tx, ty, tz`` from lines of seven numbers."""
    parts = F.split(F.trim("value"), r"\s+")
    names = ("qx", "qy", "qz", "qw", "tx", "ty", "tz")
    return read_lines(spark, path).where("trim(value) <> ''").select(F.col("line").alias("image_id"), *[parts[i].cast("double").alias(n) for i, n in enumerate(names)])


def read_angles(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path).where("trim(value) <> ''").select(F.col("line").alias("image_id"), F.trim("value").cast("double").alias("angle"))


def read_camera(spark: SparkSession, path: str, camera_id: int = 0) -> DataFrame:
    """One row: camera_id, fx, fy, cx, cy, s, w, h from a camera settings file."""
    c = read_ini(spark, path)["CameraBase"]
    w, h = int(c["w"]), int(c["h"])
    if w <= 0 or h <= 0:
        raise ValueError("a camera needs a size")
    return spark.createDataFrame([(camera_id, *numbers(c["K"])[:5], w, h)], "camera_id int, fx double, fy double, cx double, cy double, s double, w int, h int")


def frames(poses: DataFrame, images: DataFrame | None = None, masks: DataFrame | None = None, cameras: DataFrame | None = None) -> DataFrame:
    """Poses with the image, mask and camera of the same line; a missing list gives NULL names and camera 0."""
    out = poses
    for df, name in ((images, "image"), (masks, "mask"), (cameras, "camera_id")):
        if df is None:
            out = out.withColumn(name, F.lit(0) if name == "camera_id" else F.lit(None).cast("string"))
        else:
            out = out.join(df.select(F.col("line").alias("image_id"), F.col("value").alias(name)), "image_id", "left")
    return out.withColumn("camera_id", F.col("camera_id").cast("int"))


def circular_poses(spark: SparkSession, n: int, radius: float) -> DataFrame:
    """``image_id, angle, tx, ty, tz`` of a cone-beam scan on a circle: angle i / (n - 1) of a full turn."""
    angle = F.col("id") / (n - 1) * 2 * F.pi()
    return spark.range(n).select(F.col("id").alias("image_id"), angle.alias("angle"), (radius * F.cos(angle)).alias("tx"), (radius * F.sin(angle)).alias("ty"), F.lit(0.0).alias("tz"))
