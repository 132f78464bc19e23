"""Readers with explicit schemas; filters are left to Spark so that they reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlane import schemas
from shotlane.functions.text import file_stem
from shotlane.operators import dataset
from shotlane.operators.frames import read_sensor as _parse_sensor


def read_shots(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Shot records, one JSON document per file."""
    df = spark.read.schema(schemas.SHOT_RECORD).option("multiLine", True).json(path)
    return df if source is None else df.where(F.col("source") == source)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Named runs, one JSON document per file; unreadable files are skipped.  A run without a name takes its file's."""
    df = spark.read.schema(schemas.RUN_RECORD).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    df = df.withColumn("_file", file_stem(F.input_file_name())).where("_corrupt_record is null").drop("_corrupt_record")
    return df.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), "_file")).withColumn("slug", F.coalesce("slug", "_file")).drop("_file")


def run_sections_of(runs: DataFrame) -> DataFrame:
    """Run documents to one row per (slug, section)."""
    ts = lambda c: F.try_to_timestamp(F.col(c)).alias(c)
    return runs.select(
        "slug", "name", "video_key", "sd_key", "id", ts("created_at"), ts("updated_at"), F.try_to_timestamp("updated_at").alias("section_at"),
        F.explode("sections").alias("section", "payload"))


def read_sensor(spark: SparkSession, path: str) -> DataFrame:
    """Sensor documents, one per file: file stem as key and the parsed struct."""
    text = spark.read.option("wholetext", True).text(path).withColumn("sd_key", file_stem(F.input_file_name()))
    return _parse_sensor(text, "value").select("sd_key", "sensor")


def read_ground_truth(spark: SparkSession, path: str, episode: int | None = None) -> DataFrame:
    df = spark.read.schema(schemas.GROUND_TRUTH).option("header", True).csv(path)
    return df if episode is None else df.where(F.col("episode_idx") == episode)


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """Label files as numbered lines per image.  A label file is one image's objects, read whole."""
    text = spark.read.option("wholetext", True).text(path).withColumn("image", file_stem(F.input_file_name()))
    return text.select("image", F.posexplode(F.split("value", "\n")).alias("line_no", "line")).where(F.trim("line") != "")


def read_labels(spark: SparkSession, path: str, keep: str = "all", min_coords: int = 0) -> DataFrame:
    return dataset.parse_labels(read_label_lines(spark, path), keep, min_coords)


def read_class_mapping(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.option("wholetext", True).text(path).withColumn("stem", dataset.pairing_stem(file_stem(F.input_file_name())))
    return dataset.parse_class_mapping(docs, "value")


def read_training_history(spark: SparkSession, path: str) -> DataFrame:
    """Training history; header names and cells carry blanks, and columns are taken by name."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    types = dict(part.split() for part in schemas.TRAINING_HISTORY.split(", "))
    return raw.select(*[
        F.trim(F.col(f"`{src}`")).cast(types[dst]).alias(dst) for src, dst in schemas.TRAINING_HISTORY_HEADER.items() if src in raw.columns])


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Sweep results, one JSON object per line: objective, run_dir and all other fields as text by name; bad lines are skipped."""
    rows = spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("_m")).where("_m is not null")
    other = F.map_filter("_m", lambda k, v: ~k.isin("objective", "run_dir"))
    return rows.select(F.col("_m")["objective"].try_cast("double").alias("objective"), F.col("_m")["run_dir"].alias("run_dir"), other.alias("fields"))
