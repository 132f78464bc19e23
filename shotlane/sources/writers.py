"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotlane import schemas
from shotlane.operators.store import bucket_count, upsert_run_sections
from shotlane.session import cut

__all__ = ["upsert_run_sections", "save_shots", "write_labels", "write_eval", "write_summary", "format_eval"]


def save_shots(df: DataFrame, path: str) -> None:
    """Replace shot records by (source, shot_number); other records stay.  The last of repeated records wins by timestamp.

    Records lie in hash buckets, and only touched buckets are read and rewritten, so the files are as many as the buckets, not the shots.
    """
    spark, keys = df.sparkSession, ["source", "shot_number"]
    buckets = bucket_count(spark, path, None)
    columns = schemas.columns(schemas.SHOT_RECORD)
    place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
    new = cut(df.select(*columns).withColumn("shot_number", F.col("shot_number").cast("int")).select("*", place), "shot-updates")
    touched = [r[0] for r in new.select("bucket").distinct().collect()]
    if not touched:
        return
    rows = new.withColumn("_new", F.lit(1))
    old = _stored_shots(spark, path).where(F.col("bucket").isin(touched))
    rows = rows.unionByName(old.withColumn("_new", F.lit(0)))
    rest = [c for c in columns if c not in keys]
    last = rows.groupBy("bucket", *keys).agg(F.max_by(F.struct(*rest), F.struct("_new", "timestamp", "id")).alias("_r")).select(*keys, "_r.*", "bucket")
    staged = cut(last.select(*columns, "bucket"), "shot-merge")
    staged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _stored_shots(spark, path: str) -> DataFrame:
    return spark.read.schema(f"{schemas.SHOT_RECORD}, bucket int").parquet(path)


def load_shots(spark, path: str) -> DataFrame:
    return _stored_shots(spark, path).drop("bucket")


def write_labels(df: DataFrame, path: str) -> None:
    """One label text per image under image=<stem>/; an empty text is an empty file.  df: image, label_text."""
    rows = df.select("image", F.regexp_replace(F.coalesce("label_text", F.lit("")), r"\n$", "").alias("value"))
    rows.repartition("image").write.mode("overwrite").partitionBy("image").text(path)


def _cell(c: Column, kind: T.DataType) -> Column:
    """Number text of the evaluation file: blank for nan and infinity, scientific when tiny or huge, else 6 decimals."""
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return c.cast("string")
    if not isinstance(kind, T.DoubleType):
        return c.cast("string")
    sci = F.format_string("%.2e", c)
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c), "0+$", ""), r"\.$", ".0")
    return (
        F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast("string"))
        .when(((F.abs(c) < 1e-10) & (c != 0.0)) | (F.abs(c) > 1e6), sci).otherwise(plain))


def format_eval(df: DataFrame) -> DataFrame:
    """Evaluation rows as text in the file's column order; missing columns are blank."""
    kinds = {f.name: f.dataType for f in df.schema}
    text = ("timestamp", "test_name", "interpolation_mode", "fraction")
    cols = []
    for c in schemas.EVAL_COLUMNS:
        if c not in kinds:
            cols.append(F.lit(None).cast("string").alias(c))
        elif c in text:
            cols.append(F.col(c).cast("string").alias(c))
        else:
            cols.append(_cell(F.col(c), kinds[c]).alias(c))
    return df.select(*cols)


def write_eval(df: DataFrame, path: str) -> None:
    format_eval(df).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Per-run summary records as JSON."""
    df.write.mode("overwrite").json(path)
