"""Name, key and timestamp expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# class ids are scoped to a dataset; fixed values of the two class maps
REAL_CLASSES = {0: "ball", 1: "lane", 2: "pins"}
SYNTHETIC_CLASSES = {0: "lane", 1: "ball"}


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def norm_class(c: Column | str, first_token: bool = True) -> Column:
    """Class name as compared everywhere: first comma token, trimmed, lower case, sphere read as ball."""
    c = F.col(c) if isinstance(c, str) else c
    if not first_token:
        return F.lower(_strip(c))
    name = F.lower(_strip(F.get(F.split(c, ","), F.lit(0))))
    return F.when(name == "sphere", F.lit("ball")).otherwise(name)


def class_of_id(cls_id: Column, names: dict[int, str] | None = None) -> Column:
    """Class id to name; an empty or missing map means the real-video classes."""
    pairs = names or REAL_CLASSES
    out = F.lit(None).cast("string")
    for k, v in pairs.items():
        out = F.when(cls_id == F.lit(int(k)), norm_class(F.lit(v), first_token=False)).otherwise(out)
    return out


def slug(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    safe = F.regexp_replace(_strip(c), r"[^\p{L}\p{N}\-_.]", "_")
    trimmed = F.regexp_replace(safe, r"^[._]+|[._]+$", "")
    return F.when(trimmed == "", F.lit("run")).otherwise(trimmed)


def file_stem(c: Column) -> Column:
    name = F.regexp_extract(F.regexp_replace(c, r"(/+\.?)+$", ""), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def default_run_name(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    stem = file_stem(c)
    return slug(F.when(stem == "", c).otherwise(stem))


def parse_ticks(c: Column | str) -> Column:
    """ISO-8601 text, any number of fraction digits, cut (not rounded) to microseconds; bad text is null."""
    c = F.col(c) if isinstance(c, str) else c
    t = _strip(c)
    micros = F.regexp_replace(t, r"^([^.]*)\.(\d{1,6})\d*(.*)$", "$1.$2$3")
    iso = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d*)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$")
    return F.when(iso, F.try_to_timestamp(micros))
