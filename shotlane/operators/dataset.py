"""Label sets: file bundles, class resolution, splits and result tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlane.functions import geometry as G
from shotlane.functions.text import file_stem, norm_class
from shotlane.session import cut

# File-name tokens by kind, in the order they are tested and removed (fixed values of the file layout).
TOKENS = [
    ("instance_semantics", ["instance_segmentation_semantics_mapping"]),
    ("instance_mapping", ["instance_segmentation_mapping"]),
    ("semantic_labels", ["semantic_segmentation_labels"]),
    ("instance", ["instance_segmentation", "instance", "_inst", "_instance_seg"]),
    ("semantic", ["semantic_segmentation", "semantic", "_sem", "_semantic_seg"]),
    ("rgb", ["rgb", "_rgb"]),
]
# rgb wins over instance and semantic when a name carries several tokens
KIND_ORDER = ["instance_semantics", "instance_mapping", "semantic_labels", "rgb", "instance", "semantic"]
TARGET_CLASSES = ["lane", "ball"]
BACKGROUND = ["0,0,0,0", "0,0,0,255"]


def file_kind(name: Column) -> Column:
    tokens = dict(TOKENS)
    out = F.lit(None).cast("string")
    for kind in reversed(KIND_ORDER):
        out = F.when(F.lower(name).rlike("|".join(tokens[kind])), kind).otherwise(out)
    return out


def pairing_stem(name: Column) -> Column:
    for _, tokens in TOKENS:
        for t in tokens:
            name = F.regexp_replace(name, f"(?i){t}$", "")
            name = F.regexp_replace(name, f"(?i){t}(?=[._-])", "")
    return name


def classify_files(files: DataFrame, path: str = "path") -> DataFrame:
    base = file_stem(F.col(path))
    return files.withColumn("kind", file_kind(base)).withColumn("stem", pairing_stem(base)).where("kind is not null")


def bundle_frames(files: DataFrame, path: str = "path") -> DataFrame:
    """One row per stem that has an rgb, an instance and a semantic file; mapping files where present.

    Of several files of one kind the first path is taken.  Grouping by stem with
    one minimum per kind replaces the three-way join.
    """
    c = classify_files(files, path)
    pick = lambda k: F.min(F.when(F.col("kind") == k, F.col(path)))
    out = c.groupBy("stem").agg(
        pick("rgb").alias("rgb"), pick("instance").alias("instance"), pick("semantic").alias("semantic"),
        pick("instance_semantics").alias("instance_semantics"), pick("semantic_labels").alias("semantic_labels"))
    return out.where("rgb is not null and instance is not null and semantic is not null")


def common_stems(rgb: DataFrame, inst: DataFrame, sem: DataFrame) -> DataFrame:
    """Stems present in all three kinds: each is counted once, from one grouping with a flag per kind."""
    seen = reduce(DataFrame.unionByName, [df.select("stem", F.lit(1 << i).alias("_k")) for i, df in enumerate((rgb, inst, sem))])
    return seen.groupBy("stem").agg(F.bit_or("_k").alias("_k")).where("_k = 7").select("stem")


def parse_class_mapping(docs: DataFrame, text: str = "mapping_json", keys: Sequence[str] = ("stem",)) -> DataFrame:
    """Mapping documents to rows: key (an id, or "r,g,b,a" for a colour) and class name.

    A value is a name or an object with a class field.
    """
    m = docs.select(*keys, F.explode(F.from_json(text, "map<string,string>")).alias("_k", "_v"))
    key = F.regexp_replace(F.regexp_replace(F.col("_k"), r"^\(|\)$", ""), r"\s+", "")
    name = F.when(F.col("_v").startswith("{"), F.get_json_object("_v", "$.class")).otherwise(F.col("_v"))
    return m.select(*keys, key.alias("key"), name.alias("class_name"), F.col("_k").startswith("(").alias("is_colour"))


def majority_semantic(pixels: DataFrame, keys: Sequence[str] = ("stem", "colour"), count: str | None = None) -> DataFrame:
    """Most frequent semantic id per instance colour, ids 0 and 1 not voting; the smallest id wins ties."""
    n = F.sum(count) if count else F.count(F.lit(1))
    votes = pixels.where(~F.col("semantic_id").isin(0, 1)).groupBy(*keys, "semantic_id").agg(n.alias("_n"))
    return votes.groupBy(*keys).agg(
        F.max_by("semantic_id", F.struct(F.col("_n"), (-F.col("semantic_id")).alias("i"))).alias("semantic_id"))


def drop_background(colours: DataFrame, colour: str = "colour") -> DataFrame:
    bg = colours.sparkSession.createDataFrame([(c,) for c in BACKGROUND], f"{colour} string")
    return colours.join(F.broadcast(bg), colour, "left_anti")


def resolve_classes(objects: DataFrame, colour_map: DataFrame, votes: DataFrame, id_map: DataFrame) -> DataFrame:
    """Class per (stem, colour): its own mapping first, else the class of the voted semantic id.

    The mappings are per frame and grow with the data, so they are joined on their keys.
    """
    direct = colour_map.where("is_colour").select("stem", F.col("key").alias("colour"), F.col("class_name").alias("_direct"))
    named = votes.join(
        id_map.where("not is_colour").select("stem", F.col("key").try_cast("int").alias("semantic_id"), F.col("class_name").alias("_voted")),
        ["stem", "semantic_id"]).select("stem", "colour", "_voted")
    out = objects.join(direct, ["stem", "colour"], "left").join(named, ["stem", "colour"], "left")
    return out.withColumn("class_name", F.coalesce(F.nullif(F.col("_direct"), F.lit("")), F.nullif(F.col("_voted"), F.lit("")))).drop("_direct", "_voted")


def keep_classes(objs: DataFrame, classes: Sequence[str] = TARGET_CLASSES) -> DataFrame:
    """Only the target classes, with their label id (the position in the list)."""
    name = norm_class("class_name")
    ids = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class_name")).cast("int") - 1
    return objs.withColumn("class_name", name).where(F.col("class_name").isin(list(classes))).withColumn("class_id", ids)


def drop_small(objs: DataFrame, min_area: float = 10.0, min_points: int = 3, poly: str = "polygon") -> DataFrame:
    return objs.where((F.size(poly) >= min_points) & (G.poly_area(F.col(poly)) >= min_area))


def label_line(class_id: Column, poly: Column) -> Column:
    pts = F.transform(poly, lambda p: F.format_string("%.6f %.6f", p["x"], p["y"]))
    return F.concat_ws(" ", class_id.cast("string"), F.array_join(pts, " "))


def parse_labels(lines: DataFrame, keep: str = "all", min_coords: int = 0, keys: Sequence[str] = ("image",), text: str = "line", order: str = "line_no") -> DataFrame:
    """Label lines to objects: image, object_no, class_id, polygon, error.

    ``all`` skips lines of fewer than three tokens; ``last_per_class`` keeps the
    last line of each class.  A polygon of odd length or under min_coords
    numbers comes out null with an error text (null where the line was good).
    """
    tok = F.split(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""), r"\s+")
    rows = lines.select(*keys, F.col(order).alias("object_no"), tok.alias("_t")).where((F.get("_t", F.lit(0)) != "") & (F.size("_t") >= (3 if keep == "all" else 1)))
    n = F.size("_t") - 1
    bad = (n % 2 != 0) | (n < min_coords)
    rows = rows.withColumn("class_id", F.floor(F.get("_t", F.lit(0)).cast("double")).cast("int"))
    xy = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(n / 2) - 1, F.lit(0))), lambda i: G.point(
        F.get("_t", (2 * i + 1).cast("int")).cast("double"), F.get("_t", (2 * i + 2).cast("int")).cast("double")))
    rows = rows.withColumns({"polygon": F.when(~bad, xy), "error": F.when(bad, F.lit("expected polygon pairs"))}).drop("_t")
    if keep == "last_per_class":
        rows = rows.groupBy(*keys, "class_id").agg(F.max_by(F.struct("object_no", "polygon", "error"), "object_no").alias("_o")).select(*keys, "class_id", "_o.*")
    return rows.select(*keys, "object_no", "class_id", "polygon", "error")


def build_label_set(bundles: DataFrame, objects: DataFrame, colour_map: DataFrame, votes: DataFrame, id_map: DataFrame, classes: Sequence[str] = TARGET_CLASSES, min_area: float = 10.0, min_points: int = 3) -> DataFrame:
    """One row per bundle: stem, label_text (empty is valid), objects, error (null when it worked).

    objects: stem, colour "r,g,b,a", contour_no, polygon in pixels, width, height.
    """
    mine = objects.join(bundles.select("stem"), "stem", "left_semi")
    broken = F.when(F.col("polygon").isNull(), "missing polygon").when(~((F.col("width") > 0) & (F.col("height") > 0)), "invalid image size")
    checked = mine.withColumn("_err", broken)
    errors = checked.where("_err is not null").groupBy("stem").agg(F.min("_err").alias("error"))
    good = drop_small(drop_background(checked.where("_err is null").drop("_err")), min_area, min_points)
    good = keep_classes(resolve_classes(good, colour_map, votes, id_map), classes)
    rgba = F.transform(F.split("colour", ","), lambda v: v.cast("int"))
    line = label_line(F.col("class_id"), G.normalise_polygon(F.col("polygon"), "width", "height"))
    # a frame's objects are its instances: the list is one image's label file
    text = good.withColumn("_l", F.struct(rgba.alias("c"), F.col("contour_no"), line.alias("t"))).groupBy("stem").agg(
        F.concat(F.array_join(F.sort_array(F.collect_list("_l"))["t"], "\n"), F.lit("\n")).alias("label_text"), F.count(F.lit(1)).alias("objects"))
    out = bundles.select("stem").join(text, "stem", "left").join(errors, "stem", "left")
    ok = F.col("error").isNull()
    return out.select(
        "stem", F.when(ok, F.coalesce("label_text", F.lit(""))).alias("label_text"), F.when(ok, F.coalesce("objects", F.lit(0))).otherwise(0).cast("long").alias("objects"), "error")


# ---- splits and ranges -----------------------------------------------------

def split_dataset(items: DataFrame, train_frac: float, name: str = "name") -> DataFrame:
    """Adds split: the first int(n * train_frac) names in order are train, the rest val.

    Exact rank without a global window: names are range-sorted into a shared
    table once, counted per sorted piece, and offset by the counts before.
    """
    names = items.select(name).distinct()
    if not 0.0 < train_frac < 1.0:
        return items.withColumn("split", F.lit("train"))
    pieces = names.orderBy(name).withColumn("_m", F.monotonically_increasing_id())
    pieces = cut(pieces.select(name, F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("_o")), "sorted-names")
    # one row per piece of the sort: as many as there are shuffle partitions
    per = pieces.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(F.lit(0))
    per = per.withColumn("_before", F.sum("_n").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).withColumn("_all", F.sum("_n").over(whole))
    rank = F.coalesce("_before", F.lit(0)) + F.col("_o")
    marked = pieces.join(F.broadcast(per), "_p").withColumn("split", F.when(rank < F.floor(F.col("_all") * F.lit(train_frac)), "train").otherwise("val"))
    return items.join(marked.select(name, "split"), name)


def dataset_stats(items: DataFrame) -> DataFrame:
    return items.groupBy("split").agg(F.count(F.lit(1)).alias("images"))


def episode_ranges(truth: DataFrame, labels: DataFrame, frame: str = "global_frame_idx", label_frame: str = "frame_index", *, keys: Sequence[str]) -> DataFrame:
    """Frame range of each episode from the labelled frames: episode_idx, start_frame, end_frame (inclusive).

    As many contiguous label runs as episodes: they pair up in order.  Else each
    episode's own range, moved one frame back if only that frame is labelled,
    then shrunk to labelled frames.  ``keys`` names a dataset, whose frames number its labels.
    """
    k = list(keys)
    have = labels.select(*k, F.col(label_frame).alias("f")).distinct()
    ep = truth.groupBy(*k, "episode_idx").agg(F.min(frame).alias("lo"), F.max(frame).alias("hi"))
    if not k:
        raise ValueError("keys must name the dataset")
    part = lambda: Window.partitionBy(*k)
    # run ends are frames without a labelled neighbour: only they, not the frames, are ranked
    edge = lambda step: have.join(have.select(*k, (F.col("f") - step).alias("f")), [*k, "f"], "left_anti").withColumn("_i", F.row_number().over(part().orderBy("f")))
    starts = edge(-1).withColumn("_runs", F.count(F.lit(1)).over(part())).withColumnRenamed("f", "rs")
    runs = starts.join(edge(1).withColumnRenamed("f", "re"), [*k, "_i"])
    eps = ep.withColumn("_i", F.row_number().over(part().orderBy("episode_idx"))).withColumn("_eps", F.count(F.lit(1)).over(part()))
    paired = eps.join(runs, [*k, "_i"], "left").withColumn("_pair", F.coalesce(F.col("_eps") == F.col("_runs"), F.lit(False)))
    # labelled frames inside the range, and the one just before it; ranges meet frames by stretches of 256 frames
    piece = lambda c: F.floor(c / F.lit(256)).cast("int")
    inside = paired.where("not _pair").select(*k, "episode_idx", "lo", "hi").withColumn("_b", F.explode(F.sequence(piece(F.col("lo") - 1), piece(F.col("hi")))))
    near = inside.join(have.withColumn("_b", piece(F.col("f"))), [*k, "_b"], "left")
    hit = F.col("f").between(F.col("lo"), F.col("hi"))
    shrunk = near.groupBy(*k, "episode_idx", "lo", "hi").agg(
        F.min(F.when(hit, F.col("f"))).alias("_min"), F.max(F.when(hit, F.col("f"))).alias("_max"),
        F.max((F.col("f") == F.col("lo")).cast("int")).alias("_at"), F.max((F.col("f") == F.col("lo") - 1).cast("int")).alias("_prev"))
    back = (F.coalesce("_at", F.lit(0)) == 0) & (F.coalesce("_prev", F.lit(0)) == 1)
    start = F.when(back, F.col("lo") - 1).otherwise(F.coalesce(F.col("_min"), F.col("hi") + 1))
    end = F.coalesce(F.col("_max"), F.when(back, F.col("lo") - 1).otherwise(F.col("hi")))
    return paired.where("_pair").select(*k, "episode_idx", F.col("rs").alias("start_frame"), F.col("re").alias("end_frame")).unionByName(
        shrunk.select(*k, "episode_idx", start.alias("start_frame"), end.alias("end_frame")))


# ---- training and sweep results --------------------------------------------

_HISTORY_LAST = ("train_box_loss", "val_box_loss", "train_cls_loss", "val_cls_loss", "map50", "map50_95")


def training_summary(history: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Last value of each loss and score, and the best score with its epoch (the first best; epochs count from 1)."""
    best = lambda c: F.max_by("epoch", F.struct(F.col(c), (-F.col("epoch")).alias("e")))
    return history.groupBy(*keys).agg(
        *[F.max_by(c, "epoch").alias(f"final_{c}") for c in _HISTORY_LAST if c in history.columns],
        *[e for c in ("map50", "map50_95") if c in history.columns for e in (F.max(c).alias(f"best_{c}"), (best(c) + 1).alias(f"best_{c}_epoch"))])


def top_trials(trials: DataFrame, k: int, direction: str = "maximize", tie: str = "run_dir") -> DataFrame:
    key = F.desc("objective") if direction.lower() == "maximize" else F.asc("objective")
    return trials.where(F.col("objective").isNotNull()).orderBy(key, tie).limit(k)


def top_checkpoints(ckpts: DataFrame, k: int, direction: str = "maximize", keys: Sequence[str] = ()) -> DataFrame:
    """The k best checkpoints (per key); the earlier step wins ties, missing objectives never enter."""
    key = F.desc("objective") if direction.lower() == "maximize" else F.asc("objective")
    rows = ckpts.where(F.col("objective").isNotNull())
    if not keys:
        return rows.orderBy(key, "step").limit(k)
    w = Window.partitionBy(*keys).orderBy(key, "step")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
