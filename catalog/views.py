"""Shot-analytics tables derived from the given tables, once in Spark and once in SQL.

Every sequence view holds one row per (shot, frame): the hour within the month
is the frame, and the first event of an hour is the detection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotlane.functions import geometry as G
from shotlane.operators.sequences import first_per_frame

BASE_US = 1704067200000000  # 2024-01-01
HOUR_US = 3600000000
DAY_US = 86400000000
HEIGHT, WIDTH = 160, 320

SQL = {
    "one": f"""one AS (
  SELECT user_id AS shot_id, event_id, us // {HOUR_US} AS frame_index, us, cents, event_type FROM (
    SELECT *, epoch_us(ts) - {BASE_US} AS us, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
  QUALIFY row_number() OVER (PARTITION BY user_id, us // {HOUR_US} ORDER BY us, event_id) = 1)""",
    "seq": """seq AS (
  SELECT shot_id, event_id, frame_index, us / 1.08e11 AS timestamp_s, cents,
    (cents % 10541) / 1e4 AS x_wide, 0.45e0 + (cents % 2000) / 1e4 AS x_roll,
    18.288e0 * CAST(sum(cents) OVER (PARTITION BY shot_id ORDER BY frame_index) AS DOUBLE)
      / CAST(sum(cents) OVER (PARTITION BY shot_id) AS DOUBLE) AS y_fwd
  FROM one)""",
    "traj": "traj AS (SELECT shot_id, frame_index, timestamp_s, x_wide AS x_m, y_fwd AS y_m, cents FROM seq)",
    "roll": "roll AS (SELECT shot_id, frame_index, timestamp_s, x_roll AS x_m, y_fwd AS y_m, cents FROM seq)",
    "wobble": "wobble AS (SELECT shot_id, frame_index, timestamp_s, x_roll AS x_m, y_fwd + ((cents % 100) - 50) / 1e2 AS y_m, cents FROM seq)",
    "det": f"""det AS (
  SELECT user_id AS shot_id, (epoch_us(ts) - {BASE_US}) // {DAY_US} AS frame_index, event_id AS det_id,
    CASE event_type WHEN 'click' THEN 'ball' WHEN 'view' THEN 'lane' ELSE 'pins' END AS class_name,
    (event_id * 37) % 200 AS x0, (event_id * 7) % 110 AS y0,
    (event_id * 37) % 200 + 49 + event_id % 70 AS x1, (event_id * 7) % 110 + 20 + event_id % 30 AS y1, value / 500e0 AS confidence
  FROM events)""",
    # narrower toward the top, like a lane seen from its foul line
    "runs": """runs AS (
  SELECT shot_id, frame_index, det_id, class_name, y, x0 + (y1 - y) // 2 AS x0, x1 - (y1 - y) // 3 AS x1
  FROM (SELECT *, unnest(generate_series(y0, y1)) AS y FROM det))""",
    "quads": """quads AS (
  SELECT shot_id, frame_index, det_id, CAST(x0 + (y1 - y0) // 2 AS DOUBLE) AS tlx, CAST(y0 AS DOUBLE) AS tly,
    CAST(x1 - (y1 - y0) // 3 AS DOUBLE) AS trx, CAST(y0 AS DOUBLE) AS try, CAST(x1 AS DOUBLE) AS brx, CAST(y1 AS DOUBLE) AS bry,
    CAST(x0 AS DOUBLE) AS blx, CAST(y1 AS DOUBLE) AS bly, x0, y0, x1, y1,
    (det_id % 97) / 97e0 AS score, (det_id % 89) / 89e0 AS geometry_score, (det_id % 83) / 83e0 AS support_score,
    CAST((x1 - x0 + 1) * (y1 - y0 + 1) AS DOUBLE) AS mask_area
  FROM det WHERE class_name = 'lane')""",
    "top4": """top4 AS (
  SELECT *, CASE WHEN n > 4 THEN ra ELSE rd END AS lane_no FROM (
    SELECT *, row_number() OVER (PARTITION BY shot_id, frame_index ORDER BY mask_area DESC, det_id) AS ra,
      row_number() OVER (PARTITION BY shot_id, frame_index ORDER BY det_id) AS rd,
      count(*) OVER (PARTITION BY shot_id, frame_index) AS n FROM quads)
  WHERE ra <= 4)""",
    "joints": """joints AS (
  SELECT vec_id // 100 AS shot_id, vec_id % 100 AS frame_index, 0 AS person_id, j AS joint_id,
    CAST(embedding[3 * j + 1] AS DOUBLE) AS x, CAST(embedding[3 * j + 2] AS DOUBLE) AS y, CAST(embedding[3 * j + 3] AS DOUBLE) AS z
  FROM (SELECT *, unnest(generate_series(0, 20)) AS j FROM embeddings))""",
    "updates": """updates AS (
  SELECT 'run ' || CAST(o_custkey AS VARCHAR) AS name, 'run_' || CAST(o_custkey AS VARCHAR) AS slug,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'aggregated' WHEN '2' THEN 'laneballs' WHEN '3' THEN 'fourdbody' ELSE 'other' END AS section,
    CAST(o_orderkey AS VARCHAR) AS payload, 'videos/' || CAST(o_orderkey AS VARCHAR) || '.mp4' AS video_key,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'sd' || CAST(o_orderkey AS VARCHAR) END AS sd_key, o_orderdate AS updated_at, o_totalprice
  FROM orders)""",
    "pairs": """pairs AS (
  SELECT shot_id AS episode_idx, frame_index, timestamp_s, x_m, y_m, y_m AS s_bev, x_m AS l_bev, 0.9e0 * y_m + (cents % 7) / 1e1 AS lane_s, 0.5e0 * x_m + (cents % 11) / 1e2 AS y
  FROM roll)""",
    "evalp": """evalp AS (
  SELECT CASE event_type WHEN 'click' THEN 'none' WHEN 'view' THEN 'linear' ELSE 'cubic' END AS interpolation_mode, user_id AS episode_idx,
    (event_id % 4 + 1) / 4e0 AS fraction, avg(value) AS m FROM events WHERE event_type <> 'error' GROUP BY 1, 2, 3)""",
    "evalt": "evalt AS (SELECT user_id AS episode_idx, (event_id % 4 + 1) / 4e0 AS fraction, avg(value) AS m FROM events WHERE event_type = 'error' GROUP BY 1, 2)",
    "history": """history AS (
  SELECT 12 * (year(o_orderdate) - 1990) + month(o_orderdate) AS epoch, avg(o_totalprice) / 1e5 AS train_box_loss, max(o_totalprice) / 1e5 AS val_box_loss,
    min(o_totalprice) / 1e5 AS train_cls_loss, avg(o_custkey) / 1e3 AS val_cls_loss,
    CAST(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS DOUBLE) / count(*) AS map50, CAST(count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS DOUBLE) / count(*) AS map50_95
  FROM orders GROUP BY 1)""",
    "files": """files AS (
  SELECT 'in/frame_' || CAST(event_id // 5 AS VARCHAR) || CASE event_type WHEN 'click' THEN '_rgb.png' WHEN 'view' THEN '_instance_segmentation.png'
    WHEN 'purchase' THEN '_semantic_segmentation.png' WHEN 'signup' THEN '_instance_segmentation_semantics_mapping.json' ELSE '_semantic_segmentation_labels.json' END AS path
  FROM events)""",
}
NEEDS = {
    "seq": ["one"], "traj": ["seq"], "roll": ["seq"], "wobble": ["seq"], "runs": ["det"], "quads": ["det"], "top4": ["quads"], "pairs": ["roll"],
}


def with_clause(names: str, body: str) -> str:
    """WITH clause of the named views and what they need; ``body`` is the answer query, with its own CTEs before a final SELECT."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in NEEDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    ctes = [SQL[n] for n in order]
    steps = [s.strip() for s in body.split(";;")]
    return "WITH RECURSIVE " + ",\n".join([*ctes, *steps[:-1], f"answer AS ({steps[-1]})"])


def _us(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) - F.lit(BASE_US)


class Tables:
    """The given tables and the derived views of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def one(self) -> DataFrame:
        e = self.table("events").select(
            F.col("user_id").alias("shot_id"), "event_id", _us().alias("us"), F.round(F.col("value") * 100).cast("long").alias("cents"), "event_type")
        e = e.withColumn("frame_index", F.expr(f"cast(us div {HOUR_US} as int)"))
        return first_per_frame(e, order=("us", "event_id"))

    def _seq(self) -> DataFrame:
        w = Window.partitionBy("shot_id")
        run, total = F.sum("cents").over(w.orderBy("frame_index")), F.sum("cents").over(w)
        return self.one().select(
            "shot_id", "event_id", "frame_index", (F.col("us") / F.lit(1.08e11)).alias("timestamp_s"), "cents",
            ((F.col("cents") % 10541) / 1e4).alias("x_wide"), (F.lit(0.45) + (F.col("cents") % 2000) / 1e4).alias("x_roll"),
            (F.lit(18.288) * run / total).alias("y_fwd"))

    def _pick(self, x: str, y: Column) -> DataFrame:
        return self._seq().select("shot_id", "frame_index", "timestamp_s", F.col(x).alias("x_m"), y.alias("y_m"), "cents")

    def traj(self) -> DataFrame:
        return self._pick("x_wide", F.col("y_fwd"))

    def roll(self) -> DataFrame:
        return self._pick("x_roll", F.col("y_fwd"))

    def wobble(self) -> DataFrame:
        return self._pick("x_roll", F.col("y_fwd") + ((F.col("cents") % 100) - 50) / 1e2)

    def det(self) -> DataFrame:
        e = self.table("events")
        i = F.col("event_id")
        num = lambda c: c.cast("int")
        return e.select(
            F.col("user_id").alias("shot_id"), F.floor(_us() / DAY_US).cast("int").alias("frame_index"), i.alias("det_id"),
            F.when(F.col("event_type") == "click", "ball").when(F.col("event_type") == "view", "lane").otherwise("pins").alias("class_name"),
            num((i * 37) % 200).alias("x0"), num((i * 7) % 110).alias("y0"), num((i * 37) % 200 + 49 + i % 70).alias("x1"),
            num((i * 7) % 110 + 20 + i % 30).alias("y1"), (F.col("value") / F.lit(500.0)).alias("confidence"))

    def runs(self, det: DataFrame | None = None, *more: str) -> DataFrame:
        """Mask rows of the detections; ``more`` names columns of ``det`` to keep."""
        d = (self.det() if det is None else det).withColumn("y", F.explode(F.sequence("y0", "y1")))
        return d.select(
            "shot_id", "frame_index", "det_id", "class_name", "y",
            F.expr("cast(x0 + (y1 - y) div 2 as int)").alias("x0"), F.expr("cast(x1 - (y1 - y) div 3 as int)").alias("x1"), *more)

    def quads(self) -> DataFrame:
        d = self.det().where("class_name = 'lane'")
        i = F.col("det_id")
        top_l, top_r = F.expr("x0 + (y1 - y0) div 2"), F.expr("x1 - (y1 - y0) div 3")
        poly = G.quad((top_l, F.col("y0")), (top_r, F.col("y0")), (F.col("x1"), F.col("y1")), (F.col("x0"), F.col("y1")))
        return d.select(
            "shot_id", "frame_index", "det_id", poly.alias("polygon"), "x0", "y0", "x1", "y1",
            ((i % 97) / 97.0).alias("score"), ((i % 89) / 89.0).alias("geometry_score"), ((i % 83) / 83.0).alias("support_score"),
            F.expr("cast((x1 - x0 + 1) * (y1 - y0 + 1) as double)").alias("mask_area"), F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"))

    def top4(self) -> DataFrame:
        from shotlane.operators.lanes import top_lane_masks

        return top_lane_masks(self.quads().withColumn("area", F.col("mask_area"))).drop("area")

    def joints(self) -> DataFrame:
        e = self.table("embeddings").withColumn("joint_id", F.explode(F.sequence(F.lit(0), F.lit(20))))
        at = lambda k: F.get("embedding", F.col("joint_id") * 3 + k).cast("double")
        return e.select(
            F.expr("cast(vec_id div 100 as int)").alias("shot_id"), (F.col("vec_id") % 100).cast("int").alias("frame_index"), F.lit(0).alias("person_id"),
            "joint_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))

    def updates(self) -> DataFrame:
        o = self.table("orders")
        p = F.substring("o_orderpriority", 1, 1)
        key = F.col("o_orderkey").cast("string")
        return o.select(
            F.concat(F.lit("run "), F.col("o_custkey").cast("string")).alias("name"),
            F.when(p == "1", "aggregated").when(p == "2", "laneballs").when(p == "3", "fourdbody").otherwise("other").alias("section"),
            key.alias("payload"), F.concat(F.lit("videos/"), key, F.lit(".mp4")).alias("video_key"),
            F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("sd"), key)).alias("sd_key"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), "o_totalprice")

    def pairs(self) -> DataFrame:
        return self.roll().select(
            F.col("shot_id").alias("episode_idx"), "frame_index", "timestamp_s", "x_m", "y_m", F.col("y_m").alias("s_bev"), F.col("x_m").alias("l_bev"),
            (F.lit(0.9) * F.col("y_m") + (F.col("cents") % 7) / 1e1).alias("lane_s"), (F.lit(0.5) * F.col("x_m") + (F.col("cents") % 11) / 1e2).alias("y"))

    def evalp(self) -> DataFrame:
        # the errors are the truth (evalt), all others the predictions
        e = self.table("events").where("event_type <> 'error'")
        mode = F.when(F.col("event_type") == "click", "none").when(F.col("event_type") == "view", "linear").otherwise("cubic")
        return e.groupBy(mode.alias("interpolation_mode"), F.col("user_id").alias("episode_idx"), ((F.col("event_id") % 4 + 1) / 4.0).alias("fraction")).agg(F.avg("value").alias("m"))

    def evalt(self) -> DataFrame:
        e = self.table("events").where("event_type = 'error'")
        return e.groupBy(F.col("user_id").alias("episode_idx"), ((F.col("event_id") % 4 + 1) / 4.0).alias("fraction")).agg(F.avg("value").alias("m"))

    def history(self) -> DataFrame:
        share = lambda s: (F.count(F.when(F.col("o_orderstatus") == s, 1)) / F.count(F.lit(1)))
        return self.table("orders").groupBy((12 * (F.year("o_orderdate") - 1990) + F.month("o_orderdate")).alias("epoch")).agg(
            (F.avg("o_totalprice") / 1e5).alias("train_box_loss"), (F.max("o_totalprice") / 1e5).alias("val_box_loss"),
            (F.min("o_totalprice") / 1e5).alias("train_cls_loss"), (F.avg("o_custkey") / 1e3).alias("val_cls_loss"),
            share("F").alias("map50"), share("O").alias("map50_95"))

    def files(self) -> DataFrame:
        t = F.col("event_type")
        tail = (
            F.when(t == "click", "_rgb.png").when(t == "view", "_instance_segmentation.png").when(t == "purchase", "_semantic_segmentation.png")
            .when(t == "signup", "_instance_segmentation_semantics_mapping.json").otherwise("_semantic_segmentation_labels.json"))
        return self.table("events").select(F.concat(F.lit("in/frame_"), F.expr("cast(event_id div 5 as string)"), tail).alias("path"))
