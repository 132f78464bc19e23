"""Boxes, polygons, homographies and masks."""

from pyspark.sql import functions as F

from catalog.core import query
from catalog.views import HEIGHT, WIDTH
from shotlane.functions import geometry as G
from shotlane.operators import frames as fr
from shotlane.operators import lanes as ln
from shotlane.operators import masks as mk

KEY = "shot_id frame_index det_id"
QUAD8 = "tlx tly trx try brx bry blx bly"


def flat(poly: str = "polygon"):
    p = F.col(poly)
    return [G.corner(p, i)[k].alias(n) for (i, k), n in zip([(i, k) for i in range(4) for k in (0, 1)], QUAD8.split())]


_CONV = """SELECT det_id, x0, y0, x1 - x0 AS w, y1 - y0 AS h, (x0 + x1) * 0.5e0 AS cx, (y0 + y1) * 0.5e0 AS cy, (x1 - x0) * 1.25e0 AS sw, (y1 - y0) * 1.25e0 AS sh, x1, y1 FROM det"""


@query("normalise_boxes", "det_id || x0 y0 w h cx cy sw sh x1 y1", "det", _CONV)
def _(t):
    d = t.det().withColumn("box", F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]))
    d = d.withColumn("b1", G.convert_box(F.col("box"), "xyxy", "xywh"))
    d = d.withColumn("b2", G.convert_box(F.col("b1"), "xywh", "cs", 1.25)).withColumn("b3", G.convert_box(F.col("b2"), "cs", "xyxy", 1.25))
    back = fr.normalise_boxes(d.withColumn("box", F.col("b3")), "xyxy", "xyxy")
    return back.select("det_id", "box.x0", "box.y0", "b1.w", "b1.h", "b2.cx", "b2.cy", "b2.sw", "b2.sh", "box.x1", "box.y1")


@query("polygon_measures", f"{KEY} || area bottom_width top_centre_x centroid_x", "quads", """
    SELECT shot_id, frame_index, det_id, abs((tlx * try - trx * tly) + (trx * bry - brx * try) + (brx * bly - blx * bry) + (blx * tly - tlx * bly)) / 2 AS area,
      abs(brx - blx) AS bottom_width, 0.5e0 * (tlx + trx) AS top_centre_x, (tlx + trx + brx + blx) / 4 AS centroid_x FROM quads""")
def _(t):
    p = F.col("polygon")
    return t.quads().select(
        "shot_id", "frame_index", "det_id", G.poly_area(p).alias("area"), G.bottom_width(p).alias("bottom_width"), G.top_centre_x(p).alias("top_centre_x"), G.centroid_x(p).alias("centroid_x"))


@query("order_quad", f"det_id || {QUAD8} s_tlx s_trx s_brx s_blx", "quads", """
    SELECT det_id, tlx, tly, trx, try, brx, bry, blx, bly, tlx AS s_tlx, CASE WHEN try - trx <= bry - brx THEN trx ELSE brx END AS s_trx, brx AS s_brx, blx AS s_blx FROM quads""")
def _(t):
    mixed = t.quads().withColumn("mixed", F.array(*[F.get("polygon", F.lit(i)) for i in (2, 0, 3, 1)]))
    q = mixed.withColumn("polygon", G.order_quad(F.col("mixed"))).withColumn("s", G.order_quad(F.col("mixed"), "sums"))
    return q.select("det_id", *flat(), *[G.corner(F.col("s"), i)[0].alias(f"s_{n}") for i, n in enumerate(("tlx", "trx", "brx", "blx"))])


_VP = f"""q AS (SELECT *, blx - tlx AS ldx, bly - tly AS ldy, brx - trx AS rdx, bry - try AS rdy FROM quads);;
    p AS (SELECT *, ldx * rdy - rdx * ldy AS det FROM q);;
    r AS (SELECT *, CASE WHEN abs(det) < 1e-6 THEN NULL ELSE ((trx - tlx) * rdy - (try - tly) * rdx) / det END AS tt FROM p);;
    v AS (SELECT *, CASE WHEN tt IS NULL THEN 1 WHEN tly + tt * ldy > tly OR tlx + tt * ldx < -{WIDTH} OR tlx + tt * ldx > 2 * {WIDTH} THEN 0 ELSE 1 END AS vp FROM r);;
    g AS (SELECT *, abs(trx - tlx) AS wt, abs(brx - blx) AS wb, (greatest(bry, bly) - least(tly, try)) / {HEIGHT}e0 AS sp FROM v);;
    g2 AS (SELECT *, wt / greatest(wb, 1) AS ratio FROM g);;
    gs AS (SELECT *, CASE WHEN wt <= 0 OR wb <= 0 THEN 0 ELSE least(greatest(0.35e0 * CASE WHEN ratio >= 0.98e0 THEN 0 ELSE 1 - least(abs(ratio - 0.45e0) / 0.45e0, 1) END
      + 0.25e0 * least(wb / greatest(0.06e0 * {WIDTH}, 1), 1) + 0.2e0 * least(sp / 0.16e0, 1)
      + 0.1e0 * greatest(0, 1 - 1.8e0 * abs(0.5e0 * (tlx + trx) - 0.5e0 * (blx + brx)) / greatest(wb, 1)) + 0.1e0 * vp, 0), 1) END AS geom,
      CASE WHEN wt <= 0 OR wb <= 0 THEN 999 ELSE ratio END AS width_ratio, CASE WHEN wt <= 0 OR wb <= 0 THEN 0 ELSE sp END AS y_span_ratio FROM g2);;
    """


@query("valid_vanishing_point", "det_id valid", "quads", _VP + "SELECT det_id, vp AS valid FROM v")
def _(t):
    return t.quads().withColumn("valid", G.valid_vanishing_point(F.col("polygon"), "height", "width").cast("int"))


@query("geometry_scores", "det_id || geometry_score width_ratio bottom_width y_span_ratio", "quads", _VP + "SELECT det_id, geom AS geometry_score, width_ratio, wb AS bottom_width, y_span_ratio FROM gs")
def _(t):
    return t.quads().select("det_id", G.geometry_scores(F.col("polygon"), "height", "width").alias("g")).select("det_id", "g.*")


@query("correct_top_corners", f"det_id || {QUAD8}", "quads", """
    k AS (SELECT det_id, tlx + det_id % 5 - 2 AS tlx, tly, trx - det_id % 3 AS trx, try + det_id % 4 AS try, brx, bry, blx, bly FROM quads);;
    m AS (SELECT *, (blx * tly - bly * tlx) AS lw, (brx * try - bry * trx) AS rw, (blx - tlx) * (bry - try) - (bly - tly) * (brx - trx) AS d FROM k);;
    v AS (SELECT *, CASE WHEN abs(d) >= 1e-10 THEN (lw * (brx - trx) - (blx - tlx) * rw) / d END AS vx, CASE WHEN abs(d) >= 1e-10 THEN (lw * (bry - try) - (bly - tly) * rw) / d END AS vy FROM m);;
    l AS (SELECT *, (vx - blx) * (vx - blx) + (vy - bly) * (vy - bly) AS aq, (vx - brx) * (vx - brx) + (vy - bry) * (vy - bry) AS bq FROM v);;
    c AS (SELECT *, ((tlx - blx) * (vx - blx) + (tly - bly) * (vy - bly)) / nullif(aq, 0) AS la, ((trx - brx) * (vx - brx) + (try - bry) * (vy - bry)) / nullif(bq, 0) AS lb FROM l);;
    f AS (SELECT *, coalesce(NOT (vy > least(tly, try) OR aq < 1 OR bq < 1 OR la <= 0 OR la >= 1 OR lb <= 0 OR lb >= 1), FALSE) AS mv FROM c);;
    SELECT det_id, CASE WHEN mv THEN blx + la * (vx - blx) ELSE tlx END AS tlx, CASE WHEN mv THEN bly + la * (vy - bly) ELSE tly END AS tly,
      CASE WHEN mv THEN brx + lb * (vx - brx) ELSE trx END AS trx, CASE WHEN mv THEN bry + lb * (vy - bry) ELSE try END AS try, brx, bry, blx, bly FROM f""")
def _(t):
    (tlx, tly), (trx, try_), br, bl = (G.corner(F.col("polygon"), i) for i in range(4))
    i = F.col("det_id")
    q = t.quads().withColumn("polygon", G.quad((tlx + i % 5 - 2, tly), (trx - i % 3, try_ + i % 4), br, bl))
    return q.withColumn("polygon", G.correct_top_corners(F.col("polygon"))).select("det_id", *flat())


@query("point_in_polygon", "a_id b_id", "quads", """
    p AS (SELECT a.det_id AS a_id, b.det_id AS b_id, a.blx + 20 AS px, a.tly + 10 AS py, b.* FROM quads a JOIN quads b ON a.shot_id = b.shot_id AND a.frame_index = b.frame_index);;
    SELECT a_id, b_id FROM p WHERE py BETWEEN tly AND bly AND px >= tlx + (py - tly) * (blx - tlx) / (bly - tly) AND px <= trx + (py - try) * (brx - trx) / (bry - try)""")
def _(t):
    q = t.quads()
    a = q.select("shot_id", "frame_index", F.col("det_id").alias("a_id"), (F.col("x0") + 20.0).alias("px"), (F.col("y0") + 10.0).alias("py"))
    return a.join(q.select("shot_id", "frame_index", F.col("det_id").alias("b_id"), "polygon"), ["shot_id", "frame_index"]).where(
        G.point_in_polygon(F.col("px"), F.col("py"), F.col("polygon")))


@query("homography_project", "det_id || x_m far_x far_y near_x near_y", "quads", """
    k AS (SELECT *, blx + 30 AS px, (tly + bly) / 2 AS py FROM quads);;
    s AS (SELECT *, tlx + (blx - tlx) * (py - tly) / (bly - tly) AS lx, trx + (brx - trx) * (py - try) / (bry - try) AS rx FROM k);;
    SELECT det_id, 1.0541e0 * (px - lx) / (rx - lx) AS x_m, 1.0541e0 AS far_x, 18.288e0 AS far_y, 1.0541e0 AS near_x, 0e0 AS near_y FROM s""")
def _(t):
    q = t.quads().withColumn("h", G.homography(F.col("polygon")))
    (tlx, tly), (trx, try_), (brx, bry), (blx, bly) = (G.corner(F.col("polygon"), i) for i in range(4))
    q = q.withColumn("p", G.project(blx + 30, (tly + bly) / 2, F.col("h"))).withColumn("f", G.project(trx, try_, F.col("h"))).withColumn("n", G.project(brx, bry, F.col("h")))
    return q.select("det_id", F.col("p.x").alias("x_m"), F.col("f.x").alias("far_x"), F.col("f.y").alias("far_y"), F.col("n.x").alias("near_x"), F.col("n.y").alias("near_y"))


@query("unproject", "det_id || px py", "quads", "SELECT det_id, least(greatest(blx + 30, 0), 199) AS px, (tly + bly) / 2 AS py FROM quads")
def _(t):
    q = t.quads().withColumn("h", G.homography(F.col("polygon")))
    p = G.project(F.col("x0") + F.lit(30.0), (F.col("y0") + F.col("y1")) / 2.0, F.col("h"))
    q = q.withColumn("p", p).withColumn("b", G.unproject(F.col("p.x"), F.col("p.y"), F.col("h"), F.lit(200), F.lit(200)))
    return q.select("det_id", F.col("b.x").alias("px"), F.col("b.y").alias("py"))


@query("matrix_health", "det_id is_reflection is_degenerate || determinant", "", """
    m AS (SELECT event_id AS det_id, CAST(event_id % 7 + 1 AS DOUBLE) AS a, CAST(event_id % 5 AS DOUBLE) AS b, CAST(event_id % 11 AS DOUBLE) - 5 AS e FROM events);;
    SELECT det_id, a * e - b * 2 AS determinant, CASE WHEN a * e - b * 2 < 0 THEN 1 ELSE 0 END AS is_reflection, CASE WHEN a * e - b * 2 = 0 THEN 1 ELSE 0 END AS is_degenerate FROM m""")
def _(t):
    i = F.col("event_id")
    d = lambda c: c.cast("double")
    z, o = F.lit(0.0), F.lit(1.0)
    m = t.table("events").select(i.alias("det_id"), F.array(d(i % 7 + 1), d(i % 5), z, F.lit(2.0), d(i % 11) - 5, z, z, z, o).alias("homography"))
    h = ln.matrix_health(m)
    return h.withColumn("is_reflection", F.col("is_reflection").cast("int")).withColumn("is_degenerate", F.col("is_degenerate").cast("int"))


_FIT = """
    n AS (SELECT KEY AS shot_id, count(*) AS points, count(CASE WHEN event_id % 9 <> 4 THEN 1 END) AS inliers FROM events GROUP BY 1);;
    SELECT shot_id, inliers, points, 1 AS usable, (2 * 100e0 + 0.5e0 * 50e0 + 3) / (1 + 100e0 * 1e-3 + 50e0 * 2e-3) AS x_m, (0.1e0 * 100e0 + 3 * 50e0 + 7) / (1 + 100e0 * 1e-3 + 50e0 * 2e-3) AS y_m FROM n"""


def _fitted(t, key):
    x, y = (F.col("event_id") * 13 % 301).cast("double"), (F.col("event_id") * 7 % 199).cast("double")
    den = 1 + x * 1e-3 + y * 2e-3
    far = F.when(F.col("event_id") % 9 == 4, 900.0).otherwise(0.0)
    pts = t.table("events").select(
        key.alias("shot_id"), F.col("event_id").alias("point_id"), x.alias("x"), y.alias("y"), ((2 * x + 0.5 * y + 3) / den + far).alias("u"), ((0.1 * x + 3 * y + 7) / den).alias("v"))
    f = ln.fit_homography(pts).withColumn("p", G.project(F.lit(100.0), F.lit(50.0), F.col("homography")))
    return f.select("shot_id", "inliers", "points", F.col("reason").isNull().cast("int").alias("usable"), F.col("p.x").alias("x_m"), F.col("p.y").alias("y_m"))


@query("fit_homography", "shot_id inliers points usable || x_m y_m", "", _FIT.replace("KEY", "user_id"))
def _(t):
    return _fitted(t, F.col("user_id"))


@query("fit_homography_hot", "shot_id inliers points usable || x_m y_m", "", _FIT.replace("KEY", "CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END"))
def _(t):
    """One shot holds a third of all points."""
    return _fitted(t, F.when(F.col("event_id") % 3 == 0, -1).otherwise(F.col("user_id")))


@query("normalise_polygon", f"det_id || {QUAD8} px py", "quads", f"""
    SELECT det_id, tlx / {WIDTH} AS tlx, tly / {HEIGHT} AS tly, trx / {WIDTH} AS trx, try / {HEIGHT} AS try, brx / {WIDTH} AS brx, bry / {HEIGHT} AS bry, blx / {WIDTH} AS blx, bly / {HEIGHT} AS bly,
      round_even(tlx / {WIDTH} * 639, 0) AS px, round_even(tly / {HEIGHT} * 479, 0) AS py FROM quads""")
def _(t):
    q = t.quads().withColumn("polygon", G.normalise_polygon(F.col("polygon"), "width", "height"))
    q = q.withColumn("d", G.denormalise_polygon(F.col("polygon"), F.lit(640), F.lit(480)))
    return q.select("det_id", *flat(), F.get("d", F.lit(0))["x"].alias("px"), F.get("d", F.lit(0))["y"].alias("py"))


# ---- masks -----------------------------------------------------------------

@query("mask_area", f"{KEY} area", "runs", "SELECT shot_id, frame_index, det_id, sum(x1 - x0 + 1) AS area FROM runs GROUP BY ALL")
def _(t):
    return mk.mask_area(t.runs())


@query("mask_boxes", f"{KEY} x0 y0 x1 y1", "det", "SELECT shot_id, frame_index, det_id, x0, y0, x1, y1 FROM det")
def _(t):
    return mk.mask_boxes(t.runs())


@query("mask_contact", f"{KEY} area || contact_x contact_y", "runs", """
    SELECT shot_id, frame_index, det_id, sum(x1 - x0 + 1) AS area, (min(x0) + max(x1)) / 2e0 AS contact_x, max(y) AS contact_y FROM runs GROUP BY ALL""")
def _(t):
    return mk.mask_contact(t.runs())


@query("mask_centroid", f"{KEY} || cx cy", "runs", """
    px AS (SELECT shot_id, frame_index, det_id, y, unnest(generate_series(x0, x1)) AS x FROM runs);;
    SELECT shot_id, frame_index, det_id, avg(x) AS cx, avg(y) AS cy FROM px GROUP BY ALL""")
def _(t):
    return mk.mask_centroid(t.runs())


@query("union_masks", "shot_id frame_index y x0 x1 | class_name", "runs", """
    px AS (SELECT DISTINCT shot_id, frame_index, class_name, y, unnest(generate_series(x0, x1)) AS x FROM runs);;
    g AS (SELECT *, x - row_number() OVER (PARTITION BY shot_id, frame_index, class_name, y ORDER BY x) AS g FROM px);;
    SELECT shot_id, frame_index, class_name, y, min(x) AS x0, max(x) AS x1 FROM g GROUP BY shot_id, frame_index, class_name, y, g""")
def _(t):
    return mk.union_masks(t.runs())


def _truth_runs(t):
    i = F.col("det_id")
    dx, dy = (i % 9 - 4).cast("int"), (i % 5 - 2).cast("int")
    return t.runs().withColumn("x0", F.col("x0") + dx).withColumn("x1", F.col("x1") + dx).withColumn("y", F.col("y") + dy)


_IOU = """pp AS (SELECT DISTINCT shot_id, frame_index, class_name, y, unnest(generate_series(x0, x1)) AS x FROM runs);;
    tp AS (SELECT DISTINCT shot_id, frame_index, class_name, y + det_id % 5 - 2 AS y, unnest(generate_series(x0 + det_id % 9 - 4, x1 + det_id % 9 - 4)) AS x FROM runs);;
    u AS (SELECT shot_id, frame_index, class_name, count(*) AS union_area, count(CASE WHEN n = 2 THEN 1 END) AS intersection FROM (
      SELECT shot_id, frame_index, class_name, y, x, count(*) AS n FROM (SELECT * FROM pp UNION ALL SELECT * FROM tp) GROUP BY ALL) GROUP BY ALL);;
    """


@query("mask_iou", "shot_id frame_index intersection union_area | class_name | iou", "runs", _IOU + "SELECT *, intersection / union_area AS iou FROM u")
def _(t):
    return mk.mask_iou(t.runs(), _truth_runs(t))


def _frame_map(t):
    """Both sides are cut to the classes that count before their masks meet."""
    sides = [r.where(F.col("class_name").isin("lane", "ball")) for r in (t.runs(), _truth_runs(t))]
    return mk.map_50_95(mk.mask_iou(*sides), t.det())


_MAP = _IOU + """m AS (SELECT shot_id, frame_index, sum(len(list_filter(generate_series(0, 9), lambda k: intersection / union_area >= 0.5e0 + k * ((0.5e0 + 0.05e0) - 0.5e0)))) / 20e0 AS map_50_95 FROM u WHERE class_name IN ('lane', 'ball') GROUP BY ALL);;
    f AS (SELECT DISTINCT shot_id, frame_index FROM det);; fm AS (SELECT shot_id, frame_index, coalesce(map_50_95, 0e0) AS map_50_95 FROM f LEFT JOIN m USING (shot_id, frame_index));; """


@query("map_50_95", "shot_id frame_index || map_50_95", "runs", _MAP + "SELECT * FROM fm")
def _(t):
    return _frame_map(t)


@query("episode_map", "shot_id frames || map_50_95", "runs", _MAP + "SELECT shot_id, avg(map_50_95) AS map_50_95, count(*) AS frames FROM fm GROUP BY 1")
def _(t):
    return mk.episode_map(_frame_map(t))


@query("coverage_ratio", "shot_id frame_index lane_area || coverage", "runs", f"""
    f AS (SELECT DISTINCT shot_id, frame_index FROM det);; a AS (SELECT shot_id, frame_index, sum(x1 - x0 + 1) AS area FROM runs WHERE class_name = 'lane' GROUP BY ALL);;
    SELECT shot_id, frame_index, coalesce(area, 0) AS lane_area, least(coalesce(area, 0) / ({HEIGHT} * {WIDTH / 8}), 1) AS coverage FROM f LEFT JOIN a USING (shot_id, frame_index)""")
def _(t):
    frames = t.det().select("shot_id", "frame_index").distinct().withColumn("height", F.lit(HEIGHT)).withColumn("width", F.lit(WIDTH // 8))
    return mk.coverage_ratio(frames, t.runs().where("class_name = 'lane'"))


@query("mean_coverage", "shot_id || mean_lane_coverage_ratio", "runs", f"""
    f AS (SELECT DISTINCT shot_id, frame_index FROM det);; a AS (SELECT shot_id, frame_index, sum(x1 - x0 + 1) AS area FROM runs WHERE class_name = 'lane' GROUP BY ALL);;
    SELECT shot_id, avg(least(coalesce(area, 0) / {HEIGHT * WIDTH}e0, 1)) AS mean_lane_coverage_ratio FROM f LEFT JOIN a USING (shot_id, frame_index) GROUP BY 1""")
def _(t):
    frames = t.det().select("shot_id", "frame_index").distinct().withColumn("height", F.lit(HEIGHT)).withColumn("width", F.lit(WIDTH))
    return mk.mean_coverage(mk.coverage_ratio(frames, t.runs().where("class_name = 'lane'")))


_SPAN = "CAST(ceil(tlx + (blx - tlx) * (y - tly) / (bly - tly) - 1e-9) AS BIGINT) AS x0, CAST(floor(trx + (brx - trx) * (y - try) / (bry - try) + 1e-9) AS BIGINT) AS x1"
_POLY = f"pr AS (SELECT shot_id, frame_index, det_id, y, {_SPAN} FROM (SELECT *, unnest(generate_series(CAST(tly AS BIGINT), CAST(bly AS BIGINT))) AS y FROM quads));; "


@query("polygon_runs", f"{KEY} y x0 x1", "quads", _POLY + "SELECT * FROM pr WHERE x0 <= x1")
def _(t):
    return mk.polygon_runs(t.quads(), height="height", width="width")


# a lane mask shifted against its quad, with a bite taken out
_BITE = """lr AS (SELECT shot_id, frame_index, det_id, y + det_id % 7 - 3 AS y, x0 + det_id % 11 - 5 AS x0, x0 + det_id % 11 + 9 AS x1 FROM runs WHERE class_name = 'lane'
      UNION ALL SELECT shot_id, frame_index, det_id, y + det_id % 7 - 3, x0 + det_id % 11 + 13, x1 + det_id % 11 - 5 FROM runs WHERE class_name = 'lane' AND x0 + 18 <= x1);; """


def _bite(t):
    i = F.col("det_id")
    sx, sy = (i % 11 - 5).cast("int"), (i % 7 - 3).cast("int")
    r = t.runs().where("class_name = 'lane'").select("shot_id", "frame_index", "det_id", (F.col("y") + sy).cast("int").alias("y"), (F.col("x0") + sx).alias("a"), (F.col("x1") + sx).alias("b"))
    left = r.select("shot_id", "frame_index", "det_id", "y", F.col("a").alias("x0"), (F.col("a") + 14).alias("x1"))
    right = r.where("a + 18 <= b").select("shot_id", "frame_index", "det_id", "y", (F.col("a") + 18).alias("x0"), F.col("b").alias("x1"))
    return left.unionByName(right)


_EVAL = _BITE + _POLY + _VP + f"""
    lx AS (SELECT det_id, y, unnest(generate_series(x0, x1)) AS x FROM lr);;
    px AS (SELECT det_id, y, unnest(generate_series(greatest(x0, 0), least(x1, {WIDTH - 1}))) AS x FROM pr WHERE y BETWEEN 0 AND {HEIGHT - 1});;
    al AS (SELECT det_id, count(*) AS la FROM lx GROUP BY 1);; ap AS (SELECT det_id, count(*) AS pa FROM px GROUP BY 1);; ai AS (SELECT det_id, count(*) AS ia FROM px JOIN lx USING (det_id, y, x) GROUP BY 1);;
    rw AS (SELECT px.det_id, px.y, count(*) AS pw, count(lx.x) AS ow FROM px LEFT JOIN lx USING (det_id, y, x) GROUP BY ALL);;
    bd AS (SELECT det_id, k, floor(greatest(floor(least(tly, try)), 0)) AS y0, floor(least(ceil(greatest(bry, bly)), {HEIGHT - 1})) AS yb FROM (SELECT *, unnest(generate_series(0, 13)) AS k FROM quads));;
    be AS (SELECT det_id, k, greatest(floor(k * ((yb - y0) / 14) + y0), 0) AS a, least(ceil(CASE WHEN k = 13 THEN yb ELSE (k + 1) * ((yb - y0) / 14) + y0 END), {HEIGHT}) AS b FROM bd WHERE yb > y0);;
    bf AS (SELECT be.det_id, k, sum(pw) AS pw, sum(ow) AS ow FROM be JOIN rw ON rw.det_id = be.det_id AND rw.y >= a AND rw.y < b GROUP BY ALL);;
    su AS (SELECT det_id, least(greatest(0.65e0 * avg(least(ow / pw / 0.55e0, 1)) + 0.35e0 * count(CASE WHEN least(ow / pw / 0.55e0, 1) > 0.2e0 THEN 1 END) / count(*), 0), 1) AS support FROM bf WHERE pw > 0 GROUP BY 1);;
    sc AS (SELECT gs.det_id, coalesce(ia, 0) / la AS coverage, coalesce(ia, 0) / pa AS purity, coalesce(support, 0) AS support_score, geom AS geometry_score, width_ratio, y_span_ratio, la FROM gs JOIN al USING (det_id) JOIN ap USING (det_id) LEFT JOIN ai USING (det_id) LEFT JOIN su USING (det_id));;
    """


@query("evaluate_trapezoid", "det_id || coverage purity support_score score mask_area", "quads runs", _EVAL + """
    SELECT det_id, coverage, purity, support_score, 0.55e0 * (0.65e0 * coverage + (1e0 - 0.65e0) * purity) + 0.25e0 * geometry_score + 0.2e0 * support_score AS score, la AS mask_area FROM sc""")
def _(t):
    return mk.evaluate_trapezoid(_bite(t), t.quads().select("shot_id", "frame_index", "det_id", "polygon", "height", "width"))


_SCAN = _BITE + """sp AS (SELECT det_id, min(y) AS a, max(y) AS b FROM lr GROUP BY 1 HAVING max(y) - min(y) >= 20);;
    tr AS (SELECT DISTINCT det_id, CAST(CASE WHEN k = 89 THEN b ELSE floor(k * ((b - a) / 89e0) + a) END AS BIGINT) AS y FROM (SELECT *, unnest(generate_series(0, 89)) AS k FROM sp));;
    mp AS (SELECT det_id, y AS ry, unnest(generate_series(x0, x1)) AS x FROM lr);;
    sl0 AS (SELECT tr.det_id, tr.y, count(*) AS n, quantile_cont(x, 0.01) AS left_x, quantile_cont(x, 0.99) AS right_x FROM tr JOIN mp ON mp.det_id = tr.det_id AND abs(mp.ry - tr.y) <= 1 GROUP BY ALL);;
    sl AS (SELECT det_id, y, left_x, right_x, right_x - left_x AS width FROM sl0 WHERE n >= 12 AND right_x - left_x >= 10);; """


@query("scanline_boundaries", "det_id y || left_x right_x width", "runs", _SCAN + "SELECT * FROM sl")
def _(t):
    return mk.scanline_boundaries(_bite(t))


@query("boundary_near", "det_id y || left_x right_x", "runs det", _BITE + """
    mp AS (SELECT det_id, y AS ry, unnest(generate_series(x0, x1)) AS x FROM lr);; tg AS (SELECT det_id, CAST(round_even(y0 + 2.5e0, 0) AS BIGINT) AS y FROM det WHERE class_name = 'lane');;
    SELECT tg.det_id, tg.y, quantile_cont(x, 0.005) AS left_x, quantile_cont(x, 0.995) AS right_x FROM tg JOIN mp ON mp.det_id = tg.det_id AND abs(mp.ry - tg.y) <= 4 GROUP BY ALL HAVING count(*) >= 8""")
def _(t):
    tg = t.det().where("class_name = 'lane'").select("shot_id", "frame_index", "det_id", (F.col("y0") + F.lit(2.5)).alias("target_y"))
    return mk.boundary_near(_bite(t), tg)


def _robust(src: str, out: str, keys: str) -> str:
    steps = [f"rb0 AS (SELECT *, TRUE AS keep, TRUE AS ok FROM {src});;"]
    for i in range(4):
        p = f"rb{i}"
        steps.append(f"""ra{i} AS (SELECT *, count(CASE WHEN keep THEN 1 END) OVER (PARTITION BY {keys}) AS nk, regr_slope(CASE WHEN keep THEN x END, CASE WHEN keep THEN y END) OVER (PARTITION BY {keys}) AS sl,
          avg(CASE WHEN keep THEN x END) OVER (PARTITION BY {keys}) AS mx, avg(CASE WHEN keep THEN y END) OVER (PARTITION BY {keys}) AS my FROM {p});;
        rc{i} AS (SELECT *, abs(x - (sl * y + (mx - sl * my))) AS r FROM ra{i});;
        rd{i} AS (SELECT *, quantile_cont(CASE WHEN keep THEN r END, 0.5) OVER (PARTITION BY {keys}) AS med FROM rc{i});;
        re{i} AS (SELECT *, quantile_cont(CASE WHEN keep THEN abs(r - med) END, 0.5) OVER (PARTITION BY {keys}) AS mad FROM rd{i});;
        rb{i + 1} AS (SELECT {keys}, x, y, ok AND nk >= 8 AS ok, coalesce(r <= greatest(8, med + 3 * 1.4826e0 * greatest(mad, 1)), FALSE) AS keep, sl AS slope, mx - sl * my AS intercept FROM re{i});;""")
    return "\n".join(steps) + f"{out} AS (SELECT {keys}, any_value(slope) AS slope, any_value(intercept) AS intercept, count(CASE WHEN keep THEN 1 END) / count(*) AS inlier_ratio FROM rb4 WHERE ok GROUP BY ALL);; "


@query("robust_line", "shot_id || slope intercept inlier_ratio", "wobble", """
    src AS (SELECT shot_id, y_m * 20 + (cents % 17) AS x, y_m AS y FROM wobble);; """ + _robust("src", "ln", "shot_id") + "SELECT * FROM ln")
def _(t):
    pts = t.wobble().select("shot_id", (F.col("y_m") * 20 + F.col("cents") % 17).alias("x"), F.col("y_m").alias("y"))
    return mk.robust_line(pts, ["shot_id"])


@query("quad_from_boundaries", f"det_id | reason | {QUAD8}", "runs", _SCAN + """
    en AS (SELECT det_id, count(*) AS n, quantile_cont(y, 0.85) AS q FROM sl GROUP BY 1);;
    yy AS (SELECT det_id, y FROM sl UNION ALL SELECT det_id, y FROM sl);;
    tb AS (SELECT det_id, quantile_cont(y, 0.02) AS top, quantile_cont(y, 0.995) AS bot FROM yy GROUP BY 1);;
    gr AS (SELECT det_id, quantile_cont(width, 0.85) - quantile_cont(width, 0.15) AS growth FROM sl GROUP BY 1);;
    src AS (SELECT det_id, 'l' AS side, left_x AS x, CAST(y AS DOUBLE) AS y FROM sl UNION ALL SELECT det_id, 'r', right_x, y FROM sl);; """ + _robust("src", "ln", "det_id, side") + f"""
    lc AS (SELECT det_id, count(*) AS lines, min(inlier_ratio) AS inl FROM ln GROUP BY 1);;
    nt AS (SELECT tb.det_id, quantile_cont(x, 0.005) AS l, quantile_cont(x, 0.995) AS r FROM tb JOIN mp ON mp.det_id = tb.det_id AND abs(mp.ry - round_even(top, 0)) <= 4 GROUP BY 1 HAVING count(*) >= 8);;
    nb AS (SELECT tb.det_id, quantile_cont(x, 0.005) AS l, quantile_cont(x, 0.995) AS r FROM tb JOIN mp ON mp.det_id = tb.det_id AND abs(mp.ry - round_even(bot, 0)) <= 4 GROUP BY 1 HAVING count(*) >= 8);;
    ms AS (SELECT DISTINCT det_id FROM lr);;
    jj AS (SELECT ms.det_id, coalesce(n, 0) AS n, coalesce(lines, 0) AS lines, inl, top, bot, growth, nt.l AS tl, nt.r AS tr, nb.l AS bl, nb.r AS br FROM ms LEFT JOIN en USING (det_id) LEFT JOIN tb USING (det_id) LEFT JOIN gr USING (det_id) LEFT JOIN lc USING (det_id)
      LEFT JOIN nt ON nt.det_id = ms.det_id LEFT JOIN nb ON nb.det_id = ms.det_id);;
    rs AS (SELECT *, CASE WHEN n < 10 THEN 'dense_few_scanline_samples' WHEN lines < 2 THEN 'dense_line_fit_failed' WHEN inl < 0.55e0 THEN 'dense_low_line_inliers' WHEN bot - top < {HEIGHT} * 0.045e0 THEN 'dense_short_y_span'
      WHEN tr <= tl OR br <= bl THEN 'dense_invalid_width_order' WHEN br - bl <= tr - tl AND growth > 5 THEN 'dense_bottom_not_wider' END AS reason FROM jj);;
    SELECT det_id, reason, {', '.join(f"CASE WHEN reason IS NULL THEN trunc(least(greatest({v}, 0), {n - 1})) END AS {c}" for c, v, n in (("tlx", "tl", WIDTH), ("tly", "top", HEIGHT), ("trx", "tr", WIDTH), ("try", "top", HEIGHT), ("brx", "br", WIDTH), ("bry", "bot", HEIGHT), ("blx", "bl", WIDTH), ("bly", "bot", HEIGHT)))} FROM rs""")
def _(t):
    b = _bite(t)
    sizes = b.select("shot_id", "frame_index", "det_id").distinct().withColumn("height", F.lit(HEIGHT)).withColumn("width", F.lit(WIDTH))
    return mk.quad_from_boundaries(b, sizes).select("det_id", "reason", *flat())


# all masks of a frame as one: each is connected in itself, so the parts are what masks that touch make of them
@query("mask_components", "shot_id frame_index components pixels largest", "runs", """
    ed AS (SELECT DISTINCT a.shot_id, a.frame_index, a.det_id AS u, b.det_id AS v FROM runs a JOIN runs b ON a.shot_id = b.shot_id AND a.frame_index = b.frame_index AND a.det_id <> b.det_id
      AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x0 <= a.x1 + 1 AND b.x1 >= a.x0 - 1);;
    rc AS (SELECT DISTINCT shot_id, frame_index, det_id AS u, det_id AS v FROM runs UNION SELECT rc.shot_id, rc.frame_index, rc.u, ed.v FROM rc JOIN ed ON ed.shot_id = rc.shot_id AND ed.frame_index = rc.frame_index AND ed.u = rc.v);;
    cm AS (SELECT shot_id, frame_index, u AS det_id, min(v) AS c FROM rc GROUP BY 1, 2, 3);;
    px AS (SELECT DISTINCT shot_id, frame_index, c, y, unnest(generate_series(x0, x1)) AS x FROM runs JOIN cm USING (shot_id, frame_index, det_id));;
    ar AS (SELECT shot_id, frame_index, c, count(*) AS area FROM px GROUP BY 1, 2, 3);;
    SELECT shot_id, frame_index, count(*) AS components, sum(area) AS pixels, max(area) AS largest FROM ar GROUP BY 1, 2""")
def _(t):
    r = mk.union_masks(t.runs(), ["shot_id", "frame_index"])
    c = mk.mask_components(r, ["shot_id", "frame_index"])
    return c.groupBy("shot_id", "frame_index").agg(
        F.countDistinct("component").alias("components"), F.sum(F.col("x1") - F.col("x0") + 1).alias("pixels"), F.max("component_area").alias("largest"))


# two far-apart parts per mask: the part sizes are known, so SQL can tell what stays
_PARTS = """pa AS (SELECT det_id, sum(x1 - x0 + 1) AS main, sum(CASE WHEN y - y0 < 2 THEN 6 ELSE 0 END) AS speck FROM (SELECT *, min(y) OVER (PARTITION BY det_id) AS y0 FROM runs) GROUP BY 1);; """


def _parts(t):
    from pyspark.sql import Window

    # a mask's first row, told by its detections before they become runs
    d = t.det().withColumn("top", F.min("y0").over(Window.partitionBy("shot_id", "frame_index", "det_id")))
    r = t.runs(d, "top").select("shot_id", "frame_index", "det_id", "y", "x0", "x1", "top")
    both = F.when(F.col("y") - F.col("top") < 2, F.array(F.struct("x0", "x1"), F.struct(F.lit(310).alias("x0"), F.lit(315).alias("x1")))).otherwise(F.array(F.struct("x0", "x1")))
    return r.select("shot_id", "frame_index", "det_id", "y", F.inline(both))


@query("significant_components", "det_id area", "runs", _PARTS + """
    SELECT det_id, CASE WHEN main >= greatest(300, main * 0.03e0) THEN main ELSE 0 END + CASE WHEN speck >= greatest(300, main * 0.03e0) THEN speck ELSE 0 END AS area FROM pa WHERE main >= 300""")
def _(t):
    return mk.mask_area(mk.significant_components(_parts(t)))


@query("largest_component", "det_id area", "runs", _PARTS + "SELECT det_id, main AS area FROM pa")
def _(t):
    return mk.mask_area(mk.largest_component(_parts(t)))


# a plain enlargement: the warped centroid has a pixel-counting answer
@query("bev_centroid_warped", "det_id || bev_x bev_y", "runs", """
    px AS (SELECT det_id, y, unnest(generate_series(x0, x1)) AS x FROM runs WHERE class_name = 'ball');;
    up AS (SELECT det_id, 2 * x + d.dx AS u, 2 * y + e.dy AS v FROM px CROSS JOIN (SELECT unnest([-1, 0]) AS dx) d CROSS JOIN (SELECT unnest([-1, 0]) AS dy) e);;
    SELECT det_id, avg(u) AS bev_x, avg(v) AS bev_y FROM up WHERE u BETWEEN 0 AND 399 AND v BETWEEN 0 AND 799 GROUP BY 1""")
def _(t):
    r = t.runs().where("class_name = 'ball'")
    h = r.select("shot_id").distinct().withColumn("homography", F.array(*[F.lit(v) for v in (2.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 1.0)]))
    return mk.bev_centroid(r, h)


@query("bev_centroid_projected", "det_id || bev_x bev_y", "runs", """
    px AS (SELECT det_id, y, unnest(generate_series(x0, x1)) AS x FROM runs WHERE class_name = 'ball');;
    SELECT det_id, (2 * avg(x) + 5) / (1 + avg(y) * 1e-3) AS bev_x, (3 * avg(y) + 1) / (1 + avg(y) * 1e-3) AS bev_y FROM px GROUP BY 1""")
def _(t):
    r = t.runs().where("class_name = 'ball'")
    h = r.select("shot_id").distinct().withColumn("homography", F.array(*[F.lit(v) for v in (2.0, 0.0, 5.0, 0.0, 3.0, 1.0, 0.0, 1e-3, 1.0)]))
    return mk.bev_centroid(r, h, mode="projected")
