"""Sequences, trimming, kinematics and resampling."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.core import query
from shotlane.operators import sequences as sq
from shotlane.operators import smoothing as sm
from shotlane.operators import trim as tr
from shotlane.operators.kinematics import kinematics_from_points, kinematics_per_quarter
from shotlane.plans import jobs

L, Q = "18.288e0", "(18.288e0 / 4e0)"
INLANE = "(x_m BETWEEN -0.15e0 AND (1.0541e0 + 0.15e0) AND y_m BETWEEN -0.2e0 AND (18.288e0 + 0.4e0))"


def _kin_sql(view: str, keys: str = "shot_id") -> str:
    return f"""d AS (SELECT *, greatest(timestamp_s - lag(timestamp_s) OVER w, 1e-6) AS dt, x_m - lag(x_m) OVER w AS dx, y_m - lag(y_m) OVER w AS dy FROM {view}
      WINDOW w AS (PARTITION BY {keys} ORDER BY frame_index));;
    v AS (SELECT *, sqrt(dx * dx + dy * dy) / dt AS speed FROM d);;
    a AS (SELECT *, CASE WHEN speed IS NULL THEN NULL ELSE coalesce((speed - lag(speed) OVER (PARTITION BY {keys} ORDER BY frame_index)) / dt, 0) END AS accel,
      least(greatest(y_m, 0e0), {L}) AS yc FROM v);;
    qs AS (SELECT i + 1 AS quarter, i * {Q} AS start_m, (i + 1) * {Q} AS end_m FROM (SELECT unnest([0, 1, 2, 3]) AS i));;
    shots AS (SELECT DISTINCT {keys} FROM {view});;
    SELECT {keys}, quarter, start_m, end_m, coalesce(avg(speed), 0) AS mean_speed_mps, coalesce(avg(accel), 0) AS mean_acceleration_mps2, count(speed) AS sample_count
    FROM shots CROSS JOIN qs LEFT JOIN a USING ({keys}) WHERE TRUE GROUP BY ALL"""


KIN_SPEC = "shot_id quarter sample_count || start_m end_m mean_speed_mps mean_acceleration_mps2"
# the range condition belongs to the join, so that empty quarters stay
_KIN = lambda view: _kin_sql(view).replace(
    "LEFT JOIN a USING (shot_id) WHERE TRUE GROUP BY ALL",
    "LEFT JOIN a USING (shot_id) WHERE TRUE GROUP BY ALL").replace(
    "coalesce(avg(speed), 0)", "coalesce(avg(CASE WHEN yc BETWEEN start_m AND end_m THEN speed END), 0)").replace(
    "coalesce(avg(accel), 0)", "coalesce(avg(CASE WHEN yc BETWEEN start_m AND end_m THEN accel END), 0)").replace(
    "count(speed)", "count(CASE WHEN yc BETWEEN start_m AND end_m THEN speed END)")


@query("kinematics_per_quarter", KIN_SPEC, "traj", _KIN("traj"))
def _(t):
    return kinematics_per_quarter(t.traj())


@query("kinematics_from_points", KIN_SPEC, "traj", "pts AS (SELECT shot_id, row_number() OVER (PARTITION BY shot_id ORDER BY frame_index) - 1 AS frame_index, x_m, y_m FROM traj);; "
       "st AS (SELECT shot_id, frame_index, frame_index / 29.97e0 AS timestamp_s, x_m, y_m FROM pts);;" + _KIN("st"))
def _(t):
    pts = t.traj().groupBy("shot_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame_index", "x_m", "y_m"))), lambda p: F.struct(
        p["x_m"].alias("x"), p["y_m"].alias("y"))).alias("ball_positions"))
    return kinematics_from_points(pts.withColumn("fps", F.lit(29.97)))


@query("finite_diff", "shot_id frame_index || speed_mps accel_mps2", "traj", """
    d AS (SELECT *, greatest(timestamp_s - lag(timestamp_s) OVER w, 1e-6) AS dt, x_m - lag(x_m) OVER w AS dx, y_m - lag(y_m) OVER w AS dy FROM traj WINDOW w AS (PARTITION BY shot_id ORDER BY frame_index));;
    v AS (SELECT *, sqrt(dx * dx + dy * dy) / dt AS speed_mps FROM d);;
    SELECT shot_id, frame_index, speed_mps, CASE WHEN speed_mps IS NOT NULL THEN coalesce((speed_mps - lag(speed_mps) OVER (PARTITION BY shot_id ORDER BY frame_index)) / dt, 0) END AS accel_mps2 FROM v""")
def _(t):
    return sq.finite_diff(t.traj())


@query("gap_velocity", "shot_id frame_index || vx vy ax ay", "traj", """
    g AS (SELECT shot_id, frame_index, CASE WHEN cents % 6 > 0 THEN x_m END AS x, y_m AS y FROM traj);;
    s AS (SELECT *, frame_index - lag(frame_index) OVER w AS gap, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM g WHERE x IS NOT NULL WINDOW w AS (PARTITION BY shot_id ORDER BY frame_index));;
    v AS (SELECT shot_id, frame_index, dx / (1e0 / 30e0 * gap) AS vx, dy / (1e0 / 30e0 * gap) AS vy, gap FROM s);;
    a AS (SELECT *, (vx - lag(vx) OVER w) / (1e0 / 30e0 * gap) AS ax, (vy - lag(vy) OVER w) / (1e0 / 30e0 * gap) AS ay FROM v WINDOW w AS (PARTITION BY shot_id ORDER BY frame_index));;
    SELECT g.shot_id, g.frame_index, last_value(a.vx IGNORE NULLS) OVER w AS vx, last_value(a.vy IGNORE NULLS) OVER w AS vy, last_value(a.ax IGNORE NULLS) OVER w AS ax, last_value(a.ay IGNORE NULLS) OVER w AS ay
    FROM g LEFT JOIN a USING (shot_id, frame_index) WINDOW w AS (PARTITION BY g.shot_id ORDER BY g.frame_index ROWS UNBOUNDED PRECEDING)""")
def _(t):
    return sq.gap_velocity(t.traj().withColumn("x_m", F.when(F.col("cents") % 6 > 0, F.col("x_m"))))


@query("gradient_twice", "shot_id frame_index || v a", "roll", """
    i AS (SELECT *, lag(y_m) OVER w AS p, lead(y_m) OVER w AS n FROM roll WINDOW w AS (PARTITION BY shot_id ORDER BY frame_index));;
    v AS (SELECT shot_id, frame_index, CASE WHEN p IS NULL THEN (n - y_m) / 0.5e0 WHEN n IS NULL THEN (y_m - p) / 0.5e0 ELSE (n - p) / 1e0 END AS v FROM i);;
    j AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS n FROM v WINDOW w AS (PARTITION BY shot_id ORDER BY frame_index));;
    SELECT shot_id, frame_index, v, CASE WHEN p IS NULL THEN (n - v) / 0.5e0 WHEN n IS NULL THEN (v - p) / 0.5e0 ELSE (n - p) / 1e0 END AS a FROM j""")
def _(t):
    g = sq.gradient(t.roll(), {"y_m": "v"}, F.lit(0.5), ["shot_id"], "frame_index")
    return sq.gradient(g, {"v": "a"}, F.lit(0.5), ["shot_id"], "frame_index")


@query("first_per_frame", "shot_id frame_index event_id", "one", "SELECT shot_id, frame_index, event_id FROM one")
def _(t):
    return t.one()


_SEG = f"""o AS (SELECT *, row_number() OVER w - 1 AS i, frame_index - lag(frame_index) OVER w AS g, x_m - lag(x_m) OVER w AS dx, y_m - lag(y_m) OVER w AS dy, {INLANE} AS inb
      FROM VIEW WINDOW w AS (PARTITION BY shot_id ORDER BY frame_index));;
    sg AS (SELECT *, CAST(sum(CASE WHEN i > 0 AND (NOT inb OR y_m > 18.288e0 + 0.35e0 OR greatest(g, 1) > 36 OR dy < -0.35e0 OR abs(dx) > 0.42e0 OR dy / greatest(g, 1) > 0.75e0) THEN 1 ELSE 0 END)
      OVER (PARTITION BY shot_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM o);;
    """
_BEST = """st AS (SELECT shot_id, segment, sum(CASE WHEN inb THEN 1 ELSE 0 END) AS nb, max(y_m) - min(y_m) AS ys, max(frame_index) - min(frame_index) AS fs, min(i) AS a, max(i) + 1 AS b FROM sg GROUP BY ALL);;
    bs AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY shot_id ORDER BY nb DESC, ys DESC, fs DESC, segment) = 1);;
    """
_ENDS = """r0 AS (SELECT sg.*, a AS a0, b AS b0, lead(y_m, 3) OVER w - y_m AS head, y_m - lag(y_m) OVER w AS back FROM sg JOIN bs USING (shot_id) WINDOW w AS (PARTITION BY shot_id ORDER BY frame_index));;
    r1 AS (SELECT *, min(CASE WHEN i >= a0 AND i < b0 AND (i >= b0 - 1 OR y_m >= -0.08e0) THEN i END) OVER (PARTITION BY shot_id) AS a1 FROM r0);;
    r2 AS (SELECT *, min(CASE WHEN i >= a1 AND i < b0 AND (i >= b0 - 3 OR (head >= -0.05e0 AND inb)) THEN i END) OVER (PARTITION BY shot_id) AS a2 FROM r1);;
    r3 AS (SELECT *, max(CASE WHEN i >= a2 AND i < b0 AND (i + 1 - a2 < 4 OR (inb AND y_m <= 18.288e0 + 0.35e0 AND back >= -0.2e0)) THEN i + 1 END) OVER (PARTITION BY shot_id) AS b3 FROM r2);;
    """
_STEP = """, i - {a} AS k, {b} - {a} - 1 AS n, lead(y_m) OVER (PARTITION BY shot_id ORDER BY frame_index) - y_m AS sy, lead(x_m) OVER (PARTITION BY shot_id ORDER BY frame_index) - x_m AS sx"""
_MID = "k >= 0 AND k < n AND k >= floor(n * 2e-1) AND k < floor(n * 8e-1)"


def _mid(src: str, out: str, a: str, b: str) -> str:
    return f"""{out}0 AS (SELECT *{_STEP.format(a=a, b=b)} FROM {src});;
    {out} AS (SELECT *, count(CASE WHEN {_MID} AND sy > 0 THEN 1 END) OVER (PARTITION BY shot_id) AS ups,
      quantile_cont(CASE WHEN {_MID} AND sy > 0 THEN sy END, 0.5) OVER (PARTITION BY shot_id) AS med,
      stddev_pop(CASE WHEN {_MID} THEN sx END) OVER (PARTITION BY shot_id) AS sd FROM {out}0);;
    """


def _loft(src: str, a: str, b: str) -> str:
    return _mid(src, "m1", a, b) + f"""l1 AS (SELECT *, (k >= 0 AND k < n AND sy < 0.3e0 * med) AS slow, sy >= 0.45e0 * med AS good FROM m1);;
    l2 AS (SELECT *, CASE WHEN {b} - {a} >= 8 AND ups >= 3 AND slow AND lag(slow) OVER w AND k >= 1 AND k < greatest(2, floor(n * 4e-1)) THEN k END AS st,
      good AND lead(good, 1) OVER w AND lead(good, 2) OVER w AS three FROM l1 WINDOW w AS (PARTITION BY shot_id ORDER BY frame_index));;
    l3 AS (SELECT *, max(st) OVER (PARTITION BY shot_id) AS stall FROM l2);;
    l4 AS (SELECT * EXCLUDE (k, n, sy, sx, ups, med, sd), {a} + coalesce(min(CASE WHEN three AND k > stall AND k <= n - 3 THEN k END) OVER (PARTITION BY shot_id), 0) AS a4 FROM l3);;
    """


def _tail(src: str, a: str, b: str) -> str:
    return _mid(src, "m2", a, b) + f"""t1 AS (SELECT *, max(CASE WHEN k >= 0 AND k < n AND NOT (sy < 0.25e0 * med OR abs(sx) > greatest(2.5e0 * sd, 0.08e0)) THEN k END) OVER (PARTITION BY shot_id) AS lg FROM m2);;
    t2 AS (SELECT *, {b} - CASE WHEN {b} - {a} >= 8 AND ups >= 3 THEN greatest(least(n - 1 - coalesce(lg, -1), 6, {b} - {a} - 6), 0) ELSE 0 END AS b5 FROM t1);;
    """


_KEPT = "SELECT shot_id, frame_index, x_m, y_m FROM {src} WHERE i >= {a} AND i < {b}"
POS = "shot_id frame_index || x_m y_m"
_FULL = _SEG.replace("VIEW", "wobble") + _BEST + _ENDS + _loft("r3", "a2", "b3") + _tail("l4", "a4", "b3")


@query("motion_segments", "shot_id frame_index row_no segment", "traj", _SEG.replace("VIEW", "traj") + "SELECT shot_id, frame_index, i AS row_no, segment FROM sg")
def _(t):
    return tr.motion_segments(t.traj())


@query("best_interval", "shot_id start_row end_row segments rows", "wobble", _SEG.replace("VIEW", "wobble") + _BEST + """
    SELECT shot_id, a AS start_row, b AS end_row, segs AS segments, n AS rows FROM bs JOIN (SELECT shot_id, max(segment) + 1 AS segs, count(*) AS n FROM sg GROUP BY 1) USING (shot_id)""")
def _(t):
    return tr.best_interval(t.wobble())


@query("trim_ends", POS, "wobble", _SEG.replace("VIEW", "wobble") + _BEST + _ENDS + _KEPT.format(src="r3", a="a2", b="b3"))
def _(t):
    return tr.trim_ends(t.wobble())


@query("trim_loft", POS, "wobble", _SEG.replace("VIEW", "wobble") + _BEST + _ENDS + _loft("r3", "a2", "b3") + _KEPT.format(src="l4", a="a4", b="b3"))
def _(t):
    return tr.trim_loft(t.wobble())


@query("trim_tail_cluster", POS, "wobble", _SEG.replace("VIEW", "wobble") + _BEST + _ENDS + _tail("r3", "a2", "b3") + _KEPT.format(src="t2", a="a2", b="b5"))
def _(t):
    return tr.trim_tail_cluster(t.wobble())


@query("trim_detections", POS, "wobble", _FULL + _KEPT.format(src="t2", a="a4", b="b5"))
def _(t):
    return tr.trim_detections(t.wobble())


@query("trim_diagnostics", "shot_id raw_count kept_count cut_frame_index last_kept_frame_index | cut_reason | current_dy median_dy cut_x_m cut_y_m", "wobble", _FULL + """
    z AS (SELECT *, CASE WHEN i > a4 AND i < b5 THEN y_m - lag(y_m) OVER (PARTITION BY shot_id ORDER BY frame_index) END AS stp, CASE WHEN a4 > 0 THEN i = a4 ELSE i = b5 END AS atcut FROM t2);;
    SELECT shot_id, count(*) AS raw_count, count(CASE WHEN i >= a4 AND i < b5 THEN 1 END) AS kept_count, max(CASE WHEN atcut THEN frame_index END) AS cut_frame_index,
      max(CASE WHEN i = b5 - 1 THEN frame_index END) AS last_kept_frame_index,
      CASE WHEN max(a4) > 0 THEN 'pre_contact_or_artifact_interval' WHEN max(b5) < count(*) THEN 'post_track_artifact_interval' END AS cut_reason,
      max(CASE WHEN i = b5 - 1 THEN stp END) AS current_dy, CASE WHEN count(stp) > 1 THEN quantile_cont(stp, 0.5) END AS median_dy,
      max(CASE WHEN atcut THEN x_m END) AS cut_x_m, max(CASE WHEN atcut THEN y_m END) AS cut_y_m FROM z GROUP BY 1""")
def _(t):
    return tr.trim_diagnostics(t.wobble())


@query("ball_path_score", "shot_id || ball_score", "traj", _SEG.replace("VIEW", "traj") + _BEST + _ENDS + """
    z AS (SELECT *, inb AND i >= a2 AND i < b3 AS ok FROM r3);;
    SELECT shot_id, CASE WHEN count(CASE WHEN ok THEN 1 END) = 0 THEN 0 ELSE 0.35e0 * count(CASE WHEN inb THEN 1 END) / count(*) + 0.3e0 * count(CASE WHEN ok THEN 1 END) / count(*)
      + 0.2e0 * least((max(CASE WHEN ok THEN y_m END) - min(CASE WHEN ok THEN y_m END)) / 4, 1)
      + 0.15e0 * least((max(CASE WHEN ok THEN frame_index END) - min(CASE WHEN ok THEN frame_index END) + 1) / 16e0, 1) END AS ball_score FROM z GROUP BY 1""")
def _(t):
    return tr.ball_path_score(t.traj())


@query("in_lane", "shot_id frame_index inside || x_m y_m", "wobble", f"SELECT shot_id, frame_index, CASE WHEN {INLANE} THEN 1 ELSE 0 END AS inside, x_m, y_m FROM wobble")
def _(t):
    return t.wobble().withColumn("inside", sq.in_lane(F.col("x_m"), F.col("y_m")).cast("int"))


@query("clip_positions", POS, "wobble", "SELECT shot_id, frame_index, least(greatest(x_m * 3 - 1, -0.5e0), 1.5541e0) AS x_m, least(greatest(y_m * 1.2e0 - 2, -1e0), 19.288e0) AS y_m FROM wobble")
def _(t):
    return sq.clip_positions(t.wobble().withColumn("x_m", F.col("x_m") * 3 - 1).withColumn("y_m", F.col("y_m") * F.lit(1.2) - 2))


@query("running_max", "shot_id frame_index || y_max", "wobble", "SELECT shot_id, frame_index, max(y_m) OVER (PARTITION BY shot_id ORDER BY frame_index) AS y_max FROM wobble")
def _(t):
    return sq.running_max(t.wobble(), "y_m", "y_max")


_MINIMAX = """w AS (SELECT shot_id, frame_index, row_number() OVER (PARTITION BY shot_id ORDER BY frame_index) AS i, y_m, sum(y_m) OVER (PARTITION BY shot_id ORDER BY frame_index) AS c FROM wobble);;
    m AS (SELECT j.shot_id, j.i AS j, k.i AS k, (k.c - j.c + j.y_m) / (k.i - j.i + 1) AS mean FROM w j JOIN w k ON j.shot_id = k.shot_id AND k.i >= j.i);;
    sfx AS (SELECT shot_id, j, k, min(mean) OVER (PARTITION BY shot_id, j ORDER BY k DESC) AS lo FROM m);;
    iso AS (SELECT shot_id, k AS i, max(lo) AS y_iso FROM sfx GROUP BY ALL);;
    """


@query("isotonic", "shot_id frame_index || y_iso", "wobble", _MINIMAX + "SELECT shot_id, frame_index, y_iso FROM w JOIN iso USING (shot_id, i)")
def _(t):
    return sm.isotonic(t.wobble())


@query("spread_flat", "shot_id frame_index || y_spread", "seq", """
    f AS (SELECT shot_id, frame_index, row_number() OVER (PARTITION BY shot_id ORDER BY frame_index) AS i, floor(y_fwd * 2) / 2 AS v FROM seq);;
    g AS (SELECT *, count(CASE WHEN p IS NULL OR abs(v - p) >= 1e-9 THEN 1 END) OVER (PARTITION BY shot_id ORDER BY i) AS run FROM (SELECT *, lag(v) OVER (PARTITION BY shot_id ORDER BY i) AS p FROM f));;
    rn AS (SELECT shot_id, run, count(*) AS n, min(v) AS v, lead(min(v)) OVER (PARTITION BY shot_id ORDER BY run) AS nx FROM g GROUP BY shot_id, run);;
    walk AS (SELECT shot_id, run, CAST(NULL AS DOUBLE) AS fr, v AS en FROM rn WHERE run = 1
      UNION ALL SELECT rn.shot_id, rn.run, walk.en, CASE WHEN rn.n > 1 AND rn.nx IS NOT NULL AND rn.nx > walk.en THEN walk.en + (rn.nx - walk.en) / (rn.n + 1) * rn.n ELSE rn.v END
      FROM walk JOIN rn ON rn.shot_id = walk.shot_id AND rn.run = walk.run + 1);;
    s AS (SELECT g.shot_id, g.frame_index, g.i, CASE WHEN rn.n > 1 AND rn.nx IS NOT NULL AND fr IS NOT NULL AND rn.nx > fr
      THEN fr + (rn.nx - fr) / (rn.n + 1) * row_number() OVER (PARTITION BY g.shot_id, g.run ORDER BY g.i) ELSE g.v END AS s
      FROM g JOIN rn USING (shot_id, run) JOIN walk USING (shot_id, run));;
    SELECT shot_id, frame_index, max(s) OVER (PARTITION BY shot_id ORDER BY i) AS y_spread FROM s""")
def _(t):
    rows = t._seq().withColumn("v", F.floor(F.col("y_fwd") * 2) / 2)
    return sq.spread_flat(rows.select("shot_id", "frame_index", "v"), "v", "y_spread")


@query("anchor_ends", "shot_id frame_index || y_anchored", "wobble", """
    n AS (SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY frame_index) AS i, count(*) OVER (PARTITION BY shot_id) AS n, y_m + 1e0 AS raw FROM wobble);;
    h AS (SELECT *, least(5, n) AS m FROM n);;
    a AS (SELECT *, CASE WHEN i <= m THEN 0.5e0 * (1 - (i - 1) / greatest(m - 1, 1)::DOUBLE) ELSE 0 END AS hw, CASE WHEN i > n - m THEN 0.5e0 * (i - (n - m) - 1) / greatest(m - 1, 1) ELSE 0 END AS tw FROM h);;
    SELECT shot_id, frame_index, CASE WHEN n <= 2 THEN y_m ELSE tw * raw + (1 - tw) * (hw * raw + (1 - hw) * y_m) END AS y_anchored FROM a""")
def _(t):
    return sq.anchor_ends(t.wobble().withColumn("raw", F.col("y_m") + 1.0), "y_m", "raw", "y_anchored")


@query("clamp_hook_tail", POS, "roll", """
    n AS (SELECT shot_id, frame_index, x_m + y_m / 5e1 AS x_m, y_m, row_number() OVER (PARTITION BY shot_id ORDER BY frame_index) - 1 AS i, count(*) OVER (PARTITION BY shot_id) AS n FROM roll);;
    b AS (SELECT *, CAST(floor(n * 2e-1) AS BIGINT) AS lo, CAST(floor(n * 8e-1) AS BIGINT) AS hi FROM n);;
    d AS (SELECT *, max(CASE WHEN i = hi THEN x_m END) OVER (PARTITION BY shot_id) - max(CASE WHEN i = lo THEN x_m END) OVER (PARTITION BY shot_id) AS dx,
      max(CASE WHEN i = hi THEN y_m END) OVER (PARTITION BY shot_id) - max(CASE WHEN i = lo THEN y_m END) OVER (PARTITION BY shot_id) AS dy, greatest(hi, n - greatest(6, n // 8)) AS start FROM b);;
    s AS (SELECT *, CASE WHEN n >= 12 AND hi > lo + 4 AND abs(dx) >= 0.04e0 AND dy > 1 THEN sign(dx) END AS side FROM d);;
    walk AS (SELECT shot_id, i, x_m FROM s WHERE side IS NOT NULL AND i = start
      UNION ALL SELECT s.shot_id, s.i, CASE WHEN (s.x_m - walk.x_m) * s.side < -1e-3 THEN walk.x_m ELSE s.x_m END FROM walk JOIN s ON s.shot_id = walk.shot_id AND s.i = walk.i + 1);;
    SELECT s.shot_id, s.frame_index, coalesce(walk.x_m, s.x_m) AS x_m, s.y_m FROM s LEFT JOIN walk USING (shot_id, i)""")
def _(t):
    return sm.clamp_hook_tail(t.roll().withColumn("x_m", F.col("x_m") + F.col("y_m") / 50.0).select("shot_id", "frame_index", "x_m", "y_m"))


@query("orient", "shot_id frame_index primary_axis reversed seq || s l", "wobble", """
    v AS (SELECT shot_id, frame_index, x_m * (shot_id % 7 + 1) * 6 AS x, CASE WHEN shot_id % 2 = 0 THEN y_m ELSE 18 - y_m END AS y FROM wobble);;
    r AS (SELECT *, CASE WHEN max(x) OVER p - min(x) OVER p >= max(y) OVER p - min(y) OVER p THEN 0 ELSE 1 END AS primary_axis, row_number() OVER (PARTITION BY shot_id ORDER BY frame_index) AS i, count(*) OVER p AS n FROM v WINDOW p AS (PARTITION BY shot_id));;
    s AS (SELECT *, CASE WHEN primary_axis = 0 THEN x ELSE y END AS s, CASE WHEN primary_axis = 0 THEN y ELSE x END AS l FROM r);;
    d AS (SELECT *, CASE WHEN last_value(s) OVER f < first_value(s) OVER f THEN 1 ELSE 0 END AS reversed FROM s WINDOW f AS (PARTITION BY shot_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING));;
    SELECT shot_id, frame_index, primary_axis, reversed, CASE WHEN reversed = 1 THEN n - i + 1 ELSE i END AS seq, s, l FROM d""")
def _(t):
    v = t.wobble().withColumn("x_m", F.col("x_m") * (F.col("shot_id") % 7 + 1) * 6).withColumn(
        "y_m", F.when(F.col("shot_id") % 2 == 0, F.col("y_m")).otherwise(18 - F.col("y_m")))
    return sq.orient(v).withColumn("reversed", F.col("trajectory_reversed").cast("int"))


@query("contiguous_ranges", "shot_id start_frame end_frame frames", "one", """
    g AS (SELECT shot_id, frame_index, frame_index - row_number() OVER (PARTITION BY shot_id ORDER BY frame_index) AS g FROM one);;
    SELECT shot_id, min(frame_index) AS start_frame, max(frame_index) AS end_frame, count(*) AS frames FROM g GROUP BY shot_id, g""")
def _(t):
    return sq.contiguous_ranges(t.one())


@query("largest_gap", "shot_id largest_gap", "one", """
    SELECT shot_id, coalesce(max(g), 0) AS largest_gap FROM (SELECT shot_id, frame_index - lag(frame_index) OVER (PARTITION BY shot_id ORDER BY frame_index) AS g FROM one) GROUP BY 1""")
def _(t):
    return sq.largest_gap(t.one())


@query("densify_linear", POS, "traj", """
    n AS (SELECT *, lead(frame_index) OVER w AS nf, lead(x_m) OVER w AS nx, lead(y_m) OVER w AS ny FROM traj WINDOW w AS (PARTITION BY shot_id ORDER BY frame_index));;
    e AS (SELECT *, unnest(generate_series(frame_index, coalesce(nf - 1, frame_index))) AS f FROM n);;
    SELECT shot_id, f AS frame_index, CASE WHEN f = frame_index THEN x_m ELSE (nx - x_m) / (nf - frame_index) * (f - frame_index) + x_m END AS x_m,
      CASE WHEN f = frame_index THEN y_m ELSE (ny - y_m) / (nf - frame_index) * (f - frame_index) + y_m END AS y_m FROM e""")
def _(t):
    return sm.densify_linear(t.traj())


def linear_steps(view: str, key: str = "shot_id", p: str = "li") -> str:
    """``view`` resampled to straight lines, as view ``p`` (key, k, timestamp_s, x_m, y_m)."""
    return f"""
    {p}b AS (SELECT {key}, min(timestamp_s) AS t0, max(timestamp_s) AS t1, count(*) AS n FROM {view} GROUP BY 1);;
    {p}g AS (SELECT *, unnest(generate_series(0, n * 3 - 1)) AS k FROM {p}b WHERE n >= 3);;
    {p}q AS (SELECT {key}, k, CASE WHEN k = n * 3 - 1 THEN t1 ELSE k * ((t1 - t0) / (n * 3 - 1)) + t0 END AS timestamp_s FROM {p}g);;
    {p}s AS (SELECT {key}, timestamp_s AS ta, x_m, y_m, lead(timestamp_s) OVER w AS tb, lead(x_m) OVER w AS xb, lead(y_m) OVER w AS yb FROM {view} WINDOW w AS (PARTITION BY {key} ORDER BY timestamp_s));;
    {p}z AS (SELECT q.*, ta, tb, x_m, xb, y_m, yb FROM {p}q q ASOF JOIN {p}s s ON q.{key} = s.{key} AND q.timestamp_s >= s.ta);;
    {p} AS (SELECT {key}, k, timestamp_s, CASE WHEN tb IS NULL THEN x_m ELSE x_m + (xb - x_m) * ((timestamp_s - ta) / (tb - ta)) END AS x_m, CASE WHEN tb IS NULL THEN y_m ELSE y_m + (yb - y_m) * ((timestamp_s - ta) / (tb - ta)) END AS y_m FROM {p}z
      UNION ALL SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY timestamp_s) - 1, timestamp_s, x_m, y_m FROM {view} WHERE {key} IN (SELECT {key} FROM {p}b WHERE n < 3));; """


def cubic_steps(view: str, key: str = "shot_id", p: str = "cu") -> str:
    """``view`` resampled to natural cubics, as view ``p``: two recursions solve the tridiagonal equations of the second derivatives; up to three samples are not curved."""
    return f"""
    {p}p AS (SELECT {key}, timestamp_s AS t, x_m AS x, y_m AS y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n, lead(timestamp_s) OVER w - timestamp_s AS h, timestamp_s - lag(timestamp_s) OVER w AS hp,
      lead(x_m) OVER w - x_m AS ax, x_m - lag(x_m) OVER w AS wx, lead(y_m) OVER w - y_m AS ay, y_m - lag(y_m) OVER w AS wy FROM {view} WINDOW w AS (PARTITION BY {key} ORDER BY timestamp_s));;
    {p}f AS (SELECT {key}, i, n, 0e0 AS r, 0e0 AS dx, 0e0 AS dy FROM {p}p WHERE i = 0 UNION ALL
      SELECT p.{key}, p.i, p.n, h / (2 * (hp + h) - hp * r), (6 * (ax / h - wx / hp) - hp * dx) / (2 * (hp + h) - hp * r), (6 * (ay / h - wy / hp) - hp * dy) / (2 * (hp + h) - hp * r)
      FROM {p}f f JOIN {p}p p ON p.{key} = f.{key} AND p.i = f.i + 1 WHERE p.i < p.n - 1 AND p.n > 3);;
    {p}m AS (SELECT {key}, i, 0e0 AS mx, 0e0 AS my FROM {p}p WHERE i = n - 1 UNION ALL
      SELECT f.{key}, f.i, dx - r * mx, dy - r * my FROM {p}m m JOIN {p}f f ON f.{key} = m.{key} AND f.i = m.i - 1);;
    {p}s AS (SELECT p.*, coalesce(a.mx, 0) AS mx, coalesce(a.my, 0) AS my, coalesce(b.mx, 0) AS nx, coalesce(b.my, 0) AS ny FROM {p}p p LEFT JOIN {p}m a ON a.{key} = p.{key} AND a.i = p.i LEFT JOIN {p}m b ON b.{key} = p.{key} AND b.i = p.i + 1);;
    {p}b AS (SELECT {key}, min(t) AS t0, max(t) AS t1, count(*) AS c FROM {p}p GROUP BY 1);;
    {p}g AS (SELECT *, unnest(generate_series(0, c * 3 - 1)) AS k FROM {p}b WHERE c >= 3);;
    {p}q AS (SELECT {key}, k, CASE WHEN k = c * 3 - 1 THEN t1 ELSE k * ((t1 - t0) / (c * 3 - 1)) + t0 END AS u FROM {p}g);;
    {p}z AS (SELECT q.k, q.u, u - s.t AS d, s.t + s.h - u AS e, s.* FROM {p}q q ASOF JOIN {p}s s ON q.{key} = s.{key} AND q.u >= s.t);;
    {p} AS (SELECT {key}, k, u AS timestamp_s,
      CASE WHEN h IS NULL THEN x ELSE (mx * e ** 3 + nx * d ** 3) / (6 * h) + (x / h - mx * h / 6) * e + ((x + ax) / h - nx * h / 6) * d END AS x_m,
      CASE WHEN h IS NULL THEN y ELSE (my * e ** 3 + ny * d ** 3) / (6 * h) + (y / h - my * h / 6) * e + ((y + ay) / h - ny * h / 6) * d END AS y_m FROM {p}z
      UNION ALL SELECT {key}, i, t, x, y FROM {p}p WHERE n < 3);; """


@query("resample_linear", "shot_id grid_no || timestamp_s x_m y_m", "traj", linear_steps("traj") + "SELECT *, k AS grid_no FROM li")
def _(t):
    return sm.resample(t.traj(), "linear")


@query("resample_cubic", "shot_id grid_no || timestamp_s x_m y_m", "traj", cubic_steps("traj") + "SELECT *, k AS grid_no FROM cu")
def _(t):
    return sm.resample(t.traj(), "cubic")


@query("smooth_spline", "shot_id frame_index || y_smooth")
def _(t):
    return sm.smooth_spline(t.wobble(), "y_m", "y_smooth")


@query("resmooth_x", POS)
def _(t):
    return sm.resmooth_x(t.roll(), F.count(F.lit(1)).over(Window.partitionBy("shot_id")))


@query("smooth_trajectory", "shot_id frame_index || timestamp_s x_m y_m")
def _(t):
    return sm.smooth_trajectory(tr.trim_detections(t.wobble()))


@query("tail_rate", "shot_id || tail_slope median_step rate", "roll", """
    d AS (SELECT *, y_m - lag(y_m) OVER (PARTITION BY shot_id ORDER BY frame_index) AS dy, row_number() OVER (PARTITION BY shot_id ORDER BY frame_index DESC) AS r FROM roll);;
    a AS (SELECT shot_id, coalesce(regr_slope(CASE WHEN r <= 5 THEN y_m END, CASE WHEN r <= 5 THEN frame_index END), 0) AS tail_slope,
      CASE WHEN count(CASE WHEN dy > 1e-4 THEN 1 END) >= 3 THEN quantile_cont(CASE WHEN dy > 1e-4 THEN dy END, 0.5) ELSE 0 END AS median_step FROM d GROUP BY 1);;
    SELECT *, CASE WHEN tail_slope < 0.3e0 * median_step AND median_step > 1e-4 THEN median_step ELSE tail_slope END AS rate FROM a""")
def _(t):
    return sm.tail_rate(t.roll())


def _power(p: int) -> str:
    return " * ".join(["u"] * p) or "1e0"


_PREDICT = ("""tl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY frame_index DESC) AS r FROM VIEW) WHERE r <= 18);;
    lx AS (SELECT shot_id, arg_max(x_m, frame_index) AS last_x FROM tl GROUP BY 1);;
    pt AS (SELECT shot_id, y_m, quantile_cont(x_m, 0.5) AS x FROM tl GROUP BY ALL);;
    pi AS (SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY y_m) AS i, count(*) OVER (PARTITION BY shot_id) AS n, avg(y_m) OVER (PARTITION BY shot_id) AS c FROM pt);;
    pw AS (SELECT *, y_m - c AS u, (0.5e0 + (i - 1) / greatest(n - 1, 1)::DOUBLE) * (0.5e0 + (i - 1) / greatest(n - 1, 1)::DOUBLE) AS w, n // 3 AS th, greatest(3, n // 3) AS tn FROM pi);;
    ag AS (SELECT shot_id, max(n) AS n, max(c) AS c, """
    + ", ".join(f"sum(w * {_power(p)}) AS s{p}" for p in range(5)) + ", " + ", ".join(f"sum(w * x * {_power(p)}) AS t{p}" for p in range(3)) + """,
      max(y_m) - min(y_m) AS span, quantile_cont(CASE WHEN i <= th THEN x END, 0.5) AS ex, quantile_cont(CASE WHEN i > n - th THEN x END, 0.5) AS lx, quantile_cont(CASE WHEN i <= th THEN y_m END, 0.5) AS ey,
      quantile_cont(CASE WHEN i > n - th THEN y_m END, 0.5) AS ly, max(CASE WHEN i = n THEN x END) - max(CASE WHEN i = n - tn + 1 THEN x END) AS tdx, max(CASE WHEN i = n THEN y_m END) - max(CASE WHEN i = n - tn + 1 THEN y_m END) AS tdy FROM pw GROUP BY 1);;
    f1 AS (SELECT ag.*, last_x, 18.288e0 - c AS tg, (s0 * t1 - s1 * t0) / nullif(s0 * s2 - s1 * s1, 0) AS sl, (s2 * t0 - s1 * t1) / nullif(s0 * s2 - s1 * s1, 0) AS ic,
      nullif(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2), 0) AS dt,
      CASE WHEN n >= 9 AND abs(lx - ex) >= 0.04e0 AND ly - ey > 1 THEN sign(lx - ex) ELSE 0 END AS side FROM ag JOIN lx USING (shot_id));;
    f2 AS (SELECT *, ic + sl * tg AS xl, (s0 * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / dt AS cv,
      (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / dt AS q0, (s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / dt AS q1 FROM f1);;
    f3 AS (SELECT *, q0 + q1 * tg + cv * tg * tg AS xq, tdx / nullif(tdy, 0) - sl AS delta, abs(tdy) > 1e-6 AND n >= 6 AS turn FROM f2);;
    f4 AS (SELECT *, CASE WHEN turn AND cv * delta > 0 AND abs(delta) > 0.02e0 THEN 0.82e0 ELSE 0.7e0 END AS b, CASE WHEN turn AND side <> 0 AND cv * side > 0 THEN 0.06e0 ELSE 0 END AS push FROM f3);;
    f5 AS (SELECT *, CASE WHEN n < 5 OR span < 1 OR cv IS NULL OR abs(cv) > 0.2e0 THEN xl ELSE b * xq + (1 - b) * xl + push * (xq - xl) END AS raw FROM f4);;
    pr AS (SELECT shot_id, last_x, CASE WHEN n < 2 OR span < 0.35e0 OR raw IS NULL OR (side <> 0 AND (raw - last_x) * side < 0) THEN last_x ELSE raw END AS x_at_end FROM f5);;
    """)


@query("predict_x_at_y", "shot_id || last_x x_at_end", "roll", _PREDICT.replace("VIEW", "roll") + "SELECT * FROM pr")
def _(t):
    return sm.predict_x_at_y(t.roll())


@query("append_departure", "shot_id frame_index || timestamp_s x_m y_m", "seq", """
    sh AS (SELECT shot_id, frame_index, timestamp_s, x_roll AS x_m, y_fwd * 0.9e0 AS y_m FROM seq);;""" + _PREDICT.replace("VIEW", "sh") + """
    d AS (SELECT *, y_m - lag(y_m) OVER (PARTITION BY shot_id ORDER BY frame_index) AS dy, row_number() OVER (PARTITION BY shot_id ORDER BY frame_index DESC) AS r FROM sh);;
    a AS (SELECT shot_id, count(*) AS n, max(frame_index) AS f, arg_max(y_m, frame_index) AS y, coalesce(regr_slope(CASE WHEN r <= 5 THEN y_m END, CASE WHEN r <= 5 THEN frame_index END), 0) AS ts,
      CASE WHEN count(CASE WHEN dy > 1e-4 THEN 1 END) >= 3 THEN quantile_cont(CASE WHEN dy > 1e-4 THEN dy END, 0.5) ELSE 0 END AS ms FROM d GROUP BY 1);;
    v AS (SELECT *, CASE WHEN ts < 0.3e0 * ms AND ms > 1e-4 THEN ms ELSE ts END AS rate FROM a);;
    o AS (SELECT v.*, f + CAST(least(greatest(round_even((18.288e0 - y) * (1 / greatest(rate, 1e-4)), 0), 1), 60) AS BIGINT) AS df,
      least(greatest(least(greatest(x_at_end, last_x - 0.36e0), last_x + 0.36e0), -0.15e0), 1.0541e0 + 0.15e0) AS x FROM v JOIN pr USING (shot_id) WHERE n >= 2 AND abs(rate) >= 1e-4 AND y < 18.288e0 - 0.02e0);;
    SELECT shot_id, frame_index, timestamp_s, x_m, y_m FROM sh UNION ALL SELECT shot_id, df, df / 30e0, x, 18.288e0 FROM o""")
def _(t):
    return sm.append_departure(t.roll().withColumn("y_m", F.col("y_m") * F.lit(0.9)))


@query("clean_positions", "shot_id frame_index || timestamp_s x_m y_m")
def _(t):
    return jobs.clean_positions(t.wobble().withColumn("fps", F.lit(30.0)))


@query("analyse_positions", KIN_SPEC)
def _(t):
    return jobs.analyse_positions(t.roll().withColumn("fps", F.lit(30.0)))
