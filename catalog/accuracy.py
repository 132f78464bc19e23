"""Lane metrics, calibration, error reports, label sets and result tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.core import query
from catalog.motion import _FULL, cubic_steps, linear_steps
from catalog.views import HEIGHT, WIDTH
from shotlane.functions import geometry as G
from shotlane.operators import dataset as ds
from shotlane.operators import evaluate as ev
from shotlane.operators import sequences as sq
from shotlane.operators import smoothing as sm
from shotlane.operators import trim as tr
from shotlane.plans import jobs
from shotlane.session import scratch_path
from shotlane.sources import readers as rd
from shotlane.sources import writers as wr

M6 = "vel_s vel_l speed acc_s acc_l accel_mag"


def _grad(src: str, out: str, pairs: dict, key: str, order: str, dt: str) -> str:
    lagged = ", ".join(f"lag({c}) OVER w AS p_{c}, lead({c}) OVER w AS n_{c}" for c in pairs)
    cols = ", ".join(f"CASE WHEN p_{c} IS NULL THEN (n_{c} - {c}) / {dt} WHEN n_{c} IS NULL THEN ({c} - p_{c}) / {dt} ELSE (n_{c} - p_{c}) / (2 * {dt}) END AS {o}" for c, o in pairs.items())
    drop = ", ".join(f"p_{c}, n_{c}" for c in pairs)
    return f"{out}0 AS (SELECT *, {lagged} FROM {src} WINDOW w AS (PARTITION BY {key} ORDER BY {order}));; {out} AS (SELECT * EXCLUDE ({drop}), {cols} FROM {out}0);; "


def _profile(view: str, key: str) -> str:
    """The uninterpolated motion profile: orient, then two gradients over an even time step."""
    return f"""o1 AS (SELECT *, CASE WHEN max(x_m) OVER p - min(x_m) OVER p >= max(y_m) OVER p - min(y_m) OVER p THEN 0 ELSE 1 END AS primary_axis, row_number() OVER (PARTITION BY {key} ORDER BY timestamp_s) AS i, count(*) OVER p AS n,
      (max(timestamp_s) OVER p - min(timestamp_s) OVER p) / nullif(count(*) OVER p - 1, 0) AS dt FROM {view} WINDOW p AS (PARTITION BY {key}));;
    o2 AS (SELECT *, CASE WHEN primary_axis = 0 THEN x_m ELSE y_m END AS s, CASE WHEN primary_axis = 0 THEN y_m ELSE x_m END AS l FROM o1);;
    o3 AS (SELECT *, max(CASE WHEN i = n THEN s END) OVER (PARTITION BY {key}) < max(CASE WHEN i = 1 THEN s END) OVER (PARTITION BY {key}) AS rev FROM o2);;
    o4 AS (SELECT *, CASE WHEN rev THEN n - i + 1 ELSE i END AS seq FROM o3);;
    o5 AS (SELECT *, max(CASE WHEN seq = 1 THEN s END) OVER (PARTITION BY {key}) AS s0, max(CASE WHEN seq = n THEN s END) OVER (PARTITION BY {key}) - max(CASE WHEN seq = 1 THEN s END) OVER (PARTITION BY {key}) AS len FROM o4);;
    o6 AS (SELECT * FROM o5 WHERE dt > 0 AND len > 0);; """ + _grad("o6", "g1", {"s": "vel_s", "l": "vel_l"}, key, "seq", "dt") + _grad("g1", "g2", {"vel_s": "acc_s", "vel_l": "acc_l"}, key, "seq", "dt") + \
        "pf AS (SELECT *, sqrt(vel_s * vel_s + vel_l * vel_l) AS speed, sqrt(acc_s * acc_s + acc_l * acc_l) AS accel_mag FROM g2);; "


def _fractions(src: str, key: str) -> str:
    return f"""fq AS (SELECT *, unnest([0.25e0, 0.5e0, 0.75e0, 1e0]) AS fraction FROM {src});;
    fr AS (SELECT *, s AS frac_position FROM fq QUALIFY row_number() OVER (PARTITION BY {key}, fraction ORDER BY abs(s - s0 - fraction * len), seq) = 1);; """


@query("lane_metrics", f"shot_id || fraction frac_position {M6}", "roll", _profile("roll", "shot_id") + _fractions("pf", "shot_id") + "SELECT * FROM fr")
def _(t):
    return ev.lane_metrics(t.roll())


@query("lane_metrics_cubic", f"shot_id || fraction frac_position {M6}", "roll", cubic_steps("roll") + _profile("cu", "shot_id") + _fractions("pf", "shot_id") + "SELECT * FROM fr")
def _(t):
    return ev.lane_metrics(t.roll(), "cubic")


@query("lane_summary", "shot_id primary_axis reversed || total_break end_speed", "wobble", "rv AS (SELECT * REPLACE (CASE WHEN shot_id % 2 = 0 THEN y_m ELSE 18 - y_m END AS y_m) FROM wobble);; " + _profile("rv", "shot_id") + """
    SELECT shot_id, any_value(primary_axis) AS primary_axis, any_value(CASE WHEN rev THEN 1 ELSE 0 END) AS reversed, abs(arg_max(l, seq) - arg_min(l, seq)) AS total_break, arg_max(speed, seq) AS end_speed FROM pf GROUP BY 1""")
def _(t):
    v = t.wobble().withColumn("y_m", F.when(F.col("shot_id") % 2 == 0, F.col("y_m")).otherwise(18 - F.col("y_m")))
    return ev.lane_summary(v).withColumn("reversed", F.col("trajectory_reversed").cast("int"))


_TRUTH = "tv AS (SELECT episode_idx, frame_index AS seq, lane_s AS s, y AS l, min(lane_s) OVER (PARTITION BY episode_idx) AS s0, max(lane_s) OVER (PARTITION BY episode_idx) - min(lane_s) OVER (PARTITION BY episode_idx) AS len FROM pairs);; " + \
    _grad("tv", "h1", {"s": "vel_s", "l": "vel_l"}, "episode_idx", "seq", "(1e0 / 30e0)") + _grad("h1", "h2", {"vel_s": "acc_s", "vel_l": "acc_l"}, "episode_idx", "seq", "(1e0 / 30e0)") + \
    "tf AS (SELECT *, sqrt(vel_s * vel_s + vel_l * vel_l) AS speed, sqrt(acc_s * acc_s + acc_l * acc_l) AS accel_mag FROM h2);; "


def _truth(t):
    return t.pairs().select("episode_idx", F.col("frame_index").alias("global_frame_idx"), "lane_s", "y")


@query("truth_metrics", f"episode_idx || fraction frac_position {M6}", "pairs", _TRUTH + _fractions("tf", "episode_idx") + "SELECT * FROM fr")
def _(t):
    return ev.truth_metrics(_truth(t))[0]


@query("truth_summary", "episode_idx || total_break end_speed", "pairs", _TRUTH + "SELECT episode_idx, abs(arg_max(l, seq) - arg_min(l, seq)) AS total_break, arg_max(speed, seq) AS end_speed FROM tf GROUP BY 1")
def _(t):
    return ev.truth_metrics(_truth(t))[1]


@query("join_ground_truth", "episode_idx frame_index || lane_s", "pairs traj", """
    p AS (SELECT DISTINCT shot_id AS episode_idx, frame_index + cents % 2 AS frame_index FROM traj);; m AS (SELECT pairs.* FROM p JOIN pairs USING (episode_idx, frame_index));;
    SELECT episode_idx, frame_index, lane_s FROM m WHERE episode_idx IN (SELECT episode_idx FROM m GROUP BY 1 HAVING count(*) >= 4)""")
def _(t):
    # every other prediction is a frame late, so that only some meet the truth
    pred = t.traj().select(F.col("shot_id").alias("episode_idx"), (F.col("frame_index") + F.col("cents") % 2).cast("int").alias("frame_index")).distinct()
    return ev.join_ground_truth(pred, _truth(t))


_CAL = """cal AS (SELECT episode_idx, regr_slope(lane_s, s_bev) AS a_s, regr_intercept(lane_s, s_bev) AS b_s, regr_slope(y, l_bev) AS a_l, regr_intercept(y, l_bev) AS b_l FROM pairs GROUP BY 1);; """


@query("calibrate", "episode_idx matches poor_fit || a_s b_s rmse_s a_l b_l rmse_l", "pairs", _CAL + """
    r AS (SELECT episode_idx, any_value(a_s) AS a_s, any_value(b_s) AS b_s, any_value(a_l) AS a_l, any_value(b_l) AS b_l, sqrt(avg((lane_s - a_s * s_bev - b_s) ** 2)) AS rmse_s, sqrt(avg((y - a_l * l_bev - b_l) ** 2)) AS rmse_l, count(*) AS matches FROM pairs JOIN cal USING (episode_idx) GROUP BY 1);;
    SELECT *, CASE WHEN rmse_s > 1 OR rmse_l > 0.5e0 THEN 1 ELSE 0 END AS poor_fit FROM r""")
def _(t):
    return ev.calibrate(t.pairs()).withColumn("poor_fit", F.col("poor_fit").cast("int"))


@query("best_axis", "episode_idx | axis | a b mae", "pairs", """
    c AS (SELECT episode_idx, regr_slope(lane_s, x_m) AS ax, regr_intercept(lane_s, x_m) AS bx, regr_slope(lane_s, y_m) AS ay, regr_intercept(lane_s, y_m) AS bb FROM pairs GROUP BY 1);;
    e AS (SELECT episode_idx, any_value(ax) AS ax, any_value(bx) AS bx, any_value(ay) AS ay, any_value(bb) AS bb, avg(abs(ax * x_m + bx - lane_s)) AS mx, avg(abs(ay * y_m + bb - lane_s)) AS my FROM pairs JOIN c USING (episode_idx) GROUP BY 1);;
    SELECT episode_idx, CASE WHEN mx <= my THEN 'x' ELSE 'y' END AS axis, CASE WHEN mx <= my THEN ax ELSE ay END AS a, CASE WHEN mx <= my THEN bx ELSE bb END AS b, least(mx, my) AS mae FROM e""")
def _(t):
    return ev.best_axis(t.pairs(), x="x_m", y="y_m", target="lane_s")


@query("residual_summary", "episode_idx || mean_abs p75_abs p95_abs max_abs", "pairs", """
    SELECT episode_idx, avg(abs(lane_s - s_bev)) AS mean_abs, quantile_cont(abs(lane_s - s_bev), 0.75) AS p75_abs, quantile_cont(abs(lane_s - s_bev), 0.95) AS p95_abs, max(abs(lane_s - s_bev)) AS max_abs FROM pairs GROUP BY 1""")
def _(t):
    return ev.residual_summary(t.pairs().withColumn("r", F.col("lane_s") - F.col("s_bev")), "r")


_LM = _profile("pairs", "episode_idx").replace("o1 AS (SELECT *,", "o1 AS (SELECT * EXCLUDE (lane_s, y, s_bev, l_bev),") + _fractions("pf", "episode_idx")
_CONV = _CAL + _LM + """cv AS (SELECT episode_idx, fraction, frac_position * abs(a_s) AS frac_position, vel_s * abs(a_s) AS vel_s, vel_l * abs(a_l) AS vel_l, acc_s * abs(a_s) AS acc_s, acc_l * abs(a_l) AS acc_l FROM fr JOIN cal USING (episode_idx));;
    cm AS (SELECT *, sqrt(vel_s * vel_s + vel_l * vel_l) AS speed, sqrt(acc_s * acc_s + acc_l * acc_l) AS accel_mag FROM cv);; """


@query("convert_metrics", f"episode_idx || fraction frac_position {M6}", "pairs", _CONV + "SELECT * FROM cm")
def _(t):
    p = t.pairs()
    return ev.convert_metrics(ev.lane_metrics(p, keys=["episode_idx"]), ev.calibrate(p))


@query("bev_rmse", "episode_idx || bev_x_rmse bev_y_rmse bev_total_rmse", "pairs", _CAL + """
    e AS (SELECT episode_idx, x_m - (y - b_l) / a_l AS dx, y_m - (lane_s - b_s) / a_s AS dy FROM pairs JOIN cal USING (episode_idx));;
    SELECT episode_idx, sqrt(avg(dx * dx)) AS bev_x_rmse, sqrt(avg(dy * dy)) AS bev_y_rmse, sqrt(avg(dx * dx + dy * dy)) AS bev_total_rmse FROM e GROUP BY 1""")
def _(t):
    p = t.pairs()
    return ev.bev_rmse(p.withColumn("primary_axis", F.lit(1)), ev.calibrate(p), x="x_m", y="y_m")


@query("median_speed_check", "episode_idx agrees || median_pred median_truth", "pairs traj", _TRUTH + """
    d AS (SELECT shot_id AS episode_idx, sqrt(pow(x_m - lag(x_m) OVER w, 2) + pow(y_m - lag(y_m) OVER w, 2)) / greatest(timestamp_s - lag(timestamp_s) OVER w, 1e-6) AS v FROM traj WINDOW w AS (PARTITION BY shot_id ORDER BY frame_index));;
    a AS (SELECT episode_idx, quantile_cont(v, 0.5) AS median_pred FROM d GROUP BY 1);; b AS (SELECT episode_idx, quantile_cont(speed, 0.5) AS median_truth FROM tf GROUP BY 1);;
    SELECT *, CASE WHEN abs(median_pred - median_truth) < 1 THEN 1 ELSE 0 END AS agrees FROM a JOIN b USING (episode_idx)""")
def _(t):
    pred = sq.finite_diff(t.traj()).select(F.col("shot_id").alias("episode_idx"), F.col("speed_mps").alias("speed"))
    w = _truth(t).withColumn("seq", F.col("global_frame_idx")).withColumn("s", F.col("lane_s")).withColumn("l", F.col("y"))
    truth = ev._with_motion(w, F.lit(1.0 / 30.0), ["episode_idx"], "s", "l", "seq")
    return ev.median_speed_check(pred, truth).withColumn("agrees", F.col("agrees").cast("int"))


# evaluation rows straight from grouped measurements
_SPREAD = {"vel_s": 1.0, "vel_l": 0.5, "speed": 2.0, "acc_s": -1.0, "acc_l": 0.25, "accel_mag": 3.0}
_ERRS = "er AS (SELECT p.interpolation_mode, p.episode_idx, p.fraction, " + ", ".join(f"p.m * {k} - t.m AS {m}_error" for m, k in _SPREAD.items()) + " FROM evalp p JOIN evalt t USING (episode_idx, fraction));; " \
    "ep AS (SELECT p.interpolation_mode, p.episode_idx, avg(p.m) * 0.5e0 - avg(t.m) AS total_break_error, max(p.m) - max(t.m) AS end_speed_error FROM evalp p JOIN evalt t USING (episode_idx, fraction) GROUP BY ALL);; "


def _spread(df):
    return df.select(*[c for c in df.columns if c != "m"], *[(F.col("m") * k).alias(n) for n, k in _SPREAD.items()], F.col("m").alias("frac_position"))


def _errors(t):
    truth = t.evalt().select("episode_idx", "fraction", *[F.col("m").alias(n) for n in _SPREAD])
    return ev.fraction_errors(_spread(t.evalp()), truth)


def _ep_errors(t):
    both = t.evalp().join(t.evalt().withColumnRenamed("m", "tm"), ["episode_idx", "fraction"]).groupBy("interpolation_mode", "episode_idx").agg(
        (F.avg("m") * 0.5).alias("total_break"), F.max("m").alias("end_speed"), F.avg("tm").alias("t_break"), F.max("tm").alias("t_end"))
    pred = both.select("interpolation_mode", "episode_idx", "total_break", "end_speed")
    # the truth depends on which fractions a mode has, so it is compared mode by mode
    truth = both.select("interpolation_mode", "episode_idx", F.col("t_break").alias("total_break"), F.col("t_end").alias("end_speed"))
    return ev.episode_errors(pred.withColumn("k", F.col("interpolation_mode")), truth.withColumnRenamed("interpolation_mode", "k"), ["episode_idx", "k"])


_E8 = [f"{m}_error" for m in _SPREAD] + ["total_break_error", "end_speed_error"]


@query("fraction_errors", f"episode_idx | interpolation_mode | fraction {' '.join(_E8[:6])}", "evalp evalt", _ERRS + "SELECT * FROM er")
def _(t):
    return _errors(t)


@query("episode_errors", "episode_idx | interpolation_mode | total_break_error end_speed_error", "evalp evalt", _ERRS + "SELECT * FROM ep")
def _(t):
    return _ep_errors(t)


_SUMM = _ERRS + "sm AS (" + " UNION ALL ".join(
    f"SELECT a.interpolation_mode, '{stat}' AS fraction, " + ", ".join(f"{c} AS pred_{c[:-6]}" for c in _E8) + f" FROM (SELECT interpolation_mode, {', '.join(f'avg({fn.format(c)}) AS {c}' for c in _E8[:6])} FROM er GROUP BY 1) a JOIN (SELECT interpolation_mode, {', '.join(f'avg({fn.format(c)}) AS {c}' for c in _E8[6:])} FROM ep GROUP BY 1) b USING (interpolation_mode)"
    for stat, fn in (("averages", "{}"), ("mae", "abs({})"))) + ");; "


@query("error_summary", "| interpolation_mode fraction | " + " ".join(f"pred_{c[:-6]}" for c in _E8), "evalp evalt", _SUMM + "SELECT * FROM sm")
def _(t):
    return ev.error_summary(_errors(t), _ep_errors(t))


@query("fraction_error_profile", "|| fraction speed_error accel_mag_error", "evalp evalt", _ERRS + """
    f AS (SELECT * FROM er QUALIFY row_number() OVER (PARTITION BY interpolation_mode, fraction ORDER BY episode_idx) = 1);; SELECT fraction, avg(abs(speed_error)) AS speed_error, avg(abs(accel_mag_error)) AS accel_mag_error FROM f GROUP BY 1""")
def _(t):
    return ev.fraction_error_profile(_errors(t))


@query("headline_metrics", "|| speed_error accel_mag_error total_break_error end_speed_error", "evalp evalt", _SUMM + """
    SELECT avg(abs(pred_speed)) AS speed_error, avg(abs(pred_accel_mag)) AS accel_mag_error, avg(abs(pred_total_break)) AS total_break_error, avg(abs(pred_end_speed)) AS end_speed_error FROM sm WHERE fraction = 'mae'""")
def _(t):
    return ev.headline_metrics(ev.error_summary(_errors(t), _ep_errors(t)))


@query("average_trajectory", "shot_id idx runs || x_mean y_mean x_std y_std", "traj roll wobble", """
    a AS (SELECT 'a' AS r, shot_id, row_number() OVER (PARTITION BY shot_id ORDER BY frame_index) - 1 AS idx, x_m, y_m FROM traj UNION ALL SELECT 'b', shot_id, row_number() OVER (PARTITION BY shot_id ORDER BY frame_index) - 1, x_m, y_m FROM roll
      UNION ALL SELECT 'c', shot_id, row_number() OVER (PARTITION BY shot_id ORDER BY frame_index) - 1, x_m, y_m FROM wobble WHERE cents > 5000);;
    m AS (SELECT shot_id, min(n) AS mn FROM (SELECT shot_id, r, count(*) AS n FROM a GROUP BY ALL) GROUP BY 1);;
    SELECT shot_id, idx, avg(x_m) AS x_mean, avg(y_m) AS y_mean, stddev_pop(x_m) AS x_std, stddev_pop(y_m) AS y_std, count(*) AS runs FROM a JOIN m USING (shot_id) WHERE idx < mn GROUP BY ALL""")
def _(t):
    w = Window.partitionBy("shot_id").orderBy("frame_index")
    one = lambda df, r: df.select("shot_id", F.lit(r).alias("interpolation_mode"), (F.row_number().over(w) - 1).alias("idx"), "x_m", "y_m")
    return ev.average_trajectory(one(t.traj(), "a").unionByName(one(t.roll(), "b")).unionByName(one(t.wobble().where("cents > 5000"), "c")))


@query("stage_diagnostics", "shot_id raw_count trimmed_count smoothed_count final_count first_frame last_frame largest_gap in_bounds head_frame tail_frame || x_min x_max y_min y_max", "wobble", _FULL + """
    kp AS (SELECT * FROM t2 WHERE i >= a4 AND i < b5);; kc AS (SELECT shot_id, count(*) AS n, max(frame_index) - min(frame_index) + 1 AS dense FROM kp GROUP BY 1);;
    rk AS (SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY frame_index) AS ra, row_number() OVER (PARTITION BY shot_id ORDER BY frame_index DESC) AS rd FROM o);;
    SELECT shot_id, count(*) AS raw_count, max(kc.n) AS trimmed_count, max(dense) AS smoothed_count, max(dense) AS final_count, min(frame_index) AS first_frame, max(frame_index) AS last_frame, coalesce(max(g), 0) AS largest_gap,
      count(CASE WHEN inb THEN 1 END) AS in_bounds, max(CASE WHEN ra = least(4, m) THEN frame_index END) AS head_frame, min(CASE WHEN rd = least(4, m) THEN frame_index END) AS tail_frame, min(x_m) AS x_min, max(x_m) AS x_max, min(y_m) AS y_min, max(y_m) AS y_max
    FROM (SELECT *, count(*) OVER (PARTITION BY shot_id) AS m FROM rk) JOIN kc USING (shot_id) GROUP BY 1""")
def _(t):
    raw = t.wobble()
    kept = tr.trim_detections(raw)
    dense = sm.densify_linear(kept)
    d = ev.stage_diagnostics(raw, kept, dense, dense)
    return d.withColumn("head_frame", F.element_at("head", -1)["frame_index"]).withColumn("tail_frame", F.get("tail", F.lit(0))["frame_index"])


@query("accuracy", "total || accuracy", "", "SELECT CAST(count(CASE WHEN quality = toxic THEN 1 END) AS DOUBLE) / greatest(count(*), 1) AS accuracy, count(*) AS total FROM labels")
def _(t):
    return ev.accuracy(t.table("labels"), "quality", "toxic")


# all modes at once: a profile's key is its episode and its mode
_MODES = "CASE ek % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'linear' ELSE 'cubic' END AS interpolation_mode"
_EVAL_ALL = linear_steps("pairs", "episode_idx") + cubic_steps("pairs", "episode_idx") + """em AS (SELECT episode_idx * 3 AS ek, timestamp_s, x_m, y_m FROM pairs
      UNION ALL SELECT episode_idx * 3 + 1, timestamp_s, x_m, y_m FROM li UNION ALL SELECT episode_idx * 3 + 2, timestamp_s, x_m, y_m FROM cu);; """ + _profile("em", "ek") + _fractions("pf", "ek") + _TRUTH + """
    tq AS (SELECT *, unnest([0.25e0, 0.5e0, 0.75e0, 1e0]) AS fraction FROM tf);;
    tm AS (SELECT * FROM tq QUALIFY row_number() OVER (PARTITION BY episode_idx, fraction ORDER BY abs(s - s0 - fraction * len), seq) = 1);;
    ts AS (SELECT episode_idx, abs(arg_max(l, seq) - arg_min(l, seq)) AS tb, arg_max(speed, seq) AS te FROM tf GROUP BY 1);;
    fx AS (SELECT episode_idx, regr_slope(lane_s, x_m) AS xs, regr_slope(lane_s, y_m) AS ys, regr_slope(y, x_m) AS xl, regr_slope(y, y_m) AS yl FROM pairs GROUP BY 1 HAVING count(*) >= 4);;
    pe AS (SELECT ek, ek // 3 AS episode_idx, any_value(primary_axis) AS pa, abs(arg_max(l, seq) - arg_min(l, seq)) AS pb, arg_max(speed, seq) AS pe FROM pf GROUP BY 1);;
    ee AS (SELECT ek, episode_idx, abs(CASE WHEN pa = 0 THEN xs ELSE ys END) AS a, abs(CASE WHEN pa = 0 THEN yl ELSE xl END) AS b, pb * b - tb AS total_break_error, pe * a - te AS end_speed_error
      FROM pe JOIN fx USING (episode_idx) JOIN ts USING (episode_idx));;
    wr AS (SELECT ee.*, fraction, vel_s * a AS vel_s, vel_l * b AS vel_l, sqrt(pow(vel_s * a, 2) + pow(vel_l * b, 2)) AS speed, acc_s * a AS acc_s, acc_l * b AS acc_l, sqrt(pow(acc_s * a, 2) + pow(acc_l * b, 2)) AS accel_mag FROM fr JOIN ee USING (ek));;
    er AS (SELECT """ + _MODES + ", wr.episode_idx, wr.fraction, " + ", ".join(f"wr.{m} - tm.{m} AS {m}_error" for m in _SPREAD) + """ FROM wr JOIN tm USING (episode_idx, fraction));;
    ep AS (SELECT """ + _MODES + ", episode_idx, total_break_error, end_speed_error FROM ee);; "


def _evaluated(t):
    return jobs.evaluate(t.pairs().select("episode_idx", "frame_index", "timestamp_s", "x_m", "y_m"), _truth(t))


@query("evaluate_summary", "| interpolation_mode fraction | " + " ".join(f"pred_{c[:-6]}" for c in _E8), "pairs", _EVAL_ALL + _SUMM.removeprefix(_ERRS) + "SELECT * FROM sm")
def _(t):
    return _evaluated(t).summary


@query("evaluate_episodes", "episode_idx | interpolation_mode | total_break_error end_speed_error", "pairs", _EVAL_ALL + "SELECT * FROM ep")
def _(t):
    return _evaluated(t).episodes


@query("evaluate_fractions_modes", f"episode_idx | interpolation_mode | fraction {' '.join(_E8[:6])}", "pairs", _EVAL_ALL + "SELECT * FROM er")
def _(t):
    return _evaluated(t).fractions


_EVAL_NONE = _CONV + _TRUTH + """tq AS (SELECT *, unnest([0.25e0, 0.5e0, 0.75e0, 1e0]) AS fraction FROM tf);;
    tm AS (SELECT * FROM tq QUALIFY row_number() OVER (PARTITION BY episode_idx, fraction ORDER BY abs(s - s0 - fraction * len), seq) = 1);; """


@query("evaluate_fractions", f"episode_idx | interpolation_mode | fraction {' '.join(_E8[:6])}", "pairs", _EVAL_NONE + "SELECT cm.episode_idx, 'none' AS interpolation_mode, cm.fraction, " + ", ".join(f"cm.{m} - tm.{m} AS {m}_error" for m in _SPREAD) + " FROM cm JOIN tm USING (episode_idx, fraction)")
def _(t):
    return jobs.evaluate(t.pairs().select("episode_idx", "frame_index", "timestamp_s", "x_m", "y_m"), _truth(t), modes=("none",)).fractions


# ---- label sets ------------------------------------------------------------

_STEM = r"""fs AS (SELECT path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\.[^.]+$', '\1') AS b FROM files);;
    fk AS (SELECT path, split_part(b, '_', 1) || '_' || split_part(b, '_', 2) AS st0, CASE WHEN b LIKE '%instance_segmentation_semantics_mapping' THEN 'instance_semantics' WHEN b LIKE '%semantic_segmentation_labels' THEN 'semantic_labels' WHEN b LIKE '%rgb' THEN 'rgb' WHEN b LIKE '%instance%' THEN 'instance' ELSE 'semantic' END AS kind FROM fs);;
    ft AS (SELECT path, kind, st0 || CASE WHEN kind = 'rgb' THEN '_' ELSE '_' END AS stem FROM fk);; """


@query("classify_files", "| path kind stem", "files", _STEM + "SELECT path, kind, stem FROM ft")
def _(t):
    return ds.classify_files(t.files())


@query("bundle_frames", "| stem rgb instance semantic instance_semantics semantic_labels", "files", _STEM + """
    SELECT stem, min(CASE WHEN kind = 'rgb' THEN path END) AS rgb, min(CASE WHEN kind = 'instance' THEN path END) AS instance, min(CASE WHEN kind = 'semantic' THEN path END) AS semantic, min(CASE WHEN kind = 'instance_semantics' THEN path END) AS instance_semantics,
      min(CASE WHEN kind = 'semantic_labels' THEN path END) AS semantic_labels FROM ft GROUP BY 1 HAVING count(DISTINCT CASE WHEN kind IN ('rgb', 'instance', 'semantic') THEN kind END) = 3""")
def _(t):
    return ds.bundle_frames(t.files())


@query("common_stems", "| stem", "files", _STEM + "SELECT stem FROM ft WHERE kind IN ('rgb', 'instance', 'semantic') GROUP BY 1 HAVING count(DISTINCT kind) = 3")
def _(t):
    c = ds.classify_files(t.files())
    return ds.common_stems(*[c.where(F.col("kind") == k) for k in ("rgb", "instance", "semantic")])


def _colour():
    i = F.col("event_id")
    return F.when(i % 11 == 0, "0,0,0,255").otherwise(F.concat_ws(",", (i % 50).cast("string"), (i % 3).cast("string"), F.lit("7"), F.lit("255")))


_COL = "CASE WHEN event_id % 11 = 0 THEN '0,0,0,255' ELSE CAST(event_id % 50 AS VARCHAR) || ',' || CAST(event_id % 3 AS VARCHAR) || ',7,255' END"
_PIX = f"px AS (SELECT 's' || CAST(user_id AS VARCHAR) AS stem, {_COL} AS colour, CAST(value AS BIGINT) % 6 AS semantic_id FROM events);; "
_MAJ = _PIX + "vt AS (SELECT stem, colour, semantic_id FROM (SELECT stem, colour, semantic_id, row_number() OVER (PARTITION BY stem, colour ORDER BY count(*) DESC, semantic_id) AS r FROM px WHERE semantic_id NOT IN (0, 1) GROUP BY stem, colour, semantic_id) WHERE r = 1);; "


def _pixels(t):
    # DuckDB rounds a double cast to whole numbers, Spark cuts it
    return t.table("events").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("stem"), _colour().alias("colour"), (F.rint("value").cast("long") % 6).cast("int").alias("semantic_id"))


@query("majority_semantic", "semantic_id | stem colour", "", _MAJ + "SELECT * FROM vt")
def _(t):
    return ds.majority_semantic(_pixels(t))


@query("drop_background", "| stem colour", "", _PIX + "SELECT DISTINCT stem, colour FROM px WHERE colour NOT IN ('0,0,0,0', '0,0,0,255')")
def _(t):
    return ds.drop_background(_pixels(t).select("stem", "colour").distinct())


def _mappings(t):
    """Per stem one colour document and one id document, as the renderer writes them."""
    stems = _pixels(t).select("stem").distinct()
    colour = F.lit('{"(5, 2, 7, 255)": {"class": "Lane, floor"}, "(6, 0, 7, 255)": "sphere", "(7, 1, 7, 255)": {"class": ""}, "(8, 2, 7, 255)": "wall"}')
    ids = F.lit('{"2": {"class": "lane"}, "3": "ball,shiny", "4": {"class": "pins"}}')
    m = ds.parse_class_mapping(stems.withColumn("mapping_json", colour))
    return m, ds.parse_class_mapping(stems.withColumn("mapping_json", ids))


@query("parse_class_mapping", "is_colour | stem key class_name", "", """
    s AS (SELECT DISTINCT 's' || CAST(user_id AS VARCHAR) AS stem FROM events);;
    k AS (SELECT unnest(['5,2,7,255', '6,0,7,255', '7,1,7,255', '8,2,7,255', '2', '3', '4']) AS key, unnest(['Lane, floor', 'sphere', '', 'wall', 'lane', 'ball,shiny', 'pins']) AS class_name, unnest([1, 1, 1, 1, 0, 0, 0]) AS is_colour);; SELECT * FROM s CROSS JOIN k""")
def _(t):
    a, b = _mappings(t)
    return a.unionByName(b).withColumn("is_colour", F.col("is_colour").cast("int"))


_CLS = _MAJ + """oj AS (SELECT DISTINCT stem, colour FROM px);;
    rc AS (SELECT oj.stem, oj.colour, coalesce(CASE oj.colour WHEN '5,2,7,255' THEN 'Lane, floor' WHEN '6,0,7,255' THEN 'sphere' WHEN '8,2,7,255' THEN 'wall' END, CASE semantic_id WHEN 2 THEN 'lane' WHEN 3 THEN 'ball,shiny' WHEN 4 THEN 'pins' END) AS class_name FROM oj LEFT JOIN vt USING (stem, colour));; """


def _objects(t):
    return _pixels(t).select("stem", "colour").distinct()


@query("resolve_classes", "| stem colour class_name", "", _CLS + "SELECT * FROM rc")
def _(t):
    a, b = _mappings(t)
    return ds.resolve_classes(_objects(t), a, ds.majority_semantic(_pixels(t)), b)


_KEEP = _CLS + "kc AS (SELECT stem, colour, CASE class_name WHEN 'Lane, floor' THEN 0 WHEN 'lane' THEN 0 WHEN 'sphere' THEN 1 WHEN 'ball,shiny' THEN 1 END AS class_id FROM rc WHERE class_name IN ('Lane, floor', 'lane', 'sphere', 'ball,shiny'));; "


@query("keep_classes", "class_id | stem colour", "", _KEEP + "SELECT * FROM kc")
def _(t):
    a, b = _mappings(t)
    return ds.keep_classes(ds.resolve_classes(_objects(t), a, ds.majority_semantic(_pixels(t)), b))


@query("drop_small", "det_id", "quads", "SELECT det_id FROM quads WHERE abs((tlx * try - trx * tly) + (trx * bry - brx * try) + (brx * bly - blx * bry) + (blx * tly - tlx * bly)) / 2 >= 2500")
def _(t):
    return ds.drop_small(t.quads(), min_area=2500.0)


@query("build_label_set", "objects | stem label_text error", "", _KEEP + """
    sz AS (SELECT stem, colour, class_id, CAST(split_part(colour, ',', 1) AS BIGINT) AS r, CAST(split_part(colour, ',', 2) AS BIGINT) AS g FROM kc WHERE colour <> '0,0,0,255');;
    tx AS (SELECT stem, count(*) AS objects, string_agg(CAST(class_id AS VARCHAR) || printf(' %.6f %.6f %.6f 0.100000 %.6f 0.500000', r / 64e0, g / 32e0, (r + 8) / 64e0, (r + 8) / 64e0), chr(10) ORDER BY r, g) || chr(10) AS label_text FROM sz GROUP BY 1);;
    st AS (SELECT DISTINCT stem FROM px);; SELECT stem, coalesce(objects, 0) AS objects, coalesce(label_text, '') AS label_text, CAST(NULL AS VARCHAR) AS error FROM st LEFT JOIN tx USING (stem)""")
def _(t):
    a, b = _mappings(t)
    rg = F.split("colour", ",")
    r, g = F.get(rg, F.lit(0)).cast("double"), F.get(rg, F.lit(1)).cast("double")
    poly = F.array(G.point(r, g), G.point(r + 8, F.lit(3.2)), G.point(r + 8, F.lit(16.0)))
    objs = _objects(t).select("stem", "colour", F.lit(0).alias("contour_no"), poly.alias("polygon"), F.lit(64).alias("width"), F.lit(32).alias("height"))
    return ds.build_label_set(_objects(t).select("stem").distinct(), objs, a, ds.majority_semantic(_pixels(t)), b)


def _lines(t):
    q = t.quads().withColumn("polygon", G.normalise_polygon(F.col("polygon"), "width", "height"))
    return q.select(
        F.concat(F.lit("f"), F.col("shot_id").cast("string"), F.lit("x"), F.col("frame_index").cast("string")).alias("image"), F.col("det_id").alias("line_no"),
        ds.label_line((F.col("det_id") % 2).cast("int"), F.col("polygon")).alias("line"))


_LBL = f"""lb AS (SELECT 'f' || CAST(shot_id AS VARCHAR) || 'x' || CAST(frame_index AS VARCHAR) AS image, det_id AS object_no, det_id % 2 AS class_id, CAST(printf('%.6f', tlx / {WIDTH}) AS DOUBLE) AS x0, CAST(printf('%.6f', bly / {HEIGHT}) AS DOUBLE) AS y3 FROM quads);; """


@query("parse_labels_all", "object_no class_id points | image | x0 y3", "quads", _LBL + "SELECT *, 4 AS points FROM lb")
def _(t):
    p = ds.parse_labels(_lines(t), min_coords=8)
    return p.select("image", "object_no", "class_id", F.size("polygon").alias("points"), F.get("polygon", F.lit(0))["x"].alias("x0"), F.get("polygon", F.lit(3))["y"].alias("y3"))


@query("parse_labels_last", "object_no class_id | image | x0 y3", "quads", _LBL + "SELECT * FROM lb QUALIFY row_number() OVER (PARTITION BY image, class_id ORDER BY object_no DESC) = 1")
def _(t):
    p = ds.parse_labels(_lines(t), keep="last_per_class", min_coords=8)
    return p.select("image", "object_no", "class_id", F.get("polygon", F.lit(0))["x"].alias("x0"), F.get("polygon", F.lit(3))["y"].alias("y3"))


_SPLIT = "nm AS (SELECT DISTINCT url FROM pages);; rn AS (SELECT url, row_number() OVER (ORDER BY url) AS r, count(*) OVER () AS n FROM nm);; sp AS (SELECT page_id, CASE WHEN r <= floor(n * 0.8e0) THEN 'train' ELSE 'val' END AS split FROM pages JOIN rn USING (url));; "


@query("split_dataset", "page_id | split", "", _SPLIT + "SELECT * FROM sp")
def _(t):
    return ds.split_dataset(t.table("pages").select("page_id", F.col("url").alias("name")), 0.8)


@query("dataset_stats", "images | split", "", _SPLIT + "SELECT split, count(*) AS images FROM sp GROUP BY 1")
def _(t):
    return ds.dataset_stats(ds.split_dataset(t.table("pages").select("page_id", F.col("url").alias("name")), 0.8))


@query("episode_ranges", "shot_id episode_idx start_frame end_frame", "one", """
    t AS (SELECT shot_id, frame_index // 240 AS episode_idx, min(frame_index) AS lo, max(frame_index) AS hi FROM one GROUP BY ALL);; h AS (SELECT DISTINCT shot_id, frame_index AS f FROM one WHERE cents > 3000);;
    n AS (SELECT t.shot_id, episode_idx, lo, hi, min(CASE WHEN f BETWEEN lo AND hi THEN f END) AS mn, max(CASE WHEN f BETWEEN lo AND hi THEN f END) AS mx, max(CASE WHEN f = lo THEN 1 ELSE 0 END) AS ata, max(CASE WHEN f = lo - 1 THEN 1 ELSE 0 END) AS pv FROM t LEFT JOIN h USING (shot_id) GROUP BY ALL);;
    g AS (SELECT shot_id, min(f) AS rs, max(f) AS re FROM (SELECT *, f - row_number() OVER (PARTITION BY shot_id ORDER BY f) AS g FROM h) GROUP BY shot_id, g);;
    gi AS (SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY rs) AS i, count(*) OVER (PARTITION BY shot_id) AS runs FROM g);; ei AS (SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY episode_idx) AS i, count(*) OVER (PARTITION BY shot_id) AS eps FROM n);;
    SELECT ei.shot_id, episode_idx, CASE WHEN runs = eps THEN rs WHEN ata = 0 AND pv = 1 THEN lo - 1 ELSE coalesce(mn, hi + 1) END AS start_frame, CASE WHEN runs = eps THEN re ELSE coalesce(mx, CASE WHEN ata = 0 AND pv = 1 THEN lo - 1 ELSE hi END) END AS end_frame FROM ei LEFT JOIN gi ON gi.shot_id = ei.shot_id AND gi.i = ei.i""")
def _(t):
    o = t.one()
    truth = o.select("shot_id", F.expr("cast(frame_index div 240 as int)").alias("episode_idx"), F.col("frame_index").alias("global_frame_idx"))
    return ds.episode_ranges(truth, o.where("cents > 3000"), keys=["shot_id"])


@query("training_summary", "best_map50_epoch best_map50_95_epoch || final_train_box_loss final_val_box_loss final_train_cls_loss final_val_cls_loss final_map50 final_map50_95 best_map50 best_map50_95", "history", """
    SELECT arg_max(train_box_loss, epoch) AS final_train_box_loss, arg_max(val_box_loss, epoch) AS final_val_box_loss, arg_max(train_cls_loss, epoch) AS final_train_cls_loss, arg_max(val_cls_loss, epoch) AS final_val_cls_loss, arg_max(map50, epoch) AS final_map50, arg_max(map50_95, epoch) AS final_map50_95,
      max(map50) AS best_map50, max(map50_95) AS best_map50_95, (SELECT epoch + 1 FROM history ORDER BY map50 DESC, epoch LIMIT 1) AS best_map50_epoch, (SELECT epoch + 1 FROM history ORDER BY map50_95 DESC, epoch LIMIT 1) AS best_map50_95_epoch FROM history""")
def _(t):
    return ds.training_summary(t.history())


@query("top_trials", "o_orderkey || objective", "", "SELECT o_orderkey, o_totalprice AS objective FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def _(t):
    return ds.top_trials(t.table("orders").withColumn("objective", F.col("o_totalprice")), 5, tie="o_orderkey")


@query("top_checkpoints", "o_custkey step || objective", "", "SELECT o_custkey, o_orderkey AS step, o_totalprice AS objective FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) <= 3")
def _(t):
    c = t.table("orders").select("o_custkey", F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("objective"))
    return ds.top_checkpoints(c, 3, "minimize", ["o_custkey"])


# ---- sinks and sources, written and read back ------------------------------

@query("eval_file", "| interpolation_mode fraction vel_s_error speed_error", "evalp evalt", _ERRS + r"""
    SELECT interpolation_mode, CASE WHEN fraction = 1 THEN '1.0' ELSE CAST(fraction AS VARCHAR) END AS fraction, rtrim(printf('%.6f', vel_s_error), '0') || CASE WHEN printf('%.6f', vel_s_error) LIKE '%.000000' THEN '0' ELSE '' END AS vel_s_error,
      rtrim(printf('%.6f', speed_error), '0') || CASE WHEN printf('%.6f', speed_error) LIKE '%.000000' THEN '0' ELSE '' END AS speed_error FROM er""")
def _(t):
    path = scratch_path(t.spark, "eval")
    wr.write_eval(_errors(t), path)
    return t.spark.read.option("header", True).csv(path)


@query("shot_store", "shot_number points || fps", "traj", "SELECT shot_id AS shot_number, count(*) AS points, 25e0 AS fps FROM traj GROUP BY 1")
def _(t):
    pts = t.traj().groupBy("shot_id").agg(F.collect_list(F.struct(F.col("x_m").alias("x"), F.col("y_m").alias("y"))).alias("ball_positions"))
    rec = lambda fps, ts: pts.select(
        F.lit("a").alias("id"), F.lit(ts).alias("timestamp"), F.lit("laneballs").alias("source"), F.col("shot_id").cast("int").alias("shot_number"), F.lit("v").alias("video_key"), F.lit(fps).alias("fps"),
        "ball_positions", F.array().cast("array<array<struct<joint_id:int,x:double,y:double,z:double>>>").alias("skeleton_frames"))
    path = scratch_path(t.spark, "shots")
    wr.save_shots(rec(30.0, "2026-01-01"), path)
    wr.save_shots(rec(25.0, "2026-01-02"), path)
    return wr.load_shots(t.spark, path).select("shot_number", "fps", F.size("ball_positions").alias("points"))


@query("ground_truth_file", "episode_idx frames || last_s", "pairs", "SELECT episode_idx, count(*) AS frames, max(lane_s) AS last_s FROM pairs GROUP BY 1")
def _(t):
    from shotlane import schemas

    path = scratch_path(t.spark, "truth")
    p = t.pairs().withColumn("global_frame_idx", F.col("frame_index"))
    p.select(*[F.col(c) if c in p.columns else F.lit(0).alias(c) for c in schemas.columns(schemas.GROUND_TRUTH)]).write.option("header", True).csv(path)
    return rd.read_ground_truth(t.spark, path).groupBy("episode_idx").agg(F.count(F.lit(1)).alias("frames"), F.max("lane_s").alias("last_s"))


@query("history_file", "epoch || train_box_loss map50", "history", "SELECT epoch, train_box_loss, map50 FROM history")
def _(t):
    path = scratch_path(t.spark, "history")
    t.history().select(
        F.col("epoch").alias("      epoch"), F.col("train_box_loss").alias("  train/box_loss"), F.col("map50").alias(" metrics/mAP50(B)")).write.option("header", True).csv(path)
    return rd.read_training_history(t.spark, path)


@query("trials_file", "seed | run_dir | objective", "", "SELECT CAST(o_orderkey AS VARCHAR) AS run_dir, o_totalprice AS objective, o_custkey AS seed FROM orders WHERE o_orderstatus <> 'P'")
def _(t):
    path = scratch_path(t.spark, "trials")
    good = F.to_json(F.struct(F.col("o_totalprice").alias("objective"), F.col("o_orderkey").cast("string").alias("run_dir"), F.col("o_custkey").alias("seed")))
    t.table("orders").select(F.when(F.col("o_orderstatus") != "P", good).otherwise("{oops").alias("value")).write.text(path)
    return rd.read_trials(t.spark, path).withColumn("seed", F.col("fields")["seed"].cast("long"))


@query("summary_file", "best_map50_epoch || best_map50", "history", "SELECT max(map50) AS best_map50, (SELECT epoch + 1 FROM history ORDER BY map50 DESC, epoch LIMIT 1) AS best_map50_epoch FROM history")
def _(t):
    path = scratch_path(t.spark, "summary")
    wr.write_summary(ds.training_summary(t.history()), path)
    return t.spark.read.schema("best_map50 double, best_map50_epoch long").json(path)
