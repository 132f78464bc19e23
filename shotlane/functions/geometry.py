"""Box, polygon and homography expressions.

A polygon is ``array<struct<x double, y double>>``; a quad is ordered
tl, tr, br, bl; a homography is ``array<double>`` of length 9, row-major.
Everything here is a Catalyst expression, so it stays inside one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotlane.config import DEFAULT


def _c(v) -> Column:
    return v if isinstance(v, Column) else (F.col(v) if isinstance(v, str) else F.lit(float(v)))


def let(value: Column, fn) -> Column:
    """fn(value) with the value worked out once, however often fn mentions it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def quad(tl, tr, br, bl) -> Column:
    return F.array(*[point(*p) for p in (tl, tr, br, bl)])


def corner(poly: Column, i: int) -> tuple[Column, Column]:
    p = F.get(poly, F.lit(i))
    return p["x"], p["y"]


def trunc(c: Column) -> Column:
    """Cut toward zero, as an integer image coordinate is stored; a whole number short by rounding noise stays whole."""
    return F.when(c < 0, F.ceil(c - 1e-9)).otherwise(F.floor(c + 1e-9)).cast("double")


def trunc_quad(poly: Column) -> Column:
    return F.transform(poly, lambda p: point(trunc(p["x"]), trunc(p["y"])))


# ---- boxes -----------------------------------------------------------------

BOX_FIELDS = {
    "xyxy": ("x0", "y0", "x1", "y1"),
    "xywh": ("x", "y", "w", "h"),
    "cs": ("cx", "cy", "sw", "sh"),
}


def convert_box(box: Column, source: str, target: str, padding: float = 1.0) -> Column:
    """Box struct between corner, corner+size and centre+scale form; padding multiplies the scale."""
    a, b, c, d = (box[f] for f in BOX_FIELDS[source])
    if source == "xyxy":
        x0, y0, w, h = a, b, c - a, d - b
    elif source == "xywh":
        x0, y0, w, h = a, b, c, d
    else:
        w, h = c / F.lit(padding), d / F.lit(padding)
        x0, y0 = a - F.lit(0.5) * w, b - F.lit(0.5) * h
    if target == "xyxy":
        vals = (x0, y0, x0 + w, y0 + h)
    elif target == "xywh":
        vals = (x0, y0, w, h)
    else:
        if source == "cs":
            cx, cy = a, b
        elif source == "xyxy":
            cx, cy = (a + c) * F.lit(0.5), (b + d) * F.lit(0.5)
        else:
            cx, cy = a + c * F.lit(0.5), b + d * F.lit(0.5)
        vals = (cx, cy, w * F.lit(padding), h * F.lit(padding))
    return F.struct(*[v.alias(n) for v, n in zip(vals, BOX_FIELDS[target])])


# ---- polygon measures ------------------------------------------------------

def poly_area(poly: Column) -> Column:
    nxt = F.concat(F.slice(poly, 2, F.size(poly) - 1), F.slice(poly, 1, 1))
    cross = F.zip_with(poly, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / 2.0


def bottom_width(q: Column) -> Column:
    return F.abs(corner(q, 2)[0] - corner(q, 3)[0])


def top_centre_x(q: Column) -> Column:
    return F.lit(0.5) * (corner(q, 0)[0] + corner(q, 1)[0])


def centroid_x(poly: Column) -> Column:
    total = F.aggregate(poly, F.lit(0.0), lambda a, p: a + p["x"])
    return total / F.size(poly)


def order_quad(poly: Column, rule: str = "rows") -> Column:
    """Order four corners tl, tr, br, bl.

    ``rows``: two topmost, then two bottommost, each left to right, cut to integers.
    ``sums``: extremes of x+y and y-x (first corner wins ties).
    """
    if rule == "rows":
        return let(poly, _order_rows)

    def low(key):
        return F.array_min(F.transform(poly, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), p.alias("p"))))["p"]

    def high(key):
        return F.array_max(F.transform(poly, lambda p, i: F.struct(key(p).alias("k"), (-i).alias("i"), p.alias("p"))))["p"]

    picks = [
        low(lambda p: p["x"] + p["y"]),
        low(lambda p: p["y"] - p["x"]),
        high(lambda p: p["x"] + p["y"]),
        high(lambda p: p["y"] - p["x"]),
    ]
    return F.array(*[point(p["x"], p["y"]) for p in picks])


def _order_rows(poly: Column) -> Column:
    by_y = F.array_sort(F.transform(poly, lambda p, i: F.struct(p["y"].alias("y"), i.alias("i"), p["x"].alias("x"))))

    def left_right(pair: Column) -> Column:
        return F.array_sort(F.transform(pair, lambda p, i: F.struct(p["x"].alias("x"), i.alias("i"), p["y"].alias("y"))))

    # each step is worked out once: nothing inside a lambda is shared
    sides = let(by_y, lambda rows: F.array(left_right(F.slice(rows, 1, 2)), left_right(F.slice(rows, 3, 2))))
    picks = let(sides, lambda s: F.array(*[F.get(F.get(s, F.lit(j)), F.lit(i)) for j, i in ((0, 0), (0, 1), (1, 1), (1, 0))]))
    return F.transform(picks, lambda p: point(trunc(p["x"]), trunc(p["y"])))


def point_in_polygon(px: Column, py: Column, poly: Column) -> Column:
    """True inside or on the edge."""
    nxt = F.concat(F.slice(poly, 2, F.size(poly) - 1), F.slice(poly, 1, 1))
    edges = F.zip_with(
        poly, nxt,
        lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")),
    )
    on_edge = F.exists(
        edges,
        lambda e: ((e["bx"] - e["ax"]) * (py - e["ay"]) == (e["by"] - e["ay"]) * (px - e["ax"]))
        & px.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
        & py.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])),
    )
    crossings = F.filter(
        edges,
        lambda e: ((e["ay"] > py) != (e["by"] > py))
        & (px < (e["bx"] - e["ax"]) * (py - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"]),
    )
    return on_edge | (F.size(crossings) % 2 == 1)


def quad_span(corners: list[tuple[Column, Column]], y: Column) -> tuple[Column, Column]:
    """Leftmost and rightmost x of a quad on row ``y``, from plain corner columns; nulls when the row misses it.

    Level edges add nothing: their ends belong to the edges next to them.
    """
    hits = []
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        hits.append(F.when(y.between(F.least(ay, by), F.greatest(ay, by)), ax + (y - ay) * (bx - ax) / F.nullif(by - ay, F.lit(0.0))))
    return F.least(*hits), F.greatest(*hits)


def row_crossings(poly: Column, y: Column, upper: bool) -> Column:
    """Sorted edge crossings of row ``y``; ``upper`` takes edges open at their lower end, else at their upper end."""
    nxt = F.concat(F.slice(poly, 2, F.size(poly) - 1), F.slice(poly, 1, 1))

    def hit(p, q):
        lo, hi = F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"])
        inside = ((lo <= y) & (y < hi)) if upper else ((lo < y) & (y <= hi))
        return F.when(inside, p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)))

    return F.array_sort(F.filter(F.zip_with(poly, nxt, hit), lambda v: v.isNotNull()))


def normalise_polygon(poly: Column, width, height) -> Column:
    w, h = _c(width), _c(height)
    return F.transform(poly, lambda p: point(p["x"] / w, p["y"] / h))


def denormalise_polygon(poly: Column, width, height) -> Column:
    """Normalised polygon to pixel corners: times (size - 1), rounded half to even."""
    w, h = _c(width), _c(height)
    return F.transform(poly, lambda p: point(F.rint(p["x"] * (w - 1.0)), F.rint(p["y"] * (h - 1.0))))


# ---- lane quad plausibility ------------------------------------------------

def valid_vanishing_point(q: Column, h, w) -> Column:
    """The two legs meet above the top-left corner and not absurdly far sideways; parallel legs pass."""
    (tlx, tly), (trx, try_), (brx, bry), (blx, bly) = (corner(q, i) for i in range(4))
    w = _c(w)
    ldx, ldy, rdx, rdy = blx - tlx, bly - tly, brx - trx, bry - try_
    terms = F.array(tlx, tly, ldx, ldy, ldx * rdy - rdx * ldy, (trx - tlx) * rdy - (try_ - tly) * rdx)

    # in steps, each worked out once: written out in full, the code is too long for the JVM to compile
    def passes(v: Column) -> Column:
        x, y, dx, dy, det, over = (v[k] for k in range(6))
        point_ = let(over / F.nullif(det, F.lit(0.0)), lambda t: F.array(x + t * dx, y + t * dy))
        return F.when(F.abs(det) < 1e-6, F.lit(True)).otherwise(let(point_, lambda p: ~((p[1] > y) | (p[0] < -w) | (p[0] > 2 * w))))

    return let(terms, passes)


def geometry_scores(q: Column, h, w) -> Column:
    """Struct of geometry score, width ratio, bottom width and y-span ratio of a lane quad."""
    h, w = _c(h), _c(w)
    return let(q, lambda p: _geometry_scores(p, h, w))


def _geometry_scores(q: Column, h: Column, w: Column) -> Column:
    (tlx, tly), (trx, try_), (brx, bry), (blx, bly) = (corner(q, i) for i in range(4))
    wt, wb = F.abs(trx - tlx), F.abs(brx - blx)
    ratio = wt / F.greatest(wb, F.lit(1.0))
    span = (F.greatest(bry, bly) - F.least(tly, try_)) / F.greatest(h, F.lit(1.0))
    taper = F.when(ratio >= 0.98, F.lit(0.0)).otherwise(1.0 - F.least(F.abs(ratio - 0.45) / 0.45, F.lit(1.0)))
    wide = F.least(wb / F.greatest(0.06 * w, F.lit(1.0)), F.lit(1.0))
    tall = F.least(span / 0.16, F.lit(1.0))
    shift = F.abs(0.5 * (tlx + trx) - 0.5 * (blx + brx)) / F.greatest(wb, F.lit(1.0))
    even = F.greatest(F.lit(0.0), 1.0 - 1.8 * shift)
    vp = F.when(valid_vanishing_point(q, h, w), F.lit(1.0)).otherwise(0.0)
    score = 0.35 * taper + 0.25 * wide + 0.20 * tall + 0.10 * even + 0.10 * vp
    score = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    flat = (wt <= 0.0) | (wb <= 0.0)
    return F.struct(
        F.when(flat, F.lit(0.0)).otherwise(score).alias("geometry_score"),
        F.when(flat, F.lit(999.0)).otherwise(ratio).alias("width_ratio"),
        wb.alias("bottom_width"),
        F.when(flat, F.lit(0.0)).otherwise(span).alias("y_span_ratio"),
    )


def correct_top_corners(q: Column) -> Column:
    """Move each top corner onto the ray from its bottom corner to the vanishing point, keeping its depth."""
    (tlx, tly), (trx, try_), (brx, bry), (blx, bly) = (corner(q, i) for i in range(4))
    # leg lines as homogeneous triples and their meeting point
    l1, l2, l3 = bly - tly, tlx - blx, blx * tly - tlx * bly
    r1, r2, r3 = bry - try_, trx - brx, brx * try_ - trx * bry
    v3 = l1 * r2 - r1 * l2
    safe = F.nullif(v3, F.lit(0.0))
    vx, vy = (l2 * r3 - r2 * l3) / safe, (l3 * r1 - r3 * l1) / safe
    ax, ay, bx, by = vx - blx, vy - bly, vx - brx, vy - bry
    asq, bsq = ax * ax + ay * ay, bx * bx + by * by
    lam_l = ((tlx - blx) * ax + (tly - bly) * ay) / F.nullif(asq, F.lit(0.0))
    lam_r = ((trx - brx) * bx + (try_ - bry) * by) / F.nullif(bsq, F.lit(0.0))
    keep = (
        (F.abs(v3) < 1e-10)
        | (vy > F.least(tly, try_))
        | (asq < 1.0) | (bsq < 1.0)
        | (lam_l <= 0.0) | (lam_l >= 1.0) | (lam_r <= 0.0) | (lam_r >= 1.0)
    )
    moved = quad(
        (blx + lam_l * ax, bly + lam_l * ay), (brx + lam_r * bx, bry + lam_r * by), (brx, bry), (blx, bly)
    )
    return F.when(F.coalesce(keep, F.lit(True)), q).otherwise(moved)


# ---- homography ------------------------------------------------------------

def homography(q: Column, width_m: float = DEFAULT.lane_width_m, length_m: float = DEFAULT.lane_length_m) -> Column:
    """Image quad to lane metres: tl,tr at the far end, bl at the origin.

    The last element is 1, or 0 when the image origin maps to infinity.
    """
    return let(q, lambda p: _homography(p, width_m, length_m))


def _homography(q: Column, width_m: float, length_m: float) -> Column:
    # in steps, each worked out once: projective terms, map of the unit square onto the quad, its adjugate, scale
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = (corner(q, i) for i in range(4))
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    dx1, dx2, dy1, dy2 = x1 - x2, x3 - x2, y1 - y2, y3 - y2
    den = F.nullif(dx1 * dy2 - dx2 * dy1, F.lit(0.0))

    def square(v: Column) -> Column:
        g, h = v[0], v[1]
        return F.array(x1 - x0 + g * x1, x3 - x0 + h * x3, x0, y1 - y0 + g * y1, y3 - y0 + h * y3, y0, g, h)

    def adjugate(v: Column) -> Column:
        a, b, c, d, e, f, g, h = (v[k] for k in range(8))
        return F.array(e - f * h, c * h - b, b * f - c * e, f * g - d, a - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d)

    def lane(m: Column) -> Column:
        w, ln = F.lit(width_m), F.lit(length_m)
        return F.array(*[w * m[k] for k in range(3)], *[ln * (m[k + 3] - m[k]) for k in (3, 4, 5)], m[6], m[7], m[8])

    def scaled(m: Column) -> Column:
        scale = F.when(m[8] != 0.0, m[8]).otherwise(F.nullif(F.greatest(F.abs(m[6]), F.abs(m[7])), F.lit(0.0)))
        return let(scale, lambda s: F.transform(m, lambda v: v / s))

    terms = F.array((sx * dy2 - dx2 * sy) / den, (dx1 * sy - sx * dy1) / den)
    return let(let(let(let(terms, square), adjugate), lane), scaled)


def project(x: Column, y: Column, hm: Column) -> Column:
    """Point through a homography; null when the point maps to infinity."""
    def apply(e: Column) -> Column:
        den = e[6] * x + e[7] * y + e[8]
        return F.when(F.abs(den) >= 1e-9, F.struct(
            ((e[0] * x + e[1] * y + e[2]) / den).alias("x"), ((e[3] * x + e[4] * y + e[5]) / den).alias("y")))

    return let(hm, apply)


def inverse3(hm: Column) -> Column:
    """Adjugate of a 3x3 matrix: the inverse up to scale, which projection ignores."""
    a, b, c, d, e, f, g, h, i = (F.get(hm, F.lit(k)) for k in range(9))
    return F.array(
        e * i - f * h, c * h - b * i, b * f - c * e,
        f * g - d * i, a * i - c * g, c * d - a * f,
        d * h - e * g, b * g - a * h, a * e - b * d,
    )


def determinant(hm: Column) -> Column:
    a, b, c, d, e, f, g, h, i = (F.get(hm, F.lit(k)) for k in range(9))
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def unproject(x: Column, y: Column, hm: Column, width, height) -> Column:
    """Lane metres back to a pixel, held inside the frame.

    The inverse is divided by the determinant, so that the near-zero test means the same as going forward.
    """
    inv = let(hm, lambda m: let(F.nullif(determinant(m), F.lit(0.0)), lambda d: F.transform(inverse3(m), lambda v: v / d)))
    w, h = _c(width), _c(height)
    hold = lambda v, n: F.least(F.greatest(v, F.lit(0.0)), F.greatest(n - 1.0, F.lit(0.0)))
    return let(project(x, y, inv), lambda p: F.when(p.isNotNull(), F.struct(hold(p["x"], w).alias("x"), hold(p["y"], h).alias("y"))))
