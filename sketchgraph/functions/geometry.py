"""Column expressions over boxes, polygons (``ARRAY<STRUCT<x, y>>``) and polylines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"
#: Corners of the outline that stands for a round shape known by its box alone.
ROUND_CORNERS = 48
ROUND = ("ellipse", "circle", "region", "unknown", "scribble")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, where a lambda would compute it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def half_even(v: Column, digits: int) -> Column:
    """Rounded to ``digits`` decimals, ties to even."""
    return F.rint(v * 10.0**digits) / 10.0**digits


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for n, c in zip("xywh", (x, y, w, h), strict=True)))


def box_from_corners(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The box of two opposite corners, in any order."""
    return box(F.least(x0, x1), F.least(y0, y1), F.abs(x1 - x0), F.abs(y1 - y0))


def box_of_points(points: Column) -> Column:
    """The box around points; without points a box of zeros."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x0, y0 = F.coalesce(F.array_min(xs), F.lit(0.0)), F.coalesce(F.array_min(ys), F.lit(0.0))
    return box(x0, y0, F.coalesce(F.array_max(xs), F.lit(0.0)) - x0, F.coalesce(F.array_max(ys), F.lit(0.0)) - y0)


def box_area(b: Column) -> Column:
    """Negative sides count as zero."""
    return F.greatest(b["w"], F.lit(0.0)) * F.greatest(b["h"], F.lit(0.0))


def center(b: Column) -> Column:
    return point(b["x"] + b["w"] / 2, b["y"] + b["h"] / 2)


def expand(b: Column, pad) -> Column:
    return box(b["x"] - pad, b["y"] - pad, b["w"] + 2 * pad, b["h"] + 2 * pad)


def intersection(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes; 0 where the union has no area."""
    shared = intersection(a, b)
    union = box_area(a) + box_area(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def box_contains(b: Column, x: Column, y: Column, pad=0.0) -> Column:
    """Whether a point lies in the box widened by ``pad``, borders included."""
    return x.between(b["x"] - pad, b["x"] + b["w"] + pad) & y.between(b["y"] - pad, b["y"] + b["h"] + pad)


def box_distance(b: Column, x: Column, y: Column) -> Column:
    """Distance of a point to a box, 0 inside."""
    dx = F.greatest(b["x"] - x, F.lit(0.0), x - b["x"] - b["w"])
    dy = F.greatest(b["y"] - y, F.lit(0.0), y - b["y"] - b["h"])
    return F.hypot(dx, dy)


def box_outline_distance(b: Column, x: Column, y: Column) -> Column:
    """Distance of a point to the outline of a box."""
    sides = F.least(x - b["x"], b["x"] + b["w"] - x, y - b["y"], b["y"] + b["h"] - y)
    return F.when(box_contains(b, x, y), sides).otherwise(box_distance(b, x, y))


def is_box(poly: Column, b: Column) -> Column:
    """Whether a polygon is its own box, corner by corner: closed forms then stand for the walk along its edges."""
    return poly == outline(b, F.lit("rectangle"))


def outline(b: Column, kind: Column) -> Column:
    """The polygon of a shape known by box and type: 48 corners, a triangle, a diamond or the box."""
    x0, y0, x1, y1 = b["x"], b["y"], b["x"] + b["w"], b["y"] + b["h"]
    cx, cy = b["x"] + b["w"] / 2, b["y"] + b["h"] / 2
    turn = F.transform(F.sequence(F.lit(0), F.lit(ROUND_CORNERS - 1)), lambda i: i * F.lit(2.0) * F.pi() / ROUND_CORNERS)
    around = F.transform(turn, lambda t: point(cx + b["w"] / 2 * F.cos(t), cy + b["h"] / 2 * F.sin(t)))
    return (
        F.when(kind.isin(*ROUND), around)
        .when(kind == "triangle", F.array(point(cx, y0), point(x1, y1), point(x0, y1)))
        .when(kind == "diamond", F.array(point(cx, y0), point(x1, cy), point(cx, y1), point(x0, cy)))
        .otherwise(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1)))
    )


def edges_of(poly: Column) -> Column:
    """Each corner with the next one, the last with the first."""
    return F.zip_with(poly, F.concat(F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0))), F.slice(poly, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def flat(points: Column) -> Column:
    """x and y of points in turn, as Python's numeric code takes them."""
    return F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"])))


def segments_cross(e: Column, f: Column) -> Column:
    """Whether two edges cross, each having an end on either side of the other."""
    side = lambda s, p: (s["b"]["x"] - s["a"]["x"]) * (p["y"] - s["a"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (p["x"] - s["a"]["x"])
    return (side(e, f["a"]) * side(e, f["b"]) < 0) & (side(f, e["a"]) * side(f, e["b"]) < 0)


def polygon_area(poly: Column) -> Column:
    """Shoelace area; 0 with fewer than three corners."""
    twice = F.aggregate(edges_of(poly), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["a"]["y"] * e["b"]["x"])
    return F.when(F.size(poly) >= 3, F.abs(twice) / 2).otherwise(F.lit(0.0))


def segment_distance(ax: Column, ay: Column, bx: Column, by: Column, x: Column, y: Column) -> Column:
    dx, dy = bx - ax, by - ay
    long = dx * dx + dy * dy
    t = F.when(long > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - ax) * dx + (y - ay) * dy) / long))).otherwise(F.lit(0.0))
    return F.hypot(x - ax - t * dx, y - ay - t * dy)


def distance_to(edges: Column, x: Column, y: Column) -> Column:
    """Distance of a point to the nearest of a polygon's edges."""
    return F.array_min(F.transform(edges, lambda e: segment_distance(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"], x, y)))


def within(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over a polygon's edges, without regard to points on them."""
    crosses = F.filter(edges, lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0))))
    return F.size(crosses) % 2 == 1


def on_edge(edges: Column, x: Column, y: Column) -> Column:
    """Whether a point lies on one of the edges, without rounding for upright and level ones."""

    def holds(e):
        a, b = e["a"], e["b"]
        turn = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return (turn == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return F.exists(edges, holds)


def within_or_on(edges: Column, x: Column, y: Column) -> Column:
    return on_edge(edges, x, y) | within(edges, x, y)


def outline_distance(poly: Column, x: Column, y: Column) -> Column:
    """Distance of a point to the outline of a polygon."""
    return distance_to(edges_of(poly), x, y)


def inside(poly: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a polygon; the outline counts as inside."""
    return let(edges_of(poly), lambda e: within_or_on(e, x, y))


def rounded(v: Column) -> Column:
    """Lengths and areas at the grain at which they are compared (1e-6), so that equal ones tie."""
    return F.rint(v * 1e6) / 1e6


def signed_distance(poly: Column, x: Column, y: Column) -> Column:
    """Distance to the outline, negative outside."""
    return let(edges_of(poly), lambda e: F.when(within(e, x, y), distance_to(e, x, y)).otherwise(-distance_to(e, x, y)))


def fraction_inside(points: Column, poly: Column) -> Column:
    """Share of points in a polygon; 0 without points."""
    n = F.size(points)
    return F.when(n > 0, let(edges_of(poly), lambda e: F.size(F.filter(points, lambda p: within_or_on(e, p["x"], p["y"])))) / n).otherwise(F.lit(0.0))


def every_nth(points: Column, least: int = 40) -> Column:
    """Points at a stride that keeps ``least`` of them at least."""
    return F.filter(points, lambda p, i: i % F.greatest(F.lit(1), F.floor(F.size(points) / least)) == 0)


def path_lengths(path: Column) -> Column:
    """Length of a polyline up to each of its points."""
    zero = F.array(F.lit(0.0))
    steps = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.hypot(F.get(path, i)["x"] - F.get(path, i - 1)["x"], F.get(path, i)["y"] - F.get(path, i - 1)["y"]))
    return F.when(F.size(path) >= 2, F.aggregate(steps, zero, lambda s, d: F.concat(s, F.array(F.element_at(s, -1) + d)))).otherwise(zero)


def polyline_length(path: Column) -> Column:
    return F.element_at(path_lengths(path), -1)


def resampled(path: Column, step) -> Column:
    """Points at even distances of about ``step`` along a polyline, its ends included; a path without length gives its first point."""
    least = F.greatest((F.lit(step) if isinstance(step, float) else step).cast("double"), F.lit(1e-6))

    def spread(v):
        at, n, total = v["at"], v["n"], F.element_at(v["at"], -1)

        def place(i):
            def along(t):
                k = F.least(F.greatest(F.size(F.filter(at, lambda s: s <= t)), F.lit(1)), F.size(path) - 1)

                def between(j):
                    a, b, s0, s1 = F.element_at(path, j), F.element_at(path, j + 1), F.element_at(at, j), F.element_at(at, j + 1)
                    f = F.when(s1 > s0, F.least(F.lit(1.0), (t - s0) / (s1 - s0))).otherwise(F.lit(0.0))
                    return point(a["x"] + f * (b["x"] - a["x"]), a["y"] + f * (b["y"] - a["y"]))

                return let(k, between)

            return let(i * total / (n - 1), along)

        return F.when(total > 0, F.transform(F.sequence(F.lit(0), n - 1), place)).otherwise(F.slice(path, 1, 1))

    many = lambda total: F.greatest(F.lit(2), (total / least).cast("int") + 1)
    counted = lambda at: F.struct(at.alias("at"), many(F.element_at(at, -1)).alias("n"))
    a, b = F.get(path, F.lit(0)), F.get(path, F.lit(1))

    def straight(v):
        f = lambda i: F.least(F.lit(1.0), i * v["long"] / (v["n"] - 1) / v["long"])
        return F.when(v["long"] > 0, F.transform(F.sequence(F.lit(0), v["n"] - 1), lambda i: point(a["x"] + f(i) * (b["x"] - a["x"]), a["y"] + f(i) * (b["y"] - a["y"])))).otherwise(F.slice(path, 1, 1))

    sized = let(F.hypot(b["x"] - a["x"], b["y"] - a["y"]), lambda long: F.struct(long.alias("long"), many(long).alias("n")))
    return F.when(F.size(path) < 2, path).when(F.size(path) == 2, let(sized, straight)).otherwise(let(let(path_lengths(path), counted), spread))


def to_original(x: Column, y: Column, rotation: Column, width: Column, height: Column, scale: Column, crop_x: Column, crop_y: Column) -> Column:
    """A point of the working image in the pixels of the original: rotation, scale and crop undone, one decimal."""
    turn = F.pmod(F.coalesce(rotation, F.lit(0)), F.lit(360))
    sideways = turn.isin(90, 270)
    w0, h0 = F.when(sideways, height).otherwise(width), F.when(sideways, width).otherwise(height)
    px = F.when(turn == 90, y).when(turn == 180, w0 - 1 - x).when(turn == 270, w0 - 1 - y).otherwise(x)
    py = F.when(turn == 90, h0 - 1 - x).when(turn == 180, h0 - 1 - y).when(turn == 270, x).otherwise(y)
    s = F.when(F.coalesce(scale, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(scale)
    return point(F.bround(px / s + F.coalesce(crop_x, F.lit(0.0)), 1), F.bround(py / s + F.coalesce(crop_y, F.lit(0.0)), 1))


def normalised_box(b: Column, width: Column, height: Column) -> Column:
    """Corners in thousandths of the page, rounded half to even: array<int>."""
    w, h = F.greatest(width, F.lit(1)), F.greatest(height, F.lit(1))
    return F.array(*(F.rint(1000 * v / s).cast("int") for v, s in ((b["x"], w), (b["y"], h), (b["x"] + b["w"], w), (b["y"] + b["h"], h))))


def _scales(layout: Column, width: Column, height: Column, sent: Column) -> tuple[Column, Column]:
    known = (F.coalesce(sent["w"], F.lit(0)) > 0) & (F.coalesce(sent["h"], F.lit(0)) > 0)
    pixels = layout == "xyxy_pixels"
    x = F.when(pixels & known, width / sent["w"]).when(pixels, F.lit(1.0)).otherwise(width / 1000.0)
    y = F.when(pixels & known, height / sent["h"]).when(pixels, F.lit(1.0)).otherwise(height / 1000.0)
    return x, y


def no_size() -> Column:
    return F.struct(F.lit(None).cast("double").alias("w"), F.lit(None).cast("double").alias("h"))


def box_from_model(values: Column, width: Column, height: Column, layout: Column | None = None, sent: Column | None = None) -> Column:
    """A box from a model's array<double> in one of three layouts, cut to the page; null unless wider and higher than 1.

    Values that are all at most 1 are taken as fractions, but for pixels. Arrays with a null or fewer than four values give null.
    """
    layout, sent = F.lit("xyxy_1000") if layout is None else layout, no_size() if sent is None else sent
    v = [F.get(values, F.lit(k)) for k in range(4)]
    swap = layout == "yxyx_1000"
    x0, y0, x1, y1 = (F.when(swap, v[b]).otherwise(v[a]) for a, b in ((0, 1), (1, 0), (2, 3), (3, 2)))
    more = F.when((layout != "xyxy_pixels") & (F.greatest(*v) <= 1.0), 1000.0).otherwise(1.0)
    sx, sy = _scales(layout, width, height, sent)
    zero = F.lit(0.0)
    b = box_from_corners(F.greatest(zero, x0 * more * sx), F.greatest(zero, y0 * more * sy), F.least(width, x1 * more * sx), F.least(height, y1 * more * sy))
    whole = v[0].isNotNull() & v[1].isNotNull() & v[2].isNotNull() & v[3].isNotNull()
    return F.when(whole & (b["w"] > 1) & (b["h"] > 1), b)


def point_from_model(values: Column, width: Column, height: Column, layout: Column | None = None, sent: Column | None = None) -> Column:
    """A point from a model's array<double>, cut to the page; null without two numbers. Fractions are not tolerated here."""
    layout, sent = F.lit("xyxy_1000") if layout is None else layout, no_size() if sent is None else sent
    a, b = F.get(values, F.lit(0)), F.get(values, F.lit(1))
    swap = layout == "yxyx_1000"
    sx, sy = _scales(layout, width, height, sent)
    cut = lambda v, most: F.least(F.greatest(F.lit(0.0), v), most)
    found = point(cut(F.when(swap, b).otherwise(a) * sx, width), cut(F.when(swap, a).otherwise(b) * sy, height))
    return F.when(a.isNotNull() & b.isNotNull(), found)
