"""Operators over grids, flows, boxes and model tables, on cells and vectors derived from lineitem, each with equivalent SQL.

A cell is (x, y, v) = (line number, order, quantity summed up); a flow vector is (u, v) = 100 * (discount, tax).
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import boxes, colour, distance, text, transforms
from ..operators import annotations, learning, raster
from .queries import line_boxes, query, r6, table

CELLS = "g AS (SELECT CAST(l_linenumber AS BIGINT) AS x, l_orderkey AS y, sum(l_quantity) AS v, sum(l_discount * 100) AS u FROM lineitem GROUP BY ALL)"


def cells(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("x"), F.col("l_orderkey").alias("y")).agg(F.sum("l_quantity").alias("v"), F.sum(F.col("l_discount") * 100).alias("u"))


@query(f"WITH {CELLS} SELECT x, count(v) AS n, round(sum(v), 4) AS total, round(sum(v * v), 4) AS squares, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS var, min(v) AS low, max(v) AS high FROM g GROUP BY x")
def cell_moments(spark, sf_dir):
    """Sum, sum of squares, mean, variance and range of each column of cells."""
    m = cells(spark, sf_dir).groupBy("x").agg(*raster.moments(F.col("v")))
    return m.select("x", "n", F.round("total", 4).alias("total"), F.round("squares", 4).alias("squares"), r6("mean").alias("mean"), r6("var").alias("var"), "low", "high")


@query(f"WITH {CELLS}, r AS (SELECT x, max(v) AS high, min(v) AS low FROM g GROUP BY x), s AS (SELECT x, v, row_number() OVER (PARTITION BY x ORDER BY v, y) AS k FROM g) "
       "SELECT x, high, (SELECT min(y) FROM g WHERE g.x = r.x AND g.v = r.high) AS high_at, low, (SELECT min(y) FROM g WHERE g.x = r.x AND g.v = r.low) AS low_at, (SELECT v FROM s WHERE s.x = r.x AND k = 2) AS second_low FROM r")  # fmt: skip
def cell_extremes(spark, sf_dir):
    return raster.extremes(cells(spark, sf_dir), ["x"], "v", "y")


ARITHMETIC = {"plus": "a + b", "minus": "a - b", "times": "a * b", "blend": "0.25 * a + 0.75 * b", "top": "greatest(a, b)", "bottom": "least(a, b)"}


@query(f"WITH {CELLS}, p AS (SELECT c.x, c.y, c.v AS a, d.v AS b FROM g c JOIN g d ON d.x = c.x + 1 AND d.y = c.y) SELECT x, y, " + ", ".join(f"round({e}, 6) AS {k}" for k, e in ARITHMETIC.items()) + " FROM p")
def cell_arithmetic(spark, sf_dir):
    """Sums, products and extremes of each cell and the one to its right."""
    g = cells(spark, sf_dir).select("x", "y", "v")
    both = raster.combine(g, raster.paste(g, -1, 0), "v", ARITHMETIC)
    return both.select("x", "y", *(r6(k).alias(k) for k in ARITHMETIC))


@query(f"WITH {CELLS} SELECT round(sum(a.v * b.v), 2) AS dot FROM g a JOIN g b ON b.x = a.x + 1 AND b.y = a.y")
def inner_product(spark, sf_dir):
    g = cells(spark, sf_dir).select("x", "y", "v")
    return raster.combine(g, raster.paste(g, -1, 0), "v", {"p": "a * b"}).agg(F.round(F.sum("p"), 2).alias("dot"))


@query(f"WITH {CELLS} SELECT x - 2 AS x, y - 100 AS y, v FROM g WHERE x >= 2 AND x < 6 AND y >= 100 AND y < 400")
def crop_window(spark, sf_dir):
    return raster.crop(cells(spark, sf_dir), 2, 100, 4, 300).select("x", "y", "v")


@query(f"WITH {CELLS} SELECT 7 - x AS x, y, v FROM g")
def flip_cells(spark, sf_dir):
    return raster.flip(cells(spark, sf_dir), 8).select("x", "y", "v")


@query(f"WITH {CELLS} SELECT x * 2 + dx AS x, y * 2 + dy AS y, v FROM g, unnest([0, 1]) AS a(dx), unnest([0, 1]) AS b(dy) WHERE y < 500")
def enlarge_cells(spark, sf_dir):
    return raster.enlarge(cells(spark, sf_dir).where("y < 500"), 2).select("x", "y", "v")


@query(f"WITH {CELLS} SELECT CAST(x // 2 AS BIGINT) AS x, CAST(y // 2 AS BIGINT) AS y, v FROM g WHERE x % 2 = 0 AND y % 2 = 0")
def subsample_cells(spark, sf_dir):
    return raster.subsample(cells(spark, sf_dir), 2).select("x", "y", "v")


@query(f"WITH {CELLS} SELECT x, CAST(floor(v / 20) AS BIGINT) AS bin, count(*) AS n FROM g GROUP BY ALL")
def window_histograms(spark, sf_dir):
    """Histograms of values by region (a column of cells)."""
    return cells(spark, sf_dir).groupBy("x", F.floor(F.col("v") / 20).alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {CELLS}, l AS (SELECT *, CAST(floor(v / 25) AS BIGINT) AS raw FROM g), d AS (SELECT raw, dense_rank() OVER (ORDER BY raw) - 1 AS label FROM (SELECT DISTINCT raw FROM l)) SELECT label, count(*) AS size, round(avg(x), 6) AS cx, round(avg(y), 4) AS cy, round(avg(u), 6) AS mean FROM l JOIN d USING (raw) GROUP BY label")
def region_stats(spark, sf_dir):
    """Size, centroid and mean colour of regions (bands of quantity), whose labels are numbered anew without gaps."""
    from ..operators.grids import dense_labels

    g = dense_labels(cells(spark, sf_dir).withColumn("raw", F.floor(F.col("v") / 25)), "raw", "label")
    return g.groupBy("label").agg(F.count("*").alias("size"), r6(F.avg("x")).alias("cx"), F.round(F.avg("y"), 4).alias("cy"), r6(F.avg("u")).alias("mean"))


FLOW = "f AS (SELECT l_linenumber AS x, l_orderkey % 300 AS y, l_discount * 100 AS u, l_tax * 100 AS v, l_quantity / 5 AS tu, l_linenumber AS tv FROM lineitem)"


def flow(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("x"), (F.col("l_orderkey") % 300).alias("y"), (F.col("l_discount") * 100).alias("u"), (F.col("l_tax") * 100).alias("v"), (F.col("l_quantity") / 5).alias("tu"), F.col("l_linenumber").cast("double").alias("tv"))


@query(f"WITH {FLOW}, e AS (SELECT x, y, sqrt((u - tu) ** 2 + (v - tv) ** 2) AS e, sqrt(tu ** 2 + tv ** 2) AS l FROM f) SELECT x, count(*) AS n, count(*) FILTER (e > 3.0000001 AND e > 0.05 * l) AS outliers, round(max(l), 6) AS longest FROM e GROUP BY x")
def flow_outliers(spark, sf_dir):
    """Vectors, outliers (three pixels and five percent) and the largest true length, by column."""
    f = flow(spark, sf_dir)
    error, length = F.hypot(F.col("u") - F.col("tu"), F.col("v") - F.col("tv")), F.hypot("tu", "tv")
    return f.groupBy("x").agg(F.count("*").alias("n"), F.count_if(raster.is_outlier(error, length, 3.0000001)).alias("outliers"), r6(F.max(length)).alias("longest"))


@query(f"WITH {FLOW} SELECT CAST(x + round(u, 6) >= 0 AND x + round(u, 6) <= 9 AND y + round(v, 6) >= 0 AND y + round(v, 6) <= 249 AS INTEGER) AS inside, count(*) AS n FROM f GROUP BY ALL")
def in_image_mask(spark, sf_dir):
    """How many vectors end inside an image of 10 x 250."""
    f = flow(spark, sf_dir).withColumn("u", r6("u")).withColumn("v", r6("v"))
    return f.groupBy(raster.lands_inside(10, 250).alias("inside")).agg(F.count("*").alias("n"))


@query(f"WITH {FLOW}, c AS (SELECT DISTINCT x, y FROM f) SELECT count(*) AS matches, round(count(*) / (7 * 300), 6) AS density FROM c")
def match_counts(spark, sf_dir):
    """Cells with a match, and their share of the image."""
    c = flow(spark, sf_dir).select("x", "y").distinct()
    return c.agg(F.count("*").alias("matches"), r6(F.count("*") / (7 * 300)).alias("density"))


@query(f"WITH {FLOW} SELECT x, round(avg(abs(u - tu)), 6) AS scale_u, round(avg(abs(v - tv)), 6) AS scale_v FROM f WHERE abs(u - tu) < 8 AND abs(v - tv) < 8 GROUP BY x")
def laplacian_noise(spark, sf_dir):
    """Mean absolute residuals under a bound: the scale of Laplacian noise."""
    f = flow(spark, sf_dir).where((F.abs(F.col("u") - F.col("tu")) < 8) & (F.abs(F.col("v") - F.col("tv")) < 8))
    return f.groupBy("x").agg(r6(F.avg(F.abs(F.col("u") - F.col("tu")))).alias("scale_u"), r6(F.avg(F.abs(F.col("v") - F.col("tv")))).alias("scale_v"))


WHEEL = "w(k, r, g, b) AS (VALUES " + ", ".join(f"({k}, {r / 255!r}::DOUBLE, {g / 255!r}::DOUBLE, {b / 255!r}::DOUBLE)" for k, (r, g, b) in enumerate(raster.wheel())) + ")"
MIX = "CAST(floor(255 * CASE WHEN len <= 1 THEN 1 - len * (1 - ((1 - part) * lo.{0} + part * hi.{0})) ELSE ((1 - part) * lo.{0} + part * hi.{0}) * 0.75 END) AS INTEGER) AS {0}"


@query(f"WITH {WHEEL}, o AS (SELECT DISTINCT round(l_discount * 100 - 4.63, 6) AS u, round(l_tax * 100 - 3.57, 6) AS v FROM lineitem), a AS (SELECT u, v, sqrt((u / 6) ** 2 + (v / 6) ** 2) AS len, (atan2(-v / 6, -u / 6) / pi() + 1) / 2 * 54 AS pos FROM o), "
       f"p AS (SELECT *, CAST(floor(pos) AS INTEGER) AS k, pos - floor(pos) AS part FROM a) SELECT u, v, {', '.join(MIX.format(c) for c in 'rgb')} FROM p JOIN w lo ON lo.k = p.k JOIN w hi ON hi.k = (p.k + 1) % 55")  # fmt: skip
def flow_colours(spark, sf_dir):
    """Colours of vectors on the wheel of directions, in units of length 6."""
    f = table(spark, sf_dir, "lineitem").select(F.round(F.col("l_discount") * 100 - 4.63, 6).alias("u"), F.round(F.col("l_tax") * 100 - 3.57, 6).alias("v")).distinct()
    return f.select("u", "v", *(c.alias(k) for k, c in zip("rgb", raster.flow_colour(F.col("u") / 6, F.col("v") / 6), strict=True)))


RGB = "c AS (SELECT p_partkey AS id, p_size * 5 AS r, p_partkey % 256 AS g, (p_partkey * 7) % 256 AS b FROM part)"


def colours(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 5).alias("r"), (F.col("p_partkey") % 256).alias("g"), (F.col("p_partkey") * 7 % 256).alias("b"))


@query(f"WITH {RGB}, m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM c) SELECT id, round(CASE WHEN hi = lo THEN 0 WHEN hi = r THEN ((g - b) / (hi - lo) + CASE WHEN g < b THEN 6 ELSE 0 END) / 6 WHEN hi = g THEN ((b - r) / (hi - lo) + 2) / 6 ELSE ((r - g) / (hi - lo) + 4) / 6 END, 6) AS h, "
       "round(CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi END, 6) AS s, round(hi / 255, 6) AS v FROM m")  # fmt: skip
def hsv_convert(spark, sf_dir):
    c = colours(spark, sf_dir)
    return c.select("id", *(r6(x).alias(k) for k, x in zip("hsv", colour.rgb_to_hsv(*map(F.col, "rgb")), strict=True)))


@query(f"WITH {RGB} SELECT id, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b FROM c")
def lab_round_trip(spark, sf_dir):
    """To CIE L*a*b* and back, in whole channels."""
    back = colour.lab_to_rgb(*colour.rgb_to_lab(*map(F.col, "rgb")))
    return colours(spark, sf_dir).select("id", *(F.round(x).cast("int").alias(k) for k, x in zip("rgb", back, strict=True)))


@query(f"WITH {RGB}, l AS (SELECT id, {', '.join(f'CASE WHEN {k} / 255.0 <= 0.04045 THEN {k} / 255.0 / 12.92 ELSE (({k} / 255.0 + 0.055) / 1.055) ** 2.4 END AS {k}' for k in 'rgb')} FROM c), "
       + "z AS (SELECT id, " + ", ".join(" + ".join(f"{m!r}::DOUBLE * {k}" for m, k in zip(row, "rgb", strict=True)) + f" AS {n}" for n, row in zip("xyz", colour.RGB_TO_XYZ, strict=True)) + " FROM l), "
       "q AS (SELECT *, CASE WHEN y > 0.008856451679035631 THEN 116 * y ** (1.0::DOUBLE / 3) - 16 ELSE y * 903.2962962962963 END AS l, x + 15 * y + 3 * z AS d FROM z) "
       "SELECT id, round(l, 6) AS l, round(CASE WHEN d = 0 THEN 0 ELSE 13 * l * (4 * x / d - 0.19783982482140777) END, 6) AS u, round(CASE WHEN d = 0 THEN 0 ELSE 13 * l * (9 * y / d - 0.46833630293240970) END, 6) AS v FROM q")  # fmt: skip
def luv_convert(spark, sf_dir):
    return colours(spark, sf_dir).select("id", *(r6(x).alias(k) for k, x in zip("luv", colour.rgb_to_luv(*map(F.col, "rgb")), strict=True)))


BOXES = "b AS (SELECT l_orderkey AS img, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity, l_discount, l_extendedprice) AS id, CAST(l_linenumber * 7 AS DOUBLE) AS x, CAST(l_suppkey % 97 AS DOUBLE) AS y, l_quantity AS w, l_discount * 100 + 1 AS h FROM lineitem)"


@query(f"WITH {BOXES}, a AS (SELECT *, radians(30.0) AS t FROM b), e AS (SELECT img, id, x + w / 2 AS cx, y + h / 2 AS cy, abs(w * cos(t)) + abs(h * sin(t)) AS rw, abs(w * sin(t)) + abs(h * cos(t)) AS rh, sqrt((w * cos(t)) ** 2 + (h * sin(t)) ** 2) AS ew, sqrt((w * sin(t)) ** 2 + (h * cos(t)) ** 2) AS eh FROM a) "
       "SELECT img, id, round(cx - rw / 2, 6) AS rect_x, round(cy - rh / 2, 6) AS rect_y, round(rw, 6) AS rect_w, round(rh, 6) AS rect_h, round(ew, 6) AS oval_w, round(eh, 6) AS oval_h FROM e")  # fmt: skip
def rotated_extents(spark, sf_dir):
    """Upright extents of boxes and ellipses turned by 30 degrees."""
    b = boxes.box()
    rect, oval = boxes.extent(b, F.lit(30.0)), boxes.extent(b, F.lit(30.0), ellipse=True)
    named = dict(zip(("rect_x", "rect_y", "rect_w", "rect_h"), rect, strict=True)) | {"oval_w": oval[2], "oval_h": oval[3]}
    return line_boxes(spark, sf_dir).select("img", "id", *(r6(c).alias(k) for k, c in named.items()))


@query(f"WITH {BOXES}, c AS (SELECT img, id, greatest(x, 10) AS x0, greatest(y, 20) AS y0, least(x + w, 40) AS x1, least(y + h, 60) AS y1 FROM b) SELECT img, id, x0 AS x, y0 AS y, x1 - x0 AS w, round(y1 - y0, 6) AS h, CAST(x0 AS INTEGER) AS row_from, CAST(ceil(x1) AS INTEGER) AS row_to FROM c WHERE x1 > x0 AND y1 > y0")
def clipped_boxes(spark, sf_dir):
    """Boxes cut to a window, those outside dropped, and the whole pixels that they touch."""
    x, y, w, h = boxes.intersect(boxes.box(), tuple(F.lit(float(v)) for v in (10, 20, 30, 40)))
    out = line_boxes(spark, sf_dir).select("img", "id", x.alias("x"), y.alias("y"), w.alias("w"), r6(h).alias("h")).where("w > 0 and h > 0")
    return out.select("*", F.floor("x").cast("int").alias("row_from"), F.ceil(F.col("x") + F.col("w")).cast("int").alias("row_to"))


ROTATION = transforms.rotation_matrix([0.0, 0.0, math.pi / 3])


@query("SELECT vec_id AS id, " + ", ".join("round(" + " + ".join(f"{m!r}::DOUBLE * CAST(embedding[{j + 1}] AS DOUBLE)" for j, m in enumerate(row)) + f", 6) AS {k}" for k, row in zip("xyz", ROTATION, strict=True)) + " FROM embeddings")
def rotated_points(spark, sf_dir):
    """First three coordinates turned about the third axis by 60 degrees."""
    p = tuple(F.col("embedding")[i].cast("double") for i in range(3))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *(r6(c).alias(k) for k, c in zip("xyz", transforms.affine(p, ROTATION, [0.0] * 3), strict=True)))


@query("SELECT vec_id, len(embedding) AS channels, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding), 6) AS mean, CAST(embedding[1] AS DOUBLE) AS first, len(list_concat(embedding, embedding[1:2])) AS joined FROM embeddings")
def channel_ops(spark, sf_dir):
    """Norm, mean over channels, one channel apart, and channels joined."""
    e = F.col("embedding")
    total = lambda f: F.aggregate(F.transform(e, f), F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.size(e).cast("long").alias("channels"), r6(F.sqrt(total(lambda x: x.cast("double") * x.cast("double")))).alias("norm"),
        r6(total(lambda x: x.cast("double")) / F.size(e)).alias("mean"), e[0].cast("double").alias("first"), F.size(F.concat(e, F.slice(e, 1, 2))).cast("long").alias("joined"),
    )


# --- learning: labels are return flag R against the rest --------------------------------------------------

FERN_SQL = "r AS (SELECT l_orderkey * 8 + l_linenumber AS id, CAST(l_returnflag = 'R' AS INTEGER) AS label, CAST(l_quantity < 25 AS INTEGER) * 2 + CAST(l_discount < 0.05 AS INTEGER) AS f0, CAST(l_tax < 0.04 AS INTEGER) * 2 + CAST(l_linenumber < 4 AS INTEGER) AS f1, l_extendedprice AS price FROM lineitem)"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber")).withColumn("label", (F.col("l_returnflag") == "R").cast("int"))


def ferns():
    c = F.col
    return {0: learning.fern_index([c("l_quantity"), c("l_discount")], [25, 0.05]), 1: learning.fern_index([c("l_tax"), c("l_linenumber")], [0.04, 4])}


FERN_TABLE = "t AS (SELECT fern, leaf, label, count(*) AS n FROM (SELECT 0 AS fern, f0 AS leaf, label FROM r UNION ALL SELECT 1, f1, label FROM r) GROUP BY ALL)"


@query(f"WITH {FERN_SQL}, {FERN_TABLE} SELECT fern, leaf, label, round(ln((n + 1) / (sum(n) OVER (PARTITION BY fern, label) + 4)), 6) AS logp FROM t")
def fern_class_tables(spark, sf_dir):
    t = learning.fern_tables(lines(spark, sf_dir), ferns(), "label", 2, 4)
    return t.select("fern", "leaf", "label", r6("logp").alias("logp"))


@query(f"WITH {FERN_SQL}, {FERN_TABLE}, p AS (SELECT fern, leaf, label, ln((n + 1) / (sum(n) OVER (PARTITION BY fern, label) + 4)) AS logp FROM t), s AS (SELECT f0, f1, a.label, round(a.logp + b.logp, 9) AS s FROM (SELECT DISTINCT f0, f1 FROM r) q JOIN p a ON a.fern = 0 AND a.leaf = f0 JOIN p b ON b.fern = 1 AND b.leaf = f1 AND a.label = b.label), "
       "w AS (SELECT f0, f1, label AS predicted FROM s QUALIFY row_number() OVER (PARTITION BY f0, f1 ORDER BY s DESC, label) = 1) SELECT predicted, label AS truth, count(*) AS n FROM (SELECT DISTINCT id, label, f0, f1 FROM r QUALIFY count(*) OVER (PARTITION BY id) = 1) JOIN w USING (f0, f1) GROUP BY ALL")  # fmt: skip
def fern_confusion(spark, sf_dir):
    """Classes predicted by two ferns against the truth, for lines with a number of their own."""
    rows = lines(spark, sf_dir)
    single = rows.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").select("id")
    tables = learning.fern_tables(rows, ferns(), "label", 2, 4)
    own = rows.join(single, "id")
    found = learning.fern_predict(own, "id", ferns(), tables, 4)
    return own.join(found, "id").groupBy("predicted", F.col("label").alias("truth")).agg(F.count("*").alias("n"))


@query(f"WITH {FERN_SQL} SELECT f0 AS leaf, round(sum(price) / (count(*) + 10), 4) AS mean FROM r GROUP BY f0")
def fern_leaf_means(spark, sf_dir):
    return learning.leaf_means(lines(spark, sf_dir), ferns()[0], "l_extendedprice", 10).select("leaf", F.round("mean", 4).alias("mean"))


STUMPS = ("l_quantity", "l_linenumber")


@query("WITH s AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS INTEGER) AS bin, l_returnflag = 'R' AS label, l_tax + 1 AS w FROM lineitem" for f in STUMPS) + "), c AS (SELECT feature, bin, coalesce(sum(w) FILTER (label), 0) AS p, coalesce(sum(w) FILTER (NOT label), 0) AS n FROM s GROUP BY ALL), "
       "r AS (SELECT feature, bin, (coalesce(sum(p) OVER (PARTITION BY feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(n) OVER (PARTITION BY feature) - coalesce(sum(n) OVER (PARTITION BY feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(p) OVER (PARTITION BY feature) + sum(n) OVER (PARTITION BY feature)) AS e FROM c) "
       "SELECT feature, bin, round(least(e, 1 - e), 6) AS error FROM r")  # fmt: skip
def stump_errors(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("w", F.col("l_tax") + 1)
    return learning.stump_errors(rows, list(STUMPS), "label", "w", 64).select("feature", "bin", r6("error").alias("error"))


TREES = [
    {"feature": "q", "below": 25, "left": {"feature": "d", "below": 0.05, "left": {"value": 0.6}, "right": {"value": -0.2}}, "right": {"value": 0.1}},
    {"feature": "t", "below": 0.04, "left": {"value": -0.5}, "right": {"feature": "q", "below": 40, "left": {"value": 0.3}, "right": {"value": 0.9}}},
]


@query("SELECT l_returnflag, count(*) AS n, round(sum(CASE WHEN l_quantity < 25 THEN CASE WHEN l_discount < 0.05 THEN 0.6 ELSE -0.2 END ELSE 0.1 END + CASE WHEN l_tax < 0.04 THEN -0.5 WHEN l_quantity < 40 THEN 0.3 ELSE 0.9 END)::DOUBLE, 4) AS score FROM lineitem GROUP BY ALL")
def boosted_scores(spark, sf_dir):
    """Sums of two boosted trees by return flag."""
    s = learning.boosted(TREES, {"q": F.col("l_quantity"), "d": F.col("l_discount"), "t": F.col("l_tax")})
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum(s), 4).alias("score"))


# --- relational forms ----------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_quantities(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_quantities(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT 'both' AS kind, k FROM (SELECT l_suppkey AS k FROM lineitem INTERSECT SELECT s_suppkey FROM supplier) UNION ALL SELECT 'orders_only', k FROM (SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem)")
def set_algebra(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    both = t("lineitem").select(F.col("l_suppkey").alias("k")).intersect(t("supplier").select("s_suppkey"))
    only = t("orders").select(F.col("o_orderkey").alias("k")).subtract(t("lineitem").select("l_orderkey"))
    return both.select(F.lit("both").alias("kind"), "k").union(only.select(F.lit("orders_only"), "k"))


@query("SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, count(*) AS n, CAST(max(date_diff('day', CAST(o_orderdate AS DATE), CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE))) AS INTEGER) AS days_left FROM orders GROUP BY ALL")
def calendar_parts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    left = F.date_diff(F.expr("date_trunc('month', o_orderdate) + INTERVAL 1 MONTH").cast("date"), F.col("o_orderdate").cast("date"))
    return o.groupBy(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.count("*").alias("n"), F.max(left).alias("days_left"))


@query("SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(1 - CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(5,2))) AS VARCHAR) AS revenue FROM lineitem GROUP BY ALL")
def decimal_revenue(spark, sf_dir):
    line = F.col("l_extendedprice").cast("decimal(15,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")).cast("decimal(5,2)")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(line).cast("string").alias("revenue"))


def approximate_counts(spark, sf_dir):
    """Approximate distinct counts and quantiles by flag; estimates, so without SQL."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("orders"), F.percentile_approx("l_extendedprice", [0.1, 0.5, 0.9], 1000).alias("prices"))


# --- scalar functions ----------------------------------------------------------------------------------------


@query("WITH e AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: abs(CAST(x AS DOUBLE))) AS a, list_transform(embedding[5:8], lambda x: abs(CAST(x AS DOUBLE))) AS b FROM embeddings) "
       "SELECT vec_id, round(list_sum(list_transform(range(1, 5), lambda i: (a[i] - b[i]) ** 2 / (a[i] + b[i] + 2.220446049250313e-16))) / 2, 6) AS chi, "
       "round(list_sum(list_transform(range(1, 5), lambda i: abs(list_sum(a[1:i]) - list_sum(b[1:i])))), 6) AS emd FROM e")  # fmt: skip
def histogram_distances(spark, sf_dir):
    """Chi-square and earth mover's distance between the first and the next four numbers of each vector."""
    part = lambda at: F.transform(F.slice("embedding", at, 4), lambda x: F.abs(x.cast("double")))
    a, b = part(1), part(5)
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(distance.chi_square(a, b)).alias("chi"), r6(distance.earth_movers(a, b)).alias("emd"))


@query("SELECT p_partkey AS id, round(exp(-((p_size - 25) ** 2) / 200.0::DOUBLE) / (10 * sqrt(2 * pi())), 9) AS density, CAST((p_size - 1) * 100 + (p_partkey % 100 + 1) AS BIGINT) AS place, round(0.299::DOUBLE * p_size + 0.587::DOUBLE * (p_partkey % 256) + 0.114::DOUBLE * 7, 6) AS grey FROM part")
def scalar_functions(spark, sf_dir):
    """A normal density, the linear place of a row and column, and a grey value."""
    p, size = F.col("p_partkey"), F.col("p_size")
    place = transforms.linear_index(p % 100 + 1, size, 100).cast("long")
    return table(spark, sf_dir, "part").select(p.alias("id"), F.round(transforms.normal_density(size, 25.0, 10.0), 9).alias("density"), place.alias("place"), r6(colour.grey(size, p % 256, F.lit(7))).alias("grey"))


@query("SELECT p_partkey AS id, CAST((p_partkey - 1) % 7 + 1 AS BIGINT) AS r, CAST(floor((p_partkey - 1) / 7) + 1 AS BIGINT) AS c, lpad(CAST(p_size AS VARCHAR), 4, '0') AS digits, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> ''), '|') AS words FROM part")
def places_and_names(spark, sf_dir):
    """Row and column of a linear place, padded digits, and the words of a name."""
    r, c = transforms.from_linear_index(F.col("p_partkey"), 7)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), r.cast("long").alias("r"), c.cast("long").alias("c"), text.padded(F.col("p_size"), 4).alias("digits"), F.array_join(text.tokens(F.col("p_name"), " "), "|").alias("words"))


@query(f"WITH {BOXES}, p AS (SELECT a.img, a.id, c.id AS other, least(a.x, c.x) AS ux, least(a.y, c.y) AS uy, greatest(a.x + a.w, c.x + c.w) AS ur, greatest(a.y + a.h, c.y + c.h) AS ub, a.x - 3 AS sx, a.y + 2 AS sy FROM b a JOIN b c ON a.img = c.img AND c.id = a.id + 1) SELECT img, id, round(ux, 6) AS x, round(uy, 6) AS y, round(ur - ux, 6) AS w, round(ub - uy, 6) AS h, round(sx, 6) AS moved_x, round(sy, 6) AS moved_y FROM p")
def box_unions(spark, sf_dir):
    """Bounding boxes of each box and the next, and the box moved."""
    b = line_boxes(spark, sf_dir)
    named = lambda df, p: df.select("img", F.col("id").alias(f"{p}id"), *(F.col(k).alias(f"{p}{k}") for k in "xywh"))
    pairs = named(b, "a_").join(named(b, "b_").withColumn("a_id", F.col("b_id") - 1), ["img", "a_id"])
    u, moved = boxes.union(boxes.box("a_"), boxes.box("b_")), boxes.shift(boxes.box("a_"), 3, -2)
    return pairs.select("img", F.col("a_id").alias("id"), *(r6(v).alias(k) for k, v in zip("xywh", u, strict=True)), r6(moved[0]).alias("moved_x"), r6(moved[1]).alias("moved_y"))


@query(f"SELECT vec_id AS id, round({math.cos(0.5)!r}::DOUBLE * embedding[1]::DOUBLE - {math.sin(0.5)!r}::DOUBLE * embedding[2]::DOUBLE + 1, 6) AS x, round({math.sin(0.5)!r}::DOUBLE * embedding[1]::DOUBLE + {math.cos(0.5)!r}::DOUBLE * embedding[2]::DOUBLE - 2, 6) AS y FROM embeddings")
def rigid_points(spark, sf_dir):
    p = tuple(F.col("embedding")[i].cast("double") for i in range(2))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *(r6(c).alias(k) for k, c in zip("xy", transforms.rigid2d(p, 0.5, [1.0, -2.0]), strict=True)))


@query("SELECT l_returnflag AS label, CAST(l_quantity < 10 OR l_quantity > 40 OR l_returnflag = 'N' OR coalesce(l_quantity / l_linenumber NOT BETWEEN 2 AND 20, true) AS BOOLEAN) AS ignored, count(*) AS n FROM lineitem WHERE l_returnflag IN ('R', 'N') GROUP BY ALL")
def flagged_objects(spark, sf_dir):
    """Objects (lines) flagged by their label and by ranges of a property and of their shape."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("l_quantity").alias("w"), F.col("l_linenumber").cast("double").alias("h"), F.lit(0).alias("ignore"))
    found = annotations.flag_out_of_range(rows, {"w": (10, 40), "ratio": (2, 20)}, ["N"], ["R"])
    return found.groupBy("label", F.col("ignore").alias("ignored")).agg(F.count("*").alias("n"))
