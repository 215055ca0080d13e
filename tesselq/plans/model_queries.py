"""Trimmed clusters, radial features, curves, fits, masks and graphs over the driver's tables, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import transforms
from ..operators import cluster, graph, grids, nearest, registration, statistics
from .queries import CENTRES, centres, query, r6, table, vectors

SHARE = 0.05


@query(CENTRES + f""", n AS (SELECT id, centre, dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, centre) AS r FROM d) WHERE r = 1), k AS (SELECT dist, row_number() OVER (ORDER BY dist) AS k FROM n)
SELECT id, CASE WHEN dist <= (SELECT dist FROM k WHERE k = (SELECT count(*) - CAST(floor(count(*) * {SHARE}) AS BIGINT) FROM n)) THEN centre ELSE -1 END AS centre FROM n""")
def kmeans_outlier_cut(spark, sf_dir):
    """The assignment of a round of trimmed k-means, from the labels' means: the farthest twentieth of the vectors is -1."""
    v = vectors(spark, sf_dir)
    found = nearest.assign_to_centres(v, centres(v))
    near = cluster.without_far(found, SHARE).select("id", F.lit(True).alias("near"))
    return found.join(near, "id", "left").select("id", F.when(F.col("near"), F.col("centre")).otherwise(-1).cast("int").alias("centre"))


@query(CENTRES + """, w AS (SELECT label, min(s) AS w FROM (SELECT a.label, b.label AS other, sum((a.m - b.m) ** 2) AS s FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY ALL) GROUP BY label),
f AS (SELECT label, greatest(w, (SELECT avg(w) FROM w) / 100) AS w FROM w)
SELECT id, centre, round(exp(-dist / (2 * w)), 6) AS feature FROM d JOIN f ON f.label = d.centre""")
def radial_features(spark, sf_dir):
    """Gaussian features about the labels' means, widths by the nearest other mean."""
    v = vectors(spark, sf_dir)
    model = centres(v)
    widths, _ = cluster.radial_width(model)
    found = cluster.radial_features(v, model, widths).select("id", F.posexplode("features").alias("at", "feature"))
    ids = F.array(*map(F.lit, sorted(widths)))
    return found.select("id", ids[F.col("at")].cast("int").alias("centre"), r6("feature").alias("feature"))


TARGETS = statistics.spaced(0.01, 1, 9)


@query(f"""WITH c AS (SELECT n_chars AS score, count(*) FILTER (quality = 1) AS t, count(*) FILTER (quality <> 1) AS f FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY ALL),
r AS (SELECT sum(f) OVER w / (SELECT sum(f) FROM c) AS r, 1 - sum(t) OVER w / (SELECT sum(t) FROM c) AS v FROM c WINDOW w AS (ORDER BY score DESC)), t AS (SELECT unnest({TARGETS}::DOUBLE[]) AS target),
a AS (SELECT target, min(r) AS r FROM t JOIN r ON r.r >= target GROUP BY target), b AS (SELECT target, max(r) AS r FROM t JOIN r ON r.r < target GROUP BY target),
e AS (SELECT t.target, a.r AS ra, (SELECT max(v) FROM r WHERE r.r = a.r) AS va, coalesce(b.r, 0) AS rb, coalesce((SELECT min(v) FROM r WHERE r.r = b.r), 1) AS vb FROM t LEFT JOIN a USING (target) LEFT JOIN b USING (target))
SELECT target, round(CASE WHEN ra IS NULL THEN (SELECT min(v) FROM r WHERE r = (SELECT max(r) FROM r)) WHEN ra = rb THEN (va + vb) / 2 ELSE (target - rb) / (ra - rb) * va + (1 - (target - rb) / (ra - rb)) * vb END, 6) AS miss FROM e""")  # fmt: skip
def roc_resampled(spark, sf_dir):
    """Miss rate of length as a score of quality, read at nine rates of false positives."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("n_chars", "quality")
    points = statistics.roc(rows, "n_chars", "quality").select(F.lit(1).alias("k"), F.col("fall_out").alias("r"), (1 - F.col("recall")).alias("v"))
    return statistics.resample_roc(points, "k", "r", "v", TARGETS).select("target", r6("value").alias("miss"))


@query("SELECT l_extendedprice AS value FROM lineitem ORDER BY 1 LIMIT 1 OFFSET 4999")
def price_of_rank(spark, sf_dir):
    """The 5,000th least price of a line."""
    value = statistics.order_statistic(table(spark, sf_dir, "lineitem"), "l_extendedprice", 5000)
    return spark.createDataFrame([(value,)], "value double")


@query("""WITH m AS (SELECT avg(l_quantity) AS a, avg(l_extendedprice) AS b, var_pop(l_quantity) AS p, var_pop(l_extendedprice) AS q, covar_pop(l_quantity, l_extendedprice) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, round(1e6 * exp(-(q * (l_quantity - a) ** 2 - 2 * c * (l_quantity - a) * (l_extendedprice - b) + p * (l_extendedprice - b) ** 2) / (p * q - c * c) / 2) / (2 * pi() * sqrt(p * q - c * c)), 6) AS density FROM lineitem, m""")
def joint_density(spark, sf_dir):
    """Density of quantity and price under the normal distribution of their moments, times a million."""
    lines = table(spark, sf_dir, "lineitem")
    m = statistics.pca_moments(lines, ["l_quantity", "l_extendedprice"]).first()
    cross = m["cov_l_quantity_l_extendedprice"]
    density = transforms.normal_density_of(
        [F.col("l_quantity"), F.col("l_extendedprice")], [m["mean_l_quantity"], m["mean_l_extendedprice"]], [[m["cov_l_quantity_l_quantity"], cross], [cross, m["cov_l_extendedprice_l_extendedprice"]]]
    )
    return lines.select("l_orderkey", "l_linenumber", F.round(density * 1e6, 6).alias("density"))


TERMS = {"xx": "(l_discount * 100) ** 2", "yy": "(l_tax * 100) ** 2", "xy": "l_discount * 100 * l_tax * 100", "x": "l_discount * 100", "y": "l_tax * 100", "one": "1.0::DOUBLE"}
PAIRS = [(a, b, TERMS[b]) for i, a in enumerate(TERMS) for b in list(TERMS)[i:]] + [(a, "t", "l_quantity") for a in TERMS]


@query("SELECT " + ", ".join(f"round(sum(l_linenumber * ({TERMS[a]}) * ({c})), 1) AS s_{a}_{b}" for a, b, c in PAIRS) + " FROM lineitem")
def paraboloid_sums(spark, sf_dir):
    """Normal equations of quantity as a paraboloid over discount and tax, weighted by line number."""
    features = registration.paraboloid_features(F.col("l_discount") * 100, F.col("l_tax") * 100)
    sums = registration.fit_sums(table(spark, sf_dir, "lineitem"), features, {"t": F.col("l_quantity").cast("double")}, F.col("l_linenumber"))
    return sums.select(*(F.round(c, 1).alias(c) for c in sums.columns))


@query("SELECT l_returnflag, round(sum(exp(-((l_discount - l_tax) ** 2) / 0.0025) * (l_discount - l_tax)) / 0.0025, 4) AS g FROM lineitem GROUP BY ALL")
def gauss_gradient(spark, sf_dir):
    """Gradient of the kernel sum over the given pairs (discount, tax), scale 0.05."""
    g = registration.pair_gauss_gradient([F.col("l_discount")], [F.col("l_tax")], 0.05)[0]
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(g, 4).alias("g"))


@query("SELECT l_orderkey, l_linenumber, s_nationkey, s_acctbal FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0")
def seed_lookup(spark, sf_dir):
    """Lines as cells labelled by supplier, with the values of the seeds: the suppliers with money."""
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    seeds = table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    return grids.seeds_to_cells(cells, "l_suppkey", seeds, "s_suppkey", ["s_nationkey", "s_acctbal"]).drop("l_suppkey")


@query("SELECT l_orderkey, bool_and(l_quantity < 30) AS valid FROM lineitem WHERE l_linenumber - 1 < 2 GROUP BY ALL")
def level_checks(spark, sf_dir):
    """Orders as seeds, lines as levels: whether the first two hold under 30."""
    checks = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("level"), "l_quantity")
    return grids.valid_on_levels(checks, "l_orderkey", "level", F.col("l_quantity") < 30)


@query("""WITH c AS (SELECT CAST(l_linenumber AS BIGINT) AS x, l_suppkey AS y, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT px AS x, py AS y, coalesce(v, -1) AS v FROM (SELECT * FROM (SELECT unnest(range(0, 9)) AS px), (SELECT unnest(range(0, 1001)) AS py)) LEFT JOIN c ON x = px AND y = py""")
def dense_grid(spark, sf_dir):
    """Quantities by line number and supplier on a grid of 9 by 1001, -1 where there is none."""
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("x"), F.col("l_suppkey").cast("long").alias("y")).agg(F.sum("l_quantity").alias("v"))
    return grids.filled(cells, (0, 0), (8, 1000), "v", -1.0)


BOXES = "b AS (SELECT floor(l_discount * 100) AS x, floor(l_suppkey % 50) AS y, l_linenumber + 0.0 AS w, 1.0 + floor(l_tax * 100) AS h, l_quantity AS v FROM lineitem)"


def tax_boxes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_discount") * 100).alias("x"), (F.col("l_suppkey") % 50).alias("y"), F.col("l_linenumber").alias("w"), (1 + F.floor(F.col("l_tax") * 100)).alias("h"), F.col("l_quantity").alias("v")
    )


@query(f"WITH {BOXES}, p AS (SELECT unnest(range(CAST(x AS BIGINT), CAST(x + w AS BIGINT))) AS x, y, h, v FROM b), q AS (SELECT x, unnest(range(CAST(y AS BIGINT), CAST(y + h AS BIGINT))) AS y, v FROM p) SELECT x, y, round(sum(v), 4) AS v FROM q GROUP BY x, y")
def box_mask(spark, sf_dir):
    """Quantity summed over the cells that each line's box covers."""
    return grids.boxes_to_mask(tax_boxes(spark, sf_dir), F.col("v")).select("x", "y", F.round("v", 4).alias("v"))


@query(f"WITH {BOXES}, c AS (SELECT CAST(floor(x + w / 2) AS BIGINT) AS x, CAST(floor(y + h / 2) AS BIGINT) AS y, sum(v) AS v FROM b GROUP BY ALL) SELECT x - 1.5::DOUBLE AS x, y - 2.0::DOUBLE AS y, 3.0::DOUBLE AS w, 4.0::DOUBLE AS h, round(v, 4) AS score FROM c WHERE v > 500")
def mask_boxes(spark, sf_dir):
    """Boxes of 3 by 4 about the cells where the boxes' centres add up to over 500."""
    mask = grids.boxes_to_mask(tax_boxes(spark, sf_dir), F.col("v"), extents=False)
    return grids.mask_to_boxes(mask, "v", 3, 4, 500).withColumn("score", F.round("score", 4))


@query("""WITH s AS (SELECT l_returnflag, sum(l_quantity) AS s, sum(l_quantity * l_linenumber) / sum(l_quantity) AS mx, sum(l_quantity * l_tax * 100) / sum(l_quantity) AS my, sum(l_quantity * l_linenumber ** 2) AS xx, sum(l_quantity * l_linenumber * l_tax * 100) AS xy, sum(l_quantity * (l_tax * 100) ** 2) AS yy FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round(mx, 6) AS mx, round(my, 6) AS my, round(xx / s - mx * mx, 6) AS cxx, round(xy / s - mx * my, 6) AS cxy, round(yy / s - my * my, 6) AS cyy FROM s""")
def mass_centres(spark, sf_dir):
    """Centre and covariance of the quantity over line number and tax."""
    cells = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_linenumber").alias("x"), (F.col("l_tax") * 100).alias("y"), "l_quantity")
    found = grids.mass_moments(cells, ["l_returnflag"], "l_quantity")
    return found.select("l_returnflag", *(r6(c).alias(c) for c in ("mx", "my", "cxx", "cxy", "cyy")))


@query("WITH s AS (SELECT l_returnflag, CAST(floor(l_quantity / 5) AS BIGINT) AS bin, sum(l_extendedprice) AS w FROM lineitem GROUP BY ALL) SELECT l_returnflag, bin, round(sum(w) OVER (PARTITION BY l_returnflag ORDER BY bin) / sum(w) OVER (PARTITION BY l_returnflag), 6) AS cdf FROM s")
def price_cdf(spark, sf_dir):
    found = statistics.weighted_cdf(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.floor(F.col("l_quantity") / 5), F.col("l_extendedprice"))
    return found.select("l_returnflag", "bin", r6("cdf").alias("cdf"))


@query("""SELECT DISTINCT '"' || r_name || '" -> "' || n_name || '";' AS line FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def dot_graph(spark, sf_dir):
    """Regions and the nations of their customers as the lines of a drawing."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    edges = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return graph.dot_lines(edges, "r_name", "n_name")
