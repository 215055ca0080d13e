"""The engine's operators over the driver's tables, each with equivalent SQL.

The tables hold no boxes, flows or images, so some queries derive them from lineitem columns; each says how.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes, colour, distance
from ..operators import cluster, graph, grids, intervals, nearest, overlap, registration, search, statistics, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


# --- neighbours ---------------------------------------------------------------------------------

PAIRS = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT a.vec_id AS id, a.label AS truth, b.vec_id AS other, b.label AS label, {dist} AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS rank FROM p)
"""
SQ = "list_sum(list_transform(range(1, len(a.e) + 1), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i])))"
L1 = "list_sum(list_transform(range(1, len(a.e) + 1), lambda i: abs(a.e[i] - b.e[i])))"
COS = "1 - list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x))))"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def neighbours(spark: SparkSession, sf_dir: str, k: int, metric: str = "sqeuclidean") -> DataFrame:
    v = vectors(spark, sf_dir)
    return nearest.nearest(v, v, k, metric, "label")


@query(PAIRS.format(dist=SQ) + "SELECT truth, label AS predicted, count(*) AS n FROM n WHERE rank = 1 GROUP BY ALL")
def knn1_confusion(spark, sf_dir):
    """Leave-one-out nearest neighbour, and its confusion matrix."""
    found = neighbours(spark, sf_dir, 1).withColumnRenamed("label", "predicted")
    truth = vectors(spark, sf_dir).select("id", F.col("label").alias("truth"))
    return nearest.confusion(found.join(truth, "id"), "truth", "predicted")


@query(PAIRS.format(dist=SQ) + ", c AS (SELECT id, truth, label, count(*) AS n FROM n WHERE rank <= 5 GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS r FROM c) SELECT id, label AS predicted FROM b WHERE r = 1")
def knn5_vote(spark, sf_dir):
    return nearest.vote(neighbours(spark, sf_dir, 5), "label")


@query(PAIRS.format(dist=L1) + "SELECT id, other, round(dist, 6) AS dist FROM n WHERE rank = 1")
def nearest_l1(spark, sf_dir):
    return neighbours(spark, sf_dir, 1, "l1").select("id", "other", r6("dist").alias("dist"))


@query(PAIRS.format(dist=COS) + "SELECT id, other, round(dist, 6) AS dist FROM n WHERE rank <= 3")
def nearest_cosine(spark, sf_dir):
    return neighbours(spark, sf_dir, 3, "cosine").select("id", "other", r6("dist").alias("dist"))


@query(PAIRS.format(dist=SQ) + "SELECT a.id AS a, a.other AS b FROM n a JOIN n b ON a.rank = 1 AND b.rank = 1 AND a.other = b.id AND b.other = a.id WHERE a.id < a.other")
def cross_check(spark, sf_dir):
    """Forward and backward neighbours that agree."""
    return nearest.mutual(neighbours(spark, sf_dir, 1))


CENTRES = """
WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY ALL),
d AS (SELECT vec_id AS id, c.label AS centre, sum((x - m) * (x - m)) AS dist FROM e JOIN c USING (i) GROUP BY ALL)
"""


def centres(v: DataFrame) -> DataFrame:
    parts = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    return parts.groupBy(F.col("label").cast("long").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("v"))


@query(CENTRES + "SELECT id, centre, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, centre) AS r FROM d) WHERE r = 1")
def centroid_assign(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return nearest.assign_to_centres(v, centres(v)).select("id", F.col("centre").cast("int").alias("centre"), r6("dist").alias("dist"))


@query(CENTRES + "SELECT centre, count(*) AS n, round(sum(dist), 5) AS spread FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, centre) AS r FROM d) WHERE r = 1 GROUP BY ALL")
def cluster_spread(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return nearest.assign_to_centres(v, centres(v)).groupBy(F.col("centre").cast("int").alias("centre")).agg(F.count("*").alias("n"), F.round(F.sum("dist"), 5).alias("spread"))


# --- statistics ---------------------------------------------------------------------------------


def case_bins(value: str, edges: list[float]) -> str:
    return "CASE " + f"WHEN {value} = {edges[-1]} THEN {len(edges) - 1} " + " ".join(f"WHEN {value} >= {a} AND {value} < {b} THEN {i + 1}" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))) + " ELSE 0 END"


QUANTITY, DISCOUNT, PRICE = [1.0, 10.0, 20.0, 30.0, 40.0, 50.0], [0.0, 0.025, 0.055, 0.1], [900.0, 1000.0, 1200.0, 1500.0, 1800.0, 2100.0]


@query(f"WITH b AS (SELECT {case_bins('l_quantity', QUANTITY)} AS q, l_extendedprice AS w FROM lineitem) SELECT q, round(sum(w) / (SELECT sum(w) FROM b WHERE q > 0), 9) AS share FROM b WHERE q > 0 GROUP BY q")
def hist_weighted(spark, sf_dir):
    h = statistics.histogram(table(spark, sf_dir, "lineitem"), {"q": statistics.bin_of(F.col("l_quantity"), QUANTITY)}, F.col("l_extendedprice"))
    return h.select("q", F.round("share", 9).alias("share"))


@query(f"WITH b AS (SELECT {case_bins('l_quantity', QUANTITY)} AS q, {case_bins('l_discount', DISCOUNT)} AS d FROM lineitem) SELECT q, d, round(count(*) / (SELECT count(*) FROM b WHERE q > 0 AND d > 0), 9) AS share FROM b WHERE q > 0 AND d > 0 GROUP BY q, d")
def hist_2d(spark, sf_dir):
    bins = {"q": statistics.bin_of(F.col("l_quantity"), QUANTITY), "d": statistics.bin_of(F.col("l_discount"), DISCOUNT)}
    return statistics.histogram(table(spark, sf_dir, "lineitem"), bins, F.lit(1)).select("q", "d", F.round("share", 9).alias("share"))


@query(f"SELECT p_partkey, {case_bins('p_retailprice', PRICE)} AS bin FROM part")
def assign_bins(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", statistics.bin_of(F.col("p_retailprice"), PRICE).alias("bin"))


@query("""WITH m AS (SELECT l_returnflag, l_quantity AS v, sum(l_linenumber) AS w FROM lineitem GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS run, sum(w) OVER (PARTITION BY l_returnflag) AS total, lead(v) OVER (PARTITION BY l_returnflag ORDER BY v) AS nxt FROM m)
SELECT l_returnflag, min_by(CASE WHEN run * 2 = total THEN (v + coalesce(nxt, v)) / 2 ELSE v END, v) AS median FROM r WHERE run * 2 >= total GROUP BY ALL""")
def weighted_median(spark, sf_dir):
    return statistics.weighted_median(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_linenumber")


@query("SELECT round(avg(l_quantity), 6) AS mean_l_quantity, round(avg(l_discount), 6) AS mean_l_discount, round(covar_pop(l_quantity, l_quantity), 4) AS cov_l_quantity_l_quantity, round(covar_pop(l_quantity, l_discount), 4) AS cov_l_quantity_l_discount, round(covar_pop(l_discount, l_discount), 4) AS cov_l_discount_l_discount FROM lineitem")
def mean_cov(spark, sf_dir):
    m = statistics.pca_moments(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    return m.select(*(F.round(c, 6 if c.startswith("mean") else 4).alias(c) for c in m.columns))


@query("WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders) SELECT o_orderkey, round(greatest(-2, least(2, (o_totalprice - m) / s)), 6) AS z FROM orders, s")
def zscore_clip(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    z = (F.col("o_totalprice") - o.agg(F.avg("o_totalprice")).scalar()) / o.agg(F.stddev_pop("o_totalprice")).scalar()
    return o.select("o_orderkey", r6(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), z))).alias("z"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c) SELECT user_id, round(-sum(p * ln(greatest(p, 1e-6))), 6) + 0.0 AS entropy FROM p GROUP BY ALL")
def entropy_by_user(spark, sf_dir):
    return statistics.entropy(table(spark, sf_dir, "events"), "user_id", "event_type").select("user_id", (r6("entropy") + F.lit(0.0)).alias("entropy"))


@query("SELECT l_returnflag, round(exp(avg(ln(greatest(l_discount, 1e-10)))), 9) AS g FROM lineitem GROUP BY ALL")
def geometric_mean(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(statistics.geometric_mean(F.col("l_discount")), 9).alias("g"))


@query("""WITH c AS (SELECT n_chars AS score, count(*) FILTER (quality = 1) AS t, count(*) FILTER (quality <> 1) AS f FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY ALL),
r AS (SELECT score, CAST(sum(t) OVER w AS BIGINT) AS tp, CAST(sum(f) OVER w AS BIGINT) AS fp FROM c WINDOW w AS (ORDER BY score DESC))
SELECT score, tp, fp, round(tp / (SELECT sum(t) FROM c), 9) AS recall, round(fp / (SELECT sum(f) FROM c), 9) AS fall_out, round(tp / (tp + fp), 9) AS precision FROM r""")
def roc_points(spark, sf_dir):
    """Length as a score of quality."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("n_chars", "quality")
    found = statistics.roc(rows, "n_chars", "quality")
    return found.select("score", "tp", "fp", *(F.round(c, 9).alias(c) for c in ("recall", "fall_out", "precision")))


@query("SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL")
def conf_matrix(spark, sf_dir):
    return nearest.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("SELECT l_returnflag, count(*) AS n, round(avg(sqrt((l_discount * 100 - l_tax * 100) ** 2 + (l_linenumber - l_quantity) ** 2)), 6) AS epe, round(avg(degrees(acos(greatest(-1, least(1, ((l_discount * 100) * (l_tax * 100) + l_linenumber * l_quantity + 1) / sqrt(((l_discount * 100) ** 2 + l_linenumber ** 2 + 1) * ((l_tax * 100) ** 2 + l_quantity ** 2 + 1))))))), 6) AS angle FROM lineitem WHERE l_quantity <= 40 GROUP BY ALL")
def flow_error(spark, sf_dir):
    """Flows (100 discount, line number) and (100 tax, quantity) at each line, where both are within 40."""
    a = (F.col("l_discount") * 100, F.col("l_linenumber").cast("double"))
    b = (F.col("l_tax") * 100, F.col("l_quantity"))
    rows = table(spark, sf_dir, "lineitem").where(distance.valid_flow(*a, 40.0) & distance.valid_flow(*b, 40.0))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), r6(F.avg(distance.end_point_error(*a, *b))).alias("epe"), r6(F.avg(distance.angular_error(*a, *b))).alias("angle"))


@query("SELECT o_orderpriority, count(*) AS n, round(count(*) FILTER (abs(o_totalprice - total) <= 1000) / count(*), 9) AS precision FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey GROUP BY ALL")
def match_precision(spark, sf_dir):
    """Share of orders whose price is within 1000 of their lines' sum; orders without lines count below the line."""
    totals = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("total"))
    rows = table(spark, sf_dir, "orders").join(totals, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.count_if(F.abs(F.col("o_totalprice") - F.col("total")) <= 1000) / F.count("*"), 9).alias("precision"))


# --- windows and timelines ----------------------------------------------------------------------

BY_USER = (["user_id"], ["ts", "event_id"])
FRAME = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"


@query(f"SELECT event_id, round(sum(value) OVER w, 6) AS s, max(value) OVER w AS top, min(value) OVER w AS low FROM events WINDOW w AS {FRAME}")
def moving_sum_max(spark, sf_dir):
    rows = windows.moving(table(spark, sf_dir, "events"), *BY_USER, 3, s=F.sum("value"), top=F.max("value"), low=F.min("value"))
    return rows.select("event_id", r6("s").alias("s"), "top", "low")


@query(f"WITH l AS (SELECT event_id, list_sort(list(value) OVER w) AS v FROM events WINDOW w AS {FRAME}) SELECT event_id, v[(len(v) + 1) // 2] AS median FROM l")
def moving_median(spark, sf_dir):
    return windows.moving_median(table(spark, sf_dir, "events"), *BY_USER, 3, "value", "median").select("event_id", "median")


@query(f"""WITH l AS (SELECT event_id, list(event_type) OVER w AS v FROM events WINDOW w AS {FRAME}), u AS (SELECT event_id, unnest(v) AS t FROM l), c AS (SELECT event_id, t, count(*) AS n FROM u GROUP BY ALL)
SELECT event_id, t AS mode FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, t) AS r FROM c) WHERE r = 1""")
def moving_mode(spark, sf_dir):
    return windows.moving_mode(table(spark, sf_dir, "events"), *BY_USER, 3, "event_type", "mode").select("event_id", "mode")


@query(f"SELECT event_id, value FROM (SELECT *, max(value) OVER w AS top FROM events WINDOW w AS {FRAME}) WHERE value = top AND value > 10")
def local_maxima(spark, sf_dir):
    return windows.local_maxima(table(spark, sf_dir, "events"), *BY_USER, 3, "value", 10.0).select("event_id", "value")


ISLANDS = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
g AS (SELECT user_id, event_type, CAST(min(i) AS BIGINT) AS first, CAST(max(i) AS BIGINT) AS last, count(*) AS n FROM r GROUP BY user_id, event_type, i - k)"""


def islands(spark, sf_dir):
    return intervals.condense(table(spark, sf_dir, "events"), *BY_USER, "event_type")


@query(ISLANDS + "SELECT user_id, event_type, first, last, n FROM g")
def interval_condense(spark, sf_dir):
    return islands(spark, sf_dir)


@query(ISLANDS + "SELECT user_id, event_type, unnest(range(first, last + 1)) AS frame FROM g")
def interval_expand(spark, sf_dir):
    return intervals.expand(islands(spark, sf_dir).drop("n"), "first", "last", "frame")


@query(ISLANDS + "SELECT user_id, event_type, greatest(first, 5) - 5 AS first, least(last, 20) - 5 AS last, n FROM g WHERE first <= 20 AND last >= 5")
def interval_crop(spark, sf_dir):
    return intervals.crop(islands(spark, sf_dir), "first", "last", 5, 20)


@query("WITH b AS (SELECT user_id, ts, max(event_id) AS last_buy FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT e.event_id, b.last_buy FROM events e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.ts >= b.ts")
def interval_lookup(spark, sf_dir):
    """The last purchase of each event's user."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    buys = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_buy"))
    return intervals.as_of(e, buys, ["user_id"], "ts", ["last_buy"]).select("event_id", "last_buy")


@query("""WITH d AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS d FROM events), m AS (SELECT user_id, quantile_cont(d, 0.5) AS m FROM d WHERE d IS NOT NULL GROUP BY ALL)
SELECT user_id, round(CASE WHEN avg(d) > 0 THEN 1 / avg(d) END, 9) AS rate FROM d JOIN m USING (user_id) WHERE d < 3 * m OR m = 0 GROUP BY ALL""")
def robust_rate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return intervals.robust_rate(e, ["user_id"], "t").select("user_id", F.round("rate", 9).alias("rate"))


@query("WITH p AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events) SELECT a.event_id FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE a.event_type = b.event_type AND abs(a.t - b.t) <= 600 AND (b.value > a.value OR (b.value = a.value AND b.event_id < a.event_id)))")
def radius_suppress(spark, sf_dir):
    """Events without a greater one of their type within ten minutes."""
    e = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("t"), "value")
    return overlap.suppress_near(e, "event_type", "t", "value", 600).select(F.col("id").alias("event_id"))


# --- boxes: of an order's lines, x = 7 line number, y = supplier mod 97, w = quantity, h = 100 discount + 1, score = price ---

BOX_SQL = "b AS (SELECT l_orderkey AS img, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity, l_discount, l_extendedprice) AS id, CAST(l_linenumber * 7 AS DOUBLE) AS x, CAST(l_suppkey % 97 AS DOUBLE) AS y, l_quantity AS w, l_discount * 100 + 1 AS h, l_extendedprice AS score FROM lineitem)"
IOU_SQL = f"WITH {BOX_SQL}, o AS (SELECT a.img, a.id, c.id AS other, a.score AS sa, c.score AS sb, greatest(0, least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x)) * greatest(0, least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y)) AS i, a.w * a.h + c.w * c.h AS s FROM b a JOIN b c ON a.img = c.img AND a.id < c.id)"


def line_boxes(spark, sf_dir):
    """Boxes numbered within their order (img), so that no two have one name."""
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("img"), F.row_number().over(place).cast("long").alias("id"), (F.col("l_linenumber") * 7).cast("double").alias("x"), (F.col("l_suppkey") % 97).cast("double").alias("y"),
        F.col("l_quantity").alias("w"), (F.col("l_discount") * 100 + 1).alias("h"), F.col("l_extendedprice").alias("score"),
    )


@query(IOU_SQL + "SELECT img, id, other, round(i / (s - i), 6) AS iou FROM o WHERE i > 0")
def iou_pairs(spark, sf_dir):
    return overlap.overlaps(line_boxes(spark, sf_dir), "img").select("img", "id", "other", r6("iou").alias("iou"))


@query(IOU_SQL + "SELECT img, id, x, y, w, h, score FROM b WHERE (img, id) NOT IN (SELECT (img, CASE WHEN sa >= sb THEN other ELSE id END) FROM o WHERE i > 0 AND i / (s - i) > 0.2)")
def nms_max(spark, sf_dir):
    return overlap.suppress(line_boxes(spark, sf_dir), "img", 0.2)


@query(f"WITH {BOX_SQL} SELECT img, id, round(x + w / 2, 6) AS cx, round(y + h / 2, 6) AS cy, round(w * h, 6) AS area, round(x + w / 2 - sqrt(w * h) / 2, 6) AS square_x, round(sqrt(w * h), 6) AS square_w, round(x - w / 4, 6) AS wide_x, round(w * 1.5, 6) AS wide_w FROM b")
def box_ops(spark, sf_dir):
    b = boxes.box()
    cx, cy = boxes.centre(b)
    square, wide = boxes.squarify(b), boxes.resize(b, 1.0, 1.5)
    named = {"cx": cx, "cy": cy, "area": boxes.area(b), "square_x": square[0], "square_w": square[2], "wide_x": wide[0], "wide_w": wide[2]}
    return line_boxes(spark, sf_dir).select("img", "id", *(r6(c).alias(k) for k, c in named.items()))


# --- search -------------------------------------------------------------------------------------

POSTINGS = r"""WITH p AS (SELECT word, doc_id, count(*) AS freq FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[\s!-/:-@\[-^`{-~]+')) AS word FROM documents) WHERE length(word) > 2 GROUP BY ALL)"""


def postings(spark, sf_dir):
    return search.index(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(POSTINGS + "SELECT word, CAST(sum(freq) AS BIGINT) AS freq, count(*) AS docs FROM p GROUP BY ALL")
def term_freq(spark, sf_dir):
    return postings(spark, sf_dir).groupBy("word").agg(F.sum("freq").alias("freq"), F.count("*").alias("docs"))


@query(POSTINGS + "SELECT lang, count(DISTINCT word) AS vocab FROM p JOIN documents USING (doc_id) GROUP BY ALL")
def vocab_size(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return postings(spark, sf_dir).join(langs, "doc_id").groupBy("lang").agg(F.count_distinct("word").alias("vocab"))


@query(POSTINGS + "SELECT doc_id, word, freq FROM p WHERE starts_with(word, 'licen') OR starts_with(word, 'pass')")
def prefix_postings(spark, sf_dir):
    return search.prefix_hits(postings(spark, sf_dir), ["licen", "pass"]).select("doc_id", "word", "freq")


@query(POSTINGS + """, h AS (SELECT doc_id, 0 AS q, word, freq FROM p WHERE starts_with(word, 'the') UNION ALL SELECT doc_id, 1, word, freq FROM p WHERE starts_with(word, 'ing')),
f AS (SELECT doc_id, count(*) AS hits, list_reduce(list(freq / total ORDER BY q, word), lambda r, x: (r + x) * 2) AS r FROM h JOIN (SELECT q, sum(freq) AS total FROM h GROUP BY q) USING (q) GROUP BY doc_id) SELECT doc_id, hits, round(r * 100 / (SELECT max(r) FROM f), 6) AS rank FROM f""")
def search_ranked(spark, sf_dir):
    return search.ranked(postings(spark, sf_dir), "doc_id", ["the", "ing"]).select("doc_id", "hits", r6("rank").alias("rank"))


@query(POSTINGS + "SELECT doc_id FROM p WHERE word IN ('the', 'and') GROUP BY ALL HAVING count(*) = 2 AND doc_id NOT IN (SELECT doc_id FROM p WHERE word = 'was')")
def search_required_forbidden(spark, sf_dir):
    return search.filtered(postings(spark, sf_dir), "doc_id", ["the", "and"], ["was"])


# --- graphs, grids, registration, sets ------------------------------------------------------------

TRADE = "t AS (SELECT DISTINCT l_orderkey AS a, 1000000000 + l_suppkey AS b FROM lineitem)"


@query(f"""WITH RECURSIVE {TRADE}, e AS (SELECT a, b FROM t UNION ALL SELECT b, a FROM t),
c(node, component) USING KEY (node) AS (SELECT a, least(min(a), min(b)) FROM e GROUP BY a UNION SELECT e.a, min(c.component) FROM c JOIN e ON e.b = c.node JOIN recurring.c AS r ON r.node = e.a GROUP BY e.a, r.component HAVING min(c.component) < r.component)
SELECT node, component FROM c""")
def trade_components(spark, sf_dir):
    """Components of orders and suppliers (their keys from 10^9) that share a line."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), (F.lit(1000000000) + F.col("l_suppkey")).cast("long").alias("dst"))
    return graph.components(e)


GRID = "c AS (SELECT CAST(l_linenumber AS BIGINT) AS x, l_orderkey AS y, l_returnflag AS flag, l_quantity AS v FROM lineitem)"


@query(f"WITH {GRID}, m AS (SELECT least(p.flag, q.flag) AS a, greatest(p.flag, q.flag) AS b, least(p.v, q.v) AS v FROM c p JOIN c q ON ((q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1)) AND p.flag <> q.flag) SELECT a, b, count(*) AS n, min(v) AS least FROM m GROUP BY a, b")
def region_adjacency(spark, sf_dir):
    """Return flags on the grid of line number by order."""
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("x"), F.col("l_orderkey").alias("y"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("v"))
    return graph.adjacency(cells, "flag", "v")


FEATURES = ["l_quantity", "l_discount", "l_tax"]


@query("SELECT " + ", ".join(f"round(sum({a} * {b}), 2) AS s_{x}_{y}" for i, (x, a) in enumerate(ns) for y, b in ns[i:] if x != "t") + " FROM lineitem" if (ns := [("one", "1.0::DOUBLE"), *((f, f) for f in FEATURES), ("t", "l_extendedprice")]) else "")
def affine_fit_sums(spark, sf_dir):
    sums = registration.normal_equations(table(spark, sf_dir, "lineitem"), FEATURES, "l_extendedprice")
    return sums.select(*(F.round(c, 2).alias(c) for c in sums.columns))


@query("""WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), a AS (SELECT unnest([-1.0, -0.5, 0.0, 0.5, 1.0]) AS c)
SELECT vec_id, round(sum(-sqrt((x - p.c) ** 2 + (y - q.c) ** 2 + (z - r.c) ** 2)), 5) AS s FROM v, a p, a q, a r GROUP BY vec_id""")
def tps_basis_eval(spark, sf_dir):
    """Sum of the 125 kernels of a 5 x 5 x 5 grid on [-1, 1] at the first three coordinates."""
    e = [F.col("embedding")[i].cast("double") for i in range(3)]
    basis = registration.tps_basis(*e, registration.linspace_grid((-1, -1, -1), (1, 1, 1), 5))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(basis, F.lit(0.0), lambda s, x: s + x), 5).alias("s"))


@query("SELECT l_returnflag, round(sum(exp(-((l_discount - l_tax) ** 2) / 0.0025)), 4) AS g FROM lineitem GROUP BY ALL")
def gauss_transform(spark, sf_dir):
    """Kernel sum over the given pairs (discount, tax), scale 0.05."""
    d2 = (F.col("l_discount") - F.col("l_tax")) * (F.col("l_discount") - F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(registration.pair_gauss(d2, 0.05), 4).alias("g"))


def lab_sql(r: str, g: str, b: str) -> str:
    lin = lambda c: f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE (({c} / 255.0::DOUBLE + 0.055) / 1.055) ** 2.4 END"
    rows = [f"({m[0]} * rl + {m[1]} * gl + {m[2]} * bl) / {w}" for m, w in zip(colour.RGB_TO_XYZ, colour.WHITE, strict=True)]
    f = lambda t: f"CASE WHEN {t} > 0.008856451679035631 THEN {t} ** (1.0::DOUBLE / 3) ELSE {t} * 7.787037037037037 + 16.0::DOUBLE / 116 END"
    return f"WITH l AS (SELECT p_partkey, {lin(r)} AS rl, {lin(g)} AS gl, {lin(b)} AS bl FROM part), t AS (SELECT p_partkey, {rows[0]} AS x, {rows[1]} AS y, {rows[2]} AS z FROM l), u AS (SELECT p_partkey, {f('x')} AS x, {f('y')} AS y, {f('z')} AS z FROM t)"


@query(lab_sql("(p_partkey % 256)", "(p_size * 5)", "(p_partkey * 7 % 256)") + "SELECT p_partkey, round(116 * y - 16, 4) AS l, round(500 * (x - y), 4) AS a, round(200 * (y - z), 4) AS b FROM u")
def lab_convert(spark, sf_dir):
    """Red = key mod 256, green = 5 size, blue = 7 key mod 256."""
    lab = colour.rgb_to_lab(F.col("p_partkey") % 256, F.col("p_size") * 5, F.col("p_partkey") * 7 % 256)
    return table(spark, sf_dir, "part").select("p_partkey", *(F.round(c, 4).alias(k) for k, c in zip("lab", lab, strict=True)))


@query("SELECT DISTINCT CAST(floor(p_retailprice / 50) AS BIGINT) AS q, p_size FROM part")
def quant_distinct(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.floor(F.col("p_retailprice") / 50).alias("q"), "p_size").distinct()


@query("SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY ALL")
def pivot_hist(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().na.fill(0)


@query("SELECT u.conv_id, u.turn, length(u.text) AS asked, length(a.text) AS answered FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'")
def dual_zip(spark, sf_dir):
    """Each user turn beside the answer that follows."""
    c = table(spark, sf_dir, "conversations")
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("answered"))
    return c.where("role = 'user'").select("conv_id", "turn", F.length("text").cast("long").alias("asked")).join(answers, ["conv_id", "turn"])


@query("WITH m AS (SELECT o_custkey, year(o_orderdate) % 2 AS odd, count(*) AS n FROM orders GROUP BY ALL) SELECT coalesce(a.o_custkey, b.o_custkey) AS custkey, a.n AS even_n, b.n AS odd_n FROM (SELECT * FROM m WHERE odd = 0) a FULL JOIN (SELECT * FROM m WHERE odd = 1) b ON a.o_custkey = b.o_custkey WHERE a.n IS DISTINCT FROM b.n")
def full_outer_diff(spark, sf_dir):
    """Customers whose orders of even and odd years differ in number."""
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey"), (F.year("o_orderdate") % 2).alias("odd")).agg(F.count("*").alias("n"))
    even, odd = (m.where(F.col("odd") == k).select("custkey", F.col("n").alias(c)) for k, c in ((0, "even_n"), (1, "odd_n")))
    return even.join(odd, "custkey", "full").where(~F.col("even_n").eqNullSafe(F.col("odd_n")))


@query("SELECT kind, count(*) AS n, round(avg(v), 6) AS mean FROM (SELECT 'customer' AS kind, c_acctbal AS v FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier) GROUP BY ALL")
def union_views(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("v"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("v"))
    return c.unionByName(s).groupBy("kind").agg(F.count("*").alias("n"), r6(F.avg("v")).alias("mean"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_k(spark, sf_dir):
    """A report: each customer's three largest orders."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey")


# --- grids, memberships, curves at references ------------------------------------------------------


@query(f"WITH {GRID}, u AS (SELECT x, y, sum(v) AS v FROM c GROUP BY ALL), a AS (SELECT x, y, sum(v) OVER (PARTITION BY y ORDER BY x) AS s FROM u) SELECT x, y, round(sum(s) OVER (PARTITION BY x ORDER BY y), 4) AS total FROM a")
def integral_sums(spark, sf_dir):
    """Quantities on the grid of line number by order."""
    return grids.integral(quantity_cells(spark, sf_dir), "v", "total").select("x", "y", F.round("total", 4).alias("total"))


def quantity_cells(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("x"), F.col("l_orderkey").alias("y")).agg(F.sum("l_quantity").alias("v"))


@query(f"WITH {GRID}, u AS (SELECT x, y, sum(v) AS v FROM c GROUP BY ALL) SELECT CAST(floor(x / 3) AS BIGINT) AS block_x, CAST(floor(y / 3) AS BIGINT) AS block_y, round(sum(v), 4) AS total, max(v) AS top, min(v) AS low, count(*) AS n FROM u GROUP BY 1, 2")
def block_sums(spark, sf_dir):
    return grids.block_sums(quantity_cells(spark, sf_dir), "v", 3).withColumn("total", F.round("total", 4))


@query("SELECT l_linenumber AS x1, l_orderkey AS y1, round(l_linenumber + l_discount * 100, 6) AS x2, round(l_orderkey + l_tax * 100, 6) AS y2 FROM lineitem WHERE l_discount * 100 <= 5 AND l_tax * 100 <= 5")
def flow_matches(spark, sf_dir):
    """Matches of the flow (100 discount, 100 tax) at (line number, order), where both are within 5."""
    flow = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("x"), F.col("l_orderkey").alias("y"), (F.col("l_discount") * 100).alias("u"), (F.col("l_tax") * 100).alias("v"))
    return grids.flow_to_matches(flow, distance.valid_flow(F.col("u"), F.col("v"), 5.0)).select("x1", "y1", r6("x2").alias("x2"), r6("y2").alias("y2"))


@query("SELECT x + dx AS x, y + dy AS y, max(k) AS k FROM (SELECT p_size AS x, CAST(floor(p_retailprice / 10) AS BIGINT) AS y, p_partkey AS k FROM part), (SELECT unnest(range(-1, 2)) AS dx), (SELECT unnest(range(-1, 2)) AS dy) GROUP BY ALL")
def splat_seeds(spark, sf_dir):
    """Parts as seeds at (size, price / 10), each over 3 x 3 cells; the largest key wins."""
    seeds = table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("x"), F.floor(F.col("p_retailprice") / 10).alias("y"), F.col("p_partkey").alias("k")).withColumn("order", F.col("k"))
    return grids.splat(seeds, 1, 1, ["k"], "order")


@query("SELECT p_partkey, printf('%02d%02d.png', (p_size - 1) // 15, (p_size - 1) % 15) AS name, greatest(0, least(29, p_size - 10)) AS clamped, p_size < 30 AND p_retailprice < 1500 AS inside, bit_count(xor(p_partkey, CAST(p_size AS BIGINT))) AS hamming FROM part")
def view_names(spark, sf_dir):
    """Names of views, the part's size as their place, and scalar predicates."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", grids.view_name(F.col("p_size")).alias("name"), grids.clamp(F.col("p_size") - 10, 30).alias("clamped"), grids.inside(F.col("p_size"), F.col("p_retailprice"), 30, 1500).alias("inside"), distance.hamming(F.col("p_partkey"), F.col("p_size").cast("long")).cast("tinyint").alias("hamming"))


@query(CENTRES + ", w AS (SELECT id, centre, exp(-dist / 4) AS w FROM d) SELECT id, centre, round(w / sum(w) OVER (PARTITION BY id), 6) AS m FROM w")
def softmin_membership(spark, sf_dir):
    """Share of each centre at a vector: exp(-d / sigma^2), sigma 2, normalised."""
    v = vectors(spark, sf_dir)
    c = centres(v).count()
    found = nearest.nearest(v.select((-F.col("id") - 1).alias("id"), "v"), centres(v), c)
    w = found.select((-F.col("id") - 1).alias("id"), F.col("other").cast("int").alias("centre"), F.exp(-F.col("dist") / 4).alias("w"))
    return w.select("id", "centre", r6(F.col("w") / F.sum("w").over(Window.partitionBy("id"))).alias("m"))


@query("""WITH c AS (SELECT n_chars AS score, count(*) FILTER (quality = 1) AS t, count(*) FILTER (quality <> 1) AS f FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY ALL),
r AS (SELECT score, sum(t) OVER w / (SELECT sum(t) FROM c) AS recall, sum(f) OVER w / (SELECT sum(f) FROM c) AS fall_out FROM c WINDOW w AS (ORDER BY score DESC)), q AS (SELECT unnest([0.01, 0.1, 0.25, 0.5, 0.75]) AS ref)
SELECT CAST(ref AS DOUBLE) AS ref, round(coalesce(max(recall), 0), 9) AS recall FROM q LEFT JOIN r ON fall_out <= ref GROUP BY ref""")
def roc_at_reference(spark, sf_dir):
    """Recall reached at given shares of false positives."""
    refs = [0.01, 0.1, 0.25, 0.5, 0.75]
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("n_chars", "quality")
    best = statistics.roc(rows, "n_chars", "quality").agg(*(F.coalesce(F.max(F.when(F.col("fall_out") <= r, F.col("recall"))), F.lit(0.0)).alias(f"r{i}") for i, r in enumerate(refs)))
    pairs = F.array(*(F.struct(F.lit(r).alias("ref"), F.round(f"r{i}", 9).alias("recall")) for i, r in enumerate(refs)))
    return best.select(F.explode(pairs).alias("p")).select("p.ref", "p.recall")


def nms_greedy(spark, sf_dir):
    """Rows of boxes kept by greedy suppression; order-dependent, so without SQL."""
    return overlap.suppress_greedy(line_boxes(spark, sf_dir), "img", 0.2)


def nms_cover(spark, sf_dir):
    """Boxes kept by greedy cover; order-dependent, so without SQL."""
    return overlap.suppress_cover(line_boxes(spark, sf_dir), "img", 0.2)


def eval_res(spark, sf_dir):
    """Boxes of the first half of an order's lines matched to those of the second; every fifth of these is to be ignored."""
    b = line_boxes(spark, sf_dir)
    return overlap.evaluate(b.where("id <= 3"), b.where("id > 3").withColumn("ignore", (F.col("img") % 5 == 0).cast("int")), "img", 0.1)


def eval_roc(spark, sf_dir):
    found = overlap.evaluation_roc(eval_res(spark, sf_dir))
    return found.select("score", "tp", "fp", r6("recall").alias("recall"), r6("precision").alias("precision"))


def kmeans_clusters(spark, sf_dir):
    found, _ = cluster.kmeans(vectors(spark, sf_dir).select("id", "v"), 8)
    return found.select("id", F.col("centre").cast("int").alias("centre"), r6("dist").alias("dist"))


def trade_edges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("src"), (F.lit(1000000000) + F.col("l_suppkey")).cast("long").alias("dst"), F.col("l_extendedprice").alias("w"))


def trade_spanning_forest(spark, sf_dir):
    return graph.spanning_forest(trade_edges(spark, sf_dir))


@query("""WITH RECURSIVE t AS (SELECT l_orderkey AS a, 1000000000 + l_suppkey AS b, l_extendedprice AS w FROM lineitem), e AS (SELECT a, b, min(w) AS w FROM (SELECT a, b, w FROM t UNION ALL SELECT b, a, w FROM t) GROUP BY ALL),
p(node, dist) USING KEY (node) AS (SELECT 1000000001, 0.0::DOUBLE UNION SELECT e.b, min(p.dist + e.w) FROM p JOIN e ON e.a = p.node LEFT JOIN recurring.p AS r ON r.node = e.b GROUP BY e.b, r.dist HAVING r.dist IS NULL OR min(p.dist + e.w) < r.dist)
SELECT node, round(dist, 4) AS dist FROM p""")
def trade_paths(spark, sf_dir):
    """Cheapest ways from supplier 1, over lines in either direction."""
    e = trade_edges(spark, sf_dir)
    return graph.shortest_paths(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), 1000000001).select("node", F.round("dist", 4).alias("dist"))


for _fn in (nms_greedy, nms_cover, eval_res, eval_roc, kmeans_clusters, trade_spanning_forest):
    QUERIES[_fn.__name__] = _fn

# Registers its own queries; at the end, as it uses what stands above.
from . import model_queries, raster_queries  # noqa: E402, F401

QUERIES["approximate_counts"] = raster_queries.approximate_counts
