"""Benchmark items inside documents, in DataFrame expressions only.

Windows of a document are as many shingles of five words as the item they are held against. A window as similar
as asked for holds at least ``need`` shingles of items of its size, in any order, and none with fewer is looked at. Of
those that are left, only windows that begin with such a shingle (or end with the document) are taken: any
other window holds no more of them than one of these.

A window's 64-bit SimHash is cut into 16 blocks of four bits; items are indexed by size under each block's
value and its four one-bit neighbours, so that every fingerprint within ``RADIUS`` bits (at most 31: some
block then differs by at most one bit) meets its item. The index alone proposes items. What remains is
verified exactly: weighted Jaccard similarity of the shingles, weights being how often each occurs.

At similarity 0.8 two fingerprints differ by 10 bits of 64 on average, with deviation 3.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, fresh, materialize, table

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS, BLOCK_BITS = 24, 16, 4
#: Shingles of items that one pass broadcasts; more items are taken in blocks, one pass over the documents each.
BLOCK_SHINGLES = 250_000
#: Windows (two numbers each) that are broadcast to fetch their texts again; more are joined by a shuffle.
BROADCAST_STARTS = 300_000

WORDS = r"array_remove(split(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), '')"
HASHES = (
    f"CASE WHEN size(_words) >= {SHINGLE} THEN transform(sequence(0, size(_words) - {SHINGLE}), i -> xxhash64({', '.join(f'_words[i + {k}]' for k in range(SHINGLE))}))"
    " WHEN size(_words) > 0 THEN array(xxhash64(array_join(_words, ' '))) ELSE array() END"
)
#: Majority of each bit over the array ``_s`` of hashes.
SIMHASH = "aggregate(sequence(0, 63), 0L, (f, b) -> if(2 * aggregate(_s, 0, (a, h) -> a + cast(shiftrightunsigned(h, b) & 1 AS int)) > size(_s), f | shiftleft(1L, b), f))"


def shingled(texts: DataFrame) -> DataFrame:
    """``texts`` with ``_hashes``: a hash for each five words, in order; one for fewer words, none for no word or a null text."""
    return texts.withColumn("_words", F.expr(WORDS)).withColumn("_hashes", F.expr(HASHES)).drop("_words", "text")


def starts(docs: DataFrame, items: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """(keys, _size, _start) of the windows that hold enough shingles of items of ``_size``, each once.

    A window of w shingles (_size, or the whole of a shorter document) shares at least similarity * (w + _size) / (1 + similarity)
    with an item that is similar enough. ``_p`` is the places of the document's shingles that items of this size have; a window
    that begins at place i of it holds that many if the place that many further on lies inside.
    """
    places = items.select(F.size("_hashes").alias("_size"), F.explode("_hashes").alias("_h")).distinct()
    # Only numbers go through the explosion. Its outer form keeps Catalyst from filtering on the arrays' size below,
    # which would split each text once for each of its words.
    at = shingled(docs).select(*keys, F.size("_hashes").alias("_n"), F.posexplode_outer("_hashes").alias("_pos", "_h"))
    held = at.join(F.broadcast(places), "_h").groupBy(*keys, "_size", "_n").agg(F.collect_list("_pos").alias("_p"))
    held = held.withColumn("_need", F.expr(f"cast(ceil({similarity!r}D * (least(_n, _size) + _size) / {1 + similarity!r}D - 1e-6) AS int)")).where("size(_p) >= _need")
    held = held.withColumn("_p", F.array_sort("_p"))
    begins = "filter(transform(_p, (x, i) -> if(get(_p, i + _need - 1) < x + _size, least(x, greatest(_n - _size, 0)), NULL)), x -> x IS NOT NULL)"
    last = "if(get(_p, size(_p) - _need) >= _n - _size, array(greatest(_n - _size, 0)), array())"
    return held.select(*keys, "_size", F.explode(F.expr(f"array_distinct(concat({begins}, {last}))")).alias("_start"))


def windows(docs: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _size, _s): the shingles of each window of ``starts``, a stored table."""
    wanted = starts.groupBy(*keys).agg(F.collect_list(F.struct("_start", "_size")).alias("_at"))
    if starts.count() <= BROADCAST_STARTS:
        wanted = F.broadcast(wanted)
    wanted = wanted.select(*(F.col(k).alias(f"{k}_") for k in keys), "_at")
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    found = shingled(docs.join(wanted, same).drop(*(f"{k}_" for k in keys)))
    # _hashes is named twice, so that it is computed before the lambda and not inside.
    cut = "if(size(_hashes) > 0, transform(_at, x -> struct(x._size AS _size, slice(_hashes, x._start + 1, x._size) AS _s)), NULL)"
    return found.select(*keys, F.explode_outer(F.expr(cut)).alias("_cut")).select(*keys, "_cut._size", "_cut._s")


def blocks(fp: str) -> list[F.Column]:
    return [F.shiftrightunsigned(fp, BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int") for b in range(BLOCKS)]


def counted(sets: DataFrame, name: str) -> DataFrame:
    """(name, _h, _k): how often each shingle of the arrays ``_s`` occurs, by ``name``."""
    return sets.select(name, F.explode("_s").alias("_h")).groupBy(name, "_h").agg(F.count("*").alias("_k"))


def proposed(prints: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (_window, _w, _item, _m): pairs of equal ``_size`` within ``RADIUS`` bits, by the block index; _w and _m are their shingles.

    ``prints`` has _window, _size, _w and _fp, ``items`` _item, _size and _fp.
    """
    index = items.select("_item", "_size", F.col("_fp").alias("_of"), F.posexplode(F.array(*blocks("_fp"))).alias("_block", "_value"))
    flips = F.array(F.lit(0), *(F.lit(1 << b) for b in range(BLOCK_BITS)))
    index = index.select("_item", "_size", "_of", "_block", F.explode(F.transform(flips, lambda f: F.col("_value").bitwiseXOR(f))).alias("_value"))
    met = prints.select("*", F.posexplode(F.array(*blocks("_fp"))).alias("_block", "_value")).join(index, ["_size", "_block", "_value"])
    near = met.where(F.bit_count(F.col("_fp").bitwiseXOR(F.col("_of"))) <= RADIUS)
    return near.select("_window", "_w", "_item", F.col("_size").alias("_m")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("doc_id",), similarity: float = SIMILARITY) -> DataFrame:
    """One row for each (keys, item_id) with a window of at least ``similarity``, and the best similarity.

    ``docs`` has the columns ``keys`` and text, ``benchmark`` item_id and text. A document shorter than the
    item is one window. A text of fewer than five words is one shingle, equal only to such a text of the same
    words; null texts and those without words have no shingles and match nothing. Rows with equal keys are
    told together; a null key is a key like any other; rows of one item_id are items of their own until the
    last step. Other columns are ignored; no rows on either side give none. Windows of equal shingles are
    verified once, however many documents share them.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    docs = docs.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.xxhash64("text").alias("_row"), "text")
    items = materialize(shingled(benchmark.select("item_id", "text")), "items").where("size(_hashes) > 0").distinct()
    own = items.select("_hashes").distinct().withColumn("_item", F.xxhash64("_hashes")).withColumn("_s", F.col("_hashes"))
    own = materialize(own.select("_item", F.size("_s").alias("_size"), "_s", F.expr(SIMHASH).alias("_fp")), "prints")
    n = own.agg(F.sum("_size")).first()[0] or 0
    passes = max(1, -(-n // BLOCK_SHINGLES))
    # An item's shingles all go out in one pass; a window that comes up in two is one again below.
    source = own.select("_item", F.col("_s").alias("_hashes"), F.pmod("_item", F.lit(passes)).alias("_part"))
    parts = [starts(docs, source.where(F.col("_part") == k), [*names, "_row"], similarity) for k in range(passes)]
    at = materialize(reduce(DataFrame.union, parts), "starts")
    cut = windows(docs, at, [*names, "_row"]).withColumn("_window", F.xxhash64("_size", "_s"))
    cut = materialize(cut.select(*names, "_window", "_size", "_s"), "windows")
    sets = cut.select("_window", "_size", "_s").dropDuplicates(["_window"])
    prints = sets.select("_window", "_size", F.size("_s").alias("_w"), F.expr(SIMHASH).alias("_fp"))
    near = materialize(proposed(prints, own.select("_item", "_size", "_fp")), "near")
    of_window = counted(sets.join(near.select("_window").distinct(), "_window", "left_semi"), "_window")
    of_item = counted(own.select("_item", "_s"), "_item").withColumnRenamed("_k", "_l")
    met = near.join(of_window, "_window").join(of_item, ["_item", "_h"])
    shared = met.groupBy("_window", "_item", "_w", "_m").agg(F.sum(F.least("_k", "_l")).alias("_shared"))
    scored = shared.select("_window", "_item", (F.col("_shared") / (F.col("_w") + F.col("_m") - F.col("_shared"))).alias("similarity"))
    alike = materialize(scored.where(F.col("similarity") >= similarity), "alike")
    named = items.select("item_id", F.xxhash64("_hashes").alias("_item"))
    best = cut.select(*names, "_window").distinct().join(alike, "_window").join(named, "_item").groupBy(*names, "item_id").agg(F.max("similarity").alias("similarity"))
    return best.select(*(F.col(a).alias(b) for a, b in zip(names, keys, strict=True)), "item_id", "similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item, all columns as they were; rows are told apart by doc_id and text."""
    own, leak, doc = (fresh(n, docs) for n in ("row", "leak", "leak_doc"))
    row = docs.withColumn(own, F.xxhash64("doc_id", "text"))
    leaks = contaminated(row, benchmark, ("doc_id", own), similarity).select(F.col("doc_id").alias(doc), F.col(own).alias(leak)).distinct()
    leaks = bounded(materialize(leaks, "leaks"))
    return row.join(leaks, F.col(own).eqNullSafe(F.col(leak)) & F.col("doc_id").eqNullSafe(F.col(doc)), "left_anti").select(*docs.columns)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 9))


#: Every window of every document that shares a shingle with the item (any other has similarity 0).
OP8_SQL = r"""
WITH words AS (SELECT kind, id, r, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM (SELECT 0 AS kind, doc_id AS id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 1, item_id, row_number() OVER (), text FROM benchmark)),
grams AS (SELECT kind, id, r, i, array_to_string(w[i:i + 4], ' ') AS g, greatest(len(w) - 4, 1) AS m FROM words, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS u(i)),
item AS (SELECT id AS item_id, r AS item, g, m, count(*) AS n FROM grams WHERE kind = 1 GROUP BY ALL),
hits AS (SELECT d.id AS doc_id, d.r AS doc, d.i, d.g, least(d.m, b.m) AS w, greatest(d.m - b.m, 0) AS latest, item_id, item, b.m, b.n FROM grams d JOIN item b ON d.g = b.g AND d.kind = 0),
own AS (SELECT doc_id, doc, item_id, item, w, m, s, g, n, count(*) AS k FROM hits, unnest(range(greatest(i - m, 0), least(i - 1, latest) + 1)) AS u(s) GROUP BY ALL),
shared AS (SELECT doc_id, doc, item_id, item, s, w, m, sum(least(k, n)) AS c FROM own GROUP BY ALL)
SELECT doc_id, item_id, round(max(CAST(c AS DOUBLE) / (w + m - c)), 9) AS similarity FROM shared WHERE CAST(c AS DOUBLE) / (w + m - c) >= 0.8 GROUP BY doc_id, item_id
"""
