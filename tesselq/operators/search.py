"""Keyword search over an inverted index of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are cut at white space and any ASCII character but letters, digits and the underscore; the length that a word must exceed.
DELIMITERS = r"[\s!-/:-@\[-^`{-~]+"
SHORTEST = 2


def words(text: str) -> Column:
    """Words of a text column, longer than ``SHORTEST``, repeats included; case is kept."""
    return F.filter(F.split(text, DELIMITERS), lambda w: F.length(w) > SHORTEST)


def index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The inverted index: word, ``key``, freq."""
    return docs.select(F.col(key), F.explode_outer(words(text)).alias("word")).where("word is not null").groupBy("word", key).agg(F.count("*").alias("freq"))


def prefix_hits(postings: DataFrame, queries: list[str]) -> DataFrame:
    """Postings whose word begins with a query word, with the word's place in the query (``q``); a word that begins with several comes as often."""
    hits = [F.when(F.startswith(F.col("word"), F.lit(p)), F.lit(i)) for i, p in enumerate(queries)]
    return postings.withColumn("q", F.explode(F.array_compact(F.array(*hits)))) if hits else postings.withColumn("q", F.lit(0)).limit(0)


def ranked(postings: DataFrame, key: str, queries: list[str]) -> DataFrame:
    """key, hits, rank: a document's first hit counts its share of the word, each further one adds its own and doubles; in percent of the best.

    A hit's share is its frequency by that of all postings of the same query word. Hits are folded in the order of query word, then word.
    """
    hits = prefix_hits(postings, queries)
    totals = hits.groupBy("q").agg(F.sum("freq").alias("_all"))
    found = hits.join(F.broadcast(totals), "q").select(key, F.struct("q", "word", (F.col("freq") / F.col("_all")).alias("share")).alias("_x"))
    found = found.groupBy(key).agg(F.array_sort(F.collect_list("_x")).alias("_h"))
    fold = F.aggregate(F.slice(F.col("_h"), 2, F.size("_h")), F.col("_h")[0].share, lambda r, h: (r + h.share) * 2)
    scored = found.select(key, F.size("_h").cast("long").alias("hits"), fold.alias("_r"))
    return scored.select(key, "hits", (F.col("_r") * 100 / scored.agg(F.max("_r")).scalar()).alias("rank"))


def filtered(postings: DataFrame, key: str, required: list[str], forbidden: list[str]) -> DataFrame:
    """Keys of documents with all ``required`` and none of the ``forbidden`` words; a word listed twice counts once, no required word asks for none."""
    required = sorted(set(required))
    has = postings.groupBy(key).agg(F.count_if(F.col("word").isin(required)).alias("_n"), F.count_if(F.col("word").isin(forbidden)).alias("_no"))
    return has.where((F.col("_n") == len(required)) & (F.col("_no") == 0)).select(key)
