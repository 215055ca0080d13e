"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a predicate that rejects a text. On a random sample, the cascade estimates what a rule costs
(seconds that evaluating it alone adds to reading the sample, the least of a few runs) and how many rows it rejects, then
orders the rules by rejection per cost; a row is judged by one CASE that stops at the first rule to reject
it. Costs are told apart by factors of two only. The order changes what is spent, never the verdict, so
timing noise can't change a result. Counts that the output shows are there for every row; what the
cascade saves is the work of the rules that use others.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WHITE = r"[\\x20\\x09-\\x0D]"
#: Words that a repeated window needs.
WINDOW = 5

#: Columns that rules may use besides the table's own; each may use those before it.
MEASURES = {
    "_text": "coalesce(text, '')",
    "_words": rf"array_remove(split(_text, '{WHITE}+'), '')",
    "n_words": "cast(size(_words) AS bigint)",
    "word_chars": rf"cast(length(regexp_replace(_text, '{WHITE}+', '')) AS bigint)",
    "n_symbols": "cast(length(regexp_replace(_text, '[^#*$%&|<>]+', '')) AS bigint)",
    "_lines": rf"filter(split(_text, '\\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')",
    "n_lines": "cast(size(_lines) AS bigint)",
    "n_dup_lines": "cast(n_lines - size(array_distinct(_lines)) AS bigint)",
    # A hash for each window of five words, in order.
    "_windows": f"if(n_words < {WINDOW}, array(), transform(sequence(0, cast(n_words AS int) - {WINDOW}), i -> xxhash64({', '.join(f'_words[i + {k}]' for k in range(WINDOW))})))",
    # Sorted by hash, then place: a repeated window has an equal neighbour. Most texts have none and skip this.
    "_sorted": "if(size(array_distinct(_windows)) = size(_windows), NULL, array_sort(transform(_windows, (h, i) -> struct(h AS h, i AS i))))",
    "_places": "array_sort(transform(filter(_sorted, (x, k) -> x.h = get(_sorted, k - 1).h OR x.h = get(_sorted, k + 1).h), x -> x.i))",
    "n_repeat_words": f"cast(coalesce(aggregate(transform(_places, (p, k) -> least({WINDOW}, coalesce(get(_places, k + 1) - p, {WINDOW}))), 0, (a, x) -> a + x), 0) AS bigint)",
}

#: Rules that every text must pass; n_words < 10 and the share of repeated words are the base.
BASE_RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
}
RULES = BASE_RULES | {
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars > 20 * n_words OR word_chars < 2 * n_words",
    "capitals": "2 * length(regexp_replace(_text, '[^A-Z]+', '')) > word_chars",
    "shouting": "5 * (size(split(_text, '!!', -1)) - 1) > n_words",
    "no_letters": "2 * size(filter(_words, w -> w RLIKE '\\\\p{L}')) < n_words",
    "bullets": "n_lines >= 4 AND 10 * size(filter(_lines, l -> l RLIKE '^[\\\\x20\\\\x09]*[-*\u2022]')) > 9 * n_lines",
    "cut_lines": "n_lines >= 4 AND 10 * size(filter(_lines, l -> l RLIKE '([.][.][.]|\u2026)[\\\\x20\\\\x09\\\\x0D]*$')) > 3 * n_lines",
}


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``MEASURES``; Catalyst drops those that aren't used."""
    for name, sql in MEASURES.items():
        docs = docs.withColumn(name, F.expr(sql))
    return docs


def seconds(df: DataFrame, rule: str, runs: int = 2) -> float:
    """The least time of ``runs`` evaluations of ``rule`` over ``df``."""
    took = []
    for _ in range(runs):
        began = time.perf_counter()
        df.agg(F.count_if(F.expr(rule))).first()
        took.append(time.perf_counter() - began)
    return min(took)


def order_rules(sample: DataFrame, rules: dict[str, str]) -> list[str]:
    """Names of ``rules`` by rejection per cost on ``sample`` (text), highest first; ties and an empty sample keep the given order."""
    sample = sample.select("text").repartition(4).persist()
    try:
        rows = measured(sample)
        n, *rejected = rows.agg(F.count("*"), *(F.count_if(F.expr(r)) for r in rules.values())).first()
        if not n:
            return list(rules)
        idle = seconds(rows, "text = ''")
        worth = {}
        for name, count in zip(rules, rejected, strict=True):
            cost = max(seconds(rows, rules[name]) - idle, 1e-3) / n
            worth[name] = count / n / 2.0 ** round(math.log2(cost))
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda r: -worth[r])


def verdict(rules: dict[str, str], order: list[str]) -> F.Column:
    """True if no rule rejects: one CASE that stops at the first that does."""
    case = F
    for name in order:
        case = case.when(F.coalesce(F.expr(rules[name]), F.lit(False)), F.lit(False))
    return case.otherwise(F.lit(True)) if order else F.lit(True)


def judge(docs: DataFrame, rules: dict[str, str] = RULES, sample_rows: int = 1000) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for each row of ``docs`` (doc_id, text).

    ``sample_rows`` is about how many rows, drawn at random, costs are estimated on; every row is judged. A null text has no
    words and is rejected as too short. Repeated rows are judged alike; a null doc_id stays null; other
    columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    order = order_rules(docs.sample(min(1.0, sample_rows / max(1, docs.count())), seed=7), rules)
    base = " OR ".join(f"({r})" for r in BASE_RULES.values())
    return measured(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr(base).alias("base_failed"), (~F.expr(base) & verdict(rules, order)).alias("kept"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(words) - 3)) AS u(i)),
twice AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM win JOIN twice USING (r, g), unnest(range(0, 5)) AS u(k) GROUP BY r),
m AS (SELECT doc_id, t, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  len(lines) AS n_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals, len(string_split(t, '!!')) - 1 AS shouts,
  len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS lettered, len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*\x{2022}]'))) AS bullets,
  len(list_filter(lines, lambda x: regexp_matches(x, '([.][.][.]|\x{2026})[\x20\x09\x0D]*$'))) AS cut
  FROM d JOIN w USING (r) LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words OR (n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines)
    OR word_chars > 20 * n_words OR word_chars < 2 * n_words OR 2 * capitals > word_chars OR 5 * shouts > n_words OR 2 * lettered < n_words
    OR (n_lines >= 4 AND 10 * bullets > 9 * n_lines) OR (n_lines >= 4 AND 10 * cut > 3 * n_lines)) AS kept
FROM m
"""
