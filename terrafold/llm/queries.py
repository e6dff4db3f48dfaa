"""Queries and oracle SQL of the llm operators (p1, p6, p7, p8)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import encode, matching, mixing, spans
from terrafold.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_matches(spark, d).select("place_id", "poi_id")


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matched pairs with their confidence and the route that found them."""
    return matching.match_places(table(spark, d, "web_places"), table(spark, d, "poi_records")).select("place_id", "poi_id", "confidence", "route")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_column(table(spark, d, "documents"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The chosen records and their repeats."""
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached."""
    targets = table(spark, d, "mix_targets")
    return mixing.reached_shares(mixing.mixture(table(spark, d, "documents"), targets), targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(table(spark, d, "documents"))


def p8_share(spark: SparkSession, d: str) -> DataFrame:
    """How much of each text stands in another record."""
    return spans.shared_share(table(spark, d, "documents"))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """Maximal common runs between different texts, one record standing for all with the same text."""
    docs = table(spark, d, "documents")
    classes = spans.text_classes(docs)
    runs = spans.shared_runs(spans.unique_texts(docs, classes))
    return runs.select("doc_a", "doc_b", F.col("start_a"), F.col("start_b"), "length")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_matches, p6_ids, p7_mixture, p7_shares, p8_found, p8_share, p8_passages)}

_GRAMS = """
WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 80),
g AS (SELECT doc_id, n, i, substring(text, i + 1, 80) AS gram FROM (SELECT doc_id, text, n, unnest(range(CAST(n - 79 AS BIGINT))) AS i FROM t))
"""
ORACLES: dict[str, str] = {
    "p8_found": _GRAMS + "SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id",
    "p8_passages": _GRAMS
    + """, u AS (SELECT text, min(doc_id) AS doc_id FROM t GROUP BY 1),
w AS (SELECT g.doc_id, g.n, g.i, g.gram, u.text FROM g JOIN u USING (doc_id)),
s AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, a.i AS start_a, b.i AS start_b, substring(a.text, a.i + 1) AS x, substring(b.text, b.i + 1) AS y
  FROM w a JOIN w b ON a.gram = b.gram AND a.doc_id < b.doc_id WHERE a.i = 0 OR b.i = 0 OR substring(a.text, a.i, 1) <> substring(b.text, b.i, 1))
SELECT doc_a, doc_b, start_a, start_b, coalesce(list_min(list_filter(range(80, least(length(x), length(y))), lambda k: substring(x, k + 1, 1) <> substring(y, k + 1, 1))), least(length(x), length(y))) AS length FROM s""",
    "p8_share": _GRAMS
    + """, s AS (SELECT gram FROM g GROUP BY gram HAVING count(DISTINCT doc_id) > 1),
h AS (SELECT DISTINCT g.doc_id, g.i FROM g JOIN s USING (gram)),
c AS (SELECT doc_id, sum(least(80, coalesce(nxt - i, 80))) AS covered FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(length(d.text), 0) AS BIGINT) AS n_chars, CAST(coalesce(c.covered, 0) AS BIGINT) AS shared_chars,
  round(coalesce(c.covered / nullif(length(d.text), 0), 0.0), 6) AS shared_share FROM documents d LEFT JOIN c USING (doc_id)""",
}
