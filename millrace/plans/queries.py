"""Queries through the front ends and the search operators, each with its DuckDB equal."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.registry import install, sql
from millrace.operators import search
from millrace.plans import frontends
from millrace.session import TABLES, table, views


def _text(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, tuple(t for t in TABLES if re.search(rf"\b{t}\b", text)))
        return frontends.run(spark, text)

    return run


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), ["licensed", "released"], 20)


BM25_SQL = """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS w FROM documents),
r AS (SELECT doc_id, len(w) AS l, len(list_filter(w, lambda t: t = 'licensed')) AS a, len(list_filter(w, lambda t: t = 'released')) AS b FROM d),
s AS (SELECT count(*) AS n, avg(l) AS m, sum((a > 0)::INT) AS da, sum((b > 0)::INT) AS db FROM r)
SELECT doc_id, round(ln((n - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + ln((n - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m)), 9) AS score
FROM r, s WHERE a > 0 OR b > 0 ORDER BY score DESC, doc_id LIMIT 20"""


def kernels_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text kernels over whole documents."""
    install(spark, ["sentence_count", "sentiment_label", "unicode_slugify"])
    t = table(spark, sf_dir, "documents")
    return t.select("doc_id", F.expr("sentence_count(text) AS sentences"), F.expr("sentiment_label(text) AS mood"), F.expr("unicode_slugify(text) AS slug"))


def kernels_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String distances over a column of short texts."""
    install(spark, ["jaro_winkler", "damerau_levenshtein"])
    t = table(spark, sf_dir, "part")
    return t.select("p_partkey", F.expr("round(jaro_winkler(p_type, 'STANDARD POLISHED TIN'), 6) AS jw"), F.expr("damerau_levenshtein(p_type, 'PROMO BRASS') AS dl"))


#: DuckDB's own jaro_winkler_similarity adds for a common prefix only above 0.7.
DISTANCE_SQL = """SELECT p_partkey, round(j + 0.1 * n * (1 - j), 6) AS jw, damerau_levenshtein(p_type, 'PROMO BRASS') AS dl
FROM (SELECT p_partkey, p_type, jaro_similarity(p_type, 'STANDARD POLISHED TIN') AS j, len(list_filter(range(1, 5), lambda k: left(p_type, k) = left('STANDARD POLISHED TIN', k))) AS n FROM part) AS t"""


def kernels_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    install(spark, ["xxh64", "xxh32", "xxh3", "crc16", "sha3_256", "base32_encode", "base58_encode", "blake2b"])
    t = table(spark, sf_dir, "customer")
    return t.select("c_custkey", *(F.expr(f"{f}(c_name) AS {f}") for f in ("xxh64", "xxh32", "xxh3", "crc16", "sha3_256", "base32_encode", "base58_encode", "blake2b")))


def kernels_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    install(spark, ["nt_is_prime", "nt_totient", "nt_next_prime", "nt_factorize"])
    t = table(spark, sf_dir, "orders")
    return t.select("o_orderkey", *(F.expr(f"{f}(o_orderkey) AS {f}") for f in ("nt_is_prime", "nt_totient", "nt_next_prime", "nt_factorize")))


def kernels_divisor(spark: SparkSession, sf_dir: str) -> DataFrame:
    install(spark, ["nt_is_prime", "nt_gcd", "nt_lcm", "nt_modpow"])
    t = table(spark, sf_dir, "orders")
    return t.select("o_orderkey", *(F.expr(f"{f} AS {n}") for n, f in (("prime", "nt_is_prime(o_orderkey)"), ("divisor", "nt_gcd(o_orderkey, o_custkey)"), ("multiple", "nt_lcm(o_orderkey, o_custkey)"), ("square", "nt_modpow(o_orderkey, 2, 1009)"))))


DIVISOR_SQL = """SELECT o_orderkey, CAST(o_orderkey > 1 AND len(list_filter(range(2, CAST(floor(sqrt(o_orderkey)) AS BIGINT) + 1), lambda k: o_orderkey % k = 0)) = 0 AS BIGINT) AS prime,
  gcd(o_orderkey, o_custkey) AS divisor, lcm(o_orderkey, o_custkey) AS multiple, o_orderkey * o_orderkey % 1009 AS square FROM orders"""


def kernels_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, "SELECT event_id, json_set(props, '$.n', 'x') AS a, json_remove(props, '$.k') AS b, json_patch(props, '{\"k\":null,\"z\":1}') AS c, json_type(props, '$.k') AS d FROM {events}".replace("{events}", f"parquet.`{sf_dir}/events.parquet`"))


def html_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    install(spark, ["html_to_text", "html_links", "html_title", "html_strip_tags"])
    return table(spark, sf_dir, "pages").select("page_id", F.expr("length(html_to_text(html)) AS chars"), F.expr("html_links(html) AS links"), F.expr("html_title(html) AS title"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "front_prql": (_text("from orders | filter o_orderstatus == \"F\" && o_totalprice > 1000 | group {o_orderpriority} (aggregate {n = count this, total = sum o_custkey}) | sort {-n}"), "SELECT o_orderpriority, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 GROUP BY 1"),
    "front_prql_join": (_text("from nation\njoin region (n_regionkey == r_regionkey)\nfilter r_name != \"ASIA\"\nselect {n_name, r_name}\nsort {n_name}\ntake 12"), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' ORDER BY n_name LIMIT 12"),
    "front_dplyr": (_text("dplyr( part |> filter(p_size == 6) |> select(p_partkey, p_brand) |> arrange(desc(p_partkey)) |> head(9) )"), "SELECT p_partkey, p_brand FROM part WHERE p_size = 6 ORDER BY p_partkey DESC LIMIT 9"),
    "front_dplyr_summary": (_text("customer |> group_by(c_mktsegment) |> summarise(n = n(), low = min(c_acctbal)) |> filter(n > 1)"), "SELECT c_mktsegment, count(*) AS n, min(c_acctbal) AS low FROM customer GROUP BY 1 HAVING count(*) > 1"),
    "front_visualize": (_text("VISUALIZE SELECT c_mktsegment, c_nationkey FROM customer"), "SELECT c_mktsegment, CAST(sum(c_nationkey) AS BIGINT) AS c_nationkey, repeat('#', CAST(round(20 * sum(c_nationkey) / max(sum(c_nationkey)) OVER ()) AS INTEGER)) AS bar FROM customer GROUP BY 1"),
    "front_pipe_sql": (_text("FROM orders |> WHERE o_totalprice > 100000 |> AGGREGATE count(*) AS n GROUP BY o_orderstatus"), "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1"),
    "search_bm25": (bm25, BM25_SQL),
    "search_spellfix": (lambda s, d: search.spellfix(table(s, d, "part"), "p_type", "STANDARD POLISHED TIN", 8), "SELECT word, distance FROM (SELECT DISTINCT p_type AS word, levenshtein(p_type, 'STANDARD POLISHED TIN') AS distance FROM part) AS t ORDER BY distance, word LIMIT 8"),
    "search_prefix": (lambda s, d: search.by_prefix(table(s, d, "part"), "p_type", "PROMO"), "SELECT DISTINCT p_type FROM part WHERE starts_with(p_type, 'PROMO')"),
    "search_postings": (lambda s, d: search.postings(table(s, d, "documents")), "SELECT term, doc_id, length, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS w FROM documents) AS a) AS b GROUP BY ALL"),
    "kernel_text": (kernels_text, None),
    "kernel_distance": (kernels_distance, DISTANCE_SQL),
    "kernel_divisor": (kernels_divisor, DIVISOR_SQL),
    "kernel_hash": (kernels_hash, None),
    "kernel_number": (kernels_number, None),
    "kernel_json": (kernels_json, "SELECT event_id, CAST('{\"k\":' || (props::JSON->>'k') || ',\"n\":\"x\"}' AS VARCHAR) AS a, '{}' AS b, '{\"z\":1}' AS c, 'integer' AS d FROM events"),
    "kernel_html": (html_kernels, None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: q for n, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: o for n, (_, o) in QUERIES.items() if o}
