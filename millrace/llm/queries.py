"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, chat, html_text, langid, license, merkle, mixing, simhash, topk, toxicity
from millrace.llm.common import held_out, read

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft-membership rates of all documents against the target weights of the labelled domains."""
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return langid.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.digests(rows.unionAll(extra))


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_likeness(read(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.main_text(pages).select("page_id", "url", "text", "n_chars")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return toxicity.score(rows, model).select("doc_id", "held_out", "score", "predicted", "passages")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_mixing, op2_language, op3_bpe, op4_topk, op5_chat, op6_merkle, op7_html, op8_simhash, op9_license, op10_toxicity)
    return {f.__name__: f for f in made}


OP4_SQL = """WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT n, vec_id, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM v),
a AS (SELECT e.* FROM e JOIN (SELECT min(n) AS n FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id, q) AS one USING (n)),
s AS (SELECT a.n AS q, a.vec_id AS query_id, b.n, b.vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score FROM e AS b JOIN a ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY ALL),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

OP5_SQL = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
f AS (SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '<', '\<') AS safe, replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '<', '\<'), ':', '\:') AS name FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length('### ' || name || ': ' || safe || '</turn>') + 1) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op4_topk": OP4_SQL, "op5_chat": OP5_SQL, "op6_merkle": merkle.edit_likeness_sql(), "op9_license": license.scan_sql()}
