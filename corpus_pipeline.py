"""A corpus pipeline over documents: each stage takes (spark, docs, sf_dir) and works on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, langid, mixing, simhash, toxicity
from millrace.llm.common import read, renamed, restored, scratch_dir

#: A text whose likeliest language is less likely than this is rejected, as are texts without letters.  Held-out texts of
#: sf0.1 score 0.99 or more but for 1 in 10,000; sentences of unlearned languages and letter junk score 0.25 to 0.45.
LEAST_LANGUAGE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op 10 predicts to be toxic go."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    rows, name = renamed(docs)
    return restored(toxicity.score(rows, model, text=name["text"]).where("predicted = 0"), docs)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language, or of none that op 2 is sure of, go."""
    rows, name = renamed(docs)
    found = langid.predict(rows, langid.fit(docs), text=name["text"])
    return restored(found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts at a likeness of 0.8 over shingles of five words, the text of the least id stays, once.

    Candidates come from op 8's index.  An id with several texts is a document for each text.  Of rows of one id and text
    that differ in other columns, that of the least JSON form stays.  A row of null id stays: no group has it for its head.
    """
    heads = simhash.likeness_groups(docs, width=5, least=0.8).where("first").select(F.col("id").alias("kept"), F.col("key").alias("digest"))
    rows, name = renamed(docs)
    whole = F.struct(*rows.columns)
    same = (F.col(name["doc_id"]).cast("long") == F.col("kept")) & (simhash.text_key(F.col(name["text"])) == F.col("digest"))
    named = rows.join(heads, same).groupBy("kept", "digest").agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return restored(named.unionAll(rows.where(F.col(name["doc_id"]).isNull())), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as op 1's rates say, so that expected tokens of the quality domains meet their weights.

    The total is so large that the scarcest domain against its target keeps a rate of about 1: weights are met by repeats
    more than by leaving out, though a document of mixed posterior can get a rate under 1.
    """
    return mixing.resample(docs, read(spark, sf_dir, "labels"), mixing.QUALITY_TARGETS, mixing.BY_QUALITY)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the token ids of every text by op 3 in place of the text, and the digests of ids and decoded bytes.

    A column of docs that has the name of one of these gives way to it.
    """
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids="ids").drop("text")


STAGES = [("toxicity", drop_toxic), ("language", keep_known_language), ("near-dedup", drop_near_duplicates), ("mixing", mix), ("bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    at = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = f"{at}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
