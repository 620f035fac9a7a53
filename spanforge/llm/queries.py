"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import embedding_dedup, language_model, mixing, ngram_join, packing, periodic, pii, quality, sharding, suffix_dedup, toxicity, warc, whitening
from spanforge.llm.oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "PUBLIC_KEY", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stands in for a key where the session sets none: these queries run on test tables.
PUBLIC_KEY = "not-a-secret"


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.copies_by_source(_table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(_table(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", pii.pseudonymise_column("text", pii.key_of(spark, PUBLIC_KEY)).alias("text"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(_table(spark, sf_dir, "pages")).drop("target_uri")


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.summarise(periodic.detect(_table(spark, sf_dir, "documents"), planted=True, digest=True))


QUERIES = {
    query.__name__: query
    for query in (op1_pack, op2_mix, op3_embedding, op4_pii, op5_jaccard, op6_suffix_dedup, op7_lm, op8_toxicity, op9_quality, op10_shard, op11_whiten, op12_warc, op13_periodic)
}
