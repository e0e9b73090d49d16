"""The queries opN_<name> over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard, licenses, lm, mixing, quality, secrets, substrings, tiling, tokens, urls
from lodestone.llm.common import table

#: The folder of public tokenizers' files is a parameter; this is the box's.
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def _as_files(docs: DataFrame) -> DataFrame:
    """Documents as files: /<source>/<language>/<doc_id>."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return docs.select("doc_id", F.concat(F.lit("/"), part("source"), F.lit("/"), part("lang"), F.lit("/"), part("doc_id")).alias("path"), "text")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_as_files(table(spark, sf_dir, "documents")))
    return found.select(F.regexp_extract("path", "[^/]*$", 0).cast("long").alias("doc_id"), "path", F.col("own").alias("own_license"), "cosine", "license", "from_dir")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_digest(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_as_files(table(spark, sf_dir, "documents")), secrets.train(secrets.labelled_findings()), key="doc_id")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_components(table(spark, sf_dir, "documents")).drop("rid")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).withColumn("ratio", F.round("ratio", 6))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's rules alone, which SQL can say."""
    return urls.ruled(table(spark, sf_dir, "pages"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents")).drop("lang").withColumn("log_ppl", F.round("log_ppl", 6))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's counting rules alone, which SQL can say."""
    return quality.counted(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_license_scan, op2_decontamination, op3_substring_dedup, op4_secret_scan, op5_token_store, op6_mixing, op7_ngram_jaccard, op8_url_filter, op9_lm_scoring, op10_quality_rules, url_rules, quality_counts)
}

ORACLE = {"op3_substring_dedup": substrings.ORACLE, "op6_mixing": mixing.ORACLE, "op7_ngram_jaccard": jaccard.ORACLE, "url_rules": urls.ORACLE_RULES, "quality_counts": quality.ORACLE_COUNTS}
