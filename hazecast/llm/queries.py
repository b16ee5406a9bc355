"""One registered query per operator of this package, over whole tables."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazecast.llm import (
    languages, licenses, max_score, mixing, neighbours, packing, ranking, repeats, simhash, token_files, toxicity,
    url_rules, whitening)
from hazecast.llm.common import bucket_of, table
from hazecast.session import work_folder

#: Rules (host, path, verdict) of the url query.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"),
             ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scanned(table(spark, folder, "documents"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pieces(table(spark, folder, "documents"),
                            public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset", "bucket")


def op3_bm25(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return ranking.search(ranking.build_index(docs), docs.filter(F.col("doc_id") % 100 == 0)).select(
        "query_id", "rank", "doc_id", "score")


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


def op6_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.removals(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = bucket_of("doc_id", 3) == 1
    model = toxicity.trained(docs.filter(~held_out), labels.filter(~held_out))
    return toxicity.scored(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_rules.RULES)
    return url_rules.judged(table(spark, folder, "pages"), rules)


def op10_languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = bucket_of("doc_id", 4) == 2
    model = languages.trained(docs.filter(~held_out))
    return languages.predicted(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs, path = table(spark, folder, "documents"), work_folder(spark, "token-files")
    token_files.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "frames")


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.components(table(spark, folder, "embeddings"))


def op13_max_score(spark: SparkSession, folder: str) -> DataFrame:
    index = max_score.build_index(table(spark, folder, "documents"))
    return max_score.search(index, table(spark, folder, "benchmark")).select("item_id", "rank", "doc_id", "score")


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_packing, op3_bm25, op4_simhash, op5_neighbours, op6_repeats, op7_mixing, op8_toxicity,
    op9_url_rules, op10_languages, op11_token_files, op12_whitening, op13_max_score)}
