"""Registered queries of the subpackage: each operator over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.llm import quality, toxicity, vectors
from ledgermatch.llm.contamination import contaminated, find_contamination
from ledgermatch.llm.features import held_out
from ledgermatch.llm.lines import LineIndex
from ledgermatch.llm.mixing import mix
from ledgermatch.llm.outliers import quality_rules
from ledgermatch.llm.passages import remove_repeats
from ledgermatch.llm.simhash import near_duplicates
from ledgermatch.llm.tokens import count_tokens
from ledgermatch.llm.variants import variants
from ledgermatch.llm.warc import read_archives, train_dictionary, write_archives
from ledgermatch.llm.whitening import whiten
from ledgermatch.sources.rounds import RunFolder


#: The folder that holds the package.
HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def tell_workers(spark: SparkSession) -> None:
    """Python workers are told where the package is, in case it is not installed."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if HOME not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([HOME, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    tell_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(ids, 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = LineIndex(spark, threshold=10, least=1).insert(docs).drop(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the source, the language and each line of a document, encoded as one text."""
    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, fields=("source", "lang", "text"), separator=" ", by_line=True, rule="most")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256")
    return found.select("doc_id", "n_sentences", "n_removed", "n_words_removed", kept)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = table(spark, sf_dir, "pages"), f"{RunFolder(spark).path}/archives"
    write_archives(pages, path, least=0, dictionary=train_dictionary(pages))
    records = read_archives(spark, path)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


#: Categories of the chain: columns made from the labels there are.
CATEGORIES = ("low_quality", "toxic")
#: Probability from which a document is rejected as toxic.
THRESHOLD = 0.3


def toxicity_chain(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Chain:
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"
    )
    return toxicity.train(docs, labels, list(CATEGORIES))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.predict(docs, toxicity_chain(spark, sf_dir, docs))
    return found.withColumn("rejected", F.col("p_toxic") >= THRESHOLD)


def op11_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"), least_words=10, most_repeats=20)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *counts, "base_failed", "kept", "distance")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), most=16)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants(table(spark, sf_dir, "documents"), letters=5, least=3, times=2)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_token_counts,
        op3_simhash,
        op4_mixing,
        op5_line_dedup,
        op6_embedding_dedup,
        op7_substring_dedup,
        op8_warc,
        op9_quality,
        op10_toxicity,
        op11_outliers,
        op12_whitening,
        op13_spelling_variants,
    )
}
