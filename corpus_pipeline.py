"""From raw documents to a training mix: stages in order, each on all that the one before it kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the last return the columns
of ``documents``; the last returns the mix: how many copies of each remaining document to take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.llm import toxicity
from ledgermatch.llm.contamination import contaminated, find_contamination
from ledgermatch.llm.lines import LineIndex
from ledgermatch.llm.mixing import mix
from ledgermatch.llm.queries import THRESHOLD, table, toxicity_chain
from ledgermatch.llm.simhash import one_of_each
from ledgermatch.sources.rounds import RunFolder


def _packed(docs: DataFrame) -> DataFrame:
    """The whole row in one column, so that no column can clash with those an operator adds."""
    return docs.select(F.struct(*docs.columns).alias("__row"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic reaches the threshold go."""
    chain = toxicity_chain(spark, sf_dir, docs)
    found = toxicity.predict(_packed(docs), chain, carry=("__row",))
    return found.where(F.col("p_toxic") < THRESHOLD).select("__row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all of them; the documents stay."""
    packed = _packed(docs)
    kept = LineIndex(spark, threshold=10, least=1).insert(packed).drop(packed, carry=("__row",))
    row, changed = F.col("__row"), F.col("n_dropped") > 0
    text = F.when(changed, F.col("kept")).otherwise(row["text"])
    row = row.withField("text", text)
    if "n_chars" in docs.columns:
        chars = F.when(changed, F.length("kept").cast("long")).otherwise(F.col("__row.n_chars"))
        row = row.withField("n_chars", chars)
    return kept.select(row.alias("__row")).select("__row.*")


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more from benchmark passages go."""
    found = find_contamination(_packed(docs), table(spark, sf_dir, "benchmark"), carry=("__row",))
    return found.where(~contaminated()).select("__row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document in the mix."""
    return mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_documents),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Training and hashing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    folder, docs = RunFolder(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = folder.table(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
