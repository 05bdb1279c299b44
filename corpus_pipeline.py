"""A corpus cleaned and encoded, stage by stage: each stage is written as Parquet and the next one reads that.

Every stage takes any columns besides ``doc_id`` and ``text`` and gives them back, in their order, but for the last. Null
and empty texts have no words: the first stage's base rule drops them, the others keep them as they are. Rows are told
apart also where ids are null or repeated. Repeated rows are one group of near duplicates, of which one stays. An empty
table goes through every stage and gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import decontamination, near_duplicates, personal_data, piece_encoding, quality_rules
from loomframe.llm.common import table, written

#: The stages learn and match, which SQL can't express; the tests hold them against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep; each row is judged for itself. Without labels,
    the base rules alone."""
    whole = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    # written with the documents, so that the statistics are worked out once and verdicts need no join by an id
    stats = written(quality_rules.statistics(whole, id_col="doc"), "statistics")
    rules = quality_rules.learn(stats.withColumn("doc_id", F.col("doc.doc_id")), table(spark, sf_dir, "labels"))
    return quality_rules.judge(stats, rules).where("kept").select("doc.*")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the least id (without an id only if the whole group has
    none): a Jaccard index of 0.8 of five-word shingles. Texts without words are no duplicates of each other."""
    return near_duplicates.deduplicate(docs, n=5, percent=80).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item; null items, and items of fewer than four words, overlap with nothing."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars``, if there is one, counted anew."""
    masked = personal_data.mask(docs, personal_data.fit(docs))
    return masked.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they are decoded to its text; null text has no ids and decodes to nothing.
    Of the other columns, ``lang`` and ``source`` are kept where there are such."""
    own = ["doc_id", *[c for c in ("lang", "source") if c in docs.columns]]
    kept = docs.select(F.struct(*own, F.sha2("text", 256).alias("sha")).alias("doc"), "text")
    coded = piece_encoding.encode(kept, piece_encoding.model_path(), id_col="doc")
    same = F.coalesce(F.sha2("decoded", 256) == F.col("doc.sha"), F.length("decoded") == 0)
    return coded.select(*[f"doc.{c}" for c in own], "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicate),
    ("benchmark decontamination", decontaminate),
    ("personal data", mask_personal_data),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder before the next one reads them."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
