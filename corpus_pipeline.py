"""The corpus pipeline: five stages over documents, each calling one of the llm operators.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. Empty inputs pass through as empty; null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.llm import bpe, decontam, linededup, neardup, quality
from lanewright.llm.common import free_name, materialize, table, tasks_for, without_keys
from lanewright.llm.queries import vocabulary_text


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject; it learns from three quarters of the labels."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    labels = labels.where("label IS NOT NULL AND crc32(cast(doc_id AS string)) % 4 <> 2")
    model = quality.fit(docs, labels)
    return quality.with_quality(docs, model).where("predicted = 1").select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that its source repeats; n_chars follows the text."""
    cut = linededup.drop_boilerplate(docs).select(*docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast("long"))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five words a shingle, similarity 0.8.

    Id and text say which row is which. Of a group that row stays which has the least id, then the least hash; a null id
    comes last. Texts without words are no copies of each other and all stay.
    """
    key = free_name(docs.columns, "_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(key).alias("key"))
    found = neardup.near_duplicates(keyed.select(rank.alias("doc_id"), "text"), neardup.NearDup(words=5, percent=80))
    found = found.where("n_shingles > 0").select(F.col("doc_id.key").alias(key), "kept")
    found = materialize(found.groupBy(key).agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("rows")), "copies", tasks_for(docs, 0.1))
    others, repeated = found.where("NOT kept").select(key), found.where("kept AND rows > 1").select(key)
    if repeated.isEmpty():
        return without_keys(keyed, others, key).select(*docs.columns)
    once = keyed.join(repeated, key, "left_semi").dropDuplicates([key])
    return without_keys(keyed, others.unionByName(repeated), key).unionByName(once).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their number, and digests of ids and of the text decoded from them."""
    return bpe.encode_documents(docs, vocabulary_text(), with_ids=True).drop("text")


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_boilerplate),
    ("near-duplicates", keep_first_copies),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding", encode),
]
#: SQL has no compression and no BPE; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
