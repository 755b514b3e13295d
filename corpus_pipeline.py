"""The corpus pipeline: documents through toxicity, exact dedup, near dedup, mixing and encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import queries as Q
from maskwright.llm.bpe import bpe_round_trip
from maskwright.llm.exact_dedup import exact_dedup
from maskwright.llm.jaccard_join import jaccard_join
from maskwright.llm.mixing import mix_sources, repeated
from maskwright.llm.spark_util import ascii_lower, cut, small_side, stage_folder
from maskwright.llm.toxicity import score_toxicity, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit; learned from labels of the rows that are not held out.

    Null texts are empty and score as such; repeated rows score alike; a table without labels rejects nothing.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~Q.held_out(F.col("doc_id")))
    model = train_toxicity(docs, labels)
    score = "score"
    while score in docs.columns:
        score += "_"
    return score_toxicity(docs, model, score_col=score).where(F.col(score) < Q.TOXIC).select(docs.columns)


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``kept`` (``keep_id``); null ids count."""
    return docs.join(small_side(kept), F.col("doc_id").eqNullSafe(F.col("keep_id")), "left_semi")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is not in ``gone`` (``gone_id``). Few go: their ids are broadcast, and texts stay where
    they are, when those that stay are far too many for that."""
    return docs.join(small_side(gone), F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that of the largest id. Null texts are empty, null ids the least; of equal
    rows one stays."""
    judged = exact_dedup(docs)
    found = judged.where("kept").select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_sha"))
    counts = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    several = small_side(counts.where("n > 1").select(F.col("doc_id").alias("several_id")))
    same = F.col("doc_id").eqNullSafe(F.col("several_id"))
    if several.isEmpty():
        return _without(docs, judged.where("not kept").select(F.col("doc_id").alias("gone_id")))
    # an id that several rows have does not tell which of them is kept; their texts do
    single = _only(docs.join(several, same, "left_anti"), found.select("keep_id"))
    sha = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)
    twice = docs.join(several, same, "left_semi").select(F.struct("*").alias("row"), "doc_id", sha.alias("sha"))
    twice = twice.join(found, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha")), "left_semi")
    return single.unionByName(twice.dropDuplicates(["doc_id", "sha"]).select("row.*"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group that links connect (five words, 0.8 or more).

    Of rows with one id each stands for itself: null ids come last, equal ones in the order in which they are read.
    Null and empty texts are linked with nothing and stay.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 OR doc_id IS NULL").isEmpty():
        found = jaccard_join(docs.select("doc_id", "text")).where(F.col("doc_id") != F.col("component_id"))
        return _without(docs, found.select(F.col("doc_id").alias("gone_id")))
    rows = cut(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("rid")))
    place = F.struct(F.col("row.doc_id").isNull().alias("last"), F.col("row.doc_id").alias("id"), "rid")
    found = jaccard_join(rows.select(place.alias("doc_id"), F.col("row.text").alias("text"))).where(F.col("doc_id") == F.col("component_id"))
    return rows.join(small_side(found.select("doc_id.rid")), "rid", "left_semi").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources; rows of later epochs repeat. Null names are sources of their own; rows without words
    cost nothing and enter as often as their source does."""
    used = ("doc_id", "text", "lang", "source")
    others = {c: f"other_{i}" for i, c in enumerate(docs.columns) if c not in used}
    mixed = mix_sources(docs.withColumnsRenamed(others).withColumn("domain", Q.domain("source")), weights=Q.mixing_weights(spark))
    return repeated(mixed).withColumnsRenamed({v: k for k, v in others.items()}).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's row with its packed token ids, their number, and digests of the ids and of what they decode to.

    Null texts are empty and have no ids.
    """
    path = f"{Q.TOKENIZERS}/word_bpe_49k.json"
    coded = bpe_round_trip(docs.select("doc_id", "lang", "source", "text"), path, drop=True)
    return Q.digests(coded, "lang", "source", "ids")


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("encoding", encoding)]

#: A fitted classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = stage_folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
