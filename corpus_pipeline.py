"""The corpus pipeline: toxicity, near-dedup of similar shingle sets, suffix-array dedup, benchmark decontamination, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import encode_documents
from ledgerloom.llm.common import stored, table
from ledgerloom.llm.decontaminate import find_leaks
from ledgerloom.llm.near_sets import similar_groups
from ledgerloom.llm.suffix_dedup import WORDS, remove_repeats
from ledgerloom.llm.toxicity import score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Learned scores, connected components and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 by the models that the labelled documents teach."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return score_toxicity(docs.select(*COLUMNS), labels).where("tox_score < 0.5").select(*COLUMNS)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by five-word Jaccard >= 0.8: the one of smallest doc_id, once.

    SimHash fingerprints of five-word shingles link the texts, and each link is checked on the shingles; as similar texts may
    differ in more bits than link, prefix buckets of the shingles add the pairs beyond, and these alone. A doc_id with several
    texts is several documents. Rows without doc_id stay. Texts are judged as they come in: documents that differ only in
    passages which the next stage cuts are two documents here, and may end with equal texts."""
    known = docs.where("doc_id is not null")
    first = similar_groups(known).where("first").select("doc_id", F.col("text_hash").alias("th")).distinct()
    rows = known.select(*COLUMNS, F.xxhash64(F.col("text").cast("string")).alias("th")).join(first, ["doc_id", "th"], "left_semi")
    # repeated rows of one text: the first in the order of the other columns
    kept = rows.groupBy("doc_id", "th").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("row")).select("doc_id", "row.*")
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words that repeat; documents of which nothing but white space is left go."""
    cut = remove_repeats(docs.select(*COLUMNS), WORDS, words=True).where("n_removed = 0 or trim(text) <> ''")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; texts are told apart by a hash, so doc_ids may be null or repeated."""
    key = F.xxhash64(F.col("text").cast("string"))
    leaks = find_leaks(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), whole=True).select(F.col("doc_id").alias("th")).distinct()
    return docs.select(*COLUMNS, key.alias("th")).join(leaks, "th", "left_anti").select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and its text as decoded from them."""
    made = encode_documents(docs, keep=("lang", "source", "n_chars"))
    return made.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES = [
    ("toxicity", toxicity),
    ("simhash", simhash),
    ("suffix_array", suffix_array),
    ("decontamination", decontamination),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
