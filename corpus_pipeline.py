"""From raw documents to packed training sequences: rules, classifier, near copies, benchmark leaks, packing.

Every stage works on what the one before it kept and is written as Parquet before the next one reads it.  The ids that a
stage takes out or keeps are written; they are broadcast up to a number of bytes and joined by a shuffle beyond.

Cases, the same for all stages: a null or empty text fails the rules and goes there.  Rows with a null doc_id can't be
named by a later stage: they stay unless the rules reject them.  Rows that share a doc_id go together in the classifier
and the leak stages if one of them is rejected; of those that are left the near-copy stage keeps one.  Ties between
copies go to the smallest doc_id.  Empty tables give empty results; without labels the classifier rejects nothing, and
without a benchmark nothing leaks.  Columns other than those of documents are left behind by the first stage, so extra
ones can't clash with what the stages add.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.llm.decontamination import leaks
from lumenspan.llm.jaccard_join import similar_documents
from lumenspan.llm.packing import pack
from lumenspan.llm.quality_classifier import classify
from lumenspan.llm.quality_rules import quality_rules
from lumenspan.llm.queries import BPE_FILE, table, tokenizer_file
from lumenspan.store import broadcast_if_small, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that failed."""
    good = quality_rules(docs).where("kept").withColumn("text", F.col("clean_text"))
    return good.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps.  It is co-trained on all raw documents: the rules left no labelled bad ones."""
    raw = table(spark, sf_dir, "documents")
    bad = classify(docs, table(spark, sf_dir, "labels"), fit_on=raw).where("not kept").select("doc_id").distinct()
    return docs.join(broadcast_if_small(staged(bad, "rejected")), "doc_id", "left_anti").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document that gives the group its id, the smallest; of repeated rows one."""
    groups = similar_documents(docs.select("doc_id", "text"), k=5, percent=80)
    groups = staged(groups.where("doc_id is not null").select("doc_id", "component_id"), "groups")
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(broadcast_if_small(first), "doc_id", "left_semi")
    if groups.groupBy("doc_id").count().where("count > 1").limit(1).count():
        named = named.dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    leaking = leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(broadcast_if_small(staged(leaking, "leaking")), "doc_id", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_file(BPE_FILE), capacity=1024, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", clean_lines),
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_leaks),
    ("best-fit packing", packed),
]

#: SQL can't express the classifier, the decontamination or the packing.  Tests run every stage on a small table whose
#: copies, leaks and bad documents are known, and compare the packed pieces with the tokenizer's ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
