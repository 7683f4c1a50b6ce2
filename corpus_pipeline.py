"""A training corpus in five stages, each over all that its predecessor kept.

Every stage takes rows with nulls in any column, repeated rows and an empty table (which stays empty), whole texts
of any length, and further columns, which it leaves out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statforge.llm import bpe, jaccard, mixing, quality, scratch, suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@scratch.staged
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, those without text among them. A null language or source is a
    group of its own; repeated rows and rows without an id are judged like any other."""
    return quality.quality_filter(docs.select(*COLUMNS))


@scratch.staged
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest id stays. Rows
    without an id are linked with nothing and stay; rows that share an id are one document and share its fate."""
    found = jaccard.ngram_jaccard_join(docs, words=5, percent=80)
    gone = scratch.materialise(found.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "copies")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


@scratch.staged
def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat a document with a smaller id go; a character of which a byte goes, goes whole. Documents left
    without text go. A null id is smaller than all others; rows that share an id don't count as earlier for each other."""
    kept = suffix_dedup.suffix_array_dedup(docs, carry=("lang", "source"), whole_characters=True)
    out = kept.select("doc_id", F.decode(F.col("kept"), "UTF-8").alias("text"), "lang", "source")
    return out.filter(F.length(F.trim("text")) > 0).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


@scratch.staged
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the budgets of their domain, language and source have no room for go. A null language or source
    is a name of its own; rows of a leaf that share an id, or have none, share a fate."""
    taken = mixing.mix_sources(docs, budget_percent=90, max_epochs=1).filter("n_epochs > 0").select("doc_id", "lang", "source").distinct()
    # Rows that share an id, or have none, share a fate within a leaf only.
    leaf = [F.coalesce(docs[c], F.lit("?")) == taken[c] for c in ("lang", "source")]
    return docs.select(*COLUMNS).join(taken, [docs.doc_id.eqNullSafe(taken.doc_id), *leaf], "left_semi")


@scratch.staged
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to; each row has its own, whatever its id."""
    out = bpe.encode_texts(docs, *bpe.public_ranks(spark))
    digest = lambda c: F.sha2(F.col(c), 256).alias(f"{c}_sha256")
    return out.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), digest("ids"), digest("decoded"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", suffix_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE", tokens),
]

#: The stages hold sketches, near duplicates and merges, which SQL can't express; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        path = scratch.stage_path(spark, name.split()[0])
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if written:
            scratch.delete(spark, written)
        written = path
    return docs
