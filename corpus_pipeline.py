"""From raw documents to a training mix: five stages, each over all that the one before has kept.

Each stage takes (spark, docs, sf_dir) and returns a table, which ``run`` writes as Parquet and reads again as the next one's
docs.  All but the last return the columns of ``docs``.  Documents are known by doc_id, which is meant to be unique; what a stage
does with rows that share an id or have none is said there.  Empty tables pass through all stages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm import decontam, jaccard, mixing, quality, suffix
from terralith.llm._tables import read, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a grade of 1 or more is at least one half; the model learns from the graded ones.

    Rows without an id and repeated rows are judged each by its text.
    """
    model = quality.train_quality(docs, quality.ratings(read(spark, sf_dir, "labels")))
    scored = quality.score_quality(docs, model)
    return scored.where("tail_probability >= 0.5").select(docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near-duplicates, once.

    Of rows with the least id the text with the least MD5 stays, and of rows that differ in other columns alone the least.  Rows
    without an id have no class: they all stay.
    """
    classes = jaccard.jaccard_classes(docs).where("class_id IS NOT NULL")
    heads = classes.groupBy("class_key").agg(F.min(F.struct("doc_id", F.coalesce("text_md5", F.lit("")).alias("md5"))).alias("h")).select(F.col("h.doc_id").alias("__id"), F.col("h.md5").alias("__md5"))
    md5 = F.coalesce(F.md5("text"), F.lit(""))
    kept = docs.join(heads, (F.col("doc_id") == F.col("__id")) & (md5 == F.col("__md5")), "left_semi")
    others = [F.col(c) for c in docs.columns if c != "doc_id"]
    once = kept.groupBy("doc_id", md5.alias("__md5")).agg(F.min(F.struct(*others)).alias("__row")).select("doc_id", "__row.*")
    return once.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their repeated passages; characters that are cut in part go, n_chars is counted anew.

    Rows without an id count as coming after all others and lose their repeats too; rows of one id with several texts are told
    apart by MD5.
    """
    found = suffix.remove_repeats(docs).where("n_removed > 0").select(F.col("doc_id").alias("__id"), F.col("text_md5").alias("__md5"), "kept")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([x.decode("utf-8", "ignore") for x in batch.column("kept").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__md5"), text], names=["__id", "__md5", "__text"])

    changed = found.dropDuplicates(["__id", "__md5"]).mapInArrow(decode, "__id long, __md5 string, __text string")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.md5(F.col("text")) == F.col("__md5"))
    joined = docs.join(changed, same, "left").withColumn("text", F.coalesce("__text", "text"))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("__text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return joined.select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage, with an id or without; texts of one id are told apart by MD5."""
    hits = decontam.contaminated(docs, read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__id"), F.col("text_md5").alias("__md5")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.md5(F.col("text")) == F.col("__md5"))
    return docs.join(hits, same, "left_anti").select(docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with size, source_size, target and taken (words, repeats counted)."""
    sized = docs.drop("size").withColumn("size", mixing.word_count(F.col("text")))
    return mixing.mix_sources(sized, "size").where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", mixing_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The first four stages can't be expressed in SQL; tests hold near-duplicates, repeats and benchmark passages that the stages keep against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
