"""One query for each operator, over whole tables, and the SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, html, jaccard, katz, media, mixing, quality, search, suffix, toxicity, urls, vectors
from ._tables import read, written


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(chat.format_conversations(turns.unionByName(extra)))


def op2_media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.store_texts(read(spark, sf_dir, "documents")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train_quality(docs, quality.ratings(read(spark, sf_dir, "labels")))
    scored = quality.score_quality(docs, model).drop("text")
    return scored.withColumn("keep", (F.col("tail_probability") >= 0.5).cast("int"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = read(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix_sources(written(sized, "sizes"), "size")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html.extract(pages, html.train_pages(html.labelled_pages(spark)))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "content_probability")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("toxic").alias("grade"))
    scored = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs.where(~held_out), labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


#: Rules of ``op11_url_filter``.
URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return urls.judge_urls(pages, urls.train_urls(pages, pages, text="html", markup=True), URL_RULES)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(search.build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.compress(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_media_clips": op2_media_clips,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality": op4_quality,
    "op5_mix_sources": op5_mix_sources,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_katz_score": op7_katz_score,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_html_text": op9_html_text,
    "op10_toxicity": op10_toxicity,
    "op11_url_filter": op11_url_filter,
    "op12_lexical_search": op12_lexical_search,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES = {
    "op5_mix_sources": mixing.ORACLE_SQL,
    "op12_lexical_search": search.ORACLE_SQL,
    "op13_vector_codes": vectors.ORACLE_SQL,
}
