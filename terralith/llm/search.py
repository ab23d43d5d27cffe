"""Ranked lexical search: an index of postings in buckets of terms, and the highest-scoring documents of each item.

Terms are the runs of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case.  All but the term weights is in
whole numbers, so ranks are the same in every run.

* ``build_index`` writes a row for each term and document, dealt by bucket of the term and slice of the documents.
* ``search`` joins the postings with the items' terms and scores each match once, whatever number of items asks for its term.
  Matches then go to their document's task; there they meet the items, and are added up by item and document without another
  exchange.  ``row_number`` ranks: each task sends its k best of each item.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._joins import SENT, attach
from ._tables import written

#: A maximal run of these is a term.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 64


def bucket_of(term: str = "term") -> Column:
    return (F.crc32(term) % BUCKETS).cast("int")


@dataclass
class Index:
    """``postings`` (bucket, doc, doc_id, n, term, tf) of all documents; the number of those with a term, and of all terms.

    Bucket BUCKETS holds no postings, but a row for each document that has a term.
    """

    postings: DataFrame
    documents: int
    length: int


def _counted(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, n, bucket, terms, tfs) from (doc, doc_id, text): a row for each document and bucket of its terms.

    Terms are counted where the document stands, and a row holds many, parted by spaces, which are in no term.  Bucket BUCKETS
    gets a row without a term for each document that has any.
    """
    of, lower = re.compile(TERM), str.maketrans(_UPPER, _LOWER)
    kinds = {"doc": pa.int64(), "doc_id": pa.int64(), "n": pa.int64(), "bucket": pa.int32(), "terms": pa.string(), "tfs": pa.string()}

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for doc, doc_id, text in zip(*(batch.column(k).to_pylist() for k in ("doc", "doc_id", "text")), strict=True):
                found = Counter(of.findall(text.lower() if text.isascii() else text.translate(lower)))
                by_bucket: dict[int, list[str]] = {}
                for term in found:
                    by_bucket.setdefault(crc32(term.encode()) % BUCKETS, []).append(term)
                n = found.total()
                rows += [(doc, doc_id, n, bucket, " ".join(some), " ".join([str(found[t]) for t in some])) for bucket, some in by_bucket.items()]
                if found:
                    rows.append((doc, doc_id, n, BUCKETS, "", "0"))
                if len(rows) > 1 << 14:
                    yield table(rows)
                    rows = []
        if rows:
            yield table(rows)

    return docs.mapInArrow(run, "doc long, doc_id long, n long, bucket int, terms string, tfs string")


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> Index:
    """The index of all rows of ``docs``, each row a document of its own; null texts and ones without a term are in no posting.

    A bucket is cut into slices by a hash of the document, so a term that every document holds fills many tasks and files;
    within a file postings are sorted by bucket.
    """
    raw = F.col(text).cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).cast("long").alias("doc_id"), raw.alias("text")).where("text IS NOT NULL")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, -(-4 * parts // BUCKETS))
    dealt = _counted(rows).repartition(parts, "bucket", F.pmod(F.xxhash64("doc"), F.lit(slices))).sortWithinPartitions("bucket")
    each = F.arrays_zip(F.split("terms", " ").alias("term"), F.split("tfs", " ").alias("tf"))
    postings = written(dealt.select("bucket", "doc", "doc_id", "n", F.inline(each)).withColumn("tf", F.col("tf").cast("long")), "postings")
    total = postings.where(F.col("bucket") == BUCKETS).agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).head()
    return Index(postings, total["documents"], total["length"])


def asked_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term): the terms of each item, once each; rows of one item_id, or without one, are one item."""
    found = F.regexp_extract_all(F.translate(F.col(text).cast("string"), _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    return items.select(F.col(item_id).alias("item_id"), F.explode(F.array_distinct(found)).alias("term")).distinct()


def search(index: Index, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of each item with the highest scores above 0, equal ones by doc_id.

    Items without a term that any document holds have no rows.  Documents without an id come last among equals; repeated
    documents have a rank each.
    """
    asked = written(asked_terms(items, item_id, text), "asked-terms")
    by_term = written(asked.groupBy("term").agg(F.collect_set(F.struct("item_id")).alias("items")).withColumn("term_no", F.monotonically_increasing_id()), "asked-items")
    known = index.postings.where(F.col("bucket") < BUCKETS).select("bucket", "term", "doc", "doc_id", "n", "tf")
    if by_term.count() <= SENT:
        buckets = [r["bucket"] for r in by_term.select(bucket_of().alias("bucket")).distinct().collect()]
        known = known.where(F.col("bucket").isin(buckets))
    df = attach(known.select("term"), by_term.select("term", "term_no"), "term").groupBy("term", "term_no").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * index.documents + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = written(df.select("term", "term_no", weight.alias("w")).where("w > 0"), "term-weights")

    length, documents = max(1, index.length), index.documents
    if 90 * length * documents < 1 << 63:
        m = F.expr(f"10 + (90 * n * {documents}L) div {length}L")
    else:  # the same where the product has more than 64 bits
        m = F.expr(f"10 + (CAST(n AS DECIMAL(18,0)) * CAST('{90 * documents}' AS DECIMAL(19,0))) div CAST({length}L AS DECIMAL(19,0))")
    matches = attach(known, weights, "term").withColumn("m", m)
    scored = matches.select("doc", "doc_id", "term_no", F.expr("w * ((1000000000L * tf) div (1000L * tf + 8L * m))").alias("points"))
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = attach(scored.repartition(parts, "doc"), by_term.select("term_no", "items"), "term_no", SENT if asked.count() <= 10 * SENT else 0)
    each = met.select(F.explode("items").alias("item"), "doc", "doc_id", "points").select("item.item_id", "doc", "doc_id", "points")
    sums = each.groupBy("item_id", "doc", "doc_id").agg(F.sum("points").alias("score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "doc")
    ranked = sums.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = rf"""
WITH t AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term
  FROM documents),
p AS MATERIALIZED (SELECT doc, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM benchmark),
w AS (
  SELECT term, CAST(floor(1000 * ln((2.0e0 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
s AS (
  SELECT q.item_id, p.doc, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * d.n * c.docs) // c.l)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (doc), c GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, doc) AS rank FROM s WHERE score > 0)
WHERE rank <= 10"""
