"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the five columns of
documents, and no others that docs may have. A stage that changes texts brings n_chars up to date. Rows with a null text or a
null doc_id go through all stages like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aurum.llm.common import new_path, table
from aurum.llm.decontaminate import contamination, row_key
from aurum.llm.line_dedup import remove_lines
from aurum.llm.pieces import encode_decode, model_bytes
from aurum.llm.prefix_join import linked_rows
from aurum.llm.quality import scored, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3 go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs.select(*COLUMNS), model).where("quality_score >= 0.3").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are near copies of each other one stays; a document that has no word left of those it had goes."""
    out = remove_lines(docs.select(*COLUMNS))
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8. Of each component one document stays, the one with the smallest doc_id; of
    rows that repeat its doc_id and text, one. Documents without words or doc_id stay."""
    found = linked_rows(docs, 5, 80).where("n > 0 and doc_id is not null").select("doc_id", "text_hash", "component_id", "component")
    same = F.col("doc_id") == F.col("component_id")
    # where several texts of a component have the smallest doc_id, the one with the least hash stays
    head = found.where(same).groupBy("component").agg(F.min("text_hash").alias("least"))
    other = found.where(same).join(head, "component").where(F.col("text_hash") != F.col("least"))
    gone = found.where(~same).select("doc_id", "text_hash").union(other.select("doc_id", "text_hash")).distinct()
    rows = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).join(gone, ["doc_id", "text_hash"], "left_anti")
    again = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("k")).where("k > 1").select("doc_id", "text_hash")
    if not again.take(1):
        return rows.select(*COLUMNS)
    one = rows.join(again, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return rows.join(again, ["doc_id", "text_hash"], "left_anti").unionByName(one).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of 10 words of a benchmark item occurs go."""
    found = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_key", "text_hash").distinct()
    rows = docs.select(*COLUMNS, *row_key())
    return rows.join(found, ["doc_key", "text_hash"], "left_anti").select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_decode(docs, model_bytes())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("encoding", encoding)]

#: SQL can express neither the trained classifier nor the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; between two stages the rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
