"""The corpus pipeline: documents of good quality, without boilerplate lines and near-duplicates, mixed and encoded.

Each stage works on all rows of the one before, which run() writes as Parquet and rereads; so a lost executor or a restart
repeats one stage at most. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import SPACES
from lexloom.llm import bpe, lines, minhash, mixing, quality
from lexloom.session import discard, materialize, prepare, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more by a model of all labels.

    Null and empty texts have a score like any other. Rows that repeat an id are scored one by one. An empty table stays empty.
    """
    return quality.classify(docs, table(prepare(spark), sf_dir, "labels")).filter("score >= 0.5").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without boilerplate lines, n_chars following; a document of which only white space is left goes.

    Null and blank texts that had no such line stay as they are. Rows that repeat an id and a text share their fate.
    """
    out = lines.dedup_lines(docs)
    gone = (F.col("n_removed") > 0) & (F.trim("text", F.lit(SPACES)) == "")
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.filter(~gone).withColumn("n_chars", chars).select(*docs.columns)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group linked at a similarity of 0.8 or more.

    Rows that repeat an id are one document: of those that stay, the row of the smallest text (null first) does. Rows with a
    null id all stay, as do those without words.
    """
    prepare(spark)
    gone = materialize(minhash.near_duplicates(docs).filter("NOT kept").select("doc_id"), "pipeline-copies")
    many = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    many = materialize(many.join(gone, "doc_id", "left_anti"), "pipeline-repeated-ids")
    rest = docs.join(gone.unionByName(many), "doc_id", "left_anti").select(*docs.columns)
    if many.isEmpty():
        return rest
    row = F.struct("text", *[c for c in docs.columns if c != "text"])
    one = docs.join(many, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("row"))
    return rest.unionByName(one.select("row.*").select(*docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Documents without words take no part in the mix; sources, null among
    them, are those of the documents that came this far."""
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts, and whether they decode to the text. Null and empty texts have no ids."""
    prepare(spark)
    out = bpe.decode(bpe.encode(docs))
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", minhash_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", bpe_stage),
]
ORACLE_SQL = None  # the quality model has no SQL; tests compare each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spent = table(prepare(spark), sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "pipeline-" + name.replace(" ", "-"))
            if spent is not None:
                discard(spent)
            spent = docs
    return docs
