"""Index chunks as Parquet tables partitioned by chunk, sorted by key so that look-ups skip row groups.

A folder holds one directory first=N for each append: its documents and postings, whose chunks count from 0 inside it, so
their numbers begin at N. An append is written under a hidden name and published by one rename, which fails where the
name is taken: readers see all of it or nothing, and two writers never share a number.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import index


def _hadoop(spark: SparkSession, path: str):
    p, conf = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsparkSession.sessionState().newHadoopConf()
    return p, p.getFileSystem(conf), conf


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.option("basePath", folder).parquet(f"{folder}/first=*/table={name}")
    return rows.withColumn("chunk_id", (F.col("first") + F.col("chunk")).cast("long")).drop("first", "table", "chunk")


def next_chunk(spark: SparkSession, folder: str) -> int:
    """One more than the largest chunk of a stored index; 0 if there is none."""
    p, fs, _ = _hadoop(spark, f"{folder}/first=*")
    if not fs.globStatus(p):
        return 0
    return _table(spark, folder, "documents").agg(F.max("chunk_id")).first()[0] + 1  # every chunk has a document


def _publish(spark: SparkSession, staged: str, target: str) -> bool:
    """Rename unless the target exists."""
    (src, fs, conf), (dst, _, _) = _hadoop(spark, staged), _hadoop(spark, target)
    never = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    never[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(src, dst, never)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException" or fs.exists(dst):
            return False
        raise
    return True


def write_index(parsed: DataFrame, folder: str, max_docs: int = index.MAX_DOCS, max_words: int = index.MAX_WORDS) -> int:
    """Append the index of parsed pages as new chunks; returns the first one's number. What is left of an interrupted append
    is never read. Without pages nothing is written, and the number is the next free one."""
    spark, staged = parsed.sparkSession, f"{folder}/_staged-{uuid.uuid4().hex}"
    if parsed.isEmpty():
        return next_chunk(spark, folder)
    occ = index.occurrences(parsed, max_docs, max_words)
    rows = occ.placed.select("doc_seq", "url", F.col("chunk_id").alias("chunk"))
    rows.repartition("chunk").write.partitionBy("chunk").parquet(f"{staged}/table=documents")
    lists = index.postings(occ).withColumnRenamed("chunk_id", "chunk")
    if not index.are_whole(occ):  # else a chunk's lists are in one task, and make one file
        lists = lists.repartition("chunk", "key")
    lists.sortWithinPartitions("chunk", "key").write.partitionBy("chunk").parquet(f"{staged}/table=postings")
    while True:
        first = next_chunk(spark, folder)
        if _publish(spark, staged, f"{folder}/first={first}"):
            return first


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """postings and documents of a stored index; filters on key reach the Parquet scan."""
    return _table(spark, folder, "postings"), _table(spark, folder, "documents")


def chunk_path(folder: str, chunk_id: int, spark: SparkSession) -> str:
    """The directory that holds a chunk's posting lists."""
    firsts = [int(s.getPath().getName().split("=")[1]) for s in _hadoop(spark, folder)[1].globStatus(_hadoop(spark, f"{folder}/first=*")[0])]
    first = max(f for f in firsts if f <= chunk_id)
    return f"{folder}/first={first}/table=postings/chunk={chunk_id - first}"
