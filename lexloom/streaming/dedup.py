"""Incremental first-wins deduplication of a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import shingles


def dedup_batch(batch: DataFrame, folder: str, batch_id: int, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Add to folder's table of signatures the rows of a batch that are similar neither to a stored row nor to one before
    them in the batch. A batch that is run again replaces what it wrote before, so a restart keeps each row once."""
    spark = batch.sparkSession
    signed = shingles.add_signatures(batch, id_col=id_col, text_col=text_col)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        stored = spark.read.parquet(folder).filter(F.col("batch") < batch_id)
        signed = shingles.novel(signed, stored.select("id", "n_words", "sig"))
    shingles.greedy_dedup(signed).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def start(stream: DataFrame, folder: str, checkpoint: str, **names):
    """A streaming query over documents; trigger availableNow ends with the input there is."""
    run = lambda batch, k: dedup_batch(batch, folder, k, **names)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
