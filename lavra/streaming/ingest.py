"""Streaming ingest into the corpus: micro-batches with exact, idempotent deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lavra.operators.corpus import insert_ignore, stripped
from lavra.sources.writers import read_corpus


def ingest_stream(spark: SparkSession, source: DataFrame, corpus_path: str, checkpoint: str, least: int = 5, most: int = 50_000) -> StreamingQuery:
    """Write each micro-batch of source(texto, fonte, categoria) to corpus_path/lote=<n>, without texts already there.

    A batch that runs again after a failure overwrites its own folder and does not read it, so the result is that of one run.
    State is the corpus itself, not the memory of the stream.
    """

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        whole = read_batches(session, corpus_path).filter(F.col("lote") != number)
        rows = stripped(batch.withColumn("id", F.monotonically_increasing_id()), least, most)
        insert_ignore(whole, rows).select("texto", "fonte", "categoria").write.mode("overwrite").parquet(f"{corpus_path}/lote={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.listStatus(at):
        return spark.createDataFrame([], "texto string, fonte string, categoria string, lote long")
    return spark.read.schema("texto string, fonte string, categoria string, lote long").parquet(path)


def counts_stream(source: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Rows of each category by arrival window, with late rows up to the watermark."""
    return source.withWatermark("adicionado", watermark).groupBy(F.window("adicionado", window), "categoria").agg(F.count("*").alias("n"))


__all__ = ["counts_stream", "ingest_stream", "read_batches", "read_corpus"]
