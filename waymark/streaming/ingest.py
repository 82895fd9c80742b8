"""Incremental ingest: new files become chunks once, however often they come and under whatever name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import text as X

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def firsts(rows: DataFrame) -> DataFrame:
    """Of a batch's rows and the marks of its new hashes (`fresh`), the first row of each hash that has a mark, by doc_id (nulls last), then source."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("source").isNull().alias("unknown"), "source", "text")
    best = rows.groupBy("hash").agg(F.max("fresh").alias("fresh"), F.min(F.when(~F.col("fresh"), row)).alias("r"))
    return best.where("fresh").select("hash", "r.doc_id", "r.source", "r.text")


def ingest_new(spark: SparkSession, inbox: str, store: str, checkpoint: str, schema: str = "doc_id long, source string, text string") -> None:
    """Read the files of inbox (parquet) that no earlier run saw, and add the chunks of texts that are new by content hash to store: a copy under
    another name, in this or an earlier batch, is skipped; of equal texts in a batch the smallest doc_id's stays, a null one last. Texts that share a
    doc_id, or have none, are chunked each for itself. Null texts give nothing.

    Which hashes were seen is keyed state in the query's state store (RocksDB, unless the session names another), dealt by hash: a batch costs what its own rows
    cost, however much is stored. No text passes the state. A checkpoint of the form before, with a group of rows a hash, can't be gone on with. Each batch writes its own folder of the store anew, so that a batch that is run again after a failure
    replaces what it wrote. Runs until all that is there is read, then ends."""

    def batch(rows: DataFrame, number: int) -> None:
        chunks = X.windows(firsts(rows), keep=["hash", "source"]).select("hash", "doc_id", "source", "ord", "chunk")
        chunks.write.mode("overwrite").parquet(f"{store}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(inbox).where("text IS NOT NULL")
    rows = stream.select(F.sha2("text", 256).alias("hash"), F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    # a hash alone passes the state, and marks the batch's rows that have it
    none = lambda t: F.lit(None).cast(t)
    marks = rows.select("hash").dropDuplicates(["hash"]).select("hash", none("long").alias("doc_id"), none("string").alias("source"), none("string").alias("text"), F.lit(True).alias("fresh"))
    fresh = marks.unionByName(rows.withColumn("fresh", F.lit(False)))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER if before is None or "HDFSBacked" in before else before)
    try:
        fresh.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(batch).start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The chunks of a store, (hash, doc_id, source, ord, chunk, batch); none yet is an empty table."""
    return spark.read.schema("hash string, doc_id long, source string, ord int, chunk string, batch long").option("basePath", store).parquet(store)


def empty_store(spark: SparkSession, store: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(path)
