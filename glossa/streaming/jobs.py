"""Stateless streaming over a landing folder of Parquet text files.

* :func:`stream_encode` runs the *same* batch encoder on every micro-batch via
  ``foreachBatch`` with a frozen vocabulary. The encoder regroups only inside
  a micro-batch (a document arrives whole), so no state store and no
  watermark are involved. Each batch overwrites its own ``batch_id`` folder,
  so a replayed batch after a failure rewrites identical output (idempotent).
* :func:`stream_score` applies a stored pipeline model with an append sink.

Both use a checkpoint location for exactly-once progress tracking and
``availableNow`` triggers (process what has landed, then stop); a long-running
job uses ``processingTime`` instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import encode as E
from glossa.operators import tokens as tok
from glossa.operators.joins import bounded_broadcast

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def read_landing(spark: SparkSession, folder: str, schema: str = DOC_SCHEMA, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def stream_encode(spark: SparkSession, landing: str, out: str, checkpoint: str, vocab: DataFrame,
                  max_sentences: int, max_words: int, max_files: int | None = None) -> None:
    """Encode landed documents into ``(doc_id, x)`` matrices, micro-batch by
    micro-batch; blocks until everything landed so far is written."""
    frozen = bounded_broadcast(vocab.select("word", "idx"))

    def encode_batch(batch: DataFrame, batch_id: int) -> None:
        # a landed row is a document, also where keys repeat: which rows share a batch changes nothing
        rows = batch.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        mat = E.doc_matrix(rows.select(F.col("row").alias("doc_id"), F.col("doc_id").alias("key")),
                           tok.clean_tokens(rows, key="row"), frozen, max_sentences, max_words, carry=["key"],
                           vocab_measured=True).select(F.col("key").alias("doc_id"), "x")
        mat.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (read_landing(spark, landing, max_files=max_files).writeStream
         .foreachBatch(encode_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_score(spark: SparkSession, landing: str, out: str, checkpoint: str, model,
                 max_files: int | None = None) -> None:
    """Score landed documents with a fitted pipeline; append-only sink."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(read_landing(spark, landing, max_files=max_files)).select(
        "doc_id", F.col("prediction").cast("int").alias("pred"),
        vector_to_array("probability").alias("probability"))
    q = (scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
