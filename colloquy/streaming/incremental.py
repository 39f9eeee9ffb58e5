"""Forests that follow a stream of messages: an addition of this engine, built on the batch operator.

Every micro-batch is appended to the mailbox store, and the forests of the mailboxes that it touches are computed
anew. Both writes go to a folder named by the batch, so a batch that is repeated after a failure replaces its own
output. Mailboxes are dealt to ``BUCKETS`` folders below it, and a batch reads only those of the mailboxes that it touches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from colloquy.operators.threading import thread_messages
from colloquy.schema import MESSAGE_SCHEMA, NODE_SCHEMA, as_mailbox


#: Folders of a batch; as a part of the stores' layout, fixed for their lifetime.
BUCKETS = 256


def _bucket() -> Column:
    return F.pmod(F.xxhash64(F.coalesce("mailbox_id", F.lit(""))), F.lit(BUCKETS)).cast("int")


@dataclass
class IncrementalThreads:
    """Stores under ``path``; ``options`` as for ``thread_messages``."""

    path: str
    options: dict = field(default_factory=dict)

    def _read(self, spark: SparkSession, name: str, schema) -> DataFrame:
        full = schema.add("batch", "long").add("bucket", "integer")
        try:
            return spark.read.schema(full).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return spark.createDataFrame([], full)

    def messages(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "messages", type(MESSAGE_SCHEMA)(MESSAGE_SCHEMA.fields[:])).drop("batch", "bucket")

    def forest(self, spark: SparkSession) -> DataFrame:
        """The latest forest of every mailbox."""
        rows = self._read(spark, "forest", type(NODE_SCHEMA)(NODE_SCHEMA.fields[:]))
        last = rows.groupBy(F.coalesce("mailbox_id", F.lit("")).alias("_b")).agg(F.max("batch").alias("_last"))
        return rows.join(last, (F.coalesce("mailbox_id", F.lit("")) == F.col("_b")) & (F.col("batch") == F.col("_last"))).select(*NODE_SCHEMA.names)

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Take in one micro-batch of messages."""
        spark = batch.sparkSession
        self._write(as_mailbox(batch), "messages", batch_id)
        known = self._read(spark, "messages", type(MESSAGE_SCHEMA)(MESSAGE_SCHEMA.fields[:])).where(F.col("batch") <= batch_id)
        new = known.where(F.col("batch") == batch_id)
        touched = new.select(F.coalesce("mailbox_id", F.lit("")).alias("_b")).distinct()
        buckets = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
        known = known.where(F.col("bucket").isin(buckets)).drop("batch", "bucket")
        affected = known.join(touched, F.coalesce("mailbox_id", F.lit("")) == F.col("_b"), "left_semi")
        self._write(thread_messages(affected, **self.options), "forest", batch_id)

    def _write(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows.withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/batch={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Follow a streaming table of messages; ``trigger`` as for ``DataStreamWriter.trigger``."""
        writer = stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
