"""Incremental, idempotent ingest as a stream of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quern.functions.text import is_noise
from quern.operators.maintenance import new_rows


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "chunk_id", section: str | None = "section") -> StreamingQuery:
    """Reads new files of ``source`` and appends rows with new keys to the Parquet table ``target``.

    A batch that is repeated after a failure adds nothing, because its keys are stored by then."""
    stream = spark.readStream.schema(schema).parquet(source)

    def add(batch: DataFrame, _: int) -> None:
        rows = batch.where(~is_noise(F.col(section))) if section else batch
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            fresh = new_rows(spark.read.schema(batch.schema).parquet(target), rows, key)
        else:
            fresh = rows.dropDuplicates([key])
        fresh.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
