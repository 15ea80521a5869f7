"""Structured Streaming form of prepare + keep-first dedupe (E2 on a stream).

Rows arrive as files in a folder (``readStream``); each micro-batch is
cleaned with the same column expressions as the batch path, and
``dropDuplicates`` on the md5 text key keeps the first arrival of every key.
With an event-time column the state is bounded by a watermark
(``dropDuplicatesWithinWatermark``); without one the state holds one key per
distinct text.  The sink is any streaming sink; its checkpoint makes the
query restartable after executor or driver loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.prepare import PREPROCESSING_VERSION, clean_records


def prepared_stream(spark: SparkSession, path: str, schema, *, fmt: str = "parquet",
                    event_time: str | None = None, watermark: str = "1 hour",
                    max_text_length: int | None = None) -> DataFrame:
    stream = spark.readStream.schema(schema).format(fmt).load(path)
    out = clean_records(stream, max_text_length=max_text_length).withColumn(
        "_key", tx.key_hash("text"))
    if event_time:
        out = out.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["_key"])
    else:
        out = out.dropDuplicates(["_key"])
    return out.drop("_key").withColumn("preprocessing_version", F.lit(PREPROCESSING_VERSION))


def start(df: DataFrame, sink_path: str, checkpoint: str, *, fmt: str = "parquet",
          available_now: bool = True):
    w = df.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w
    return w.start(sink_path)
