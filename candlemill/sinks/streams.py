"""Where streams end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_stream_files(
    stream: DataFrame, path: str, checkpoint: str, format: str = "csv", once: bool = False
) -> StreamingQuery:
    """Append to CSV (null as empty) or JSON files; ``once`` takes what is there now and stops."""
    writer = stream.writeStream.outputMode("append").format(format)
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    if format == "csv":
        writer = writer.option("nullValue", "").option("emptyValue", "")
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_bars_sink(batch: DataFrame, path: str, batch_id: int) -> None:
    """Append one micro-batch of bars or pattern rows, with the day it was created.

    The batch number is a partition below the day, so a batch that is run again replaces its own rows only, and a
    day has as many folders as micro-batches, however many symbols there are. Rows lie together by symbol.
    """
    rows = batch.withColumns({"created_at": F.current_date(), "batch_id": F.lit(batch_id)})
    (
        rows.sortWithinPartitions("landing_date", "symbol").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("landing_date", "batch_id").parquet(path)
    )


def write_warehouse(batch: DataFrame, url: str, table: str, batch_rows: int = 5000, **options) -> None:
    """Append a micro-batch to a warehouse table over JDBC, ``batch_rows`` rows to a statement."""
    rows = batch.withColumn("created_at", F.current_date())
    rows.write.mode("append").option("batchsize", batch_rows).options(**options).jdbc(url, table)


def write_messages(messages: DataFrame, target: str, batch_id: int, format: str = "json",
                   options: dict | None = None) -> None:
    """Publish one micro-batch of messages to a topic, or to files in a folder per batch."""
    if format == "kafka":
        messages.write.format("kafka").option("topic", target).options(**(options or {})).save()
    else:
        messages.write.mode("overwrite").format(format).save(f"{target}/batch_id={batch_id}")
