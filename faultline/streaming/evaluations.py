"""Results that arrive in files: each micro-batch is merged into the evaluation table, idempotently."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def merge_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Append results whose eval_id the target does not hold yet; a replayed batch adds nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(["eval_id"])
        try:
            new = new.join(batch.sparkSession.read.schema(schema).parquet(target).select("eval_id"), "eval_id", "left_anti")
        except AnalysisException:  # the first batch makes the table
            pass
        new.write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
