"""Questions as a stream: each micro-batch runs the batch search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, query: str = "ligne", arrived: str = "recu_le", late: str = "1 day") -> StreamingQuery:
    """Answers a stream of questions into `path`. A question that comes again within the watermark `late` is answered once;
    a batch that is run again replaces its own folder, so a lost executor or driver repeats nothing in the result."""
    once = questions.withWatermark(arrived, late).dropDuplicatesWithinWatermark([query])

    def batch(df: DataFrame, epoch: int) -> None:
        answer(df).withColumn("lot", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/lot={epoch}")

    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def question_counts(questions: DataFrame, arrived: str = "recu_le", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Questions per window of arrival and language; late ones within the watermark are counted."""
    return questions.withWatermark(arrived, late).groupBy(F.window(arrived, width), "langue").count()
