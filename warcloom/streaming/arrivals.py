"""Archive files as they arrive: records as a stream, and verification whose references and segments span all files so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import verify as ve
from ..scratch import cut
from ..sources.archive import register


def stream_records(spark: SparkSession, folder: str, **options) -> DataFrame:
    """records of each new file of a folder, once."""
    register(spark)
    return spark.readStream.format("warc").options(**options).load(folder)


def verify_stream(records: DataFrame, state_path: str, problems_path: str, checkpoint: str, exclude=(), available_now: bool = True) -> StreamingQuery:
    """Verifies each micro-batch: its own rules' problems go to problems_path/batch=N, its ids, references and segments
    to state_path/.../batch=N. A repeated batch overwrites what it wrote. `open_problems` gives what the whole state lacks."""
    checks = tuple(c for c in ve.CHECKS if c not in exclude)

    def each(batch: DataFrame, number: int) -> None:
        # the source's rows are read once, for a table of short rows that the writes below share
        slim = cut(ve.survey(batch, checks, own=True), "arrivals-survey")
        ve.own_problems(slim, checks).write.mode("overwrite").parquet(f"{problems_path}/batch={number}")
        state = ve.State.of_survey(slim)
        for name in ("ids", "refs", "segments"):
            getattr(state, name).write.mode("overwrite").parquet(f"{state_path}/{name}/batch={number}")

    writer = records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def open_problems(spark: SparkSession, state_path: str, exclude=()) -> DataFrame:
    """Dangling references and segment problems over all batches so far."""
    checks = tuple(c for c in ve.CHECKS if c not in exclude)
    read = lambda n: spark.read.parquet(f"{state_path}/{n}").drop("batch")
    return ve.state_problems(ve.State(read("ids").distinct(), read("refs").distinct(), read("segments")), checks)


def counts_by_window(records: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Records by type and window of WARC-Date, with a watermark for late files (an extension)."""
    from ..functions.fields import field_or_empty, rfc3339

    at = records.select(rfc3339(field_or_empty("fields", "WARC-Date")).alias("at"), field_or_empty("fields", "WARC-Type").alias("warc_type")).where("at IS NOT NULL")
    return at.withWatermark("at", late).groupBy(F.window("at", width), "warc_type").count()
