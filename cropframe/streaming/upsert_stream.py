"""K5: incremental ingest of landed yield files with Structured Streaming.

A file source picks up new CSV files; each micro-batch is cleaned and
merged into the stored yields table by natural key. The keyed
last-write-wins merge is idempotent, so a batch replayed after a failure
gives the same table and no watermark is needed. Progress (which files were
consumed) lives in the checkpoint folder, which must be on shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropframe.operators import clean, upsert
from cropframe.sources import schemas
from cropframe.sources.files import explode_records

YIELD_ORDER = ["src_epoch", "src_file", "src_block", "src_row"]


def landed_yield_stream(spark: SparkSession, landing: str, kind: str = "csv") -> DataFrame:
    """Streaming read of the yield landing folder (explicit schema).

    ``kind`` "csv" reads the survey CSV; "json" reads service response
    objects (one per file, rows under ``data``).
    """
    r = spark.readStream.option("maxFilesPerTrigger", 1000)
    if kind == "json":
        df = r.schema(schemas.YIELD_JSON).option("multiLine", True).json(landing)
    else:
        df = r.schema(schemas.YIELD_CSV).option("header", True).csv(landing)
    return (df.withColumn("src_file", F.col("_metadata.file_path"))
              .withColumn("src_block", F.col("_metadata.file_block_start")))


def _clean_json_batch(batch: DataFrame) -> DataFrame:
    """Response objects of one micro-batch -> cleaned yield rows (S2 rules)."""
    recs = explode_records(batch, ["src_file", "src_block", "src_epoch"])
    return clean.clean_yield_json(recs).filter(F.col("crop").isNotNull())


def stream_upsert(spark: SparkSession, landing: str, store: str, checkpoint: str | None = None,
                  start_year=None, end_year=None, available_now: bool = True,
                  kind: str = "csv"):
    """Start the incremental upsert; returns the StreamingQuery.

    ``available_now`` processes what has landed and stops (a scheduled
    incremental job); otherwise it keeps running with a 1-minute trigger.
    """
    # progress lives beside the table it describes, unless a shared folder is named
    ckpt = checkpoint or f"{store.rstrip('/')}/_progress/yield-stream"
    path = f"{store}/yields"

    def merge_batch(batch: DataFrame, epoch: int) -> None:
        batch = batch.withColumn("src_epoch", F.lit(epoch))
        if kind == "json":
            rows = _clean_json_batch(batch)
            if start_year is not None:
                rows = rows.filter(F.col("year") >= int(start_year))
            if end_year is not None:
                rows = rows.filter(F.col("year") <= int(end_year))
        else:
            # Row order inside a file is only available on the static batch.
            batch = batch.withColumn("src_row", F.monotonically_increasing_id())
            rows = clean.clean_yield_csv(batch, start_year, end_year)
        upsert.upsert_table(batch.sparkSession, path, rows, schemas.YIELD_KEY, YIELD_ORDER,
                            ["value", "unit"], ["district", "county_ansi"],
                            partition_by=["state"], schema=schemas.YIELDS)

    w = (landed_yield_stream(spark, landing, kind).writeStream.foreachBatch(merge_batch)
         .option("checkpointLocation", ckpt))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
