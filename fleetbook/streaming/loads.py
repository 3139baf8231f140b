"""Posted entry forms as a stream: each micro-batch runs the load job.

Forms land as files in ``forms_path``. Every micro-batch is cleaned and
validated in its posters' sessions, checked against the entries stored so
far (the base table plus every earlier batch) and split into accepted rows
and rejects, exactly as the batch job does (``operators.loads``).

Exactly-once output: batch ``n`` writes to ``.../ingest_batch=n`` with
overwrite, so a micro-batch that is retried after a failure replaces its own
output instead of appending twice; the stream's checkpoint (in the shared
checkpoint folder) records which batches are done.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetbook.operators import loads as L


def _read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], like.schema)  # nothing ingested yet


def ingest_entry_forms(spark: SparkSession, forms_path: str, forms_schema: T.StructType,
                       base_entries: DataFrame, users: DataFrame, drivers: DataFrame,
                       cars: DataFrame, out_path: str, checkpoint_location: str,
                       as_of: dt.date, available_now: bool = True,
                       max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the ingest stream; accepted rows go to ``{out_path}/entries``,
    rejects (with reasons) to ``{out_path}/rejects``."""
    key = L.ENTRY_KEY
    loads_path, rejects_path = f"{out_path}/entries", f"{out_path}/rejects"

    def process(batch: DataFrame, batch_id: int) -> None:
        cleaned = L.clean_entry_forms(batch, users, as_of)
        validated = L.validate_entry_loads(cleaned, drivers, cars)
        earlier = _read_or_empty(spark, loads_path, base_entries.select(*key))
        if "ingest_batch" in earlier.columns:  # a retried batch does not see its own output
            earlier = earlier.where(F.col("ingest_batch") != batch_id)
        existing = base_entries.select(*key).unionByName(earlier.select(*key))
        accepted, rejected = L.split_loads(validated, existing)
        L.derive_entries(accepted).write.mode("overwrite").parquet(f"{loads_path}/ingest_batch={batch_id}")
        (rejected.select("form_seq", "posted_by", "reasons")
                 .write.mode("overwrite").parquet(f"{rejects_path}/ingest_batch={batch_id}"))

    reader = spark.readStream.schema(forms_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(forms_path)
    writer = (stream.writeStream.foreachBatch(process)
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
