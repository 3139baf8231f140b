"""Spark session settings for fleetbook jobs.

The settings are the ones a cluster job wants as well: adaptive query
execution (runtime coalescing, skew-join splitting, broadcast conversion from
measured sizes), UTC session clock, ANSI arithmetic, and no web UI.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings applied to every session built here. Broadcast joins are only
# chosen by Spark itself, from plan statistics (autoBroadcastJoinThreshold)
# or from the measured size of a finished shuffle stage (AQE); no operator in
# this package forces a broadcast of a table whose size grows with the data.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def sizing_conf(input_bytes: int, total_cores: int, split_bytes: int = 256 * 1024 * 1024,
                shuffle_bytes: int = 128 * 1024 * 1024) -> dict[str, str]:
    """Partition sizing for a job reading ``input_bytes`` on ``total_cores``.

    Scan splits of ``split_bytes`` keep each task's input bounded. The
    initial shuffle partition count aims at ``shuffle_bytes`` per reduce task
    for a shuffle as large as the input, and is 3 waves of tasks at least, so
    a reducer's share does not grow with the data. Adaptive execution
    coalesces small shuffles back to the advisory size, so one setting serves
    a month report and a full backfill.
    """
    by_size = -(-input_bytes // shuffle_bytes)
    partitions = max(3 * total_cores, by_size)
    return {
        "spark.sql.files.maxPartitionBytes": str(split_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(shuffle_bytes),
    }


def build_session(
    master: str | None = None,
    cpus: int | None = None,
    app_name: str = "fleetbook",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
    input_bytes: int | None = None,
    total_cores: int | None = None,
) -> SparkSession:
    """Build (or reuse) a session with fleetbook's settings.

    A master is set only when given (``master``, or ``cpus`` for a local
    session); otherwise the one configured by spark-submit is used.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is None and cpus is not None:
        master = f"local[{cpus}]"
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if input_bytes is not None:
        conf.update(sizing_conf(input_bytes, total_cores or cpus or 8))
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` (or a folder set on the context) names a shared,
    fault-tolerant folder and is used as is. Where neither is set, only a
    single-JVM local session gets a scratch folder; any other must set one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="fleetbook-ckpt-"))
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as parquet in the shared checkpoint folder and read back.

    Cuts the lineage of iterative jobs: what a lost executor held is read again.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
