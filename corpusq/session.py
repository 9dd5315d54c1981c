"""Session settings the operators rely on, and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning does the broadcast-or-shuffle choice from measured sizes,
# coalesces small shuffle partitions and splits skewed ones.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Batches handed to Python are bounded by rows and by bytes: texts may be long.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    # A union that claims the partitioning of its inputs does not survive a checkpoint
    # under AQE in 4.1 (partitions are zipped wrongly), so it is told not to.
    "spark.sql.unionOutputPartitioning": "false",
}


def build_session(app: str = "corpusq", master: str | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings above; `conf` adds or overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    """Set the runtime settings on a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it.

    A folder of our own is made only when the session names none and everything runs in this
    one process (tests); on a cluster without the setting this is an error.
    """
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None)
    if shared:
        return shared
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    safe = "spark.sql.unionOutputPartitioning"
    df.sparkSession.conf.set(safe, RUNTIME_CONF[safe])
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def keep(df: DataFrame, by: str | None = None) -> DataFrame:
    """A result that is read several times, written once to a table in the shared folder.

    Its files tell Spark its true size, by which joins then choose to broadcast it or not.
    With `by`, rows of one value of that column are read without the others.
    """
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    if by is None:
        df.write.parquet(path)
    else:
        df.repartition(by).write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
