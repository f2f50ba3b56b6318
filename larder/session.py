"""Session helpers: table reading and durable cuts of a plan."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle: int = 8, memory: str = "8g", checkpoints: str | None = None) -> SparkSession:
    """A session for tests and benchmarks on one machine; ``checkpoints`` is the folder of durable cuts."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("larder")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    return (builder.config("spark.checkpoint.dir", checkpoints) if checkpoints else builder).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan with at least as many partitions as the session has cores.

    Files too small to be split would leave heavy per-row work to a few tasks;
    large inputs have more partitions than cores and stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for an exchange whose number must be fixed beforehand."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def durable(df: DataFrame) -> DataFrame:
    """Cut the plan with a reliable checkpoint.

    The folder is the one set on the context or the one the cluster names in
    ``spark.checkpoint.dir``. Only a local master, which has no other machines,
    gets a temporary folder where both are unset; a cluster must name one. The
    files survive the loss of any executor, and are removed once nothing refers
    to them any more where the session has
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("no shared folder for checkpoints: set spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="larder-checkpoint-"))
    return df.checkpoint(eager=True)


def within(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than one row beyond the bound."""
    return df.limit(rows + 1).count() <= rows
