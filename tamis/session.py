"""Session helpers: builder for local runs, shared checkpoint folder, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Bytes up to which it may be.
BROADCAST_BYTES = 32_000_000


def local_session(cpus: int | str = 8, memory: str = "20g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster the session comes from the caller."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tamis")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per context, so that they need no installation of it."""
    sc = spark.sparkContext
    if not getattr(sc, "_tamis_shipped", False):
        root = os.path.dirname(os.path.abspath(__file__))
        at = os.path.join(tempfile.mkdtemp(prefix="tamis-package-"), "tamis.zip")
        with zipfile.ZipFile(at, "w") as z:
            for folder, _, files in os.walk(root):
                for f in files:
                    if f.endswith(".py"):
                        z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), os.path.dirname(root)))
        sc.addPyFile(at)
        sc._tamis_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's `spark.checkpoint.dir`. A local session without one gets a folder
    of its own, removed when Python ends; on a cluster that is an error, as no machine's folder is shared there."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if at is None:
        now = sc._jsc.sc().getCheckpointDir()
        if now.isDefined():
            return now.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tamis-checkpoint-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Writes `df` to the shared folder and reads it again, so that what follows neither recomputes it nor depends on an executor.
    With spark.cleaner.referenceTracking.cleanCheckpoints (as in local_session()) it is deleted when nothing refers to it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """`df` (already cut) with a broadcast hint if it has at most `rows` rows of at most `size` bytes (as JSON) in all; without
    a hint otherwise, so that the join shuffles."""
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if found.n <= rows and found.b <= size else df


#: Tables with long texts, whose rows cost far more to work on than to move.
TEXTS = ("chunks", "documents")


#: Splits up to which a table of texts is spread: at most as many times spark.sql.files.maxPartitionBytes is moved, 2 GB.
SPREAD_SPLITS = 16


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores, if its files give fewer splits than there are cores and SPREAD_SPLITS at most (a file of one row
    group is one task however large); unchanged otherwise, so that no more than those splits' bytes are ever moved."""
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < min(cores, SPREAD_SPLITS + 1) else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df) if name in TEXTS else df
