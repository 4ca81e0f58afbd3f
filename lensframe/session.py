"""Session factory and the helpers every long job shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "lensframe", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster use the one that spark-submit gives."""
    n = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the cluster's ``spark.checkpoint.dir``.

    Only where a local session names none (tests, a single machine) a temporary one is set, and removed at the end. On a cluster a folder of one machine
    would lose what other machines wrote, so a session without one is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if not current:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        current = tempfile.mkdtemp(prefix="lensframe-checkpoint-")
        atexit.register(shutil.rmtree, current, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there: survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``cut``, as a compressed table by column: for wide rows of which later steps read a part. Removed when the program ends."""
    spark = df.sparkSession
    where = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(where)
    atexit.register(_remove, spark.sparkContext, where)
    return spark.read.schema(df.schema).parquet(where)


def _remove(sc, where: str) -> None:  # noqa: ANN001
    try:
        path = sc._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session is gone, and what it wrote is the cluster's to clear
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
