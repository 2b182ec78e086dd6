"""Sessions, input tables, and tables written to the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cpus: int = 8, **conf) -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


ARROW_ROWS, ARROW_BYTES = 2000, 16 << 20
WORKER_MEMORY = {  # large arrays go back to the system when they are freed; workers live on between stages
    "MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "4194304", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it is not installed (a shared or single machine), give freed memory back,
    and send them batches of ARROW_ROWS rows and about ARROW_BYTES bytes at most: several copies of a batch live in a
    worker, and Spark's defaults are 10,000 rows and no bound on bytes. Lower settings of the session stay as they are; the
    batch settings hold for the session from then on."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key)
        if not now.isdigit() or int(now) > most or int(now) <= 0:
            spark.conf.set(key, most)
    env = spark.sparkContext.environment
    for key, value in WORKER_MEMORY.items():
        env.setdefault(key, value)
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary folder, on a local master only."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/lexloom-{sc.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; Spark deletes it when the application ends."""
    path = f"{shared_folder(spark)}/lexloom/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).deleteOnExit(p)
    return path


def materialize(df: DataFrame, name: str, sift: int = 0) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage, outlives lost executors, and gives the optimizer the table's true size, by which
    Spark broadcasts it below spark.sql.autoBroadcastJoinThreshold and shuffles it above. With sift, see sifted().
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    with sifted(spark, sift) if sift else nullcontext():
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no plan reads any more."""
    for df in tables:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


@contextmanager
def sifted(spark: SparkSession, keys: int):
    """Inside, Spark sends a Bloom filter of one side's keys (filtered by a comparison) to the scan of the other side of a
    shuffle join, whatever the sizes, so rows without a partner stay out of the shuffle. keys: about how many there are. The
    filter has 64 million bits at most; beyond some ten million keys it lets more rows pass, never fewer."""
    prefix = "spark.sql.optimizer.runtime.bloomFilter."
    bits = max(1 << 20, min(10 * keys, 1 << 26))
    wanted = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": str(1 << 50), "numBits": str(bits), "expectedNumItems": str(max(1, min(keys, 4_000_000)))}
    before = {k: spark.conf.get(prefix + k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(prefix + k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(prefix + k, v)
